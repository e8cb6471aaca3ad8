"""Candidate pairs of transactions and documents, and their scores.

Scores are whole millionths, so that sums and thresholds are exact.  Null means
that a signal could not be evaluated, 0 that it was and did not match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import MICRO, Settings, micros
from tallyloom.functions.amounts import MONEY, currency_safe_equal
from tallyloom.functions.columns import half_up
from tallyloom.functions.merchants import merchant_signal, normalize_merchant
from tallyloom.functions.references import reference_signal
from tallyloom.operators.prefilter import inner_joined, semi_joined
from tallyloom.scratch import cut

TXN = ["scope_id", "transaction_id", "posted_date", "amount", "currency", "description", "m1", "m2", "m3"]


def outgoing(transactions: DataFrame) -> DataFrame:
    """The transactions that are reconciled."""
    return transactions.where("direction = 'outgoing'")


def prepared_transactions(transactions: DataFrame) -> DataFrame:
    """With normalised names: of the merchant, of that again, of the description."""
    names = transactions.withColumn("m1", normalize_merchant(F.col("merchant_raw")))
    names = names.withColumn("m2", normalize_merchant(F.col("m1"))).withColumn("m3", normalize_merchant(F.col("description")))
    return names.withColumnRenamed("id", "transaction_id").select(*TXN)


def prepared_documents(documents: DataFrame) -> DataFrame:
    names = documents.withColumn("d_m1", normalize_merchant(F.col("merchant_raw"))).withColumn("d_m2", normalize_merchant(F.col("d_m1")))
    return names.select(
        F.col("scope_id").alias("d_scope"), F.col("id").alias("document_id"), "issued_date", F.col("amount").alias("d_amount"),
        F.col("currency").alias("d_currency"), "invoice_number", "extracted_text", "d_m1", "d_m2",
    )


def name_signals(different: DataFrame, settings: Settings) -> DataFrame:
    """The signal of each of the different pairs (name_l, name_r), written once."""
    return cut(different.select("name_l", "name_r", merchant_signal(F.col("name_l"), F.col("name_r"), settings).alias("signal")), "name-signals")


def with_merchant_signals(pairs: DataFrame, names: dict[str, tuple[str, str]], settings: Settings) -> DataFrame:
    """Add signals of pairs of normalised names, ``names`` giving for each new
    column the two it compares.

    Rows are written once, as they are read for the different pairs of names
    and again for the join; each pair of names is compared once.
    """
    pairs = cut(pairs, "pairs")
    met = None
    for left, right in names.values():
        part = pairs.select(F.col(left).alias("name_l"), F.col(right).alias("name_r"))
        met = part if met is None else met.unionByName(part)
    signals = name_signals(met.where("name_l <> '' and name_r <> ''").distinct(), settings)
    for name, (left, right) in names.items():
        part = signals.select(F.col("name_l").alias(left), F.col("name_r").alias(right), F.col("signal").alias(name))
        pairs = pairs.join(part, [left, right], "left")
    return pairs


def date_signal(gap: Column, settings: Settings) -> Column:
    bands = settings.dates
    steps = [
        (bands.strong_days, bands.same_day_score), (bands.close_days, bands.close_score),
        (bands.near_days, bands.near_score), (settings.date_tolerance_days, bands.outer_score),
    ]
    found = F.when(gap.isNull(), F.lit(None).cast("long"))
    for days, score in steps:
        found = found.when(gap <= days, F.lit(micros(score)).cast("long"))
    return found.otherwise(F.lit(0).cast("long"))


def weighted(amount: Column, currency: Column, merchant: Column, date: Column, reference: Column, settings: Settings) -> Column:
    """The total in millionths, halves up; missing signals count as 0."""
    w = settings.weights
    parts = ((w.amount, amount), (w.currency, currency), (w.merchant, merchant), (w.date, date), (w.reference, reference))
    total = sum((micros(weight) * F.coalesce(score, F.lit(0)) for weight, score in parts[1:]), micros(parts[0][0]) * F.coalesce(amount, F.lit(0)))
    return F.greatest(F.lit(0), F.least(F.lit(MICRO), half_up(total, F.lit(MICRO)))).cast("long")


def classified(total: Column, amount: Column, currency: Column, merchant: Column, reference: Column, settings: Settings) -> Column:
    """CONFIRMED, PROBABLE or MISSING."""
    yes = lambda score: F.coalesce(score == MICRO, F.lit(False))
    at_least = lambda bound: F.coalesce(merchant >= micros(bound), F.lit(False))
    bands = settings.merchants
    sure = (total >= micros(settings.confirmed)) & yes(amount) & yes(currency) & (at_least(bands.strong) | yes(reference))
    credible = (total >= micros(settings.probable)) & (at_least(bands.moderate) | yes(reference))
    return F.when(sure, "CONFIRMED").when(credible, "PROBABLE").otherwise("MISSING")


def _flag(value: Column) -> Column:
    return F.when(value, F.lit(MICRO)).when(~value, F.lit(0)).cast("long")


def pair_signals(pairs: DataFrame, settings: Settings) -> DataFrame:
    """The five signals of each pair of prepared rows."""
    pairs = with_merchant_signals(pairs, {"s1": ("m1", "d_m1"), "s2": ("m2", "d_m2"), "s3": ("m3", "d_m1")}, settings)
    exact = currency_safe_equal(F.col("amount"), F.col("currency"), F.col("d_amount"), F.col("d_currency"), settings.amount_tolerance)
    gap = F.abs(F.datediff("posted_date", "issued_date"))
    reference = reference_signal(F.col("description"), F.col("invoice_number"), F.col("extracted_text"), settings.reference_minimum_length)
    return (
        pairs.withColumn("amount_exact", exact)
        .withColumn("date_delta_days", gap)
        .withColumn("amount_score", _flag(F.col("amount_exact")))
        .withColumn("currency_score", _flag(F.col("currency") == F.col("d_currency")))
        .withColumn("merchant_score", F.greatest("s1", "s2", "s3"))
        .withColumn("date_score", date_signal(F.col("date_delta_days"), settings))
        .withColumn("reference_score", reference)
        .drop("s1", "s2", "s3")
    )


SIGNALS = ("amount_score", "currency_score", "merchant_score", "date_score", "reference_score")


def with_total(scored: DataFrame, settings: Settings) -> DataFrame:
    amount, currency, merchant, date, reference = map(F.col, SIGNALS)
    scored = scored.withColumn("score", weighted(amount, currency, merchant, date, reference, settings))
    return scored.withColumn("status", classified(F.col("score"), amount, currency, merchant, reference, settings))


def candidate_pairs(transactions: DataFrame, documents: DataFrame, settings: Settings, pruned: bool = True) -> DataFrame:
    """The ids of all pairs of one scope whose currencies are equal or whose
    document has none, written.

    ``pruned`` replaces the join on scope and currency, whose size is the
    product of both sides, by equi-joins on amount or on date, wherever the
    weights prove that other pairs cannot reach the probable threshold.  Only
    ids and a hash of the key are shuffled there, and of documents those that
    may meet a transaction; what hashes alone bring together is dropped by
    ``scored_pairs``.
    """
    # Keys are hashed, so both sides have the same types.
    kinds = transactions.select("scope_id", "posted_date").schema
    t = outgoing(transactions).select("scope_id", F.col("id").alias("transaction_id"), "currency", F.col("amount").cast(MONEY).alias("amount"), "posted_date")
    d = documents.select(
        F.col("scope_id").cast(kinds[0].dataType).alias("d_scope"), F.col("id").alias("document_id"), F.col("currency").alias("d_currency"),
        F.col("amount").cast(MONEY).alias("d_amount"), F.col("issued_date").cast(kinds[1].dataType).alias("issued_date"),
    )
    scope = t["scope_id"] == d["d_scope"]
    same = scope & (t["currency"] == d["d_currency"])
    w, dates = settings.weights, settings.dates
    probable = micros(settings.probable)
    slack = MICRO - micros(w.amount) - probable  # what a pair of other amount can miss
    later = micros(w.date) * (MICRO - micros(dates.close_score)) // MICRO
    unknown_currency = micros(w.merchant) + micros(w.date) + micros(w.reference) >= probable
    parts = []
    if pruned and float(settings.amount_tolerance) == 0 and slack < later and dates.strong_days == 0:

        def keyed(rows: DataFrame, names: list[str], *ids: str) -> DataFrame:
            return rows.dropna(subset=names).select(F.xxhash64(*names).alias("key"), *ids)

        for on in (("amount", "d_amount"), ("posted_date", "issued_date"))[: 1 + (slack >= 0)]:
            left = keyed(t, ["scope_id", "currency", on[0]], "scope_id", "transaction_id")
            parts.append(inner_joined(keyed(d, ["d_scope", "d_currency", on[1]], "document_id"), left, ["key"]))
    else:
        parts.append(t.join(d, same))
    if unknown_currency or not pruned:
        parts.append(t.join(d.where("d_currency is null"), scope))
    ids = ["scope_id", "transaction_id", "document_id"]
    pairs = parts[0].select(ids)
    for part in parts[1:]:
        pairs = pairs.unionByName(part.select(ids))
    return cut(pairs.distinct(), "candidate-pairs")


def needed(transactions: DataFrame, documents: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that ``pairs`` of ids name, written; names are
    normalised and texts moved for these alone."""
    ids = lambda side: pairs.select("scope_id", F.col(side).alias("id"))
    rows = lambda table, side: cut(semi_joined(table, ids(side), ["scope_id", "id"]), f"needed-{side}")
    unused = [c for c in ("filename", "source_file") if c in documents.columns]
    return rows(outgoing(transactions), "transaction_id"), rows(documents.drop(*unused), "document_id")


def with_rows(pairs: DataFrame, transactions: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs of ids with both sides' prepared rows."""
    t, d = prepared_transactions(transactions), prepared_documents(documents).withColumnRenamed("document_id", "d_id")
    met = pairs.join(t, ["scope_id", "transaction_id"])
    return met.join(d, (F.col("scope_id") == F.col("d_scope")) & (F.col("document_id") == F.col("d_id"))).drop("d_id")


def scored_pairs(transactions: DataFrame, documents: DataFrame, settings: Settings, pruned: bool = True, pairs: DataFrame | None = None) -> DataFrame:
    """The candidate pairs (``pairs`` of ids, if they are known and both tables have
    their rows; ids are unique in a scope) with signals, total and status; MISSING pairs are left out."""
    if pairs is None:
        pairs = candidate_pairs(transactions, documents, settings, pruned)
        transactions, documents = needed(transactions, documents, pairs)
    rows = with_rows(pairs, transactions, documents).where("d_currency is null or currency = d_currency")
    return with_total(pair_signals(rows, settings), settings).where("status <> 'MISSING'")


def cited() -> Column:
    """A document as evidence."""
    return F.struct("document_id", "amount_exact", F.col("merchant_score").alias("merchant_similarity"), "date_delta_days", "issued_date")


def single_proposals(transactions: DataFrame, documents: DataFrame, settings: Settings, pruned: bool = True, pairs: DataFrame | None = None) -> DataFrame:
    pairs = scored_pairs(transactions, documents, settings, pruned, pairs)
    return pairs.select(
        "scope_id", "transaction_id", "posted_date", F.array("document_id").alias("document_ids"), F.array(cited()).alias("documents"),
        "status", "score", *SIGNALS, F.lit(False).alias("group_amount_exact"),
    )
