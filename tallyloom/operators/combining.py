"""Small sets of documents that sum to one transaction."""

from __future__ import annotations

from decimal import Decimal
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.config import MICRO, Settings
from tallyloom.functions.amounts import MONEY
from tallyloom.operators.ranking import best_documents, best_sets
from tallyloom.operators.scoring import (
    SIGNALS, cited, date_signal, needed, outgoing, pair_signals, prepared_documents, prepared_transactions, with_rows, with_total,
)
from tallyloom.scratch import cut

#: A pool with more sets than this is not tried set by set.
TRIED = 5_000


def combination_pool(transactions: DataFrame, documents: DataFrame, settings: Settings) -> DataFrame:
    """For each outgoing transaction the ``pool_limit`` best documents of its
    scope and currency with a smaller amount, numbered from 1: by merchant, then
    date gap, then larger amount, then id.

    They are found by a walk over ranked names; the rows' texts come by id.
    """
    t = cut(prepared_transactions(outgoing(transactions)), "pool-transactions")
    d = cut(prepared_documents(documents), "pool-documents")
    best = best_documents(t, d, settings, settings.combinations.pool_limit)
    found = t.join(best, ["scope_id", "transaction_id"])
    return found.join(d, (F.col("scope_id") == F.col("d_scope")) & (found["document_id"] == d["document_id"])).drop(found["document_id"])


def combination_sets(pool: DataFrame, settings: Settings) -> DataFrame:
    """Sets of 2 to ``max_documents`` pool members whose amounts sum to the
    transaction's within the tolerance: scope_id, transaction_id, places.

    A set is a lower part of one or two members and an upper part of higher
    places, and the parts meet by an equi-join on what the lower one leaves of
    the amount: one and one, two and one, two and two, two and three.  With a
    tolerance, sums meet in buckets of twice its width.  Parts past the amount
    are dropped, which loses nothing as amounts are positive.
    """
    tolerance = Decimal(settings.amount_tolerance)
    slack = F.lit(settings.amount_tolerance).cast(MONEY)
    key = ["scope_id", "transaction_id"]
    total = "decimal(38,8)"
    slim = pool.select(*key, F.col("amount").alias("target"), F.col("d_amount").cast(total).alias("sum"), F.array("place").alias("places"), F.col("place").alias("first"), F.col("place").alias("last"))

    def longer(part: DataFrame) -> DataFrame:
        one = slim.select(*key, F.col("sum").alias("one"), F.col("last").alias("p"))
        grown = part.join(one, key).where((F.col("p") > F.col("last")) & (F.col("sum") + F.col("one") <= F.col("target") + slack))
        return grown.select(*key, "target", (F.col("sum") + F.col("one")).cast(total).alias("sum"), F.concat("places", F.array("p")).alias("places"), "first", F.col("p").alias("last"))

    def met(lower: DataFrame, upper: DataFrame) -> DataFrame:
        left = lower.select(*key, (F.col("target") - F.col("sum")).cast(total).alias("rest"), F.col("places").alias("low"), "last")
        right = upper.select(*key, "sum", F.col("places").alias("high"), "first")
        if tolerance:
            width = F.lit(2 * tolerance).cast(MONEY)
            bucket = lambda x: F.floor(x / width).cast("decimal(38,0)")
            at = bucket(F.col("rest") - slack)
            left = left.withColumn("at", F.explode(F.array(at, (at + 1).cast("decimal(38,0)"))))
            right = right.withColumn("at", bucket(F.col("sum")))
        else:
            left, right = left.withColumn("at", F.col("rest")), right.withColumn("at", F.col("sum"))
        both = left.join(right, [*key, "at"]).where((F.col("first") > F.col("last")) & (F.abs(F.col("rest") - F.col("sum")) <= slack))
        return both.select(*key, F.concat("low", "high").alias("places"))

    most = settings.combinations.max_documents
    found = met(slim, slim)
    pairs = cut(longer(slim), "pool-pairs") if most > 2 else None
    uppers = [slim, pairs, longer(pairs) if most > 4 else None]
    for upper in uppers[: most - 2]:
        found = found.unionByName(met(pairs, upper))
    return found


def summing_sets(transactions: DataFrame, documents: DataFrame, settings: Settings) -> DataFrame:
    """The sets of each outgoing transaction's pool that sum to its amount within
    the tolerance: scope_id, transaction_id, places and document_ids.

    The walk that finds a pool tries its sets at once, so pools are not shuffled.
    Pools with too many sets for that meet by joins of their parts."""
    wanted, most = settings.combinations.pool_limit, settings.combinations.max_documents
    if sum(comb(wanted, k) for k in range(2, most + 1)) <= TRIED:
        return best_sets(prepared_transactions(outgoing(transactions)), prepared_documents(documents), settings, wanted, most)
    pool = cut(combination_pool(transactions, documents, settings), "pool")
    key = ["scope_id", "transaction_id"]
    ids = pool.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("place", "document_id"))).alias("ids"))
    return combination_sets(pool, settings).join(ids, key).select(*key, "places", F.transform("places", lambda p: F.element_at("ids", p)).alias("document_ids"))


def combination_proposals(transactions: DataFrame, documents: DataFrame, settings: Settings, sets: DataFrame | None = None) -> DataFrame:
    """Proposals of document sets with group scores; MISSING ones left out.  With
    ``sets`` that are known both tables need only the rows of these.

    Merchant is the least and date the largest of the members', null if any is;
    the reference is the best that is present."""
    key = ["scope_id", "transaction_id"]
    ids = lambda sets: sets.select(*key, "places", F.posexplode("document_ids").alias("place", "document_id"))
    if sets is None:
        sets = cut(summing_sets(transactions, documents, settings), "sets")
        transactions, documents = needed(transactions, documents, ids(sets))
    members = with_rows(ids(sets), transactions, documents)
    scored = pair_signals(members, settings)
    whole = lambda of, name: F.when(F.count(name) == F.count(F.lit(1)), of(name))
    grouped = scored.groupBy(*key, "posted_date", "places").agg(
        F.array_sort(F.collect_list(F.struct("place", cited().alias("c")))).alias("members"),
        whole(F.min, "merchant_score").alias("merchant_score"),
        whole(F.max, "date_delta_days").alias("gap"),
        F.max("reference_score").alias("reference_score"),
    )
    million = F.lit(MICRO).cast("long")
    grouped = grouped.select(
        *key, "posted_date", F.transform("members", lambda m: m["c"]).alias("documents"), million.alias("amount_score"),
        million.alias("currency_score"), "merchant_score", date_signal(F.col("gap"), settings).alias("date_score"), "reference_score",
    )
    return with_total(grouped, settings).where("status <> 'MISSING'").select(
        *key, "posted_date", F.transform("documents", lambda c: c["document_id"]).alias("document_ids"), "documents",
        "status", "score", *SIGNALS, F.lit(True).alias("group_amount_exact"),
    )
