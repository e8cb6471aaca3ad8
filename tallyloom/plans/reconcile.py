"""Reconciliation: from transactions and documents to matches and links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import MICRO, Settings, micros
from tallyloom.operators.assignment import conflicts, greedy_assign, ranked
from tallyloom.operators.combining import combination_proposals, summing_sets
from tallyloom.operators.prefilter import anti_joined, left_joined, semi_joined
from tallyloom.operators.scoring import SIGNALS, candidate_pairs, needed, outgoing, single_proposals
from tallyloom.scratch import cut

# The sentences and phrases of reasons.
NO_CANDIDATE = "No supporting document found with sufficient evidence."
TAKEN = ("Document ", " is already used by transaction ", ". The same document is not assigned to a second transaction.")
GROUP_SUMS = "Documents in the same currency sum to the transaction amount"
EXACT_MONEY, OTHER_CURRENCY, OTHER_AMOUNT, NO_MONEY = "Exact amount and currency", "Currency differs", "Amount differs", "Amount or currency is missing"
NO_NAME, STRONG_NAME = "merchant was not available", "strong merchant match"
MODERATE_NAME, WEAK_NAME = "merchant similarity is moderate", "merchant similarity is weak"
NO_DATE, SAME_DAY, DATE_IS, TO_TRANSACTION, UP_TO = "document date is missing", "dates are the same day", "document date is ", " the transaction", "dates differ by up to "
SAME_REFERENCE, CLASSIFIED = "invoice or reference text matches", ". Classified as "


class MatchError(ValueError):
    """Input or result breaks a rule of matching."""


@dataclass(frozen=True)
class Reconciliation:
    """Matches, one row per outgoing transaction, and the tables around them."""

    transactions: DataFrame
    documents: DataFrame
    matches: DataFrame

    def links(self) -> DataFrame:
        """One row for each document that a match cites, in order."""
        cited = self.matches.select("scope_id", "transaction_id", F.posexplode("documents").alias("pos", "c"))
        return cited.select("scope_id", "transaction_id", "pos", "c.document_id", "c.amount_exact", "c.merchant_similarity", "c.date_delta_days")

    def references(self) -> DataFrame:
        """Every document with the transactions that cite it, unused ones too."""
        links = self.links().groupBy("scope_id", "document_id").agg(F.array_sort(F.collect_list("transaction_id")).alias("transaction_ids"))
        docs = self.documents.withColumnRenamed("id", "document_id")
        none = F.array().cast("array<string>")
        return left_joined(docs, links, ["scope_id", "document_id"]).withColumn("transaction_ids", F.coalesce("transaction_ids", none))

    def unmatched_documents(self) -> DataFrame:
        used = self.links().select("scope_id", F.col("document_id").alias("id"))
        return anti_joined(self.documents, used, ["scope_id", "id"])


def proposals(transactions: DataFrame, documents: DataFrame, settings: Settings, pruned: bool = True) -> DataFrame:
    """All credible proposals, single and combined, with their rank.

    Candidates are found by slim rows; of the tables only their rows are scored."""
    pairs = candidate_pairs(transactions, documents, settings, pruned)
    if not settings.combinations.enabled:
        return ranked(single_proposals(*needed(transactions, documents, pairs), settings, pruned, pairs))
    sets = cut(summing_sets(transactions, documents, settings), "sets")
    members = sets.select("scope_id", "transaction_id", F.explode("document_ids").alias("document_id"))
    t, d = needed(transactions, documents, pairs.unionByName(members))
    return ranked(single_proposals(t, d, settings, pruned, pairs).unionByName(combination_proposals(t, d, settings, sets)))


def _upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def explanation(settings: Settings) -> Column:
    """The reason of a match, from the signals that were present."""
    exact = (F.col("amount_score") == MICRO) & (F.col("currency_score") == MICRO)
    money = (
        F.when(exact & F.col("group_amount_exact"), GROUP_SUMS)
        .when(exact, EXACT_MONEY)
        .when(F.col("currency_score") == 0, OTHER_CURRENCY)
        .when(F.col("amount_score") == 0, OTHER_AMOUNT)
        .when(F.col("amount_score").isNull() | F.col("currency_score").isNull(), NO_MONEY)
    )
    bands, merchant = settings.merchants, F.col("merchant_score")
    name = (
        F.when(merchant.isNull(), NO_NAME)
        .when(merchant >= micros(bands.strong), STRONG_NAME)
        .when(merchant >= micros(bands.moderate), MODERATE_NAME)
        .otherwise(WEAK_NAME)
    )
    gaps = F.transform("documents", lambda c: F.when(c["issued_date"].isNotNull(), c["date_delta_days"]))
    gap, issued = F.array_max(gaps), F.element_at("documents", 1)["issued_date"]
    unit = F.when(gap == 1, " day ").otherwise(" days ")
    side = F.when(issued < F.col("posted_date"), "before").otherwise("after")
    day = (
        F.when(F.exists(gaps, lambda g: g.isNull()), NO_DATE)
        .when(gap == 0, SAME_DAY)
        .when(F.size("documents") == 1, F.concat(F.lit(DATE_IS), gap, unit, side, F.lit(TO_TRANSACTION)))
        .otherwise(F.concat(F.lit(UP_TO), gap, F.rtrim(unit)))
    )
    reference = F.when(F.col("reference_score") == MICRO, SAME_REFERENCE)
    sentence = _upper_first(F.concat_ws("; ", money, name, day, reference))
    return F.concat(sentence, F.lit(CLASSIFIED), F.col("status"), F.lit("."))


def require_unique(table: DataFrame, what: str) -> None:
    """Raise when two rows of a scope share an id; ids are counted by their hashes,
    and themselves only where two hashes are equal."""
    hashed = table.select(F.xxhash64("scope_id", "id").alias("h"))
    if hashed.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return
    twice = table.groupBy("scope_id", "id").agg(F.count("*").alias("c")).where("c > 1").limit(1).collect()
    if twice:
        raise MatchError(f"{what} listed twice: {twice[0]['id']}")


def match_transactions(
    transactions: DataFrame, documents: DataFrame, settings: Settings | None = None, pruned: bool = True, small: int = 50_000
) -> Reconciliation:
    """Match every outgoing transaction with a document, a set of documents, or
    none, each document with one transaction at most.

    Scores are millionths.  A transaction without a match is MISSING with score
    0; its reason names the document that a better proposal took, if one did.
    """
    settings = settings or Settings()
    paid = outgoing(transactions)
    require_unique(paid, "transaction")
    require_unique(documents, "document")
    offered = cut(proposals(transactions, documents, settings, pruned), "proposals")
    taken = greedy_assign(offered, small)
    chosen = cut(offered.join(taken, ["scope_id", "rank"], "left_semi"), "chosen")
    blocked = conflicts(offered, chosen)
    found = chosen.withColumn("reason", explanation(settings)).drop("rank", "posted_date", "document_ids")
    rows = paid.withColumnRenamed("id", "transaction_id").join(found, ["scope_id", "transaction_id"], "left")
    rows = rows.join(blocked.withColumnRenamed("document_id", "blocking"), ["scope_id", "transaction_id"], "left")
    taken_text = F.concat(F.lit(TAKEN[0]), "blocking", F.lit(TAKEN[1]), "owner", F.lit(TAKEN[2]))
    empty = F.array().cast(chosen.schema["documents"].dataType)
    matches = rows.select(
        "scope_id", "transaction_id", F.coalesce("status", F.lit("MISSING")).alias("status"), F.coalesce("score", F.lit(0)).cast("long").alias("score"),
        *SIGNALS, F.coalesce("group_amount_exact", F.lit(False)).alias("group_amount_exact"), F.coalesce("documents", empty).alias("documents"),
        F.coalesce("reason", taken_text, F.lit(NO_CANDIDATE)).alias("reason"),
    )
    return Reconciliation(transactions, documents, cut(matches, "matches"))


def broken_rules(result: Reconciliation, settings: Settings | None = None) -> DataFrame:
    """Rows that break a rule of a result; none in a sound one."""
    settings = settings or Settings()
    m = result.matches
    n = F.size("documents")
    sure = (F.col("score") >= micros(settings.confirmed)) & (
        F.col("group_amount_exact") | F.forall("documents", lambda c: F.coalesce(c["amount_exact"], F.lit(False)))
    )
    rule = (
        F.when((F.col("status") == "MISSING") & (n > 0), "a missing match cites documents")
        .when((F.col("status") != "MISSING") & (n == 0), "a match cites no document")
        .when((F.col("status") == "CONFIRMED") & ~sure, "a confirmed match is not exact")
        .when(F.size(F.array_distinct(F.transform("documents", lambda c: c["document_id"]))) != n, "a match cites a document twice")
    )
    own = m.select("scope_id", F.col("transaction_id").alias("id"), rule.alias("rule"))
    reused = result.links().groupBy("scope_id", F.col("document_id").alias("id")).agg(F.count("*").alias("c")).where("c > 1")
    cited = result.links().select("scope_id", F.col("document_id").alias("id"))
    unknown = cited.join(semi_joined(result.documents.select("scope_id", "id"), cited, ["scope_id", "id"]), ["scope_id", "id"], "left_anti")
    return (
        own.where("rule is not null")
        .unionByName(reused.select("scope_id", "id", F.lit("a document is cited twice").alias("rule")))
        .unionByName(unknown.select("scope_id", "id", F.lit("a cited document is unknown").alias("rule")))
    )
