"""One-to-one assignment in rank order, computed in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.components import connected_components
from tallyloom.operators.numbering import with_running
from tallyloom.operators.prefilter import semi_joined
from tallyloom.scratch import cut


def ranked(proposals: DataFrame) -> DataFrame:
    """Proposals with ``rank``, a value whose order is the strict total order of
    their scope: confirmed first, higher score, fewer documents, then ids.

    A value that compares needs no sort of a scope in one task, which a number
    would."""
    order = F.struct(
        F.when(F.col("status") == "CONFIRMED", 0).otherwise(1).alias("s"), (-F.col("score")).alias("minus"),
        F.size("document_ids").alias("n"), F.col("transaction_id").alias("t"), F.col("document_ids").alias("d"),
    )
    return proposals.withColumn("rank", order)


def numbered(proposals: DataFrame) -> DataFrame:
    """Ranks as numbers from 1 in each scope, for reports."""
    return with_running(proposals, ["scope_id"], ["rank"], {"place": F.lit(1)})


def _walk(group: str):
    """What a walk takes of rows that come by ``group`` and rank: it keeps the
    resources that one group has used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, used = None, set()
        for batch in batches:
            free = []
            for of, resources in zip(batch.column(group).to_pylist(), batch.column("resources").to_pylist(), strict=True):
                if of != here:
                    here, used = of, set()
                free.append(used.isdisjoint(resources))
                if free[-1]:
                    used.update(resources)
            yield batch.filter(pa.array(free, pa.bool_())).select(["scope_id", "rank"])

    return run


def _walked(live: DataFrame, group: str, label: str) -> DataFrame:
    kind = live.select("scope_id", "rank").schema
    return cut(live.repartition(group).sortWithinPartitions(group, "rank").mapInArrow(_walk(group), kind), label)


def _with_components(live: DataFrame) -> DataFrame:
    """Proposals with the component of those that share resources, directly or
    over others, as a number.  Resources go by a hash; two that have the same one
    only bring components together that need not be."""
    number = lambda r: F.xxhash64("scope_id", r)
    first = number(F.element_at("resources", 1))
    links = live.select(first.alias("a"), F.explode("resources").alias("r"), "scope_id").select("a", number(F.col("r")).alias("b")).where("a <> b")
    found = connected_components(links).select(F.col("id").alias("first"), "component")
    return live.withColumn("first", first).join(found, "first", "left").withColumn("component", F.coalesce("component", "first")).drop("first")


def greedy_assign(proposals: DataFrame, small: int = 50_000, quick: float = 0.25) -> DataFrame:
    """The scope_id and rank of the proposals that a walk in rank order takes:
    each whose transaction and documents are all still free.

    Input columns: scope_id, rank (orderable, unique in a scope), transaction_id and
    document_ids.  Three ways share the work, with one result:

    1. Scopes do not touch each other, so scopes of at most ``small`` proposals are
       walked, each in one task.
    2. In larger scopes a proposal that is the best of all that touch any of its
       resources is taken whatever the others are.  Each round takes all such
       proposals at once and drops what they block.  Ranks are numbers there.
    3. Rounds end when at most ``small`` proposals are left, or when one removes
       less than the share ``quick`` of them, as along a chain in which each blocks
       the next.  What is left falls into components that share no resource; each
       is streamed by rank through a task that keeps the resources used.
    """
    t, d = F.concat(F.lit("t:"), "transaction_id"), F.transform("document_ids", lambda x: F.concat(F.lit("d:"), x))
    every = cut(proposals.select("scope_id", "rank", F.concat(F.array(t), d).alias("resources")), "greedy")
    giants = cut(every.groupBy("scope_id").agg(F.count("*").alias("c")).where(F.col("c") > small).select("scope_id"), "greedy-giants")
    if giants.isEmpty():
        return _walked(every, "scope_id", "greedy-small")
    taken = _walked(every.join(giants, "scope_id", "left_anti"), "scope_id", "greedy-small")
    places = with_running(every.join(giants, "scope_id", "left_semi"), ["scope_id"], ["rank"], {"place": F.lit(1)})
    places = cut(places, "greedy-places")
    live = places.select("scope_id", F.col("place").alias("rank"), "resources")
    won = live.select("scope_id", "rank").where("false")
    left = live.count()
    while left > small:
        spread = live.select("scope_id", "rank", F.explode("resources").alias("resource"))
        best = cut(spread.groupBy("scope_id", "resource").agg(F.min("rank").alias("best")), "greedy-best")
        met = cut(spread.join(best, ["scope_id", "resource"]).select("scope_id", "rank", "best"), "greedy-met")
        winners = cut(met.groupBy("scope_id", "rank").agg(F.bool_and(F.col("best") == F.col("rank")).alias("wins")).where("wins").select("scope_id", "rank"), "greedy-winners")
        # A winner is the best of all its resources, so what it blocks has met it as a best.
        beaten = met.where("best <> rank").join(winners.withColumnRenamed("rank", "best"), ["scope_id", "best"], "left_semi")
        gone = beaten.select("scope_id", "rank").distinct().unionByName(winners)
        live = cut(live.join(gone, ["scope_id", "rank"], "left_anti"), "greedy-live")
        won = won.unionByName(winners)
        before, left = left, live.count()
        if left > (1 - quick) * before:
            break
    if left:
        won = won.unionByName(_walked(_with_components(live), "component", "greedy-last"))
    found = semi_joined(places.drop("resources"), won.withColumnRenamed("rank", "place"), ["scope_id", "place"])
    return taken.unionByName(found.select("scope_id", "rank"))


def conflicts(proposals: DataFrame, chosen: DataFrame) -> DataFrame:
    """For transactions never chosen: document and owner that block their best
    proposal, its first document with an owner of a better rank.

    ``proposals`` are ranked and ``chosen`` are those that were taken."""
    owners = chosen.select("scope_id", F.explode("document_ids").alias("document_id"), F.col("transaction_id").alias("owner"), F.col("rank").alias("owner_rank"))
    left = proposals.join(chosen.select("scope_id", "transaction_id"), ["scope_id", "transaction_id"], "left_anti")
    asked = left.select("scope_id", "transaction_id", "rank", F.posexplode("document_ids").alias("pos", "document_id"))
    met = asked.join(owners, ["scope_id", "document_id"]).where("owner_rank < rank")
    first = F.min_by(F.struct("document_id", "owner"), F.struct("rank", "pos")).alias("c")
    return met.groupBy("scope_id", "transaction_id").agg(first).select("scope_id", "transaction_id", F.col("c.document_id").alias("document_id"), "c.owner")
