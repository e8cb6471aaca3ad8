"""Benchmark items inside documents, by size-partitioned MinHash containment.

Items are partitioned by their number of shingles.  An item's sketch is its
smallest shingle hashes, so many as its partition asks for.  A document that
contains a share t of the item contains each sketch hash with probability t, so
the number of sketch hashes among the document's shingles estimates the
containment however long the document is; a signature of the document itself
would lose a short item in a long text.  Each partition has its own least
number of hits, below which a true match falls with probability under 1e-9, and
a document with too few shingles is out by its size.  Small items keep all
their shingles, which makes their test exact.

Items with equal sets are one while they are searched.  Sketches are a table: the
documents' shingles meet them in one equi-join, in one scan, where the sketches are
broadcast if they were counted to be few and both sides shuffled else.  Documents
with enough hits are read again, and every candidate is verified by the exact
number of the item's shingles in the document.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, tidy
from tallyloom.llm.shingles import shingle_sets
from tallyloom.scratch import cut

#: Candidate rows that are broadcast to the second reading of the texts.
BROADCAST_ROWS = 1_000_000
#: Shingles that a task passes on together, about.
LOT = 200_000


def _sets(size: int):
    """Shingle sets, ascending as unsigned numbers, of a batch's last column; the
    other columns stay.  Empty sets are left out."""

    def run(batches):
        for batch in batches:
            at, held, count = [], [], 0
            for k, found in enumerate(shingle_sets(batch.columns[-1], size)):
                if len(found):
                    at.append(k)
                    held.append(found.view(np.int64))
                    count += len(found)
                if held and (count > LOT or k == batch.num_rows - 1):
                    hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held)))
                    kept = [c.take(pa.array(at)) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(list(map(len, held)), pa.int64()), hashes], names=[*batch.schema.names[:-1], "n", "hashes"])
                    at, held, count = [], [], 0

    return run


def least_hits(kept: int, n: int, percent: int, miss: float = 1e-9) -> int:
    """Hits among ``kept`` sketch hashes that a match reaches but with
    probability ``miss``; with all ``n`` shingles kept, what a match has."""
    if kept == n:
        return -(-percent * n // 100)
    t, below = percent / 100, 0.0
    for h in range(kept + 1):
        below += comb(kept, h) * t**h * (1 - t) ** (kept - h)
        if below > miss:
            return max(1, h)
    return 1


def _sketched(percent: int, sketch: int):
    """For each size how many smallest hashes an item keeps, and how many hits and
    shingles a match has at least."""

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            # Partitions double in size; larger items keep more hashes, in proportion to nothing but the bound.
            kept = np.minimum(n, sketch + 4 * np.maximum(0, np.log2(n).astype(int) - 5))
            needed = [least_hits(int(k), int(m), percent) for k, m in zip(kept, n, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(kept), pa.array(needed, pa.int64()), pa.array(-(-percent * n // 100))], names=["n", "kept", "needed", "smallest"])

    return run


def find_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = 80,
    size: int = 5,
    sketch: int = 48,
    block_shingles: int = 2_000_000,
) -> DataFrame:
    """Return doc_id, item_id, n_item, n_shared, one row for each document and
    item of which the document has at least ``percent`` hundredths of the
    distinct ``size``-word shingles.

    Null texts count as empty.  Items without words match nothing, and so do
    documents without words; an item or document of fewer than ``size`` words
    has its whole sequence as one shingle.  Rows that repeat, of documents or of
    items, are found each; null ids are passed on.  An empty table on either side
    gives an empty result; other columns are ignored.  ``block_shingles`` bounds
    the sketch hashes that are broadcast, some 40 bytes each; more are joined by
    shuffling, with the same result.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = cut(items.mapInArrow(tidy(_sets(size)), "item_id long, n long, hashes array<long>"), "items")
    sizes = items.select("n").distinct().mapInArrow(_sketched(percent, sketch), "n long, kept long, needed long, smallest long")
    classes = cut(items.groupBy("n", "hashes").agg(F.count("*").alias("rows")).join(sizes, "n").withColumn("item", F.monotonically_increasing_id()), "item-classes")
    smallest = F.slice("hashes", 1, F.col("kept").cast("int"))
    sketches = cut(classes.select("item", "needed", "smallest", F.explode(smallest).alias("h")), "item-sketches")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    shingles = texts.select("row", "text").mapInArrow(tidy(_sets(size)), "row long, n long, hashes array<long>").select("row", "n", F.explode("hashes").alias("h"))
    hits = shingles.join(broadcast_if_small(sketches, block_shingles), "h").where("n >= smallest")
    hits = hits.groupBy("row", "item", "needed").agg(F.count("*").alias("hits")).where("hits >= needed")
    candidates = cut(hits.select("row", "item"), "item-candidates")

    rows = broadcast_if_small(cut(candidates.select("row").distinct(), "item-rows"), BROADCAST_ROWS)
    again = texts.join(rows, "row", "left_semi").select("doc_id", "row", "text")
    again = again.mapInArrow(tidy(_sets(size)), "doc_id long, row long, n long, hashes array<long>").select("doc_id", "row", F.col("hashes").alias("own"))
    shared = F.size(F.array_intersect("own", "hashes")).cast("long")
    met = again.join(candidates, "row").join(classes.select("item", F.col("n").alias("n_item"), "hashes"), "item")
    met = met.select("doc_id", "item", "n_item", shared.alias("n_shared")).where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    members = items.join(classes.select("n", "hashes", "item").hint("merge"), ["n", "hashes"]).select("item_id", "item")
    return met.join(members, "item").select("doc_id", "item_id", "n_item", "n_shared")
