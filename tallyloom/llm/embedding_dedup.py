"""Near duplicates of embeddings by a subspace pigeonhole join.

Of unit vectors, cosine >= c means squared distance <= 2 - 2 c.  Vectors are turned
by one orthogonal matrix, which spreads their variance evenly, and parted into
blocks of about 16 coordinates.  A block of k of d coordinates gets k / d of the
squared distance as its budget: blocks in which a pair is over budget cannot be all
of them, so every pair within the distance is within budget in some block.

Each block is joined by range.  The first two coordinates of a block lie in square
cells of twice its radius; a vector stands in its own cell and in the neighbours
before it that the radius reaches, so that any two vectors within the radius meet
once.  A cell with many vectors is dealt into tiles, and pairs of tiles are the
units of work, so a crowded cell is many tasks' work.  Within a unit, pairs within
the block's budget are candidates; the full vectors decide in double precision.
A pair counts in the first block that has it within budget, so the union of all
blocks' candidates has it once.  Units emit a number of links for each vector and
the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, tidy
from tallyloom.operators.components import connected_components
from tallyloom.scratch import cut

#: Coordinates of a block, about.
BLOCK = 16
#: Vectors of a tile, at least and at most; between them a quarter of all.
TILE = (2_048, 16_384)
#: Vectors that are held against each other at once within a unit of work.
SQUARE = 1_024
#: Candidate pairs whose full vectors are compared at once.
PAIRS = 16_384
#: Room for rounding where a bound only selects candidates, in double and single precision.
ROOM, COARSE = 1e-6, 1e-5
#: Cells of all blocks that are broadcast; about 300 for each length of vectors.
BROADCAST_CELLS = 100_000


class Blocks:
    """The rotation and blocks of vectors of ``d`` coordinates."""

    def __init__(self, d: int, squared: float) -> None:
        self.turn = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
        cuts = np.linspace(0, d, max(1, round(d / BLOCK)) + 1).round().astype(int)
        self.spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        self.budgets = [squared * (b - a) / d for a, b in self.spans]

    def turned(self, units: np.ndarray) -> np.ndarray:
        """Rotated vectors; each row's result depends on that row alone, to the bit."""
        out = np.zeros_like(units)
        for j in range(units.shape[1]):
            out += units[:, j : j + 1] * self.turn[j]
        return out


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square is over or under the range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = pc.list_value_length(batch.column("embedding"))
    for d in lengths.unique().to_pylist():
        yield d, batch.filter(pc.equal(lengths, d))


def _celled(blocks: Callable[[int], Blocks], payload: bool):
    """For every vector and block, a row for its cell and for each neighbour
    before it that is within the block's radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d, batch in _by_length(whole):
                known = blocks(d)
                y = known.turned(unit_vectors(_matrix(batch.column("embedding"), d)))
                for b, ((lo, hi), budget) in enumerate(zip(known.spans, known.budgets, strict=True)):
                    radius = np.sqrt(budget) + ROOM
                    width = 2 * radius
                    at = y[:, lo : min(hi, lo + 2)] / width
                    at = at if at.shape[1] == 2 else np.pad(at, ((0, 0), (0, 1)))
                    cell = np.floor(at).astype(np.int64)
                    low, high = (at - cell) * width, (cell + 1 - at) * width
                    for dx, dy in ((0, 0), (-1, -1), (-1, 0), (-1, 1), (0, -1)):
                        gap_x = low[:, 0] if dx else 0.0
                        gap_y = low[:, 1] if dy < 0 else high[:, 1] if dy > 0 else 0.0
                        who = np.flatnonzero(np.broadcast_to(gap_x * gap_x + gap_y * gap_y <= radius * radius, len(y)))
                        names = [f"{d}:{b}:{p}:{q}" for p, q in (cell[who] + [dx, dy]).tolist()]
                        taken = batch.take(pa.array(who)) if payload else batch.select(["key"]).take(pa.array(who))
                        taken = taken.append_column("cell", pa.array(names, pa.string()))
                        yield taken.append_column("home", pa.array(np.full(len(who), dx == dy == 0)))

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over pairs (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            return label


def linked_pairs(known: Blocks, block: int, units: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, one of ``left`` and one of ``right`` (of one list, each pair
    once), at least one at home here, that reach the cosine and have ``block`` as
    their first block within budget."""
    turned = known.turned(units)
    lo, hi = known.spans[block]
    mine = turned[:, lo:hi].astype(np.float32)
    square, ones = (mine * mine).sum(axis=1, keepdims=True), np.ones((len(mine), 1), np.float32)
    # Products of these rows are squared distances in the block.
    rows, columns = np.hstack([-2 * mine, square, ones]), np.hstack([mine, ones, square])
    one = left is right
    for i in range(0, len(left), SQUARE):
        x = left[i : i + SQUARE]
        for j in range(i if one else 0, len(right), SQUARE):
            y = right[j : j + SQUARE]
            a, b = np.nonzero(rows[x] @ columns[y].T <= known.budgets[block] + COARSE)
            if one and i == j:
                a, b = a[a < b], b[a < b]
            a, b = x[a], y[b]
            near = home[a] | home[b]
            a, b = a[near], b[near]
            for k in range(0, len(a), PAIRS):
                p, q = a[k : k + PAIRS], b[k : k + PAIRS]
                linked = (units[p] * units[q]).sum(axis=1) >= cosine
                p, q = p[linked], q[linked]
                apart = turned[p] - turned[q]
                apart *= apart
                within = [apart[:, c:e].sum(axis=1) <= budget for (c, e), budget in zip(known.spans, known.budgets, strict=True)]
                first = within[block]
                for earlier in within[:block]:
                    first = first & ~earlier
                yield p[first], q[first]


def _compared(blocks: Callable[[int], Blocks], cosine: float):
    """Links of each unit of work, whose rows come together."""

    def links(unit: pa.Table) -> pa.RecordBatch:
        d, block, _, _, tile, other = map(int, unit.column("work")[0].as_py().split(":"))
        vectors = unit_vectors(_matrix(unit.column("embedding").combine_chunks(), d))
        key, times = unit.column("key").to_numpy(), unit.column("times").to_numpy()
        home, first = unit.column("home").to_numpy(), unit.column("first").to_numpy()
        left = np.flatnonzero(first)
        right = left if tile == other else np.flatnonzero(~first)
        counts, a, b = np.zeros(len(key), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        label = np.arange(len(key))
        for p, q in linked_pairs(blocks(d), block, vectors, home, left, right, cosine):
            counts += np.bincount(p, times[q], len(key)).astype(np.int64) + np.bincount(q, times[p], len(key)).astype(np.int64)
            new = label[p] != label[q]
            a.append(label[p][new])
            b.append(label[q][new])
            if sum(map(len, a)) > 1_000_000:
                label = _labels(len(key), np.concatenate([*a, np.arange(len(key))]), np.concatenate([*b, label]))
                a, b = a[:1], b[:1]
        label = _labels(len(key), np.concatenate([*a, np.arange(len(key))]), np.concatenate([*b, label]))
        out = np.flatnonzero(counts)
        columns = [pa.array(key[out]), pa.array(counts[out]), pa.array(key[label[out]])]
        return pa.RecordBatch.from_arrays(columns, names=["key", "n", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            work = table.column("work").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(work[1:] != work[:-1]) + 1).tolist()]
            for start, end in zip(cuts, cuts[1:], strict=False):
                yield links(table.slice(start, end - start))
            rest = table.slice(cuts[-1])
        if rest is not None:
            yield links(rest)

    return run


def embedding_duplicates(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, tile: tuple[int, int] = TILE) -> DataFrame:
    """Return vec_id, n_links, component_id, kept, one row per input row.

    Two vectors are linked when their cosine, in double precision, is at least
    ``cosine`` (over 0); n_links counts the other rows linked directly, and
    component_id is the smallest id reachable over links.  ``kept`` marks the row
    that has it.

    Vectors that are null, empty, zero or have null or non-finite components link
    with nothing, nor do vectors of different lengths with each other.  Equal
    vectors are one while links are sought, so copies make no pairs.  Rows that
    repeat an id count one by one; rows with a null id are linked and counted like
    others, but give their component no id: a component of such rows alone has
    null, and each of them is kept.  An empty table gives an empty result; other
    columns are ignored.

    All pairs of a crowded cell are compared, tile by tile, as their number is
    asked for; a tile has ``tile`` vectors, at least and at most.
    """
    spark = docs.sparkSession
    squared = 2 - 2 * cosine
    rows = docs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    vectors, others = rows.where(usable), rows.where(~usable)

    classes = vectors.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()), "embedding-classes")
    known = {d: Blocks(d, squared) for (d,) in classes.select(F.size("embedding")).distinct().collect()}
    blocks = known.__getitem__

    places = classes.select("key", "embedding").mapInArrow(tidy(_celled(blocks, False)), "key long, cell string, home boolean")
    wide = int(min(max(classes.count() // 4, tile[0]), tile[1]))
    tiles = places.groupBy("cell").agg(F.ceil(F.count("*") / wide).cast("int").alias("tiles"))
    tiles = broadcast_if_small(cut(tiles, "embedding-cells"), BROADCAST_CELLS)
    kind = classes.schema["embedding"].dataType.simpleString()
    placed = classes.select("key", "times", "embedding").mapInArrow(
        tidy(_celled(blocks, True)), f"key long, times long, embedding {kind}, cell string, home boolean"
    )
    placed = placed.join(tiles, "cell").withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = F.concat_ws(":", "cell", F.least("own", "other"), F.greatest("own", "other"))
    placed = placed.select("key", "times", "embedding", "home", (F.col("own") <= F.col("other")).alias("first"), pair.alias("work"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    units = placed.repartition(tasks, "work").sortWithinPartitions("work")
    found = cut(units.mapInArrow(tidy(_compared(blocks, cosine)), "key long, n long, to long"), "embedding-links")

    counted = found.groupBy("key").agg(F.sum("n").alias("n"))
    reached = connected_components(found.where("key <> to"), "key", "to").withColumnRenamed("id", "key")
    classes = classes.join(counted, "key", "left").join(reached, "key", "left").withColumn("component", F.coalesce("component", "key"))
    classes = cut(classes.select("embedding", "least", "times", "component", F.coalesce("n", F.lit(0)).alias("n")), "embedding-counted")
    tops = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = cut(classes.join(tops, "component").select("embedding", (F.col("n") + F.col("times") - 1).alias("n_links"), "component_id"), "embedding-settled")
    linked = vectors.join(classes.hint("merge"), "embedding").select("vec_id", "n_links", "component_id")
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.col("vec_id").isNull() | F.col("vec_id").eqNullSafe(F.col("component_id"))
    return linked.unionByName(alone).withColumn("kept", kept)
