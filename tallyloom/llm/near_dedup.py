"""Near duplicates by SetSketch registers, confirmed on full shingle sets.

A document is its set of distinct five-word shingles, hashed to 64 bits.

1. Equal sets become one row; all that follows works on different sets.
2. SetSketch: each register keeps the truncated minimum of exponential values,
   ``clip(floor(1 - log_b(min)), 0, q + 1)``.  Two registers agree with about
   the probability of the Jaccard similarity.  Bands of registers are keys, and
   sets that share a key are candidates of each other.
3. A shingle that occurs in no other candidate cannot be shared.  Sets with too
   many of them are done, without losing a link: J <= (n - own) / n.
4. Each remaining set meets the best-connected set among its buckets' leaders.
   Links that hold join sets into components.
5. Only sets that share a bucket and are not yet in one component meet
   pairwise, where sizes, own shingles and counts by classes of shingles leave
   a link possible; these bounds lose nothing.  Within the largest component of
   a bucket no pair is looked at, so a group of thousands of copies makes
   thousands of pairs, not their square.  Sets of buckets in which very many
   pairs are still apart (one template, many texts) meet by the rarest of their
   shingles instead: of two sets that link, each has one of the other's among
   its first ``n - ceil(threshold * n) + 1``, in one order for all.
6. A pair's similarity is first estimated by maximum likelihood from the
   registers and the known set sizes.  Pairs that the likelihood all but rules
   out are left; every other pair is confirmed on the full sets.

With 32 bands of 6 registers a pair at the threshold of 0.85 stays unseen with
probability 3e-7, and one with higher similarity with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, tidy
from tallyloom.llm.shingles import constants, mix, shingle_sets
from tallyloom.operators.components import connected_components
from tallyloom.scratch import cut

#: SetSketch parameters: base, rate and largest register.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Shingles are counted in so many classes by hash, to bound what two sets share.
CLASSES = 64
#: A pair is left when its likelihood at the threshold is e**-SLACK of the best.
SLACK = 18.0


def registers(hashes: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch registers of one non-empty set of shingle hashes.

    Registers of a union are the larger of both, register by register."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        values = hashes[at : at + 2048, None] * multipliers + offsets
        np.minimum(least, values.min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def _parameters(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return constants(bands * rows, 1), constants(bands * rows, 2), constants(rows, 3)


def _sketches(size: int, bands: int, rows: int):
    def run(batches):
        multipliers, offsets, weights = _parameters(bands, rows)
        band = np.arange(bands, dtype=np.uint64) << np.uint64(17)
        for batch in batches:
            ids, hashes, texts = batch.columns
            n, a, b, keys = [], [], [], []
            for found in shingle_sets(texts, size):
                n.append(len(found))
                a.append(int(found.sum().view(np.int64)) if len(found) else 0)
                b.append(int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)) if len(found) else 0)
                if len(found):
                    r = registers(found, multipliers, offsets).astype(np.uint64).reshape(bands, rows)
                    keys.append(mix((r * weights).sum(axis=1) ^ band).view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            cuts = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids, hashes, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(cuts, flat)],
                names=["doc_id", "th", "n", "fa", "fb", "keys"],
            )

    return run


def _sets(size: int, bands: int, rows: int, with_registers: bool):
    def run(batches):
        multipliers, offsets, _ = _parameters(bands, rows)
        for batch in batches:
            ids, texts = batch.columns
            held, regs, classes, count = [], [], [], 0
            start = 0
            for k, found in enumerate(shingle_sets(texts, size)):
                held.append(found.view(np.int64))
                if with_registers:
                    regs.append(registers(found, multipliers, offsets).tobytes() if len(found) else b"")
                    classes.append(np.bincount((found & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES))
                count += len(found)
                if count > 500_000 or k == len(ids) - 1:
                    flat, cuts = pa.array(np.concatenate(held)), pa.array(np.cumsum([0, *map(len, held)]).astype(np.int32))
                    cols = [ids.slice(start, k + 1 - start), pa.ListArray.from_arrays(cuts, flat)]
                    names = ["id", "hashes"]
                    if with_registers:
                        cols += [pa.array(regs, pa.binary()), pa.array(classes, pa.list_(pa.int32()))]
                        names += ["regs", "classes"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    held, regs, classes, count, start = [], [], [], 0, k + 1

    return run


def log_likelihood(j: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of Jaccard similarity ``j`` given how many registers of the first set are
    above, below and equal to the second's; ``u`` is the first's share of the
    summed set sizes."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - (1 - u) * j), p((1 - u) - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return above * log(more) + below * log(less) + equal * log(1 - more - less)


def may_link(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series, percent: int) -> np.ndarray:
    """Whether the registers leave a similarity of ``percent`` possible."""
    a = np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1)
    b = np.frombuffer(b"".join(y), np.uint16).reshape(len(y), -1)
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    u = (nx / (nx + ny)).to_numpy()[:, None]
    least = percent / 100
    grid = np.concatenate([np.linspace(0, 1, 101), [least]])[None, :]
    grid = np.minimum(grid, np.minimum(u / (1 - u), (1 - u) / u))
    found = log_likelihood(grid, above, below, equal, u)
    best = found.argmax(axis=1)
    return (grid[np.arange(len(grid)), best] >= least) | (found[:, -1] >= found.max(axis=1) - SLACK)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have the similarity."""

    def check(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, nx, ny in batches:
            yield pd.Series(may_link(x, y, nx, ny, percent) if len(x) else np.zeros(0, bool))

    possible = F.pandas_udf(check, "boolean")
    light = sets.select("id", "n", "regs")
    one = light.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = light.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    likely = pairs.join(one, "a").join(two, "b").where(possible("ra", "rb", "na", "nb")).select("a", "b", "na", "nb")
    likely = cut(likely, "near-likely")
    heavy = sets.select("id", "hashes")
    one = heavy.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    two = heavy.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb")).cast("long")
    return (
        likely.join(one, "a")
        .join(two, "b")
        .select("a", "b", (F.col("na") + F.col("nb")).alias("n"), shared.alias("i"))
        .where(100 * F.col("i") >= percent * (F.col("n") - F.col("i")))
        .select("a", "b")
    )


def _sizes_fit(n1: Column, own1: Column, n2: Column, own2: Column, percent: int) -> Column:
    """Whether set sizes and shingles of their own leave a link possible: what
    two sets share is at most the rest of either, and fixes their union."""
    shared = F.least(n1 - own1, n2 - own2)
    return 100 * shared >= percent * (n1 + n2 - shared)


def _open(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the keys that several components share, with the number of pairs
    that are ``apart`` there and the component with most rows, ``major``."""
    c = F.col("c").cast("double")
    counted = rows.groupBy(key, "comp").agg(F.count("*").alias("c")).groupBy(key)
    counted = counted.agg(F.count("*").alias("comps"), F.sum(c).alias("s"), F.sum(c * c).alias("q"), F.max(F.struct("c", "comp")).alias("most"))
    counted = counted.where("comps > 1").select(key, ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("apart"), F.col("most.comp").alias("major"))
    return rows.join(cut(counted, "near-open-keys"), key)


def _meet(rows: DataFrame, key: str, percent: int, once: Column) -> DataFrame:
    """Pairs (a, b) of different components that share a key and may link.

    One side leaves out each key's largest component, so its own pairs are never
    looked at.  ``once`` picks one of the keys that a pair shares."""
    x, y = rows.where("comp <> major").alias("x"), rows.alias("y")
    apart = (F.col("x.comp") < F.col("y.comp")) | ((F.col("x.comp") > F.col("y.comp")) & (F.col("y.comp") == F.col("y.major")))
    fits = _sizes_fit(F.col("x.n"), F.col("x.own"), F.col("y.n"), F.col("y.own"), percent)
    # In each class of shingles two sets share no more than either has there.
    common = F.aggregate(F.zip_with("x.others", "y.others", lambda p, q: F.least(p, q)), F.lit(0), lambda a, v: a + v).cast("long")
    enough = 100 * common >= percent * (F.col("x.n") + F.col("y.n") - common)
    meet = (F.col(f"x.{key}") == F.col(f"y.{key}")) & apart & fits & once & enough
    return x.join(y.hint("merge"), meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _prefixes(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of ``crowded``, one for each shingle ``h`` by which a set can link.

    Shingles are ordered by how many sets have them, then by hash.  A set shares
    at least ``ceil(percent * n / 100)`` with one that it links to, so one of the
    others and one more is shared, whichever they are.  Shingles that no other
    set has come first and join nothing, so they are counted and left out."""
    held = sets.select("id", "hashes").join(crowded.select("id"), "id", "left_semi").select("id", F.explode("hashes").alias("h"))
    often = held.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    common = held.join(often, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("common"))
    length = (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1) - (F.col("n") - F.size("common"))
    first = F.slice("common", 1, F.greatest(length, F.lit(0)).cast("int"))
    rows = common.join(crowded, "id").withColumn("one", F.explode(first))
    return cut(rows.select("id", "n", "own", "others", "comp", F.col("one.h").alias("h")), "near-prefix-rows")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    size: int = 5,
    bands: int = 32,
    band_size: int = 6,
    broadcast_rows: int = 1_000_000,
    bucket_pairs: int = 500_000,
) -> DataFrame:
    """Return doc_id, n_shingles, component_id, kept, one row per input row.

    Documents are linked when the Jaccard similarity of their shingle sets is
    at least ``percent`` hundredths; component_id is the smallest id reachable
    over links, and ``kept`` marks the document that has it.

    Null text counts as empty; empty texts and texts without words have no
    shingles and are alone.  A text with fewer than ``size`` words has its whole
    sequence as its one shingle.  Rows with a null id are alone too: their
    component is null and they are kept.  Rows that repeat an id are one document
    whatever their texts: each row has the size of its own set, and the texts'
    sets are linked (a row without shingles is alone all the same).  An empty
    table gives an empty result; other columns are ignored.

    A pair of similarity j stays unseen with probability
    ``(1 - j**band_size) ** bands``: choose both to the threshold.
    ``broadcast_rows`` bounds the candidate ids that are broadcast to the second
    reading of the texts; a longer list is joined by shuffling.  Buckets with
    more than ``bucket_pairs`` pairs that are apart meet by rare shingles; the
    result is the same.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sketched = cut(
        texts.mapInArrow(tidy(_sketches(size, bands, band_size)), "doc_id long, th long, n long, fa long, fb long, keys array<long>"), "near-sketches"
    )
    usable = sketched.where("n > 0 and doc_id is not null")

    # Each different set has a number, and the row that it is read from again.
    equal = usable.groupBy("n", "fa", "fb").agg(F.min(F.struct("doc_id", "th")).alias("at"), F.any_value("keys").alias("keys"))
    equal = cut(equal.select("n", "fa", "fb", "at.doc_id", "at.th", "keys", F.monotonically_increasing_id().alias("id")), "near-equal")
    numbers = equal.select("n", "fa", "fb", "id")
    membership = cut(usable.select("doc_id", "n", "fa", "fb").join(numbers.hint("merge"), ["n", "fa", "fb"]).select("doc_id", "n", "id"), "near-members")

    spread = equal.select("id", "n", "keys")
    rows = spread.select("id", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    rows = cut(rows.join(cut(shared, "near-keys"), "key"), "near-rows")

    # Shingles of a candidate's own, which no other candidate has.
    candidates = rows.select("id").distinct().join(equal.select("id", "n", "doc_id", "th"), "id")
    candidates = cut(candidates, "near-candidates")

    def read_again(which: DataFrame) -> DataFrame:
        few = broadcast_if_small(which.select("id", "doc_id", "th"), broadcast_rows)
        return texts.join(few, ["doc_id", "th"]).select("id", "text")

    read = read_again(candidates)
    hashed = read.mapInArrow(tidy(_sets(size, bands, band_size, False)), "id long, hashes array<long>").select("id", F.explode("hashes").alias("h"))
    single = hashed.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    by_class = single.groupBy("id", F.col("h").bitwiseAND(CLASSES - 1).cast("int").alias("c")).agg(F.count("*").cast("int").alias("k"))
    own = by_class.groupBy("id").agg(F.sum("k").alias("own"), F.map_from_entries(F.collect_list(F.struct("c", "k"))).alias("own_classes"))
    sized = candidates.join(own, "id", "left").select("id", "doc_id", "th", "n", F.coalesce("own", F.lit(0)).alias("own"), "own_classes")
    alive = cut(sized.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "near-alive")

    sets = read_again(alive).mapInArrow(tidy(_sets(size, bands, band_size, True)), "id long, hashes array<long>, regs binary, classes array<int>")
    others = F.transform("classes", lambda v, c: v - F.coalesce(F.try_element_at("own_classes", c), F.lit(0)))
    # Repeated rows give a set again, the same one.
    sets = sets.dropDuplicates(["id"]).join(alive.drop("doc_id", "th"), "id").withColumn("others", others).drop("own_classes", "classes")
    sets = cut(sets, "near-sets")

    rows = rows.select("id", "key").join(sets.select("id", "n", "own", "others"), "id")
    rows = cut(rows.join(spread.select("id", "keys"), "id"), "near-alive-rows")
    slim = rows.select("id", "key")

    # One pair a set: with the best-connected leader of its buckets.
    counted = cut(slim.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "near-counts")
    weight = slim.join(counted, "key").groupBy("id").agg(F.sum("c").alias("w"))
    rank = F.struct("w", (-F.col("id")).alias("minus"))
    weighed = cut(slim.join(cut(weight, "near-weights"), "id").select("id", "key", rank.alias("rank")), "near-weighed")
    leaders = cut(weighed.groupBy("key").agg(F.max("rank").alias("lead")), "near-leaders")
    best = weighed.join(leaders, "key").where("lead.minus <> -id").groupBy("id").agg(F.max("lead").alias("lead"))
    pairs = best.select(F.col("id").alias("a"), (-F.col("lead.minus")).alias("b"))
    links = cut(_confirm(pairs, sets, percent), "near-links")
    first = connected_components(links)

    # What shares a bucket and is still apart.
    joined = rows.join(first, "id", "left").select(
        "key", "id", "n", "own", "others", "keys", F.coalesce("component", "id").alias("comp")
    )
    joined = cut(_open(cut(joined, "near-apart"), "key"), "near-open")
    same = F.zip_with("x.keys", "y.keys", lambda p, q: p == q)
    # Sets that meet in several buckets make one pair, in the first of them.
    earliest = F.element_at("x.keys", F.array_position(same, F.lit(True)).cast("int")) == F.col("x.key")
    pairs = cut(_meet(joined.where(F.col("apart") <= bucket_pairs), "key", percent, earliest), "near-pairs")
    crowded = joined.where(F.col("apart") > bucket_pairs).select("id", "n", "own", "others", "comp").dropDuplicates(["id"])
    crowded = cut(crowded, "near-crowded")
    if not crowded.isEmpty():
        prefixes = cut(_open(_prefixes(crowded, sets, percent), "h"), "near-prefixes")
        pairs = pairs.unionByName(cut(_meet(prefixes, "h", percent, F.lit(True)).distinct(), "near-pairs"))
    more = _confirm(pairs, sets, percent)
    # Different texts under one id are one document.
    several = cut(membership.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b < top").select("doc_id", "b"), "near-repeated")
    one = membership.join(several, "doc_id").select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    components = cut(connected_components(links.unionByName(more).unionByName(one)), "near-components")

    named = equal.select("id", "doc_id").join(components, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    named = cut(named, "near-named")
    tops = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    settled = membership.join(cut(named.join(tops, "component").select("id", "component_id"), "near-tops").hint("merge"), "id")
    found = settled.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sketched.where("n = 0 or doc_id is null")
    alone = rest.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
