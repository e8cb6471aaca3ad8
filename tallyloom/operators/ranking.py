"""The best documents of each transaction, by walking ranked names.

The documents of a scope and currency are dealt into blocks of bounded size, its
transactions into chunks, and each block meets each chunk in one task.  There a
transaction's name ranks the block's different names, and its documents are taken
from the best name on until there are enough:

* How alike two names can be is bounded by the characters they have in common;
  which names a brand word lifts is looked up by words, and those that it lifts over
  their bound need no comparison.  The others are compared in the order of the
  bound, and only while it reaches what the best name so far has.
* A name's documents lie sorted by day; the walk goes outwards from the
  transaction's day and stops when no later day can bring a better one.

So a transaction looks at about as many names and documents as it takes, not at
all of its scope.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import MICRO, Settings, micros
from tallyloom.functions.amounts import MONEY
from tallyloom.functions.merchants import plain_signal
from tallyloom.scratch import cut

#: Documents of a block and transactions of a chunk, about.
BLOCK = 20_000
#: Blocks of so few documents are ranked at once.
FEW = 64
#: Pairs of names that a worker remembers.
REMEMBERED = 200_000
#: The gap of a pair without two dates.
UNDATED = 10**9
#: What tells units of work apart.
UNIT = ["scope_id", "currency", "block", "chunk"]
#: Classes of characters by code point, for the bound.
CLASSES = 64


class _Bounds:
    """Upper bounds of the signals of one name with many others, and whether they
    are the signals themselves."""

    def __init__(self, names: list[str], settings: Settings) -> None:
        self.bands = settings.merchants
        self.counts = np.zeros((len(names), CLASSES), np.int32)
        for i, name in enumerate(names):
            np.add.at(self.counts[i], [ord(c) % CLASSES for c in name], 1)
        self.lengths = self.counts.sum(axis=1)
        # Names by their distinctive words and by the first of these; words by their beginnings.
        any_of: dict[str, list[int]] = {}
        first_of: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            for k, word in enumerate(self._words(name)):
                any_of.setdefault(word, []).append(i)
                if not k:
                    first_of.setdefault(word, []).append(i)
        self.any_of, self.first_of = ({w: np.array(at) for w, at in of.items()} for of in (any_of, first_of))
        self.heads: dict[str, list[str]] = {}
        for word in any_of:
            self.heads.setdefault(word[: self.bands.minimum_length], []).append(word)

    def _words(self, name: str) -> list[str]:
        return [t for t in name.split(" ") if len(t) >= self.bands.minimum_length]

    def _touching(self, word: str) -> list[str]:
        """The known words that begin with the word or that it begins with."""
        return [w for w in self.heads.get(word[: self.bands.minimum_length], ()) if w.startswith(word) or word.startswith(w)]

    def of(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        own = np.bincount([ord(c) % CLASSES for c in name], minlength=CLASSES).astype(np.int32)
        common = np.minimum(self.counts, own).sum(axis=1, dtype=np.int64)
        n = self.lengths + len(name)
        bound = (4 * MICRO * common + n) // (2 * n)
        lifted = np.zeros(len(bound), bool)
        words = self._words(name)
        for k, word in enumerate(words):
            for other in self._touching(word):
                for of in (self.first_of, self.any_of)[: 1 + (not k)]:
                    if other in of:
                        lifted[of[other]] = True
        token = micros(self.bands.token_score)
        sure = lifted & (bound <= token)
        bound = np.where(lifted, np.maximum(bound, token), bound)
        cap = micros(self.bands.short_cap)
        short = (self.lengths < self.bands.minimum_length) | (len(name) < self.bands.minimum_length)
        return np.where(short, np.minimum(bound, cap), bound), sure


class Block:
    """One block's documents, asked for the best ones of transactions."""

    def __init__(self, ids: list[str], names: list[str | None], hi: np.ndarray, lo: np.ndarray, days: np.ndarray, dated: np.ndarray, settings: Settings, signal: Callable[[str, str], int]) -> None:
        self.ids, self.hi, self.lo, self.days, self.dated = ids, hi, lo, days, dated
        self.place = np.empty(len(ids), np.int64)
        self.place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        self.names = sorted({n for n in names if n})
        number = {n: i for i, n in enumerate(self.names)}
        self.of_name: list[list[int]] = [[] for _ in self.names]
        self.nameless: list[int] = []
        for i, n in enumerate(names):
            (self.of_name[number[n]] if n else self.nameless).append(i)
        self.settings, self.signal, self.compared = settings, signal, 0
        self.bounds: _Bounds | None = None
        self.known: tuple[str | None, list, Iterator] = ("\0", [], iter(()))

    def _levels(self, name: str | None) -> Iterator[tuple[int | None, list[int]]]:
        """Signals from the best on, each with all documents that have it."""
        if not name:
            yield None, list(range(len(self.ids)))
            return
        if len(self.ids) <= FEW:
            order, bound, sure = range(len(self.names)), np.full(len(self.names), MICRO), np.zeros(len(self.names), bool)
        else:
            self.bounds = self.bounds or _Bounds(self.names, self.settings)
            bound, sure = self.bounds.of(name)
            order = np.argsort(-bound, kind="stable").tolist()
        heap: list[tuple[int, int]] = []
        at = 0
        while at < len(order) or heap:
            while at < len(order) and (not heap or bound[order[at]] >= -heap[0][0]):
                other = order[at]
                heapq.heappush(heap, (-int(bound[other]) if sure[other] else -self.signal(name, self.names[other]), other))
                self.compared += not sure[other]
                at += 1
            best, docs = heap[0][0], []
            while heap and heap[0][0] == best:
                docs += self.of_name[heapq.heappop(heap)[1]]
            yield -best, docs
        if self.nameless:
            yield None, self.nameless

    def _sorted_levels(self, name: str | None) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
        """Levels kept for the name's next transactions, which come one after the
        other: documents by day, those without a day last, and the days of the others."""
        if self.known[0] != name:
            self.known = name, [], self._levels(name)
        _, done, more = self.known
        at = 0
        while True:
            if at == len(done):
                level = next(more, None)
                if level is None:
                    return
                docs = np.array(level[1])
                docs = docs[np.lexsort((self.days[docs], ~self.dated[docs]))]
                done.append((level[0], docs, self.days[docs[self.dated[docs]]]))
            yield done[at]
            at += 1

    def _nearest(self, docs: np.ndarray, days: np.ndarray, day: int | None, hi: int, lo: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a level the first ``wanted`` documents below the amount, by gap, larger
        amount and id, with their gaps."""
        middle, dated, reach = 0 if day is None else int(np.searchsorted(days, day)), len(days), FEW
        while True:
            a, b = max(0, middle - reach), min(dated, middle + reach)
            whole = day is None or len(docs) <= 2 * FEW or (a == 0 and b == dated)
            part = docs if whole else docs[a:b]
            part = part[(self.hi[part] < hi) | ((self.hi[part] == hi) & (self.lo[part] < lo))]
            gap = np.full(len(part), UNDATED) if day is None else np.where(self.dated[part], np.abs(self.days[part] - day), UNDATED)
            if not whole:
                # Documents outside the part are at least so far away.
                outside = [day - days[max(a, 1) - 1]] * (a > 0) + [days[min(b, dated - 1)] - day] * (b < dated)
                if (gap < min(outside)).sum() < wanted:
                    reach *= 4
                    continue
            first = np.lexsort((self.place[part], -self.lo[part], -self.hi[part], gap))[:wanted]
            return part[first], gap[first]

    def best(self, name: str | None, day: int | None, hi: int, lo: int, wanted: int) -> list[tuple[int, int | None, int]]:
        """Document, signal and gap of the first ``wanted``, in order."""
        found: list[tuple[int, int | None, int]] = []
        for signal, docs, days in self._sorted_levels(name):
            taken, gaps = self._nearest(docs, days, day, hi, lo, wanted - len(found))
            found += [(d, signal, g) for d, g in zip(taken.tolist(), gaps.tolist(), strict=True)]
            if len(found) == wanted:
                break
        return found


#: Chosen places by the two numbers.  A decorator's cache would go to workers by
#: reference, and they have no copy of this package.
_CHOICES: dict[tuple[int, int], np.ndarray] = {}


def _choices(n: int, size: int) -> np.ndarray:
    if (n, size) not in _CHOICES:
        _CHOICES[n, size] = np.array(list(combinations(range(n), size)), np.int64).reshape(-1, size)
    return _CHOICES[n, size]


def sets_within(hi: np.ndarray, lo: np.ndarray, t_hi: int, t_lo: int, most: int, width: int) -> Iterator[list[int]]:
    """The sets of 2 to ``most`` amounts whose sum is at least the given one and at
    most ``width`` 10**-8ths more, as places from 0."""
    for size in range(2, min(most, len(hi)) + 1):
        chosen = _choices(len(hi), size)
        above = hi[chosen].sum(axis=1) - t_hi
        # A sum of the rests carries at most ``most`` millions over.
        near = np.flatnonzero((above >= -most) & (above <= width // 10**14 + 1))
        more = above[near] * 10**14 + lo[chosen[near]].sum(axis=1) - t_lo
        yield from chosen[near[(more >= 0) & (more <= width)]].tolist()


POOL = {"hi": pa.int64(), "lo": pa.int64(), "signal": pa.int64(), "gap": pa.int64(), "t_hi": pa.int64(), "t_lo": pa.int64()}
KINDS = {
    "report": {"pairs": pa.int64(), "compared": pa.int64()},
    "pool": {"transaction_id": pa.string(), "document_id": pa.string(), **POOL},
    "sets": {"transaction_id": pa.string(), "places": pa.list_(pa.int32()), "document_ids": pa.list_(pa.string()), **POOL},
}


def _walk(settings: Settings, wanted: int, kind: str, most: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the units' transactions the pools, or of each unit how many names were
    compared, or the sets that sum up: of groups of one block the sets, with null
    for the columns of pools, of others the pools' documents, one in a list."""
    width = int(2 * Decimal(settings.amount_tolerance) * 10**8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signal = lru_cache(REMEMBERED)(lambda a, b: plain_signal(a, b, settings))

        def units(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            scope = table.column("scope_id").combine_chunks()
            ids, names = table.column("id").to_pylist(), table.column("name").to_pylist()
            is_txn, alone = table.column("is_txn").to_numpy(), table.column("alone").to_numpy()
            hi, lo = table.column("hi").to_numpy(), table.column("lo").to_numpy()
            day = table.column("day").combine_chunks()
            dated, days = day.is_valid().to_numpy(zero_copy_only=False), day.fill_null(0).to_numpy()
            rows: list[tuple] = []
            for start, end in zip(cuts, cuts[1:], strict=False):
                middle = start + int((~is_txn[start:end]).sum())
                if start == middle or middle == end:
                    continue
                part = slice(start, middle)
                block = Block(ids[part], names[part], hi[part], lo[part], days[part], dated[part], settings, signal)
                for t in sorted(range(middle, end), key=lambda t: names[t] or ""):
                    t_hi, t_lo = int(hi[t]), int(lo[t])
                    found = block.best(names[t], int(days[t]) if dated[t] else None, t_hi, t_lo, wanted)
                    if kind == "sets" and alone[start]:
                        docs = np.array([start + d for d, _, _ in found], np.int64)
                        for places in sets_within(hi[docs], lo[docs], t_hi, t_lo, most, width):
                            rows.append((t, ids[t], [p + 1 for p in places], [ids[docs[p]] for p in places], *[None] * 6))
                    elif kind != "report":
                        lists = [None] if kind == "sets" else []
                        rows += [
                            (t, ids[t], *lists, [ids[start + d]] if lists else ids[start + d], int(hi[start + d]), int(lo[start + d]), s, g, t_hi, t_lo) for d, s, g in found
                        ]
                if kind == "report":
                    rows.append((start, len({n for n in names[middle:end] if n}) * len(block.names), block.compared))
            kinds = KINDS[kind]
            columns = list(zip(*rows, strict=True)) or [()] * (1 + len(kinds))
            made = [scope.take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds.values(), strict=True)]]
            return pa.RecordBatch.from_arrays(made, names=["scope_id", *kinds])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            unit = np.stack([table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in UNIT])
            cuts = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1).tolist()]
            if len(cuts) > 1:
                yield units(table.slice(0, cuts[-1]), cuts)
            rest = table.slice(cuts[-1])
        if rest is not None:
            yield units(rest, [0, rest.num_rows])

    return run


def _merged_sets(settings: Settings, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sets of transactions whose pools were merged from several blocks."""
    width = int(2 * Decimal(settings.amount_tolerance) * 10**8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, ids = [], [], []
            for i, (docs, t_hi, t_lo) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("docs", "t_hi", "t_lo")], strict=True)):
                hi, lo = (np.array([d[c] for d in docs], np.int64) for c in ("hi", "lo"))
                for found in sets_within(hi, lo, t_hi, t_lo, most, width):
                    at.append(i)
                    places.append([p + 1 for p in found])
                    ids.append([docs[p]["document_id"] for p in found])
            keys = batch.select(["scope_id", "transaction_id"]).take(pa.array(at, pa.int64()))
            made = [*keys.columns, pa.array(places, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(made, names=["scope_id", "transaction_id", "places", "document_ids"])

    return run


def _halves(amount: Column) -> tuple[Column, Column]:
    """An amount as two whole numbers that order it: millions, and 10**-8ths of the rest."""
    amount = amount.cast(MONEY)
    hi = F.floor(amount / F.lit(10**6).cast("decimal(8,0)")).cast("decimal(28,8)").cast("long")
    return hi, ((amount - hi.cast("decimal(20,0)") * 10**6) * 10**8).cast("long")


def _dealt(transactions: DataFrame, documents: DataFrame, settings: Settings) -> DataFrame:
    """Both sides' rows by unit of work, a unit's documents first."""
    group = ["scope_id", "currency"]
    d_hi, d_lo = _halves(F.col("d_amount"))
    t_hi, t_lo = _halves(F.col("amount") - F.lit(settings.amount_tolerance).cast(MONEY))
    d = documents.where("d_scope is not null and d_currency is not null and d_amount is not null").select(
        F.col("d_scope").alias("scope_id"), F.col("d_currency").alias("currency"), F.lit(False).alias("is_txn"), F.col("document_id").alias("id"),
        F.col("d_m1").alias("name"), d_hi.alias("hi"), d_lo.alias("lo"), F.unix_date("issued_date").alias("day"),
    )
    t = transactions.dropna(subset=group).select(
        *group, F.lit(True).alias("is_txn"), F.col("transaction_id").alias("id"), F.col("m1").alias("name"), t_hi.alias("hi"), t_lo.alias("lo"), F.unix_date("posted_date").alias("day")
    )
    rows = d.unionByName(t)
    parts = lambda is_txn: F.ceil(F.count_if(F.col("is_txn") == is_txn) / BLOCK).cast("int")
    large = rows.groupBy(*group).agg(parts(False).alias("blocks"), parts(True).alias("chunks")).where("blocks > 1 or chunks > 1")
    rows = rows.join(cut(large, "pool-large"), group, "left")
    blocks, chunks = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("blocks", "chunks"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("is_txn"), chunks).otherwise(blocks)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_txn"), blocks).otherwise(chunks) - 1)))
    block, chunk = (F.when(F.col("is_txn") == by, F.col("other")).otherwise(F.col("own")) for by in (True, False))
    rows = rows.select(*group, block.alias("block"), chunk.alias("chunk"), "is_txn", (blocks == 1).alias("alone"), "id", "name", "hi", "lo", "day")
    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "is_txn")


def best_documents(transactions: DataFrame, documents: DataFrame, settings: Settings, wanted: int) -> DataFrame:
    """For each prepared transaction the ``wanted`` best of the prepared documents
    of its scope and currency whose amounts are smaller by more than the tolerance:
    scope_id, transaction_id, document_id, pool_merchant and place from 1.

    The order is by merchant signal (none last), day gap (none last), larger amount
    and id.  A scope of many documents gives the best of each block, and the best of
    those; none of its tasks has more than a block and a chunk."""
    dealt = _dealt(transactions, documents, settings)
    scope = dealt.schema["scope_id"].dataType.simpleString()
    found = dealt.mapInArrow(_walk(settings, wanted, "pool"), f"scope_id {scope}, transaction_id string, document_id string, {LONGS}")
    return _placed(found, wanted).select("scope_id", "transaction_id", "document_id", F.col("signal").alias("pool_merchant"), "place")


LONGS = ", ".join(f"{c} long" for c in POOL)


def _placed(found: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("scope_id", "transaction_id").orderBy(F.desc(F.coalesce("signal", F.lit(-MICRO))), "gap", F.desc("hi"), F.desc("lo"), "document_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)


def best_sets(transactions: DataFrame, documents: DataFrame, settings: Settings, wanted: int, most: int) -> DataFrame:
    """The sets of 2 to ``most`` of each prepared transaction's ``best_documents``
    whose amounts sum to its own within the tolerance: scope_id, transaction_id,
    places and document_ids.

    Sets are tried where the pool is found.  Only pools of scopes with several blocks
    of documents are merged first."""
    dealt = _dealt(transactions, documents, settings)
    scope = dealt.schema["scope_id"].dataType.simpleString()
    sets = f"scope_id {scope}, transaction_id string, places array<int>, document_ids array<string>"
    found = cut(dealt.mapInArrow(_walk(settings, wanted, "sets", most), f"{sets}, {LONGS}"), "pool-sets")
    whole = found.where("places is not null").select("scope_id", "transaction_id", "places", "document_ids")
    parts = _placed(found.where("places is null").withColumn("document_id", F.element_at("document_ids", 1)), wanted)
    docs = F.array_sort(F.collect_list(F.struct("place", "document_id", "hi", "lo"))).alias("docs")
    merged = parts.groupBy("scope_id", "transaction_id", "t_hi", "t_lo").agg(docs)
    return whole.unionByName(merged.mapInArrow(_merged_sets(settings, most), sets))


def names_compared(transactions: DataFrame, documents: DataFrame, settings: Settings, wanted: int) -> DataFrame:
    """For each scope how many pairs of different names its transactions and
    documents have, and how many of them ``best_documents`` compares."""
    dealt = _dealt(transactions, documents, settings)
    scope = dealt.schema["scope_id"].dataType.simpleString()
    found = dealt.mapInArrow(_walk(settings, wanted, "report"), f"scope_id {scope}, pairs long, compared long")
    return found.groupBy("scope_id").agg(F.sum("pairs").alias("pairs"), F.sum("compared").alias("compared"))
