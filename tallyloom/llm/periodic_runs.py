"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Every stretch of 2**k words gets a number, its name, from the names of its two
halves; equal names mean equal stretches of one document.  A stretch that is the
only one of its kind in its document needs no name and is in no longer repeat,
so ordinary prose has few names left after some levels.  How far two places
agree, forwards or backwards, is read off the names from the highest level down.

A run of period q and at least 3 q words covers a multiple x of q, counted from
the document's first word, so that the stretches from x and x + q agree in more
than q words.  Such grid places are the candidates of every period; one look at
the names of a fitting level decides whether a candidate is extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import tidy

#: Texts are worked on in lots of about so many bytes; one longer text is a lot.
LOT_BYTES = 4 << 20
#: Grid places that are looked at together.
GRID = 2_000_000


def _named(keys: np.ndarray) -> np.ndarray:
    """A number for each key that occurs more than once, -1 for the others."""
    order = np.argsort(keys)
    first = np.ones(len(keys), bool)
    np.not_equal(keys[order[1:]], keys[order[:-1]], out=first[1:])
    group = np.cumsum(first) - 1
    repeated = np.bincount(group) > 1
    fresh = np.where(repeated, np.cumsum(repeated) - 1, -1)
    names = np.empty(len(keys), np.int32)
    names[order] = fresh[group]
    return names


def name_levels(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 2**k words from every place, for k = 0, 1 ... as
    long as a stretch repeats within its document.  ``words`` are numbers from 0;
    documents are given by their first places and lengths.  One -1 is appended,
    for places outside."""
    end = np.repeat(starts + lengths, lengths)
    doc = np.repeat(np.arange(len(starts)), lengths)
    names = _named(doc * (int(words.max(initial=0)) + 1) + words)
    levels, half = [], 1
    while True:
        levels.append(np.append(names, np.int32(-1)))
        at = np.flatnonzero(names >= 0)
        at = at[at + 2 * half <= end[at]]
        at = at[names[at + half] >= 0]
        if not len(at):
            return levels
        found = _named(names[at].astype(np.int64) * (int(names.max()) + 1) + names[at + half])
        names = np.full(len(names), -1, np.int32)
        names[at] = found
        half *= 2
        if not (found >= 0).any():
            return levels


def agree(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
    """In how many words the places x < y of a document agree from there on, or
    just before them."""
    outside, length = len(levels[0]) - 1, np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        if back:
            a, b = x - length - step, y - length - step
            a, b = np.where(a < 0, outside, a), np.where(b < 0, outside, b)
        else:
            a, b = np.minimum(x + length, outside), np.minimum(y + length, outside)
        a, b = levels[k][a], levels[k][b]
        length += ((a >= 0) & (a == b)) * step
    return length


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1 ... below each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _grids(k: int, first: int, last: int, starts: np.ndarray, lengths: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the grids of the periods ``first`` to ``last``."""
    most = np.minimum(last, lengths // times) - first + 1
    starts, lengths, most = starts[most > 0], lengths[most > 0], most[most > 0]
    period = first + _spread(most)
    start, length = np.repeat(starts, most), np.repeat(lengths, most)
    points = np.maximum((length - (1 << k)) // period, 0)
    cuts = np.searchsorted(np.cumsum(points), np.arange(GRID, int(points.sum()) + GRID, GRID), "left") + 1
    for a, b in zip([0, *cuts[:-1]] if len(cuts) else [], cuts, strict=True):
        n = points[a:b]
        yield np.repeat(start[a:b], n) + _spread(n) * np.repeat(period[a:b], n), np.repeat(period[a:b], n)


def runs_of(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run, by start and period."""
    empty = np.zeros(0, np.int64)
    found = [(empty, empty, empty)]
    if len(words):
        levels = name_levels(words, starts, lengths)
        doc = np.repeat(np.arange(len(starts)), lengths)
        # A run's first grid place agrees with the next one in so many words at least.
        sure = lambda q: max((times - 2) * q + 1, least - 2 * q + 1)
        longest, q = int(lengths.max()) // times, 1
        while q <= longest:
            k, last = sure(q).bit_length() - 1, q
            while last < longest and sure(last + 1).bit_length() - 1 == k:
                last += 1
            if k < len(levels):
                docs = np.unique(doc[np.flatnonzero(levels[k] >= 0)])
                docs = docs[lengths[docs] >= max(least, times * q)]
                for x, period in _grids(k, q, last, starts[docs], lengths[docs], times):
                    a = levels[k][x]
                    hit = np.flatnonzero(a >= 0)
                    hit = hit[a[hit] == levels[k][x[hit] + period[hit]]]
                    x, period = x[hit], period[hit]
                    before = agree(levels, x, x + period, back=True)
                    new = before < period  # else an earlier grid place has the run
                    x, period, before = x[new], period[new], before[new]
                    end = x + period + agree(levels, x, x + period)
                    long = end - (x - before) >= np.maximum(least, times * period)
                    found.append(((x - before)[long], end[long], period[long]))
            q = last + 1
    start, end, period = (np.concatenate(c) for c in zip(*found, strict=True))
    # A multiple of a run's period finds the same stretch again.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + LOT_BYTES, "right")))
        yield at, end
        at = end


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _finder(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _lots(batch.column(1)):
                ids, texts = batch.column(0).slice(a, b - a), pc.fill_null(batch.column(1).slice(a, b - a), "")
                parts = pc.ascii_split_whitespace(texts)
                values, owner = parts.flatten(), pc.list_parent_indices(parts)
                full = pc.not_equal(values, "")
                values, owner = values.filter(full), owner.filter(full).to_numpy(zero_copy_only=False)
                lengths = np.bincount(owner, minlength=len(ids)).astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                words = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                start, end, period = runs_of(words, starts, lengths, least, times)
                of = np.searchsorted(starts + lengths, start, "right")
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, end, -1)
                stays = np.cumsum(edge[:-1]) == 0
                kept = np.bincount(owner[stays], minlength=len(ids))
                cuts = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
                listed = pa.StructArray.from_arrays([pa.array(start - starts[of]), pa.array(end - start), pa.array(period)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(lengths), pa.ListArray.from_arrays(cuts(np.bincount(of, minlength=len(ids))), listed),
                        pc.binary_join(pa.ListArray.from_arrays(cuts(kept), values.filter(pa.array(stays))), " "),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Return doc_id, n_words, runs, collapsed, one row per input row.

    Words are stretches of characters other than space and tab to carriage
    return, numbered from 0.  A run is a stretch of words with smallest period q
    (words q apart are identical, case included) and at least ``least`` and
    ``times`` q words (``times`` is 3 or more) that no neighbouring word extends;
    ``runs`` lists start, length and period by start, then period.  ``collapsed``
    is the text without what only repeats: a word goes if a run has it after its
    first q words; the others are joined by single spaces.

    Null text counts as empty: no words, no runs, an empty ``collapsed``.  Ids
    are passed on as they are, null and repeated ones too; an empty table gives
    an empty result; other columns are ignored.  Texts are whole; one task needs
    memory for names of its longest text, about four bytes a word and level.
    """
    if times < 3:
        raise ValueError("times is 3 or more")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return texts.mapInArrow(tidy(_finder(least, times)), kind)
