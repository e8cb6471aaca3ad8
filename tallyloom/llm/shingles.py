"""Hashed word shingles of Arrow text columns, computed with numpy.

Words are runs of bytes other than space and tab to carriage return, after
lower-casing A-Z.  A word's hash is a polynomial over its bytes, mixed; a
shingle's hash mixes the hashes of its words in order.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on ``seed`` alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of about ``limit`` bytes (one long text may be
    more): the first row, the bytes with A-Z lower-cased, and the rows' offsets."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, lower[raw[offsets[at] : offsets[end]]], offsets[at : end + 1] - offsets[at]
        at = end


BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_hashes(
    text: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS, beginning: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, in order.  ``separators`` says for each
    byte whether it parts words; ``beginning`` hashes only so many first bytes."""
    solid = ~separators[text]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(text))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    places = np.flatnonzero(solid)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE, np.uint64))
    where = places - np.repeat(starts, lengths)
    if beginning:
        places, where = places[where < beginning], where[where < beginning]
        lengths = np.minimum(lengths, beginning)
    sums = np.add.reduceat((text[places].astype(np.uint64) + np.uint64(1)) * powers[where], np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64)), starts, ends


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of one text's shingles, in order, repeats included.  A text of
    fewer words than ``size`` has its whole sequence as one, an empty one none."""
    if not len(words):
        return words
    weights = constants(size, 77)
    if len(words) < size:
        return mix((words * weights[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k : k + n] * weights[k]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text, its distinct shingle hashes in ascending order."""
    for _, text, offsets in chunks(texts):
        words, starts, _ = word_hashes(text, offsets)
        cuts = np.searchsorted(starts, offsets)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(shingle_hashes(words[a:b], size))
