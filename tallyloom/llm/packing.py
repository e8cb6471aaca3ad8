"""Best-fit packing of tokenised documents, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt into
partitions of a bounded size, each packed by best-fit decreasing.  Dual-feasible
functions give a lower bound of each partition's bins; where the bins reach it
the partition is certified and closed.  Partitions with a gap, and the emptiest
bin of every other one, exchange documents: their bins go to new partitions
whole, where best-fit decreasing runs again over the mixed documents and its
result is taken if it needs fewer bins.  So a round never makes it worse.
"""

from __future__ import annotations

import json
import os
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import tidy
from tallyloom.scratch import cut

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
# The settings of a tokenizer file whose texts may be cut at blanks.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLIT = {
    "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed", "invert": True,
}
#: Lower-case letters, digits and blanks below U+0180, where Arrow's lower case
#: and blanks agree with the tokenizer's and every text is in NFC.
LETTERS, DIGITS, BLANKS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\x{17f}", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
#: The pre-tokens of that pattern which are not runs of letters.
APART = f"('s|'t|'re|'ve|'m|'ll|'d|[{DIGITS}]|[^{BLANKS}{LETTERS}{DIGITS}]+)"
#: Texts with other characters, U+0130, separators that not all take for
#: blanks, or what may be a special token go to the tokenizer whole.
UNUSUAL = r"[^\x00-\x1b\x20-\x{12f}\x{131}-\x{17f}]|<\|"
_ENCODERS: dict[str, Encoder] = {}


class Cache:
    """A bounded map: two generations of ``held`` entries, of which the older
    one goes when the newer is full; what is asked for again moves over."""

    def __init__(self, held: int) -> None:
        self.held = held
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        """Begin a new generation if the newer one is full."""
        if len(self.new) > self.held:
            self.old, self.new = self.new, {}

    def missing(self, keys) -> list[str]:
        """Those of the keys that are in neither generation; all others are in
        the newer one from now on."""
        new, old, lost = self.new, self.old, []
        for k in keys:
            if k not in new:
                if (v := old.get(k)) is None:
                    lost.append(k)
                else:
                    new[k] = v
        return lost


class Encoder:
    """Token ids of texts, with a bounded cache.

    No token spans pre-tokens, so texts are lower-cased, pre-tokens are parted
    by blanks, and each different one is looked up once for a whole lot of
    texts; the tokenizer encodes those that are new, many in one call.  The
    settings that this takes for granted are read from the file; under any
    other the tokenizer is given every text whole."""

    def __init__(self, path: str, held: int = 60_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        before = said["pre_tokenizer"] or {}
        self.by_words = (
            said["normalizer"] == NORMALIZER
            and (before.get("pretokenizers") or [None])[0] == SPLIT
            and all(t["content"].startswith("<|") for t in said["added_tokens"])
            and said["truncation"] is said["padding"] is None
        )
        self.known = Cache(held)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        lots = [words[i : i + 64] for i in range(0, len(words), 64)]
        for lot, got in zip(lots, self.tokenizer.encode_batch([" ".join(x) for x in lots], add_special_tokens=False), strict=True):
            ids, places = np.array(got.ids, "<u4"), np.array(got.word_ids, np.int64)
            if len(places) and places[-1] == len(lot) - 1:
                ends = np.searchsorted(places, np.arange(len(lot)), "right")
                parts = [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                parts = [self._whole(w).tobytes() for w in lot]
            self.known.new.update(zip(lot, parts, strict=True))

    def _parts(self, words: list[str]) -> list[bytes]:
        self.known.turn()
        self._learn(self.known.missing(words))
        return list(map(self.known.new.__getitem__, words))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        if not self.by_words:
            return list(map(self._whole, texts.to_pylist()))
        odd = pc.match_substring_regex(texts, UNUSUAL)
        spaced = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(odd, "", texts)), APART, r" \1 ")
        words = pc.utf8_split_whitespace(spaced)
        coded = words.flatten().dictionary_encode()
        parts = self._parts(coded.dictionary.to_pylist())
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        held, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        place = np.repeat((starts[at] - ends[:-1]).astype(np.int32), sizes[at])
        place += np.arange(len(place), dtype=np.int32)
        ids = held[place]
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        found = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            found[i] = self._whole(texts[i].as_py())
        return found


def encoder(path: str) -> Encoder:
    """The process's encoder of a file: making one takes memory that is not given
    back, and Spark's workers do one task after another, each on one core."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _lots(texts: pa.Array, limit: int):
    """First row and texts of runs of about ``limit`` bytes; one long text may be more."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def _pieces(path: str, capacity: int, end_id: int, lot_bytes: int):
    def run(batches):
        encode, end = encoder(path).encode, np.array([end_id], "<u4")
        for batch in batches:
            docs, out = batch.column(0).to_pylist(), []
            for at, texts in _lots(pc.fill_null(batch.column(1), ""), lot_bytes):
                for doc, ids in zip(docs[at:], encode(texts), strict=False):
                    ids = np.concatenate([ids, end])
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        out.append((doc, piece, start, len(part), zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece, and the number of bins.  Pieces come in
    descending length; each goes to the fullest bin that still takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, n = 0, 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k, n = capacity, n, n + 1
        bins[i], offsets[i] = k, capacity - room
        if left := room - size:
            by_room.setdefault(left, []).append(k)
            rooms |= 1 << left
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """A proven number of bins that any packing needs, from dual-feasible
    functions over the histogram of lengths."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    # Pieces over capacity - t count as whole, those under t as nothing.
    for t in range(1, capacity // 2 + 1):
        whole = sizes > capacity - t
        middle = (sizes >= t) & ~whole
        best = max(best, int(counts[whole].sum()) - (-int((sizes * counts)[middle].sum()) // capacity))
        if t > sizes[-1]:
            break
    # Rounding to multiples of 1 / k: x stays where (k + 1) x is an integer.
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        value = np.where(exact, k * sizes, capacity * (scaled // capacity))  # times k * capacity
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


PACKED = PIECE + ", sequence_id long, offset long, open boolean, saved long"


def _pack(capacity: int, number: int):
    """Repack one partition; ``number`` makes its sequence ids unlike others'."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = group["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        old = group["sequence_id"].to_numpy(zero_copy_only=False)
        had = len(np.unique(old)) if group["sequence_id"].null_count == 0 else None
        ids = (np.int64(number) << 56) + (np.int64(group["g"][0].as_py()) << 24) + bins
        if had is not None and n >= had:
            ids, offsets, bins, n = old.astype(np.int64), group["offset"].to_numpy(), np.unique(old, return_inverse=True)[1], had
        room = capacity - np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        again = room > 0 if n > bound else np.arange(n) == room.argmax()
        out = group.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        saved = np.zeros(len(lengths), np.int64)
        saved[0] = 0 if had is None else had - n
        extra = {"sequence_id": ids, "offset": offsets, "open": (again & (room > 0))[bins], "saved": saved}
        for name, values in extra.items():
            out = out.append_column(name, pa.array(values))
        return out

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    group_rows: int = 8192,
    rounds: int = 6,
    lot_bytes: int = 1 << 23,
) -> DataFrame:
    """Return doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``lot_bytes`` of texts are encoded at once by a task: smaller lots take less
    memory and more time, with the same result.

    A document is its token ids, without special tokens, and ``end_id``.  Only
    longer ones than ``capacity`` are cut, into pieces of that length and a rest.
    A sequence's pieces follow each other without a gap from offset 0.
    ``group_rows`` is about the number of pieces packed by one task; ``rounds``
    bounds the exchanges, which end earlier when one saves nothing.

    Null and empty texts are one piece that holds ``end_id`` alone.  A null id
    stays null, and rows that repeat an id are packed each.  An empty table
    gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(texts.mapInArrow(tidy(_pieces(tokenizer_path, capacity, end_id, lot_bytes)), PIECE), "pack-pieces")

    count = pieces.count()
    if not count:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    groups = ceil(count / group_rows)
    # Repeated rows are told apart by their place in the written files, which stays.
    place = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())
    none = F.lit(None).cast("long")
    dealt = pieces.select("*", none.alias("sequence_id"), none.alias("offset"), F.pmod(place, F.lit(groups)).alias("g"))
    packed = cut(dealt.groupBy("g").applyInArrow(_pack(capacity, 0), PACKED), "pack-round")

    closed = packed.where("not open")
    for number in range(1, rounds + 1):
        left = packed.where("open").drop("open", "saved")
        count = left.count()
        if not count:
            break
        groups = ceil(count / group_rows)
        route = F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(groups))
        packed = cut(left.withColumn("g", route).groupBy("g").applyInArrow(_pack(capacity, number), PACKED), "pack-round")
        closed = closed.unionByName(packed.where("not open"))
        if groups == 1 or not packed.agg(F.sum("saved")).first()[0]:
            break
    return closed.unionByName(packed.where("open")).drop("open", "saved")
