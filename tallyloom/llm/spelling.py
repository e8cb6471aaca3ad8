"""Spelling variants: words one edit apart, found by a trie self-join.

Words are counted once; all that follows works on the vocabulary.

The vocabulary is dealt out by prefixes.  Of two words one edit apart, the shorter
of ``l`` code points, the edit lies in the first or in the second half of it, and
they share the other half: the prefix, or the suffix, which is the prefix of the
word turned round.  So a word stands in the parts of its own length and of the
length below, once by prefix and once by suffix.  A part with too many words is
dealt again by halves of the stretch that is still open, down to one code point.

In a part the words' open stretches form a trie.  From the root down, level by
level, every node carries the nodes at distance one from it (its active nodes):
siblings differ by a replaced code point, a node and its child by an inserted one,
and children of an active pair stay active under the same code point.  Where both
nodes of a pair end a word, the pair is emitted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, tidy
from tallyloom.scratch import cut

#: Words as lower-cased runs of these characters.
LETTERS = "A-Za-zÀ-ÿ"
#: Different words that a task counts before it passes them on.
COUNTED = 200_000
#: Parts with more rows are dealt again.
PART_ROWS = 5_000
#: Code points of a lot of parts that are joined together.
LOT_CELLS = 1_000_000
#: More oversized parts than this are joined by shuffling.
BROADCAST_PARTS = 200_000


def count_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: str = LETTERS,
    least_length: int = 6,
    least_count: int = 5,
    change: Callable[[int | None], Callable[[str], str]] | None = None,
) -> DataFrame:
    """Return word, n: how often each word of at least ``least_length`` code
    points occurs, for words with ``least_count`` occurrences or more.

    Words are maximal runs of ``letters`` with A-Z lower-cased.  ``change`` gives,
    for an id, what becomes of a run of that document before it counts.  Null
    texts have no words, rows with a null id count like others, repeated rows
    count each time, an empty table gives an empty result; other columns are
    ignored.  A task holds at most about 200,000 different words at once, and
    those of one text.
    """
    found = re.compile(f"[{letters}]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            words = [w for w in counts if len(w) >= least_length]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for doc, text in zip(*batch.columns, strict=True):
                # Of bytes, lower() changes A-Z only.
                runs = Counter(found.findall(text.as_py().encode().lower().decode()) if text.is_valid else ())
                if change is None:
                    counts.update(runs)
                else:
                    changed = change(doc.as_py())
                    for word, n in runs.items():
                        counts[changed(word)] += n
                if len(counts) > COUNTED:
                    yield passed_on()
        yield passed_on()

    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    partial = texts.mapInArrow(tidy(run), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _spread(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class _Level:
    """The trie's nodes at one depth, by parent and code point."""

    def __init__(self, parent: np.ndarray, point: np.ndarray, word: np.ndarray, parents: int) -> None:
        self.parent, self.point, self.word = parent, point, word
        self.keys = (parent << 21) | point
        self.first = np.searchsorted(parent, np.arange(parents + 1))

    def below(self, u: np.ndarray, v: np.ndarray, other: _Level) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, ours of ``u`` and the other level's of ``v``, under
        the same code point."""
        counts = self.first[u + 1] - self.first[u]
        child = np.repeat(self.first[u], counts) + _spread(counts)
        key = (np.repeat(v, counts) << 21) | self.point[child]
        at = np.minimum(np.searchsorted(other.keys, key), max(0, len(other.keys) - 1))
        same = other.keys[at] == key if len(other.keys) else np.zeros(len(key), bool)
        return child[same], at[same]


def _trie(part: np.ndarray, stretches: list[str]) -> list[_Level]:
    """Levels 1, 2 ... of the tries of all parts.  Rows are sorted by part, then
    by stretch in code-point order; part p is node p of level 0.  The last level
    has no nodes."""
    longest = max(1, *map(len, stretches))
    points = np.array(stretches, f"U{longest}").view(np.uint32).reshape(len(stretches), longest).astype(np.int64)
    lengths = np.array([len(s) for s in stretches])
    differ = points[1:] != points[:-1]
    # Length of the prefix shared with the row before; -1 in another part.
    shared = np.where(part[1:] == part[:-1], np.where(differ.any(axis=1), differ.argmax(axis=1), longest), -1)
    shared = np.append(-1, shared)
    levels, node, above = [], part, int(part[-1]) + 1
    for depth in range(1, longest + 1):
        first = np.flatnonzero((shared < depth) & (points[:, depth - 1] > 0))
        word = np.where(lengths[first] == depth, first, -1)
        levels.append(_Level(node[first], points[first, depth - 1], word, above))
        begun = np.zeros(len(part), np.int64)
        begun[first] = 1
        # Rows that ended before this depth have no node; none asks for it.
        node, above = np.maximum(np.cumsum(begun) - 1, 0), len(first)
    none = np.zeros(0, np.int64)
    levels.append(_Level(none, none, none, above))
    return levels


def near_rows(part: np.ndarray, stretches: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one part whose stretches are one edit apart: once for
    equal lengths, the shorter one first otherwise; a pair may come repeatedly."""
    levels = _trie(part, stretches)
    none = np.zeros(0, np.int64)
    same = (none, none)
    longer = (levels[0].parent, np.arange(len(levels[0].parent)))
    for here, below in zip(levels, [*levels[1:], levels[-1]], strict=True):
        # Both one level down: siblings, and children of pairs under one code point.
        after = here.first[here.parent + 1] - 1 - np.arange(len(here.parent))
        left = np.repeat(np.arange(len(here.parent)), after)
        kept = here.below(*same, here)
        same = np.append(kept[0], left), np.append(kept[1], left + 1 + _spread(after))
        kept = here.below(*longer, below)
        pairs = np.append(kept[0], below.parent), np.append(kept[1], np.arange(len(below.parent)))
        whole = np.unique((pairs[0] << 32) | pairs[1])
        longer = whole >> 32, whole & 0xFFFFFFFF
        for (u, v), other in ((same, here), (longer, below)):
            a, b = here.word[u], other.word[v]
            ends = (a >= 0) & (b >= 0)
            yield a[ends], b[ends]
        if not len(below.parent):
            return


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each part; rows come sorted by part and stretch."""
    names = ["word", "n", "other", "other_n"]

    def pairs(lot: pa.Table) -> Iterator[pa.RecordBatch]:
        part = lot.column("part").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        word, n = lot.column("word").combine_chunks(), lot.column("n").combine_chunks()
        short = lot.column("short").to_numpy()
        for a, b in near_rows(part, lot.column("stretch").to_pylist()) if len(part) > 1 else ():
            # Two words of the greater length meet in the parts of their own length.
            fit = short[a]
            a, b = a[fit], b[fit]
            for x, y in ((a, b), (b, a)):
                yield pa.RecordBatch.from_arrays([word.take(pa.array(x)), n.take(pa.array(x)), word.take(pa.array(y)), n.take(pa.array(y))], names=names)

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        parts = table.column("part").combine_chunks().dictionary_encode().indices.to_numpy()
        widest = np.maximum.accumulate(pc.utf8_length(table.column("stretch")).to_numpy())
        starts = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(parts))
        at = 0
        for end, more in zip(starts[1:-1], starts[2:], strict=True):
            if (more - at) * widest[more - 1] > LOT_CELLS:
                yield from pairs(table.slice(at, end - at))
                at = end
        rest = table.slice(at)
    if rest is not None:
        yield from pairs(rest)


def _windows(rows: DataFrame, windows: Column) -> DataFrame:
    """Rows of words in the parts that ``windows`` (l, a, b) give them: what stands
    before place a and the last l - b code points are shared there."""
    rows = rows.select("word", "n", F.explode(windows).alias("w")).select("word", "n", "w.l", "w.a", "w.b")
    length = F.char_length("word")
    tail = F.col("l") - F.col("b")
    name = F.concat_ws(":", F.lpad(F.col("l").cast("string"), 6, "0"), "a", "b", F.substring("word", F.lit(1), F.col("a")), F.substring("word", length - tail + 1, tail))
    stretch = F.substring("word", F.col("a") + 1, length - F.col("a") - tail)
    return rows.select("word", "n", "l", "a", "b", (length == F.col("l")).alias("short"), name.alias("part"), stretch.alias("stretch"))


def near_pairs(words: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Return word, n, other, other_n, both ways round: every two different words
    of ``words`` (word, n) that are exactly one inserted, deleted or replaced code
    point apart.  Words are different and have two code points at least."""
    spark = words.sparkSession
    window = lambda l, a, b: F.struct(l.cast("int").alias("l"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    halves = lambda l: [window(l, F.lit(0), F.floor(l / 2)), window(l, F.floor(l / 2), l)]
    length = F.char_length("word")
    open_rows = _windows(words, F.array(*halves(length), *halves(length - 1)))
    ready: list[DataFrame] = []
    while True:
        open_rows = cut(open_rows, "spelling-parts")
        large = cut(open_rows.groupBy("part", "a", "b").agg(F.count("*").alias("c")).where((F.col("c") > part_rows) & (F.col("b") - F.col("a") > 1)), "spelling-large")
        if large.isEmpty():
            ready.append(open_rows)
            break
        large = broadcast_if_small(large.select("part"), BROADCAST_PARTS)
        ready.append(open_rows.join(large, "part", "left_anti"))
        middle = F.floor((F.col("a") + F.col("b")) / 2)
        again = open_rows.join(large, "part", "left_semi")
        open_rows = _windows(again, F.array(window(F.col("l"), F.col("a"), middle), window(F.col("l"), middle, F.col("b"))))
    columns = ["part", "stretch", "short", "word", "n"]
    rows = ready[0].select(columns)
    for more in ready[1:]:
        rows = rows.unionByName(more.select(columns))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(tasks, "part").sortWithinPartitions("part", "stretch")
    return dealt.mapInArrow(tidy(_joined), "word string, n long, other string, other_n long").distinct()


def spelling_variants(words: DataFrame, ratio: int = 5, part_rows: int = PART_ROWS) -> DataFrame:
    """Return word, form, root, n, n_near, form_n for ``words`` (word, n).

    Words are near when exactly one inserted, deleted or replaced code point
    apart.  A word's form is its near word of largest n, of equal ones the first
    in code-point order, if that n is at least ``ratio`` times the word's; else
    null.  ``root`` follows forms to the last, and is the word itself without a
    form.  ``n_near`` counts near words.

    Words with null or of fewer than two code points are near to none; words are
    given once each.  An empty table gives an empty result; other columns are
    ignored.  A word has at most some hundred near words for each of its code
    points, so no word is a hot key.
    """
    words = words.select("word", "n")
    near = near_pairs(words.where(F.char_length("word") > 1), part_rows)
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    close = -F.col("best.minus") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(close, F.col("best.form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(close, -F.col("best.minus")).alias("form_n"),
    )
    found = cut(found, "spelling-forms")

    # Counts grow along forms, so there are no circles; each round doubles the way.
    ways = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = cut(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if ways.where("moved").isEmpty():
            break
    roots = ways.select("word", "root")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
