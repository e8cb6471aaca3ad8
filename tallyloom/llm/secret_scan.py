"""Secrets by rules and by probabilistic automata learned from what rules find.

Rules give the base spans.  Their matches are labelled credentials; a sample of
each kind of a stated bound becomes a prefix tree whose statistically compatible
states are merged, which leaves a probabilistic automaton of the kind's format.
States are compared by what follows them, place by place: the classes of
characters and the ends that so many places on are seen (Hoeffding's bound
decides), and of several compatible states the likeliest is taken.  So random
characters, which part a tree into single examples soon, still show how long
their format is and where its marks stand.  Every other candidate token of the corpus is
scored by its likelihood under each automaton against a uniform choice of
characters; those that fit a format become additional spans.

Candidates are tokens of the rules' own characters, of ``SHORTEST`` characters
at least, as no rule takes fewer, with a digit and a letter: words and numbers
alone fit formats of few letters or digits by their nature, and text is full of
them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import smallest_hashes
from tallyloom.scratch import cut

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
DIGIT, TOKEN, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z0-9+/_.=-]+"), re.compile("[A-Za-z]")
SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
SHORTEST = 8
#: Places after a state that are compared.
AHEAD = 64
#: Classes of characters that the automata read; any other is its own class.
CLASSES = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l")}
CLASSES |= {**dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "L")}
SIZES = {"d": 10, "h": 6, "l": 20, "H": 6, "L": 20}
ALPHABET = 67


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and secret of every base match, by start, then kind."""
    found = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidate_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Tokens with a digit and a letter that touch no base span; points at their
    ends are not of them."""
    starts, ends = [s for s, *_ in base], []
    for _, e, *_ in base:
        ends.append(max(e, ends[-1]) if ends else e)
    found, done = [], 0
    for m in DIGIT.finditer(text):
        if m.start() < done:
            continue
        start, stop = m.start(), TOKEN.match(text, m.start()).end()
        while start > done and text[start - 1] in SIGNS:
            start -= 1
        done = stop
        while text[start] == ".":
            start += 1
        while text[stop - 1] == ".":
            stop -= 1
        before = bisect_right(starts, stop - 1)
        if stop - start >= SHORTEST and LETTER.search(text, start, stop) and not (before and ends[before - 1] > start):
            found.append((start, stop, text[start:stop]))
    return found


@dataclass(slots=True)
class State:
    ends: int = 0
    to: dict[str, int] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)
    signs: dict[str, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self.ends + sum(self.seen.values())


def follows(suffix: str) -> Iterator[tuple[int, str]]:
    """What follows a state in one example: place and class of character, and
    the end as an empty class."""
    for k, sign in enumerate(suffix[:AHEAD]):
        yield k, CLASSES.get(sign, sign)
    if len(suffix) < AHEAD:
        yield len(suffix), ""


class Profile:
    """Counts of what follows a state, and how many examples reach each place."""

    def __init__(self) -> None:
        self.seen: Counter[tuple[int, str]] = Counter()
        self.reach: Counter[int] = Counter()

    def add(self, suffix: str) -> None:
        for k, c in follows(suffix):
            self.seen[k, c] += 1
            self.reach[k] += 1

    def update(self, other: Profile) -> None:
        self.seen.update(other.seen)
        self.reach.update(other.reach)

    def differs(self, other: Profile, alpha: float) -> bool:
        """Whether a share at some place differs beyond Hoeffding's bound."""
        wide = sqrt(0.5 * log(2 / alpha))
        for k, c in self.seen.keys() | other.seen.keys():
            n, m = self.reach[k], other.reach[k]
            if n and m and abs(self.seen[k, c] / n - other.seen[k, c] / m) > wide * (1 / sqrt(n) + 1 / sqrt(m)):
                return True
        return False

    def fit(self, other: Profile) -> float:
        """Log-likelihood of what follows another state under our shares."""
        return sum(n * log((self.seen[k, c] + 0.1) / (self.reach[k] + 1)) for (k, c), n in other.seen.items())


class Automaton:
    """A probabilistic automaton inferred from whole examples by merging states.

    The tree before merging has at most a state for each character of them."""

    def __init__(self, examples: list[str], alpha: float = 0.05) -> None:
        self.alpha = alpha
        self.states = [State()]
        self.after = [Profile()]
        for text in examples:
            at = 0
            for i, sign in enumerate(text):
                self.after[at].add(text[i:])
                c = CLASSES.get(sign, sign)
                here = self.states[at]
                here.signs[sign] = here.signs.get(sign, 0) + 1
                if c not in here.to:
                    here.to[c] = len(self.states)
                    self.states.append(State())
                    self.after.append(Profile())
                here.seen[c] = here.seen.get(c, 0) + 1
                at = here.to[c]
            self.after[at].add("")
            self.states[at].ends += 1
        self._merge()
        del self.after

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree's counts to a state and its successors."""
        pairs = [(into, tree)]
        while pairs:
            a, b = pairs.pop()
            p, q = self.states[a], self.states[b]
            self.after[a].update(self.after[b])
            p.ends += q.ends
            for c, n in q.signs.items():
                p.signs[c] = p.signs.get(c, 0) + n
            for c, n in q.seen.items():
                p.seen[c] = p.seen.get(c, 0) + n
                if c in p.to:
                    pairs.append((p.to[c], q.to[c]))
                else:
                    p.to[c] = q.to[c]

    def _merge(self) -> None:
        """Settled states stay apart; each of their successors, the one of most
        examples first, joins the settled state that it is compatible with and
        that what follows it is likeliest after, or is settled itself."""
        settled = [0]
        while fringe := [(r, c) for r in settled for c, t in self.states[r].to.items() if t not in settled]:
            parent, c = max(fringe, key=lambda x: self.states[self.states[x[0]].to[x[1]]].total)
            tree = self.states[parent].to[c]
            fitting = [r for r in settled if not self.after[r].differs(self.after[tree], self.alpha)]
            if fitting:
                best = max(fitting, key=lambda r: self.after[r].fit(self.after[tree]))
                self.states[parent].to[c] = best
                self._fold(best, tree)
            else:
                settled.append(tree)
        self.states = {r: self.states[r] for r in settled}

    def likelihood(self, text: str) -> float:
        """Log-likelihood ratio of a text and its end against uniform ones.

        States move by classes of characters; within a class a state prefers
        what it saw there, so that fixed beginnings count.  After a character
        that the format does not have there, nothing that follows is of it."""
        here, total = self.states[0], 0.0
        for c in text:
            kind = CLASSES.get(c, c)
            seen, size = here.seen.get(kind, 0), SIZES.get(kind, 1)
            chance = (seen + 0.01) / (here.total + 0.5) * (here.signs.get(c, 0) + 2) / (seen + 2 * size)
            total += log(chance * ALPHABET)
            here = self.states[here.to[kind]] if kind in here.to else State()
        return total + log((here.ends + 0.01) / (here.total + 0.5) * ALPHABET)


def _scan(batches):
    for batch in batches:
        ids, texts = (c.to_pylist() for c in batch.columns)
        spans, found = [], []
        for text in texts:
            base = base_spans(text or "")
            spans.append([{"start": s, "stop": e, "kind": k, "secret": x} for s, e, k, x in base])
            found.append([{"start": s, "stop": e, "token": x} for s, e, x in candidate_spans(text or "", base)])
        base_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("secret", pa.string())]))
        token_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("token", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(spans, base_type), pa.array(found, token_type)], names=["doc_id", "base", "tokens"]
        )


def learn_formats(examples: DataFrame, per_kind: int = 400) -> dict[str, Automaton]:
    """An automaton for each kind in examples(kind, secret), from ``per_kind``
    different secrets, those with the smallest hashes, or all if they are fewer."""
    different = cut(examples.select("kind", "secret").distinct(), "secret-examples")
    rows = sorted(map(tuple, smallest_hashes(different, per_kind, "kind", ["secret"], "secret-sample").select("kind", "secret").collect()))
    kinds = dict.fromkeys(k for k, _ in rows)
    return {kind: Automaton([s for k, s in rows if k == kind]) for kind in kinds}


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_kind: int = 400, least: float = 16.0, least_mean: float = 0.3
) -> DataFrame:
    """Return doc_id and spans, one row per input row.

    ``spans`` is an array of structs (start, stop, kind, format, score) by start
    and kind: base spans of kind assign, access or hex, and spans of kind
    ``learned`` whose log-likelihood ratio ``score`` under the automaton
    ``format`` is at least ``least``, and at least ``least_mean`` for each
    character.  Positions are code points, the end exclusive.  ``per_kind``
    bounds the labelled credentials that an automaton learns from; those and the
    candidates are taken whole.

    Null text counts as empty and has no spans; a null id stays null; repeated
    rows are scanned each; texts of any length are read whole.  Of automata with
    equal scores the later name is the format.  Without base matches in the table nothing is learned
    and no span is added.  An empty table gives an empty result; other columns
    are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = (
        "doc_id long, base array<struct<start:long,stop:long,kind:string,secret:string>>,"
        " tokens array<struct<start:long,stop:long,token:string>>"
    )
    scanned = cut(texts.mapInArrow(_scan, schema), "secret-spans")
    formats = learn_formats(scanned.select(F.inline("base")).select("kind", "secret"), per_kind)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for tokens in batches:
            best = [max(((a.likelihood(t), k) for k, a in formats.items()), default=(None, None)) for t in tokens]
            yield pd.DataFrame(best, columns=["score", "format"]).astype({"score": "float64"})

    judged = F.pandas_udf(judge, "score double, format string")
    # Only different tokens are scored; most documents have none.
    tokens = scanned.where(F.size("tokens") > 0).select(F.explode("tokens.token").alias("token")).distinct()
    scored = tokens.select("token", judged("token").alias("j")).where((F.col("j.score") >= least) & (F.col("j.score") >= least_mean * (F.length("token") + 1)))
    scored = cut(scored.select("token", "j.score", "j.format"), "secret-formats")
    plain = scanned.select("doc_id", "base", "tokens", F.monotonically_increasing_id().alias("row"))
    numbered = cut(plain, "secret-rows")
    extra = (
        numbered.select("row", F.inline("tokens"))
        .join(scored, "token")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "stop", F.lit("learned").alias("kind"), "format", "score")).alias("extra"))
    )
    own = F.transform(
        "base",
        lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"),
            x["kind"].alias("format"), F.lit(None).cast("double").alias("score"),
        ),
    )
    rank = lambda k: F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(KINDS) for x in (n, i)]), k)
    order = lambda x, y: F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(
        (rank(x["kind"]) - rank(y["kind"])).cast("int")
    )
    every = F.array_sort(F.concat(own, F.coalesce("extra", F.array().cast("array<struct<start:long,stop:long,kind:string,format:string,score:double>>"))), order)
    return numbered.join(extra, "row", "left").select("doc_id", every.alias("spans"))


def written(spans) -> F.Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
