import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tallyloom.llm import queries, spelling
from tallyloom.llm.spelling import count_words, near_pairs, near_rows, spelling_variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, ratio=5):
    near_of = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if near(a, b):
            near_of[a].append(b)
            near_of[b].append(a)
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, len(near_of[w]), None if form[w] is None else counts[form[w]]) for w, n in counts.items()}


def test_tries_match_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        rows = {(rng.randint(0, 2), "".join(rng.choices("abé"[: rng.randint(1, 3)], k=rng.randint(1, 6)))) for _ in range(rng.randint(2, 60))}
        numbers = {p: i for i, p in enumerate(sorted({p for p, _ in rows}))}
        rows = sorted((numbers[p], s) for p, s in rows)
        found = set()
        for a, b in near_rows(np.array([p for p, _ in rows]), [s for _, s in rows]):
            found |= {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
        assert found == {(i, j) for i, j in combinations(range(len(rows)), 2) if rows[i][0] == rows[j][0] and near(rows[i][1], rows[j][1])}


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abcdé", k=rng.randint(2, 12))) for _ in range(n)}
    for w in list(words):
        at = rng.randrange(len(w) + 1)
        words |= {w[:at] + rng.choice("abÿ") + w[at:], w[:at] + w[at + 1 :]}
    words = {w for w in words if len(w) > 1} | {"same" * 30, "same" * 30 + "s", "aaaaaa", "aaaaaaa", "aaaaaaaa"}
    return {w: rng.choice([5, 6, 7, 25, 30, 200, 200, 1000, 9000]) for w in sorted(words)}


@pytest.mark.parametrize(("part_rows", "cells"), [(5000, 1_000_000), (20, 60)])
def test_variants_match_brute_force(spark, part_rows, cells, monkeypatch):
    """Large parts are dealt again, down to one code point, with the same result."""
    monkeypatch.setattr(spelling, "LOT_CELLS", cells)
    counts = vocabulary(part_rows)
    words = spark.createDataFrame([(w, n, "clash") for w, n in counts.items()], "word string, n long, part string")
    found = [tuple(r) for r in spelling_variants(words, part_rows=part_rows).collect()]
    assert len(found) == len(counts) and set(found) == brute(counts)


def test_edge_words(spark):
    words = spark.createDataFrame([("a", 5), ("ab", 100), (None, 7), ("b", 9), ("ac", 4)], "word string, n long")
    found = {tuple(r) for r in spelling_variants(words).collect()}
    assert found == {("a", None, "a", 5, 0, None), ("b", None, "b", 9, 0, None), (None, None, None, 7, 0, None), ("ab", None, "ab", 100, 1, None), ("ac", "ab", "ab", 4, 1, 100)}
    assert spelling_variants(words.limit(0)).count() == 0 and near_pairs(words.limit(0)).count() == 0


def contract(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{word}".encode())
            counts[word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def test_query_matches_the_contract(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 50)
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdeÀé×", k=rng.randint(5, 9))) for _ in range(60)]
    texts = [rng.choice([" ", "\n", "-", "ā", "7"]).join(rng.choice([w, w.upper(), w.capitalize()]) for w in rng.choices(base, k=rng.randint(0, 300))) for _ in range(120)]
    rows = [*enumerate(texts), (None, " ".join(base * 3)), (3, texts[0]), (3, texts[0]), (500, ""), (501, None), (502, "abcdef" * 2000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op12_spelling_variants(spark, str(tmp_path)).collect()]
    expected = contract(rows)
    assert len(found) == len(expected) and set(found) == expected and any(r[1] for r in found)


def test_counts_without_a_change(docs_of):
    found = {tuple(r) for r in count_words(docs_of(["Straße straße STRASSE", "straße", None]), least_count=1).collect()}
    assert found == {("straße", 3), ("strasse", 1)}
    assert count_words(docs_of(["x"]).limit(0)).count() == 0
