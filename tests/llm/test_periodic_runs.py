import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyloom.llm import periodic_runs, queries
from tallyloom.llm.periodic_runs import find_runs, runs_of


def brute(words, least=24, times=3):
    """Every run, from every period's stretches of equal words."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((start, q, end) for (start, end), q in found.items())


def words_of(rng):
    words = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 4)):
        unit = [rng.randint(0, rng.choice([1, 3, 30])) for _ in range(rng.randint(1, 20))]
        at = rng.randint(0, len(words))
        words[at:at] = (unit * 100)[: rng.randint(10, 100)]
    return words


@pytest.mark.parametrize(("least", "times"), [(24, 3), (8, 4), (50, 3)])
def test_runs_match_brute_force(least, times, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GRID", 50)
    rng = random.Random(least)
    for _ in range(60):
        docs = [words_of(rng) for _ in range(rng.randint(1, 6))]
        lengths = np.array([len(d) for d in docs])
        starts = np.cumsum(lengths) - lengths
        start, end, period = runs_of(np.array(sum(docs, []), np.int64), starts, lengths, least, times)
        expected = [(s + int(at), q, e + int(at)) for at, d in zip(starts, docs, strict=True) for s, q, e in brute(d, least, times)]
        assert list(zip(start.tolist(), period.tolist(), end.tolist(), strict=True)) == expected


def contract(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = None
    for s, q, e in runs:
        if best is None or (e - s) * best[2] > best[1] * q:
            best = (s, e - s, q)
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(rest))


def test_query_matches_the_contract(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcÉß", k=rng.randint(1, 3)))
    texts = [rng.choice([" ", "\n", " \t ", "\x0b"]).join(word() for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += ["la " * 30, "La la " * 20, "", None, " \n ", "no break " * 30, "x " * 3000, "a b c " * 7 + "d", "end"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "w " * 40, "x", 1), (3, "v " * 25, "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, _n int").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted((contract(r[0], r[1]) for r in rows), key=str)


def test_real_outputs_and_an_empty_table(spark, docs_of):
    unit = "one two three four five six seven eight"
    docs = docs_of([f"start {unit} {unit}  {unit}\n{unit} end", "plain text"])
    first, second = sorted(find_runs(docs).collect())
    assert [tuple(r) for r in first.runs] == [(1, 32, 8)] and first.collapsed == f"start {unit} end" and first.n_words == 34
    assert (second.runs, second.collapsed) == ([], "plain text")
    assert find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="times"):
        find_runs(docs, times=2)


def test_a_text_longer_than_a_lot(docs_of, monkeypatch):
    monkeypatch.setattr(periodic_runs, "LOT_BYTES", 100)
    texts = ["a b " * 500, "x", "c " * 60, "d e f g " * 30]
    found = sorted(find_runs(docs_of(texts)).collect())
    assert [[tuple(r) for r in f.runs] for f in found] == [[(0, 1000, 2)], [], [(0, 60, 1)], [(0, 120, 4)]]
