import random
import re

import pytest

from tallyloom.llm.decontaminate import find_contaminated, least_hits


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_matches_brute_force(spark, docs_of, block):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    items = [" ".join(word() for _ in range(n)) for n in (2, 4, 5, 20, 40, 70, 200)] + ["", None]
    texts = [" ".join(word() for _ in range(60)) for _ in range(10)]
    for item in items[:-2]:
        words = item.split()
        texts.append(" ".join([word() for _ in range(3000)] + words + [word() for _ in range(50)]))
        cut = words[: max(1, int(len(words) * 0.85))]
        texts.append("X " + " ".join(cut).upper() + " end")
    texts += [items[0], items[1], items[3], "", None]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = find_contaminated(docs_of(texts), benchmark, block_shingles=block).collect()
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            s = shingles(item)
            both = len(s & shingles(t))
            if s and 100 * both >= 80 * len(s):
                want.add((d, i, len(s), both))
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_repeated_rows_null_ids_and_long_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    a, b = (" ".join(word() for _ in range(30)) for _ in range(2))
    long = " ".join(word() for _ in range(60_000))
    items = [(1, a), (1, b), (2, a), (None, a), (3, None), (2, a)]
    rows = [(7, "x " + a), (7, "x " + a), (7, "clean"), (None, a), (None, "clean"), (8, f"{long} {b} {long}"), (9, ""), (10, None)]
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n int")
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, hashes string, item int")
    want = [(d, i, len(shingles(item)), len(shingles(item) & shingles(t))) for d, t in rows for i, item in items if shingles(item) and 100 * len(shingles(item) & shingles(t)) >= 80 * len(shingles(item))]
    for block in (2_000_000, 0):
        found = [tuple(r) for r in find_contaminated(docs, benchmark, block_shingles=block).collect()]
        assert sorted(found, key=str) == sorted(want, key=str) and len(want) == 13


def test_empty_sides(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_contaminated(docs_of(["a"]).limit(0), benchmark).count() == 0
    assert find_contaminated(docs_of(["a b c d e f"]), benchmark.limit(0)).count() == 0


def test_least_hits():
    assert least_hits(10, 10, 80) == 8
    assert 15 < least_hits(48, 500, 80) < 30
