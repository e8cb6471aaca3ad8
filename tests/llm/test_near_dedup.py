import random
import re

import numpy as np
import pytest

from tallyloom.llm import near_dedup
from tallyloom.llm.near_dedup import log_likelihood, near_duplicates, registers
from tallyloom.llm.shingles import constants, mix


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts, percent):
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(s), top(i), top(i) == i) for i, s in enumerate(sets)}


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 5)))
    base = [word() for _ in range(90)]
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [" ".join(word() for _ in range(40)) for _ in range(30)]
    texts += [texts[0]] * 5 + [texts[0].upper()] + ["one two", "One\ttwo", "ONE", "", None, " \n ", " ".join(base * 40)]
    return texts


@pytest.mark.parametrize(("percent", "bands", "size"), [(85, 32, 6), (80, 40, 5)])
def test_matches_brute_force(docs_of, percent, bands, size):
    texts = corpus(percent)
    found = near_duplicates(docs_of(texts), percent=percent, bands=bands, band_size=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(texts, percent)


def one_template(seed, n=40):
    """Texts that share half their words; each has a near copy, some a longer one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 6)))
    shared, texts = [word() for _ in range(150)], []
    for _ in range(n):
        words = shared + [word() for _ in range(rng.choice([20, 25, 30, 60]))]
        other = list(words)
        other[rng.randrange(len(other))] = word()
        texts += [" ".join(words), " ".join(other), " ".join(words + [word() for _ in range(rng.randint(0, 12))])]
    return texts


def test_crowded_buckets_meet_by_rare_shingles(docs_of, monkeypatch):
    met, prefixes = [], near_dedup._prefixes
    monkeypatch.setattr(near_dedup, "_prefixes", lambda *a: met.append(1) or prefixes(*a))
    texts = one_template(1) + corpus(2)
    found = near_duplicates(docs_of(texts), bucket_pairs=0).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(texts, 85)
    assert met


def test_empty_table_null_and_repeated_ids(spark, docs_of):
    assert near_duplicates(docs_of(["a"]).limit(0)).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [(-1, -1, True), (3, 3, True), (7, 3, False), (7, 3, False)]


def brute_rows(rows, percent=85):
    """By rows, with those of one id as one document; a row without shingles or id is alone."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if not a or not sets[j] or rows[i][0] is None or rows[j][0] is None or label[i] == label[j]:
                    continue
                both = len(a & sets[j])
                if rows[i][0] == rows[j][0] or 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
                    changed = True
    found = []
    for i, (doc_id, _) in enumerate(rows):
        top = doc_id if not sets[i] or doc_id is None else min(rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None and sets[j])
        found.append((doc_id, len(sets[i]), top, doc_id == top))
    return sorted(found, key=str)


@pytest.mark.parametrize("order", [1, -1])
def test_an_id_with_different_texts(spark, order):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    near = lambda words: " ".join([*words[:-1], word()])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (3, near(a)), (9, near(b)), (9, near(c)), (12, " ".join(c)), (7, ""), (2, None), (None, near(a)), (12, near(c)), (7, " ".join(a))]
    rows = rows[::order] + [(20 + i, near(b)) for i in range(3)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_rows(rows)
    many = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket_pairs=0, broadcast_rows=0).collect()
    assert sorted((tuple(r) for r in many), key=str) == brute_rows(rows)


def test_registers_merge_and_estimate():
    a, b = constants(256, 1), constants(256, 2)
    hashes = mix(np.arange(1, 3001, dtype=np.uint64))
    x, y = hashes[:2000], hashes[1000:]
    rx, ry = registers(x, a, b), registers(y, a, b)
    assert (np.maximum(rx, ry) == registers(hashes, a, b)).all()
    grid = np.linspace(0, 1, 101)[None, :]
    u = np.array([[0.5]])
    found = log_likelihood(grid, *[np.array([[v]]) for v in ((rx > ry).sum(), (rx < ry).sum(), (rx == ry).sum())], u)
    assert abs(grid[0, found.argmax()] - 1 / 3) < 0.12
