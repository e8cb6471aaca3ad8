import math
import random

import numpy as np
import pytest

from tallyloom.llm import embedding_dedup
from tallyloom.llm.embedding_dedup import Blocks, embedding_duplicates, unit_vectors


def brute(rows, cosine=0.95):
    good = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, np.float64) / max(map(abs, v)) if good(v) else None for _, v in rows]
    unit = [None if u is None else u / np.sqrt((u * u).sum()) for u in unit]
    links = [[j for j, y in enumerate(unit) if j != i and x is not None and y is not None and len(x) == len(y) and (x * y).sum() >= cosine] for i, x in enumerate(unit)]
    found = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen |= set(new)
            todo += new
        top = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        found.append((vec_id, len(links[i]), top, vec_id is None or vec_id == top))
    return sorted(found, key=str)


def vectors(seed, n, d, groups):
    """Groups of vectors around centres, at distances on both sides of the bound."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    spread = rng.choice([0.05, 0.15, 0.22, 0.3], (n, 1)) * rng.standard_normal((n, d)) / np.sqrt(d)
    made = (centres[rng.integers(0, groups, n)] + spread) * rng.choice([0.01, 1, 50], (n, 1))
    return made.astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize(("d", "tile", "cosine"), [(64, (2048, 16384), 0.95), (64, (16, 16), 0.95), (33, (20, 20), 0.9), (7, (30, 30), 0.98), (1, (4, 4), 0.95)])
def test_matches_brute_force(spark, d, tile, cosine, monkeypatch):
    """Crowded cells dealt into tiles give the same counts."""
    monkeypatch.setattr(embedding_dedup, "SQUARE", 8)
    monkeypatch.setattr(embedding_dedup, "PAIRS", 16)
    made = vectors(d, 260, d, 12)
    made += made[:20] + made[:3] * 4 + [[-x for x in made[5]]]
    ids = random.Random(d).sample(range(1000), len(made))
    rows = list(zip(ids, made, strict=True))
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, key int, cell string")
    found = embedding_duplicates(frame, cosine=cosine, tile=tile).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, cosine)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [1e-300, 1e-300]), (9, [1e300, 1e300]),
        (10, [1.0, 1.0, 1.0]), (None, [2.0, 2.0]), (None, [-1.0, 0.0]), (None, None), (7, [1.0, 1.0]), (7, [0.0, -1.0]), (11, [0.0, -2.0]), (12, [1.0, 0.0]), (13, [1.0, -0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in embedding_duplicates(frame).collect()]
    assert sorted(found, key=str) == brute(rows)
    assert embedding_duplicates(frame.limit(0)).count() == 0


def test_every_pair_within_the_distance_is_within_budget_in_a_block():
    known = Blocks(64, 0.1)
    assert abs(sum(known.budgets) - 0.1) < 1e-12 and known.spans[0] == (0, 16) and known.spans[-1][1] == 64
    x = unit_vectors(np.array(vectors(3, 300, 64, 5)))
    y = known.turned(x)
    assert np.allclose(x @ x.T, y @ y.T) and (known.turned(x[7:8]) == y[7:8]).all()
