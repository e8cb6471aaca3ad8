"""Bounded samples and broadcast bounds."""

from collections import Counter

from tallyloom.llm.common import TOP_HASH, hash_level, smallest_hashes, within


def test_levels_are_whole_numbers():
    assert hash_level(400, 10**18) > 0 and hash_level(400, 5 * 10**13) < TOP_HASH
    assert hash_level(400, 100) == hash_level(1, 0) == TOP_HASH
    assert abs(hash_level(1, 4) - TOP_HASH / 4) < 2


def test_samples_are_exact(spark):
    rows = [(i, f"text {i}", "big") for i in range(3000)] + [(i, "t", "small") for i in range(7)]
    rows += [(9, "same", "same")] * 2000 + [(None, None, "empty")] * 300 + [(1, "x", None)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string").repartition(5)
    found = [tuple(r) for r in smallest_hashes(docs, 20, "lang", ["id", "text"], "t").collect()]
    assert Counter(r[2] for r in found) == {"big": 20, "small": 7, "same": 20, "empty": 20}
    again = [tuple(r) for r in smallest_hashes(docs.repartition(3), 20, "lang", ["id", "text"], "t").collect()]
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert smallest_hashes(docs.limit(0), 20, "lang", ["id", "text"], "t").count() == 0


def test_within(spark):
    assert within(spark.range(5), 5) and not within(spark.range(6), 5)
