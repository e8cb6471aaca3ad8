import hashlib
import re

import pytest

from tallyloom.llm.exact_dedup import exact_dedup


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_matches_brute_force(docs_of, limit):
    texts = ["Same TEXT", "same text", "same texu", "ÉCOLE", "éCOLE", "École", None, "", "x" * 200_000, "X" * 200_000, "a", "b", "A"] + ["hot copy"] * 40
    docs = docs_of(texts)
    found = exact_dedup(docs, digest_all=True, broadcast_rows=limit).collect()
    want = brute(list(enumerate(texts)))
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == want
    assert len(found) == len(texts)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_digests_only_survivors(docs_of, limit):
    docs = docs_of(["abc", "abd", "ABC", "longer", "x" * 200 + "a", "x" * 200 + "b"])
    found = {r.doc_id: r.text_sha256 for r in exact_dedup(docs, broadcast_rows=limit).collect()}
    assert found[3] is None and found[0] == found[2] == hashlib.sha256(b"abc").hexdigest() and found[1] is None
    assert found[4] and found[5] and found[4] != found[5]


def test_empty_table_and_repeated_rows(docs_of):
    assert exact_dedup(docs_of(["a"]).limit(0)).count() == 0
    twice = docs_of(["a"]).union(docs_of(["a"]))
    assert [(r.group_size, r.kept) for r in exact_dedup(twice).collect()] == [(2, True), (2, True)]


def test_null_ids(spark):
    rows = [(None, "a"), (3, "A"), (None, "b"), (None, "b"), (None, None), (5, "")]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in found) == [
        (0, 0, 2, True), (0, 0, 2, True), (0, 3, 2, False), (0, 5, 2, False), (3, 3, 2, True), (5, 5, 2, True)
    ]
