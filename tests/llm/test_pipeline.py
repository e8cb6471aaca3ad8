"""The pipeline's stages against plain Python, one by one and as a whole."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tallyloom.llm.language_id import fit_languages, identify_languages

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def exact_by_force(rows):
    last = {}
    for i, t in rows.items():
        last[lower(t)] = max(i, last.get(lower(t), i))
    return {i: t for i, t in rows.items() if last[lower(t)] == i}


def near_by_force(rows, percent=80):
    sets, up = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: t for i, t in rows.items() if top(i) == i}


def clean_by_force(rows, items, percent=80):
    wanted = [s for s in map(shingles, items) if s]
    return {i: t for i, t in rows.items() if not any(100 * len(s & shingles(t)) >= percent * len(s) for s in wanted)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted exact and near copies, benchmark passages and junk."""
    path, rng = str(tmp_path_factory.mktemp("corpus")), random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.where("length(text) > 300").orderBy("doc_id").limit(120).collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(5).collect()]
    add = lambda text: rows.append((10_000 + len(rows), text, "en", "planted", len(text or "")))
    for _, text, *_ in rows[:20]:
        add(text.upper() if text.isascii() else text)
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        add(" ".join(words))
    for k, item in enumerate(items):
        add(rows[30 + k][1][:2000] + " " + item.upper() + " and so on " + rows[40 + k][1][:1000])
    for junk in ("", None, "12345 !!", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=900))):
        add(junk)
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs.columns, items


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_match_brute_force(spark, folder):
    path, columns, items = folder
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = fit_languages(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    gone = {r.doc_id for r in identify_languages(docs, model).where("rejected").collect()}
    force = [
        lambda rows: {i: t for i, t in rows.items() if i not in gone}, exact_by_force, near_by_force, lambda rows: clean_by_force(rows, items)
    ]
    rows, dropped = texts(docs), []
    for (name, stage), by_force in zip(pipeline.STAGES, force):
        found = stage(spark, spark.createDataFrame(docs.where(F.col("doc_id").isin(list(rows))).collect(), docs.schema), path)
        want = by_force(rows)
        assert found.columns == columns and texts(found) == want, name
        dropped.append(len(rows) - len(want))
        rows = want
    assert min(dropped) >= 4
    packed = pipeline.run(spark, path).toPandas()
    assert set(packed.doc_id) == set(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in rows.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        own = packed[packed.doc_id == i].sort_values("piece")
        assert own.length.tolist() == [len(ids[s : s + 4096]) for s in range(0, len(ids), 4096)]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()) for s in range(0, len(ids), 4096)]
    for _, group in packed.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group.length.cumsum() - group.length == group.offset).all() and group.length.sum() <= 4096


def test_empty_table_null_and_repeated_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you".split()
    rng = random.Random(7)
    text = lambda: " ".join(rng.choices(words, k=60))
    rows = [(i, text(), "en", "s", 1) for i in range(40)]
    rows += [(None, text(), "en", "s", 1), (None, text(), "en", "s", 1), (3, rows[3][1], "en", "s", 1), (50, None, None, None, None), (5, "", "en", "s", 0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "a b c"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()]
    # Rows that repeat an id and a text stay together; rows with a null id stay; texts without a letter go.
    assert sorted(i for i in found if i is not None) == sorted([*range(40), 3]) and found.count(None) == 2
    # One id with different texts: what is equal, near or contaminated goes, the rest of that id stays.
    other, item = text(), text()
    more = [*rows, (3, other, "en", "s", 1), (60, other, "en", "s", 1), (4, text() + " " + item, "en", "s", 1), (61, rows[8][1] + " more", "en", "s", 1), (61, text(), "en", "s", 1)]
    spark.createDataFrame(more, schema).write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/more/benchmark.parquet")
    found = [r.doc_id for r in pipeline.run(spark, f"{tmp_path}/more").collect()]
    # 3 keeps its own text but not the one of 60; of 4 the contaminated text goes; 61 is one document, near to 8.
    assert sorted(i for i in found if i is not None) == sorted([*range(40), 3, 60]) and found.count(None) == 2
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert pipeline.run(spark, str(empty)).count() == 0
