"""Token counts, secrets, languages, toxicity, licences and URLs."""

import hashlib
import math
import random
import re
import string
from collections import Counter
from math import log
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyloom.llm import license_scan, queries, secret_scan, toxicity
from tallyloom.llm.language_id import fit_languages, gram_counts, identify_languages, recognised
from tallyloom.llm.license_scan import TEMPLATES, scan_licenses
from tallyloom.llm.token_count import count_tokens
from tallyloom.llm.toxicity import fit_risk, fit_toxicity, score_toxicity
from tallyloom.llm.url_filter import RULE_SCHEMA, filter_urls

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a\n\n b", "\n", " \n x", "▁a ▁", "<s> a </s> <unk>", "é漢字\r\n\tx", "a" * 5000, "the cat the cat\nthe", "x " * 30_000]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_token_counts(docs_of, limit):
    docs = docs_of(ODD).union(docs_of(ODD[:3]))
    found = count_tokens(docs, MODEL, broadcast_words=limit).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in [*enumerate(ODD), *enumerate(ODD[:3])]]
    assert sorted(map(tuple, found)) == sorted(want)
    assert count_tokens(docs.limit(0), MODEL).count() == 0


def test_secrets(docs_of):
    key = "AKIA" + "Q7" * 8
    texts = [None, "", "password: hunter2 token = 'abcdEFGH12345678'", f"é {key} and {'0123456789abcdef' * 2}", "AKIASHORT " + "f" * 31, 'API_KEY="' + "a1" * 20 + '"', "paſſword=12345678"]
    found = secret_scan.scan_secrets(docs_of(texts)).withColumn("w", secret_scan.written(F.col("spans"))).collect()
    spans = {r.doc_id: r.w for r in found}
    assert spans[0] == spans[1] == spans[4] == spans[6] == ""
    assert spans[2] == "assign:18:43"
    assert spans[3] == f"access:2:{2 + len(key)},hex:{7 + len(key)}:{39 + len(key)}"
    assert spans[5] == "assign:0:49,hex:9:49"
    assert secret_scan.scan_secrets(docs_of(["a"]).limit(0)).count() == 0


def test_learned_formats_add_spans(docs_of):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:40]
    texts = [f'token = "{digest(i)}"' for i in range(60)] + [f"id {digest(99)[:28]} and thisisnotacredential1 ok"]
    found = {r.doc_id: r.spans for r in secret_scan.scan_secrets(docs_of(texts)).collect()}
    assert [(s.kind, s.start, s.stop) for s in found[60]] == [("learned", 3, 31)]


def base_by_force(text):
    """Base spans by trying every place."""
    found, rules = [], ((secret_scan.ASSIGN, 8, 2), (secret_scan.ACCESS, 16, 0), (secret_scan.HEX, 32, 0))
    for kind, (rule, least, group) in zip(secret_scan.KINDS, rules):
        at = 0
        while at < len(text):
            m = rule.match(text, at)
            if m and len(m[group]) >= least:
                found.append((m.start(), kind, m.end()))
            at = m.end() if m else at + 1
    order = lambda x: (x[0], secret_scan.KINDS.index(x[1]))
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(found, key=order))


def test_base_spans_match_brute_force(spark, docs_of, tmp_path):
    rng = random.Random(4)
    bits = ["password", "PASSWD", "api_key", "apikey", "Token", ": ", "=", '"', "'", " = ", "AKIA", "ABCD1234", "Z9" * 6, "0123456789abcdef", "beef" * 9, "é", " ", "\n", "x.y-z_1=", "漢"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(400)] + [None, "", "secret:" + "a" * 200_000]
    docs = docs_of([*texts, *texts[:5]])
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op5_secret_scan(spark, str(tmp_path)).collect()}
    for i, t in enumerate([*texts, *texts[:5]]):
        want = base_by_force(t or "")
        assert found[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [x for x in found[i].spans.split(",") if x and not x.startswith("learned")] == [x for x in want.split(",") if x]
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))


def test_candidates_are_whole_tokens():
    text = "a key1 is ab.cdefgh1. and x9y8z7w6v5 in 12345678 or wordwithoutdigit, eyJh1.bGci.OiJ9 token=abcdefgh1"
    base = secret_scan.base_spans(text)
    assert [t for *_, t in secret_scan.candidate_spans(text, base)] == ["ab.cdefgh1", "x9y8z7w6v5", "eyJh1.bGci.OiJ9"]


def test_learned_formats_find_held_out_credentials(docs_of):
    """Credentials of formats that no rule names, which stood beside a keyword in
    other documents, against tokens that are none."""
    rng = random.Random(5)
    run = lambda signs, n: "".join(rng.choices(signs, k=n))
    alnum, upper, lower = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase
    made = lambda: [f"ghq_{run(alnum, 36)}", f"SK-{run(upper, 8)}-{run(upper, 8)}-{run(upper, 4)}"][rng.randrange(2)]
    texts = [f'token = "{made()}"' for _ in range(500)]
    true = [made() for _ in range(100)]
    false = [f"{run(lower, 9)}{rng.randrange(99)}" for _ in range(60)] + [run(alnum, 40) for _ in range(60)]
    false += [f"v{rng.randrange(9)}.{rng.randrange(99)}.{rng.randrange(99)}-beta", f"{run(lower, 4)}-{run(lower, 5)}-2024-01-31.log", run(alnum + "+/", 900)]
    start = len(texts)
    texts += [f"the value {t} stands here" for t in [*true, *false]]
    found = {r.doc_id: r.spans for r in secret_scan.scan_secrets(docs_of(texts)).where(f"doc_id >= {start}").collect()}
    hit = [any(s.kind == "learned" and texts[start + i][s.start : s.stop] == t for s in found[start + i]) for i, t in enumerate([*true, *false])]
    recall, wrong = sum(hit[:100]) / 100, sum(hit[100:])
    print("recall", recall, "wrong", wrong, "of", len(false))
    assert recall >= 0.95 and wrong <= 2


def test_random_characters_show_the_length_of_their_format():
    """Against a slow version: likelihoods by walking states with plain counts, and
    profiles by listing what follows."""
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:40]
    examples = [digest(i) for i in range(131)]
    learned = secret_scan.Automaton(examples)
    assert len(learned.states) == 41 and sorted(s.ends for s in learned.states.values()) == [0] * 40 + [131]
    counts = Counter()  # of classes and signs by state, in a plain walk
    for text in examples:
        at = 0
        for c in text:
            kind = secret_scan.CLASSES.get(c, c)
            counts[at, "n"] += 1
            counts[at, kind] += 1
            counts[at, kind, c] += 1
            at = learned.states[at].to[kind]
        counts[at, "n"] += 1
        counts[at, ""] += 1
    for text in [digest(500), digest(501)[:39], digest(502) + "0", "zz" + digest(503)[:38], ""]:
        at, want = 0, 0.0
        for c in text:
            kind = secret_scan.CLASSES.get(c, c)
            size = secret_scan.SIZES.get(kind, 1)
            want += log((counts[at, kind] + 0.01) / (counts[at, "n"] + 0.5) * (counts[at, kind, c] + 2) / (counts[at, kind] + 2 * size) * 67)
            at = learned.states[at].to.get(kind) if at is not None and at in learned.states else None
        want += log((counts[at, ""] + 0.01) / (counts[at, "n"] + 0.5) * 67)
        assert abs(learned.likelihood(text) - want) < 1e-9
    a, b = secret_scan.Profile(), secret_scan.Profile()
    for text in ("ab1", "a", "b12"):
        a.add(text)
    for text in ("ab1", "a"):
        b.add(text)
    assert dict(a.seen) == {(0, "h"): 3, (1, "h"): 1, (2, "d"): 2, (3, ""): 2, (1, ""): 1, (1, "d"): 1} and dict(a.reach) == {0: 3, 1: 3, 2: 2, 3: 2}
    assert not a.differs(b, 0.05) and a.fit(b) < 0


def test_formats_are_learned_to_their_ends():
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:24]
    learned = secret_scan.Automaton([digest(i) + "-ZZZZ-ZZZZ" for i in range(400)])
    assert sum(s.ends for s in learned.states.values()) == 400
    assert any("-" in s.seen for s in learned.states.values()) and any("L" in s.seen for s in learned.states.values())
    whole, odd = digest(999) + "-ZZZZ-ZZZZ", digest(999) + "-gggg-gggg"
    assert len(learned.states) > 1 and learned.likelihood(whole) > learned.likelihood(odd) + 16
    fixed = secret_scan.Automaton(["k7Q"] * 50)
    assert fixed.likelihood("k7Q") > fixed.likelihood("k7") + 4 and fixed.likelihood("k7Q") > fixed.likelihood("k7Q" * 20) + 4


WORDS = {"en": "the of and to in that is was he for", "de": "der die und den von zu das mit sich des", "fr": "le de un et être à il avoir ne je"}


def language_docs(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split(), 30)), lang) for i, lang in enumerate(sorted(WORDS) * (n // 3))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(spark):
    docs = language_docs(spark)
    model = fit_languages(docs, F.col("doc_id") % 4 != 2)
    odd = spark.createDataFrame([(900, None, None), (901, "123 !!", "en"), (902, "the and of " * 20_000, "en")], docs.schema)
    found = {r.doc_id: r for r in identify_languages(docs.union(odd), model).collect()}
    assert all(found[r.doc_id].lang_pred == r.lang and not found[r.doc_id].rejected for r in docs.collect())
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[900].rejected and found[900].score == 0
    assert found[902].lang_pred == "en" and 0 <= found[902].score <= 1
    assert docs.union(odd).where(recognised(F.col("text"), model)).count() == 61
    nothing = fit_languages(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in identify_languages(docs, nothing).collect()} == {"und"}


def test_languages_on_odd_tables(spark):
    docs = language_docs(spark).withColumn("score", F.lit("clash")).withColumn("rejected", F.lit(1))
    twice = docs.union(docs).union(docs.select(F.lit(None).cast("long"), F.lit(None).cast("string"), "lang", "score", "rejected").limit(1))
    model = fit_languages(twice, F.lit(True), per_language=20)
    found = identify_languages(twice, model).collect()
    assert len(found) == 121 and sum(r.lang_pred == "und" for r in found) == 1
    assert len({(r.doc_id, r.lang_pred, r.score) for r in found}) == 61
    assert identify_languages(docs.limit(0), model).count() == 0
    alike = docs.where("doc_id = 0").union(docs.where("doc_id = 0").withColumn("lang", F.lit("de")))
    tied = fit_languages(alike, F.lit(True))
    assert {r.lang_pred for r in identify_languages(alike, tied).collect()} == {"de"}  # of equal cosines the first name
    letterless = fit_languages(docs.withColumn("text", F.lit("1 2")), F.lit(True))
    assert letterless.languages == []


def cosine_by_force(model, text):
    """Nearest centroid with plain Python numbers."""
    places, counts = gram_counts(text)
    weights = [(1 + math.log(n)) * model.idf[p] for p, n in zip(places, counts)]
    norm = math.sqrt(sum(w * w for w in weights))
    cosines = [sum(w / norm * model.centroids[p, k] for p, w in zip(places, weights)) for k in range(model.centroids.shape[1])]
    best = max(range(len(cosines)), key=cosines.__getitem__)
    return model.languages[model.owner[best]], cosines[best]


def test_languages_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_languages(docs, F.col("doc_id") % 4 != 2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in identify_languages(docs, model).collect():
        if r.lang_pred != "und":
            name, cosine = cosine_by_force(model, texts[r.doc_id])
            assert name == r.lang_pred and abs(cosine - r.score) < 1e-5


def test_language_left_out_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 200")
    shares = {}
    for lang in sorted(r.lang for r in docs.select("lang").distinct().collect()):
        model = fit_languages(docs, F.col("lang") != lang)
        found = identify_languages(docs.where(F.col("lang") == lang), model)
        shares[lang] = found.agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    print(shares)
    assert min(shares.values()) > 0.5


def test_languages_reject_what_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(docs, F.lit(True))
    rng = np.random.default_rng(3)
    strange = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. " * 4,
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem. " * 4,
        "for (int i = 0; i < n; i++) { if (buf[i] == NULL) return -1; memcpy(dst, src, len); } " * 6,
        "".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz    "], 1500)),
        "".join(rng.choice([*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"], 1500)),
    ]
    assert [model.predict(t)[2] for t in strange] == [True] * 5
    clean = [r.text for r in docs.where("length(text) > 400").limit(200).collect()]
    assert sum(model.predict(t)[2] for t in clean) <= 2
    assert sum(model.predict(t[:n])[2] for t in clean for n in (30, 80)) <= 8


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    clean = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 40))
        toxic = i % 8 == 0
        if toxic:
            words[5] = str(rng.choice(["scum", "moron", "vejuta", "vejumo"]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), lambda i: i % 5 != 0)
    found = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    right = sum(found[i].predicted == int(i % 8 == 0) for i in range(400) if i % 5 == 0)
    assert right >= 76 and found[900].predicted == 0 and found[900].score == found[901].score
    none = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"), lambda i: i >= 0)
    assert {r.predicted for r in score_toxicity(docs, none).collect()} == {0}


def test_toxicity_on_odd_tables(spark):
    rows = [(i, "you scum" if i % 3 == 0 else f"kind words {i % 7}", "clash") for i in range(90)]
    rows += [(1, "kind words " * 50_000, "x"), (1, "kind words " * 50_000, "x"), (None, "you scum", "x"), (91, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string")
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0), (6, None), (None, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    wide, narrow = (fit_toxicity(docs, labels, lambda i: i >= 0, probe_features=n) for n in (1_000_000, 0))
    assert (wide.hashes == narrow.hashes).all() and (wide.weights == narrow.weights).all() and len(wide.hashes)
    found = score_toxicity(docs, wide).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in found if r.doc_id is not None and r.doc_id < 90)
    assert [r.predicted for r in found if r.doc_id is None] == [1] and [r.predicted for r in found if r.doc_id == 91] == [0]
    assert len({r.score for r in found if r.doc_id == 1 and r.score}) <= 2
    assert score_toxicity(docs.limit(0), wide).count() == 0
    for model in (fit_toxicity(docs.limit(0), labels, lambda i: i >= 0), fit_toxicity(docs, labels.where("toxic is null"), lambda i: i >= 0)):
        assert {r.predicted for r in score_toxicity(docs, model).collect()} == {0}


def test_risk_recovers_classes_from_unlabelled_rows():
    rng = np.random.default_rng(2)
    x_p = np.c_[rng.random(200) < 0.9, rng.random(200) < 0.5].astype(np.float32)
    y = rng.random(2000) < 0.3
    x_u = np.c_[np.where(y, rng.random(2000) < 0.9, rng.random(2000) < 0.02), rng.random(2000) < 0.5].astype(np.float32)
    w, b = fit_risk(x_p, x_u, 0.3)
    assert ((x_u @ w + b > 0) == y).mean() > 0.93


def test_licenses(docs_of):
    texts = [None, "", "Released under the MIT License.", "some words\nlicensed under the apache license version 2 0\n\nmore", "Released under the Foo License by us and many others of them", "MIT"]
    found = {(r.doc_id, r.line): (r.license, round(r.dice, 3)) for r in scan_licenses(docs_of(texts)).collect()}
    assert found == {(2, 1): ("MIT", 1.0), (3, 2): ("Apache-2.0", 1.0)}
    assert scan_licenses(docs_of(["a"]).limit(0)).count() == 0


def windows_by_force(text, templates, percent=80):
    """Windows of words by trying all, in the order and with the overlaps of scan_licenses."""
    placed = [(w, k) for k, line in enumerate(text.split("\n"), 1) for w in re.sub("[^a-z0-9]+", " ", line.lower()).split()]
    pairs = [f"{a[0]} {b[0]}" for a, b in zip(placed, placed[1:])]
    found, kept = [], []
    for i, (name, template) in enumerate(templates):
        words = re.sub("[^a-z0-9]+", " ", template.lower()).split()
        known = {f"{a} {b}" for a, b in zip(words, words[1:])}
        for a in range(len(pairs)):
            for b in range(a, min(len(pairs), a + (len(words) - 1) * (200 - percent) // percent)):
                m, shared = len(set(pairs[a : b + 1])), len(set(pairs[a : b + 1]) & known)
                if 200 * shared >= percent * (m + len(known)):
                    found.append((-2 * shared / (m + len(known)), i, a, b, name, shared))
    for x in sorted(found):
        if all(x[2] > k[3] + 1 or k[2] > x[3] + 1 for k in kept):
            kept.append(x)
    return sorted((placed[a][1], name, i, shared, round(-minus, 9)) for minus, i, a, b, name, shared in kept)


def test_licenses_in_windows(docs_of):
    texts = [
        "x y\nUse of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.",
        "Copyright 2020 A. Author. Released under the MIT License. See the project page for more.",
        "# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General\n# Public License version 2.\nmore",
        "we said released under the mit license and then\nalso licensed\nunder cc by\n4.0 and licensed under cc by\nsa 4 0 at the end of it all",
        "one two three four five\nsix seven",
    ]
    want = {(i, *w) for i, t in enumerate(texts) for w in windows_by_force(t, TEMPLATES)}
    found = {(r.doc_id, r.line, r.license, r.template, r.shared, round(r.dice, 9)) for r in scan_licenses(docs_of(texts), texts=[]).collect()}
    assert found == want and {i for i, *_ in want} == {0, 1, 2, 3}
    assert (0, 2, "BSD-3-Clause") in {f[:3] for f in found} and len([f for f in found if f[0] == 3]) == 3
    both = scan_licenses(docs_of(["4.0 licensed under cc by\nsa 4 0 at the end"]), texts=[]).collect()
    assert sorted((r.line, r.license, r.dice) for r in both) == [(1, "CC-BY-4.0", 0.8), (1, "CC-BY-SA-4.0", 1.0)]


def test_crowded_windows_of_licenses(docs_of):
    """Rounds over words give what the walk gives, in one line of very many notices too."""
    rng = random.Random(6)
    some = [t for _, t in TEMPLATES[:3]] + ["Licensed under CC BY 4.0.", "words between", "under the mit license licensed under"]
    texts = [rng.choice(["\n", " "]).join(rng.choices(some, k=12)) for _ in range(6)]
    texts += ["licensed under cc by " * 20, " ".join([TEMPLATES[0][1]] * 30) + " and words that no notice has, one after the other"]
    want = sorted((i, *w) for i, t in enumerate(texts) for w in windows_by_force(t, TEMPLATES))
    docs = docs_of(texts)
    found = [sorted((r.doc_id, r.line, r.license, r.template, r.shared, round(r.dice, 9)) for r in scan_licenses(docs, texts=[], crowded=n).collect()) for n in (0, 3, 2000)]
    assert found[0] == found[1] == found[2]
    one_line = {i for i, t in enumerate(texts) if "\n" not in t}
    assert [f for f in found[0] if f[0] in one_line] == [w for w in want if w[0] in one_line] and len(one_line) > 2


def test_licenses_of_null_and_repeated_ids(spark):
    mit, cc = TEMPLATES[0][1], "Licensed under CC BY 4.0."
    rows = [(None, mit), (None, "x " + cc + " y"), (5, mit), (5, mit), (5, "a " + mit + " b"), (None, mit), (6, mit + "\n" + cc)]
    found = [(r.doc_id, r.line, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), texts=[]).collect()]
    want = [(None, 1, "MIT"), (None, 1, "CC-BY-4.0"), (5, 1, "MIT"), (5, 1, "MIT"), (6, 1, "MIT"), (6, 2, "CC-BY-4.0")]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_full_license_texts(docs_of):
    names = ["MIT", "BSD-3-Clause", "GPL-3.0", "MPL-2.0"]
    texts = [(Path(license_scan.__file__).parent / "licenses" / f"{n}.txt").read_text() for n in names]
    texts.append(" ".join(texts[0].split()))
    found = scan_licenses(docs_of(texts)).groupBy("doc_id").agg(F.mode("license").alias("l"), F.count("*").alias("n")).collect()
    assert {r.doc_id: r.l for r in found} == dict(enumerate([*names, "MIT"]))
    assert {r.doc_id: r.n for r in found}[4] == len(license_scan.passages(texts[0]))


def test_rules_of_the_url_query(spark, tmp_path):
    want = {
        "https://a.com/en/1": ("com/en/", "block"),
        "https://example.com/en/70": ("example.com/en/7", "allow"),
        "https://www.example.com/en/8": ("com/en/", "block"),
        "https://b.net/de/8": ("net/de/", "allow"),
        "https://example.net/de/9": ("net/de/", "allow"),
        "HTTPS://Shop.EXAMPLE.net/de/81?q#t": ("example.net/de/8", "block"),
        "http://c.org/es/": ("org/es/", "block"),
        "http://c.org/es": (None, "allow"),
        "http://c.org/" + "x" * 100_000: (None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate([*want, *want])]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: (r.rule, r.verdict) for r in queries.op9_url_filter(spark, str(tmp_path)).collect()}
    assert found == {i: want[u] for i, u in rows}


def test_rules_of_one_length_are_settled(spark):
    rules = spark.createDataFrame([("allow", "x.org", "/ab"), ("block", "x.org", "/ab"), ("allow", "a.x.org", ""), ("block", "x.org", "/a")], RULE_SCHEMA)
    urls = ["http://a.x.org/ab", "http://a.x.org/a", "http://x.org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, rules).collect()}
    assert found == {0: ("x.org/ab", "block"), 1: ("x.org/a", "block"), 2: ("x.org/a", "block")}


def test_urls(spark):
    rules = spark.createDataFrame([("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "x.org", None)], RULE_SCHEMA)
    urls = [None, "no scheme", "http://", "https://A.Example.COM/en/725?x", "http://example.com/en/8#t", "http://notexample.com/en/7", "http://x.org?q=/en/", "http://yx.org/", "https://a.x.org/en/://com/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rules).collect()}
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("a.example.com", "/en/725", "example.com/en/7", "allow")
    assert found[4] == ("example.com", "/en/8", "com/en/", "block")
    assert found[5] == ("notexample.com", "/en/7", "com/en/", "block")
    assert found[6] == ("x.org", "", "x.org", "block") and found[7][2] is None
    assert found[8] == ("a.x.org", "/en/://com/en/", "x.org", "block")
    assert {r.verdict for r in filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), rules).count() == 0


def test_few_features_are_looked_up_among_many(monkeypatch):
    """Whichever side is longer, the same places; the longer one is never walked."""
    rng, asked = np.random.default_rng(3), []
    of = lambda n: np.unique(rng.integers(0, 4_000, n).astype(np.uint64))
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **more: asked.append((len(a), np.size(v))) or search(a, v, **more))
    for n_found, n_known in ((0, 5), (5, 0), (1, 900), (40, 3000), (3000, 40), (700, 700)):
        found, known = of(n_found), of(n_known)
        places = toxicity.Model(known, np.zeros(len(known)), 0.0).places(found)
        assert places.tolist() == [i for i, h in enumerate(known.tolist()) if h in set(found.tolist())]
    assert asked and all(looked_up <= held for held, looked_up in asked)
