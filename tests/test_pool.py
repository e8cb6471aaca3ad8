"""Pools by walking ranked names, sets that sum up, running numbers, long chains."""

import random
from datetime import date, timedelta
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyloom.config import MICRO, Combinations, Settings
from tallyloom.functions.merchants import merchant_signal, plain_signal
from tallyloom.operators import combining, ranking, scoring
from tallyloom.operators.assignment import greedy_assign
from tallyloom.operators.combining import combination_sets
from tallyloom.operators.numbering import with_running
from tallyloom.operators.ranking import best_documents, names_compared
from tallyloom.plans import reconcile
from tallyloom.scratch import cut

SETTINGS = Settings()
T = "scope_id string, transaction_id string, posted_date date, amount decimal(28,8), currency string, m1 string"
D = "d_scope string, document_id string, issued_date date, d_amount decimal(28,8), d_currency string, d_m1 string"
WORDS = ["ALPHA", "BETA", "GAMMA", "ALPHABET", "CAR", "CARGURU", "A", "LĪGUMS", "NORTH", "NOR", "SUPPLIES", "H&M", "WIND"]


def names(rng, n):
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n)]


def tables(seed, scopes, per_scope):
    rng, t, d = random.Random(seed), [], []
    day = lambda: date(2024, 1, 1) + timedelta(rng.randint(0, 60))
    money = lambda: Decimal(rng.choice(["5", "10", "20.5", "999999999999999999.12345678", "40", "0.01"])) + rng.randint(0, 3)
    for s in range(scopes):
        known = [*names(rng, 25), None, ""]
        for i in range(per_scope):
            t.append((f"s{s}", f"t{s}-{i}", day(), money(), rng.choice(["EUR", "USD"]), rng.choice(known)))
            d.append((f"s{s}", f"d{s}-{rng.randint(0, 10**6)}-{i}", rng.choice([None, day(), day()]), rng.choice([None, *[money() for _ in range(9)]]), rng.choice(["EUR", "EUR", "USD", None]), rng.choice(known)))
    return t, d


def by_force(t, d, wanted, tolerance=Decimal(0)):
    found = set()
    for scope, tid, posted, amount, currency, name in t:
        offers = []
        for d_scope, did, issued, d_amount, d_currency, d_name in d:
            if d_scope == scope and d_currency == currency and d_amount is not None and d_amount < amount - tolerance:
                signal = plain_signal(name, d_name, SETTINGS) if name and d_name else None
                gap = 10**9 if issued is None else abs((posted - issued).days)
                offers.append((MICRO if signal is None else -signal, gap, -d_amount, did, signal))
        found |= {(scope, tid, x[3], x[4], k) for k, x in enumerate(sorted(offers, key=lambda x: x[:4])[:wanted], 1)}
    return found


def test_plain_signals_equal_the_expression(spark):
    rng = random.Random(3)
    pairs = list(zip(names(rng, 400), names(rng, 400), strict=True))
    frame = spark.createDataFrame(pairs, "a string, b string").withColumn("s", merchant_signal(F.col("a"), F.col("b"), SETTINGS))
    assert all(r.s == plain_signal(r.a, r.b, SETTINGS) for r in frame.collect())


@pytest.mark.parametrize(("block", "few", "tolerance"), [(20_000, 64, "0.00"), (20_000, 1, "0.00"), (30, 2, "1.00")])
def test_walks_find_the_best_documents(spark, monkeypatch, block, few, tolerance):
    """One block or many, ranked at once or by bounds, the pool is the same."""
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(ranking, "FEW", few)
    t, d = tables(block + few, 3, 90)
    settings = Settings(amount_tolerance=tolerance)
    found = best_documents(spark.createDataFrame(t, T), spark.createDataFrame(d, D), settings, 7)
    assert {tuple(r) for r in found.collect()} == by_force(t, d, 7, Decimal(tolerance))
    assert best_documents(spark.createDataFrame([], T), spark.createDataFrame(d, D), settings, 7).count() == 0


def test_few_pairs_of_names_are_compared(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=rng.randint(4, 9)))
    known = [f"{word()} {word()}" for _ in range(600)]
    t = [("s", f"t{i}", date(2024, 1, 2), Decimal(100), "EUR", known[i]) for i in range(300)]
    d = [("s", f"d{i}", date(2024, 1, 1), Decimal(5), "EUR", known[i % 600]) for i in range(6000)]
    settings = Settings(combinations=Combinations(pool_limit=10))
    r = names_compared(spark.createDataFrame(t, T), spark.createDataFrame(d, D), settings, 10).first()
    assert r.pairs == 300 * 600 and r.compared < 0.05 * r.pairs


@pytest.mark.parametrize(("most", "tolerance"), [(2, "0.00"), (3, "0.00"), (4, "0.02"), (5, "0.00"), (5, "0.01")])
def test_sets_that_sum_up(spark, most, tolerance):
    rng, rows = random.Random(most), []
    for k in range(4):
        target = Decimal(rng.randint(300, 400)) / 100
        rows += [("s", f"t{k}", target, Decimal(rng.randint(20, 390)) / 100, place) for place in range(1, 41 if k == 0 else 13)]
    settings = Settings(amount_tolerance=tolerance, combinations=Combinations(max_documents=most, pool_limit=40))
    pool = spark.createDataFrame(rows, "scope_id string, transaction_id string, amount decimal(28,8), d_amount decimal(28,8), place int")
    found = [(r.transaction_id, tuple(r.places)) for r in combination_sets(pool, settings).collect()]
    want = set()
    for k in range(4):
        own = [r for r in rows if r[1] == f"t{k}"]
        for n in range(2, most + 1):
            want |= {(f"t{k}", tuple(r[4] for r in c)) for c in combinations(own, n) if abs(sum(r[3] for r in c) - own[0][2]) <= Decimal(tolerance)}
    assert len(found) == len(want) and set(found) == want and want


@pytest.mark.parametrize("group_rows", [10**6, 25, 1])
def test_running_sums(spark, group_rows):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None, f"g{i}"]), rng.random(), rng.randint(0, 3), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "g string, o double, v int, i long").repartition(3)
    found = {r.i: (r.n, r.s) for r in with_running(frame, ["g"], ["o"], {"n": F.lit(1), "s": F.col("v")}, group_rows).collect()}
    for g, o, _, i in rows:
        before = [v for h, p, v, _ in rows if h == g and p <= o]
        assert found[i] == (len(before), sum(before))
    assert with_running(frame.limit(0), ["g"], ["o"], {"n": F.lit(1)}, group_rows).count() == 0


def test_a_chain_of_proposals(spark):
    """Each proposal blocks the next: rounds would take one a time."""
    n = 20_000
    made = spark.range(n).select(
        F.lit("s").alias("scope_id"), F.col("id").alias("rank"), F.format_string("t%d", F.floor(F.col("id") / 2)).alias("transaction_id"),
        F.array(F.format_string("d%d", F.floor((F.col("id") + 1) / 2))).alias("document_ids"),
    )
    other = made.where("rank < 50").withColumn("scope_id", F.lit("x"))
    found = greedy_assign(made.unionByName(other), small=100).collect()
    assert {r.rank for r in found if r.scope_id == "s"} == set(range(0, n, 2)) and {r.rank for r in found if r.scope_id == "x"} == set(range(0, 50, 2))


def test_pools_try_their_sets_at_once(spark, monkeypatch):
    """The walk's sets are those of the written pool, in scopes of one block and of several."""
    rng = random.Random(5)
    day = date(2026, 1, 1)
    t = [(s, f"t{i}", day, "outgoing", Decimal(rng.randrange(20, 60)), "EUR", "Shop", "Shop", "f") for s in (1, 2) for i in range(8)]
    d = [(s, f"d{i}", f"d{i}.pdf", day, f"Shop {i % 3}", Decimal(rng.randrange(1, 30)), "EUR", None, None) for s, n in ((1, 9), (2, 40)) for i in range(n)]
    texts = "merchant_raw string, amount decimal(28,8), currency string, invoice_number string, extracted_text string"
    documents = spark.createDataFrame(d, f"scope_id long, id string, filename string, issued_date date, {texts}")
    transactions = spark.createDataFrame(t, "scope_id long, id string, posted_date date, direction string, amount decimal(28,8), currency string, description string, merchant_raw string, source_file string")
    monkeypatch.setattr(ranking, "BLOCK", 12)
    for settings in (Settings(), Settings(amount_tolerance="1.00", combinations=Combinations(max_documents=5))):
        pool = {(r.scope_id, r.transaction_id, r.place): r.document_id for r in combining.combination_pool(transactions, documents, settings).collect()}
        want = sorted((r.scope_id, r.transaction_id, tuple(r.places)) for r in combination_sets(combining.combination_pool(transactions, documents, settings), settings).collect())
        for tried in (5_000, 1):
            monkeypatch.setattr(combining, "TRIED", tried)
            found = combining.summing_sets(transactions, documents, settings).collect()
            assert want and sorted((r.scope_id, r.transaction_id, tuple(r.places)) for r in found) == want
            assert all(r.document_ids == [pool[r.scope_id, r.transaction_id, p] for p in r.places] for r in found)


def test_matching_moves_texts_of_candidates_only(spark, monkeypatch):
    """No table that matching writes holds the texts of documents without a candidate."""
    day = date(2026, 1, 1)
    t = [(1, "t", day, "outgoing", Decimal(30), "EUR", "Shop", "Shop", "f")]
    d = [(1, f"d{i}", f"d{i}.pdf", date(2025, 1, 1 + i), "Other", Decimal(100 + i), "EUR", None, "text") for i in range(20)]
    d += [(1, "a", "a.pdf", day, "Shop", Decimal(10), "EUR", None, "text"), (1, "b", "b.pdf", day, "Shop", Decimal(20), "EUR", None, "text")]
    texts = "merchant_raw string, amount decimal(28,8), currency string, invoice_number string, extracted_text string"
    written = []
    for module in (combining, scoring, reconcile, ranking):
        monkeypatch.setattr(module, "cut", lambda df, label: written.append(cut(df, label)) or written[-1])
    transactions = spark.createDataFrame(t, "scope_id long, id string, posted_date date, direction string, amount decimal(28,8), currency string, description string, merchant_raw string, source_file string")
    result = reconcile.match_transactions(transactions, spark.createDataFrame(d, f"scope_id long, id string, filename string, issued_date date, {texts}"))
    assert [c.document_id for c in result.matches.first().documents] == ["b", "a"]
    assert max(w.count() for w in written if "extracted_text" in w.columns) <= 4
