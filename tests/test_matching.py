"""Reconciliation scenarios and properties."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.config import Settings
from tallyloom.operators.assignment import conflicts, greedy_assign
from tallyloom.operators.components import connected_components
from tallyloom.plans import reconcile, reports

DAY = date(2026, 9, 10)
TXN = "scope_id string, id string, posted_date date, direction string, amount decimal(28,8), currency string, description string, merchant_raw string, source_file string"
DOC = "scope_id string, id string, filename string, issued_date date, merchant_raw string, amount decimal(28,8), currency string, invoice_number string, extracted_text string"


def txn(scope, id, amount, merchant, description=None, direction="outgoing", currency="EUR"):
    return (scope, id, DAY, direction, Decimal(amount), currency, description or merchant, merchant, "statement.pdf")


def doc(scope, id, amount, merchant, days=0, currency="EUR", invoice=None, text=None):
    issued = None if days is None else DAY - timedelta(days)
    return (scope, id, f"{id}.pdf", issued, merchant, None if amount is None else Decimal(amount), currency, invoice, text)


SCENES = {
    # scope: transactions, documents, then status and documents of each transaction
    "exact": ([("t", "100.00", "Amazon")], [("d", "100.00", "Amazon")], {"t": ("CONFIRMED", ["d"])}),
    "currency": ([("t", "100.00", "Amazon")], [("d", "100.00", "Amazon", 0, "USD")], {"t": ("MISSING", [])}),
    "gap1": ([("t", "100.00", "Amazon")], [("d", "100.00", "Amazon", 1)], {"t": ("CONFIRMED", ["d"])}),
    "gap3": ([("t", "100.00", "Amazon")], [("d", "100.00", "Amazon", 3)], {"t": ("PROBABLE", ["d"])}),
    "gap7": ([("t", "100.00", "Amazon")], [("d", "100.00", "Amazon", 7)], {"t": ("PROBABLE", ["d"])}),
    "variant": ([("t", "18.40", "BOLT.EU/R/2609200744")], [("d", "18.40", "Bolt")], {"t": ("CONFIRMED", ["d"])}),
    "short": ([("t", "12.00", "CAR")], [("d", "12.00", "CARGURU")], {"t": ("MISSING", [])}),
    "moderate": ([("t", "42.50", "ALPHA SUPPLIES")], [("d", "42.50", "BETA SUPPLIES", 5)], {"t": ("PROBABLE", ["d"])}),
    "undated": ([("t", "100.00", "Amazon")], [("d", "100.00", "Amazon", None)], {"t": ("PROBABLE", ["d"])}),
    "reference": (
        [("t", "42.50", "ALPHA SUPPLIES", "Card payment INV-20481")],
        [("d", "42.50", "BETA SUPPLIES", 5, "EUR", "INV-20481")],
        {"t": ("CONFIRMED", ["d"])},
    ),
    "edge": ([("t", "50.00", "Amazon", "Amazon order 1234ABCD")], [("d", "70.00", "Amazon", 0, "EUR", "1234ABCD")], {"t": ("PROBABLE", ["d"])}),
    "none": ([("t", "77.10", "GROCERY STORE")], [], {"t": ("MISSING", [])}),
    "combination": ([("t", "100.00", "Office Depot")], [("a", "20.00", "Office Depot"), ("b", "30.00", "Office Depot"), ("c", "50.00", "Office Depot")], {"t": ("CONFIRMED", ["c", "b", "a"])}),
    "single_first": ([("t", "100.00", "Office Depot")], [("s", "100.00", "Office Depot"), ("a", "20.00", "Office Depot"), ("b", "80.00", "Office Depot")], {"t": ("CONFIRMED", ["s"])}),
    "mixed": ([("t", "100.00", "Parts Shop")], [("a", "20.00", "Parts Shop"), ("b", "80.00", "Parts Shop", 0, "USD")], {"t": ("MISSING", [])}),
    "reuse": ([("ta", "100.00", "Amazon"), ("tb", "100.00", "Amazon")], [("d", "100.00", "Amazon")], {"ta": ("CONFIRMED", ["d"]), "tb": ("MISSING", [])}),
}


@pytest.fixture(scope="module")
def scenes(spark):
    t = [txn(s, *x) for s, (ts, _, _) in SCENES.items() for x in ts] + [txn("exact", "in", "500.00", "Salary", direction="incoming")]
    d = [doc(s, *x) for s, (_, ds, _) in SCENES.items() for x in ds]
    return spark.createDataFrame(t, TXN), spark.createDataFrame(d, DOC)


@pytest.fixture(scope="module")
def result(scenes):
    return reconcile.match_transactions(*scenes)


def test_scenes(result):
    rows = {(r.scope_id, r.transaction_id): r for r in result.matches.collect()}
    assert len(rows) == sum(len(x[0]) for x in SCENES.values())
    for scope, (_, _, want) in SCENES.items():
        for t, (status, docs) in want.items():
            row = rows[scope, t]
            assert (scope, row.status, [c.document_id for c in row.documents]) == (scope, status, docs)
    assert rows["moderate", "t"].merchant_score == 740741 and rows["moderate", "t"].score == 755185
    assert rows["edge", "t"].score == 600_000
    assert rows["moderate", "t"].reason == "Exact amount and currency; merchant similarity is moderate; document date is 5 days before the transaction. Classified as PROBABLE."
    assert rows["combination", "t"].group_amount_exact and "sum to the transaction amount" in rows["combination", "t"].reason
    assert rows["reuse", "tb"].reason.startswith("Document d is already used by transaction ta.")
    assert rows["none", "t"].reason == reconcile.NO_CANDIDATE
    assert not reconcile.broken_rules(result).count() and not reports.population_gaps(result).count()


def test_pruning_and_rounds_change_nothing(scenes, result):
    other = reconcile.match_transactions(*scenes, pruned=False, small=0)
    assert result.matches.exceptAll(other.matches).count() == other.matches.exceptAll(result.matches).count() == 0


def test_reports(result, tmp_path):
    summary = {r.scope_id: r for r in reports.status_summary(result).collect()}
    assert (summary["exact"].outgoing, summary["exact"].incoming, summary["exact"].confirmed) == (1, 1, 1)
    assert summary["mixed"].unmatched_documents == 2
    totals = {r.scope_id: r for r in reports.currency_totals(result).collect()}
    assert totals["reuse"].total == 200 and totals["reuse"].confirmed == totals["reuse"].missing == 100
    use = {(r.scope_id, r.document_id): r.usage for r in reports.documents_sheet(result).collect()}
    assert use["reuse", "d"] == "USED ONCE" and use["mixed", "a"] == "UNUSED"
    reports.write_html(reports.html_rows(result).where("scope_id = 'exact'"), tmp_path / "report.html")
    page = (tmp_path / "report.html").read_text()
    assert 'href="d.pdf"' in page and "IDENTIFIED" in page and "UNKNOWN" in page


def test_summary_rows_and_workbook(spark, result, tmp_path):
    rows = [(r.metric, r.value) for r in reports.summary_sheet(result).where("scope_id = 'reuse'").orderBy("place").collect()]
    of = dict(rows)
    assert rows[0][0] == "Reporting period" and [m for m, _ in rows[-3:]] == list(reports.STATUSES)
    assert (of["Outgoing transactions"], of["Matched documents"], of["Outgoing amount (EUR)"], of["Missing amount (EUR)"]) == ("2", "1", "200.00", "100.00")
    assert of["Coverage by count"] == of["Coverage by amount (EUR)"] == "0.5000" and "Unclassified transactions" not in of
    alone = {r.metric: r.value for r in reports.summary_sheet(result, supplied=False).where("scope_id = 'exact'").collect()}
    assert alone["Incoming transactions"] is None and alone["Total transactions"] == "1"
    folder = str(tmp_path / "book")
    for _ in range(2):
        reports.write_workbook(result, folder)
    assert spark.read.parquet(f"{folder}/summary").count() == reports.summary_sheet(result).count()
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["book"]


def test_supplied_lists(result):
    given = result.transactions
    gaps = lambda rows: {(r.scope_id, r.gap) for r in reports.supplied_gaps(result, rows).collect()}
    assert gaps(given) == set() and reports.count_gaps(result).count() == 0
    assert gaps(given.where("scope_id <> 'exact'")) == {("exact", "extra in result")}
    other = given.withColumn("description", F.when(F.col("scope_id") == "reuse", "other").otherwise(F.col("description")))
    assert gaps(other) == {("reuse", "differs from result")}
    more = given.unionByName(given.where("scope_id = 'exact' and direction = 'outgoing'").withColumn("id", F.lit("new")))
    assert gaps(more) == {("exact", "missing from result")}
    assert gaps(given.unionByName(given.where("scope_id = 'exact'"))) == {("exact", "listed twice")}


def test_duplicate_ids_are_refused(scenes):
    t, d = scenes
    with pytest.raises(reconcile.MatchError):
        reconcile.match_transactions(t, d.union(d))


def test_unicode_and_settings(spark):
    t = spark.createDataFrame([txn("s", "t", "10.00", "LĪGUMS SIA")], TXN)
    d = spark.createDataFrame([doc("s", "d", "10.01", "Līgums")], DOC)
    assert reconcile.match_transactions(t, d).matches.first().status == "MISSING"
    near = reconcile.match_transactions(t, d, Settings(amount_tolerance="0.01"))
    assert near.matches.first().status == "CONFIRMED"


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    offers, taken, owner, blocked = [], set(), {}, {}
    for scope in ("x", "y"):
        used, done = {}, set()
        for rank in range(120):
            t = f"t{rng.randrange(25)}"
            docs = [f"d{k}" for k in rng.sample(range(30), rng.randint(1, 3))]
            offers.append((scope, rank, t, docs))
            if t in done:
                continue
            hit = next((d for d in docs if d in used), None)
            if hit is None:
                done.add(t)
                taken.add((scope, rank))
                used |= dict.fromkeys(docs, t)
            else:
                blocked.setdefault((scope, t), (hit, used[hit]))
        owner |= {(scope, t): None for t in done}
    rows = spark.createDataFrame(offers, "scope_id string, rank int, transaction_id string, document_ids array<string>")
    for small in (0, 10_000):
        found = greedy_assign(rows, small=small)
        assert {tuple(r) for r in found.collect()} == taken
    chosen = rows.join(spark.createDataFrame(sorted(taken), "scope_id string, rank int"), ["scope_id", "rank"])
    got = {(r.scope_id, r.transaction_id): (r.document_id, r.owner) for r in conflicts(rows, chosen).collect()}
    assert got == {k: v for k, v in blocked.items() if k not in owner}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (50, 60), (None, 3), (200, 200)] + [(1000, k) for k in range(1001, 1100)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and found[102] == 100 and found[60] == 50 and found[1050] == 1000 and 200 not in found
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
