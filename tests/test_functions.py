"""Scalar functions over the tables of accepted and rejected inputs."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.config import ConfigError, Settings, Weights, load_settings, settings_from
from tallyloom.functions import amounts, dates, merchants, references

MONEY = {
    "43.21": ("43.21", None), "43,21": ("43.21", None), "1 234,56": ("1234.56", None), "1,234.56": ("1234.56", None), "1.234,56": ("1234.56", None),
    "€43.21": ("43.21", "EUR"), "€ 43.21": ("43.21", "EUR"), "43.21 EUR": ("43.21", "EUR"), "43.21EUR": ("43.21", "EUR"), "eur 43,21": ("43.21", "EUR"),
    "€43.21 EUR": ("43.21", "EUR"), "£10.50": ("10.50", "GBP"), "1 234 567.89": ("1234567.89", None), "1,234,567": ("1234567", None), "43": ("43", None),
    "43,2100": ("43.21", None), "1 234,56 EUR": ("1234.56", "EUR"),
}
NO_MONEY = {
    "": "invalid amount", "  ": "invalid amount", "abc": "invalid amount", "1,234": "ambiguous amount", "1.234": "ambiguous amount",
    "$43.21": "ambiguous currency", "43.21$": "ambiguous currency", "€43.21 USD": "conflicting currency", "1 23,45": "invalid amount",
    "10.20.30": "invalid amount", "-43.21": "invalid amount", "0.00": "invalid amount", "0": "invalid amount", "43.21 EURO": "invalid amount",
    "1e2": "invalid amount",
}


def column(spark, values, use):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", use(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_amounts(spark):
    for got, (value, code) in zip(column(spark, MONEY, amounts.parse_amount), MONEY.values(), strict=True):
        assert (got.amount, got.currency, got.error) == (Decimal(value), code, None)
    assert [(x.amount, x.error) for x in column(spark, NO_MONEY, amounts.parse_amount)] == [(None, e) for e in NO_MONEY.values()]
    assert column(spark, [None], amounts.parse_amount) == [None]


def test_dates(spark):
    good = {"04.10.2026": (2026, 10, 4), "2026-1-4": (2026, 1, 4), "4/10/2026": (2026, 10, 4), "10/04/2026": (2026, 4, 10), "29.02.2024": (2024, 2, 29), " 2026-10-04 ": (2026, 10, 4)}
    bad = ["", " ", "04-10-2026", "2026/10/04", "02/13/2026", "32.01.2026", "31.04.2026", "29.02.2023", "04.10.26", "2026-10-04T12:00:00", "yesterday", None]
    assert column(spark, good, dates.parse_date) == [date(*d) for d in good.values()]
    assert column(spark, bad, dates.parse_date) == [None] * len(bad)


def test_periods(spark):
    points = {"January 2026": "2026-01", "2026-12": "2026-12", "31.02.2026": "2026-02", "1.13.2026": None, "2026-13": None, "May 1999": None}
    assert column(spark, points, dates.period_point) == list(points.values())
    names = {"invoice_2026-03.pdf": None, "a 2026_04.pdf": "2026-04", "inv_03_2026.pdf": "2026-03", "service-march-2026.pdf": "2026-03", "x.pdf": None, "2026-05-03_2026.pdf": "2026-05"}
    assert column(spark, names, dates.period_in_filename) == list(names.values())


def test_merchants(spark):
    names = {
        "Rimi Latvia SIA": "RIMI LATVIA", " RIMI LATVIA, SIA ": "RIMI LATVIA", "rimi   latvia": "RIMI LATVIA", "Latvenergo AS": "LATVENERGO",
        "Acme L.L.C.": "ACME", "Acme SIA LTD": "ACME", "SIA.": "", "H&M": "H&M", "McDonald's": "MCDONALDS", "THE SIA STORE": "THE SIA STORE",
        "GAS STATION": "GAS STATION", "A,&,B": "A & B", "A & B": "A AND B", "Līgums_x": "LĪGUMS X", None: None,
    }
    assert column(spark, names, merchants.normalize_merchant) == list(names.values())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_similarity_and_signal(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("ABĀ C", k=rng.randint(0, 12))), "".join(rng.choices("ABĀ C", k=rng.randint(0, 12)))) for _ in range(300)]
    assert all(merchants._common_subsequence(a, b) == lcs(a, b) for a, b in pairs)
    rows = spark.createDataFrame(
        [("ALPHA SUPPLIES", "BETA SUPPLIES"), ("AMAZON NV3LD00P4", "AMAZON"), ("CAR", "CARGURU"), ("B A", "A B"), ("", "X"), (None, "X"), ("AAAA", "ZZZZ")],
        "a string, b string",
    )
    a, b = F.col("a"), F.col("b")
    got = [(r[0], r[1]) for r in rows.select(merchants.similarity(a, b), merchants.merchant_signal(a, b, Settings())).collect()]
    assert [x[0] for x in got] == [740741, 545455, 600000, 1_000_000, 0, None, 0]
    assert [x[1] for x in got] == [740741, 950000, 350000, 350000, None, None, 0]


def test_ids_and_tokens(spark):
    row = spark.createDataFrame([(date(2026, 10, 4), Decimal("19.90"), Decimal("19.91"))], "d date, a decimal(28,8), b decimal(28,8)")
    make = lambda a, c="eur": references.transaction_id(F.lit("f"), F.col("d"), F.lit("Outgoing"), a, F.lit(c), F.lit(" X "), F.lit(1), F.lit(4))
    one, same, other = row.select(make(F.col("a")), make(F.col("a"), "EUR"), make(F.col("b"))).first()
    assert one == same != other
    texts = {"Card payment INV-20481": ["PAYMENT", "20481"], "12345678 1234567 ab-cd abcde": ["12345678", "ABCDE"], "": []}
    found = column(spark, texts, lambda c: references.reference_tokens(c, 5))
    assert found == [["PAYMENT"], ["12345678", "ABCDE"], []]


def test_currency_safe_equality(spark):
    rows = spark.createDataFrame([("EUR", "GBP"), ("EUR", None), (None, "EUR"), ("EUR", "EUR")], "a string, b string")
    ten = F.lit("10.00").cast(amounts.MONEY)
    assert [r[0] for r in rows.select(amounts.currency_safe_equal(ten, F.col("a"), ten, F.col("b"))).collect()] == [False, None, None, True]


def test_settings(tmp_path, monkeypatch):
    with pytest.raises(ConfigError):
        Settings(weights=Weights(amount=0.5))
    with pytest.raises(ConfigError):
        Settings(amount_tolerance=0.0)
    with pytest.raises(ConfigError):
        settings_from({"combinations": {"max_documents": 6}})
    with pytest.raises(ConfigError):
        settings_from({"unknown": 1})
    monkeypatch.chdir(tmp_path)
    assert load_settings() == Settings()
    (tmp_path / "tallyloom.yaml").write_text("probable: 0.65\n")
    assert load_settings().probable == 0.65


def test_parts_of_an_amount_are_found_once(spark):
    from tallyloom.functions.amounts import parse_amount

    # Blanks are cut off the text, the rest and the digits: no part is computed again where it is used.
    plan = spark.range(1).select(parse_amount(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"(?U)^\s+|\s+$") == 3
