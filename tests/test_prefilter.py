"""Joins by a bitmap of keys, slim line items, and functions that travel to workers."""

import os
import subprocess
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyloom import domain
from tallyloom.operators import assignment, prefilter, ranking
from tallyloom.scratch import cut

ON = ["scope_id", "id"]
JOINS = {"semi_joined": "left_semi", "inner_joined": "inner", "anti_joined": "left_anti", "left_joined": "left"}


def rows_of(table):
    return sorted(map(repr, table.collect()))


def test_bitmap_joins_give_what_joins_give(spark, monkeypatch):
    key = F.when(F.col("n") % 7 == 0, None).otherwise(F.concat(F.lit("d"), F.col("n") % 900))
    rows = spark.range(3000).select(F.col("id").alias("n")).select((F.col("n") % 5).alias("scope_id"), key.alias("id"), "n")
    other = spark.range(80).select((F.col("id") % 6).alias("scope_id"), F.when(F.col("id") != 3, F.concat(F.lit("d"), (F.col("id") * 3 % 70))).alias("k"), F.col("id").alias("v"))
    other = other.withColumnRenamed("k", "id")
    for most_bits, kind in ((2**28, "long"), (2**10, "long"), (16, "long"), (2**28, "int")):
        monkeypatch.setattr(prefilter.may_meet, "__defaults__", (most_bits,))
        for keys in (other.withColumn("scope_id", F.col("scope_id").cast(kind)), other.where("false")):
            for name, how in JOINS.items():
                right = keys.select(*ON) if how in ("left_semi", "left_anti") else keys
                found = getattr(prefilter, name)(rows, right, ON)
                plain = rows.join(right, ON, how).select(found.columns)
                assert rows_of(found) == rows_of(plain), (most_bits, kind, name)


def test_few_rows_are_left_for_a_join(spark):
    rows = spark.range(100_000).select(F.concat(F.lit("d"), "id").alias("id"))
    keys = spark.range(0, 100_000, 100).select(F.concat(F.lit("d"), "id").alias("id"))
    marked = prefilter.may_meet(rows, keys, ["id"]).where("_may")
    assert marked.join(keys, "id", "left_semi").count() == 1000
    assert 1000 <= marked.count() < 10_000


def test_prices_of_no_whole_cents_keep_the_order(spark, tmp_path):
    """Lines equal in number, part and supplier follow the price as it is, not its cents."""
    day = lambda d, h=0: datetime(2024, 1, d, h)
    items = [(1, 1, 1, 1, 10.004, day(1)), (1, 1, 1, 1, 10.001, day(9)), (1, 1, 1, 1, 10.0, day(5, 7)), (1, 1, 1, 1, 10.0, day(5, 3)), (1, 1, 1, 1, None, day(2)), (2, 2, 1, 1, 3.5, day(4)), (2, 1, 1, 1, 2.25, day(3))]
    tables = {
        "lineitem": (items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp"),
        "orders": ([(1, 1, "F", 20.0), (2, 1, "O", 5.75)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"),
        "part": ([(1, "bolt", "B#1")], "p_partkey long, p_name string, p_brand string"), "customer": ([(1, 2)], "c_custkey long, c_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    made = domain.lines(spark, str(tmp_path))
    columns = ["orderkey", "seq", "price", "shipdate", "name", "scope_id", "nationkey"]
    assert rows_of(made.select(columns)) == rows_of(spark.sql(domain.LINES_SQL).select(columns))
    one = made.where("seq = 1").select("orderkey", "orderstatus", "totalprice", "price2", "price3").orderBy("orderkey").collect()
    assert [(r.orderstatus, r.totalprice) for r in one] == [("F", 20.0), ("O", 5.75)]
    assert [str(x) for r in one for x in (r.price2, r.price3)] == ["10.00", "10.00", "3.50", "None"]


@pytest.mark.parametrize("found", [[[0, 1], [1, 2]]])
def test_sets_are_tried_where_the_package_is_absent(found):
    code = "import pickle, sys, numpy as np; f = pickle.load(sys.stdin.buffer); print(list(f(np.zeros(3, 'i8'), np.array([1, 2, 1]), 0, 3, 2, 0)))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(ranking.sets_within), capture_output=True, cwd="/", env=env, timeout=60)
    assert ran.stdout.decode().strip() == str(found), ran.stderr.decode()


def test_rounds_of_assignment_move_numbers(spark, monkeypatch):
    """Rounds compare and move numbers of ranks, and take what a walk takes."""
    written = {}
    monkeypatch.setattr(assignment, "cut", lambda df, label: written.setdefault(label, df) and cut(df, label))
    rows = spark.range(60).select((F.col("id") % 2).alias("scope_id"), F.lit("PROBABLE").alias("status"), (F.col("id") * 7 % 13).alias("score"),
        F.concat(F.lit("t"), F.col("id") % 20).alias("transaction_id"), F.array(F.concat(F.lit("d"), F.col("id") % 9)).alias("document_ids"))
    offers = cut(assignment.ranked(rows), "offers")
    walked = assignment.greedy_assign(offers, small=1_000)
    assert rows_of(assignment.greedy_assign(offers, small=0)) == rows_of(walked)
    assert [f.dataType.simpleString() for f in written["greedy-met"].schema] == ["bigint"] * 3
