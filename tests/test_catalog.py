"""Every registered query of the engine against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest
from keystrand.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return f"{float(v):.9g}"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in "customer part orders lineitem events documents pages conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


def test_filters_reach_the_files(spark):
    def plan(name):
        return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,42)]" in plan("kv_get")
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan("kv_scan_range")
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan("kv_scan_range")
    assert "PythonUDF" not in plan("log_latest_state") and "ArrowEvalPython" not in plan("log_latest_state")


def test_latest_state_sums_in_tasks_before_the_shuffle(spark):
    text = catalog.QUERIES["compact_merge"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in text and text.count("Exchange hashpartitioning") == 1


def test_range_probe_takes_every_customer(spark, db):
    got = {r.start for r in catalog.QUERIES["kv_range_probe"](spark, SF).collect()}
    last = db.sql("SELECT max(o_orderkey) FROM orders").fetchall()[0][0]
    assert got == {c * 10 for (c,) in db.sql("SELECT c_custkey FROM customer").fetchall() if c * 10 <= last} and max(got) > 990


def test_second_buckets_count_every_event(spark, db):
    got = catalog.QUERIES["ts_second_buckets"](spark, SF).collect()
    assert sum(r.n for r in got) == db.sql("SELECT count(*) FROM events").fetchall()[0][0] and max(r.sec for r in got) > 86400


def test_ycsb_e_depends_on_the_last_orders(spark, tmp_path):
    keys = spark.range(5000).select(F.col("id").alias("o_orderkey"))
    spark.range(1000).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    keys.write.parquet(f"{tmp_path}/orders.parquet")
    starts = [i * 2654435761 % 5000 for i in range(1000) if i % 20 != 19]
    want = sum(min(100, 5000 - s) for s in starts)
    got = {r.op: (r.n, r.delivered) for r in catalog.workload_ycsb_e(spark, str(tmp_path)).collect()}
    assert got == {"insert": (50, 0), "scan": (950, want)}
    keys.where("o_orderkey < 2500 or o_orderkey = 4999").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    got = {r.op: r.delivered for r in catalog.workload_ycsb_e(spark, str(tmp_path)).collect()}
    assert got["scan"] == sum(sum(k < 2500 or k == 4999 for k in range(s, s + 100)) for s in starts) < want


def test_cuts_move_with_the_log(spark, tmp_path):
    for n in (100, 10_000):
        rows = spark.range(n).selectExpr("id AS event_id", "id AS user_id", "'signup' AS event_type", "id / 2D AS value")
        rows.write.parquet(f"{tmp_path}/{n}/events.parquet")
        cut = (n - 1) * 7 // 10
        for name, last in (("log_state_as_of", cut), ("log_valid_prefix", cut - 1)):
            assert sorted(r.lsn for r in catalog.QUERIES[name](spark, f"{tmp_path}/{n}").collect()) == list(range(last + 1)), name
