"""Hashes over bytes against plain loops, and the work they take for each byte."""

import re
import time

import pytest
from keystrand.functions import codec
from keystrand.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TEXTS = [b"", b"a", bytes(range(256)), bytes(range(255, -1, -1)) * 3, b"\x00" * 9, b"\xff" * 40, "Größe, 漢字 🙂".encode(), b"Customer#000000001", None]
STARTS = [0, 1, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64 - 1]


def fnv(data, h=codec.FNV_BASIS):
    for b in data:
        h = (h ^ b) * codec.FNV_PRIME % 2**64
    return h


def roll(data):
    h = 0
    for b in data:
        h = (h * 131 + b) % 2**64
    return h


def lambdas(df):
    """The bodies of lambda functions in a plan: what runs for each element."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for m in re.finditer(r"lambdafunction\(", plan):
        depth = 1
        for at in range(m.end(), len(plan)):
            depth += {"(": 1, ")": -1}.get(plan[at], 0)
            if not depth:
                break
        yield plan[m.end() : at]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t binary").cache()


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", old)


def test_chained_hashes_equal_a_plain_loop(spark, ansi, texts):
    starts = spark.createDataFrame([(str(s),) for s in STARTS], "s string").select(F.col("s").cast("decimal(20,0)").alias("s"))
    got = texts.crossJoin(starts).select("i", "s", codec.fnv1a64(F.col("t"), F.col("s")).alias("h"), codec.fnv1a64(F.col("t"), codec.fnv1a64(F.col("t"))).alias("twice"))
    assert dict(got.dtypes)["h"] == "decimal(20,0)"
    rows = got.collect()
    assert len(rows) == len(TEXTS) * len(STARTS)
    for r in rows:
        t = TEXTS[r.i]
        assert (r.h, r.twice) == ((None, None) if t is None else (fnv(t, int(r.s)), fnv(t + t)))


def test_clean_and_rolling_hashes_equal_a_plain_loop(spark, ansi, texts):
    rows = texts.select("i", codec.fnv1a64(F.col("t")).alias("h"), codec.clean_hash(F.col("t")).alias("clean"), codec.rolling(F.col("t")).alias("r"))
    assert [t for _, t in rows.dtypes] == ["int", "decimal(20,0)", "bigint", "decimal(20,0)"]
    for r in rows.collect():
        t = TEXTS[r.i]
        assert (r.h, r.clean, r.r) == ((None,) * 3 if t is None else (fnv(t), fnv(t) % 2**60, roll(t)))


@pytest.mark.parametrize("name", ["codec_fnv_chained", "codec_fnv1a64", "codec_rolling_checksum", "kv_get_prefix_hash"])
def test_a_byte_costs_no_decimal_and_no_copy_of_its_text(spark, name):
    bodies = list(lambdas(catalog.QUERIES[name](spark, SF)))
    assert bodies and not [b for b in bodies if re.search(r"decimal|hex\(|encode\(|c_name|url|octet_length", b)]


def test_long_texts_cost_as_much_as_short_ones(spark, tmp_path):
    """The same number of bytes in 4,000 texts and in four."""

    def seconds(n, length):
        path = f"{tmp_path}/{n}"
        spark.range(n).select(F.col("id"), F.repeat(F.lit("k"), length).alias("t")).coalesce(1).write.parquet(path)
        begin = time.time()
        found = {int(r.h) for r in spark.read.parquet(path).select(codec.fnv1a64(codec.text(F.col("t"))).alias("h")).collect()}
        assert found == {fnv(b"k" * length)}
        return time.time() - begin

    short = seconds(4_000, 20)
    assert seconds(4, 20_000) < 5 * max(short, 1)
