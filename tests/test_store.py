"""The store's contract: conditional writes, scans, recovery, compaction, clones."""

import random

import pytest
from keystrand.functions import codec
from keystrand.operators import changes, compaction
from keystrand.operators.compaction import CompactionPolicy
from keystrand.plans.config import EngineConfig
from keystrand.sources.rivals import DuckStore
from keystrand.sources.store import KeyedStore, StoreError
from pyspark.sql import functions as F

REQUESTS = "seq long, op string, key binary, value binary"


def rows(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def ask(spark, *requests):
    return spark.createDataFrame([(i, op, bytearray(k), None if v is None else bytearray(v)) for i, (op, k, v) in enumerate(requests)], REQUESTS)


def outcome(store, df):
    return [r.accepted for r in store.apply(df).orderBy("seq").collect()]


def test_conditional_writes_scans_and_restart(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s")
    got = outcome(
        store,
        ask(
            spark,
            ("insert", b"a", b"1"), ("insert", b"a", b"2"), ("update", b"a", b"3"), ("update", b"x", b"4"), ("delete", b"x", None),
            ("insert", b"b", b"\xff" * 8), ("insert", b"b", b""), ("insert", b"c", b"5"), ("delete", b"c", None), ("insert", b"c", b"6"), ("insert", b"a\x00", b"zero"),
        ),
    )
    assert got == [True, False, True, False, False, False, True, True, True, True, True]
    assert store.get(b"a") == b"3" and store.get(b"b") == b"" and store.get(b"nope") is None
    assert rows(store.scan(b"a", b"b")) == [(b"a", b"3"), (b"a\x00", b"zero"), (b"b", b"")]
    assert rows(store.scan(b"b", b"a")) == []
    again = KeyedStore(spark, f"file://{tmp_path}/s")
    assert rows(again.scan(b"a", b"z")) == rows(store.scan(b"a", b"z"))
    again.checkpoint()
    again.verify()
    assert again.log_bytes() == 0 and again.get(b"c") == b"6"
    assert outcome(again, ask(spark, ("insert", b"c", b"7"), ("delete", b"c", None))) == [False, True]
    assert KeyedStore(spark, f"file://{tmp_path}/s").get(b"c") is None


def test_same_outcomes_as_the_rival(spark, tmp_path):
    rng = random.Random(7)
    steps = [(op := rng.choice(["insert", "update", "delete"]), b"k%d" % rng.randrange(12), None if op == "delete" else rng.choice([b"v%d" % i, b"\xff" * 8, b""])) for i in range(150)]
    store, rival = KeyedStore(spark, f"file://{tmp_path}/s"), DuckStore()
    for part in (steps[:60], steps[60:100], steps[100:]):
        df = ask(spark, *part)
        assert outcome(store, df) == [ok for _, ok in rival.apply(df)]
        store.reorganize()
    assert rows(store.scan(b"", b"z")) == rival.scan(b"", b"z")


def test_crash_before_and_after_the_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = KeyedStore(spark, path)
    store.apply(ask(spark, ("insert", b"a", b"1"), ("insert", b"b", b"2"), ("delete", b"a", None)))

    def crash():
        raise RuntimeError("power cut")

    for hook in ("before_manifest", "before_rotate"):
        broken = KeyedStore(spark, path)
        broken.hooks[hook] = crash
        with pytest.raises(RuntimeError):
            broken.checkpoint()
        assert rows(KeyedStore(spark, path).scan(b"a", b"z")) == [(b"b", b"2")]
    KeyedStore(spark, path).checkpoint()
    assert rows(KeyedStore(spark, path).scan(b"a", b"z")) == [(b"b", b"2")]


def test_damage_is_loud(spark, tmp_path):
    path = tmp_path / "s"
    store = KeyedStore(spark, f"file://{path}")
    store.bulk_load(spark.range(10).select(codec.int_key(F.col("id")).alias("key"), codec.int_value(F.col("id")).alias("value")))
    assert store.state().count() == 10
    first, manifest = sorted((path / "manifest").glob("*.json"))
    good = manifest.read_text()
    manifest.write_text(good.replace('"rows": 10', '"rows": 11'))
    for crc in path.glob("manifest/.*.crc"):
        crc.unlink()
    with pytest.raises(StoreError):
        KeyedStore(spark, f"file://{path}")
    manifest.unlink()
    first.unlink()
    with pytest.raises(StoreError):
        KeyedStore(spark, f"file://{path}")


def test_damaged_record_cuts_the_log(spark):
    log = changes.with_checksum(spark.createDataFrame([(i, "insert", bytearray(b"k%d" % i), bytearray(b"v")) for i in range(1, 7)], "lsn long, op string, key binary, value binary"))
    broken = log.withColumn("value", F.when(F.col("lsn") == 4, F.lit(b"w")).otherwise(F.col("value")))
    assert [r.lsn for r in changes.valid_prefix(broken, ~changes.is_valid()).orderBy("lsn").collect()] == [1, 2, 3]
    assert changes.valid_prefix(log, ~changes.is_valid()).count() == 6


def test_tombstone_beats_an_older_base(spark):
    kind = "key long, value long, is_delete boolean, lsn long"
    base = spark.createDataFrame([(1, 10, False, 1), (2, 20, False, 2)], kind)
    delta = spark.createDataFrame([(1, None, True, 5), (2, 21, False, 6), (2, 22, False, 7), (3, 30, False, 4)], kind)
    assert sorted(map(tuple, compaction.merge(base, delta).collect())) == [(2, 22, 7), (3, 30, 4)]


def test_clone_shares_files_and_goes_its_own_way(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s")
    store.bulk_load(spark.range(5).select(codec.int_key(F.col("id")).alias("key"), codec.int_value(F.col("id")).alias("value")))
    twin = store.clone(f"file://{tmp_path}/t")
    assert twin.manifest["base"] == store.manifest["base"]
    assert twin.remove(b"\x80" + b"\0" * 7) and twin.state().count() == 4 and store.state().count() == 5


def test_policy_and_maintenance(spark, tmp_path):
    p = CompactionPolicy(capacity=100)
    assert [p.decide(10), p.decide(50), p.decide(96), p.decide(10, deleted=5), p.decide(1, log_bytes=1 << 27)] == [None, "soft", "hard", "deletes", "log"]
    store = KeyedStore(spark, f"file://{tmp_path}/s", EngineConfig(policy=CompactionPolicy(capacity=4)))
    store.apply(ask(spark, *[("insert", b"%d" % i, b"v") for i in range(3)]))
    assert store.maintain() == "soft" and store.statistics()["checkpoints"] == 1 and store.maintain() is None


@pytest.mark.parametrize("bits,signed,numbers", [(64, True, [-(2**63), -1, 0, 1, 256, 2**63 - 1]), (32, True, [-(2**31), -1, 0, 2**31 - 1]), (32, False, [0, 1, 2, 10, 256, 2**32 - 1]), (8, True, [-128, -1, 0, 127])])
def test_integer_keys_keep_order_and_width(spark, bits, signed, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codec.int_key(F.col("n"), bits, signed).alias("k"))
    got = df.orderBy("k").collect()
    assert [r.n for r in got] == numbers and {len(r.k) for r in got} == {bits // 8}
    assert [r[0] for r in df.select(codec.decode_int_key(F.col("k"), bits, signed)).collect()] == numbers


def test_a_registered_codec_goes_both_ways(spark):
    codec.Codec("point", lambda x, y: codec.composite_key(codec.int_key(x, 32), codec.int_key(y, 32)), lambda k: F.struct(codec.decode_int_key(F.substring(k, 1, 4), 32).alias("x"), codec.decode_int_key(F.substring(k, 5, 4), 32).alias("y")))
    point = codec.Codec.registry["point"]
    points = [(-3, 7), (-3, -8), (0, 0), (5, -(2**31))]
    df = spark.createDataFrame(points, "x int, y int").withColumn("k", point.encode(F.col("x"), F.col("y")))
    assert [(r.x, r.y) for r in df.orderBy("k").collect()] == sorted(points)
    assert {tuple(r.p) for r in df.select(point.decode(F.col("k")).alias("p")).collect()} == set(points)


def test_hashes_and_layouts(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert int(one(codec.fnv1a64(F.lit(b"hello")))) == 0xA430D84680AABD0B and int(one(codec.fnv1a64(F.lit(b"")))) == codec.FNV_BASIS
    assert int(one(codec.fnv1a64(F.lit(b"lo"), codec.fnv1a64(F.lit(b"hel"))))) == 0xA430D84680AABD0B
    assert one(codec.decode_int_value(codec.int_value(F.lit(-2)))) == -2
    assert [one(codec.align(F.lit(n))) for n in (0, 1, 8, 9)] == [0, 8, 8, 16]
    assert [one(codec.inline_size(codec.embed(F.lit(5).cast("long"), F.lit(n)))) for n in (1, 7, 8)] == [1, 7, 8]
    assert one(codec.prefix16(F.lit(b"ab"))) == "6162" + "0" * 28
    assert [len(one(codec.scrambled_value(F.lit(i).cast("long"), 20))) for i in (0, 1)] == [8, 20]


@pytest.mark.parametrize("parts,adaptive", [(16, "true"), (16, "false"), (5, "true")])
def test_every_request_of_a_large_batch_is_answered(spark, tmp_path, parts, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 300_000
        key = F.concat(codec.int_key((F.col("id") * 7919) % n), F.lit(b"k" * 56))
        store = KeyedStore(spark, f"file://{tmp_path}/s")
        done = store.apply(spark.range(n).select(F.col("id").alias("seq"), F.lit("insert").alias("op"), key.alias("key"), codec.int_value(F.col("id")).alias("value")))
        assert done.agg(F.count("*"), F.countDistinct("seq"), F.sum(F.col("accepted").cast("int"))).first() == (n, n, n)
        assert store.state().agg(F.count("*"), F.countDistinct("key")).first() == (n, n)
        assert store.log().agg(F.min("lsn"), F.max("lsn"), F.countDistinct("lsn")).first() == (1, n, n)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_writes_after_damage_are_kept(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = KeyedStore(spark, path)
    store.apply(ask(spark, *[("insert", b"k%d" % i, b"v") for i in range(6)]))
    (batch,) = store.files.names("log")
    at = f"{path}/log/{batch}"
    hurt = spark.read.parquet(at).withColumn("value", F.when(F.col("lsn") == 4, F.lit(b"w")).otherwise(F.col("value")))
    hurt.write.parquet(f"{path}/log/a=000000000007")
    store.files.delete(f"log/{batch}")
    again = KeyedStore(spark, path)
    assert [k for k, _ in rows(again.scan(b"", b"z"))] == [b"k0", b"k1", b"k2"]

    def crash():
        raise RuntimeError("power cut")

    again.hooks["before_cut"] = crash
    with pytest.raises(RuntimeError):
        again.apply(ask(spark, ("insert", b"new", b"1")))
    again = KeyedStore(spark, path)
    assert [k for k, _ in rows(again.scan(b"", b"z"))] == [b"k0", b"k1", b"k2"]
    assert outcome(again, ask(spark, ("insert", b"k4", b"1"), ("insert", b"k0", b"2"), ("update", b"k2", b"3"))) == [True, False, True]
    want = [(b"k0", b"v"), (b"k1", b"v"), (b"k2", b"3"), (b"k4", b"1")]
    assert rows(again.scan(b"", b"z")) == want and rows(KeyedStore(spark, path).scan(b"", b"z")) == want
    assert outcome(KeyedStore(spark, path), ask(spark, ("delete", b"k4", None))) == [True]
    last = KeyedStore(spark, path)
    last.checkpoint()
    assert rows(KeyedStore(spark, path).scan(b"", b"z")) == want[:3]


def test_a_failed_append_stops_all_writes(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = KeyedStore(spark, path)
    assert store.insert(b"a", b"1")

    def fault():
        raise OSError("no space left")

    store.hooks["before_log"] = fault
    with pytest.raises(OSError):
        store.insert(b"b", b"2")
    store.hooks.clear()
    for write in (lambda: store.insert(b"b", b"2"), store.checkpoint, lambda: store.bulk_load(spark.createDataFrame([(b"b", b"2")], "key binary, value binary"))):
        with pytest.raises(StoreError, match="open the store again"):
            write()
    assert store.get(b"a") == b"1" and store.get(b"b") is None
    again = KeyedStore(spark, path)
    assert again.insert(b"b", b"2") and rows(again.scan(b"", b"z")) == [(b"a", b"1"), (b"b", b"2")]


def test_only_committed_batches_count(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = KeyedStore(spark, path)
    store.apply(ask(spark, ("insert", b"a", b"1")))
    store.apply(ask(spark, ("insert", b"b", b"1")))
    last = store.files.names("log")[-1]
    store.files.delete(f"log/{last}/_SUCCESS")
    again = KeyedStore(spark, path)
    assert rows(again.scan(b"", b"z")) == [(b"a", b"1")]
    assert outcome(again, ask(spark, ("insert", b"b", b"2"))) == [True]
    assert rows(KeyedStore(spark, path).scan(b"", b"z")) == [(b"a", b"1"), (b"b", b"2")]


def test_snapshot_content_is_checked(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = KeyedStore(spark, path)
    rows_of = lambda f: spark.range(50).select(codec.int_key(F.col("id")).alias("key"), codec.int_value(f(F.col("id"))).alias("value"))
    store.bulk_load(rows_of(lambda i: i))
    store.verify()
    rows_of(lambda i: i + 1).write.mode("overwrite").parquet(store.manifest["base"])
    with pytest.raises(StoreError):
        KeyedStore(spark, path).verify()


def test_clone_carries_what_no_checkpoint_holds(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s")
    store.apply(ask(spark, ("insert", b"a", b"1"), ("insert", b"b", b"1")))
    store.checkpoint()
    store.apply(ask(spark, ("delete", b"a", None), ("insert", b"c", b"2")))
    twin = store.clone(f"file://{tmp_path}/t")
    assert rows(twin.scan(b"", b"z")) == rows(store.scan(b"", b"z")) == [(b"b", b"1"), (b"c", b"2")]
    assert outcome(twin, ask(spark, ("insert", b"a", b"9"))) == [True] and store.get(b"a") is None
    twin.checkpoint()
    assert rows(KeyedStore(spark, f"file://{tmp_path}/t").scan(b"", b"z")) == [(b"a", b"9"), (b"b", b"1"), (b"c", b"2")]


def test_probes_and_streams_into_a_store(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", EngineConfig(policy=CompactionPolicy(capacity=8)))
    store.apply(ask(spark, *[("insert", b"%02d" % i, b"v") for i in range(10)]))
    assert store.probe("reorganize", limit=0.0)[::2] == (10, True)
    keys, took, late = store.probe("checkpoint", ask(spark, ("delete", b"00", None)))
    assert keys == 9 and took > 0 and not late
    for i in range(3):
        ask(spark, *[("insert", b"n%d%d" % (i, j), b"w") for j in range(4)], ("delete", b"0%d" % (i + 1), None)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    store.follow(stream, f"{tmp_path}/checkpoint")
    want = sorted([b"%02d" % i for i in range(4, 10)] + [b"n%d%d" % (i, j) for i in range(3) for j in range(4)])
    assert [k for k, _ in rows(KeyedStore(spark, f"file://{tmp_path}/s").scan(b"", b"z"))] == want
    assert store.statistics()["checkpoints"] >= 2
