"""Measurements, result files, workload generators and streams."""

import json
import random
from collections import OrderedDict

import pytest
from keystrand.operators import changes, compaction, measure, reads, workload
from keystrand.plans import catalog
from keystrand.sources import results
from keystrand.streaming import replay
from pyspark.sql import functions as F


def test_index_percentiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 5.0)] * 3, "g string, x double")
    got = {r.g: (r.n, r.p50, r.p99) for r in measure.index_percentiles(df, "x", "g", {"p50": 500, "p99": 990}).collect()}
    assert got == {"a": (10, 5.0, 9.0), "b": (3, 5.0, 5.0)}


def test_second_buckets_without_a_bound(spark):
    df = spark.sql("SELECT timestamp_micros(t) AS ts, 'a' AS k FROM VALUES (-1L), (0L), (999999L), (86400000000L), (9000000000000000L), (NULL) AS v(t)")
    start = F.timestamp_micros(F.lit(0).cast("long"))
    assert {r.sec: r.n for r in measure.second_buckets(df, start, "ts", "k", None).collect()} == {0: 1, 1: 2, 86401: 1, 9000000001: 1, None: 1}
    assert {r.sec: r.n for r in measure.second_buckets(df.where("ts < '2000-01-01'"), start, "ts", "k", 86400).collect()} == {1: 2}


def test_lru(spark):
    pages = [1, 2, 3, 1, 4, 2, 1, 1, 5, 3, 4, 1]
    cache, hits = OrderedDict(), 0
    for p in pages:
        hits += p in cache
        cache.pop(p, None)
        cache[p] = 1
        if len(cache) > 3:
            cache.popitem(last=False)
    df = spark.createDataFrame(list(enumerate(pages)), "i long, p long")
    assert measure.lru_hits(df, 3, "i", "p").first() == (len(pages), hits)


def test_lru_over_many_ranges_and_groups(spark):
    r = random.Random(3)
    steps = [(i, r.choice("ab"), int(r.paretovariate(0.7)) % 60) for i in range(4000)]
    df = spark.createDataFrame(steps, "i long, g string, p long").repartition(7)

    def plain(rows, capacity):
        cache, hits = OrderedDict(), 0
        for _, _, p in rows:
            hits += p in cache
            cache.pop(p, None)
            cache[p] = 1
            if len(cache) > capacity:
                cache.popitem(last=False)
        return len(rows), hits

    for capacity in (1, 5, 30, 1000):
        assert tuple(measure.lru_hits(df, capacity, "i", "p").first()) == plain(steps, capacity)
        got = {x.g: (x.accesses, x.hits) for x in measure.lru_hits(df, capacity, "i", "p", "g").collect()}
        assert got == {g: plain([s for s in steps if s[1] == g], capacity) for g in "ab"}
    assert tuple(measure.lru_hits(df.where("false"), 3, "i", "p").first()) == (0, 0)


def test_deltas_of_groups_that_span_partitions(spark):
    r = random.Random(4)
    steps = [(i, None if i % 97 == 0 else r.choice("abc") if i % 3 else "hot", None if i % 31 == 0 else float(r.randrange(100))) for i in range(3000)]
    df = spark.createDataFrame(steps, "i long, g string, x double").repartition(5)
    last, want = {}, {}
    for i, g, x in steps:
        before = last.get(g)
        want[i] = None if x is None or before is None else x - before
        last[g] = x
    assert {x.i: x.delta for x in changes.counter_deltas(df, "x", "i", "g").collect()} == want
    total = {x.i: x.delta for x in changes.counter_deltas(df, "x", "i").collect()}
    assert all(total[i] == (None if i == 0 or None in (steps[i][2], steps[i - 1][2]) else steps[i][2] - steps[i - 1][2]) for i in range(3000))


@pytest.mark.parametrize("span", [1, 7, 50, 1 << 20])
def test_outcomes_and_versions_of_hot_keys_by_ranges_of_the_log(spark, span):
    rng = random.Random(span)
    rows = [(n, rng.choice(["insert", "update", "delete"]), rng.choice([1, 1, 1, 2, 3, None, rng.randrange(90)]), rng.choice([None, 1.5, 9.0, float(n)])) for n in rng.sample(range(2000), 400)]
    log, known = spark.createDataFrame(rows, "lsn long, op string, key long, value double"), {1, 40, 41}
    live, last, want = {k: True for k in known}, {}, {}
    for lsn, op, key, value in sorted(rows, key=lambda r: r[0]):
        refused, found = value == 9.0, live.get(key, False)
        accepted = not refused and (op == "insert") != found
        if accepted and op != "update":
            live[key] = op == "insert"
        previous, number = last.get(key, (None, 0))
        last[key] = value, number + 1
        want[lsn] = (op, key, value, found, accepted, previous, number + 1)
    existing = spark.createDataFrame([(k,) for k in known], "key long")
    done = changes.outcomes(log, existing, reject=F.col("value") == 9.0, span=span)
    assert done.columns == [*log.columns, "exists_before", "accepted"]
    counted = changes.versions(log, span=span)
    assert counted.columns == [*log.columns, "previous", "version"]
    got = {r.lsn: tuple(r)[1:] for r in done.join(counted.select("lsn", "previous", "version"), "lsn").collect()}
    assert got == want
    assert changes.outcomes(log.where("false"), span=span).count() == 0 and changes.versions(log.where("false"), span=span).count() == 0


def test_range_probe_equals_brute_force(spark):
    r = random.Random(5)
    keys, starts = sorted(r.sample(range(-500, 3000), 700)), [r.randrange(-700, 3100) for _ in range(200)]
    got = {x.start: (x.n, x.low, x.high) for x in reads.range_probe(spark.createDataFrame([(s,) for s in set(starts)], "start long"), spark.createDataFrame([(k,) for k in keys], "k long"), "k", 37).collect()}
    inside = {s: [k for k in keys if s <= k < s + 37] for s in starts}
    assert got == {s: (len(v), v[0], v[-1]) for s, v in inside.items() if v}


def test_winner_ties_take_the_first_label(spark):
    df = spark.createDataFrame([("w", "n1", 5.0, True), ("w", "n0", 5.0, True), ("w", "r", 4.0, False), ("v", "n0", 1.0, True)], "w string, label string, value double, native boolean")
    got = {r.w: (r.native_label, r.rival_label, r.ratio, r.badge) for r in measure.winners(df, F.col("native"), "w").collect()}
    assert got == {"w": ("n0", "r", 1.25, "win"), "v": ("n0", None, None, "n/a")}


def test_result_files(spark, tmp_path):
    name = "Store=A/Variant=B/Op=Get/Mode=Hit/Dist=Zipf/Value=1KB_20__8B_/real_time/threads:4"
    (tmp_path / "b.json").write_text(json.dumps({"context": {}, "benchmarks": [{"name": name, "items_per_second": 2.5}, {"name": "other"}]}))
    (tmp_path / "t.json").write_text(json.dumps({"store": "A", "variant": "B", "value_size": "64KB_x", "timeline": [{"sec": 1, "scan_ops": 9, "insert_ops": 1}], "forced_events": []}))
    (tmp_path / "p.jsonl").write_text('{"scenario":"ltm","value_size":"8B","mode":"t1only","ratio":1.0,"key_count":5,"elapsed_sec":0.5,"timed_out":false}\n\n')
    (tmp_path / "m.json").write_text(json.dumps({"config": {"threads": 1}, "results": {"mmap": {"p50": 0.1}, "lru": {"p50": 0.2, "hits": 3}}}))
    row = results.read_benchmarks(spark, str(tmp_path / "b.json")).collect()
    assert [(r.store, r.variant, r.op, r.mode, r.dist, r.value, r.threads, r.items_per_second) for r in row] == [("A", "B", "Get", "Hit", "Zipf", "1KB_20__8B_", 4, 2.5)]
    assert [(r.value_size, r.scenario, r.sec, r.scan_ops, r.t1_reorg_ops) for r in results.read_timelines(spark, str(tmp_path / "t*.json")).collect()] == [("64KB", "unspecified", 1, 9, 0)]
    assert results.read_forced_events(spark, str(tmp_path / "t*.json")).count() == 1
    assert results.read_probes(spark, str(tmp_path / "p.jsonl")).count() == 1
    micro = results.read_micro(spark, str(tmp_path / "m.json"))
    assert micro.count() == 3
    results.write_micro(micro, str(tmp_path / "out"))
    assert results.read_micro(spark, str(tmp_path / "out")).count() == 3
    results.write_timeline(spark.createDataFrame([("A", 2, 5, 1), ("A", 1, 6, 0)], "store string, sec int, scan_ops long, insert_ops long"), str(tmp_path / "line"), "store")
    assert [t.sec for t in spark.read.json(str(tmp_path / "line")).first().timeline] == [1, 2]


def test_workloads(spark):
    corpus = workload.corpus(spark, 20, 64)
    assert [len(r.value) for r in corpus.orderBy("i").collect()] == [8 if i % 5 == 0 else 64 for i in range(20)]
    assert corpus.select("value").distinct().count() == 20
    keys = corpus.select("key")
    assert reads.get_miss(workload.misses(spark, 50, 20), keys, "key").count() == 50
    assert reads.multi_get(workload.hits(spark, 50, 20), keys, "key").count() == 50
    draws = workload.zipf_exact(spark, 1000, 5000, 3).groupBy("i").count().collect()
    counts = {r.i: r["count"] for r in draws}
    assert min(counts) >= 0 and max(counts) < 1000 and 450 < counts[0] < 900
    ops = {r.op: r["count"] for r in workload.ycsb_e(spark, 4000, 1000).groupBy("op").count().collect()}
    assert 120 < ops["insert"] < 290 and ops["scan"] + ops["insert"] == 4000
    assert workload.churn(spark, 100, 0.3).count() == 30 and len(workload.pages(spark, 1).first().data) == 4096


def test_exact_zipf_has_the_distribution_at_any_size(spark):
    for n, alpha in ((1, 1.0), (5, 1.0), (300, 1.0), (300, 0.7)):
        draws = {r.i: r["count"] for r in workload.zipf_exact(spark, n, 40_000, 3, alpha).groupBy("i").count().collect()}
        weights = [1 / (i + 1) ** alpha for i in range(n)]
        assert set(draws) <= set(range(n))
        for i in range(min(n, 5)):
            share = weights[i] / sum(weights)
            assert abs(draws[i] / 40_000 - share) < 5 * (share / 40_000) ** 0.5 + 1e-9, (n, alpha, i)
    big = workload.zipf_exact(spark, 10**12, 1000, 3)
    assert big.agg(F.max("i")).first()[0] < 10**12 and big.collect() == big.repartition(3).orderBy("draw").collect()


def test_requests_pages_and_schedules(spark):
    rows = workload.deletes(spark, 20, 3).collect()
    assert [(r.seq, r.op, bytes(r.key), r.thread) for r in rows] == [(i, "delete", b"k%015x" % i, i % 3) for i in range(20)]
    assert workload.updates(spark, 30, 10).where("op = 'update' and value is not null").count() == 30
    assert workload.corpus_keys(10_000, 84) == 100 and workload.corpus_keys(1, 84) == 1
    pages = workload.page_accesses(spark, 1000, 50, 8).collect()
    assert {r.page for r in pages} <= set(range(50)) and [r.op for r in pages] == [i // 8 for i in range(1000)] and len({r.page for r in pages}) > 40
    assert [r.op for r in workload.page_accesses(spark, 5, 50).collect()] == list(range(5))
    plan, done, now = workload.Schedule(), [], iter(range(100))
    actions = {k: (lambda k=k: done.append(k)) for k in ("reorganize", "checkpoint")}
    assert plan.run(4.9, actions, lambda: next(now)) == [] and plan.run(11.0, actions, lambda: next(now)) == [(5, 11.0, "reorganize", 1), (10, 11.0, "checkpoint", 1)]
    plan.run(30.0, actions, lambda: next(now))
    assert done == ["reorganize", "checkpoint", "checkpoint"] and not plan.open and len(plan.fired) == 3


def test_hooks_of_merge_and_replay(spark, tmp_path):
    rows = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "key long, value long")
    doubled = compaction.rewritten(rows, lambda df: df.withColumn("value", F.col("value") * 2))
    assert {(r.key, r.value) for r in doubled.collect()} == {(i * 7 % 50, 2 * i) for i in range(50)}
    with pytest.raises(ValueError):
        compaction.rewritten(rows, lambda df: df.drop("value"))
    compaction.write_final(rows, lambda df: df.write.parquet(f"{tmp_path}/final"))
    assert spark.read.parquet(f"{tmp_path}/final").count() == 50
    log = spark.createDataFrame([(i, "insert", bytearray(b"k%d" % i), bytearray(b"v")) for i in range(40)], "lsn long, op string, key binary, value binary").repartition(5)
    folder = str(tmp_path / "seen")
    (tmp_path / "seen").mkdir()

    def note(op, key, value, lsn):
        import os
        import threading

        with open(f"{folder}/{os.getpid()}-{threading.get_ident()}", "a") as f:
            f.write(f"{op} {bytes(key).decode()} {lsn}\n")

    changes.replay_to(log, note)
    lines = [line.split() for f in (tmp_path / "seen").iterdir() for line in f.read_text().splitlines()]
    assert sorted(int(n) for _, _, n in lines) == list(range(40)) and all(k == f"k{n}" for _, k, n in lines)


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("x"))
    got = [r.position for r in reads.numbered(df, "x").orderBy("x").collect()]
    assert got == list(range(1, 1001))
    assert reads.numbered(df.where("x < 0"), "x").count() == 0


@pytest.mark.parametrize("parts,adaptive", [(16, "true"), (16, "false"), (3, "true")])
def test_numbers_of_wide_rows(spark, parts, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000
        df = spark.range(n).select(((F.col("id") * 7919) % n).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("wide"), F.col("id"))
        rows = reads.numbered(df, "x")
        assert rows.columns == ["x", "wide", "id", "position"]
        assert tuple(rows.agg(F.count("*"), F.countDistinct("position"), F.min("position"), F.max("position"), F.sum((F.col("position") != F.col("x") + 1).cast("int")), F.countDistinct("wide")).first()) == (n, n, 1, n, 0, n)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_micro_batches_equal_one_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(4):
        events.where((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(catalog.EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    state = replay.MergedState(spark, f"file://{tmp_path}/state", "key", "value")
    replay.merge_stream(catalog.requests(stream), state, f"{tmp_path}/checkpoint")
    want = {tuple(r) for r in catalog.log_latest_state(spark, "/root/testdata/sf0.001").select("key", "value", "lsn").collect()}
    assert {tuple(r) for r in state.read().select("key", "value", "lsn").collect()} == want and state.latest() == 3
    state.merge(catalog.requests(events), 3)  # a repeated batch changes nothing
    assert state.read().count() == len(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
