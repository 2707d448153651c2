"""The registered queries: each operator over the driver's tables, with its SQL twin where SQL can say it.

How tables stand in: ``orders`` is an ordered store (key o_orderkey); ``events`` is a request log (lsn event_id, key user_id,
signup inserts, error deletes, the rest update).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import changes, compaction, measure, reads, workload
from ..sources import results
from ..sources.files import scratch_dir
from ..sources.store import KeyedStore
from ..streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

OP_SQL = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END"
REQUESTS_SQL = f"r AS (SELECT event_id AS lsn, {OP_SQL} AS op, user_id AS key, value FROM events)"
ACCEPTED_SQL = f"""{REQUESTS_SQL},
    e AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('insert', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'insert', false) AS exists_before FROM r),
    a AS (SELECT *, CASE WHEN op = 'insert' THEN NOT exists_before ELSE exists_before END AS accepted FROM e)"""
BASE_SQL = """v AS (SELECT o_orderkey AS key, o_totalprice AS value, false AS is_delete, 0::BIGINT AS lsn FROM orders
    UNION ALL SELECT event_id, value, event_type = 'error', event_id + 1 FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operation() -> Column:
    return F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")


def requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("lsn"), operation().alias("op"), F.col("user_id").alias("key"), "value")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def newest(rows: str, where: str = "true") -> str:
    return f"SELECT key, value, lsn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS n FROM {rows} WHERE {where}) WHERE n = 1 AND op <> 'delete'"


# ---------------------------------------------------------------- reads


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def kv_get(spark, d):
    return reads.get(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 42, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_orderkey = c_custkey")
def kv_multi_get(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"))
    return reads.multi_get(wanted, table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("SELECT a.page_id, b.page_id AS found FROM pages a JOIN pages b ON a.url = b.url")
def kv_get_prefix_hash(spark, d):
    url = codec.text(F.col("url"))
    index = table(spark, d, "pages").select(codec.prefix16(url).alias("prefix"), codec.clean_hash(url).alias("hash"), "page_id")
    return reads.get_by_prefix_hash(index, index.withColumnRenamed("page_id", "found")).select("page_id", "found")


@query("SELECT c_custkey * 20 AS o_orderkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c_custkey * 20)")
def kv_get_miss(spark, d):
    return reads.get_miss(table(spark, d, "customer").select((F.col("c_custkey") * 20).alias("o_orderkey")), table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT c_custkey * 20 AS o_orderkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c_custkey * 20)")
def kv_exists(spark, d):
    return reads.exists(table(spark, d, "customer").select((F.col("c_custkey") * 20).alias("o_orderkey")), table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 199")
def kv_scan_range(spark, d):
    return reads.scan(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, 199, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 199 AND 100")
def kv_scan_inverted(spark, d):
    return reads.scan(table(spark, d, "orders").select("o_orderkey"), 199, 100, "o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey BETWEEN 100 AND 199")
def kv_scan_count(spark, d):
    return reads.scan_count(table(spark, d, "orders").select("o_orderkey"), 100, 199, "o_orderkey")


@query("SELECT url, page_id FROM pages WHERE url BETWEEN 'https://b' AND 'https://t'")
def kv_scan_string_keys(spark, d):
    return reads.prefix_scan(table(spark, d, "pages").select("url", "page_id"), "https://b", "https://t", "url")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 100")
def kv_scan_limit(spark, d):
    return reads.scan_limit(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 500, 100, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 599 ORDER BY o_orderkey LIMIT 100")
def kv_scan_resume(spark, d):
    return reads.after(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 599, 100, "o_orderkey")


@query("SELECT (p - 1) // 100 AS page, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1")
def kv_paginate(spark, d):
    return reads.paginate(table(spark, d, "orders"), 100, "o_orderkey")


@query("SELECT c_custkey * 10 AS start, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM customer JOIN orders ON o_orderkey BETWEEN c_custkey * 10 AND c_custkey * 10 + 99 GROUP BY 1")
def kv_range_probe(spark, d):
    return reads.range_probe(table(spark, d, "customer").select((F.col("c_custkey") * 10).alias("start")), table(spark, d, "orders"), "o_orderkey")


@query("SELECT l_orderkey AS offset, l_linenumber AS generation, l_quantity, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_custkey % 7 + 1 = l_linenumber")
def kv_dereference(spark, d):
    index = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("offset"), F.col("l_linenumber").alias("generation"), "l_quantity")
    values = table(spark, d, "orders").select(F.col("o_orderkey").alias("offset"), (F.col("o_custkey") % 7 + 1).cast("int").alias("generation"), "o_totalprice")
    return reads.dereference(index, values)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN o_orderstatus ELSE o_orderpriority END AS value FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 7 > 0")
def kv_covered(spark, d):
    """Values of up to eight bytes lie in the index; the records of a seventh of the others belong to another generation."""
    orders, small = table(spark, d, "orders"), F.col("o_custkey") % 5 == 0
    hash_ = F.when(small, codec.embed(F.col("o_orderkey"), F.octet_length("o_orderstatus"))).otherwise(F.col("o_orderkey"))
    index = orders.select("o_orderkey", hash_.alias("hash"), F.when(small, F.col("o_orderstatus")).alias("small_value"), F.col("o_orderkey").alias("offset"), F.lit(1).alias("generation"))
    values = orders.where(~small).select(F.col("o_orderkey").alias("offset"), F.when(F.col("o_custkey") % 7 > 0, 1).otherwise(0).alias("generation"), F.col("o_orderpriority").alias("value"))
    return reads.covered(index, values).select("o_orderkey", "value")


# ---------------------------------------------------------------- logs


@query(f"WITH {ACCEPTED_SQL} SELECT lsn, op, key, value, exists_before, accepted FROM a")
def log_accepted_requests(spark, d):
    return changes.outcomes(requests(table(spark, d, "events"))).select("lsn", "op", "key", "value", "exists_before", "accepted")


@query(f"WITH {ACCEPTED_SQL} {newest('a', 'accepted')}")
def log_latest_state(spark, d):
    return changes.replay(changes.outcomes(requests(table(spark, d, "events"))).where("accepted"))


@query(f"WITH {REQUESTS_SQL} {newest('r')}")
def log_upsert_state(spark, d):
    return changes.upsert(requests(table(spark, d, "events")))


def _with_cut(log):
    """The log with ``_cut``, the lsn at seven tenths of its last one."""
    return log.crossJoin(F.broadcast(log.agg(F.expr("max(lsn) * 7 div 10").alias("_cut"))))  # one row


@query(f"WITH {ACCEPTED_SQL} {newest('a', 'accepted AND lsn <= (SELECT max(lsn) * 7 // 10 FROM r)')}")
def log_state_as_of(spark, d):
    """The cut is the feature; it moves with the log's length."""
    return changes.replay(changes.outcomes(changes.as_of(_with_cut(requests(table(spark, d, "events"))), F.col("_cut"))).where("accepted"))


@query(f"WITH {REQUESTS_SQL} SELECT lsn, op, key, value FROM r WHERE lsn > 800")
def log_tail_after_checkpoint(spark, d):
    return changes.tail(requests(table(spark, d, "events")), 800)


@query(f"WITH {REQUESTS_SQL} SELECT DISTINCT key FROM r WHERE lsn > 800")
def log_changed_keys(spark, d):
    return changes.changed_keys(requests(table(spark, d, "events")), 800)


@query(f"WITH {ACCEPTED_SQL}, s AS ({newest('a', 'accepted')}) SELECT k.key, s.value FROM (SELECT DISTINCT key FROM r WHERE lsn > 800) k LEFT JOIN s USING (key)")
def log_changed_keys_resolved(spark, d):
    log = requests(table(spark, d, "events"))
    state = changes.replay(changes.outcomes(log).where("accepted")).select("key", "value")
    return changes.resolve_changed(log, state, 800)


@query(f"WITH {REQUESTS_SQL} SELECT lsn, op, key, value, lag(value) OVER w AS previous, row_number() OVER w AS version FROM r WINDOW w AS (PARTITION BY key ORDER BY lsn)")
def log_version_history(spark, d):
    return changes.versions(requests(table(spark, d, "events")))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events")
def log_lsn_assign(spark, d):
    return reads.numbered(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "position")


@query("SELECT event_id, value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS delta FROM events")
def log_counter_delta(spark, d):
    return changes.counter_deltas(table(spark, d, "events").select("event_id", "event_type", "value"), "value", "event_id", "event_type").select("event_id", "delta")


@query(f"WITH {REQUESTS_SQL} SELECT lsn, op, key, value FROM r WHERE lsn < (SELECT max(lsn) * 7 // 10 FROM r)")
def log_valid_prefix(spark, d):
    """Checksums over the whole log; the value of the record at seven tenths is changed after its checksum was taken."""
    log = requests(table(spark, d, "events"))
    sealed = changes.with_checksum(log.select("lsn", "op", codec.int_key(F.col("key")).alias("key"), codec.text(F.col("value").cast("string")).alias("value"), F.col("key").alias("k"), F.col("value").alias("v")))
    damaged = _with_cut(sealed).withColumn("value", F.when(F.col("lsn") == F.col("_cut"), F.lit(b"?")).otherwise(F.col("value")))
    return changes.valid_prefix(damaged, ~changes.is_valid()).select("lsn", "op", F.col("k").alias("key"), F.col("v").alias("value"))


@query(f"WITH {REQUESTS_SQL} SELECT op, count(*) AS n, count(*) / (SELECT count(*) FROM r) AS share FROM r GROUP BY op")
def log_op_counts(spark, d):
    return changes.op_counts(requests(table(spark, d, "events")))


@query(f"WITH {REQUESTS_SQL} SELECT max(lsn) + 1 AS next_lsn, count(*) AS records FROM r")
def log_next_lsn(spark, d):
    return requests(table(spark, d, "events")).agg((F.max("lsn") + 1).alias("next_lsn"), F.count("*").alias("records"))


@query(f"WITH {REQUESTS_SQL} SELECT lsn, op, key, value FROM r")
def log_redelivered(spark, d):
    log = requests(table(spark, d, "events"))
    return changes.deduplicated(log.unionByName(changes.tail(log, 500)))


# ---------------------------------------------------------------- compaction


def _parts(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), F.lit(False).alias("is_delete"), F.lit(0).cast("long").alias("lsn"))
    delta = table(spark, d, "events").select(F.col("event_id").alias("key"), "value", (F.col("event_type") == "error").alias("is_delete"), (F.col("event_id") + 1).alias("lsn"))
    return base, delta


@query(f"WITH {BASE_SQL} SELECT key, value, lsn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS n FROM v) WHERE n = 1 AND NOT is_delete")
def compact_merge(spark, d):
    return compaction.merge(*_parts(spark, d))


@query("SELECT o_orderkey * 16 AS offset, CASE WHEN o_custkey % 5 = 0 THEN o_orderkey - 9223372036854775807 - 1 ELSE o_orderkey END AS hash FROM orders WHERE o_custkey % 5 <> 0 AND o_custkey % 7 <> 0 AND o_orderkey >= 100 AND o_orderkey NOT IN (SELECT user_id FROM events)")
def compact_candidates(spark, d):
    hash_ = F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderkey").bitwiseOR(F.lit(codec.SIGN))).otherwise(F.col("o_orderkey"))
    index = table(spark, d, "orders").select((F.col("o_orderkey") * 16).alias("offset"), hash_.alias("hash"), (F.col("o_custkey") % 7 == 0).alias("is_delete"))
    durable = table(spark, d, "events").select((F.col("user_id") * 16).alias("offset"))
    return compaction.candidates(index, durable, 1600).select("offset", "hash")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 3 ELSE 9 END AS generation FROM orders")
def compact_restamp(spark, d):
    hash_ = F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderkey").bitwiseOR(F.lit(codec.SIGN))).otherwise(F.col("o_orderkey"))
    return compaction.restamp(table(spark, d, "orders").select("o_orderkey", hash_.alias("hash"), F.lit(3).alias("generation")), 9).select("o_orderkey", "generation")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def compact_without_deleted(spark, d):
    base, delta = _parts(spark, d)
    return compaction.without_deleted(base.select("key", "value"), delta.where("is_delete"))


@query("SELECT (count(*) - count(DISTINCT l_orderkey))::BIGINT AS duplicates FROM lineitem")
def compact_duplicates_check(spark, d):
    return compaction.adjacent_duplicates(table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")


@query("SELECT o_orderkey // 1000 AS zone, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders GROUP BY 1")
def compact_zone_map(spark, d):
    return compaction.zone_map(table(spark, d, "orders"), F.floor(F.col("o_orderkey") / 1000), "o_orderkey")


@query("SELECT (user_id % 256)::INT AS stripe, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)::BIGINT AS live, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS deleted, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*) AS ratio FROM events GROUP BY 1 HAVING ratio >= 0.2")
def compact_stripe_pressure(spark, d):
    return compaction.stripe_pressure(table(spark, d, "events"), F.col("user_id"), F.col("event_type") == "error", 0.2)


@query("""SELECT coalesce(sum(b) FILTER (v NOT BETWEEN 1 AND 8), 0)::BIGINT AS live_bytes, count(*) FILTER (v NOT BETWEEN 1 AND 8) AS records
    FROM (SELECT v, ((((8 + v + 24 + 7) // 8) * 8 + 15) // 16) * 16 AS b FROM (SELECT octet_length(encode(text))::BIGINT AS v FROM documents))""")
def stat_live_bytes(spark, d):
    size = F.octet_length("text").cast("long")
    return compaction.live_bytes(table(spark, d, "documents"), F.lit(8), size, size.between(1, 8))


@query("""WITH s AS (SELECT user_id, event_id, ((((8 + octet_length(encode(props)) + 24 + 7) // 8) * 8 + 15) // 16) * 16 AS b FROM events),
    g AS (SELECT sum(b) AS total, arg_max(b, event_id) AS live FROM s GROUP BY user_id)
    SELECT sum(total)::BIGINT AS total_bytes, sum(live)::BIGINT AS live_bytes, sum(total) / sum(live) AS amplification FROM g""")
def stat_space_amplification(spark, d):
    rows = table(spark, d, "events").withColumn("lsn", F.col("event_id"))
    return compaction.space_amplification(rows, "user_id", F.lit(8), F.octet_length("props"))


# ---------------------------------------------------------------- encodings


@query("SELECT o_orderkey, lpad(upper(to_hex(xor((o_orderkey - 700)::BIGINT, (-9223372036854775808)::BIGINT))), 16, '0') AS k, o_orderkey - 700 AS back FROM orders")
def codec_int_key(spark, d):
    key = codec.int_key(F.col("o_orderkey") - 700)
    return table(spark, d, "orders").select("o_orderkey", F.hex(key).alias("k"), codec.decode_int_key(key).alias("back"))


@query("SELECT o_orderkey, array_to_string(list_reverse(list_transform(range(8), lambda i: substr(h, (i * 2 + 1)::INT, 2))), '') AS v, o_orderkey - 700 AS back FROM (SELECT o_orderkey, lpad(upper(to_hex((o_orderkey - 700)::BIGINT)), 16, '0') AS h FROM orders)")
def codec_int_value(spark, d):
    value = codec.int_value(F.col("o_orderkey") - 700)
    return table(spark, d, "orders").select("o_orderkey", F.hex(value).alias("v"), codec.decode_int_value(value).alias("back"))


@query("SELECT conv_id, turn, lpad(upper(to_hex(conv_id)), 8, '0') || lpad(upper(to_hex(turn)), 8, '0') AS k FROM conversations")
def codec_composite_key(spark, d):
    key = codec.composite_key(codec.int_key(F.col("conv_id"), 32, signed=False), codec.int_key(F.col("turn"), 32, signed=False))
    return table(spark, d, "conversations").select("conv_id", "turn", F.hex(key).alias("k"))


@query("SELECT o_orderkey, lpad(upper(to_hex((o_orderkey - 700 + 2147483648)::BIGINT)), 8, '0') AS k, o_orderkey - 700 AS back FROM orders")
def codec_int_key32(spark, d):
    key = codec.int_key(F.col("o_orderkey") - 700, 32)
    return table(spark, d, "orders").select("o_orderkey", F.hex(key).alias("k"), codec.decode_int_key(key, 32).alias("back"))


@query("SELECT o_orderkey, printf('k%015x', o_orderkey) AS k FROM orders")
def codec_ikey_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", codec.formatted_key(F.col("o_orderkey")).alias("k"))


@query("SELECT page_id, rpad(substr(hex(encode(url)), 1, 32), 32, '0') AS prefix FROM pages")
def codec_prefix16(spark, d):
    return table(spark, d, "pages").select("page_id", codec.prefix16(codec.text(F.col("url"))).alias("prefix"))


_FNV = "list_reduce(list_concat([14695981039346656037::hugeint], [ascii(s[i])::hugeint for i in range(1, length(s) + 1)]), lambda h, b: ((h - h % 256 + xor((h % 256)::int, b::int))::hugeint * 1099511628211) % 18446744073709551616)"


@query(f"SELECT c_custkey, ({_FNV})::VARCHAR AS h, (({_FNV}) % 1152921504606846976)::BIGINT AS clean FROM (SELECT c_custkey, c_name AS s FROM customer)")
def codec_fnv1a64(spark, d):
    name = codec.text(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", codec.fnv1a64(name).cast("string").alias("h"), codec.clean_hash(name).alias("clean"))


@query(f"SELECT c_custkey, ({_FNV})::VARCHAR AS h FROM (SELECT c_custkey, c_name || c_mktsegment AS s FROM customer)")
def codec_fnv_chained(spark, d):
    """The hash of two parts, one after the other, is that of the whole."""
    return table(spark, d, "customer").select("c_custkey", codec.fnv1a64(codec.text(F.col("c_mktsegment")), codec.fnv1a64(codec.text(F.col("c_name")))).cast("string").alias("h"))


@query("SELECT c_custkey, (list_reduce(list_concat([0::hugeint], [ascii(s[i])::hugeint for i in range(1, length(s) + 1)]), lambda h, b: (h * 131 + b) % 18446744073709551616))::VARCHAR AS h FROM (SELECT c_custkey, c_name AS s FROM customer)")
def codec_rolling_checksum(spark, d):
    return table(spark, d, "customer").select("c_custkey", codec.rolling(codec.text(F.col("c_name"))).cast("string").alias("h"))


@query("SELECT o_orderkey, ((o_custkey % 1000) << 48) | (o_orderkey * 16) AS payload, o_orderkey * 16 AS byte_offset, (o_custkey % 1000) * 16 AS size FROM orders")
def codec_payload_pack(spark, d):
    p = codec.pack(F.col("o_orderkey") * 16, F.col("o_custkey") % 1000)
    return table(spark, d, "orders").select("o_orderkey", p.alias("payload"), codec.unpack_offset(p).alias("byte_offset"), codec.unpack_size(p).cast("long").alias("size"))


@query("SELECT o_orderkey, true AS inline, (1 + o_custkey % 8)::INT AS size, o_orderkey AS clean FROM orders")
def codec_inline_metadata(spark, d):
    h = codec.embed(F.col("o_orderkey"), 1 + F.col("o_custkey") % 8)
    return table(spark, d, "orders").select("o_orderkey", codec.is_inline(h).alias("inline"), codec.inline_size(h).alias("size"), h.bitwiseAND(F.lit(codec.CLEAN_MASK)).alias("clean"))


@query("SELECT p_partkey, CASE WHEN length('p' || p_partkey) <= 16 AND length(p_brand) BETWEEN 1 AND 8 THEN 'inline' ELSE 'separate' END AS class, p_partkey % 5 = 0 AS rejected FROM part")
def codec_inline_class(spark, d):
    key, value = codec.text(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))), codec.text(F.col("p_brand"))
    stored = F.when(F.col("p_partkey") % 5 == 0, F.lit(b"\xff" * 8)).otherwise(value)
    return table(spark, d, "part").select("p_partkey", F.when(codec.may_inline(key, value), "inline").otherwise("separate").alias("class"), codec.is_sentinel(stored).alias("rejected"))


@query("SELECT rpad(substr(hex(encode(url)), 1, 32), 32, '0') AS prefix, count(*) AS n FROM pages GROUP BY 1 HAVING n > 1")
def prefix_collision_groups(spark, d):
    return table(spark, d, "pages").groupBy(codec.prefix16(codec.text(F.col("url"))).alias("prefix")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT p_partkey, translate(p_type || '/' || p_brand, '/()% ', '_____') AS f FROM part")
def codec_file_name(spark, d):
    return table(spark, d, "part").select("p_partkey", codec.file_name(F.concat_ws("/", "p_type", "p_brand")).alias("f"))


# ---------------------------------------------------------------- measurements


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ts_tumbling_counts(spark, d):
    return measure.buckets(table(spark, d, "events"), "ts", "hour", "event_type").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 + 1)::BIGINT AS sec, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ts_second_buckets(spark, d):
    return measure.second_buckets(table(spark, d, "events"), F.lit("2024-01-01 00:00:00").cast("timestamp"), "ts", "event_type", None)


@query("SELECT event_type, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us, count(*) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))) AS per_second FROM events GROUP BY 1")
def ts_throughput(spark, d):
    return measure.throughput(table(spark, d, "events"), "ts", "event_type")


@query("SELECT event_type, count(*) AS n, list_sort(list(value))[count(*) * 500 // 1000 + 1] AS p50, list_sort(list(value))[count(*) * 950 // 1000 + 1] AS p95, list_sort(list(value))[count(*) * 990 // 1000 + 1] AS p99, list_sort(list(value))[count(*) * 999 // 1000 + 1] AS p999 FROM events GROUP BY 1")
def ts_index_percentiles(spark, d):
    return measure.index_percentiles(table(spark, d, "events"), "value", "event_type", {"p50": 500, "p95": 950, "p99": 990, "p999": 999})


_BADGE = "CASE WHEN ratio IS NULL THEN 'n/a' WHEN ratio <= 0.85 THEN 'lose' WHEN ratio < 0.95 THEN 'behind' WHEN ratio <= 1.05 THEN 'even' WHEN ratio < 1.15 THEN 'ahead' ELSE 'win' END"


@query(f"""WITH r AS (SELECT user_id % 10 AS g, event_type AS label, max(value) AS value FROM events GROUP BY 1, 2),
    b AS (SELECT g, label < 'm' AS native, label, value, row_number() OVER (PARTITION BY g, label < 'm' ORDER BY value DESC, label) AS n FROM r),
    m AS (SELECT g, max(label) FILTER (native) AS native_label, max(value) FILTER (native) AS native_value, max(label) FILTER (NOT native) AS rival_label, max(value) FILTER (NOT native) AS rival_value FROM b WHERE n = 1 GROUP BY g),
    q AS (SELECT *, CASE WHEN rival_value > 0 THEN native_value / rival_value END AS ratio FROM m)
    SELECT *, {_BADGE} AS badge FROM q""")
def bench_winner_matrix(spark, d):
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("g"), F.col("event_type").alias("label")).agg(F.max("value").alias("value"))
    return measure.winners(rows, F.col("label") < "m", "g")


@query("SELECT event_type, max(value) FILTER (user_id % 4 = 0) AS t1, max(value) FILTER (user_id % 4 = 1) AS t4, max(value) FILTER (user_id % 4 = 2) AS t16, max(value) FILTER (user_id % 4 = 3) AS t32 FROM events GROUP BY 1")
def bench_pivot(spark, d):
    rows = table(spark, d, "events").select("event_type", F.element_at(F.array(*map(F.lit, measure.THREADS)), (F.col("user_id") % 4 + 1).cast("int")).alias("threads"), "value")
    out = measure.pivot_threads(rows, "event_type")
    return out.select("event_type", *[F.col(str(t)).alias(f"t{t}") for t in measure.THREADS])


@query("SELECT event_id, event_type, value, 'new' AS src FROM events WHERE event_id % 2 = 0 AND event_type = 'signup' UNION ALL SELECT event_id, event_type, value, 'old' FROM events WHERE event_id % 2 = 1 AND event_type <> 'signup'")
def bench_merge_results(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return measure.merge_results(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), F.col("event_type") == "signup")


@query("""SELECT event_id, event_type AS store, 'v' || user_id % 3 AS variant, CASE WHEN user_id % 2 = 0 THEN 'Get' ELSE 'Scan' END AS op, 'Hit' AS mode, 'Zipf' AS dist,
    CASE WHEN user_id % 5 = 0 THEN '8B' ELSE '1KB' END AS value, (user_id % 4 + 1)::INT AS threads FROM events""")
def bench_name_parse(spark, d):
    size = F.when(F.col("user_id") % 5 == 0, "8B").otherwise("1KB_20__8B_")
    name = measure.compose_name(F.col("event_type"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")), F.when(F.col("user_id") % 2 == 0, "Get").otherwise("Scan"), F.lit("Hit"), F.lit("Zipf"), size, F.col("user_id") % 4 + 1)
    rows = table(spark, d, "events").select("event_id", name.alias("name"))
    return rows.select("event_id", *measure.name_parts(F.col("name"))).withColumn("value", measure.value_label(F.col("value")))


@query("""WITH l AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
    d AS (SELECT b.event_id, count(DISTINCT a.user_id) AS n FROM l b LEFT JOIN l a ON a.event_id > b.p AND a.event_id < b.event_id WHERE b.p IS NOT NULL GROUP BY 1)
    SELECT (SELECT count(*) FROM events) AS accesses, count(*) FILTER (n < 50) AS hits FROM d""")
def lru_hit_rate(spark, d):
    return measure.lru_hits(table(spark, d, "events"), 50, "event_id", "user_id")


_NAMED = "e AS (SELECT *, 'Store=' || event_type || '/Variant=v' || user_id % 3 || '/Op=' || CASE WHEN user_id % 2 = 0 THEN 'Get' ELSE 'Scan' END || '/Mode=Hit/Dist=Zipf/Value=' || CASE WHEN user_id % 5 = 0 THEN '8B' ELSE '1KB_20__8B_' END || '/real_time/threads:' || user_id % 4 + 1 AS name FROM events)"


def _named(spark, d):
    size = F.when(F.col("user_id") % 5 == 0, "8B").otherwise("1KB_20__8B_")
    name = measure.compose_name(F.col("event_type"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")), F.when(F.col("user_id") % 2 == 0, "Get").otherwise("Scan"), F.lit("Hit"), F.lit("Zipf"), size, F.col("user_id") % 4 + 1)
    return table(spark, d, "events").withColumn("name", name)


@query(f"""WITH {_NAMED} SELECT event_id, event_type IN ('click', 'error') AND user_id % 5 = 0 AS small, event_type = 'click' AND user_id % 2 = 0 AND user_id % 4 = 0 AS priming,
    event_type = 'click' AND user_id % 3 = 1 AND user_id % 2 = 0 AND user_id % 5 = 0 AND user_id % 4 = 0 AS quick FROM e""")
def bench_matrix_filters(spark, d):
    name = F.col("name")
    return _named(spark, d).select(
        "event_id", measure.matrix_filter(name, ["click", "error"], "8B").alias("small"), measure.priming_filter(name, ["click"]).alias("priming"), measure.quick_filter(name, "click", "v1").alias("quick")
    )


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'plain' ELSE '+filter' END AS label FROM events WHERE event_type = 'click' AND user_id % 3 = 0 OR event_type = 'signup' AND user_id % 3 = 1")
def bench_labels(spark, d):
    rows = _named(spark, d).select("event_id", *measure.name_parts(F.col("name")))
    return measure.labelled(rows, {("click", "v0"): "plain", ("signup", "v1"): "+filter"}).select("event_id", "label")


_FILES = "n AS (SELECT event_id, 'results_' || user_id % 4 AS file, event_type, value FROM events WHERE user_id % 4 < 3), o AS (SELECT event_id + 1000000 AS event_id, 'results_' || user_id % 4 AS file, event_type, value FROM events WHERE user_id % 4 > 0)"


def _runs(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("f"), "event_type", "value")
    name = lambda folder, end: F.concat(F.lit(f"/{folder}/results_"), F.col("f").cast("string"), F.lit(f"{end}.json"))
    return rows.where("f < 3").select("event_id", name("new", "_native").alias("file"), "event_type", "value"), rows.where("f > 0").select((F.col("event_id") + 1000000).alias("event_id"), name("old", "").alias("file"), "event_type", "value")


@query(f"""WITH {_FILES} SELECT event_id, file, event_type, value, 'new' AS src FROM n WHERE event_type = 'signup' AND file IN (SELECT file FROM o)
    UNION ALL SELECT event_id, file, event_type, value, 'old' FROM o WHERE event_type <> 'signup' AND file IN (SELECT file FROM n)""")
def bench_merge_files(spark, d):
    return measure.merge_files(*_runs(spark, d), F.col("event_type") == "signup", "_native")


@query(f"""WITH {_FILES} SELECT coalesce(a.file, b.file) AS file, coalesce(stray, 0)::BIGINT AS stray, coalesce(rivals, 0)::BIGINT AS rivals, a.file IS NOT NULL AND b.file IS NOT NULL AS in_both
    FROM (SELECT file, count(*) FILTER (event_type <> 'signup') AS stray FROM n GROUP BY 1) a FULL JOIN (SELECT file, count(*) FILTER (event_type <> 'signup') AS rivals FROM o GROUP BY 1) b USING (file)""")
def bench_merge_warnings(spark, d):
    return measure.merge_warnings(*_runs(spark, d), F.col("event_type") == "signup", "_native")


@query("SELECT DISTINCT (user_id % 4 + 1)::INT AS threads FROM events")
def bench_thread_counts(spark, d):
    return measure.thread_counts(_named(spark, d).select(*measure.name_parts(F.col("name"))))


@query("""SELECT event_type, '{' || string_agg('"' || g || '":' || n, ',' ORDER BY g) || '}' AS entries FROM (SELECT event_type, 'u' || user_id % 10 AS g, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def bench_nested(spark, d):
    rows = table(spark, d, "events").groupBy("event_type", F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("g")).agg(F.count("*").alias("n"))
    return measure.nested(rows, "event_type", "g", "n").select("event_type", F.to_json("entries").alias("entries"))


@query(f"""WITH {_NAMED} SELECT event_type AS store, 'v' || user_id % 3 AS variant, CASE WHEN user_id % 2 = 0 THEN 'Get' ELSE 'Scan' END AS op, CASE WHEN user_id % 5 = 0 THEN '8B' ELSE '1KB' END AS value, (user_id % 4 + 1)::INT AS threads, max(value) AS items_per_second
    FROM e GROUP BY ALL""")
def bench_result_file(spark, d):
    """Written as a result file, read back and parsed."""
    path = f"{scratch_dir(spark, 'results')}/results.json"
    cells = _named(spark, d).groupBy("name").agg(F.max("value").alias("items_per_second"))
    cells.agg(F.collect_list(F.struct("name", "items_per_second")).alias("benchmarks")).write.json(path)
    return results.read_benchmarks(spark, path).select("store", "variant", "op", measure.value_label(F.col("value")).alias("value"), "threads", "items_per_second")


@query("SELECT event_type AS store, (user_id % 30)::INT AS sec, count(*) AS scan_ops, count(*) FILTER (value > 50) AS insert_ops FROM events GROUP BY 1, 2")
def bench_timeline_file(spark, d):
    path = scratch_dir(spark, "timelines")
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("store"), (F.col("user_id") % 30).cast("int").alias("sec")).agg(F.count("*").alias("scan_ops"), F.count_if(F.col("value") > 50).alias("insert_ops"))
    results.write_timeline(counts, path, "store")
    return results.read_timelines(spark, path).select("store", "sec", "scan_ops", "insert_ops")


@query("SELECT event_type AS scenario, user_id % 2 = 0 AS timed_out, count(*) AS key_count, max(value) AS elapsed_sec, CASE WHEN user_id % 2 = 0 THEN '≥' || floor(max(value))::BIGINT || 's (timeout)' ELSE printf('%.2fs', max(value)) END AS label FROM events GROUP BY 1, user_id % 2")
def bench_probe_lines(spark, d):
    path = scratch_dir(spark, "probes")
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("scenario"), (F.col("user_id") % 2 == 0).alias("timed_out")).agg(F.count("*").alias("key_count"), F.max("value").alias("elapsed_sec"))
    results.write_lines(rows, path)
    return measure.probe_points(results.read_probes(spark, path)).select("scenario", "timed_out", "key_count", "elapsed_sec", codec.timeout_text(F.col("elapsed_sec"), F.col("timed_out")).alias("label"))


@query("SELECT event_type AS method, 'u' || user_id % 5 AS metric, max(value) AS value FROM events GROUP BY 1, 2")
def bench_micro_file(spark, d):
    path = scratch_dir(spark, "micro")
    results.write_micro(table(spark, d, "events").groupBy(F.col("event_type").alias("method"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("metric")).agg(F.max("value").alias("value")), path)
    return results.read_micro(spark, path).select("method", "metric", "value")


# ---------------------------------------------------------------- workloads


@query("SELECT o_orderkey, greatest(1, 1048576 // (16 + 8 * (o_custkey % 200))) * (16 + 8 * (o_custkey % 200)) AS bytes FROM orders")
def workload_corpus_bytes(spark, d):
    size = 8 * (F.col("o_custkey") % 200)
    keys = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(1 << 20) / (size + 16)).cast("long"))
    return table(spark, d, "orders").select("o_orderkey", workload.corpus_bytes(keys, size).alias("bytes"))


@query("SELECT i AS seq, 'delete' AS op, printf('k%015x', i) AS key, (i % 7)::INT AS thread FROM range((SELECT count(*) FROM orders)) t(i)")
def workload_deletes(spark, d):
    n = table(spark, d, "orders").count()
    return workload.deletes(spark, n, 7).select("seq", "op", F.decode("key", "UTF-8").alias("key"), "thread")


@query("""WITH e AS (SELECT event_id % 20 = 19 AS ins, (event_id % 2147483648) * 2654435761 % (SELECT max(o_orderkey) + 1 FROM orders) AS start FROM events),
    s AS (SELECT start, count(*) AS c FROM e WHERE NOT ins GROUP BY 1)
    SELECT 'insert' AS op, count(*) AS n, 0::BIGINT AS delivered FROM e WHERE ins
    UNION ALL SELECT 'scan', (SELECT count(*) FROM e WHERE NOT ins), (SELECT sum(c)::BIGINT FROM s JOIN orders ON o_orderkey BETWEEN start AND start + 99)""")
def workload_ycsb_e(spark, d):
    """Starts are spread over all keys of orders by a multiplicative hash, so that the SQL twin can draw the same ones."""
    orders = table(spark, d, "orders")
    events = table(spark, d, "events").crossJoin(F.broadcast(orders.agg((F.max("o_orderkey") + 1).alias("_keys"))))  # one row
    start = F.col("event_id") % 2147483648 * 2654435761 % F.col("_keys")
    e = events.select(F.when(F.col("event_id") % 20 == 19, "insert").otherwise("scan").alias("op"), start.alias("start"))
    asked = e.where("op = 'scan'").groupBy("start").agg(F.count("*").alias("c"))
    found = reads.range_probe(asked, orders, "o_orderkey").join(asked, "start").agg(F.lit("scan").alias("op"), F.sum(F.col("c") * F.col("n")).alias("delivered"))
    return e.groupBy("op").agg(F.count("*").alias("n")).join(found, "op", "left").select("op", "n", F.coalesce("delivered", F.lit(0)).cast("long").alias("delivered"))


@query("SELECT (CASE WHEN o_orderkey % 5 = 0 THEN 8 ELSE 1024 END)::INT AS size, count(*) AS n FROM orders GROUP BY 1")
def workload_value_sizes(spark, d):
    return table(spark, d, "orders").groupBy(codec.value_size(F.col("o_orderkey"), 1024).alias("size")).agg(F.count("*").alias("n"))


@query("SELECT i, printf('k%015x', i) AS key, (CASE WHEN i % 5 = 0 THEN 8 ELSE 64 END)::INT AS bytes FROM range((SELECT count(*) FROM orders)) t(i)")
def workload_populate(spark, d):
    """A corpus as large as orders, in a seeded order."""
    rows = workload.shuffled(workload.corpus(spark, table(spark, d, "orders").count(), 64))
    return rows.select("i", F.decode("key", "UTF-8").alias("key"), F.octet_length("value").alias("bytes"))


@query("SELECT i AS seq, 'insert' AS op, printf('k%015x', i + (SELECT count(*) FROM orders)) AS key FROM range((SELECT count(*) FROM events)) t(i)")
def workload_inserts(spark, d):
    """As many new keys as events, from the first one that orders leave."""
    rows = workload.inserts(spark, table(spark, d, "orders").count(), table(spark, d, "events").count(), 64)
    return rows.select("seq", "op", F.decode("key", "UTF-8").alias("key"))


@query("""SELECT 'hit' AS kind, count(*) AS asked, count(*) AS found FROM events UNION ALL SELECT 'miss', count(*), 0 FROM events
    UNION ALL SELECT 'scan', count(*), count(*) FROM events UNION ALL SELECT 'churn', count(*) // 2, count(*) // 2 FROM orders""")
def workload_lookups(spark, d):
    """Drawn keys are in the corpus or beyond it, as the workload says, and scans end within it."""
    n, count = table(spark, d, "orders").count(), table(spark, d, "events").count()
    corpus = workload.corpus(spark, n, 8).select("i", "key")
    drawn = workload.hits(spark, count, n).withColumn("kind", F.lit("hit")).union(workload.misses(spark, count, n).withColumn("kind", F.lit("miss")))
    drawn = drawn.unionByName(workload.churn(spark, n, 0.5, target=8).select("key", F.lit("churn").alias("kind")))
    starts = workload.scans(spark, count, n).select(F.lit("scan").alias("kind"), F.col("start").between(0, n - 1).alias("there"))
    found = drawn.join(corpus, "key", "left").select("kind", F.col("i").isNotNull().alias("there")).union(starts)
    return found.groupBy("kind").agg(F.count("*").alias("asked"), F.sum(F.col("there").cast("long")).alias("found"))


@query("""WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS deleted, sum(event_id % 97) AS bytes, count(DISTINCT event_type) AS keys FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN n >= 0.95 * 40 OR keys >= 0.9 * 8 THEN 'hard' WHEN n >= 20 THEN 'soft' WHEN user_id % 2 = 0 AND n >= 12 THEN 'scan' WHEN deleted >= 0.25 * n THEN 'deletes' WHEN bytes >= 400 THEN 'log' WHEN keys >= 4 THEN 'tail' END AS why FROM g""")
def compact_policy(spark, d):
    """Why each of many logs, one a user, should be folded into its base."""
    policy = compaction.CompactionPolicy(capacity=40, delete_share=0.25, log_bytes=400, scan_rows=12, tail_capacity=8)
    logs = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("deleted"), F.sum(F.col("event_id") % 97).alias("bytes"), F.countDistinct("event_type").alias("keys"))
    return logs.select("user_id", policy.reason(F.col("n"), F.col("deleted"), F.col("bytes"), F.col("user_id") % 2 == 0, F.col("keys")).alias("why"))


# ---------------------------------------------------------------- store and streams


@query(f"""WITH r AS (SELECT event_id AS lsn, {OP_SQL} AS op, user_id * 7 AS key, event_id AS value, user_id * 7 IN (SELECT o_orderkey FROM orders) AS known FROM events),
    e AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('insert', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'insert', known) AS found FROM r),
    v AS (SELECT lsn, op, key, value FROM e WHERE CASE WHEN op = 'insert' THEN NOT found ELSE found END UNION ALL SELECT -1, 'insert', o_orderkey, o_custkey FROM orders)
    SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS n FROM v) WHERE n = 1 AND op <> 'delete'""")
def store_lifecycle(spark, d):
    """Bulk load, apply requests, checkpoint, open again, read all."""
    store = _filled(spark, d)
    store.checkpoint()
    return _decoded(KeyedStore(spark, store.path))


def _filled(spark, d) -> KeyedStore:
    """A new store: orders loaded into its snapshot, events applied and in the log."""
    store = KeyedStore(spark, scratch_dir(spark, "store"))
    store.bulk_load(table(spark, d, "orders").select(codec.int_key(F.col("o_orderkey")).alias("key"), codec.int_value(F.col("o_custkey")).alias("value")))
    asked = table(spark, d, "events").select(F.col("event_id").alias("seq"), operation().alias("op"), codec.int_key(F.col("user_id") * 7).alias("key"), codec.int_value(F.col("event_id")).alias("value"))
    store.apply(asked)
    return store


def _decoded(store: KeyedStore) -> DataFrame:
    return store.state().select(codec.decode_int_key(F.col("key")).alias("key"), codec.decode_int_value(F.col("value")).alias("value"))


@query(SQL["store_lifecycle"])
def store_clone(spark, d):
    """Snapshot by reference and the log's tail: a clone reads like its origin, whose content is verified."""
    store = _filled(spark, d)
    store.verify()
    return _decoded(store.clone(scratch_dir(spark, "clone")))


@query(f"SELECT count(*) AS n, sum(value)::BIGINT AS total FROM ({SQL['store_lifecycle']})")
def store_fold(spark, d):
    """A fold over a scan of all keys of a store that was opened again without a checkpoint."""
    store = KeyedStore(spark, _filled(spark, d).path)
    return store.scan(b"", b"\xff" * 16, fold=F.struct(F.count("*").alias("n"), F.sum(codec.decode_int_value(F.col("value"))).alias("total")).alias("f")).select("f.*")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; a glob, since a single file may stand in a folder's place."""
    return spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query(SQL["log_latest_state"])
def stream_state_final(spark, d):
    path = scratch_dir(spark, "stream")
    state = replay.MergedState(spark, f"{path}/state", "key", "value")
    replay.merge_stream(requests(event_stream(spark, d)), state, f"{path}/checkpoint")
    return state.read().select("key", "value", "lsn")


@query(SQL["log_latest_state"])
def stream_keyed_state(spark, d):
    """Replay by Spark's state store; the last row of each key is its state."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        path = scratch_dir(spark, "keyed")
        replay.to_files(replay.keyed_state(requests(event_stream(spark, d))), path, "Update")
    finally:
        spark.conf.set(provider, before)
    return replay.latest(spark, path).select("key", "value", "lsn")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    counts = replay.tumbling(event_stream(spark, d), "ts", "1 hour", "event_type")
    name = "w" + scratch_dir(spark, "w").rpartition("-")[2]
    return replay.to_memory(counts, name).select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n")
