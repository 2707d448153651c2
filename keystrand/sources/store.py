"""A keyed store in a directory: immutable base snapshots, an append-only change log, and a manifest that commits.

Layout: ``base/v=N`` (Parquet, range-partitioned and sorted by key, Bloom filter on the key), ``log/a=N`` (accepted records
with checksums; a batch counts once its commit marker is there), ``manifest/N.json``.  State is the manifest's base and the
log above its checkpoint LSN, newest wins.  Order of a checkpoint: new base, then manifest, then log rotation; a crash in
between loses nothing, as replay is idempotent.  The log ends at its first damaged record; the next append cuts it there.
After a failed append this object refuses all writes, since it can't tell what reached the disk; a new one looks there.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import changes, compaction, reads
from ..plans.config import EngineConfig
from .files import Files

STATE = "key binary, value binary"
LOG = "lsn long, op string, key binary, value binary, crc string"


class Backend(Protocol):
    """What every backend offers: this store, and rivals that serve as second implementations."""

    def apply(self, requests: DataFrame) -> DataFrame: ...
    def get(self, key: bytes) -> bytes | None: ...
    def scan(self, low: bytes, high: bytes): ...
    def bulk_load(self, rows: DataFrame) -> None: ...


class StoreError(RuntimeError):
    """The directory's files contradict each other."""


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or EngineConfig()
        self.files = Files(spark, self.path)
        #: called by name between the steps of a checkpoint; tests put faults here
        self.hooks: dict[str, Callable[[], None]] = {}
        self.failure: Exception | None = None
        self.counters = {"compactions": 0, "checkpoints": 0, "stalls": 0}
        self.manifest = self._load()
        if not self.manifest["version"]:
            self._commit(None, 0, 0, "0")  # from now on a folder without a manifest is a damaged one

    # ---- manifest

    @staticmethod
    def _seal(m: dict) -> str:
        return hashlib.sha256(json.dumps({k: v for k, v in m.items() if k != "checksum"}, sort_keys=True).encode()).hexdigest()

    def _load(self) -> dict:
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        if not names:
            if self.files.names("base"):
                raise StoreError(f"{self.path} has snapshots but no manifest")
            return {"version": 0, "checkpoint_lsn": 0, "base": None, "rows": 0, "content": "0"}
        # the newest manifest decides; an unreadable one is never skipped
        try:
            m = json.loads(self.files.read(f"manifest/{names[-1]}"))
        except ValueError as e:
            raise StoreError(f"manifest {names[-1]} can't be read") from e
        if m.get("checksum") != self._seal(m):
            raise StoreError(f"manifest {names[-1]} is damaged")
        if m["base"] and not Files(self.spark, m["base"]).exists(""):
            raise StoreError(f"snapshot {m['base']} of manifest {names[-1]} is missing")
        return m

    def _commit(self, base: str | None, checkpoint_lsn: int, rows: int, content: str) -> None:
        m = {"version": self.manifest["version"] + 1, "checkpoint_lsn": checkpoint_lsn, "base": base, "rows": rows, "content": content}
        m["checksum"] = self._seal(m)
        self.files.publish(f"manifest/{m['version']:012d}.json", json.dumps(m))
        self.manifest = m

    def _writable(self) -> None:
        if self.failure is not None:
            raise StoreError("an append to the log has failed; open the store again") from self.failure

    def _hook(self, name: str) -> None:
        self.hooks.get(name, lambda: None)()

    # ---- reads

    def base(self) -> DataFrame:
        """The snapshot, checked against the manifest's schema."""
        at = self.manifest["base"]
        return self.spark.read.schema(STATE).parquet(at) if at else self.spark.createDataFrame([], STATE)

    def _batches(self) -> list[str]:
        """Committed batches of the log; a writer that died leaves a folder without the marker."""
        return [n for n in self.files.names("log") if self.files.exists(f"log/{n}/_SUCCESS")]

    def _records(self) -> DataFrame:
        """All committed records on disk, damaged and repeated ones too."""
        names = self._batches()
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/log/{n}" for n in names]) if names else self.spark.createDataFrame([], LOG)

    def log(self) -> DataFrame:
        """All records on disk before the first damaged one."""
        return changes.deduplicated(changes.valid_prefix(self._records(), ~changes.is_valid()))

    def _bounds(self) -> tuple[int | None, int]:
        """(lsn of the log's first damaged record, the next lsn to give)."""
        first, after = changes.bounds(self._records(), ~changes.is_valid()) if self._batches() else (None, 1)
        return first, max(after, self.manifest["checkpoint_lsn"] + 1)

    def delta(self) -> DataFrame:
        return changes.tail(self.log(), self.manifest["checkpoint_lsn"])

    def state(self) -> DataFrame:
        """Live (key, value)."""
        return self._state(changes.valid_prefix(self._records(), ~changes.is_valid())) if self._batches() else self.base()

    def _state(self, valid: DataFrame, of: DataFrame | None = None) -> DataFrame:
        """Base and the tail of ``valid`` records, newest wins; records met twice change nothing, so they need no pass of their own.

        ``of``: only these keys.  A small batch's keys are sent to the base's files, so the base isn't shuffled for it.
        """
        old = self.base().select("key", "value", F.lit(False).alias("is_delete"), F.lit(0).cast("long").alias("lsn"))
        new = changes.tail(valid, self.manifest["checkpoint_lsn"]).select("key", "value", (F.col("op") == "delete").alias("is_delete"), "lsn")
        if of is not None:
            old, new = reads.exists(old, of, "key"), reads.exists(new, of, "key")
        return compaction.merge(old, new).select("key", "value")

    def _decided(self, of: DataFrame | None = None) -> tuple[DataFrame, int, int | None]:
        """The state (of some keys), the next lsn and the log's first damaged lsn, from one look at which records hold."""
        if not self._batches():
            return self.base() if of is None else reads.exists(self.base(), of, "key"), self.manifest["checkpoint_lsn"] + 1, None
        bad, lsn = self._bounds()
        rows = self._records()
        return self._state(rows if bad is None else rows.where(F.col("lsn") < bad), of), lsn, bad

    def get(self, key: bytes) -> bytes | None:
        row = reads.get(self.state(), key).select("value").first()
        return None if row is None else bytes(row[0])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return reads.multi_get(keys, self.state(), "key")

    def scan(self, low: bytes, high: bytes, fold: Column | None = None) -> DataFrame:
        rows = reads.scan(self.state(), low, high, ordered=fold is None)
        return rows if fold is None else reads.fold_values(rows, fold)

    @staticmethod
    def _content() -> list[Column]:
        """Row count and content sum of (key, value) rows; neither depends on their order."""
        return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64("key", "value").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("content")]

    def verify(self) -> None:
        """The snapshot's rows and content against the manifest."""
        rows, content = self.base().agg(*self._content()).first()
        if rows != self.manifest["rows"]:
            raise StoreError(f"snapshot has {rows} rows, the manifest {self.manifest['rows']}")
        if content != self.manifest["content"]:
            raise StoreError("the snapshot's content is not what the manifest recorded")

    # ---- writes

    def _fence(self, bad: int) -> None:
        """Cut the log before its damaged record: records from there on were never part of the state and must not come to hide new ones.

        The sound records are written as one batch before the old batches go; a crash in between leaves both, which read the same.
        """
        old = self.files.names("log")
        sound = changes.deduplicated(self._records().where(F.col("lsn") < bad))
        sound.write.parquet(f"{self.path}/log/{self._next('c')}")
        self._hook("before_cut")
        for name in old:
            self.files.delete(f"log/{name}")

    def _next(self, kind: str) -> str:
        """A batch name that neither the log nor the outcomes have."""
        taken = [int(n.rpartition("=")[2]) for folder in ("log", "outcomes") for n in self.files.names(folder)]
        return f"{kind}={max(taken, default=-1) + 1:012d}"

    def apply(self, requests: DataFrame) -> DataFrame:
        """Apply requests (seq, op, key, value) in seq order; (seq, accepted).

        Only accepted records reach the log.  The outcomes are written once and numbered from what was written; StoreError if
        they are not as many as the requests, before any record reaches the log.
        """
        self._writable()
        before, lsn, bad = self._decided(requests.select("key").distinct())
        rows = requests.withColumnRenamed("seq", "lsn")
        done = changes.outcomes(rows, before, reject=changes.sentinel_reject() | (F.coalesce(F.octet_length("value"), F.lit(0)) > self.config.value_quota))
        batch = self._next("a")
        at = f"{self.path}/outcomes/{batch}"
        placed = reads.placed(done, "lsn")
        placed.write.parquet(at)
        done = self.spark.read.schema(placed.schema).parquet(at)
        asked, answered = requests.count(), done.count()
        if asked != answered:
            raise StoreError(f"{answered} answers to {asked} requests")
        done = reads.positions(done)
        log = done.where("accepted").select((F.col("position") + (lsn - 1)).alias("lsn"), "op", "key", F.when(F.col("op") != "delete", F.col("value")).alias("value"))
        try:
            if bad is not None:
                self._fence(bad)
            self._hook("before_log")
            changes.with_checksum(log).write.parquet(f"{self.path}/log/{batch}")
        except Exception as e:
            self.failure = e
            raise
        return done.select(F.col("lsn").alias("seq"), "accepted")

    def insert(self, key: bytes, value: bytes) -> bool:
        return self._one("insert", key, value)

    def update(self, key: bytes, value: bytes) -> bool:
        return self._one("update", key, value)

    def remove(self, key: bytes) -> bool:
        return self._one("delete", key, None)

    def _one(self, op: str, key: bytes, value: bytes | None) -> bool:
        rows = self.spark.createDataFrame([(1, op, bytearray(key), None if value is None else bytearray(value))], "seq long, op string, key binary, value binary")
        return self.apply(rows).first()[1]

    def _write_base(self, state: DataFrame) -> tuple[str, int, str]:
        """A new snapshot (path, rows, content), counted and summed as it is written."""
        taken = {int(n.removeprefix("v=")) for n in self.files.names("base")}
        path = f"{self.path}/base/v={max(taken, default=0) + 1}"
        n = self.config.partitions
        ordered = (state.repartitionByRange(n, "key") if n else state.repartitionByRange("key")).sortWithinPartitions("key")
        seen = Observation()
        writer = ordered.observe(seen, *self._content()).write
        if self.config.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.enable.dictionary#key", "false")
        writer.parquet(path)
        return path, seen.get["rows"], seen.get["content"]

    def bulk_load(self, rows: DataFrame) -> None:
        """Upsert (key, value) straight into a new snapshot: no log, no gating; of equal keys one row stays."""
        self._writable()
        state, lsn, _ = self._decided()
        old = state.select("key", "value", F.lit(False).alias("is_delete"), F.lit(0).cast("long").alias("lsn"))
        new = rows.select("key", "value", F.lit(False).alias("is_delete"), F.lit(1).cast("long").alias("lsn"))
        written = self._write_base(compaction.merge(old, new).select("key", "value"))
        self._commit(written[0], lsn - 1, *written[1:])

    def reorganize(self) -> None:
        """Fold the log's tail into a new snapshot; the log stays until a checkpoint rotates it."""
        self._writable()
        state, lsn, _ = self._decided()
        base, n, content = self._write_base(state)
        self._hook("before_manifest")
        self._commit(base, lsn - 1, n, content)
        self.counters["compactions"] += 1

    defragment = reorganize

    def checkpoint(self) -> None:
        """Reorganize, then drop log records the snapshot holds."""
        self.reorganize()
        self._hook("before_rotate")
        self.rotate()
        self.counters["checkpoints"] += 1

    def rotate(self) -> None:
        """Delete log batches that end at or below the checkpoint."""
        names = self._batches()
        if not names:
            return
        batch = F.regexp_extract(F.col("_metadata.file_path"), "/log/([^/]+)/", 1)
        last = dict(map(tuple, self._records().groupBy(batch).agg(F.max("lsn")).collect()))  # one row a batch
        for name in names:
            if last.get(name) is None or last[name] <= self.manifest["checkpoint_lsn"]:
                self.files.delete(f"log/{name}")

    def maintain(self, scanning: bool = False) -> str | None:
        """Compact if the policy asks for it; the reason."""
        n, deleted, keys = self.delta().agg(F.count("*"), F.coalesce(F.sum((F.col("op") == "delete").cast("int")), F.lit(0)), F.countDistinct("key")).first()
        why = self.config.policy.decide(n, deleted, self.log_bytes(), scanning, keys)
        if why:
            self.counters["stalls"] += why == "hard"
            self.checkpoint()
        return why

    def probe(self, kind: str, churn: DataFrame | None = None, limit: float = float("inf")) -> tuple[int, float, bool]:
        """Time one ``reorganize`` or ``checkpoint``: (keys, seconds, over the limit).

        Without ``churn`` the first one of a fresh corpus (bootstrap), else one after these requests were applied (steady).
        """
        if churn is not None:
            self.apply(churn)
        began = time.perf_counter()
        {"reorganize": self.reorganize, "checkpoint": self.checkpoint}[kind]()
        took = time.perf_counter() - began
        return self.manifest["rows"], took, took > limit

    def follow(self, requests: DataFrame, checkpoint: str) -> None:
        """Apply all available input of a streaming DataFrame of requests, batch by batch, with maintenance after each.

        A batch that comes again after a failure is applied again; requests are conditional, so the state ends the same.
        """

        def batch(rows: DataFrame, _: int) -> None:
            if not rows.isEmpty():
                self.apply(rows)
                self.maintain()

        requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    # ---- the rest

    def log_bytes(self) -> int:
        return self.files.size("log")

    def statistics(self) -> dict[str, int]:
        return {**self.counters, "version": self.manifest["version"], "rows": self.manifest["rows"], "log_bytes": self.log_bytes(), "base_bytes": Files(self.spark, self.manifest["base"]).size("") if self.manifest["base"] else 0}

    def clone(self, path: str) -> KeyedStore:
        """A store with this one's state: the snapshot by reference, as files are immutable, and a copy of the records above its checkpoint."""
        other = KeyedStore(self.spark, path, self.config)
        if self._batches():
            self.delta().write.parquet(f"{other.path}/log/{other._next('a')}")
        other._commit(self.manifest["base"], self.manifest["checkpoint_lsn"], self.manifest["rows"], self.manifest["content"])
        return other
