"""Compaction of a base snapshot with newer deltas, and the measures that tell when it is due."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec


def merge(base: DataFrame, *deltas: DataFrame, column: str = "key") -> DataFrame:
    """Newest version of each key over (key, value, is_delete, lsn) parts; tombstones win first and then go.

    Union and one aggregation: one shuffle, in place of a full outer join for each delta.  Value and flag are picked by
    two aggregates over the same lsn, so fixed-width values are aggregated by hash and not by sort; of rows that tie in
    key and lsn, which are deliveries of one record, one is picked.
    """
    rows = base
    for d in deltas:
        rows = rows.unionByName(d)
    newest = rows.groupBy(column).agg(F.max_by("value", "lsn").alias("value"), F.max_by("is_delete", "lsn").alias("_gone"), F.max("lsn").alias("lsn"))
    return newest.where(~F.col("_gone")).select(column, "value", "lsn")


def without_deleted(base: DataFrame, tombstones: DataFrame, column: str = "key") -> DataFrame:
    return base.join(tombstones.select(column), column, "left_anti")


def candidates(index: DataFrame, durable: DataFrame, boundary) -> DataFrame:
    """Index entries (hash, offset, is_delete) whose values still have to be copied.

    Live, not inline, at or above the boundary up to which values are durable, and not among the offsets made durable since.
    """
    open_ = index.where(~F.col("is_delete") & ~codec.is_inline(F.col("hash")) & (F.col("offset") >= boundary))
    return open_.join(durable.select("offset"), "offset", "left_anti")


def rewritten(merged: DataFrame, mapper: Callable[[DataFrame], DataFrame], column: str = "key") -> DataFrame:
    """Merged rows through a caller's mapper, which may change values but neither keys nor columns (ValueError)."""
    out = mapper(merged)
    if out.columns != merged.columns or dict(out.dtypes)[column] != dict(merged.dtypes)[column]:
        raise ValueError("a mapper must leave keys and columns as they are")
    return out


def write_final(merged: DataFrame, writer: Callable[[DataFrame], None], column: str = "key") -> None:
    """Hand the final rows, range-partitioned and sorted by key, to a caller's writer."""
    writer(merged.repartitionByRange(column).sortWithinPartitions(column))


def restamp(entries: DataFrame, generation) -> DataFrame:
    """New generation on every entry that points into the value file."""
    return entries.withColumn("generation", F.when(codec.is_inline(F.col("hash")), F.col("generation")).otherwise(F.lit(generation)))


def adjacent_duplicates(state: DataFrame, column: str = "key") -> DataFrame:
    """One row: how many keys equal their predecessor in key order (0 for sound state).

    Equal keys are neighbours in any order that groups them, so counts by key tell; they are partial before the shuffle.
    """
    return state.groupBy(column).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def zone_map(state: DataFrame, zone: Column, column: str = "key") -> DataFrame:
    return state.groupBy(zone.alias("zone")).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n"))


def stripe_pressure(rows: DataFrame, hash_: Column, is_delete: Column, least: float = 0.0) -> DataFrame:
    """(stripe, live, deleted, ratio) of stripes whose deleted share reaches ``least``."""
    out = rows.groupBy(codec.stripe(hash_).alias("stripe")).agg(F.sum(F.when(is_delete, 0).otherwise(1)).alias("live"), F.sum(F.when(is_delete, 1).otherwise(0)).alias("deleted"))
    return out.withColumn("ratio", F.col("deleted") / (F.col("live") + F.col("deleted"))).where(F.col("ratio") >= least)


def live_bytes(rows: DataFrame, key_bytes: Column, value_bytes: Column, inline: Column) -> DataFrame:
    """One row: aligned bytes of the records that are not inline, and their number."""
    length = codec.blocks(codec.record_length(key_bytes, value_bytes)) * codec.BLOCK
    return rows.agg(F.coalesce(F.sum(F.when(~inline, length)), F.lit(0)).cast("long").alias("live_bytes"), F.sum(F.when(~inline, 1).otherwise(0)).cast("long").alias("records"))


def space_amplification(versions: DataFrame, column: str, key_bytes: Column, value_bytes: Column) -> DataFrame:
    """One row: bytes of all versions, of the newest ones, and their ratio."""
    sized = versions.select(column, "lsn", (codec.blocks(codec.record_length(key_bytes, value_bytes)) * codec.BLOCK).alias("bytes"))
    each = sized.groupBy(column).agg(F.sum("bytes").alias("all"), F.max_by("bytes", "lsn").alias("live"))
    return each.agg(F.sum("all").cast("long").alias("total_bytes"), F.sum("live").cast("long").alias("live_bytes")).withColumn("amplification", F.col("total_bytes") / F.col("live_bytes"))


@dataclass(frozen=True)
class CompactionPolicy:
    """When a delta is folded into the base.  Fixed defaults: capacity, soft and hard shares, delete share, log bytes."""

    capacity: int = 1 << 22
    soft: float = 0.5
    hard: float = 0.95
    delete_share: float = 0.5
    log_bytes: int = 64 << 20
    scan_rows: int = 18_724
    tail_capacity: int = 1 << 20

    def _rules(self, delta_rows, deleted, log_bytes, scanning, tail_keys) -> list[tuple[str, object]]:
        """(reason, whether it holds), the first that holds counts; over numbers or over columns."""
        return [
            ("hard", (delta_rows >= self.hard * self.capacity) | (tail_keys >= 0.9 * self.tail_capacity)),
            ("soft", delta_rows >= self.soft * self.capacity),
            ("scan", scanning & (delta_rows >= self.scan_rows)),
            ("deletes", (delta_rows > 0) & (deleted >= self.delete_share * delta_rows)),
            ("log", log_bytes >= self.log_bytes),
            ("tail", tail_keys >= 0.5 * self.tail_capacity),
        ]

    def decide(self, delta_rows: int, deleted: int = 0, log_bytes: int = 0, scanning: bool = False, tail_keys: int = 0) -> str | None:
        """The reason to compact now, or None.  ``hard`` means writers wait."""
        return next((why for why, due in self._rules(delta_rows, deleted, log_bytes, scanning, tail_keys) if due), None)

    def reason(self, delta_rows: Column, deleted: Column, log_bytes: Column, scanning: Column, tail_keys: Column) -> Column:
        """:meth:`decide` for many stores, one a row."""
        return F.coalesce(*[F.when(due, why) for why, due in self._rules(delta_rows, deleted, log_bytes, scanning, tail_keys)])
