"""Request and change logs: outcomes, replay, cuts and validity.

A log is (lsn, op, key, value) with unique lsn and op in insert, update, delete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import codec
from ..sources.files import written
from . import reads


#: The range of lsns in which the records of one key are ordered by one task.
SPAN = 1 << 20


def _spanned(rows: DataFrame, column: str, span: int, ends: list[Column], carried: Callable[[WindowSpec], list[Column]]) -> tuple[DataFrame, WindowSpec]:
    """Rows and the window of a key's rows in lsn order, at most ``span`` lsns in one group whatever share of the rows a key has.

    Where the log is longer than ``span``, groups are (key, range of lsns).  ``ends`` sums up each, with partial sums;
    ``carried`` tells from a window over a key's earlier ranges what a range begins with, and that enters as a row with ``_mark``.
    """
    rows = rows.withColumn("_mark", F.lit(False))
    low, high = rows.agg(F.min("lsn"), F.max("lsn")).first()
    if low is None or high - low < span:
        return rows, Window.partitionBy(column).orderBy("lsn")
    rows = rows.withColumn("_span", F.floor(F.col("lsn") / span))
    ordered = Window.partitionBy(column).orderBy("_span")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(column, "_span").agg(*ends)
    marks = sums.select(column, "_span", *carried(before), F.lit(True).alias("_mark"), F.row_number().over(ordered).alias("_at")).where("_at > 1").drop("_at")
    return rows.unionByName(marks, allowMissingColumns=True), Window.partitionBy(column, "_span").orderBy(F.desc("_mark"), "lsn")


def outcomes(requests: DataFrame, existing: DataFrame | None = None, column: str = "key", reject: Column | None = None, span: int = SPAN) -> DataFrame:
    """Requests with ``exists_before`` and ``accepted``.

    Insert needs absence, update and delete need presence.  A rejected request never changes whether a key exists, so the
    last insert or delete before a request tells what it finds: windows, no loop, and no group of more than ``span`` requests.  ``existing`` keys count as inserted
    before all requests; requests for which ``reject`` holds are refused and without effect.
    """
    rows = requests.withColumn("_refused", F.coalesce(reject, F.lit(False)) if reject is not None else F.lit(False))
    if existing is not None:
        known = existing.select(column).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, column, "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("boolean"))
    rows = rows.withColumn("_event", F.when(F.col("op").isin("insert", "delete") & ~F.col("_refused"), F.col("op") == "insert"))
    last = F.max_by("_event", F.when(F.col("_event").isNotNull(), F.col("lsn"))).alias("_event")
    rows, w = _spanned(rows, column, span, [last], lambda before: [F.last("_event", ignorenulls=True).over(before).alias("_event")])
    found = F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("exists_before", F.coalesce(found, F.col("_known"), F.lit(False))).where(~F.col("_mark"))
    rows = rows.withColumn("accepted", ~F.col("_refused") & F.when(F.col("op") == "insert", ~F.col("exists_before")).otherwise(F.col("exists_before")))
    return rows.select(*[F.col(f"`{c}`") for c in requests.columns], "exists_before", "accepted")


def sentinel_reject(column: str = "value") -> Column:
    return F.col("op").isin("insert", "update") & codec.is_sentinel(F.col(column))


def replay(log: DataFrame, *values: str, column: str = "key") -> DataFrame:
    """Live state of an accepted log: newest record of each key, deletes dropped after that.

    One aggregate a field over the same lsn: with fixed-width values that is a hash aggregate, and as it is partial, a hot key
    costs one row a task.
    """
    fields = values or ("value",)
    gone = F.max_by(F.col("op") == "delete", F.col("lsn")).alias("_gone")
    newest = log.groupBy(column).agg(gone, *[F.max_by(v, "lsn").alias(v) for v in fields], F.max("lsn").alias("lsn"))
    return newest.where(~F.col("_gone")).select(column, *fields, "lsn")


def replay_to(log: DataFrame, callback: Callable[[str, bytes, bytes | None, int], None]) -> None:
    """Call ``callback(op, key, value, lsn)`` in the executors for each record, in lsn order within ranges of the log."""

    def run(rows: Iterator) -> None:
        for r in rows:
            callback(r.op, r.key, r.value, r.lsn)

    log.select("lsn", "op", "key", "value").repartitionByRange("lsn").sortWithinPartitions("lsn").foreachPartition(run)


def upsert(log: DataFrame, *values: str, column: str = "key") -> DataFrame:
    """Bulk-load semantics: the newest record wins without any gating."""
    return replay(log, *values, column=column)


def as_of(log: DataFrame, cut) -> DataFrame:
    return log.where(F.col("lsn") <= cut)


def tail(log: DataFrame, checkpoint_lsn) -> DataFrame:
    """Records after a checkpoint: rotation keeps these, replay needs only these."""
    return log.where(F.col("lsn") > checkpoint_lsn)


def changed_keys(log: DataFrame, checkpoint_lsn, column: str = "key") -> DataFrame:
    return tail(log, checkpoint_lsn).select(column).distinct()


def resolve_changed(log: DataFrame, state: DataFrame, checkpoint_lsn, column: str = "key") -> DataFrame:
    """Changed keys with their current state; null where the key is gone."""
    return changed_keys(log, checkpoint_lsn, column).join(state, column, "left")


def versions(log: DataFrame, value: str = "value", column: str = "key", span: int = SPAN) -> DataFrame:
    """Each record with the value before it and its version number; see :func:`_spanned` for keys with many versions."""
    ends = [F.max_by(value, "lsn").alias(value), F.count("*").alias("_n")]
    rows, w = _spanned(log.withColumn("_n", F.lit(None).cast("long")), column, span, ends, lambda before: [F.last(value).over(before).alias(value), (F.sum("_n").over(before) - 1).alias("_n")])
    number = F.row_number().over(w) + F.coalesce(F.first("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("version", number.cast("long")).where(~F.col("_mark")).drop("_n", "_mark", "_span")


def deltas(value: str, order: str, by: list[str] | None = None) -> Column:
    """value - previous value of a counter, for groups small enough for one task each; see :func:`counter_deltas`."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    return F.col(value) - F.lag(value).over(w)


def counter_deltas(rows: DataFrame, value: str, order: str, *by: str, name: str = "delta") -> DataFrame:
    """``rows`` with value - previous value of the group's counter, for groups of any size.

    Rows lie in order of (group, order) over many partitions; the last row of each partition is carried to the next one.
    """
    stored = reads.placed(rows, *by, order)
    stored = written(stored, "deltas").withColumn(reads.PART, F.shiftright(reads.AT, 33))
    last = stored.groupBy(reads.PART).agg(F.max_by(F.struct(*by, F.col(value).alias("_value")), reads.AT).alias("__end"))
    carried = last.select(reads.PART, F.lag("__end").over(Window.orderBy(reads.PART)).alias("__carried"))  # one row a partition
    here = F.lag(F.struct(*by, F.col(value).alias("_value"))).over(Window.partitionBy(reads.PART).orderBy(reads.AT))
    out = stored.withColumn("__here", here).join(F.broadcast(carried), reads.PART).withColumn("__before", F.coalesce("__here", "__carried"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__before.{c}"))
    return out.withColumn(name, F.col(value) - F.when(same, F.col("__before._value"))).drop(reads.AT, reads.PART, "__here", "__carried", "__before")


def with_checksum(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", codec.record_checksum(F.col("lsn"), F.col("op"), F.col("key"), F.col("value")))


def is_valid() -> Column:
    """A record's stored checksum and shape hold."""
    good = F.col("op").isin("insert", "update", "delete") & F.col("key").isNotNull() & (F.col("crc") == codec.record_checksum(F.col("lsn"), F.col("op"), F.col("key"), F.col("value")))
    return F.coalesce(good, F.lit(False))


def valid_prefix(log: DataFrame, bad: Column) -> DataFrame:
    """Records before the first bad one, even if good ones follow it."""
    cut = log.where(bad).agg(F.min("lsn").alias("__cut"))  # one row
    return log.join(F.broadcast(cut), F.col("__cut").isNull() | (F.col("lsn") < F.col("__cut"))).drop("__cut")


def next_lsn(log: DataFrame) -> int:
    last = log.agg(F.max("lsn")).first()[0]
    return 1 if last is None else last + 1


def bounds(log: DataFrame, bad: Column) -> tuple[int | None, int]:
    """(lsn of the first bad record, next lsn after the records before it); one pass where no record is bad."""
    first, last = log.agg(F.min(F.when(bad, F.col("lsn"))), F.max("lsn")).first()
    return (None, 1 if last is None else last + 1) if first is None else (first, next_lsn(log.where(F.col("lsn") < first)))


def op_counts(log: DataFrame) -> DataFrame:
    """(op, n, share) of a log."""
    total = log.agg(F.count("*").alias("all"))
    return log.groupBy("op").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("op", "n", (F.col("n") / F.col("all")).alias("share"))


def deduplicated(log: DataFrame) -> DataFrame:
    """Records delivered again count once."""
    return log.dropDuplicates(["lsn"])
