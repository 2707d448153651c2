"""Point and range reads over keyed state (any DataFrame with a key column).

Keys compare as unsigned bytes; Parquet statistics, Bloom filters and range-partitioned files prune what a filter on the
raw key column lets them.  Bounds are inclusive and an inverted range is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..sources.files import written

AT, PART, SHIFT = "__at", "__part", "__shift"


def get(state: DataFrame, key, column: str = "key") -> DataFrame:
    """The row of one key, or none."""
    return state.where(F.col(column) == F.lit(key))


def get_by_prefix_hash(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Index entries of requested (prefix, hash) pairs: the index holds no whole keys, and both columns decide."""
    return requests.join(index, ["prefix", "hash"], "inner")


def multi_get(requests: DataFrame, state: DataFrame, on: str) -> DataFrame:
    """State of every requested key that exists; Catalyst broadcasts whichever side is small enough."""
    return requests.join(state, on, "inner")


def get_miss(requests: DataFrame, state: DataFrame, on: str) -> DataFrame:
    """Requests whose key does not exist."""
    return requests.join(state, on, "left_anti")


def exists(requests: DataFrame, state: DataFrame, on: str) -> DataFrame:
    return requests.join(state, on, "left_semi")


def scan(state: DataFrame, low, high, column: str = "key", ordered: bool = True) -> DataFrame:
    """Rows with low <= key <= high, ascending."""
    rows = state.where(F.col(column).between(F.lit(low), F.lit(high)))
    return rows.orderBy(column) if ordered else rows


def prefix_scan(state: DataFrame, low: str, high: str, column: str = "key", length: int = 16) -> DataFrame:
    """Range scan with a coarse condition on the first bytes before the exact one; both reach the files."""
    return scan(state.where(F.substring(F.col(column), 1, length).between(low[:length], high[:length])), low, high, column)


def scan_count(state: DataFrame, low, high, column: str = "key") -> DataFrame:
    return scan(state, low, high, column, ordered=False).agg(F.count("*").alias("n"))


def scan_limit(state: DataFrame, start, n: int = 100, column: str = "key") -> DataFrame:
    """The n smallest keys >= start: a top-k in each task, then one of k rows a task."""
    return state.where(F.col(column) >= F.lit(start)).orderBy(column).limit(n)


def after(state: DataFrame, last, n: int = 100, column: str = "key") -> DataFrame:
    """The page that follows a key."""
    return state.where(F.col(column) > F.lit(last)).orderBy(column).limit(n)


def placed(df: DataFrame, *order: str) -> DataFrame:
    """Rows range-partitioned and sorted, with partition and place in ``AT``.

    To be written before it is used: bounds are sampled and partitions coalesced for each evaluation, so two evaluations
    needn't agree on where a row lies.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())


def positions(stored: DataFrame, name: str = "position") -> DataFrame:
    """Dense numbers from 1 in the order in which :func:`placed` rows were written; only one count a partition meets in one place."""
    sizes = stored.groupBy(F.shiftright(AT, 33).alias(PART)).agg(F.count("*").alias("_n"), F.min(AT).alias("_low"))
    shift = sizes.select(PART, (F.sum("_n").over(Window.orderBy(PART)) - F.col("_n") - F.col("_low") + 1).alias(SHIFT))
    # one row a partition
    return stored.withColumn(PART, F.shiftright(AT, 33)).join(F.broadcast(shift), PART).withColumn(name, (F.col(AT) + F.col(SHIFT)).cast("long")).drop(AT, PART, SHIFT)


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Dense numbers from 1 in the given order, without bringing all rows into one task.

    The ordered rows are written to shared storage once, and what was written is counted and numbered.
    """
    return positions(written(placed(df, *order), "numbered"), name)


def paginate(state: DataFrame, size: int = 100, column: str = "key") -> DataFrame:
    """(page, rows, first, last) of consecutive pages in key order."""
    rows = numbered(state.select(column), column)
    page = F.floor((F.col("position") - 1) / size).cast("long").alias("page")
    return rows.groupBy(page).agg(F.count("*").alias("n"), F.min(column).alias("first_key"), F.max(column).alias("last_key"))


def range_probe(probes: DataFrame, state: DataFrame, column: str, length: int = 100) -> DataFrame:
    """(start, n, low, high) of the keys in start .. start+length-1 for every probe over integer keys.

    A range of ``length`` keys touches two blocks of that width, so each probe is two rows of an equi-join on the block, and
    no range join is planned.  Probes without a key are left out.
    """
    block = F.floor(F.col("start") / length)
    wanted = probes.select("start", F.explode(F.array(block, block + 1)).alias("_block"))
    keys = state.select(F.col(column).alias("_key"), F.floor(F.col(column) / length).alias("_block"))
    found = wanted.join(keys, "_block").where((F.col("_key") >= F.col("start")) & (F.col("_key") < F.col("start") + length))
    return found.groupBy("start").agg(F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"))


def dereference(index: DataFrame, values: DataFrame) -> DataFrame:
    """Index entries joined to value records on (generation, offset); entries of another generation find nothing."""
    return index.join(values, ["generation", "offset"], "inner")


def covered(index: DataFrame, values: DataFrame) -> DataFrame:
    """Every index entry with its ``value``: small ones lie in the index (``small_value``), only the others' records are looked up.

    An entry without a record of its generation finds nothing, like in :func:`dereference`.
    """
    small = codec.is_inline(F.col("hash"))
    far = dereference(index.where(~small).drop("small_value"), values)
    return index.where(small).drop("offset", "generation").withColumnRenamed("small_value", "value").unionByName(far.drop("offset", "generation"))


def fold_values(state: DataFrame, expr: Column) -> DataFrame:
    """A fold over a scan's rows, as one aggregate expression."""
    return state.agg(expr)
