"""Workload generators: request streams and corpora as DataFrames, made where they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec


def corpus(spark: SparkSession, n: int, target: int = 1024) -> DataFrame:
    """(i, key, value) in ascending order; every fifth value has eight bytes."""
    i = F.col("id")
    return spark.range(n).select(i.alias("i"), codec.text(codec.formatted_key(i)).alias("key"), codec.scrambled_value(i, target).alias("value"))


def shuffled(rows: DataFrame, seed: int = 42) -> DataFrame:
    return rows.orderBy(F.rand(seed))


def uniform(n: int, seed: int) -> Column:
    return F.floor(F.rand(seed) * n).cast("long")


def zipf(n: int, seed: int) -> Column:
    """Index 0..n-1 with weight about 1/(index+1): the inverse of the continuous distribution function, n^u - 1."""
    return F.least(F.floor(F.pow(F.lit(float(n + 1)), F.rand(seed)) - 1), F.lit(n - 1)).cast("long")


def zipf_exact(spark: SparkSession, n: int, draws: int, seed: int, alpha: float = 1.0) -> DataFrame:
    """(draw, i) from the exact distribution of weight 1 / (i+1)**alpha over 0..n-1, by rejection-inversion: no table, whatever n is.

    A draw depends on its number and the seed alone.  Candidates come from the inverse of the integral of the weights, and a
    candidate is taken if it lies in its rank's own part; at least half of them do.
    """
    import numpy as np
    import pandas as pd

    def area(x):
        return np.log(x) if alpha == 1.0 else x ** (1 - alpha) / (1 - alpha)

    def back(y):
        return np.exp(y) if alpha == 1.0 else (y * (1 - alpha)) ** (1 / (1 - alpha))

    low, high = area(1.5) - 1.0, area(n + 0.5)
    near = 1.0 - back(low) if n > 1 else 1.0

    def uniform_of(ids, step):
        x = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((seed * 1_000_003 + step) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53

    def pick(frames):
        for frame in frames:
            ids = frame["id"].to_numpy().astype(np.uint64)
            out, todo, step = np.zeros(len(ids), np.int64), np.arange(len(ids)), 0
            with np.errstate(over="ignore"):
                while len(todo):
                    y = high + uniform_of(ids[todo], step) * (low - high)
                    x = back(y)
                    rank = np.clip(np.rint(x), 1, n)
                    good = (rank - x <= near) | (y >= area(rank + 0.5) - rank**-alpha)
                    out[todo[good]] = rank[good].astype(np.int64) - 1
                    todo, step = todo[~good], step + 1
            yield pd.DataFrame({"draw": frame["id"], "i": out})

    return spark.range(draws).mapInPandas(pick, "draw long, i long")


def requests(spark: SparkSession, count: int, op: str, index: Column, target: int = 1024) -> DataFrame:
    """(seq, op, key, value) of one kind of operation over keys picked by ``index``."""
    rows = spark.range(count).select(F.col("id").alias("seq"), index.alias("i"))
    value = F.lit(None).cast("binary") if op == "delete" else codec.scrambled_value(F.col("i"), target)
    return rows.select("seq", F.lit(op).alias("op"), codec.text(codec.formatted_key(F.col("i"))).alias("key"), value.alias("value"))


def inserts(spark: SparkSession, first: int, count: int, target: int = 1024) -> DataFrame:
    return requests(spark, count, "insert", F.col("id") + first, target)


def deletes(spark: SparkSession, n: int, threads: int, target: int = 1024) -> DataFrame:
    """Delete requests of all n keys: thread t takes keys t, t + threads, ..., and the threads take turns in order of seq."""
    return requests(spark, n, "delete", F.col("id"), target).select("*", (F.col("seq") % threads).cast("int").alias("thread"))


def updates(spark: SparkSession, count: int, n: int, seed: int = 1, target: int = 1024) -> DataFrame:
    """Update requests of skewed keys."""
    return requests(spark, count, "update", zipf(n, seed), target)


def corpus_keys(budget: int, value_bytes: int, key_bytes: int = 16) -> int:
    """How many keys a corpus of ``budget`` bytes holds, at least one."""
    return max(1, budget // (key_bytes + value_bytes))


def corpus_bytes(keys: Column, value_bytes: Column, key_bytes: int = 16) -> Column:
    return keys * (value_bytes + key_bytes)


def page_accesses(spark: SparkSession, count: int, pages: int, width: int = 0, seed: int = 1) -> DataFrame:
    """(seq, op, page): ``count`` uniform page accesses; with ``width`` each op reads that many pages, prefetched together, else one."""
    page = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(pages))
    return spark.range(count).select(F.col("id").alias("seq"), F.floor(F.col("id") / max(1, width)).cast("long").alias("op"), page.alias("page"))


class Schedule:
    """Triggers at fixed seconds of a run.  A trigger that comes late fires late and once."""

    def __init__(self, marks: tuple[tuple[int, str], ...] = ((5, "reorganize"), (10, "checkpoint"), (25, "checkpoint"))):
        self.open, self.fired = sorted(marks), []

    def run(self, elapsed: float, actions: dict[str, Callable[[], None]], clock: Callable[[], float]) -> list[tuple]:
        """Fire what is due at ``elapsed`` seconds; rows (scheduled_sec, fired_sec, kind, duration_sec) of this call, also kept in ``fired``."""
        out = []
        while self.open and self.open[0][0] <= elapsed:
            mark, kind = self.open.pop(0)
            began = clock()
            actions[kind]()
            out.append((mark, elapsed, kind, clock() - began))
        self.fired += out
        return out


def churn(spark: SparkSession, n: int, ratio: float, seed: int = 42, target: int = 1024) -> DataFrame:
    """Uniform updates of a share of the keys."""
    return requests(spark, int(n * ratio), "update", uniform(n, seed), target)


def hits(spark: SparkSession, count: int, n: int, seed: int = 1) -> DataFrame:
    return spark.range(count).select(codec.text(codec.formatted_key(zipf(n, seed))).alias("key"))


def misses(spark: SparkSession, count: int, n: int, seed: int = 1) -> DataFrame:
    """Keys beyond the corpus."""
    return spark.range(count).select(codec.text(codec.formatted_key(zipf(n, seed) + n)).alias("key"))


def scans(spark: SparkSession, count: int, n: int, length: int = 100, skewed: bool = True, seed: int = 1) -> DataFrame:
    """(seq, start) of scans of consecutive keys."""
    return spark.range(count).select(F.col("id").alias("seq"), (zipf(max(1, n - length), seed) if skewed else uniform(max(1, n - length), seed)).alias("start"))


def ycsb_e(spark: SparkSession, count: int, n: int, seed: int = 1, length: int = 100) -> DataFrame:
    """(seq, op, start, length): 95 % scans over the growing key space, 5 % inserts of the next keys."""
    rows = spark.range(count).select(F.col("id").alias("seq"), (F.rand(seed) < 0.05).alias("is_insert"), F.rand(seed + 1).alias("u"))
    grown = n + F.floor(F.col("seq") * 0.05)
    start = F.floor(F.pow((grown - length).cast("double"), F.col("u")) - 1).cast("long")
    return rows.select("seq", F.when(F.col("is_insert"), "insert").otherwise("scan").alias("op"), F.when(F.col("is_insert"), grown.cast("long")).otherwise(start).alias("start"), F.when(F.col("is_insert"), 1).otherwise(length).alias("length"))


def pages(spark: SparkSession, count: int, size: int = 4096) -> DataFrame:
    """(page, data) of pseudo-random pages."""
    return spark.range(count).select(F.col("id").alias("page"), F.unhex(F.array_join(F.transform(codec.scrambled(F.col("id"), size // 8), lambda w: F.lpad(F.hex(w), 16, "0")), "")).alias("data"))
