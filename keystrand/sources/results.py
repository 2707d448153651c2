"""Benchmark result files: sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measure

BENCHMARKS = "benchmarks array<struct<name string, items_per_second double, real_time double, error_occurred boolean>>"
TIMELINE = (
    "store string, variant string, value_size string, scenario string, "
    "timeline array<struct<sec int, scan_ops long, insert_ops long, t1_reorg_ops long, t2_reorg_ops long, t1_forced_reorg_ops long, t2_forced_reorg_ops long>>, "
    "forced_events array<struct<scheduled_sec int, fired_sec double, kind string, duration_sec double>>"
)
PROBE = "scenario string, value_size string, mode string, ratio double, churn_ratio double, key_count long, elapsed_sec double, timed_out boolean"
MICRO = "config map<string,string>, results map<string,map<string,double>>"


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """One row a measurement, its name split; rows without an operation or thread count are dropped."""
    rows = spark.read.schema(BENCHMARKS).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), F.explode("benchmarks").alias("b"))
    rows = rows.select("file", F.col("b.name").alias("name"), F.coalesce("b.items_per_second", F.lit(0.0)).alias("items_per_second"))
    return rows.select("*", *measure.name_parts(F.col("name"))).where("op is not null and threads is not null")


def read_timelines(spark: SparkSession, glob: str) -> DataFrame:
    """One row a second of each run."""
    runs = spark.read.schema(TIMELINE).option("multiLine", True).json(glob)
    rows = runs.select("store", "variant", measure.value_label(F.col("value_size")).alias("value_size"), F.coalesce("scenario", F.lit("unspecified")).alias("scenario"), F.explode("timeline").alias("t"))
    return rows.select("store", "variant", "value_size", "scenario", "t.*").na.fill(0, ["t1_reorg_ops", "t2_reorg_ops", "t1_forced_reorg_ops", "t2_forced_reorg_ops"])


def read_forced_events(spark: SparkSession, glob: str) -> DataFrame:
    runs = spark.read.schema(TIMELINE).option("multiLine", True).json(glob)
    return runs.select("store", "variant", "value_size", F.explode_outer("forced_events").alias("e")).select("store", "variant", "value_size", "e.*")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(PROBE).json(path).where("scenario is not null")


def read_micro(spark: SparkSession, path: str) -> DataFrame:
    """(method, metric, value) of a nested result."""
    rows = spark.read.schema(MICRO).option("multiLine", True).json(path).select("config", F.explode("results").alias("method", "m"))
    return rows.select("config", "method", F.explode("m").alias("metric", "value"))


def write_timeline(counts: DataFrame, path: str, *by: str) -> None:
    """One file a run, a JSON object with its timeline array, from (by..., sec, scan_ops, insert_ops)."""
    counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("sec", "scan_ops", "insert_ops"))).alias("timeline")).write.option("maxRecordsPerFile", 1).json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_micro(rows: DataFrame, path: str) -> None:
    """The nested form of (method, metric, value)."""
    rows.groupBy("method").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("method", "m"))).alias("results")).write.json(path)


def write_html(rows: DataFrame, path: str, title: str = "Results") -> None:
    """A report table of a small result, which passes the driver."""
    with open(path, "w") as f:
        f.write(f"<!DOCTYPE html><meta charset=utf-8><title>{title}</title>{rows.toPandas().to_html(index=False)}")
