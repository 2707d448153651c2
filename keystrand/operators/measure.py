"""Analytics over measurements: buckets, rates, percentiles, winners, merges, caches."""

from __future__ import annotations

import re
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..sources.files import written
from . import reads

# Thread counts of a report's columns.
THREADS = (1, 4, 16, 32)


def buckets(events: DataFrame, ts: str, unit: str, kind: str) -> DataFrame:
    """(bucket, kind, n): counts in tumbling windows of one unit; partial counts before the shuffle."""
    return events.groupBy(F.date_trunc(unit, ts).alias("bucket"), kind).agg(F.count("*").alias("n"))


def second_buckets(events: DataFrame, start: Column, ts: str, kind: str, seconds: int | None = 30) -> DataFrame:
    """Counts by whole second since ``start``; what lies outside 1..seconds is dropped, nothing if ``seconds`` is None."""
    sec = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start)) / 1_000_000) + 1
    rows = events.select(sec.alias("sec"), kind) if seconds is None else events.select(sec.cast("int").alias("sec"), kind).where(F.col("sec").between(1, seconds))
    return rows.groupBy("sec", kind).agg(F.count("*").alias("n"))


def throughput(events: DataFrame, ts: str, *by: str) -> DataFrame:
    """Rows a second between the first and the last."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    grouped = events.groupBy(*by).agg(F.count("*").alias("n"), (F.max(micros) - F.min(micros)).alias("span_us"))
    return grouped.withColumn("per_second", F.when(F.col("span_us") > 0, F.col("n") * 1e6 / F.col("span_us")))


def index_percentiles(df: DataFrame, value: str, by: str, marks: dict[str, int]) -> DataFrame:
    """Element floor(n * p / 1000) of each group's sorted values, for p in thousandths; no interpolation.

    All values are numbered in order of (group, value) over many partitions, and the wanted numbers are looked up, so a
    group may be of any size.
    """
    rows = reads.numbered(df.select(F.col(by).alias("_by"), F.col(value).alias("_value")).where("_value is not null"), "_by", "_value")
    groups = rows.groupBy("_by").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    wanted = groups.select("_by", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("mark"), (F.col("first") + F.floor(F.col("n") * p / 1000)).alias("position")) for k, p in marks.items()])).alias("w"))
    found = wanted.select("_by", "n", "w.mark", "w.position").join(rows.select("position", "_value"), "position")
    return found.groupBy(F.col("_by").alias(by)).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("mark") == k, F.col("_value"))).alias(k) for k in marks])


def name_parts(name: Column) -> list[Column]:
    """Columns store, variant, op, mode, dist, value, threads of a benchmark's name."""

    def part(key: str) -> Column:
        return F.nullif(F.regexp_extract(name, f"(?:^|/){key}=([^/]*)", 1), F.lit(""))

    threads = F.nullif(F.regexp_extract(name, r"/threads:(\d+)", 1), F.lit("")).cast("int")
    return [*(part(k).alias(k.lower()) for k in ("Store", "Variant", "Op", "Mode", "Dist", "Value")), threads.alias("threads")]


def value_label(size: Column) -> Column:
    """1KB, 64KB or 8B from the longer labels that mixed corpora carry."""
    return F.when(size.startswith("1KB"), "1KB").when(size.startswith("64KB"), "64KB").when(size.startswith("8B"), "8B").otherwise(size)


def compose_name(store: Column, variant: Column, op: Column, mode: Column, dist: Column, value: Column, threads: Column) -> Column:
    parts = [F.concat(F.lit(f"{k}="), c) for k, c in (("Store", store), ("Variant", variant), ("Op", op), ("Mode", mode), ("Dist", dist), ("Value", value))]
    return F.concat_ws("/", *parts, F.lit("real_time"), F.concat(F.lit("threads:"), threads.cast("string")))


def labelled(rows: DataFrame, labels: dict[tuple[str, str], str], store: str = "store", variant: str = "variant") -> DataFrame:
    """Rows whose (store, variant) has a label, with ``label``."""
    pair = F.concat(F.col(store), F.lit("\0"), F.col(variant))
    known = F.create_map(*[F.lit(x) for (s, v), label in labels.items() for x in (f"{s}\0{v}", label)])
    return rows.withColumn("label", F.try_element_at(known, pair)).where("label is not null")


def matrix_filter(name: Column, stores: list[str], value: str | None = None) -> Column:
    """Benchmarks of some stores, and of one value size (as in ``value_label``)."""
    some = "|".join(re.escape(s) for s in stores)
    return name.rlike(f"^Store=({some})/.*{f'Value={re.escape(value)}' if value else ''}")


def priming_filter(name: Column, stores: list[str]) -> Column:
    """The one cell of each (store, variant, value) that builds the corpus all others share."""
    return matrix_filter(name, stores) & name.rlike("/Op=Get/Mode=Hit/Dist=Zipf/.*threads:1$")


def quick_filter(name: Column, store: str, variant: str, op: str = "Get", value: str = "8B") -> Column:
    """One representative cell, on one thread."""
    return name.rlike(f"^Store={re.escape(store)}/Variant={re.escape(variant)}/Op={op}/.*Value={re.escape(value)}.*threads:1$")


def thread_counts(rows: DataFrame) -> DataFrame:
    """Distinct thread counts, ascending."""
    return rows.select("threads").where("threads is not null").distinct().orderBy("threads")


def probe_points(rows: DataFrame) -> DataFrame:
    """Points of a report's probe lines, each scenario's by number of keys."""
    return rows.orderBy("scenario", "key_count")


def winners(rows: DataFrame, native: Column, *by: str) -> DataFrame:
    """Best native and best rival label and value for each group, their ratio and badge; ties go to the first label."""

    def best(mask: Column, prefix: str) -> list[Column]:
        # of equal values the first label: max_by over (value, reversed label order)
        top = F.min(F.when(mask, F.struct(-F.col("value"), F.col("label"))))
        return [top.getField("label").alias(f"{prefix}_label"), (-top.getField("col1")).alias(f"{prefix}_value")]

    out = rows.groupBy(*by).agg(*best(native, "native"), *best(~native, "rival"))
    ratio = F.when(F.col("rival_value") > 0, F.col("native_value") / F.col("rival_value"))
    return out.withColumn("ratio", ratio).withColumn("badge", codec.badge(ratio))


def pivot_threads(rows: DataFrame, *by: str) -> DataFrame:
    """One column a thread count; the list is given, so no job looks for it."""
    return rows.groupBy(*by).pivot("threads", list(THREADS)).agg(F.max("value"))


def merge_results(new: DataFrame, old: DataFrame, native: Column) -> DataFrame:
    """Native rows of the new run, all other rows of the old run, with their source."""
    return new.where(native).withColumn("src", F.lit("new")).unionByName(old.where(~native).withColumn("src", F.lit("old")))


def merge_files(new: DataFrame, old: DataFrame, native: Column, suffix: str = "") -> DataFrame:
    """:func:`merge_results` file by file: of the files in both runs, by base name, native rows of the new and others of the old one.

    ``suffix`` ends the new files' base names and is left out of them; a side's file names are few, so they are collected by no one.
    """
    mine, theirs = ((_based(df, s)) for df, s in ((new, suffix), (old, "")))
    names = mine.select("file").distinct().join(theirs.select("file").distinct(), "file")
    return merge_results(mine.join(names, "file", "left_semi"), theirs.join(names, "file", "left_semi"), native)


def merge_warnings(new: DataFrame, old: DataFrame, native: Column, suffix: str = "") -> DataFrame:
    """(file, stray, rivals, in_both): foreign rows of a new file, rows an old file gives, and whether both runs have it."""
    stray = _based(new, suffix).groupBy("file").agg(F.sum((~native).cast("long")).alias("stray"), F.lit(True).alias("_new"))
    rivals = _based(old, "").groupBy("file").agg(F.sum((~native).cast("long")).alias("rivals"), F.lit(True).alias("_old"))
    both = stray.join(rivals, "file", "full_outer")
    return both.select("file", F.coalesce("stray", F.lit(0)).alias("stray"), F.coalesce("rivals", F.lit(0)).alias("rivals"), (F.col("_new").isNotNull() & F.col("_old").isNotNull()).alias("in_both"))


def _based(rows: DataFrame, suffix: str) -> DataFrame:
    """``file`` without folder, ending and suffix."""
    return rows.withColumn("file", F.regexp_replace(F.regexp_extract("file", r"([^/]*?)(?:\.json)?$", 1), f"{re.escape(suffix)}$", ""))


def nested(rows: DataFrame, outer: str, key: str, value: str) -> DataFrame:
    """A map of key to value for each outer group."""
    return rows.groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("entries"))


def lru_hits(accesses: DataFrame, capacity: int, order: str, page: str, *by: str) -> DataFrame:
    """(group..., accesses, hits) of a least-recently-used cache fed in order.

    A cache holds the ``capacity`` pages seen last, whatever hit or missed.  So ranges of the sequence are counted side by
    side: each range's last pages are found, the cache at its start is what the ranges before it leave, and every range
    begins with that.  The pass over the ranges' last pages is the only one in sequence; it takes ``capacity`` pages a range.
    """
    keys = list(by)
    cols = [f"_k{i}" for i in range(len(keys))]
    rows = accesses.select(*[F.col(k).alias(c) for k, c in zip(keys, cols, strict=True)], F.col(order).alias("_order"), F.col(page).alias("_page"))
    stored = written(reads.placed(rows, *cols, "_order"), "accesses").withColumn(reads.PART, F.shiftright(reads.AT, 33))
    kinds = "".join(f"{c} {t}, " for c, t in stored.dtypes if c in cols)
    kind = dict(stored.dtypes)["_page"]
    latest = stored.groupBy(reads.PART, *cols, "_page").agg(F.max(reads.AT).alias(reads.AT))
    recent = latest.withColumn("_n", F.row_number().over(Window.partitionBy(reads.PART, *cols).orderBy(F.desc(reads.AT)))).where(F.col("_n") <= capacity)

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cache at the end of each range, as the rows the next range of the group begins with."""
        cache: OrderedDict = OrderedDict()
        group, part, out = None, None, []

        def leave(to: int) -> None:
            out.extend((to, *group, i - len(cache), p) for i, p in enumerate(cache))

        for frame in frames:
            for r in frame.itertuples(index=False):
                mine = tuple(getattr(r, f"c{i}") for i in range(len(cols)))
                if mine != group:
                    cache.clear()
                elif r.part != part:
                    leave(r.part)
                group, part = mine, r.part
                cache.pop(r.page, None)
                cache[r.page] = None
                if len(cache) > capacity:
                    cache.popitem(last=False)
            if out:
                yield pd.DataFrame(out, columns=[reads.PART, *cols, reads.AT, "_page"])
                out = []

    ordered = recent.select(F.col(reads.PART).alias("part"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)], F.col("_page").alias("page"), F.col(reads.AT).alias("at"))
    names = [f"c{i}" for i in range(len(cols))]
    ordered = (ordered.repartition(*names) if names else ordered.coalesce(1)).sortWithinPartitions(*names, "part", "at")
    warm = ordered.mapInPandas(carry, f"{reads.PART} long, {kinds}{reads.AT} long, _page {kind}")

    def simulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: OrderedDict = OrderedDict()
        at, counts = None, defaultdict(lambda: [0, 0])
        for frame in frames:
            groups = zip(*(frame[c] for c in cols), strict=True) if cols else repeat(())
            for part, group, place, p in zip(frame[reads.PART], groups, frame[reads.AT], frame["_page"], strict=False):
                if (part, group) != at:
                    at = (part, group)
                    cache.clear()
                    n = counts[group]
                hit = p in cache
                if place >= 0:
                    n[0] += 1
                    n[1] += hit
                if hit:
                    cache.move_to_end(p)
                else:
                    cache[p] = None
                    if len(cache) > capacity:
                        cache.popitem(last=False)
        yield pd.DataFrame([[*g, *n] for g, n in counts.items()], columns=[*cols, "accesses", "hits"])

    every = stored.select(reads.PART, *cols, reads.AT, "_page").union(warm)
    parts = every.repartition(reads.PART).sortWithinPartitions(reads.PART, *cols, reads.AT).mapInPandas(simulate, f"{kinds}accesses long, hits long")
    return parts.groupBy(*[F.col(c).alias(k) for k, c in zip(keys, cols, strict=True)]).agg(F.coalesce(F.sum("accesses"), F.lit(0)).alias("accesses"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
