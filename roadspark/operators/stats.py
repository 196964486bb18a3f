"""Latency and load statistics of query logs. Ranks are exact, and no list of values is gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def rank(n: Column, share: float) -> Column:
    """The place, from 0, of the nearest rank: min(floor(n * share), n - 1)."""
    return F.least(F.floor(n * share), n - 1)


def at_ranks(values: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]], keep: Keep) -> DataFrame:
    """(keys, a column for each place): the values at these places of the sorted values of each group.

    Equal values become one row with their number; these are dealt by ranges of (keys, value), counted a
    range, and the range that holds a place finds its row. Neither a group nor a value is one task's work.
    """
    spark = values.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    dealt = keep(distinct.repartitionByRange(n, *keys, "_v").withColumn("_pid", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_s"))
    by = Window.partitionBy(*keys)
    ranges = ranges.withColumn("_base", F.sum("_s").over(by.orderBy("_pid")) - F.col("_s")).withColumn("_n", F.sum("_s").over(by)).drop("_s")
    same = F.lit(True)
    for c in [*keys, "_pid"]:
        same &= F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}"))
    inner = Window.partitionBy(*keys, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_before", F.coalesce(F.sum("_c").over(inner), F.lit(0))).alias("d").join(ranges.alias("r"), same).select("d.*", "_base", "_n")
    start = F.col("_base") + F.col("_before")
    picks = [F.max(F.when((start <= place(F.col("_n"))) & (place(F.col("_n")) < start + F.col("_c")), F.col("_v"))).alias(name) for name, place in places.items()]
    return rows.groupBy(*keys).agg(*picks)


MIDDLE = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}


def _shown(c: Column, name: str, digits: int = 2) -> Column:
    return F.bround(F.coalesce(c, F.lit(0.0)), digits).alias(name)


def _with_ranks(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    same = F.lit(True)
    for c in keys:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"k.{c}"))
    return rows.alias("a").join(ranks.alias("k"), same, "left").select("a.*", *(f"k.{c}" for c in ranks.columns if c not in keys))


def latency(log: DataFrame, keep: Keep) -> DataFrame:
    """By (category, test_case, query_type): counts, latency over successes, distance over found paths; all failed: zeros."""
    keys = ["category", "test_case", "query_type"]
    good = F.when(F.col("success"), F.col("latency_ms"))
    rows = log.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(good).alias("n_ok"), F.avg(good).alias("mean"), F.stddev_samp(good).alias("std"), F.min(good).alias("low"), F.max(good).alias("high"),
        F.avg(F.when(F.col("success") & F.col("path_found"), F.col("distance_m"))).alias("distance"),
    )
    ranks = at_ranks(log.where("success"), keys, "latency_ms", MIDDLE | {"_p95": lambda n: rank(n, 0.95)}, keep)
    middle = F.round((F.col("_low") + F.col("_high")) / 2, 6)
    return _with_ranks(rows, ranks, keys).select(
        *keys, F.col("n").alias("run_count"), F.col("n_ok").alias("success_count"), _shown(F.col("mean"), "mean_ms"), _shown(F.col("std"), "std_ms"), _shown(F.col("low"), "min_ms"),
        _shown(F.col("high"), "max_ms"), _shown(middle, "median_ms"), _shown(F.col("_p95"), "p95_ms"), _shown(F.col("distance"), "avg_distance_m"),
    )


def load(log: DataFrame, keep: Keep) -> DataFrame:
    """One row: duration, requests a second, latency over successes, error rate."""
    good = F.when(F.col("success"), F.col("latency_ms"))
    span = (F.max("start_time").cast("double") - F.min("start_time").cast("double")).alias("span")
    one = log.agg(F.count("*").alias("n"), F.count(good).alias("n_ok"), F.avg(good).alias("mean"), F.stddev_samp(good).alias("std"), F.min(good).alias("low"), F.max(good).alias("high"), span).withColumn("one", F.lit(1))
    shares = (50, 95, 99)
    ranks = at_ranks(log.where("success").withColumn("one", F.lit(1)), ["one"], "latency_ms", {f"_p{p}": lambda n, p=p: rank(n, p / 100) for p in shares}, keep)
    duration = F.when(F.col("span") > 0, F.col("span")).otherwise(1.0)
    return _with_ranks(one, ranks, ["one"]).select(
        F.col("n").alias("total"), F.col("n_ok").alias("success_count"), _shown(duration, "duration_s"), _shown(F.col("n") / duration, "rps", 6), _shown(F.col("mean"), "mean_ms"), _shown(F.col("std"), "std_ms"),
        _shown(F.col("low"), "min_ms"), _shown(F.col("high"), "max_ms"), *(_shown(F.col(f"_p{p}"), f"p{p}_ms") for p in shares), _shown(1 - F.col("n_ok") / F.col("n"), "error_rate", 4),
    )


def by_category(stats: DataFrame) -> DataFrame:
    """(category, first, cached): the statistics of latency() in two lists, by test case; a category's cases are few."""
    shown = F.struct(*(c for c in stats.columns if c not in ("category", "query_type")))
    lists = [F.array_sort(F.collect_list(F.when(F.col("query_type") == t, shown))).alias(t) for t in ("first", "cached")]
    return stats.groupBy("category").agg(*lists)


def speedup(log: DataFrame) -> DataFrame:
    """Mean latency of first and cached queries by test case, their ratio and the share saved."""
    rows = log.where("success").groupBy("category", "test_case").pivot("query_type", ["first", "cached"]).agg(F.avg("latency_ms"))
    ratio = F.when(F.col("cached") > 0, F.col("first") / F.col("cached"))
    return rows.select("category", "test_case", F.bround("first", 2).alias("first_ms"), F.bround("cached", 2).alias("cached_ms"), F.bround(ratio, 4).alias("ratio"), F.bround((1 - 1 / ratio) * 100, 4).alias("reduction_pct"))


def summary_report(stats: DataFrame) -> DataFrame:
    """latency()'s rows with the columns of the summary report, numbers as text with two decimals."""
    names = {"category": "CATEGORY", "test_case": "TEST_NAME", "query_type": "QUERY_TYPE", "run_count": "COUNT", "success_count": "SUCCESS", "mean_ms": "MEAN_MS", "std_ms": "STD_MS", "min_ms": "MIN_MS", "max_ms": "MAX_MS", "median_ms": "MEDIAN_MS", "p95_ms": "P95_MS", "avg_distance_m": "AVG_DIST_M"}
    return stats.select(*((F.format_string("%.2f", F.col(c)) if c.endswith(("_ms", "_m")) else F.col(c)).alias(n) for c, n in names.items()))


def _word(flag: str) -> Column:
    return F.when(F.col(flag), "True").otherwise("False")


def raw_report(log: DataFrame) -> DataFrame:
    """The log with the columns of the raw report; runs are numbered by start time within a case and kind."""
    run = F.row_number().over(Window.partitionBy("category", "test_case", "query_type").orderBy("start_time", "request_id"))
    return log.select(
        F.col("category").alias("CATEGORY"), F.col("test_case").alias("TEST_NAME"), F.col("query_type").alias("QUERY_TYPE"), run.alias("RUN"), F.format_string("%.2f", "latency_ms").alias("LATENCY_MS"),
        _word("success").alias("SUCCESS"), _word("path_found").alias("PATH_FOUND"), F.format_string("%.2f", F.coalesce("distance_m", F.lit(0.0))).alias("DISTANCE_M"), F.coalesce("segments_count", F.lit(0)).alias("SEGMENTS"), F.coalesce("error", F.lit("")).alias("ERROR"),
    )


def load_report(one: DataFrame, test_case: str, concurrency: int) -> DataFrame:
    """load()'s row with the columns of the load report."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    return one.select(
        F.lit(test_case).alias("TEST_CASE"), F.lit(concurrency).alias("CONCURRENCY"), F.col("total").alias("TOTAL_REQS"), F.col("success_count").alias("SUCCESSFUL"), (F.col("total") - F.col("success_count")).alias("FAILED"),
        two("duration_s").alias("DURATION_S"), two("rps").alias("THROUGHPUT_RPS"), F.format_string("%.4f", "error_rate").alias("ERROR_RATE"), *(two(c).alias(c.upper()) for c in ("mean_ms", "std_ms", "min_ms", "max_ms", "p50_ms", "p95_ms", "p99_ms")),
    )


def timeline_report(log: DataFrame) -> DataFrame:
    """The log with the columns of the timeline report; order it by START_TIME."""
    micros = F.unix_micros("start_time")
    start = F.concat(F.floor(micros / 1_000_000).cast("string"), F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"))
    return log.select(F.col("request_id").alias("REQUEST_ID"), start.alias("START_TIME"), F.format_string("%.2f", "latency_ms").alias("LATENCY_MS"), _word("success").alias("SUCCESS"), F.coalesce("error", F.lit("")).alias("ERROR"))
