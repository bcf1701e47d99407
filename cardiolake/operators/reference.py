"""The one-hertz reference stream: duplicate merge, coverage, and interval joins to windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Rounded to one decimal, halves to even. Means of short decimals within 1e-9 of a half are halves, in whatever order they were summed."""
    tenths = x * 10
    half = F.abs(tenths - F.floor(tenths) - 0.5) < 1e-9
    return F.when(half, 2 * F.round(x * 5) / 10).otherwise(F.round(x, 1))


def merge_duplicates(rows: DataFrame, numeric: list[str], first: list[str], order: str, keys: tuple[str, ...] = ("epoch_utc",)) -> DataFrame:
    """One row per key: means rounded half to even at one decimal, and first non-null values in ``order``."""
    means = [half_even(F.avg(c)).alias(c) for c in numeric]
    firsts = [F.expr(f"min_by({c}, {order}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in first]
    return rows.groupBy(*keys).agg(*means, *firsts)


def coverage(rows: DataFrame, *keys: str) -> DataFrame:
    """Raw rows, distinct epochs, merged duplicates and missing seconds."""
    got = rows.groupBy(*keys).agg(F.count("*").alias("n_raw"), F.countDistinct("epoch_utc").alias("n_unique"), (F.max("epoch_utc") - F.min("epoch_utc") + 1).alias("span"))
    return got.select(*keys, "n_raw", "n_unique", (F.col("n_raw") - F.col("n_unique")).alias("n_merged"), (F.col("span") - F.col("n_unique")).alias("n_missing"))


def crop(rows: DataFrame, start: float, end: float) -> DataFrame:
    """Rows of ``[start, end)``."""
    if end <= start:
        raise ValueError("the end must lie after the start")
    return rows.where((F.col("epoch_utc") >= F.lit(start)) & (F.col("epoch_utc") < F.lit(end)))


def interval_join(windows: DataFrame, rows: DataFrame, bucket_s: int, keys: tuple[str, ...] = (), how: str = "left") -> DataFrame:
    """Windows with the rows of ``[start_epoch, end_epoch)``, by an equi-join on time buckets and a range condition.

    A window is repeated once per bucket that it touches; a bucket of about one hop keeps that at ``length / hop + 1``."""
    first = F.floor(F.col("start_epoch") / bucket_s).cast("long")
    last = F.floor((F.ceil("end_epoch") - 1) / bucket_s).cast("long")
    w = windows.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    r = rows.withColumn("bucket", F.floor(F.col("epoch_utc") / bucket_s).cast("long"))
    inside = (F.col("w.bucket") == F.col("r.bucket")) & (F.col("r.epoch_utc") >= F.col("w.start_epoch")) & (F.col("r.epoch_utc") < F.col("w.end_epoch"))
    for k in keys:
        inside = inside & (F.col(f"w.{k}") == F.col(f"r.{k}"))
    return w.alias("w").join(r.alias("r"), inside, how).select("w.*", *[F.col(f"r.{c}") for c in rows.columns if c not in keys]).drop("bucket")


def window_reference(windows: DataFrame, rows: DataFrame, window_key: list[str], bucket_s: int, keys: tuple[str, ...] = (), min_pi: float = 0.5, require: bool = False) -> DataFrame:
    """Per window: gated mean and deviation of the pulse rate, mean breathing rate with and without the gate, counts, quality.

    The gate keeps rows with perfusion index ``>= min_pi``; a window without any such row uses all of its rows. A window
    is of low quality when fewer than 80 % pass. ``require`` fails on a window without rows; otherwise it gets nulls."""
    joined = interval_join(windows.select(*window_key, "start_epoch", "end_epoch"), rows.select(*keys, "epoch_utc", "pr_bpm", "rr_bpm", "pi"), bucket_s, keys)
    good = F.col("pi") >= F.lit(float(min_pi))
    gated = lambda f, c: F.coalesce(F.when(F.count_if(good) > 0, f(F.when(good, F.col(c)))), F.when(F.count_if(good) == 0, f(F.col(c))))
    n = F.count("epoch_utc")
    if require:
        n = F.when(n > 0, n).otherwise(F.raise_error(F.lit("a window has no reference row")).cast("bigint"))
    return joined.groupBy(*window_key).agg(
        gated(F.avg, "pr_bpm").alias("pr_bpm_mean"), gated(F.stddev_pop, "pr_bpm").alias("pr_bpm_std"), gated(F.avg, "rr_bpm").alias("rr_bpm_gated"),
        F.avg("rr_bpm").alias("rr_bpm_mean"), n.alias("n_total"), F.count_if(good).alias("n_good_pi"), (F.count_if(good) < 0.8 * F.count("epoch_utc")).alias("low_quality"),
    )


def reference_summary(rows: DataFrame, order: str, min_pi: float, above_pr: float, *keys: str) -> DataFrame:
    """Keep-first deduplication, gate, then mean, deviation and range of each series; NaN values propagate into means."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "epoch_utc").orderBy(order))).where("_k = 1").drop("_k")
    good = F.col("pi") >= F.lit(float(min_pi))
    only: dict[str, Column] = {c: F.when(good, F.col(c)) for c in ("pr_bpm", "rr_bpm", "pi")}
    stats = [f(v).alias(f"{c}_{n}") for c, v in only.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return first.groupBy(*keys).agg(F.count("*").alias("n_unique"), F.count_if(good).alias("n_used"), (F.count("*") - F.count_if(good)).alias("n_filtered"), *stats, F.avg(F.when(good, (F.col("pr_bpm") > above_pr).cast("double"))).alias("fraction_above"))
