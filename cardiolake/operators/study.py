"""Studies over several captures: pooling, trends, verdicts, top lists and respiration reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compare import error_metrics, finite

# order of the window lengths in a trend
LENGTHS = ("20s", "25s", "30s")


def pooled(errors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``errors(capture, length, error)``: micro (all errors), per capture, and macro (over captures) metrics. A capture without
    errors of a length (rows with a null error) has ``n`` 0 and null metrics, and doesn't count in macro."""
    ok = F.lit(True)
    per = errors.groupBy("length", "capture").agg(F.count("error").alias("n"), *error_metrics(F.col("error"), ok))
    micro = errors.groupBy("length").agg(F.count("error").alias("n"), *error_metrics(F.col("error"), ok))
    macro = per.groupBy("length").agg(F.avg("mae_bpm").alias("mae_mean"), F.min("mae_bpm").alias("mae_min"), F.max("mae_bpm").alias("mae_max"), F.avg("rmse_bpm").alias("rmse_mean"), F.avg("bias_bpm").alias("bias_mean"))
    return micro, per, macro


def require_population(errors: DataFrame, lengths: tuple[str, ...] = LENGTHS) -> None:
    """Fails where pooling has nothing to pool: no capture, a capture that lacks a length, or a length without any error."""
    per = errors.groupBy("capture").agg(F.collect_set("length").alias("has")).where(F.size(F.array_except(F.array(*[F.lit(x) for x in lengths]), F.col("has"))) > 0)
    lacking = [r["capture"] for r in per.select("capture").take(5)]
    if lacking:
        raise ValueError(f"captures that lack a window length: {lacking}")
    full = {r["length"] for r in errors.where("error IS NOT NULL").select("length").distinct().collect()}  # a few lengths
    empty = [x for x in lengths if x not in full]
    if empty:
        raise ValueError(f"no errors to pool for {empty}")


def trend(a: Column, b: Column, c: Column) -> Column:
    """How an error moves over three lengths; equal counts as an improvement."""
    missing = a.isNull() | b.isNull() | c.isNull()
    return F.when(missing, "unavailable").when((a >= b) & (b >= c), "monotonic_improvement").when((a >= b) | (b >= c), "partial_improvement").otherwise("no_improvement")


def strict_trend(a: Column, b: Column, c: Column) -> Column:
    """The report's variant: strict, and partial when only the ends improve."""
    missing = a.isNull() | b.isNull() | c.isNull()
    return F.when(missing, "n/a").when((a > b) & (b > c), "YES").when(a > c, "PART").otherwise("NO")


def capture_trends(per_capture: DataFrame, key: str = "capture") -> DataFrame:
    wide = per_capture.groupBy(key).pivot("length", list(LENGTHS)).agg(F.first("mae_bpm"))
    cols = [F.col(f"`{x}`") for x in LENGTHS]
    return wide.select(key, *[c.alias(f"mae_{x}") for c, x in zip(cols, LENGTHS, strict=True)], trend(*cols).alias("trend"), strict_trend(*cols).alias("strict_trend"))


def two_capture_summary(per_capture: DataFrame, first: str, second: str) -> DataFrame:
    """Per length, two captures side by side and the difference of their metrics."""
    wide = per_capture.groupBy("length").pivot("capture", [first, second]).agg(F.first("mae_bpm").alias("mae"), F.first("rmse_bpm").alias("rmse"))
    return wide.select("length", *[F.col(f"`{c}_{m}`").alias(f"{m}_{i}") for i, c in enumerate((first, second)) for m in ("mae", "rmse")], (F.col(f"`{second}_mae`") - F.col(f"`{first}_mae`")).alias("mae_diff"), (F.col(f"`{second}_rmse`") - F.col(f"`{first}_rmse`")).alias("rmse_diff"))


def two_condition_report(per_condition: DataFrame, first: str, second: str, confounds: list[str]) -> DataFrame:
    """Per length, coverage and errors of two captures side by side, first minus second, with the confounds that forbid a causal
    reading. ``per_condition(capture, condition, n_total, n_finite, n_nan_radar, n_nan_ref, n_ahet_verified, mae_bpm, rmse_bpm, bias_bpm)``."""
    counts, errors = ("n_total", "n_finite", "n_nan_radar", "n_nan_ref", "n_ahet_verified"), ("mae_bpm", "rmse_bpm", "bias_bpm")
    side = lambda c, i: per_condition.where(F.col("capture") == c).select("condition", *[F.col(x).alias(f"{x}_{i}") for x in (*counts, *errors)])
    both = side(first, 0).join(side(second, 1), "condition")
    for x in ("mae_bpm", "rmse_bpm"):
        both = both.withColumn(f"{x}_diff", F.col(f"{x}_0") - F.col(f"{x}_1"))
    return both.withColumn("confounds", F.array(*[F.lit(x) for x in confounds]))


def mean_session_mae(sessions: DataFrame) -> DataFrame:
    """Unweighted mean over sessions with a finite error."""
    ok = finite(F.col("mae_bpm"))
    return sessions.agg(F.count_if(ok).alias("n_sessions"), F.avg(F.when(ok, F.col("mae_bpm"))).alias("mean_mae_bpm"))


def verdict(sessions: DataFrame, *keys: str, good: float = 7.0, fair: float = 9.0) -> DataFrame:
    """Acceptance over captures: all or any within ``good``, else all or any within ``fair``."""
    m = F.col("mae_bpm")
    text = F.when(F.bool_and(m <= good), "STRONG PASS").when(F.bool_or(m <= good), "PASS").when(F.bool_and(m <= fair), "MARGINAL").when(F.bool_or(m <= fair), "MIXED").otherwise("FAIL")
    return sessions.groupBy(*keys).agg(text.alias("verdict"))


def worst(merged: DataFrame, n: int, *keys: str, tie: str) -> DataFrame:
    """The ``n`` largest absolute errors per key, unknown ones last."""
    size = F.when(F.isnan("abs_error_bpm"), None).otherwise(F.col("abs_error_bpm"))
    order = Window.partitionBy(*keys).orderBy(size.desc_nulls_last(), tie)
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def flagged_windows(merged: DataFrame, limit: float, key: str, index: str) -> DataFrame:
    """Windows whose absolute error exceeds ``limit``, as one ordered list per key."""
    return merged.where(F.col("abs_error_bpm") > limit).groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(index)).alias("windows"))


def adaptive_k_max(f_r: Column, top_hz: float = 0.833, low_hz: float = 0.083, most: int = 6) -> Column:
    """How many respiratory harmonics to remove for a breathing rate, 1 to ``most``."""
    return F.greatest(F.lit(1), F.least(F.floor((top_hz - low_hz) / f_r), F.lit(most))).cast("int")


def suppressed_harmonics(rates: DataFrame, band: tuple[float, float] = (50.0, 100.0)) -> DataFrame:
    """``rates(f_r_hz, k_max)`` with every harmonic up to ``k_max + 2``: its rate, whether it is in band and suppressed."""
    k = rates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("k_max") + 2)))
    bpm = F.col("k") * F.col("f_r_hz") * 60
    return k.select("*", bpm.alias("harmonic_bpm"), bpm.between(*band).alias("in_band"), (F.col("k") <= F.col("k_max")).alias("suppressed"))


def harmonic_intruders(windows: DataFrame, *keys: str) -> DataFrame:
    """Per harmonic 2 to 6 of the breathing rate: how often it lies in the pulse band, or within 5 bpm of the reference."""
    bpm = F.col("k") * F.col("f_r_hz") * 60
    h = windows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(2, 7)])))
    return h.groupBy(*keys, "k").agg(F.count("f_r_hz").alias("n"), F.count_if(bpm.between(50, 100)).alias("n_in_band"), F.count_if(F.abs(bpm - F.col("pr_bpm_mean")) < 5).alias("n_near_reference"))


def primary_intruder(intruders: DataFrame, *keys: str) -> DataFrame:
    """The smallest harmonic that is in band in more than half of the windows."""
    return intruders.groupBy(*keys).agg(F.min(F.when(F.col("n_in_band") > 0.5 * F.col("n"), F.col("k"))).alias("primary_k"))


def respiration_track(windows: DataFrame, *keys: str) -> DataFrame:
    f = F.when(finite(F.col("f_r_hz")), F.col("f_r_hz"))
    return windows.groupBy(*keys).agg(F.count(f).alias("n"), F.avg(f).alias("f_r_mean"), F.stddev_pop(f).alias("f_r_std"), F.min(f).alias("f_r_min"), F.max(f).alias("f_r_max"))
