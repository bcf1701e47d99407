"""Agreement of estimates with the reference: error metrics, coverage and paired comparisons of conditions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import selection, series


def finite(c: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def error_metrics(error: Column, where: Column) -> list[Column]:
    """Mean absolute error, root mean square error and bias of the errors that ``where`` picks."""
    e = F.when(where, error)
    return [F.avg(F.abs(e)).alias("mae_bpm"), F.sqrt(F.avg(e * e)).alias("rmse_bpm"), F.avg(e).alias("bias_bpm")]


def compare(windows: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """Windows with ``hr_bpm`` and their reference: signed and absolute error, and the reference's quality mark."""
    e = F.col("hr_bpm") - F.col("pr_bpm_mean")
    return windows.join(reference, on).withColumn("error_bpm", e).withColumn("abs_error_bpm", F.abs(e))


def accuracy(merged: DataFrame, *keys: str, drop_low_quality: bool = True) -> DataFrame:
    """Metrics over usable windows; windows without an estimate (null or NaN) are counted apart. Groups without a usable
    window are left out."""
    d = merged.where(~F.col("low_quality")) if drop_low_quality else merged
    has = F.col("hr_bpm").isNotNull() & ~F.isnan("hr_bpm")
    got = d.groupBy(*keys).agg(F.count_if(has).alias("n_windows"), F.count_if(~has).alias("n_nan_windows"), *error_metrics(F.col("error_bpm"), has))
    return got.where("n_windows > 0")


def finite_error_metrics(merged: DataFrame, *keys: str) -> DataFrame:
    """Metrics over all finite errors, whatever the reference's quality."""
    ok = finite(F.col("error_bpm"))
    return merged.groupBy(*keys).agg(F.count_if(ok).alias("n_windows"), *error_metrics(F.col("error_bpm"), ok))


def _pair() -> tuple[Column, Column, Column]:
    a, b = finite(F.col("radar_hr")), finite(F.col("reference_pr"))
    return a, b, F.col("radar_hr") - F.col("reference_pr")


def condition_coverage(pairs: DataFrame, *keys: str) -> DataFrame:
    """Counts of estimates, gaps and marks per condition, with metrics over finite pairs (null where there is none)."""
    a, b, e = _pair()
    flags = [F.count_if(F.col(c)).alias(f"n_{c}") for c in ("ahet_verified", "f_r_outlier", "harmonic_suspect") if c in pairs.columns]
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if(a & b).alias("n_finite"), F.count_if(~a).alias("n_nan_radar"), F.count_if(~b).alias("n_nan_ref"), *flags, *error_metrics(e, a & b))


#: What each row of a paired study must have.
PAIRED = ("condition", "center_frame", "radar_hr", "reference_pr", "ahet_verified")
_MOST_CONDITIONS = 62


def paired_rows(pairs: DataFrame, conditions: list[str], baseline: str | None = None) -> DataFrame:
    """The study's rows with ``_bit``, a power of two for each condition in declared order, and ``_finite``.

    Fails for no or repeated conditions, an unknown ``baseline``, missing columns and centers that aren't whole numbers; and, when
    the rows are read, for a condition that wasn't declared and a null center."""
    if not conditions or len(set(conditions)) != len(conditions) or len(conditions) > _MOST_CONDITIONS:
        raise ValueError(f"a study needs 1 to {_MOST_CONDITIONS} distinct conditions, not {conditions}")
    if baseline is not None and baseline not in conditions:
        raise ValueError(f"the baseline {baseline!r} is none of {conditions}")
    missing = [c for c in PAIRED if c not in pairs.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if dict(pairs.dtypes)["center_frame"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("centers must be whole numbers")
    a, b, _ = _pair()
    bits = F.create_map(*[x for i, c in enumerate(conditions) for x in (F.lit(c), F.lit(1 << i).cast("long"))])
    unknown = F.concat(F.lit("unknown condition "), F.coalesce("condition", F.lit("null")))
    known = F.coalesce(F.try_element_at(bits, F.coalesce("condition", F.lit(""))), F.raise_error(unknown).cast("long"))
    whole = F.coalesce(F.col("center_frame"), F.raise_error(F.lit("a center is null")).cast("bigint"))
    return pairs.withColumns({"_bit": known, "_finite": a & b, "center_frame": whole})


def center_sets(pairs: DataFrame, conditions: list[str], *keys: str, baseline: str | None = None) -> DataFrame:
    """``(keys, center_frame, present, finite)``: which conditions have each center, and which have finite values there, as bitmaps in
    declared order. All centers are the union; those whose ``present`` (``finite``) has every bit are the intersection. A condition
    that has a center twice fails the query."""
    rows = paired_rows(pairs, conditions, baseline)
    got = rows.groupBy(*keys, "center_frame").agg(F.bit_or("_bit").alias("present"), F.coalesce(F.bit_or(F.when(F.col("_finite"), F.col("_bit"))), F.lit(0)).alias("finite"), F.count("*").alias("_n"))
    twice = F.concat(F.lit("a condition has center "), F.col("center_frame").cast("string"), F.lit(" twice"))
    sound = lambda c: F.when(F.col("_n") == F.bit_count("present"), F.col(c)).otherwise(F.raise_error(twice).cast("bigint")).alias(c)
    return got.select(*keys, "center_frame", sound("present"), sound("finite"))


def _all_bits(conditions: list[str]) -> Column:
    return F.lit((1 << len(conditions)) - 1)


def all_centers(sets: DataFrame, conditions: list[str], *keys: str) -> DataFrame:
    """The union of centers, with the number of conditions that have each and the names of those that lack it."""
    lacking = F.filter(F.array(*[F.when(F.col("present").bitwiseAND(1 << i) == 0, F.lit(c)) for i, c in enumerate(conditions)]), lambda x: x.isNotNull())
    return sets.select(*keys, "center_frame", F.bit_count("present").cast("int").alias("n_conditions"), F.array_join(lacking, ",").alias("lacking"))


def common_centers(sets: DataFrame, conditions: list[str], *keys: str) -> DataFrame:
    """Centers that are finite in all conditions."""
    return sets.where(F.col("finite") == _all_bits(conditions)).select(*keys, "center_frame")


def require_common_centers(sets: DataFrame, conditions: list[str]) -> None:
    """Fails where no center is present (finite or not) in all conditions: there is nothing to pair."""
    if sets.where(F.col("present") == _all_bits(conditions)).isEmpty():
        raise ValueError("no center is common to all conditions")


def paired_errors(pairs: DataFrame, conditions: list[str], *keys: str, baseline: str | None = None) -> DataFrame:
    """``(keys, condition, at, center_frame, error, ahet_verified)`` at the common centers, one row per condition and center: the error
    vectors in long form. ``at`` is the condition's place in the declared order; the error is computed anew."""
    _, _, e = _pair()
    common = common_centers(center_sets(pairs, conditions, *keys, baseline=baseline), conditions, *keys)
    place = F.log2("_bit").cast("int")
    rows = paired_rows(pairs, conditions, baseline).join(common, [*keys, "center_frame"])
    return rows.select(*keys, "condition", place.alias("at"), "center_frame", e.alias("error"), "ahet_verified")


def paired_intersection(errors: DataFrame, *keys: str) -> DataFrame:
    """Per condition of ``paired_errors``: metrics, verified windows, and the errors at the first and the last center."""
    e = F.col("error")
    ends = [F.min_by("error", "center_frame").alias("first_error"), F.max_by("error", "center_frame").alias("last_error")]
    return errors.groupBy(*keys, "condition").agg(F.count("*").alias("n_centers"), F.count_if("ahet_verified").alias("n_ahet"), *error_metrics(e, F.lit(True)), *ends)


def error_vector(errors: DataFrame, *keys: str) -> DataFrame:
    """``paired_errors`` with ``rank``, the center's place from 1 in each condition's vector. Every condition has the same centers, so ranks
    are found once, for the centers, by chunks."""
    centers = errors.where("at = 0").select(*keys, "center_frame")
    ranks = series.ranked(centers, list(keys), "center_frame") if keys else series.ranked(centers.withColumn("_all", F.lit(0)), ["_all"], "center_frame")
    return errors.join(ranks.select(*keys, "center_frame", (F.col("_place") + 1).alias("rank")), [*keys, "center_frame"])


def pairwise_rows(errors: DataFrame, *keys: str) -> DataFrame:
    """Every pair of conditions, in declared order, at every common center: the difference vectors in long form."""
    names = ("condition", "at", "error", "ahet_verified")
    side = lambda end: errors.select(*keys, "center_frame", *[F.col(c).alias(f"{c}_{end}") for c in names])
    both = side("a").join(side("b"), [*keys, "center_frame"]).where("at_a < at_b")
    return both.withColumn("diff", F.col("error_a") - F.col("error_b")).withColumn("gap", F.abs("error_a") - F.abs("error_b"))


def pairwise(errors: DataFrame, *keys: str) -> DataFrame:
    """Every pair of conditions in their declared order: differences of errors at common centers and verification moves."""
    rows = pairwise_rows(errors, *keys)
    by, va, vb = [*keys, "condition_a", "condition_b"], F.col("ahet_verified_a"), F.col("ahet_verified_b")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.avg("diff").alias("mean_error_diff"), F.avg("gap").alias("mean_abs_error_diff"),
        F.count_if(va & vb).alias("both_pass"), F.count_if(va & ~vb).alias("only_a_passes"), F.count_if(~va & vb).alias("only_b_passes"), F.count_if(~va & ~vb).alias("neither_passes"),
    )
    median = selection.percentiles(rows, "gap", [0.5], by).select(*by, F.get("percentiles", F.lit(0)).alias("median_abs_error_diff"))
    return sums.join(median, by, "left")


def coverage_table(coverage: DataFrame, intersection: DataFrame, conditions: list[str]) -> str:
    """The study as text: a row per condition in declared order over all its centers, then the same over the common ones. Takes
    ``condition_coverage`` and ``paired_intersection`` of one study (a few rows)."""
    names = ("n_total", "n_finite", "n_ahet", "n_nan_radar", "n_nan_ref")
    head = f"{'Condition':<12} " + " ".join(f"{n:>{max(6, len(n))}}" for n in (*names, "MAE", "RMSE")) + f" {'Bias':>7}"
    number = lambda v, width=6: f"{v:>{width}.2f}" if v is not None and math.isfinite(v) else f"{'NaN':>{width}}"
    line = lambda name, counts, m: f"{name:<12} " + " ".join(f"{c:>{max(6, len(n))}}" for n, c in zip(names, counts, strict=True)) + f" {number(m[0])} {number(m[1])} {number(m[2], 7)}"
    metrics = ("mae_bpm", "rmse_bpm", "bias_bpm")
    per = {r["condition"]: r for r in coverage.collect()}
    common = {r["condition"]: r for r in intersection.collect()}
    n = max((r["n_centers"] for r in common.values()), default=0)
    out = [head, "-" * len(head)]
    out += [line(c, [r["n_total"], r["n_finite"], r["n_ahet_verified"], r["n_nan_radar"], r["n_nan_ref"]], [r[m] for m in metrics]) for c in conditions if (r := per.get(c))]
    out += ["", f"Intersection (n={n})", "-" * len(head)]
    return "\n".join(out + [line(c, [n, n, r["n_ahet"] if r else 0, 0, 0], [r[m] if r else None for m in metrics]) for c in conditions for r in [common.get(c)]])


def align_centers(left: DataFrame, right: DataFrame, suffixes: tuple[str, str]) -> DataFrame:
    """Two conditions' errors at equal window centers."""
    mid = F.expr("(start_frame + end_frame) div 2")
    a = left.select(mid.alias("center_frame"), F.col("error_bpm").alias(f"error_{suffixes[0]}"))
    return a.join(right.select(mid.alias("center_frame"), F.col("error_bpm").alias(f"error_{suffixes[1]}")), "center_frame")


# the flat columns of window results (fixed names of the comparison files); arrays are left out
FLAT = (
    "start_epoch", "end_epoch", "hr_bpm", "rr_bpm", "chosen_range_m", "heart_spectrum_stage", "heart_peak_hz", "accepted_candidate_rank", "accepted_candidate_initial_hz", "accepted_candidate_refined_hz",
    "accepted_second_harmonic_refined_hz", "schema_version", "window_index", "start_frame", "end_frame", "window_frames", "hop_frames", "frame_rate_hz", "range_bin", "range_m", "eca_applied",
    "ahet_verified", "harmonic_suspect", "f_r_hz_used", "f_r_raw_hz", "f_r_outlier",
)
SHORT = ("start_epoch", "end_epoch", "hr_bpm", "window_index", "rr_bpm", "ahet_verified")


def flat_windows(windows: DataFrame, hop_frames: int, bins: DataFrame | None = None, short: bool = False, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Window results as the flat columns of a comparison file, after ``keys``. ``bins(session_id, bin_idx, range_m)`` give the
    session's range; what isn't known is null, ``harmonic_suspect`` false."""
    if short:
        return windows.select(*keys, *SHORT)
    rows = windows.join(bins.select("session_id", F.col("bin_idx").alias("range_bin"), "range_m"), "session_id", "left") if bins is not None else windows
    made = {
        "window_frames": F.col("end_frame") - F.col("start_frame"), "hop_frames": F.lit(hop_frames), "schema_version": F.lit(1), "range_bin": F.lit(None).cast("int"), "range_m": F.lit(None).cast("double"),
        "harmonic_suspect": F.lit(False), "f_r_hz_used": F.lit(None).cast("double"),
    }
    made = {k: v for k, v in made.items() if k not in rows.columns}
    rows = rows.withColumns(made)
    rows = rows.withColumns({"chosen_range_m": F.col("range_m"), "f_r_raw_hz": F.col("f_r_hz_used"), "harmonic_suspect": F.coalesce("harmonic_suspect", F.lit(False))})
    return rows.select(*keys, *FLAT)


def reference_names(rows: DataFrame) -> DataFrame:
    """The reference stream under the names that summaries use."""
    return rows.withColumnsRenamed({"epoch_utc": "epoch", "pr_bpm": "PR", "rr_bpm": "BR", "pi": "PI"})
