"""End-to-end plans: one capture to rates, several window lengths side by side, and a session's quality mask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, quality, reference, vitals, windows
from ..sources import adc


def capture_features(spark: SparkSession, paths: list[str], session_id: str, g: vitals.Geometry, trim_s: float = 0.0, windowed: bool = True, phase_bin: int | None = None, allow_frame_count_mismatch: bool = False, **frames: int | None) -> DataFrame:
    """Features of the frames after the trim; earlier frames are never read. ``expected_frames`` guards the length, unless a mismatch
    is allowed."""
    found = adc.frame_count(adc.file_sizes(paths), g.frame_bytes)
    adc.expect_frames(found, frames.get("expected_frames"), allow_frame_count_mismatch)
    raw = adc.read_capture(spark, paths, session_id, g, trim_frames=int(trim_s * g.frame_rate_hz), end_frame=frames.get("end_frame"))
    return vitals.range_features(raw, g, windowed, phase_bin)


def capture_phase(features: DataFrame, g: vitals.Geometry, gate_m: tuple[float, float], locked_bin: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(bins, phase)``: the locked bin, or the strongest in the gate (a gate without a bin fails); and the clipped phase series in absolute frames."""
    if locked_bin is not None:
        if not 0 <= locked_bin < g.samples:
            raise ValueError(f"bin {locked_bin} lies outside 0..{g.samples - 1}")
        bins = features.select("session_id").distinct().withColumn("bin_idx", F.lit(locked_bin)).withColumn("range_m", F.lit(locked_bin * g.range_resolution_m))
    else:
        energy = vitals.mean_range_energy(features)
        bins = vitals.select_bin(vitals.in_gate(energy, g.range_resolution_m, (F.lit(gate_m[0]), F.lit(gate_m[1])), require=True))
    return bins, vitals.phase_series(features, bins)


def rates(phase: DataFrame, g: vitals.Geometry, grid: DataFrame, capture_start: float, use_eca: bool = True, bucket: int = 256) -> DataFrame:
    """Estimates for a grid of absolute frames, with epochs. Windows are assembled from buckets of frames, so one session's windows
    are estimated by all tasks."""
    timed = windows.with_epochs(grid, F.lit(float(capture_start)), g.frame_rate_hz).withColumn("frame_rate_hz", F.lit(g.frame_rate_hz))
    return vitals.estimate_windows(windows.assemble(timed, phase, "phase", bucket), g.frame_rate_hz, use_eca)


def in_pipeline_rates(phase: DataFrame, g: vitals.Geometry, window: int, hop: int, capture_start: float, use_eca: bool = True) -> DataFrame:
    """Estimates for the grid that starts with each session's first frame; sessions that are too short give no row."""
    span = phase.groupBy("session_id").agg(F.min("frame_idx").alias("first_frame"), F.count("*").alias("total_frames"))
    grid = windows.pipeline_grid(span, window, hop).join(span.select("session_id", "first_frame"), "session_id")
    absolute = grid.select("session_id", "window_index", *[(F.col(c) + F.col("first_frame")).alias(c) for c in ("start_frame", "end_frame")])
    return rates(phase, g, absolute, capture_start, use_eca)


def whole_capture_rate(phase: DataFrame, g: vitals.Geometry) -> DataFrame:
    """One estimate over the whole series, without projecting harmonics out: a single window as long as the capture."""
    span = phase.groupBy("session_id").agg(F.min("frame_idx").alias("start_frame"), (F.max("frame_idx") + 1).alias("end_frame"))
    return vitals.estimate_windows(windows.assemble(span.withColumn("window_index", F.lit(0)), phase, "phase", 4096), g.frame_rate_hz, use_eca=False)


def agreement(estimates: DataFrame, rows: DataFrame, bucket_s: int = 5, min_pi: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(merged, metrics of all windows, metrics of verified windows)`` against the reference stream."""
    ref = reference.window_reference(estimates, rows, ["session_id", "window_index"], bucket_s, min_pi=min_pi, require=True)
    merged = compare.compare(estimates, ref, ["session_id", "window_index"])
    return merged, compare.accuracy(merged, "session_id"), compare.accuracy(merged.where("ahet_verified"), "session_id")


def length_study(phase: DataFrame, g: vitals.Geometry, total_frames: DataFrame, rows: DataFrame, lengths_s: list[int], spacing: int, first_center: int, trim: int, capture_start: float) -> DataFrame:
    """Pairs ``(condition, center_frame, radar_hr, reference_pr, ahet_verified, ...)`` of several window lengths at common
    centers, ready for the paired comparisons: all conditions are one grid with a condition column."""
    frames = [int(s * g.frame_rate_hz) for s in lengths_s]
    names = F.create_map(*[F.lit(x) for s, n in zip(lengths_s, frames, strict=True) for x in (n, f"{s}s")])
    grid = windows.common_center_grid(total_frames, frames, spacing, first_center, trim).withColumn("condition", names[F.col("window_frames")])
    est = rates(phase, g, grid, capture_start)
    keys = ["session_id", "condition", "window_index"]
    ref = reference.window_reference(est, rows, keys, max(1, int(spacing / g.frame_rate_hz)), require=True)
    got = est.join(ref, keys)
    return got.select("session_id", "condition", "center_frame", F.col("hr_bpm").alias("radar_hr"), F.col("pr_bpm_mean").alias("reference_pr"), "ahet_verified", "f_r_outlier", "harmonic_suspect")


def session_quality(features: DataFrame, checks: dict[str, dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(frames with the mask, statistics per session, longest runs)``; the features come without a window."""
    from ..functions import series

    masked = quality.quality_mask(features, checks)
    return masked, quality.mask_stats(masked), series.longest_runs(masked, "quality_mask", ["session_id"], "frame_idx")
