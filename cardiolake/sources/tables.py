"""Text sources: capture logs, the reference monitor's CSV, manifests, comparison files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reference
from . import store

# header of the monitor's export -> column (fixed names of the file format)
REFERENCE_COLUMNS = {
    "Session": "session", "Index": "index", "Timestamp": "epoch_utc", "O2 Saturation": "spo2",
    "Beats / min": "pr_bpm", "Perfusion Index": "pi", "Pleth Variability": "pvi", "Breaths / min": "rr_bpm",
}
MARKERS = {"Capture start time": "start", "Capture end time": "end", "Duration(sec)": "duration"}


def capture_log(spark: SparkSession, path: str, utc_offset_hours: int = 3) -> DataFrame:
    """One row ``(start_epoch_utc, end_epoch_utc, duration_s)``; of repeated lines the last counts, a missing one fails."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    key, value = F.trim(F.split("value", " - ", 2)[0]), F.trim(F.split("value", " - ", 2)[1])
    name = F.coalesce(*[F.when(key.contains(m), F.lit(n)) for m, n in MARKERS.items()])
    found = lines.select("at", name.alias("name"), value.alias("v")).where("name IS NOT NULL AND v IS NOT NULL")
    last = {n: F.max_by(F.when(F.col("name") == n, F.col("v")), F.when(F.col("name") == n, F.col("at"))) for n in MARKERS.values()}
    need = lambda n: F.coalesce(last[n], F.raise_error(F.lit(f"the log lacks its {n} line")).cast("string"))
    # the weekday is dropped: its letter is no pattern of to_timestamp
    epoch = lambda c: F.unix_seconds(F.to_timestamp(F.substring(c, 5, 40), "MMM dd HH:mm:ss yyyy")) - 3600 * utc_offset_hours
    row = found.agg(*[need(n).alias(n) for n in MARKERS.values()])
    return row.select(epoch(F.col("start")).alias("start_epoch_utc"), epoch(F.col("end")).alias("end_epoch_utc"), F.col("duration").cast("int").alias("duration_s"))


def reference_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The merged one-hertz series, and its one-row coverage. Unreadable numbers become null; missing headers fail."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in REFERENCE_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kinds = {"session": "int", "index": "int", "epoch_utc": "bigint"}
    cols = [F.expr(f"try_cast(`{h}` AS {kinds.get(c, 'double')})").alias(c) for h, c in REFERENCE_COLUMNS.items()]
    rows = raw.select(*cols, F.monotonically_increasing_id().alias("row_no")).where("epoch_utc IS NOT NULL")
    merged = reference.merge_duplicates(rows, ["spo2", "pr_bpm", "pi", "pvi", "rr_bpm"], ["session", "index"], "row_no")
    return merged.orderBy("epoch_utc"), reference.coverage(rows)


def manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sessions with ``distance_m``, the whole-number ``locked_bin`` (else null) and the stationary seconds ``trim_s, end_s``."""
    raw = spark.read.option("header", True).csv(path)
    if "locked_bin" not in raw.columns:
        raw = raw.withColumn("locked_bin", F.lit(None).cast("string"))
    b = F.expr("try_cast(locked_bin AS double)")
    span = F.split("stationary_intervals", "-")
    return raw.select(
        *[c for c in raw.columns if c not in ("locked_bin", "radar_start_epoch_seconds")],
        F.expr("try_cast(radar_start_epoch_seconds AS double)").alias("radar_start_epoch_seconds"),
        F.expr("try_cast(distance_cm AS double) / 100").alias("distance_m"),
        F.when(~F.isnan(b) & (b == F.floor(b)), b.cast("int")).alias("locked_bin"),
        F.get(span, F.lit(0)).try_cast("int").alias("trim_s"), F.get(span, F.lit(1)).try_cast("int").alias("end_s"),
    )


def comparison_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A comparison file with typed columns; ``True``/``False`` become booleans."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_frames(spark: SparkSession, path: str, trim_frames: int = 0, sessions: list[str] | None = None) -> DataFrame:
    """Frames of a store from ``trim_frames`` on, as of its last commit; the trim and the sessions reach the scan."""
    return store.read(spark, path, "frames", sessions).where(F.col("frame_idx") >= trim_frames)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """``(session_id, name, value)`` of a store."""
    return store.read(spark, path, "attributes")


def stored_metric(spark: SparkSession, path: str, metric: str = "subject_bin_energy", flag: str = "motion_spike_flagged", settings: dict[str, str] | None = None) -> DataFrame:
    """A stored metric with its stored flag, and per session the stored ``settings`` (name: fallback) as columns; fails where the
    store lacks the metric."""
    frames = read_frames(spark, path)
    missing = [c for c in (metric, flag) if c not in frames.columns]
    if missing:
        raise KeyError(f"the store has no {missing}")
    settings = settings if settings is not None else {"motion_spike_factor": "5.0", "motion_spike_half_window": "10", "motion_spike_bin": "-1"}
    wide = read_attributes(spark, path).groupBy("session_id").agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(v)).alias(n) for n, v in settings.items()])
    got = frames.select("session_id", "frame_idx", metric, flag).join(wide, "session_id", "left")
    return got.select("session_id", "frame_idx", metric, flag, *[F.coalesce(n, F.lit(v)).alias(n) for n, v in settings.items()])


def read_config(path: str) -> dict:
    """A run's configuration in YAML (JSON where PyYAML is absent); anything but a mapping fails."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        config = yaml.safe_load(text)
    except ImportError:
        config = json.loads(text)
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no mapping")
    return config


def updated_manifest(manifest: DataFrame, bins: DataFrame) -> DataFrame:
    """The manifest with newly selected bins where there are any; write it to a new path."""
    new = bins.select("session_id", F.col("bin_idx").alias("_new"))
    return manifest.join(new, "session_id", "left").withColumn("locked_bin", F.coalesce(F.col("_new").cast("int"), "locked_bin")).drop("_new")
