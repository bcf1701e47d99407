"""The archive of window results: validation as a table of violations, the verified write, and reading it back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vitals import CANDIDATES, RESULT

SCHEMA_VERSION = 1
PLACE = ("window_index", "start_frame", "end_frame", "frame_rate_hz", "start_epoch", "end_epoch")
_OF = {f.name: f.dataType for f in RESULT.fields}
SCALARS = (*PLACE, *(n for n, t in _OF.items() if not isinstance(t, T.ArrayType)))
TRIPLES = tuple(n for n, t in _OF.items() if isinstance(t, T.ArrayType) and (n.startswith(("candidate_", "second_peak_", "peak_to_floor", "comparison_", "region_"))))
PHASE_LENGTH = ("phase_window", "resp_filtered", "heart_filtered", "phase_eca")
SPECTRUM_LENGTH = ("resp_spectrum", "heart_spectrum", "heart_spectrum_first_pass")
ATTEMPTS = "ahet_attempt_spectrum"
ARRAYS = (*PHASE_LENGTH, "freqs_hz", *SPECTRUM_LENGTH, *TRIPLES, ATTEMPTS)
REQUIRED = (*SCALARS, *ARRAYS)


def check_fields(windows: DataFrame) -> None:
    """Every required field must be there, and be a number or a boolean: scalars alone, arrays flat, attempts two deep."""
    missing = [c for c in REQUIRED if c not in windows.columns]
    if missing:
        raise ValueError(f"missing fields: {missing}")
    wrong = []
    for c in REQUIRED:
        kind, depth = windows.schema[c].dataType, 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        if depth != (0 if c in SCALARS else 2 if c == ATTEMPTS else 1) or not isinstance(kind, (T.NumericType, T.BooleanType)):
            wrong.append(f"{c} {windows.schema[c].dataType.simpleString()}")
    if wrong:
        raise ValueError(f"fields of a wrong type: {wrong}")


def violations(windows: DataFrame, total_frames: int, key: str = "session_id") -> DataFrame:
    """``(key, window_index, rule, message)`` for every broken rule; empty when the archive is sound."""
    if isinstance(total_frames, bool) or not isinstance(total_frames, int) or total_frames <= 0:
        raise ValueError(f"total_frames must be a whole number above 0, not {total_frames!r}")
    check_fields(windows)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    length = F.col("end_frame") - F.col("start_frame")
    any_of = lambda conditions: reduce(Column.__or__, conditions)
    first = Window.partitionBy(key).orderBy("window_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bad = {
        "bounds": (F.col("start_frame") < 0) | (F.col("end_frame") > total_frames) | (length <= 0),
        "rate": ~(finite("frame_rate_hz") & (F.col("frame_rate_hz") > 0)),
        "epochs": ~(finite("start_epoch") & finite("end_epoch")),
        "duration": F.abs(F.col("end_epoch") - F.col("start_epoch") - F.try_divide(length, F.col("frame_rate_hz"))) > F.try_divide(F.lit(1.0), F.col("frame_rate_hz")),
        "order": F.row_number().over(Window.partitionBy(key).orderBy("window_index")) - 1 != F.col("window_index"),
        "phase_length": any_of([F.size(c) != length for c in PHASE_LENGTH]),
        "spectrum_length": any_of([F.size("freqs_hz") != F.floor(length / 2) + 1, *(F.size(c) != F.size("freqs_hz") for c in SPECTRUM_LENGTH)]),
        "candidates": any_of([*(F.size(c) != CANDIDATES for c in (*TRIPLES, ATTEMPTS)), F.exists(ATTEMPTS, lambda x: F.size(x) != F.size("freqs_hz"))]),
        # all windows of a session are of one length
        "shape": any_of([F.size(c) != F.first(F.size(c)).over(first) for c in ("phase_window", "freqs_hz")]),
        "peak_index": (F.col("resp_peak_raw_index") < 0) | (F.col("resp_peak_raw_index") >= F.size("resp_spectrum")),
        "missing": any_of([F.col(c).isNull() for c in (*PLACE, *ARRAYS)]),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in bad.items()]), lambda x: x.isNotNull())
    return windows.withColumn("_broken", found).select(key, "window_index", F.explode("_broken").alias("rule")).withColumn("message", F.concat(F.lit("window "), F.coalesce(F.col("window_index").cast("string"), F.lit("null")), F.lit(" breaks rule "), F.col("rule")))


def write_archive(windows: DataFrame, path: str, total_frames: int, key: str = "session_id") -> None:
    """Writes the archive beside ``path``, validates what was written, and then puts it in the place of an older one, which
    stays untouched when anything fails. The windows are computed once; the folder above ``path`` must exist."""
    check_fields(windows)
    spark = windows.sparkSession
    made = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    target = made(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(target.getParent()):
        raise FileNotFoundError(f"no folder for {path}")
    fresh, old = (f"{path}.{n}-{uuid.uuid4().hex}" for n in ("new", "old"))
    try:
        windows.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.parquet(fresh)
        back = spark.read.parquet(fresh)
        if back.isEmpty():
            raise ValueError("the archive has no windows")
        broken = violations(back, total_frames, key).take(3)
        if broken:
            raise ValueError("; ".join(r["message"] for r in broken))
        had = store.exists(target)
        if had:
            store.rename(target, made(old))
        if not store.rename(made(fresh), target):
            if had:
                store.rename(made(old), target)
            raise OSError(f"{path} could not be put in place")
        if had:
            store.delete(made(old), True)
    finally:
        store.delete(made(fresh), True)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A written archive; other schema versions fail."""
    back = spark.read.parquet(path)
    fits = F.col("schema_version") == SCHEMA_VERSION
    return back.where(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("unknown schema version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null")))).cast("boolean")))


def align_archive(archive: DataFrame, comparison: DataFrame, keys: tuple[str, ...] = ("session_id", "window_index")) -> DataFrame:
    """Archive rows with the comparison's further columns for the same window (row ``i`` of a file is window ``i``)."""
    more = [c for c in comparison.columns if c not in archive.columns]
    return archive.join(comparison.select(*keys, *more), list(keys))
