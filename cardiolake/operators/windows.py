"""Window grids over frame indices, as DataFrames with one row per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(**values: int) -> None:
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, int):
            raise ValueError(f"{name} must be a whole number, not {v!r}")


def sliding_grid(sessions: DataFrame, window: int, hop: int, trim: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(session_id, window_index, start_frame, end_frame)``: starts ``trim, trim + hop, ...`` while the window fits.

    ``sessions(session_id, total_frames)``; further columns named in ``keep`` go along. Ends are exclusive; frames are absolute. ``trim`` must be positive and every
    session must hold one full window, else the query fails."""
    _whole(window=window, hop=hop, trim=trim)
    if window <= 0 or hop <= 0 or trim <= 0:
        raise ValueError("window, hop and trim must be positive")
    room = F.col("total_frames") - F.lit(trim + window)
    checked = F.when(room >= 0, room).otherwise(F.raise_error(F.concat(F.lit("no full window in session "), F.col("session_id").cast("string"))).cast("bigint"))
    at = F.posexplode(F.sequence(F.lit(trim).cast("long"), F.lit(trim) + checked, F.lit(hop).cast("long")))
    return sessions.select("session_id", *keep, at.alias("window_index", "start_frame")).withColumn("end_frame", F.col("start_frame") + window)


def pipeline_grid(sessions: DataFrame, window: int, hop: int) -> DataFrame:
    """Grid relative to an already trimmed series; sessions that are too short give no row."""
    _whole(window=window, hop=hop)
    fits = sessions.where(F.col("total_frames") >= window)
    at = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("total_frames") - window, F.lit(hop).cast("long")))
    return fits.select("session_id", at.alias("window_index", "start_frame")).withColumn("end_frame", F.col("start_frame") + window)


def common_center_grid(sessions: DataFrame, lengths: list[int], spacing: int, first_center: int, trim: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(session_id, window_frames, window_index, center_frame, start_frame, end_frame)`` for centers at which windows of
    all lengths fit between ``trim`` and the end of the session."""
    _whole(spacing=spacing, first_center=first_center, trim=trim, **{f"length {x}": x for x in lengths})
    if not lengths or len(set(lengths)) != len(lengths) or any(x <= 0 or x % 2 for x in lengths):
        raise ValueError("lengths must be positive, even and distinct")
    half = max(lengths) // 2
    if trim < 0 or spacing <= 0 or first_center - half < trim:
        raise ValueError("the first center must support the longest window")
    last = F.col("total_frames") - half
    checked = F.when(last >= first_center, last).otherwise(F.raise_error(F.lit("no center supports all lengths")).cast("bigint"))
    at = F.posexplode(F.sequence(F.lit(first_center).cast("long"), checked, F.lit(spacing).cast("long")))
    centers = sessions.select("session_id", *keep, at.alias("window_index", "center_frame"))
    grid = centers.withColumn("window_frames", F.explode(F.array(*[F.lit(x) for x in lengths])))
    start = F.col("center_frame") - F.expr("window_frames div 2")
    return grid.select("session_id", *keep, "window_frames", "window_index", "center_frame", start.alias("start_frame"), (start + F.col("window_frames")).alias("end_frame"))


def with_epochs(grid: DataFrame, capture_start: Column, frame_rate_hz: float) -> DataFrame:
    """Adds ``start_epoch`` and ``end_epoch`` (Unix seconds) of each window."""
    at = lambda c: capture_start + F.col(c) / F.lit(float(frame_rate_hz))
    return grid.withColumn("start_epoch", at("start_frame")).withColumn("end_epoch", at("end_frame"))


def slices(grid: DataFrame, series: DataFrame, column: str = "phase") -> DataFrame:
    """Cuts each window out of its session's array; ``series(session_id, <column>)`` has one row per session."""
    cut = F.slice(F.col(column), (F.col("start_frame") + 1).cast("int"), (F.col("end_frame") - F.col("start_frame")).cast("int"))
    return grid.join(series.select("session_id", column), "session_id").withColumn(column, cut)


def assemble(grid: DataFrame, frames: DataFrame, column: str = "phase", bucket: int = 256, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Each window of the grid with the array of its frames' values, from ``frames(keys, frame_idx, <column>)``.

    Frames are packed into buckets of ``bucket`` indices, windows ask for the buckets that they touch, and both meet by (keys, bucket);
    what a window got is put in order and cut to its bounds. So no row holds more than a window and two buckets, and one session's
    windows spread over all tasks. A window that lacks frames, or has one twice, fails the query: an estimate over a gap would be
    wrong. Windows of one session must be told apart by the grid's columns."""
    at = F.floor(F.col("frame_idx") / F.lit(bucket)).cast("long")
    packed = frames.groupBy(*keys, at.alias("_bucket")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", F.col(column).alias("v")))).alias("_part"))
    first, last = F.floor(F.col("start_frame") / F.lit(bucket)), F.floor((F.col("end_frame") - 1) / F.lit(bucket))
    asked = grid.withColumn("_bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    inside = F.filter("_part", lambda x: (x["frame_idx"] >= F.col("start_frame")) & (x["frame_idx"] < F.col("end_frame")))
    met = asked.join(packed, [*keys, "_bucket"], "left").withColumn("_part", inside)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_part"))), lambda x: x["_part"]))
    got = met.groupBy(*grid.columns).agg(whole.alias("_whole"))
    full = (F.size("_whole") == F.col("end_frame") - F.col("start_frame")) & (F.size(F.array_distinct(F.transform("_whole", lambda x: x["frame_idx"]))) == F.size("_whole"))
    message = F.concat(F.lit("window of frames "), F.col("start_frame").cast("string"), F.lit(" to "), F.col("end_frame").cast("string"), F.lit(" lacks frames or has some twice"))
    value = F.when(full, F.transform("_whole", lambda x: x["v"])).otherwise(F.raise_error(message).cast(f"array<{dict(frames.dtypes)[column]}>"))
    return got.select(*grid.columns, value.alias(column))
