"""Raw radar captures as a Spark data source: one row per frame, read by ranges, split files seen as one.

``spark.read.format("radar_adc").option("paths", "a_0.bin;a_1.bin").option("session_id", "a")...load()``, or for many sessions
``.option("captures", json)`` with a list of ``{"session_id", "paths", "trim_frames", "end_frame"}``.

Options: ``paths`` (``;`` between), ``session_id``, ``trim_frames`` (0), ``end_frame`` (all) of one capture, or ``captures``; ``chirps``,
``rx``, ``samples``, ``frames_per_partition`` (256). A path is a URI of any store that Arrow opens, or a plain path. All files must
exist before anything is read; the sum of a capture's sizes must be a whole number of frames, so a frame may begin in one file and end
in the next. Frame indices are absolute. A task opens its capture's files once and reads its range alone; a filter on ``frame_idx`` or
``session_id`` narrows the ranges (Spark asks for ``spark.sql.python.filterPushdown.enabled`` to be on, which ``read_captures`` sets). ``frames_from_binary`` takes whole files from
stores that only Spark reads.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.vitals import Geometry
from . import stores

SCHEMA = "session_id string, frame_idx long, raw binary"
BATCH_FRAMES = 64


def frame_count(sizes: list[int], frame_bytes: int) -> int:
    """Frames in files of these sizes; they must add up to a whole number of frames, at least one."""
    frames, rest = divmod(sum(sizes), frame_bytes)
    if rest or not frames:
        raise ValueError(f"{sum(sizes)} bytes are not a whole number of frames of {frame_bytes} bytes")
    return frames


def check_trim(trim: int, frames: int) -> None:
    if not 0 <= trim < frames:
        raise ValueError(f"trim must lie in 0..{frames - 1}, not {trim}")


def expect_frames(found: int, expected: int | None, allow_mismatch: bool = False) -> None:
    if expected is not None and found != expected and not allow_mismatch:
        raise ValueError(f"{found} frames found, {expected} expected")


def resolve_paths(folder: str, session_id: str) -> list[str]:
    """``<id>_0.bin`` (with ``<id>_1.bin``) before ``<id>.bin``; ``folder`` is a path or a URI."""
    at = [f"{folder.rstrip('/')}/{session_id}{end}.bin" for end in ("_0", "_1", "")]
    first, second, whole = (size is not None for size in stores.sizes(at))
    if first:
        return at[:2] if second else at[:1]
    if not whole:
        raise FileNotFoundError(f"no capture of {session_id} in {folder}")
    return at[2:]


def file_sizes(paths: list[str]) -> list[int]:
    """Sizes of a capture's files, all of which must exist."""
    found = stores.sizes(paths)
    missing = [p for p, size in zip(paths, found, strict=True) if size is None]
    if missing or not paths:
        raise FileNotFoundError(f"missing capture files: {missing or 'none given'}")
    return found


@dataclass(frozen=True)
class Capture:
    """One session's files and the frames that are wanted of it."""

    session_id: str
    paths: tuple[str, ...]
    sizes: tuple[int, ...]
    first: int
    stop: int


class Frames(InputPartition):
    def __init__(self, capture: Capture, first: int, stop: int):
        self.capture, self.first, self.stop = capture, first, stop


class AdcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        g = Geometry(int(options.get("chirps", 32)), int(options.get("rx", 4)), int(options.get("samples", 256)))
        self.frame_bytes, self.step = g.frame_bytes, int(options.get("frames_per_partition", 256))
        if options.get("captures"):
            asked = json.loads(options["captures"])
        else:
            asked = [{"session_id": options.get("session_id", ""), "paths": [p for p in options.get("paths", options.get("path", "")).split(";") if p], "trim_frames": options.get("trim_frames", 0), "end_frame": options.get("end_frame")}]
        flat = iter(file_sizes([p for x in asked for p in x["paths"]]))
        self.captures = [self._capture(x, [next(flat) for _ in x["paths"]]) for x in asked]
        self.low, self.high, self.sessions = 0, None, None

    def _capture(self, asked: dict, sizes: list[int]) -> Capture:
        frames = frame_count(sizes, self.frame_bytes)
        first = int(asked.get("trim_frames") or 0)
        check_trim(first, frames)
        stop = frames if asked.get("end_frame") is None else min(frames, int(asked["end_frame"]))
        return Capture(asked["session_id"], tuple(asked["paths"]), tuple(sizes), first, stop)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes bounds of ``frame_idx`` and sets of ``session_id``; Spark applies all others."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("frame_idx",) and isinstance(value, int):
                if isinstance(f, (ds.GreaterThanOrEqual, ds.GreaterThan)):
                    self.low = max(self.low, value + isinstance(f, ds.GreaterThan))
                    continue
                if isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                    stop = value + isinstance(f, ds.LessThanOrEqual)
                    self.high = stop if self.high is None else min(self.high, stop)
                    continue
            if column == ("session_id",) and isinstance(f, (ds.EqualTo, ds.In)) and value is not None:
                some = set(value) if isinstance(f, ds.In) else {value}
                self.sessions = some if self.sessions is None else self.sessions & some
                continue
            yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for c in self.captures:
            if self.sessions is None or c.session_id in self.sessions:
                first, stop = max(c.first, self.low), c.stop if self.high is None else min(c.stop, self.high)
                out += [Frames(c, a, min(a + self.step, stop)) for a in range(first, stop, self.step)]
        return out or [Frames(self.captures[0], 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        n, c = self.frame_bytes, partition.capture
        whole = stores.Joined(list(c.paths), list(c.sizes))
        try:
            for a in range(partition.first, partition.stop, BATCH_FRAMES):
                b = min(a + BATCH_FRAMES, partition.stop)
                data = whole.read(a * n, b * n)
                yield pa.record_batch([pa.array([c.session_id] * (b - a)), pa.array(range(a, b), pa.int64()), pa.array([data[i : i + n] for i in range(0, len(data), n)], pa.binary())], names=["session_id", "frame_idx", "raw"])
        finally:
            whole.close()


class AdcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "radar_adc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AdcReader:
        return AdcReader(self.options)


def _reader(spark: SparkSession, g: Geometry):
    spark.dataSource.register(AdcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("radar_adc").option("chirps", g.chirps).option("rx", g.rx).option("samples", g.samples)


def read_capture(spark: SparkSession, paths: list[str], session_id: str, g: Geometry, trim_frames: int = 0, end_frame: int | None = None) -> DataFrame:
    return read_captures(spark, [{"session_id": session_id, "paths": paths, "trim_frames": trim_frames, "end_frame": end_frame}], g)


def read_captures(spark: SparkSession, captures: list[dict], g: Geometry) -> DataFrame:
    """Frames of many sessions as one scan: ``captures`` has ``session_id``, ``paths`` and, if wanted, ``trim_frames`` and ``end_frame`` of each."""
    return _reader(spark, g).option("captures", json.dumps(captures)).load()


def frames_from_binary(files: DataFrame, g: Geometry) -> DataFrame:
    """Frames of whole files in a ``binaryFile`` frame with a ``session_id``, for stores without a mount; one file per session."""
    n = g.frame_bytes
    cut = F.sequence(F.lit(0).cast("long"), F.expr(f"length(content) div {n}") - 1)
    return files.select("session_id", "content", F.explode(cut).alias("frame_idx")).select("session_id", "frame_idx", F.substring("content", (F.col("frame_idx") * n + 1).cast("int"), F.lit(n)).alias("raw"))


def sanity_report(features: DataFrame, resolution_m: float, trim: int = 0, frames: int = 100, gate: tuple[int, int] = (20, 45), expected_m: float = 1.4, tolerance_m: float = 0.2) -> DataFrame:
    """Per session: the five strongest bins of the first frames (positive half, without bin 0), the gate's peak and whether
    it lies within ``tolerance_m`` of the expected distance. ``features`` come without a window."""
    first = features.where(f"frame_idx >= {trim} AND frame_idx < {trim + frames}")
    half = F.slice("bin_energy", 1, (F.size("bin_energy") / 2).cast("int"))
    bins = first.select("session_id", F.posexplode(half).alias("bin_idx", "e")).groupBy("session_id", "bin_idx").agg(F.avg("e").alias("energy"))
    ranked = F.slice(F.array_sort(F.collect_list(F.when(F.col("bin_idx") > 0, F.struct((-F.col("energy")).alias("minus"), "bin_idx")))), 1, 5)
    peak = F.min_by(F.when(F.col("bin_idx").between(*gate), F.col("bin_idx")), F.when(F.col("bin_idx").between(*gate), F.struct(-F.col("energy"), F.col("bin_idx"))))
    got = bins.groupBy("session_id").agg(F.transform(ranked, lambda x: x["bin_idx"]).alias("top_bins"), peak.alias("gate_bin"))
    distance = F.col("gate_bin") * F.lit(resolution_m)
    return got.withColumn("gate_range_m", distance).withColumn("plausible", F.abs(distance - expected_m) <= tolerance_m)
