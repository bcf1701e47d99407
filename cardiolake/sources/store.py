"""A store of sessions: frames (cubes or quality) and attributes that change together, by versions and one marker per commit.

::

    <path>/versions/<version>/frames|attributes|sessions
    <path>/commits/<number>-<version>

A writer puts its sessions' frames and attributes into a version of its own, and then creates one empty marker. Until that exists nobody
sees the version, so a failure anywhere leaves the pair of before. Each session is read from the last commit that holds it, frames and
attributes from the same one; of two writers with one number the larger name counts, for all readers alike. Creating a file is
all that the file system must do at once.

Frames are dealt to tasks by session and run of frames and sorted, so one long session is written by many tasks. ``vacuum`` deletes what later commits
have replaced.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frames of a session that are written by one task.
RUN = 8192
_TABLES = ("frames", "attributes", "sessions")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)


def commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of all commits, in order."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(f"{path}/commits")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(f"{path}/commits"))]
    return sorted((int(n), v) for n, _, v in (x.partition("-") for x in names if x[:1].isdigit()))


def stage(frames: DataFrame, attributes: DataFrame, path: str) -> str:
    """Writes a version that nobody sees yet; returns its name. Sessions without frames or without attributes count, too."""
    version = uuid.uuid4().hex
    where = f"{path}/versions/{version}"
    run = F.floor(F.col("frame_idx") / F.lit(RUN))
    ordered = frames.repartition("session_id", run).sortWithinPartitions("session_id", "frame_idx")
    ordered.write.option("parquet.block.size", 16 << 20).partitionBy("session_id").parquet(f"{where}/frames")
    attributes.select("session_id", "name", "value").write.parquet(f"{where}/attributes")
    spark = frames.sparkSession
    both = [_typed(spark, f"{where}/{t}").select("session_id") for t in ("frames", "attributes")]
    both[0].union(both[1]).distinct().write.parquet(f"{where}/sessions")
    return version


def commit(spark: SparkSession, path: str, version: str) -> int:
    """Makes a staged version visible."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(f"{path}/versions/{version}/sessions/_SUCCESS")):
        raise FileNotFoundError(f"version {version} was not staged")
    number = max((n for n, _ in commits(spark, path)), default=0) + 1
    fs.create(at(f"{path}/commits/{number:012}-{version}"), False).close()
    return number


def write_store(frames: DataFrame, attributes: DataFrame, path: str) -> int:
    """Replaces the sessions that ``frames(session_id, frame_idx, ...)`` or ``attributes(session_id, name, value)`` hold, in one commit."""
    return commit(frames.sparkSession, path, stage(frames, attributes, path))


def _typed(spark: SparkSession, path: str) -> DataFrame:
    """A table whose sessions are strings, also such as ``007``, which partition names would turn into numbers."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name == "session_id" else f for f in found])).parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """``(session_id, place)``: for each session the place, among ``commits``, of the commit that it is read from."""
    held = [_typed(spark, f"{path}/versions/{v}/sessions").withColumn("place", F.lit(i)) for i, (_, v) in enumerate(commits(spark, path))]
    if not held:
        raise FileNotFoundError(f"{path} has no commit")
    return reduce(DataFrame.union, held).groupBy("session_id").agg(F.max("place").alias("place"))


def read(spark: SparkSession, path: str, table: str, sessions: list[str] | None = None) -> DataFrame:
    """``frames`` or ``attributes`` as of the last commit. Later versions may have more columns; older rows have nulls there."""
    now = latest(spark, path)
    if sessions is not None:
        now = now.where(F.col("session_id").isin(sessions))
    # few places: one for each commit that still counts
    used = {r["place"] for r in now.select("place").distinct().collect()}
    parts = []
    for place, (_, version) in enumerate(commits(spark, path)):
        if place in used or (not used and place == 0):
            part = _typed(spark, f"{path}/versions/{version}/{table}")
            parts.append((part if sessions is None else part.where(F.col("session_id").isin(sessions))).withColumn("_place", F.lit(place)))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = now.select(F.col("session_id").alias("_session"), "place")
    return every.join(names, F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("_place") == F.col("place")), "left_semi").drop("_place")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes versions of which no session is read any more, first their markers; returns their names. Versions without a marker stay, as
    someone may be writing them. Not to be run while others read."""
    fs, at = _fs(spark, path)
    used, gone = {r["place"] for r in latest(spark, path).select("place").distinct().collect()}, []
    for place, (number, version) in enumerate(commits(spark, path)):
        if place not in used:
            fs.delete(at(f"{path}/commits/{number:012}-{version}"), False)
            fs.delete(at(f"{path}/versions/{version}"), True)
            gone.append(version)
    return gone
