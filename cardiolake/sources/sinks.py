"""Sinks: JSON without NaN, comparison files, per-session tables, provenance, plain-text reports."""

from __future__ import annotations

import copy
import datetime
import hashlib
import json
import os
import platform
import subprocess
import sys
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import stores

#: Characters of the changes that a provenance record keeps.
DIFF_CHARS = 200_000


def without_nan(column: Column, kind: T.DataType) -> Column:
    """Null for NaN and infinities, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: without_nan(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[without_nan(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: without_nan(v, kind.valueType))
    return column


def to_json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as one JSON text; unknown numbers are ``null`` and stay in the text."""
    fields = [without_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(out))


def write_json(df: DataFrame, path: str) -> None:
    to_json_rows(df, "value").write.mode("overwrite").text(path)


def write_comparison(df: DataFrame, path: str) -> None:
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_sessions(df: DataFrame, path: str) -> None:
    """Replaces only the sessions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def write_captures(frames: DataFrame, folder: str, frames_per_file: int = 4096, cut: int = 0) -> DataFrame:
    """Writes ``frames(session_id, frame_idx, raw)``, whose indices begin at 0 and have no gaps, as raw captures in a store that Arrow opens;
    returns ``(session_id, paths)`` with each session's files in order. A file has about ``frames_per_file`` frames; with ``cut``, it is
    split once more after that many bytes, within a frame. Runs of frames are written by tasks of their own under names of their own,
    and only those that a finished task returns are listed, so a repeated task does no harm."""

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        data, out = b"".join(pdf["raw"]), []
        for k, part in enumerate((data[:cut], data[cut:]) if 0 < cut < len(data) else (data,)):
            uri = f"{folder}/{uuid.uuid4().hex}.bin"
            store, path = stores.locate(uri)
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as f:
                f.write(part)
            out.append((int(pdf["run"].iloc[0]), k, uri))
        return pd.DataFrame(out, columns=["run", "piece", "uri"]).assign(session_id=pdf["session_id"].iloc[0])

    run = F.floor(F.col("frame_idx") / F.lit(frames_per_file)).cast("long").alias("run")
    # the listing is written by this query once: a second run would write other files
    listing = written(frames.select("session_id", "frame_idx", "raw", run).groupBy("session_id", "run").applyInPandas(put, "run long, piece int, uri string, session_id string"), "captures")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("run", "piece", "uri"))), lambda x: x["uri"])
    return listing.groupBy("session_id").agg(ordered.alias("paths"))


def append_log(lines: DataFrame, path: str) -> None:
    """Adds text rows to a log, which is a folder of text files."""
    lines.write.mode("append").text(path)


class Tee:
    """Standard output that also goes to a file, while the ``with`` block runs."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self) -> Tee:
        self.out, self.file = sys.stdout, open(self.path, "a", encoding="utf-8")  # noqa: SIM115
        sys.stdout = self
        return self

    def write(self, text: str) -> int:
        self.file.write(text)
        return self.out.write(text)

    def flush(self) -> None:
        self.file.flush()
        self.out.flush()

    def __exit__(self, *_) -> None:
        sys.stdout = self.out
        self.file.close()


def write_config(config: dict, path: str) -> None:
    """Snapshot of a run's configuration: YAML, or JSON (which YAML readers take as well) where PyYAML is absent."""
    try:
        import yaml

        text = yaml.safe_dump(config, sort_keys=False, allow_unicode=True)
    except ImportError:
        text = json.dumps(config, indent=2, ensure_ascii=False)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def fixed_width(df: DataFrame, formats: dict[str, str], out: str = "line") -> DataFrame:
    """Rows as text by printf formats, for reports."""
    return df.select(F.format_string(" ".join(formats.values()), *[F.col(c) for c in formats]).alias(out))


def provenance(folder: str, files: list[str], config: dict) -> dict:
    """Commit, dirtiness, changes (against the commit, cut to ``DIFF_CHARS``), untracked files, checksums of sources (``missing`` where
    absent), versions, time and a copy of the configuration. Without git those fields are null."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, check=True, timeout=30).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    def checksum(path: str) -> str:
        try:
            with open(os.path.join(folder, path), "rb") as f:
                return hashlib.sha256(f.read()).hexdigest()
        except OSError:
            return "missing"

    import pyspark

    status, diff, new = git("status", "--porcelain"), git("diff", "HEAD"), git("ls-files", "--others", "--exclude-standard")
    return {"commit": git("rev-parse", "HEAD"), "dirty": None if status is None else bool(status), "diff": diff and diff[:DIFF_CHARS], "untracked": None if new is None else new.splitlines(), "sources": {f: checksum(f) for f in files}, "python": platform.python_version(), "pyspark": pyspark.__version__, "time": datetime.datetime.now(datetime.UTC).isoformat(), "config": copy.deepcopy(config)}
