"""Live phase: unwrapped and clipped phase of a stream of phasors, with the last phasor per session as state.

The batch form is ``functions.series``; replaying a session through the stream gives the same series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "angle double, total double"
OUTPUT = "session_id string, frame_idx long, phase double"


class Unwrap(StatefulProcessor):
    """State: the last angle and the running sum. Frames of a session must arrive in order across batches; within a batch
    they are sorted."""

    def __init__(self, limit: float = 1.5):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("frame_idx")
        angle = np.arctan2(pdf["im"].to_numpy(float), pdf["re"].to_numpy(float))
        before, total = self.last.get() if self.last.exists() else (angle[0], 0.0)
        step = np.diff(np.concatenate(([before], angle)))
        folded = np.mod(step + np.pi, 2 * np.pi) - np.pi
        folded[(folded == -np.pi) & (step > 0)] = np.pi
        step = np.where(np.abs(step) >= np.pi, folded, step)
        phase = total + np.cumsum(np.clip(step, -self.limit, self.limit))
        self.last.update((float(angle[-1]), float(phase[-1])))
        yield pd.DataFrame({"session_id": key[0], "frame_idx": pdf["frame_idx"].to_numpy(), "phase": phase})

    def close(self) -> None:
        pass


def live_phase(stream: DataFrame, limit: float = 1.5) -> DataFrame:
    """``stream(session_id, frame_idx, re, im)`` to ``(session_id, frame_idx, phase)``; needs the RocksDB state store."""
    return stream.groupBy("session_id").transformWithStateInPandas(Unwrap(limit), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
