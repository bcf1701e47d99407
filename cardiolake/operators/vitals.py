"""From frames to rates: range features, bin selection, the phase series, and estimates per window."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dsp, series

FEATURES = "session_id string, frame_idx long, max_abs_adc double, frame_energy double, rx_energy array<double>, bin_energy array<double>, mean_re array<double>, mean_im array<double>, phasor_re array<double>, phasor_im array<double>"


@dataclass(frozen=True)
class Geometry:
    """Shape of one frame: ``chirps x rx x samples`` complex values."""

    chirps: int = 32
    rx: int = 4
    samples: int = 256
    frame_rate_hz: float = 20.0
    range_resolution_m: float = 0.05

    @property
    def frame_bytes(self) -> int:
        return self.chirps * self.rx * self.samples * 4


def decode(raw: bytes, g: Geometry) -> np.ndarray:
    """Complex samples of a frame from packets ``[I0, I1, Q0, Q1]`` of little-endian 16-bit words."""
    words = np.frombuffer(raw, "<i2").astype(np.float64).reshape(-1, 2, 2)
    return (words[:, 0, :] + 1j * words[:, 1, :]).reshape(g.chirps, g.rx, g.samples)


def _squared(z: np.ndarray) -> np.ndarray:
    """Squared magnitudes without a root, so that those of whole parts stay exact."""
    return z.real**2 + z.imag**2


@functools.cache
def _factors(n: int) -> list[np.ndarray]:
    """Cosines and sines of bins and samples, by sample first."""
    return [np.array([[f(2 * math.pi * k * s / n) for k in range(n)] for s in range(n)]) for f in (math.cos, math.sin)]


def _by_sums(cube: np.ndarray) -> np.ndarray:
    """The transform of the last axis as SQL writes it: sums over the samples in their order, with factors as the C library rounds them. Its
    last bits, which decide halves and ties of thresholds, are then those of the SQL."""
    cos, sin = _factors(cube.shape[-1])
    re, im = cube.real[..., None], cube.imag[..., None]
    z = np.empty(cube.shape, np.complex128)
    z.real = (re * cos + im * sin).cumsum(axis=-2)[..., -1, :]
    z.imag = (im * cos - re * sin).cumsum(axis=-2)[..., -1, :]
    return z


def _in_order(x: np.ndarray) -> np.ndarray:
    """Means over chirps and receivers, added up one after the other."""
    rows = x.reshape(-1, x.shape[-1])
    return rows.cumsum(axis=0)[-1] / len(rows)


def range_features(frames: DataFrame, g: Geometry, windowed: bool = True, phase_bin: int | None = None, real: bool = False, by_sums: bool = False) -> DataFrame:
    """One row of small features per frame; the cube and its transform stay inside the task.

    ``frames(session_id, frame_idx, raw)``. ``bin_energy``: mean squared magnitude per bin; ``mean_re/mean_im``: mean phasor
    per bin; ``phasor_re/phasor_im``: the phasors of ``phase_bin`` per chirp and receiver (null without one). Double
    precision throughout. With ``windowed`` a Hann window precedes the transform; ``real`` drops the quadrature part and gives
    ``samples // 2 + 1`` bins; ``by_sums`` takes plain sums instead of a fast transform (for frames of few samples)."""
    if real and by_sums:
        raise ValueError("plain sums are of complex samples")
    window = np.hanning(g.samples) if windowed else np.ones(g.samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("session_id", pa.string()), ("frame_idx", pa.int64()), ("max_abs_adc", pa.float64()), ("frame_energy", pa.float64()), *[(c, pa.list_(pa.float64())) for c in ("rx_energy", "bin_energy", "mean_re", "mean_im", "phasor_re", "phasor_im")]])
        for batch in batches:
            rows = []
            for session, index, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cube = decode(raw, g)
                if real:
                    cube = cube.real
                power = _squared(cube)
                z = _by_sums(cube * window) if by_sums else (np.fft.rfft if real else np.fft.fft)(cube * window, axis=2)
                mean, energy = (_in_order(z), _in_order(_squared(z))) if by_sums else (z.mean(axis=(0, 1)), _squared(z).mean(axis=(0, 1)))
                one = z[:, :, phase_bin].ravel() if phase_bin is not None else None
                peak = max(np.abs(cube.real).max(), np.abs(cube.imag).max())
                rows.append((session, index, peak, power.mean(), power.mean(axis=(0, 2)), energy, mean.real, mean.imag, None if one is None else one.real, None if one is None else one.imag))
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return frames.select("session_id", "frame_idx", "raw").mapInArrow(run, FEATURES)


def mean_range_energy(features: DataFrame) -> DataFrame:
    """``(session_id, bin_idx, energy)``: mean over frames, summed partly before the shuffle."""
    e = features.select("session_id", F.posexplode("bin_energy").alias("bin_idx", "e"))
    return e.groupBy("session_id", "bin_idx").agg(F.avg("e").alias("energy"))


def in_gate(bins: DataFrame, resolution_m: float, gate: tuple[Column, Column], require: bool = False) -> DataFrame:
    """Bins whose distance lies in the gate, both ends included. With ``require``, a session without a bin in its gate fails the query
    (else it has no row)."""
    if require:
        d = bins.withColumn("range_m", F.col("bin_idx") * F.lit(resolution_m)).withColumn("_in", (F.col("range_m") >= gate[0]) & (F.col("range_m") <= gate[1]))
        message = F.concat(F.lit("no range bin lies in the gate of session "), F.coalesce(F.col("session_id").cast("string"), F.lit("null")))
        whole = d.groupBy("session_id").agg(F.count_if("_in").alias("_n"), F.collect_list(F.when(F.col("_in"), F.struct(*[c for c in d.columns if c not in ("session_id", "_in")]))).alias("_bins"))
        checked = F.when(F.col("_n") > 0, F.col("_bins")).otherwise(F.raise_error(message).cast(whole.schema["_bins"].dataType))
        return whole.select("session_id", F.explode(checked).alias("_b")).select("session_id", "_b.*")
    d = bins.withColumn("range_m", F.col("bin_idx") * F.lit(resolution_m))
    return d.where((F.col("range_m") >= gate[0]) & (F.col("range_m") <= gate[1]))


def distance_gate(distance_m: Column, half_width_m: float = 0.20) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), distance_m - half_width_m), distance_m + half_width_m


def select_bin(gated: DataFrame) -> DataFrame:
    """The strongest bin per session, the first of equals."""
    return gated.groupBy("session_id").agg(F.min_by(F.struct("bin_idx", "range_m", "energy"), F.struct(-F.col("energy"), F.col("bin_idx"))).alias("b")).select("session_id", "b.*")


def top_bins(bins: DataFrame, n: int = 5) -> DataFrame:
    """The strongest bins of each session, without the one at distance 0."""
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy(F.desc("energy"), "bin_idx")
    return bins.where("bin_idx > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def range_profile_db(features: DataFrame, g: Geometry, max_range_m: float) -> DataFrame:
    """Range profile per frame in decibels, positive half up to ``max_range_m``; the features come without a window (the mean
    over chirps and receivers commutes with the transform)."""
    m = F.zip_with("mean_re", "mean_im", lambda a, b: F.sqrt(a * a + b * b))
    rows = features.select("session_id", "frame_idx", F.posexplode(F.slice(m, 1, g.samples // 2)).alias("bin_idx", "m"))
    at = rows.withColumn("range_m", F.col("bin_idx") * F.lit(g.range_resolution_m)).where(F.col("range_m") <= max_range_m)
    return at.select("session_id", "frame_idx", "bin_idx", "range_m", (20 * F.log10(F.col("m") + 1e-10)).alias("db"))


def phase_series(features: DataFrame, bins: DataFrame, limit: float = 1.5) -> DataFrame:
    """``(session_id, frame_idx, phase)``: angle of the mean phasor at each session's bin, unwrapped and clipped."""
    at = features.select("session_id", "frame_idx", "mean_re", "mean_im").join(bins.select("session_id", "bin_idx"), "session_id")
    angle = at.select("session_id", "frame_idx", series.phase(F.get("mean_re", F.col("bin_idx")), F.get("mean_im", F.col("bin_idx"))).alias("angle"))
    whole = series.unwrap(angle, "angle", "unwrapped", ["session_id"], "frame_idx", keep=True)
    return series.impulse_clip(whole, "unwrapped", "phase", ["session_id"], "frame_idx", limit).select("session_id", "frame_idx", "phase")


def as_arrays(phase: DataFrame) -> DataFrame:
    """One row per session with its whole series in frame order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "phase"))), lambda x: x["phase"])
    return phase.groupBy("session_id").agg(ordered.alias("phase"))


_SCALARS = {
    "resp_peak_raw_index": "int", "resp_peak_raw_hz": "double", "resp_peak_refined_hz": "double", "heart_spectrum_stage": "int", "heart_peak_hz": "double", "accepted_candidate_rank": "int",
    "accepted_candidate_initial_hz": "double", "accepted_candidate_refined_hz": "double", "accepted_second_harmonic_refined_hz": "double", "eca_applied": "boolean", "f_r_outlier": "boolean", "ahet_verified": "boolean", "harmonic_suspect": "boolean", "hr_bpm": "double", "rr_bpm": "double", "f_r_hz_used": "double",
}
_TRIPLES = {
    "candidate_attempted": "boolean", "candidate_peak_bin_index": "int", "candidate_initial_hz": "double", "candidate_refined_hz": "double", "candidate_peak_magnitude": "double", "candidate_prominence": "double", "candidate_argmax_fallback": "boolean",
    "second_peak_bin_hz": "double", "second_peak_refined_hz": "double", "second_peak_magnitude": "double", "comparison_floor": "double", "peak_to_floor_ratio": "double", "peak_to_floor_ratio_db": "double", "region_available": "boolean", "candidate_passed": "boolean",
}
_ARRAYS = ("phase_window", "resp_filtered", "heart_filtered", "phase_eca", "freqs_hz", "resp_spectrum", "heart_spectrum", "heart_spectrum_first_pass")
_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
RESULT = T.StructType([*(T.StructField(k, _TYPES[v]) for k, v in _SCALARS.items()), *(T.StructField(k, T.ArrayType(_TYPES[v])) for k, v in _TRIPLES.items()), *(T.StructField(k, T.ArrayType(T.DoubleType())) for k in _ARRAYS), T.StructField("ahet_attempt_spectrum", T.ArrayType(T.ArrayType(T.DoubleType())))])


CANDIDATES = dsp.CANDIDATES


def window_results(phases: np.ndarray, fs: float, use_eca: bool, k_max: list[int], heart: tuple[float, float], breath: tuple[float, float]) -> list[dict]:
    """All evidence of windows of one length, ``phases (windows, time)``: filters and their spectra run over all windows at once,
    only the choice of candidates goes window by window."""
    x = phases - phases.mean(axis=1, keepdims=True)
    calm = dsp.breathing(dsp.band_pass(x, fs, *breath), fs, breath)
    f_r = np.array([r["refined_hz"] for r in calm])
    plausible = (f_r >= dsp.PLAUSIBLE_BREATH[0]) & (f_r <= dsp.PLAUSIBLE_BREATH[1]) & use_eca
    filtered = np.empty_like(x)
    for some, top in ((plausible, min(2 * heart[1], 0.45 * fs)), (~plausible, heart[1])):
        if some.any():
            filtered[some] = dsp.band_pass(x[some], fs, heart[0], top)
    out = []
    for i, r in enumerate(calm):
        h = dsp.heart_rate(filtered[i], fs, heart, r["refined_hz"] if use_eca else None, bool(plausible[i]), k_max[i])
        picked = {k: h[k] for k in ("accepted_candidate_rank", "accepted_candidate_initial_hz", "accepted_candidate_refined_hz", "accepted_second_harmonic_refined_hz", "eca_applied", "f_r_outlier", "ahet_verified", "harmonic_suspect", "phase_eca", "f_r_hz_used", *_TRIPLES)}
        out.append(picked | {
            "resp_peak_raw_index": r["peak_index"], "resp_peak_raw_hz": r["peak_hz"], "resp_peak_refined_hz": r["refined_hz"], "heart_spectrum_stage": h["spectrum_stage"], "heart_peak_hz": h["peak_hz"], "hr_bpm": h["rate_bpm"], "rr_bpm": r["rate_bpm"],
            "phase_window": phases[i], "resp_filtered": r["filtered"], "heart_filtered": h["filtered"], "freqs_hz": h["freqs_hz"], "resp_spectrum": r["spectrum"], "heart_spectrum": h["spectrum"], "heart_spectrum_first_pass": h["spectrum_first_pass"], "ahet_attempt_spectrum": h["ahet_attempt_spectrum"],
        })
    return out


def window_result(phase: np.ndarray, fs: float, use_eca: bool, k_max: int, heart: tuple[float, float], breath: tuple[float, float]) -> dict:
    """All evidence of one window."""
    return window_results(np.asarray(phase, float)[None, :], fs, use_eca, [k_max], heart, breath)[0]


def estimate_windows(windows: DataFrame, fs: float, use_eca: bool = True, heart: tuple[float, float] = dsp.HEART, breath: tuple[float, float] = dsp.BREATH) -> DataFrame:
    """Adds the columns of ``RESULT`` to every window with its ``phase`` array; a column ``k_max`` sets the harmonics removed.
    Windows of a batch that are equally long go through the kernels together."""
    keep = [c for c in windows.columns if c != "phase"]
    schema = T.StructType([*(windows.schema[c] for c in keep), *RESULT.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = pdf["k_max"].to_numpy() if "k_max" in pdf else np.full(len(pdf), 6)
            length, got = pdf["phase"].map(len).to_numpy(), [None] * len(pdf)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                for i, r in zip(at, window_results(np.stack(pdf["phase"].iloc[at].to_list()).astype(float), fs, use_eca, [int(m) for m in k[at]], heart, breath), strict=True):
                    got[i] = {c: (v.tolist() if isinstance(v, np.ndarray) else v) for c, v in r.items()}
            yield pd.concat((pdf[keep].reset_index(drop=True), pd.DataFrame(got, columns=RESULT.names)), axis=1)

    return windows.mapInPandas(run, schema)


def _kernel(windows: DataFrame, out: str, f) -> DataFrame:
    """Windows with a further array: ``f(phases (windows, time))``, for all windows of a batch that are equally long at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, got = pdf["phase"].map(len).to_numpy(), [None] * len(pdf)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                for i, y in zip(at, f(np.stack(pdf["phase"].iloc[at].to_list()).astype(float)), strict=True):
                    got[i] = y.tolist()
            yield pdf.assign(**{out: got})

    return windows.mapInPandas(run, T.StructType([*windows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def band_passed(windows: DataFrame, fs: float, band: tuple[float, float], out: str = "filtered") -> DataFrame:
    """Windows with their phase, less its mean, filtered forward and backward to the band."""
    return _kernel(windows, out, lambda x: dsp.band_pass(x - x.mean(axis=1, keepdims=True), fs, *band))


def without_harmonics(windows: DataFrame, fs: float, f_r: float, k_max: int = 6, guard_hz: float | None = None, out: str = "projected") -> DataFrame:
    """Windows with their phase without the harmonics of one breathing rate."""
    return _kernel(windows, out, lambda x: [dsp.project_out(row, f_r, fs, k_max, guard_hz) for row in x])
