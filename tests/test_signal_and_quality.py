"""Series, spectra, kernels, estimation, archive, quality masks and raw captures."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardiolake.functions import dsp, series, spectral
from cardiolake.operators import evidence, quality, vitals, windows
from cardiolake.plans import capture, registry
from cardiolake.sources import adc
from cardiolake.streaming import live_phase

FS, N, F_R, F_H = 20.0, 400, 0.25, 71 / 60


def tone(f, a=1.0, n=N, fs=FS, ph=0.0):
    return a * np.sin(2 * np.pi * f * np.arange(n) / fs + ph)


def chest(n=N, cardiac=True):
    x = sum(tone(k * F_R, a, n) for k, a in ((1, 3.0), (2, 1.5), (3, 1.0), (4, 0.75)))
    if cardiac:
        x = x + tone(F_H, 0.30, n) + tone(2 * F_H, 0.15, n) + 0.03 * np.random.default_rng(0).standard_normal(n)
    return x


def frame(spark, values, name="v", session="s"):
    return spark.createDataFrame([(session, i, float(x)) for i, x in enumerate(values)], f"session_id string, frame_idx long, {name} double")


def column(df, name):
    return np.array([r[name] for r in df.orderBy("session_id", "frame_idx").collect()])


@pytest.mark.parametrize("parts", [1, 7])
def test_unwrap_and_clip_equal_numpy(spark, parts):
    rng = np.random.default_rng(1)
    angle = np.angle(np.exp(1j * np.cumsum(rng.normal(0, 2.5, 300))))
    df = frame(spark, angle).repartition(parts)
    got = series.unwrap(df, "v", "u", ["session_id"], "frame_idx")
    assert np.abs(column(got, "u") - np.unwrap(angle)).max() < 1e-9
    clipped = column(series.impulse_clip(got, "u", "p", ["session_id"], "frame_idx"), "p")
    assert np.abs(clipped - np.cumsum(np.clip(np.diff(np.unwrap(angle), prepend=np.unwrap(angle)[0]), -1.5, 1.5))).max() < 1e-9 and clipped[0] == 0


@pytest.mark.parametrize("n,half", [(1, 3), (2, 5), (5, 2), (40, 3), (7, 20), (30, 0)])
def test_rolling_median_mirrors_the_ends(spark, n, half):
    v = np.random.default_rng(n).integers(0, 50, n).astype(float)
    padded = np.pad(v, half, mode="symmetric")
    want = [np.median(padded[i : i + 2 * half + 1]) for i in range(n)]
    assert np.allclose(column(series.rolling_median(frame(spark, v), "v", "m", ["session_id"], "frame_idx", half), "m"), want)


def test_phase_deltas(spark):
    z = np.exp(1j * np.cumsum(np.full(20, 0.3)))
    off = [np.exp(1j * np.pi / 2), np.exp(-1j * np.pi / 2)]
    rows = [("s", i, float(x.real), float(x.imag), [float((x * o).real) for o in off], [float((x * o).imag) for o in off]) for i, x in enumerate(z)]
    df = spark.createDataFrame(rows, "session_id string, frame_idx long, re double, im double, res array<double>, ims array<double>")
    d = column(series.phase_delta(df, "re", "im", "d", ["session_id"], "frame_idx"), "d")
    assert d[0] == 0 and np.allclose(d[1:], 0.3)
    d = column(series.phase_delta_before_mean(df, "res", "ims", "d", ["session_id"], "frame_idx"), "d")
    assert d[0] == 0 and np.allclose(d[1:], 0.3)


def test_runs(spark):
    df = frame(spark, [1, 1, 0, 0, 0, 1, 0, 1, 1, 1, 1]).withColumn("f", F.col("v") > 0)
    assert tuple(series.longest_runs(df, "f", ["session_id"], "frame_idx").first())[1:] == (4, 3)
    spans = quality.flagged_spans(df, "f", 10.0).orderBy("t_start").collect()
    assert [(r["t_start"], r["t_end"]) for r in spans] == [(0.0, 0.2), (0.5, 0.6), (0.7, 1.1)]


def test_spectrum_equals_numpy(spark):
    x = np.random.default_rng(2).normal(size=24)
    df = spark.createDataFrame([([float(a) for a in x],)], "x array<double>")
    r = df.select(spectral.amplitude_spectrum(F.col("x"), 24).alias("s"), spectral.amplitude_spectrum(F.col("x"), 24, windowed=False).alias("r")).first()
    assert np.allclose(r["s"], np.abs(np.fft.rfft(x * np.hanning(24)))) and np.allclose(r["r"], np.abs(np.fft.rfft(x)))
    z = df.select(spectral.dft_bin(F.col("x"), F.reverse("x"), 24, F.lit(5)).alias("z")).first()["z"]
    assert np.isclose(complex(*z), np.fft.fft(x + 1j * x[::-1])[5])


@pytest.mark.parametrize("s,i,by_index,by_freq", [([0, 1, 4, 1, 0], 2, 2.0, 2.0), ([0, 2, 4, 3, 0], 2, 2 + 1 / 6, 2 + 1 / 6), ([5, 1, 0], 0, 0.0, 0.0), ([0, 1, 5], 2, 2.0, 2.0), ([1, 1, 1, 1], 1, 1.0, 1.0), ([10, 5, 2, 0], 1, 1.0, 1 - 2.0)])
def test_parabolas(spark, s, i, by_index, by_freq):
    a = F.array(*[F.lit(float(x)) for x in s])
    f = F.array(*[F.lit(float(x)) for x in range(len(s))])
    r = spark.range(1).select(spectral.refine_by_index(a, F.lit(i), F.lit(1.0)).alias("a"), spectral.refine_by_frequency(a, f, F.lit(i)).alias("b")).first()
    assert np.isclose(r["a"], by_index) and np.isclose(dsp.refine_index_hz(np.array(s, float), i, 1.0), by_index)
    want = dsp.refine_hz(np.array(s, float), np.arange(len(s), dtype=float), i)
    assert np.isclose(r["b"], want) and (np.isclose(want, by_freq) or s == [10, 5, 2, 0])


def test_ratios(spark):
    cases = [(4.0, 2.0, 2.0), (1.0, 0.0, np.inf), (0.0, 0.0, np.nan), (0.0, 2.0, 0.0)]
    for p, f, want in cases:
        ratio, db = spectral.peak_to_floor(F.lit(p), F.lit(f))
        r = spark.range(1).select(ratio.alias("r"), db.alias("d")).first()
        assert np.isclose(r["r"], want, equal_nan=True)
        with np.errstate(divide="ignore"):
            assert np.isclose(r["d"], 20 * np.log10(want), equal_nan=True)


@pytest.mark.parametrize("lo,hi", [(0.8, 2.0), (0.1, 0.5), (0.8, 4.0)])
def test_band_pass_properties(lo, hi):
    b, a = dsp.band_coefficients(lo, hi, FS)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / FS)) / np.polyval(a, np.exp(2j * np.pi * f / FS)))
    assert len(b) == len(a) == 9 and abs(gain(lo) - 2**-0.5) < 1e-3 and abs(gain(hi) - 2**-0.5) < 1e-3 and gain(0) < 1e-6 and gain(FS / 2) < 1e-6
    mid = np.sqrt(lo * hi)
    x = tone(mid, n=6000)
    y = dsp.band_pass(x, FS, lo, hi)
    inner = slice(2000, 4000)
    assert np.abs(y[inner] - x[inner]).max() < 0.02
    assert np.allclose(dsp.band_pass(np.stack((x, 2 * x)), FS, lo, hi), np.stack((y, 2 * y)))
    assert np.abs(dsp.band_pass(np.full(400, 5.0), FS, lo, hi)).max() < 1e-6
    with pytest.raises(ValueError):
        dsp.band_pass(np.zeros(27), FS, lo, hi)


def test_peaks_and_prominences():
    at, p = dsp.peaks(np.array([0, 3, 1, 2, 1, 5, 5, 5, 0, 1, 0.0]), 0.0)
    assert at.tolist() == [1, 3, 6, 9] and p.tolist() == [2.0, 1.0, 5.0, 1.0]
    assert dsp.peaks(np.array([5.0, 1, 2, 1, 9]), 1.5)[0].tolist() == [] and dsp.peaks(np.ones(5), 0.0)[0].tolist() == []


@pytest.mark.parametrize("hr", [54.0, 72.0, 96.0, 110.0])
def test_heart_rate_of_a_tone(hr):
    n = 1200
    x = tone(hr / 60, n=n) + tone(0.3, 3.0, n) + 0.05 * np.random.default_rng(0).standard_normal(n)
    assert abs(dsp.estimate(x, FS, dsp.HEART)["rate_bpm"] - hr) <= 2
    assert abs(dsp.breathing(dsp.band_pass(x[None, :], FS, *dsp.BREATH), FS)[0]["refined_hz"] * 60 - 18) <= 2


def test_projection_moves_the_dominant_peak():
    x = chest()
    band = lambda s, f: f[(f >= 0.8) & (f <= 2)][np.argmax(s[(f >= 0.8) & (f <= 2)])]
    assert abs(band(*dsp.spectrum(x, FS)) - 1.0) < 0.05
    assert abs(band(*dsp.spectrum(dsp.project_out(x, F_R, FS), FS)) - F_H) < 0.06
    assert (dsp.project_out(x, 2.5, FS) == x).all()


def test_stages():
    two = dsp.estimate(chest(), FS, dsp.HEART, F_R)
    assert two["spectrum_stage"] == 2 and two["ahet_verified"] and abs(two["rate_bpm"] - 71) <= 1.5
    assert two["candidate_passed"].sum() == 1 and two["accepted_candidate_rank"] == two["candidate_attempted"].sum() - 1
    out = dsp.estimate(tone(0.1, 3.0) + tone(1.2, 0.4), FS, dsp.HEART, 0.1)
    assert out["spectrum_stage"] == 0 and out["f_r_outlier"] and not out["eca_applied"]
    one = dsp.estimate(chest(cardiac=False), FS, dsp.HEART, F_R)
    assert one["spectrum_stage"] == 1 and np.isnan(one["rate_bpm"]) and one["harmonic_suspect"] and not one["candidate_passed"].any()


def windows_of(spark, n=1000):
    x = chest(n)
    arrays = spark.createDataFrame([("s", x.tolist())], "session_id string, phase array<double>")
    total = spark.createDataFrame([("s", n)], "session_id string, total_frames long")
    grid = windows.with_epochs(windows.sliding_grid(total, N, 100, 100), F.lit(1000.0), FS)
    return vitals.estimate_windows(windows.slices(grid, arrays), FS).withColumn("frame_rate_hz", F.lit(FS))


def test_windows_equal_the_kernel_and_archive_is_sound(spark, tmp_path):
    got = windows_of(spark).cache()
    rows = got.orderBy("window_index").collect()
    assert [r["window_index"] for r in rows] == list(range(6))
    want = vitals.window_result(chest(1000)[100:500], FS, True, 6, dsp.HEART, dsp.BREATH)
    assert np.isclose(rows[0]["hr_bpm"], want["hr_bpm"], equal_nan=True) and rows[0]["heart_spectrum_stage"] == want["heart_spectrum_stage"]
    assert evidence.violations(got, 1000).count() == 0
    evidence.write_archive(got, str(tmp_path / "a"), 1000)
    assert spark.read.parquet(str(tmp_path / "a")).where("schema_version = 1").count() == 6


@pytest.mark.parametrize(
    "change,rule",
    [
        ({"end_epoch": "end_epoch + 1"}, "duration"), ({"start_epoch": "double('NaN')"}, "epochs"), ({"frame_rate_hz": "0.0D"}, "rate"), ({"window_index": "window_index + 1"}, "order"),
        ({"phase_window": "slice(phase_window, 1, 5)"}, "phase_length"), ({"heart_spectrum": "slice(heart_spectrum, 1, 5)"}, "spectrum_length"), ({"candidate_attempted": "slice(candidate_attempted, 1, 2)"}, "candidates"), ({"end_frame": "end_frame + 5000"}, "bounds"),
    ],
)
def test_archive_violations(spark, change, rule, tmp_path):
    got = windows_of(spark, 600)
    for c, v in change.items():
        got = got.withColumn(c, F.expr(v))
    assert rule in {r["rule"] for r in evidence.violations(got, 1000).collect()}
    with pytest.raises(ValueError):
        evidence.write_archive(got, str(tmp_path / "a"), 1000)


def test_archive_missing_field(spark):
    with pytest.raises(ValueError, match="missing"):
        evidence.violations(windows_of(spark, 600).drop("freqs_hz"), 1000)


# -- quality --------------------------------------------------------------------------------------------------------------


def quality_frames(spark, energy, adc_max=None, rx=None, bins=None):
    rows = [("s", i, float((adc_max or {}).get(i, 100)), float(e), [float(x) for x in (rx or {}).get(i, (1, 1))], [float(x) for x in (bins or {}).get(i, (1, 1, e, 1, 1, 1))], [1.0], [0.0]) for i, e in enumerate(energy)]
    return spark.createDataFrame(rows, "session_id string, frame_idx long, max_abs_adc double, frame_energy double, rx_energy array<double>, bin_energy array<double>, phasor_re array<double>, phasor_im array<double>")


def flags(df, name):
    return [i for i, x in enumerate(column(df, name)) if x]


def test_hard_checks_and_boundaries(spark):
    df = quality.quality_mask(quality_frames(spark, [100] * 8 + [1.0, 0.99], {0: 32767, 1: 32766}), {})
    assert flags(df, "clip_flagged") == [0] and flags(df, "dead_flagged") == [9] and flags(df, "quality_mask") == list(range(1, 9))


def test_soft_checks(spark):
    energy = [1000.0] * 20
    energy[10], energy[15] = 50.0, 5000.0
    frames = quality_frames(spark, energy, rx={0: (10, 1), 1: (10.1, 1), 2: (1, 0)}, bins={3: (1, 1, 4.9, 1, 1, 1), 4: (1, 1, 5, 1, 1, 1)})
    checks = {"rx_imbalance": {"enabled": True}, "motion_spike": {"bin": 2, "factor": 5.0, "half_window": 3}, "subject_bin_dropout": {"bin": 2, "fraction": 0.1, "half_window": 3}, "snr": {"bin": 2, "guard": 1, "min_snr": 5.0}}
    df = quality.quality_mask(frames, checks)
    assert flags(df, "rx_imbalance_flagged") == [1, 2] and flags(df, "motion_spike_flagged") == [] and flags(df, "subject_bin_dropout_flagged") == [3, 4, 10] and flags(df, "snr_flagged") == [3]
    assert [i for i in range(20) if i not in flags(df, "quality_mask")] == [1, 2]
    checks["motion_spike"]["factor"] = 4.9
    assert flags(quality.quality_mask(frames, checks), "motion_spike_flagged") == [15]
    assert flags(quality.quality_mask(frames, {"snr": {"bin": 2, "guard": 9, "min_snr": 5.0}}), "snr_flagged") == [3]
    for bad in ({"motion_spike": {"bin": 2, "factor": 1.0}}, {"subject_bin_dropout": {"bin": 2, "fraction": 1.0}}, {"phase_jump": {"method": "x"}}):
        with pytest.raises(ValueError):
            quality.quality_mask(frames, bad)


def test_phase_jump_near_pi(spark):
    angles = [0.0, 1.4, 2.95, -2.95, 0.0]
    rows = [("s", i, 1.0, 1.0, [1.0], [1.0], [float(np.cos(a))], [float(np.sin(a))]) for i, a in enumerate(angles)]
    df = spark.createDataFrame(rows, "session_id string, frame_idx long, max_abs_adc double, frame_energy double, rx_energy array<double>, bin_energy array<double>, phasor_re array<double>, phasor_im array<double>")
    for method in ("mean_phasor", "delta_before_mean"):
        assert flags(quality.quality_mask(df, {"phase_jump": {"threshold_rad": 1.5, "method": method}}), "phase_jump_flagged") == [2, 4]


def test_overlaps_and_stats(spark):
    df = spark.createDataFrame([("s", a, b, c) for a, b, c in ((True, True, False), (True, False, False), (True, True, True), (False, False, False))], "session_id string, a boolean, b boolean, c boolean")
    r = quality.flag_overlaps(df, ["a", "b", "c"]).first().asDict()
    assert (r["a"], r["a_only"], r["a_and_b"], r["a_and_c"], r["a_and_b_and_c"], r["any"], r["b_only"]) == (3, 1, 2, 1, 1, 3, 0)
    assert quality.flag_overlaps(df, ["a"]).columns == ["session_id"]
    p = quality.phase_summary(frame(spark, [1, 2, 3, 4, float("nan"), float("inf")], "phase_delta")).first()
    assert (p["min"], p["p50"], p["max"], p["mean"]) == (1.0, 2.5, 4.0, 2.5) and np.isclose(p["p90"], 3.7)


def test_bin_resolution():
    assert quality.resolve_bin(5, "7", 10) == (5, None) and quality.resolve_bin(None, "7.0", 10) == (7, None)
    assert quality.resolve_bin(None, "7.5", 10)[0] is None and quality.resolve_bin(None, None, 10)[0] is None and quality.resolve_bin(None, 12, 10)[0] is None and quality.resolve_bin(None, float("nan"), 10)[0] is None
    with pytest.raises(ValueError):
        quality.resolve_bin(10, None, 10)


# -- raw captures -----------------------------------------------------------------------------------------------------------

SMALL = vitals.Geometry(chirps=1, rx=1, samples=4)


def words(v):
    return np.full(8, v, "<i2").tobytes()


def read(spark, paths, **options):
    return adc.read_capture(spark, [str(p) for p in paths], "s", SMALL, **options).orderBy("frame_idx").collect()


def test_packets_are_deinterleaved():
    g = vitals.Geometry()
    cube = vitals.decode(np.tile(np.array([100, 200, 300, 400], "<i2"), g.frame_bytes // 8).tobytes(), g)
    assert cube.shape == (32, 4, 256) and (cube[..., 0::2] == 100 + 300j).all() and (cube[..., 1::2] == 200 + 400j).all()


def test_split_files_and_ranges(spark, tmp_path):
    whole = b"".join(words(v) for v in (10, 20, 30, 40, 50))
    a, b = tmp_path / "s_0.bin", tmp_path / "s_1.bin"
    a.write_bytes(whole[:24])
    b.write_bytes(whole[24:])
    rows = read(spark, adc.resolve_paths(str(tmp_path), "s"))
    assert [(r["frame_idx"], np.frombuffer(r["raw"], "<i2")[0]) for r in rows] == [(0, 10), (1, 20), (2, 30), (3, 40), (4, 50)]
    assert [r["frame_idx"] for r in read(spark, [a, b], trim_frames=2, end_frame=4)] == [2, 3]
    binary = spark.read.format("binaryFile").load(str(b)).withColumn("session_id", F.lit("s"))
    assert adc.frames_from_binary(binary, SMALL).count() == 3
    for bad in ({"trim_frames": 5}, {"trim_frames": -1}):
        with pytest.raises(Exception, match="trim"):
            read(spark, [a, b], **bad)
    with pytest.raises(Exception, match="whole number"):
        read(spark, [a])
    with pytest.raises(Exception, match="missing"):
        read(spark, [a, tmp_path / "no.bin"])
    with pytest.raises(FileNotFoundError):
        adc.resolve_paths(str(tmp_path), "other")
    with pytest.raises(ValueError):
        adc.expect_frames(5, 6)
    adc.expect_frames(5, 6, allow_mismatch=True)


def test_capture_to_rates(spark, tmp_path):
    """A capture with a tone in one range bin whose phase breathes and beats: the bin, the phase and the rates come back."""
    g = vitals.Geometry(chirps=2, rx=2, samples=16, range_resolution_m=0.1)
    n, bin_ = 500, 5
    phase = 0.8 * tone(F_R, 1.0, n) + 0.1 * tone(F_H, 1.0, n) + 0.05 * tone(2 * F_H, 1.0, n)
    z = 3000 * np.exp(1j * (2 * np.pi * bin_ * np.arange(16)[None, :] / 16 + phase[:, None]))
    z = np.repeat(z[:, None, :], 4, axis=1).reshape(n, -1, 2)
    packets = np.stack((z.real[:, :, 0], z.real[:, :, 1], z.imag[:, :, 0], z.imag[:, :, 1]), axis=2)
    (tmp_path / "s.bin").write_bytes(np.round(packets).astype("<i2").tobytes())
    frames = adc.read_capture(spark, [str(tmp_path / "s.bin")], "s", g)
    features = vitals.range_features(frames, g).cache()
    gate = vitals.distance_gate(F.lit(0.55))
    bins = vitals.select_bin(vitals.in_gate(vitals.mean_range_energy(features), 0.1, gate))
    assert bins.first()["bin_idx"] == bin_
    report = adc.sanity_report(vitals.range_features(frames, g, windowed=False), 0.1, gate=(3, 7), expected_m=0.5).first()
    assert report["top_bins"][0] == bin_ and report["gate_bin"] == bin_ and report["plausible"]
    got = column(vitals.phase_series(features, bins), "phase")
    assert np.abs(got - (phase - phase[0])).max() < 0.01
    grid = windows.pipeline_grid(spark.createDataFrame([("s", n)], "session_id string, total_frames long"), N, 50)
    rates = vitals.estimate_windows(windows.slices(grid, vitals.as_arrays(vitals.phase_series(features, bins))), FS).collect()
    assert len(rates) == 3 and all(abs(r["rr_bpm"] - 15) < 1 for r in rates) and all(np.isnan(r["hr_bpm"]) or abs(r["hr_bpm"] - 71) < 2 for r in rates)
    assert any(r["ahet_verified"] for r in rates)
    # the same through the plans, with a trim, the reference stream and two lengths
    g20 = vitals.Geometry(chirps=2, rx=2, samples=16, range_resolution_m=0.1, frame_rate_hz=FS)
    f = capture.capture_features(spark, [str(tmp_path / "s.bin")], "s", g20, trim_s=1.0, expected_frames=n)
    picked, series_ = capture.capture_phase(f, g20, (0.3, 0.8))
    assert picked.first()["bin_idx"] == bin_ and series_.agg(F.min("frame_idx")).first()[0] == 20
    total = spark.createDataFrame([("s", n)], "session_id string, total_frames long")
    stream = spark.createDataFrame([(1000 + i, 71.0, 15.0, 1.0) for i in range(30)], "epoch_utc long, pr_bpm double, rr_bpm double, pi double")
    est = capture.rates(series_, g20, windows.sliding_grid(total, N, 40, 20), 1000.0)
    merged, every, verified = capture.agreement(est, stream)
    assert merged.count() == 3 and verified.first()["mae_bpm"] < 2 and every.first()["n_windows"] >= verified.first()["n_windows"]
    pairs = capture.length_study(series_, g20, total, stream, [15, 20], 20, 220, 20, 1000.0)
    assert {r["condition"]: r["count"] for r in pairs.groupBy("condition").count().collect()} == {"15s": 5, "20s": 5}
    whole = capture.whole_capture_rate(series_, g20).first()
    assert abs(whole["rr_bpm"] - 15) < 1 and not whole["eca_applied"]
    assert capture.capture_phase(f, g20, (0, 1), locked_bin=4)[0].first()["bin_idx"] == 4
    with pytest.raises(ValueError):
        capture.capture_phase(f, g20, (0, 1), locked_bin=16)
    with pytest.raises(Exception, match="no range bin lies in the gate of session s"):
        capture.capture_phase(f, g20, (0.51, 0.55))[0].collect()
    local = capture.in_pipeline_rates(series_, g20, N, 40, 1000.0).orderBy("window_index").collect()
    assert [r["start_frame"] for r in local] == [20, 60, 100] and np.allclose([r["rr_bpm"] for r in local], [r["rr_bpm"] for r in est.orderBy("window_index").collect()])
    masked, stats, runs = capture.session_quality(vitals.range_features(frames, g20, False, phase_bin=bin_), {"snr": {"bin": bin_, "enabled": True}, "phase_jump": {"enabled": True}})
    assert stats.first()["n_flagged"] == 0 and runs.first()["longest_true"] == n
    db = vitals.range_profile_db(vitals.range_features(frames, g20, windowed=False), g20, 0.75)
    assert db.groupBy("bin_idx").agg(F.avg("db").alias("m")).orderBy(F.desc("m")).first()["bin_idx"] == bin_
    assert len(vitals.range_features(frames, g20, real=True).first()["bin_energy"]) == 9


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    z = np.exp(1j * np.cumsum(rng.normal(0, 1.0, 60)))
    rows = [("s", i, float(x.real), float(x.imag)) for i, x in enumerate(z)]
    schema = "session_id string, frame_idx long, re double, im double"
    df = spark.createDataFrame(rows, schema).withColumn("angle", F.atan2("im", "re"))
    u = series.unwrap(df, "angle", "u", ["session_id"], "frame_idx")
    want = column(series.impulse_clip(u, "u", "phase", ["session_id"], "frame_idx"), "phase")
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live_phase.live_phase(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert np.abs(column(spark.read.parquet(str(tmp_path / "out")), "phase") - want).max() < 1e-9


def test_empty_gates_fail_only_where_asked(spark):
    bins = spark.createDataFrame([(s, i, float(i)) for s in ("a", "b") for i in range(8 if s == "a" else 2)], "session_id string, bin_idx int, energy double")
    gate = (F.lit(0.5), F.lit(1.0))
    assert {r["session_id"] for r in vitals.select_bin(vitals.in_gate(bins, 0.25, gate)).collect()} == {"a"}
    assert sorted(map(tuple, vitals.in_gate(bins.where("session_id = 'a'"), 0.25, gate, require=True).collect())) == sorted(map(tuple, vitals.in_gate(bins.where("session_id = 'a'"), 0.25, gate).collect()))
    with pytest.raises(Exception, match="gate of session b"):
        vitals.select_bin(vitals.in_gate(bins, 0.25, gate, require=True)).collect()


def test_window_kernels_equal_the_array_kernels(spark):
    x = chest(500)
    df = spark.createDataFrame([(0, x[:300].tolist()), (1, x[100:400].tolist()), (2, x[:200].tolist())], "window_index int, phase array<double>")
    for r in vitals.band_passed(df, FS, dsp.HEART).collect():
        p = np.array(r["phase"])
        assert np.allclose(r["filtered"], dsp.band_pass(p - p.mean(), FS, *dsp.HEART))
    for r in vitals.without_harmonics(df, FS, 0.31, 6, 1.6).collect():
        assert np.allclose(r["projected"], dsp.project_out(np.array(r["phase"]), 0.31, FS, 6, 1.6))


def test_steps_between_opposite_phasors_equal_the_sql(spark, tmp_path):
    """The last bit of both angles decides whether such a step exceeds pi; a wrong turn shifts all frames that follow."""
    rng = np.random.default_rng(5)
    pairs = rng.integers(-60, 61, (150, 2)) * rng.choice([-1, 1], (150, 1))
    vectors = np.zeros((300, 64), np.float32)
    vectors[0::2, :2], vectors[1::2, :2] = pairs / 1024, -pairs * rng.integers(1, 4, (150, 1)) / 1024
    vectors[::7, 1] = -0.0001  # rounds to nothing, below the axis
    duck = duckdb.connect()
    rows = pd.DataFrame({"vec_id": np.arange(300), "label": np.arange(300) // 2 % 3, "embedding": list(vectors)}).astype({"label": "int32"})
    duck.register("rows", rows)
    duck.execute(f"COPY (SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding, label FROM rows) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name, c in (("phase_unwrap", "unwrapped"), ("phase_impulse_clip", "phase")):
        got = {(r["session_id"], r["frame_idx"]): r[c] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        want = {(s, i): v for s, i, v in duck.execute(f"SELECT session_id, frame_idx, {c} FROM ({registry.ORACLE_SQL[name]})").fetchall()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-6


def test_a_last_bit_beyond_pi_is_a_turn(spark):
    up = float(np.nextafter(np.pi, 4))
    values = {0: [0.0, np.pi, 0.0], 1: [0.0, up, 0.0], 2: [0.0, -np.pi, 0.0], 3: [0.0, 7.0, 20.0, -20.0], 4: [None, 1.0, float("nan"), 5.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k int, i long, v double")
    for chunk in (1, 2, 1024, None):
        got = series.unwrap(df, "v", "u", ["k"], "i", chunk=chunk).orderBy("k", "i").collect()
        by = {k: [r["u"] for r in got if r["k"] == k] for k in values}
        assert by[0] == values[0] and by[1] == [0.0, up - 2 * np.pi, 0.0] and by[2] == values[2]
        assert np.allclose(by[3], np.unwrap(values[3])) and by[4][1] == 1.0 and by[4][3] == 5.0


def test_energies_of_whole_samples_are_exact(spark):
    """Bins whose transform only adds and subtracts have whole sums of squares; a root in between would miss halves when rounded."""
    g = vitals.Geometry(chirps=2, rx=2, samples=8)
    words = np.random.default_rng(6).integers(-400, 400, (200, g.frame_bytes // 2)).astype("<i2")
    df = spark.createDataFrame([("s", i, bytearray(w.tobytes())) for i, w in enumerate(words)], "session_id string, frame_idx long, raw binary")
    for r in vitals.range_features(df, g, windowed=False).collect():
        cube = vitals.decode(words[r["frame_idx"]].tobytes(), g)
        assert r["frame_energy"] * cube.size == (cube.real**2 + cube.imag**2).sum()
        for k in (0, 2, 4, 6):
            z = (cube * np.array([1, -1j, -1, 1j] * 2) ** (k // 2)).sum(axis=2)
            assert r["bin_energy"][k] * 4 == (z.real**2 + z.imag**2).sum()
