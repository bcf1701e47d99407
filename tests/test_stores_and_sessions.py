"""Sessions that fail alone, stores with attributes, flat window files, pooling of empty populations, run records."""

import subprocess

import pytest
from pyspark.sql import functions as F

from cardiolake.operators import compare, evidence, quality, study
from cardiolake.sources import sinks, store, tables
from tests.test_signal_and_quality import windows_of

FRAME = "session_id string, frame_idx long, max_abs_adc double, frame_energy double, rx_energy array<double>, bin_energy array<double>, phasor_re array<double>, phasor_im array<double>"
CHECKS = {"motion_spike": {"enabled": True, "factor": 3.0, "half_window": 2}, "snr": {"guard": 0, "min_snr": 2.0}, "subject_bin_dropout": {"fraction": 0.2, "half_window": 2}}


def features(spark):
    rows = []
    for s in ("a", "b", "c", "d", "t"):
        for i in range(12):
            bins = [1.0, 1.0, 10.0, 1.0]
            if i == 6:
                bins[2] = 100.0
            rows.append((s, i, 1.0, 1.0, [1.0, 1.0], bins, [1.0], [0.0]))
    return spark.createDataFrame(rows, FRAME)


def manifest(spark):
    rows = [("a", "2", 0), ("b", "9", 0), ("c", "x", 3), ("d", None, None), ("t", "2", 12), ("none", "2", 0), ("twice", "1", 0), ("twice", "1", 0)]
    return spark.createDataFrame(rows, "session_id string, locked_bin string, trim_frames int")


def test_sessions_fail_alone_and_say_why(spark):
    frames, attributes, failures = quality.all_sessions(features(spark), manifest(spark), CHECKS)
    assert {r["session_id"]: r["error"] for r in failures.collect()} == {"t": "trim of 12 frames leaves none", "none": "no frames", "twice": "several rows in the manifest"}
    got = {(r["session_id"], r["frame_idx"]): r for r in frames.collect()}
    assert len(got) == 12 * 3 + 9 and min(i for s, i in got if s == "c") == 3
    assert [k for k, r in got.items() if not r["quality_mask"]] == [("a", 6)]
    assert got["a", 6]["motion_spike_flagged"] and got["b", 6]["motion_spike_flagged"] is None
    facts = {(r["session_id"], r["name"]): r["value"] for r in attributes.collect()}
    assert facts["a", "motion_spike_bin"] == "2" and facts["a", "snr_skipped"] == "false" and ("a", "snr_skip_reason") not in facts
    assert facts["b", "motion_spike_skip_reason"] == "locked bin 9 is out of range" and facts["c", "snr_skip_reason"] == "locked bin is no whole number: x" and facts["d", "snr_skip_reason"] == "no locked bin"
    assert facts["a", "motion_spike_factor"] == "3.0" and facts["a", "subject_bin_dropout_energy_source"] == "reused_subject_bin_energy" and facts["c", "trim_frames"] == "3"


def test_configured_bins_win_and_must_exist(spark):
    fixed = {"snr": {"bin": 1, "guard": 0, "min_snr": 2.0}}
    frames, attributes, _ = quality.all_sessions(features(spark), manifest(spark), fixed)
    assert {r["value"] for r in attributes.where("name = 'snr_bin'").collect()} == {"1"} and frames.where("snr_flagged").count() == 12 * 3 + 9
    with pytest.raises(Exception, match="configured bin 7"):
        quality.all_sessions(features(spark), manifest(spark), {"snr": {"bin": 7}})[0].collect()
    with pytest.raises(ValueError, match="needs a bin"):
        quality.quality_mask(features(spark), {"subject_bin_dropout": {}})


def test_dropout_reuses_the_spike_checks_energy(spark):
    """Reused energy needs no bin of the check's own; without it the own bin counts, and only then must it exist."""
    drop = {"subject_bin_dropout": {"fraction": 0.2, "half_window": 2}}
    both = {"motion_spike": {"bin": 2, "factor": 3.0, "half_window": 2}, **drop}
    assert quality.energy_source(both) == quality.REUSED and quality.energy_source(drop) == quality.COMPUTED and quality.energy_source({"snr": {}}) is None
    # a bin for the spike check alone; and one of another bin for the dropout check, which isn't looked at
    for checks in (both, {**both, "subject_bin_dropout": {"bin": 77, **drop["subject_bin_dropout"]}}):
        one = quality.quality_mask(features(spark), checks)
        assert {r["subject_bin_energy"] for r in one.collect()} == {10.0, 100.0} and one.where("subject_bin_dropout_flagged IS NULL").count() == 0
        frames, attributes, _ = quality.all_sessions(features(spark), manifest(spark), checks)
        facts = {(r["session_id"], r["name"]): r["value"] for r in attributes.collect()}
        for s in "abcd":
            assert facts[s, "subject_bin_dropout_energy_source"] == "reused_subject_bin_energy" and facts[s, "subject_bin_dropout_skipped"] == "false" and (s, "subject_bin_dropout_bin") not in facts
        assert frames.where("subject_bin_dropout_flagged IS NULL").count() == 0
    # the spike check skipped (no locked bin): the dropout check falls back on its own bin, and the spike's flag stays unknown
    own = {"motion_spike": {"factor": 3.0, "half_window": 2}, "subject_bin_dropout": {"bin": 1, "fraction": 0.2, "half_window": 2}}
    frames, attributes, _ = quality.all_sessions(features(spark), manifest(spark), own)
    facts = {(r["session_id"], r["name"]): r["value"] for r in attributes.collect()}
    assert facts["a", "subject_bin_dropout_energy_source"] == "reused_subject_bin_energy" and facts["d", "subject_bin_dropout_energy_source"] == "computed_fallback" and facts["d", "subject_bin_dropout_bin"] == "1"
    assert {r["motion_spike_flagged"] for r in frames.where("session_id = 'd'").collect()} == {None} and frames.where("session_id = 'd' AND subject_bin_energy = 1.0").count() == 12
    none = {"motion_spike": {"factor": 3.0, "half_window": 2}, **drop}
    facts = {(r["session_id"], r["name"]): r["value"] for r in quality.all_sessions(features(spark), manifest(spark), none)[1].collect()}
    assert facts["d", "subject_bin_dropout_skipped"] == "true" and facts["d", "subject_bin_dropout_skip_reason"] == "no locked bin" and ("d", "subject_bin_dropout_energy_source") not in facts
    with pytest.raises(Exception, match="configured bin 77"):
        quality.all_sessions(features(spark), manifest(spark), {"subject_bin_dropout": {"bin": 77}})[0].collect()


def test_bin_resolution_equals_the_scalar_rule(spark):
    values = ["5", "7.0", "7.5", None, "12", "nan", "-1", "x", "1e3", "inf"]
    rows = spark.createDataFrame([(str(i), 10, v) for i, v in enumerate(values)], "session_id string, n_bins int, locked_bin string")
    got = {int(r["session_id"]): r["snr_bin"] for r in quality.resolve_bins(rows, {"snr": {}}).collect()}
    assert got == {i: quality.resolve_bin(None, v, 10)[0] for i, v in enumerate(values)}


def test_store_replaces_sessions_and_reads_back(spark, tmp_path):
    frames, attributes, _ = quality.all_sessions(features(spark), manifest(spark), CHECKS)
    path = str(tmp_path / "store")
    store.write_store(frames, attributes, path)
    store.write_store(frames.where("session_id = 'a' AND frame_idx < 8"), attributes.where("session_id = 'a'"), path)
    assert {(r["session_id"], r["count"]) for r in tables.read_frames(spark, path).groupBy("session_id").count().collect()} == {("a", 8), ("b", 12), ("c", 9), ("d", 12)}
    late = tables.read_frames(spark, path, trim_frames=5, sessions=["a"])
    assert late.count() == 3 and "GreaterThanOrEqual(frame_idx,5)" in late._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    stored = tables.stored_metric(spark, path).where("session_id = 'a' AND frame_idx = 6").first()
    assert stored["subject_bin_energy"] == 100.0 and stored["motion_spike_flagged"] and stored["motion_spike_factor"] == "3.0" and stored["motion_spike_bin"] == "2"
    assert tables.stored_metric(spark, path).where("session_id = 'd'").first()["motion_spike_bin"] == "-1"
    with pytest.raises(KeyError):
        tables.stored_metric(spark, path, metric="no_such")


def test_archive_is_checked_as_a_whole(spark, tmp_path):
    got = windows_of(spark, 600).cache()
    path = str(tmp_path / "a")
    evidence.write_archive(got, path, 1000)
    for change, rule in (("second_peak_bin_hz", "candidates"), ("peak_to_floor_ratio_db", "candidates"), ("resp_peak_raw_index", "peak_index"), ("phase_eca", "phase_length")):
        value = f"slice({change}, 1, 2)" if change != "resp_peak_raw_index" else "100000"
        broken = got.selectExpr(*[c if c != change else f"{value} AS {change}" for c in got.columns])
        with pytest.raises(ValueError, match=rule):
            evidence.write_archive(broken, path, 1000)
    # the older archive is untouched, and nothing lies beside it
    assert evidence.read_archive(spark, path).count() == got.count() and [p.name for p in tmp_path.iterdir()] == ["a"]
    for bad in (got.withColumn("hr_bpm", got["hr_bpm"].cast("string")), got.withColumn("phase_window", got["hr_bpm"]), got.limit(0)):
        with pytest.raises(ValueError):
            evidence.write_archive(bad, path, 1000)
    for total in (0, True, 2.5):
        with pytest.raises(ValueError):
            evidence.violations(got, total)
    with pytest.raises(FileNotFoundError):
        evidence.write_archive(got, str(tmp_path / "no" / "a"), 1000)
    more = spark.createDataFrame([("s", 1, 70.0), ("s", 99, 1.0)], "session_id string, window_index int, pr_bpm_mean double")
    assert [(r["window_index"], r["pr_bpm_mean"]) for r in evidence.align_archive(evidence.read_archive(spark, path), more).collect()] == [(1, 70.0)]


def test_flat_windows(spark):
    bins = spark.createDataFrame([("s", 29, 1.3)], "session_id string, bin_idx int, range_m double")
    flat = compare.flat_windows(windows_of(spark, 600), 100, bins)
    r = flat.first()
    assert len(compare.FLAT) == 26 and flat.columns == ["session_id", *compare.FLAT]
    assert (r["window_frames"], r["hop_frames"], r["range_bin"], r["chosen_range_m"]) == (r["end_frame"] - r["start_frame"], 100, 29, 1.3) and r["f_r_raw_hz"] == r["f_r_hz_used"]
    assert compare.flat_windows(windows_of(spark, 600), 100, short=True).columns == ["session_id", *compare.SHORT]
    assert compare.reference_names(spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "epoch_utc long, pr_bpm double, rr_bpm double, pi double")).columns == ["epoch", "PR", "BR", "PI"]


def test_pooling_of_empty_populations(spark):
    make = lambda rows: spark.createDataFrame(rows, "capture string, length string, error double")
    rows = [(c, x, None if c == "e" else 1.0) for c in ("a", "e") for x in study.LENGTHS]
    study.require_population(make(rows))
    _, per, macro = study.pooled(make(rows))
    assert [(r["n"], r["mae_bpm"]) for r in per.where("capture = 'e' AND length = '20s'").collect()] == [(0, None)] and macro.first()["mae_mean"] == 1.0
    for bad in ([], rows[1:], [(c, x, None) for c, x, _ in rows]):
        with pytest.raises(ValueError):
            study.require_population(make(bad))


def test_two_condition_report(spark):
    rows = [("c2", "20s", 9, 8, 1, 0, 5, 4.0, 5.0, -1.0), ("c3", "20s", 9, 6, 3, 0, 2, 7.0, 9.0, 2.0)]
    df = spark.createDataFrame(rows, "capture string, condition string, n_total int, n_finite int, n_nan_radar int, n_nan_ref int, n_ahet_verified int, mae_bpm double, rmse_bpm double, bias_bpm double")
    r = study.two_condition_report(df, "c2", "c3", ["order of recording"]).first()
    assert (r["mae_bpm_diff"], r["rmse_bpm_diff"], r["n_finite_0"], r["n_finite_1"], r["confounds"]) == (-3.0, -4.0, 8, 6, ["order of recording"])


def test_run_records(spark, tmp_path, capsys):
    config = {"trim_s": 30, "names": ["a", "b"], "gate": {"low": 0.5}}
    sinks.write_config(config, str(tmp_path / "config.yaml"))
    assert tables.read_config(str(tmp_path / "config.yaml")) == config
    (tmp_path / "list.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        tables.read_config(str(tmp_path / "list.yaml"))
    with sinks.Tee(str(tmp_path / "log")):
        print("seen twice")
    print("seen once")
    assert (tmp_path / "log").read_text() == "seen twice\n" and capsys.readouterr().out == "seen twice\nseen once\n"
    for text in ("one", "two"):
        sinks.append_log(spark.createDataFrame([(text,)], "value string"), str(tmp_path / "lines"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()} == {"one", "two"}
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init"), git("add", "config.yaml"), git("commit", "-m", "x")
    (tmp_path / "config.yaml").write_text("changed: 1\n")
    got = sinks.provenance(str(tmp_path), ["config.yaml"], config)
    assert got["dirty"] and "+changed: 1" in got["diff"] and "list.yaml" in got["untracked"]
    got["config"]["gate"]["low"] = 9
    assert config["gate"]["low"] == 0.5


# stores with one commit


def stored(spark, sessions, mark, n=5):
    frames = spark.createDataFrame([(s, i, mark) for s in sessions for i in range(n)], "session_id string, frame_idx long, mark string")
    return frames, spark.createDataFrame([(s, "mark", mark) for s in sessions], "session_id string, name string, value string")


def state(spark, path):
    frames = {r["session_id"]: (r["n"], r["marks"]) for r in tables.read_frames(spark, path).groupBy("session_id").agg(F.count("*").alias("n"), F.array_join(F.collect_set("mark"), ",").alias("marks")).collect()}
    facts = {r["session_id"]: r["value"] for r in tables.read_attributes(spark, path).collect()}
    assert {s: m for s, (_, m) in frames.items()} == facts  # never a pair of two versions
    return frames


def test_a_failure_between_frames_and_attributes_leaves_the_old_pair(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        tables.read_frames(spark, path)
    store.write_store(*stored(spark, ["007", "b"], "one"), path)
    assert state(spark, path) == {"007": (5, "one"), "b": (5, "one")}
    frames, attributes = stored(spark, ["007"], "two", 9)
    broken = attributes.withColumn("value", F.raise_error(F.lit("no attributes")).cast("string"))
    with pytest.raises(Exception, match="no attributes"):
        store.write_store(frames, broken, path)
    assert state(spark, path) == {"007": (5, "one"), "b": (5, "one")}
    with pytest.raises(FileNotFoundError):
        store.commit(spark, path, "nothing")
    assert store.write_store(frames, attributes, path) == 2
    assert state(spark, path) == {"007": (9, "two"), "b": (5, "one")}
    assert tables.read_frames(spark, path, 6, ["007"]).count() == 3 and tables.read_frames(spark, path, sessions=["none"]).count() == 0


def test_two_writers_do_not_mix(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write_store(*stored(spark, ["a", "b", "c"], "old"), path)
    staged = [store.stage(*stored(spark, s, m), path) for s, m in ((["a", "b"], "left"), (["b", "c"], "right"))]
    assert state(spark, path) == dict.fromkeys("abc", (5, "old"))
    for v in staged:
        store.commit(spark, path, v)
    assert state(spark, path) == {"a": (5, "left"), "b": (5, "right"), "c": (5, "right")}
    # the same number twice, as when both looked before either wrote: one wins, the same for every reader
    for v in (store.stage(*stored(spark, ["a"], m), path) for m in ("x", "y")):
        (tmp_path / "s" / "commits" / f"000000000009-{v}").touch()
    last = max(store.commits(spark, path))[1]
    assert state(spark, path)["a"][1] == spark.read.parquet(f"{path}/versions/{last}/attributes").first()["value"]


def test_vacuum_deletes_what_was_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write_store(*stored(spark, ["a"], "one"), path)
    store.write_store(*stored(spark, ["a", "b"], "two"), path)
    store.stage(*stored(spark, ["a"], "never"), path)
    before = state(spark, path)
    assert len(store.vacuum(spark, path)) == 1 and store.vacuum(spark, path) == []
    assert state(spark, path) == before and len(list((tmp_path / "s" / "versions").iterdir())) == 2


def test_one_session_is_written_by_many_tasks_and_columns_may_come_later(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "RUN", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = f"file://{tmp_path}/s"
    frames = spark.range(0, 2000).select(F.lit("a").alias("session_id"), F.col("id").alias("frame_idx"), F.lit("m").alias("mark"))
    store.write_store(frames, stored(spark, ["a"], "m")[1], path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "s").glob("versions/*/frames/session_id=a/*.parquet"))) > 1
    more, facts = stored(spark, ["b"], "n")
    store.write_store(more.withColumn("extra", F.lit(1.5)), facts, path)
    assert {(r["session_id"], r["extra"]) for r in tables.read_frames(spark, path).select("session_id", "extra").distinct().collect()} == {("a", None), ("b", 1.5)}
