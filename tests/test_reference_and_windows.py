"""Sources of text, the reference stream, window grids."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cardiolake.operators import reference, windows
from cardiolake.sources import sinks, tables

HEADER = "Session,Index,Timestamp,Date,Time,O2 Saturation,Beats / min,Perfusion Index,Pleth Variability,Breaths / min\n"


def csv(tmp_path, rows):
    path = tmp_path / "ref.csv"
    path.write_text(HEADER + "".join(f"0,{i},{t},5/13/26,2:38:15 PM,95,{pr},{pi},17,{rr}\n" for i, (t, pr, pi, rr) in enumerate(rows)))
    return str(path)


def test_duplicate_seconds_are_averaged(spark, tmp_path):
    rows, cover = tables.reference_csv(spark, csv(tmp_path, [(1000, 73, 1.6, 24), (1000, 75, 1.6, 24), (1001, 70, "--", 24), (1003, 70.5, 1, "--")]))
    got = {r["epoch_utc"]: r for r in rows.collect()}
    assert got[1000]["pr_bpm"] == 74.0 and got[1000]["index"] == 0
    assert got[1001]["pi"] is None and got[1003]["rr_bpm"] is None
    assert cover.first().asDict() == {"n_raw": 4, "n_unique": 3, "n_merged": 1, "n_missing": 1}


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(1, 72.2, 0), (1, 72.3, 1), (2, 72.3, 2), (2, 72.4, 3)], "epoch_utc long, pr_bpm double, row_no long")
    got = reference.merge_duplicates(df, ["pr_bpm"], [], "row_no").orderBy("epoch_utc").collect()
    assert [r["pr_bpm"] for r in got] == [72.2, 72.4] or [r["pr_bpm"] for r in got] == [72.2, 72.3]


def test_halves_are_even_whatever_the_order_of_sums(spark):
    """The mean of equal or exactly balanced decimals is a half, though sums of doubles miss it by a last bit."""
    values = [9.55, 30.65, 6.85, 33.05, 57.45, 57.55]
    rows = [(k, v + d, k * 100 + i) for k, v in enumerate(values) for i, d in enumerate([0.0, 0.1, -0.1, 0.0, 0.2, -0.2, 0.0])]
    df = spark.createDataFrame(rows, "epoch_utc long, pr_bpm double, row_no long")
    for some in (df, df.orderBy(F.desc("row_no")), df.repartition(7, "row_no")):
        got = reference.merge_duplicates(some, ["pr_bpm"], [], "row_no").orderBy("epoch_utc").collect()
        assert [r["pr_bpm"] for r in got] == [9.6, 30.6, 6.8, 33.0, 57.4, 57.6]
    odd = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, -0.25), (5, -0.34)], "epoch_utc long, v double")
    got = [r["v"] for r in odd.select("epoch_utc", reference.half_even(F.col("v")).alias("v")).orderBy("epoch_utc").collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [float("inf"), -0.2, -0.3]


def test_missing_header_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Session,Index\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.reference_csv(spark, str(tmp_path / "bad.csv"))


def stream(spark, rows):
    return spark.createDataFrame([(t, float(pr), float(rr), None if pi is None else float(pi)) for t, pr, rr, pi in rows], "epoch_utc long, pr_bpm double, rr_bpm double, pi double")


def window(spark, *spans):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(spans)], "window_index int, start_epoch double, end_epoch double")


def test_intervals_are_half_open(spark):
    rows = stream(spark, [(100, 60, 15, 1), (101, 70, 16, 1), (102, 100, 17, 1)])
    got = reference.window_reference(window(spark, (100, 102), (102, 104), (99.5, 100.5)), rows, ["window_index"], 2).orderBy("window_index").collect()
    assert [(r["pr_bpm_mean"], r["n_total"], r["rr_bpm_mean"]) for r in got] == [(65.0, 2, 15.5), (100.0, 1, 17.0), (60.0, 1, 15.0)]
    assert reference.crop(rows, 100, 102).count() == 2
    with pytest.raises(ValueError):
        reference.crop(rows, 5, 5)


def test_perfusion_gate_and_quality(spark):
    rows = stream(spark, [(100, 60, 15, 1.0), (101, 70, 16, 0.5), (102, 100, 17, 0.1), (200, 80, 15, 0.1), (201, 90, 15, None)])
    got = reference.window_reference(window(spark, (100, 102), (100, 103), (200, 202), (300, 301)), rows, ["window_index"], 10).orderBy("window_index").collect()
    assert [r["n_good_pi"] for r in got] == [2, 2, 0, 0]
    assert [r["low_quality"] for r in got][:3] == [False, True, True]
    assert [r["pr_bpm_mean"] for r in got] == [65.0, 65.0, 85.0, None]
    assert math.isclose(got[0]["pr_bpm_std"], 5.0)
    with pytest.raises(PySparkException, match="no reference row"):
        reference.window_reference(window(spark, (300, 301)), rows, ["window_index"], 10, require=True).collect()


@pytest.mark.parametrize("bucket", [1, 7, 50, 1000])
def test_bucket_size_does_not_matter(spark, bucket):
    rows = stream(spark, [(1000 + 3 * i, 60 + i % 9, 15, (i % 7) / 5) for i in range(300)])
    w = window(spark, *[(1000 + 10.25 * i, 1000 + 10.25 * i + 47.5) for i in range(60)])
    got = reference.window_reference(w, rows, ["window_index"], bucket).orderBy("window_index").collect()
    data = rows.collect()
    for r, s in zip(got, w.collect()):
        inside = [x for x in data if s["start_epoch"] <= x["epoch_utc"] < s["end_epoch"]]
        assert r["n_total"] == len(inside)
        good = [x["pr_bpm"] for x in inside if x["pi"] >= 0.5] or [x["pr_bpm"] for x in inside]
        assert math.isclose(r["pr_bpm_mean"], sum(good) / len(good))


def test_interval_join_plans_as_an_equi_join(spark):
    rows, w = stream(spark, [(100, 60, 15, 1)]), window(spark, (100, 102))
    plan = reference.interval_join(w, rows, 60)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_summary_keeps_first_and_propagates_nan(spark):
    rows = spark.createDataFrame([(1, 60.0, 15.0, 1.0, 0), (1, 99.0, 15.0, 1.0, 1), (2, 80.0, float("nan"), 0.4, 2), (3, 70.0, float("nan"), 0.6, 3)], "epoch_utc long, pr_bpm double, rr_bpm double, pi double, n long")
    r = reference.reference_summary(rows, "n", 0.5, 65.0).first()
    assert (r["n_unique"], r["n_used"], r["n_filtered"], r["pr_bpm_mean"], r["fraction_above"]) == (3, 2, 1, 65.0, 0.5) and math.isnan(r["rr_bpm_mean"])


def sessions(spark, total):
    return spark.createDataFrame([("s", total)], "session_id string, total_frames long")


def test_sliding_grid(spark):
    for total, n, last in ((3000, 21, (2600, 3000)), (3001, 21, (2600, 3000)), (4800, 39, (4400, 4800)), (9000, 81, (8600, 9000))):
        got = windows.sliding_grid(sessions(spark, total), 400, 100, 600).orderBy("window_index").collect()
        assert len(got) == n and (got[0]["start_frame"], got[0]["end_frame"]) == (600, 1000) and (got[-1]["start_frame"], got[-1]["end_frame"]) == last
    for bad in ((0, 100, 600), (400, 0, 600), (400, 100, 0), (True, 100, 600)):
        with pytest.raises(ValueError):
            windows.sliding_grid(sessions(spark, 3000), *bad)
    with pytest.raises(PySparkException, match="no full window"):
        windows.sliding_grid(sessions(spark, 999), 400, 100, 600).collect()
    assert windows.pipeline_grid(sessions(spark, 399), 400, 100).count() == 0


def test_common_centers(spark):
    got = windows.common_center_grid(sessions(spark, 3000), [400, 500, 600], 100, 900, 600)
    assert {r["window_frames"]: r["count"] for r in got.groupBy("window_frames").count().collect()} == {400: 19, 500: 19, 600: 19}
    assert {r["window_frames"]: r["start_frame"] for r in got.where("window_index = 0").collect()} == {400: 700, 500: 650, 600: 600}
    assert got.agg(F.max("end_frame")).first()[0] == 3000
    for lengths, first, trim in (([400, 401], 900, 600), ([400, 400], 900, 600), ([400, 600], 850, 600), ([], 900, 600)):
        with pytest.raises(ValueError):
            windows.common_center_grid(sessions(spark, 3000), lengths, 100, first, trim)
    with pytest.raises(PySparkException, match="no center"):
        windows.common_center_grid(sessions(spark, 1000), [400, 600], 100, 900, 0).collect()


def test_window_slices_and_epochs(spark):
    series = spark.createDataFrame([("s", [float(i) for i in range(20)])], "session_id string, phase array<double>")
    grid = windows.with_epochs(windows.sliding_grid(sessions(spark, 20), 4, 4, 2), F.lit(1000.0), 20.0)
    got = windows.slices(grid, series).orderBy("window_index").collect()
    assert [r["phase"] for r in got][1] == [6.0, 7.0, 8.0, 9.0] and got[1]["start_epoch"] == 1000.3


def test_capture_log(spark, tmp_path):
    path = tmp_path / "log.txt"
    lines = ["noise", "Capture start time - Mon Jun 08 01:00:00 2026", "Capture start time - Tue Jun 09 11:59:55 2026", "Capture end time - Tue Jun 09 12:02:27 2026", "Duration(sec) - 152"]
    path.write_text("\n".join(lines))
    assert tables.capture_log(spark, str(path)).first().asDict() == {"start_epoch_utc": 1780995595, "end_epoch_utc": 1780995747, "duration_s": 152}
    path.write_text("\n".join(lines[:3]))
    with pytest.raises(PySparkException, match="lacks"):
        tables.capture_log(spark, str(path)).collect()


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("session_id,posture,distance_cm,radar_orientation,radar_start_epoch_seconds,stationary_intervals,locked_bin\na,seated,140,front,1000.5,30-150,29\nb,supine,x,front,,,29.5\nc,supine,90,front,7,5-9,\n")
    got = {r["session_id"]: r for r in tables.manifest_csv(spark, str(path)).collect()}
    assert (got["a"]["distance_m"], got["a"]["trim_s"], got["a"]["end_s"], got["a"]["locked_bin"]) == (1.4, 30, 150, 29)
    assert got["b"]["locked_bin"] is None and got["b"]["distance_m"] is None and got["b"]["trim_s"] is None and got["c"]["locked_bin"] is None
    bins = spark.createDataFrame([("c", 12)], "session_id string, bin_idx int")
    new = {r["session_id"]: r["locked_bin"] for r in tables.updated_manifest(tables.manifest_csv(spark, str(path)), bins).collect()}
    assert new == {"a": 29, "b": None, "c": 12}


def test_json_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")], (float("-inf"), "x"))], "a int, b double, c array<double>, d struct<e:double,f:string>")
    assert sinks.to_json_rows(df).first()[0] == '{"a":1,"b":null,"c":[1.0,null],"d":{"e":null,"f":"x"}}'
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 1
    sinks.write_comparison(df, str(tmp_path / "c"))
    assert tables.comparison_csv(spark, str(tmp_path / "c"), "a int, b double").first()["a"] == 1


def test_sessions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "q")
    make = lambda s, v: spark.createDataFrame([(s, v)], "session_id string, v int")
    for s, v in (("a", 1), ("b", 2), ("a", 3)):
        sinks.write_sessions(make(s, v), path)
    assert {(r["session_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 3), ("b", 2)}


def test_provenance(tmp_path):
    (tmp_path / "f").write_text("x")
    got = sinks.provenance(str(tmp_path), ["f", "g"], {"k": 1})
    assert got["sources"]["g"] == "missing" and len(got["sources"]["f"]) == 64 and got["commit"] is None and got["config"] == {"k": 1}


def test_windows_from_buckets_equal_slices(spark):
    """No row is longer than a window; results equal those of one array per session, for any bucket."""
    rows = [(s, 20 + i, float(100 * k + i)) for k, s in enumerate(("a", "b")) for i in range(500)]
    frames = spark.createDataFrame(rows, "session_id string, frame_idx long, phase double").repartition(5)
    whole = spark.createDataFrame([(s, [0.0] * 20 + [x for t, _, x in rows if t == s]) for s in ("a", "b")], "session_id string, phase array<double>")
    grid = windows.sliding_grid(spark.createDataFrame([("a", 520), ("b", 519)], "session_id string, total_frames long"), 100, 30, 20)
    want = {(r["session_id"], r["window_index"]): r["phase"] for r in windows.slices(grid, whole).collect()}
    for bucket in (1, 7, 100, 256, 100_000):
        got = windows.assemble(grid, frames, "phase", bucket)
        assert {(r["session_id"], r["window_index"]): r["phase"] for r in got.collect()} == want and got.columns == [*grid.columns, "phase"]


def test_windows_with_gaps_or_repeated_frames_fail(spark):
    frames = spark.createDataFrame([("a", i, 1.0) for i in range(60) if i != 33] + [("a", 5, 1.0)], "session_id string, frame_idx long, phase double")
    at = lambda a, b: spark.createDataFrame([("a", 0, a, b)], "session_id string, window_index int, start_frame long, end_frame long")
    assert len(windows.assemble(at(10, 30), frames, "phase", 8).first()["phase"]) == 20
    for a, b in ((30, 40), (0, 10), (50, 70), (200, 210)):
        with pytest.raises(Exception, match="lacks frames"):
            windows.assemble(at(a, b), frames, "phase", 8).collect()
