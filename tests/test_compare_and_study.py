"""Error metrics, paired conditions and studies on literal inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cardiolake.functions import selection
from cardiolake.operators import compare, study

NAN = float("nan")


def pairs(spark, rows):
    return spark.createDataFrame([(c, f, hr, pr, v) for c, f, hr, pr, v in rows], "condition string, center_frame long, radar_hr double, reference_pr double, ahet_verified boolean")


def test_metrics_and_populations(spark):
    rows = [(0, 72.0, 70.0, False), (1, 66.0, 70.0, False), (2, NAN, 70.0, False), (3, 90.0, 70.0, True), (4, None, 70.0, False)]
    df = spark.createDataFrame(rows, "window_index int, hr_bpm double, pr double, low boolean")
    ref = df.select("window_index", F.col("pr").alias("pr_bpm_mean"), F.col("low").alias("low_quality"))
    merged = compare.compare(df.select("window_index", "hr_bpm"), ref, ["window_index"])
    m = compare.accuracy(merged).first()
    assert (m["n_windows"], m["n_nan_windows"], m["mae_bpm"], m["bias_bpm"]) == (2, 2, 3.0, -1.0) and math.isclose(m["rmse_bpm"], math.sqrt(10))
    assert compare.accuracy(merged, drop_low_quality=False).first()["n_windows"] == 3
    assert compare.finite_error_metrics(merged).first()["n_windows"] == 3
    assert compare.accuracy(merged.where("window_index = 2")).count() == 0


def test_condition_coverage_counts_gaps(spark):
    df = pairs(spark, [("a", 1, 72.0, 70.0, True), ("a", 2, NAN, 70.0, True), ("a", 3, 71.0, None, False), ("b", 1, NAN, 70.0, False)])
    got = {r["condition"]: r for r in compare.condition_coverage(df, "condition").collect()}
    a, b = got["a"], got["b"]
    assert (a["n_total"], a["n_finite"], a["n_nan_radar"], a["n_nan_ref"], a["n_ahet_verified"], a["mae_bpm"]) == (3, 1, 1, 1, 2, 2.0)
    assert b["n_finite"] == 0 and b["mae_bpm"] is None


def test_intersection_drops_a_center_with_a_gap(spark):
    rows = [(c, f, (NAN if (c, f) == ("b", 1000) else 70.0 + i), 70.0, True) for i, c in enumerate("abc") for f in range(900, 2701, 100)]
    df, names = pairs(spark, rows), list("abc")
    sets = compare.center_sets(df, names)
    assert compare.common_centers(sets, names).count() == 18 and compare.all_centers(sets, names).count() == 19
    compare.require_common_centers(sets, names)
    errors = compare.paired_errors(df, names)
    got = {r["condition"]: r for r in compare.paired_intersection(errors).collect()}
    assert got["c"]["n_centers"] == 18 and got["c"]["mae_bpm"] == 2.0
    vector = compare.error_vector(errors).where("condition = 'c'").orderBy("rank").collect()
    assert [r["error"] for r in vector] == [2.0] * 18 and [r["rank"] for r in vector] == list(range(1, 19)) and vector[1]["center_frame"] == 1100


def test_pairwise_differences_and_moves(spark):
    e = {"x": [3.0, -1.0, 2.0], "y": [1.0, 2.0, -1.0]}
    v = {"x": [True, True, False], "y": [True, False, False]}
    df = pairs(spark, [(c, 10 * i, 70 + e[c][i], 70.0, v[c][i]) for c in e for i in range(3)])
    errors = compare.paired_errors(df, ["x", "y"])
    r = compare.pairwise(errors).first()
    assert (r["condition_a"], r["condition_b"], r["n_pairs"]) == ("x", "y", 3)
    assert math.isclose(r["mean_error_diff"], 2 / 3) and math.isclose(r["mean_abs_error_diff"], 2 / 3)
    assert [x["diff"] for x in compare.pairwise_rows(errors).orderBy("center_frame").collect()] == [2.0, -3.0, 3.0]
    assert (r["both_pass"], r["only_a_passes"], r["only_b_passes"], r["neither_passes"]) == (1, 1, 0, 1) and r["median_abs_error_diff"] == 1.0
    assert compare.pairwise(compare.paired_errors(df, ["y", "x"])).first()["condition_a"] == "y"


def test_studies_count_conditions_not_rows(spark):
    """Two rows of one condition never stand for two conditions; a center that a condition has twice is an error."""
    names = list("abc")
    twice = pairs(spark, [("a", 1, 72.0, 70.0, True), ("a", 1, 73.0, 70.0, True), ("b", 1, 71.0, 70.0, True)])
    every = pairs(spark, [(c, 1, 72.0, 70.0, True) for c in "abc" for _ in range(2)])
    for df in (twice, every):
        with pytest.raises(Exception, match="center 1 twice"):
            compare.center_sets(df, names).collect()
        with pytest.raises(Exception, match="center 1 twice"):
            compare.paired_intersection(compare.paired_errors(df, names)).collect()


def test_studies_refuse_what_cannot_be_paired(spark):
    some = pairs(spark, [("20s", 900, 72.0, 70.0, True), ("25s", 1000, 71.0, 70.0, True)])
    names = ["20s", "25s"]
    sets = compare.center_sets(some, names)
    assert [tuple(r) for r in compare.all_centers(sets, names).orderBy("center_frame").collect()] == [(900, 1, "25s"), (1000, 1, "20s")]
    with pytest.raises(ValueError, match="no center"):
        compare.require_common_centers(sets, names)
    for bad in ([], ["20s", "20s"], [str(i) for i in range(70)]):
        with pytest.raises(ValueError, match="distinct conditions"):
            compare.center_sets(some, bad)
    with pytest.raises(ValueError, match="baseline"):
        compare.paired_errors(some, names, baseline="30s")
    with pytest.raises(ValueError, match="missing columns"):
        compare.paired_errors(some.drop("ahet_verified"), names)
    with pytest.raises(ValueError, match="whole numbers"):
        compare.center_sets(some.withColumn("center_frame", F.col("center_frame").cast("double")), names)
    with pytest.raises(Exception, match="unknown condition 25s"):
        compare.center_sets(some, ["20s"]).collect()
    with pytest.raises(Exception, match="center is null"):
        compare.center_sets(some.withColumn("center_frame", F.lit(None).cast("long")), names).collect()


def test_a_condition_without_values_leaves_an_empty_intersection(spark):
    df = pairs(spark, [("A", f, NAN, 70.0, False) for f in (900, 1000)] + [("B", f, 72.0, 70.0, True) for f in (900, 1000)])
    sets = compare.center_sets(df, ["A", "B"])
    compare.require_common_centers(sets, ["A", "B"])  # keys are common, values aren't
    assert compare.common_centers(sets, ["A", "B"]).count() == 0
    table = compare.coverage_table(compare.condition_coverage(df, "condition"), compare.paired_intersection(compare.paired_errors(df, ["A", "B"])), ["A", "B"])
    lines = table.splitlines()
    assert lines[0].split() == ["Condition", "n_total", "n_finite", "n_ahet", "n_nan_radar", "n_nan_ref", "MAE", "RMSE", "Bias"] and "Intersection (n=0)" in lines
    assert lines[2].split() == ["A", "2", "0", "0", "2", "0", "NaN", "NaN", "NaN"] and lines[3].split() == ["B", "2", "2", "2", "0", "0", "2.00", "2.00", "2.00"]
    assert len({len(x) for x in lines if x and not x.startswith("Intersection")}) == 1


def test_studies_of_several_captures_stay_apart(spark):
    rows = [("one", "a", 1, 72.0), ("one", "b", 1, 71.0), ("two", "a", 1, 75.0), ("two", "b", 2, 71.0)]
    df = spark.createDataFrame([(k, c, f, x, 70.0, True) for k, c, f, x in rows], "capture string, condition string, center_frame long, radar_hr double, reference_pr double, ahet_verified boolean")
    got = compare.pairwise(compare.paired_errors(df, ["a", "b"], "capture"), "capture").collect()
    assert [(r["capture"], r["mean_error_diff"]) for r in got] == [("one", 1.0)]


def test_exact_percentiles_of_groups_of_any_shape(spark):
    rng = random.Random(1)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "ties": [1.0] * 500 + [2.0] * 499 + [3.0], "equal": [7.0] * 300, "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        "nan": [NAN] * 3 + [1.0, 5.0, float("inf"), -float("inf")], "all nan": [NAN, NAN], "zeros": [0.0, -0.0, 0.0], "large": [rng.gauss(0, 1) for _ in range(6000)] + [NAN] * 100, None: [4.0, 1.0, None, 3.0], "none": [None, None],
    }
    rows = [(k, v) for k, x in groups.items() for v in x]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    fractions = [0.0, 0.01, 0.5, 0.9, 0.95, 0.999, 1.0]
    want = {r["k"]: (r["n"], r["q"]) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*[F.lit(f) for f in fractions])).alias("q")).collect()}
    for accuracy in (20, 10_000):  # with 20, brackets are a fifth of a group and more
        got = {r["k"]: (r["n"], r["percentiles"]) for r in selection.percentiles(df, "v", fractions, ["k"], accuracy).collect()}
        assert got.keys() == want.keys()
        for k, (n, q) in got.items():
            assert n == want[k][0], k
            zero = lambda x: x if x is None else x + 0.0
            assert repr(q) == repr([zero(x) for x in want[k][1] or [None] * len(fractions)]), k
    assert selection.percentiles(df.where("false"), "v", [0.5], ["k"]).collect() == []


def test_micro_and_macro_pooling(spark):
    rows = [("c1", "20s", x) for x in (1.0, -2.0, 3.0)] + [("c2", "20s", x) for x in (2.0, -1.0, 4.0)]
    micro, per, macro = study.pooled(spark.createDataFrame(rows, "capture string, length string, error double"))
    assert micro.first()["n"] == 6 and math.isclose(micro.first()["mae_bpm"], 13 / 6)
    assert math.isclose(macro.first()["mae_mean"], (2.0 + 7 / 3) / 2) and macro.first()["mae_min"] == 2.0
    assert per.count() == 2


def test_trends(spark):
    rows = [("a", 3.0, 2.0, 1.0), ("b", 1.0, 2.0, 3.0), ("c", 2.0, 2.0, 2.0), ("d", 3.0, 1.0, 2.0), ("e", 3.0, None, 2.0)]
    df = spark.createDataFrame([(k, n, m) for k, *ms in rows for n, m in zip(study.LENGTHS, ms)], "capture string, length string, mae_bpm double")
    got = {r["capture"]: (r["trend"], r["strict_trend"]) for r in study.capture_trends(df).collect()}
    assert got == {"a": ("monotonic_improvement", "YES"), "b": ("no_improvement", "NO"), "c": ("monotonic_improvement", "NO"), "d": ("partial_improvement", "PART"), "e": ("unavailable", "n/a")}


def test_verdicts(spark):
    rows = [("s", 5.0), ("s", 7.0), ("p", 6.0), ("p", 12.0), ("m", 8.0), ("m", 9.0), ("x", 8.0), ("x", 12.0), ("f", 10.0)]
    df = spark.createDataFrame(rows, "k string, mae_bpm double")
    assert {r["k"]: r["verdict"] for r in study.verdict(df, "k").collect()} == {"s": "STRONG PASS", "p": "PASS", "m": "MARGINAL", "x": "MIXED", "f": "FAIL"}
    assert study.mean_session_mae(df.union(spark.createDataFrame([("n", NAN)], df.schema))).first()["n_sessions"] == 9


def test_worst_windows_put_unknown_last(spark):
    df = spark.createDataFrame([("s", i, e) for i, e in enumerate((1.0, NAN, 5.0, None, 5.0))], "k string, i int, abs_error_bpm double")
    assert [r["i"] for r in study.worst(df, 4, "k", tie="i").orderBy("rank").collect()] == [2, 4, 0, 1]


def test_harmonics(spark):
    df = spark.createDataFrame([(0.25, 72.0), (0.1, 60.0), (0.9, 60.0)], "f_r_hz double, pr_bpm_mean double")
    k = df.withColumn("k_max", study.adaptive_k_max(F.col("f_r_hz")))
    assert [r["k_max"] for r in k.collect()] == [3, 6, 1]
    rows = study.suppressed_harmonics(k.where("f_r_hz = 0.25")).collect()
    assert [(r["k"], r["in_band"], r["suppressed"]) for r in rows] == [(1, False, True), (2, False, True), (3, False, True), (4, True, False), (5, True, False)]
    h = study.harmonic_intruders(df.where("f_r_hz = 0.25"))
    assert {r["k"]: (r["n_in_band"], r["n_near_reference"]) for r in h.collect()} == {2: (0, 0), 3: (0, 0), 4: (1, 0), 5: (1, 1), 6: (1, 0)}
    assert study.primary_intruder(h).first()["primary_k"] == 4
