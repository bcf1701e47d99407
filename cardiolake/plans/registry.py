"""Queries over the driver's tables, each with the SQL that it must equal. Doubles are rounded to six decimals."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dsp, series, spectral
from ..operators import compare, evidence, quality, reference, study, vitals, windows
from ..session import shared_folder, written
from ..sources import sinks, store, tables
from . import views

#: Added, here and in the SQL, to means of short decimals before they are rounded: sums in another order differ by less than that,
#: and exact halves then go the same way.
TIE = 1e-9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; with its SQL where that can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(F.col(f"`{x.name}`"), 6).alias(x.name) if isinstance(x.dataType, T.DoubleType) else F.col(f"`{x.name}`") for x in df.schema.fields])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


EVENTS = """ev AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_utc, event_type, user_id, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events),
sn AS (SELECT min(epoch_utc) // 86400 * 86400 AS o, 24 * ((max(epoch_utc) - min(epoch_utc) // 86400 * 86400) // 86400 + 1) AS hh FROM ev)"""
STREAM = EVENTS + """, st AS (SELECT event_id, epoch_utc, value AS pr_bpm, value / 4 AS rr_bpm, k / 50 AS pi, user_id AS session FROM ev)"""
# round half to even at one decimal, as the stream's merge does
EVEN = lambda x: f"(CASE WHEN abs({x} * 10 - floor({x} * 10) - 0.5) < 1e-9 THEN 2 * round({x} * 5) / 10 ELSE round({x}, 1) END)"
MERGED = STREAM + f""", me AS (SELECT epoch_utc, round_even(avg(pr_bpm), 1) AS pr_bpm, round_even(avg(rr_bpm), 1) AS rr_bpm, round_even(avg(pi), 1) AS pi, arg_min(session, event_id) AS session FROM st GROUP BY epoch_utc)"""


def gated(hours: int = 6) -> str:
    """CTEs of sliding windows of some hours, a hop of one hour, with the gated reference."""
    return MERGED + f""", w AS (SELECT i AS window_index, 1 + i AS start_frame, {1 + hours} + i AS end_frame, CAST(o + (1 + i) * 3600 AS DOUBLE) AS start_epoch, CAST(o + ({1 + hours} + i) * 3600 AS DOUBLE) AS end_epoch FROM (SELECT o, unnest(range(0, hh - {hours})) AS i FROM sn)), g AS (
  SELECT window_index, start_epoch, coalesce(avg(pr_bpm) FILTER (WHERE pi >= 0.5), avg(pr_bpm)) AS pr_bpm_mean, coalesce(stddev_pop(pr_bpm) FILTER (WHERE pi >= 0.5), stddev_pop(pr_bpm)) AS pr_bpm_std,
         avg(rr_bpm) AS rr_bpm_mean, count(epoch_utc) AS n_total, count(*) FILTER (WHERE pi >= 0.5) AS n_good_pi, count(*) FILTER (WHERE pi >= 0.5) < 0.8 * count(epoch_utc) AS low_quality
  FROM w LEFT JOIN me ON epoch_utc >= start_epoch AND epoch_utc < end_epoch GROUP BY ALL)"""


GATED = gated()
PAIRS = EVENTS + """, cw AS (SELECT c AS center_frame, n AS condition, o + (c - h / 2) * 3600 AS s, o + (c + h / 2) * 3600 AS e FROM (SELECT o, unnest(range(12, hh - 11)) AS c FROM sn), (VALUES ('6h', 6), ('12h', 12), ('24h', 24)) l(n, h)),
pa AS (SELECT condition, center_frame, 'cap' || CAST((center_frame // 24) % 3 AS VARCHAR) AS capture, avg(value) FILTER (WHERE event_type = 'click') AS radar_hr, avg(value) FILTER (WHERE event_type = 'view') AS reference_pr,
       count(*) FILTER (WHERE event_type = 'click') >= 2 AS ahet_verified
  FROM cw LEFT JOIN ev ON epoch_utc >= s AND epoch_utc < e GROUP BY ALL),
er AS (SELECT *, radar_hr - reference_pr AS err FROM pa),
cc AS (SELECT center_frame FROM er GROUP BY 1 HAVING count(err) = 3),
ix AS (SELECT er.* FROM er JOIN cc USING (center_frame))"""
METRICS = "round(avg(abs({e})), 6) AS mae_bpm, round(sqrt(avg({e} * {e})), 6) AS rmse_bpm, round(avg({e}), 6) AS bias_bpm"
PER = ", pc AS (SELECT condition AS length, capture, count(*) AS n, avg(abs(err)) AS mae_bpm, sqrt(avg(err * err)) AS rmse_bpm, avg(err) AS bias_bpm FROM ix GROUP BY ALL)"
FRAMES = """fr AS (SELECT CAST(label AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, [round(CAST(embedding[2 * i - 1] AS DOUBLE) * 1024) / 1024 for i in range(1, 33)] AS re, [round(CAST(embedding[2 * i] AS DOUBLE) * 1024) / 1024 for i in range(1, 33)] AS im FROM embeddings)"""
PHASOR = FRAMES + """, ph AS (SELECT session_id, frame_idx, re[1] AS re, im[1] AS im, re AS res, im AS ims, atan2(im[1], re[1]) AS angle FROM fr)"""
UNWRAP = PHASOR + """, d0 AS (SELECT *, angle - lag(angle) OVER w AS step FROM ph WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx)),
d1 AS (SELECT *, CASE WHEN step > pi() THEN -2 * pi() WHEN step < -pi() THEN 2 * pi() ELSE 0.0 END AS fix FROM d0),
uw AS (SELECT session_id, frame_idx, angle, angle + sum(coalesce(fix, 0.0)) OVER (PARTITION BY session_id ORDER BY frame_idx) AS unwrapped FROM d1)"""
# long form of the samples: a in 0..3 numbers chirp and receiver, s the sample
SAMPLES = FRAMES + """, sm AS (SELECT session_id, frame_idx, i // 8 AS a, i % 8 AS s, re[i + 1] AS re, im[i + 1] AS im FROM fr, range(0, 32) t(i)),
zz AS (SELECT session_id, frame_idx, a, k, sum(re * cos(2 * pi() * k * s / 8) + im * sin(2 * pi() * k * s / 8)) AS zr, sum(im * cos(2 * pi() * k * s / 8) - re * sin(2 * pi() * k * s / 8)) AS zi FROM sm, range(0, 8) u(k) GROUP BY ALL),
be AS (SELECT session_id, frame_idx, k AS bin_idx, avg(zr * zr + zi * zi) AS energy, avg(zr) AS mr, avg(zi) AS mi FROM zz GROUP BY ALL),
rx AS (SELECT session_id, frame_idx, a % 2 AS r, avg(re * re + im * im) AS e FROM sm GROUP BY ALL),
ft AS (SELECT session_id, frame_idx, max(greatest(abs(re), abs(im))) AS max_abs_adc, avg(re * re + im * im) AS frame_energy FROM sm GROUP BY ALL)"""
MASK = SAMPLES + """, sb AS (SELECT session_id, frame_idx, energy AS e2 FROM be WHERE bin_idx = 2),
n AS (SELECT session_id, count(*) AS n FROM sb GROUP BY 1),
pad AS (SELECT session_id, p, e2 FROM (SELECT sb.session_id, unnest([frame_idx, -1 - frame_idx, 2 * n - 1 - frame_idx]) AS p, e2, n FROM sb JOIN n USING (session_id)) WHERE p >= -3 AND p < n + 3),
rm AS (SELECT session_id, p AS frame_idx, median(e2) OVER (PARTITION BY session_id ORDER BY p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS roll FROM pad),
bg AS (SELECT session_id, frame_idx, median(energy) AS m FROM be WHERE abs(bin_idx - 2) > 1 GROUP BY ALL),
im AS (SELECT session_id, frame_idx, max(e) / min(e) AS ratio FROM rx GROUP BY ALL),
md AS (SELECT session_id, median(frame_energy) AS m FROM ft GROUP BY 1),
pm AS (SELECT session_id, frame_idx, mr, mi, lag(mr) OVER w AS lr, lag(mi) OVER w AS li FROM be WHERE bin_idx = 2 WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx)),
qm AS (SELECT ft.session_id, ft.frame_idx, max_abs_adc >= 0.35 AS clip_flagged, frame_energy < 0.8 * md.m AS dead_flagged, ratio AS rx_energy_ratio, ratio > 1.8 AS rx_imbalance_flagged,
         e2 AS subject_bin_energy, e2 > 1.6 * greatest(roll, 1e-12) AS motion_spike_flagged, roll > 1e-12 AND e2 < 0.5 * roll AS subject_bin_dropout_flagged, e2 / greatest(bg.m, 1e-12) AS subject_bin_snr, e2 / greatest(bg.m, 1e-12) < 0.8 AS snr_flagged,
         coalesce(atan2(mi * lr - mr * li, mr * lr + mi * li), 0.0) AS phase_delta, abs(coalesce(atan2(mi * lr - mr * li, mr * lr + mi * li), 0.0)) > 1.5 AS phase_jump_flagged
  FROM ft JOIN md USING (session_id) JOIN im USING (session_id, frame_idx) JOIN sb USING (session_id, frame_idx) JOIN rm USING (session_id, frame_idx) JOIN bg USING (session_id, frame_idx) JOIN pm USING (session_id, frame_idx)),
qq AS (SELECT *, NOT (clip_flagged OR dead_flagged OR rx_imbalance_flagged OR motion_spike_flagged) AS quality_mask FROM qm)"""
CHECKS = {
    "clip": {"full_scale": 0.35}, "dead": {"fraction": 0.8}, "rx_imbalance": {"enabled": True, "max_ratio": 1.8}, "motion_spike": {"enabled": True, "bin": 2, "factor": 1.6, "half_window": 3},
    "subject_bin_dropout": {"bin": 2, "fraction": 0.5, "half_window": 3}, "snr": {"bin": 2, "guard": 1, "min_snr": 0.8}, "phase_jump": {"threshold_rad": 1.5},
}
HOURLY = EVENTS + """, hh AS (SELECT h AS hour, coalesce(sum(value), 0.0) AS v FROM (SELECT o, unnest(range(0, hh)) AS h FROM sn) LEFT JOIN ev ON (epoch_utc - o) // 3600 = h GROUP BY 1),
dy AS (SELECT hour // 24 AS day, hour % 24 AS i, v * (0.5 - 0.5 * cos(2 * pi() * (hour % 24) / 23)) AS x FROM hh),
sp AS (SELECT day, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / 24)), 2) + pow(sum(x * sin(2 * pi() * k * i / 24)), 2)) AS m FROM dy, range(0, 13) u(k) GROUP BY ALL)"""


def S(ctes: str, select: str, macro: str = "") -> str:
    text = f"WITH {ctes} {select}"
    for c in ("pr_bpm", "rr_bpm", "pi"):
        text = text.replace(f"round_even(avg({c}), 1)", EVEN(f"avg({c})"))
    return text


# -- reference stream -----------------------------------------------------------------------------------------------------


@query(S(MERGED, "SELECT epoch_utc, round(pr_bpm, 6) AS pr_bpm, round(rr_bpm, 6) AS rr_bpm, round(pi, 6) AS pi, session FROM me"))
def reference_duplicate_merge(spark, sf_dir):
    return views.merged(spark, sf_dir).select("epoch_utc", "pr_bpm", "rr_bpm", "pi", "session")


@query(S(STREAM, "SELECT count(*) AS n_raw, count(DISTINCT epoch_utc) AS n_unique, count(*) - count(DISTINCT epoch_utc) AS n_merged, max(epoch_utc) - min(epoch_utc) + 1 - count(DISTINCT epoch_utc) AS n_missing FROM st"))
def reference_coverage(spark, sf_dir):
    return reference.coverage(views.stream(spark, sf_dir))


@query(S(STREAM, "SELECT event_id, epoch_utc FROM st WHERE epoch_utc >= 1704500000 AND epoch_utc < 1705000000"))
def interval_crop(spark, sf_dir):
    return reference.crop(views.stream(spark, sf_dir), 1_704_500_000, 1_705_000_000).select("event_id", "epoch_utc")


@query(S(GATED, "SELECT window_index, round(pr_bpm_mean + 1e-9, 6) AS pr_bpm_mean, round(pr_bpm_std, 6) AS pr_bpm_std, round(rr_bpm_mean + 1e-9, 6) AS rr_bpm_mean, n_total, n_good_pi, low_quality FROM g"))
def interval_join_gated_stats(spark, sf_dir):
    got = reference.window_reference(views.hour_windows(spark, sf_dir), views.merged(spark, sf_dir), ["window_index"], 3600).drop("rr_bpm_gated")
    return got.withColumns({c: F.col(c) + TIE for c in ("pr_bpm_mean", "rr_bpm_mean")})


@query(S(STREAM + ", o AS (SELECT *, row_number() OVER (PARTITION BY epoch_utc ORDER BY event_id) AS k FROM st), f AS (SELECT * FROM o WHERE k = 1)", """
SELECT count(*) AS n_unique, count(*) FILTER (WHERE pi >= 0.5) AS n_used, count(*) - count(*) FILTER (WHERE pi >= 0.5) AS n_filtered, """ + ", ".join(f"round({f}({c}) FILTER (WHERE pi >= 0.5), 6) AS {c}_{n}" for c in ("pr_bpm", "rr_bpm", "pi") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + """,
round(avg(CASE WHEN pr_bpm > 100 THEN 1.0 ELSE 0.0 END) FILTER (WHERE pi >= 0.5), 6) AS fraction_above FROM f"""))
def reference_summary(spark, sf_dir):
    return reference.reference_summary(views.stream(spark, sf_dir), "event_id", 0.5, 100.0)


def _estimates(spark, sf_dir, hours: int = 6) -> DataFrame:
    """Windows with an estimate (mean of one event type) joined to the gated reference."""
    w = views.hour_windows(spark, sf_dir, hours)
    e = views.events(spark, sf_dir).where("event_type = 'click'").select("epoch_utc", "value")
    hr = reference.interval_join(w, e, 3600).groupBy("window_index", "start_frame", "end_frame").agg(F.avg("value").alias("hr_bpm"), F.count("value").alias("n_click"))
    ref = reference.window_reference(w, views.merged(spark, sf_dir), ["window_index"], 3600)
    return compare.compare(hr, ref, ["window_index"]).withColumn("ahet_verified", F.col("n_click") >= 2)


def estimates(hours: int = 6) -> str:
    return gated(hours) + """, hr AS (SELECT window_index, start_frame, end_frame, avg(value) AS hr_bpm, count(value) AS n_click FROM w LEFT JOIN (SELECT * FROM ev WHERE event_type = 'click') x ON epoch_utc >= start_epoch AND epoch_utc < end_epoch GROUP BY ALL),
es AS (SELECT hr.*, pr_bpm_mean, low_quality, hr_bpm - pr_bpm_mean AS error_bpm, abs(hr_bpm - pr_bpm_mean) AS abs_error_bpm, n_click >= 2 AS ahet_verified FROM hr JOIN g USING (window_index))"""


ESTIMATES = estimates()


@query(S(ESTIMATES, "SELECT window_index // 24 AS day, count(hr_bpm) AS n_windows, count(*) - count(hr_bpm) AS n_nan_windows, " + METRICS.format(e="error_bpm") + " FROM es GROUP BY 1 HAVING count(hr_bpm) > 0"))
def window_accuracy_metrics(spark, sf_dir):
    return compare.accuracy(_estimates(spark, sf_dir).withColumn("day", F.expr("cast(window_index div 24 AS bigint)")), "day", drop_low_quality=False)


@query(S(ESTIMATES, "SELECT count(hr_bpm) AS n_windows, count(*) - count(hr_bpm) AS n_nan_windows, " + METRICS.format(e="error_bpm") + " FROM es WHERE NOT low_quality HAVING count(hr_bpm) > 0"))
def accuracy_of_good_windows(spark, sf_dir):
    return compare.accuracy(_estimates(spark, sf_dir))


@query(S(ESTIMATES, "SELECT ahet_verified, count(error_bpm) AS n_windows, " + METRICS.format(e="error_bpm") + " FROM es GROUP BY 1"))
def accuracy_by_verification(spark, sf_dir):
    return compare.finite_error_metrics(_estimates(spark, sf_dir), "ahet_verified")


@query(S(ESTIMATES, "SELECT day, rank, window_index, round(abs_error_bpm + 1e-9, 6) AS abs_error_bpm FROM (SELECT window_index // 24 AS day, window_index, abs_error_bpm, CAST(row_number() OVER (PARTITION BY window_index // 24 ORDER BY abs_error_bpm DESC NULLS LAST, window_index) AS INTEGER) AS rank FROM es) WHERE rank <= 3"))
def worst_windows(spark, sf_dir):
    d = _estimates(spark, sf_dir).withColumn("day", F.expr("cast(window_index div 24 AS bigint)"))
    return study.worst(d, 3, "day", tie="window_index").select("day", "rank", "window_index", (F.col("abs_error_bpm") + TIE).alias("abs_error_bpm"))


@query(S(ESTIMATES, "SELECT window_index // 24 AS day, count(*) AS n, string_agg(CAST(window_index AS VARCHAR), ',' ORDER BY window_index) AS windows FROM es WHERE abs_error_bpm > 20 GROUP BY 1"))
def flagged_windows(spark, sf_dir):
    d = _estimates(spark, sf_dir).withColumn("day", F.expr("cast(window_index div 24 AS bigint)"))
    got = study.flagged_windows(d, 20.0, "day", "window_index")
    return got.withColumn("windows", F.array_join(F.col("windows").cast("array<string>"), ","))


CENTERS = [S(estimates(h), f"SELECT (start_frame + end_frame) // 2 AS center_frame, error_bpm AS {c} FROM es") for h, c in ((6, "a"), (12, "b"))]


@query(f"SELECT center_frame, round(a + 1e-9, 6) AS error_a, round(b + 1e-9, 6) AS error_b FROM ({CENTERS[0]}) JOIN ({CENTERS[1]}) USING (center_frame)")
def aligned_centers(spark, sf_dir):
    got = compare.align_centers(_estimates(spark, sf_dir), _estimates(spark, sf_dir, 12), ("a", "b"))
    return got.select("center_frame", (F.col("error_a") + TIE).alias("error_a"), (F.col("error_b") + TIE).alias("error_b"))


@query(S(ESTIMATES, "SELECT window_index, '{\"window_index\":' || window_index || ',\"low_quality\":' || low_quality || ',\"n_click\":' || n_click || ',\"ratio\":' || CASE WHEN n_click = 0 THEN 'null' ELSE CAST(n_click AS VARCHAR) || '.0' END || '}' AS json FROM es"))
def nan_safe_json(spark, sf_dir):
    ratio = F.when(F.col("n_click") == 0, F.lit(float("nan"))).otherwise(F.col("n_click").cast("double"))
    d = _estimates(spark, sf_dir).select("window_index", "low_quality", "n_click", ratio.alias("ratio"))
    return sinks.to_json_rows(d).select(F.get_json_object("json", "$.window_index").cast("int").alias("window_index"), "json")


# -- grids ----------------------------------------------------------------------------------------------------------------


@query(S(EVENTS, "SELECT 'all' AS session_id, CAST(i AS INTEGER) AS window_index, CAST(1 + i AS BIGINT) AS start_frame, CAST(7 + i AS BIGINT) AS end_frame, CAST(o + (1 + i) * 3600 AS DOUBLE) AS start_epoch, CAST(o + (7 + i) * 3600 AS DOUBLE) AS end_epoch FROM (SELECT o, unnest(range(0, hh - 6)) AS i FROM sn)"))
def sliding_window_grid(spark, sf_dir):
    return views.hour_windows(spark, sf_dir)


@query(S(EVENTS, "SELECT 'all' AS session_id, h AS window_frames, CAST(c - 12 AS INTEGER) AS window_index, c AS center_frame, c - h // 2 AS start_frame, c + h - h // 2 AS end_frame FROM (SELECT unnest(range(12, hh - 11)) AS c FROM sn), (VALUES (6), (12), (24)) l(h)"))
def common_center_grid(spark, sf_dir):
    return windows.common_center_grid(views.span(spark, sf_dir), [6, 12, 24], 1, 12, 0)


@query("SELECT CAST(o_custkey AS VARCHAR) AS session_id, i AS window_index, 2 * i AS start_frame, 2 * i + 4 AS end_frame FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 4), range(0, 200) t(i) WHERE 2 * i + 4 <= n")
def pipeline_grid(spark, sf_dir):
    s = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("session_id")).agg(F.count("*").alias("total_frames"))
    return windows.pipeline_grid(s, 4, 2)


# -- paired studies -------------------------------------------------------------------------------------------------------


@query(S(PAIRS, "SELECT condition, count(*) AS n_total, count(err) AS n_finite, count(*) - count(radar_hr) AS n_nan_radar, count(*) - count(reference_pr) AS n_nan_ref, count(*) FILTER (WHERE ahet_verified) AS n_ahet_verified, " + METRICS.format(e="err") + " FROM er GROUP BY 1"))
def condition_coverage(spark, sf_dir):
    return compare.condition_coverage(views.pairs(spark, sf_dir), "condition")


CONDITIONS = list(views.LENGTHS)


def _paired(spark, sf_dir) -> DataFrame:
    return compare.paired_errors(views.pairs(spark, sf_dir), CONDITIONS, baseline=CONDITIONS[0])


@query(S(PAIRS, "SELECT center_frame FROM cc"))
def common_centers(spark, sf_dir):
    return compare.common_centers(compare.center_sets(views.pairs(spark, sf_dir), CONDITIONS), CONDITIONS)


@query(S(PAIRS, "SELECT center_frame, CAST(count(*) AS INTEGER) AS n_conditions, concat_ws(',', CASE WHEN count(*) FILTER (WHERE condition = '6h') = 0 THEN '6h' END, CASE WHEN count(*) FILTER (WHERE condition = '12h') = 0 THEN '12h' END, CASE WHEN count(*) FILTER (WHERE condition = '24h') = 0 THEN '24h' END) AS lacking FROM pa WHERE radar_hr IS NOT NULL GROUP BY 1"))
def union_of_centers(spark, sf_dir):
    """All centers at which any condition has an estimate, and which conditions lack one."""
    estimated = views.pairs(spark, sf_dir).where("radar_hr IS NOT NULL")
    return compare.all_centers(compare.center_sets(estimated, CONDITIONS), CONDITIONS)


@query(S(PAIRS, "SELECT condition, count(*) AS n_centers, count(*) FILTER (WHERE ahet_verified) AS n_ahet, " + METRICS.format(e="err") + ", round(arg_min(err, center_frame), 6) AS first_error, round(arg_max(err, center_frame), 6) AS last_error FROM ix GROUP BY 1"))
def paired_intersection(spark, sf_dir):
    return compare.paired_intersection(_paired(spark, sf_dir))


@query(S(PAIRS + ", o AS (SELECT *, CASE condition WHEN '6h' THEN 0 WHEN '12h' THEN 1 ELSE 2 END AS k FROM ix)", """SELECT a.condition AS condition_a, b.condition AS condition_b, count(*) AS n_pairs, round(avg(a.err - b.err), 6) AS mean_error_diff, round(avg(abs(a.err) - abs(b.err)), 6) AS mean_abs_error_diff,
round(median(abs(a.err) - abs(b.err)), 6) AS median_abs_error_diff, count(*) FILTER (WHERE a.ahet_verified AND b.ahet_verified) AS both_pass, count(*) FILTER (WHERE a.ahet_verified AND NOT b.ahet_verified) AS only_a_passes,
count(*) FILTER (WHERE NOT a.ahet_verified AND b.ahet_verified) AS only_b_passes, count(*) FILTER (WHERE NOT a.ahet_verified AND NOT b.ahet_verified) AS neither_passes FROM o a JOIN o b ON a.center_frame = b.center_frame AND a.k < b.k GROUP BY ALL"""))
def pairwise_conditions(spark, sf_dir):
    return compare.pairwise(_paired(spark, sf_dir))


@query(S(PAIRS, "SELECT condition, center_frame, row_number() OVER (PARTITION BY condition ORDER BY center_frame) AS rank, round(err + 1e-9, 6) AS error FROM ix"))
def error_vectors(spark, sf_dir):
    """The error vectors of all conditions over their common centers, in long form."""
    got = compare.error_vector(_paired(spark, sf_dir))
    return got.select("condition", "center_frame", "rank", (F.col("error") + TIE).alias("error"))


def _errors(spark, sf_dir) -> DataFrame:
    captures = views.pairs(spark, sf_dir).select("condition", "center_frame", "capture")
    return _paired(spark, sf_dir).join(captures, ["condition", "center_frame"]).select("capture", F.col("condition").alias("length"), "error")


def _as_lengths(df: DataFrame) -> DataFrame:
    """The study's names of the three lengths, in their order."""
    return df.withColumn("length", F.element_at(F.create_map(*[F.lit(x) for pair in zip(views.LENGTHS, study.LENGTHS) for x in pair]), F.col("length")))


@query(S(PAIRS, "SELECT condition AS length, count(*) AS n, " + METRICS.format(e="err") + " FROM ix GROUP BY 1"))
def pooled_micro(spark, sf_dir):
    return study.pooled(_errors(spark, sf_dir))[0]


@query(S(PAIRS + PER, "SELECT length, round(avg(mae_bpm), 6) AS mae_mean, round(min(mae_bpm), 6) AS mae_min, round(max(mae_bpm), 6) AS mae_max, round(avg(rmse_bpm), 6) AS rmse_mean, round(avg(bias_bpm), 6) AS bias_mean FROM pc GROUP BY 1"))
def pooled_macro(spark, sf_dir):
    return study.pooled(_errors(spark, sf_dir))[2]


@query(S(PAIRS + PER + ", p AS (SELECT capture, max(mae_bpm) FILTER (WHERE length = '6h') AS a, max(mae_bpm) FILTER (WHERE length = '12h') AS b, max(mae_bpm) FILTER (WHERE length = '24h') AS c FROM pc GROUP BY 1)", """SELECT capture, round(a, 6) AS mae_20s, round(b, 6) AS mae_25s, round(c, 6) AS mae_30s,
CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'unavailable' WHEN a >= b AND b >= c THEN 'monotonic_improvement' WHEN a >= b OR b >= c THEN 'partial_improvement' ELSE 'no_improvement' END AS trend,
CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'n/a' WHEN a > b AND b > c THEN 'YES' WHEN a > c THEN 'PART' ELSE 'NO' END AS strict_trend FROM p"""))
def capture_trends(spark, sf_dir):
    return study.capture_trends(_as_lengths(study.pooled(_errors(spark, sf_dir))[1]))


@query(S(PAIRS + PER, "SELECT a.length, round(a.mae_bpm, 6) AS mae_0, round(a.rmse_bpm, 6) AS rmse_0, round(b.mae_bpm, 6) AS mae_1, round(b.rmse_bpm, 6) AS rmse_1, round(b.mae_bpm - a.mae_bpm, 6) AS mae_diff, round(b.rmse_bpm - a.rmse_bpm, 6) AS rmse_diff FROM pc a JOIN pc b USING (length) WHERE a.capture = 'cap0' AND b.capture = 'cap1'"))
def two_capture_summary(spark, sf_dir):
    return study.two_capture_summary(study.pooled(_errors(spark, sf_dir))[1], "cap0", "cap1")


@query(S(PAIRS + PER, "SELECT count(*) AS n_sessions, round(avg(mae_bpm), 6) AS mean_mae_bpm FROM pc WHERE length = '6h'"))
def mean_session_mae(spark, sf_dir):
    return study.mean_session_mae(study.pooled(_errors(spark, sf_dir))[1].where("length = '6h'"))


@query(S(PAIRS + PER, "SELECT length, CASE WHEN bool_and(mae_bpm <= 30) THEN 'STRONG PASS' WHEN bool_or(mae_bpm <= 30) THEN 'PASS' WHEN bool_and(mae_bpm <= 40) THEN 'MARGINAL' WHEN bool_or(mae_bpm <= 40) THEN 'MIXED' ELSE 'FAIL' END AS verdict FROM pc GROUP BY 1"))
def acceptance_verdict(spark, sf_dir):
    return study.verdict(study.pooled(_errors(spark, sf_dir))[1], "length", good=30.0, fair=40.0)


# -- respiration reports: a breathing rate per customer ---------------------------------------------------------------------

RATES = "ra AS (SELECT c_custkey, 0.1 + (c_custkey % 50) / 100.0 AS f_r_hz, 50 + c_custkey % 60 AS pr_bpm_mean, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), rk AS (SELECT *, greatest(1, least(CAST(floor((0.833 - 0.083) / f_r_hz) AS INTEGER), 6)) AS k_max FROM ra)"


def _rates(spark, sf_dir) -> DataFrame:
    c, n = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "nation")
    d = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    d = d.select("c_custkey", (F.lit(0.1) + (F.col("c_custkey") % 50) / 100.0).alias("f_r_hz"), (50 + F.col("c_custkey") % 60).alias("pr_bpm_mean"), "n_name")
    return d.withColumn("k_max", study.adaptive_k_max(F.col("f_r_hz")))


@query(S(RATES, "SELECT k_max, count(*) AS n FROM rk GROUP BY 1"))
def k_max_histogram(spark, sf_dir):
    return _rates(spark, sf_dir).groupBy("k_max").agg(F.count("*").alias("n"))


@query(S(RATES, "SELECT c_custkey, k, round(k * f_r_hz * 60, 6) AS harmonic_bpm, k * f_r_hz * 60 BETWEEN 50 AND 100 AS in_band, k <= k_max AS suppressed FROM rk, range(1, 9) t(k) WHERE k <= k_max + 2"))
def suppressed_harmonics(spark, sf_dir):
    return study.suppressed_harmonics(_rates(spark, sf_dir)).select("c_custkey", "k", "harmonic_bpm", "in_band", "suppressed")


@query(S(RATES, "SELECT n_name, CAST(k AS INTEGER) AS k, count(*) AS n, count(*) FILTER (WHERE k * f_r_hz * 60 BETWEEN 50 AND 100) AS n_in_band, count(*) FILTER (WHERE abs(k * f_r_hz * 60 - pr_bpm_mean) < 5) AS n_near_reference FROM ra, range(2, 7) t(k) GROUP BY 1, 2"))
def harmonic_intruders(spark, sf_dir):
    return study.harmonic_intruders(_rates(spark, sf_dir), "n_name")


@query(S(RATES + ", h AS (SELECT n_name, k, count(*) AS n, count(*) FILTER (WHERE k * f_r_hz * 60 BETWEEN 50 AND 100) AS b FROM ra, range(2, 7) t(k) GROUP BY 1, 2)", "SELECT n_name, CAST(min(k) FILTER (WHERE b > 0.5 * n) AS INTEGER) AS primary_k FROM h GROUP BY 1"))
def primary_intruder(spark, sf_dir):
    return study.primary_intruder(study.harmonic_intruders(_rates(spark, sf_dir), "n_name"), "n_name")


@query(S(RATES, "SELECT n_name, count(*) AS n, round(avg(f_r_hz), 6) AS f_r_mean, round(stddev_pop(f_r_hz), 6) AS f_r_std, round(min(f_r_hz), 6) AS f_r_min, round(max(f_r_hz), 6) AS f_r_max FROM ra GROUP BY 1"))
def respiration_track(spark, sf_dir):
    return study.respiration_track(_rates(spark, sf_dir), "n_name")


# -- ordered series -------------------------------------------------------------------------------------------------------


@query(S(UNWRAP, "SELECT session_id, frame_idx, round(unwrapped, 6) AS unwrapped FROM uw"))
def phase_unwrap(spark, sf_dir):
    return series.unwrap(views.phasors(spark, sf_dir), "angle", "unwrapped", ["session_id"], "frame_idx").select("session_id", "frame_idx", "unwrapped")


@query(S(UNWRAP + ", s AS (SELECT *, coalesce(unwrapped - lag(unwrapped) OVER (PARTITION BY session_id ORDER BY frame_idx), 0.0) AS d FROM uw)", "SELECT session_id, frame_idx, round(sum(greatest(-1.5, least(1.5, d))) OVER (PARTITION BY session_id ORDER BY frame_idx), 6) AS phase FROM s"))
def phase_impulse_clip(spark, sf_dir):
    u = series.unwrap(views.phasors(spark, sf_dir), "angle", "unwrapped", ["session_id"], "frame_idx")
    return series.impulse_clip(u, "unwrapped", "phase", ["session_id"], "frame_idx").select("session_id", "frame_idx", "phase")


@query(S(PHASOR + ", l AS (SELECT session_id, frame_idx, re, im, lag(re) OVER w AS r, lag(im) OVER w AS i FROM ph WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx))", "SELECT session_id, frame_idx, round(coalesce(atan2(im * r - re * i, re * r + im * i), 0.0), 6) AS delta FROM l"))
def phase_delta(spark, sf_dir):
    return series.phase_delta(views.phasors(spark, sf_dir), "re", "im", "delta", ["session_id"], "frame_idx").select("session_id", "frame_idx", "delta")


@query(S(SAMPLES + ", l AS (SELECT session_id, frame_idx, re, im, lag(re) OVER w AS r, lag(im) OVER w AS i FROM sm WINDOW w AS (PARTITION BY session_id, a, s ORDER BY frame_idx))", "SELECT session_id, frame_idx, round(coalesce(atan2(sum(im * r - re * i), sum(re * r + im * i)), 0.0), 6) AS delta FROM l GROUP BY ALL"))
def phase_delta_before_mean(spark, sf_dir):
    return series.phase_delta_before_mean(views.phasors(spark, sf_dir), "res", "ims", "delta", ["session_id"], "frame_idx").select("session_id", "frame_idx", "delta")


@query(S(MASK, "SELECT sb.session_id, sb.frame_idx, round(roll, 6) AS roll FROM sb JOIN rm USING (session_id, frame_idx)"))
def rolling_median_reflect(spark, sf_dir):
    f = views.features(spark, sf_dir).withColumn("e", F.get("bin_energy", F.lit(2)))
    return series.rolling_median(f, "e", "roll", ["session_id"], "frame_idx", 3).select("session_id", "frame_idx", "roll")


# -- frames, spectra and quality --------------------------------------------------------------------------------------------


@query(S(SAMPLES, "SELECT session_id, bin_idx, round(avg(energy), 6) AS energy FROM be GROUP BY ALL"))
def mean_range_energy(spark, sf_dir):
    return vitals.mean_range_energy(views.features(spark, sf_dir)).withColumn("bin_idx", F.col("bin_idx").cast("long"))


GATE = SAMPLES + ", mb AS (SELECT session_id, bin_idx, avg(energy) AS energy FROM be GROUP BY ALL)"


@query(S(GATE, "SELECT session_id, bin_idx, CAST(bin_idx * 0.25 AS DOUBLE) AS range_m, round(energy, 6) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY energy DESC, bin_idx) AS k FROM mb WHERE bin_idx * 0.25 BETWEEN 0.5 AND 1.5) WHERE k = 1"))
def select_range_bin(spark, sf_dir):
    bins = vitals.mean_range_energy(views.features(spark, sf_dir))
    return vitals.select_bin(vitals.in_gate(bins, 0.25, (F.lit(0.5), F.lit(1.5)))).withColumn("bin_idx", F.col("bin_idx").cast("long"))


@query(S(GATE, "SELECT session_id, CAST(k AS INTEGER) AS rank, bin_idx, round(energy, 6) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY energy DESC, bin_idx) AS k FROM mb WHERE bin_idx > 0) WHERE k <= 5"))
def top_range_bins(spark, sf_dir):
    return vitals.top_bins(vitals.mean_range_energy(views.features(spark, sf_dir))).select("session_id", "rank", F.col("bin_idx").cast("long").alias("bin_idx"), "energy")


@query(S(SAMPLES, "SELECT session_id, frame_idx, bin_idx, round(20 * log10(sqrt(mr * mr + mi * mi) + 1e-10), 6) AS db FROM be WHERE bin_idx < 4"))
def range_profile_db(spark, sf_dir):
    f = vitals.range_profile_db(views.features(spark, sf_dir), views.GEOMETRY, 10.0)
    return f.select("session_id", "frame_idx", F.col("bin_idx").cast("long").alias("bin_idx"), "db")


@query(S(MASK, "SELECT session_id, frame_idx, clip_flagged, dead_flagged, round(rx_energy_ratio, 6) AS rx_energy_ratio, rx_imbalance_flagged, round(subject_bin_energy, 6) AS subject_bin_energy, motion_spike_flagged, subject_bin_dropout_flagged, round(subject_bin_snr, 6) AS subject_bin_snr, snr_flagged, round(phase_delta, 6) AS phase_delta, phase_jump_flagged, quality_mask FROM qq"))
def frame_quality_mask(spark, sf_dir):
    keep = ["session_id", "frame_idx", "clip_flagged", "dead_flagged", "rx_energy_ratio", "rx_imbalance_flagged", "subject_bin_energy", "motion_spike_flagged", "subject_bin_dropout_flagged", "subject_bin_snr", "snr_flagged", "phase_delta", "phase_jump_flagged", "quality_mask"]
    return quality.quality_mask(views.features(spark, sf_dir), CHECKS).select(*keep)


FLAGS = ["motion_spike_flagged", "snr_flagged", "subject_bin_dropout_flagged", "phase_jump_flagged"]


@query(S(MASK, "SELECT session_id, count(*) AS n_frames, count(*) FILTER (WHERE NOT quality_mask) AS n_flagged, round(100.0 * count(*) FILTER (WHERE NOT quality_mask) / count(*), 6) AS pct_flagged, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{c}" for c in ["clip_flagged", "dead_flagged", "rx_imbalance_flagged", "motion_spike_flagged", "subject_bin_dropout_flagged", "snr_flagged", "phase_jump_flagged"]) + " FROM qq GROUP BY 1"))
def quality_mask_stats(spark, sf_dir):
    return quality.mask_stats(quality.quality_mask(views.features(spark, sf_dir), CHECKS))


@query(S(MASK, "SELECT session_id, motion, both_flags, motion_only, any_of FROM (SELECT session_id, count(*) FILTER (WHERE motion_spike_flagged) AS motion, count(*) FILTER (WHERE motion_spike_flagged AND phase_jump_flagged) AS both_flags, count(*) FILTER (WHERE motion_spike_flagged AND NOT (snr_flagged OR subject_bin_dropout_flagged OR phase_jump_flagged)) AS motion_only, count(*) FILTER (WHERE motion_spike_flagged OR snr_flagged OR subject_bin_dropout_flagged OR phase_jump_flagged) AS any_of FROM qq GROUP BY 1)"))
def soft_flag_overlaps(spark, sf_dir):
    o = quality.flag_overlaps(quality.quality_mask(views.features(spark, sf_dir), CHECKS), FLAGS)
    return o.select("session_id", F.col("motion_spike_flagged").alias("motion"), F.col("motion_spike_flagged_and_phase_jump_flagged").alias("both_flags"), F.col("motion_spike_flagged_only").alias("motion_only"), F.col("any").alias("any_of"))


@query(S(MASK, "SELECT session_id, " + ", ".join(f"round(quantile_cont(phase_delta, {q}), 6) AS {n}" for q, n in ((0.0, "min"), (0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (1.0, "max"))) + ", round(avg(phase_delta), 6) AS mean FROM qq GROUP BY 1"))
def phase_delta_summary(spark, sf_dir):
    return quality.phase_summary(quality.quality_mask(views.features(spark, sf_dir), CHECKS))


ISLANDS = MASK + ", il AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY session_id, quality_mask ORDER BY frame_idx) AS g FROM qq), ru AS (SELECT session_id, quality_mask, min(frame_idx) AS a, max(frame_idx) AS b, count(*) AS n FROM il GROUP BY session_id, quality_mask, g)"


@query(S(ISLANDS, "SELECT session_id, coalesce(max(n) FILTER (WHERE quality_mask), 0) AS longest_true, coalesce(max(n) FILTER (WHERE NOT quality_mask), 0) AS longest_false FROM ru GROUP BY 1"))
def longest_runs(spark, sf_dir):
    return series.longest_runs(quality.quality_mask(views.features(spark, sf_dir), CHECKS), "quality_mask", ["session_id"], "frame_idx")


@query(S(ISLANDS, "SELECT session_id, a / 20.0 AS t_start, (b + 1) / 20.0 AS t_end, n AS length FROM ru WHERE NOT quality_mask"))
def flagged_spans(spark, sf_dir):
    q = quality.quality_mask(views.features(spark, sf_dir), CHECKS).withColumn("bad", ~F.col("quality_mask"))
    return quality.flagged_spans(q, "bad", 20.0)


def _days(spark, sf_dir) -> DataFrame:
    h = views.hourly(spark, sf_dir)
    x = F.transform(F.array_sort(F.collect_list(F.struct("hour", "v"))), lambda s: s["v"])
    return h.groupBy(F.expr("hour div 24").alias("day")).agg(x.alias("x")).withColumn("s", spectral.amplitude_spectrum(F.col("x"), 24))


@query(S(HOURLY, "SELECT day, k, round(m, 6) AS m FROM sp"))
def amplitude_spectrum(spark, sf_dir):
    return _days(spark, sf_dir).select("day", F.posexplode("s").alias("k", "m")).withColumn("k", F.col("k").cast("long"))


PEAK = HOURLY + """, tp AS (SELECT day, arg_max(k, (m, -k)) AS i FROM sp WHERE k BETWEEN 2 AND 10 GROUP BY 1),
nb AS (SELECT tp.day, i, max(m) FILTER (WHERE k = i - 1) AS a, max(m) FILTER (WHERE k = i) AS b, max(m) FILTER (WHERE k = i + 1) AS c, median(m) FILTER (WHERE k BETWEEN 2 AND 10) AS f FROM tp JOIN sp USING (day) GROUP BY ALL)"""


@query(S(PEAK, "SELECT day, i AS peak_bin, round(i / 24.0 + CASE WHEN abs(0.5 * (a - c) / (a - 2 * b + c)) <= 1 THEN 0.5 * (a - c) / (a - 2 * b + c) / 24.0 ELSE 0 END, 6) AS peak_index_form, round(i / 24.0 + 0.5 * (a - c) / (a - 2 * b + c) / 24.0, 6) AS peak_freqs_form, round(b / f, 6) AS peak_to_floor, round(20 * log10(b / f), 6) AS peak_to_floor_db FROM nb"))
def spectral_peaks(spark, sf_dir):
    d = _days(spark, sf_dir).withColumn("i", (F.lit(2) + spectral.argmax(F.slice("s", 3, 9))).cast("int"))
    freqs = F.array(*[F.lit(k / 24.0) for k in range(13)])
    part = F.array_sort(F.slice("s", 3, 9))
    ratio, db = spectral.peak_to_floor(F.get("s", F.col("i")), F.get(part, F.lit(4)))
    return d.select("day", F.col("i").cast("long").alias("peak_bin"), spectral.refine_by_index(F.col("s"), F.col("i"), F.lit(1 / 24.0)).alias("peak_index_form"), spectral.refine_by_frequency(F.col("s"), freqs, F.col("i")).alias("peak_freqs_form"), ratio.alias("peak_to_floor"), db.alias("peak_to_floor_db"))


# -- captures, sessions and the archive ---------------------------------------------------------------------------------------


HANNED = FRAMES + """, sm AS (SELECT session_id, frame_idx, i // 8 AS a, i % 8 AS s, re[i + 1] * (0.5 - 0.5 * cos(2 * pi() * (i % 8) / 7)) AS re, im[i + 1] * (0.5 - 0.5 * cos(2 * pi() * (i % 8) / 7)) AS im FROM fr, range(0, 32) t(i) WHERE frame_idx >= 2),
zz AS (SELECT session_id, frame_idx, a, k, sum(re * cos(2 * pi() * k * s / 8) + im * sin(2 * pi() * k * s / 8)) AS zr, sum(im * cos(2 * pi() * k * s / 8) - re * sin(2 * pi() * k * s / 8)) AS zi FROM sm, range(0, 8) u(k) GROUP BY ALL)"""


@query(S(HANNED, "SELECT session_id, frame_idx, k AS bin_idx, round(avg(zr * zr + zi * zi) + 1e-9, 6) AS energy, round(avg(zr) + 1e-9, 6) AS mean_re, round(avg(zi) + 1e-9, 6) AS mean_im FROM zz GROUP BY ALL"))
def captured_range_features(spark, sf_dir):
    """Windowed range features of captures that were written as split files and read by ranges, without the trimmed frames."""
    f = vitals.range_features(views.captured(spark, sf_dir), views.GEOMETRY)
    rows = f.select("session_id", "frame_idx", F.posexplode(F.arrays_zip("bin_energy", "mean_re", "mean_im")).alias("bin_idx", "z"))
    return rows.select("session_id", "frame_idx", F.col("bin_idx").cast("long").alias("bin_idx"), (F.col("z.bin_energy") / views.UNIT**2 + TIE).alias("energy"), *[(F.col(f"z.{c}") / views.UNIT + TIE).alias(c) for c in ("mean_re", "mean_im")])


REAL = FRAMES + """, sm AS (SELECT session_id, frame_idx, i // 8 AS a, i % 8 AS s, re[i + 1] AS re FROM fr, range(0, 32) t(i)),
zz AS (SELECT session_id, frame_idx, a, k, sum(re * cos(2 * pi() * k * s / 8)) AS zr, sum(re * sin(2 * pi() * k * s / 8)) AS zi FROM sm, range(0, 5) u(k) GROUP BY ALL)"""


@query(S(REAL, "SELECT session_id, frame_idx, k AS bin_idx, round(avg(zr * zr + zi * zi) + 1e-9, 6) AS energy FROM zz GROUP BY ALL"))
def real_range_energy(spark, sf_dir):
    """Range energies of captures without a quadrature part: half of the bins and one."""
    f = vitals.range_features(views.raw_frames(spark, sf_dir), views.GEOMETRY, windowed=False, real=True)
    return f.select("session_id", "frame_idx", F.posexplode("bin_energy").alias("bin_idx", "e")).select("session_id", "frame_idx", F.col("bin_idx").cast("long").alias("bin_idx"), (F.col("e") / views.UNIT**2 + TIE).alias("energy"))


@query(S(SAMPLES + ", sb AS (SELECT session_id, bin_idx, avg(energy) AS energy FROM be WHERE frame_idx >= 1 AND frame_idx < 101 AND bin_idx < 4 GROUP BY ALL)", """
SELECT session_id, string_agg(CAST(bin_idx AS VARCHAR), ',' ORDER BY energy DESC, bin_idx) FILTER (WHERE bin_idx > 0) AS top_bins, CAST(arg_min(bin_idx, (-energy, bin_idx)) FILTER (WHERE bin_idx BETWEEN 2 AND 3) AS INTEGER) AS gate_bin,
round(0.25 * arg_min(bin_idx, (-energy, bin_idx)) FILTER (WHERE bin_idx BETWEEN 2 AND 3), 6) AS gate_range_m, abs(0.25 * arg_min(bin_idx, (-energy, bin_idx)) FILTER (WHERE bin_idx BETWEEN 2 AND 3) - 0.5) <= 0.2 AS plausible FROM sb GROUP BY 1"""))
def decode_sanity(spark, sf_dir):
    """Strongest bins of each session's first frames, the gate's peak, and whether it lies where the subject sat."""
    from ..sources import adc

    got = adc.sanity_report(views.features(spark, sf_dir), 0.25, trim=1, frames=100, gate=(2, 3), expected_m=0.5, tolerance_m=0.2)
    return got.withColumn("top_bins", F.array_join(F.col("top_bins").cast("array<string>"), ","))


MANIFEST = FRAMES + """, ma AS (SELECT CAST(n_nationkey AS VARCHAR) AS session_id, CASE n_regionkey WHEN 0 THEN '2' WHEN 1 THEN '99' WHEN 2 THEN '2.5' WHEN 4 THEN '1.0' END AS locked, CASE WHEN n_nationkey = 7 THEN 1000000 ELSE n_nationkey % 3 END AS trim FROM nation),
st AS (SELECT ma.*, n FROM ma LEFT JOIN (SELECT session_id, max(frame_idx) AS n FROM fr GROUP BY 1) USING (session_id)),
ok AS (SELECT *, CASE locked WHEN '2' THEN '2' WHEN '1.0' THEN '1' END AS bin, CASE WHEN locked IS NULL THEN 'no locked bin' WHEN locked = '99' THEN 'locked bin 99 is out of range' WHEN locked = '2.5' THEN 'locked bin is no whole number: 2.5' END AS reason FROM st WHERE trim <= n)"""
SESSION_CHECKS = {"motion_spike": {"enabled": True, "factor": 1.6, "half_window": 3}, "subject_bin_dropout": {"bin": 3, "fraction": 0.5, "half_window": 3}, "snr": {"guard": 1, "min_snr": 0.8}}


@query(S(MANIFEST, "SELECT session_id, CASE WHEN n IS NULL THEN 'no frames' ELSE 'trim of 1000000 frames leaves none' END AS error FROM st WHERE n IS NULL OR trim > n"))
def session_failures(spark, sf_dir):
    """Sessions of a manifest that can't be masked, and why; they keep no other from its mask."""
    return quality.all_sessions(views.features(spark, sf_dir), views.manifest(spark, sf_dir), SESSION_CHECKS)[2]


@query(S(MANIFEST, """SELECT session_id, name, value FROM (SELECT session_id, unnest([
  {'name': 'motion_spike_enabled', 'value': 'True'}, {'name': 'motion_spike_factor', 'value': '1.6'}, {'name': 'motion_spike_half_window', 'value': '3'}, {'name': 'subject_bin_dropout_fraction', 'value': '0.5'}, {'name': 'subject_bin_dropout_half_window', 'value': '3'},
  {'name': 'snr_guard', 'value': '1'}, {'name': 'snr_min_snr', 'value': '0.8'}, {'name': 'trim_frames', 'value': CAST(trim AS VARCHAR)},
  {'name': 'motion_spike_bin', 'value': bin}, {'name': 'motion_spike_skip_reason', 'value': reason}, {'name': 'motion_spike_skipped', 'value': CAST(bin IS NULL AS VARCHAR)}, {'name': 'snr_bin', 'value': bin}, {'name': 'snr_skip_reason', 'value': reason}, {'name': 'snr_skipped', 'value': CAST(bin IS NULL AS VARCHAR)},
  {'name': 'subject_bin_dropout_bin', 'value': CASE WHEN bin IS NULL THEN '3' END}, {'name': 'subject_bin_dropout_skipped', 'value': 'false'}, {'name': 'subject_bin_dropout_energy_source', 'value': CASE WHEN bin IS NULL THEN 'computed_fallback' ELSE 'reused_subject_bin_energy' END}], recursive := true) FROM ok) WHERE value IS NOT NULL"""))
def session_attributes(spark, sf_dir):
    """Settings and resolved bins of every session and check: a spike check's energy serves the dropout check, whose own bin counts only without it."""
    return quality.all_sessions(views.features(spark, sf_dir), views.manifest(spark, sf_dir), SESSION_CHECKS)[1]


BROKEN = {1: ("end_epoch", "end_epoch + 1"), 2: ("frame_rate_hz", "double('NaN')"), 3: ("resp_peak_raw_index", "-1"), 4: ("heart_spectrum", "slice(heart_spectrum, 1, 3)"), 5: ("candidate_passed", "slice(candidate_passed, 1, 2)")}


@query(S(EVENTS + ", wn AS (SELECT session_id, unnest(range(0, (hh - 100) // 60 + 1)) AS i FROM (SELECT DISTINCT event_type AS session_id FROM ev), sn)", """SELECT session_id, CAST(i AS INTEGER) AS window_index, rule FROM wn
JOIN (VALUES (1, 'duration'), (2, 'rate'), (3, 'peak_index'), (4, 'spectrum_length'), (5, 'candidates')) b(k, rule) ON i % 7 = k"""))
def archive_violations(spark, sf_dir):
    """Broken rules of an archive of windows in which five of seven were spoilt, each in its own way."""
    grid = views.hourly_windows(spark, sf_dir, 80, 60, 20)
    timed = windows.with_epochs(grid, F.lit(1000.0), 20.0).withColumn("frame_rate_hz", F.lit(20.0))
    whole = vitals.estimate_windows(timed, 20.0)
    for k, (column, text) in BROKEN.items():
        whole = whole.withColumn(column, F.when(F.col("window_index") % 7 == k, F.expr(text)).otherwise(F.col(column)))
    return evidence.violations(whole, 1 << 30).drop("message")


# -- files written and read back --------------------------------------------------------------------------------------------


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


MONITOR = EVENTS + ", mo AS (SELECT epoch_utc, value AS pr, CASE WHEN k % 7 <> 0 THEN 90 + k / 10 END AS spo2, k / 50 AS pi, value / 4 AS rr FROM ev)"


@query(S(MONITOR, "SELECT epoch_utc, " + ", ".join(f"round({EVEN(f'avg({c})')}, 6) AS {n}" for c, n in (("spo2", "spo2"), ("pr", "pr_bpm"), ("pi", "pi"), ("rr", "rr_bpm"))) + " FROM mo GROUP BY 1"))
def monitor_csv(spark, sf_dir):
    """The stream written as the monitor's export, with dashes where it has no value, and loaded again: coerced, merged, renamed."""
    e, path = views.events(spark, sf_dir), _new_folder(spark, "monitor")
    text = {"Session": F.col("user_id"), "Index": F.col("event_id"), "Timestamp": F.col("epoch_utc"), "O2 Saturation": F.when(F.col("k") % 7 != 0, (90 + F.col("k") / 10).cast("string")).otherwise("--"), "Beats / min": F.col("value"), "Perfusion Index": F.col("k") / 50, "Pleth Variability": F.lit("--"), "Breaths / min": F.col("value") / 4}
    e.select(*[c.cast("string").alias(n) for n, c in text.items()]).write.option("header", True).csv(path)
    return tables.reference_csv(spark, path)[0].select("epoch_utc", "spo2", "pr_bpm", "pi", "rr_bpm")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS session_id, round(s_suppkey % 300 / 100.0, 6) AS distance_m, CASE s_suppkey % 5 WHEN 0 THEN 12 WHEN 1 THEN 7 END AS locked_bin, CAST(s_suppkey % 40 AS INTEGER) AS trim_s, CAST(s_suppkey % 40 + 60 AS INTEGER) AS end_s, 1700000000.5 + s_suppkey AS radar_start_epoch_seconds FROM supplier""")
def manifest_csv(spark, sf_dir):
    """A manifest written as CSV (suppliers as sessions) and loaded again: metres, whole bins or none, stationary seconds, start."""
    k, path = F.col("s_suppkey"), _new_folder(spark, "manifest")
    bins = F.when(k % 5 == 0, "12").when(k % 5 == 1, "7.0").when(k % 5 == 2, "7.5").when(k % 5 == 3, "none")
    text = {"session_id": k, "posture": F.lit("seated"), "distance_cm": k % 300, "radar_orientation": F.lit("front"), "radar_start_epoch_seconds": F.lit(1_700_000_000.5) + k, "stationary_intervals": F.concat_ws("-", (k % 40).cast("string"), (k % 40 + 60).cast("string")), "locked_bin": bins}
    views.table(spark, sf_dir, "supplier").select(*[c.cast("string").alias(n) for n, c in text.items()]).write.option("header", True).csv(path)
    return tables.manifest_csv(spark, path).select("session_id", "distance_m", "locked_bin", "trim_s", "end_s", "radar_start_epoch_seconds")


@query(S(ESTIMATES, "SELECT window_index, start_frame, round(hr_bpm + 1e-9, 6) AS hr_bpm, round(error_bpm + 1e-9, 6) AS error_bpm, low_quality, ahet_verified FROM es"))
def comparison_csv(spark, sf_dir):
    """The comparison of all windows written as CSV and read back with its types."""
    path = _new_folder(spark, "comparison")
    sinks.write_comparison(_estimates(spark, sf_dir).select("window_index", "start_frame", "hr_bpm", "error_bpm", "low_quality", "ahet_verified"), path)
    got = tables.comparison_csv(spark, path, "window_index int, start_frame bigint, hr_bpm double, error_bpm double, low_quality boolean, ahet_verified boolean")
    return got.withColumns({c: F.col(c) + TIE for c in ("hr_bpm", "error_bpm")})


@query(S(SAMPLES, "SELECT session_id, frame_idx, round(CASE WHEN CAST(session_id AS INTEGER) % 2 = 0 THEN 2 ELSE 1 END * frame_energy, 6) AS frame_energy, CASE WHEN CAST(session_id AS INTEGER) % 2 = 0 THEN 'second' ELSE 'first' END AS source FROM ft WHERE frame_idx >= 2"))
def stored_sessions(spark, sf_dir):
    """A store of all sessions, of which a second commit replaces every other one, frames and attributes together; read after the trim."""
    path = _new_folder(spark, "store")
    frames = written(views.features(spark, sf_dir).select("session_id", "frame_idx", "frame_energy"), "frames")
    for label, some, factor in (("first", frames, 1.0), ("second", frames.where("cast(session_id AS int) % 2 = 0"), 2.0)):
        facts = some.select("session_id").distinct().select("session_id", F.lit("source").alias("name"), F.lit(label).alias("value"))
        store.write_store(some.withColumn("frame_energy", F.col("frame_energy") * factor), facts, path)
    facts = tables.read_attributes(spark, path).where("name = 'source'").select("session_id", F.col("value").alias("source"))
    return tables.read_frames(spark, path, 2).join(facts, "session_id").select("session_id", "frame_idx", "frame_energy", "source")


# -- kernels ----------------------------------------------------------------------------------------------------------------


# windows of 300 (or other) samples of each event type's hourly signal, less their mean
SIGNAL = lambda n=300: EVENTS + f""", hz AS (SELECT t.event_type AS session_id, h AS hour, coalesce(sum(value), 0.0) / 1000 AS v FROM (SELECT DISTINCT event_type FROM ev) t CROSS JOIN (SELECT o, unnest(range(0, hh)) AS h FROM sn) LEFT JOIN ev ON ev.event_type = t.event_type AND (epoch_utc - o) // 3600 = h GROUP BY 1, 2),
wi AS (SELECT session_id, w AS window_index, list(v ORDER BY hour) AS p FROM hz, (SELECT unnest(range(0, (hh - {n + 20}) // 100 + 1)) AS w FROM sn) WHERE hour >= 20 + 100 * w AND hour < {n + 20} + 100 * w GROUP BY 1, 2),
xs AS (SELECT session_id, window_index, p, list_transform(p, lambda q: q - list_avg(p)) AS x FROM wi)"""  # noqa: E731


def band_sql(name: str, lo: float, hi: float, n: int = 300, fs: float = 20.0) -> str:
    """CTEs up to ``<name>(session_id, window_index, y)``: the filter as a recursion over samples, forward and backward; the coefficients
    are the kernel's (tests compare those with the design's response)."""
    b, a = dsp.band_coefficients(lo, hi, fs)
    z0, row = dsp.steady(lo, hi, fs), lambda v: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in v) + "]"
    run = lambda out, src: f""", {out}(session_id, window_index, e, t, ys, z) AS (
  SELECT session_id, window_index, e, 0, CAST([] AS DOUBLE[]), list_transform({row(z0)}, lambda q: q * e[1]) FROM {src}
  UNION ALL SELECT session_id, window_index, e, t + 1, list_append(ys, y), list_transform(range(1, 9), lambda i: (CASE WHEN i < 8 THEN z[i + 1] ELSE 0.0 END) + e[t + 1] * ({row(b)})[i + 1] - y * ({row(a)})[i + 1])
  FROM (SELECT *, {float(b[0])!r} * e[t + 1] + z[1] AS y FROM {out} WHERE t < len(e)))"""  # noqa: E731
    first = f", {name}0 AS (SELECT session_id, window_index, list_concat(list_transform(range(1, 28), lambda i: 2 * x[1] - x[29 - i]), x, list_transform(range(1, 28), lambda i: 2 * x[{n}] - x[{n} - i])) AS e FROM xs)"
    second = f", {name}2 AS (SELECT session_id, window_index, list_reverse(ys) AS e FROM {name}1 WHERE t = len(e))"
    return first + run(f"{name}1", f"{name}0") + second + run(f"{name}3", f"{name}2") + f", {name} AS (SELECT session_id, window_index, list_slice(list_reverse(ys), 28, {n + 27}) AS y FROM {name}3 WHERE t = len(e))"


def peak_sql(name: str, lo: float, hi: float, n: int = 300, fs: float = 20.0) -> str:
    """CTEs up to ``<name>_peak(session_id, window_index, hz, refined)`` of the filtered windows ``<name>``."""
    inside = [k for k in range(n // 2 + 1) if lo <= k * (1 / (n * (1 / fs))) <= hi]
    k0, k1, step = inside[0], inside[-1], fs / n
    return f""", {name}_s AS (SELECT session_id, window_index, k, sqrt(pow(sum(q * cos(2 * pi() * k * i / {n})), 2) + pow(sum(q * sin(2 * pi() * k * i / {n})), 2)) AS m FROM (SELECT session_id, window_index, i, y[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / {n - 1})) AS q FROM {name}, range(0, {n}) t(i)), range({max(k0 - 3, 0)}, {k1 + 4}) u(k) GROUP BY ALL),
{name}_i AS (SELECT session_id, window_index, arg_min(k, (-m, k)) AS i FROM {name}_s WHERE k BETWEEN {k0} AND {k1} GROUP BY ALL),
{name}_n AS (SELECT session_id, window_index, i, max(m) FILTER (WHERE k = i - 1) AS a, max(m) FILTER (WHERE k = i) AS b, max(m) FILTER (WHERE k = i + 1) AS c FROM {name}_i JOIN {name}_s USING (session_id, window_index) GROUP BY ALL),
{name}_h AS (SELECT session_id, window_index, {step!r} * (i + CASE WHEN i > {k0} AND i < {k1} AND a - 2 * b + c <> 0 AND abs(0.5 * (a - c) / (a - 2 * b + c)) <= 1 THEN 0.5 * (a - c) / (a - 2 * b + c) ELSE 0 END) AS hz FROM {name}_n),
{name}_peak AS (SELECT session_id, window_index, any_value(hz) AS hz, {step!r} * (any_value(j) + 0.5 * (max(m) FILTER (WHERE k = j - 1) - max(m) FILTER (WHERE k = j + 1)) / (max(m) FILTER (WHERE k = j - 1) - 2 * max(m) FILTER (WHERE k = j) + max(m) FILTER (WHERE k = j + 1))) AS refined
  FROM (SELECT *, CAST(round(hz / {step!r}) AS BIGINT) AS j FROM {name}_h) JOIN {name}_s USING (session_id, window_index) GROUP BY session_id, window_index)"""


@query("WITH RECURSIVE " + SIGNAL() + band_sql("br", *dsp.BREATH, fs=5.0) + band_sql("he", *dsp.HEART, fs=5.0) + peak_sql("br", *dsp.BREATH, fs=5.0) + peak_sql("he", *dsp.HEART, fs=5.0) + " SELECT session_id, CAST(window_index AS INTEGER) AS window_index, round(60 * br_peak.hz, 6) AS rr_bpm, round(br_peak.refined, 6) AS resp_peak_refined_hz, round(60 * he_peak.hz, 6) AS hr_bpm FROM br_peak JOIN he_peak USING (session_id, window_index)")
def plain_rates(spark, sf_dir):
    """Breathing and heart rates of all windows of all event types, read as a 5 Hz phase, without projecting harmonics out: filter,
    spectrum and refined peak."""
    got = vitals.estimate_windows(views.hourly_windows(spark, sf_dir), 5.0, use_eca=False)
    return got.select("session_id", "window_index", "rr_bpm", "resp_peak_refined_hz", "hr_bpm")


@query("WITH RECURSIVE " + SIGNAL(200) + band_sql("he", *dsp.HEART, n=200) + " SELECT session_id, CAST(window_index AS INTEGER) AS window_index, i, round(y[i + 1] + 1e-9, 6) AS y FROM he, range(0, 200) t(i)")
def band_passed(spark, sf_dir):
    """Windows filtered forward and backward to the heart's band, sample by sample."""
    got = vitals.band_passed(views.hourly_windows(spark, sf_dir, 200), 20.0, dsp.HEART)
    return got.select("session_id", "window_index", F.posexplode("filtered").alias("i", "y")).select("session_id", "window_index", F.col("i").cast("long").alias("i"), (F.col("y") + TIE).alias("y"))


# sines and cosines leave the signal one after the other, each made orthogonal to those before it; of the harmonics of 0.31 Hz, the fifth lies within 0.15 Hz of the guard
@query("WITH RECURSIVE " + SIGNAL(200) + """, g(session_id, window_index, r, cols) AS (
  SELECT session_id, window_index, p, list_transform(range(0, 10), lambda j: list_transform(range(0, 200), lambda t: CASE WHEN j % 2 = 0 THEN sin(2 * pi() * t / 20.0 * 0.31 * [1, 2, 3, 4, 6][j // 2 + 1]) ELSE cos(2 * pi() * t / 20.0 * 0.31 * [1, 2, 3, 4, 6][j // 2 + 1]) END)) FROM xs
  UNION ALL SELECT session_id, window_index, list_transform(range(1, 201), lambda i: r[i] - cols[1][i] * list_dot_product(cols[1], r) / list_dot_product(cols[1], cols[1])),
    list_transform(cols[2:], lambda o: list_transform(range(1, 201), lambda i: o[i] - cols[1][i] * list_dot_product(cols[1], o) / list_dot_product(cols[1], cols[1]))) FROM g WHERE len(cols) > 0)
SELECT session_id, CAST(window_index AS INTEGER) AS window_index, i, round(r[i + 1] + 1e-9, 6) AS r FROM g, range(0, 200) t(i) WHERE len(cols) = 0""")
def harmonics_removed(spark, sf_dir):
    """Windows without the harmonics of a breathing rate of 0.31 Hz, except the one that a candidate at 1.6 Hz guards."""
    got = vitals.without_harmonics(views.hourly_windows(spark, sf_dir, 200), 20.0, 0.31, 6, 1.6)
    return got.select("session_id", "window_index", F.posexplode("projected").alias("i", "r")).select("session_id", "window_index", F.col("i").cast("long").alias("i"), (F.col("r") + TIE).alias("r"))


# -- without SQL: the choice among candidates is tested with known tones and properties -----------------------------------------


@query()
def estimated_rates(spark, sf_dir):
    """Breathing and heart rates of sliding windows over each event type's hourly signal, read as a 20 Hz phase."""
    got = vitals.estimate_windows(views.hourly_windows(spark, sf_dir), 20.0)
    return got.select("session_id", "window_index", "start_frame", "end_frame", "rr_bpm", "hr_bpm", "heart_spectrum_stage", "ahet_verified", "harmonic_suspect", "f_r_outlier")


@query()
def manifest_lookup(spark, sf_dir):
    """Bins per session joined to the manifest (nations as sessions)."""
    n = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("session_id"), F.lit(None).cast("int").alias("locked_bin"), "n_name")
    bins = vitals.select_bin(vitals.in_gate(vitals.mean_range_energy(views.features(spark, sf_dir)), 0.25, (F.lit(0.5), F.lit(1.5))))
    return tables.updated_manifest(n, bins)


ORACLE_SQL["manifest_lookup"] = S(GATE, "SELECT CAST(n_nationkey AS VARCHAR) AS session_id, CAST(bin_idx AS INTEGER) AS locked_bin, n_name FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY energy DESC, bin_idx) AS k FROM mb WHERE bin_idx * 0.25 BETWEEN 0.5 AND 1.5) b ON b.session_id = CAST(n_nationkey AS VARCHAR) AND k = 1")
