"""Per-frame quality: a registry of detectors over frame features, the combined mask, and its statistics.

Input: one row per frame, ``(session_id, frame_idx)`` and the features a detector needs: ``max_abs_adc``, ``frame_energy``,
``rx_energy array``, ``bin_energy array`` (of the transform without window), ``phasor_re/phasor_im`` arrays. A further check
registers a function ``(frames, options) -> frames`` that adds ``<name>_flagged`` (true: bad).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import selection, series
from ..session import written

TINY = 1e-12
KEYS, ORDER = ["session_id"], "frame_idx"
HARD: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}
SOFT: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def hard(name: str):
    return lambda f: HARD.setdefault(name, f)


def soft(name: str):
    return lambda f: SOFT.setdefault(name, f)


@hard("clip")
def clipping(frames: DataFrame, options: dict) -> DataFrame:
    """The largest sample reaches full scale."""
    return frames.withColumn("clip_flagged", F.col("max_abs_adc") >= options.get("full_scale", 32767))


@hard("dead")
def dead(frames: DataFrame, options: dict) -> DataFrame:
    """Energy below a share of the session's median."""
    median = selection.percentiles(frames, "frame_energy", [0.5], KEYS, scan=True).select(*[F.col(k).alias(f"_s_{k}") for k in KEYS], F.get("percentiles", F.lit(0)).alias("_median"))
    rows = frames.join(median, F.col(KEYS[0]).eqNullSafe(F.col(f"_s_{KEYS[0]}")), "left").drop(f"_s_{KEYS[0]}")
    return rows.withColumn("dead_flagged", F.col("frame_energy") < F.col("_median") * options.get("fraction", 0.01)).drop("_median")


@soft("rx_imbalance")
def rx_imbalance(frames: DataFrame, options: dict) -> DataFrame:
    """Largest over smallest receiver energy; a receiver without energy gives infinity."""
    low, high = F.array_min("rx_energy"), F.array_max("rx_energy")
    ratio = F.when(low <= 0, F.lit(float("inf"))).otherwise(F.try_divide(high, low))
    return frames.withColumn("rx_energy_ratio", ratio).withColumn("rx_imbalance_flagged", F.col("rx_energy_ratio") > options.get("max_ratio", 10.0))


def _subject_bin(options: dict) -> Column:
    """The configured bin, or else the column that ``resolve_bins`` made for the check."""
    if options.get("bin") is None and "bin_column" not in options:
        raise ValueError("the check needs a bin")
    return F.lit(int(options["bin"])) if options.get("bin") is not None else F.col(options["bin_column"])


def _with_rolling(frames: DataFrame, half: int) -> DataFrame:
    """Energy of the subject's bin and its rolling median, shared by the detectors that need them."""
    name = f"rolling_energy_{half}"
    return frames if name in frames.columns else series.rolling_median(frames, "subject_bin_energy", name, KEYS, ORDER, half)


def _with_energy(frames: DataFrame, options: dict) -> DataFrame:
    return frames if "subject_bin_energy" in frames.columns else frames.withColumn("subject_bin_energy", F.get("bin_energy", _subject_bin(options)))


#: What ``energy_source`` can say.
REUSED, COMPUTED = "reused_subject_bin_energy", "computed_fallback"


def energy_source(checks: dict[str, dict]) -> str | None:
    """Where the dropout check's energy comes from: from the spike check, whatever bin the dropout check names itself, or, without that
    check, from its own bin."""
    if "subject_bin_dropout" not in checks:
        return None
    return REUSED if "motion_spike" in checks else COMPUTED


@soft("motion_spike")
def motion_spike(frames: DataFrame, options: dict) -> DataFrame:
    """Energy above ``factor`` times its rolling median."""
    factor, half = float(options.get("factor", 5.0)), int(options.get("half_window", 10))
    if factor <= 1 or half < 0:
        raise ValueError("motion_spike needs factor > 1 and half_window >= 0")
    frames = _with_rolling(_with_energy(frames, options), half)
    high = F.col("subject_bin_energy") > F.greatest(F.col(f"rolling_energy_{half}"), F.lit(TINY)) * factor
    # an energy that another check's bin gave says nothing about a session without a bin for this one
    return frames.withColumn("motion_spike_flagged", F.when(F.col(options["bin_column"]).isNotNull(), high) if "bin_column" in options else high)


@soft("subject_bin_dropout")
def dropout(frames: DataFrame, options: dict) -> DataFrame:
    """Energy below ``fraction`` of its rolling median, where that is above nothing."""
    fraction, half = float(options.get("fraction", 0.2)), int(options.get("half_window", 10))
    if not 0 < fraction < 1 or half < 0:
        raise ValueError("subject_bin_dropout needs 0 < fraction < 1 and half_window >= 0")
    frames = _with_rolling(_with_energy(frames, options), half)
    median = F.col(f"rolling_energy_{half}")
    return frames.withColumn("subject_bin_dropout_flagged", (median > TINY) & (F.col("subject_bin_energy") < median * fraction))


@soft("snr")
def subject_snr(frames: DataFrame, options: dict) -> DataFrame:
    """Subject's bin over the median of the background: all bins beyond ``guard`` of it, or all others if none is."""
    at, guard = _subject_bin(options), F.lit(int(options.get("guard", 2)))
    far = F.filter("bin_energy", lambda x, i: F.abs(i - at) > guard)
    rest = F.when(F.size(far) > 0, far).otherwise(F.filter("bin_energy", lambda x, i: i != at))
    ranked, n = F.array_sort(rest), F.size(rest)
    median = (F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2
    frames = frames.withColumn("subject_bin_snr", F.get("bin_energy", at) / F.greatest(median, F.lit(TINY)))
    return frames.withColumn("snr_flagged", F.col("subject_bin_snr") < float(options.get("min_snr", 3.0)))


@soft("phase_jump")
def phase_jump(frames: DataFrame, options: dict) -> DataFrame:
    """Step of the subject's phase above ``threshold_rad``; the mean comes before or after the step."""
    method = options.get("method", "mean_phasor")
    if method == "mean_phasor":
        mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / F.size(c)
        frames = frames.withColumn("_re", mean(F.col("phasor_re"))).withColumn("_im", mean(F.col("phasor_im")))
        frames = series.phase_delta(frames, "_re", "_im", "phase_delta", KEYS, ORDER).drop("_re", "_im")
    elif method == "delta_before_mean":
        frames = series.phase_delta_before_mean(frames, "phasor_re", "phasor_im", "phase_delta", KEYS, ORDER)
    else:
        raise ValueError(f"unknown method {method!r}")
    return frames.withColumn("phase_jump_flagged", F.abs("phase_delta") > float(options.get("threshold_rad", 1.5)))


def resolve_bin(options_bin: int | None, manifest_bin: float | str | None, n_bins: int) -> tuple[int | None, str | None]:
    """``(bin, reason to skip)``: a configured bin wins and must exist; one of the manifest may be missing or out of range."""
    if options_bin is not None:
        if not 0 <= options_bin < n_bins:
            raise ValueError(f"configured bin {options_bin} lies outside 0..{n_bins - 1}")
        return options_bin, None
    try:
        value = float(manifest_bin)
        whole = int(value) if value == int(value) else None
    except (TypeError, ValueError, OverflowError):
        whole = None
    if whole is None:
        return None, "no locked bin"
    return (whole, None) if 0 <= whole < n_bins else (None, f"locked bin {whole} is out of range")


#: Checks that look at the subject's bin; the phase check uses phasors of a bin that was chosen before.
BIN_CHECKS = ("motion_spike", "subject_bin_dropout", "snr")


def resolve_bins(sessions: DataFrame, checks: dict[str, dict]) -> DataFrame:
    """For ``sessions(session_id, n_bins, locked_bin)``, per check that needs a bin: ``<check>_bin``, ``<check>_skipped`` and
    ``<check>_skip_reason``. A configured bin wins and fails the job where it doesn't exist; one of the manifest may be missing,
    no whole number, or out of range, and then the check is skipped for that session. The dropout check reuses the spike check's energy where there is one; then it
    needs no bin, and ``subject_bin_dropout_energy_source`` says so."""
    locked = F.col("locked_bin").cast("string").try_cast("double")
    whole = F.when(~F.isnan(locked) & (locked == F.floor(locked)) & (F.abs(locked) < 1e9), locked.cast("int"))
    out = sessions
    for name in (n for n in BIN_CHECKS if n in checks):
        fixed = checks[name].get("bin")
        if fixed is not None:
            inside = (F.lit(int(fixed)) >= 0) & (F.lit(int(fixed)) < F.col("n_bins"))
            text = F.concat(F.lit(f"{name}: configured bin {int(fixed)} lies outside 0.."), (F.col("n_bins") - 1).cast("string"))
            use, reason = F.when(inside, F.lit(int(fixed))).when(~inside, F.raise_error(text).cast("int")), F.lit(None).cast("string")
        else:
            inside = (whole >= 0) & (whole < F.col("n_bins"))
            reason = F.when(F.col("locked_bin").isNull(), F.lit("no locked bin")).when(whole.isNull(), F.concat(F.lit("locked bin is no whole number: "), F.col("locked_bin").cast("string")))
            reason = reason.when(~inside, F.concat(F.lit("locked bin "), whole.cast("string"), F.lit(" is out of range")))
            use = F.when(inside, whole)
        reused = F.lit(False)
        if name == "subject_bin_dropout" and "motion_spike" in checks:
            # the spike check's energy serves, so this check needs no bin there; a bin of its own isn't looked at
            reused = ~F.col("motion_spike_skipped")
            use, reason = F.when(~reused, use), F.when(~reused, reason)
        out = out.withColumn(f"{name}_bin", use).withColumn(f"{name}_skip_reason", reason).withColumn(f"{name}_skipped", F.col(f"{name}_bin").isNull() & ~reused)
        if name == "subject_bin_dropout":
            out = out.withColumn(f"{name}_energy_source", F.when(reused, F.lit(REUSED)).when(~F.col(f"{name}_skipped"), F.lit(COMPUTED)))
    return out


def quality_mask(frames: DataFrame, checks: dict[str, dict]) -> DataFrame:
    """Adds every configured detector's columns and ``quality_mask`` (true: good). Hard checks always count; a soft check is
    computed when configured and counts when ``enabled``. A flag that could not be computed (a skipped check, a frame without
    the feature) is null and counts as good, as in a session without that check. Detectors look at a session's frames in several ways (its
    median, the frames around, the frame before), so the frames are written once first."""
    frames, bad = written(frames, "frames"), []
    for name, f in HARD.items():
        frames = f(frames, checks.get(name, {}))
        bad.append(F.col(f"{name}_flagged"))
    for name, f in SOFT.items():
        if name in checks:
            frames = f(frames, checks[name])
            if checks[name].get("enabled", False):
                bad.append(F.col(f"{name}_flagged"))
    flagged = F.coalesce(bad[0], F.lit(False))
    for c in bad[1:]:
        flagged = flagged | F.coalesce(c, F.lit(False))
    return frames.withColumn("quality_mask", ~flagged)


def all_sessions(features: DataFrame, manifest: DataFrame, checks: dict[str, dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quality of all sessions of ``manifest(session_id, locked_bin[, trim_frames])`` in one plan: ``(frames, attributes, failures)``.

    A session that can't be processed (no frames, a trim that leaves none, a repeated manifest row) is a row ``(session_id, error)`` of
    ``failures`` and keeps no other from its mask. ``attributes(session_id, name, value)`` has the settings, each check's bin, and why
    it was skipped."""
    trim = F.coalesce(F.col("trim_frames").cast("long"), F.lit(0)) if "trim_frames" in manifest.columns else F.lit(0).cast("long")
    wanted = manifest.groupBy("session_id").agg(F.count("*").alias("rows"), F.first("locked_bin").alias("locked_bin"), F.first(trim).alias("trim"))
    found = features.groupBy("session_id").agg(F.max("frame_idx").alias("last"), F.max(F.size("bin_energy")).alias("n_bins"))
    state = wanted.join(found, "session_id", "left")
    error = F.when(F.col("rows") > 1, "several rows in the manifest").when(F.col("last").isNull(), "no frames")
    error = error.when((F.col("trim") < 0) | (F.col("trim") > F.col("last")), F.concat(F.lit("trim of "), F.col("trim").cast("string"), F.lit(" frames leaves none")))
    state = state.withColumn("error", error)
    sound = resolve_bins(state.where("error IS NULL").drop("error"), checks)
    own = {n: {**o, "bin": None, "bin_column": f"{n}_bin"} if n in BIN_CHECKS else o for n, o in checks.items()}
    kept = features.join(sound.drop("rows", "locked_bin", "last", "n_bins"), "session_id").where(F.col("frame_idx") >= F.col("trim"))
    names = [n for n in BIN_CHECKS if n in checks]
    energies = [F.col(f"{n}_bin") for n in names if n != "snr"]
    if energies:
        kept = kept.withColumn("subject_bin_energy", F.get("bin_energy", F.coalesce(*energies)))
    masked = quality_mask(kept, own).drop("trim", *[f"{n}_{x}" for n in names for x in ("bin", "skipped", "skip_reason", "energy_source")])
    settings = [(f"{n}_{k}", str(v)) for n, o in checks.items() for k, v in o.items() if k != "bin"]
    pairs = [F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in settings]
    pairs += [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for n in names for c in (f"{n}_bin", f"{n}_skipped", f"{n}_skip_reason")]
    if "subject_bin_dropout" in checks:
        pairs.append(F.struct(F.lit("subject_bin_dropout_energy_source").alias("name"), F.col("subject_bin_dropout_energy_source").alias("value")))
    pairs.append(F.struct(F.lit("trim_frames").alias("name"), F.col("trim").cast("string").alias("value")))
    attributes = sound.select("session_id", F.explode(F.array(*pairs)).alias("x")).select("session_id", "x.name", "x.value").where("value IS NOT NULL")
    return masked, attributes, state.where("error IS NOT NULL").select("session_id", "error")


def mask_stats(frames: DataFrame) -> DataFrame:
    """Per session: frames, flagged, share, and the count of each check that ran."""
    flags = [c for c in frames.columns if c.endswith("_flagged")]
    n, bad = F.count("*"), F.count_if(~F.col("quality_mask"))
    return frames.groupBy(*KEYS).agg(n.alias("n_frames"), bad.alias("n_flagged"), (100.0 * bad / n).alias("pct_flagged"), *[F.count_if(F.col(c)).alias(f"n_{c}") for c in flags])


def flag_overlaps(frames: DataFrame, flags: list[str]) -> DataFrame:
    """Totals, exclusive counts, all intersections of two or more flags, and the union; no columns for fewer than two."""
    if len(flags) < 2:
        return frames.select(*KEYS).distinct()
    out = [F.count_if(F.col(f)).alias(f) for f in flags]
    for f in flags:
        alone = F.col(f)
        for g in flags:
            if g != f:
                alone = alone & ~F.col(g)
        out.append(F.count_if(alone).alias(f"{f}_only"))
    for k in range(2, len(flags) + 1):
        for some in combinations(flags, k):
            all_of = F.col(some[0])
            for f in some[1:]:
                all_of = all_of & F.col(f)
            out.append(F.count_if(all_of).alias("_and_".join(some)))
    any_of = F.col(flags[0])
    for f in flags[1:]:
        any_of = any_of | F.col(f)
    return frames.groupBy(*KEYS).agg(*out, F.count_if(any_of).alias("any"))


def phase_summary(frames: DataFrame, column: str = "phase_delta") -> DataFrame:
    """Order statistics and mean of the finite values; null without any."""
    v = F.when(~F.isnan(column) & (F.abs(column) < float("inf")), F.col(column))
    names = ("min", "p50", "p90", "p95", "p99", "max")
    rows = frames.select(*KEYS, v.alias("_v"))
    got = selection.percentiles(rows, "_v", [0.0, 0.5, 0.9, 0.95, 0.99, 1.0], KEYS).drop("n")
    return got.join(rows.groupBy(*KEYS).agg(F.avg("_v").alias("mean")), KEYS).select(*KEYS, *[F.get("percentiles", F.lit(i)).alias(n) for i, n in enumerate(names)], "mean")


def flagged_spans(frames: DataFrame, flag: str, frame_rate_hz: float) -> DataFrame:
    """Runs of flagged frames as times in seconds, the end exclusive."""
    r = series.runs(frames, flag, KEYS, ORDER).where(F.col(flag))
    return r.select(*KEYS, (F.col("first") / frame_rate_hz).alias("t_start"), ((F.col("last") + 1) / frame_rate_hz).alias("t_end"), "length")
