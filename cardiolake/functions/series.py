"""Ordered-series operators; ``keys`` part the series, ``order`` (a whole number such as a frame index) orders each.

No task holds a series. Rows are packed into chunks of ``chunk`` steps of ``order``; each chunk is summed up in one small row (its first
and last values, the sum of its corrections, its border runs), a prefix over the chunk rows of a series gives what a chunk takes over from those before, and
that is joined back to the chunks. Sums that cross chunks are of whole turns or of decimals, so results don't depend on where chunks
are cut; ``chunk=None`` runs plain window functions over whole series, with equal results. Packed rows are shuffled once by (keys, chunk);
all further steps of a chunk reuse that partitioning.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PI = math.pi
#: Steps of ``order`` in a chunk.
CHUNK = 1024
#: Sums of steps across chunks: exact, whatever their order (sums are cast back, as a wider type would lose digits).
EXACT = "decimal(30,18)"


#: Chunk of rows without a place. A chunk is never null: else the join of chunks would filter one side, which then is computed twice.
_NOWHERE = -(1 << 62)


def _over(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def _packed(df: DataFrame, keys: list[str], order: str, chunk: int) -> DataFrame:
    """``(_k, _chunk, _rows)``: all rows of each chunk, in order, as one array; ``_k`` has the keys (so null keys are equal, too). Rows that
    still have their ``_k`` and ``_chunk`` from a step before are not shuffled again."""
    columns = [c for c in df.columns if c not in ("_k", "_chunk")]
    if "_chunk" not in df.columns:
        df = df.withColumn("_k", F.struct(*[F.col(f"`{k}`") for k in keys])).withColumn("_chunk", F.coalesce(F.floor(F.col(order) / F.lit(chunk)).cast("long"), F.lit(_NOWHERE)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))))
    return df.groupBy("_k", "_chunk").agg(F.transform(rows, lambda r: r["_row"]).alias("_rows"))


def _unpacked(packed: DataFrame, carry: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of chunks again, numbered in ``_at`` within their chunk, with the columns that the chunk takes over."""
    flat = packed.join(carry, ["_k", "_chunk"]).select("_k", "_chunk", *carried, F.posexplode("_rows").alias("_at", "_row"))
    return flat.select("_k", "_chunk", "_at", *carried, "_row.*")


def _steps(values: Column, f) -> Column:
    """``f(value, value before)`` of all elements but the first."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 2, n), F.slice(values, 1, n), f)


def _scan(df: DataFrame, keys: list[str], order: str, chunk: int | None, columns: list[str], step, kind: str | None) -> DataFrame:
    """The rows with the column ``_previous`` (a struct of ``columns`` of the row before, null at the start) and, for a ``kind``, the running sum in ``_sum`` of ``step(row, row before)``; null steps count as nothing."""
    own = F.struct(*[F.col(c) for c in columns])
    nothing = F.lit(0).cast(kind) if kind else None
    some = lambda x: F.coalesce(x.cast(kind), nothing)
    if chunk is None:
        w = _over(keys, order)
        rows = df.withColumn("_previous", F.lag(own).over(w))
        if kind is None:
            return rows
        rows = rows.withColumn("_step", some(step(own, F.col("_previous"))))
        return rows.withColumn("_sum", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
    packed = _packed(df, keys, order, chunk)
    values = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    inner = F.aggregate(_steps(values, lambda b, a: some(step(b, a))), nothing, lambda x, y: (x + y).cast(kind)) if kind else F.lit(0)
    carry = packed.select("_k", "_chunk", F.element_at(values, 1).alias("_first"), F.element_at(values, -1).alias("_last"), inner.alias("_inner"))
    w = _over(["_k"], "_chunk")
    carry, kept = carry.withColumn("_before", F.lag("_last").over(w)), ["_before"]
    if kind:
        # all before this chunk, and the step into it
        carry = carry.withColumn("_enter", some(step(F.col("_first"), F.col("_before"))))
        whole = F.sum(F.col("_inner") + F.col("_enter")).over(w.rowsBetween(Window.unboundedPreceding, -1))
        carry, kept = carry.withColumn("_offset", (F.coalesce(whole.cast(kind), nothing) + F.col("_enter")).cast(kind)), ["_before", "_offset"]
    rows = _unpacked(packed, carry.select("_k", "_chunk", *kept), kept)
    within = _over(["_k", "_chunk"], "_at")
    rows = rows.withColumn("_previous", F.when(F.col("_at") == 0, F.col("_before")).otherwise(F.lag(own).over(within)))
    if kind:
        moved = F.when(F.col("_at") == 0, nothing).otherwise(some(step(own, F.col("_previous"))))
        rows = rows.withColumn("_step", moved).withColumn("_sum", (F.sum("_step").over(within.rowsBetween(Window.unboundedPreceding, 0)).cast(kind) + F.col("_offset")).cast(kind)).drop("_step")
    return rows.drop("_at", *kept)


def plain(df: DataFrame) -> DataFrame:
    """Without the columns by which steps of one chunk find each other."""
    return df.drop("_k", "_chunk")


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


@F.arrow_udf(T.DoubleType())
def c_phase(re: pa.Array, im: pa.Array) -> pa.Array:
    """As ``phase``, by the C library, which SQL engines and numpy use. The JVM's angles are other doubles in the last bit for one phasor
    in six, and that bit decides whether the step between opposite phasors exceeds pi."""
    return pa.array([None if x is None or y is None else math.atan2(y, x) for x, y in zip(re.to_pylist(), im.to_pylist(), strict=True)], pa.float64())


def unwrap(df: DataFrame, column: str, out: str, keys: list[str], order: str, chunk: int | None = CHUNK, keep: bool = False) -> DataFrame:
    """Adds multiples of 2 pi wherever a step exceeds pi, by however little; steps of exactly pi stay, up and down. With ``keep``, a next
    step over the same series needs no shuffle; ``plain`` ends such a row of steps."""

    def turns(row: Column, before: Column) -> Column:
        step = row[column] - before[column]
        # the difference to pi is exact near pi, so a last bit beyond it is a turn
        over = F.ceil((F.abs(step) - PI) / (2 * PI))
        return F.when((F.abs(step) > PI) & ~F.isnan(step) & (F.abs(step) < float("inf")), F.when(step > 0, -over).otherwise(over))

    rows = _scan(df, keys, order, chunk, [column], turns, "long")
    rows = rows.withColumn(out, F.col(column) + 2 * PI * F.col("_sum")).drop("_previous", "_sum")
    return rows if keep else plain(rows)


def impulse_clip(df: DataFrame, column: str, out: str, keys: list[str], order: str, limit: float = 1.5, chunk: int | None = CHUNK) -> DataFrame:
    """Running sum of steps clipped to ``limit``; starts at 0."""
    clipped = lambda row, before: F.greatest(F.lit(-limit), F.least(row[column] - before[column], F.lit(limit)))
    only = lambda row, before: F.when((row[column] - before[column]).isNotNull(), clipped(row, before))
    rows = _scan(df, keys, order, chunk, [column], only, EXACT)
    return plain(rows.withColumn(out, F.col("_sum").cast("double")).drop("_previous", "_sum"))


def phase_delta(df: DataFrame, re: str, im: str, out: str, keys: list[str], order: str, chunk: int | None = CHUNK) -> DataFrame:
    """Angle of each phasor times the conjugate of the one before; 0 at the start."""
    rows = plain(_scan(df, keys, order, chunk, [re, im], None, None))
    r, i = F.col("_previous")[re], F.col("_previous")[im]
    angle = F.atan2(F.col(im) * r - F.col(re) * i, F.col(re) * r + F.col(im) * i)
    return rows.withColumn(out, F.coalesce(angle, F.lit(0.0))).drop("_previous")


def phase_delta_before_mean(df: DataFrame, re: str, im: str, out: str, keys: list[str], order: str, chunk: int | None = CHUNK) -> DataFrame:
    """As ``phase_delta`` over arrays of phasors: conjugate products per element, then the angle of their mean, so that
    static offsets between elements don't cancel."""
    rows = plain(_scan(df, keys, order, chunk, [re, im], None, None))
    rows = rows.withColumn("_r", F.col("_previous")[re]).withColumn("_i", F.col("_previous")[im])
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    product = lambda a, b: F.zip_with(F.col(a), F.col(b), lambda x, y: x * y)
    real = total(product(re, "_r")) + total(product(im, "_i"))
    imag = total(product(im, "_r")) - total(product(re, "_i"))
    return rows.withColumn(out, F.coalesce(F.atan2(imag, real), F.lit(0.0))).drop("_r", "_i", "_previous")


def ranked(df: DataFrame, keys: list[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``_place``, each row's place in its series from 0, and ``_n``, the number of its rows."""
    packed = _packed(df, keys, order, chunk)
    w = _over(["_k"], "_chunk")
    carry = packed.select("_k", "_chunk", F.size("_rows").cast("long").alias("_in"))
    carry = carry.withColumn("_start", F.coalesce(F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_in").over(Window.partitionBy("_k"))).drop("_in")
    return plain(_unpacked(packed, carry, ["_start", "_n"]).withColumn("_place", F.col("_start") + F.col("_at")).drop("_start", "_at"))


def rolling_median(df: DataFrame, column: str, out: str, keys: list[str], order: str, half: int, chunk: int = CHUNK) -> DataFrame:
    """Median over ``half`` rows on each side in the order of ``order``; the ends are mirrored, edge rows included.

    Rows are dealt by their place to blocks; a block also gets the values of ``half`` places beyond its borders, from its neighbours
    or, beyond the ends of the series, from the mirror. Only values are copied; each row itself goes to one block."""
    if half < 0:
        raise ValueError("half must not be negative")
    rows = ranked(df, keys, order, chunk)
    at, n = F.col("_place"), F.col("_n")
    # index rule of the mirror: place p holds row m, m = pmod(p, 2n), folded back beyond n - 1; h beyond an end repeats
    turns = F.expr(f"sequence(-({half} div (2 * _n)) - 1, ({half} div (2 * _n)) + 1)")
    places = F.flatten(F.transform(turns, lambda t: F.array(at + 2 * t * n, 2 * t * n - 1 - at)))
    near = F.filter(places, lambda p: (p >= -half) & (p < n + half))
    size = max(chunk, 2 * half + 1)
    block = lambda p: F.floor(p / F.lit(size)).cast("long")
    # the blocks that need the value at place p: from the one of p - half to the one of p + half, as far as there are such blocks
    wanted = lambda p: F.sequence(F.greatest(block(p - half), F.lit(0).cast("long")), F.least(block(p + half), block(n - 1)))
    copies = F.flatten(F.transform(near, lambda p: F.transform(wanted(p), lambda b: F.struct(p.alias("p"), b.alias("b")))))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    own = (F.col("_c.p") == at) & (F.col("_c.b") == block(at))
    sent = rows.withColumn("_c", F.explode(copies)).select(*keys, F.col("_c.p").alias("_p"), F.col("_c.b").alias("_b"), F.col(column).alias("_v"), F.when(own, whole).alias("_row"))
    frame = Window.partitionBy(*keys, "_b").orderBy("_p").rowsBetween(-half, half)
    got = sent.withColumn("_median", F.percentile("_v", F.lit(0.5)).over(frame)).where("_row IS NOT NULL")
    return got.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns], F.col("_median").alias(out))


def runs(df: DataFrame, flag: str, keys: list[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """Islands of equal flags: ``(keys, flag, first, last, length)``.

    Islands inside a chunk are final; a chunk's first and last ones are joined to their neighbours'. Joining is associative, so two rows
    a chunk are all that meets per series."""
    cut = df.select(*keys, F.col(order).alias("_o"), F.col(flag).alias("_f"), F.floor(F.col(order) / F.lit(chunk)).cast("long").alias("_chunk"))
    w, per = _over([*keys, "_chunk"], "_o"), Window.partitionBy(*keys, "_chunk", "_f").orderBy("_o")
    d = cut.withColumn("_g", F.row_number().over(w) - F.row_number().over(per))
    islands = d.groupBy(*keys, "_chunk", "_f", "_g").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count("*").alias("length"))
    ends = Window.partitionBy(*keys, "_chunk")
    islands = islands.withColumn("_opens", F.col("first") == F.min("first").over(ends)).withColumn("_closes", F.col("last") == F.max("last").over(ends))
    inner = islands.where("NOT _opens AND NOT _closes").select(*keys, F.col("_f").alias(flag), "first", "last", "length")
    border = islands.where("_opens OR _closes")
    s = _over(keys, "first")
    # an island that opens its chunk goes on the one before if that has the same flag
    begins = F.when(F.col("_opens") & F.lag("_f").over(s).eqNullSafe(F.col("_f")), 0).otherwise(1)
    joined = border.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(s.rowsBetween(Window.unboundedPreceding, 0)))
    outer = joined.groupBy(*keys, "_island").agg(F.first("_f").alias(flag), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"))
    return inner.union(outer.select(*keys, flag, "first", "last", "length"))


def longest_runs(df: DataFrame, flag: str, keys: list[str], order: str, chunk: int = CHUNK) -> DataFrame:
    r = runs(df, flag, keys, order, chunk)
    return r.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(flag), F.col("length"))), F.lit(0)).alias("longest_true"), F.coalesce(F.max(F.when(~F.col(flag), F.col("length"))), F.lit(0)).alias("longest_false"))
