"""Exact order statistics of groups of any size: sketches bracket each wanted rank, counts below the bracket and its distinct values decide.

``percentile`` holds all distinct values of a group in one buffer. Here a group's sketch (of bounded size) gives, for each rank, two of
its values between which the rank's value must lie; one pass counts what lies below them and sends on only what lies between,
summed up by value: about ``4 / accuracy`` of a large group, spread by value. Running sums over these give the values at the ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: A sketch's ranks are off by ``n / ACCURACY`` at most.
ACCURACY = 10_000


def percentiles(df: DataFrame, column: str, fractions: list[float], keys: list[str], accuracy: int = ACCURACY, scan: bool = False) -> DataFrame:
    """``(keys, n, percentiles)``: per group the number of its values and the linearly interpolated percentiles, as ``percentile`` gives
    them: nulls don't count, NaN ranks above all numbers, -0 equals 0. A group without values has ``n`` 0 and nulls. Groups with
    null keys are kept. Keys and values are written once, as they are read twice; not where ``df`` is a ``scan`` of a table."""
    if any(not 0 <= f <= 1 for f in fractions) or not fractions:
        raise ValueError("fractions lie between 0 and 1")
    rows = df.select(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_")).alias("_k"), (F.col(column).cast("double") + 0.0).alias("_v"))
    if not scan:
        rows = written(rows, "values")
    # for the sketch, NaN lies with infinity; counts tell them apart later
    place, number = F.when(F.isnan("_v"), F.lit(float("inf"))).otherwise(F.col("_v")), F.when(~F.isnan("_v"), F.col("_v"))
    slack = 2.0 / accuracy
    ends = sorted({min(1.0, max(0.0, x)) for f in fractions for x in (f - slack, f + slack)})
    sketch = F.percentile_approx(place, F.array(*[F.lit(x) for x in ends]), F.lit(accuracy))
    groups = rows.groupBy("_k").agg(F.count("_v").alias("n"), F.count(number).alias("_numbers"), F.min(place).alias("_min"), F.max(place).alias("_max"), sketch.alias("_ends"))
    # per fraction: its two ranks, and its bracket (in a small group, everything)
    small = F.col("n") <= 4 * accuracy
    end = lambda x: F.get("_ends", F.lit(ends.index(min(1.0, max(0.0, x)))))
    wanted = []
    for i, f in enumerate(fractions):
        at = F.lit(float(f)) * (F.col("n") - 1)
        low = F.when(small | F.lit(f - slack <= 0), F.col("_min")).otherwise(end(f - slack))
        high = F.when(small | F.lit(f + slack >= 1), F.col("_max")).otherwise(end(f + slack))
        wanted.append(F.struct(F.lit(i).alias("i"), F.floor(at).alias("r0"), F.ceil(at).alias("r1"), (at - F.floor(at)).alias("part"), low.alias("low"), high.alias("high")))
    asked = groups.select("_k", "n", "_numbers", F.explode(F.array(*wanted)).alias("w")).select("_k", "n", "_numbers", "w.*")
    brackets = asked.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("_b"))
    met = rows.where("_v IS NOT NULL AND NOT isnan(_v)").join(brackets, "_k").select("_k", "_v", F.explode("_b").alias("b"))
    # what lies below a bracket becomes one row of its task, what lies in it a row per value
    kept = F.when(F.col("_v") < F.col("b.low"), F.lit(None)).otherwise(F.col("_v"))
    counted = met.where(F.col("_v") <= F.col("b.high")).groupBy("_k", F.col("b.i").alias("i"), kept.alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy("_k", "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("_upto", F.sum("_c").over(order))
    hit = lambda r: F.max(F.when((F.col("_upto") > F.col(r)) & (F.col("_upto") - F.col("_c") <= F.col(r)), F.col("_v")))
    found = upto.join(asked.select("_k", "i", "r0", "r1"), ["_k", "i"]).groupBy("_k", "i").agg(hit("r0").alias("v0"), hit("r1").alias("v1"))
    nan = F.lit(float("nan"))
    exact = asked.join(found, ["_k", "i"], "left")
    value = lambda r, v: F.when(F.col("n") == 0, F.lit(None)).when(F.col(r) >= F.col("_numbers"), nan).otherwise(F.coalesce(v, F.raise_error(F.lit("a sketch missed its rank")).cast("double")))
    v0, v1 = value("r0", F.col("v0")), value("r1", F.col("v1"))
    mixed = F.when((F.col("r0") == F.col("r1")) | (v0 == v1), v0).otherwise((1 - F.col("part")) * v0 + F.col("part") * v1)
    listed = exact.groupBy("_k").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", mixed.alias("q")))), lambda x: x["q"]).alias("percentiles"))
    return listed.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "n", "percentiles")
