"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Sizes are words. Sources, in code point order with null last, take the given weights in turn and share ``ratio`` times all
sizes; a target stops at ``epochs`` times its source's size and the excess is shared again by weight, in closed form: sources
sorted by cap per weight are capped until the common level fits.

Schedule: slot ``i`` takes the point ``frac(i * golden ratio)`` (32-bit integer arithmetic), which falls into one source's
interval of cumulated targets; slots are ranked per source, in chunks, so that no task ranks all slots of a hot source. Slot
``r`` of a source takes the ``r``-th block of equal size from the source's stream, which is its documents in the order of a
hash, ``epochs`` times over. A source stops at its target; blocks that the schedule left out (a few at most, since the points
are evenly spread) take slots of their own after the last one. Blocks meet documents by an equi-join on (source, block).
``scheduled_documents`` returns the interleaved order itself; ``mix_sources`` sums what it takes of each document.

Running sums over a hot source go through hash buckets of about ``bucket_docs`` documents: sums per bucket first, then within
each bucket. What meets in one task is one row per source, or per bucket of a source.

Defined cases: null text has size 0 and takes nothing; null sources form one source, the last; rows that repeat a document are
documents of their own; documents of size 0 take 0; a source without words has target 0; an empty table gives an empty
result; reruns give the same rows; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, join_wide, stash

GOLDEN = 2654435769  # 2^32 / golden ratio
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, epochs: int = 2) -> DataFrame:
    """``(source, rank, docs, source_size, weight, target)``, one row per source of ``sized(source, size)``."""
    per = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size").cast("double") * epochs).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(ratio))
    per = per.withColumn("share", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    fits = F.when(F.col("share") <= F.col("level"), F.struct("level", "rank", "share"))
    level = F.min(fits).over(Window.partitionBy())["share"]
    return per.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))).select("source", "rank", "docs", "source_size", "weight", "target")


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """``(src, r, slot)``: which source each slot takes, and the slot's rank among those of the source."""
    whole = F.sum("target").over(Window.partitionBy())
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.when(F.col("rank") == F.max("rank").over(Window.partitionBy()), F.lit(1 << 32)).otherwise(F.floor(F.coalesce(F.try_divide(F.sum("target").over(upto), whole), F.lit(0.0)) * (1 << 32)))
    spans = targets.withColumn("hi", hi.cast("long")).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("rank")), F.lit(0)))
    spans = spans.where("hi > lo").select(F.col("rank").alias("src"), "lo", "hi", F.explode(F.expr("sequence(lo div 1048576, (hi - 1) div 1048576)")).alias("cell"))
    low, high = F.col("id").bitwiseAND(65535), F.shiftright("id", 16).bitwiseAND(65535)
    point = (low * GOLDEN + (high * GOLDEN).bitwiseAND(65535) * 65536).bitwiseAND(4294967295)
    points = targets.sparkSession.range(slots).withColumn("x", point).withColumn("cell", F.expr("x div 1048576"))
    hits = points.join(spans, "cell").where("lo <= x AND x < hi").select("src", F.col("id").alias("slot"), F.shiftright("id", 12).alias("chunk"))
    counts = hits.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    return hits.withColumn("k", inner).join(base, ["src", "chunk"]).select("src", (F.col("base") + F.col("k")).alias("r"), "slot")


def _dealt(docs: DataFrame, weights: tuple[float, ...], ratio: float, epochs: int, slots: int, bucket_docs: int, seed: int, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The targets, and ``(src, bucket, pos, doc_id, key, size, source_size, target, r, slot, start, words)``: a row for each document,
    pass and block that share words, and one without a slot for a document that the mix doesn't reach."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = (F.col(key) if key else F.lit(None)).cast("long").alias("key")
    sized = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), own, "source", size.alias("size")), "sizes")
    targets = stash(source_targets(sized, weights, ratio, epochs), "targets")
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    block = max(16, math.ceil(total / slots))
    last = F.floor("target").cast("long")

    src = targets.select("source", F.col("rank").alias("src"), "source_size", "target", last.alias("stop"), (F.expr(f"docs div {bucket_docs}") + 1).alias("buckets"))
    rows = sized.join(src.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("buckets"))).drop("buckets")
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = Window.partitionBy("src", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    rows = rows.withColumn("pos", F.row_number().over(inner)).withColumn("at", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(sums, ["src", "bucket"]).withColumn("at", F.col("base") + F.col("at")).drop("base")

    # the blocks that a document lies in, once per pass over its source; documents that none can reach keep one row
    passes = [F.when((F.col("size") > 0) & (F.col("at") + p * F.col("source_size") < F.col("stop")), F.expr(f"transform(sequence((at + {p} * source_size) div {block}, least(at + {p} * source_size + size, stop) div {block}), r -> struct({p}L AS p, r AS r))")).otherwise(F.array().cast("array<struct<p:bigint,r:bigint>>")) for p in range(epochs)]
    none = F.array(F.struct(F.lit(0).cast("long").alias("p"), (-1 - F.pmod(F.xxhash64("doc_id"), F.lit(4096))).alias("r")))
    touched = F.concat(*passes)
    rows = rows.withColumn("in", F.explode(F.when(F.size(touched) > 0, touched).otherwise(none)))
    rows = rows.withColumn("r", F.col("in.r")).withColumn("from", F.col("at") + F.col("in.p") * F.col("source_size")).drop("in", "at")

    wanted = targets.select(F.col("rank").alias("src"), F.ceil(last / block).cast("long").alias("blocks"))
    ends = math.ceil(total / block)
    plan = schedule(targets, ends)
    used = plan.join(wanted, "src").where("r < blocks").select("src", "r", "slot")
    # blocks up to the target that the evenly spread points have left out, in turn
    given = plan.groupBy("src").agg(F.count("*").alias("n"))
    tail = wanted.join(given, "src", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks").select("src", "n", F.explode(F.expr("sequence(n, blocks - 1)")).alias("r"))
    tail = tail.select("src", "r", (F.row_number().over(Window.orderBy(F.col("r") - F.col("n"), "src")) + (ends - 1)).cast("long").alias("slot"))
    rows = rows.join(used.union(tail), ["src", "r"], "left")
    start = F.greatest(F.col("r") * block, F.col("from"))
    end = F.least((F.col("r") + 1) * block, F.col("stop"), F.col("from") + F.col("size"))
    words = F.when(F.col("slot").isNotNull(), F.greatest(F.lit(0), end - start)).otherwise(0).cast("long")
    return targets, rows.withColumn("start", start).withColumn("words", words).drop("stop", "from")


def scheduled_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, epochs: int = 2, slots: int = 1 << 20, bucket_docs: int = 2000, seed: int = 17) -> DataFrame:
    """``(slot, source, block, start, doc_id, words)`` in the order of the schedule: which words the mix takes in turn. ``start``
    counts the words of the source's stream before them; a block's documents follow each other in it."""
    targets, rows = _dealt(docs, weights, ratio, epochs, slots, bucket_docs, seed)
    rows = rows.where("words > 0").join(targets.select(F.col("rank").alias("src"), "source"), "src")
    return rows.select("slot", "source", F.col("r").alias("block"), "start", "doc_id", "words").orderBy("slot", "start")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, epochs: int = 2, slots: int = 1 << 20, bucket_docs: int = 2000, seed: int = 17, key: str | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, n_slots, first_slot)`` of every row of ``docs(doc_id, text, source)``; with ``key``, a
    column of numbers, also that. ``n_slots`` slots of the schedule take words of the document, the first of them ``first_slot`` (null
    without any).

    ``slots``: about how many slots the schedule has; a block is all words to take over ``slots``, 16 words at least."""
    taken = _dealt(docs, weights, ratio, epochs, slots, bucket_docs, seed, key)[1]
    taken = taken.groupBy("src", "bucket", "pos", "doc_id", "key", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.count_if(F.col("words") > 0).alias("n_slots"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot"))
    return taken.select("doc_id", *([F.col("key").alias(key)] if key else []), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "n_slots", "first_slot")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, as often as the mix takes them: ``taken / size`` rounded, up to the number of
    passes; documents without words stay once. Rows are told apart by a hash of id and text, so each counts by its own text,
    whatever its id; rows that are equal in both count alike."""
    rows = docs.withColumn(ROW, F.xxhash64("doc_id", "text"))
    mix = mix_sources(rows, key=ROW, **options).groupBy(ROW).agg(F.max("size").alias("__size"), F.max("taken").alias("__taken"))
    mix = stash(mix, "mix")
    times = F.when(F.col("__size") == 0, 1).otherwise(F.expr("(2 * __taken + __size) div (2 * __size)"))
    return join_wide(rows, mix, ROW, "inner").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)
