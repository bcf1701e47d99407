"""Shared helpers: written intermediates in the cluster's shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where that setting is absent (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        path = spark._jvm.org.apache.hadoop.fs.Path(set_dir)
        full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
        return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="cardiolake-")
    return _OWN_DIR[app]


def small_batches(spark: SparkSession, most: str = "8m") -> SparkSession:
    """Bounds the Arrow batches of this session by bytes: rows carry whole texts, and the default of 64 MB, twice in the
    executor and twice in each Python worker, would be most of a small executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back: this cuts the lineage, and a lost
    executor costs no more than the tasks that it ran."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stash_path = path
    return back


def unstash(df: DataFrame) -> None:
    """Deletes what ``stash`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written intermediates of one operator, deleted together once its result is written: ``with Scratch() as tmp``."""

    def __init__(self):
        self.kept: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return self.keep(stash(df, name))

    def keep(self, df: DataFrame) -> DataFrame:
        """Takes charge of a table that ``stash`` wrote elsewhere."""
        self.kept.append(df)
        return df

    def drop(self, df: DataFrame) -> None:
        """Deletes one before the others."""
        self.kept = [x for x in self.kept if x is not df]
        unstash(df)

    def __exit__(self, *_) -> None:
        while self.kept:
            unstash(self.kept.pop())


#: Rows of (id, number) up to which a lookup side is broadcast; beyond, both sides are shuffled. The check tool measured 19 MB
#: for 220,697 such rows, so this is about 85 MB in each executor.
BROADCAST_ROWS = 1_000_000


#: A column that numbers rows; ids may be null or repeated.
ROW = "__row"


def with_row_keys(docs: DataFrame) -> DataFrame:
    """The rows, written once with a unique number in ``__row``: written, because another reading could number them otherwise."""
    return stash(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def small_side(narrow: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast when its counted rows allow it."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


def join_wide(wide: DataFrame, narrow: DataFrame, on: str, how: str) -> DataFrame:
    """Joins rows with whole texts to a written table of ids. Up to ``BROADCAST_ROWS`` counted rows the ids go to the texts,
    so that texts aren't shuffled; a larger table meets them in a sort-merge join."""
    return wide.join(small_side(narrow), on, how)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``edges(src, dst)``; returns ``(node, component)`` with the smallest
    node of each component, for every node that has an edge to another node.

    Large-star and small-star rounds (Kiveris et al., 2014): each round hangs neighbours on the smallest one. Minima are
    pre-aggregated and joined back, so the rows of one hot node can be split by a skew join. Null ends and loops are
    dropped; an empty input gives an empty result. The edge list is written in the shared folder after each round, and so is
    the result.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    e = stash(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    seen = _mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        after = stash(small.where("u <> v").distinct(), "edges")
        now = _mark(after)
        unstash(e)
        e = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    leaf = e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))
    root = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = stash(leaf.union(root), "components")
    unstash(e)
    return out


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
