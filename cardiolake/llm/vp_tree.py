"""Approximate nearest neighbours with a vantage-point tree per shard.

Vectors are dealt to shards by a hash of their id and components, packed into rows of bytes. Every shard has one task, which builds its
tree and then takes all queries, in blocks of ``query_rows``, as they come from the shuffle: nothing but the shard and a block is held, the
number of tasks goes with the vectors alone, and no tree is copied or sent. A node holds a vantage point and the median
distance ``mu`` of its points to it, and has an inner and an outer half (split by rank, so equal vectors can't unbalance it). The
queries of a block first go down to their nearest leaf, for a bound; then the block walks the tree once. A half is skipped when the
triangle inequality, relaxed by ``factor``, says that it holds nothing better: outer if ``mu - d > factor * t`` and inner if
``d - mu > factor * t``, with ``t`` the distance of the k-th best so far. ``factor`` 1 gives the exact result (ties included);
smaller ones prune more. In a leaf, a matrix product with a margin for its rounding says who may be among the best; their
distances are then taken from the vectors as given, in double precision.

Of exact copies of one vector in a shard, those with the smallest ids stay, as many as a result can need. Per shard the ``k`` best
of up to ``PACKET`` queries leave the task as one row; rows of the same queries are merged, and ranked by distance, then id.

Defined cases: vectors that are null, all zero, or hold null or non-finite components take no part, neither as query nor as
candidate; vectors of another length than ``dims`` (by default that of the first valid one by id) neither; a query's own id
is no candidate; fewer candidates than ``k`` give them all; ties go to the smaller id; an empty table gives an empty result;
rows that repeat an id are several candidates; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

LEAF = 512
#: Queries whose products with a leaf are taken at once, so that these stay in the processor's cache.
PRODUCTS = 256
#: Bytes of a shard's vectors, unless its rows are given.
SHARD_BYTES = 32 << 20
#: Queries that are packed together; their results from all shards are merged together.
PACKET = 256
#: Smaller tables are cut further, into shards of so many rows, until there are so many shards.
SPREAD_ROWS, SPREAD = 4096, 32
#: Squared norms up to which products can't overflow, and a margin for those too small to be told apart.
LIMITS = {np.dtype(np.float32): (1e35, 1e-35), np.dtype(np.float64): (1e300, 1e-300)}


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` to ``y`` (one vector, or as many), in double precision."""
    out = np.empty(len(x))
    for i in range(0, len(x), 4096):
        diff = x[i : i + 4096].astype(np.float64) - (y if y.ndim == 1 else y[i : i + 4096])
        out[i : i + 4096] = np.sqrt((diff * diff).sum(axis=1))
    return out


def _vantage(vectors: np.ndarray, points: np.ndarray, rng: np.random.Generator, tries: int = 12, sample: int = 96) -> int:
    """Of some points, the one whose distances to a sample spread most."""
    some = points[rng.integers(len(points), size=tries)]
    near = vectors[points[rng.integers(len(points), size=sample)]]
    return int(some[int(np.argmax([_distances(near, vectors[i].astype(np.float64)).std() for i in some]))])


def _needed(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that a result can need: of copies of a vector those with the smallest ids, each id ``k`` times at most. With
    2 ``k`` of them, ``k`` are left whatever the query's own id is."""
    words = vectors.view(np.uint32).reshape(len(vectors), -1)
    odd = np.random.default_rng(1).integers(0, 1 << 63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    marks = np.zeros(len(ids), np.uint64)
    for j, m in enumerate(odd):
        marks += words[:, j] * m
    order = np.lexsort((ids, marks))
    if len(order) < 2 or not (marks[order[1:]] == marks[order[:-1]]).any():
        return order

    def place(new: np.ndarray) -> np.ndarray:
        at = np.arange(len(new))
        return at - np.maximum.accumulate(np.where(new, at, 0))

    first = lambda same: np.concatenate(([True], ~same))
    alike = marks[order[1:]] == marks[order[:-1]]
    twins = np.flatnonzero(alike)
    alike[twins] = (words[order[twins + 1]] == words[order[twins]]).all(axis=1)
    group = np.cumsum(first(alike))
    keep = place(first(alike & (ids[order[1:]] == ids[order[:-1]]))) < k
    order, group = order[keep], group[keep]
    return order[place(first(group[1:] == group[:-1])) < 2 * k]


class Tree:
    """Points in tree order and nodes ``(begin, end, mu, near, far, vantage point)``; a leaf has no halves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = _needed(ids, vectors, k)
        self.nodes: list[list] = []
        todo = [(0, len(order), -1, 0)]
        rng = np.random.default_rng(0)
        while todo:
            a, b, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][side] = me
            self.nodes.append([a, b, -1.0, -1, -1, None])
            if b - a <= LEAF:
                continue
            points = order[a:b]
            point = vectors[_vantage(vectors, points, rng)].astype(np.float64)
            d, half = _distances(vectors[points], point), (b - a) // 2
            rank = np.argpartition(d, half)
            # mu: no inner point is farther, no outer point nearer
            self.nodes[me][2], self.nodes[me][5] = float(d[rank[half]]), point
            order[a:b] = points[rank]
            todo.append((a + half, b, me, 4))
            todo.append((a, a + half, me, 3))
        self.ids, self.vectors = ids[order], vectors[order]
        squares = np.concatenate([(self.vectors[i : i + 4096].astype(np.float64) ** 2).sum(axis=1) for i in range(0, len(order), 4096)])
        self.largest = float(squares.max())
        small = vectors.dtype == np.float32 and self.largest < LIMITS[vectors.dtype][0]
        #: Components and minus half the square: times a query and 1, they order the points of a leaf by nearness.
        self.products = np.empty((len(order), vectors.shape[1] + 1), np.float32 if small else np.float64)
        self.products[:, :-1] = self.vectors
        with np.errstate(over="ignore"):
            self.products[:, -1] = -squares / 2


class Search:
    """The ``k`` best of a block of queries in one tree."""

    def __init__(self, tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.tree, self.query_ids, self.queries, self.k, self.factor = tree, query_ids, queries.astype(np.float64), k, factor
        kind = tree.products.dtype
        with np.errstate(over="ignore"):
            self.squares = (self.queries**2).sum(axis=1)
            self.products = np.concatenate((self.queries, np.ones((len(queries), 1))), axis=1).astype(kind)
        limit, least = LIMITS[kind]
        self.plain = max(float(self.squares.max()), tree.largest) < limit  # else each distance is taken by itself
        self.margin = 2 * (queries.shape[1] + 8) * float(np.finfo(kind).eps) * (self.squares + tree.largest) + least if self.plain else np.zeros(len(queries))
        self.least = np.full(len(queries), -np.inf, kind)  # products below it are of points beyond the k-th best
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.home = np.full(len(queries), -1)
        self.room = np.empty((PRODUCTS, LEAF), kind)
        self.descend(0, np.arange(len(queries)))
        self.visit(0, np.arange(len(queries)))

    def _near(self, active: np.ndarray, a: int, b: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of these queries and points that may be among the best."""
        tree, k = self.tree, self.k
        s = np.matmul(self.products[active], tree.products[a:b].T, out=self.room[: len(active), : b - a])
        least = self.least[active]
        if first:
            s[tree.ids[a:b] == self.query_ids[active][:, None]] = -np.inf
            if b - a > k:
                least = (np.partition(s, b - a - k, axis=1)[:, b - a - k] - 2 * self.margin[active]).astype(s.dtype)
        some = np.flatnonzero(s.max(axis=1) >= least)
        rows, cols = np.divmod(np.flatnonzero(s[some] >= least[some, None]), b - a)
        return some[rows], cols

    def offer(self, active: np.ndarray, a: int, b: int, first: bool = False) -> None:
        """Points ``a`` to ``b`` to these queries; ``first``: there is no bound yet, so it comes from the points themselves."""
        tree, k = self.tree, self.k
        if not self.plain:
            rows, cols = np.divmod(np.arange(len(active) * (b - a)), b - a)
        else:
            hits = [self._near(active[i : i + PRODUCTS], a, b, first) for i in range(0, len(active), PRODUCTS)]
            rows = np.concatenate([i * PRODUCTS + r for i, (r, _) in enumerate(hits)])
            cols = np.concatenate([c for _, c in hits])
        ids = tree.ids[a + cols]
        other = ids != self.query_ids[active[rows]]
        rows, cols, ids = rows[other], cols[other], ids[other]
        d = np.empty(len(rows))
        for i in range(0, len(rows), 1 << 15):
            part = slice(i, i + (1 << 15))
            d[part] = _distances(tree.vectors[a + cols[part]], self.queries[active[rows[part]]])
        better = d <= self.best[active[rows], -1]
        rows, ids, d = rows[better], ids[better], d[better]
        if not len(rows):
            return
        some, place = np.unique(rows, return_inverse=True)
        mine = active[some]
        row = np.concatenate((np.repeat(np.arange(len(some)), k), place))
        all_d, all_i = np.concatenate((self.best[mine].ravel(), d)), np.concatenate((self.found[mine].ravel(), ids))
        order = np.lexsort((all_i, all_d, row))
        picked = order[np.searchsorted(row[order], np.arange(len(some)))[:, None] + np.arange(k)]
        self.best[mine], self.found[mine] = all_d[picked], all_i[picked]
        if self.plain:
            last = self.best[mine, -1]
            self.least[mine] = np.where(np.isinf(last), -np.inf, (self.squares[mine] - last * last) / 2 - self.margin[mine])

    def descend(self, node: int, active: np.ndarray) -> None:
        """Each query to the leaf on its own side of every vantage point."""
        if not len(active):
            return
        a, b, mu, near, far, point = self.tree.nodes[node]
        if near < 0:
            self.home[active] = node
            self.offer(active, a, b, first=True)
            return
        inside = _distances(self.queries[active], point) < mu
        self.descend(near, active[inside])
        self.descend(far, active[~inside])

    def visit(self, node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        a, b, mu, near, far, point = self.tree.nodes[node]
        if near < 0:
            active = active[self.home[active] != node]
            if len(active):
                self.offer(active, a, b)
            return
        gap = _distances(self.queries[active], point) - mu
        slack = 1e-9 * (1 + mu)  # rounding never prunes
        self.visit(near, active[~(gap > self.factor * self.best[active, -1] + slack)])
        self.visit(far, active[~(-gap > self.factor * self.best[active, -1] + slack)])


def _pack(dims: int):
    """Vectors of a batch as rows of bytes: one for each of its shards, and its queries as rows without a shard (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, shard, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "shard", "asks"))
            vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            order = np.argsort(shard, kind="stable")
            parts = [(shard[p[0]], p) for p in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)]
            asked = np.flatnonzero(asks)
            parts += [(-1, asked[i : i + PACKET]) for i in range(0, len(asked), PACKET)]
            yield pa.record_batch([pa.array([int(s) for s, _ in parts], pa.int32()), pa.array([ids[p].tobytes() for _, p in parts]), pa.array([vectors[p].tobytes() for _, p in parts])], names=["shard", "ids", "vectors"])

    return run


def _search(dims: int, kind: str, k: int, factor: float, query_rows: int):
    """Rows come by shard, its points before the queries."""

    def unpack(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.frombuffer(i, np.int64) for i, _ in rows]), np.concatenate([np.frombuffer(v, kind).reshape(-1, dims) for _, v in rows])

    def answer(tree: Tree, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        ids, queries = unpack([r[1:] for r in rows])
        s = Search(tree, ids, queries, k, factor)
        ends = np.cumsum([len(r[1]) // 8 for r in rows])[:-1]
        return pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), *[pa.array([p.tobytes() for p in np.split(x, ends)]) for x in (s.found, s.best)]], names=["packet", "ids", "found", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, points, tree, waiting, n = None, [], None, [], 0
        for batch in batches:
            for shard, packet, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("shard", "packet", "ids", "vectors")), strict=True):
                if shard != at:
                    if waiting:
                        yield answer(tree, waiting)
                    at, points, tree, waiting, n = shard, [], None, [], 0
                if packet is None:
                    points.append((ids, vectors))
                    continue
                if tree is None:
                    if not points:
                        continue  # no vector fell to this shard
                    tree, points = Tree(*unpack(points), k), []
                waiting.append((packet, ids, vectors))
                n += len(ids) // 8
                if n >= query_rows:
                    yield answer(tree, waiting)
                    waiting, n = [], 0
        if waiting:
            yield answer(tree, waiting)

    return run


def _merge(k: int):
    """The ``k`` best of each query of one packet, from all shards."""

    def run(rows: pa.Table) -> pa.Table:
        at: dict[bytes, list[tuple[np.ndarray, np.ndarray]]] = {}
        for ids, found, best in zip(*(rows.column(c).to_pylist() for c in ("ids", "found", "best")), strict=True):
            at.setdefault(ids, []).append((np.frombuffer(found, np.int64).reshape(-1, k), np.frombuffer(best).reshape(-1, k)))
        out: list[list[np.ndarray]] = [[], [], []]
        for ids, parts in at.items():
            found, best = (np.concatenate(x, axis=1) for x in zip(*parts, strict=True))
            order = np.lexsort((found, best), axis=1)[:, :k]
            found, best = np.take_along_axis(found, order, axis=1), np.take_along_axis(best, order, axis=1)
            ok = np.isfinite(best) | (found != np.iinfo(np.int64).max)
            for c, x in zip(out, (np.repeat(np.frombuffer(ids, np.int64), ok.sum(axis=1)), found[ok], best[ok]), strict=True):
                c.append(x)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return run


def valid_vectors(rows: DataFrame, dims: int | None = None) -> tuple[DataFrame, int, int]:
    """``(vec_id, embedding)`` of rows that take part, the number of their components, and their number. Components stay floats where they
    are, else they become doubles."""
    kind = rows.schema["embedding"].dataType
    e = F.col("embedding") if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("embedding", lambda x: x != 0))
    if dims is not None:
        rows = rows.where(F.size("embedding") == dims)
    sizes = rows.groupBy(F.size("embedding").alias("dims")).agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    one = sizes.orderBy("first", "dims").first()
    return (rows.where(F.size("embedding") == one["dims"]), one["dims"], one["n"]) if one else (rows, dims or 0, 0)


def nearest(rows: DataFrame, is_query: str, k: int = 10, factor: float = 0.18, shard_rows: int | None = None, query_rows: int = 2048) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found among all rows for each row that ``is_query`` picks."""
    spark = small_batches(rows.sparkSession)
    valid, dims, n = valid_vectors(rows)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "float32" if isinstance(valid.schema["embedding"].dataType.elementType, T.FloatType) else "float64"
    most = shard_rows or max(SPREAD_ROWS, SHARD_BYTES // (dims * np.dtype(kind).itemsize))
    shards = max(-(-n // most), min(-(-n // SPREAD_ROWS), SPREAD))
    dealt = valid.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    packed = dealt.mapInArrow(_pack(dims), "shard int, ids binary, vectors binary")
    # each query goes to each shard: a stated query set against all rows
    places = F.when(F.col("shard") >= 0, F.array("shard")).otherwise(F.sequence(F.lit(0), F.lit(shards - 1)))
    mark = F.when(F.col("shard") < 0, F.xxhash64("ids", "vectors"))  # of a packet of queries
    sent = packed.select(F.explode(places).alias("to"), mark.alias("packet"), "ids", "vectors").withColumnRenamed("to", "shard")
    met = sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("packet").isNotNull())
    found = met.mapInArrow(_search(dims, kind, k, factor, query_rows), "packet long, ids binary, found binary, best binary")
    best = found.groupBy("packet").applyInArrow(_merge(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
