"""Benchmark decontamination by SimHash over item-sized windows and a multi-index Hamming search.

A benchmark item is a bag of ``k``-word shingles (its whole text as one, when shorter), weighted by how rare a shingle is
among the items (other shingles weigh as much as those of one item). Windows of each item's number of words slide over every
document; a window's 64-bit SimHash is the sign of the weighted sum of its shingles' bits. Fingerprints are cut into ``blocks``
blocks; two fingerprints within ``radius`` bits differ by at most ``radius // blocks`` bits in some block, so tables over all
block values within that many bits find every item within the radius. What the tables find is compared exactly: weighted Jaccard
similarity of the bags (sum of smaller over sum of larger weights).

A window reaches the similarity ``threshold`` only if shingles of the benchmark make up that share of its weight, so windows with
less are not fingerprinted: a bound by running sums that loses nothing. All other windows, of all texts, whole, are looked
up in the tables. How many of the passages at or above the threshold the radius keeps is measured against brute force in the tests
(all of the items, with words changed until the threshold is near).

Items travel to the tasks in blocks of at most ``item_shingles`` shingles and ``most_items`` items (the bound of what is
broadcast: about 40 bytes a shingle and, for the tables, 256 bytes an item); a larger benchmark takes several passes over the
documents.

Defined cases: null or empty text and items give no row; an empty benchmark or table gives an empty result; the best
window per (document, item) counts: highest similarity, then smallest start; rows that repeat a ``doc_id`` give one row
with the best of them; null ids are kept as one group; very long texts are hashed piece by piece and their windows looked up in
runs; further columns are not read. Words are compared without A-Z case and ASCII punctuation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stash
from .textkit import U, documents, shingle_hashes

SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long, hamming int"


#: Windows whose sums of bits are in memory at a time.
RUN = 4096


class Items:
    """The tables of one block of items: the weights of their shingles, and for each window length the items' bags,
    fingerprints and Hamming tables."""

    def __init__(self, ids: list[int], bags: list[np.ndarray], lengths: list[int], k: int, weight: dict[int, float], default: float, radius: int, blocks: int):
        self.ids, self.radius, self.default = ids, radius, default
        self.bags = []
        for bag in bags:
            values, counts = np.unique(bag, return_counts=True)
            w = np.array([weight[int(v)] for v in values])
            self.bags.append((values, counts, w, float((counts * w).sum())))
        self.vocabulary = np.unique(np.concatenate([b[0] for b in self.bags])) if bags else np.zeros(0, U)
        self.weights = np.array([weight[int(v)] for v in self.vocabulary])
        # a coarse bit table answers most look-ups
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> U(44)).astype(np.int64)] = True
        self.prints = np.array([simhash(b[0], b[1] * b[2]) for b in self.bags], U)
        lengths = np.array(lengths)
        self.by_length = {int(n): Index(self.prints, np.flatnonzero(lengths == n), radius, blocks) for n in np.unique(lengths)}


class Index:
    """Multi-index Hamming tables over the fingerprints of some items: per block and block value, the items (a bit each) within
    ``radius // blocks`` bits of that value."""

    def __init__(self, prints: np.ndarray, items: np.ndarray, radius: int, blocks: int):
        self.items, self.prints, self.radius, self.tables = items, prints[items], radius, []
        for b in range(blocks):
            low, high = 64 * b // blocks, 64 * (b + 1) // blocks
            size = 1 << (high - low)
            value = (self.prints >> U(low)).astype(np.int64) & (size - 1)
            near = np.bitwise_count((np.arange(size)[:, None] ^ value[None, :]).astype(np.uint64)) <= radius // blocks
            self.tables.append((U(low), size - 1, np.packbits(near, axis=1, bitorder="little")))

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for every fingerprint and every item within the radius."""
        windows, items = [], []
        step = max(1, (1 << 20) // len(self.items))
        for a in range(0, len(prints), step):
            some = prints[a : a + step]
            found = np.zeros((len(some), self.tables[0][2].shape[1]), np.uint8)
            for low, mask, table in self.tables:
                found |= table[(some >> low).astype(np.int64) & mask]
            w, i = np.nonzero(np.unpackbits(found, axis=1, count=len(self.items), bitorder="little"))
            near = np.bitwise_count(some[w] ^ self.prints[i]) <= self.radius
            windows.append(a + w[near])
            items.append(self.items[i[near]])
        return np.concatenate(windows), np.concatenate(items)


def simhash(shingles: np.ndarray, weights: np.ndarray) -> np.uint64:
    bits = ((shingles[:, None] >> np.arange(64, dtype=U)) & U(1)).astype(np.float64) * 2 - 1
    return _pack((weights[:, None] * bits).sum(axis=0)[None, :])[0]


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(U).reshape(-1)


def _windows(items: Items, h: np.ndarray, k: int, threshold: float, n_words: int) -> Iterator[tuple[int, float, int, int, int]]:
    """(item, similarity, start, words, hamming) of the best window of each item in one document's shingles ``h``."""
    at = np.flatnonzero(items.maybe[(h >> U(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(items.vocabulary, h[at]), len(items.vocabulary) - 1)
    known = items.vocabulary[place] == h[at]
    at, place = at[known], place[known]
    if not len(at):
        return
    weight = np.full(len(h), items.default)
    weight[at] = items.weights[place]
    shared = np.zeros(len(h))
    shared[at] = items.weights[place]
    upto, shared = (np.concatenate(([0], np.cumsum(x))) for x in (weight, shared))
    for length, index in items.by_length.items():
        span = max(1, length - k + 1)  # shingles of a window
        last = max(0, len(h) - span)
        starts = np.arange(last + 1)
        stops = np.minimum(starts + span, len(h))
        # the shingles that it shares with an item are among those of the benchmark
        starts = starts[shared[stops] - shared[starts] >= threshold * (upto[stops] - upto[starts]) - 1e-9]
        best: dict[int, tuple] = {}
        for a in range(0, len(starts), RUN):
            for run in np.split(starts[a : a + RUN], np.flatnonzero(np.diff(starts[a : a + RUN]) > span) + 1):
                low, high = int(run[0]), min(int(run[-1]) + span, len(h))
                # neighbouring starts share their running sums
                bits = np.unpackbits(h[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1
                sums = np.vstack((np.zeros(64), np.cumsum(bits * weight[low:high, None], axis=0)))
                prints = _pack(sums[np.minimum(run + span, len(h)) - low] - sums[run - low])
                for w, item in zip(*(x.tolist() for x in index.find(prints)), strict=True):
                    s, e = int(run[w]), min(int(run[w]) + span, len(h))
                    sim = similarity(items.bags[item], h[s:e], weight[s:e])
                    if sim >= threshold and (item not in best or sim > best[item][1]):
                        best[item] = (item, sim, s, min(length, n_words), int(np.bitwise_count(prints[w] ^ items.prints[item])))
        yield from best.values()


def similarity(bag: tuple, shingles: np.ndarray, weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of an item's bag and a window."""
    values, counts, w, total = bag
    at = np.searchsorted(values, shingles)
    at[at == len(values)] = 0
    same = values[at] == shingles
    both = (np.minimum(np.bincount(at[same], minlength=len(values)), counts) * w).sum()
    return float(both / (total + weights.sum() - both))


def _found(shared: list, words: np.ndarray, threshold: float) -> Iterator[tuple]:
    for own, items in shared:
        for item, *rest in _windows(items, shingle_hashes(words, own), own, threshold, len(words)):
            yield items.ids[item], *rest


def _search(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for row, words in documents(batch.column(1), strip=True):
                if len(words):
                    rows += [(ids[row].as_py(), *found) for found in _found(shared.value, words, threshold)]
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "n_words", "hamming"])

    return run


def _keep(shared, threshold: float, at: int):
    """The rows whose text holds no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leak = np.zeros(batch.num_rows, bool)
            for row, words in documents(batch.column(at), strip=True):
                leak[row] = len(words) and next(_found(shared.value, words, threshold), None) is not None
            yield batch.filter(pa.array(~leak))

    return run


def _bags(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(batch.column(0)[row].as_py(), shingle_hashes(words, k).view(np.int64).tolist(), len(words)) for row, words in documents(batch.column(1), strip=True)]
            ids, bags, sizes = zip(*got, strict=True) if got else ((), (), ())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(bags, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["item_id", "bag", "words"])

    return run


def _item_blocks(benchmark: DataFrame, k: int, radius: int, blocks: int, item_shingles: int, most_items: int) -> Iterator:
    """Broadcast tables of one block of items after the other."""
    spark = benchmark.sparkSession
    with Scratch() as tmp:
        bags = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
        bags = tmp(bags.mapInArrow(_bags(k), "item_id long, bag array<long>, words long").where("words > 0"), "bags")
        n, shingles = bags.agg(F.count("*"), F.coalesce(F.sum(F.size("bag")), F.lit(0))).first()
        rarity = tmp(bags.select(F.explode(F.array_distinct("bag")).alias("s")).groupBy("s").count().select("s", (1 + F.log2(F.lit(max(n, 1)) / F.col("count"))).alias("w")), "rarity")
        # items are dealt to blocks by hash; each pass collects and broadcasts one block
        passes = max(-(-shingles // item_shingles), -(-n // most_items))
        for i in range(passes):
            part = bags.where(F.pmod(F.xxhash64("item_id", "bag"), F.lit(passes)) == i)
            rows = part.collect()  # one block: about item_shingles shingles and most_items items
            if not rows:
                continue
            weight = {r["s"] & 0xFFFFFFFFFFFFFFFF: r["w"] for r in rarity.join(part.select(F.explode("bag").alias("s")).distinct(), "s").collect()}
            rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["bag"]))
            # items of fewer than k words have shingles of their own length
            alike = [(own, [r for r in rows if min(k, r["words"]) == own]) for own in range(1, k + 1)]
            items = [(own, Items([r["item_id"] for r in some], [np.array(r["bag"], np.int64).view(U) for r in some], [r["words"] for r in some], own, weight, 1 + math.log2(n), radius, blocks)) for own, some in alike if some]
            yield spark.sparkContext.broadcast(items)


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 23, blocks: int = 8, item_shingles: int = 500_000, most_items: int = 20_000) -> DataFrame:
    """``(doc_id, item_id, similarity, start_word, n_words, hamming)`` for every document and item that a window matches."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for shared in _item_blocks(benchmark, k, radius, blocks, item_shingles, most_items):
        found = found.union(docs.mapInArrow(_search(shared, threshold), SCHEMA))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), "n_words", "hamming")).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.s")).alias("start_word"), "b.n_words", "b.hamming")


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 23, blocks: int = 8, item_shingles: int = 500_000, most_items: int = 20_000) -> DataFrame:
    """The rows, with all their columns, whose text holds no benchmark passage. Each row is judged by its own text, whatever
    its id; null and empty texts stay."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(docs.columns)])
    done = False
    for shared in _item_blocks(benchmark, k, radius, blocks, item_shingles, most_items):
        # one pass at a time, so that a task runs one Python worker
        rows = stash(rows, "clean") if done else rows
        rows, done = rows.mapInArrow(_keep(shared, threshold, docs.columns.index("text")), rows.schema), True
    return rows.toDF(*docs.columns)
