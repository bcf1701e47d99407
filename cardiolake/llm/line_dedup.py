"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact tables of reference counts.

A line's key is the line without ASCII white space at both ends, ``A-Z`` lower-cased; an index counts in how many documents each key
occurs. Keys are spread over shards by their first bits. A shard is one row: its keys (128-bit hashes, sorted) with their exact
counts, and two cuckoo filters (buckets of four 16-bit fingerprints), of all keys and of those that ``least`` documents or more
hold. Filters answer first, tables decide:

- ``insert`` and ``delete`` send each block's distinct keys, with their counts, to the shards. A key that the filter of all keys
  doesn't hold is new and is not looked up; all others are looked up in the table, since a fingerprint may be another key's. A key
  whose count falls to nothing leaves the table and its fingerprint leaves the filter; keys that reach ``least`` or fall below it enter
  or leave the second filter. Removing documents therefore gives the table as if they had never come.
- ``dedup`` asks the shards about each block's keys: the second filter first, then the count of what it holds. Answers are places of
  keys within the block, and meet the block's text again.

Each change writes a new version of the shards; an index that failed midway leaves the old one as it was. Shards are split as they
grow, so that one holds about ``SHARD_KEYS`` keys whatever the corpus; a filter that is full is rebuilt, twice as large, from the table.
A key that every block holds comes to its shard once per block; partial sums over groups of ``GROUP`` blocks, and copies of the second filter
with its counts for groups of blocks that ask, bound what one task gets.

Defined cases: null or empty text is one empty line; empty keys are never counted nor dropped; each row is a document, whatever its id
(rows that repeat an id or have none each count and get a row); a very long text is a block of its own; an empty table gives an empty
result and leaves the index alone; deleting what was never inserted raises; ``docs`` may have any further columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import stash, unstash
from .textkit import _LOWER, _SPACE, U, buffers, eights, mix, pack, slices, span_hashes, unpack

BLOCK = 2 << 20
#: About how many keys a shard holds, and how many blocks' rows meet in one task.
SHARD_KEYS, GROUP = 500_000, 4096
SHARD = "shard long, one binary, two binary, counts binary, present binary, frequent binary"
_NL = 10


class Cuckoo:
    """A filter of distinct 64-bit hashes that forgets again. ``table``: buckets of four fingerprints, 0 for none."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = U(len(table) - 1)

    @staticmethod
    def sized(n: int) -> Cuckoo:
        """Empty, for ``n`` hashes at a load below 80 %."""
        return Cuckoo(np.zeros((1 << max(2, (max(1, n) * 5 // 16).bit_length()), 4), np.uint16))

    @staticmethod
    def of(hashes: np.ndarray) -> Cuckoo:
        size = max(8, len(hashes))
        while not (made := Cuckoo.sized(size)).insert(hashes):
            size *= 2
        return made

    @staticmethod
    def read(data: bytes) -> Cuckoo:
        return Cuckoo(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint16).reshape(-1, 4).copy())

    def write(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(self.table.tobytes())

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(hashes, 29)
        print_ = (h & U(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (h >> U(16)) & self.mask
        return print_, first.astype(np.int64), self._other(print_, first).astype(np.int64)

    def _other(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket.astype(U) ^ (mix(print_.astype(U), 31) & self.mask)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(hashes)
        return (self.table[a] == print_[:, None]).any(axis=1) | (self.table[b] == print_[:, None]).any(axis=1)

    def insert(self, hashes: np.ndarray, rounds: int = 500) -> bool:
        """False if the filter is too full; it is to be built anew then. All that are without a place move at once: those that fit into
        their bucket stay, of the others one a bucket takes the place of a fingerprint, which goes on to its other bucket."""
        print_, bucket, other = self._places(hashes)
        for turn in range(rounds):
            if not len(print_):
                return True
            order = np.argsort(bucket, kind="stable")
            print_, bucket, other = print_[order], bucket[order], other[order]
            first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            start = np.flatnonzero(first)
            rank = np.arange(len(bucket)) - start[np.cumsum(first) - 1]
            taken = self.table[bucket] != 0
            fits = rank < 4 - taken.sum(axis=1)
            slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(bucket)), np.minimum(rank, 3)]  # free slots first
            self.table[bucket[fits], slot[fits]] = print_[fits]
            print_, bucket, other, rank = print_[~fits], bucket[~fits], other[~fits], rank[~fits]
            if not turn:  # each tries its other bucket before it displaces anything
                bucket, other = other, bucket
                continue
            full = (self.table[bucket] != 0).all(axis=1)
            head = np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(bucket)] & full
            at, place = bucket[head], (mix(bucket[head].astype(U) + U(turn), 37) & U(3)).astype(np.int64)
            out = self.table[at, place]
            self.table[at, place] = print_[head]
            print_[head] = out
            bucket[head], other[head] = self._other(out, at).astype(np.int64), at
        return not len(print_)

    def delete(self, hashes: np.ndarray) -> None:
        """Removes one fingerprint for each of the hashes, all of which were inserted."""
        print_, a, b = self._places(hashes)
        while len(print_):
            hit = np.concatenate((self.table[a] == print_[:, None], self.table[b] == print_[:, None]), axis=1)
            slot = hit.argmax(axis=1)
            if not hit.any(axis=1).all():
                raise ValueError("a key that the filter doesn't hold can't be deleted")
            cell = np.where(slot < 4, a, b) * 4 + slot % 4
            _, mine = np.unique(cell, return_index=True)  # copies of a fingerprint go one by one
            self.table.reshape(-1)[cell[mine]] = 0
            rest = np.ones(len(cell), bool)
            rest[mine] = False
            print_, a, b = print_[rest], a[rest], b[rest]


def _find(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of keys ``(a, b)`` in a sorted table, -1 where there is none."""
    at, out = np.searchsorted(one, a), np.full(len(a), -1, np.int64)
    open_ = np.flatnonzero(at < len(one))
    while len(open_):
        open_ = open_[(at[open_] < len(one))]
        open_ = open_[one[at[open_]] == a[open_]]
        hit = two[at[open_]] == b[open_]
        out[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit]
        at[open_] += 1  # keys that share their first half
    return out


def _summed(one: np.ndarray, two: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((two, one))
    one, two, counts = one[order], two[order], counts[order]
    new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))[: len(one)]
    start = np.flatnonzero(new)
    return one[start], two[start], np.add.reduceat(counts, start) if len(start) else counts


class Lines:
    """The lines of a block's documents: spans in ``raw``, keys, and the document of each. A null text has one empty line."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        ends = np.flatnonzero(raw == _NL)
        owner = np.searchsorted(offsets, ends, side="right") - 1
        docs = len(offsets) - 1
        ends, owner = np.concatenate((ends, offsets[1:])), np.concatenate((owner, np.arange(docs)))
        order = np.lexsort((ends, owner))
        self.ends, self.doc = ends[order], owner[order]
        first = np.concatenate(([True], self.doc[1:] != self.doc[:-1]))[: len(self.doc)]
        self.starts = np.where(first, offsets[self.doc], np.concatenate(([0], self.ends[:-1] + 1))[: len(self.ends)])
        self.first = np.concatenate((np.flatnonzero(first), [len(self.doc)]))
        solid = np.flatnonzero(~_SPACE[raw])
        a, b = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        self.full = a < b  # lines with a key
        padded = np.append(solid, 0)
        begin, end = padded[a[self.full]], padded[b[self.full] - 1] + 1
        wide = eights(_LOWER[raw])
        self.one, self.two = span_hashes(wide, begin, end, 41), span_hashes(wide, begin, end, 43)
        self.raw = raw

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, the number of documents that hold each, and the key's place for each line that has one."""
        order = np.lexsort((self.two, self.one))
        one, two, doc = self.one[order], self.two[order], self.doc[self.full][order]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))[: len(one)]
        start = np.flatnonzero(new)
        place = np.empty(len(one), np.int64)
        place[order] = np.cumsum(new) - 1
        # lexsort is stable, so documents ascend within a key
        fresh = new | np.concatenate(([True], doc[1:] != doc[:-1]))[: len(doc)]
        counts = np.add.reduceat(fresh.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        return one[start], two[start], counts, place


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs documents: ids and whole texts of one block."""
    task, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0)
        raw, offsets = buffers(batch.column(1))
        for i, j in slices(offsets, BLOCK):
            text = zstandard.ZstdCompressor(level=1).compress(raw[offsets[i] : offsets[j]].tobytes())
            yield pa.record_batch([pa.array([(task << 32) + count]), pa.array([ids[i:j].to_pylist()], pa.list_(pa.int64())), pa.array([(offsets[i : j + 1] - offsets[i]).tolist()], pa.list_(pa.int64())), pa.array([text], pa.binary())], names=["block", "ids", "offsets", "text"])
            count += 1


def _lines(text: bytes, offsets: list[int]) -> Lines:
    return Lines(np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8), np.array(offsets))


def _cut(one: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys."""
    if not len(one):
        return
    shard = (one >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
    at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    for a, b in zip(at, [*at[1:], len(one)], strict=True):
        yield int(shard[a]), int(a), int(b)


def _keys(bits: int, groups: int, sign: int):
    """Each block's keys by shard; ``sign`` is 0 for a question, else what a document adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            for row in batch.to_pylist():
                one, two, counts, _ = _lines(row["text"], row["offsets"]).keys()
                group = int(mix(np.array([row["block"]], U), 47)[0] % U(groups))
                rows = [(s, group, row["block"], a, pack(one[a:b], True), pack(two[a:b]), pack(counts[a:b] * sign) if sign else None) for s, a, b in _cut(one, bits)]
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "group", "block", "at", "one", "two", "counts"])

    return run


def _joined(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = [unpack(x, True) for x in pdf["one"]]
    two, counts = [unpack(x) for x in pdf["two"]], [unpack(x).view(np.int64) for x in pdf["counts"]]
    if not one:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
    return _summed(np.concatenate(one), np.concatenate(two), np.concatenate(counts))


def _partial(pdf: pd.DataFrame) -> pd.DataFrame:
    one, two, counts = _joined(pdf)
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "one": [pack(one, True)], "two": [pack(two)], "counts": [pack(counts)]})


def _renewed(filter_: Cuckoo | None, gone: np.ndarray, come: np.ndarray, all_of: np.ndarray) -> Cuckoo:
    """The filter without ``gone`` and with ``come``; from all its keys where it is missing or full."""
    if filter_ is None:
        return Cuckoo.of(all_of)
    filter_.delete(gone)
    return filter_ if filter_.insert(come) else Cuckoo.of(all_of)


def _change(least: int):
    def run(shard: pd.DataFrame, news: pd.DataFrame) -> pd.DataFrame:
        """A shard after the sums of ``news``. New keys enter unseen; the others are looked up."""
        a, b, delta = _joined(news)
        old = shard.iloc[0] if len(shard) else None
        one, two, counts = (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)) if old is None else (unpack(old["one"], True), unpack(old["two"]), unpack(old["counts"]).view(np.int64))
        present, frequent = (None, None) if old is None else (Cuckoo.read(old["present"]), Cuckoo.read(old["frequent"]))
        maybe = np.zeros(len(a), bool) if present is None else present.contains(a)
        at = np.full(len(a), -1, np.int64)
        at[maybe] = _find(one, two, a[maybe], b[maybe])
        known = at >= 0
        if (delta[~known] < 0).any():
            raise ValueError("documents that were never inserted can't be deleted")
        after = counts.copy()
        after[at[known]] += delta[known]
        if (after < 0).any():
            raise ValueError("documents that were never inserted can't be deleted")
        fresh = ~known & (delta > 0)
        stay = after > 0
        gone, fell, rose = one[~stay], one[(counts >= least) & (after < least)], one[(counts < least) & (after >= least)]
        rose = np.concatenate((rose, a[fresh & (delta >= least)]))
        one, two, after = _summed(np.concatenate((one[stay], a[fresh])), np.concatenate((two[stay], b[fresh])), np.concatenate((after[stay], delta[fresh])))
        if not len(one):
            return pd.DataFrame({c.split()[0]: [] for c in SHARD.split(", ")})
        present, frequent = _renewed(present, gone, a[fresh], one), _renewed(frequent, fell, rose, one[after >= least])
        return pd.DataFrame({"shard": [int((news if old is None else shard)["shard"].iloc[0])], "one": [pack(one, True)], "two": [pack(two)], "counts": [pack(after)], "present": [present.write()], "frequent": [frequent.write()]})

    return run


def _split(bits: int, least: int):
    """Shards cut to more bits; their filters are built from the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one, two, counts = unpack(row["one"], True), unpack(row["two"]), unpack(row["counts"]).view(np.int64)
                for s, a, b in _cut(one, bits):
                    often = one[a:b][counts[a:b] >= least]
                    out = (s, pack(one[a:b], True), pack(two[a:b]), pack(counts[a:b]), Cuckoo.of(one[a:b]).write(), Cuckoo.of(often).write())
                    yield pa.record_batch([pa.array([x]) for x in out], names=[c.split()[0] for c in SHARD.split(", ")])

    return run


def _frequent(least: int):
    """Of each shard, the second filter and what it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = unpack(row["counts"]).view(np.int64)
                keep = counts >= least
                if keep.any():
                    out = (row["shard"], row["frequent"], pack(unpack(row["one"], True)[keep], True), pack(unpack(row["two"])[keep]), pack(counts[keep]))
                    yield pa.record_batch([pa.array([x]) for x in out], names=["shard", "frequent", "one", "two", "counts"])

    return run


def _answer(least: int):
    def run(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        """Of one shard: for each block that asked, the places of its keys that ``least`` documents hold."""
        out: list[tuple[int, bytes]] = []
        if len(shard):
            row = shard.iloc[0]
            held, one, two, counts = Cuckoo.read(row["frequent"]), unpack(row["one"], True), unpack(row["two"]), unpack(row["counts"]).view(np.int64)
            for block, at, x, y in zip(asked["block"], asked["at"], asked["one"], asked["two"], strict=True):
                a = unpack(x, True)
                maybe = np.flatnonzero(held.contains(a))
                if len(maybe):
                    found = _find(one, two, a[maybe], unpack(y)[maybe])
                    sure = maybe[(found >= 0) & (counts[found] >= least)]
                    if len(sure):
                        out.append((int(block), pack(sure + int(at))))
        return pd.DataFrame(out, columns=["block", "drop"])

    return run


def _kept(block: pd.DataFrame, drop: pd.DataFrame) -> pd.DataFrame:
    """The block's documents without the lines whose keys were named."""
    row = block.iloc[0]
    lines = _lines(row["text"], row["offsets"])
    one, _, _, place = lines.keys()
    often = np.zeros(len(one), bool)
    for x in drop["drop"]:
        often[unpack(x).view(np.int64)] = True
    gone = np.zeros(len(lines.doc), bool)
    gone[lines.full] = often[place]
    dropped = np.add.reduceat(gone.astype(np.int64), lines.first[:-1])
    data, offsets, texts = lines.raw.tobytes(), row["offsets"], []
    for d, some in enumerate(dropped):
        a, b = lines.first[d], lines.first[d + 1]
        if some:
            texts.append(b"\n".join(data[lines.starts[k] : lines.ends[k]] for k in range(a, b) if not gone[k]).decode())
        else:
            texts.append(data[offsets[d] : offsets[d + 1]].decode())
    return pd.DataFrame({"doc_id": pd.array(row["ids"], dtype="Int64"), "n_lines": np.diff(lines.first), "n_dropped": dropped, "text": texts})


def _digest(block: pd.DataFrame, drop: pd.DataFrame) -> pd.DataFrame:
    out = _kept(block, drop)
    out["kept_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in out.pop("text")]
    return out


@dataclass(frozen=True)
class LineIndex:
    """How many documents hold each line. Changes return a new index; the old one stays as it was, until ``drop``."""

    spark: SparkSession
    least: int = 10
    shards: DataFrame | None = None
    bits: int = 0
    shard_keys: int = SHARD_KEYS

    def _blocks(self, docs: DataFrame) -> tuple[DataFrame, int, int]:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        blocks = stash(rows.mapInArrow(_blocks, "block long, ids array<long>, offsets array<long>, text binary"), "line-blocks")
        n, size = blocks.agg(F.count("*"), F.coalesce(F.sum(F.element_at("offsets", -1)), F.lit(0))).first()
        return blocks, n, size

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Without the rows ``docs``, all of which were inserted before."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        blocks, n, size = self._blocks(docs)
        try:
            return self._apply(blocks, n, size, sign) if n else self
        finally:
            unstash(blocks)

    def _apply(self, blocks: DataFrame, n: int, size: int, sign: int) -> LineIndex:
        # lines are taken to have about 50 bytes; a shard that holds more keys is split when the change is written
        bits = max(self.bits, (size // 50 // self.shard_keys).bit_length())
        shards, empty = self.shards, self.spark.createDataFrame([], SHARD)
        if shards is not None and bits > self.bits:
            shards = shards.mapInArrow(_split(bits, self.least), SHARD)
        groups = 1 + n // GROUP
        news = blocks.mapInArrow(_keys(bits, groups, sign), "shard long, group int, block long, at long, one binary, two binary, counts binary")
        if groups > 1:
            news = news.groupBy("shard", "group").applyInPandas(_partial, "shard long, one binary, two binary, counts binary")
        news = news.select("shard", "one", "two", "counts")
        after = stash((empty if shards is None else shards).groupBy("shard").cogroup(news.groupBy("shard")).applyInPandas(_change(self.least), SHARD), "line-shards")
        return LineIndex(self.spark, self.least, after, bits, self.shard_keys)

    def counts(self) -> DataFrame:
        """``(one, two, n)``: all keys' hashes and their counts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield pa.record_batch([pa.array(unpack(row["one"], True).view(np.int64)), pa.array(unpack(row["two"]).view(np.int64)), pa.array(unpack(row["counts"]).view(np.int64))], names=["one", "two", "n"])

        return (self.spark.createDataFrame([], SHARD) if self.shards is None else self.shards).mapInArrow(run, "one long, two long, n long")

    def dedup(self, docs: DataFrame, digest: bool = False) -> DataFrame:
        """``(doc_id, n_lines, n_dropped, text)`` of every row of ``docs``: the lines that fewer than ``least`` documents of the index hold.
        With ``digest``, ``kept_sha256`` instead of the text."""
        blocks, n, _ = self._blocks(docs)
        last = "kept_sha256 string" if digest else "text string"
        try:
            groups = 1 + n // GROUP
            held = (self.spark.createDataFrame([], SHARD) if self.shards is None else self.shards).mapInArrow(_frequent(self.least), "shard long, frequent binary, one binary, two binary, counts binary")
            held = held.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            asked = blocks.select("block", "offsets", "text").mapInArrow(_keys(self.bits, groups, 0), "shard long, group int, block long, at long, one binary, two binary, counts binary").drop("counts")
            answers = asked.groupBy("shard", "group").cogroup(held.groupBy("shard", "group")).applyInPandas(_answer(self.least), "block long, drop binary")
            kept = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_digest if digest else _kept, f"doc_id long, n_lines long, n_dropped long, {last}")
            return stash(kept, "line-dedup")
        finally:
            unstash(blocks)

    def drop(self) -> None:
        if self.shards is not None:
            unstash(self.shards)
