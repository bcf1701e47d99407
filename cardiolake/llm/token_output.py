"""Token-id output in patched frame-of-reference (PFOR) files, and reading them back.

Texts are range-partitioned and sorted by ``doc_id``; each task tokenises its run of documents and rolls a new file after
about ``file_tokens`` ids. Files lie in the cluster's shared folder under names that no other attempt uses, and only those
of committed tasks enter the manifest, so a lost executor leaves at most an unused file. A file:

    magic "PFOR1\\0\\0\\0" | documents D, ids N, blocks B (uint64 each)
    D x (doc_id int64, null mark uint8, ids of the document uint32)
    B x block start uint64 (byte offset of each block from the start of the block area; the index)
    blocks: minimum uint32 | width uint8 | exceptions E uint16 | ids in block uint16 |
            ids minus minimum, packed at width bits (the low bits of an exception) | E x position uint16 | E x high bits uint32

A block holds ``BLOCK`` ids; its width is the smallest that fits ``percentile`` per cent of its differences, the others
are exceptions. Any block can be decoded alone through the index (``read_block``).

Defined cases: null or empty text is the end id alone; null ids sort first and come back null; rows that repeat a
``doc_id`` are separate documents, in the order of their texts' checksums (null first); a very long text is a run of its own and
may fill a file alone; an empty table writes nothing and gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, stash
from .textkit import FIRST, U, buffers, eights, give_back, slices, span_hashes

BLOCK = 1024
#: About how many bytes of text one task encodes, where the shuffle has fewer partitions.
TASK_BYTES = 64 << 20
MAGIC = b"PFOR1\0\0\0"
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("patches", "<u2"), ("ids", "<u2")])
_DOCS = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u4")])

# White space beyond 0x20 and 0x09-0x0D: a text that holds any of it is tokenised whole, since its runs of white space
# cannot be cut at ASCII bytes.
_WIDE_SPACE = regex.compile(r"[\s--[\x20\x09-\x0D]]", regex.V1)


class Encoder:
    """Byte-level BPE through the tokenizers library, with the ids of distinct pieces of text kept by 64-bit hash.

    The pre-tokeniser never joins a non-space with the white space after it, nor a letter with the punctuation after it, so
    texts are cut there and a distinct piece is encoded once. Kept pieces have their bytes (the first eight apart from the
    others), and a piece takes the ids of a kept one only if its bytes are the same. ``most`` bounds the kept pieces (about
    45 bytes each), ``most_bytes`` what lies beyond their first eight bytes. With ``special``, strings that are added tokens of the
    vocabulary become those, as in the library's plain call (texts that hold any are tokenised whole); else they are ordinary text."""

    def __init__(self, path: str, most: int = 300_000, most_bytes: int = 8 << 20, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.added = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.tokenizer.no_truncation()
        # in a byte-level vocabulary a token has one character per byte
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.head, self.length, self.place, self.rest = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def pieces(self, keys: np.ndarray, data: np.ndarray, head: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each distinct piece lie in ``flat``: (begin, size), and whether the kept piece is the same."""
        if len(self.keys) > self.most or len(self.rest) > self.most_bytes:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        new[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] != keys[at < len(self.keys)]
        length = (stops - starts).astype(np.int32)
        if new.any():
            ids, sizes = self._encode(data.tobytes(), starts[new], stops[new])
            more = np.maximum(length[new] - 8, 0).astype(np.int64)
            every = np.concatenate((self.keys, keys[new]))
            order = np.argsort(every, kind="stable")
            self.keys = every[order]
            self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(sizes) - sizes))[order]
            self.size = np.concatenate((self.size, sizes.astype(np.int32)))[order]
            self.head = np.concatenate((self.head, head[new]))[order]
            self.length = np.concatenate((self.length, length[new]))[order]
            self.place = np.concatenate((self.place, len(self.rest) + np.cumsum(more) - more))[order]
            self.rest = np.concatenate((self.rest, data[_ranges(starts[new] + 8, more)]))
            self.flat = np.concatenate((self.flat, ids))
            at = np.searchsorted(self.keys, keys)
        same = (self.head[at] == head) & (self.length[at] == length)
        long = np.flatnonzero(same & (length > 8) & ~new)
        same[long] = _equal(data, starts[long] + 8, self.rest, self.place[at[long]], length[long].astype(np.int64) - 8)
        return self.begin[at], self.size[at].astype(np.int64), same

    def _encode(self, blob: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces. Pieces that begin with white space and end without are encoded in runs, as one text: the cuts
        between them are cuts of the pre-tokeniser, and the tokens' widths tell them apart."""
        text = [blob[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        white = b" \t\n\v\f\r"
        runs = [i for i, p in enumerate(text) if p[0] in white and p[-1] not in white]
        alone = [i for i, p in enumerate(text) if p[0] not in white or p[-1] in white]
        out = np.zeros(len(text), np.int64)
        found = []
        places = []
        for a in range(0, len(runs), 2048):
            some = runs[a : a + 2048]
            ids = self.whole(b"".join(text[i] for i in some).decode("utf-8"))
            ends = np.cumsum([len(text[i]) for i in some])
            place = np.cumsum(self.width[ids])
            cut = np.searchsorted(place, ends)
            if not (place[cut] == ends).all():
                raise RuntimeError("token widths don't add up to the text")
            out[some] = np.diff(np.concatenate(([-1], cut)))
            found.append(ids)
            places += some
        if alone:
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([text[i].decode("utf-8") for i in alone], add_special_tokens=False)]
            out[alone] = [len(x) for x in coded]
            found.append(np.fromiter((i for x in coded for i in x), np.uint32))
            places += alone
        flat = np.concatenate(found)
        # back into the order of the pieces
        sizes = out[places]
        begin = np.empty(len(text), np.int64)
        begin[places] = np.cumsum(sizes) - sizes
        return flat[_ranges(begin, out)], out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges ``begin .. begin + size``."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)


def _equal(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ranges of at least one byte at ``a`` and at ``b`` hold the same bytes."""
    if not len(size):
        return np.zeros(0, bool)
    return np.logical_and.reduceat(left[_ranges(a, size)] == right[_ranges(b, size)], np.cumsum(size) - size)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special=special)
    return _ENCODERS[path, special]


_KIND = np.zeros(256, np.uint8)  # 1 white space, 2 ASCII letter, 3 ASCII punctuation
_KIND[[0x20, *range(0x09, 0x0E)]] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 3


def encode_texts(enc: Encoder, column: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids of these rows with an end id each, number of ids of each row)."""
    raw, offsets = buffers(column)
    for i, j in slices(offsets, 1 << 19):
        base = int(offsets[i])
        data, off = raw[base : int(offsets[j])], offsets[i : j + 1] - base
        wide = np.concatenate(([0], np.cumsum(data >= 0x80)))
        odd = [d for d in np.flatnonzero(wide[off[1:]] > wide[off[:-1]]).tolist() if _WIDE_SPACE.search(data[off[d] : off[d + 1]].tobytes().decode("utf-8"))]
        if enc.added is not None and (found := [m.start() for m in enc.added.finditer(data)]):
            odd = sorted({*odd, *(np.searchsorted(off, found, side="right") - 1).tolist()})
        kind = _KIND[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = ((kind[1:] == 1) & (kind[:-1] != 1)) | ((kind[1:] == 3) & (kind[:-1] == 2))
        cut[off[:-1][off[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(data))
        rows = np.searchsorted(off, starts, side="right") - 1
        if odd:
            plain = ~np.isin(rows, odd)
            starts, stops, rows = starts[plain], stops[plain], rows[plain]
        eight, length = eights(data), stops - starts
        head = eight[starts] & FIRST[np.minimum(length, 8)]
        keys, first, at = np.unique(span_hashes(eight, starts, stops), return_index=True, return_inverse=True)
        begin, size, same = enc.pieces(keys, data, head[first], starts[first], stops[first])
        # two pieces of one hash: their texts are encoded whole
        one = first[at]
        good = same[at] & (head == head[one]) & (length == length[one])
        long = np.flatnonzero(good & (length > 8) & (one != np.arange(len(one))))
        good[long] = _equal(data, starts[long] + 8, data, starts[one[long]] + 8, length[long] - 8)
        if not good.all():
            odd = sorted({*odd, *rows[~good].tolist()})
            plain = ~np.isin(rows, odd)
            at, rows = at[plain], rows[plain]
        n = size[at]
        per_row = np.bincount(rows, weights=n, minlength=j - i).astype(np.int64)
        whole = {d: enc.whole(data[off[d] : off[d + 1]].tobytes().decode("utf-8")) for d in odd}
        for d, x in whole.items():
            per_row[d] = len(x)
        per_row += 1
        stop = np.cumsum(per_row)
        out = np.full(int(stop[-1]), end, np.uint32)
        room = np.ones(len(out), bool)
        room[stop - 1] = False
        for d, x in whole.items():
            out[stop[d] - per_row[d] : stop[d] - 1] = x
            room[stop[d] - per_row[d] : stop[d] - 1] = False
        out[room] = enc.flat[_ranges(begin[at], n)]
        yield i, j, out, per_row


def encode_blocks(ids: np.ndarray, percentile: float = 95.0) -> tuple[bytes, np.ndarray]:
    """Blocks' bytes and each block's start. All blocks of a width are packed at once."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    grid = grid - low[:, None]
    rank = max(0, int(np.ceil(BLOCK * percentile / 100)) - 1)
    width = np.ceil(np.log2(np.partition(grid, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(np.int64)
    count = np.full(blocks, BLOCK)
    if blocks:
        count[-1] = n - (blocks - 1) * BLOCK
    over = (grid >> width[:, None].astype(np.uint32)) > 0
    patches = over.sum(axis=1)
    size = _HEAD.itemsize + BLOCK // 8 * width + patches * 6
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(start[-1]), np.uint8)
    head = np.zeros(blocks, _HEAD)
    head["low"], head["width"], head["patches"], head["ids"] = low, width, patches, count
    out[start[:-1, None] + np.arange(_HEAD.itemsize)] = head.view(np.uint8).reshape(blocks, _HEAD.itemsize)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = (grid[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
            packed = np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            out[start[rows, None] + _HEAD.itemsize + np.arange(packed.shape[1])] = packed
    for b in np.flatnonzero(patches):
        at = np.flatnonzero(over[b])
        body = at.astype("<u2").tobytes() + (grid[b, at] >> np.uint32(width[b])).astype("<u4").tobytes()
        stop = start[b + 1]
        out[stop - len(body) : stop] = np.frombuffer(body, np.uint8)
    return out.tobytes(), start[:-1]


def decode_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``start``."""
    blocks = len(start)
    if not blocks:
        return np.zeros(0, np.uint32)
    start = start.astype(np.int64)
    head = np.ascontiguousarray(data[start[:, None] + np.arange(_HEAD.itemsize)]).view(_HEAD).reshape(-1)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    width = head["width"].astype(np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            packed = data[start[rows, None] + _HEAD.itemsize + np.arange(BLOCK // 8 * w)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            value = np.zeros((len(rows), BLOCK), np.uint32)
            for k in range(w):
                value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            grid[rows] = value
    for b in np.flatnonzero(head["patches"]):
        e = int(head["patches"][b])
        at = start[b] + _HEAD.itemsize + BLOCK // 8 * width[b]
        where = data[at : at + 2 * e].view("<u2")
        grid[b, where] |= np.ascontiguousarray(data[at + 2 * e : at + 6 * e]).view("<u4") << np.uint32(width[b])
    grid += head["low"][:, None]
    keep = np.arange(BLOCK) < head["ids"][:, None]
    return grid[keep]


def file_bytes(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, percentile: float) -> bytes:
    docs = np.zeros(len(sizes), _DOCS)
    docs["null"] = [d is None for d in doc_ids]
    docs["doc_id"] = [0 if d is None else d for d in doc_ids]
    docs["ids"] = sizes
    parts, starts, at = [], [], 0
    for a in range(0, len(ids), BLOCK * 256):
        body, start = encode_blocks(ids[a : a + BLOCK * 256], percentile)
        parts.append(body)
        starts.append(start + at)
        at += len(body)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return MAGIC + np.array([len(docs), len(ids), len(start)], "<u8").tobytes() + docs.tobytes() + start.astype("<u8").tobytes() + b"".join(parts)


def parse(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, block starts, block area) of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    d, _, b = np.frombuffer(content, "<u8", 3, 8).tolist()
    docs = np.frombuffer(content, _DOCS, d, 32)
    at = 32 + d * _DOCS.itemsize
    return docs, np.frombuffer(content, "<u8", b, at), np.frombuffer(content, np.uint8, offset=at + 8 * b)


def read_block(content: bytes, block: int) -> np.ndarray:
    """The ids of one block, found through the index."""
    _, start, area = parse(content)
    return decode_blocks(area, start[block : block + 1])


def _write(folder: str, tokenizer: str, end: int, percentile: float, file_tokens: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.taskcontext import TaskContext

        enc, store = encoder(tokenizer, special), fs.FileSystem.from_uri(folder)
        task, name, count = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        ids, sizes, docs, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal count, held
            n = np.concatenate(sizes)
            path = f"{store[1]}/{task:06d}-{count:04d}-{name}.pfor"
            with store[0].open_output_stream(path) as out:
                out.write(file_bytes(docs, n, np.concatenate(ids), percentile))
            row = pa.record_batch([pa.array([task], pa.int32()), pa.array([count], pa.int32()), pa.array([path.rsplit("/", 1)[1]]), pa.array([int(n.sum())])], names=["task", "seq", "file", "ids"])
            count, held = count + 1, 0
            for x in (ids, sizes, docs):
                x.clear()
            return row

        try:
            for batch in batches:
                for i, j, got, n in encode_texts(enc, batch.column(1), end):
                    ids.append(got)
                    sizes.append(n)
                    docs.extend(batch.column(0)[i:j].to_pylist())
                    held += len(got)
                    if held >= file_tokens:
                        yield flush()
            if docs:
                yield flush()
        finally:
            # workers wait for further tasks, more of them than run at a time: they keep the vocabulary, and nothing else
            enc.clear()
            give_back()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int, percentile: float = 95.0, file_tokens: int = 1_000_000, special: bool = True) -> tuple[str, DataFrame]:
    """Writes all texts; returns the folder and its manifest ``(task, seq, file, ids, start)``, one row per file."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    # the texts of a hot id are parted by their checksums
    order = [F.col("doc_id").asc_nulls_first(), F.crc32("text")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stash(dealt.mapInArrow(_write(folder, tokenizer, end, percentile, file_tokens, special), "task int, seq int, file string, ids long"), "manifest")
    # two steps, so that only one row per task meets in one place
    tasks = found.groupBy("task").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("task").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return folder, found.withColumn("at", F.coalesce(F.sum("ids").over(inner), F.lit(0))).join(tasks, "task").select("task", "seq", "file", "ids", (F.col("base") + F.col("at")).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            docs, start, area = parse(batch.column(1)[row].as_py())
            ids = np.concatenate([decode_blocks(area, start[a : a + 256]) for a in range(0, len(start), 256)]).astype("<u4")
            stop = np.cumsum(docs["ids"].astype(np.int64))
            begin = stop - docs["ids"]
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            yield pa.record_batch([pa.array([batch.column(0)[row].as_py()] * len(docs)), pa.array(docs["doc_id"], mask=docs["null"].astype(bool)), pa.array(begin), pa.array(docs["ids"].astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "begin", "n_tokens", "ids_crc32"])


def read_tokens(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files that the manifest names."""
    files = spark.read.format("binaryFile").load(folder + "/").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    decoded = files.mapInArrow(_read, "file string, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return decoded.join(manifest.select("file", "start"), "file").select("doc_id", (F.col("start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, end: int, **options) -> DataFrame:
    """Writes all texts and reads the files back; see the module's text."""
    folder, manifest = write_tokens(docs, tokenizer, end, **options)
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(docs.sparkSession, folder, manifest)
