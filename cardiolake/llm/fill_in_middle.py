"""Fill-in-the-middle samples from an index of distinct texts.

Each document is cut into prefix, middle and suffix at two token boundaries that its id draws. Tokens are runs of ``A-Za-z`` and
single other code points. Which boundaries a text has depends on the text alone, so copies share the work:

1. ``text_index``: blocks of documents send each distinct text once, compressed, with the ids of the block's documents that hold
   it. Rows meet by a 64-bit hash of the text; within a hash, texts are one only if their bytes are equal. Each distinct text gets
   one index row: its number of tokens and its boundaries as an Elias-Fano list (low bits packed, high bits in unary), about
   four bits a token. The ids of its documents are joined to it there.
2. ``cut_documents``: each index row meets its documents; the seeds of an id select two entries of the list, without reading the
   boundaries before them; the sample is put together, taken apart again, and both are hashed.

A text that more than ``hot`` rows hold is split by a hash of the id into parts of about ``hot`` rows, each indexed once; such texts
are counted beforehand, so no task's work grows with the largest group of copies. Texts are shuffled once.

Defined cases: null text is empty, and plain; a null id draws as an empty number; rows that repeat an id or a text each give a
row; a text that holds a marker stays plain; very long texts are one list each; an empty table gives an empty result; only
``doc_id`` and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stash
from .textkit import buffers, give_back, slices

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Text of one block, in bytes.
BLOCK = 4 << 20
INDEX = "text_hash long, part int, n long, span long, low_bits int, low binary, high binary, text binary, ids binary, no_id long"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def boundaries(raw: np.ndarray) -> tuple[np.ndarray, int]:
    """Where tokens end, in code points, and the number of code points of UTF-8 bytes."""
    first = (raw & 0xC0) != 0x80
    letter = _LETTER[raw[first]]
    # a token ends after each code point but a letter that a letter follows
    inner = np.zeros(len(letter), bool)
    inner[:-1] = letter[:-1] & letter[1:]
    return np.flatnonzero(~inner) + 1, len(letter)


class EliasFano:
    """An ascending list of numbers up to ``span``: ``low_bits`` of each packed, the rest in unary."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)))

    @staticmethod
    def encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
        """``(low_bits, low, high)``"""
        n = len(values)
        if not n:
            return 0, b"", b""
        bits = max(0, (span // n).bit_length() - 1)
        low = np.zeros(n * bits, np.uint8)
        for k in range(bits):
            low[k::bits] = (values >> k) & 1
        high = np.zeros((span >> bits) + n + 1, np.uint8)
        high[(values >> bits) + np.arange(n)] = 1
        return bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()

    def select(self, i: int) -> int:
        """The entry ``i``, from 0: the byte of the unary part that holds the ``i``-th one, then the bit in it."""
        byte = int(np.searchsorted(self.before, i + 1)) - 1
        ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        high = 8 * byte + int(ones[i - int(self.before[byte])]) - i
        low, at = 0, i * self.low_bits
        for k in range(self.low_bits):
            low |= (int(self.low[(at + k) >> 3]) >> ((at + k) & 7) & 1) << k
        return high << self.low_bits | low


def draw(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def assemble(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restore(form: str, output: bytes) -> bytes:
    """The text, from a sample and its form alone. Texts with markers are never cut, so each marker is found once."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    one, other = head[len(PREFIX) :].split(SUFFIX if form == "psm" else PREFIX)
    return one + middle + other if form == "psm" else other + middle + one


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts of each block with the ids of their rows."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        ids, hashes, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        raw, offsets = buffers(batch.column(1))
        for i, j in slices(offsets, BLOCK):
            held: dict[tuple[int, int, bytes], list[int | None]] = {}
            for d in range(i, j):
                held.setdefault((hashes[d], parts[d], raw[offsets[d] : offsets[d + 1]].tobytes()), []).append(ids[d])
            rows = [(h, p, len(t), press.compress(t), np.array([x for x in own if x is not None], np.int64).tobytes(), own.count(None)) for (h, p, t), own in held.items()]
            del held
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["text_hash", "part", "size", "text", "ids", "no_id"])
        give_back()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of ``INDEX`` for each distinct text of a part and about a batch of its rows; rows come sorted by hash, part and size, so
    equal texts lie together. A list is computed at a text's first row and serves all that follow."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    names = [x.split()[0] for x in INDEX.split(", ")]
    key, lists = None, {}  # of the current hash and part: text to list
    for batch in batches:
        rows: dict[tuple, list] = {}
        for h, part, _, packed, ids, none in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (h, part):
                key, lists = (h, part), {}
            text = zstandard.ZstdDecompressor().decompress(packed)
            if text not in lists:
                ends, span = boundaries(np.frombuffer(text, np.uint8))
                lists[text] = (len(ends), span, *EliasFano.encode(ends, span))
            row = rows.setdefault((*key, text), [lists[text], packed, [], 0])
            row[2].append(ids)
            row[3] += none
        flat = [(h, part, *entry, packed, b"".join(ids), none) for (h, part, _), (entry, packed, ids, none) in rows.items()]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*flat, strict=True) if flat else [[]] * len(kinds), kinds, strict=True)], names=names)


def _cut(plain_percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            col = {name: batch.column(name) for name in ("n", "low_bits", "low", "high", "text", "ids", "no_id")}
            for i in range(batch.num_rows):
                n, bits, none = (col[c][i].as_py() for c in ("n", "low_bits", "no_id"))
                text = zstandard.ZstdDecompressor().decompress(col["text"][i].as_py())
                marked = not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                ends = EliasFano(n, bits, col["low"][i].as_py(), col["high"][i].as_py())
                raw = np.frombuffer(text, np.uint8)
                # bytes at which code points begin, where that isn't the code point's number
                begin = None if text.isascii() else np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                whole = hashlib.sha256(text).hexdigest()
                for doc_id in [*np.frombuffer(col["ids"][i].as_py(), np.int64).tolist(), *[None] * none]:
                    h = draw(doc_id)
                    if marked or h[2] % 100 >= 100 - plain_percent:
                        out.append((doc_id, n, "plain", None, None, whole, hashlib.sha256(restore("plain", text)).hexdigest()))
                        continue
                    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    form = "spm" if h[3] % 100 < spm_percent else "psm"
                    a, b = (ends.select(x - 1) if x else 0 for x in (a, b))
                    x, y = (a, b) if begin is None else (int(begin[a]), int(begin[b]))
                    sample = assemble(form, text[:x], text[x:y], text[y:])
                    out.append((doc_id, n, form, a, b - a, hashlib.sha256(sample).hexdigest(), hashlib.sha256(restore(form, sample)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def text_index(docs: DataFrame, hot: int = 1000) -> DataFrame:
    """The index of the distinct texts of ``docs(doc_id, text)``: rows of ``INDEX``. ``text`` is compressed, ``ids`` packed, ``no_id`` the
    number of rows without an id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    often = rows.groupBy("text_hash").count().where(F.col("count") > hot).select("text_hash", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    often = stash(often, "hot-texts")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts"))).cast("int")
    rows = rows.join(small_side(often), "text_hash", "left").select("doc_id", "text", "text_hash", part.alias("part"))
    packed = rows.mapInArrow(_pack, "text_hash long, part int, size long, text binary, ids binary, no_id long")
    met = packed.repartition("text_hash", "part").sortWithinPartitions("text_hash", "part", "size")
    return met.mapInArrow(_index, INDEX)


def cut_documents(index: DataFrame, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """A row of ``RESULT`` for every document of ``text_index``."""
    return index.mapInArrow(_cut(plain_percent, spm_percent), RESULT)


def samples(docs: DataFrame, hot: int = 1000) -> DataFrame:
    return cut_documents(text_index(docs, hot))
