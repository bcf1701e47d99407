"""Vectorised word hashing over Arrow string batches (numpy inside tasks; Spark deals out the rows).

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. A word is read eight bytes at a time; each
eight go through a finaliser that depends on their place, and the results are added up with the length, so no structure of
a word (as polynomials modulo 2^64 have it for Thue-Morse words) makes two words collide. Texts never become Python strings.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
# of the GNU allocator; others have none
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
_Q = U(0xD1342543DE82EF95)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, twice)."""
    h = h + U(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
#: Masks of the first 0 to 8 bytes of a little-endian number.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)
#: Further eights of long spans that are worked on at a time.
_STEP = 1 << 17


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on (zeros beyond the end), as overlapping numbers."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(wide: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the spans of bytes ``starts .. ends``; ``wide`` comes from ``eights``."""
    size = ends - starts
    h = mix(wide[starts] & FIRST[np.minimum(size, 8)], salt)
    long = np.flatnonzero(size > 8)
    if len(long):
        stop = np.cumsum((size[long] - 1) // 8)
        begin = np.concatenate(([0], stop[:-1]))
        for a in range(0, int(stop[-1]), _STEP):
            at = np.arange(a, min(a + _STEP, int(stop[-1])))
            own = np.searchsorted(stop, at, side="right")
            place = at - begin[own] + 1
            at = starts[long[own]] + 8 * place
            part = mix((wide[at] & FIRST[np.minimum(ends[long[own]] - at, 8)]) ^ mix(place.astype(U), 17), salt + 1)
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            h[long[own[first]]] += np.add.reduceat(part, first)
    return mix(h + size.astype(U) * _Q, salt)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def give_back() -> None:
    """Returns unused memory of this worker to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null texts are empty. Called once a batch: what Arrow and the allocator still hold
    of earlier batches goes back to the system first, so that waiting workers stay small."""
    give_back()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (into ``raw``) of the words of documents that lie at ``offsets``."""
    solid = ~_SPACE[raw]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    cut = offsets[(offsets < len(raw))]
    before[cut] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    cut = offsets[(offsets > 0) & (offsets <= len(raw))] - 1
    after[cut] = False
    return starts, np.flatnonzero(solid & ~after) + 1


#: Bytes of a very long text that are worked on at a time.
PIECE = 1 << 20


def pieces(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts one very long text before white space, into pieces of ``PIECE`` bytes and up to that much more (a word is never
    cut, so one without end makes its piece longer)."""
    a, n = 0, len(raw)
    while a < n:
        b = a + PIECE
        while b < n and not (space := _SPACE[raw[b : b + PIECE]]).any():
            b += PIECE
        b = n if b >= n else b + int(space.argmax())
        yield a, b
        a = b


def word_hashes(raw: np.ndarray, offsets: np.ndarray, strip: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each document's first word (one more than documents).

    ``strip`` leaves out ASCII punctuation; words that hold nothing else vanish. A very long text goes piece by piece."""
    base = int(offsets[0])
    raw, offsets = raw[base : int(offsets[-1])], offsets - base
    if len(offsets) == 2 and len(raw) > 2 * PIECE:
        h = np.concatenate([_hashes(raw[a:b], np.array([0, b - a]), strip)[0] for a, b in pieces(raw)])
        return h, np.array([0, len(h)])
    return _hashes(raw, offsets, strip)


def _hashes(raw: np.ndarray, offsets: np.ndarray, strip: bool) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    data = _LOWER[raw]
    if strip:
        kept = ~_PUNCT[raw]
        data, offsets = data[kept], np.concatenate(([0], np.cumsum(kept)))[offsets]
    starts, ends = word_spans(data, offsets)
    return span_hashes(eights(data), starts, ends), np.searchsorted(starts, offsets, side="left")


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; with fewer words, of the whole sequence; without words, none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.zeros(n - k + 1, U)
    for j in range(k):
        h = h * _Q + words[j : n - k + 1 + j]
    return mix(h, k)


def documents(batch_text: pa.Array, strip: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each document of a batch."""
    raw, offsets = buffers(batch_text)
    for i, j in slices(offsets):
        h, first = word_hashes(raw, offsets[i : j + 1], strip)
        for d in range(j - i):
            yield i + d, h[first[d] : first[d + 1]]
    give_back()


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit values as compressed byte planes; of ``ascending`` ones, the differences."""
    v = values.view(U)
    if ascending and len(v):
        v = np.concatenate((v[:1], np.diff(v)))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    v = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(U).reshape(-1)
    return np.cumsum(v) if ascending else v
