"""Exact n-gram Jaccard self-join by universe partitioning (pigeonhole over segments of the token universe).

Two sets link when ``100 * |A & B| >= percent * |A | B|``. Sets fall into size bands; each band cuts the 64-bit universe
of shingle hashes into segments. Linked sets differ in at most H elements, so among segments whose allowances (1: equal
subsets, 2: subsets that differ by one element) add up to H + 1, one segment must agree. A set therefore emits the hash of
its subset in every segment, and the hashes of all one-deletion neighbours in segments of allowance 2. How many segments
get allowance 2 is chosen per band by a cost model over the band's number of distinct sets. ``spare`` more segments of
allowance 1 let a set leave out its empty ones (if it has no more than ``spare``): linked sets agree in ``spare + 1``
segments, so in one that isn't empty, and sets no longer meet because both have nothing somewhere. Every pair that agrees
is verified on the whole sets.

Rows with equal sets form one class; classes have keys made from their elements, so nothing below depends on ``doc_id``. Order of
work, each step a Spark job over all rows:

1. ``profile``: size, class and parities of every row's set.
2. ``lonely``: elements that occur in no other set lie in no intersection. They are counted in a part of the universe (blocks of
   text send the elements of each hash range to one reducer); a class that has more of them than a link allows has no links,
   and takes no part in what follows; its parities are deleted. This is a bound, so no link is lost.
3. ``signatures``: packed per block of text, one row per (block, hash range); a subset that several sets of a block
   share leaves the block once. Reducers keep only subsets that occur at least twice.
4. star edges from each bucket's smallest and largest class to its members are verified; connected components follow. Parities (whether
   each of 8 to 16 hash buckets per element holds an odd number of elements) bound the difference of two sets from below, so
   what is far apart ends there; all other pairs are verified on the whole sets.
5. Only buckets that still hold several components are compared further, and only between components; parities and the
   distances to the bucket's pivot (Jaccard distance is a metric) prune those pairs inside the task, and only members that have
   a pair at or just below the threshold go on. These meet once more, as whole sets; a task sends on fewer links than a group has
   members, and no other pair leaves it. Members of a bucket of more than ``bucket_rows`` don't meet as a whole: a link needs a
   share of both sets, so in any fixed order of the elements the first ones of both, as many as a link can miss and one more,
   have one in common. The order puts elements first that few of these sets have (by a sketch of bounded size; any order loses
   nothing), and members meet under each of their first elements. What all have, as a shared passage, comes last, so rows
   grow with members.

Defined cases: null or empty text has no shingles, links with nothing and is its own component; texts with fewer words
than ``k`` count as one shingle; equal sets share a component whatever their number; rows that repeat a ``doc_id`` are rows of
their own, each linked by its own text; a row with a null ``doc_id`` links like any other and takes the smallest id of its
component (null if none); very long texts are hashed piece by piece; an empty table gives an empty result; only ``doc_id``
and ``text`` are read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import ROW, Scratch, connected_components, join_wide, small_side, stash, with_row_keys
from .textkit import U, documents, mix, pack, shingle_hashes, unpack

BLOCK_BYTES = 4 << 20
#: The part of the universe in which lonely elements are counted: enough to tell a set of which nearly all is its own.
WATCHED = 0.35


def bands(percent: int, top: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band; a partner of a set lies in its own band or a neighbour's."""
    out, lo = [], 1
    while lo <= top:
        hi = max(lo, lo * 100 // percent)
        out.append((lo, hi))
        lo = hi + 1
    return out


def differ_most(size: int, percent: int) -> int:
    """Most elements by which a set of ``size`` or fewer may differ from a linked set that is as large or larger."""
    larger = size * 100 // percent
    return max(s + size - 2 * -(-percent * (s + size) // (100 + percent)) for s in range(size, larger + 1))


def allocate(size: float, differ: int, sets: float, pair_cost: float = 0.3) -> tuple[int, int, int]:
    """(segments, of which with allowance 2, spare ones) at the least cost: rows emitted plus chance agreements to verify."""
    best = (float("inf"), 1, 0, 0)
    for two in range((differ + 1) // 2 + 1):
        for spare in (0, None):
            segments = differ + 1 - two
            empty = (1 - 1 / segments) ** size
            if spare is None:
                few = (segments - two) * empty
                spare = int(few + 4 * few**0.5) + 1
                segments += spare
                empty = (1 - 1 / segments) ** size
            single = size / segments * (1 - 1 / segments) ** (size - 1)
            chance = (0 if spare else (segments - two) * empty**2) + two * (empty + single) ** 2
            cost = sets * (segments + two * size / segments) + pair_cost * chance * sets * sets / 2
            best = min(best, (cost, segments, two, spare))
    return best[1:]


class Plan:
    """Bands with their segment bounds; small enough to travel with each task (a few hundred bands at most)."""

    def __init__(self, percent: int, counts: dict[int, tuple[int, float]], top: int):
        self.bands = bands(percent, top)
        self.low = np.array([b[0] for b in self.bands], dtype=np.int64)
        self.share = []
        for i, (lo, hi) in enumerate(self.bands):
            n, mean = counts.get(i, (0, 0.0))
            above = counts.get(i + 1, (0, 0.0))
            sets = n + above[0]
            size = (n * mean + above[0] * above[1]) / sets if sets else lo
            segments, two, spare = allocate(size, differ_most(hi, percent), sets)
            bounds = np.array([(j << 64) // segments for j in range(1, segments)], dtype=U)
            self.share.append((bounds, segments, two, spare))

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """All signatures of a sorted set: for its own band, and for the band below, where smaller partners index."""
        own = int(np.searchsorted(self.low, len(shingles), side="right")) - 1
        coded = mix(shingles, 3)
        sums = np.concatenate((np.zeros(1, U), np.cumsum(coded)))
        out = []
        for band in {own, max(own - 1, 0)}:
            bounds, segments, two, spare = self.share[band]
            at = np.concatenate(([0], np.searchsorted(shingles, bounds, side="left"), [len(shingles)]))
            part = sums[at[1:]] - sums[at[:-1]]
            label = mix(np.arange(segments, dtype=U), 1000 + band)
            full = mix(part ^ label)
            if spare:
                empty = at[1:] == at[:-1]
                empty[:two] = False
                if np.count_nonzero(empty) <= spare:
                    full = full[~empty]
            out.append(full)
            if two:
                end = at[two]
                segment = np.repeat(np.arange(two), np.diff(at[: two + 1]))
                out.append(mix((part[segment] - coded[:end]) ^ label[segment]))
        return np.unique(np.concatenate(out))


def _parities(s: np.ndarray, each: int = 8) -> bytes:
    """Whether each of 512 hash buckets, or ``each`` to twice as many per element, holds an odd number of elements: sets differ at least
    where these do, and by little more where they are many. The upper half of the buckets folds onto the lower one, so sets of
    other widths can be compared."""
    bits = min(max(9, (each * len(s) - 1).bit_length()), 20)
    odd = np.bincount(((s >> U(40)) & U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(par: bytes, eights: int) -> np.ndarray:
    """Parities folded to ``eights`` 64-bit numbers."""
    p = np.frombuffer(par, U)
    while len(p) > eights:
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    return p


def class_key(s: np.ndarray, salt: int) -> tuple[int, int, int]:
    """(key, two independent sums over the elements, which tell whether two sets of a key are one)."""
    one, other = mix(s, 11).sum(dtype=U), np.bitwise_xor.reduce(mix(s, 13))
    return int(mix(np.array([one ^ mix(np.array([other]), salt)[0]]), salt).view(np.int64)[0]), int(one.view(np.int64)), int(other.view(np.int64))


def _profile(k: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            key, par, fine = [(None, None, None)] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for row, words in documents(batch.column(1)):
                s = np.unique(shingle_hashes(words, k))
                n[row] = len(s)
                if len(s):
                    key[row], par[row], fine[row] = class_key(s, salt), _parities(s, 2), _parities(s)
            yield pa.record_batch([batch.column(0), pa.array(n), *(pa.array([x[i] for x in key], pa.int64()) for i in range(3)), pa.array(par, pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "n_shingles", "class", "fp1", "fp2", "par", "fine"])

    return run


def _elements(k: int, salt: int, parts: int, bits: int):
    """Elements of the watched part of the universe, cut to ``bits`` bits, of each block's sets: rows (part, block, values,
    owners), where an owner is a set's number in the block or -1 for several; and one row (block, classes, sizes) per block."""
    edges = np.array([(int(WATCHED * (1 << bits)) * j) // parts for j in range(1, parts)], dtype=U)
    shift, top = U(64 - bits), U(int(WATCHED * (1 << bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        count = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal count
            block = (TaskContext.get().partitionId() << 32) + count
            count += 1
            values = np.concatenate([v for _, v in held.values()])
            owner = np.repeat(np.arange(len(held)), [len(v) for _, v in held.values()])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            first = np.concatenate(([True], values[1:] != values[:-1]))[: len(values)]
            last = np.concatenate((first[1:], [True]))[: len(values)]
            owner = np.where(first & last, owner, -1)[first]
            values = values[first]
            cut = np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))
            some = np.flatnonzero(np.diff(cut))
            rows = [(int(p), block, pack(values[cut[p] : cut[p + 1]], True), pack(owner[cut[p] : cut[p + 1]])) for p in some]
            rows.append((None, block, pack(np.array(list(held), np.int64)), pack(np.array([n for n, _ in held.values()], np.int64))))
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "left", "right"])

        for batch in batches:
            for _, words in documents(batch.column(0)):
                if not len(words):
                    continue
                s = np.unique(shingle_hashes(words, k))
                if (key := class_key(s, salt)[0]) in held:
                    continue
                v = np.unique(s >> shift)
                held[key] = (len(s), v[v < top])
                size += len(held[key][1]) + 1
                if size >= BLOCK_BYTES // 8:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return run


def _lonely(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one range of the universe: the owners of values that one set alone holds, per block."""
    values = [unpack(x, True) for x in pdf["left"]]
    owner = np.concatenate([unpack(x) for x in pdf["right"]]).view(np.int64)
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    values = np.concatenate(values)
    order = np.argsort(values)
    new = np.concatenate(([True], values[order][1:] != values[order][:-1]))
    alone = order[new & np.concatenate((new[1:], [True]))]
    alone = np.sort(alone[owner[alone] >= 0])
    cut = np.searchsorted(row[alone], np.arange(len(pdf) + 1))
    return pd.DataFrame({"block": pdf["block"], "left": None, "right": [pack(owner[alone[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]})


def _linkable(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one block: the classes whose other elements may be enough for a link."""
        head = pdf[pdf["left"].notna()].iloc[0]
        classes, sizes = unpack(head["left"]).view(np.int64), unpack(head["right"]).view(np.int64)
        own = np.zeros(len(classes), np.int64)
        for x in pdf.loc[pdf["left"].isna(), "right"]:
            own += np.bincount(unpack(x).view(np.int64), minlength=len(classes))
        return pd.DataFrame({"class": classes[(sizes - own) * 100 >= sizes * percent]})

    return run


def _signatures(k: int, salt: int, plan: Plan, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sig = np.concatenate([s for s, _ in held])
            doc = np.repeat(np.array([d for _, d in held], np.int64), [len(s) for s, _ in held])
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            first = np.concatenate(([True], sig[1:] != sig[:-1]))
            alone = first & np.concatenate((first[1:], [True]))
            same = ~alone  # members of a subset that this block holds more than once
            yield pa.record_batch([pa.nulls(same.sum(), pa.int32()), pa.array(sig[same].view(np.int64)), pa.array(doc[same]), pa.nulls(same.sum(), pa.binary()), pa.nulls(same.sum(), pa.binary())], names=["part", "sig", "class", "sigs", "docs"])
            sig, doc = sig[first], doc[first]
            edge = np.searchsorted(sig, np.array([(j << 64) // parts for j in range(1, parts)], dtype=U))
            cut = np.concatenate(([0], edge, [len(sig)]))
            some = np.flatnonzero(np.diff(cut))
            yield pa.record_batch(
                [pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array([pack(sig[cut[i] : cut[i + 1]], True) for i in some], pa.binary()), pa.array([pack(doc[cut[i] : cut[i + 1]]) for i in some], pa.binary())],
                names=["part", "sig", "class", "sigs", "docs"],
            )

        size = 0
        for batch in batches:
            for _, words in documents(batch.column(0)):
                if not len(words):
                    continue
                s = np.unique(shingle_hashes(words, k))
                if (key := class_key(s, salt)[0]) in seen:
                    continue  # an equal set of this block stands for it
                seen.add(key)
                held.append((plan.of(s), key))
                size += len(held[-1][0])
                if size >= BLOCK_BYTES // 8:
                    yield from flush()
                    held.clear()
                    seen.clear()
                    size = 0
        yield from flush()

    return run


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: (signature, class) of signatures that come from two blocks or more."""
    sig = np.concatenate([unpack(x, True) for x in pdf["sigs"]]).view(np.int64)
    owner = np.concatenate([unpack(x) for x in pdf["docs"]]).view(np.int64)
    order = np.argsort(sig)
    sig, owner = sig[order], owner[order]
    new = np.concatenate(([True], sig[1:] != sig[:-1]))
    alone = new & np.concatenate((new[1:], [True]))
    return pd.DataFrame({"sig": sig[~alone], "class": owner[~alone]})


def _sets(k: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.unique(shingle_hashes(words, k)) for _, words in documents(batch.column(0))]
            got = [s for s in got if len(s)]
            yield pa.record_batch([pa.array([class_key(s, salt)[0] for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["class", "bytes"])

    return run


#: Counters of the sketch by which elements are ordered.
_SLOTS = 1 << 16


def _slots(s: np.ndarray) -> np.ndarray:
    return (mix(s, 17) >> U(48)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many elements of this task's sets fall on each counter."""
    n = np.zeros(_SLOTS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            n += np.bincount(_slots(np.frombuffer(x.as_buffer(), U)), minlength=_SLOTS)
    some = np.flatnonzero(n)
    yield pa.record_batch([pa.array(some), pa.array(n[some])], names=["slot", "n"])


def _first_elements(percent: int, counts: np.ndarray):
    """Of each set, the rarest elements: one more than a linked set can lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), U) for x in batch.column(1)]
            first = [s[np.lexsort((s, counts[_slots(s)]))][: len(s) - -(-percent * len(s) // 100) + 1].view(np.int64) for s in sets]
            if first:
                yield pa.record_batch([pa.array(np.concatenate(first)), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in first]))], names=["sig", "id"])

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of intersections of (left, right) packed sorted sets."""
    for batch in batches:
        both = np.zeros(batch.num_rows, np.int64)
        left, right = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            a, b = np.frombuffer(left[i].as_buffer(), U), np.frombuffer(right[i].as_buffer(), U)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both[i] = np.count_nonzero(b[at] == a)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(x.as_buffer()) // 8 for x in left]), pa.array([len(x.as_buffer()) // 8 for x in right]), pa.array(both)], names=["a", "b", "na", "nb", "both"])


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least Jaccard distance of (left, right) by their parities and sizes."""
    for batch in batches:
        n = np.array(batch.column(2)) + np.array(batch.column(3))
        apart = np.zeros(batch.num_rows)
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            x, y = x.as_buffer(), y.as_buffer()
            width = min(len(x), len(y)) // 8
            apart[i] = np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum(dtype=np.int64)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(2 * apart / (n + apart))], names=["a", "b", "least"])


class Join:
    """What the steps of one join share: the texts, the classes with one row each, and the settings."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, salt: int, percent: int, tmp: Scratch):
        self.docs, self.classes, self.k, self.salt, self.percent, self.tmp = docs, classes, k, salt, percent, tmp

    def texts(self, wanted: DataFrame) -> DataFrame:
        """Texts of rows with the representative ids of classes ``wanted(class)``; rows that repeat such an id come along."""
        reps = self.tmp(self.classes.join(wanted, "class", "left_semi").select("rep").distinct(), "representatives")
        return self.docs.join(small_side(reps), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``(class, bytes)``: the sorted elements of the classes of a written table ``wanted(class)``, written."""
        sets = self.texts(wanted).mapInArrow(_sets(self.k, self.salt), "class long, bytes binary").join(small_side(wanted), "class", "left_semi")
        return self.tmp(sets.groupBy("class").agg(F.max("bytes").alias("bytes")), "sets")

    def by_first_elements(self, members: DataFrame) -> DataFrame:
        """``members(id, size, comp)`` in buckets of their own: one for each element that is among the first of sets of several
        components. Linked members meet in at least one."""
        members = self.tmp(members.distinct(), "heavy")
        sets = self.sets(self.tmp(members.select(F.col("id").alias("class")), "wanted"))
        counts = np.zeros(_SLOTS, np.int64)
        for slot, n in sets.select("bytes").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():  # at most _SLOTS rows
            counts[slot] = n
        first = sets.mapInArrow(_first_elements(self.percent, counts), "sig long, id long").join(members, "id")
        first = self.tmp(first.select("sig", "id", "size", "comp", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")), "firsts")
        self.tmp.drop(sets)
        mixed = first.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).where("c0 <> c1").select("sig", "n")
        return first.join(mixed, "sig")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """``pairs(a, b)`` with bounds of their Jaccard distance (equal where whole sets were compared) and whether they link."""
        h = self.classes.select("class", "n_shingles", F.col("fine").alias("par"))
        wide = pairs.join(h.toDF("a", "na", "pa"), "a").join(h.toDF("b", "nb", "pb"), "b").select("a", "b", "na", "nb", "pa", "pb")
        bounded = self.tmp(wide.mapInArrow(_bound, "a long, b long, least double"), "bounded")
        near = F.col("least") <= 1 - self.percent / 100 + 1e-9
        pairs = bounded.where(near)
        wanted = self.tmp(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct(), "wanted")
        sets = self.sets(wanted)
        left = pairs.select("a", "b").join(sets.select(F.col("class").alias("a"), F.col("bytes").alias("left")), "a")
        full = left.join(sets.select(F.col("class").alias("b"), F.col("bytes").alias("right")), "b")
        got = full.select("a", "b", "left", "right").mapInArrow(_overlap, "a long, b long, na long, nb long, both long")
        union = F.col("na") + F.col("nb") - F.col("both")
        d = 1 - F.col("both") / union
        exact = got.select("a", "b", d.alias("lo"), d.alias("hi"), (F.col("both") * 100 >= union * self.percent).alias("linked"))
        far = bounded.where(~near).select("a", "b", F.col("least").alias("lo"), F.lit(1.0).alias("hi"), F.lit(False).alias("linked"))
        out = self.tmp(exact.union(far), "verified")
        self.tmp.drop(sets)
        self.tmp.drop(bounded)
        return out


#: Columns of a bucket's members, before their parities.
_MEMBER = "sig long, b0 int, b1 int, own int, id long, size long, comp long, lo double, hi double"


#: Columns that part groups of a bucket's members.
_GROUP = ("sig", "b0", "b1")
#: About how many elements the sets of one group may have together when they are compared in a task (32 MB).
GROUP_ELEMENTS = 4_000_000


def _across(percent: int, keys: tuple[str, ...] = _GROUP, exact: bool = False):
    """The members of each group that have any pair of different components whose bounds allow a link; or, ``exact``, links ``(a, b)``
    between components by the whole sets in ``bytes``: of links that join the same components one is enough, so a group has fewer links
    than members. Batches come sorted by ``keys``."""
    far = 1 - percent / 100 + 1e-9

    def arrays(rows: pa.Table) -> list[np.ndarray]:
        col = lambda c: rows.column(c).to_numpy()
        lo, hi = (np.nan_to_num(col(c).astype(float), nan=v) for c, v in (("lo", 0.0), ("hi", 1.0)))
        objects = lambda c: np.array([*rows.column(c).to_pylist(), None], dtype=object)[:-1]
        return [*(col(c) for c in ("own", "id", "size", "comp", "b0", "b1")), lo, hi, objects("par"), *([objects("bytes")] if exact else [])]

    def pairs(own, ids, size, comp, b0, b1, lo, hi, par) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        within = b0[0] == b1[0]
        left = np.arange(len(ids)) if within else np.flatnonzero(own == b0[0])
        right = left if within else np.flatnonzero(own == b1[0])
        if not len(left) or not len(right):
            return
        width = min(map(len, par)) // 8
        par = np.stack([_fold(p, width) for p in par])
        step = max(1, 2_000_000 // (width * len(right)))
        for at in range(0, len(left), step):
            x = left[at : at + step]
            ok = comp[x][:, None] != comp[right][None, :]
            ok &= np.minimum(size[x][:, None], size[right][None, :]) * 100 >= np.maximum(size[x][:, None], size[right][None, :]) * percent
            ok &= np.maximum(lo[x][:, None] - hi[right][None, :], lo[right][None, :] - hi[x][:, None]) <= far
            if not ok.any():
                continue
            odd = np.bitwise_count(par[x][:, None, :] ^ par[right][None, :, :]).sum(axis=2, dtype=np.int64)
            ok &= odd * (100 + percent) <= (size[x][:, None] + size[right][None, :]) * (100 - percent)
            i, j = np.nonzero(ok)
            i, j = x[i], right[j]
            if within:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j

    def members(rows: pa.Table, a: int, group: list[np.ndarray]) -> pa.RecordBatch | None:
        some = np.zeros(len(group[0]), bool)
        for i, j in pairs(*group):
            some[i] = some[j] = True
        return rows.take(pa.array(a + np.flatnonzero(some))).drop_columns(["par"]).combine_chunks().to_batches()[0] if some.any() else None

    def links(rows: pa.Table, a: int, group: list[np.ndarray]) -> pa.RecordBatch | None:
        *group, content = group
        flat, comp, found = None, np.unique(group[3], return_inverse=True)[1], []
        for left, right in pairs(*group):
            if flat is None:
                sets = [np.frombuffer(x, U) for x in content]
                size = np.array([len(x) for x in sets])
                start = np.cumsum(size) - size
                values, flat = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.zeros(len(values), bool)
            for i, js in zip(*_runs(left, right), strict=True):
                js = js[comp[js] != comp[i]]  # others were joined meanwhile
                if not len(js):
                    continue
                mine, n = flat[start[i] : start[i] + size[i]], size[js]
                ends = np.cumsum(n)
                mark[mine] = True
                both = np.add.reduceat(mark[flat[np.arange(ends[-1]) + np.repeat(start[js] - ends + n, n)]], ends - n, dtype=np.int64)
                mark[mine] = False
                for j in js[both * 100 >= (size[i] + n - both) * percent].tolist():
                    if comp[j] != comp[i]:
                        found.append((i, j))
                        comp[comp == comp[j]] = comp[i]
        if not found:
            return None
        i, j = group[1][np.array(found)].T
        return pa.record_batch([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    one = links if exact else members

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows = pa.concat_tables(held).combine_chunks()
            ids = np.stack([rows.column(c).to_numpy() for c in keys])
            cut = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            if len(cut):
                all_of = arrays(rows.slice(0, cut[-1]))
                for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                    if b - a > 1 and (got := one(rows, a, [x[a:b] for x in all_of])) is not None:
                        yield got
            held = [rows.slice(cut[-1] if len(cut) else 0)]  # the last bucket may go on
        if held and held[0].num_rows > 1 and (got := one(held[0], 0, arrays(held[0]))) is not None:
            yield got

    return run


def _runs(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Each left place with all right places that it meets."""
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    cut = np.flatnonzero(np.diff(left)) + 1
    return left[np.concatenate(([0], cut))].tolist(), np.split(right, cut)


def _profiled(docs: DataFrame, k: int, tmp: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Every row's size and class, one row per class with its smallest id and its parities, and the salt under which no two sets share a key."""
    for salt in range(100):
        prof = tmp(docs.mapInArrow(_profile(k, salt), "doc_id long, n_shingles long, class long, fp1 long, fp2 long, par binary, fine binary"), "profile")
        some = prof.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("par").alias("par"), F.max("fine").alias("fine"), *[f(c).alias(f"{c}_{n}") for c in ("n_shingles", "fp1", "fp2") for n, f in (("least", F.min), ("most", F.max))])
        classes = tmp(some, "classes")
        if classes.where("n_shingles_least <> n_shingles_most OR fp1_least <> fp1_most OR fp2_least <> fp2_most").isEmpty():
            rows = tmp(prof.select("doc_id", "n_shingles", "class"), "rows")
            tmp.drop(prof)
            return rows, classes, salt
    raise RuntimeError("class keys collide under every salt")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, part_rows: int = 1_000_000, bucket_rows: int = 4096) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``; see the module's text.

    ``bucket_rows``: how many members of a bucket meet in one group. ``part_rows``: about how many signatures one reducer
    sorts (16 bytes each, unpacked)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch() as tmp:
        prof, classes, salt = _profiled(docs, k, tmp)
        none = prof.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        top, elements = classes.agg(F.max("n_shingles"), F.sum("n_shingles")).first()
        if top is None:
            return stash(none, "result")
        names = tmp(classes.select("class", "rep"), "names")
        label = _components(Join(docs, classes, k, salt, percent, tmp), top, elements, part_rows, bucket_rows)
        # components by their smallest id
        named = names.join(label, F.col("class") == F.col("node"), "left").select("class", "rep", F.coalesce("component", "class").alias("c"))
        named = named.join(named.groupBy("c").agg(F.min("rep").alias("component_id")), "c").select("class", "component_id")
        return stash(prof.where("n_shingles > 0").join(named, "class").select("doc_id", "n_shingles", "component_id").union(none), "result")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, of which each component keeps one row: that with the smallest ``doc_id`` (null
    last; among equal ids any one). Rows without words stay. Each row counts by its own text, whatever its id."""
    rows = with_row_keys(docs)
    found = jaccard_components(rows.select(F.col(ROW).alias("doc_id"), "text"), **options).where("n_shingles > 0")
    groups = found.groupBy("component_id").count().where("count > 1").select("component_id")
    members = found.join(groups, "component_id", "left_semi").select(F.col("doc_id").alias(ROW), "component_id")
    ids = rows.select(ROW, F.col("doc_id").alias("__id"))
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col(ROW).alias("row"))
    members = stash(members.join(ids, ROW).select(ROW, "component_id", order.alias("order")), "members")
    first = members.groupBy("component_id").agg(F.min("order")["row"].alias(ROW)).select(ROW)
    more = stash(members.select(ROW).join(first, ROW, "left_anti"), "copies")
    return join_wide(rows, more, ROW, "left_anti").select(*docs.columns)


def _dealt(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Members of buckets of ``n``; where more than ``bucket_rows`` have one element among their rarest, the bucket falls into blocks
    of about that many, and each pair of blocks is a group of its own."""
    rows = rows.withColumn("blocks", F.expr(f"cast((n - 1) div {bucket_rows} AS int) + 1"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("b0", F.least("own", "other")).withColumn("b1", F.greatest("own", "other"))


def _linked(job: Join, close: DataFrame, spread: int) -> DataFrame:
    """``(a, b)``: links between components among members ``close`` (written), compared as whole sets inside the tasks, so that rows grow
    with members. Where a group's sets have more than ``GROUP_ELEMENTS``, it falls into parts, and each pair of parts is a group."""
    keys = (*_GROUP, "c0", "c1")
    parts = close.groupBy(*_GROUP).agg((F.floor(F.sum("size") / GROUP_ELEMENTS) + 1).cast("int").alias("parts"))
    rows = close.join(parts, list(_GROUP)).withColumn("at", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("c0", F.least("at", "other")).withColumn("c1", F.greatest("at", "other")).drop("parts", "at", "other")
    sets = job.sets(job.tmp(close.select(F.col("id").alias("class")).distinct(), "wanted"))
    fine = job.classes.select(F.col("class").alias("id"), F.col("fine").alias("par")).join(sets.withColumnRenamed("class", "id"), "id")
    met = rows.join(fine, "id").repartition(spread, *keys).sortWithinPartitions(*keys)
    out = job.tmp(met.select("sig", "b0", "b1", "own", "id", "size", "comp", "lo", "hi", "c0", "c1", "par", "bytes").mapInArrow(_across(job.percent, keys, True), "a long, b long").distinct(), "links")
    job.tmp.drop(sets)
    return out


def _components(job: Join, top: int, elements: int, part_rows: int, bucket_rows: int) -> DataFrame:
    """``(node, component)`` of the classes that link with others. Of the job's classes only those that may link are kept."""
    tmp, docs, percent = job.tmp, job.docs, job.percent
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    # values have six bits more than their number needs: few meet by chance, which only weakens the bound
    parts, bits = int(WATCHED * elements // part_rows) + 1, min(62, int(elements).bit_length() + 6)
    parts = max(parts, spread if elements > 1e6 else 1)
    raw = tmp(docs.select("text").mapInArrow(_elements(job.k, job.salt, parts, bits), "part int, block long, left binary, right binary"), "elements")
    lonely = raw.where("part IS NOT NULL").groupBy("part").applyInPandas(_lonely, "block long, left binary, right binary")
    heads = raw.where("part IS NULL").select("block", "left", "right")
    alive = tmp(heads.union(lonely).groupBy("block").applyInPandas(_linkable(percent), "class long").distinct(), "linkable")
    tmp.drop(raw)
    # the others' parities are neither shuffled nor kept any more
    classes = tmp(job.classes.join(small_side(alive), "class", "left_semi").select("class", "rep", "n_shingles", "par", "fine"), "living")
    tmp.drop(job.classes)
    job.classes = classes
    some = classes.select("class", F.col("n_shingles").alias("size"))

    low = [b[0] for b in bands(percent, top)]
    # bands are geometric: about 5 * ln(largest set) of them, whatever the number of rows
    numbered = F.aggregate(F.array(*[F.lit(x) for x in low]), F.lit(-1), lambda n, x: n + F.when(F.col("size") >= x, 1).otherwise(0))
    sizes = some.groupBy("size").count().withColumn("band", numbered)
    counts = {r[0]: (r[1], r[2] / r[1]) for r in sizes.groupBy("band").agg(F.sum("count"), F.sum(F.col("count") * F.col("size"))).collect()}
    plan = Plan(percent, counts, top)
    emitted = sum(n * (s[1] + s[2] * mean / s[1]) for i, (n, mean) in counts.items() for s in (plan.share[i], plan.share[max(i - 1, 0)]))
    parts = max(1, int(emitted // part_rows) + 1, spread if emitted > 1e6 else 1)

    raw = tmp(job.texts(alive).mapInArrow(_signatures(job.k, job.salt, plan, parts), "part int, sig long, class long, sigs binary, docs binary"), "signatures")
    within = raw.where("part IS NULL").select("sig", "class")
    across = raw.where("part IS NOT NULL").select("part", "sigs", "docs").groupBy("part").applyInPandas(_repeated, "sig long, class long")
    members = tmp(within.union(across).join(some, "class").select("sig", F.col("class").alias("id"), "size"), "members")
    tmp.drop(raw)

    pivots = members.groupBy("sig").agg(F.min("id").alias("pivot"), F.min_by("size", "id").alias("pivot_size"), F.max("id").alias("top"), F.max_by("size", "id").alias("top_size")).where("top > pivot")
    star = tmp(members.join(pivots, "sig").select("sig", "id", "size", "pivot", "pivot_size", "top", "top_size"), "stars")
    tmp.drop(members)
    fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    low = star.where("id <> pivot").where(fits(F.col("size"), F.col("pivot_size"))).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    high = star.where("id <> top").where(fits(F.col("size"), F.col("top_size"))).select(F.col("id").alias("a"), F.col("top").alias("b"))
    first = job.verify(low.union(high).distinct())
    edges = first.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    label = tmp.keep(connected_components(edges))

    far = first.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "lo", "hi")
    seen = star.join(far, ["pivot", "id"], "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    seen = seen.select("sig", "id", "size", F.coalesce("component", "id").alias("comp"), *[F.when(F.col("id") == F.col("pivot"), 0.0).otherwise(F.col(c)).alias(c) for c in ("lo", "hi")])
    mixed = seen.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("id").alias("pivot"), F.count("*").alias("n")).where("c0 <> c1").select("sig", "pivot", "n")
    left_over = seen.join(mixed, "sig").where("id <> pivot").drop("pivot")
    # first by few parities, then what is left by many
    columns = [x.split()[0] for x in _MEMBER.split(", ")]
    typed = lambda rows: rows.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in _MEMBER.split(", "))])
    met = lambda rows, par: rows.join(classes.select(F.col("class").alias("id"), F.col(par).alias("par")), "id").select(*columns, "par").repartition(spread, *_GROUP).sortWithinPartitions(*_GROUP)
    whole = left_over.where(F.col("n") <= bucket_rows).withColumns({c: F.lit(0) for c in ("b0", "b1", "own")})
    heavy = left_over.where(F.col("n") > bucket_rows).withColumns({c: F.lit(-1) for c in ("b0", "b1", "own")})
    near = tmp(met(typed(whole), "par").mapInArrow(_across(percent), _MEMBER).union(typed(heavy)), "near")
    heavy, near = near.where("b0 < 0"), near.where("b0 >= 0")
    if not heavy.isEmpty():
        again = typed(_dealt(job.by_first_elements(heavy.select("id", "size", "comp")), bucket_rows))
        near = near.union(tmp(met(again, "par").mapInArrow(_across(percent), _MEMBER), "near"))
    close = tmp(met(near, "fine").mapInArrow(_across(percent), _MEMBER), "close")
    if not close.isEmpty():
        second = _linked(job, close, spread)
        label = tmp.keep(connected_components(edges.union(second.select(F.col("a").alias("src"), F.col("b").alias("dst")))))
    return label
