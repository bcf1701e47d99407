"""Spelling variants: words at one edit from each other, by forward and backward minimal acyclic automata.

1. ``count_words``: runs of letters of all texts, each with its own seeded deletion, counted per block before they are shuffled.
2. ``near_words``: one edit leaves one half of a word as it is. With ``s`` the length of the shorter of two words and ``h = s // 2``, they
   share their first ``h`` code points or their last ``s - h``. So each word goes, for each ``s`` it can have with a neighbour, to the
   bucket of its first half (a forward automaton of the bucket's words, read from the left) and to that of its last half (a backward
   automaton, of reversed words). There the half is walked exactly and the rest completed with exactly one error. Buckets are dealt
   to shards; a shard holds one automaton. Arcs carry how many words lie before them, so a path adds up to the word's number
   (a minimal perfect hash), by which the same word found along several paths is one. A pair that shares both halves is
   left to the forward automaton. A bucket of more than ``shard_words`` words is cut into automata of that many; all its words
   are sought in each.
3. ``variant_groups``: each word's near words are summed per shard, then over shards; its form is the near word of largest count,
   if that is ``ratio`` times its own. Roots follow forms by doubling, in rounds of joins.

Defined cases: null and empty texts have no words; a null id draws as an empty number; rows that repeat an id or a text are counted each; ties
of counts go to the smaller word in code-point order; a very long run is a word like any other; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_side, stash, unstash
from .textkit import _LOWER, buffers, eights, give_back, slices, span_hashes

_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
#: U+00C0 to U+00FF are this byte and one more in UTF-8.
_LEAD = 0xC3
#: Polynomial of the CRC-32 of zlib, bits reversed.
_POLYNOMIAL = 0xEDB88320
#: Longer runs (in bytes) are hashed one by one.
_LONG = 64
#: Words sought at a time, and the place in a word from which searches that meet are one.
QUERIES, LONG_WORD = 20_000, 40


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_CRC = _crc_table()


def _crcs(prefixes: list[bytes], doc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each document's prefix and the bytes ``starts .. ends``: all spans move on together, byte by byte."""
    own = np.array([zlib.crc32(p) for p in prefixes], np.uint32)[doc]
    size = ends - starts
    order = np.argsort(-np.minimum(size, _LONG), kind="stable")
    at, left = starts[order], np.minimum(size, _LONG)[order]
    state = ~own[order]
    short = np.count_nonzero(left == _LONG)  # those before are hashed one by one
    for k in range(_LONG):
        a, b = short, int(np.searchsorted(-left, -k, side="left"))
        if b <= a:
            break
        state[a:b] = _CRC[(state[a:b] ^ data[at[a:b] + k]) & 0xFF] ^ (state[a:b] >> 8)
    out = np.empty(len(size), np.uint32)
    out[order] = ~state
    for k in order[:short]:
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(own[k]))
    return out


def _slice_words(ids: list, raw: np.ndarray, offsets: np.ndarray, one_in: int, least: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of some documents after their deletions, and their counts."""
    base = int(offsets[0])
    data, offsets = _LOWER[raw[base : int(offsets[-1])]], offsets - base
    letter = _ASCII[data] | (data == _LEAD)
    letter[1:] |= data[:-1] == _LEAD
    before = np.concatenate(([False], letter[:-1]))[: len(letter)]
    before[offsets[offsets < len(data)]] = False
    starts = np.flatnonzero(letter & ~before)
    after = np.concatenate((letter[1:], [False]))[: len(letter)]
    after[offsets[(offsets > 0) & (offsets <= len(data))] - 1] = False
    ends = np.flatnonzero(letter & ~after) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    h = _crcs([f"{'' if x is None else x}:".encode() for x in ids], doc, data, starts, ends)
    heads = np.concatenate(([0], np.cumsum(letter & ((data & 0xC0) != 0x80))))  # code points of words before each byte
    points = heads[ends] - heads[starts]
    hit = np.flatnonzero(h % one_in == 0)
    kept = letter.copy()
    if len(hit):
        places = np.flatnonzero(letter & ((data & 0xC0) != 0x80))
        gone = places[heads[starts[hit]] + (h[hit] % points[hit]).astype(np.int64)]
        kept[gone] = False
        kept[gone[data[gone] == _LEAD] + 1] = False
        points[hit] -= 1
    moved = np.concatenate(([0], np.cumsum(kept)))
    data, starts, ends = data[kept], moved[starts], moved[ends]
    long = points >= least
    starts, ends = starts[long], ends[long]
    wide = eights(data)
    one, two = span_hashes(wide, starts, ends, 51), span_hashes(wide, starts, ends, 53)
    order = np.lexsort((two, one))
    new = np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))[: len(order)]
    first = np.flatnonzero(new)
    some = order[first]
    counts = np.diff(np.append(first, len(order)))
    text = data.tobytes()
    return pa.array([text[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], pa.string()), counts


def _count(one_in: int, least: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                words, counts = _slice_words(ids[i:j], raw, offsets[i : j + 1], one_in, least)
                held.append(pa.table({"word": words, "n": pa.array(counts)}))
                size += len(words)
                if size > block:
                    merged = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
                    if merged.num_rows > block // 2:  # else the block may grow on
                        yield from merged.to_batches()
                        merged = merged.slice(0, 0)
                    held, size = [merged], merged.num_rows
            give_back()
        if size:
            yield from pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    return run


class Automaton:
    """A minimal acyclic automaton of sorted words (sequences of small numbers), as arrays; see ``number``.

    State ``q`` has the arcs ``start[q] .. start[q + 1]``, ascending by label; ``target`` is where an arc leads, ``skip`` how many words
    come before those that go through it, of all that continue from its state."""

    def __init__(self, words: list[tuple[int, ...]]):
        # words are added in order; what the next word leaves behind is final, and is merged with an equal state if there is one
        register: dict[tuple, int] = {}
        self._arcs: list[tuple] = []
        path: list[list] = [[False, []]]  # open states along the last word: final, arcs (label, target)
        last: tuple[int, ...] = ()

        def close(state: list) -> int:
            key = (state[0], *[x for arc in state[1] for x in arc])
            if (known := register.get(key)) is None:
                known = register[key] = len(self._arcs)
                self._arcs.append((state[0], state[1]))
            return known

        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            for k in range(len(last), same, -1):
                path[k - 1][1].append((last[k - 1], close(path.pop())))
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        for k in range(len(last), 0, -1):
            path[k - 1][1].append((last[k - 1], close(path.pop())))
        self.root = close(path[0])
        self.final = np.array([f for f, _ in self._arcs], bool)
        self.start = np.concatenate(([0], np.cumsum([len(a) for _, a in self._arcs])))
        self.label = np.array([x for _, a in self._arcs for x, _ in a], np.int64)
        self.target = np.array([x for _, a in self._arcs for _, x in a], np.int64)
        # targets come before the states that lead to them
        words_from, skip = [0] * len(self._arcs), []
        for q, (final, arcs) in enumerate(self._arcs):
            n = int(final)
            for _, to in arcs:
                skip.append(n)
                n += words_from[to]
            words_from[q] = n
        self.skip, self.size = np.array(skip, np.int64), words_from[self.root]
        self.labels = int(self.label.max(initial=0)) + 1
        self._code = np.repeat(np.arange(len(self._arcs)), np.diff(self.start)) * self.labels + self.label
        del self._arcs

    def step(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The arcs that read ``label`` from each state, -1 where there is none."""
        code = state * self.labels + label
        at = np.searchsorted(self._code, code)
        at[at == len(self._code)] = 0
        ok = (label < self.labels) & (self._code[at] == code) if len(self._code) else np.zeros(len(state), bool)
        return np.where(ok, at, -1)

    def number(self, word: tuple[int, ...]) -> int:
        """The word's place among all, -1 if it isn't one of them."""
        q, n = self.root, 0
        for x in word:
            arc = int(self.step(np.array([q]), np.array([x]))[0])
            if arc < 0:
                return -1
            q, n = int(self.target[arc]), n + int(self.skip[arc])
        return n if self.final[q] else -1

    def fan(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of the states: which of ``state``, and the arc."""
        many = self.start[state + 1] - self.start[state]
        row = np.repeat(np.arange(len(state)), many)
        return row, self.start[state][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def one_error(automaton: Automaton, labels: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exact: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word number) of all words of the automaton that share each query's first ``exact`` labels and differ by one replaced or
    one more label (by one label less for queries marked ``shorter``) after them. Queries lie at ``starts`` in ``labels``; all move on together."""
    q = np.arange(len(starts))
    state, number = np.full(len(q), automaton.root), np.zeros(len(q), np.int64)
    wrong = [np.zeros(0, np.int64)] * 4  # query, next place, state, number: one error behind them
    found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    for place in range(int(sizes.max(initial=0)) + 1):
        read = labels[np.minimum(starts[q] + place, len(labels) - 1)]
        free = place >= exact[q]
        if free.any():
            row, arc = automaton.fan(state[free])
            who, at = q[free][row], number[free][row]
            same = (automaton.label[arc] == read[free][row]) | (place == sizes[who])
            more = ~shorter[who]
            swap = more & ~same
            less = free & shorter[q] & (place < sizes[q])
            wrong = [np.concatenate(x) for x in zip(
                wrong,
                (who[swap], np.full(swap.sum(), place + 1), automaton.target[arc[swap]], at[swap] + automaton.skip[arc[swap]]),  # replaced
                (who[more], np.full(more.sum(), place), automaton.target[arc[more]], at[more] + automaton.skip[arc[more]]),  # one more
                (q[less], np.full(less.sum(), place + 1), state[less], number[less]),  # one less
                strict=True,
            )]
            if place >= LONG_WORD:  # in long words of few letters, most errors lead to the same place
                wrong = list(np.unique(np.stack(wrong), axis=1))
        wrong, done = _advance(automaton, labels, starts, sizes, place, wrong)
        found.append(done)
        go = place < sizes[q]
        arc = automaton.step(state[go], read[go])
        ok = arc >= 0
        q, number, state = q[go][ok], number[go][ok] + automaton.skip[arc[ok]], automaton.target[arc[ok]]
        if not len(q) and not len(wrong[0]):
            break
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


def _advance(automaton: Automaton, labels: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: int, wrong: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Those whose error lies behind them read their label at ``place``, and end where there is no arc; also those that are words."""
    now = wrong[1] == place
    wait, (q, _, state, number) = [x[~now] for x in wrong], [x[now] for x in wrong]
    end = place == sizes[q]
    full = end & automaton.final[state]
    done = np.stack((q[full], number[full]))
    q, state, number = q[~end], state[~end], number[~end]
    arc = automaton.step(state, labels[starts[q] + place])
    ok = arc >= 0
    arc = arc[ok]
    read = [q[ok], np.full(len(arc), place + 1), automaton.target[arc], number[ok] + automaton.skip[arc]]
    return [np.concatenate(x) for x in zip(wait, read, strict=True)], done


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: each word's near words in it, as their number and the one of largest count."""
    backward = bool(pdf["backward"].iloc[0])
    names = np.sort(np.array(pdf["word"].unique(), object))  # Python orders strings by code points
    name_of = {w: i for i, w in enumerate(names)}
    ids = pdf["word"].map(name_of).to_numpy()
    weight = np.zeros(len(names), np.int64)
    weight[ids] = pdf["n"].to_numpy()
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in names]
    alphabet, flat = np.unique(np.concatenate(points), return_inverse=True)
    size = np.array([len(p) for p in points])
    begin = np.cumsum(size) - size
    turn = -1 if backward else 1
    words = [tuple(flat[b : b + n][::turn].tolist()) for b, n in zip(begin, size, strict=True)]
    member = np.unique(ids[pdf["member"].to_numpy()])
    order = sorted(member.tolist(), key=words.__getitem__)
    if not order:
        return pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []})
    automaton, ranked = Automaton([words[i] for i in order]), np.array(order)
    # each query is a word with the length of the shorter of a pair
    asked = pdf[["word", "s"]].assign(id=ids).drop_duplicates(["id", "s"])
    query, s = asked["id"].to_numpy(), asked["s"].to_numpy()
    half = s // 2
    labels = np.concatenate([np.array(w, np.int64) for w in words])
    hits = []
    for a in range(0, len(query), QUERIES):
        x, length = query[a : a + QUERIES], s[a : a + QUERIES]
        h = half[a : a + QUERIES]
        got, number = one_error(automaton, labels, begin[x], size[x], length - h if backward else h, length < size[x])
        if backward:  # pairs that share their first half, too, are the forward automaton's
            left, right = x[got], ranked[number]
            open_ = np.ones(len(got), bool)
            for k in range(int(h.max(initial=0))):
                open_ &= (k >= h[got]) | (flat[np.minimum(begin[left] + k, len(flat) - 1)] == flat[np.minimum(begin[right] + k, len(flat) - 1)])
                if not open_.any():
                    break
            got, number = got[~open_], number[~open_]
        hits.append(np.stack((x[got], ranked[number])))
    who, near = np.concatenate([np.zeros((2, 0), np.int64), *hits], axis=1)
    # names are in code-point order, so the smaller id is the smaller word
    order = np.lexsort((near, -weight[near], who))
    who, near = who[order], near[order]
    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))[: len(who)])
    return pd.DataFrame({"word": names[who[first]], "n_near": np.diff(np.append(first, len(who))), "best_n": weight[near[first]], "best": names[near[first]]})


def count_words(docs: DataFrame, one_in: int = 31, least: int = 7, block: int = 1 << 19) -> DataFrame:
    """``(word, n)``: how often each word of ``least`` code points or more occurs in ``docs(doc_id, text)`` after deletions. Of one in ``one_in``
    pairs of id and run, drawn by their checksum, a code point is deleted. ``block``: words that a task holds before it sends them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_count(one_in, least, block), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame, shard_words: int = 50_000) -> DataFrame:
    """``(word, n_near, best_n, best)`` for the words of ``words(word, n)`` that have others at one edit; words of fewer than four code points
    take no part. ``words`` is to be written, as it is read twice."""
    spark = words.sparkSession
    with Scratch() as tmp:
        size = F.length("word")
        lengths = F.filter(F.array(size, size - 1), lambda s: s >= 4)
        spot = words.where(size >= 4).select("word", "n", F.explode(lengths).alias("s"))
        spot = spot.select("word", "n", "s", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"))
        half = F.when(F.col("backward"), F.expr("right(word, s - s div 2)")).otherwise(F.expr("left(word, cast(s div 2 AS int))"))
        spot = tmp(spot.withColumn("bucket", F.xxhash64("s", half)), "spelling-buckets")
        large = tmp(spot.groupBy("backward", "bucket").count().where(F.col("count") > shard_words).select("backward", "bucket", F.ceil(F.col("count") / shard_words).cast("int").alias("cuts")), "large-buckets")
        spot = spot.join(small_side(large), ["backward", "bucket"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        spot = spot.withColumn("own", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + 2 * words.count() // shard_words)
        shard = F.pmod(F.xxhash64("bucket", "cut"), F.lit(shards))
        # the automata of a bucket that is cut hold nothing else, so that no word lies in two of them
        alone = F.when(F.col("cuts") > 1, F.col("bucket"))
        dealt = spot.select("backward", shard.alias("shard"), alone.alias("alone"), "cut", "word", "n", "s", (F.col("own") == F.col("cut")).alias("member"))
        parts = dealt.groupBy("backward", "shard", "alone", "cut").applyInPandas(_shard, "word string, n_near long, best_n long, best string")
        return stash(parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), F.min_by("best", F.struct(-F.col("best_n"), F.col("best"))).alias("best")), "near-words")


def follow(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(word, root, moved)`` for each row of ``forms(word, form)``: the end of its chain of forms. Chains have no circles, as counts grow along them;
    each round doubles how far a root looks."""
    now = stash(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    for _ in range(max_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stash(now.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        still = not after.where("moved").isEmpty()
        unstash(now)
        now = after
        if not still:
            return now
    raise RuntimeError(f"roots not settled after {max_rounds} rounds")


def variant_groups(docs: DataFrame, one_in: int = 31, least: int = 7, seen: int = 2, ratio: int = 10, shard_words: int = 50_000) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``count_words`` that occurs ``seen`` times or more."""
    with Scratch() as tmp:
        words = tmp(count_words(docs, one_in, least).where(F.col("n") >= seen), "words")
        near = tmp.keep(near_words(words, shard_words))
        sure = F.col("best_n") >= ratio * F.col("n")
        full = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(sure, F.col("best")).alias("form"), F.when(sure, F.col("best_n")).alias("form_n"))
        full = tmp(full, "forms")
        roots = tmp.keep(follow(full.where("form IS NOT NULL").select("word", "form")))
        return stash(full.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
