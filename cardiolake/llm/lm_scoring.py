"""Language-model scoring with a weighted backoff automaton, built and applied block by block.

Model: word trigrams, smoothed by Dirichlet priors (MacKay and Peto, 1995) over bigrams, and those over a discounted unigram
distribution. ``p1(w) = (c(w) - d) / N`` for known words and ``d * V / N`` for the class of unknown ones, ``d = n1 / (n1 + 2 * n2)``;
``p2(w | v) = (c(v w) + priors[0] * p1(w)) / (c(v) + priors[0])``; ``p3(w | u v) = (c(u v w) + priors[1] * p2(w | v)) / (c(u v) + priors[1])``.

Automaton: the empty history, each known word and each bigram of the training texts are states. A counted n-gram is an arc from
the state of its history to the state of its last two words, of weight ``log10 p``. Every state but the empty one has a failure
arc to the state of its history without the first word, of weight ``log10(prior / (c(history) + prior))``; the empty state has an
arc for every word (unknown ones lead back to it). One left-to-right traversal per text carries the state, follows failure arcs
until the next word has an arc, and adds up the weights.

The model never sits in one process. Texts are packed into blocks; a block asks for the counts of its distinct n-grams,
grouped by hash range; each range sums the training counts and answers every block that asked; the answers meet the
blocks again and make the part of the automaton that the block's texts can reach. Work and traffic per task depend on block and range sizes only, whatever the corpus' size: a frequent
n-gram is asked for once per block, and ranges are cut so that all of them hold about as many n-grams. Words are told apart by 64-bit
hashes, longer n-grams by hashes of 48 bits, or 20 more than their number needs (fewer than one in a million meets another one).

Defined cases: null text is empty and has only the end token; an empty table gives an empty result; without training
documents ``N`` is 0 and the score equals the base score; rows that repeat a document each get a row; a very long text is a
block of its own; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import Scratch, stash
from .textkit import U, buffers, mix, pack, slices, unpack, word_hashes

END = U(0x5851F42D4C957F2D)
#: Tokens whose arcs are Python numbers at a time.
RUN = 1 << 16
#: No arc (weights are logarithms of probabilities).
NONE = 1.0


def _blocks(block_bytes: int):
    """Packs documents into rows: ids, training marks and whole texts of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, train = batch.column(0), batch.column(2)
            raw, offsets = buffers(batch.column(1))
            for i, j in slices(offsets, block_bytes):
                text = zstandard.ZstdCompressor(level=1).compress(raw[offsets[i] : offsets[j]].tobytes())
                yield pa.record_batch([pa.array([(task << 32) + count]), pa.array([ids[i:j].to_pylist()], pa.list_(pa.int64())), pa.array([train[i:j].to_pylist()], pa.list_(pa.bool_())), pa.array([(offsets[i : j + 1] - offsets[i]).tolist()], pa.list_(pa.int64())), pa.array([text], pa.binary())], names=["block", "ids", "train", "offsets", "text"])
                count += 1

    return run


def _tokens(text: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents of a block, each with its end token, and where documents start."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
    found, starts = [], [0]
    for i, j in slices(offsets):
        h, first = word_hashes(raw, offsets[i : j + 1])
        sizes = np.diff(first)
        out = np.full(len(h) + j - i, END, U)
        ends = np.cumsum(sizes + 1) - 1
        mask = np.ones(len(out), bool)
        mask[ends] = False
        out[mask] = h
        found.append(out)
        starts.extend((ends + 1 + starts[-1]).tolist())
    return np.concatenate(found), np.array(starts)


class Grams:
    """Distinct n-grams of a block, ascending by hash; ``at[n]`` has the place of the n-gram that ends at each token. Tokens with
    too short a history have the n-gram 0, which counts nothing."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, bits: int):
        first = np.zeros(len(tokens), bool)
        first[starts[:-1]] = True
        two, three = np.zeros(len(tokens), U), np.zeros(len(tokens), U)
        two[1:] = mix(tokens[:-1] * U(0xA0761D6478BD642F) + tokens[1:], 2) >> U(64 - bits)
        two[first] = 0
        three[2:] = mix(mix(tokens[:-2] * U(0xE7037ED1A0B428DB) + tokens[1:-1], 3) * U(0xA0761D6478BD642F) + tokens[2:], 4) >> U(64 - bits)
        three[first] = 0
        three[1:][first[:-1]] = 0
        self.values, self.at, self.where = {}, {}, {}
        for n, x in ((1, tokens), (2, two), (3, three)):
            self.values[n], self.where[n], self.at[n] = np.unique(x, return_index=True, return_inverse=True)


def _ask(parts: int, bits: int):
    edges = {n: np.array([((1 << (64 if n == 1 else bits)) * j) // parts for j in range(1, parts)], dtype=U) for n in (1, 2, 3)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, starts = _tokens(row["text"], np.array(row["offsets"]))
                train = np.repeat(np.array(row["train"], bool), np.diff(starts))
                rows = []
                grams = Grams(tokens, starts, bits)
                for n, values in grams.values.items():
                    counts = np.bincount(grams.at[n][train], minlength=len(values)).astype(np.int64)
                    if n > 1:
                        counts[values == 0] = 0
                    cut = np.concatenate(([0], np.searchsorted(values, edges[n]), [len(values)]))
                    rows += [(p * 3 + n - 1, row["block"], n, pack(values[a:b], True), pack(counts[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "block", "ngram", "grams", "counts"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: every block's n-grams with their counts over all training texts, and sums for the model."""
    grams = [unpack(x, True) for x in pdf["grams"]]
    counts = np.concatenate([unpack(x) for x in pdf["counts"]]).view(np.int64)
    sizes = [len(g) for g in grams]
    allg = np.concatenate(grams)
    del grams
    order = np.argsort(allg, kind="stable")
    ranked = allg[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    group = np.cumsum(new) - 1
    totals = np.bincount(group, weights=counts[order]).astype(np.int64)
    out = np.empty(len(allg), np.int64)
    out[order] = totals[group]
    cuts = np.cumsum([0, *sizes])
    seen = totals[totals > 0]
    facts = [seen.sum(), len(seen), (seen == 1).sum(), (seen == 2).sum()]
    return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "ngram": pdf["ngram"], "totals": [pack(out[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], "facts": [facts if i == 0 else None for i in range(len(pdf))]})


class Automaton:
    """The states and arcs that a block's texts can reach, as arrays over the block's n-grams.

    A state is a history: a bigram, a word or nothing. ``arc[n]`` has, per n-gram, the weight of the arc from the state of its
    first ``n - 1`` words that reads its last word (``NONE`` without such an arc); ``fail[n]`` the weight of the failure arc of the state
    that an n-gram is, to the state without its first word; ``after[n]`` the length of the history that the arc leads to."""

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], n: int, v: int, discount: float, priors: tuple[float, float]):
        c1, c2, c3 = counts[1], counts[2], counts[3]
        self.at, word, pair, at2, at3 = grams.at, grams.at[1], grams.at[2], grams.where[2], grams.where[3]
        p1 = np.where(c1 > 0, (c1 - discount) / n, discount * v / n)
        p2 = (c2 + priors[0] * p1[word[at2]]) / (c1[word[at2 - 1]] + priors[0])
        p3 = (c3 + priors[1] * p2[pair[at3]]) / (c2[pair[at3 - 1]] + priors[1])
        self.arc = {1: np.log10(p1), 2: np.where(c2 > 0, np.log10(p2), NONE), 3: np.where(c3 > 0, np.log10(p3), NONE)}
        self.fail = {1: np.log10(priors[0] / (c1 + priors[0])), 2: np.log10(priors[1] / (c2 + priors[1]))}
        # the end has no history after it; an unknown word leads back to nothing
        open_ = grams.values[1] != END
        self.after = {1: ((c1 > 0) & open_).astype(np.int8), 2: np.where(open_[word[at2]], 2, 0).astype(np.int8)}

    def traverse(self, starts: np.ndarray) -> np.ndarray:
        """Sum of the weights along each document's path, from left to right; ``state`` is the length of the history."""
        scores, total, state, doc = [], 0.0, 0, 1
        stops = starts.tolist()
        for a in range(0, stops[-1], RUN):
            b = min(a + RUN, stops[-1])
            one, two, three = (self.at[n][a:b] for n in (1, 2, 3))
            before = [np.concatenate((x[a - 1 : a] if a else x[:1], x[a : b - 1])) for x in (self.at[1], self.at[2])]
            steps = [x.tolist() for x in (self.arc[3][three], self.fail[2][before[1]], self.arc[2][two], self.after[2][two], self.fail[1][before[0]], self.arc[1][one], self.after[1][one])]
            at = a
            while at < b:
                stop = min(stops[doc], b)
                for three, fail2, two, after2, fail1, one, after1 in zip(*(x[at - a : stop - a] for x in steps)):
                    if state == 2:
                        if three <= 0:
                            total += three
                            state = after2
                            continue
                        total += fail2
                        state = 1
                    if state == 1:
                        if two <= 0:
                            total += two
                            state = after2
                            continue
                        total += fail1
                    total += one
                    state = after1
                if stop == stops[doc]:
                    scores.append(total)
                    total, state, doc = 0.0, 0, doc + 1
                at = stop
        return np.array(scores)


def _score(n: int, v: int, n1: int, n2: int, priors: tuple[float, float], bits: int):
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    base_unit = n + v + 1

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        tokens, starts = _tokens(row["text"], np.array(row["offsets"]))
        answers = answers.sort_values("part")
        grams = Grams(tokens, starts, bits)
        got = {k: np.concatenate([unpack(x) for x in answers.loc[answers["ngram"] == k, "totals"]]).view(np.int64) for k in (1, 2, 3)}
        c = got[1][grams.at[1]]
        base = np.log10((c + 1) / base_unit)
        add = lambda x: np.add.reduceat(x.astype(float), starts[:-1])
        score = Automaton(grams, got, n, v, discount, priors).traverse(starts) if n else add(base)
        sizes = np.diff(starts)
        return pd.DataFrame({"doc_id": pd.array(row["ids"], dtype="Int64"), "held_out": ~np.array(row["train"], bool), "n_tokens": sizes, "n_known": add(c > 0).astype(np.int64), "train_tokens": n, "base_score": add(base), "score": score})

    return run


def score_documents(docs: DataFrame, train: str, priors: tuple[float, float] = (400.0, 5.0), block_bytes: int = 2 << 20, part_grams: int = 400_000) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs(doc_id, text)``.

    ``train``: SQL condition that picks the training rows. ``base_score`` sums ``log10((c + 1) / (N + V + 1))``. ``priors``: of
    bigrams and trigrams (the best of a few on held-out text). ``block_bytes``: text per block. ``part_grams``: about how many
    n-grams of one length a range answers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    with Scratch() as tmp:
        blocks = tmp(rows.mapInArrow(_blocks(block_bytes), "block long, ids array<long>, train array<boolean>, offsets array<long>, text binary"), "blocks")
        total = blocks.agg(F.sum(F.element_at("offsets", -1))).first()[0] or 0
        # words are about six bytes long
        parts, bits = int(total / 6 // part_grams) + 1, min(64, max(48, 20 + int(total / 6).bit_length()))
        asked = blocks.select("block", "train", "offsets", "text").mapInArrow(_ask(parts, bits), "part int, block long, ngram int, grams binary, counts binary")
        answers = tmp(asked.groupBy("part").applyInPandas(_answer, "block long, part int, ngram int, totals binary, facts array<long>"), "answers")
        facts = answers.where("ngram = 1 AND facts IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("facts")[i]), F.lit(0)) for i in range(4)]).first()
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        right = answers.select("block", "part", "ngram", "totals").groupBy("block")
        return stash(blocks.groupBy("block").cogroup(right).applyInPandas(_score(*[int(x) for x in facts], priors, bits), schema), "scores")
