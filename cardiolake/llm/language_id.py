"""Language identification by nearest clustered centroid over TF-IDF byte n-gram vectors.

Every whole text becomes counts of its letter n-grams (runs of 1 to 3 UTF-8 bytes inside words, lower-cased, hashed to
``dims`` buckets), damped by log, weighted by inverse document frequency and scaled to length 1. Document frequencies
come from all training rows. Per language, spherical k-means on a bounded sample (``sample`` rows of each language, the
ones with the smallest hash of their id) gives up to ``clusters`` centroids. A text takes the language of the centroid
with the largest cosine; ties go to the first language by code point. A text is rejected when its cosine falls below
``slack`` times a low quantile of the cosines that texts of its length class (binary logarithm of the number of n-grams)
have with centroids of their language that were fitted without them (four folds of the sample). Limits go by length and
language: where a language has under ``OWN`` texts of a class, all languages count, with shorter texts until ``ENOUGH``.

Defined cases: null text or text without a letter gives ``und``, score 0, rejected; without training rows every text
is ``und``; an empty table gives an empty result; repeated rows and further columns don't matter. ``max_langs`` bounds
what is broadcast (``max_langs * clusters * dims`` floats); more languages raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import PIECE, buffers, pieces, slices

UND = "und"
LENGTHS = 40
FOLDS = 4
#: A language's own texts of a class that set its limit; texts that set one in common; the share of them that lies below.
OWN, ENOUGH, QUANTILE = 100, 20, 0.01


def size_class(grams: np.ndarray) -> np.ndarray:
    """Class of a text by the binary logarithm of its number of n-grams."""
    return np.log2(grams + 1).astype(np.int64)


def _fold() -> np.ndarray:
    table = np.zeros(256, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_FOLD = _fold()


def gram_counts(raw: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """(documents, dims) counts of hashed n-grams; anything but letters parts words. A very long text goes piece by piece:
    pieces begin with white space, and no n-gram crosses that."""
    if len(offsets) == 2 and offsets[1] - offsets[0] > 2 * PIECE:
        own = raw[int(offsets[0]) : int(offsets[1])]
        return sum(_gram_counts(own[a:b], np.array([0, b - a]), dims) for a, b in pieces(own))
    return _gram_counts(raw, offsets, dims)


def _gram_counts(raw: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    base = int(offsets[0])
    data, offsets = _FOLD[raw[base : int(offsets[-1])]], offsets - base
    n = len(offsets) - 1
    # accented capitals of the Latin-1 block (0xC3 0x80-0x9E) fold to their small letters
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        data[1:][capital] += 0x20
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    out = np.zeros(n * dims, np.int64)
    h = np.zeros(len(data), np.uint32)
    whole = np.ones(len(data), bool)
    for k in range(3):
        m = len(data) - k
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) ^ data[k:]
        whole = whole[:m] & (data[k:] > 0)
        same = doc[:m] == doc[k:] if k else True
        ok = whole & same
        g = (h[ok] + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
        out += np.bincount(doc[:m][ok] * dims + (g >> np.uint32(7)).astype(np.int64) % dims, minlength=n * dims)
    return out.reshape(n, dims)


def has_letter(raw: np.ndarray, offsets: np.ndarray, column: pa.Array, at: int) -> np.ndarray:
    """Whether each text has a letter of any script; bytes decide for ASCII, the rest is looked at as text."""
    base = int(offsets[0])
    data = raw[base : int(offsets[-1])]
    ascii_letter = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))))
    found = ascii_letter[offsets[1:] - base] > ascii_letter[offsets[:-1] - base]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in column[at + int(i)].as_py())
    return found


def _frequencies(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(dims, np.int64), 0
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for i, j in slices(offsets, 1 << 17):
                for a in range(i, j, 64):
                    b = min(a + 64, j)
                    df += (gram_counts(raw, offsets[a : b + 1], dims) > 0).sum(axis=0)
            rows += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], names=["gram", "n"])

    return run


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = counts.astype(np.float32) ** 0.75 * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _centroids(v: np.ndarray, clusters: int, rounds: int) -> np.ndarray:
    # the sample is in the order of a hash, so its first rows are random seeds; clusters of under 5 % are given up
    centroids = v[:clusters]
    for _ in range(rounds):
        near = (v @ centroids.T).argmax(axis=1)
        share = np.bincount(near, minlength=len(centroids))
        kept = np.flatnonzero(share >= max(1, 0.05 * len(v)))
        sums = np.stack([v[near == c].sum(axis=0) for c in (kept if len(kept) else [share.argmax()])])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def _limits(scored: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(languages, LENGTHS) low quantiles of ``(scores, size classes)`` per language; a limit never falls as texts grow."""
    scores, sizes = (np.concatenate([np.asarray(x[i], t) for x in scored]) for i, t in ((0, np.float32), (1, np.int64)))
    # shorter texts lie farther from centroids, so they may fill up a class and longer ones may not
    common = np.zeros(LENGTHS, np.float32)
    for c in np.unique(sizes):
        low = c
        while low and np.count_nonzero((sizes >= low) & (sizes <= c)) < ENOUGH:
            low -= 1
        common[c] = np.quantile(scores[(sizes >= low) & (sizes <= c)], QUANTILE)
    limits = np.tile(common, (len(scored), 1))
    for at, (own, classes) in enumerate(scored):
        own, classes = np.asarray(own, np.float32), np.asarray(classes, np.int64)
        for c in np.unique(classes):
            if np.count_nonzero(classes == c) >= OWN:
                limits[at, c] = np.quantile(own[classes == c], QUANTILE)
    # a class without texts takes the limit of the next shorter one that has some
    return np.maximum.accumulate(limits, axis=1)


def _fit(dims: int, idf: np.ndarray, clusters: int, rounds: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "doc_id"], kind="stable")
        raw, offsets = buffers(pa.array(pdf["text"], pa.large_string()))
        counts = np.concatenate([gram_counts(raw, offsets[a : min(a + 64, len(pdf)) + 1], dims).astype(np.float32) for a in range(0, len(pdf), 64)])
        grams = counts.sum(axis=1)
        v, grams = _vectors(counts[grams > 0], idf), grams[grams > 0]
        if not len(v):
            return pd.DataFrame({"lang": [], "cluster": [], "centroid": [], "scores": [], "sizes": []})
        centroids = _centroids(v, clusters, rounds)
        fold, scores = np.arange(len(v)) % FOLDS, np.full(len(v), np.nan, np.float32)
        for k in range(FOLDS if len(v) > 1 else 0):
            out = fold == k
            if out.any():
                scores[out] = (v[out] @ _centroids(v[~out], clusters, rounds).T).max(axis=1)
        known = ~np.isnan(scores)
        none = [[] for _ in range(len(centroids) - 1)]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "cluster": range(len(centroids)), "centroid": [c.tolist() for c in centroids], "scores": [scores[known].tolist(), *none], "sizes": [size_class(grams[known]).tolist(), *none]})

    return run


def fit(docs: DataFrame, train: str, dims: int = 4096, clusters: int = 4, sample: int = 1000, rounds: int = 8, max_langs: int = 200):
    """Model (idf, languages, centroids, limits) from the rows of ``docs(doc_id, text, lang)`` that ``train`` picks."""
    rows = docs.where(f"({train}) AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counted = rows.select("text").mapInArrow(_frequencies(dims), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    df = {r[0]: r[1] for r in counted.collect()}  # at most dims + 1 rows
    n = df.pop(-1, 0)
    if not n:
        return np.ones(dims, np.float32), [], np.zeros((0, dims), np.float32), np.zeros((0, LENGTHS), np.float32)
    # the square root on either side of a cosine weighs it by the smoothed idf once
    idf = np.full(dims, np.sqrt(1 + np.log(1.0 + n)), np.float32)
    for g, c in df.items():
        idf[g] = np.sqrt(1 + np.log((1.0 + n) / (1.0 + c)))
    langs = rows.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    order = Window.partitionBy("lang").orderBy("rank", "doc_id")
    # ids with small hashes only: about twice the sample of each language meets for ranking
    bound = F.create_map(*[F.lit(x) for r in langs for x in (r[0], int(min(1.0, 2 * sample / r[1]) * (1 << 30)) + 1)])
    ids = rows.select("lang", "doc_id").withColumn("rank", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).where(F.col("rank") < bound[F.col("lang")])
    ids = ids.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample)
    picked = ids.select("lang", "doc_id", "rank").distinct()
    chosen = F.broadcast(picked) if len(langs) * sample <= 500_000 else picked
    # an id may stand for many rows: the sample is bounded again
    texts = rows.join(chosen, ["lang", "doc_id"]).withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample).drop("at")
    got = texts.groupBy("lang").applyInPandas(_fit(dims, idf, clusters, rounds), "lang string, cluster int, centroid array<float>, scores array<float>, sizes array<int>")
    got = sorted(got.collect(), key=lambda r: (r["lang"], r["cluster"]))  # at most max_langs * clusters rows
    names = sorted({r["lang"] for r in got})
    # at most max_langs * sample scores
    limits = _limits([(r["scores"], r["sizes"]) for r in got if r["cluster"] == 0]) if got else np.zeros((0, LENGTHS))
    of = [names.index(r["lang"]) for r in got]
    return idf, [r["lang"] for r in got], np.array([r["centroid"] for r in got], np.float32).reshape(-1, dims), limits[of].astype(np.float32)


def _predict(model, dims: int, slack: float, at: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centroids, limits = model.value
        names = np.array([*langs, UND], dtype=object)
        for batch in batches:
            column = batch.column(at)
            raw, offsets = buffers(column)
            lang, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            rejected = np.ones(batch.num_rows, bool)
            for i, j in slices(offsets, 1 << 17):
                for a in range(i, j, 64):
                    b = min(a + 64, j)
                    letters = has_letter(raw, offsets[a : b + 1], column, a)
                    if not len(langs) or not letters.any():
                        continue
                    counts = gram_counts(raw, offsets[a : b + 1], dims)
                    cos = _vectors(counts, idf) @ centroids.T
                    near = cos.argmax(axis=1)
                    best = cos[np.arange(b - a), near]
                    lang[a:b] = np.where(letters, near, len(langs))
                    score[a:b] = np.where(letters, np.clip(best, 0, 1), 0)
                    rejected[a:b] = ~letters | (best < slack * limits[near, size_class(counts.sum(axis=1))])
            yield pa.record_batch([*batch.columns[:kept], pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(rejected)], names=[*batch.schema.names[:kept], "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model, keep: list[str], slack: float = 0.85) -> DataFrame:
    """Columns ``keep`` of every row with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``."""
    # the text goes to the task once, also where it is kept
    columns = keep if "text" in keep else [*keep, "text"]
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), "lang_pred string, score double, rejected boolean"])
    out = rows.mapInArrow(_predict(shared, model[2].shape[1] if len(model[1]) else 1, slack, columns.index("text"), len(keep)), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")
