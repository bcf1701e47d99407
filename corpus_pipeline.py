"""Corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token output.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; between stages the rows are written as Parquet in the
cluster's shared folder and read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardiolake.llm import decontaminate, language_id, mixing, token_output
from cardiolake.llm.common import small_batches, stash
from cardiolake.llm.jaccard_join import one_of_each


def small_docs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    small_batches(spark)
    return docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a learned language; ``lang`` becomes the predicted one. Null texts, texts without a letter and
    those rejected go; null ids, repeated rows and other columns are passed on; without training rows nothing stays."""
    small_batches(spark)
    model = language_id.fit(docs, "crc32(cast(doc_id AS string)) % 4 <> 2")
    judged = language_id.predict(docs, model, docs.columns)
    columns = [F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns]
    return judged.where("NOT rejected").select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that with the smallest id) of each group that five-word shingles link at a similarity of 0.8; rows without
    words stay, rows that repeat an id or have none count by their own texts; an empty table stays empty."""
    return one_of_each(small_docs(spark, docs))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``. Each row counts by its own text: null and empty texts stay, as do all rows
    when the benchmark is empty; other columns are passed on."""
    return decontaminate.clean(small_docs(spark, docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them (0 to 2 times). Rows without words stay once; a null source is a
    source of its own; rows that repeat an id are taken apart; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read back from the written token files. Null texts are empty and have the end id
    alone; null ids come first; rows that repeat an id are documents of their own; an empty table gives an empty result."""
    return token_output.encode_documents(small_docs(spark, docs), public_tokenizers.path("byte_bpe_50k.json"), end=2)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_to_weights),
    ("token_output", encode_tokens),
]

#: Learned centroids, hashed schedules and a tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
