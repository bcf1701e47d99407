"""The pipeline's stages: what each keeps, that decisions take effect, and the final rows against the parts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cardiolake.llm import decontaminate, jaccard_join, mixing
from cardiolake.llm.common import stash

DATA = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "token_output"]


def test_stages_one_by_one(spark, docs):
    first = stash(STAGE["language_id"](spark, docs, DATA), "t1")
    assert first.columns == docs.columns and first.count() == docs.where("text IS NOT NULL AND text RLIKE '[^ \\n]'").count()
    second = stash(STAGE["jaccard_join"](spark, first, DATA), "t2")
    groups = jaccard_join.jaccard_components(first)
    assert second.count() == groups.select("component_id").distinct().count() and second.columns == docs.columns
    assert {r[0] for r in second.select("doc_id").collect()} == {r[0] for r in groups.select("component_id").collect()}
    third = stash(STAGE["decontamination"](spark, second, DATA), "t3")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    leaking = {r["doc_id"] for r in decontaminate.leaks(second, bench).collect()}
    assert leaking and {r[0] for r in second.select("doc_id").collect()} - {r[0] for r in third.select("doc_id").collect()} == leaking
    fourth = stash(STAGE["mixing"](spark, third, DATA), "t4")
    mix = {r["doc_id"]: r for r in mixing.mix_sources(third).collect()}
    copies = {r["doc_id"]: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    for d, r in mix.items():
        assert copies.get(d, 0) == (int(r["taken"] / r["size"] + 0.5) if r["size"] else 1)
    assert fourth.columns == docs.columns and fourth.exceptAll(third).select("doc_id").distinct().count() == sum(c > 1 for c in copies.values())


def test_run_equals_the_library_on_the_mixed_texts(spark, docs):
    got = sorted(corpus_pipeline.run(spark, DATA).collect(), key=lambda r: r["start"])
    rows = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        rows = stash(f(spark, rows, DATA), name)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    want = rows.orderBy("doc_id").collect()
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        ids = np.array([*t.encode(w["text"], add_special_tokens=False).ids, 2], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (w["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_odd_rows_pass_every_stage(spark, docs):
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, "the of and to in that", None, None, 5), (None, "the of and to in that is", "en", "a", 5), (9003, "the of and to in that", None, None, 5)], docs.schema)
    for rows in (docs.limit(60).union(odd), docs.limit(0)):
        rows = rows.withColumn("component_id", F.lit("x")).withColumn("rank", F.lit(1))
        for name, f in corpus_pipeline.STAGES:
            rows = stash(f(spark, rows, DATA), name)
        assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
