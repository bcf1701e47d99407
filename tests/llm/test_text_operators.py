"""Operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.llm import decontaminate, jaccard_join, language_id, lm_scoring, mixing, token_output
from cardiolake.llm.common import connected_components, shared_dir

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash with results."""
    long = " ".join(f"w{i % 977} the" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one two", "en", "b"), (5, "one two", "en", "b"), (5, "one two", "en", "b"), (6, long, "en", "a"), (7, long + " tail", "en", "a"), (8, "Ünï çödé   x \ny", "fr", None), (9, "12 34 !!", "de", "b"), (10, "<|endoftext|> a", "en", "c"), (None, "no id here at all", "en", "c")]
    return spark.createDataFrame([(a, b, c, d, 1, 0.5, 3) for a, b, c, d in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(rows, k, percent):
    sets = {}
    for r in rows:
        w = WORD.findall(lower(r["text"]))
        n = min(k, len(w))
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(docs, k, percent):
    want = brute_components(docs.collect(), k, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, k, percent).collect()}
    assert got == want


def test_jaccard_near_copies_in_a_chain(spark):
    """Each text changes a few words of the one before, so links form chains that no common pivot sees."""
    rng = np.random.default_rng(5)
    rows, words = [], [f"v{x}" for x in rng.integers(0, 10_000, 120)]
    for i in range(60):
        words = list(words)
        for at in rng.integers(0, len(words), 1 + i % 3):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words[: 120 - i % 4])))
    rows += [(100 + i, "the same short line") for i in range(5)] + [(200 + i, " ".join(f"q{x}" for x in rng.integers(0, 40, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components([{"doc_id": a, "text": b} for a, b in rows], 4, 85)
    for bucket_rows in (4096, 2):
        got = jaccard_join.jaccard_components(df, 4, 85, bucket_rows=bucket_rows).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_shared_passage_in_large_texts(spark):
    """Many texts share half of their words, some of them nearly all; sizes on both sides of the wider parities."""
    rng = np.random.default_rng(6)
    rows, passage = [], [f"p{x}" for x in range(600)]
    for i in range(40):
        rows.append((i, " ".join([f"a{i}x{x}" for x in range(int(rng.integers(350, 560)))] + passage)))
    for i in range(10):
        words = rows[i][1].split()
        for at in rng.integers(0, len(words), 4 + 6 * i):
            words[at] = f"n{at}"
        rows.append((50 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components([{"doc_id": a, "text": b} for a, b in rows], 4, 85)
    for bucket_rows in (4096, 3):
        got = jaccard_join.jaccard_components(df, 4, 85, bucket_rows=bucket_rows).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_edge_cases(odd, empty):
    got = jaccard_join.jaccard_components(odd, 4, 85).collect()
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert by[4]["component_id"] == by[5]["component_id"] == 4 and by[7]["component_id"] == 6 and by[1]["component_id"] == 1
    assert jaccard_join.jaccard_components(empty).count() == 0


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


def test_jaccard_repeated_and_null_ids(spark):
    """Each row links by its own text, whatever other rows share its id."""
    base = [f"w{i}" for i in range(64)]
    near = [*base[:-1], "changed"]
    rows = [(10, base), (11, [f"x{i}" for i in range(50)]), (11, near), (12, [f"y{i}" for i in range(9)]), (None, [f"y{i}" for i in range(9)]), (None, [*base[:-1], "other"]), (None, ["alone"] * 7), (13, [])]
    rows = [(a, " ".join(b)) for a, b in rows]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85).collect())
    assert got == sorted([(10, 61, 10), (11, 47, 11), (11, 61, 10), (12, 6, 12), (-1, 6, 12), (-1, 61, 10), (-1, 1, -1), (13, 0, 13)])


def test_one_of_each_counts_rows_not_ids(spark):
    base = " ".join(f"w{i}" for i in range(64))
    rows = [(10, base), (11, base + " more"), (11, "quite another text of its own"), (11, base + " more"), (None, base), (None, "no id and no copy of it"), (12, ""), (12, None), (13, "twice here the same"), (13, "twice here the same"), (3, "one two three four five six seven eight nine"), (None, "one two three four five six seven eight nine")]
    df = spark.createDataFrame([(a, b, i, "x") for i, (a, b) in enumerate(rows)], "doc_id long, text string, n_shingles int, component_id string").repartition(3)
    got = jaccard_join.one_of_each(df)
    assert got.columns == df.columns
    want = [0, 2, 5, 6, 7, 8, 10]
    assert sorted(8 if r["n_shingles"] == 9 else r["n_shingles"] for r in got.collect()) == want


def test_mixed_documents_counts_rows_not_ids(spark):
    rows = [(1, "a b c d", "s"), (1, "e f", "s"), (None, "g h i", "s"), (None, None, "s"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r["text"] for r in mixing.mixed_documents(df, ratio=2.0).collect())
    assert got == {"a b c d": 2, "e f": 2, "g h i": 2, None: 1, "": 1}


def test_jaccard_does_not_link_words_of_a_kind(spark):
    """Thue-Morse words collide under polynomials modulo a power of two."""
    for n in (64, 1024, 4096):
        rows = [(i, " ".join(f"{thue_morse(n, i)}{x}" for x in "pqrstuv")) for i in (0, 1)]
        assert {r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()} == {0, 1}


@pytest.mark.parametrize("n", [150, 600])
def test_jaccard_pairs_of_a_far_group_stay_few(spark, monkeypatch, n):
    """Members of one group share a passage and are mutually far: what is compared grows no faster than they do."""
    rng = np.random.default_rng(7)
    passage = [f"p{x}" for x in range(100)]
    rows = []
    for i in range(n):
        own = [f"a{i}x{x}" for x in range(60)] if i % 3 else [f"c{x}" for x in rng.integers(0, 300, 60)]
        rows.append((i, " ".join(passage + own)))
    rows += [(n + i, rows[i][1] + " tail") for i in range(5)]
    made = []
    monkeypatch.setattr(jaccard_join.Join, "verify", lambda self, pairs, real=jaccard_join.Join.verify: made.append(pairs.count()) or real(self, pairs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()}
    assert got == brute_components([{"doc_id": a, "text": b} for a, b in rows], 4, 85)
    assert sum(made[1:]) <= n


def test_jaccard_near_copies_of_one_text_leave_few_rows(spark, monkeypatch):
    """Copies with parts changed link with some others and just miss most: what leaves the comparison of whole sets grows with copies."""
    rng, rows = np.random.default_rng(9), []
    for i in range(300):
        w = [f"w{x}" for x in range(120)]
        for p in rng.choice(30, 2, replace=False):
            w[4 * p + 2] = f"x{p}y{rng.integers(0, 3)}"
        rows.append((i, " ".join(w)))
    made = []
    monkeypatch.setattr(jaccard_join, "_linked", lambda job, close, spread, real=jaccard_join._linked: (out := real(job, close, spread), made.append((close.select("id").distinct().count(), out.count())))[0])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 91).collect()}
    assert got == brute_components([{"doc_id": a, "text": b} for a, b in rows], 4, 91)
    assert made and made[0][0] >= 10 and made[0][1] <= 2 * made[0][0]


def test_jaccard_keeps_parities_of_linkable_sets_only(spark, monkeypatch):
    """While pairs are compared, parities lie on disk for sets that may link, not for all."""
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:39], f"x{i}"])) for i in range(3)] + [(i, " ".join(f"{i}_{j}" for j in range(40))) for i in range(3, 60)]
    seen, before = [], set(os.listdir(shared_dir(spark).removeprefix("file://")))

    def kept(self, pairs, real=jaccard_join.Join.verify):
        folder = shared_dir(spark).removeprefix("file://")
        tables = [spark.read.parquet(f"file://{folder}/{x}") for x in set(os.listdir(folder)) - before]
        seen.append([t.count() for t in tables if "fine" in t.columns])
        return real(self, pairs)

    monkeypatch.setattr(jaccard_join.Join, "verify", kept)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()}
    assert got == brute_components([{"doc_id": a, "text": b} for a, b in rows], 4, 85)
    assert len({c for _, c in got.values()}) == 58 and seen and all(len(n) == 1 and n[0] <= 10 for n in seen)


def test_jaccard_large_buckets_of_far_members_stay_linear(spark, monkeypatch):
    """Members share a passage and other parts with some others, so none is left out early; buckets are larger than ``bucket_rows``."""
    passage, rng, heavy, dealt = [f"p{x}" for x in range(100)], np.random.default_rng(8), [], []
    real, deal = jaccard_join.Join.by_first_elements, jaccard_join._dealt
    monkeypatch.setattr(jaccard_join.Join, "by_first_elements", lambda self, members: heavy.append(members.select("id").distinct().count()) or real(self, members))
    monkeypatch.setattr(jaccard_join, "_dealt", lambda rows, most: (out := deal(rows, most), dealt.append(out.count()))[0])
    for n in (1500, 15_000):
        picks = rng.integers(0, n // 5, (n, 3))
        rows = [(i, " ".join(passage + [f"s{p}x{x}" for p in pick for x in range(20)])) for i, pick in enumerate(picks.tolist())]
        rows += [(n + i, rows[7 * i][1] + " tail") for i in range(50)]
        sets, parts = {}, defaultdict(set)
        for i, text in rows:
            w = text.split()
            sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3))
            for p in w[100::20]:
                parts[p].add(i)
        # texts without a common part have the passage alone in common, which is too little
        linked = {(a, b) for ids in parts.values() for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
        want = list(range(n + 50))
        for _ in range(20):
            for a, b in linked:
                want[a] = want[b] = min(want[a], want[b])
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df, 4, 85, bucket_rows=64).collect()}
        assert got == dict(enumerate(want))
    assert heavy[0] >= 400 and heavy[1] >= 8 * heavy[0]
    assert dealt[1] <= 11 * heavy[1] / heavy[0] * max(dealt[0], 1)


def test_jaccard_class_keys_that_collide_are_made_anew(docs, monkeypatch):
    real = jaccard_join.class_key
    monkeypatch.setattr(jaccard_join, "class_key", lambda s, salt: (real(s, salt)[0] % 50 if salt == 0 else real(s, salt)[0], *real(s, salt)[1:]))
    made = []
    monkeypatch.setattr(jaccard_join, "_profile", lambda k, salt, f=jaccard_join._profile: made.append(salt) or f(k, salt))
    jaccard_join.jaccard_components(docs, 4, 85)
    assert made in ([0], [0, 1])


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((5, 9), (100, 300), (3000, 2000)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate((a[: n // 2], rng.integers(0, 1 << 63, m).astype(np.uint64)))
        x, y = jaccard_join._parities(a), jaccard_join._parities(b)
        width = min(len(x), len(y)) // 8
        odd = int(np.bitwise_count(jaccard_join._fold(x, width) ^ jaccard_join._fold(y, width)).sum())
        apart = len(np.setxor1d(a, b))
        assert 0.5 * apart <= odd <= apart and (apart - odd) % 2 == 0


def test_allocation_always_covers_the_difference():
    for percent in (80, 85):
        for size in (1, 5, 6, 40, 300, 5000):
            h = jaccard_join.differ_most(size, percent)
            for sets in (10, 1e6, 1e12):
                segments, two, spare = jaccard_join.allocate(size, h, sets)
                assert segments + two == h + 1 + spare and segments >= 1
            larger = size * 100 // percent
            worst = max((s - size for s in range(size, larger + 1)), default=0)
            assert h >= worst


def test_components_of_path_star_and_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)] + [(5, 5), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}


def test_language_held_out_accuracy_and_edges(docs, odd, empty):
    hold = "crc32(cast(doc_id AS string)) % 4 = 2"
    model = language_id.fit(docs, f"NOT ({hold})")
    got = language_id.predict(docs.where(hold), model, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    assert not any(r["rejected"] for r in got) and all(0 <= r["score"] <= 1 for r in got)
    rows = language_id.predict(odd, model, ["doc_id", "rank", "score"]).toPandas()
    und = set(rows.loc[rows["lang_pred"] == "und", "doc_id"])
    assert und == {1, 2, 3, 9} and len(rows) == 12
    assert language_id.predict(empty, model, ["doc_id"]).count() == 0
    nothing = language_id.fit(empty, "true")
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}


def test_language_rejects_what_is_like_no_language(docs, spark):
    model = language_id.fit(docs, "true")
    texts = ["这是一个测试文本我们在这里写一些中文内容" * 20, "Это простой русский текст для проверки языка " * 20, "the of and to in is"]
    got = {r["i"]: r["rejected"] for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), model, ["i"]).collect()}
    assert got == {0: True, 1: True, 2: False}
    assert language_id.predict(docs, model, ["doc_id"]).where("rejected").count() == 0


def test_language_rejects_unlearned_latin_script(spark, docs):
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(many, "crc32(cast(doc_id AS string)) % 4 <> 2")
    italian = "la storia della lingua italiana comincia quando il latino parlato nelle diverse regioni si trasforma lentamente e ogni citta sviluppa il suo modo di parlare molti scrittori hanno cercato una forma comune che tutti potessero capire ma soltanto dopo alcuni secoli la scuola e i giornali hanno portato questa lingua nelle case"
    polish = "historia języka polskiego zaczyna się bardzo dawno temu każdy człowiek mówi trochę inaczej ale wszyscy rozumieją wspólną mowę której uczą się w szkole oraz czytają w książkach i gazetach przez całe życie"
    rng = np.random.default_rng(5)
    letters = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(300))
    short = ["the of and to in is", "the of and to in that"]
    rows = [*((i, (t + " ") * 4) for i, t in enumerate((italian, polish, letters))), *enumerate(short, 10)]
    got = {r["i"]: r["rejected"] for r in language_id.predict(spark.createDataFrame(rows, "i long, text string"), model, ["i"]).collect()}
    assert got == {0: True, 1: True, 2: True, 10: False, 11: False}
    # what is learned stays: all but texts that repeat hardly more than one word
    held = many.where("crc32(cast(doc_id AS string)) % 4 = 2 AND text RLIKE '[a-zA-Z]'")
    lost = [r["text"] for r in language_id.predict(held, model, ["text"]).where("rejected").collect()]
    assert all(len(set(WORD.findall(t))) < 0.2 * len(WORD.findall(t)) for t in lost) and len(lost) <= 0.02 * held.count()


def brute_grams(text, dims):
    """Hashed n-grams of one text, byte by byte."""
    b, out = bytearray(text.encode()), np.zeros(dims, np.int64)
    for i in range(1, len(b)):
        if b[i - 1] == 0xC3 and 0x80 <= b[i] <= 0x9E:
            b[i] += 0x20
    letters = [c | 32 if 65 <= (c & ~32) <= 90 else c if c >= 128 else 0 for c in b]
    for i in range(len(b)):
        h = 0
        for k in range(3):
            if i + k >= len(b) or not letters[i + k]:
                break
            h = (h * 0x01000193 ^ letters[i + k]) & 0xFFFFFFFF
            out[(((h + k + 1) * 0x9E3779B1 & 0xFFFFFFFF) >> 7) % dims] += 1
    return out


def test_language_predictions_equal_brute_force(docs):
    model = language_id.fit(docs, "crc32(cast(doc_id AS string)) % 4 <> 2")
    idf, langs, centroids, _ = model
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    rows = docs.where("text RLIKE '[a-zA-Z]' AND length(text) < 3000").orderBy("doc_id").limit(60).collect()
    for r in rows:
        v = brute_grams(r["text"], len(idf)) ** 0.75 * idf
        cos = centroids @ (v / np.linalg.norm(v))
        assert got[r["doc_id"]][0] == langs[int(cos.argmax())] and math.isclose(got[r["doc_id"]][1], cos.max(), abs_tol=1e-4)


@pytest.mark.parametrize("lang", ["fr", "en"])
def test_language_rejects_a_language_left_out(spark, lang):
    """The documents of a language that wasn't learned are rejected, hardly any others (4,000 documents; all four languages measured
    once: 99, 99, 100 and 91 % of fr, de, es, en, at most 1 % of learned ones)."""
    many = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000 AND text RLIKE '[a-zA-Z]'")
    model = language_id.fit(many.where(F.col("lang") != lang), "crc32(cast(doc_id AS string)) % 4 <> 2")
    got = language_id.predict(many, model, ["lang"]).groupBy((F.col("lang") == lang).alias("left_out")).agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()
    share = {r["left_out"]: r["share"] for r in got}
    assert share[True] >= 0.85 and share[False] <= 0.02


def test_language_ignores_labels_of_the_judged(docs):
    hold = "crc32(cast(doc_id AS string)) % 4 = 2"
    model = language_id.fit(docs, f"NOT ({hold})")
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    a = language_id.predict(docs, model, ["doc_id"]).orderBy("doc_id").collect()
    assert a == language_id.predict(other, model, ["doc_id"]).orderBy("doc_id").collect()


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t, public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_equal_the_library_and_files_round_trip(docs, odd):
    t, path = tokenizer()
    for df in (docs, odd):
        rows = df.select("doc_id", "text", F.crc32("text").alias("c")).orderBy(F.col("doc_id").asc_nulls_first(), "c").collect()
        start, want = 0, []
        for r in rows:
            ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = token_output.encode_documents(df.repartition(3), path, end=2, file_tokens=20_000).collect()
        assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_added_tokens_are_those_of_the_plain_call(spark):
    """Strings that are added tokens become them as in the library's plain call; or stay text where that is asked for."""
    t, path = tokenizer()
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    assert added and len(t.encode(added[0], add_special_tokens=False).ids) == 1
    texts = [f"a {x} b{x}{x} c {x[:-1]} {x[1:]}" for x in added] + ["".join(added), " ".join(added) + "\u00a0x", "plain text", added[0] * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for special in (True, False):
        t.encode_special_tokens = not special
        start, want = 0, []
        for i, x in enumerate(texts):
            ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = token_output.encode_documents(df, path, end=2, special=special).collect()
        assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_pieces_that_share_a_hash_keep_their_ids(docs, monkeypatch):
    """With a hash of four values nearly every piece meets another one's; bytes decide."""
    import pyarrow as pa

    texts = [thue_morse(1024), thue_morse(1024, 1), thue_morse(1024) + " " + thue_morse(1024, 1), *[r["text"] for r in docs.limit(40).collect()], thue_morse(64), thue_morse(4096, 1)]
    t = tokenizer()[0]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in (*texts, *texts)]
    enc = token_output.Encoder(tokenizer()[1])
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(token_output, "span_hashes", lambda *a, f=token_output.span_hashes: f(*a) & np.uint64(3))
        for enc.most in (600_000, 3):
            enc.clear()
            got = []
            for batch in (texts[:20], texts[20:], texts):
                for i, j, ids, n in token_output.encode_texts(enc, pa.array(batch, pa.string()), 2):
                    got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
            assert got == want


def test_token_output_of_nothing(empty):
    assert token_output.encode_documents(empty, tokenizer()[1], end=2).count() == 0


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_patched_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), np.full(n, 7), np.where(rng.random(n) < 0.01, 2**32 - 1, rng.integers(0, 9, n))):
        ids = ids.astype(np.uint32)
        data, start = token_output.encode_blocks(ids)
        area = np.frombuffer(data, np.uint8)
        assert (token_output.decode_blocks(area, start) == ids).all()
        content = token_output.file_bytes([5], np.array([n]), ids, 95.0)
        assert (token_output.read_block(content, 0) == ids[: token_output.BLOCK]).all()


def brute_scores(tokens, train, priors):
    """(known tokens, base score, score) by the model's formulas, and the training tokens."""
    one, two, three = Counter(), Counter(), Counter()
    for i in train:
        t = tokens[i]
        one.update(t)
        two.update(zip(t, t[1:]))
        three.update(zip(t, t[1:], t[2:]))
    n, v = sum(one.values()), len(one)
    n1, n2 = (sum(c == k for c in one.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2)
    p1 = lambda w: (one[w] - d) / n if one[w] else d * v / n
    p2 = lambda h, w: (two[h, w] + priors[0] * p1(w)) / (one[h] + priors[0])
    p3 = lambda g, h, w: (three[g, h, w] + priors[1] * p2(h, w)) / (two[g, h] + priors[1])
    assert math.isclose(sum(p1(w) for w in one) + d * v / n, 1, rel_tol=1e-9)
    out = {}
    for i, t in tokens.items():
        score = sum(math.log10(p1(w) if k == 0 else p2(t[k - 1], w) if k == 1 else p3(t[k - 2], t[k - 1], w)) for k, w in enumerate(t))
        out[i] = (sum(one[w] > 0 for w in t), sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), score)
    return out, n


def test_lm_automaton_equals_the_formulas(docs, monkeypatch):
    rule = "crc32(cast(doc_id AS string)) % 7 <> 2"
    rows = docs.withColumn("train", F.expr(rule)).collect()
    tokens = {r["doc_id"]: [*WORD.findall(lower(r["text"])), None] for r in rows}
    want, n = brute_scores(tokens, [r["doc_id"] for r in rows if r["train"]], (400.0, 5.0))
    for block, run in ((50_000, lm_scoring.RUN), (2 << 20, 997)):
        # runs end within documents; the state goes on
        monkeypatch.setattr(lm_scoring, "RUN", run)
        got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs.repartition(3), rule, block_bytes=block).collect()}
        assert len(got) == len(rows)
        for r in rows:
            g, (known, base, score) = got[r["doc_id"]], want[r["doc_id"]]
            assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (not r["train"], len(tokens[r["doc_id"]]), known, n)
            assert math.isclose(g["base_score"], base, rel_tol=1e-9) and math.isclose(g["score"], score, rel_tol=1e-9)
    held = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)


def test_lm_automaton_has_states_and_failure_arcs():
    words = {w: np.uint64(w * 7919 + 5) for w in range(1, 5)}
    texts = [[1, 2, 3], [1, 2, 4], [4, 2, 3]]
    tokens = np.array([words.get(w, lm_scoring.END) for t in texts for w in (*t, 0)], np.uint64)
    starts = np.array([0, 4, 8, 12])
    grams = lm_scoring.Grams(tokens, starts, 48)
    # only the first two texts are counted, so "4 2" is no bigram, "4 2 3" no trigram
    counts = {k: np.bincount(grams.at[k][:8], minlength=len(v)) * (v != 0) for k, v in grams.values.items()}
    a = lm_scoring.Automaton(grams, counts, 8, 5, 0.5, (2.0, 1.0))
    arcs = {k: int((a.arc[k] != lm_scoring.NONE).sum()) for k in a.arc}
    assert arcs == {1: 5, 2: 5, 3: 4}
    by = lambda k, t: grams.at[k][t]
    w = lambda k, t: a.arc[k][by(k, t)]
    got = a.traverse(starts)
    assert math.isclose(got[0], w(1, 0) + w(2, 1) + w(3, 2) + w(3, 3))
    # 4 from nothing; 2 by the failure arc of 4; 3 from the state 2; the end by failure arcs of "2 3", as it follows "1 2 3" it is counted
    assert math.isclose(got[2], w(1, 8) + a.fail[1][by(1, 8)] + w(1, 9) + w(2, 10) + w(3, 11))
    assert a.after[1][by(1, 3)] == 0 and a.after[2][by(2, 3)] == 0 and a.after[2][by(2, 1)] == 2


def test_lm_words_of_a_kind_stay_apart(spark):
    rows = [(1, thue_morse(1024)), (2, thue_morse(1024, 1) + " x")]
    got = {r["doc_id"]: r["n_known"] for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id = 1").collect()}
    assert got == {1: 2, 2: 1}


def test_lm_edge_cases(odd, empty):
    got = lm_scoring.score_documents(odd, "doc_id <> 4").collect()
    assert len(got) == 12 and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(math.isfinite(r["score"]) for r in got)
    none = lm_scoring.score_documents(odd, "false").collect()
    assert all(r["train_tokens"] == 0 and r["score"] == r["base_score"] for r in none)
    assert lm_scoring.score_documents(empty, "true").count() == 0


def water_level(sizes, weights, total):
    """Targets by repeated sharing, as the contract words it."""
    target, open_, left = {}, set(sizes), total
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_targets_and_taken(docs, odd):
    for df in (docs, odd.union(odd.where("source = 'b'"))):
        got = mixing.mix_sources(df).collect()
        text = df.collect()
        assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((r["doc_id"] or 0, len(WORD.findall(r["text"] or ""))) for r in text)
        sizes = defaultdict(int)
        for r in text:
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = water_level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
        by_target, taken = defaultdict(float), defaultdict(int)
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[round(r["target"], 6), r["source_size"]] += r["taken"]
        for s, t in want.items():
            by_target[round(t, 6), sizes[s]] += math.floor(t + 1e-9)
        assert {k: pytest.approx(v, abs=3) for k, v in taken.items()} == dict(by_target)
        again = mixing.mix_sources(df.repartition(3)).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_takes_of_each_document_what_its_stream_gives(docs, odd):
    """Per document against brute force: each source's stream is its documents in the order of a hash, from the start to the target."""
    for df, bucket_docs in ((docs, 2000), (docs, 7), (odd, 2)):
        ranked = df.select("doc_id", "text", "source", F.xxhash64("doc_id", F.lit(17)).alias("a"), F.xxhash64("doc_id", F.lit(18)).alias("b")).collect()
        of = defaultdict(list)
        for r in ranked:
            of[r["source"]].append((r["a"], r["b"], r["doc_id"], len(WORD.findall(r["text"] or ""))))
        order = sorted(of, key=lambda s: (s is None, s or ""))
        sizes = {s: sum(x[3] for x in of[s]) for s in of}
        target = water_level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
        want = []
        for s, rows in of.items():
            buckets = len(rows) // bucket_docs + 1
            at, stop = 0, math.floor(target[s] + 1e-9)
            for _, _, d, n in sorted((a % buckets, (b, d is not None, d or 0, n), d, n) for a, b, d, n in rows):
                want.append((d or 0, n, sum(max(0, min(at + p * sizes[s] + n, stop) - at - p * sizes[s]) for p in range(2))))
                at += n
        got = [(r["doc_id"] or 0, r["size"], r["taken"]) for r in mixing.mix_sources(df, bucket_docs=bucket_docs).collect()]
        assert sorted(got) == sorted(want)


def test_mixing_schedule_is_evenly_spread(spark):
    sized = spark.createDataFrame([("a", 5000), ("b", 3000), ("c", 1000)], "source string, size long")
    targets = mixing.source_targets(sized).cache()
    total = sum(r["target"] for r in targets.collect())
    share = {r["rank"]: r["target"] / total for r in targets.collect()}
    got = mixing.schedule(targets, 10_000).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(10_000))
    seen = Counter()
    for i, r in enumerate(got):
        assert r["r"] == seen[r["src"]]
        seen[r["src"]] += 1
        assert all(abs(seen[s] - (i + 1) * share[s]) < 4 for s in share)


def test_mixing_order_keeps_running_shares(docs, odd):
    got = mixing.scheduled_documents(docs, slots=2000).collect()
    assert [(r["slot"], r["start"]) for r in got] == sorted((r["slot"], r["start"]) for r in got)
    blocks = {(r["source"], r["block"]) for r in got}
    assert len(blocks) == len({(r["slot"], r["source"], r["block"]) for r in got}) == len({r["slot"] for r in got})
    whole = Counter()
    for r in got:
        whole[r["source"]] += r["words"]
    total, size = sum(whole.values()), Counter()
    for r in got:
        size[r["slot"]] += r["words"]
    block, seen = max(size.values()), Counter()
    assert len(whole) > 1 and len(size) > 1000 and sum(n < block for n in size.values()) <= len(whole)
    for r in got:
        assert r["start"] == seen[r["source"]]
        seen[r["source"]] += r["words"]
        assert all(abs(seen[s] - sum(seen.values()) * whole[s] / total) < 6 * block for s in whole)
    for df in (docs, odd.union(odd.where("source = 'b'"))):
        a, b = Counter(), Counter()
        for r in mixing.mix_sources(df).collect():
            a[r["doc_id"]] += r["taken"]
        for r in mixing.scheduled_documents(df).collect():
            b[r["doc_id"]] += r["words"]
        assert +a == +b


def test_mixing_says_which_slots_take_a_document(docs):
    """The schedule is part of the result: its first slot and the number of slots per document are those of the interleaved order."""
    slots = defaultdict(set)
    for r in mixing.scheduled_documents(docs).collect():
        slots[r["doc_id"]].add(r["slot"])
    got = mixing.mix_sources(docs).collect()
    assert {r["doc_id"]: (r["n_slots"], r["first_slot"]) for r in got} == {r["doc_id"]: (len(slots[r["doc_id"]]), min(slots[r["doc_id"]], default=None)) for r in got}
    assert len({r["first_slot"] for r in got}) > len(got) / 2 and all((r["taken"] > 0) == (r["n_slots"] > 0) for r in got)


def test_mixing_of_nothing(empty):
    assert mixing.mix_sources(empty).count() == 0
    zero = empty.union(empty.sparkSession.createDataFrame([(1, None, "en", "a", 0, 0.0, 0)], DOCS))
    assert [(r["target"], r["taken"]) for r in mixing.mix_sources(zero).collect()] == [(0.0, 0)]


def brute_leaks(docs, items, k=5, threshold=0.8):
    def words(t):
        return [w for w in ("".join(c for c in x if not (0x21 <= ord(c) < 0x7F) or c.isalnum()) for x in WORD.findall(lower(t))) if w]

    def bag(w):
        n = min(k, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()

    bags = {i: (bag(words(t)), len(words(t))) for i, t in items.items() if words(t)}
    df = Counter(s for b, _ in bags.values() for s in b)
    top = max((1 + math.log2(len(bags) / c) for c in df.values()), default=1)
    weight = lambda s: 1 + math.log2(len(bags) / df[s]) if s in df else top
    found = {}
    for d, t in docs.items():
        w = words(t)
        for i, (b, n) in bags.items():
            best = 0.0
            for s in range(max(1, len(w) - n + 1)):
                x = bag(w[s : s + n])
                if x.keys() & b.keys():
                    keys = x.keys() | b.keys()
                    best = max(best, sum(min(x[y], b[y]) * weight(y) for y in keys) / sum(max(x[y], b[y]) * weight(y) for y in keys))
            if best >= threshold:
                found[d, i] = best
    return found


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [f"t{x}" for x in rng.integers(0, 400, n)]
    items = {i: make(n) for i, n in enumerate((3, 5, 12, 18, 30, 57, 57))}
    items[7] = items[5][:40] + make(10)
    docs = {i: make(200) for i in range(30)}
    for i in range(24):
        part = list(items[i % 8])
        if i >= 8 and len(part) > 25:
            part[-1 - i % 3] = "changed"
        at = int(rng.integers(0, 150))
        docs[i] = docs[i][:at] + part + docs[i][at:]
    docs[30] = items[4][:25]
    docs[31] = []
    d = spark.createDataFrame([(i, " ".join(w).title() + ".") for i, w in docs.items()] + [(90, None)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, " ")], "item_id long, text string")
    want = brute_leaks({i: " ".join(w).title() + "." for i, w in docs.items()}, {i: " ".join(w) for i, w in items.items()})
    for size in (500_000, 60):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(d, b, item_shingles=size).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in want)
    for most in (20_000, 3):
        assert {r["doc_id"] for r in decontaminate.clean(d, b, most_items=most).collect()} == {*docs, 90} - {x for x, _ in want}


def test_leaks_recall_on_the_whole_benchmark(spark):
    """Every item, with words changed until its similarity is just at the threshold, against brute force."""
    rng = np.random.default_rng(9)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect() if r["text"]}
    some = {i: t for i, t in items.items() if len(WORD.findall(t)) >= 25}
    rows = {}
    for i, t in some.items():
        words = WORD.findall(t)
        for copy in range(6):
            near = list(words)
            # words at the ends cost few shingles, those inside five
            for at in ([], [0], [-1], [0, -1, 1], [len(words) // 2], [0, 1, 2, -1, -2])[copy]:
                near[at] = f"x{rng.integers(1e9)}"
            filler = [f"f{x}" for x in rng.integers(0, 1e9, 40)]
            rows[len(rows)] = " ".join(filler[:20] + near + filler[20:])
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute_leaks(rows, items, threshold=0.8 - 1e-9)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(d, b).collect()}
    assert got.keys() <= want.keys() and min(want.values()) < 0.85
    sure = {x for x, s in want.items() if s > 0.8 + 1e-9}
    assert len(got.keys() & sure) >= 0.98 * len(sure), len(got.keys() & sure) / len(sure)


def test_leaks_are_found_through_the_tables(monkeypatch):
    """Without the tables no window is compared; with them, exactly those within the radius are."""
    rng = np.random.default_rng(2)
    bags = [rng.integers(0, 1 << 63, 30).astype(np.uint64) for _ in range(50)]
    weight = {int(v): 1.0 for b in bags for v in b}
    items = decontaminate.Items(list(range(50)), bags, [34] * 50, 5, weight, 1.0, 23, 8)
    prints = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    w, i = items.by_length[34].find(prints)
    near = np.bitwise_count(prints[:, None] ^ items.prints[None, :]) <= 23
    assert set(zip(w.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near)))) and near.any()
    text = np.concatenate((rng.integers(0, 1 << 63, 40).astype(np.uint64), bags[7], rng.integers(0, 1 << 63, 40).astype(np.uint64)))
    assert [(x[0], x[1], x[2]) for x in decontaminate._windows(items, text, 5, 0.8, 114)] == [(7, 1.0, 40)]
    monkeypatch.setattr(decontaminate.Index, "find", lambda self, prints: (np.zeros(0, int), np.zeros(0, int)))
    assert not list(decontaminate._windows(items, text, 5, 0.8, 114))


def test_leaks_of_equal_windows_go_to_the_first(spark):
    words = [f"t{x}" for x in range(20)]
    d = spark.createDataFrame([(1, " ".join(["a b c", *words, "d", *words, "e"])), (None, " ".join(words))], "doc_id long, text string")
    b = spark.createDataFrame([(4, " ".join(words)), (None, " ".join(words))], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["similarity"], r["start_word"]) for r in decontaminate.leaks(d, b).collect())
    assert got == [(0, 0, 1.0, 0), (0, 4, 1.0, 0), (1, 0, 1.0, 3), (1, 4, 1.0, 3)]
    assert decontaminate.clean(d, b).count() == 0


def test_leaks_edge_cases(odd, empty, docs, spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(odd, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).count() == 12


def test_very_long_texts_go_piece_by_piece(monkeypatch):
    import pyarrow as pa

    from cardiolake.llm import textkit

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcé.,-Z"), size=n)) for n in rng.integers(1, 40, size=400)]
    text = pa.array(["".join(w + " \t\n"[i % 3] for i, w in enumerate(words)) + "x" * 900 + " end"])
    raw, offsets = textkit.buffers(text)
    whole = [textkit.word_hashes(raw, offsets, strip) for strip in (False, True)]
    grams = language_id.gram_counts(raw, offsets, 512)
    for module in (textkit, language_id):
        monkeypatch.setattr(module, "PIECE", 64)
    assert len(list(textkit.pieces(raw))) > 20
    for strip, (h, first) in zip((False, True), whole):
        got, at = textkit.word_hashes(raw, offsets, strip)
        assert (got == h).all() and (at == first).all()
    assert (language_id.gram_counts(raw, offsets, 512) == grams).all()
