"""Fill-in-the-middle samples, reversible line dedup and spelling variants against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cardiolake.llm import fill_in_middle as fim
from cardiolake.llm import line_dedup, spelling
from cardiolake.llm.line_dedup import Cuckoo, LineIndex

DOCS = "doc_id long, text string, n long, ids string, part int, line string, word string, count long"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 7, "x", 9, "y", "z", 8) for a, b in rows], DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    long = " ".join(f"w{i % 977} thé\n" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (5, "one two"), (6, long), (7, long), (8, "Ünï çödé 𝔘 x \ny"), (9, "a <S> marker"), (None, "no id here at all"), (None, None), (10, "9")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-the-middle


def brute_sample(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_samples_equal_brute_force(spark, odd_rows, hot):
    rng = random.Random(3)
    rows = odd_rows + [(100 + i, "".join(rng.choice("ab <PSM>é\n1𝔘") for _ in range(rng.randrange(40)))) for i in range(300)] + [(1000 + i, "the same text, é, many times") for i in range(50)]
    got = [tuple(r) for r in fim.samples(frame(spark, rows), hot=hot).collect()]
    assert sorted(got, key=repr) == sorted((brute_sample(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_texts_of_one_hash_are_told_apart_by_their_bytes():
    import pyarrow as pa
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    rows = [(7, 0, 3, press(t), np.array([i], np.int64).tobytes(), 0) for i, t in enumerate([b"a b", b"abc", b"a b", b"a b"])]
    batches = [pa.record_batch([pa.array(c) for c in zip(*part)], names=["text_hash", "part", "size", "text", "ids", "no_id"]) for part in (rows[:3], rows[3:])]
    out = [r for b in fim._index(iter(batches)) for r in b.to_pylist()]
    assert [(r["n"], zstandard.ZstdDecompressor().decompress(r["text"]), np.frombuffer(r["ids"], np.int64).tolist()) for r in out] == [(3, b"a b", [0, 2]), (1, b"abc", [1]), (3, b"a b", [3])]


def test_each_distinct_text_has_one_index_row(spark):
    rows = [(i, f"text {i % 5}") for i in range(200)]
    index = fim.text_index(frame(spark, rows).repartition(1)).collect()
    assert len(index) == 5 and sorted(x for r in index for x in np.frombuffer(r["ids"], np.int64).tolist()) == list(range(200))


def test_elias_fano_selects_every_entry():
    rng = np.random.default_rng(1)
    for n, span in ((1, 1), (1, 900), (7, 7), (300, 300), (300, 5000), (1000, 123_456)):
        values = np.sort(rng.choice(span, n, replace=False)) + 1
        ef = fim.EliasFano(n, *fim.EliasFano.encode(values, span))
        assert [ef.select(i) for i in range(n)] == values.tolist()
        assert 8 * (len(ef.low) + len(ef.high)) <= n * (2 + max(0, np.log2(span / n))) + n + 24


def test_samples_of_an_empty_table(spark):
    assert fim.samples(frame(spark, [])).collect() == []


# line dedup


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute_dedup(index_rows, rows, least):
    held = Counter(k for _, t in index_rows for k in {line_key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if held[line_key(x)] < least]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows(seed, n, start=0):
    rng = random.Random(seed)
    line = lambda: rng.choice(["", "  ", "Common LINE", "common line \r", "é\u00a0É", f"rare {rng.randrange(40)}", f"own {rng.random()}"])
    return [(start + i, "\n".join(line() for _ in range(rng.randrange(8)))) for i in range(n)]


def deduped(index, docs):
    return sorted((tuple(r) for r in index.dedup(docs).collect()), key=repr)


def test_line_dedup_equals_brute_force_through_insertions_and_deletions(spark, odd_rows):
    a, b, c = odd_rows + line_rows(1, 120), line_rows(2, 80, 500), line_rows(3, 60, 900)
    fa, fb, fc = (frame(spark, x).repartition(3) for x in (a, b, c))
    one = LineIndex(spark, least=3, shard_keys=50).insert(fa)
    assert deduped(one, fa) == brute_dedup(a, a, 3)
    two = one.insert(fb)
    assert deduped(two, fa) == brute_dedup(a + b, a, 3) and deduped(two, fc) == brute_dedup(a + b, c, 3)
    table = lambda index: sorted(tuple(r) for r in index.counts().collect())
    # taking documents back gives the counts, and the decisions, as if they had never come
    back = two.insert(fc).delete(fb)
    assert deduped(back, fc) == brute_dedup(a + c, c, 3)
    assert table(back.delete(fc)) == table(one) and deduped(back.delete(fc), fa) == deduped(one, fa)
    assert two.bits > 0 and one.shards.count() > 1
    assert back.delete(fc).delete(fa).counts().count() == 0


def test_deleting_what_was_never_inserted_fails_and_leaves_the_index(spark):
    index = LineIndex(spark, least=2).insert(frame(spark, [(1, "a\nb"), (2, "b")]))
    before = sorted(map(tuple, index.counts().collect()))
    for rows in ([(3, "never seen")], [(1, "a"), (1, "a")]):
        with pytest.raises(Exception, match="never inserted"):
            index.delete(frame(spark, rows))
    assert sorted(map(tuple, index.counts().collect())) == before


def test_line_dedup_of_empty_tables_and_in_groups_of_blocks(spark, monkeypatch):
    none = frame(spark, [])
    index = LineIndex(spark, least=2).insert(none)
    assert index.dedup(none).collect() == [] and deduped(index, frame(spark, [(1, "a"), (2, None)])) == [(1, 1, 0, "a"), (2, 1, 0, "")]
    monkeypatch.setattr(line_dedup, "GROUP", 2)
    rows = line_rows(5, 90)
    many = frame(spark, rows).repartition(8)
    assert deduped(LineIndex(spark, least=3).insert(many), many) == brute_dedup(rows, rows, 3)


def test_cuckoo_filters_forget_and_never_miss():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**64, 40_000, dtype=np.uint64)
    held = Cuckoo.of(keys)
    assert held.contains(keys).all() and held.contains(rng.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 0.001
    assert 40_000 / held.table.size > 0.3 and np.count_nonzero(held.table) == 40_000
    again = Cuckoo.read(held.write())
    again.delete(keys[:30_000])
    assert again.contains(keys[30_000:]).all() and again.contains(keys[:30_000]).mean() < 0.001 and np.count_nonzero(again.table) == 10_000
    assert again.insert(keys[:30_000]) and again.contains(keys).all()
    full = Cuckoo.sized(100)
    assert not full.insert(keys[: full.table.size + 1])
    with pytest.raises(ValueError):
        Cuckoo.of(keys[:10]).delete(keys[10:20])


# spelling variants


def brute_words(rows, one_in=31, least=7, seen=2):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= seen}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_near(n):
    return {w: sorted((x for x in n if one_edit(w, x)), key=lambda x: (-n[x], x)) for w in n}


def brute_variants(rows, **options):
    n = brute_words(rows, **options)
    near = brute_near(n)
    form = {w: x[0] if x and n[x[0]] >= 10 * n[w] else None for w, x in near.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def word_rows(seed, n):
    rng = random.Random(seed)
    stems = ["abababab", "aaaaaaaa", "Prénomé", "colours", "ÿÀ×÷abcd", "wordword", "ababab", "colouring"] + ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 12))) for _ in range(40)]
    return [(i if i % 11 else None, " ".join(rng.choice(stems[: rng.randrange(1, len(stems))]) for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "1", "Ω"])) for i in range(n)]


@pytest.mark.parametrize("one_in, shard_words", [(31, 50_000), (5, 20)])
def test_variants_equal_brute_force(spark, odd_rows, one_in, shard_words):
    rows = odd_rows + word_rows(1, 150) + [(7000, ("x" * 3000 + "y" + "x" * 2000 + " ") * 40), (7001, ("x" * 5001 + " ") * 3)]
    chain = {"chainaaa": 2, "chainaab": 25, "chainabb": 300}
    intact = next(i for i in range(8000, 9000) if all(zlib.crc32(f"{i}:{w}".encode()) % one_in for w in chain))
    rows.append((intact, " ".join(f"{w} " * k for w, k in chain.items())))
    got = [tuple(r) for r in spelling.variant_groups(frame(spark, rows), one_in=one_in, shard_words=shard_words).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(rows, one_in=one_in)
    assert sorted(got, key=repr) == want
    assert ("chainaaa", "chainaab", "chainabb", 2, 1, 25) in want


@pytest.mark.parametrize("shard_words", [5, 40, 100_000])
def test_near_words_equal_brute_force(spark, shard_words):
    rng = random.Random(7)
    n = {"".join(rng.choice("ab𝔘") for _ in range(rng.randrange(4, 9))): rng.randrange(1, 9) for _ in range(400)}
    n |= {"a" * k: 5 for k in range(4, 30)} | {"pre" + "".join(rng.choice("abc") for _ in range(5)): 3 for _ in range(150)}
    from cardiolake.llm.common import stash

    words = stash(spark.createDataFrame(list(n.items()), "word string, n long"), "words")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(words, shard_words).collect()}
    assert got == {w: (len(x), n[x[0]], x[0]) for w, x in brute_near(n).items() if x}


def test_automata_are_minimal_and_number_their_words():
    rng = random.Random(2)
    for letters, size in ((2, 8), (3, 6), (1, 20)):
        words = sorted({tuple(rng.randrange(letters) for _ in range(rng.randrange(1, size))) for _ in range(300)})
        a = spelling.Automaton(words)
        assert [a.number(w) for w in words] == list(range(len(words))) == list(range(a.size))
        assert a.number((letters,)) == -1 and a.number((0,) * 50) == -1
        rest = {w[:k]: None for w in words for k in range(len(w) + 1)}  # right languages of all prefixes
        languages = {frozenset(w[len(p) :] for w in words if w[: len(p)] == p) for p in rest}
        assert len(a.final) == len(languages)


def test_checksums_equal_zlib():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 20_000, dtype=np.uint8)
    starts = np.sort(rng.integers(0, 19_000, 500))
    ends = starts + rng.integers(1, 200, 500)
    doc = rng.integers(0, 3, 500)
    prefixes = [b":", b"12:", b"-7:"]
    want = [zlib.crc32(prefixes[d] + data[a:b].tobytes()) for d, a, b in zip(doc, starts, ends)]
    assert spelling._crcs(prefixes, doc, data, starts, ends).tolist() == want


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(70)] + [("x", "w069"), ("y", "z")], "word string, form string")
    roots = {r["word"]: r["root"] for r in spelling.follow(forms).collect()}
    assert roots == {f"w{i:03}": "w070" for i in range(70)} | {"x": "w070", "y": "z"}


def test_variants_of_an_empty_table(spark):
    assert spelling.variant_groups(frame(spark, [])).collect() == [] and spelling.variant_groups(frame(spark, [(1, "12 34"), (2, None)])).collect() == []


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_line_dedup", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from cardiolake.llm import queries

    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(got.fetchall(), key=repr)
