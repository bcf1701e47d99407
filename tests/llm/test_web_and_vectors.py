"""Vector search, HTML, URL filters and WARC derivatives against brute force and by hand."""

import gzip
import math
import re
import zlib
from html import unescape

import numpy as np
import pytest
from pyarrow import fs

from cardiolake.llm import html_text, queries, url_filters, vp_tree, warc_derivatives
from cardiolake.llm.html_text import to_text

DATA = "/root/testdata/sf0.001"


def brute_nearest(rows, is_query, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ok = [(i, v) for i, v in ok if len(v) == len(min(ok, key=lambda x: x[0])[1])]
    out = {}
    for q, a in ok:
        if is_query(q):
            near = sorted((math.sqrt(((a - b) ** 2).sum()), i) for i, b in ok if i != q)[:k]
            out[q] = [(i, d) for d, i in near]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_factor_one_is_exact(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in rows.collect()], lambda q: q % 10 == 0, 10)
    got = found(vp_tree.nearest(rows, "vec_id % 10 = 0", factor=1.0, shard_rows=100, query_rows=7))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(math.isclose(a[1], b[1], rel_tol=1e-12) for q in want for a, b in zip(got[q], want[q]))


def test_default_factor_reaches_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in rows.select("vec_id", "embedding").collect()]
    ids, v = np.array([i for i, _ in data]), np.array([x for _, x in data], np.float64)
    got = found(vp_tree.nearest(rows, "vec_id % 100 = 0"))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits, total = hits + len({i for i, _ in got[q]} & set(best.tolist())), total + 10
    assert hits / total >= 0.9


def test_tasks_of_a_search_go_with_its_shards_alone(spark):
    """However many queries there are: their number of blocks once multiplied the tasks, which the driver keeps track of, and the trees sent."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(600)], "vec_id long, embedding array<float>")
    plan = vp_tree.nearest(df, "true", shard_rows=100, query_rows=2)._jdf.queryExecution().executedPlan().toString()
    assert [int(n) for n in re.findall(r"Exchange \w+\([^\n]*?, (\d+)\), REPARTITION", plan)] == [6]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_copies_of_a_vector_keep_the_smallest_ids(spark, kind):
    """Of many copies only those stay that a result can need, though ids repeat and a query's own id is no candidate."""
    rows = [(i // 30 if i < 90 else i, [1.0, 2.0, float(i % 7 == 0)]) for i in range(1500)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5)
    got = found(vp_tree.nearest(df, "vec_id IN (2, 100, 700)", k=10, factor=1.0, shard_rows=400))
    own = sorted((math.dist(rows[100][1], v), i) for i, v in rows if i != 100)[:10]
    assert got[100] == [(i, d) for d, i in own] and got[700][:1] == [(0, 0.0)]
    # id 2 asks with 30 rows, all of which find the same
    assert {i for i, d in got[2]} == {0} and {d for i, d in got[2]} == {0.0}
    kept = vp_tree._needed(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), 10)
    assert len(kept) == 40


@pytest.mark.parametrize(("kind", "scale"), [("float", 1e-24), ("float", 1e-17), ("float", 1e12), ("float", 1e19), ("double", 1e-160), ("double", 1e150), ("double", 1e152)])
def test_vectors_of_any_size_give_exact_results(spark, kind, scale):
    rng = np.random.default_rng(7)
    values = (rng.normal(size=(1400, 6)) * scale).astype(np.float32 if kind == "float" else np.float64)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got, want = found(vp_tree.nearest(df, "vec_id % 100 = 0", factor=1.0, shard_rows=1400)), brute_nearest(rows, lambda q: q % 100 == 0, 10)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_repeated_vector_ids_are_candidates_of_their_own(spark):
    rng = np.random.default_rng(3)
    rows = [(5, [float(x) for x in rng.normal(size=4)]) for _ in range(120)] + [(i, [float(x) for x in rng.normal(size=4)]) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(vp_tree.nearest(df, "vec_id = 110", factor=1.0, shard_rows=20, query_rows=1))
    a = dict(rows)[110]
    want = sorted((math.dist(a, b), i) for i, b in rows if i != 110)[:10]
    assert [(i, pytest.approx(d)) for d, i in want] == got[110]


def test_vector_ties_and_invalid_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i // 50)]) for i in range(200)] + [(200, None), (201, [0.0, 0.0]), (202, [nan, 1.0]), (203, [inf, 1.0]), (204, [None, 1.0]), (205, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = found(vp_tree.nearest(df, "vec_id % 20 = 0", factor=1.0, shard_rows=60))
    want = brute_nearest(rows, lambda q: q % 20 == 0, 10)
    assert got == want
    few = found(vp_tree.nearest(df.where("vec_id < 4"), "vec_id = 0"))
    assert few == {0: [(1, 0.0), (2, 0.0), (3, 0.0)]}
    assert vp_tree.nearest(df.limit(0), "true").count() == 0


@pytest.mark.parametrize(
    "markup,text",
    [
        (None, None),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
        ("<h1>T</h1>a <b>b</b><i>c</i> d", "T\n\na bc d"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>after", "- a\n- b\n  3. x\n  4. y\n- c\n\nafter"),
        ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dddd</table>", "aa | b\nc  | dddd"),
        ("<table><caption>cap</caption><thead><tr><th>h1<th>h2<tbody><tr><td>x<td><ul><li>1<li>2</ul></table>z", "cap\nh1 | h2\nx  | - 1\n   | - 2\n\nz"),
        ("a<script>if (x < y) { '</p>' }</script>b<style>p{}</style>c<!-- no -->d", "abcd"),
        ("<p hidden>no</p><p style='color:red; DISPLAY : none'>no</p><p class=hidden-not>yes</p><div style=visibility:hidden>no <b>no</b></div>", "yes"),
        ("<head><title>t</title><meta charset=x></head><body>b</body>", "b"),
        ("<head><title>t</title><p>implied body", "implied body"),
        ("<pre>\n a  b\n  c &lt;\n</pre>d", " a  b\n  c <\n\nd"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("&amp;&copy;&#65;&nbsp;x &bogus; 1 < 2 <3", "&©A\xa0x &bogus; 1 < 2 <3"),
        ("<p>cut off <a href='x", "cut off"),
        ("<b>x</i></b></p></div>y", "xy"),
        ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n    d1\n    d2"),
        ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
        ("<select><option>a<option>b</select><textarea> k </textarea>", "a\nb\nk"),
    ],
)
def test_html_by_hand(markup, text):
    assert to_text(markup) == text


@pytest.mark.parametrize(
    "markup, text",
    [
        ('<p title="hidden gems" class="hidden lg">seen<p HIDDEN>not<p hidden="">nor<p aria-hidden=true>also', "seen\n\nalso"),
        ('<p data-style="display:none">a<p style="color:red; DISPLAY : none">b<p style=visibility:hidden>c<p alt="style=\'display:none\'">d', "a\n\nd"),
        ('<ol class="x" start="4"><li>a<li>b</ol>', "4. a\n5. b"),
        ('<ol title="start=9"><li>a</ol>', "1. a"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab |   | c\nd  | e | f"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td colspan=x>a<td>b</table>", "a | b"),
    ],
)
def test_html_attributes_and_spans(markup, text):
    assert to_text(markup) == text


def random_page(rng, words, depth):
    """Markup of a random tree, and its visible words in order."""
    out, seen = [], []

    def word(shown):
        words[0] += 1
        w = f"w{words[0]}"
        if shown:
            seen.append(w)
        return w

    def node(level, shown, cells):
        kind = rng.integers(0, 14)
        style = [("", shown), (" hidden", None), (" style='color:red;display:none'", None), (" style=visibility:hidden", shown and False), (" style='VISIBILITY : visible'", shown if shown is None else True), (' title="hidden"', shown)][rng.integers(0, 6) if rng.integers(0, 3) == 0 else 0]
        attributes, inside = style if shown is not None else ("", None)
        if level == 0 or kind < 3:
            out.append(f" {word(shown)} &amp; " if kind == 1 else f" {word(shown)} ")
            if kind == 1 and shown:
                seen.append("&")
        elif kind < 8:
            tag = ("div", "span", "p", "blockquote", "section")[kind - 3]
            # a paragraph holds no blocks
            if tag == "p":
                out.append(f"<p{attributes}> {word(inside)} <b>{word(inside)}</b></p>")
            else:
                out.append(f"<{tag}{attributes}>")
                for _ in range(rng.integers(0, 4)):
                    node(level - 1, inside, cells)
                out.append(f"</{tag}>")
        elif kind < 10:
            out.append(f"<UL{attributes}>")
            for _ in range(rng.integers(1, 4)):
                out.append("<li>")
                node(level - 1, inside, cells)
            out.append("</UL>")
        elif kind == 10:
            out.append(f"<script>var a = '<p>{word(None)}';</ScRiPt ><!-- {word(None)} -->")
        elif kind == 11:
            out.append(f"<pre{attributes}> {word(inside)}\n\n {word(inside)}</pre>")
        elif kind == 12:
            out.append(f"<svg{attributes}><text>{word(inside)}</text>{word(None)}</svg>")
        else:
            # one word a cell, so that the order of words is that of rows
            out.append(f"<table{attributes}>")
            for _ in range(rng.integers(1, 4)):
                out.append("<tr>")
                for _ in range(rng.integers(1, 4)):
                    out.append(f"<td>{word(inside)}")
            out.append("</table>")

    for _ in range(6):
        node(depth, True, 0)
    return "".join(out), seen


def test_html_shows_all_visible_words_and_no_others():
    rng = np.random.default_rng(11)
    for i in range(300):
        markup, seen = random_page(rng, [0], 1 + i % 6)
        wrapped = "<div>" * 5000 + "<p>" + "İ" * 40 + "</p>" + markup if i % 50 == 0 else markup
        got = [w for w in to_text(wrapped).replace("|", " ").split() if w not in ("-", "İ" * 40)]
        assert got == seen, markup


@pytest.mark.parametrize(
    "markup, text",
    [
        ("<div>" * 125 + "<p hidden>secret</p>shown", "shown"),
        ("<div>" * 3000 + "<table><tr><td>a<td>bb<tr><td>cc<td>d</table>", "a  | bb\ncc | d"),
        ("<p>" + "İ" * 60 + "</p><script>x</script><p>after text</p><p>end</p>", "İ" * 60 + "\n\nafter text\n\nend"),
        ("<script>a</scripts>b</SCRIPT\n>c", "c"),
        ("<head><title>T</title>Hello <b>world</b>", "Hello world"),
        ("<svg><title>no</title><g><text>one</text><text>two</text></g>no</svg>three", "one two three"),
        ("<div style='visibility:hidden'>a<p style='visibility:visible'>b</p>c</div>d", "b\n\nd"),
        ("<div style='display:none'>a<p style='display:block'>b</div>c", "c"),
        ("<p style='visibility:hidden;visibility:visible'>a", "a"),
        ("<table><tr><td rowspan=0>a<td>b" + "<tr><td>c" * 1200 + "</table>", "a | b" + "\n  | c" * 1200),
        ("<table><tr><td colspan=1000>a<td>b</table>", "a | b"),
        ("<xmp><b>x</b></xmp>", "<b>x</b>"),
        ("a<!-->b<!--->c<!-- x --!>d", "abcd"),
    ],
)
def test_html_faults_of_old(markup, text):
    assert to_text(markup) == text


def test_html_deep_and_long():
    for tag in ("div", "span", "ul><li", "blockquote", "table><tr><td", "p"):
        assert "core" in to_text(f"<{tag}>" * 20_000 + "core" + "</div>" * 100)
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert to_text(deep) == "core"
    assert to_text("<table><tr><td>" * 500 + "x").strip(" |\n") == "x"
    assert len(to_text("<p>word</p>" * 50_000).split()) == 50_000
    assert to_text("<" * 20_000).count("<") == 20_000
    assert to_text("<a b='" * 3000) is not None


def test_html_query_keeps_every_page_and_word(spark):
    rows = queries.op2_html_text(spark, DATA).collect()
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(html) and all(r["text"] == to_text(html[r["page_id"]]) for r in rows)
    # no word of the text comes from elsewhere than the page
    letters = re.compile(r"[A-Za-z]+")
    for r in rows:
        assert r["text"] and set(letters.findall(r["text"])) <= set(letters.findall(unescape(html[r["page_id"]])))
    odd = spark.createDataFrame([(1, None, "t"), (1, "<p>a", "t"), (None, "", "t")], "page_id long, html string, text string")
    assert sorted(map(tuple, html_text.extract_text(odd).collect()), key=str) == [(1, "a"), (1, None), (None, "")]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def verdicts(spark, pages, redirects=None):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    edges = spark.createDataFrame(redirects, "src string, dst string") if redirects is not None else None
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(df, rules, edges).collect()}


def test_rules_by_hand(spark):
    urls = ["http://a.Example.COM/en/1?x#y", "https://www.example.com/en/", "https://w.www.example.com/en/z", "http://x.net/es/", "http://x.net/es", "http://notnet/es/", "net/es/", None, "http://net/fr/a", "http://x.com", "ftp://q.org/?http://x.net/es/", "http://x.com#/en/", ""]
    got = verdicts(spark, [(u, None) for u in urls])
    assert [got[i] for i in range(len(urls))] == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("w.www.example.com", "/en/z", "www.example.com/en/", "allow"),
        ("x.net", "/es/", "net/es/", "block"), ("x.net", "/es", None, "allow"), ("notnet", "/es/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("net", "/fr/a", "net/fr/", "block"), ("x.com", "", None, "allow"), ("q.org", "/", None, "allow"), ("x.com", "", None, "allow"), ("", "", None, "allow"),
    ]


def test_block_decisions_reach_aliases(spark):
    canon = lambda to: f'<html><head><LINK href="{to}" data-x=1 rel="canonical"></head>'
    pages = [
        ("http://a.org/1", '<link rel="canonical" href="http://b.org/1">'),
        ("http://b.org/1#frag", None),
        ("http://c.org/1", '<meta http-equiv="refresh" content="0; url=http://b.org/1">'),
        ("http://good.com/1", '<link rel=canonical href=http://b.org/1>'),
        ("http://d.org/x/y", '<link rel="canonical" href="z">'),
        ("http://d.org/x/z", None),
        ("http://e.org/", '<link rel="canonical" href="//bad.net/es/q">'),
        ("http://f.org/p", '<link rel="stylesheet" href="http://b.org/1">'),
        ("http://g.org/p", canon("http://good.com/1")),
    ]
    got = verdicts(spark, pages, [("http://b.org/1", "http://x.net/fr/9"), (None, "http://a.org/1")])
    assert [got[i][3] for i in range(len(pages))] == ["block", "block", "block", "allow", "allow", "allow", "block", "allow", "block"]
    assert got[3][2] == "com/"


def test_aliases_equal_brute_force_components(spark):
    """A random graph of links of all kinds; a union-find over normal urls decides."""
    rng = np.random.default_rng(4)
    names = [f"http://{h}/{'abcde'[i % 5]}/{i}" for i, h in enumerate(rng.choice(["q.org", "r.org", "s.com", "t.org"], 120))] + ["http://x.net/fr/1", "http://www.example.com/en/2", "http://example.com/en/3", "http://y.net/es/"]
    parent = {u: u for u in names}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    pages, redirects = [], []
    for u in names[:120]:
        markup = "<p>text"
        if rng.random() < 0.75:
            v = names[rng.integers(0, len(names))]
            host, path = v[7:].split("/", 1)
            same = u[7:].split("/", 1)[0] == host
            to = [v, v.replace(host, host.upper()), f"//{host}/{path}", f"/{path}" if same else v, f"../../zz/./../{path}" if same else v, v + "#part"][rng.integers(0, 6)]
            kind = rng.integers(0, 4)
            if kind == 0:
                redirects.append((u.replace("http://", "HTTP://"), v))
            else:
                markup = [f"<!-- <link rel=canonical href=http://x.net/fr/1> --><link rel='canonical' href='{to}'>", f'<META HTTP-EQUIV="refresh" content="0;url={to}">', f"<link rel=stylesheet href=http://x.net/fr/1><link href=\"{to}\" rel=canonical>"][kind - 1]
            parent[find(u)] = find(v)
        pages.append((u, markup))
    pages += [(u, None) for u in names[120:]] + [(names[0] + "#x", None), ("http://x.net", '<link rel=canonical href="http://q.org/q">'), ("http://x.net/", None)]
    got = verdicts(spark, pages, redirects)

    def own(u):
        host, path = (u[7:].split("#")[0].split("/", 1) + [""])[:2]
        fit = [(len(h + p), v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fit)[1] if fit else None

    blocked = {find(u) for u in names if own(u) == "block"}
    for i, (u, _) in enumerate(pages[: len(names) + 1]):
        assert got[i][3] == (own(u) or ("block" if find(u.split("#")[0]) in blocked else "allow")), u
    assert {got[i][3] for i in range(120)} == {"allow", "block"}


def test_very_long_urls(spark):
    long = "http://x.net/es/" + "a/" * 50_000
    assert verdicts(spark, [(long, f'<link rel="canonical" href="http://q.org/{"b" * 50_000}">'), ("http://q.org/" + "b" * 50_000, None)])[1][3] == "block"


def test_url_filters_of_nothing_and_repeats(spark):
    assert verdicts(spark, []) == {}
    df = spark.createDataFrame([(1, "http://x.net/es/", None)] * 3, "page_id long, url string, html string")
    assert url_filters.judge(df, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 3


def test_warc_derivatives_link_and_round_trip(spark):
    body = b"<html><p>caf\xe9 &amp; co</p></html>"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-A: one\r\n two\r\n\r\n"
    rows = [
        ("k1", "<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", warc_derivatives.digest(body), head + body),
        ("k2", None, "http://b/", None, "sha1:WRONG", b"HTTP/1.0 404 Not Found\nContent-Type: text/plain\n\nplain"),
        ("k3", "<urn:uuid:3>", None, None, None, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"),
        ("k4", None, None, None, None, None),
        ("k4", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "source_key string, record_id string, target_uri string, warc_date string, payload_digest string, block binary")
    records = warc_derivatives.build_derivatives(df)
    got = {}
    for r in records.collect():
        got.setdefault(r["source_key"], []).append(r)
    assert [(k, [r["record_type"] for r in v]) for k, v in sorted(got.items())] == [("k1", ["metadata", "conversion"]), ("k2", ["metadata", "conversion"]), ("k3", ["metadata"]), ("k4", ["metadata", "metadata"])]
    meta, text = got["k1"]
    assert bytes(text["block"]).decode() == "café & co" and text["refers_to"] == meta["refers_to"] == "<urn:uuid:1>" and text["digest_matches"]
    fields = bytes(meta["block"]).decode()
    assert f"conversion-record-id: {text['record_id']}" in fields and "http-header-x-a: one two" in fields and "http-status-line: HTTP/1.1 200 OK" in fields
    assert got["k2"][0]["digest_matches"] is False and "source-payload-digest: sha1:WRONG" in bytes(got["k2"][0]["block"]).decode()
    assert got["k2"][0]["refers_to"] == got["k2"][1]["refers_to"]
    folder, manifest = warc_derivatives.write_warc(records.repartition(2))
    store, path = fs.FileSystem.from_uri(folder)
    parsed = {}
    for m in manifest.collect():
        with store.open_input_stream(f"{path}/{m['file']}", compression=None) as f:
            for heads, block in warc_derivatives.parse_warc(gzip.decompress(f.read())):
                parsed.setdefault(heads["WARC-Record-ID"], (heads, block))
    want = {r["record_id"]: r for v in got.values() for r in v}
    assert parsed.keys() == want.keys()
    for k, (heads, block) in parsed.items():
        assert block == bytes(want[k]["block"]) and heads["WARC-Block-Digest"] == warc_derivatives.digest(block) and heads["WARC-Refers-To"] == want[k]["refers_to"]


@pytest.mark.parametrize(
    "heads, body, text",
    [
        ("Transfer-Encoding: chunked", b"5\r\n<p>he\r\n3;x=y\r\nllo\r\n0\r\n\r\n", "hello"),
        ("Transfer-Encoding: Chunked", b"5\r\n<p>he\r\nff\r\ncut off", "hecut off"),
        ("Transfer-Encoding: chunked", b"<p>not chunked", "not chunked"),
        ("Content-Encoding: gzip", gzip.compress(b"<p>a &amp; b"), "a & b"),
        ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", b"%x\r\n%s\r\n0\r\n\r\n" % (len(gzip.compress(b"<p>both")), gzip.compress(b"<p>both")), "both"),
        ("Content-Encoding: deflate", zlib.compress(b"<p>zlib"), "zlib"),
        ("Content-Encoding: deflate", zlib.compress(b"<p>raw")[2:-4], "raw"),
        ("Content-Encoding: gzip", b"broken", ""),
        ("Content-Encoding: br", b"unknown", None),
        ("X: y", b"<p>" + b"word " * 200_000, "word " * 199_999 + "word"),
    ],
)
def test_warc_bodies_lose_their_codings(heads, body, text):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + heads.encode() + b"\r\n\r\n" + body
    got = list(warc_derivatives.derive("k", None, "http://a/", None, None, block))
    assert [r[1] for r in got] == ["metadata", "conversion"][: 1 + (text is not None)]
    if text is not None:
        assert got[1][-1].decode() == text
    record = warc_derivatives.serialize(dict(zip(warc_derivatives._NAMES, got[-1])))
    (heads, _), = warc_derivatives.parse_warc(record)
    assert heads["WARC-Date"] == warc_derivatives.NO_DATE and heads["WARC-Refers-To-Payload-Digest"] == warc_derivatives.digest(body)


def test_warc_digest_of_the_body_without_chunks(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Type: text/plain\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    rows = [("k", None, "http://a/", None, warc_derivatives.digest(b"abc"), block, 1, "x")]
    df = spark.createDataFrame(rows, "source_key string, record_id string, target_uri string, warc_date string, payload_digest string, block binary, content_length int, record_type string")
    assert [(r["digest_matches"], bytes(r["block"])) for r in warc_derivatives.build_derivatives(df).where("record_type = 'conversion'").collect()] == [(True, b"abc")]


def test_warc_query(spark):
    rows = queries.op7_warc_derivatives(spark, DATA)
    n = spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert rows.where("record_type = 'metadata'").count() == n == rows.where("record_type = 'conversion'").count()
    assert rows.select("record_id").distinct().count() == 2 * n
    empty = spark.read.parquet(f"{DATA}/pages.parquet").limit(0)
    assert warc_derivatives.build_derivatives(warc_derivatives.responses_of_pages(empty)).count() == 0


# what pages must not do


def test_slashes_dialogs_details_and_plaintext():
    for markup, want in {
        "<p>a<span hidden/>secret</span>b": "ab",  # the slash means nothing outside of svg and math
        "<b/>x<i hidden/>y</i>z": "xz",
        '<p>a<svg/>b<svg><path d="x"/><text>t</text></svg>c': "ab t c",
        "<svg><g hidden/>x<text>y</text></svg>z": "y z",
        "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
        "<details><summary>s</summary>hid<p>x</p></details><details open><summary>t</summary>in</details>z": "s\nt\nin\nz",
        "<pre>a<dialog>no</dialog>b</pre>": "ab",
        "a<listing>x  y\n z</listing>b": "a\n\nx  y\n z\n\nb",
        "a<plaintext>c <b>d</b></plaintext>": "a\n\nc <b>d</b></plaintext>",
        'a <b title="x>y">c</b>': "a c",
        "a <b title='<i>'>c</b> < d <3": "a c < d <3",
    }.items():
        assert html_text.to_text(markup) == want, markup


def test_text_is_a_small_multiple_of_the_markup():
    pages = [
        "<table>" + "<tr><td>a<td>b<td>c" * 2000 + "<tr><td>" + "w" * 200_000 + "<td>x</table>",
        "<table>" + "".join(f"<tr><td colspan={i % 900 + 1}>a<td>b" for i in range(4000)),
        "<table>" + "".join(f"<tr><td rowspan=60000 colspan={i + 1}>a<td>b" for i in range(900)),
        "<blockquote>" * 3000 + "x<br>" * 3000,
        "<ul><li>" * 3000 + "x<br>" * 3000,
        ("<table><tr><td>" + "y" * 99 + "<td>z<tr><td>1<td>2</table>") * 500,
    ]
    for page in pages:
        text = html_text.to_text(page)
        assert len(text) <= 20 * len(page) + 1000
        # only blanks and bars differ from the words of the page
        words = re.sub("<[^>]*>", " ", page).split()
        assert [x for x in re.sub(r"[|\-]", " ", text).split()] == words or "rowspan" in page


def test_tags_without_an_end_take_linear_time():
    import time

    for unit in ('<a "', "<a b='\"", '<a href="x>', "<a ", "<a b=\"c\" '", "<", "<!--", "<p title='a\">b "):
        start = time.perf_counter()
        html_text.to_text(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - start < 30, unit  # about a second on an idle machine; minutes if it were quadratic


def test_any_charset_gives_text():
    from encodings.aliases import aliases

    labels = {*aliases, *aliases.values(), "undefined", "idna", "punycode", "unicode_escape", "rot13", "base64", "mbcs", "utf-7", "x" * 500, "..", "-"}
    body = bytes(range(256)) * 2 + "é".encode()
    for label in labels:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset={label}\r\n\r\n".encode() + body
        assert [r[1] for r in warc_derivatives.derive("k", None, "u", None, None, block)] == ["metadata", "conversion"]
    assert [warc_derivatives.codec(x) for x in ("latin1", "US-ASCII", "Shift-JIS", "utf-16le", "windows-1251", "undefined", "nonsense")] == ["cp1252", "cp1252", "shift_jis", "utf-16-le", "cp1251", "utf-8", "utf-8"]


def test_heads_end_at_their_first_empty_line_and_bodies_have_a_bound(monkeypatch):
    import gzip

    for end in ("\n\n", "\r\n\r\n", "\n\r\n"):
        block = f"HTTP/1.1 200 OK\nContent-Type: text/html{end}<p>a</p>\r\n\r\n<p>b</p>".encode()
        assert list(warc_derivatives.derive("k", None, "u", None, None, block))[1][-1] == b"a\n\nb"
    monkeypatch.setattr(warc_derivatives, "MOST_BODY", 1 << 16)
    monkeypatch.setattr(warc_derivatives.uncompress, "__defaults__", (1 << 16,))
    for size, kinds in ((1 << 16, ["metadata", "conversion"]), ((1 << 16) + 1, ["metadata"]), (50_000_000, ["metadata"])):
        for parts in (1, 3):
            packed = b"".join(gzip.compress(b"a" * n) for n in [size // parts] * (parts - 1) + [size - size // parts * (parts - 1)])
            rows = list(warc_derivatives.derive("k", None, "u", None, None, b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Encoding: gzip\r\n\r\n" + packed))
            assert [r[1] for r in rows] == kinds and (b"conversion-refused: body of more than 65536 bytes" in rows[0][-1]) == (len(kinds) == 1)


def test_links_are_read_from_attributes_of_tags_only(spark):
    """Longer attribute names, names in values, scripts, comments and styles give no links; quoted ends of tags do no harm."""
    bad = "http://bad.org/"
    pages = {
        f'<link rel="canonical" data-href="http://ok.org/" href="{bad}">': True,
        f'<link data-rel="canonical" href="{bad}">': False,
        f"<link title='rel=canonical href={bad}' href='{bad}'>": False,
        f'<script>var x = \'<link rel="canonical" href="{bad}">\';</script>': False,
        f'<style>/* <link rel="canonical" href="{bad}"> */</style><link rel=canonical href={bad}>': True,
        f'<!-- <link rel="canonical" href="{bad}"> -->': False,
        f'<script>"<!--"</script><link title="a > b" rel="nofollow Canonical" href=" {bad} ">': True,
        f'<meta data-http-equiv="refresh" content="0; url={bad}">': False,
        f"<META HTTP-EQUIV=Refresh CONTENT='0;URL={bad}'>": True,
        f'<meta http-equiv="refresh" data-content="0; url={bad}" content="5">': False,
        f'<linkx rel="canonical" href="{bad}">': False,
        f'<link rel="canonical" rel="next" href="{bad}"/>': True,
        f'<link rel="next" rel="canonical" href="{bad}">': False,
        f'<textarea><link rel="canonical" href="{bad}"></textarea>': False,
        '<link rel="canonical" ' + "a='b' " * 5000 + f'href="{bad}">': False,  # beyond what a tag is looked through for
    }
    rows = [(i, f"http://page{i}.org/x", h) for i, h in enumerate(pages)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["src"] for r in url_filters.page_links(df).where("dst LIKE '%bad.org%'").collect()}
    assert {int(re.search(r"page(\d+)", x)[1]) for x in found} == {i for i, (h, link) in enumerate(pages.items()) if link}
