"""Thin queries ``opN_<name>`` over the tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_in_middle, html_text, language_id, lm_scoring, mixing, spelling, token_output, url_filters, vp_tree, warc_derivatives
from .common import small_batches
from .jaccard_join import jaccard_components
from .line_dedup import LineIndex

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_tree.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = "crc32(cast(doc_id AS string)) % 4 = 2"
    model = language_id.fit(docs, f"NOT ({held_out})")
    rows = docs.select("doc_id", "text", F.expr(held_out).alias("held_out"))
    return language_id.predict(rows, model, ["doc_id", "held_out"])


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_derivatives.build_derivatives(warc_derivatives.responses_of_pages(table(spark, sf_dir, "pages")))
    return records.withColumn("page_id", F.col("source_key").cast("long")).drop("source_key")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), "crc32(cast(doc_id AS string)) % 7 <> 2")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = LineIndex(spark, least=10).insert(docs)
    kept = index.dedup(docs, digest=True)
    index.drop()
    return kept


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.samples(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_vp_tree, op2_html_text, op3_url_filters, op4_mixing, op5_language_id, op6_token_output, op7_warc_derivatives, op8_lm_scoring, op9_jaccard_join, op10_decontaminate, op11_spelling_variants, op12_line_dedup, op13_fill_in_middle)}

# Links and components can't be followed in the check data's SQL without recursion over the markup; the pages hold none, so
# rules decide alone there, and tests on small tables cover the propagation.
ORACLE_SQL = {
    "op3_url_filters": r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict, false AS alias_blocked
FROM (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, h || p) AS k
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
WHERE k = 1
""",
    # crc32 by its table, then counts of tokens and pairs of the training rows; the automaton's weights in closed form (without a history, counts are 0 and the priors stand alone)
    "op8_lm_scoring": r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT CAST(range AS UBIGINT), CAST(range AS UBIGINT), 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc(id, s, p, c) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), 1, CAST(4294967295 AS UBIGINT) FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL SELECT id, s, p + 1, xor(crc.c >> 8, bits.c) FROM crc JOIN bits ON bits.k = 8 AND bits.i = xor(crc.c, CAST(ascii(substr(s, p, 1)) AS UBIGINT)) & 255 WHERE p <= length(s)),
split AS (SELECT id, xor(c, CAST(4294967295 AS UBIGINT)) % 7 = 2 AS held_out FROM crc WHERE p = length(s) + 1),
words AS (SELECT doc_id, held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), NULL) AS w FROM documents JOIN split ON id = doc_id),
tok AS (SELECT doc_id, held_out, i, coalesce(w[i], ' ') AS t, CASE WHEN i > 1 THEN w[i - 1] END AS u, CASE WHEN i > 2 THEN w[i - 2] END AS g FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)),
one AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY 1),
two AS (SELECT u, t, count(*) AS c FROM tok WHERE NOT held_out AND u IS NOT NULL GROUP BY 1, 2),
three AS (SELECT g, u, t, count(*) AS c FROM tok WHERE NOT held_out AND g IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT sum(c) AS n, count(*) AS v, count(*) FILTER (WHERE c = 1) AS n1, count(*) FILTER (WHERE c = 2) AS n2 FROM one),
d AS (SELECT CAST(n AS BIGINT) AS n, v, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END AS d FROM m),
x AS (SELECT doc_id, held_out, coalesce(one.c, 0) AS c, coalesce(ctx.c, 0) AS cu, coalesce(two.c, 0) AS cut, coalesce(his.c, 0) AS cgu, coalesce(three.c, 0) AS cgut, n, v,
             CASE WHEN coalesce(one.c, 0) > 0 THEN (one.c - d) / n ELSE d * v / n END AS p1
      FROM tok CROSS JOIN d LEFT JOIN one ON one.t = tok.t LEFT JOIN one ctx ON ctx.t = tok.u LEFT JOIN two ON two.u = tok.u AND two.t = tok.t
      LEFT JOIN two his ON his.u = tok.g AND his.t = tok.u LEFT JOIN three ON three.g = tok.g AND three.u = tok.u AND three.t = tok.t),
y AS (SELECT *, (cut + 400 * p1) / (cu + 400) AS p2 FROM x)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, any_value(n) AS train_tokens,
       sum(log10((c + 1) / (n + v + 1))) AS base_score, sum(log10((cgut + 5 * p2) / (cgu + 5))) AS score
FROM y GROUP BY doc_id, held_out
""",
    "op9_jaccard_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(c) AS component_id FROM r GROUP BY 1) ON node = doc_id
""",
    # crc32 by its table over the bytes of `<doc_id>:<run>`; pairs at one edit by words with one code point left out
    "op11_spelling_variants": r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT CAST(range AS UBIGINT), CAST(range AS UBIGINT), 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
pairs AS (SELECT doc_id, run, count(*) AS m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
keys AS (SELECT DISTINCT x FROM pairs),
crc(x, p, c) AS (
  SELECT x, 1, CAST(4294967295 AS UBIGINT) FROM keys
  UNION ALL SELECT x, p + 2, xor(crc.c >> 8, bits.c) FROM crc JOIN bits ON bits.k = 8 AND bits.i = xor(crc.c, CAST('0x' || substr(x, p, 2) AS UBIGINT)) & 255 WHERE p <= length(x)),
h AS (SELECT x, xor(c, CAST(4294967295 AS UBIGINT)) AS h FROM crc WHERE p = length(x) + 1),
results AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, m FROM pairs JOIN h USING (x)),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
less AS (SELECT word, n, i, left(word, CAST(i - 1 AS INT)) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word FROM less a JOIN words b ON a.d = b.word),
ranked AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS k FROM near JOIN words o ON o.word = other),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
chain(word, last, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN forms f ON f.word = chain.form)
SELECT f.word, f.form, chain.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain ON chain.word = f.word AND chain.form IS NULL
""",
    "op12_line_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, r, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key GROUP BY r, doc_id
""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS k FROM documents),
h AS (SELECT doc_id, t, k, len(k) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(k) + 1) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(k) + 1) AS h2,
             CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
c AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(k[1:least(h1, h2)], '') AS p, array_to_string(k[least(h1, h2) + 1:greatest(h1, h2)], '') AS m, array_to_string(k[greatest(h1, h2) + 1:], '') AS x FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
""",
}
