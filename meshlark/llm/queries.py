"""Queries of the corpus operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import decontam, exactdup, hpylm, htmltext, langid, mixing, neardup, pii, quality, shards
from meshlark.llm.spread import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rated, name = mixing.rate_documents(docs)
    return rated.select("doc_id", F.col(name["size"]).alias("size"), F.col(name["source_size"]).alias("source_size"), F.col(name["target"]).alias("target"), (F.col(name["size"]) * F.col(name["copies"])).alias("taken"))


def op2_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, main = htmltext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.col(f"{main}.text")
    return pages.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


def op3_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(docs.filter(~held))
    rows, said = langid.predict(docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text")), model)
    return rows.select("doc_id", held.alias("held_out"), F.coalesce(f"{said}.lang", F.lit("und")).alias("lang_pred"), F.col(f"{said}.score").alias("score"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return hpylm.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, depth=2)


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and whether the document is labelled good and not toxic."""
    return _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))


def op7_select_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = quality.select(_table(spark, sf_dir, "documents").select("doc_id", "text"), good_labels(spark, sf_dir))
    return rows.select("doc_id", F.col(names["log_weight"]).alias("log_weight"), F.col(names["kept"]).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, found = decontam.find_benchmark(docs, _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", F.col(f"{found}.n_words").alias("n_words"), F.col(f"{found}.n_hit").alias("n_hit"), F.size(f"{found}.items").cast("bigint").alias("n_items"), decontam.items_digest(F.col(f"{found}.items")).alias("items_sha256"), (F.col(f"{found}.n_hit") > 0).alias("contaminated"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names, _ = shards.shard_documents(_table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"), F.col(names["shard"]).endswith(".parquet").alias("in_shard"), (F.col(names["version"]) > 0).alias("committed"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, name = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col(name["base"]), F.col(name["spans"])
    counts = [F.size(F.filter(base, pii.of_kind(k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_extract_text": op2_extract_text,
    "op3_identify_language": op3_identify_language,
    "op4_near_dedup": op4_near_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_language_model": op6_language_model,
    "op7_select_quality": op7_select_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_shard": op9_shard,
    "op10_personal_data": op10_personal_data,
}

_SIZED = r"""
sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)"""

SQL = {
    "op1_mix_sources": rf"""
WITH {_SIZED},
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST(source_size * 2.0 AS DOUBLE) AS cap,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM src),
steps AS (
  SELECT *, cap / w AS full_at,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps_before,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_open
  FROM ranked),
lv AS (
  SELECT arg_min(level, full_at) AS level
  FROM (SELECT full_at, (((SELECT sum(source_size) FROM src) * CAST(1.5 AS DOUBLE)) - caps_before) / w_open AS level FROM steps)
  WHERE full_at >= level),
tgt AS (SELECT source, source_size, CASE WHEN w * level > cap THEN cap ELSE w * level END AS target FROM ranked, lv),
rate AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS r,
         CAST('0x' || substr(md5('mix:' || CAST(s.doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(r) + CASE WHEN u < r - floor(r) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rate
""",
    "op4_near_dedup": r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM dw),
ids AS (SELECT doc_id, len(s) AS n, list_sort(list_transform(s, lambda x: hash(x))) AS hs FROM sets),
cls AS (SELECT hs, min(doc_id) AS id, any_value(n) AS n FROM ids WHERE n > 0 GROUP BY hs),
sh AS (SELECT id, n, unnest(hs) AS h FROM cls),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM sh a JOIN sh b ON a.h = b.h AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (SELECT id, id FROM cls UNION SELECT reach.id, sym.b FROM reach JOIN sym ON reach.r = sym.a),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT i.doc_id, CAST(i.n AS BIGINT) AS n_shingles, coalesce(comp.c, i.doc_id) AS component_id, coalesce(comp.c, i.doc_id) = i.doc_id AS kept
FROM ids i LEFT JOIN cls ON i.n > 0 AND i.hs = cls.hs LEFT JOIN comp ON comp.id = cls.id
""",
    "op5_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
iw AS (
  SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT p.doc_id, p.k, p.i, x.item_id FROM pos p JOIN win x ON p.k = x.k AND p.s = x.s),
n_hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN n_hit h ON d.doc_id = h.doc_id LEFT JOIN its t ON d.doc_id = t.doc_id
""",
    "op8_exact_dedup": r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op9_shard": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256, true AS in_shard, true AS committed FROM documents",
    "op10_personal_data": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, 'email' AS kind, 0 AS ord, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS f, regexp_split_to_array(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g FROM t
  UNION ALL SELECT doc_id, 'ip', 1, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_split_to_array(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM t
  UNION ALL SELECT doc_id, 'card', 2, regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), regexp_split_to_array(text, '[0-9]([\x20-]?[0-9])+') FROM t
  UNION ALL SELECT doc_id, 'phone', 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM t),
placed AS (
  SELECT doc_id, kind, ord, f[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, regexp_replace(f[i], '[^0-9]', '', 'g') AS d
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m)),
base AS (
  SELECT doc_id, kind, ord, v, s, s + length(v) AS e FROM placed
  WHERE kind = 'email' OR (kind = 'ip' AND list_max(list_transform(string_split(v, '.'), lambda x: TRY_CAST(x AS DOUBLE))) <= 255) OR (kind = 'phone' AND length(d) BETWEEN 9 AND 15)
    OR (kind = 'card' AND length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) ELSE CAST(d[i] AS INT) * 2 - CASE WHEN CAST(d[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)),
near AS (
  SELECT doc_id, text, entity, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS term
  FROM (SELECT DISTINCT b.doc_id, t.text, lower(b.v) AS entity FROM base b JOIN t ON t.doc_id = b.doc_id)),
pairs AS (SELECT entity, term, count(DISTINCT doc_id) AS n_both FROM near GROUP BY entity, term HAVING count(DISTINCT text) >= 3),
ents AS (SELECT lower(v) AS entity, count(DISTINCT doc_id) AS n_entity FROM base GROUP BY 1),
terms AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS term FROM t) WHERE term IN (SELECT term FROM pairs) GROUP BY term),
risky AS (
  SELECT p.entity, p.term FROM pairs p JOIN ents e ON p.entity = e.entity JOIN terms w ON p.term = w.term, (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)
  WHERE ln(n / n_entity) > 0 AND ln(n_both * n / (n_entity * greatest(n_term, n_both))) / ln(n / n_entity) >= 0.8),
held AS (SELECT DISTINCT b.doc_id, r.term FROM base b JOIN risky r ON lower(b.v) = r.entity),
words AS (
  SELECT doc_id, f[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, f, g, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS f, regexp_split_to_array(text, '\p{L}+') AS g FROM t WHERE doc_id IN (SELECT doc_id FROM held)))),
found AS (SELECT w.doc_id, 'term' AS kind, 4 AS ord, w.v, w.s, w.s + length(w.v) AS e FROM words w JOIN held h ON w.doc_id = h.doc_id AND lower(w.v) = h.term
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.s + length(w.v) AND w.s < b.e)),
spans AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e) AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM found) GROUP BY doc_id),
own AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS x, count(*) FILTER (kind = 'email') AS a, count(*) FILTER (kind = 'ip') AS b, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS d FROM base GROUP BY doc_id)
SELECT t.doc_id, coalesce(o.a, 0) AS n_email, coalesce(o.b, 0) AS n_ip, coalesce(o.c, 0) AS n_card, coalesce(o.d, 0) AS n_phone, sha256(coalesce(o.x, '')) AS base_sha256, coalesce(s.x, '') AS spans
FROM t LEFT JOIN own o ON t.doc_id = o.doc_id LEFT JOIN spans s ON t.doc_id = s.doc_id
""",
}
