"""The registered queries of these operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontam, importance, langid, linededup, lmscore, media, mixing, neardup, pii, quality, tokencount, urlrules
from .common import remainder, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.learning_labels(table(spark, sf_dir, "labels")))
    scored = quality.quality_scores(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlrules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urlrules.SITE_RULES + urlrules.PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs))
    return langid.predict(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (document, item) pairs found; documents without one have no row."""
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("cover", 4).alias("cover"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lmscore.language_scores(docs, docs.where(remainder("doc_id", 10) != 0))
    return scored.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.payload_media(table(spark, sf_dir, "documents"))
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("feature"), "tile_sha256")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    every = (
        op1_quality, op2_source_mix, op3_url_rules, op4_personal_data, op5_near_duplicates, op6_token_counts, op7_language, op8_benchmark_leaks, op9_language_model, op10_media,
        op11_importance, op12_line_dedup, op13_alignment,
    )
    return {f.__name__: f for f in every}


OP3_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '^([^/]*[.-])?spam-farm\.') OR regexp_matches(host || path, '^([^/]*[.-])?link-farm\.')
      OR regexp_matches(host || path, '^[^/]*\bcasino\b') OR regexp_matches(host || path, '/free-download(s)?(/|$)')
      OR regexp_matches(host || path, '^([^/]*[.-])?xxx([./-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, rk % 3 + 1 AS w, 3*ss AS cap, CAST(sum(ss) OVER () AS BIGINT) AS total FROM s),
o AS (SELECT *, total - coalesce(sum(cap) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open FROM w
  WINDOW before AS (ORDER BY cap/w::DOUBLE, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, rest*w > cap*open AS capped FROM o),
f AS (SELECT max(total) - coalesce(sum(cap) FILTER (WHERE capped), 0) AS rest, sum(w) FILTER (WHERE NOT capped) AS open FROM c),
t AS (SELECT source, rk, ss, total, CASE WHEN capped THEN cap::DOUBLE ELSE (f.rest*w)::DOUBLE/f.open::DOUBLE END AS target FROM c CROSS JOIN f),
q AS (SELECT d.row_id, d.doc_id, d.size, t.rk, t.ss, t.target, t.total,
    CAST(sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT row_id, rk, total, (start + size + k*ss)/target AS finish, size AS words FROM q CROSS JOIN range(3) g(k) WHERE size > 0 AND target > 0),
z AS (SELECT row_id, greatest(0, least(words, total - (sum(words) OVER (ORDER BY finish, rk ROWS UNBOUNDED PRECEDING) - words))) AS took FROM e),
y AS (SELECT row_id, sum(took) AS taken FROM z GROUP BY row_id)
SELECT doc_id, size, ss AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN y ON q.row_id = y.row_id
"""

#: Exact: every pair that shares a run of words is compared, and links are followed to the end.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM w CROSS JOIN unnest(range(1, greatest(len(w) - 3, 2))) u(k) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100*c >= 85*(p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.m = l.x),
g AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT g.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g LEFT JOIN n ON n.doc_id = g.doc_id
"""


#: The checksum is followed byte by byte, once for each distinct run of words; its 256 steps are made by rule.
OP11_SQL = r"""
WITH steps AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS MATERIALIZED (
  SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
n AS MATERIALIZED (SELECT side, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
v AS MATERIALIZED (SELECT f, list_transform(range(0, len(hex(encode(f))) // 2), lambda i: 16*(instr('0123456789ABCDEF', hex(encode(f))[2*i + 1]) - 1) + instr('0123456789ABCDEF', hex(encode(f))[2*i + 2]) - 1) AS bytes FROM (SELECT DISTINCT f FROM n)),
b AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) % 10000 AS b FROM v CROSS JOIN steps),
c AS (SELECT b, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM n JOIN b USING (f) GROUP BY b),
g AS (SELECT b, CAST(floor(1000*ln((t + 1)::DOUBLE*(sum(s) OVER () + 10000)::DOUBLE/((s + 1)::DOUBLE*(sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS g FROM c),
d AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n*g) AS BIGINT) AS weight FROM n JOIN b USING (f) JOIN g USING (b) WHERE side = 0 GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS words, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h FROM w WHERE side = 0),
z AS (SELECT h.doc_id, words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000*ln(-ln((h + 0.5)::DOUBLE/4294967296))) AS BIGINT) AS score FROM h LEFT JOIN d ON h.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (WHERE words >= 20) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= 5*n // 100 THEN k END AS rank FROM r
"""

OP12_SQL = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, k, line[k] AS line, translate(trim(line[k], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, line, unnest(range(1, len(line) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents))),
r AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
x AS (SELECT l.*, r.first IS NOT NULL AND l.doc_id <> r.first AS lost FROM l LEFT JOIN r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM x GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": OP2_SQL, "op3_url_rules": OP3_SQL, "op5_near_duplicates": OP5_SQL, "op11_importance": OP11_SQL, "op12_line_dedup": OP12_SQL}
