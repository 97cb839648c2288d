"""The operators applied to whole tables with production parameters, and SQL that says the same where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import decontamination, near_duplicates, packing, quality_rules, secrets, substring_dedup, suffix_dedup, token_counts, toxicity, url_reputation
from inkfold.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, size=1024, end_id=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, limit=1024)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), k=50).drop("spans")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(table(spark, sf_dir, "documents"), k=5, threshold=0.8)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), k=20).drop("kept")


def bad_pages(labels: DataFrame) -> DataFrame:
    """A page counts as bad if its label's quality is 0."""
    return labels.filter("quality IS NOT NULL").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), bad_pages(table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("mean")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


QUERIES = {f.__name__: f for f in (op1_packing, op2_token_counts, op3_suffix_dedup, op4_near_duplicates, op5_secrets, op6_decontamination, op7_substring_dedup, op8_url_filter, op9_toxicity, op10_quality_rules)}

CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORD = r"'[^\x20\x09-\x0D]+'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op6_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {CASE}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {CASE}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + 9], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw))),
hit AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, win)),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM d),
y AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM x),
win AS (SELECT doc_id, i AS p, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM y WHERE i <= n - 19),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM win WHERE nth > 1),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS text, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY x.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_url_filter": rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), {CASE}) AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path
  FROM (SELECT page_id, regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^?#]*') AS rest FROM (SELECT page_id, coalesce(url, '') AS url FROM pages))),
bad AS (SELECT doc_id AS page_id, max((quality = 0)::INT)::DOUBLE AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0) AS k, split_part(regexp_replace(host, ':[0-9]*$', ''), '.', -1) AS suffix,
  CASE WHEN split_part(regexp_replace(host, ':[0-9]*$', ''), '.', -2) = '' THEN regexp_replace(host, ':[0-9]*$', '') ELSE split_part(regexp_replace(host, ':[0-9]*$', ''), '.', -2) || '.' || split_part(regexp_replace(host, ':[0-9]*$', ''), '.', -1) END AS domain
  FROM p LEFT JOIN bad USING (page_id) GROUP BY host),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
sf AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 0.5) / (sum(n) + 1) ELSE 0.5 END FROM h) AS m FROM dm GROUP BY suffix),
s1 AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 THEN 1000 ELSE 1 / least(greatest((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)), 0.001), 0.5) - 1 END AS c FROM sf WHERE n > 0),
d2 AS (SELECT dm.*, (sf.k + c * m) / (sf.n + c) AS m FROM dm JOIN sf USING (suffix), s1),
s2 AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 THEN 1000 ELSE 1 / least(greatest((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)), 0.001), 0.5) - 1 END AS c FROM d2 WHERE n > 0),
h2 AS (SELECT h.*, (d2.k + c * m) / (d2.n + c) AS m FROM h JOIN d2 USING (domain), s2),
s3 AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 THEN 1000 ELSE 1 / least(greatest((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)), 0.001), 0.5) - 1 END AS c FROM h2 WHERE n > 0),
h3 AS (SELECT host, (k + c * m) / (n + c) AS share, n + c AS size FROM h2, s3),
r AS (SELECT p.*, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule = 'org/fr/' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN share - 1.645 * sqrt(share * (1 - share) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN h3 USING (host)""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS p FROM d),
y AS (SELECT doc_id, p, a, lead(a) OVER (PARTITION BY doc_id ORDER BY p) AS b, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY p) AS c FROM x),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM y WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS i FROM win WHERE times > 1) GROUP BY doc_id),
line AS (SELECT doc_id, line, length(translate(line, {BLANKS}, '')) AS chars, length(translate(line, {BLANKS} || '|>•·»', '')) AS no_sep, length(translate(line, {BLANKS} || '#*$%&|<>', '')) AS no_sym,
  len(regexp_extract_all(line, {WORD})) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (SELECT *, (chars - no_sep >= 3 AND (chars - no_sep) * 4 >= n) OR (chars - no_sym) * 10 > chars
  OR (chars <= 200 AND regexp_matches(lower(line), 'cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|subscribe to|sign (in|up)|log in|click here|read more|share (this|on)|skip to'))
  OR (chars <= 24 AND n <= 2 AND NOT regexp_matches(line, '[.!?:;,…。！？"''”’»)\]][\x20\x09-\x0D]*$')) AS fails FROM line WHERE chars > 0),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(chars) FILTER (NOT fails), 0) AS kept_chars FROM judged GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 - kept_chars / word_chars <= 0.5 AS kept FROM b""",
}
