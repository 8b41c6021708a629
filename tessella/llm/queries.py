"""The registered queries of the text operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, decontaminate, licenses, lines, quality, shards, simhash, token_counts, urls
from .common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses in each whole text of ``documents``, by patience alignment with all templates."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each whole text and of the bytes that they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each whole text."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document: all links of 4 bits or fewer among all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all rules under the current policy."""
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    return quality.apply_policy(entries).select("doc_id", *quality.MEASURES[:5], "base_failed", "kept", "failures")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in windows of all benchmark items, and those items."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without later copies of runs of lines with 50 words or more, as a digest."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_removed", digest.alias("text_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document, for shards of a megabyte of text."""
    return shards.assign(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each document, by a model of the training folds' positives and unlabelled documents."""
    documents = table(spark, sf_dir, "documents")
    return classifier.classify(documents, classifier.train(documents, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_licenses,
        op2_byte_level_bpe,
        op3_token_counts,
        op4_simhash,
        op5_quality_rules,
        op6_url_filter,
        op7_decontamination,
        op8_line_dedup,
        op9_sharding,
        op10_quality_classifier,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op5_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
h AS (SELECT k, p, count(*) OVER (PARTITION BY k, w[p], w[p + 1], w[p + 2]) AS n FROM g),
c AS (SELECT k, count(DISTINCT p + o) AS n FROM h, range(3) r(o) WHERE n > 1 GROUP BY k),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN c USING (k)),
f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (20 * n_symbols > word_chars)::INT
         + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::INT + 16 * (2 * n_capitals > word_chars)::INT
         + 32 * (word_chars > 20 * n_words)::INT + 64 * (word_chars < 2 * n_words)::INT AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed,
       failures = 0 AS kept, failures FROM f
""",
    "op6_url_filter": r"""
WITH r(action, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS s FROM pages),
p AS (SELECT page_id, translate(regexp_extract(s, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(s, '^([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS k FROM u),
m AS (SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(action, length(r.host || r.path)) AS action
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (k)
""",
    "op7_decontamination": r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[s:s + 9] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(g) AS n FROM win),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (SELECT k, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, n WHERE len(w) >= n),
h AS (SELECT k, p, n, item_id FROM s JOIN win ON w[p:p + n - 1] = g),
c AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM h) GROUP BY k),
l AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN l USING (k)
""",
    "op8_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
r AS (SELECT k, doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM d),
v AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM r WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l AS (SELECT *, row_number() OVER o AS seq, sum(w) OVER o AS c FROM v WINDOW o AS (PARTITION BY k ORDER BY pos)),
s AS (SELECT k, list(line ORDER BY seq) AS a FROM l GROUP BY k),
runs AS (
  SELECT x.k, x.seq AS s, min(y.seq) AS e FROM l x JOIN l y ON x.k = y.k AND y.seq >= x.seq AND y.c - x.c + x.w >= 50 GROUP BY ALL
  UNION SELECT x.k, max(y.seq) AS s, x.seq AS e FROM l x JOIN l y ON x.k = y.k AND y.seq <= x.seq AND x.c - y.c + y.w >= 50 GROUP BY x.k, x.seq),
named AS (SELECT runs.k, doc_id, s, e, s.a[runs.s:e] AS g FROM runs JOIN s USING (k) JOIN d USING (k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM named),
gone AS (SELECT DISTINCT k, unnest(range(s, e + 1)) AS seq FROM ranked WHERE n > 1),
lost AS (SELECT k, pos FROM gone JOIN l USING (k, seq)),
kept AS (SELECT k, string_agg(line, chr(10) ORDER BY pos) AS t FROM r ANTI JOIN lost USING (k, pos) GROUP BY k)
SELECT doc_id, (SELECT count(*) FROM v WHERE v.k = d.k) AS n_lines, (SELECT count(*) FROM lost WHERE lost.k = d.k) AS n_removed,
  sha256(coalesce(t, '')) AS text_sha256
FROM d LEFT JOIN kept USING (k)
""",
    "op9_sharding": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
  CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 15) AS BIGINT) AS h FROM documents),
p AS (SELECT *, CAST(b AS INTEGER) AS depth, h >> (60 - b) AS prefix FROM d, range(61) r(b)),
t AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM p GROUP BY ALL HAVING sum(n_bytes) <= 1048576 OR count(*) = 1),
one AS (SELECT k, doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes
  FROM p JOIN t USING (depth, prefix) QUALIFY row_number() OVER (PARTITION BY k ORDER BY depth) = 1),
c AS (SELECT *, CASE WHEN n_bytes <= 131072 THEN 3 WHEN n_bytes <= 262144 THEN 2 WHEN n_bytes <= 524288 THEN 1 ELSE 0 END AS c FROM d ANTI JOIN one USING (k)),
o AS (SELECT *, sum(n_bytes) OVER w - n_bytes AS before, row_number() OVER w - 1 AS n FROM c WINDOW w AS (PARTITION BY h, c ORDER BY n_bytes, doc_id, k ROWS UNBOUNDED PRECEDING)),
g AS (SELECT doc_id, n_bytes, lpad(bin(h), 60, '0') || '-' || c || '-' ||
  CAST(CASE c WHEN 0 THEN n ELSE before // (1048576 - (1048576 >> c)) END AS BIGINT) AS shard, 60 AS depth FROM o),
u AS (SELECT doc_id, n_bytes, shard, depth, shard_bytes FROM one
  UNION ALL SELECT doc_id, n_bytes, shard, depth, CAST(sum(n_bytes) OVER (PARTITION BY shard) AS BIGINT) FROM g)
SELECT *, shard_bytes <= 1048576 AS fits FROM u
""",
}
