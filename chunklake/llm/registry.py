"""Queries op1 .. op10 and pipeline over the driver's tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, lm_scoring, minhash_dedup, mixing, neighbours, quality_rules, sharding, substring_dedup, token_counts, url_filter
from .common import read, shuffle_width

SHARDS = 8
#: (host, path, verdict), fixed by the contract.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: Target shares of the tokens by domain.
MIX_WEIGHTS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def op1_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.groups(read(spark, sf_dir, "documents"), minhash_dedup.Setting(shingle=3, percent=85))


def op2_shard_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), SHARDS)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read(spark, sf_dir, "pages"), rules, shuffle_width(spark))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), MIX_WEIGHTS).drop("doc")


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.maintain(read(spark, sf_dir, "documents"))


def op7_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_multiprobe_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_substring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(read(spark, sf_dir, "documents"))


def near_sql(docs: str, shingle: int, percent: int) -> str:
    """CTEs d, s, n, links and reach (doc_id, other) over a relation with doc_id and text: all links by exact set sizes."""
    return f"""
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(w[i:i + {shingle - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 2}, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (k) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (min(x.n) + min(y.n) - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)"""


def op10_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


OP1_SQL = "WITH RECURSIVE " + near_sql("documents", 3, 85) + """
SELECT doc_id, CAST(coalesce(min(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
OP3_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, pa, v) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + r""")
SELECT page_id, host, path, (SELECT h || pa FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pa) ORDER BY length(h || pa) DESC, length(h) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pa) ORDER BY length(h || pa) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""

#: What is left after copies of a text have gone, counted anew under both versions.
OP6_SQL = r"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS t FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, coalesce(source, ''), coalesce(lang, '')) = 1)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) + 1) AS BIGINT) AS n_tokens FROM d GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words-2', count(*), CAST(sum(len(regexp_extract_all(t, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]'))) AS BIGINT) FROM d GROUP BY source, lang
"""
#: Counts of every document; all rules of the cascade as one condition.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
hit AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM hit) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same
  FROM d LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 25 * n_words OR 100 * (len(ls) - len(list_distinct(ls))) > 50 * len(ls)
    OR 100 * up > 50 * (up + low) OR 100 * same > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
cov AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN cov USING (doc_id)
"""


def queries() -> dict:
    return {"op1_superminhash_dedup": op1_superminhash_dedup, "op2_shard_jump": op2_shard_jump, "op3_url_rules": op3_url_rules, "op4_soft_mixing": op4_soft_mixing, "op5_quality_cascade": op5_quality_cascade, "op6_token_rollup": op6_token_rollup, "op7_bpe_pair_index": op7_bpe_pair_index, "op8_multiprobe_pstable": op8_multiprobe_pstable, "op9_substring_windows": op9_substring_windows, "op10_attention_scores": op10_attention_scores}


def oracle_sql() -> dict[str, str]:
    return {"op1_superminhash_dedup": OP1_SQL, "op3_url_rules": OP3_SQL, "op5_quality_cascade": OP5_SQL, "op6_token_rollup": OP6_SQL, "op9_substring_windows": OP9_SQL}
