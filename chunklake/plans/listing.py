"""Queries on listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions import expr as X
from chunklake.operators import listing as L
from chunklake.operators import mutations as M
from chunklake.sources import fixtures as S

AFTER = "timestamp_ntz'2024-01-01 00:04:00'"


def list_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return L.newest(S.objects(spark, sf), "en/").select("ref", "size_b")


def list_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of 100 (and one more) after the cursor."""
    return L.page(S.objects(spark, sf), "", (F.expr(AFTER), "en/src0/0"), 100).select("domain", "ref", "size_b")


def list_delimiter(spark: SparkSession, sf: str) -> DataFrame:
    return L.entries(S.keys(spark, sf), "", "/").select("entry", "is_prefix", "keys", "size")


def list_cursor(spark: SparkSession, sf: str) -> DataFrame:
    """Cursors of all objects, and what they decode to."""
    rows = S.objects(spark, sf).withColumn("cursor", L.encode_cursor(F.col("created_at"), F.col("ref")))
    back = L.decode_cursor(F.col("cursor"))
    return rows.select("domain", "ref", "cursor", back["at"].alias("at"), back["ref"].alias("back"))


def list_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.keys(spark, sf)
    return rows.select("key", X.continuation_token(F.col("key")).alias("token"), X.uri_encode(F.col("key"), slash=False).alias("encoded"), F.size(X.path_parts(F.col("key"))).cast("bigint").alias("parts"))


def tenant_list(spark: SparkSession, sf: str) -> DataFrame:
    """Objects and bytes of every domain, by name."""
    return S.objects(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("objects"), F.sum("size_b").alias("bytes")).orderBy("domain")


def delete_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return M.delete_prefix(S.objects(spark, sf), "de/src1").select("ref")


def upsert_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Objects after a batch that completes every pending one."""
    rows = S.objects(spark, sf).select("domain", "ref", "size_b", "pending")
    batch = rows.where("pending").select("domain", "ref", (F.col("size_b") + 1).alias("size_b"), F.lit(False).alias("pending"))
    return M.upsert(rows, batch, ["domain", "ref"])


def put_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    """The index of all documents' contents after all pages' contents were offered to it: the existing row wins."""
    rows = S.objects(spark, sf).select("content_hash", F.col("doc_id").alias("id"))
    state = rows.groupBy("content_hash").agg(F.min("id").alias("id"))
    batch = spark.read.parquet(f"{sf}/pages.parquet").select(F.sha2(F.encode("html", "UTF-8"), 256).alias("content_hash"), (-F.col("page_id") - 1).alias("id"))
    return M.insert_if_absent(state, rows.union(batch), ["content_hash"], ["id"])


QUERIES = {
    "list_prefix": (list_prefix, "SELECT ref, size_b FROM objects WHERE starts_with(ref, 'en/')"),
    "list_keyset_page": (list_keyset_page, "SELECT domain, ref, size_b FROM objects WHERE created_at < TIMESTAMP '2024-01-01 00:04:00' OR created_at = TIMESTAMP '2024-01-01 00:04:00' AND ref > 'en/src0/0' ORDER BY created_at DESC, ref LIMIT 101"),
    "list_delimiter": (list_delimiter, "SELECT entry, is_prefix, count(*) AS keys, CAST(sum(size) AS BIGINT) AS size FROM (SELECT CASE WHEN instr(key, '/') > 0 THEN key[1:instr(key, '/')] ELSE key END AS entry, instr(key, '/') > 0 AS is_prefix, size FROM keys WHERE key > '') GROUP BY ALL ORDER BY entry LIMIT 1001"),
    "list_cursor": (list_cursor, "SELECT domain, ref, rtrim(translate(to_base64(encode(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '|' || ref)), '+/', '-_'), '=') AS cursor, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, ref AS back FROM objects"),
    "list_tokens": (list_tokens, "SELECT key, to_base64(encode(key)) AS token, replace(url_encode(key), '%2F', '/') AS encoded, CAST(len(list_filter(string_split(key, '/'), lambda p: p <> '')) AS BIGINT) AS parts FROM keys"),
    "tenant_list": (tenant_list, "SELECT domain, count(*) AS objects, CAST(sum(size_b) AS BIGINT) AS bytes FROM objects GROUP BY domain"),
    "delete_prefix": (delete_prefix, "SELECT ref FROM objects WHERE NOT starts_with(ref, 'de/src1')"),
    "upsert_refs": (upsert_refs, "SELECT domain, ref, CASE WHEN pending THEN size_b + 1 ELSE size_b END AS size_b, false AS pending FROM objects"),
    "put_if_absent": (put_if_absent, "SELECT content_hash, min(doc_id) AS id FROM objects GROUP BY content_hash UNION ALL SELECT h, min(i) FROM (SELECT sha256(html) AS h, -page_id - 1 AS i FROM pages) WHERE h NOT IN (SELECT content_hash FROM objects) GROUP BY h"),
}
