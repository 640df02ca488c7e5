"""Queries on puts and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.operators import ingest, packing
from chunklake.plans.storage import new_chunks
from chunklake.sources import fixtures as S

_NONE = "domain string, chunk_hash string, pack_no bigint, offset bigint"


def _put(spark: SparkSession, sf: str) -> ingest.Put:
    return ingest.put(S.chunks(spark, sf), spark.createDataFrame([], _NONE), S.PACK_TARGET)


def put_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of all documents put into an empty store."""
    rows = _put(spark, sf).manifests
    return rows.select("domain", "ref", "total_size", F.size("chunks").cast("bigint").alias("chunks"), F.array_join(F.transform("chunks", lambda c: F.concat(c["p"], F.lit(":"), c["o"].cast("string"))), ",").alias("places"))


def put_again(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents put a second time add no pack, and refer to the first time's."""
    first = _put(spark, sf)
    again = ingest.put(S.chunks(spark, sf), first.index, S.PACK_TARGET, first_pack=1_000_000)
    return again.packs.select("domain", "pack_no").unionByName(again.assoc.groupBy("domain").agg(F.count_distinct("pack_no").alias("pack_no")))


def put_unpacked(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.put_unpacked(S.chunks(spark, sf), spark.createDataFrame([], _NONE))


def batch_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Packs of a batch whose codec changes from document to document by its number: a change closes a pack."""
    rows = new_chunks(spark, sf).withColumn("codec", F.floor(F.col("doc_id") / 4) % 2)
    placed = packing.greedy(rows, "domain", ["doc_id", "seq"], "size", S.PACK_TARGET, breaks=("codec",))
    return placed.groupBy("domain", "pack_no").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("chunks"), F.count_distinct("codec").alias("codecs"))


def multipart_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as uploads of their turns; those of even number ask for an etag that no part has, if they have a turn 3."""
    rows = S.manifests(spark, sf)
    stored = rows.select(F.col("owner_key").alias("upload"), F.col("turn").alias("part"), F.md5("payload").alias("etag"), F.octet_length("payload").cast("bigint").alias("size"))
    asked = rows.select(F.col("owner_key").alias("upload"), F.col("turn").alias("part"), F.when((F.col("turn") == 3) & (F.col("owner_key").cast("long") % 2 == 0), "none").otherwise(F.md5("payload")).alias("etag"))
    return ingest.complete_upload(asked, stored)


def staging_gc(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.staging_report(S.objects(spark, sf), F.expr("timestamp_ntz'2024-01-01 00:02:00'"))


QUERIES = {
    "put_manifests": (put_manifests, """
        SELECT domain, ref, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS chunks, string_agg(pack_no || ':' || off, ',' ORDER BY seq) AS places FROM chunks JOIN (
          SELECT domain, chunk_hash, pack_no, CAST(off AS BIGINT) AS off FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY domain, pack_no ORDER BY doc_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM fold)
          QUALIFY row_number() OVER (PARTITION BY domain, chunk_hash ORDER BY pack_no, off) = 1) USING (domain, chunk_hash) GROUP BY domain, ref"""),
    "put_again": (put_again, "SELECT domain, count(DISTINCT pack_no) AS pack_no FROM chunk_pack GROUP BY domain"),
    "put_unpacked": (put_unpacked, "SELECT domain, chunk_hash, max(size) AS size FROM chunks GROUP BY domain, chunk_hash"),
    "batch_packs": (batch_packs, """SELECT domain, pack_no, CAST(sum(size) AS BIGINT) AS size, count(*) AS chunks, count(DISTINCT codec) AS codecs FROM (
        WITH RECURSIVE n AS (SELECT *, (doc_id // 4) % 2 AS codec FROM new_chunks),
        f AS (SELECT domain, rn, size, codec, 0::BIGINT AS pack_no, size AS filled FROM n WHERE rn = 1
          UNION ALL SELECT n.domain, n.rn, n.size, n.codec, CASE WHEN f.filled >= 4096 OR n.codec <> f.codec THEN f.pack_no + 1 ELSE f.pack_no END, CASE WHEN f.filled >= 4096 OR n.codec <> f.codec THEN n.size ELSE f.filled + n.size END FROM f JOIN n ON n.domain = f.domain AND n.rn = f.rn + 1)
        SELECT * FROM f) GROUP BY domain, pack_no"""),
    "multipart_complete": (multipart_complete, """
        SELECT owner_key AS upload, parts, CASE WHEN ok THEN size END AS size, CASE WHEN ok THEN e END AS etag, CASE WHEN NOT ok THEN 'invalid_part' END AS problem FROM (
          SELECT owner_key, count(*) AS parts, CAST(sum(octet_length(payload)) AS BIGINT) AS size, bool_and(NOT (turn = 3 AND CAST(owner_key AS BIGINT) % 2 = 0)) AS ok, md5(unhex(string_agg(md5(payload), '' ORDER BY turn))) || '-' || count(*) AS e FROM manifests GROUP BY owner_key)"""),
    "staging_gc": (staging_gc, "SELECT domain, count(*) AS scanned, count(*) FILTER (WHERE created_at <= TIMESTAMP '2024-01-01 00:02:00') AS reclaimed, CAST(coalesce(sum(size_b) FILTER (WHERE created_at <= TIMESTAMP '2024-01-01 00:02:00'), 0) AS BIGINT) AS bytes FROM objects WHERE pending GROUP BY domain"),
}
