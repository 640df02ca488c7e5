"""Sources: Parquet tables, blob listings, manifest folders, log tails and metric texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blob_listing(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """blob_id, length and ts of every file below path whose name starts with prefix. Contents aren't read: the column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return files.where(name.startswith(prefix)).select(name.alias("blob_id"), "length", F.col("modificationTime").cast("timestamp_ntz").alias("ts"))


def blob_id_parts(blob_id: Column) -> Column:
    """struct<domain, hash> of pack-<domain>-<64 hex>; null where the id isn't one. A domain may hold dashes; `_` stands for none."""
    pattern = r"(?s)^pack-(.*)-([0-9a-f]{64})$"
    domain = F.regexp_extract(blob_id, pattern, 1)
    return F.when(blob_id.rlike(pattern), F.struct(F.when(domain == "_", "").otherwise(domain).alias("domain"), F.regexp_extract(blob_id, pattern, 2).alias("hash")))


def manifest_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """metadata.json files at tenant/workspace/user/owner/version; paths of another depth are skipped."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").option("multiLine", "true").json(path)
    names = ("tenant", "workspace", "user_field", "owner_key", "version")
    pattern = re.escape(path.rstrip("/")) + "/([^/]+)" * len(names) + "/metadata\\.json$"
    rows = rows.withColumn("__file", F.col("_metadata.file_path")).where(F.col("__file").rlike(pattern))
    return rows.select(*[F.regexp_extract("__file", pattern, i).alias(n) for i, n in enumerate(names, 1)], *[c for c in rows.columns if c != "__file"])


def manifest_payloads(manifests: DataFrame) -> DataFrame:
    """Manifest rows with `doc` (parsed payload) and `corrupt`. Bad JSON parses to nulls in every field: that, not a null struct, marks a corrupt payload."""
    doc = F.from_json(F.col("payload").cast("string"), schemas.MANIFEST_PAYLOAD)
    return manifests.withColumn("doc", doc).withColumn("corrupt", F.col("doc.format").isNull() & F.col("doc.chunks").isNull())


def slice_ids(manifests: DataFrame) -> DataFrame:
    """id (unsigned) and created_at of manifests whose owner_key is s/<number>."""
    return manifests.where(F.col("owner_key").rlike("^s/[0-9]+$")).select(F.substring("owner_key", 3, 40).cast("decimal(20,0)").alias("id"), "created_at")


def folder_usage(spark: SparkSession, path: str) -> DataFrame:
    """files, bytes and the oldest ts over names that don't start with a dot."""
    files = blob_listing(spark, path)
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.min(F.when(~F.col("blob_id").startswith("."), F.col("ts"))).alias("oldest"))


def metric_samples(lines: DataFrame, value: str = "value") -> DataFrame:
    """name and total of each counter in exposition text; label variants are added up, comments and other lines skipped."""
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{[^}]*\})?\s+([-+0-9.eE]+)\s*$"
    rows = lines.where(F.col(value).rlike(pattern))
    return rows.groupBy(F.regexp_extract(value, pattern, 1).alias("name")).agg(F.sum(F.regexp_extract(value, pattern, 2).cast("double")).alias("total"))


def log_tail(changelog: DataFrame, after: int) -> DataFrame:
    """Entries with lsn > after, in order; pushed to the scan."""
    return changelog.where(F.col("lsn") > after).orderBy("lsn")
