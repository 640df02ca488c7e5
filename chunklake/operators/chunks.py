"""Chunking, hashing and dedup accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_chunks(objects: DataFrame, size: int) -> DataFrame:
    """domain, doc_id, ref, seq, chunk_hash and size of each slice of `size` bytes of data. Empty or null data has no chunks."""
    n = F.ceil(F.octet_length("data") / F.lit(size)).cast("int")
    rows = objects.where(F.octet_length("data") > 0).withColumn("seq", F.explode(F.sequence(F.lit(0), n - 1)))
    piece = F.substring(F.col("data"), F.col("seq") * size + 1, F.lit(size))
    return rows.select("domain", "doc_id", "ref", F.col("seq").cast("bigint").alias("seq"), F.sha2(piece, 256).alias("chunk_hash"), F.octet_length(piece).cast("bigint").alias("size"))


def first_stored(chunks: DataFrame) -> DataFrame:
    """One row per (domain, chunk_hash): that of the smallest doc_id, then seq. Partial aggregation: a hot chunk sends one row from each task."""
    first = F.min(F.struct("doc_id", "seq", "size")).alias("f")
    return chunks.groupBy("domain", "chunk_hash").agg(first).select("domain", "chunk_hash", "f.doc_id", "f.seq", "f.size")


def probe(chunks: DataFrame) -> DataFrame:
    """Per object: logical bytes, bytes newly stored, chunks, new chunks, and running totals in its domain.

    A chunk is reused iff an earlier object of the domain stored it; repeats inside one object are stored again.
    """
    owner = chunks.groupBy("domain", "chunk_hash").agg(F.min("doc_id").alias("owner"))
    new = F.col("owner") == F.col("doc_id")
    rows = chunks.join(owner, ["domain", "chunk_hash"]).groupBy("domain", "doc_id").agg(
        F.sum("size").alias("logical"), F.coalesce(F.sum(F.when(new, F.col("size"))), F.lit(0)).alias("physical"), F.count(F.lit(1)).alias("chunks"), F.count(F.when(new, 1)).alias("new_chunks")
    )
    so_far = Window.partitionBy("domain").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"logical_total": F.sum("logical").over(so_far), "physical_total": F.sum("physical").over(so_far)}).withColumn("reuse_pct", reuse("logical", "physical"))


def reuse(logical: str, physical: str) -> Column:
    """Whole percent of logical bytes that were not stored; 0 for no bytes."""
    return F.when(F.col(logical) > 0, F.floor((F.col(logical) - F.col(physical)) * 100 / F.col(logical))).otherwise(F.lit(0)).cast("bigint")


def unique_bytes(chunks: DataFrame) -> DataFrame:
    """Per domain: chunks, distinct chunks, bytes and bytes of distinct chunks."""
    per_hash = chunks.groupBy("domain", "chunk_hash").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.sum("size").alias("bytes"))
    return per_hash.groupBy("domain").agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum("bytes").alias("bytes"), F.sum("size").alias("unique_bytes"))


def prior_reuse(versions: DataFrame) -> DataFrame:
    """owner_key, version, chunks and reused of each version: chunks that the version just before it, of the same key, holds too.

    versions: owner_key, version (compared as a string), hashes array<string>.
    """
    before = F.lag("hashes").over(Window.partitionBy("owner_key").orderBy("version"))
    rows = versions.withColumn("before", F.coalesce(before, F.array().cast("array<string>")))
    reused = F.size(F.filter("hashes", lambda h: F.array_contains(F.col("before"), h)))
    return rows.select("owner_key", "version", F.size("hashes").cast("bigint").alias("chunks"), reused.cast("bigint").alias("reused"))


def lookup(index: DataFrame, packs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Index rows whose pack is usable: state stored, or no pack row at all. wanted (domain, chunk_hash) narrows the lookup."""
    rows = index if wanted is None else index.join(wanted.select("domain", "chunk_hash").distinct(), ["domain", "chunk_hash"], "left_semi")
    state = packs.select("domain", "pack_hash", "state")
    return rows.join(state, ["domain", "pack_hash"], "left").where(F.coalesce("state", F.lit("stored")) == "stored").drop("state")


def verified(chunks: DataFrame) -> DataFrame:
    """chunks (data, offset, size, chunk_hash) with `problem`: out_of_bounds, hash_mismatch or null."""
    piece = F.substring(F.col("data"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    bad = (F.col("offset") < 0) | (F.col("size") <= 0) | (F.col("offset") + F.col("size") > F.octet_length("data"))
    return chunks.withColumn("problem", F.when(bad, "out_of_bounds").when(F.sha2(piece, 256) != F.col("chunk_hash"), "hash_mismatch"))


def check_registered(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (domain, chunk_hash, pack_hash, offset, size) with `status`: absent, mismatch or ok against the index."""
    have = index.select("domain", "chunk_hash", F.struct("pack_hash", "offset", "size").alias("__have"))
    same = F.col("__have") == F.struct("pack_hash", "offset", "size")
    return wanted.join(have, ["domain", "chunk_hash"], "left").withColumn("status", F.when(F.col("__have").isNull(), "absent").when(~same, "mismatch").otherwise("ok")).drop("__have")
