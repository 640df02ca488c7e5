"""Reachability and reclaim, as plans: what is live, what would go, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CorruptManifest(ValueError):
    """A manifest that can't be read: what it refers to is unknown, so nothing may be reclaimed."""


def live_blobs(payloads: DataFrame) -> DataFrame:
    """domain and blob_hash that a manifest (domain, doc, corrupt) refers to: by pack in format v2, by chunk in v1. Refuses to plan beside a corrupt manifest."""
    bad = payloads.where("corrupt").limit(1).count()
    if bad:
        raise CorruptManifest("a manifest can't be read")
    refs = payloads.select("domain", F.col("doc.format").alias("format"), F.explode("doc.chunks").alias("c"))
    return refs.select("domain", F.when((F.col("format") == "v2") & (F.coalesce("c.p", F.lit("")) != ""), F.col("c.p")).otherwise(F.col("c.h")).alias("blob_hash")).distinct()


def live_packs(assoc: DataFrame) -> DataFrame:
    return assoc.select("domain", "pack_no").distinct()


def orphans(stored: DataFrame, live: DataFrame, key: list[str], now: Column, window: int) -> DataFrame:
    """Stored blobs (key, size, created_at) that nothing refers to, with decision: deferred while younger than `window` seconds (0: never), else reclaim."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    lost = stored.join(live, key, "left_anti")
    return lost.withColumn("decision", F.when((age < window) & F.lit(window > 0), "deferred").otherwise("reclaim"))


def report(stored: DataFrame, live: DataFrame, key: list[str], now: Column, window: int) -> DataFrame:
    """Per domain: scanned, live, reclaimed, deferred, bytes to reclaim, and whether an empty live set stands beside stored blobs."""
    found = stored.join(live.withColumn("__live", F.lit(1)), key, "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    gone = F.col("__live").isNull() & ~((age < window) & F.lit(window > 0))
    rows = found.groupBy("domain").agg(
        F.count(F.lit(1)).alias("scanned"), F.count("__live").alias("live"), F.count(F.when(gone, 1)).alias("reclaimed"), F.count(F.when(F.col("__live").isNull() & ~gone, 1)).alias("deferred"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("bytes")
    )
    return rows.withColumn("empty_live_set", (F.col("live") == 0) & (F.col("scanned") > 0))


def slice_orphans(stored: DataFrame, live: DataFrame, cutoff: Column) -> DataFrame:
    """Stored slice ids (the newest created_at of each counts) that no file uses, with deferred for those created after the cutoff."""
    newest = stored.groupBy("slice_id").agg(F.max("created_at").alias("created_at"))
    return newest.join(live.select("slice_id").distinct(), "slice_id", "left_anti").withColumn("deferred", F.col("created_at") > cutoff)


def drop_context(assoc: DataFrame, context: Column) -> tuple[DataFrame, DataFrame]:
    """The associations without a context, and the distinct packs that lost one."""
    gone = F.col("context") == context
    return assoc.where(~gone), assoc.where(gone).select("domain", "pack_no").distinct()


def reclaim_context(assoc: DataFrame, context: Column) -> DataFrame:
    """Packs that a dropped context held, with outcome: still_referenced by another context, or reclaimed."""
    rest, lost = drop_context(assoc, context)
    held = rest.select("domain", "pack_no").distinct().withColumn("__held", F.lit(True))
    return lost.join(held, ["domain", "pack_no"], "left").select("domain", "pack_no", F.when(F.col("__held"), "still_referenced").otherwise("reclaimed").alias("outcome"))


def backfill(chunk_packs: DataFrame) -> DataFrame:
    """The distinct (domain, pack_no, context) that manifests imply."""
    return chunk_packs.select("domain", "pack_no", F.col("ref").alias("context")).distinct()


def backfill_sizes(packs: DataFrame, listing: DataFrame, key: list[str]) -> DataFrame:
    """packs with the length found in a listing where they have none yet."""
    found = listing.select(*key, F.col("length").alias("__length"))
    return packs.join(found, key, "left").withColumn("size", F.coalesce("size", "__length")).drop("__length")


def referenced(wanted: DataFrame, assoc: DataFrame, key: list[str]) -> DataFrame:
    """wanted with `referenced`."""
    return wanted.join(assoc.select(*key).distinct().withColumn("__hit", F.lit(True)), key, "left").withColumn("referenced", F.coalesce("__hit", F.lit(False))).drop("__hit")


def commit_obliterated(packs: DataFrame, assoc: DataFrame, key: list[str]) -> DataFrame:
    """packs after the reclaim step: those marked obliterating that nothing refers to become obliterated, the others of them go back to stored."""
    known = referenced(packs, assoc, key)
    state = F.when(F.col("state") != "obliterating", F.col("state")).when(F.col("referenced"), "stored").otherwise("obliterated")
    return known.withColumn("state", state).drop("referenced")


def reclaim_result(outcomes: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: packs considered, reclaimed and still referenced, and the bytes of those reclaimed. outcomes: domain, pack_no, outcome; sizes: domain, pack_no, size."""
    rows = outcomes.join(sizes.select("domain", "pack_no", "size"), ["domain", "pack_no"], "left")
    of = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    freed = F.coalesce(F.sum(F.when(F.col("outcome") == "reclaimed", F.col("size"))), F.lit(0)).alias("bytes_reclaimed")
    return rows.agg(F.count(F.lit(1)).alias("packs_considered"), of("reclaimed").alias("packs_reclaimed"), of("still_referenced").alias("packs_still_referenced"), freed)


def backfill_counts(assoc: DataFrame) -> DataFrame:
    """Per domain: associations, packs and contexts."""
    return assoc.groupBy("domain").agg(F.count(F.lit(1)).alias("associations"), F.count_distinct("pack_no").alias("packs"), F.count_distinct("context").alias("contexts"))


def zombies(nodes: DataFrame, edges: DataFrame, root: int = 1) -> DataFrame:
    """Inodes without links (nlink <= 0) that no entry of edges names either, the root spared. One that still has an entry is alive."""
    return nodes.where((F.col("nlink") <= 0) & (F.col("inode") != root)).join(edges.select("inode"), "inode", "left_anti")


def stale(objects: DataFrame, cutoff: Column, limit: int = 0) -> DataFrame:
    """Pending objects created at the cutoff or before, oldest first."""
    rows = objects.where(F.col("pending") & (F.col("created_at") <= cutoff)).orderBy("created_at", "ref")
    return rows.limit(limit) if limit > 0 else rows
