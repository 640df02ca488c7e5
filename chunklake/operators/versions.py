"""Versioned manifests: latest, history, retention, tag rewrites. Versions compare as strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _newest(key: list[str]):
    return F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("version")))


def latest(manifests: DataFrame, key: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """The row of the highest version of each key (of the wanted keys). The row_number filter is a group limit below the exchange."""
    rows = manifests if wanted is None else manifests.join(wanted.select(*key).distinct(), key, "left_semi")
    return rows.withColumn("__r", _newest(key)).where("__r = 1").drop("__r")


def history(manifests: DataFrame, key: list[str]) -> DataFrame:
    """All versions, newest first, with their rank."""
    return manifests.withColumn("rank", _newest(key)).orderBy(*key, "rank")


def prune_keep(manifests: DataFrame, key: list[str], keep: int) -> DataFrame:
    """Versions to drop: all but the newest `keep` of each key; none if keep <= 0."""
    if keep <= 0:
        return manifests.limit(0)
    return manifests.withColumn("__r", _newest(key)).where(F.col("__r") > keep).drop("__r")


def prune_age(manifests: DataFrame, key: list[str], cutoff) -> DataFrame:
    """Versions to drop: created before the cutoff, but never the newest of a key. Rank is by version, age by created_at."""
    return manifests.withColumn("__r", _newest(key)).where((F.col("__r") > 1) & (F.col("created_at") < cutoff)).drop("__r")


def rewrite_tags(manifests: DataFrame, key: list[str], new: DataFrame, version) -> DataFrame:
    """The next versions of keys in new (key, tags): the latest tags overlaid by the new ones, where an empty value deletes a tag."""
    now = latest(manifests, key)
    names = F.map_keys(F.col("__new"))
    left = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(names, k))
    tags = F.map_filter(F.map_concat(left, F.col("__new")), lambda _, v: v != "")
    return now.join(new.select(*key, F.col("tags").alias("__new")), key).withColumns({"tags": tags, "version": version}).drop("__new")


def append(manifests: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The manifests with new versions: one that is there already, by key and version, is a row written again and replaced."""
    return manifests.join(new.select(*key, "version"), [*key, "version"], "left_anti").unionByName(new.select(*manifests.columns))


def slice_history(slices: DataFrame, wanted: DataFrame) -> DataFrame:
    """All rows of the wanted slices (slice_id), newest write first, with their rank."""
    newest = F.row_number().over(Window.partitionBy("slice_id").orderBy(F.desc("id"), "inode"))
    return slices.join(wanted.select("slice_id").distinct(), "slice_id", "left_semi").withColumn("rank", newest)


def assemble(chunk_rows: DataFrame, key: list[str]) -> DataFrame:
    """Manifests from (key, seq, chunk_hash, pack_hash, offset, size): chunks in stream order, total_size. Rows with an empty pack, size <= 0 or offset < 0 refuse their manifest."""
    bad = (F.coalesce("pack_hash", F.lit("")) == "") | (F.col("size") <= 0) | (F.col("offset") < 0)
    entry = F.struct("seq", F.col("chunk_hash").alias("h"), F.col("pack_hash").alias("p"), F.col("offset").alias("o"), F.col("size").alias("s"))
    rows = chunk_rows.groupBy(*key).agg(F.max(bad).alias("refused"), F.sort_array(F.collect_list(entry)).alias("c"), F.sum("size").alias("total_size"))
    return rows.where("not refused").select(*key, "total_size", F.transform("c", lambda x: x.dropFields("seq")).alias("chunks"))
