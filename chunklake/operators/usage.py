"""Usage accounting: domain totals, file system statistics, rates between samples, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def domain_usage(packs: DataFrame, index: DataFrame, objects: DataFrame) -> DataFrame:
    """Per domain: physical (pack) bytes, bytes of distinct chunks, apparent object bytes (0 where there is nothing) and logical / physical in thousandths (0 without packs)."""
    parts = [
        packs.groupBy("domain").agg(F.sum("stored").alias("physical")), index.groupBy("domain").agg(F.sum("size").alias("unique_bytes")), objects.groupBy("domain").agg(F.sum("size_b").alias("apparent")),
    ]
    rows = parts[0].join(parts[1], "domain", "full").join(parts[2], "domain", "full")
    rows = rows.select("domain", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("physical", "unique_bytes", "apparent")])
    return rows.withColumn("ratio_milli", ratio_milli("unique_bytes", "physical"))


def ratio_milli(logical: str, physical: str) -> Column:
    return F.when(F.col(physical) > 0, F.floor(F.col(logical) * 1000 / F.col(physical))).otherwise(F.lit(0)).cast("bigint")


def fs_stats(nodes: DataFrame, slices: DataFrame, leases: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """One row: files, dirs, others, logical bytes; slices, distinct slices, their live bytes; active leases; source_to_live_ratio in thousandths."""
    count = lambda c: F.count(F.when(c, 1))
    a = nodes.agg(count(F.col("type") == "file").alias("files"), count(F.col("type") == "dir").alias("dirs"), count(~F.col("type").isin("file", "dir")).alias("others"), F.coalesce(F.sum(F.when(F.col("type") == "file", F.col("length"))), F.lit(0)).alias("logical"))
    b = slices.agg(F.count(F.lit(1)).alias("slices"), F.count_distinct("slice_id").alias("distinct_slices"), F.coalesce(F.sum("slen"), F.lit(0)).alias("live_bytes"))
    rows = a.join(b)  # one row each
    if leases is not None:
        rows = rows.join(leases.agg(count(F.col("expires") > now).alias("active_leases")))
    return rows.withColumn("source_to_live_ratio_milli", ratio_milli("logical", "live_bytes"))


def rates(samples: DataFrame, group: list[str], time: str, counters: list[str]) -> DataFrame:
    """Change of each counter a second since the sample before; no seconds count as one. The first sample of a group has none."""
    w = Window.partitionBy(*group).orderBy(time)
    secs = F.greatest(F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(w)), F.lit(1))
    return samples.withColumns({f"{c}_rate": (F.col(c) - F.lag(c).over(w)) / secs for c in counters})


def hit_percent(hits: Column, misses: Column) -> Column:
    """Whole percent of hits; 0 without any."""
    return F.when(hits + misses > 0, F.floor(hits * 100 / (hits + misses))).otherwise(F.lit(0)).cast("bigint")


def histogram(rows: DataFrame, group: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Rows per bucket: le is the first bound at or above the value, infinity beyond the last."""
    le = F.lit(float("inf"))
    for b in reversed(bounds):
        le = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(le)
    return rows.groupBy(*group, le.alias("le")).agg(F.count(F.lit(1)).alias("n"))


def counters(rows: DataFrame, tenant: str, names: list[str]) -> DataFrame:
    """Report counters added up per tenant."""
    return rows.groupBy(tenant).agg(*[F.sum(n).alias(n) for n in names])


def observed(rows: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, Observation]:
    """rows, and the sink of their measures (a count, if none are given): filled by the action that runs over the rows, without a pass of its own."""
    sink = Observation(name)
    return rows.observe(sink, *(measures or [F.count(F.lit(1)).alias("rows")])), sink


def audited(rows: DataFrame, actor: Column, action: str, at: Column) -> DataFrame:
    """An audit record for each row of an operation: actor, action, time, and the row as JSON."""
    return rows.select(actor.alias("actor"), F.lit(action).alias("action"), at.alias("at"), F.to_json(F.struct(*rows.columns)).alias("detail"))


def tenants(quota: DataFrame, positive: bool = False) -> DataFrame:
    """Tenants with a quota row; or only those with bytes or objects."""
    rows = quota.where((F.col("bytes") > 0) | (F.col("objects") > 0)) if positive else quota
    return rows.select("tenant").distinct()


def object_sizes(chunks: DataFrame, declared: DataFrame, key: list[str]) -> DataFrame:
    """declared (key, size_b) with the sum of the chunks and whether they agree."""
    total = chunks.groupBy(*key).agg(F.sum("size").alias("total"))
    return declared.join(total, key, "left").withColumn("total", F.coalesce("total", F.lit(0))).withColumn("agrees", F.col("total") == F.col("size_b"))
