"""Compaction plans: fill, candidates, budget and the guard that a pass must pay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.operators.packing import budget


def fill(packs: DataFrame, live_chunks: DataFrame) -> DataFrame:
    """packs (domain, pack_no, size, stored) with live bytes and the fill in thousandths: of stored (compressed) bytes as the store judges it, and of logical bytes."""
    live = live_chunks.groupBy("domain", "pack_no").agg(F.sum("size").alias("live"), F.count_distinct("ref").alias("keys"))
    rows = packs.join(live, ["domain", "pack_no"], "left").withColumns({"live": F.coalesce("live", F.lit(0)), "keys": F.coalesce("keys", F.lit(0))})
    mille = lambda whole: F.when(F.col(whole) > 0, F.floor(F.col("live") * 1000 / F.col(whole))).otherwise(F.lit(0)).cast("bigint")
    return rows.withColumns({"fill_stored": mille("stored"), "fill_logical": mille("size")})


def candidates(filled: DataFrame, min_fill: int, min_bytes: int, most_live: int, target: int) -> DataFrame:
    """Packs to rewrite, per domain in pack order: fill below min_fill thousandths or stored below min_bytes (0: off), within the live-byte
    budget; none of a domain where fewer than two are left or the rewrite would not lower the number of packs."""
    poor = F.lit(False)
    if min_fill > 0:
        poor = poor | (F.col("fill_stored") < min_fill)
    if min_bytes > 0:
        poor = poor | (F.col("stored") < min_bytes)
    rows = budget(filled.where(poor & (F.col("live") > 0)), ["pack_no"], "live", most_live, ["domain"])
    w = Window.partitionBy("domain")
    n, live = F.count(F.lit(1)).over(w), F.sum("live").over(w)
    return rows.withColumns({"__n": n, "__new": F.ceil(live / target)}).where((F.col("__n") >= 2) & (F.col("__new") < F.col("__n"))).drop("__n", "__new")


def result(scanned: DataFrame, selected: DataFrame, keys: DataFrame, target: int) -> DataFrame:
    """One row on a pass: packs scanned, selected and to be written (a domain's live bytes in packs of `target`), manifests to be rewritten (keys: domain, pack_no, ref) and bytes rewritten."""
    per = selected.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("live").alias("live"))
    sums = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("packs_selected"), F.coalesce(F.sum(F.ceil(F.col("live") / target)), F.lit(0)).alias("packs_written"), F.coalesce(F.sum("live"), F.lit(0)).alias("bytes_rewritten"))
    refs = keys.join(selected.select("domain", "pack_no"), ["domain", "pack_no"], "left_semi").agg(F.count_distinct("domain", "ref").alias("manifests_rewritten"))
    return scanned.agg(F.count(F.lit(1)).alias("packs_scanned")).crossJoin(sums).crossJoin(refs)  # one row each
