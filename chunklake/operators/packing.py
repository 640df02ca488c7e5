"""Packs: greedy assignment, runs, coalesced ranges, stream offsets, cache eviction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy(items: DataFrame, group: str, order: list[str], size: str, target: int, breaks: tuple[str, ...] = ()) -> DataFrame:
    """items with pack_no: items of a group, in order, fill a pack until it holds target bytes or more; then the next begins at 0.
    A change in a column of `breaks` closes a pack that holds anything.

    An ordered fold: the overshoot of a pack is dropped, so it isn't a running sum divided by the target. Each group is
    sorted in one partition and streamed through; memory doesn't grow with the group. The order is part of the result.
    """
    at = items.columns.index(size), items.columns.index(group)
    cut = [items.columns.index(b) for b in breaks]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, pack, filled = object(), (), 0, 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            kinds = list(zip(*[batch.column(c).to_pylist() for c in cut], strict=True)) if cut else [()] * batch.num_rows
            for i, (n, g, kind) in enumerate(zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), kinds, strict=True)):
                if g != now:
                    now, last, pack, filled = g, kind, 0, 0
                elif kind != last:
                    pack, filled, last = pack + (filled > 0), 0, kind
                out[i] = pack
                filled += n
                if filled >= target:
                    pack, filled = pack + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "pack_no"])

    placed = items.repartition(group).sortWithinPartitions(group, *order)
    schema = items.schema.add("pack_no", "long")
    return placed.mapInArrow(fold, schema)


def pack_sizes(packed: DataFrame, group: str, size: str) -> DataFrame:
    return packed.groupBy(group, "pack_no").agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("chunks"))


def offsets(items: DataFrame, group: list[str], order: list[str], size: str, name: str = "offset") -> DataFrame:
    """Bytes of the group before each item."""
    before = F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return items.withColumn(name, F.coalesce(before, F.lit(0)).cast("bigint"))


def runs(items: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of neighbours with equal value: run (from 0), first and last order key, length."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = items.withColumn("__new", new).withColumn("run", F.sum("__new").over(w) - 1)
    return rows.groupBy(*group, "run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length"), F.first(value).alias(value))


def merge_intervals(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Touching or overlapping half-open intervals become one: start, end, parts."""
    w = Window.partitionBy(*group).orderBy(start, end)
    furthest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.when(F.col(start) <= furthest, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(w))
    return rows.groupBy(*group, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("parts")).drop("__island")


def subtract(rows: DataFrame, covered: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What is left of each interval [start, end) of rows without the intervals of covered in the same group."""
    merged = merge_intervals(covered, group, start, end).drop("parts").withColumnsRenamed({"start": "__s", "end": "__e"})
    hits = rows.join(merged, group, "left").where(F.col("__s").isNull() | (F.col("__s") < F.col(end)) & (F.col("__e") > F.col(start)))
    keys = [*group, start, end]
    cuts = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("__s").isNotNull(), F.struct(F.col("__s").alias("s"), F.col("__e").alias("e"))))).alias("c"))
    whole = rows.select(*keys).distinct().join(cuts, keys, "left").withColumn("c", F.coalesce("c", F.array().cast(cuts.schema["c"].dataType)))
    lows = F.concat(F.array(F.col(start)), F.transform("c", lambda x: x["e"]))
    highs = F.concat(F.transform("c", lambda x: x["s"]), F.array(F.col(end)))
    gaps = F.filter(F.arrays_zip(lows.alias("lo"), highs.alias("hi")), lambda g: g["lo"] < g["hi"])
    return whole.select(*[F.col(g) for g in group], F.explode(gaps).alias("g")).select(*group, F.col("g.lo").alias("start"), F.col("g.hi").alias("end"))


def evict(entries: DataFrame, order: list, size: str, most_bytes: int, most_items: int = 0, group: list[str] | None = None) -> DataFrame:
    """entries with `evicted`: counted from the most recent on, all beyond most_bytes or most_items (0: no bound) go. order: most recent first."""
    w = Window.partitionBy(*(group or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = F.sum(size).over(w) > most_bytes
    if most_items > 0:
        over = over | (F.count(F.lit(1)).over(w) > most_items)
    return entries.withColumn("evicted", over)


def budget(candidates: DataFrame, order: list[str], size: str, most: int, group: list[str]) -> DataFrame:
    """The candidates in order while their running size is within `most`; the first always, and none after the first that overflows."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = candidates.withColumns({"__sum": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.row_number().over(w)})
    return rows.where((F.col("__n") == 1) | (F.col("__sum") <= most)).drop("__sum", "__n")


def sequential(reads: DataFrame, group: list[str], order: list[str], trigger: int) -> DataFrame:
    """Runs of reads that each start where the one before ended: run, bytes, and prefetch once a run holds `trigger` bytes. reads: offset, length."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = reads.withColumn("__new", F.when(F.lag(F.col("offset") + F.col("length")).over(w) == F.col("offset"), 0).otherwise(1)).withColumn("run", F.sum("__new").over(w))
    so_far = F.sum("length").over(Window.partitionBy(*group, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run_bytes", so_far).withColumn("prefetch", F.col("run_bytes") >= trigger).drop("__new")


def in_order(writes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """writes (offset, length) with `valid`: whether all writes up to here began where the bytes so far ended, so that a running hash still holds."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = writes.withColumn("__ok", (F.col("offset") == before).cast("int"))
    return rows.withColumn("valid", F.min("__ok").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("__ok")
