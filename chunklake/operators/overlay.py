"""Newest-wins overlays of slices, as interval sweeps. Every join has the inode as an equality key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(slices: DataFrame, lo: int, hi: int, keys: tuple[str, ...] = ("inode",)) -> DataFrame:
    """inode, start, end, slice_id and src_off of the window [lo, hi): at each place the slice with the highest id; holes have slice_id 0.

    The window is cut at every boundary of a slice; of the slices over a piece, the newest wins, and equal neighbours are joined again.
    """
    k = list(keys)
    cut = slices.select(*k, "id", "slice_id", "pos", "soff", F.greatest("pos", F.lit(lo)).alias("a"), F.least(F.col("pos") + F.col("slen"), F.lit(hi)).alias("b"))
    seen = cut.where("a < b")
    ends = slices.select(*k).distinct().select(*k, F.explode(F.array(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"))).alias("p"))
    bounds = seen.select(*k, F.explode(F.array("a", "b")).alias("p")).unionByName(ends).distinct()
    nxt = F.lead("p").over(Window.partitionBy(*k).orderBy("p"))
    pieces = bounds.withColumn("q", nxt).where("q is not null")
    over = pieces.join(seen, k).where("a <= p and b >= q")
    newest = over.groupBy(*k, "p", "q").agg(F.max(F.struct("id", "slice_id", "pos", "soff")).alias("s"))
    placed = pieces.join(newest, [*k, "p", "q"], "left").select(
        *k, F.col("p").alias("start"), F.col("q").alias("end"), F.coalesce("s.slice_id", F.lit(0)).alias("slice_id"),
        F.when(F.col("s").isNull(), 0).otherwise(F.col("s.soff") + F.col("p") - F.col("s.pos")).cast("bigint").alias("src_off"),
    )
    w = Window.partitionBy(*k).orderBy("start")
    goes_on = (F.lag("slice_id").over(w) == F.col("slice_id")) & ((F.col("slice_id") == 0) | (F.lag("src_off").over(w) + F.col("start") - F.lag("start").over(w) == F.col("src_off")))
    rows = placed.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    return rows.groupBy(*k, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("slice_id").alias("slice_id"), F.min("src_off").alias("src_off")).drop("__run")


def truncate(slices: DataFrame, size) -> DataFrame:
    """The slices after a cut to `size`: those from there on go, those across it end there."""
    return slices.where(F.col("pos") < size).withColumn("slen", F.least("slen", size - F.col("pos")))


def length_after(slices: DataFrame, old: DataFrame) -> DataFrame:
    """inode and length: the longer of the old length and the furthest end of a slice."""
    ends = slices.groupBy("inode").agg(F.max(F.col("pos") + F.col("slen")).alias("end"))
    return old.join(ends, "inode", "left").select("inode", F.greatest("length", F.coalesce("end", F.lit(0))).alias("length"))


def clone(slices: DataFrame, pairs: DataFrame) -> DataFrame:
    """The slices after copying src to dst for each pair: rows that dst has already, by slice_id, stay as they are."""
    made = slices.join(pairs, F.col("inode") == F.col("src")).withColumn("inode", F.col("dst")).select(*slices.columns)
    return slices.unionByName(made.dropDuplicates(["inode", "slice_id"]).join(slices, ["inode", "slice_id"], "left_anti").select(*slices.columns))


def clone_range(slices: DataFrame, src: int, dst: int, src_index: int, dst_index: int, n: int, strict_reference: bool = False) -> DataFrame:
    """The slices (with indx) after copying n chunk indexes from src to dst.

    The destination range is dropped first. Copies are told apart by (inode, indx, slice_id); with
    strict_reference by (inode, slice_id) alone, which loses a slice that the file holds elsewhere.
    """
    at = lambda ino, first: (F.col("inode") == ino) & F.col("indx").between(first, first + n - 1)
    rest = slices.where(~at(dst, dst_index))
    made = slices.where(at(src, src_index)).withColumns({"inode": F.lit(dst).cast("bigint"), "indx": F.col("indx") + (dst_index - src_index)})
    key = ["inode", "slice_id"] if strict_reference else ["inode", "indx", "slice_id"]
    return rest.unionByName(made.dropDuplicates(key).join(rest, key, "left_anti").select(*slices.columns))


def file_windows(chunks: DataFrame, window: int) -> DataFrame:
    """Chunks (ref, offset, size) in every file window of `window` bytes that they overlap: window_no, lo and hi within it."""
    first, last = F.floor(F.col("offset") / window), F.floor((F.col("offset") + F.col("size") - 1) / window)
    rows = chunks.where("size > 0").withColumn("window_no", F.explode(F.sequence(first, last)))
    base = F.col("window_no") * window
    return rows.withColumns({"lo": F.greatest(F.col("offset") - base, F.lit(0)), "hi": F.least(F.col("offset") + F.col("size") - base, F.lit(window))})


def whole_chunks(chunks: DataFrame, lo: int, hi: int) -> DataFrame:
    """Chunks whose first byte lies in [lo, hi)."""
    return chunks.where(F.col("offset").between(lo, hi - 1))


def dangling(slices: DataFrame, nodes: DataFrame) -> DataFrame:
    """Slices whose file is gone; they would count as live for ever."""
    return slices.join(nodes.select("inode"), "inode", "left_anti")


def read_plan(segs: DataFrame) -> DataFrame:
    """Segments of data, with the bytes to fetch; holes are zeros and need no fetch."""
    return segs.where("slice_id <> 0").select("inode", "slice_id", "src_off", (F.col("end") - F.col("start")).alias("bytes"), "start")
