"""Writes as next states: each takes the table as it is and a batch, and returns the table as it will be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(state: DataFrame, batch: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of the batch whose key is new are added; of equal keys in the batch the first in order."""
    rows = batch.join(state.select(*key), key, "left_anti").select(*state.columns)
    if order:
        w = Window.partitionBy(*key).orderBy(*order)
        rows = rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    else:
        rows = rows.dropDuplicates(key)
    return state.unionByName(rows)


def upsert(state: DataFrame, batch: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """The batch replaces rows of equal key: whole rows, or the named columns of rows that exist. Keys of the batch are distinct."""
    new = batch.select(*key, F.struct(*[c for c in batch.columns if c not in key]).alias("__new"))
    both = state.withColumn("__old", F.lit(True)).join(new, key, "full")
    out = []
    for c in state.columns:
        if c in key or c not in batch.columns:
            out.append(F.col(c))
        elif columns is not None and c not in columns:
            out.append(F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__new.{c}")).alias(c))
        else:
            out.append(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def delete(state: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return state.join(keys.select(*key).distinct(), key, "left_anti")


def delete_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """Without the refs under a prefix, which must not be empty."""
    if not prefix:
        raise ValueError("an empty prefix would delete everything")
    return objects.where(~F.col("ref").startswith(prefix))


def purge(index: DataFrame, packs: DataFrame, gone: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Index and packs without the given packs. A reclaimed pack leaves both at once, so that no writer takes it for a stored one."""
    return delete(index, gone, key), delete(packs, gone, key)


class NotStored(ValueError):
    """A pack of the batch is being reclaimed."""


def associate(assoc: DataFrame, packs: DataFrame, batch: DataFrame) -> DataFrame:
    """The associations with the batch, or none of it: a pack that isn't stored refuses the whole batch."""
    bad = batch.join(packs.where("state <> 'stored'").select("domain", "pack_hash"), ["domain", "pack_hash"], "left_semi")
    if bad.limit(1).count():
        raise NotStored("a pack of the batch is not stored")
    return insert_if_absent(assoc, batch, ["domain", "pack_hash", "context"])


def append_log(log: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """changes after the log, numbered on from its highest lsn. Numbers are made per range of the order, then shifted: no task holds all rows."""
    last = log.agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0]
    ranged = changes.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    counts = ranged.groupBy("__p").count()
    starts = counts.withColumn("__s", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    rows = ranged.withColumn("__w", within).join(F.broadcast(starts), "__p").withColumn("lsn", F.lit(last) + F.col("__s") + F.col("__w"))  # starts: one row a partition
    return log.unionByName(rows.select(*log.columns))


def keep_last(log: DataFrame, n: int) -> DataFrame:
    """The n entries of highest lsn: a top-n gives the least lsn to keep, so no global window is sorted."""
    if n <= 0:
        return log.limit(0)
    least = log.select("lsn").orderBy(F.desc("lsn")).limit(n).agg(F.min("lsn").alias("least"))
    return log.join(least, F.col("lsn") >= F.col("least"), "left_semi")


def trim(log: DataFrame, up_to: int) -> DataFrame:
    return log if up_to <= 0 else log.where(F.col("lsn") > up_to)


def trim_age(log: DataFrame, cutoff: Column) -> DataFrame:
    return log.where(F.col("ts") >= cutoff)


def set_attributes(nodes: DataFrame, changes: DataFrame, fields: dict[str, int]) -> DataFrame:
    """nodes after changes (inode, mask, and new values): a field changes where its bit is in the mask."""
    new = changes.select("inode", F.col("mask").alias("__mask"), *[F.col(f).alias(f"__{f}") for f in fields])
    rows = nodes.join(new, "inode", "left")
    on = lambda bit: F.coalesce(F.col("__mask").bitwiseAND(F.lit(bit)) != 0, F.lit(False))
    return rows.withColumns({f: F.when(on(b), F.col(f"__{f}")).otherwise(F.col(f)) for f, b in fields.items()}).select(*nodes.columns)


def unlink(edges: DataFrame, nodes: DataFrame, gone: DataFrame, others: list[DataFrame], opened: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """edges, nodes and dependent tables (by inode) without the given entries (parent, name): links fall by one each, and what has none left and isn't open goes everywhere."""
    lost = edges.join(gone.select("parent", "name"), ["parent", "name"], "left_semi").groupBy("inode").agg(F.count(F.lit(1)).alias("__n"))
    left = nodes.join(lost, "inode", "left").withColumn("nlink", F.col("nlink") - F.coalesce("__n", F.lit(0))).drop("__n")
    dead = left.where("nlink <= 0").select("inode")
    if opened is not None:
        dead = dead.join(opened.select("inode"), "inode", "left_anti")
    return delete(edges, gone, ["parent", "name"]), delete(left, dead, ["inode"]), [delete(t, dead, ["inode"]) for t in others]


def link(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges and nodes with new entries (parent, name, inode, type): names that exist stay as they are; links grow by the entries added."""
    added = new.join(edges.select("parent", "name"), ["parent", "name"], "left_anti").dropDuplicates(["parent", "name"]).select(*edges.columns)
    n = added.groupBy("inode").agg(F.count(F.lit(1)).alias("__n"))
    return edges.unionByName(added), nodes.join(n, "inode", "left").withColumn("nlink", F.col("nlink") + F.coalesce("__n", F.lit(0))).drop("__n")


def create(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges and nodes with new inodes (parent, name, inode, type); names that exist are refused; a parent gains a link for each new directory."""
    fresh = new.join(edges.select("parent", "name"), ["parent", "name"], "left_anti")
    dirs = fresh.where("type = 'dir'").groupBy(F.col("parent").alias("inode")).agg(F.count(F.lit(1)).alias("__n"))
    grown = nodes.join(dirs, "inode", "left").withColumn("nlink", F.col("nlink") + F.coalesce("__n", F.lit(0))).drop("__n")
    own = fresh.select("inode", "type", F.when(F.col("type") == "dir", 2).otherwise(1).cast(nodes.schema["nlink"].dataType).alias("nlink"))
    return edges.unionByName(fresh.select(*edges.columns)), grown.unionByName(own.select(*nodes.columns))


def rename(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """edges after moves (parent, name, to_parent, to_name) that don't depend on each other; an entry in the way is replaced. Its file is then found by unlink's rule, not left behind."""
    key = ["parent", "name"]
    there = moves.join(edges.select(*key), key, "left_semi")
    target = there.select(F.col("to_parent").alias("parent"), F.col("to_name").alias("name"))
    moved = edges.join(there, key).withColumns({"parent": F.col("to_parent"), "name": F.col("to_name")}).select(*edges.columns)
    return delete(delete(edges, there, key), target, key).unionByName(moved)


def rename_checked(edges: DataFrame, nodes: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges (parent, name, inode), nodes (inode, type, nlink) and moves with `outcome`, after moves (parent, name, to_parent, to_name, no_replace) that share no entry.

    Outcomes: missing (no source), exists (a target, though no_replace), same (both are one inode: nothing happens), is_dir (a file over a
    directory), not_dir (a directory over a file), not_empty (over a directory with entries), or moved. A directory that is
    replaced goes, and its parent loses a link; a file that is replaced loses a link and goes with its last one. A
    directory that changes its parent takes a link from the old one to the new. Entries of directories are those before all moves.
    """
    key = ["parent", "name"]
    kind = nodes.select("inode", "type")
    src = edges.join(kind, "inode").select(*key, F.col("inode").alias("__src"), F.col("type").alias("__kind"))
    dst = edges.join(kind, "inode").select(F.col("parent").alias("to_parent"), F.col("name").alias("to_name"), F.col("inode").alias("__dst"), F.col("type").alias("__over"))
    held = edges.groupBy(F.col("parent").alias("__dst")).agg(F.count(F.lit(1)).alias("__n"))
    rows = moves.join(src, key, "left").join(dst, ["to_parent", "to_name"], "left").join(held, "__dst", "left")
    over, moving = F.col("__over") == "dir", F.col("__kind") == "dir"
    outcome = (
        F.when(F.col("__src").isNull(), "missing").when(F.col("__dst").isNull(), "moved").when(F.col("no_replace"), "exists").when(F.col("__src") == F.col("__dst"), "same")
        .when(over & ~moving, "is_dir").when(~over & moving, "not_dir").when(over & (F.coalesce("__n", F.lit(0)) > 0), "not_empty").otherwise("moved")
    )
    rows = rows.withColumn("outcome", outcome)
    done = rows.where("outcome = 'moved'")
    changed = F.col("parent") != F.col("to_parent")
    delta = done.where("__over = 'dir'").select(F.col("to_parent").alias("inode"), F.lit(-1).alias("d"))
    delta = delta.unionByName(done.where(moving & changed).select(F.explode(F.array(F.struct(F.col("parent").alias("inode"), F.lit(-1).alias("d")), F.struct(F.col("to_parent").alias("inode"), F.lit(1).alias("d")))).alias("x")).select("x.*"))
    delta = delta.unionByName(done.where("__over <> 'dir'").select(F.col("__dst").alias("inode"), F.lit(-1).alias("d"))).groupBy("inode").agg(F.sum("d").alias("__d"))
    gone = done.where("__over = 'dir'").select(F.col("__dst").alias("inode"))
    left = nodes.join(gone, "inode", "left_anti").join(delta, "inode", "left").withColumn("nlink", F.col("nlink") + F.coalesce("__d", F.lit(0)))
    left = left.where((F.col("nlink") > 0) | F.col("__d").isNull() | (F.col("type") == "dir")).drop("__d").select(*nodes.columns)
    return rename(edges, done.select(*key, "to_parent", "to_name")), left, rows.select(*moves.columns, "outcome")


def reserve(counters: DataFrame, name: str, n: int) -> tuple[DataFrame, int]:
    """counters (name, value) after n numbers of `name` were taken, and the first of them: a batch takes one step of the counter."""
    now = counters.where(F.col("name") == name).select("value").first()
    return counters.withColumn("value", F.when(F.col("name") == name, F.col("value") + n).otherwise(F.col("value"))), now[0]


def exchange(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """edges after each pair of entries (parent, name, to_parent, to_name) that both exist has swapped inodes."""
    key = ["parent", "name"]
    a = edges.select(*key, F.col("inode").alias("__a"))
    b = edges.select(F.col("parent").alias("to_parent"), F.col("name").alias("to_name"), F.col("inode").alias("__b"))
    both = pairs.join(a, key).join(b, ["to_parent", "to_name"])
    new = both.select(*key, F.col("__b").alias("__new")).unionByName(both.select(F.col("to_parent").alias("parent"), F.col("to_name").alias("name"), F.col("__a").alias("__new")))
    return edges.join(new, key, "left").withColumn("inode", F.coalesce("__new", "inode")).select(*edges.columns)


def write_slices(slices: DataFrame, new: DataFrame) -> DataFrame:
    """Slices with new ones; an (inode, slice_id) that is there already was replayed and changes nothing."""
    return insert_if_absent(slices, new, ["inode", "slice_id"])


def quarantined(rows: DataFrame, corrupt: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and rows set aside; together all of them."""
    bad = F.coalesce(corrupt, F.lit(True))
    return rows.where(~bad), rows.where(bad)
