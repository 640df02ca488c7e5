"""Trees of inodes: walks by pointer doubling, listings, lookups, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.scratch import drop, written


def _climb(rows: DataFrame, pending: str, step, name: str) -> DataFrame:
    """rows (inode, to, ...) after every row in state `pending` has followed its pointer until none is left.

    Each step joins the open rows with the table itself and doubles what a pointer spans, so a tree of depth n takes log2(n) steps
    of any number of rows. After as many steps as the longest chain can need, rows still open go round in circles, and stay open.
    """
    rows = written(rows, name)
    steps = max(1, rows.count()).bit_length() + 1
    for _ in range(steps):
        if not rows.where(pending).limit(1).count():
            break
        before = rows
        rows = written(rows.where(f"not ({pending})").unionByName(step(rows.where(pending), rows)), name)
        drop(before)
    return rows


def paths(nodes: DataFrame, root: int = 1) -> DataFrame:
    """inode and path of every inode that the root reaches, at any depth. Inodes below a missing parent, or in a circle, have no row."""

    def step(waiting: DataFrame, rows: DataFrame) -> DataFrame:
        up = rows.select(F.col("inode").alias("to"), F.col("to").alias("__to"), F.col("path").alias("__head"))
        return waiting.join(up, "to").select("inode", F.col("__to").alias("to"), F.concat("__head", "path").alias("path"))

    start = nodes.where(F.col("inode") != root).select("inode", F.col("parent").alias("to"), F.concat(F.lit("/"), "name").alias("path"))
    found = _climb(start, f"to <> {root}", step, "tree-paths").where(F.col("to") == root).select("inode", "path")
    return nodes.where(F.col("inode") == root).select("inode", F.lit("").alias("path")).unionByName(found)


def scopes(nodes: DataFrame, root: int = 1) -> DataFrame:
    """inode and scope of every inode: `root` for the root, else ino:<its ancestor just below the root>, or the ancestor that is its own parent. Where an ancestor is missing, or they go in a circle, it is ino:<the inode itself>."""

    def step(waiting: DataFrame, rows: DataFrame) -> DataFrame:
        up = rows.select(F.col("inode").alias("to"), F.col("to").alias("__to"), F.col("state").alias("__state"))
        return waiting.join(up, "to", "left").select("inode", F.col("__to").alias("to"), F.coalesce("__state", F.lit("lost")).alias("state"))

    anchor = F.col("parent").isin(root) | (F.col("parent") == F.col("inode"))
    start = nodes.where(F.col("inode") != root).select("inode", F.when(anchor, F.col("inode")).otherwise(F.col("parent")).alias("to"), F.when(anchor, "found").otherwise("open").alias("state"))
    found = _climb(start, "state = 'open'", step, "tree-scopes")
    key = F.concat(F.lit("ino:"), F.when(F.col("state") == "found", F.col("to")).otherwise(F.col("inode")).cast("string"))
    return nodes.where(F.col("inode") == root).select("inode", F.lit("root").alias("scope")).unionByName(found.select("inode", key.alias("scope")))


def lookup(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """parent, name and inode of the wanted names (parent, name); null where there is no such entry."""
    return wanted.join(edges.select("parent", "name", "inode"), ["parent", "name"], "left")


def attribute_names(attributes: DataFrame) -> DataFrame:
    """inode and the sorted names of its extended attributes (inode, name)."""
    return attributes.groupBy("inode").agg(F.array_sort(F.collect_set("name")).alias("names"))


def resolve(nodes: DataFrame, wanted: DataFrame, root: int = 1) -> DataFrame:
    """path and inode of each wanted path (slashes without a name between them count once); absent paths have no row."""
    clean = F.concat_ws("/", F.lit(""), F.array_join(F.filter(F.split("path", "/"), lambda p: p != ""), "/"))
    asked = wanted.select(F.col("path").alias("asked"), F.when(clean == "/", "").otherwise(clean).alias("path"))
    return asked.join(paths(nodes, root), "path").select(F.col("asked").alias("path"), "inode")


def readdir(nodes: DataFrame, parent: int | None = None) -> DataFrame:
    """Entries of a directory, or of all, by name (in bytes), with attributes."""
    rows = nodes.where("parent <> 0") if parent is None else nodes.where(F.col("parent") == parent)
    return rows.orderBy("parent", "name")


def children(nodes: DataFrame) -> DataFrame:
    """Directories with their number of entries: only those with none may be removed."""
    n = nodes.where("parent <> 0").groupBy(F.col("parent").alias("inode")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.where("type = 'dir'").select("inode").join(n, "inode", "left").select("inode", F.coalesce("n", F.lit(0)).alias("entries"))


def unreachable(nodes: DataFrame, root: int = 1) -> DataFrame:
    """Inodes whose parent is gone, the root spared."""
    alive = nodes.select(F.col("inode").alias("parent"))
    return nodes.where(F.col("inode") != root).join(alive, "parent", "left_anti")
