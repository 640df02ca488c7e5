"""Queries on inodes, slices and their overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions import expr as X
from chunklake.operators import gc, mutations, overlay, packing, tree, usage
from chunklake.sources import fixtures as S

#: Files that are gone: every seventh order, so that slices are left without one.
GONE = "inode % 7 = 3"


def overlay_segments(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.segments(S.slices(spark, sf), 0, 1000)


def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.slices(spark, sf).select("inode", F.col("pos").alias("lo"), (F.col("pos") + F.col("slen")).alias("hi"))
    return packing.merge_intervals(rows, ["inode"], "lo", "hi")


def interval_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What no slice covers of each file's first 1000 bytes."""
    rows = S.slices(spark, sf)
    whole = rows.select("inode").distinct().select("inode", F.lit(0).cast("bigint").alias("start"), F.lit(1000).cast("bigint").alias("end"))
    return packing.subtract(whole, rows.select("inode", F.col("pos").alias("start"), (F.col("pos") + F.col("slen")).alias("end")), ["inode"])


def truncate_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.truncate(S.slices(spark, sf), F.lit(300)).select("inode", "slice_id", "pos", "slen")


def file_length(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.slices(spark, sf)
    return overlay.length_after(rows, rows.select("inode").distinct().withColumn("length", F.lit(500).cast("bigint")))


def read_plan(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.read_plan(overlay.segments(S.slices(spark, sf), 100, 400)).groupBy("inode").agg(F.count(F.lit(1)).alias("fetches"), F.sum("bytes").alias("bytes"))


def clone_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every file copied to the next number, which may hold slices of its own."""
    rows = S.slices(spark, sf)
    pairs = rows.select(F.col("inode").alias("src")).distinct().withColumn("dst", F.col("src") + 1)
    return overlay.clone(rows, pairs).groupBy("inode").agg(F.count(F.lit(1)).alias("n"), F.sum("slen").alias("bytes"))


def slice_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Stored slices that no file uses any more; those of late lines are too young to go."""
    rows = S.slices(spark, sf)
    stored = rows.select("slice_id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int))").alias("created_at"))
    return gc.slice_orphans(stored, rows.where(f"not ({GONE})"), F.expr("timestamp_ntz'2024-01-01 00:04:00'")).select("slice_id", "deferred")


def dangling_slices(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.slices(spark, sf)
    return overlay.dangling(rows, rows.select("inode").distinct().where(f"not ({GONE})")).select("inode", "slice_id")


def zombie_inodes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a balance have no links; every second of them still has its entry, and so lives."""
    nodes = S.nodes(spark, sf).withColumn("nlink", F.when((F.col("type") == "file") & (F.col("length") == 0), 0).otherwise(1))
    return gc.zombies(nodes, nodes.where("inode % 2 = 0").select("parent", "name", "inode")).select("inode")


def scope_of(spark: SparkSession, sf: str) -> DataFrame:
    """The tree without its third region, so that all below it is lost."""
    return tree.scopes(S.nodes(spark, sf).where("inode <> 12"))


def path_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer, by its path with a doubled slash."""
    region, nation, customer = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("region", "nation", "customer"))
    names = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return tree.resolve(S.nodes(spark, sf), names.select(F.concat_ws("/", F.lit(""), "r_name", F.lit(""), "n_name", "c_name").alias("path")))


def readdir_plus(spark: SparkSession, sf: str) -> DataFrame:
    return tree.readdir(S.nodes(spark, sf)).select("parent", "name", "inode", "type", "length")


def child_count(spark: SparkSession, sf: str) -> DataFrame:
    return tree.children(S.nodes(spark, sf))


def unreachable_inodes(spark: SparkSession, sf: str) -> DataFrame:
    """Inodes whose directory has gone with the third region."""
    return tree.unreachable(S.nodes(spark, sf).where("inode <> 12")).select("inode")


def fs_stats_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return usage.fs_stats(S.nodes(spark, sf), S.slices(spark, sf))


def unlink_files(spark: SparkSession, sf: str) -> DataFrame:
    """Inodes and their entries after all customers of the first nation were unlinked."""
    nodes = S.nodes(spark, sf)
    edges = nodes.where("parent <> 0").select("parent", "name", "inode")
    gone = edges.where("parent = 100")
    left, alive, _ = mutations.unlink(edges, nodes.select("inode", "type", F.lit(1).alias("nlink")), gone, [])
    return alive.join(left, "inode", "left").select("inode", "type", "nlink", "parent")


def rename_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Entries after every nation of the first region moved under the second."""
    edges = S.nodes(spark, sf).where("parent <> 0").select("parent", "name", "inode")
    moves = edges.where("parent = 10").select("parent", "name", F.lit(11).cast("bigint").alias("to_parent"), F.concat(F.lit("moved-"), "name").alias("to_name"))
    return mutations.rename(edges, moves)


def hash_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """Which writes of a file still allow a running hash: each event writes as many bytes as its value says, where the last but every fifth write ended."""
    events = S.changelog(spark, sf).select(F.col("ino").alias("inode"), "lsn", F.greatest(F.floor("value"), F.lit(1)).cast("bigint").alias("length"))
    rows = packing.offsets(events, ["inode"], ["lsn"], "length").withColumn("offset", F.when(F.col("lsn") % 5 == 4, F.col("offset") + 1).otherwise(F.col("offset")))
    return packing.in_order(rows, ["inode"], ["lsn"]).select("inode", "lsn", "valid")


def sequential_runs(spark: SparkSession, sf: str) -> DataFrame:
    events = S.changelog(spark, sf).select(F.col("ino").alias("inode"), "lsn", F.greatest(F.floor("value"), F.lit(1)).cast("bigint").alias("length"))
    rows = packing.offsets(events, ["inode"], ["lsn"], "length").withColumn("offset", F.when(F.col("lsn") % 5 == 4, F.col("offset") + 1).otherwise(F.col("offset")))
    return packing.sequential(rows, ["inode"], ["lsn"], 100).select("inode", "lsn", F.col("run").cast("bigint").alias("run"), "run_bytes", "prefetch")


def invalidation_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Things that each change makes stale; the payloads name no directory, so that only inode changes show."""
    rows = S.changelog(spark, sf).withColumn("op", F.col("op") + 4)
    named = F.concat(F.lit('{"src_parent":'), F.col("ino").cast("string"), F.lit(',"src_name":"a","dst_parent":0}'))
    return rows.select("lsn", F.explode(X.invalidations(F.col("ino"), F.col("op"), named)).alias("i")).select("lsn", "i.kind", "i.ino", "i.name")


def changelog_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.keep_last(S.changelog(spark, sf), 500).select("lsn", "ino", "op")


def changelog_trim_age(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.changelog(spark, sf)
    latest = rows.agg((F.max("ts") - F.expr("interval 12 hours")).alias("cutoff"))
    return rows.join(latest, F.col("ts") >= F.col("cutoff"), "left_semi").select("lsn")


def changelog_horizon(spark: SparkSession, sf: str) -> DataFrame:
    return S.changelog(spark, sf).agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("horizon"))


_NEW = "CASE WHEN lag(slice_id) OVER w = slice_id AND (slice_id = 0 OR lag(src_off) OVER w + start - lag(start) OVER w = src_off) THEN 0 ELSE 1 END"
_BOUNDS = "SELECT inode, p, lead(p) OVER (PARTITION BY inode ORDER BY p) AS q FROM (SELECT inode, unnest([greatest(pos, {lo}), least(pos + slen, {hi})]) AS p FROM slices WHERE greatest(pos, {lo}) < least(pos + slen, {hi}) UNION SELECT inode, unnest([{lo}, {hi}]) FROM slices)"
_SEGMENTS = f"""SELECT inode, min(start) AS start, max("end") AS "end", min(slice_id) AS slice_id, min(src_off) AS src_off FROM (SELECT *, sum(brk) OVER (PARTITION BY inode ORDER BY start) AS run FROM (SELECT *, {_NEW} AS brk FROM (
  SELECT b.inode, p AS start, q AS "end", coalesce(arg_max(s.slice_id, s.id), 0) AS slice_id, coalesce(arg_max(s.soff + p - s.pos, s.id), 0) AS src_off FROM ({_BOUNDS}) b LEFT JOIN slices s ON s.inode = b.inode AND s.pos <= p AND s.pos + s.slen >= q WHERE q IS NOT NULL GROUP BY b.inode, p, q)
  WINDOW w AS (PARTITION BY inode ORDER BY start))) GROUP BY inode, run"""
_WRITES = "SELECT inode, lsn, length, CASE WHEN lsn % 5 = 4 THEN o + 1 ELSE o END AS off, o FROM (SELECT *, coalesce(sum(length) OVER (PARTITION BY inode ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT ino AS inode, lsn, CAST(greatest(floor(value), 1) AS BIGINT) AS length FROM changelog))"
_MERGED = "SELECT inode, min(lo) AS start, max(hi) AS \"end\", count(*) AS parts FROM (SELECT *, sum(brk) OVER (PARTITION BY inode ORDER BY lo, hi) AS g FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY inode ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM (SELECT inode, pos AS lo, pos + slen AS hi FROM slices))) GROUP BY inode, g"

QUERIES = {
    "overlay_segments": (overlay_segments, _SEGMENTS.format(lo=0, hi=1000)),
    "interval_merge": (interval_merge, _MERGED),
    "interval_gaps": (interval_gaps, f"""
        SELECT inode, start, "end" FROM (SELECT inode, e AS start, coalesce(lead(s) OVER (PARTITION BY inode ORDER BY s), 1000) AS "end" FROM (SELECT inode, start AS s, least("end", 1000) AS e FROM ({_MERGED}) UNION ALL SELECT DISTINCT inode, -1, 0 FROM slices)) WHERE start < "end" """),
    "truncate_rewrite": (truncate_rewrite, "SELECT inode, slice_id, pos, least(slen, 300 - pos) AS slen FROM slices WHERE pos < 300"),
    "file_length": (file_length, "SELECT inode, greatest(500, max(pos + slen)) AS length FROM slices GROUP BY inode"),
    "read_plan": (read_plan, f"SELECT inode, count(*) AS fetches, CAST(sum(\"end\" - start) AS BIGINT) AS bytes FROM ({_SEGMENTS.format(lo=100, hi=400)}) WHERE slice_id <> 0 GROUP BY inode"),
    "clone_files": (clone_files, "SELECT inode, count(*) AS n, CAST(sum(slen) AS BIGINT) AS bytes FROM (SELECT inode, slen FROM slices UNION ALL SELECT inode + 1, slen FROM slices) GROUP BY inode"),
    "slice_orphans": (slice_orphans, f"SELECT slice_id, id > 4 AS deferred FROM slices WHERE {GONE}"),
    "dangling_slices": (dangling_slices, f"SELECT inode, slice_id FROM slices WHERE {GONE}"),
    "zombie_inodes": (zombie_inodes, "SELECT n.inode FROM (SELECT *, CASE WHEN type = 'file' AND length = 0 THEN 0 ELSE 1 END AS nlink FROM nodes) n WHERE n.nlink <= 0 AND n.inode <> 1 AND NOT EXISTS (SELECT 1 FROM nodes e WHERE e.inode % 2 = 0 AND e.inode = n.inode)"),
    "scope_of": (scope_of, """
        SELECT inode, CASE WHEN inode = 1 THEN 'root' ELSE 'ino:' || coalesce(anchor, inode) END AS scope FROM nodes n LEFT JOIN (
          WITH RECURSIVE up AS (SELECT inode AS start, inode AS cur, parent FROM nodes WHERE inode NOT IN (1, 12)
            UNION ALL SELECT u.start, p.inode, p.parent FROM up u JOIN nodes p ON p.inode = u.parent AND p.inode <> 12 WHERE u.parent <> 1 AND u.parent <> u.cur)
          SELECT start, max(cur) AS anchor FROM up WHERE parent = 1 OR parent = cur GROUP BY start) a ON a.start = n.inode WHERE inode <> 12"""),
    "path_resolve": (path_resolve, "SELECT '/' || r_name || '//' || n_name || '/' || c_name AS path, c_custkey + 1000 AS inode FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "readdir_plus": (readdir_plus, "SELECT parent, name, inode, type, length FROM nodes WHERE parent <> 0"),
    "child_count": (child_count, "SELECT n.inode, count(c.inode) AS entries FROM nodes n LEFT JOIN nodes c ON c.parent = n.inode WHERE n.type = 'dir' GROUP BY n.inode"),
    "unreachable_inodes": (unreachable_inodes, "SELECT inode FROM nodes WHERE parent = 12"),
    "fs_stats_by_type": (fs_stats_by_type, """
        SELECT *, CASE WHEN live_bytes > 0 THEN logical * 1000 // live_bytes ELSE 0 END AS source_to_live_ratio_milli FROM (SELECT count(*) FILTER (WHERE type = 'file') AS files, count(*) FILTER (WHERE type = 'dir') AS dirs, 0::BIGINT AS others, CAST(coalesce(sum(length) FILTER (WHERE type = 'file'), 0) AS BIGINT) AS logical FROM nodes),
        (SELECT count(*) AS slices, count(DISTINCT slice_id) AS distinct_slices, CAST(sum(slen) AS BIGINT) AS live_bytes FROM slices)"""),
    "unlink_files": (unlink_files, "SELECT inode, type, 1::BIGINT AS nlink, CASE WHEN parent = 0 THEN NULL ELSE parent END AS parent FROM nodes WHERE parent <> 100"),
    "rename_nation": (rename_nation, "SELECT CASE WHEN parent = 10 THEN 11 ELSE parent END AS parent, CASE WHEN parent = 10 THEN 'moved-' || name ELSE name END AS name, inode FROM nodes WHERE parent <> 0"),
    "hash_watermark": (hash_watermark, f"SELECT inode, lsn, bool_and(off = o) OVER (PARTITION BY inode ORDER BY lsn) AS valid FROM ({_WRITES})"),
    "sequential_runs": (sequential_runs, f"""
        SELECT inode, lsn, CAST(run AS BIGINT) AS run, CAST(sum(length) OVER w AS BIGINT) AS run_bytes, sum(length) OVER w >= 100 AS prefetch FROM (SELECT *, sum(brk) OVER (PARTITION BY inode ORDER BY lsn) AS run FROM (
          SELECT *, CASE WHEN lag(off + length) OVER (PARTITION BY inode ORDER BY lsn) = off THEN 0 ELSE 1 END AS brk FROM ({_WRITES}))) WINDOW w AS (PARTITION BY inode, run ORDER BY lsn)"""),
    "invalidation_fanout": (invalidation_fanout, """
        SELECT lsn, kind, ino, name FROM (SELECT lsn, op + 4 AS op, ino FROM changelog) JOIN (VALUES (5, 'entry', 'a'), (5, 'inode', NULL), (6, 'inode', NULL), (7, 'inode', NULL)) AS v(o, kind, name) ON op = o WHERE op <> 5 OR ino <> 0"""),
    "changelog_keep_last": (changelog_keep_last, "SELECT lsn, ino, op FROM changelog ORDER BY lsn DESC LIMIT 500"),
    "changelog_trim_age": (changelog_trim_age, "SELECT lsn FROM changelog WHERE ts >= (SELECT max(ts) FROM changelog) - INTERVAL 12 HOURS"),
    "changelog_horizon": (changelog_horizon, "SELECT coalesce(max(lsn), 0) AS horizon FROM changelog"),
}
