"""Queries on next states, lookups, checks and result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions import binary as B
from chunklake.functions import expr as X
from chunklake.operators import chunks as C
from chunklake.operators import compact, gc, listing, mutations, overlay, policy, tree, usage, versions
from chunklake.plans import storage
from chunklake.sources import fixtures as S
from chunklake.sources.tables import log_tail, table

KEY = ["domain", "pack_no"]


def _moves(nodes: DataFrame) -> DataFrame:
    """Every second customer moves onto the entry of the next one; every third of them mustn't replace, and every fifth names no entry."""
    files = nodes.where("type = 'file'").withColumn("k", F.col("inode") - 1000)
    to = files.select((F.col("k") - 1).alias("k"), F.col("parent").alias("to_parent"), F.col("name").alias("to_name"))
    rows = files.where("k % 2 = 0").join(to, "k")
    return rows.select("k", "parent", F.when(F.col("k") % 10 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"), "to_parent", "to_name", (F.col("k") % 6 == 0).alias("no_replace"))


def rename_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = S.nodes(spark, sf)
    return mutations.rename_checked(nodes.where("parent <> 0").select("parent", "name", "inode"), nodes.select("inode", "type", F.lit(1).alias("nlink")), _moves(nodes))[2].select("k", "outcome")


def rename_over_files(spark: SparkSession, sf: str) -> DataFrame:
    nodes = S.nodes(spark, sf)
    edges, left, _ = mutations.rename_checked(nodes.where("parent <> 0").select("parent", "name", "inode"), nodes.select("inode", "type", F.lit(1).alias("nlink")), _moves(nodes).drop("k"))
    return left.join(edges, "inode").select("inode", "type", "nlink", "parent", "name")


def attribute_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("inode"), F.col("l_returnflag").alias("name"))
    return tree.attribute_names(rows).select("inode", F.array_join("names", ",").alias("names"))


def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer by its directory and name; of every third the name is wrong."""
    nodes = S.nodes(spark, sf)
    wanted = nodes.where("type = 'file'").select("parent", F.when(F.col("inode") % 3 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"))
    return tree.lookup(nodes.where("parent <> 0"), wanted)


def reclaim_result(spark: SparkSession, sf: str) -> DataFrame:
    return gc.reclaim_result(storage.reclaim_context(spark, sf), storage.packs(spark, sf))


def assoc_counts(spark: SparkSession, sf: str) -> DataFrame:
    return gc.backfill_counts(storage.assoc(spark, sf))


def compact_result(spark: SparkSession, sf: str) -> DataFrame:
    return compact.result(storage.packs(spark, sf), storage.compact_candidates(spark, sf), storage.chunk_packs(spark, sf), S.PACK_TARGET)


def tenant_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.objects(spark, sf).select("domain", F.lit(1).alias("scanned"), F.col("pending").cast("int").alias("pending"), F.col("size_b").alias("bytes"))
    return usage.counters(rows, "domain", ["scanned", "pending", "bytes"])


def object_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Declared sizes against the sums of chunks; every 13th declares a byte too many."""
    declared = S.objects(spark, sf).select("domain", "doc_id", F.when(F.col("doc_id") % 13 == 0, F.col("size_b") + 1).otherwise(F.col("size_b")).alias("size_b"))
    return usage.object_sizes(S.chunks(spark, sf), declared, ["domain", "doc_id"])


def tenants_of_quota(spark: SparkSession, sf: str) -> DataFrame:
    quota = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("tenant")).agg(F.sum(F.when(F.col("c_custkey") % 20 == F.col("c_nationkey"), 1).otherwise(0)).alias("objects"), F.lit(0).alias("bytes"))
    return usage.tenants(quota).withColumn("kind", F.lit("all")).unionByName(usage.tenants(quota, positive=True).withColumn("kind", F.lit("positive")))


def purge_packs(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of index and packs, per domain, after every third pack went."""
    packs = storage.packs(spark, sf)
    index, left = mutations.purge(storage.packed(spark, sf), packs, packs.where("pack_no % 3 = 0"), KEY)
    return index.groupBy("domain").agg(F.count(F.lit(1)).alias("chunks")).join(left.groupBy("domain").agg(F.count(F.lit(1)).alias("packs")), "domain")


def version_delete(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.manifests(spark, sf)
    return mutations.delete(rows, rows.where("turn % 4 = 1"), ["owner_key", "version"]).select("owner_key", "version")


def version_append(spark: SparkSession, sf: str) -> DataFrame:
    """Every first version written again with another role, and one after the last of each key."""
    rows = S.manifests(spark, sf)
    new = rows.where("turn = 0").withColumn("role", F.lit("again")).unionByName(versions.latest(rows, ["owner_key"]).withColumn("version", F.concat("version", F.lit("+"))).withColumn("role", F.lit("next")))
    return versions.append(rows, new, ["owner_key"]).select("owner_key", "version", "role")


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Messages set aside: those of odd turns, and those of which nothing can be said."""
    rows = S.manifests(spark, sf)
    good, bad = mutations.quarantined(rows, F.when(F.col("turn") != 2, F.col("turn") % 2 == 1))
    return good.select("owner_key", "version", F.lit("good").alias("state")).unionByName(bad.select("owner_key", "version", F.lit("aside").alias("state")))


def integrity_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", X.integrity_kind(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 2 == 0).alias("kind"))


def attribute_rights(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", policy.may_set(k % 3, k % 5, k % 2 == 0, k % 7 < 3, k % 11 < 3, k % 13 < 5, k % 17 == 0).alias("may"))


def slice_write(spark: SparkSession, sf: str) -> DataFrame:
    """Slices of even files come again, and change nothing; those of every fifth file come with new numbers."""
    rows = S.slices(spark, sf)
    new = rows.where("inode % 2 = 0").unionByName(rows.where("inode % 5 = 0").withColumn("slice_id", F.col("slice_id") + 50))
    return mutations.write_slices(rows, new).groupBy("inode").agg(F.count(F.lit(1)).alias("n"), F.sum("slice_id").alias("ids"))


def slice_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Where the slices of every third file are, after a copy of each file."""
    rows = S.slices(spark, sf)
    both = overlay.clone(rows, rows.select(F.col("inode").alias("src")).distinct().withColumn("dst", F.col("src") + 1_000_000))
    return versions.slice_history(both, rows.where("inode % 3 = 0")).select("slice_id", "inode", "rank")


def size_backfill(spark: SparkSession, sf: str) -> DataFrame:
    packs = storage.packs(spark, sf).select(*KEY, "size")
    listed = packs.where("pack_no % 3 <> 0").select(*KEY, (F.col("size") + 1).alias("length"))
    return gc.backfill_sizes(packs.withColumn("size", F.when(F.col("pack_no") % 2 == 0, F.col("size"))), listed, KEY)


def index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of every fifth object, in packs of which every third is going."""
    index = storage.packed(spark, sf).select("domain", "chunk_hash", F.col("pack_no").alias("pack_hash")).dropDuplicates(["domain", "chunk_hash"])
    packs = storage.packs(spark, sf).select("domain", F.col("pack_no").alias("pack_hash"), F.when(F.col("pack_no") % 3 == 0, "obliterating").otherwise("stored").alias("state")).where("pack_hash % 4 <> 1")
    return C.lookup(storage.chunk_packs(spark, sf).select("domain", "chunk_hash", F.col("pack_no").alias("pack_hash")).distinct().join(index.select("domain", "chunk_hash"), ["domain", "chunk_hash"], "left_semi"), packs, S.chunks(spark, sf).where("doc_id % 5 = 0")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def registered_chunks(spark: SparkSession, sf: str) -> DataFrame:
    index = S.index(spark, sf).select("domain", "chunk_hash", F.lit("p").alias("pack_hash"), F.col("seq").alias("offset"), "size")
    wanted = index.withColumn("offset", F.when(F.col("size") % 3 == 0, F.col("offset") + 1).otherwise(F.col("offset")))
    return C.check_registered(wanted, index.where("offset % 2 = 0")).groupBy("domain", "status").agg(F.count(F.lit(1)).alias("n"))


def latest_of_wanted(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.manifests(spark, sf)
    return versions.latest(rows, ["owner_key"], rows.where("cast(owner_key as int) % 3 = 0")).select("owner_key", "version")


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 256 bytes over windows of 1000: some lie in two."""
    rows = S.chunks(spark, sf).withColumn("offset", F.col("seq") * S.CHUNK)
    return overlay.file_windows(rows, 1000).groupBy("domain", "window_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hi") - F.col("lo")).alias("bytes"))


def whole_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.chunks(spark, sf).withColumn("offset", F.col("seq") * S.CHUNK)
    return overlay.whole_chunks(rows, 300, 2000).groupBy("domain", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def lock_records(spark: SparkSession, sf: str) -> DataFrame:
    """Lock records out of their JSON."""
    rows = S.slices(spark, sf).select("slice_id", F.format_string('[{"t":1,"s":%d,"e":%d,"p":%d},{"t":0,"s":9,"e":10,"p":0}]', F.col("pos"), F.col("pos") + F.col("slen"), F.col("id")).alias("text"))
    return rows.select("slice_id", F.inline(X.parse_locks(F.col("text"))))


def changelog_tail(spark: SparkSession, sf: str) -> DataFrame:
    return log_tail(S.changelog(spark, sf), 700).select("lsn", "ino")


def object_get(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.objects(spark, sf)
    return listing.get(rows, rows.where("doc_id % 9 = 4").select("ref").union(spark.sql("SELECT 'no/such/ref'"))).select("ref", "content_hash")


def pack_by_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """Texts packed in four chunks under four codecs and read again; of every third pack the last byte is lost, which shows where it holds any content."""
    data = F.encode("text", "UTF-8")
    piece = lambda i: F.substring(F.col("data"), i * F.col("n") + 1, F.col("n"))
    rows = table(spark, sf, "documents").select("doc_id", data.alias("data")).withColumn("n", (F.octet_length("data") / 4).cast("int") + 1)
    rows = rows.withColumn("pack", B.compress_pack_by_chunk(F.array(*[piece(F.lit(i)) for i in range(4)]), F.col("doc_id") % 2 + 1))
    rows = rows.withColumn("pack", F.when(F.col("doc_id") % 3 == 0, F.substring(F.col("pack"), F.lit(1), F.octet_length("pack") - 1)).otherwise(F.col("pack")))
    return rows.select("doc_id", B.decompress_pack("pack").eqNullSafe(F.col("data")).alias("same"), X.framing(F.col("pack"))["codec"].alias("codec"))


_MOVED = "n.type = 'file' AND (n.inode - 1000) % 2 = 0 AND (n.inode - 1000) % 6 <> 0 AND (n.inode - 1000) % 10 <> 0"
_CONTEXTS = "SELECT a.domain, a.pack_no, CASE WHEN a.context = g.c THEN 'gone' ELSE a.context END AS context FROM assoc a JOIN (SELECT domain, min(context) AS c FROM assoc GROUP BY domain) g USING (domain)"

QUERIES = {
    "rename_outcomes": (rename_outcomes, "SELECT n.inode - 1000 AS k, CASE WHEN (n.inode - 1000) % 10 = 0 THEN 'missing' WHEN (n.inode - 1000) % 6 = 0 THEN 'exists' ELSE 'moved' END AS outcome FROM nodes n JOIN nodes t ON t.inode = n.inode + 1 WHERE n.type = 'file' AND n.inode % 2 = 0"),
    "rename_over_files": (rename_over_files, f"""
        SELECT n.inode, n.type, 1 AS nlink, coalesce(t.parent, n.parent) AS parent, coalesce(t.name, n.name) AS name FROM nodes n LEFT JOIN nodes t ON t.inode = n.inode + 1 AND {_MOVED}
        WHERE n.inode <> 1 AND n.inode NOT IN (SELECT n.inode + 1 FROM nodes n WHERE {_MOVED})"""),
    "attribute_names": (attribute_names, "SELECT l_partkey AS inode, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS names FROM lineitem GROUP BY l_partkey"),
    "name_lookup": (name_lookup, "SELECT parent, CASE WHEN inode % 3 = 0 THEN name || '?' ELSE name END AS name, CASE WHEN inode % 3 <> 0 THEN inode END AS inode FROM nodes WHERE type = 'file'"),
    "reclaim_result": (reclaim_result, f"""
        SELECT count(*) AS packs_considered, count(*) FILTER (WHERE NOT held) AS packs_reclaimed, count(*) FILTER (WHERE held) AS packs_still_referenced, CAST(coalesce(sum(size) FILTER (WHERE NOT held), 0) AS BIGINT) AS bytes_reclaimed
        FROM (SELECT domain, pack_no, bool_or(context <> 'gone') AS held FROM ({_CONTEXTS}) GROUP BY domain, pack_no HAVING bool_or(context = 'gone')) JOIN packs USING (domain, pack_no)"""),
    "assoc_counts": (assoc_counts, "SELECT domain, count(*) AS associations, count(DISTINCT pack_no) AS packs, count(DISTINCT context) AS contexts FROM assoc GROUP BY domain"),
    "compact_result": (compact_result, f"""
        SELECT * FROM (WITH sel AS ({storage.QUERIES['compact_candidates'][1]}) SELECT (SELECT count(*) FROM packs) AS packs_scanned, (SELECT count(*) FROM sel) AS packs_selected, (SELECT CAST(coalesce(sum((live + {S.PACK_TARGET - 1}) // {S.PACK_TARGET}), 0) AS BIGINT) FROM (SELECT domain, sum(live) AS live FROM sel GROUP BY domain)) AS packs_written,
        (SELECT CAST(coalesce(sum(live), 0) AS BIGINT) FROM sel) AS bytes_rewritten, (SELECT count(*) FROM (SELECT DISTINCT domain, c.ref FROM chunks c JOIN chunk_pack p USING (domain, chunk_hash) JOIN sel USING (domain, pack_no))) AS manifests_rewritten)"""),
    "tenant_counters": (tenant_counters, "SELECT domain, count(*) AS scanned, CAST(count(*) FILTER (WHERE pending) AS BIGINT) AS pending, CAST(sum(size_b) AS BIGINT) AS bytes FROM objects GROUP BY domain"),
    "object_sizes": (object_sizes, "SELECT domain, doc_id, size_b + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size_b, size_b AS total, doc_id % 13 <> 0 AS agrees FROM objects"),
    "tenants_of_quota": (tenants_of_quota, "SELECT c_nationkey AS tenant, 'all' AS kind FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 'positive' FROM customer WHERE c_custkey % 20 = c_nationkey GROUP BY 1"),
    "purge_packs": (purge_packs, "SELECT domain, count(*) AS chunks, count(DISTINCT pack_no) AS packs FROM fold WHERE pack_no % 3 <> 0 GROUP BY domain"),
    "version_delete": (version_delete, "SELECT owner_key, version FROM manifests WHERE turn % 4 <> 1"),
    "version_append": (version_append, "SELECT owner_key, version, CASE WHEN turn = 0 THEN 'again' ELSE role END AS role FROM manifests UNION ALL SELECT owner_key, max(version) || '+', 'next' FROM manifests GROUP BY owner_key"),
    "quarantine": (quarantine, "SELECT owner_key, version, CASE WHEN turn = 2 OR turn % 2 = 1 THEN 'aside' ELSE 'good' END AS state FROM manifests"),
    "integrity_kinds": (integrity_kinds, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'corrupt' WHEN c_custkey % 2 = 0 THEN 'not_found' ELSE '' END AS kind FROM customer"),
    "attribute_rights": (attribute_rights, "SELECT c_custkey, u = 0 OR c OR (NOT su AND u = o AND (NOT sg OR g)) OR (NOT su AND NOT sg AND NOT sm) AS may FROM (SELECT c_custkey, c_custkey % 3 AS o, c_custkey % 5 AS u, c_custkey % 2 = 0 AS g, c_custkey % 7 < 3 AS sm, c_custkey % 11 < 3 AS su, c_custkey % 13 < 5 AS sg, c_custkey % 17 = 0 AS c FROM customer)"),
    "slice_write": (slice_write, "SELECT inode, count(*) AS n, CAST(sum(slice_id) AS BIGINT) AS ids FROM (SELECT inode, slice_id FROM slices UNION ALL SELECT inode, slice_id + 50 FROM slices WHERE inode % 5 = 0) GROUP BY inode"),
    "slice_versions": (slice_versions, "SELECT slice_id, inode, 1 AS rank FROM slices WHERE inode % 3 = 0 UNION ALL SELECT slice_id, inode + 1000000, 2 FROM slices WHERE inode % 3 = 0"),
    "size_backfill": (size_backfill, "SELECT domain, pack_no, CASE WHEN pack_no % 2 = 0 THEN size WHEN pack_no % 3 <> 0 THEN size + 1 END AS size FROM packs"),
    "index_lookup": (index_lookup, "SELECT p.domain, count(*) AS n FROM chunk_pack p WHERE NOT (p.pack_no % 3 = 0 AND p.pack_no % 4 <> 1) AND EXISTS (SELECT 1 FROM chunks c WHERE c.domain = p.domain AND c.chunk_hash = p.chunk_hash AND c.doc_id % 5 = 0) GROUP BY p.domain"),
    "registered_chunks": (registered_chunks, "SELECT domain, CASE WHEN seq % 2 <> 0 THEN 'absent' WHEN size % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS status, count(*) AS n FROM idx GROUP BY 1, 2"),
    "latest_of_wanted": (latest_of_wanted, "SELECT owner_key, max(version) AS version FROM manifests WHERE CAST(owner_key AS INTEGER) % 3 = 0 GROUP BY owner_key"),
    "chunk_windows": (chunk_windows, """
        SELECT domain, w AS window_no, count(*) AS n, CAST(sum(least(o + size, (w + 1) * 1000) - greatest(o, w * 1000)) AS BIGINT) AS bytes FROM (SELECT domain, seq * 256 AS o, size, unnest(range(seq * 256 // 1000, (seq * 256 + size - 1) // 1000 + 1)) AS w FROM chunks) GROUP BY domain, w"""),
    "whole_chunks": (whole_chunks, "SELECT domain, doc_id, count(*) AS n FROM chunks WHERE seq * 256 >= 300 AND seq * 256 < 2000 GROUP BY domain, doc_id"),
    "lock_records": (lock_records, "SELECT slice_id, 1 AS t, pos AS s, pos + slen AS e, id AS p FROM slices UNION ALL SELECT slice_id, 0, 9, 10, 0 FROM slices"),
    "changelog_tail": (changelog_tail, "SELECT lsn, ino FROM changelog WHERE lsn > 700"),
    "object_get": (object_get, "SELECT ref, content_hash FROM objects WHERE doc_id % 9 = 4"),
    "pack_by_chunk": (pack_by_chunk, "SELECT doc_id, doc_id % 3 <> 0 AS same, 3 AS codec FROM documents"),
}
