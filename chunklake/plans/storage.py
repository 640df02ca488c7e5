"""Queries on chunks, packs, manifests, reachability and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions import expr as X
from chunklake.operators import chunks as C
from chunklake.operators import compact, gc, packing, usage, versions
from chunklake.sources import fixtures as S
from chunklake.sources.tables import table

NOW = "timestamp_ntz'2024-01-01 00:05:00'"
SQL_NOW = "TIMESTAMP '2024-01-01 00:05:00'"
DAY = "2024-01-01"


def new_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that their object stored: an earlier one had none of their hash."""
    rows = S.chunks(spark, sf)
    owner = rows.groupBy("domain", "chunk_hash").agg(F.min("doc_id").alias("owner"))
    return rows.join(owner, ["domain", "chunk_hash"]).where("owner = doc_id").drop("owner")


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.greedy(new_chunks(spark, sf), "domain", ["doc_id", "seq"], "size", S.PACK_TARGET)


def packs(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_sizes(packed(spark, sf), "domain", "size").withColumn("stored", F.floor(F.col("size") * 6 / 10))


def chunk_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk of every object, with the pack that holds it."""
    where = packed(spark, sf).groupBy("domain", "chunk_hash").agg(F.min("pack_no").alias("pack_no"))
    return S.chunks(spark, sf).join(where, ["domain", "chunk_hash"])


def assoc(spark: SparkSession, sf: str) -> DataFrame:
    return gc.backfill(chunk_packs(spark, sf))


def dedup_probe_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return C.probe(S.chunks(spark, sf))


def chunk_unique_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return C.unique_bytes(S.chunks(spark, sf))


def chunk_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk read back from its object and checked; the counts of what is wrong with them."""
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    n = F.col("doc_id") + F.col("seq")  # some are read from the wrong place, some have another hash
    rows = S.chunks(spark, sf).withColumns({"offset": F.col("seq") * S.CHUNK + F.when(n % 7 == 0, 1_000_000).otherwise(0), "chunk_hash": F.when(n % 5 == 0, F.reverse("chunk_hash")).otherwise(F.col("chunk_hash"))}).join(docs, "doc_id")
    return C.verified(rows).groupBy("domain", F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def prior_version_reuse(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("payload") / 32).cast("int") - 1, F.lit(0))), lambda i: F.sha2(F.substring(F.col("payload"), i * 32 + 1, F.lit(32)), 256))
    return C.prior_reuse(S.manifests(spark, sf).select("owner_key", "version", pieces.alias("hashes")))


def greedy_packs(spark: SparkSession, sf: str) -> DataFrame:
    return packs(spark, sf)


def manifest_latest(spark: SparkSession, sf: str) -> DataFrame:
    return versions.latest(S.manifests(spark, sf), ["owner_key"]).select("owner_key", "version", F.octet_length("payload").cast("bigint").alias("size"))


def manifest_history(spark: SparkSession, sf: str) -> DataFrame:
    return versions.history(S.manifests(spark, sf), ["owner_key"]).select("owner_key", "version", F.col("rank").cast("bigint").alias("rank"))


def prune_keep_n(spark: SparkSession, sf: str) -> DataFrame:
    return versions.prune_keep(S.manifests(spark, sf), ["owner_key"], 3).select("owner_key", "version")


def prune_by_age(spark: SparkSession, sf: str) -> DataFrame:
    return versions.prune_age(S.manifests(spark, sf), ["owner_key"], F.expr("timestamp_ntz'2024-01-01 02:00:00'")).select("owner_key", "version")


def rewrite_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.manifests(spark, sf).select("owner_key", "version", F.create_map(F.lit("role"), F.col("role"), F.lit("chunked_format"), F.lit("v2")).alias("tags"))
    new = rows.select("owner_key").distinct().select("owner_key", F.create_map(F.lit("chunked_format"), F.lit(""), F.lit("owner_context"), F.concat(F.lit("ctx"), "owner_key")).alias("tags"))
    out = versions.rewrite_tags(rows, ["owner_key"], new, F.lit("next"))
    return out.select("owner_key", "version", F.size("tags").cast("bigint").alias("n"), F.col("tags")["role"].alias("role"), X.effective(F.col("tags")["owner_context"], F.col("owner_key")).alias("context"), X.chunked(F.col("tags")).alias("chunked"))


def domain_usage(spark: SparkSession, sf: str) -> DataFrame:
    return usage.domain_usage(packs(spark, sf), S.index(spark, sf), S.objects(spark, sf))


def live_packs(spark: SparkSession, sf: str) -> DataFrame:
    return gc.live_packs(assoc(spark, sf))


def _half(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored packs with their age, and those that objects outside src0 use."""
    stored = packs(spark, sf).select("domain", "pack_no", F.col("stored").alias("size"), F.expr(f"timestamp_ntz'{DAY} 00:00:00' + make_dt_interval(0, 0, 0, pack_no)").alias("created_at"))
    return stored, gc.live_packs(assoc(spark, sf).where(~F.col("context").contains("/src0/")))


def orphan_packs(spark: SparkSession, sf: str) -> DataFrame:
    stored, live = _half(spark, sf)
    return gc.orphans(stored, live, ["domain", "pack_no"], F.expr(NOW), 240).select("domain", "pack_no", "size", "decision")


def gc_report(spark: SparkSession, sf: str) -> DataFrame:
    stored, live = _half(spark, sf)
    return gc.report(stored, live, ["domain", "pack_no"], F.expr(NOW), 240)


def assoc_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return assoc(spark, sf)


def reclaim_context(spark: SparkSession, sf: str) -> DataFrame:
    """The context is the first object, by ref, of each domain."""
    rows = assoc(spark, sf)
    one = rows.groupBy("domain").agg(F.min("context").alias("__c"))
    marked = rows.join(one, "domain").withColumn("context", F.when(F.col("context") == F.col("__c"), "gone").otherwise(F.col("context")))
    return gc.reclaim_context(marked, F.lit("gone"))


def obliterate(spark: SparkSession, sf: str) -> DataFrame:
    rows = packs(spark, sf).withColumn("state", F.when(F.col("pack_no") % 3 == 0, "obliterating").otherwise("stored"))
    _, live = _half(spark, sf)
    return gc.commit_obliterated(rows.select("domain", "pack_no", "state"), live, ["domain", "pack_no"])


def pack_fill(spark: SparkSession, sf: str) -> DataFrame:
    live = chunk_packs(spark, sf).where(~F.col("ref").contains("/src0/")).dropDuplicates(["domain", "chunk_hash"])
    return compact.fill(packs(spark, sf), live.withColumn("ref", F.col("chunk_hash"))).select("domain", "pack_no", "live", "keys", "fill_stored", "fill_logical")


def compact_candidates(spark: SparkSession, sf: str) -> DataFrame:
    live = chunk_packs(spark, sf).where(~F.col("ref").contains("/src0/")).dropDuplicates(["domain", "chunk_hash"])
    return compact.candidates(compact.fill(packs(spark, sf), live), 1200, 0, 65536, S.PACK_TARGET).select("domain", "pack_no", "live")


def pack_runs(spark: SparkSession, sf: str) -> DataFrame:
    return packing.runs(chunk_packs(spark, sf), ["ref"], ["seq"], "pack_no").select("ref", "run", "first", "last", "length", "pack_no")


def coalesced_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Byte ranges of each pack that live objects (those outside src0) need: neighbours in one request."""
    at = packing.offsets(packed(spark, sf), ["domain", "pack_no"], ["doc_id", "seq"], "size").select("domain", "chunk_hash", "pack_no", "offset", "size")
    at = at.groupBy("domain", "chunk_hash").agg(F.min(F.struct("pack_no", "offset", "size")).alias("x")).select("domain", "chunk_hash", "x.*")
    used = S.chunks(spark, sf).where(~F.col("ref").contains("/src0/")).select("domain", "chunk_hash").distinct().join(at, ["domain", "chunk_hash"])
    return packing.merge_intervals(used.select("domain", "pack_no", F.col("offset").alias("lo"), (F.col("offset") + F.col("size")).alias("hi")), ["domain", "pack_no"], "lo", "hi")


def stale_pending(spark: SparkSession, sf: str) -> DataFrame:
    return gc.stale(S.objects(spark, sf), F.expr("timestamp_ntz'2024-01-01 00:02:00'")).select("domain", "ref", "size_b")


def dedup_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Index rows whose pack is stored or unknown; packs of even number have a row."""
    where = chunk_packs(spark, sf).select("domain", "chunk_hash", F.col("pack_no").alias("pack_hash")).distinct()
    states = packs(spark, sf).where("pack_no % 2 = 0").select("domain", F.col("pack_no").alias("pack_hash"), F.when(F.col("pack_no") % 4 == 0, "stored").otherwise("obliterating").alias("state"))
    return C.lookup(where, states).groupBy("domain", "pack_hash").agg(F.count(F.lit(1)).alias("n"))


def lru_evict(spark: SparkSession, sf: str) -> DataFrame:
    return packing.evict(S.objects(spark, sf), [F.desc("created_at"), "ref"], "size_b", 200_000, 100, ["domain"]).select("domain", "ref", "evicted")


def multipart_etag(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a conversation, in turn order, as the parts of an upload."""
    rows = S.manifests(spark, sf).groupBy("owner_key").agg(F.sort_array(F.collect_list(F.struct("turn", F.md5("payload").alias("m")))).alias("p"))
    return rows.select("owner_key", X.multipart_etag(F.transform("p", lambda x: x["m"])).alias("etag"))


_ASSOC_LIVE = "SELECT DISTINCT domain, pack_no FROM assoc WHERE NOT contains(context, '/src0/')"
_LIVE_CHUNKS = "SELECT DISTINCT c.domain, c.chunk_hash, c.size, p.pack_no FROM chunks c JOIN chunk_pack p USING (domain, chunk_hash) WHERE NOT contains(c.ref, '/src0/')"
_FILL = f"SELECT p.domain, p.pack_no, p.size, p.stored, CAST(coalesce(sum(l.size), 0) AS BIGINT) AS live, count(DISTINCT l.chunk_hash) AS keys FROM packs p LEFT JOIN ({_LIVE_CHUNKS}) l USING (domain, pack_no) GROUP BY ALL"

QUERIES = {
    "dedup_probe_fixed": (dedup_probe_fixed, """
        SELECT *, CASE WHEN logical > 0 THEN (logical - physical) * 100 // logical ELSE 0 END AS reuse_pct FROM (
          SELECT domain, doc_id, logical, physical, chunks, new_chunks, CAST(sum(logical) OVER w AS BIGINT) AS logical_total, CAST(sum(physical) OVER w AS BIGINT) AS physical_total FROM (
            SELECT domain, doc_id, CAST(sum(size) AS BIGINT) AS logical, CAST(coalesce(sum(size) FILTER (WHERE owner = doc_id), 0) AS BIGINT) AS physical, count(*) AS chunks, count(*) FILTER (WHERE owner = doc_id) AS new_chunks FROM owned GROUP BY domain, doc_id)
          WINDOW w AS (PARTITION BY domain ORDER BY doc_id))"""),
    "chunk_unique_bytes": (chunk_unique_bytes, "SELECT domain, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(s) AS BIGINT) AS unique_bytes FROM (SELECT domain, chunk_hash, count(*) AS n, max(size) AS s, sum(size) AS b FROM chunks GROUP BY ALL) GROUP BY domain"),
    "chunk_verify": (chunk_verify, "SELECT domain, CASE WHEN (doc_id + seq) % 7 = 0 THEN 'out_of_bounds' WHEN (doc_id + seq) % 5 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS problem, count(*) AS n FROM chunks GROUP BY 1, 2"),
    "prior_version_reuse": (prior_version_reuse, """
        SELECT owner_key, version, CAST(len(h) AS BIGINT) AS chunks, CAST(len(list_filter(h, lambda x: list_contains(b, x))) AS BIGINT) AS reused FROM (
          SELECT owner_key, version, h, coalesce(lag(h) OVER (PARTITION BY owner_key ORDER BY version), []) AS b FROM (
            SELECT owner_key, version, list_transform(range(0, greatest((octet_length(payload) + 31) // 32, 1)), lambda i: sha256(payload[i * 32 + 1:(i + 1) * 32])) AS h FROM manifests))"""),
    "greedy_packs": (greedy_packs, "SELECT domain, pack_no, size, chunks, stored FROM packs"),
    "manifest_latest": (manifest_latest, "SELECT owner_key, version, CAST(octet_length(payload) AS BIGINT) AS size FROM manifests QUALIFY row_number() OVER (PARTITION BY owner_key ORDER BY version DESC) = 1"),
    "manifest_history": (manifest_history, "SELECT owner_key, version, row_number() OVER (PARTITION BY owner_key ORDER BY version DESC) AS rank FROM manifests"),
    "prune_keep_n": (prune_keep_n, "SELECT owner_key, version FROM manifests QUALIFY row_number() OVER (PARTITION BY owner_key ORDER BY version DESC) > 3"),
    "prune_by_age": (prune_by_age, "SELECT owner_key, version FROM (SELECT *, row_number() OVER (PARTITION BY owner_key ORDER BY version DESC) AS r FROM manifests) WHERE r > 1 AND created_at < TIMESTAMP '2024-01-01 02:00:00'"),
    "rewrite_tags": (rewrite_tags, "SELECT owner_key, 'next' AS version, 2::BIGINT AS n, role, 'ctx' || owner_key AS context, false AS chunked FROM manifests QUALIFY row_number() OVER (PARTITION BY owner_key ORDER BY version DESC) = 1"),
    "domain_usage": (domain_usage, """
        SELECT domain, physical, unique_bytes, apparent, CASE WHEN physical > 0 THEN unique_bytes * 1000 // physical ELSE 0 END AS ratio_milli FROM (
          SELECT domain, CAST(coalesce(p, 0) AS BIGINT) AS physical, CAST(coalesce(u, 0) AS BIGINT) AS unique_bytes, CAST(coalesce(a, 0) AS BIGINT) AS apparent FROM (SELECT domain, sum(stored) AS p FROM packs GROUP BY domain)
          FULL JOIN (SELECT domain, sum(size) AS u FROM idx GROUP BY domain) USING (domain) FULL JOIN (SELECT domain, sum(size_b) AS a FROM objects GROUP BY domain) USING (domain))"""),
    "live_packs": (live_packs, "SELECT DISTINCT domain, pack_no FROM assoc"),
    "orphan_packs": (orphan_packs, f"SELECT domain, pack_no, stored AS size, CASE WHEN 300 - pack_no < 240 THEN 'deferred' ELSE 'reclaim' END AS decision FROM packs ANTI JOIN ({_ASSOC_LIVE}) USING (domain, pack_no)"),
    "gc_report": (gc_report, f"""
        SELECT domain, count(*) AS scanned, count(l) AS live, count(*) FILTER (WHERE gone) AS reclaimed, count(*) FILTER (WHERE l IS NULL AND NOT gone) AS deferred, CAST(coalesce(sum(stored) FILTER (WHERE gone), 0) AS BIGINT) AS bytes, count(l) = 0 AS empty_live_set
        FROM (SELECT p.*, l, l IS NULL AND NOT (300 - pack_no < 240) AS gone FROM packs p LEFT JOIN (SELECT *, 1 AS l FROM ({_ASSOC_LIVE})) USING (domain, pack_no)) GROUP BY domain"""),
    "assoc_backfill": (assoc_backfill, "SELECT domain, pack_no, context FROM assoc"),
    "reclaim_context": (reclaim_context, """
        SELECT domain, pack_no, CASE WHEN bool_or(context <> c) THEN 'still_referenced' ELSE 'reclaimed' END AS outcome FROM assoc JOIN (SELECT domain, min(context) AS c FROM assoc GROUP BY domain) USING (domain) GROUP BY domain, pack_no HAVING bool_or(context = c)"""),
    "obliterate": (obliterate, f"SELECT domain, pack_no, CASE WHEN pack_no % 3 <> 0 OR l IS NOT NULL THEN 'stored' ELSE 'obliterated' END AS state FROM packs LEFT JOIN (SELECT *, 1 AS l FROM ({_ASSOC_LIVE})) USING (domain, pack_no)"),
    "pack_fill": (pack_fill, f"SELECT domain, pack_no, live, keys, CASE WHEN stored > 0 THEN live * 1000 // stored ELSE 0 END AS fill_stored, CASE WHEN size > 0 THEN live * 1000 // size ELSE 0 END AS fill_logical FROM ({_FILL})"),
    "compact_candidates": (compact_candidates, f"""
        SELECT domain, pack_no, live FROM (SELECT *, count(*) OVER (PARTITION BY domain) AS n, sum(live) OVER (PARTITION BY domain) AS t FROM (
          SELECT * FROM (SELECT *, sum(live) OVER (PARTITION BY domain ORDER BY pack_no) AS s, row_number() OVER (PARTITION BY domain ORDER BY pack_no) AS r FROM ({_FILL}) WHERE live > 0 AND stored > 0 AND live * 1000 // stored < 1200) WHERE r = 1 OR s <= 65536))
        WHERE n >= 2 AND (t + 4095) // 4096 < n"""),
    "pack_runs": (pack_runs, """
        SELECT ref, CAST(run AS BIGINT) AS run, min(seq) AS first, max(seq) AS last, count(*) AS length, min(pack_no) AS pack_no FROM (SELECT *, sum(brk) OVER (PARTITION BY ref ORDER BY seq) - 1 AS run FROM (
          SELECT c.ref, c.seq, p.pack_no, CASE WHEN lag(p.pack_no) OVER (PARTITION BY c.ref ORDER BY c.seq) = p.pack_no THEN 0 ELSE 1 END AS brk FROM chunks c JOIN chunk_pack p USING (domain, chunk_hash))) GROUP BY ref, run"""),
    "coalesced_ranges": (coalesced_ranges, """
        SELECT domain, pack_no, min(lo) AS start, max(hi) AS "end", count(*) AS parts FROM (SELECT *, sum(brk) OVER (PARTITION BY domain, pack_no ORDER BY lo, hi) AS g FROM (
          SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY domain, pack_no ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM (
            SELECT domain, pack_no, CAST(off AS BIGINT) AS lo, CAST(off + size AS BIGINT) AS hi FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY domain, pack_no ORDER BY doc_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM fold)
            SEMI JOIN (SELECT DISTINCT domain, chunk_hash FROM chunks WHERE NOT contains(ref, '/src0/')) USING (domain, chunk_hash) QUALIFY row_number() OVER (PARTITION BY domain, chunk_hash ORDER BY pack_no, off) = 1))) GROUP BY domain, pack_no, g"""),
    "stale_pending": (stale_pending, "SELECT domain, ref, size_b FROM objects WHERE pending AND created_at <= TIMESTAMP '2024-01-01 00:02:00'"),
    "dedup_lookup": (dedup_lookup, "SELECT domain, pack_no AS pack_hash, count(*) AS n FROM chunk_pack WHERE pack_no % 4 <> 2 GROUP BY ALL"),
    "lru_evict": (lru_evict, "SELECT domain, ref, sum(size_b) OVER w > 200000 OR count(*) OVER w > 100 AS evicted FROM objects WINDOW w AS (PARTITION BY domain ORDER BY created_at DESC, ref ROWS UNBOUNDED PRECEDING)"),
    "multipart_etag": (multipart_etag, "SELECT owner_key, md5(unhex(string_agg(md5(payload), '' ORDER BY turn))) || '-' || count(*) AS etag FROM manifests GROUP BY owner_key"),
}
