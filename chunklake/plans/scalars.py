"""Queries on expressions: ranges, classes, ids, encodings, statistics of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions import binary as B
from chunklake.functions import expr as X
from chunklake.operators import usage
from chunklake.sources import fixtures as S
from chunklake.sources.tables import blob_id_parts, table

_KINDS = ["text/plain", "IMAGE/png; q=1", " application/zip ", "video/mp4", "application/x-npy", "", "application/json"]
_NAMES = [".safetensors", ".txt", ".BIN", ".gguf", "", ".tar.gz"]
_ERRORS = ["key not found", "already exists here", "InvalidRange", "token has expired", "serialization failure", "deadline passed", "boom", "not found: context deadline exceeded", "conflict: context canceled"]


def _pick(values: list[str], n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], n: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{n} % {len(values)} + 1]"


def range_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Eight forms of a header over the size of every document."""
    n, size = F.col("doc_id"), F.octet_length("text").cast("bigint")
    form, lo = n % 8, (n * 37) % 3000
    text = lambda *p: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in p])
    header = (
        F.when(form == 0, text("bytes=", lo, "-", lo + 99)).when(form == 1, text("bytes=", lo, "-")).when(form == 2, text("bytes=-", lo)).when(form == 3, F.lit("bytes=-"))
        .when(form == 4, text("bytes=", lo + 5, "-", lo)).when(form == 5, text("bytes=0-1,", lo, "-")).when(form == 6, F.lit(None).cast("string")).otherwise(text(" bytes=", lo, "-", lo + 1_000_000, " "))
    )
    return table(spark, sf, "documents").select("doc_id", X.byte_range(header, size).alias("r")).select("doc_id", "r.start", "r.length", "r.status")


def codec_class(spark: SparkSession, sf: str) -> DataFrame:
    kind, name = _pick(_KINDS, F.col("doc_id")), F.concat(F.lit("model"), _pick(_NAMES, F.col("doc_id")))
    tag = F.when(F.col("doc_id") % 10 == 0, F.lit("gzip"))
    codec = X.codec_of(tag, kind)
    return table(spark, sf, "documents").select("doc_id", X.raw_content_type(kind).alias("raw"), codec.alias("codec"), X.codec_byte(codec).alias("codec_byte"), X.store_class(name, 0).alias("class"))


def error_kind(spark: SparkSession, sf: str) -> DataFrame:
    message = F.when(F.col("doc_id") % 50 != 0, _pick(_ERRORS, F.col("doc_id")))
    return table(spark, sf, "documents").select("doc_id", X.error_kind(message).alias("kind"))


def blob_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Blob ids of all objects, taken apart again."""
    rows = S.objects(spark, sf).select("doc_id", X.blob_id("pack", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat("domain", F.lit("-x"))), F.col("content_hash")).alias("blob_id"))
    part = blob_id_parts(F.col("blob_id"))
    return rows.select("doc_id", "blob_id", part["domain"].alias("domain"), part["hash"].alias("hash"))


def human_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.pow(F.octet_length(F.coalesce("text", F.lit(""))).cast("double"), F.lit(2.0)).cast("bigint")
    return table(spark, sf, "documents").select("doc_id", X.human_bytes(F.shiftleft(F.col("doc_id"), 10)).alias("by_id"), (n >= 0).alias("some"))


def integrity_gate(spark: SparkSession, sf: str) -> DataFrame:
    n, size = F.col("doc_id"), F.col("size_b")
    wanted = F.when(n % 3 == 0, size).when(n % 3 == 1, size + 1).otherwise(F.lit(0))
    hash_ = F.when(n % 2 == 0, F.upper("content_hash")).otherwise(F.lit("abc"))
    return S.objects(spark, sf).select("doc_id", X.integrity(hash_, wanted, F.col("content_hash"), size).alias("problem"))


def tenant_names(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit(".x"))).when(F.col("c_custkey") % 4 == 1, F.lit("")).otherwise(F.col("c_name"))
    return c.select("c_custkey", X.valid_tenant(name).alias("valid"), X.safe_tenant(F.replace(name, F.lit("#"), F.lit("_"))).alias("safe"))


def inode_numbers(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", X.inode(F.col("o_custkey") % 100, F.col("o_orderkey")).alias("inode"), X.scope_key(F.col("o_orderkey")).alias("scope"))


def user_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of every message encoded and decoded, and parsed from JSON."""
    meta = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("role"), F.col("role"), F.lit("n"), F.col("turn").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", meta.alias("m"))
    coded = X.encode_user_tags(F.col("m"))
    back = X.decode_user_tags(F.map_concat(F.coalesce(coded, F.create_map().cast("map<string,string>")), F.create_map(F.lit("sys"), F.lit("1"))))
    parsed = X.parse_tags(F.when(F.col("turn") % 3 == 0, F.lit("{bad")).otherwise(F.to_json("m")))
    return rows.select("conv_id", "turn", coded["u.role"].alias("coded_role"), back["role"].alias("role"), back.isNull().alias("none"), parsed["corrupt"].alias("corrupt"))


def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return usage.histogram(table(spark, sf, "events"), ["event_type"], "value", [1.0, 5.0, 10.0, 50.0, 100.0])


def counter_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a kind a second, from hourly samples of their running number, in thousandths; and its share of hits."""
    hourly = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("c"))
    rows = usage.rates(hourly, ["event_type"], "at", ["c"])
    return rows.select("event_type", F.unix_timestamp("at").alias("at"), F.floor(F.col("c_rate") * 1000).cast("bigint").alias("milli_rate"), usage.hit_percent(F.col("n"), F.lit(10)).alias("hit_pct"))


def cdc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("lang").alias("domain"), "doc_id", F.lit("").alias("ref"), F.encode("text", "UTF-8").alias("data"))
    return B.content_chunks(docs).drop("ref")


def pack_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document framed under each codec and read back: whether it is itself, and what its frame says."""
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("codec"))
    pack = docs.withColumn("pack", B.compress_pack("data", "codec"))
    return pack.select("doc_id", "codec", (B.decompress_pack("pack") == F.col("data")).alias("same"), X.framing(F.col("pack"))["framed"].alias("framed"))


_FORM = "doc_id % 8"
_LO = "((doc_id * 37) % 3000)"
_HUMAN = "CASE " + " ".join(f"WHEN n >= {1 << (10 * i)} THEN printf('%.1f {u}', n / {float(1 << (10 * i))})" for i, u in ((3, "GiB"), (2, "MiB"), (1, "KiB"))) + " ELSE printf('%d B', n) END"

QUERIES = {
    "range_parse": (range_parse, f"""
        SELECT doc_id, CAST(CASE WHEN st = 'partial' THEN a ELSE 0 END AS BIGINT) AS start, CAST(CASE WHEN st = 'whole' THEN n WHEN st = 'partial' THEN z - a + 1 ELSE 0 END AS BIGINT) AS length, st AS status FROM (
          SELECT *, CASE WHEN {_FORM} IN (3, 4, 5, 6) THEN 'whole' WHEN {_FORM} = 2 AND l = 0 OR a >= n THEN 'unsatisfiable' ELSE 'partial' END AS st FROM (
            SELECT doc_id, n, l, CASE WHEN {_FORM} = 2 THEN greatest(n - l, 0) ELSE l END AS a, CASE {_FORM} WHEN 0 THEN least(l + 99, n - 1) WHEN 7 THEN least(l + 1000000, n - 1) ELSE n - 1 END AS z FROM (SELECT doc_id, octet_length(encode(text)) AS n, {_LO} AS l FROM documents)))"""),
    "codec_class": (codec_class, f"""
        SELECT doc_id, raw, codec, CASE codec WHEN 'none' THEN 0 WHEN 'zstd' THEN 1 WHEN 'gzip' THEN 2 END AS codec_byte, CASE WHEN doc_id % 6 IN (0, 2, 3) THEN 1 ELSE 0 END AS class FROM (
          SELECT doc_id, doc_id % 7 IN (1, 2, 3, 4) AS raw, CASE WHEN doc_id % 10 = 0 THEN 'gzip' WHEN doc_id % 7 IN (1, 2, 3, 4) THEN 'none' ELSE 'zstd' END AS codec FROM documents)"""),
    "error_kind": (error_kind, f"SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'ok' ELSE {_sql_pick(['not_found', 'already_exists', 'range', 'auth', 'conflict', 'timeout', 'other', 'timeout', 'canceled'], 'doc_id')} END AS kind FROM documents"),
    "blob_ids": (blob_ids, "SELECT doc_id, 'pack-' || d || '-' || content_hash AS blob_id, CASE WHEN d = '_' THEN '' ELSE d END AS domain, content_hash AS hash FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '_' ELSE domain || '-x' END AS d FROM objects)"),
    "human_sizes": (human_sizes, f"SELECT doc_id, {_HUMAN} AS by_id, true AS some FROM (SELECT doc_id, doc_id << 10 AS n FROM documents)"),
    "integrity_gate": (integrity_gate, """
        SELECT doc_id, CASE WHEN w > 0 AND size_b = 0 THEN 'empty' WHEN w > 0 AND w <> size_b THEN 'size' WHEN doc_id % 2 = 1 THEN 'hash' END AS problem FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN size_b WHEN 1 THEN size_b + 1 ELSE 0 END AS w FROM objects)"""),
    "tenant_names": (tenant_names, "SELECT c_custkey, length(n) > 0 AND NOT regexp_matches(n, '[. *>]') AS valid, regexp_full_match(replace(n, '#', '_'), '[A-Za-z0-9_-]+') AS safe FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '.x' WHEN 1 THEN '' ELSE c_name END AS n FROM customer)"),
    "inode_numbers": (inode_numbers, "SELECT o_orderkey, ((o_custkey % 100)::BIGINT << 48) | o_orderkey AS inode, 'ino:' || o_orderkey AS scope FROM orders"),
    "user_tags": (user_tags, "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS coded_role, CASE WHEN turn % 2 = 0 THEN role END AS role, turn % 2 <> 0 AS none, turn % 3 = 0 AS corrupt FROM conversations"),
    "value_histogram": (value_histogram, "SELECT event_type, le, count(*) AS n FROM (SELECT event_type, CASE WHEN value <= 1 THEN 1.0 WHEN value <= 5 THEN 5.0 WHEN value <= 10 THEN 10.0 WHEN value <= 50 THEN 50.0 WHEN value <= 100 THEN 100.0 ELSE CAST('inf' AS DOUBLE) END AS le FROM events) GROUP BY ALL"),
    "counter_rates": (counter_rates, """
        SELECT event_type, CAST(epoch(h) AS BIGINT) AS "at", CAST(floor((c - lag(c) OVER w) / CAST(greatest(epoch(h) - lag(epoch(h)) OVER w, 1) AS DOUBLE) * 1000) AS BIGINT) AS milli_rate, n * 100 // (n + 10) AS hit_pct FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n, max(event_id) AS c FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY h)"""),
    "cdc_chunks": (cdc_chunks, ""),
    "pack_round_trip": (pack_round_trip, "SELECT doc_id, codec, true AS same, true AS framed FROM documents, (VALUES (0), (1), (2)) AS v(codec)"),
}
