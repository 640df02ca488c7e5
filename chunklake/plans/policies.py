"""Queries on ordered policies, locks and tokens, and their streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.operators import policy as P
from chunklake.sources import fixtures as S
from chunklake.scratch import shared_folder
from chunklake.sources.tables import table
from chunklake.streaming import feeds

RATE, BURST = 0.001, 3.0
TTL = 7_200_000


def requests(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select(F.col("user_id").alias("bucket_key"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value", "event_type")


def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return P.token_bucket(requests(spark, sf), RATE, BURST).select("bucket_key", "event_id", "allowed")


def quota_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each user after each event: views take away, all else adds."""
    delta = F.floor("value").cast("bigint") * F.when(F.col("event_type").isin("view", "click"), -1).otherwise(1)
    return P.quota(requests(spark, sf).withColumn("delta", delta), "bucket_key", ["ms", "event_id"], "delta").select("bucket_key", "event_id", "bytes")


def lease_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of one node for each kind of event on the scope of each user."""
    rows = requests(spark, sf).select(F.concat(F.lit("s"), F.col("bucket_key").cast("string")).alias("scope"), F.col("event_type").alias("node"), "ms", "event_id")
    return P.leases(rows, TTL).select("scope", "event_id", "outcome")


def _locks(spark: SparkSession, sf: str) -> DataFrame:
    s = S.slices(spark, sf)
    return s.select("inode", (F.col("id") % 3).alias("owner"), (F.col("id") % 2 == 0).alias("exclusive"), F.col("pos").alias("start"), (F.col("pos") + F.col("slen") - 1).alias("end"), "slice_id")


def lock_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _locks(spark, sf)
    return P.lock_conflicts(rows, rows).select("inode", "slice_id")


def flock_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _locks(spark, sf)
    return P.flock_conflicts(rows, rows).select("inode", "slice_id")


def dead_lock_sids(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users who hold locks (by events or as customers) but are no customers of the first ten nations."""
    sids = P.lock_sessions(table(spark, sf, "events").select(F.col("user_id").cast("bigint").alias("sid")), table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("sid")))
    return P.dead_sessions(sids, table(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_custkey").cast("bigint").alias("sid")))


def lock_split(spark: SparkSession, sf: str) -> DataFrame:
    """Each slice as a lock record, cut by a request over bytes 100 to 199."""
    rec = F.array(F.struct(F.lit(1).alias("t"), F.col("pos").alias("s"), (F.col("pos") + F.col("slen") - 1).alias("e"), F.col("id").alias("p")))
    rows = S.slices(spark, sf).select("slice_id", F.explode(P.split_locks(rec, F.lit(100).cast("bigint"), F.lit(199).cast("bigint"), F.lit(0), F.lit(99).cast("bigint"))).alias("r"))
    return rows.select("slice_id", "r.t", "r.s", "r.e", "r.p")


def access_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Whether supplier n may read and write a customer's file of its own nation's group, by a mode that follows the customer's key."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("gid"), (F.col("c_custkey") % 512).cast("int").alias("mode"), (F.col("c_custkey") % 5).cast("bigint").alias("uid"))
    ok = lambda mask: P.may_access(F.col("mode"), F.col("uid"), F.col("gid"), F.col("c_custkey") % 3, F.array(F.lit(4).cast("bigint"), F.lit(7).cast("bigint")), mask)
    return c.select("c_custkey", ok(4).alias("may_read"), ok(2).alias("may_write"))


def token_denial(spark: SparkSession, sf: str) -> DataFrame:
    """Why an order, taken as a capability, is refused on the first of January 1995."""
    o = table(spark, sf, "orders")
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    rows = o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, 2).otherwise(1).alias("version"), day.alias("nbf"), (day + 400).alias("exp"), F.col("o_orderstatus").alias("audience"), F.lit("O").alias("wanted_audience"),
        (F.col("o_custkey") % 2).alias("op"), F.lit(1).alias("wanted_op"), (F.col("o_custkey") % 7 == 0).alias("revoked"), F.floor("o_totalprice").alias("size"), F.lit(150_000).alias("max_size"),
    )
    return rows.select("o_orderkey", P.token_denial(F.lit(9131)).alias("reason"), P.minted_ttl(F.col("nbf") % 50, F.lit(30), 20).cast("bigint").alias("ttl"))


def quota_predicate(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.objects(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("objects"), F.sum("size_b").alias("bytes"))
    return rows.select("domain", P.over_quota(F.col("objects"), F.col("bytes"), F.lit(1000), F.lit(0), F.lit(500_000)).alias("over_bytes"), P.over_quota(F.col("objects"), F.col("bytes"), F.lit(1000), F.lit(100), F.lit(0)).alias("over_objects"))


def revoked_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tokens; those of customers in debt are on the list, whose entries end with the customer's key."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("jti"))
    denied = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("jti"), F.col("c_custkey").alias("expires_at"))
    return P.revoked(o, denied, F.lit(500)).select("o_orderkey", "revoked")


def token_bucket_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The token bucket as a stream over the events table, run to its end; same rows as token_bucket."""
    base = shared_folder(spark)
    at = f"{base.rstrip('/')}/bucket-{uuid.uuid4().hex}"
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        rows = events.select(F.col("user_id").alias("bucket_key"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
        out = feeds.fold(rows, feeds.TokenBucket(RATE, BURST), "boolean")
        query = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema("bucket_key bigint, event_id bigint, ms bigint, allowed boolean").parquet(f"{at}/out").select("bucket_key", "event_id", "allowed")


_BUCKET = """SELECT bucket_key, event_id, allowed FROM (
  WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY bucket_key ORDER BY ms, event_id) AS n FROM requests),
  f AS (SELECT bucket_key, event_id, n, ms, 2000::BIGINT AS tokens, true AS allowed FROM r WHERE n = 1
    UNION ALL SELECT r.bucket_key, r.event_id, r.n, r.ms, CASE WHEN least(3000, f.tokens + greatest(r.ms - f.ms, 0) * 1 // 1000) >= 1000 THEN least(3000, f.tokens + greatest(r.ms - f.ms, 0) * 1 // 1000) - 1000 ELSE least(3000, f.tokens + greatest(r.ms - f.ms, 0) * 1 // 1000) END,
      least(3000, f.tokens + greatest(r.ms - f.ms, 0) * 1 // 1000) >= 1000 FROM f JOIN r ON r.bucket_key = f.bucket_key AND r.n = f.n + 1)
  SELECT * FROM f)"""

QUERIES = {
    "token_bucket": (token_bucket, _BUCKET),
    "token_bucket_stream": (token_bucket_stream, _BUCKET),
    "quota_clamped": (quota_clamped, """SELECT bucket_key, event_id, bytes FROM (
        WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY bucket_key ORDER BY ms, event_id) AS n, CAST(floor(value) AS BIGINT) * CASE WHEN event_type IN ('view', 'click') THEN -1 ELSE 1 END AS delta FROM requests),
        f AS (SELECT bucket_key, event_id, n, greatest(delta, 0) AS bytes FROM r WHERE n = 1 UNION ALL SELECT r.bucket_key, r.event_id, r.n, greatest(f.bytes + r.delta, 0) FROM f JOIN r ON r.bucket_key = f.bucket_key AND r.n = f.n + 1) SELECT * FROM f)"""),
    "lease_fold": (lease_fold, f"""SELECT scope, event_id, outcome FROM (
        WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY bucket_key ORDER BY ms, event_id) AS n FROM requests),
        f AS (SELECT bucket_key, event_id, n, 1 AS gen, event_type AS owner, ms + {TTL} AS expires, 'acquired:1' AS outcome FROM r WHERE n = 1
          UNION ALL SELECT r.bucket_key, r.event_id, r.n, CASE WHEN f.owner <> r.event_type AND f.expires < r.ms THEN f.gen + 1 ELSE f.gen END, CASE WHEN f.owner = r.event_type OR f.expires < r.ms THEN r.event_type ELSE f.owner END,
            CASE WHEN f.owner = r.event_type OR f.expires < r.ms THEN r.ms + {TTL} ELSE f.expires END, CASE WHEN f.owner = r.event_type THEN 'refreshed:' || f.gen WHEN f.expires < r.ms THEN 'stolen:' || (f.gen + 1) ELSE 'held:' || f.gen END
          FROM f JOIN r ON r.bucket_key = f.bucket_key AND r.n = f.n + 1) SELECT 's' || bucket_key AS scope, event_id, outcome FROM f)"""),
    "lock_conflicts": (lock_conflicts, "SELECT inode, slice_id FROM slices a WHERE EXISTS (SELECT 1 FROM slices b WHERE a.inode = b.inode AND a.id % 3 <> b.id % 3 AND a.pos <= b.pos + b.slen - 1 AND a.pos + a.slen - 1 >= b.pos AND (a.id % 2 = 0 OR b.id % 2 = 0))"),
    "flock_conflicts": (flock_conflicts, "SELECT inode, slice_id FROM slices a WHERE EXISTS (SELECT 1 FROM slices b WHERE a.inode = b.inode AND a.id % 3 <> b.id % 3 AND (a.id % 2 = 0 OR b.id % 2 = 0))"),
    "dead_lock_sids": (dead_lock_sids, "SELECT sid FROM (SELECT CAST(user_id AS BIGINT) AS sid FROM events UNION SELECT c_custkey FROM customer) WHERE sid NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)"),
    "lock_split": (lock_split, """
        SELECT slice_id, t, s, e, p FROM (SELECT slice_id, 1 AS t, pos AS s, least(pos + slen - 1, 99) AS e, id AS p FROM slices WHERE pos < 100 UNION ALL SELECT slice_id, 1, greatest(pos, 200), pos + slen - 1, id FROM slices WHERE pos + slen - 1 > 199 UNION ALL SELECT slice_id, 0, 100, 199, 99 FROM slices)"""),
    "access_mask": (access_mask, """
        SELECT c_custkey, a = 0 OR (b & 4) = 4 AS may_read, a = 0 OR (b & 2) = 2 AS may_write FROM (SELECT c_custkey, c_custkey % 3 AS a, CASE WHEN c_custkey % 3 = c_custkey % 5 THEN (c_custkey % 512) >> 6 WHEN c_nationkey IN (4, 7) THEN (c_custkey % 512) >> 3 ELSE c_custkey % 512 END AS b FROM customer)"""),
    "token_denial": (token_denial, """
        SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'version' WHEN d > 9131 THEN 'not_yet' WHEN d + 400 <= 9131 THEN 'expired' WHEN o_orderstatus <> 'O' THEN 'audience' WHEN o_custkey % 2 <> 1 THEN 'op' WHEN o_custkey % 7 = 0 THEN 'revoked' WHEN floor(o_totalprice) > 150000 THEN 'too_large' END AS reason,
        CAST(least(CASE WHEN d % 50 > 0 THEN d % 50 ELSE 20 END, 30) AS BIGINT) AS ttl FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)"""),
    "quota_predicate": (quota_predicate, "SELECT domain, sum(size_b) + 1000 > 500000 AS over_bytes, count(*) + 1 > 100 AS over_objects FROM objects GROUP BY domain"),
    "revoked_tokens": (revoked_tokens, "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey > 500) AS revoked FROM orders"),
}
