"""Storage tables derived from the driver's tables; each has its SQL twin in plans.prelude."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunklake.operators import chunks as C
from chunklake.sources.tables import table

CHUNK = 256
PACK_TARGET = 4096


def objects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("lang").alias("domain"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("ref"), "doc_id",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.octet_length("text").cast("bigint").alias("size_b"),
        (F.col("doc_id") % 17 == 0).alias("pending"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id div 3)").alias("created_at"),
    )


def chunks(spark: SparkSession, sf: str, size: int = CHUNK) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("lang").alias("domain"), "doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("ref"), F.encode("text", "UTF-8").alias("data"))
    return C.fixed_chunks(docs, size)


def index(spark: SparkSession, sf: str) -> DataFrame:
    """The row of each (domain, chunk_hash) that was stored first."""
    return C.first_stored(chunks(spark, sf))


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("owner_key"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("version"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(turn as int))").alias("created_at"), F.encode("text", "UTF-8").alias("payload"), "turn", "role",
    )


#: The five kinds of event in the order of their names; an event's op is its place, from 1.
def changelog(spark: SparkSession, sf: str) -> DataFrame:
    op = F.dense_rank().over(Window.orderBy("event_type"))
    events = table(spark, sf, "events")
    kinds = events.select("event_type").distinct().select("event_type", op.cast("int").alias("op"))  # a handful of rows
    return events.join(F.broadcast(kinds), "event_type").select(F.col("event_id").alias("lsn"), F.col("user_id").alias("ino"), "op", F.col("props").alias("payload"), "ts", "value")


def slices(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").withColumn("id", F.row_number().over(order).cast("bigint"))
    return rows.select(
        F.col("l_orderkey").cast("bigint").alias("inode"), "id", (F.col("l_orderkey").cast("bigint") * 100 + F.col("id")).alias("slice_id"), ((F.col("l_partkey") % 50) * 10).cast("bigint").alias("pos"),
        (F.col("l_quantity").cast("int") * 4).cast("bigint").alias("slen"), F.lit(0).cast("bigint").alias("soff"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of depth 3: root 1, regions 10.., nations 100.., customers 1000.. as files whose length is their balance."""
    region = table(spark, sf, "region").select((F.col("r_regionkey") + 10).cast("bigint").alias("inode"), F.lit("dir").alias("type"), F.col("r_name").alias("name"), F.lit(1).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("length"))
    nation = table(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("inode"), F.lit("dir").alias("type"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 10).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("length"))
    customer = table(spark, sf, "customer").select((F.col("c_custkey") + 1000).cast("bigint").alias("inode"), F.lit("file").alias("type"), F.col("c_name").alias("name"), (F.col("c_nationkey") + 100).cast("bigint").alias("parent"), F.greatest(F.floor(F.col("c_acctbal")), F.lit(0)).cast("bigint").alias("length"))
    root = spark.range(1).select(F.lit(1).cast("bigint").alias("inode"), F.lit("dir").alias("type"), F.lit("").alias("name"), F.lit(0).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("length"))
    return root.unionByName(region).unionByName(nation).unionByName(customer)


def keys(spark: SparkSession, sf: str) -> DataFrame:
    """Object keys: page URLs after the scheme."""
    return table(spark, sf, "pages").select(F.regexp_replace("url", "^https?://", "").alias("key"), F.octet_length("html").cast("bigint").alias("size"))
