"""Sharding by jump consistent hashing, with DataFrame functions only.

The generator of the published algorithm (a 64-bit congruential step) runs in three limbs of 22, 22
and 20 bits, so that no product overflows a long; the fold visits at most as many steps as there are shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier of the published generator, fixed value.
MULTIPLIER = 2862933555777941757
_MASK22 = (1 << 22) - 1
_MASK20 = (1 << 20) - 1
_C = (MULTIPLIER & _MASK22, (MULTIPLIER >> 22) & _MASK22, MULTIPLIER >> 44)
#: Chunks per shard in which slots are numbered; counts per chunk are the only thing summed across chunks.
SLOT_CHUNKS = 1024


def _limbs(key: Column) -> Column:
    low = lambda n, m: F.shiftrightunsigned(key, n).bitwiseAND(F.lit(m)) if n else key.bitwiseAND(F.lit(m))
    return F.struct(low(0, _MASK22).alias("x0"), low(22, _MASK22).alias("x1"), low(44, _MASK20).alias("x2"))


def _step(s: Column) -> Column:
    """x * MULTIPLIER + 1 modulo 2**64, in limbs."""
    x0, x1, x2 = s["x0"], s["x1"], s["x2"]
    a = x0 * F.lit(_C[0]) + F.lit(1)
    b = x0 * F.lit(_C[1]) + x1 * F.lit(_C[0]) + F.shiftright(a, 22)
    c = x0 * F.lit(_C[2]) + x1 * F.lit(_C[1]) + x2 * F.lit(_C[0]) + F.shiftright(b, 22)
    return F.struct(a.bitwiseAND(F.lit(_MASK22)).alias("x0"), b.bitwiseAND(F.lit(_MASK22)).alias("x1"), c.bitwiseAND(F.lit(_MASK20)).alias("x2"))


def jump(key: Column, shards: int) -> Column:
    """Shard of a long key among 0 .. shards - 1 (null: key 0), and the shard with one more: struct<shard, grown>.

    The jumps of a key do not depend on the number of shards, which only stops them: so both
    numbers come from one walk, and a key moves to the new shard or stays.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    zero = F.lit(0).cast("long")
    start = F.struct(_limbs(F.coalesce(key.cast("long"), zero)).alias("x"), zero.alias("shard"), zero.alias("grown"), zero.alias("j"))

    def go(s: Column, _: Column) -> Column:
        x = _step(s["x"])
        top = F.shiftleft(x["x2"], 11).bitwiseOR(F.shiftright(x["x1"], 11)) + F.lit(1)  # the upper 31 bits, plus 1
        nxt = F.floor((s["j"] + F.lit(1)) * (F.lit(float(1 << 31)) / top)).cast("long")
        return F.when(s["j"] > F.lit(shards), s).otherwise(F.struct(x.alias("x"), F.when(s["j"] < F.lit(shards), s["j"]).otherwise(s["shard"]).alias("shard"), s["j"].alias("grown"), nxt.alias("j")))

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, go)
    return F.struct(walked["shard"].cast("int").alias("shard"), walked["grown"].cast("int").alias("grown"))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", chunks: int = SLOT_CHUNKS) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row.

    Law `key`: key and shard count alone decide. A null key counts as 0; a null text has size 1 and
    the checksum of no bytes. Repeated rows each get a slot of their own. Slots run from 0 in each
    shard without gaps: by chunk (a hash of the key), key, checksum and size. Only counts per chunk
    (at most shards * chunks rows, whatever the input) are summed over chunks; no task sorts a whole shard.
    Extra columns of docs are not read.
    """
    data = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(f"`{key}`").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        jump(F.col(f"`{key}`"), shards).alias("to"),
    ).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks)).cast("int").alias("chunk"),
    )
    counts = rows.groupBy("shard", "chunk").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("shard").alias("s"), F.col("chunk").alias("c"), F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("within", within)
    return numbered.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c"))).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), "grown_shard"
    )
