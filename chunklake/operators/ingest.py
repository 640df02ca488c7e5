"""Puts as one job: chunks meet the index, new ones fill packs, and index, packs, associations and manifests follow from that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.operators import packing


@dataclass
class Put:
    """What a put adds, in the order in which it must become visible: packs, index, associations, manifests."""

    packs: DataFrame
    index: DataFrame
    assoc: DataFrame
    manifests: DataFrame


def put(chunks: DataFrame, known: DataFrame, target: int, first_pack: int = 0, breaks: tuple[str, ...] = ()) -> Put:
    """The objects' chunks (domain, doc_id, ref, seq, chunk_hash, size) against known (domain, chunk_hash, pack_no, offset).

    A chunk is new if neither the index nor an earlier object of the put has its hash; repeats within one object are stored
    again. New chunks fill packs of `target` bytes in the order of (doc_id, seq); packs are numbered per domain from first_pack on.
    """
    key = ["domain", "chunk_hash"]
    fresh = chunks.join(known.select(*key), key, "left_anti")
    owner = fresh.groupBy(*key).agg(F.min("doc_id").alias("__owner"))
    stored = fresh.join(owner, key).where("doc_id = __owner").drop("__owner")
    placed = packing.greedy(stored, "domain", ["doc_id", "seq"], "size", target, breaks).withColumn("pack_no", F.col("pack_no") + first_pack)
    placed = packing.offsets(placed, ["domain", "pack_no"], ["doc_id", "seq"], "size")
    index = placed.groupBy(*key).agg(F.min(F.struct("pack_no", "offset", "size")).alias("x")).select(*key, "x.*")
    where = index.select(*key, "pack_no", "offset").unionByName(known.select(*key, "pack_no", "offset"))
    located = chunks.join(where, key)
    entry = F.struct("seq", F.col("chunk_hash").alias("h"), F.col("pack_no").cast("string").alias("p"), F.col("offset").alias("o"), F.col("size").alias("s"))
    rows = located.groupBy("domain", "ref").agg(F.sum("size").alias("total_size"), F.sort_array(F.collect_list(entry)).alias("c"))
    manifests = rows.select("domain", "ref", "total_size", F.transform("c", lambda x: x.dropFields("seq")).alias("chunks"))
    return Put(packing.pack_sizes(placed, "domain", "size"), index, located.select("domain", "pack_no", F.col("ref").alias("context")).distinct(), manifests)


def put_unpacked(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Blobs to write when each chunk is a blob of its own: (domain, chunk_hash, size), each once, without those that are there."""
    return chunks.dropDuplicates(["domain", "chunk_hash"]).select("domain", "chunk_hash", "size").join(known.select("domain", "chunk_hash"), ["domain", "chunk_hash"], "left_anti")


def payload(manifests: DataFrame, tenant: str = "domain") -> DataFrame:
    """Manifest rows with their JSON body and format tag."""
    body = F.to_json(F.struct(F.lit("v2").alias("format"), "total_size", F.col(tenant).alias("tenant"), "chunks"))
    return manifests.select("domain", "ref", F.encode(body, "UTF-8").alias("payload"), F.create_map(F.lit("chunked_format"), F.lit("v2")).alias("tags"))


def complete_upload(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """upload, parts, size and etag of uploads whose asked parts (upload, part, etag) are all stored with that etag (upload, part, etag, size); the others with problem invalid_part, and no etag."""
    have = stored.select("upload", "part", F.col("etag").alias("__etag"), "size")
    rows = asked.join(have, ["upload", "part"], "left").withColumn("__ok", F.coalesce(F.col("etag") == F.col("__etag"), F.lit(False)))
    done = rows.groupBy("upload").agg(F.min("__ok").alias("ok"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size"), F.sort_array(F.collect_list(F.struct("part", "__etag"))).alias("p"))
    etag = F.concat(F.md5(F.unhex(F.array_join(F.transform("p", lambda x: x["__etag"]), ""))), F.lit("-"), F.col("parts").cast("string"))
    return done.select("upload", "parts", F.when(F.col("ok"), F.col("size")).alias("size"), F.when(F.col("ok"), etag).alias("etag"), F.when(~F.col("ok"), "invalid_part").alias("problem"))


def staging_report(objects: DataFrame, cutoff) -> DataFrame:
    """Per domain: pending objects seen, and those old enough to go with their bytes."""
    old = F.col("created_at") <= cutoff
    return objects.where("pending").groupBy("domain").agg(F.count(F.lit(1)).alias("scanned"), F.count(F.when(old, 1)).alias("reclaimed"), F.coalesce(F.sum(F.when(old, F.col("size_b"))), F.lit(0)).alias("bytes"))
