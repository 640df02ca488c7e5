"""Token counts as delta-maintained rollups.

Totals by (source, lang, tokenizer version) are sums of signed deltas. A batch is reduced to one row a key and
written to a folder of its own, which counts once its commit marker is there: a batch sent twice, or again after a
failure in mid-write, changes nothing.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, keep, shared_folder

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizer versions: the pattern whose matches are counted.
VERSIONS = {"words-1": WORD, "words-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a whole text; null has none."""
    if version == "words-1":  # runs, counted by their first characters: no array of words is made
        return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(VERSIONS[version])).cast("long")


def inserts(docs: DataFrame, version: str) -> DataFrame:
    """A delta of +1 document and its tokens for every row. Null sources and languages are keys like any other."""
    return docs.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), count_tokens(F.col("text"), version).alias("n_tokens"))


def deletes(docs: DataFrame, version: str) -> DataFrame:
    """The inserts of these rows, taken back."""
    return inserts(docs, version).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revisions(rows: DataFrame, version: str, old: Column, new: Column) -> DataFrame:
    """Counts that have changed: no document more or less, new - old tokens."""
    return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(0).cast("long").alias("n_docs"), (new - old).cast("long").alias("n_tokens"))


class Rollup:
    """Totals in a folder that all executors share; one writer at a time.

    Each batch is a Parquet folder batch=<id>; the marker that the output committer leaves last makes it
    part of the totals. Extra columns of a delta are dropped; an empty batch is committed like any other.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}").rstrip("/")

    def _path(self, batch: str, name: str = ""):
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch id holds letters, digits, dots, dashes and underscores only")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch}{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        path, fs = self._path(batch, "/_SUCCESS")
        return fs.exists(path)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds the batch; False, and nothing done, if it is already in."""
        if self.committed(batch):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        # Sums are on one row a key, partial sums made before the exchange: a hot source sends one row from each task.
        sums.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(b for n in names if n.startswith("batch=") and self.committed(b := n[len("batch=") :]))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens over all committed batches; keys whose documents and tokens are both 0 are gone."""
        paths = [f"{self.folder}/batch={b}" for b in self.batches()]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def maintain(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """A rollup's life over a whole table: all documents come in under both versions, later copies of a text leave, and words-1 is revised to count an end of text for each document that is left.

    The copies' batch is sent twice and counts once. Of rows with equal text, the one with the smallest
    doc_id (null last) stays; a null text is a text like any other, and repeated rows leave but for one.
    """
    rows = docs.select("doc_id", "text", "source", "lang")
    rollup = Rollup(docs.sparkSession, folder)
    # Texts meet by 128 bits of their hash; partial aggregation keeps a hot text to one row a task.
    ident = [F.xxhash64("text").alias("h1"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("h2"), F.col("text").isNull().alias("h3")]
    tokens = [count_tokens(F.col("text"), v).alias(v) for v in VERSIONS]
    counted = rows.select("doc_id", "source", "lang", *ident, *tokens)
    all_rows = counted.groupBy("source", "lang", "h1", "h2", "h3", "words-1", "words-2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    all_rows = keep(all_rows, "token-texts")
    both = lambda d, sign: d.select("source", "lang", F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(f"`{v}`").alias("t")) for v in VERSIONS])).alias("e"), "n").select(
        "source", "lang", "e.tokenizer", (F.col("n") * sign).alias("n_docs"), (F.col("n") * F.col("e.t") * sign).alias("n_tokens")
    )
    rollup.commit("0001-load", both(all_rows, 1))
    first = all_rows.groupBy("h1", "h2", "h3").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("lang", F.lit("")).alias("l"))).alias("first"))
    mine = (F.col("least").eqNullSafe(F.col("first.least"))) & (F.coalesce("source", F.lit("")) == F.col("first.s")) & (F.coalesce("lang", F.lit("")) == F.col("first.l"))
    marked = all_rows.join(first, ["h1", "h2", "h3"]).withColumn("stays", mine.cast("long"))
    for _ in range(2):
        rollup.commit("0002-copies", both(marked.withColumn("n", F.col("n") - F.col("stays")), -1))
    rollup.commit("0003-ends", revisions(marked.where("stays = 1"), "words-1", F.col("words-1"), F.col("words-1") + 1))
    return rollup.totals()
