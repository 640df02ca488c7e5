"""Shared helpers: shared-folder tables, ASCII words, 64-bit hashing of word sequences."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.scratch import shared_folder

#: The word of every contract: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles; longer single texts are a step of their own.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20
#: Rows of a kept table's file, where their number is known and they are narrow.
ROWS_PER_FILE = 20_000
#: Folders that keep() has written and nothing has deleted.
_kept: list[str] = []

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def keep(df: DataFrame, name: str, *by: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder, in folders `by` columns, and reads it back: lineage is cut, and lost executors lose nothing.

    `rows`, if given, is at least the number of rows: no more files are then written than they need, or than there are cores.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
    out = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    writers = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    try:
        if by:  # a writer a folder, for few folders: rows needn't be sorted by them
            spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "8")
        (out.partitionBy(*by) if by else out).parquet(path)
    finally:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", writers)
    kept = spark.read.schema(schema).parquet(path)
    kept._kept = path
    _kept.append(path)
    return kept


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _kept.remove(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of keep(), once nothing reads them any more."""
    for t in tables:
        _delete(t.sparkSession, t._kept)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark then deletes the shuffle files that no table reads any more, which else stay until the driver's heap happens to fill."""
    spark._jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at the end what keep() wrote meanwhile, but for the tables put into the list it gives."""
    before, spared = set(_kept), []
    yield spared
    for path in [p for p in _kept if p not in before and p not in {t._kept for t in spared}]:
        _delete(spark, path)


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends whole texts to Python by BATCH_BYTES from now on: the setting's default would hold a whole split of the input several times over, in the JVM and in each worker."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = re.fullmatch(r"(-?\d+)b?", conf.get(name))
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns freed memory to the system, so that a worker which lives on doesn't hold what a large batch took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def no_overflow():
    """uint64 arithmetic wraps on purpose."""
    with np.errstate(over="ignore"):
        yield


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def values(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def _cut(array: pa.LargeStringArray) -> list[bytes]:
    """The values as bytes, cut from the array's buffer: a scalar for each would cost more than all else."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1].tolist() if len(array) else [0]
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def coded(column: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of a column of texts: the distinct ones, the number of each word among them in the order of the texts, and the offsets of each text's words.

    Null has no words. `lower` lower-cases A-Z. Arrow splits at exactly the six ASCII spaces, and gives empty parts at the ends of a text, which are left out.
    """
    texts = pa.array(values(column), pa.large_binary()).view(pa.large_string())  # laid out anew: the view of a slice would be lower-cased from the wrong place
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten().dictionary_encode()
    words, codes = _cut(flat.dictionary), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    full = codes != (words.index(b"") if b"" in words else -1)
    return words, codes[full], np.concatenate([[0], np.cumsum(full)])[offsets]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about CHUNK_BYTES of text each, and their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        col = batch.column(at).cast(pa.large_binary())
        sizes = np.array([0 if n is None else n for n in pc.binary_length(col).to_pylist()], np.int64)
        group = np.cumsum(sizes) // CHUNK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = batch.slice(lo, hi - lo)
            yield part, values(part.column(at))
        give_back()


def sequence_hash(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit Rabin-Karp hashes of every run of width values: a polynomial modulo 2**64 over hashed words, by prefix sums, finished by mix."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with no_overflow():
        base = pow(0x5851F42D4C957F2D + 2 * seed, 1, 1 << 64) | 1
        inverse = np.uint64(pow(base, -1, 1 << 64))
        up, down = np.full(len(h) + 1, np.uint64(base)), np.full(len(h) + 1, inverse)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * down[:-1], out=total[1:])
        return mix((total[width:] - total[:n]) * up[width - 1 : width - 1 + n])


def inside(ends: np.ndarray, width: int) -> np.ndarray:
    """For every start of a run of width values: whether the run stays in one text."""
    n = int(ends[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for e in np.unique(ends[1:-1]):
        ok[max(0, e - width + 1) : e] = False
    return ok


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df hasn't got."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
