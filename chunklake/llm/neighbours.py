"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash function is floor((a . v + b) / w) for each of `per_table` Gaussian directions a, on vectors of
length 1. A query visits its own bucket and those that a small move away along some directions leads
to, in the order of their estimated success: sets of moves are ordered once by the expected squared
distance to the cell walls, and each query ranks its own walls. Candidates of all tables are merged and ranked by
their exact cosine.

The index is keyed by table and bucket. A row lies once in each table, with its vector, under its bucket; buckets whose
cells agree in the first directions form a group, and a query travels, with its vector, to the groups that hold buckets
it visits, and to no others. The more rows, the more directions make a group, so that groups keep their size; larger
ones are split by salt. Equal vectors are searched for once, and of equal vectors only the few of least id can be found.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, keep


@dataclass(frozen=True)
class Index:
    """tables hash tables of per_table directions each, with cells of this width; probes buckets a table. Groups of buckets hold about row_block rows, and meet query_block queries at a time. Recall of these figures is in the README."""

    tables: int = 8
    per_table: int = 14
    width: float = 2.5
    probes: int = 1500
    row_block: int = 4096
    query_block: int = 2048
    seed: int = 11

    def grouping(self, rows: int) -> int:
        """Directions that make a group: each parts rows about in two."""
        return min(self.per_table, max(0, math.ceil(math.log2(max(1, rows) / self.row_block))))


@functools.cache
def probe_sets(m: int, probes: int) -> list[tuple[int, ...]]:
    """The first `probes` sets of moves in ascending expected score, as places in a query's own ranking of its 2m walls; never both walls of one direction."""
    j = np.arange(1, 2 * m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    back = 2 * m + 1 - j
    z = np.where(j <= m, near, 1 - back / (m + 1) + back * (back + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(z[0], (0,))]
    while heap and len(out) < probes:
        score, a = heapq.heappop(heap)
        if not any(2 * m - 1 - x in a for x in a):
            out.append(a)
        last = a[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - z[last] + z[last + 1], (*a[:-1], last + 1)))
            heapq.heappush(heap, (score + z[last + 1], (*a, last + 1)))
    return out


class Table:
    """One hash table for vectors of one length. Keys are whole numbers in double precision: sums of a number a cell, below 2**52."""

    def __init__(self, index: Index, number: int, dim: int, grouping: int):
        rng = np.random.default_rng([index.seed, number, dim])
        self.m, self.width = index.per_table, index.width
        self.a, self.b = rng.normal(size=(dim, self.m)), rng.uniform(0, self.width, self.m)
        self.coef = rng.integers(1 << 40, 1 << 45, self.m).astype(np.float64)
        self.group_coef = np.where(np.arange(self.m) < grouping, self.coef, 0)
        sets = probe_sets(self.m, index.probes)
        self.moves = np.zeros((2 * self.m, len(sets)))
        for i, s in enumerate(sets):
            self.moves[list(s), i] = 1

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group and bucket of each vector."""
        cell = np.floor((unit @ self.a + self.b) / self.width)
        return cell @ self.group_coef, cell @ self.coef

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups and buckets that each vector visits, in the order of estimated success."""
        at = (unit @ self.a + self.b) / self.width
        cell = np.floor(at)
        walls = np.argsort(np.concatenate([at - cell, 1 - (at - cell)], axis=1), axis=1, kind="stable")
        return tuple((cell @ c)[:, None] + np.concatenate([-c, c])[walls] @ self.moves for c in (self.group_coef, self.coef))


def cosine(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Double-precision cosines by row, each pair summed alike wherever it stands."""
    return (rows * queries).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((queries * queries).sum(axis=1)))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1. Divided by the largest component first: so that no square overflows or vanishes."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches (dim, ...) by dim."""
    for b in batches:
        dims = b.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            yield dim, b.take(pa.array(np.flatnonzero(dims == dim)))


def _placed(index: Index, grouping: int, vectors: bool):
    """From (dim, id, v): a row a table with group, bucket and id, and with the vector, if asked for."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _by_length(batches):
            unit = _unit(_vectors(part.column(2)))
            for t in range(index.tables):
                group, bucket = Table(index, t, dim, grouping).keys(unit)
                cols = {"dim": part.column(0), "t": pa.array(np.full(len(unit), t, np.int32)), "grp": pa.array(group.astype(np.int64))}
                yield pa.RecordBatch.from_pydict(cols | ({"bucket": pa.array(bucket.astype(np.int64)), "id": part.column(1), "v": part.column(2)} if vectors else {}))

    return go


def _asked(index: Index, grouping: int):
    """From (dim, id, v): a row for each table and group that the query visits."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, whole in _by_length(batches):
            for part in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):
                unit = _unit(_vectors(part.column(2)))
                for t in range(index.tables):
                    groups = np.sort(Table(index, t, dim, grouping).visits(unit)[0].astype(np.int64), axis=1)
                    new = np.concatenate([np.ones((len(groups), 1), bool), groups[:, 1:] != groups[:, :-1]], axis=1)
                    at = pa.array(np.nonzero(new)[0])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), pa.array(np.full(len(at), t, np.int32)), pa.array(groups[new]), part.column(1).take(at), part.column(2).take(at)], names=["dim", "t", "grp", "id", "v"]
                    )

    return go


def _best(ur: np.ndarray, uq: np.ndarray, rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, may: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and exact cosine of the k best rows of each query among those it may see; ties to the smaller id."""
    rough = uq @ ur.T
    if may is not None:
        rough[~may] = -np.inf
    least = np.partition(rough, max(0, len(ur) - k), axis=1)[:, max(0, len(ur) - k)]
    q, r = np.nonzero((rough >= (least - 1e-9)[:, None]) & (rough > -np.inf))
    exact = cosine(rows[r], queries[q])
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    first = np.searchsorted(q, q)
    top = np.arange(len(q)) - first < k
    return q[top], r[top], exact[top]


def _search(index: Index, grouping: int, k: int, everywhere: bool = False):
    """The k best rows of a part of a group for each query of a block; `everywhere`: of all rows, whatever their bucket."""

    def go(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            rows, queries = _vectors(left.column("v")), _vectors(right.column("v"))
            ids, asks = left.column("id").to_numpy(), right.column("id").to_numpy()
            ur, uq = _unit(rows), _unit(queries)
            if not everywhere:
                table, group = Table(index, key[1].as_py(), key[0].as_py(), grouping), key[2].as_py()
                buckets, place = np.unique(left.column("bucket").to_numpy(), return_inverse=True)
            for lo in range(0, len(queries), 256):
                part, may = uq[lo : lo + 256], None
                if not everywhere:
                    groups, visited = table.visits(part)
                    q, n = np.nonzero(groups == group)
                    visited = visited[q, n].astype(np.int64)
                    at = np.minimum(np.searchsorted(buckets, visited), len(buckets) - 1)
                    hit = buckets[at] == visited
                    seen = np.zeros((len(part), len(buckets)), bool)
                    seen[q[hit], at[hit]] = True
                    may = seen[:, place]
                q, r, score = _best(ur, part, rows, queries[lo : lo + 256], ids, may, k)
                for c, x in zip(out, (asks[lo + q], ids[r], score), strict=True):
                    c.append(x)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"ask": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    return go


def nearest(vectors: DataFrame, every: int, k: int, index: Index = Index(), key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest rows by cosine that the index finds for each row whose key is divisible by `every`.

    Ties go to the smaller key. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows with a null key; vectors of different lengths aren't compared. Rows equal in key and vector count
    once. Of repeated keys, the least vector is the query; all are candidates for others. A query whose buckets hold
    too few rows over all tables is compared with all rows instead, block by block. Extra columns are not read.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if isinstance(vectors.schema[value].dataType.elementType, T.FloatType) else "array<double>"
    v = F.col(f"`{value}`").cast(kind)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine).select(F.size("v").alias("dim"), "id", "v")
    queries = rows.where(F.col("id") % every == 0)
    repeated = queries.groupBy("id").agg(F.countDistinct("v").alias("n")).agg(F.max("n")).first()[0]
    if not repeated:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = k + repeated  # a query's own rows are found, and left out at the end
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    # Of equal vectors all have the same score, and ties go to the smaller ids: no others than the first can be among the nearest.
    known = keep(rows.withColumn("__n", place).where(F.col("__n") <= wanted).drop("__n").dropDuplicates(["v", "id"]), "ann-rows")
    asks = queries.groupBy("id", "dim").agg(F.min("v").alias("v")) if repeated == 1 else queries.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("dim", "v"))).where("__n = 1").drop("__n")
    asks = keep(asks, "ann-asks")
    classes = keep(asks.groupBy("dim", "v").agg(F.min("id").alias("id")).select("dim", "id", "v"), "ann-classes")
    grouping = index.grouping(known.count())
    cell = ["dim", "t", "grp"]
    visits = keep(classes.mapInArrow(_asked(index, grouping), f"dim int, t int, grp long, id long, v {kind}"), "ann-visits")
    sizes = known.mapInArrow(_placed(index, grouping, False), "dim int, t int, grp long").groupBy(*cell).agg(F.count(F.lit(1)).alias("r"))
    sizes = keep(sizes.join(visits.groupBy(*cell).agg(F.count(F.lit(1)).alias("q")), cell), "ann-sizes")
    parts = lambda n, block: F.ceil(F.col(n) / F.lit(block)).cast("int")
    sizes = sizes.select(*cell, parts("r", index.row_block).alias("r"), parts("q", index.query_block).alias("q"))
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = known.mapInArrow(_placed(index, grouping, True), f"dim int, t int, grp long, bucket long, id long, v {kind}").join(sizes, cell).select(*cell, mine("r").alias("i"), each("q").alias("j"), "bucket", "id", "v")
    right = visits.join(sizes, cell).select(*cell, each("r").alias("i"), mine("q").alias("j"), "id", "v")
    by = [*cell, "i", "j"]
    result = "ask long, vec_id long, score double"
    found = keep(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(index, grouping, wanted), result).distinct(), "ann-found")
    forget(visits)
    # Queries that the tables served badly, if any: against all rows, in blocks.
    short = keep(classes.join(found.groupBy(F.col("ask").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= wanted), "id", "left_anti").select("dim", "id", "v"), "ann-short")
    counts = [short.count(), known.count()]
    if counts[0]:
        r, q = max(1, -(-counts[1] // index.row_block)), max(1, -(-counts[0] // index.query_block))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = known.select("dim", mine(F.lit(r)).alias("i"), spread(q).alias("j"), "id", "v")
        right = short.select("dim", spread(r).alias("i"), mine(F.lit(q)).alias("j"), "id", "v")
        more = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(_search(index, grouping, wanted, True), result)
        found = found.unionByName(more).distinct()
    top = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("__n", top).where(F.col("__n") <= wanted).drop("__n")
    members = asks.join(classes.select("dim", "v", F.col("id").alias("ask")), ["dim", "v"]).select(F.col("id").alias("query_id"), "ask")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = members.join(found, "ask").where("vec_id <> query_id").withColumn("rank", rank.cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
