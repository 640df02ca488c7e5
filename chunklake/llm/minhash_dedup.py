"""Near-duplicates by SuperMinHash signatures, banding, verification and grouping.

SuperMinHash ranks the slots of a signature by one random permutation for each element: element d
offers slot perm_d(j) the value j + r_dj. Slots of one element thus get different ranks, which lowers
the variance, and once all slots of a set hold values below j + 1, later steps can't change
any, so they are left out. All sets of a chunk take step j together.

Documents with equal shingle sets form a class. Classes that agree in a band are candidates. Each
class is first verified against the one it shares most bands with. In bands that still hold several
components after that, all pairs across components are compared: in bands of up to HOT rows on compact
sketches, the pairs that may reach the threshold then being verified on full sets; in larger bands on full sets at once,
block by block, the classes outside the band's largest component against all: so a stray in a large group meets each
member once, no task holds the group, and only links leave a block, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, coded, forget, keep, mix, signed, small_batches, unused, word_hashes
from .components import components

SLOTS, BANDS = 256, 32
#: Members up to which a band is compared on sketches, and rows of a block in larger ones.
HOT, BLOCK = 128, 512
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Setting:
    """Words of a shingle; percent of the union that the intersection must reach; bands of the signature: at the threshold, one of (1 - p**(SLOTS // bands))**bands pairs is missed."""

    shingle: int
    percent: int
    bands: int = BANDS


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text: A-Z lower-cased; fewer words than `width` are one shingle; no words, none."""
    words, codes, ends = coded(texts, lower=True)
    h = word_hashes(words)[codes]
    with np.errstate(over="ignore"):
        s = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            s = mix(s * _GOLDEN + h[k : k + len(s)])
        out = []
        for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            if hi - lo >= width:
                x = np.sort(s[lo : hi - width + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif hi > lo:
                x = np.zeros(1, np.uint64)
                for k in range(lo, hi):
                    x = mix(x * _GOLDEN + h[k])
                out.append(mix(x + np.uint64(hi - lo)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (one row of `slots` values for each nonempty set; empty sets get all ones)."""
    n = np.array([len(s) for s in sets], np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((len(sets), slots), top)
    flat = sig.reshape(-1)
    x = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), n)
    perm = None
    low = np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for j in range(slots):
            if not len(x):
                break
            r = mix(x + np.uint64(j + 1) * _GOLDEN)
            k = j + (((r & low) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
            if perm is None:
                slot = k
            else:
                at = np.arange(len(x))
                slot = perm[at, k].astype(np.int64)
                perm[at, k] = perm[:, j]
            np.minimum.at(flat, owner * slots + slot, (np.uint64(j) << np.uint64(32)) | (r >> np.uint64(32)))
            done = sig.max(axis=1) < (np.uint64(j + 1) << np.uint64(32)) if j < 8 or j % 4 == 0 else None
            if done is not None and done[owner].any():
                left = ~done[owner]
                if perm is None or left.sum() < 0.7 * len(left):
                    x, owner = x[left], owner[left]
                    perm = None if perm is None else perm[left]
                    k = k[left]
            if perm is None and j == 0:
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(x), 1))
                perm[np.arange(len(x)), k] = 0
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature, the band's number mixed in."""
    rows = sig.shape[1] // bands
    with np.errstate(over="ignore"):
        out = mix(np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1)) * _GOLDEN)
        for k in range(rows):
            out = mix(out * _GOLDEN + sig[:, k::rows][:, :bands])
    return out


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return small_batches(docs).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))


def _set_id(s: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(both[0]), int(both[1])


def signatures(rows: DataFrame, setting: Setting) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (hash of the set), bands and sketch (one byte a slot) of every row; null bands for empty sets."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in chunks(batches):
            sets = shingle_sets(part.column(1), setting.shingle)
            for lo in range(0, len(sets), 256):
                own = sets[lo : lo + 256]
                sig = superminhash(own)
                bands, sketch = signed(band_keys(sig, setting.bands)), (mix(sig) & np.uint64(255)).astype(np.uint8)
                ids = [_set_id(s) for s in own]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).slice(lo, len(own)), pa.array([len(s) for s in own], pa.int64()), pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int64()),
                    pa.array([b if len(s) else None for b, s in zip(bands, own, strict=True)], pa.list_(pa.int64())), pa.array([k.tobytes() if len(s) else None for k, s in zip(sketch, own, strict=True)], pa.binary()),
                ], names=["doc_id", "n", "s1", "s2", "bands", "sketch"])

    return rows.mapInArrow(go, "doc_id long, n long, s1 long, s2 long, bands array<long>, sketch binary")


def _full_sets(width: int):
    """From (doc_id, text, s1, s2): doc_id and the items of its set, where that is the set in question."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in chunks(batches):
            sets = shingle_sets(part.column(1), width)
            right = [_set_id(s) == (x, y) for s, x, y in zip(sets, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "items"]).filter(pa.array(right, pa.bool_()))

    return go


def _verified(percent: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ok = []
            for x, y in zip(part.column(2), part.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return go


def _bytes(t: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in t.column(column).to_pylist()]


def _first_shared(marks: tuple[np.ndarray, np.ndarray], i: int, may: np.ndarray, band: int) -> np.ndarray:
    """Of the rows may, those that share no earlier band with row i: every pair is compared in one band only."""
    if not len(may):
        return may
    same = marks[1][may] == marks[0][i]
    return may[np.argmax(same, axis=1) == band] if band >= 0 else may


def _near(percent: int, slots: int):
    """Pairs of a band, across components, whose sketches and sizes may reach the threshold."""
    p = percent / 100
    least = p - 5.5 * (p * (1 - p) / slots) ** 0.5
    need = slots * (least + (1 - least) / 256)

    def go(t: pa.Table) -> pa.Table:
        a, b = [], []
        x = np.stack(_bytes(t, "sketch", np.uint8))
        marks = np.stack(_bytes(t, "marks", np.uint64))
        ids, comp, size, band = (t.column(c).to_numpy() for c in ("id", "comp", "n", "at"))
        for i in range(t.num_rows):
            may = np.flatnonzero((comp > comp[i]) & (100 * np.minimum(size[i], size) >= percent * np.maximum(size[i], size)))
            may = may[(x[may] == x[i]).sum(axis=1) >= need] if len(may) else may
            may = _first_shared((marks, marks), i, may, int(band[i]))
            a += [ids[i]] * len(may)
            b += ids[may].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return go


def _linked(percent: int):
    """Links between a block of rows outside a band's largest component (left) and a block of all its rows (right), across components, on full sets: at most one for each row and other component. Of two rows that both are left rows, the one of the smaller component looks for the other."""

    def go(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            sets = tuple(_bytes(t, "items", np.uint64) for t in (left, right))
            ids, comp = ([t.column(c).to_numpy() for t in (left, right)] for c in ("id", "comp"))
            marks = tuple(np.stack(_bytes(t, "marks", np.uint64)) for t in (left, right))
            band, main = int(left.column("at")[0].as_py()), int(left.column("main")[0].as_py())
            size = [np.array([len(s) for s in own]) for own in sets]
            # The right block as rows x distinct items, for all intersections of a set at once.
            items, place = np.unique(np.concatenate(sets[1]), return_inverse=True)
            owner = np.repeat(np.arange(right.num_rows), size[1])
            order = np.argsort(place, kind="stable")
            owner, cuts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(items)))])
            for i, own in enumerate(sets[0]):
                at = np.searchsorted(items, own)
                at = at[(at < len(items)) & (items[np.minimum(at, len(items) - 1)] == own)]
                n = cuts[at + 1] - cuts[at]
                rows = owner[np.repeat(cuts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                both = np.bincount(rows, minlength=right.num_rows)
                hit = np.flatnonzero(((comp[1] > comp[0][i]) | (comp[1] == main)) & (100 * both >= percent * (size[0][i] + size[1] - both)))
                hit = _first_shared(marks, i, hit, band)
                _, one = np.unique(comp[1][hit], return_index=True)
                a += [ids[0][i]] * len(one)
                b += ids[1][hit[one]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return go


def groups(docs: DataFrame, setting: Setting, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Texts whose shingle sets have 100 * |intersection| >= percent * |union| are linked, on full sets;
    component_id is the smallest doc_id reachable; kept says whether that is the row's own. Empty
    sets (null text, no words) are linked with nothing. Rows with equal doc_id and different texts are told
    apart by their sets, but share links through the id. A null doc_id takes part in nothing: component_id is
    null and the row is kept. Extra columns are not read.
    """
    rows = _rows(docs, key, text)
    sig = keep(signatures(rows, setting), "minhash-signatures")
    total = sig.count()  # of the files' footers; bounds all tables with a row a document or class
    full = sig.where("n > 0 and doc_id is not null")
    classes = keep(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "minhash-classes", rows=total)
    own = ["doc_id", "s1", "s2"]
    reps = classes.select(F.col("rep").alias("doc_id"), "s1", "s2")
    members = full.select(*own, "bands").join(reps, own).select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    # Tables of their own on both sides of a join, so that a hot band or class can be split when it runs.
    hubs = keep(members.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("band", "hub"), "minhash-hubs", rows=total * setting.bands // 2)
    met = keep(members.join(hubs, "band"), "minhash-met", rows=total * setting.bands)  # bands that several classes share
    stars = met.where("id > hub").groupBy("id", "hub").count()
    best = stars.groupBy("id").agg(F.max(F.struct("count", (-F.col("hub")).alias("h"))).alias("best"))
    first = keep(best.select((-F.col("best.h")).alias("a"), F.col("id").alias("b")), "minhash-first", rows=total)
    linked = verify(first, rows, reps, setting, total)
    comp = components(linked, rows=total)

    # All other pairs: within a band, across components.
    shared = met.join(comp, "id", "left").select("band", "id", F.coalesce("component", "id").alias("comp")).distinct()
    parted = shared.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    several = parted.groupBy("band").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("main"))
    several = several.where("comps > 1").select("band", "size", F.col("main.comp").alias("main"), (F.col("size") - F.col("main.n")).alias("others"))
    opened = keep(shared.join(several, "band"), "minhash-open", rows=total * setting.bands)
    forget(hubs, met, first)
    ids = opened.select(F.col("id").alias("doc_id")).distinct().join(reps, "doc_id")
    facts = full.select(*own, "n", "sketch", "bands").join(ids, own).select(F.col("doc_id").alias("id"), "n", "sketch", "bands")
    placed = opened.join(facts, "id").select("band", "id", "comp", "size", "main", "others", "n", "sketch", (F.array_position("bands", F.col("band")) - 1).alias("at"), _marks("bands").alias("marks"))
    placed = keep(placed, "minhash-placed", rows=total * setting.bands)
    small = placed.where(F.col("size") <= HOT).groupBy("band").applyInArrow(_near(setting.percent, SLOTS), "a long, b long")
    pairs = keep(small, "minhash-second")
    links = verify(pairs, rows, reps, setting, None)
    forget(pairs)
    parts = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    hot = placed.where(F.col("size") > HOT).select("band", "id", "comp", "main", "at", "marks", parts("others").alias("lefts"), parts("size").alias("rights"))
    hot = keep(hot.join(_sets(hot.select(F.col("id").alias("doc_id")), rows, reps, setting), "id"), "minhash-hot")
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = hot.where("comp <> main").select("band", block("lefts").alias("i"), every("rights").alias("j"), "id", "comp", "main", "at", "marks", "items")
    right = hot.select("band", every("lefts").alias("i"), block("rights").alias("j"), "id", "comp", "main", "at", "marks", "items")
    more = left.groupBy("band", "i", "j").cogroup(right.groupBy("band", "i", "j")).applyInArrow(_linked(setting.percent), "a long, b long")
    comp = components(linked.unionByName(links).unionByName(more)).select(F.col("id").alias("rep"), "component")

    of_class = keep(classes.join(comp, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id")), "minhash-components", rows=total)
    forget(classes, linked, links, opened, placed, hot)
    narrow = sig.select("doc_id", "n", "s1", "s2")
    alone = narrow.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    rest = narrow.where("n > 0 and doc_id is not null").join(of_class, ["s1", "s2"]).select("doc_id", "n", "component_id")
    return alone.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, setting: Setting, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are kept by groups(): one of each group. Rows with a null key and empty texts stay.

    Of rows equal in key and text one stays: the least by all other columns in their order, null first, as text.
    """
    own, place = unused(docs, "__kept"), unused(docs, "__place")
    kept = groups(docs, setting, key, text).where("kept").select(F.col("doc_id").alias(own)).distinct()
    rows = docs.join(kept, F.col(f"`{key}`").cast("long").eqNullSafe(F.col(own)), "left_semi")
    others = [F.struct(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`").cast("string")) for c in docs.columns if c not in (key, text)]
    first = F.row_number().over(Window.partitionBy(F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`"))).orderBy(*others or [F.lit(0)]))
    return rows.withColumn(place, first).where(F.col(place) == 1).drop(place)


def _marks(bands: str):
    """Every band key, one after the other, as numpy reads them."""
    flip = lambda h: F.concat(*[F.substring(h, k, 2) for k in range(15, 0, -2)])
    return F.unhex(F.array_join(F.transform(bands, lambda b: flip(F.lpad(F.hex(b), 16, "0"))), ""))


def _sets(ids: DataFrame, rows: DataFrame, reps: DataFrame, setting: Setting) -> DataFrame:
    """(id, items) for the ids in question: their sets are made anew, so that no set is stored for all documents."""
    return rows.join(ids.distinct().join(reps, "doc_id"), "doc_id").select("doc_id", "text", "s1", "s2").mapInArrow(_full_sets(setting.shingle), "id long, items binary")


def verify(pairs: DataFrame, rows: DataFrame, reps: DataFrame, setting: Setting, most: int | None) -> DataFrame:
    """The pairs (a, b) of class ids whose full shingle sets reach the threshold, as a kept table; `most`, if given, is at least the number of pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sets = keep(_sets(ids, rows, reps, setting), "minhash-sets")
    a, b = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    found = keep(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_verified(setting.percent), "a long, b long"), "minhash-links", rows=most)
    forget(sets)
    return found
