"""Substring dedup: repeated fixed-length windows of words merge into maximal removal intervals.

Every window gets a Rabin-Karp hash. Windows are counted in Spark, after a lossless screen: a window's
anchor is the least hash of the shorter runs of words in it, so equal windows have equal anchors, and
a window whose anchor lies in one document only can't repeat. Only the others reach the exchange,
with 128 bits of hash. Word sequences that occur as a whole in an earlier document go as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, coded, forget, free_shuffles, keep, sequence_hash, signed, small_batches, unused, word_hashes

WINDOW = 50
#: Words of the runs among which a window's anchor is chosen.
RUN = 16
#: A window's place in its text is below this bit; above it is the tag of the text among those of its doc_id.
_TAG = 40
#: Bits of the map of candidates, by which texts are left out before they are dealt: the most, and those of one of its rows.
MAP_BITS, _ROW_BITS = 1 << 26, 1 << 15
_EMPTY = hashlib.sha256(b"").hexdigest()


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours."""
    have, out = 1, x
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if have < width else out


def anchors(h: np.ndarray, window: int, run: int) -> np.ndarray:
    """The anchor of every window over the word hashes h."""
    return _least(sequence_hash(h, run, 7), window - run + 1) if len(h) >= window else np.zeros(0, np.uint64)


def sequence_id(words: list[bytes]) -> tuple[bytes, int, int]:
    joined = b" ".join(words)
    both = np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64)
    return joined, int(both[0]), int(both[1])


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return small_batches(docs).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))


def heads(docs: DataFrame, window: int, run: int) -> DataFrame:
    """doc_id, n_words, s1 and s2 (hash of the word sequence), sha (of all words) and anchors (distinct) of every row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words, codes, ends = coded(part.column(1))
            least = anchors(word_hashes(words)[codes], window, run)
            cols: list[list] = [[], [], [], [], []]
            for t, lo, hi in zip(texts, ends.tolist(), ends[1:].tolist(), strict=False):
                joined, s1, s2 = sequence_id(t.split())
                own = np.unique(least[lo : hi - window + 1]) if hi - lo >= window else least[:0]
                for c, v in zip(cols, (hi - lo, s1, s2, hashlib.sha256(joined).hexdigest(), signed(own)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_words", "s1", "s2", "sha", "anchors"])

    return docs.mapInArrow(go, "doc_id long, n_words long, s1 long, s2 long, sha string, anchors array<long>")


def likely(rows: DataFrame, ids: DataFrame, n: int, most: int = MAP_BITS) -> DataFrame:
    """rows, without most of those whose doc_id is not among the n ids (none is lost that is): a map of hashed ids, of at most `most` bits, goes to every task."""
    bits = max(_ROW_BITS, min(most, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rest = F.pmod(place, F.lit(_ROW_BITS))
    full = ids.groupBy(F.floor(place / _ROW_BITS).alias("__row")).agg(F.bitmap_construct_agg(rest).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(rest / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__row", F.floor(place / _ROW_BITS)).join(F.broadcast(full), "__row")
    return found.where(F.floor(byte / F.pow(F.lit(2), F.pmod(rest, F.lit(8)))) % 2 == 1).select(rows.columns)


def _windows(window: int, run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words, codes, ends = coded(part.column(1))
            h = word_hashes(words)[codes]
            least, w1, w2 = anchors(h, window, run), sequence_hash(h, window, 1), sequence_hash(h, window, 2)
            ids, s1, s2, tags = (part.column(k).to_pylist() for k in (0, 2, 3, 4))
            seen = part.column(5)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, (lo, hi) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
                right = hi - lo >= window and sequence_id(texts[i].split())[1:] == (s1[i], s2[i])
                at = lo + np.flatnonzero(np.isin(signed(least[lo : hi - window + 1]), np.asarray(seen[i].values, np.int64))) if right else np.zeros(0, np.int64)
                for c, v in zip(out, (signed(w1[at]), signed(w2[at]), np.full(len(at), ids[i], np.int64), at - lo + (tags[i] << _TAG)), strict=True):
                    c.append(v)
            for k in range(0, len(ids), 64):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c[k : k + 64])) for c in out], names=["w1", "w2", "doc_id", "at"])

    return go


class Repeats:
    """Repeated windows of a table of documents.

    head: heads() of every row. reps: (s1, s2, rep, tag) for each sequence of window words or more, rep being the
    smallest doc_id that has it, and tag its number among the sequences of that doc_id (0, where doc_id is unique).
    candidates: doc_id, text and sequence of those that may share a window. starts: (doc_id, tag, starts) of repeated windows in
    them, as arrays, each bounded by its document's length. Rows whose doc_id is null take no part.
    """

    def __init__(self, docs: DataFrame, window: int = WINDOW, run: int = RUN, key: str = "doc_id", text: str = "text"):
        if not 1 <= run <= window:
            raise ValueError("run must be between 1 and window")
        self.window = window
        rows = _rows(docs, key, text)
        self.head = keep(heads(rows, window, run), "substring-heads")
        long = self.head.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
        tag = F.row_number().over(Window.partitionBy("rep").orderBy("s1", "s2")) - 1
        total = self.head.count()  # of the files' footers
        self.reps = keep(long.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")).withColumn("tag", tag.cast("long")), "substring-reps", rows=total)
        first = long.join(self.reps.withColumnRenamed("rep", "doc_id"), ["s1", "s2", "doc_id"])
        found = first.select("doc_id", "tag", F.explode("anchors").alias("anchor"))
        # Tables of their own on both sides of a join, so that a hot key can be split when it runs.
        shared = keep(found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "substring-anchors")
        wanted = found.join(shared, "anchor").groupBy("doc_id", "tag").agg(F.collect_set("anchor").alias("anchors"))
        wanted = keep(wanted.join(self.reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "tag"]), "substring-wanted", rows=total)
        free_shuffles(docs.sparkSession)
        self.candidates = keep(likely(rows, wanted, wanted.count()).join(wanted, "doc_id").select("doc_id", "text", "s1", "s2", "tag", "anchors"), "substring-candidates")
        free_shuffles(docs.sparkSession)
        hits = self.candidates.mapInArrow(_windows(window, run), "w1 long, w2 long, doc_id long, at long")
        hits = keep(hits, "substring-windows")
        earliest = keep(hits.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "substring-repeated")
        free_shuffles(docs.sparkSession)
        later = hits.join(earliest, ["w1", "w2"]).where("doc_id > lo").select("doc_id", F.shiftright("at", _TAG).alias("tag"), F.col("at").bitwiseAND(F.lit((1 << _TAG) - 1)).alias("at"))
        self.starts = keep(later.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("at")).alias("starts")), "substring-starts", rows=total)
        forget(shared, wanted, hits, earliest)
        free_shuffles(docs.sparkSession)


def merged(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of words that windows at these ascending starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    lo, hi = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + window
    return list(zip(lo.tolist(), hi.tolist(), strict=True))


def _without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for lo, hi in spans:
        out += words[at:lo]
        at = hi
    return out + words[at:]


def digest(docs: DataFrame, window: int = WINDOW, run: int = RUN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A word goes if a window over it also starts in a document with a smaller doc_id, judged on the input. A null text
    has no words. Rows with a null doc_id are kept whole and remove nothing. Rows with equal
    doc_id don't remove from each other. Texts under `window` words stay. Extra columns are not read.
    """
    found = Repeats(docs, window, run, key, text)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            cols: list[list] = [[], [], [], []]
            for t, s1, s2, s in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4), strict=True):
                words = t.split()
                if sequence_id(words)[1:] == (s1, s2):  # else another text of a repeated doc_id
                    kept = _without(words, merged(np.asarray(s.values, np.int64), window))
                    for c, v in zip(cols, (s1, s2, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["s1", "s2", "n_removed", "kept_sha256"])

    cut = found.candidates.join(found.starts, ["doc_id", "tag"]).select("doc_id", "text", "s1", "s2", "starts").mapInArrow(go, "s1 long, s2 long, n_removed long, kept_sha256 string")
    cut = cut.groupBy("s1", "s2").agg(F.max("n_removed").alias("n_removed"), F.max("kept_sha256").alias("kept_sha256"))
    head = found.head.select("doc_id", "n_words", "s1", "s2", "sha")
    out = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    takes_part = (F.col("n_words") >= window) & F.col("doc_id").isNotNull()
    whole = head.where(~takes_part).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    part = head.where(takes_part).join(found.reps, ["s1", "s2"])
    copies = part.where("doc_id <> rep").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(_EMPTY).alias("kept_sha256"))
    first = part.where("doc_id = rep").join(cut, ["s1", "s2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    return whole.select(out).unionByName(copies.select(out)).unionByName(first.select(out))


def remove(docs: DataFrame, window: int = WINDOW, run: int = RUN, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """docs, with all their columns, without the repeated words; texts that lose nothing stay as they are, byte by byte.

    A text that loses words becomes its kept words joined by one space; `length`, if given, names the column of
    its characters. Rows stay, even if nothing of their text does. Otherwise as digest().
    """
    found = Repeats(docs, window, run, key, text)
    own, size, reps = f"`{text}`", window, found.reps
    ids = found.head.where((F.col("n_words") >= size) & F.col("doc_id").isNotNull()).join(reps, ["s1", "s2"])
    spans = ids.where("doc_id <> rep").select("doc_id", "s1", "s2", F.array(F.lit(-1).cast("long")).alias("starts"))
    spans = spans.unionByName(ids.where("doc_id = rep").join(found.starts, ["doc_id", "tag"]).select("doc_id", "s1", "s2", "starts"))
    doc, cut = unused(docs, "__doc"), unused(docs, "__spans")
    spans = spans.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("s1", "s2", "starts")).alias(cut))
    joined = docs.join(spans, F.col(f"`{key}`").cast("long") == F.col(doc), "left").drop(doc)
    names = docs.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for part, texts in chunks(batches, text):
            new, spans = part.column(at).to_pylist(), part.column(len(names)).to_pylist()
            for i, (t, each) in enumerate(zip(texts, spans, strict=True)):
                if each:
                    words = t.split()
                    _, s1, s2 = sequence_id(words)
                    starts = next((s["starts"] for s in each if (s["s1"], s["s2"]) == (s1, s2)), [])
                    if starts:
                        kept = [] if starts[0] < 0 else _without(words, merged(np.array(starts), size))
                        new[i] = b" ".join(kept).decode("utf-8", "replace")
            cols = [part.column(k) for k in range(len(names))]
            cols[at] = pa.array(new, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = joined.mapInArrow(go, docs.schema)
    return out if length is None else out.withColumn(length, F.length(F.col(own)).cast(docs.schema[length].dataType))
