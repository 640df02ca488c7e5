"""Scores of texts by a causal self-attention model over subword ids, beside a unigram base.

One pass splits words (and one end a text) into subword ids and keeps them; all else reads the ids. The model predicts a
subword's class from the tokens before it, in overlapping windows that score each token once; within a class, a subword
has its unigram probability, so that the score is a proper distribution. Weights are trained on every token of each training
text once, in rounds: trainers each take a share of a round's windows, and their weights are averaged before the next. Counts
cover all training documents. Word counts stay distributed: the frequent ones (a table of bounded size) go to the workers,
all others meet their documents in a join.
"""

from __future__ import annotations

import base64
import dataclasses
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import attention
from .attention import Shape
from .common import chunks, coded, forget, keep, mix, signed, small_batches

#: Frequent words whose counts are sent to every worker: 16 bytes each.
FREQUENT = 524_288
#: Windows of a training document that travel as one piece: every window is trained on.
PIECE_WINDOWS = 256
#: Windows that one trainer sees in a round, and the rounds that the training documents are dealt to; after a round, weights are averaged.
TRAINER_WINDOWS, ROUNDS = 100_000, 4
WORDS_CACHED = 400_000
#: The published pattern of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER_SPACE = re.compile(r"[^\S ]|[\x1c-\x1f]")
_END = b""  # no word is empty
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_keys(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word from its subword ids, which tell words apart: a polynomial over hashed ids."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(place.max() + 1, _BASE))
        kinds = mix(np.arange(1, int(ids.max()) + 2, dtype=np.uint64))
        return mix(np.add.reduceat(kinds[ids] * powers[place], starts))


class Subwords:
    """Words of a group as numbers, with their keys and subword ids; remembered up to a bound."""

    def __init__(self, ranks: bytes):
        self._table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.end_id = max(self._table.values()) + 1
        self.size = self.end_id + 1
        self._spaced = np.zeros(self.size, bool)
        self._spaced[[i for piece, i in self._table.items() if piece.startswith(b" ")]] = True
        self._encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=self._table, special_tokens={})
        self.forget()

    def full(self) -> bool:
        return len(self.numbers) > WORDS_CACHED

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.key, self.start, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, an end after each text, and the offsets of the texts."""
        if self.full():
            self.forget()
        words, codes, ends = coded(texts, lower=True)
        known = self.numbers
        new = [w for w in dict.fromkeys([_END, *words]) if w not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        end = known[_END]
        own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[codes]
        n = np.diff(ends)
        numbers = np.full(len(own) + len(n), end, np.int64)
        numbers[np.arange(len(own)) + np.repeat(np.arange(len(n)), n)] = own
        ends = ends + np.arange(len(ends))
        ids, sizes = self._encoded(new)
        self.key = np.concatenate([self.key, word_keys(ids, np.cumsum(sizes) - sizes)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        return numbers, ends

    def _one(self, word: bytes) -> list[int]:
        if word == _END:
            return [self.end_id]
        try:
            return self._encoding.encode_ordinary(" " + word.decode())
        except UnicodeDecodeError:  # no text: byte by byte
            return [self._table[bytes([b])] for b in b" " + word]

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of each word after a space, end to end, and how many each has. Words are encoded in one go where each id that starts with a space starts a word."""
        own = np.array([w != _END for w in words], bool)
        try:
            text = (b" " + b" ".join([w for w in words if w != _END])).decode()
        except UnicodeDecodeError:
            text = "\t"
        if own.any() and not _OTHER_SPACE.search(text):
            flat = np.array(self._encoding.encode_ordinary(text), np.int32)
            starts = np.flatnonzero(self._spaced[flat])
            if len(starts) == own.sum():
                sizes = np.ones(len(words), np.int64)
                sizes[own] = np.diff(np.append(starts, len(flat)))
                ids = np.full(sizes.sum(), self.end_id, np.int32)
                ids[np.repeat(own, sizes)] = flat
                return ids, sizes
        each = [self._one(w) for w in words]
        return np.array([i for e in each for i in e], np.int32), np.array([len(e) for e in each], np.int64)

    def totals(self, counts: np.ndarray) -> np.ndarray:
        """How often each subword id occurs if the word of each number occurs that often."""
        n = np.diff(self.start[: len(counts) + 1])
        return np.bincount(self.ids[: n.sum()], np.repeat(counts, n), self.size).astype(np.int64)

    def stream(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subword ids of the group, end to end, the offsets of the texts, and those of the words."""
        n = self.start[numbers + 1] - self.start[numbers]
        before = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.start[numbers] - before[:-1], n) + np.arange(before[-1])
        return self.ids[at], before[ends], before[:-1]


_made: dict[bytes, Subwords] = {}


def _subwords(ranks: bytes) -> Subwords:
    key = hashlib.sha256(ranks).digest()
    if key not in _made:
        _made[key] = Subwords(ranks)
    return _made[key]


def _laid(seq: np.ndarray, ends: np.ndarray, shape: Shape, maps: tuple[np.ndarray, np.ndarray]):
    """Windows over a group of subword sequences: text of each, inputs, targets, and which positions are scored."""
    text, begin, score = attention.windows(np.diff(ends), shape)
    at = (ends[text] + begin)[:, None] + np.arange(shape.window)
    last = ends[text + 1][:, None]
    real = (at < last) & (at >= (ends[text] + score)[:, None])
    of_input, of_class = maps
    inputs = of_input[np.concatenate([[-1], seq[:-1]])]
    inputs[ends[:-1]] = of_input[-1]
    safe = np.minimum(at, last - 1)
    return text, inputs[safe], of_class[seq[safe]], real


def _kind_of_ids(size: int) -> type:
    """The smallest type that holds subword ids below size, and size itself, which stands before a text."""
    return np.uint16 if size <= 0xFFFF else np.uint32


def gather(rows: DataFrame, ranks, shape: Shape) -> DataFrame:
    """What the rows (doc_id, held_out, text) hold: kind 0, word key k and count c; kind 1, subword id k and count c, both of the rows that aren't held out; kind 2, a text of document k as ids, with bits that mark the first id of each word, a hash of the text and its number c of windows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = _subwords(ranks.value)  # with the words of the worker's tasks before
        total, seen, kind_of_id = np.zeros(sub.size, np.int64), np.zeros(0, np.int64), _kind_of_ids(sub.size)

        def out(kind: int, k, c: np.ndarray, *texts: pa.Array) -> pa.RecordBatch:
            none = [pa.nulls(len(c), t) for t in (pa.bool_(), pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), pa.array(k, pa.int64()), pa.array(c, pa.int64()), *(texts or none)], names=["kind", "k", "c", "held_out", "h", "ids", "first"])

        def words(seen: np.ndarray) -> pa.RecordBatch:
            used = np.flatnonzero(seen)
            return out(0, signed(sub.key[used]), seen[used])

        for part, texts in chunks(batches):
            if sub.full():  # counts of a task leave it once a cache, not once a chunk
                yield words(seen)
                total += sub.totals(seen)
                sub.forget()
                seen = np.zeros(0, np.int64)
            numbers, ends = sub.group(part.column(2))
            trains = ~np.array(part.column(1).to_pylist(), bool)
            n = np.bincount(numbers[np.repeat(trains, np.diff(ends))], minlength=len(sub.key))
            n[: len(seen)] += seen
            seen = n
            seq, offsets, firsts = sub.stream(numbers, ends)
            seq, mark = seq.astype(kind_of_id), np.zeros(len(seq), bool)
            mark[firsts] = True
            cuts = list(zip(offsets.tolist(), offsets[1:].tolist(), strict=False))
            yield out(
                2, part.column(0), -(-np.diff(offsets) // shape.window), part.column(1), pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], pa.int64()),
                pa.array([seq[lo:hi].tobytes() for lo, hi in cuts], pa.binary()), pa.array([np.packbits(mark[lo:hi]).tobytes() for lo, hi in cuts], pa.binary()),
            )
        yield words(seen)
        total += sub.totals(seen)
        used = np.flatnonzero(total)
        yield out(1, used, total[used])

    return rows.mapInArrow(go, "kind int, k long, c long, held_out boolean, h long, ids binary, first binary")


def classes_of(counts: np.ndarray, classes: int) -> np.ndarray:
    """A class for each subword id, by falling count: one of its own for each of the most frequent, as long as it has no less than its part of what is left; the rest is cut into equal shares of all tokens. Ids never seen are in the last."""
    order = np.argsort(-counts, kind="stable")
    p = counts[order] / max(1, counts.sum())
    left = 1 - np.concatenate([[0], np.cumsum(p)[:-1]])
    n = min(classes, len(p)) - 1
    alone = int(np.argmin(np.append(p[:n] * (classes - np.arange(n)) >= left[:n], False)))
    share = (left[alone] - left[alone:]) / max(left[alone], 1e-12) * (classes - alone)
    cls = np.empty(len(counts), np.int64)
    cls[order] = np.minimum(classes - 1, np.concatenate([np.arange(alone), alone + share.astype(np.int64)]))
    return cls


def maps_of(counts: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """For each subword id, its input (a number of its own for the most frequent ones, else its class's; last: before a text), and its class."""
    cls = classes_of(counts, shape.classes)
    of_input = np.append(shape.frequent + cls, shape.frequent + shape.classes)
    own = np.argsort(-counts, kind="stable")[: shape.frequent]
    of_input[own] = np.arange(len(own))
    return of_input, cls


def _cut(texts: DataFrame, size: int, shape: Shape) -> DataFrame:
    """Pieces (k, piece, ids) of texts (k, ids): the id before the piece (size: none) and those of its windows, at most PIECE_WINDOWS. Windows for training don't overlap, so every token is a target once."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, long = _kind_of_ids(size), PIECE_WINDOWS * shape.window
        for b in batches:
            out: list[list] = [[], [], []]
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seq = np.concatenate([np.array([size], kind), np.frombuffer(ids, kind)])
                for i, lo in enumerate(range(0, len(seq) - 1, long)):
                    for c, v in zip(out, (k, i, seq[lo : lo + long + 1].tobytes()), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["k", "piece", "ids"])

    return texts.select("k", "ids").mapInArrow(go, "k long, piece long, ids binary")


def _windows_of(pieces: list[bytes], maps: tuple[np.ndarray, np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and real positions of all windows of the pieces, in an order that doesn't depend on theirs."""
    of_input, of_class = maps
    kind = _kind_of_ids(len(of_class))
    ids = np.frombuffer(b"".join(sorted(pieces)), kind)
    ends = np.concatenate([[0], np.cumsum([len(x) // kind().itemsize for x in sorted(pieces)])])
    text, begin, _ = attention.windows(np.diff(ends) - 1, dataclasses.replace(shape, overlap=0))
    at = (ends[text] + begin).astype(np.int32)[:, None] + np.arange(shape.window, dtype=np.int32)  # a trainer's share is bounded
    last = ends[text + 1].astype(np.int32)[:, None] - 2
    real = at <= last
    at = np.minimum(at, last)
    return of_input.astype(np.int32)[ids][at], np.append(of_class, 0).astype(np.int32)[ids[1:]][at], real  # 0: where a piece begins, which is no target


def _trainer(flat: np.ndarray, maps: tuple[np.ndarray, np.ndarray], class_counts: np.ndarray, shape: Shape, seed: int):
    """One trainer's round: its windows, from the weights in flat; yields each weight times the number of windows."""

    def go(t: pa.Table) -> pa.Table:
        inputs, targets, real = _windows_of(t.column("ids").to_pylist(), maps, shape)
        p = attention.train(attention.unpack(flat, attention.fresh(shape, class_counts)), inputs, targets, real, seed=seed)
        v = attention.pack(p).astype(np.float64)
        return pa.table({"i": np.arange(len(v)), "v": v * len(real), "n": np.full(len(v), len(real))})

    return go


def trainers_of(n: int) -> int:
    """Trainers of a round, n windows being dealt over all rounds: by one rule at every size."""
    return max(1, -(-n // (TRAINER_WINDOWS * ROUNDS)))


def fit(texts: DataFrame, maps: tuple[np.ndarray, np.ndarray], class_counts: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Weights after ROUNDS rounds on the texts (k, c, ids): each document is dealt to one round, and in it, piece by piece, to trainers, whose weights are averaged. As many weights as the shape has reach the driver, whatever the input."""
    weights = attention.fresh(shape, class_counts)
    n = texts.agg(F.sum("c")).first()[0]
    if not n:
        return weights
    trainers = trainers_of(n)
    for r in range(ROUNDS):
        pieces = _cut(texts.where(F.pmod(F.xxhash64("k", F.lit("round")), F.lit(ROUNDS)) == r), len(maps[1]), shape)
        dealt = pieces.select("ids", F.pmod(F.xxhash64("k", "piece"), F.lit(trainers)).cast("int").alias("trainer")).repartition(min(trainers, 1000), "trainer")
        trained = dealt.groupBy("trainer").applyInArrow(_trainer(attention.pack(weights), maps, class_counts, shape, r), "i long, v double, n long")
        found = trained.groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
        if len(found):  # a round may have no documents, if there are few
            new = np.empty(len(found))
            new[found["i"].to_numpy()] = found["v"].to_numpy()
            weights = attention.unpack(new, weights)
    return weights


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent words: all with a count from some threshold on, at most FREQUENT of them."""
    bins = sorted(((b, n) for b, n in counts.groupBy(F.floor(F.log2("c") * 8).alias("b")).count().collect()), reverse=True)
    least, total = None, 0
    for b, n in bins:
        if total + n > FREQUENT:
            break
        least, total = b, total + n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = counts.where(F.floor(F.log2("c") * 8) >= least).toPandas()
    h, c = t["k"].to_numpy().astype(np.int64).view(np.uint64), t["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text (null: the empty text) mod 7 is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def alike(scored: DataFrame) -> DataFrame:
    """scored, in which equal texts have the least of their scores: where a text stands in its batch can move its score in single precision."""
    same = scored.groupBy("text_hash", "n_tokens").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return scored.join(same, ["text_hash", "n_tokens"], "left").withColumn("score", F.coalesce("least", "score")).drop("least")


def score(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Training rows are those that held_out() leaves. A null text is empty and has one token, its end. Repeated rows
    count as often as they stand there and are scored alike. Without training rows all counts are 0 and the untrained
    model scores. Extra columns are not read.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the input
    rows = small_batches(docs).select(F.col(f"`{key}`").cast("long").alias("doc_id"), held_out(F.col(f"`{key}`")).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("text"))
    got = keep(gather(rows, ranks, shape), "lm-gathered", "kind")
    texts = got.where("kind = 2")
    counts = keep(got.where("kind = 0").groupBy("k").agg(F.sum("c").alias("c")).where("c > 0"), "lm-words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    size = Subwords(ranks.value).size
    subs = np.zeros(size, np.int64)
    for k, c in got.where("kind = 1").groupBy("k").agg(F.sum("c")).collect():  # at most one row a subword
        subs[k] = c
    maps = maps_of(subs, shape)
    cls = maps[1]
    class_counts, class_sizes = np.bincount(cls, subs, shape.classes), np.bincount(cls, minlength=shape.classes)
    weights = fit(texts.where("not held_out"), maps, class_counts, shape)
    inner = np.log((subs + 1) / (class_counts + class_sizes)[cls])
    sent = spark.sparkContext.broadcast((weights, maps, inner, *_frequent(counts)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, (of_input, of_class), inner, top_key, top_count = sent.value
        of_input, of_class = of_input.astype(np.int32), of_class.astype(np.int32)
        kind = _kind_of_ids(len(inner))
        model = attention.Scorer(weights)
        for part, ids in chunks(batches, "ids"):
            seq = np.frombuffer(b"".join(ids), kind).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) // kind().itemsize for x in ids])])
            bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(part.column(4).to_pylist(), np.diff(ends).tolist(), strict=True)]
            starts = np.flatnonzero(np.concatenate(bits))
            owner = np.repeat(np.arange(len(ids)), [np.count_nonzero(x) for x in bits])
            words = pa.array(signed(word_keys(seq, starts))).dictionary_encode()
            word, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary.to_numpy().view(np.uint64)
            order = np.argsort(distinct)  # in order, they are found several times as fast
            at = np.empty(len(order), np.int64)
            at[order] = np.minimum(np.searchsorted(top_key, distinct[order]), max(0, len(top_key) - 1))
            count = np.where(top_key[at] == distinct, top_count[at], 0) if len(top_key) else np.zeros(len(distinct), np.int64)
            own = count[word]
            known = np.bincount(owner, own > 0, len(ids)).astype(np.int64)
            base = np.bincount(owner, np.log10(count + 1.0)[word], len(ids))
            rare, times = np.unique((owner[own == 0] << 32) | word[own == 0], return_counts=True)
            offsets = np.searchsorted(rare >> 32, np.arange(len(ids) + 1)).astype(np.int32)
            lm = np.add.reduceat(inner[seq], ends[:-1])
            text, begin, _ = attention.windows(np.diff(ends), shape)
            begin += ends[text]
            inputs, targets = of_input[np.concatenate([[-1], seq[:-1]])], of_class[seq]
            inputs[ends[:-1]] = of_input[-1]
            later = np.diff(text, prepend=-1) == 0  # a text's first window is scored from its start, later ones after the overlap
            for rows, skip in ((np.flatnonzero(~later), 0), (np.flatnonzero(later), shape.overlap)):
                for lo in range(0, len(rows), 256):
                    own = rows[lo : lo + 256]
                    at, last = begin[own, None] + np.arange(shape.window), ends[text[own] + 1, None]
                    real = at < last
                    np.minimum(at, last - 1, out=at)
                    p = model(inputs[at], targets[at], skip)
                    np.add.at(lm, text[own], (p * real[:, skip:]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), part.column(2), pa.array(np.bincount(owner, minlength=len(ids))), pa.array(known), pa.array(base), pa.array(lm / math.log(10)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(distinct)[rare & 0xFFFFFFFF])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int64))),
            ], names=["doc_id", "held_out", "text_hash", "n_tokens", "known", "base", "score", "rare", "times"])

    scored = texts.select("k", "held_out", "h", "ids", "first").mapInArrow(go, "doc_id long, held_out boolean, text_hash long, n_tokens long, known long, base double, score double, rare array<long>, times array<long>")
    scored = keep(scored, "lm-scored")
    forget(got)
    rare = scored.select("doc_id", "text_hash", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("doc_id", "text_hash", F.col("r.rare").alias("k"), F.col("r.times").alias("n"))
    more = rare.join(counts, "k").groupBy("doc_id", "text_hash").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("plus"))
    more = more.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "more", "plus")
    copies = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "text_hash"))  # equal rows have put their words in as often
    whole = alike(scored.drop("rare", "times"))
    whole = whole.withColumn("copies", copies).join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    floor = math.log10((tokens or 0) + distinct + 1)
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce((F.col("more") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"), F.lit(tokens or 0).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("plus") / F.col("copies"), F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score",
    )
