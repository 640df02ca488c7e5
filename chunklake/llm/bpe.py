"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct units of a group of texts are laid out as one array of symbols with links to their
neighbours. An index maps each mergeable pair (by its rank) to all its positions; the lowest active
rank is applied to all of them at once, and only the lists of the pairs that this makes are touched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, values

#: The published pre-tokenizer's pattern, with white space spelt out as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Text that is encoded at once; a longer single text is a group of its own.
GROUP_BYTES = 8 << 20
#: Units that a worker remembers before it starts anew.
CACHE_UNITS = 300_000
#: A space beside other white space or an end of the text: such texts are split by the full pattern only.
_ODD_SPACE = re.compile(r" (?=\s|\Z)|(?<=[\s\x1c-\x1f]) |\A ")


def _byte_letters() -> list[str]:
    """The printable letter of each byte in the vocabulary file: printable Latin-1 stands for itself, the rest for 256, 257, ..."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out, extra = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in own else chr(256 + extra)
        extra += b not in own
    return out


class PairIndexBPE:
    """A byte-level BPE vocabulary from the bytes of its JSON file."""

    def __init__(self, blob: bytes):
        data = json.loads(blob)
        vocab = data["model"]["vocab"]
        letters = _byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(of_letter[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.names = [str(i) for i in range(size)]
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = (left << 32) | right
        self._order = np.argsort(key)
        self._keys = key[self._order]
        # A merge whose product starts or ends a pair of lower rank is applied to one position of a unit at a time.
        lowest = np.full(size, len(pairs), np.int64)
        np.minimum.at(lowest, left, np.arange(len(pairs)))
        np.minimum.at(lowest, right, np.arange(len(pairs)))
        self._one_by_one = lowest[self.made] < np.arange(len(pairs))
        self._pattern = regex.compile(PATTERN)
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and the offsets of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        n = int(ends[-1])
        if not n:
            return np.zeros(0, np.int64), ends
        sym = np.append(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], -1)
        word = np.repeat(np.arange(len(words)), sizes)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        full = sizes > 0
        nxt[ends[1:][full] - 1] = n  # position n is the end of every word
        prv[ends[:-1][full]] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enters the pairs that start at these positions."""
            rank = self._ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        at = np.arange(n)
        add(at[nxt[:n] < n])
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b, c = self.left[r], self.right[r], self.made[r]
            at = np.unique(np.concatenate(lists))
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if not len(at):
                continue
            if a == b:  # in a run, every other position from its start
                starts = np.concatenate([[True], nxt[at[:-1]] != at[1:]])
                run = np.cumsum(starts) - 1
                place = np.arange(len(at)) - np.flatnonzero(starts)[run]
                at = at[place % 2 == 0]
            if self._one_by_one[r]:
                first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(active, r)
                at = at[first]
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = c, -2
            nxt[at] = after
            inner = after < n
            prv[after[inner]] = at[inner]
            before = prv[at]
            add(np.concatenate([at[inner], before[(before >= 0) & (before < n)]]))
        alive = sym[:n] >= 0
        return sym[:n][alive], np.concatenate([[0], np.cumsum(alive)])[ends]

    def units(self, text: str) -> list[str]:
        """Parts of a text, end to end the text itself, that are encoded apart from each other."""
        out: list[str] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                out.append(part)
            elif part and _ODD_SPACE.search(part) is None:
                first, *rest = part.split(" ")
                out.append(first)
                out += map(" ".__add__, rest)
            elif part:
                out += self._pattern.findall(part)
        return out

    def words(self, unit: str) -> list[bytes]:
        return [w.encode() for w in self._pattern.findall(unit)]


class Units(dict):
    """Numbers of units; new ones wait to be merged together."""

    def __init__(self, bpe: PairIndexBPE):
        self.bpe, self.new = bpe, []
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.named, self.bytes = [], []
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n

    def numbers(self, texts: list[bytes]) -> list[list[int]]:
        """For each text, the numbers of its units; named and bytes then hold what each number stands for, and flat, from start on, its ids."""
        if len(self) > CACHE_UNITS:
            self._forget()
        out = [list(map(self.__getitem__, self.bpe.units(t.decode("utf-8", "replace")))) for t in texts]
        words, owner = [], []
        for u in self.new:
            own = [] if u in self.bpe.special else self.bpe.words(u)
            words += own
            owner.append(len(words))
        flat, ends = self.bpe.merge(words)
        cuts, flat, all_ids = ends[np.array([0, *owner], np.int64)], flat.tolist(), []
        for u, lo, hi in zip(self.new, cuts.tolist(), cuts[1:].tolist(), strict=False):
            ids = [self.bpe.special[u]] if u in self.bpe.special else flat[lo:hi]
            all_ids.append(ids)
            self.named.append(",".join(map(self.bpe.names.__getitem__, ids)))
            self.bytes.append(b"".join(map(self.bpe.pieces.__getitem__, ids)))
        self.flat = np.concatenate([self.flat, np.array([i for ids in all_ids for i in ids], np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(i) for i in all_ids], dtype=np.int64)])
        self.new = []
        return out


    def ids_of(self, texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's begin."""
        own = np.fromiter((n for t in texts for n in t), np.int64)
        size = self.start[own + 1] - self.start[own]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[own] - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])]


_loaded: dict[bytes, PairIndexBPE] = {}


def _load(blob: bytes) -> PairIndexBPE:
    key = hashlib.sha256(blob).digest()
    if key not in _loaded:
        _loaded[key] = PairIndexBPE(blob)
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver and broadcast: its size doesn't depend on the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = values(batch.column(batch.schema.get_field_index(column)))
        group = np.cumsum([len(t) for t in texts]) // GROUP_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield batch.slice(lo, hi - lo), texts[lo:hi]
        give_back()


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array<int>) of every row: the whole text, special tokens in it included.

    A null or empty text has no ids. Repeated rows are encoded each by itself. Extra columns are not read.
    """
    blob = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(_load(blob.value))
        for part, texts in _groups(batches, "text"):
            ids, ends = units.ids_of(units.numbers(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    rows = small_batches(docs).select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of every row of ids. Null ids give the empty text; an unknown id gives nothing; bytes that aren't UTF-8 give U+FFFD."""
    blob = vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(blob.value).pieces
        for part in batches:
            texts = [b"".join(pieces[i] for i in own or [] if i is not None and 0 <= i < len(pieces)).decode("utf-8", "replace") for own in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {encoded.schema[key].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, and digests of the ids and of the text decoded from them; rows as in encode()."""
    blob = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(_load(blob.value))
        for part, texts in _groups(batches, "text"):
            n, ids, back = [], [], []
            for own in units.numbers(texts):
                own_ids = np.array(own, np.int64)
                n.append(int((units.start[own_ids + 1] - units.start[own_ids]).sum()))
                ids.append(hashlib.sha256(",".join([units.named[u] for u in own]).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([units.bytes[u] for u in own]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = small_batches(docs).select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
