"""Quality rules as a short-circuit cascade.

Each rule rejects documents by a few integer measures of the text. On a bounded sample, each rule's
cost (time of the measures that it needs) and selectivity (share of rows rejected) are estimated;
rules then run in descending order of rejections per unit of cost, each on the rows that are left, whose measures
so far are kept. A document is kept if no rule rejects it, so the order changes the work and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, coded, inside, plain, sequence_hash, small_batches, word_hashes

#: Characters that count as symbols, fixed by the contract.
SYMBOLS = b"#*$%&|<>"
#: Words of the window whose repetition counts.
REPEAT_WINDOW = 8
#: Rows of the sample that orders the rules, and the longest text in it: the sample is the bound of what reaches the driver. It orders the work and decides nothing.
SAMPLE_ROWS, SAMPLE_BYTES = 512, 1 << 16

_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 1
_KIND[list(SYMBOLS)] = 2
_KIND[0x80:0xC0] = 4  # continuation bytes: not the first of a code point
_KIND[ord("A") : ord("Z") + 1] = 8
_KIND[ord("a") : ord("z") + 1] = 16


#: Measures with one number a text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHERS = ("n_upper", "n_lower", "n_same_next", "n_lines")


class Measures:
    """Measures of some texts, each worked out when first asked for."""

    def __init__(self, texts: list[bytes], column: pa.Array | None = None):
        self.texts, self._column, self._known = texts, column, {}

    def take(self, rows: np.ndarray) -> Measures:
        """The same of some of the texts; what is known of them stays known."""
        out = Measures([self.texts[i] for i in rows])
        out._known = {k: v[rows] for k, v in self._known.items() if k in COUNTS + OTHERS}
        if "ends" in self._known:
            ends = self._known["ends"]
            n = np.diff(ends)[rows]
            out._known |= {"words": self._known["words"], "ends": np.concatenate([[0], np.cumsum(n)])}
            at = np.repeat(ends[:-1][rows] - out._known["ends"][:-1], n) + np.arange(n.sum())
            out._known |= {k: self._known[k][at] for k in ("codes", "hashes") if k in self._known}
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            getattr(self, f"_{name}")()
        return self._known[name]

    def _per_text(self, kinds: dict[str, Callable[[np.ndarray], np.ndarray]]) -> None:
        """Bytes of a kind in each text."""
        kind = _KIND[np.frombuffer(b"".join(self.texts), np.uint8)]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        for name, test in kinds.items():
            c = np.concatenate([[0], np.cumsum(test(kind))])
            self._known[name] = c[ends[1:]] - c[ends[:-1]]

    def _word_chars(self) -> None:
        self._per_text({"word_chars": lambda kind: (kind & 5) == 0, "n_symbols": lambda kind: kind == 2})

    _n_symbols = _word_chars

    def _n_upper(self) -> None:
        self._per_text({"n_upper": lambda kind: kind == 8, "n_lower": lambda kind: kind == 16})

    _n_lower = _n_upper

    def _ends(self) -> None:
        _ = self["n_words"]

    def _split(self) -> None:
        words, codes, ends = coded(pa.array(self.texts, pa.large_binary()) if self._column is None else self._column)
        self._known |= {"words": words, "codes": codes, "ends": ends, "n_words": np.diff(ends)}

    _n_words = _split

    def _hashes(self) -> None:
        _ = self["n_words"]
        self._known["hashes"] = word_hashes(self._known["words"])[self._known["codes"]]

    def _n_same_next(self) -> None:
        h, ends = self["hashes"], self["ends"]
        same = np.zeros(len(h) + 1, np.int64)
        same[1:-1] = h[1:] == h[:-1]
        same[ends[:-1]] = 0  # a text's first word follows none
        c = np.concatenate([[0], np.cumsum(same)])
        self._known["n_same_next"] = c[ends[1:]] - c[ends[:-1]]

    def _n_dup_lines(self) -> None:
        lines, dup = np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), np.int64)
        for i, t in enumerate(self.texts):
            own = [x for x in t.split(b"\n") if x.strip()]
            lines[i], dup[i] = len(own), len(own) - len(set(own))
        self._known |= {"n_lines": lines, "n_dup_lines": dup}

    _n_lines = _n_dup_lines

    def _n_repeat_words(self) -> None:
        own, ends = self["hashes"], self["ends"]
        covered = np.zeros(len(own) + 1, np.int64)
        h = sequence_hash(own, REPEAT_WINDOW)
        starts = np.flatnonzero(inside(ends, REPEAT_WINDOW))
        if len(starts):
            doc = np.searchsorted(ends, starts, side="right").astype(np.uint64)
            with np.errstate(over="ignore"):
                key = h[starts] + doc * np.uint64(0x9E3779B97F4A7C15)
            order = np.sort(key)
            twice = order[1:][order[1:] == order[:-1]]
            if len(twice):
                at = np.searchsorted(twice, key)
                hit = starts[(at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == key)]
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + REPEAT_WINDOW, -1)
        c = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
        self._known["n_repeat_words"] = c[ends[1:]] - c[ends[:-1]]


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Measures], np.ndarray]


#: The contract's two rules.
BASE = [
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
]
#: The method's own rules; thresholds are percentages in integers.
EXTRA = [
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 100 * m["n_symbols"] > 25 * m["n_words"]),
    Rule("same_lines", ("n_dup_lines", "n_lines"), lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("shouting", ("n_upper", "n_lower"), lambda m: 100 * m["n_upper"] > 50 * (m["n_upper"] + m["n_lower"])),
    Rule("same_words", ("n_words", "n_same_next"), lambda m: 100 * m["n_same_next"] > 30 * m["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
]
RULES = BASE + EXTRA


def estimate(docs: DataFrame, rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, int]]:
    """(rule, seconds, rows rejected) on at most `rows` texts of up to SAMPLE_BYTES. The first partitions that hold them are read, not all; only these texts reach the driver."""
    text = F.col("`text`").cast("binary")
    texts = [bytes(r[0] or b"") for r in docs.select(text).where(F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_BYTES).take(rows)]
    out = []
    for r in rules if texts else []:
        began = time.perf_counter()
        lost = int(np.sum(r.rejects(Measures(texts))))
        out.append((r.name, time.perf_counter() - began, lost))
    return out


def ordered(docs: DataFrame, rules: list[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on the sample, best first; without a sample, as given."""
    gain = {name: (lost + 1e-3) / max(s, 1e-9) for name, s, lost in estimate(docs, rules, rows)}
    return sorted(rules, key=lambda r: -gain.get(r.name, 0))


def cascade(m: Measures, rules: list[Rule]) -> tuple[np.ndarray, list[str | None]]:
    """kept, and the first rule that rejected each text: every rule sees only what the ones before left."""
    left, by = np.arange(len(m.texts)), [None] * len(m.texts)
    for r in rules:
        if not len(left):
            break
        bad = r.rejects(m)
        if bad.any():
            for i in left[bad]:
                by[i] = r.name
            left, m = left[~bad], m.take(np.flatnonzero(~bad))
    kept = np.zeros(len(by), bool)
    kept[left] = True
    return kept, by


def verdicts(texts: list[bytes], rules: list[Rule]) -> tuple[np.ndarray, list[str | None]]:
    return cascade(Measures(texts), rules)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """One row per row of docs: key, the five counts, base_failed and kept.

    A null text has no words (and so fails the base); counts are over the whole text. Repeated rows are
    judged each by itself. Extra columns are not read.
    """
    rules = ordered(docs.select(F.col(f"`{text}`").alias("text")), rules)
    rows = small_batches(docs).select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            m = Measures(texts, part.column(1))
            counts = [pa.array(m[c], pa.int64()) for c in COUNTS]  # part of the result for every row; all other measures are made of the rows left
            failed = BASE[0].rejects(m) | BASE[1].rejects(m)
            kept, _ = cascade(m, rules)
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(failed), pa.array(kept & ~failed)], names=["doc_id", *COUNTS, "base_failed", "kept"])

    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects; later rules see only what earlier ones kept."""
    rules = ordered(plain(docs, text).withColumnRenamed(text, "text"), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, text):
            kept, _ = cascade(Measures(texts), rules)
            yield part.filter(pa.array(kept))

    return small_batches(docs).mapInArrow(run, docs.schema)
