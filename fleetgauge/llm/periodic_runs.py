"""Periodic runs of words by online dyadic square catching.

Words are appended to a text. Whenever a block of 2^k words at a multiple of 2^k is complete, a
catcher is set up on it: it looks for squares whose period p lies in [2^k, 2^(k+1)), by comparing
the 2^(k+1) words from the block's start with the same number of words p later, for every p
that further appended words complete. A hit is a square. Squares of neighbouring blocks with
the same period overlap and merge into one run, whose two ends are then compared word by
word. A catcher lives until 2^(k+2) words are there, so a level has at most four at a time
and does one comparison per appended word and catcher: n log n in all.

Why nothing is missed: a run of at least four periods p, with 2^k <= p < 2^(k+1), holds a block of its
level that starts within its first 2^k words, together with the whole comparison. As the compared words
are longer than p, the smallest p that a block finds is the run's own period, or the block
lies in a run of a smaller period, which a lower level has found; such hits are dropped.

The comparisons of one level over all the words appended at a time are array operations: windows are
named by 64-bit hashes, built from those of half their length, and a hit is confirmed on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.bytewise import buffers, mix, pieces

#: Shortest run, in words and in periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Comparisons made at once.
CELLS = 1 << 20

SPACE = r"[\x20\x09-\x0D]"
RUNS = "array<struct<start:long,length:long,period:long>>"


class Catchers:
    """Squares and runs of a growing sequence of whole numbers (words by number)."""

    def __init__(self) -> None:
        self._words = np.zeros(0, np.int64)
        self._hashes: list[np.ndarray] = []
        self._from: list[int] = []  # position of the first hash kept, per level
        self._next: list[int] = []  # start of the first block without a verdict, per level
        self._caught: list[list[np.ndarray]] = []

    def append(self, words: np.ndarray) -> np.ndarray:
        """New squares as rows (start, period): a block's start and the smallest period it repeats with."""
        words = np.asarray(words, np.int64)
        self._words = np.concatenate([self._words, words])
        self._advance(mix((words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        return self._catch(finished=False)

    def _advance(self, new: np.ndarray) -> None:
        """Hashes of all windows of 2^k words that the new words complete."""
        level, size = 0, len(self._words)
        while True:
            if level == len(self._hashes):
                self._hashes.append(np.zeros(0, np.uint64))
                self._from.append(0)
                self._next.append(0)
                self._caught.append([])
            kept = self._hashes[level] = np.concatenate([self._hashes[level], new])
            width = 1 << level
            if size < 2 * width:
                return
            # windows of twice the width are complete up to size - 2 * width
            done = self._from[level + 1] + len(self._hashes[level + 1]) if level + 1 < len(self._hashes) else 0
            left = kept[done - self._from[level]: size - 2 * width + 1 - self._from[level]]
            right = kept[done + width - self._from[level]: size - width + 1 - self._from[level]]
            new = mix(left * np.uint64(0xD1B54A32D192ED03) + right)
            level += 1

    def _catch(self, finished: bool) -> np.ndarray:
        """Verdicts of the blocks whose catchers have seen all they need, or of all if `finished`."""
        size, found = len(self._words), []
        for level in range(len(self._hashes) - 1):
            width, names, base = 1 << level, self._hashes[level + 1], self._from[level + 1]
            last = size - 3 * width if finished else size - 4 * width + 1
            blocks = np.arange(self._next[level], last + 1, width)
            for lo in range(0, len(blocks), max(CELLS >> level, 1)):
                some = blocks[lo:lo + max(CELLS >> level, 1)]
                there = np.lib.stride_tricks.sliding_window_view(
                    np.concatenate([names[some[0] + width - base:some[-1] + 2 * width - base], np.zeros(max(some[-1] + 2 * width - base - len(names), 0), np.uint64)]), width)[::width]
                hit = there == names[some - base][:, None]
                # windows that the text does not complete do not count
                hit &= (some[:, None] + width + np.arange(width)) <= size - 2 * width
                caught = hit.any(axis=1)
                squares = np.stack([some[caught], width + hit[caught].argmax(axis=1)], axis=1)
                if len(squares):
                    found.append(squares)
                    if not finished:
                        self._caught[level].append(squares)
            if len(blocks) and not finished:
                self._next[level] = int(blocks[-1]) + width
                # names before the next block are not needed at this level; the level above may still pair them
                self._trim(level + 1)
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def _trim(self, level: int) -> None:
        keep = min(self._next[level - 1], self._from[level + 1] + len(self._hashes[level + 1]) if level + 1 < len(self._hashes) else 0)
        if keep - self._from[level] > len(self._hashes[level]) // 2:
            self._hashes[level] = self._hashes[level][keep - self._from[level]:].copy()
            self._from[level] = keep

    def runs(self) -> np.ndarray:
        """All runs of at least MIN_WORDS words and MIN_PERIODS periods so far, as rows (start, end, period)
        by start, then period."""
        late = self._catch(finished=True)
        runs = np.zeros((0, 3), np.int64)
        for level, caught in enumerate(self._caught):
            squares = np.concatenate([*caught, np.zeros((0, 2), np.int64)])
            width = 1 << level
            if len(late):
                squares = np.unique(np.concatenate([squares, late[(late[:, 1] >= width) & (late[:, 1] < 2 * width)]]), axis=0)
            if not len(squares):
                continue
            new = np.ones(len(squares), bool)
            new[1:] = (np.diff(squares[:, 0]) != width) | (np.diff(squares[:, 1]) != 0)
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(squares)]]) - 1
            period = squares[first, 1]
            start, end = self._ends(squares[first, 0], squares[last, 0] + period + 2 * width, period, width)
            long = end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
            start, end, period = start[long], end[long], period[long]
            # confirmed on the words, not only on their hashes
            true = np.array([np.array_equal(self._words[s:e - p], self._words[s + p:e]) for s, e, p in zip(start, end, period, strict=True)], bool)
            start, end, period = start[true], end[true], period[true]
            if len(runs) and len(start):
                # what lies in a run of a smaller period repeats only because that one does
                furthest = np.maximum.accumulate(runs[:, 1])
                before = np.searchsorted(runs[:, 0], start, "right") - 1
                inside = (before >= 0) & (furthest[np.maximum(before, 0)] >= end)
                start, end, period = start[~inside], end[~inside], period[~inside]
            runs = np.concatenate([runs, np.stack([start, end, period], axis=1)])
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        return runs

    def _ends(self, start: np.ndarray, end: np.ndarray, period: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Both ends moved out while words a period apart are equal; less than a block on each side,
        as the neighbouring block has no such square."""
        start, end, size = start.copy(), end.copy(), len(self._words)
        step = np.arange(width)
        for lo in range(0, len(start), max(CELLS >> max(width.bit_length() - 1, 0), 1)):
            part = slice(lo, lo + max(CELLS >> max(width.bit_length() - 1, 0), 1))
            s, e, p = start[part], end[part], period[part]
            at = s[:, None] - 1 - step
            same = (at >= 0) & (self._words[np.maximum(at, 0)] == self._words[np.minimum(at + p[:, None], size - 1)])
            start[part] = s - np.minimum.accumulate(same, axis=1).sum(axis=1)
            at = e[:, None] + step
            same = (at < size) & (self._words[np.minimum(at, size - 1)] == self._words[np.maximum(np.minimum(at, size - 1) - p[:, None], 0)])
            end[part] = e + np.minimum.accumulate(same, axis=1).sum(axis=1)
        return start, end


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs (start, end, period) of each list of words. The texts are one sequence, parted by words
    that occur once and therefore end every run."""
    numbers: dict[bytes, int] = {}
    flat, begins = [], []
    for k, words in enumerate(texts):
        begins.append(len(flat))
        flat += [numbers.setdefault(w, len(numbers)) for w in words]
        flat.append(-1 - k)
    catchers = Catchers()
    catchers.append(np.array(flat, np.int64))
    found = catchers.runs()
    cut = np.searchsorted(found[:, 0], begins)
    return [found[a:b] - [begin, begin, 0] for begin, a, b in zip(begins, cut, [*cut[1:], len(found)], strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words joined by one space, without those that repeat what a run's first period says."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, runs (start, length, period in words, by start, then
    period) and collapsed, the text with every run cut to its first period and one space between words.

    A null, empty or blank text has no words, no runs and an empty collapsed text. A null id stays null.
    Repeated rows are searched each; other columns are not read. An empty table gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in pieces(offsets):
                # bytes.split() cuts at runs of the six ASCII white-space characters
                texts = [data[a:b].tobytes().split() for a, b in zip(offsets[lo:hi], offsets[lo + 1:hi + 1], strict=True)]
                found = runs_of(texts)
                flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
                entries = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], ["start", "length", "period"])
                at = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), entries),
                    pa.array([collapsed(t, f) for t, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(read, f"doc_id long, n_words long, runs {RUNS}, collapsed string"))


def with_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text; where the CRC h of the id is a multiple of ten, words from number g % n on
    (g = floor(h / 10), n words) repeat with a period of 1 + floor((n - g % n) / (3 + g % 8))."""
    h = F.crc32(F.col(doc_id).cast("long").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col("_text"), SPACE + "+"), lambda w: w != "")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"), h.alias("_h"), g.alias("_g"))

    def repeated(w: Column) -> Column:
        a = F.when(F.size(w) > 0, F.col("_g") % F.size(w)).otherwise(0)
        p = F.floor((F.size(w) - a) / (3 + F.col("_g") % 8)) + 1
        spelled = F.transform(F.array(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p"))), lambda x: F.transform(
            w, lambda own, i: F.when(i < x["a"], own).otherwise(F.get(w, x["a"] + (i - x["a"]) % x["p"]))))
        return F.array_join(F.element_at(spelled, 1), " ")

    tail = F.element_at(F.transform(F.array(words), repeated), 1)
    return rows.select("doc_id", F.when(F.col("_h") % 10 == 0, tail).otherwise(F.col("_text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Per document: n_runs, the run of greatest exponent (start, length, period, exponent_milli; of
    equal ones the first, then that of the smaller period), runs_sha256 and collapsed_sha256."""
    runs = F.col("runs")
    # length / period as a fraction: more than the best so far, compared across
    best = F.aggregate(runs, F.get(runs, 0), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("_b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "_b.start", "_b.length", "_b.period", F.expr("(1000 * _b.length) div _b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
