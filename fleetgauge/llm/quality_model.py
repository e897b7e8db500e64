"""Quality by histogram gradient-boosted trees over statistics of the whole text.

Statistics are counted from the bytes of a column at once and written as a table. The trees
are grown on a bounded sample of labelled documents: statistics are cut into bins at quantiles, each
level adds up gradients and second derivatives per node, statistic and bin, and the best cut of
every node is read from the running sums. All trees lie one after the other in flat arrays (statistic,
threshold, left, right, value), which a batch of documents walks together, one step per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.bytewise import LOWER, SPACE_WORD, buffers, gram_hashes, mix, pieces, prefix_hash, range_hash, word_spans
from fleetgauge.session import write_once

#: At most this many labelled documents are learned from, those of the smallest hash of their id.
SAMPLE_ROWS = 40_000
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
#: Added to the second derivatives of a node, and the least of them on either side of a cut.
RIDGE, LEAST_WEIGHT = 1.0, 2.0
#: Documents with at least this score are predicted to be good.
CUT = 0.3

STATISTICS = ("words", "bytes", "characters_per_word", "lower", "upper", "digit", "space", "stop", "comma", "mark", "symbol", "control", "beyond_ascii", "byte_entropy",
              "short_words", "long_words", "capital_words", "upper_words", "letterless_words", "marked_words", "distinct_words", "top_word", "repeated_grams",
              "lines", "words_per_line", "repeated_lines")

_KINDS = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [32, *range(9, 14)], "stop": b".!?", "comma": b",;:'\"-()",
          "symbol": b"#*$%&|<>=_~^@+\\/{}[]`", "control": [*range(0, 9), *range(14, 32), 127], "beyond_ascii": range(128, 256)}
_CLASS = np.zeros((256, len(_KINDS)))
for _k, _bytes in enumerate(_KINDS.values()):
    _CLASS[list(_bytes), _k] = 1
_LINE = np.ones(256, bool)
_LINE[10] = False
_LETTER = (_CLASS[:, 0] + _CLASS[:, 1] + _CLASS[:, 8]) > 0
_MARK = (_CLASS[:, list(_KINDS).index("symbol")] > 0) | np.isin(np.arange(256), list(b"!"))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _per_row(row: np.ndarray, rows: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weight, rows).astype(np.float64)


def _repeats(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of different hashes, and how often its most frequent one stands in it."""
    keyed, order = mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), None
    order = np.argsort(keyed, kind="stable")
    sorted_keys = keyed[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keyed) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(keyed)]]))
    owner = row[order[first]]
    most = np.zeros(rows)
    np.maximum.at(most, owner, size)
    return _per_row(owner, rows), most


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; all 0 for an empty one."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    of_byte = np.repeat(np.arange(rows), lengths)
    counts = np.bincount(of_byte * 256 + data, minlength=rows * 256).reshape(rows, 256).astype(np.float64)
    kinds = _share(counts @ _CLASS, lengths[:, None])
    chance = _share(counts, lengths[:, None])
    entropy = -(chance * np.log2(np.where(chance > 0, chance, 1))).sum(axis=1)

    starts, stops, begin = word_spans(data, offsets, SPACE_WORD)
    n_words = np.diff(begin)
    of_word = np.repeat(np.arange(rows), n_words)
    size = stops - starts
    lowered = LOWER[data]
    sums = prefix_hash(lowered)
    words = range_hash(sums, starts, stops)

    def inside(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[stops] - total[starts]

    letters, capitals, marks = inside(_LETTER), inside(_CLASS[:, 1] > 0), inside(_MARK)
    different, most = _repeats(words, of_word, rows)
    grams, at = gram_hashes(words, begin, 4)
    of_gram = of_word[at]
    other_grams, _ = _repeats(grams, of_gram, rows)
    n_grams = _per_row(of_gram, rows)
    line_from, line_to, line_begin = word_spans(lowered, offsets, _LINE)
    n_lines = np.diff(line_begin)
    other_lines, _ = _repeats(range_hash(sums, line_from, line_to), np.repeat(np.arange(rows), n_lines), rows)
    characters = lengths - counts[:, 128:192].sum(axis=1) - kinds[:, 3] * lengths

    def of_words(which: np.ndarray) -> np.ndarray:
        return _share(_per_row(of_word[which], rows), n_words)

    columns = {
        "words": n_words, "bytes": lengths, "characters_per_word": _share(characters, n_words), "byte_entropy": entropy,
        "short_words": of_words(size <= 3), "long_words": of_words(size >= 13), "capital_words": of_words(_CLASS[data[starts], 1] > 0), "upper_words": of_words((capitals == letters) & (letters > 1)),
        "letterless_words": of_words(letters == 0), "marked_words": of_words(marks > 0), "distinct_words": _share(different, n_words), "top_word": _share(most, n_words),
        "repeated_grams": _share(n_grams - other_grams, n_grams), "lines": n_lines, "words_per_line": _share(n_words, n_lines), "repeated_lines": _share(n_lines - other_lines, n_lines),
        "mark": _share(counts[:, _MARK].sum(axis=1), lengths)}
    columns |= {name: kinds[:, k] for k, name in enumerate(_KINDS)}
    return np.stack([np.asarray(columns[s], np.float64) for s in STATISTICS], axis=1)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `statistics` (an array in the order of STATISTICS) of every document row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in pieces(offsets):
                found = statistics_of(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                listed = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), listed], ["doc_id", "statistics"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(read, "doc_id long, statistics array<double>"))


@dataclass
class Trees:
    """All trees in flat arrays. A leaf points at itself, so every document may take `depth` steps."""

    base: float
    roots: np.ndarray
    depth: int
    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.statistic[at]] <= self.threshold[at], self.left[at], self.right[at])
        return _chance(self.base + self.value[at].sum(axis=1))


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def edges_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Inner borders of at most `bins` bins at quantiles of the values; a value belongs left of its border."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Trees for the log loss, grown level by level from histograms."""
    n, wide = x.shape
    edges = [edges_of(x[:, f], bins) for f in range(wide)]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) + np.arange(wide) * bins
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    flat: dict[str, list] = {k: [] for k in ("statistic", "threshold", "left", "right", "value")}

    def leaf(value: float) -> int:
        here = len(flat["value"])
        for key, entry in (("statistic", 0), ("threshold", 0.0), ("left", here), ("right", here), ("value", value)):
            flat[key].append(entry)
        return here

    z, roots = np.full(n, base), []
    for _ in range(trees):
        p = _chance(z)
        gradient, weight = y - p, p * (1 - p)
        roots.append(leaf(0.0))
        node, open_ = np.zeros(n, np.int64), [roots[-1]]  # place of each row's node in open_, -1 once it is settled
        final = np.zeros(n, np.int64) + roots[-1]
        for level in range(depth + 1):
            live = node >= 0
            slot = (node[live, None] * (wide * bins) + codes[live]).ravel()
            shape = (len(open_), wide, bins)
            g = np.bincount(slot, np.repeat(gradient[live], wide), np.prod(shape)).reshape(shape)
            h = np.bincount(slot, np.repeat(weight[live], wide), np.prod(shape)).reshape(shape)
            total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
            left_g, left_h = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (total_g**2 / (total_h + RIDGE))[:, None, None]
            gain = np.where((left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT), gain, 0.0).reshape(len(open_), -1)
            best = gain.argmax(axis=1)
            children, go = [], np.full(len(open_), -1)
            feature, cut = best // (bins - 1), best % (bins - 1)
            for k, at in enumerate(open_):
                flat["value"][at] = rate * total_g[k] / (total_h[k] + RIDGE)
                if level < depth and gain[k, best[k]] > 1e-6:
                    f, c = int(feature[k]), int(cut[k])
                    go[k] = len(children)
                    flat["statistic"][at], flat["threshold"][at] = f, float(edges[f][c])
                    flat["left"][at], flat["right"][at] = leaf(0.0), leaf(0.0)
                    children += [flat["left"][at], flat["right"][at]]
            if not children:
                break
            splits = live & (go[np.maximum(node, 0)] >= 0)
            k = node[splits]
            right = codes[splits, feature[k]] - feature[k] * bins > cut[k]
            node = np.full(n, -1)
            node[splits] = go[k] + right
            open_ = children
            final[splits] = np.array(children)[node[splits]]
        z += np.array(flat["value"])[final]
    return Trees(base, np.array(roots), depth, *(np.array(flat[k]) for k in ("statistic", "threshold", "left", "right", "value")))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a document is kept from training: remainder of the CRC of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def learn(counted: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", most: int = SAMPLE_ROWS) -> Trees | None:
    """Trees from at most `most` labelled rows of `statistics`; None if nothing is labelled.

    Only labels 0 and 1 count, and only of documents that are not held out. Equal rows of one
    id count once. The sample is the rows of the smallest hashes, and all that comes to the driver.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("_id"), F.expr(f"try_cast(`{label}` AS INT)").alias("label"))
    known = known.filter(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    pairs = counted.filter(F.col("doc_id").isNotNull()).distinct().join(known, F.col("doc_id") == F.col("_id"))
    rows = write_once(pairs.select("doc_id", "label", "statistics", F.xxhash64("doc_id", F.lit(13)).alias("o")), "labelled")
    have = rows.count()
    if have > 2 * most:
        # about 1.5 times the sample goes on to the sort, whatever the table's size
        rows = rows.filter(F.pmod("o", F.lit(1 << 40)) < int(1.5 * most / have * (1 << 40)))
    order = F.pmod("o", F.lit(1 << 40))
    found = rows.orderBy(order, "doc_id", "label", "statistics").limit(most).select("label", "statistics").toArrow() if have else None
    if not have:
        return None
    x = found.column("statistics").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    return train(x, found.column("label").to_numpy().astype(np.float64))


def rate_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """Per document row: doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted
    (1 from `cut` on).

    A null or empty text has statistics of 0 and is scored like any other. Without a usable label all scores are
    0.5. A document without an id is neither held out nor learned from. Of a document only its text is looked
    at. Repeated rows are scored each; other columns are not read. An empty table gives no rows.
    """
    counted = write_once(statistics(docs, doc_id, text), "statistics")
    model = learn(counted, labels, doc_id, label, most)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            parts = [model.score(x[lo:lo + 4096]) for lo in range(0, len(x), 4096)] if model else [np.full(len(x), 0.5)]
            score = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return (counted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "statistics")
            .mapInArrow(read, "doc_id long, held_out boolean, score double, predicted int"))
