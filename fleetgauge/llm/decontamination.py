"""Benchmark passages inside training documents, found by backward search in FM-indexes.

Each task turns its rows into shards of a few megabytes, indexes the words of each shard and
searches all benchmark windows in the index at once. Words that no benchmark item has, and
word pairs that stand in no item, cut a shard into runs before it is indexed: no window can
reach across them. Occurrences are located by sampled suffix positions and merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.bytewise import ALNUM_WORD, buffers, pieces, word_hashes
from fleetgauge.llm.fm_index import FMIndex

WINDOW = 13
#: Bytes of benchmark word hashes in one broadcast; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20

_FOUND = "_key long, _hash long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def _item_words(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Each item as one binary of 8-byte word hashes; items without a word are left out."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            hashes, rows = word_hashes(data, offsets, ALNUM_WORD)
            raw = [hashes[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["_item", "_words"])

    return (benchmark.select(F.col(item).cast("string").alias("_item"), F.col(text).cast("string").alias("_text"))
            .filter("_item is not null").mapInArrow(words, "_item string, _words binary").filter("length(_words) > 0"))


class Windows:
    """All distinct windows of a set of items, coded by rank of word, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        words = [np.frombuffer(raw, np.uint64) for _, raw in items]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        base = len(self.vocabulary) + 1
        rows, owners, pairs = [], [], []
        for (name, _), hashes in zip(items, words, strict=True):
            codes = np.searchsorted(self.vocabulary, hashes) + 1
            pairs.append(codes[:-1] * base + codes[1:])
            n = min(window, len(codes))
            grams = np.zeros((len(codes) - n + 1, window), np.int64)
            grams[:, window - n:] = np.lib.stride_tricks.sliding_window_view(codes, n)
            rows.append(grams)
            owners.append(np.full(len(grams), number[name]))
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        grams = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
        self.windows, which = np.unique(grams, axis=0, return_inverse=True)
        self.lengths = (self.windows > 0).sum(axis=1)
        both = np.unique(np.stack([which.reshape(-1), np.concatenate(owners) if owners else np.zeros(0, np.int64)]), axis=1)
        self.owner_of, self.owners = np.searchsorted(both[0], np.arange(len(self.windows) + 1)), both[1]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def find(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, window number and length of every occurrence in the words of a shard."""
        none = np.zeros(0, np.int64)
        if not len(hashes) or not len(self.windows):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        codes = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        known = codes > 0
        joined = np.zeros(len(codes), bool)  # to the word before it
        row_start = np.zeros(len(codes) + 1, bool)
        row_start[rows] = True
        maybe = np.flatnonzero(known[1:] & known[:-1] & ~row_start[1:-1]) + 1
        if len(maybe) and len(self.pairs):
            pair = codes[maybe - 1] * (len(self.vocabulary) + 1) + codes[maybe]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[maybe[self.pairs[place] == pair]] = True
        heads = np.flatnonzero(known & ~joined)
        if not len(heads):
            return none, none, none
        tail = np.concatenate([~joined[1:], [True]]) & known
        size = np.flatnonzero(tail) + 1 - heads
        keep = size >= self.shortest
        heads, size = heads[keep], size[keep]
        if not len(heads):
            return none, none, none
        # the runs, each followed by a separator
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        text, origin = np.zeros(begin[-1], np.int64), np.full(begin[-1], -1, np.int64)
        inside = np.ones(begin[-1], bool)
        inside[begin[1:] - 1] = False
        origin[inside] = np.repeat(heads - (begin[:-1] - np.arange(len(heads))), size) + np.arange(int(size.sum()))
        text[inside] = codes[origin[inside]]
        index = FMIndex(text, len(self.vocabulary))
        lo, hi = index.search(self.windows, self.lengths)
        count = np.where(self.lengths > 0, hi - lo, 0)
        which = np.repeat(np.arange(len(count)), count)
        if not len(which):
            return none, none, none
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(which))
        return origin[index.locate(first)], which, self.lengths[which]


def _search(docs: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    """One pass over (_key, _hash, _text): spans of hit words and the items, per row."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Windows(sent.value, window)
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for lo, hi in pieces(offsets, SHARD_BYTES):
                part = offsets[lo:hi + 1]
                hashes, rows = [], [np.zeros(1, np.int64)]
                for a, b in pieces(part):  # words are hashed in smaller steps
                    h, r = word_hashes(data[part[a]:part[b]], part[a:b + 1] - part[a], ALNUM_WORD)
                    hashes.append(h)
                    rows.append(r[1:] + rows[-1][-1])
                hashes, rows = np.concatenate(hashes), np.concatenate(rows)
                first, which, length = benchmark.find(hashes, rows)
                spans, names = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                if len(first):
                    change = np.zeros(len(hashes) + 1, np.int64)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + length, -1)
                    hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
                    edge = np.flatnonzero(hit[1:] != hit[:-1])
                    # runs that meet at the border of two rows are two spans
                    starts, stops = edge[::2], edge[1::2]
                    doc = np.searchsorted(rows, first, "right") - 1
                    for s, e in zip(starts, stops, strict=True):
                        d = int(np.searchsorted(rows, s, "right")) - 1
                        while s < e:
                            cut = min(e, rows[d + 1])
                            if cut > s:
                                spans[d].append({"start": int(s - rows[d]), "stop": int(cut - rows[d])})
                            s, d = cut, d + 1
                    for d, w in np.unique(np.stack([doc, which]), axis=1).T:
                        names[d].extend(benchmark.owners[benchmark.owner_of[w]:benchmark.owner_of[w + 1]].tolist())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(rows)),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array([[benchmark.names[i] for i in sorted(set(x))] for x in names], pa.list_(pa.string()))],
                    ["_key", "_hash", "n_words", "spans", "items"])

    return docs.mapInArrow(search, _FOUND)


def find_passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, `spans` of hit words [start, stop) and the `items` found.

    A window is `window` consecutive words of an item, or all words of a shorter one. A null or
    empty text has no words; a null item id is left out; repeated rows are kept; an empty
    benchmark hits nothing. Other columns are not read. The benchmark is counted first and
    searched in blocks of about `block_bytes` of word hashes, one pass over the documents each.
    """
    words = _item_words(benchmark, item, item_text)
    total = words.agg(F.sum(F.length("_words"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    rows = docs.select(F.col(doc_id).cast("long").alias("_key"), F.xxhash64(F.col(text).cast("string")).alias("_hash"),
                       F.col(text).cast("string").alias("_text"))
    passes = []
    for block in range(blocks):
        mine = words if blocks == 1 else words.filter(F.pmod(F.xxhash64("_item", "_words"), F.lit(blocks)) == block)
        passes.append(_search(rows, [(r[0], bytes(r[1])) for r in mine.toLocalIterator()], window))
    if blocks == 1:
        return passes[0].select(F.col("_key").alias("doc_id"), "n_words", "spans", "items")
    # the same row comes back once from each pass; equal rows are counted and given out again
    every = passes[0]
    for more in passes[1:]:
        every = every.unionAll(more)
    merged = every.groupBy("_key", "_hash").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.count("*") / blocks).cast("int").alias("_n"))
    start = F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("stop"))
    spans = F.aggregate(F.array_sort("_spans"), F.array(start), lambda done, x: F.when(
        x["start"] <= F.element_at(done, -1)["stop"], F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(
                F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(done, F.array(x))))
    return (merged.withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_n"))))
            .select(F.col("_key").alias("doc_id"), "n_words", F.filter(spans, lambda x: x["stop"] > 0).alias("spans"), "items"))


def contamination(found: DataFrame) -> DataFrame:
    """Digest of `find_passages`: hit words, items, and the rule that 5 % of all words are hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without those the contamination rule names. Rows are told apart by doc_id; a
    document of several rows goes if one of them is contaminated, one without an id stays."""
    bad = contamination(find_passages(docs, benchmark, window=window)).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
