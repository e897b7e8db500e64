"""Byte strings of a given length that stand in the corpus more than once, and their removal.

A sparse, distributed form of the enhanced suffix array. Of all suffixes only those at anchors
are kept: every window of `length` bytes is owned by the smallest of its k-mer hashes (leftmost
if equal), so equal windows have the same anchor at the same place, wherever they stand. Suffixes
with the same k-mer are a bucket; buckets spread over the cluster by hash.

Within a bucket the suffixes are sorted, and their common-prefix intervals are scanned with a
stack. Every interval keeps its suffixes ordered by what stands to their left; where two
intervals meet, the neighbours in that order give the longest left extension, which ends where
the characters differ. Prefix and extension together are a maximal repeat.

Before that, suffixes with the same surroundings are counted as one (exact copies, the inner
part of shared passages), so a bucket holds different surroundings only. A bucket with very many
of these is settled by counting its windows instead, over the whole cluster.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.bytewise import buffers, pieces, position, prefix_hash, range_hash, ranked, sliding_min
from fleetgauge.session import write_once

LENGTH = 400
KMER = 64
#: Different surroundings of one k-mer that are sorted in one task.
CROWD = 10_000
CHUNK_BYTES = 8 << 20
#: Window starts looked at together.
STRETCH = 1 << 20


def window_owners(data: np.ndarray, offsets: np.ndarray, length: int, kmer: int) -> dict[str, np.ndarray]:
    """Anchors of all windows of some rows: row, at (in the row), left and right reach of the
    windows that the anchor owns, key (hash of its k-mer), around (hash of the whole reach)."""
    parts = []
    lengths = np.diff(offsets)
    width = length - kmer + 1
    for begin in range(0, max(len(data) - length + 1, 0), STRETCH):
        part = data[begin:begin + STRETCH + length - 1]
        sums = prefix_hash(part)
        n = len(part) - kmer + 1
        hashes = range_hash(sums, np.arange(n), np.arange(n) + kmer)
        owner = position(sliding_min(ranked(hashes), width))
        n_windows = len(owner)
        start = np.arange(n_windows)
        row = np.searchsorted(offsets, start + begin, "right") - 1
        good = start + begin + length <= offsets[row + 1]
        start, owner, row = start[good], owner[good], row[good]
        if not len(start):
            continue
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(start)]]) - 1
        a, b, p, row = start[first], start[last], owner[first], row[first]
        parts.append({"row": row, "at": p + begin - offsets[row], "left": p - a, "right": b + length - p,
                      "key": hashes[p].view(np.int64), "around": range_hash(sums, a, b + length).view(np.int64)})
    names = ("row", "at", "left", "right", "key", "around")
    return {k: np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in names} | {"rows": len(lengths)}


def _anchors(rows: DataFrame, length: int, kmer: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for lo, hi in pieces(offsets):
                got = window_owners(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], length, kmer)
                take = pa.array(got["row"] + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), *[pa.array(got[k]) for k in ("key", "around")], *[pa.array(got[k].astype(np.int32)) for k in ("at", "left", "right")]],
                    ["_id", "_hash", "key", "around", "at", "left", "right"])

    return rows.mapInArrow(find, "_id long, _hash long, key long, around long, at int, left int, right int")


def _range_min(values: np.ndarray) -> list[list[int]]:
    """Tables of the minimum of 1, 2, 4, ... neighbours."""
    tables, step = [values.tolist()], 1
    while len(values) > step:
        values = np.minimum(values[:-step], values[step:])
        tables.append(values.tolist())
        step *= 2
    return tables


def _sorted_with_lcp(group: np.ndarray, body: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and bytes, and the common prefix with the row before (-1: other group)."""
    lead = group.astype(">i8").view(np.uint8).reshape(-1, 8)
    wide = np.ascontiguousarray(np.concatenate([lead, body], axis=1))
    order = np.argsort(wide.view(f"S{wide.shape[1]}").reshape(-1), kind="stable")
    body, sizes, group = body[order], sizes[order], group[order]
    differ = body[1:] != body[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), body.shape[1])
    lcp = np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))
    return order, np.concatenate([[-1], np.where(group[1:] == group[:-1], lcp, -1)])


def maximal_repeats(group: np.ndarray, contexts: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(suffix, left extension, common prefix) of every maximal repeat of at least `length`.

    `contexts` holds the bytes around each suffix from `begin`: `left` before it, `right` from it on.
    """
    m = len(group)
    here = begin + left
    columns = np.arange(int(right.max()))
    reach = columns[None, :] < right[:, None]
    after = np.where(reach, contexts[np.minimum(here[:, None] + columns, len(contexts) - 1)], 0).astype(np.uint8)
    columns = np.arange(max(int(left.max()), 1))
    reach = columns[None, :] < left[:, None]
    before = np.where(reach, contexts[np.maximum(here[:, None] - 1 - columns, 0)], 0).astype(np.uint8)
    order, prefix = _sorted_with_lcp(group, after, right)
    by_left, shared = _sorted_with_lcp(group, before, left)
    place = np.empty(m, np.int64)
    place[by_left] = np.arange(m)
    tables = _range_min(shared)
    owner, place_of = by_left.tolist(), place[order].tolist()
    best, found = [-1] * m, []

    def meet(x: int, y: int, depth: int) -> None:
        x, y = (x, y) if x < y else (y, x)
        level = (y - x).bit_length() - 1
        table = tables[level]
        reach = min(table[x + 1], table[y - (1 << level) + 1])
        if reach + depth >= length:
            for one in (x, y):
                if reach > best[one]:  # longer to the left than any repeat with a longer prefix
                    best[one] = reach
                    found.append((owner[one], reach, depth))

    def join(some: list[int], more: list[int], depth: int) -> list[int]:
        if len(some) > len(more):
            some, more = more, some
        for x in some:
            at = bisect_left(more, x)
            if at:
                meet(more[at - 1], x, depth)
            if at < len(more):
                meet(x, more[at], depth)
            more.insert(at, x)
        return more

    stack: list[tuple[int, list[int]]] = []
    for i, depth in enumerate(prefix[1:].tolist() + [-1]):
        inside = [place_of[i]]
        while stack and stack[-1][0] > depth:
            inside = join(inside, stack[-1][1], stack[-1][0])
            stack.pop()
        if depth < 0:
            continue
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, join(inside, stack[-1][1], depth))
        else:
            stack.append((depth, inside))
    return found


_SPAN = "_id long, _hash long, start int, stop int, repeat long"


def _span_batch(ids, hashes, starts, stops, repeats) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(repeats, pa.int64())],
                                      ["_id", "_hash", "start", "stop", "repeat"])


def _scan_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Repeats of the suffixes marked `alone`, from buckets that are sorted in one task each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(table: pa.Table) -> pa.RecordBatch:
            data, begin = buffers(table["context"])
            key, ids, hashes = table["key"].to_numpy(), table["_id"].to_pylist(), table["_hash"].to_pylist()
            at, left, right = (table[k].to_numpy().astype(np.int64) for k in ("at", "left", "right"))
            alone = table["alone"].to_pylist()
            found = [x for x in maximal_repeats(key, data, begin[:-1], left, right, length) if alone[x[0]]]
            who = np.array([x[0] for x in found], np.int64)
            back, ahead = np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64)
            here = begin[:-1][who] + left[who]
            return _span_batch([ids[i] for i in who], [hashes[i] for i in who], at[who] - back, at[who] + ahead,
                               range_hash(prefix_hash(data), here - back, here + ahead).view(np.int64))

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            last = keys[-1]
            cut = int(np.searchsorted(keys, last))  # sorted: the last key may go on in the next batch
            if held and (cut or held[-1].column(0)[-1].as_py() != last) and size >= CHUNK_BYTES:
                yield settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield settle(pa.Table.from_batches(held))

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(scan, _SPAN)


def _count_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for crowded buckets: every window that is found in two of the contexts."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = buffers(batch.column(batch.schema.get_field_index("context")))
            at, left = (batch.column(batch.schema.get_field_index(k)).to_numpy().astype(np.int64) for k in ("at", "left"))
            for lo, hi in pieces(begin):
                part, rows = data[begin[lo]:begin[hi]], begin[lo:hi + 1] - begin[lo]
                start = np.arange(max(len(part) - length + 1, 0))
                row = np.searchsorted(rows, start, "right") - 1
                good = start + length <= rows[row + 1]
                start, row = start[good], row[good]
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([
                    pa.array(range_hash(prefix_hash(part), start, start + length).view(np.int64)), batch.column(1).take(take), batch.column(2).take(take),
                    pa.array((at[row + lo] - left[row + lo] + start - rows[row]).astype(np.int32)), batch.column(batch.schema.get_field_index("alone")).take(take)],
                    ["repeat", "_id", "_hash", "start", "alone"])

    rows = contexts.mapInArrow(windows, "repeat long, _id long, _hash long, start int, alone boolean")
    twice = rows.groupBy("repeat").count().filter("count > 1").select(F.col("repeat").alias("_r"))
    return (rows.filter("alone").join(twice, rows["repeat"] == twice["_r"])
            .select("_id", "_hash", "start", (F.col("start") + length).cast("int").alias("stop"), "repeat"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, kmer: int = KMER, crowd: int = CROWD) -> DataFrame:
    """Byte spans [start, stop) of repeats, as (_id, _hash, start, stop, repeat).

    `repeat` is the same number for the same string: all its occurrences, not just neighbours.
    A row is named by its id and the hash of its text; rows alike in both are occurrences of
    their own, as their strings are repeated. Spans of one row may overlap. Null and short texts
    have none. Other columns than the two are not read.
    """
    if not 0 < kmer < length:
        raise ValueError("kmer must be shorter than length")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_hash"), F.col(text).cast("string").alias("_text")).filter(F.octet_length("_text") >= length)
    anchors = write_once(_anchors(rows, length, kmer), "anchors")
    alike = anchors.groupBy("key", "around").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_hash", "at", "left", "right")).alias("one"))
    buckets = alike.groupBy("key").agg(F.sum("n").alias("_total"), F.count("*").alias("different"), F.count_if(F.col("n") == 1).alias("alone")).filter("_total > 1").withColumnRenamed("key", "_k")
    alike = write_once(alike.join(buckets, alike["key"] == buckets["_k"]).select("key", "around", "n", "one", "different", F.col("alone").alias("_alone")), "repeated-anchors")
    settled = alike.filter("n > 1").select(F.col("key").alias("_k"), F.col("around").alias("_a"))
    spans = anchors.join(settled, (anchors["key"] == settled["_k"]) & (anchors["around"] == settled["_a"])).select(
        "_id", "_hash", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop"), F.col("around").alias("repeat"))

    # what stands once, beside others with the same k-mer: fetch the bytes around these
    open_ = alike.filter("different > 1 and _alone > 0")
    wanted = open_.groupBy(F.col("one._id").alias("_i"), F.col("one._hash").alias("_h")).agg(
        F.collect_list(F.struct("key", F.col("one.at").alias("at"), F.col("one.left").alias("left"), F.col("one.right").alias("right"), (F.col("n") == 1).alias("alone"), (F.col("different") > crowd).alias("crowded"))).alias("_want"))
    pulled = rows.join(wanted, rows["_id"].eqNullSafe(wanted["_i"]) & (rows["_hash"] == wanted["_h"])).select("_id", "_hash", F.encode("_text", "UTF-8").alias("_text"), F.explode("_want").alias("w"))
    context = F.substring("_text", F.col("w.at") - F.col("w.left") + 1, F.col("w.left") + F.col("w.right"))
    contexts = write_once(pulled.select(F.col("w.key").alias("key"), "_id", "_hash", "w.at", "w.left", "w.right", "w.alone", "w.crowded", context.alias("context")), "contexts")
    columns = [c for c in contexts.columns if c != "crowded"]
    spans = spans.unionAll(_scan_buckets(contexts.filter("not crowded").select(*columns), length))
    return spans.unionAll(_count_windows(contexts.filter("crowded").select(*columns), length))


def cut_repeats(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, `removed` (maximal runs [start, stop)), the `kept`
    bytes, and `text`, the kept bytes as text. A cut may fall inside a character, so what is kept is
    binary; in `text` the parts of such a character are left out. Every row of `docs` is returned; a null
    text is empty."""
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_hash"), F.col(text).cast("string").alias("_text"))
    mine = spans.groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    joined = rows.join(mine, rows["_id"].eqNullSafe(mine["_i"]) & (rows["_hash"] == mine["_h"]), "left").select("_id", "_text", F.array_sort("_spans").alias("_spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            sizes, removed, kept = [], [], []
            for i in range(batch.num_rows):
                raw = data[offsets[i]:offsets[i + 1]].tobytes()
                runs: list[list[int]] = []
                for x in batch.column(2)[i].as_py() or ():
                    if runs and x["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["stop"])
                    else:
                        runs.append([x["start"], x["stop"]])
                edges = [0, *[e for r in runs for e in r], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(raw))
                removed.append([{"start": a, "stop": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array([n - len(k) for n, k in zip(sizes, kept, strict=True)], pa.int64()),
                pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "removed", "kept", "text"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,stop:long>>, kept binary, text string")


def digest(cut: DataFrame) -> DataFrame:
    """The counts of `cut_repeats` with a hash of the kept bytes."""
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def cleaned(cut: DataFrame) -> DataFrame:
    """`digest` beside the plain result: `has_repeats` and `text`, what is left of the document."""
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("removed") > 0).alias("has_repeats"), "text")
