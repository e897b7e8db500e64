"""Near-duplicate documents by HyperMinHash registers, banding and exact confirmation.

A document's set of word shingles is hashed once; the top bits choose one of 128 registers,
and each register keeps the smallest remaining hash as a leading-zero count and ten mantissa
bits (Yu and Weber's HyperMinHash). Four neighbouring registers are a band. Equal sets are one
class from the start; classes that share a band are candidates:

* first every class against the most central class of each of its bands, which is linear;
* then, where a band still holds several components, their registers and, for likely pairs,
  their sets are compared in blocks inside tasks; only links come out. A band of very many classes
  is first split by set size, into ranges that any two similar sets have in common. What is still crowded
  is compared in blocks all the same if its sets are small; large sets, which fill all registers, are split
  further by the crowded bands they share.

Candidates pass a size test and the collision-corrected register estimate, and are then
confirmed on their full shingle sets. Two sets of similarity 0.8 that fill all registers share no band
with probability 5e-8, and fewer than two with 1e-6; more similar ones far less. Small sets are never
asked for more than one band in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.bytewise import SPACE_WORD, buffers, gram_hashes, mix, pieces, word_hashes
from fleetgauge.llm.components import components
from fleetgauge.session import write_once

#: Registers that are banded, and further ones, of a second hash, that only sharpen the estimate.
REGISTERS, FURTHER = 128, 256
BAND = 4
MANTISSA = 10
#: Percent of the union that the intersection must reach.
SIMILARITY = 80
#: Classes of one band that are compared in blocks; more, if not all linked, are split first.
CROWD, BLOCK = 16_384, 512
#: From this many shingles on a set fills nearly all registers, and bands in common may be counted on.
FULL = 512
#: Chance matches of one register pair, from the published approximation.
COLLISION = 0.169919487159739 * 2.0**-MANTISSA
SALTS = 32


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words, rows = word_hashes(data, offsets, SPACE_WORD)
    grams, start = gram_hashes(words, rows, n)
    cuts = np.searchsorted(start, rows)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = np.sort(grams[a:b])
        yield part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part


def registers(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HyperMinHash registers of sorted hashes: 0 if empty, else 1 + leading zeros and mantissa."""
    out = np.zeros(1 << bits, np.uint16)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])[:len(bucket)]
    rest = np.maximum((hashes[first] >> np.uint64(12 - bits)) & np.uint64((1 << 52) - 1), np.uint64(1))
    length = np.frexp(rest.astype(np.float64))[1].astype(np.uint64)
    aligned = rest << (np.uint64(52) - length)
    mantissa = (aligned >> np.uint64(52 - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first]] = ((np.uint64(52) - length) << np.uint64(MANTISSA)) + mantissa + np.uint64(1)
    return out


def _all_registers(hashes: np.ndarray) -> bytes:
    return registers(hashes, 7).tobytes() + registers(np.sort(mix(hashes)), 8).tobytes()


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """Per row: _id, _hash of the text, n (set size), _class (key of the set) and _registers."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            sizes, classes, regs = [], [], []
            for lo, hi in pieces(offsets):
                for s in _sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], shingle):
                    sizes.append(len(s))
                    if not len(s):
                        classes.append(None)
                        regs.append(None)
                        continue
                    with np.errstate(over="ignore"):
                        classes.append(s.sum().tobytes() + (s * (s >> np.uint64(17) | np.uint64(1))).sum().tobytes())
                    regs.append(_all_registers(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(regs, pa.binary())],
                                             ["_id", "_hash", "n", "_class", "_registers"])

    return (docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_hash"), F.col(text).cast("string").alias("_text"))
            .mapInArrow(sign, "_id long, _hash long, n long, _class binary, _registers binary"))


def _likely(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the collision-corrected estimate of each pair of register rows is near the
    threshold or above: at most five standard deviations below, and one register more."""
    used = (x > 0) | (y > 0)
    total = used.sum(axis=1)
    same = ((x == y) & used).sum(axis=1) - COLLISION * total
    p = percent / 100
    return same + 1 >= p * total - 5 * np.sqrt(p * (1 - p) * total)


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose registers make it likely."""
    sides = []
    for side in "ab":
        sides.append(reps.select(F.col("_class").alias(f"_{side}"), F.col("n").alias(f"n_{side}"), F.col("_registers").alias(f"r_{side}")))
    wide = pairs.join(sides[0], pairs["a"] == sides[0]["_a"]).join(sides[1], pairs["b"] == sides[1]["_b"])
    wide = wide.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(buffers(batch.column(i))[0], np.uint16).reshape(-1, REGISTERS + FURTHER) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(_likely(x, y, percent)))

    return wide.select("a", "b", "r_a", "r_b").mapInArrow(estimate, "a binary, b binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the similarity. The first text of each pair is sent
    once for each of up to SALTS parts of its partners and kept while these stream by."""
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    heads = salted.select("a", "_salt").distinct()
    own, other = texts.select(F.col("_class").alias("_c"), "_text"), texts.select(F.col("_class").alias("_c"), "_text")
    stream = (heads.join(own, heads["a"] == own["_c"]).select("a", "_salt", F.lit(None).cast("binary").alias("b"), "_text")
              .unionAll(salted.join(other, salted["b"] == other["_c"]).select("a", "_salt", "b", "_text")))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            data, offsets = buffers(batch.column(3))
            one, two = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            u, v, row = [], [], 0
            for lo, hi in pieces(offsets):
                for s in _sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], shingle):
                    a, b = one[row], two[row]
                    row += 1
                    if b is None:
                        held, at = s, a
                    elif at == a:
                        both = len(np.intersect1d(held, s, assume_unique=True))
                        if 100 * both >= percent * (len(held) + len(s) - both):
                            u.append(a)
                            v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return (stream.repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first())
            .mapInArrow(confirm, "u binary, v binary"))


def _across(rows: DataFrame, roots: DataFrame, reps: DataFrame, percent: int, crowd: int, block: int, full: int) -> tuple[DataFrame, bool]:
    """Cells in which classes of different components that share a band meet, and whether each
    pair should be looked at in its first shared band only. From (key, _class, band).

    Bands with more than `crowd` classes are split into ranges of set size, each class standing in its own and
    the next, so that sets of sizes within the similarity's ratio meet. Ranges that are still crowded are
    compared in blocks if their sets are smaller than `full`; else they give way to the pairs of such bands
    that a class has. The classes of a key are compared in blocks of about `block`: each class
    is sent to the cells of its own block against every other. No list of pairs is made.
    """
    rows = rows.join(roots, rows["_class"] == roots["node"], "left").select("key", "_class", F.coalesce("root", "_class").alias("root"), "band")

    def open_keys(rows: DataFrame, label: str) -> DataFrame:
        stats = rows.groupBy("key").agg(F.count("*").alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select(F.col("key").alias("_k"), "_n")
        return write_once(rows.join(stats, rows["key"] == stats["_k"]).drop("_k"), label)

    columns = ["key", "_class", "root", "_n", "band"]
    rows = open_keys(rows, "bands-1")
    parts, crowded = [rows.filter(F.col("_n") <= crowd).select(*columns)], rows.filter(F.col("_n") > crowd)
    once = crowded.isEmpty()  # every shared band is compared, so its first one can report a pair
    if not once:
        sizes = reps.select(F.col("_class").alias("_c"), "n")
        # sizes up to the ratio apart lie in the same range or in neighbouring ones
        own = F.floor(F.log(F.col("n")) / np.log(100 / percent) - 1e-9)
        ranged = crowded.join(sizes, crowded["_class"] == sizes["_c"]).withColumn("_range", F.explode(F.array(own, own + 1)))
        ranged = ranged.select(F.xxhash64("key", "_range").alias("key"), "_class", "root", "band", "_range", (F.col("_range") >= np.log(full) / np.log(100 / percent)).alias("_full"))
        ranged = open_keys(ranged, "bands-by-size")
        deep = F.col("_full") & (F.col("_n") > crowd)
        parts.append(ranged.filter(~deep).select(*columns))
        mine = ranged.filter(deep).groupBy("_class", "root", "_range").agg(F.array_sort(F.collect_set("key")).alias("_keys"))  # at most 32
        pairs = (mine.withColumn("one", F.explode("_keys")).withColumn("two", F.explode(F.filter("_keys", lambda k: k > F.col("one"))))
                 .select(F.xxhash64("one", "two").alias("key"), "_class", "root", F.lit(0).alias("band")))
        parts.append(open_keys(pairs, "bands-in-pairs").select(*columns))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionAll(more)
    blocks = F.ceil(F.col("_n") / block)
    own = F.pmod(F.xxhash64("_class"), blocks)
    cells = every.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "_class", "root", "band")
    side = reps.select(F.col("_class").alias("_c"), "n", "_registers")
    cells = cells.join(side, cells["_class"] == side["_c"]).select("key", "i", "j", "own", "_class", "root", "n", "_registers", "band")
    return cells, once


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one cell at a time, from batches sorted by the first three columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(3)):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _cell_pairs(table: pa.Table, percent: int, once: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Row x of a cell and its likely partners y, of other components."""
    numbers: dict[bytes, int] = {}
    root = np.array([numbers.setdefault(r, len(numbers)) for r in table["root"].to_pylist()])
    if len(numbers) < 2:
        return
    size = table["n"].to_numpy()
    regs = np.frombuffer(buffers(table["_registers"])[0], np.uint16).reshape(-1, REGISTERS + FURTHER)
    parts = regs[:, :REGISTERS].reshape(len(regs), -1, BAND)
    own, j, band = table["own"].to_numpy(), table["j"][0].as_py(), table["band"][0].as_py()
    one_block = table["i"][0].as_py() == j
    for x in range(len(regs) - 1) if one_block else np.flatnonzero(own != j):
        y = np.arange(x + 1, len(regs)) if one_block else np.flatnonzero(own == j)
        y = y[(root[y] != root[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
        if len(y):
            y = y[_likely(regs[x][None, :], regs[y], percent)]
        if len(y) and once:
            shared = (parts[y] == parts[x]).all(axis=2) & parts[x].any(axis=1)
            y = y[shared.argmax(axis=1) == band]
        if len(y):
            yield int(x), y


def _involved(cells: DataFrame, percent: int, once: bool) -> DataFrame:
    """Rows (key, i, j, _class) of each cell that have a likely partner in it."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            rows: set[int] = set()
            for x, y in _cell_pairs(table, percent, once):
                rows.add(x)
                rows.update(y.tolist())
            if rows:
                yield from table.select(["key", "i", "j", "_class"]).take(pa.array(sorted(rows))).combine_chunks().to_batches()

    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(look, "key long, i long, j long, _class binary")


def _links_across(cells: DataFrame, involved: DataFrame, texts: DataFrame, shingle: int, percent: int, once: bool) -> DataFrame:
    """Links (u, v) inside cells, confirmed on full sets; one for each two components that meet."""
    named = involved.select(F.col("key").alias("_k"), F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("_class").alias("_n"))
    rows = cells.join(named, (cells["key"] == named["_k"]) & (cells["i"] == named["_i"]) & (cells["j"] == named["_j"]) & (cells["_class"] == named["_n"]), "left_semi")
    text = texts.select(F.col("_class").alias("_t"), "_text")
    rows = rows.join(text, rows["_class"] == text["_t"]).drop("_t")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            names, roots = table["_class"].to_pylist(), table["root"].to_pylist()
            over: dict[bytes, bytes] = {}

            def find(r: bytes, over: dict[bytes, bytes] = over) -> bytes:
                while r in over:
                    r = over[r]
                return r

            sets: list[np.ndarray] = []
            for chunk in table["_text"].chunks:
                data, offsets = buffers(chunk)
                for lo, hi in pieces(offsets):
                    sets += [s.copy() for s in _sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], shingle)]
            u, v = [], []
            for x, partners in _cell_pairs(table, percent, once):
                for y in partners.tolist():
                    one, two = find(roots[x]), find(roots[y])
                    if one == two:
                        continue
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        over[one] = two
                        u.append(names[x])
                        v.append(names[y])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(confirm, "u binary, v binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = SIMILARITY, crowd: int = CROWD, block: int = BLOCK, full: int = FULL) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links of
    `percent` or more, itself included) and kept (it is that document).

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than `shingle`
    words is one shingle; a null, empty or blank text has none and is linked with nothing. Rows
    that repeat a doc_id are documents of their own with that id. A null doc_id takes part in
    links; its component_id is the smallest id there is, else null, and it is never kept unless
    alone. Columns other than doc_id and text are not read.
    """
    signed = write_once(signatures(docs, doc_id, text, shingle), "signatures")
    reps = write_once(signed.filter("_class is not null").groupBy("_class").agg(
        F.min("_id").alias("_low"), F.min("_hash").alias("_hash"), F.first("n").alias("n"), F.first("_registers").alias("_registers")), "classes")
    # bands: 8 bytes of registers each; four empty registers say nothing
    pieces_of = F.expr(f"filter(transform(sequence(0, {REGISTERS // BAND - 1}), i -> struct(i, substring(_registers, i * {2 * BAND} + 1, {2 * BAND}) as part)), x -> x.part <> X'{'00' * 2 * BAND}')")
    bands = reps.select("_class", F.explode(pieces_of).alias("x")).select(F.xxhash64("x.i", "x.part").alias("key"), "_class", F.col("x.i").alias("band"))
    # the centre of a family of copies meets most others in most bands; it leads wherever it is
    crowds = bands.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").withColumnRenamed("key", "_k")
    met = write_once(bands.join(crowds, bands["key"] == crowds["_k"]).select("key", "_class", "band", "_n"), "bands")
    central = met.groupBy("_class").agg(F.sum("_n").alias("score")).withColumnRenamed("_class", "_c")
    scored = met.join(central, met["_class"] == central["_c"]).select("key", "_class", "score")
    leaders = scored.groupBy("key").agg(F.max(F.struct("score", "_class")).alias("x")).select(F.col("key").alias("_k"), F.col("x._class").alias("leader"))
    shared = met.join(leaders, met["key"] == leaders["_k"]).select("key", "_class", "band", "leader")
    stars = shared.filter("leader <> _class").select(F.col("leader").alias("a"), F.col("_class").alias("b")).distinct()
    likely = write_once(_estimated(stars, reps, percent), "candidates")

    def texts_of(need: DataFrame, label: str) -> DataFrame:
        need = need.select(F.col("_class").alias("c")).distinct()
        wanted = reps.join(need, reps["_class"] == need["c"], "left_semi").select("_class", F.col("_hash").alias("_h"))
        rows = docs.select(F.xxhash64(F.col(text).cast("string")).alias("_hash"), F.col(text).cast("string").alias("_text"))
        rows = rows.join(wanted.select("_h").distinct(), rows["_hash"] == F.col("_h"), "left_semi").dropDuplicates(["_hash"])
        return write_once(rows.join(wanted, rows["_hash"] == wanted["_h"]).select("_class", "_text"), label)

    ends = likely.select(F.col("a").alias("_class")).unionAll(likely.select(F.col("b").alias("_class")))
    links = write_once(_confirmed(likely, texts_of(ends, "texts"), shingle, percent), "links")
    roots = components(links)
    cells, once = _across(met.select("key", "_class", "band"), roots, reps, percent, crowd, block, full)
    involved = write_once(_involved(cells, percent, once), "involved")
    if not involved.isEmpty():
        extra = write_once(_links_across(cells, involved, texts_of(involved, "texts-across"), shingle, percent, once), "links-across")
        if not extra.isEmpty():
            roots = components(links.unionAll(extra))
    placed = reps.join(roots, reps["_class"] == roots["node"], "left").select("_class", "_low", F.coalesce("root", "_class").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("_low").alias("component_id")).withColumnRenamed("root", "_r")
    classes = placed.join(lowest, placed["root"] == lowest["_r"]).select(F.col("_class").alias("_c"), "component_id")
    joined = signed.join(classes, signed["_class"] == classes["_c"], "left")
    component = F.when(F.col("_class").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return joined.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """Documents without those that have a near duplicate of smaller doc_id. Rows that repeat
    the kept doc_id stay as they are told apart by id only."""
    gone = near_duplicates(docs, shingle=shingle, percent=percent).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
