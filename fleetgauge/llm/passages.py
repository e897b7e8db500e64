"""Fuzzy passages that documents share: shared seeds, collinear chains, alignment.

Seeds are k-word grams, one from every window of neighbouring grams (the smallest hash), so any
run of `k + window - 1` equal words shares one. Each seed links its documents to the first
document that has it, in a star: the number of matches never exceeds the number of seeds.

The first document with a seed need not have the passage that two others share around it. So
wherever a match does not lie in a passage as long as those looked for, the words around it give
longer seeds, which form stars of their own (`levels`). The last ones are `min_words` words long:
documents with one of these in common do share a passage, so no exact passage is lost, however
many documents have pieces of it, and the work stays in proportion to the matches.

The matches of a pair are chained in order in both texts, best score first, with a Fenwick tree
over the second text that answers "best chain ending before here" and a cost for the words
skipped. Chains are then aligned word by word on the full texts and extended at both ends; a chain
that is not similar enough as a whole is cut into the longest parts that are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.bytewise import SPACE_WORD, buffers, gram_hashes, pieces, position, ranked, sliding_min, word_hashes
from fleetgauge.operators.skew import attach_group, salted_join
from fleetgauge.session import write_once

#: Seeds of 8 words find nine in ten passages of 200 words with a tenth of the words changed, seeds of 4 words those with a
#: fifth changed; but 4 words also meet by chance, and each such meeting moves a text.
KMER, WINDOW = 8, 16
#: Shortest passage reported, in words of either text, and the part of the longer side that must be equal.
MIN_WORDS, SIMILARITY = 50, 0.8
#: Cost per word skipped in either text; a seed is worth its k words.
GAP = 0.2
#: Texts compared with one copy of their leader's text.
MEMBERS = 512


def levels(k: int, window: int, min_words: int) -> list[tuple[int, int]]:
    """Words of a seed and grams of a window, level by level: the length doubles up to a whole passage."""
    out = [(k, window)]
    while out[-1][0] < min_words:
        longer = min(2 * out[-1][0], min_words)
        # so many neighbouring grams fit in a passage, so each passage has a seed
        out.append((longer, min(window, min_words - longer + 1)))
    return out


def seeds_around(words: np.ndarray, rows: np.ndarray, at: np.ndarray, k: int, spans: Sequence[tuple[int, int]], min_words: int, longer: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Longer seeds of every run of `min_words` words that holds one of the k-word grams and is not inside one of the spans.

    For all rows at once: `at` and `spans` count in `words`; `min_words` is at least two."""
    row = np.searchsorted(rows, at, "right") - 1
    low, high = rows[:-1][row], rows[1:][row] - min_words + 1
    at, low, high = at[high > low], low[high > low], high[high > low]
    steps = np.bincount(np.clip(at + k - min_words, low, high), minlength=len(words) + 1) - np.bincount(np.clip(at + 1, low, high), minlength=len(words) + 1)
    left = np.cumsum(steps[:-1]) > 0
    for s, e in spans:
        left[s:e - min_words + 1] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], left, [False]]).astype(np.int8)))
    if not len(edges):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin, size = edges[::2], edges[1::2] - edges[::2] + min_words - 1
    cuts = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(cuts[-1]) + np.repeat(begin - cuts[:-1], size)
    found, first = seed_positions(words[take], cuts, longer, window)
    # neighbouring runs may overlap
    at, once = np.unique(take[first], return_index=True)
    return found[once], at


def seed_positions(words: np.ndarray, rows: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the seeds of all rows; a row with fewer grams than a window gives one."""
    grams, start = gram_hashes(words, rows, k)
    full = start + k <= np.repeat(rows[1:], np.diff(rows))[start] if len(start) else np.zeros(0, bool)
    grams, start = grams[full], start[full]
    if not len(grams):
        return grams, start
    chosen = []
    step = (1 << 21) - window
    for lo in range(0, len(grams), step):
        part = ranked(grams[lo:lo + step + window - 1])
        cuts = np.clip(np.searchsorted(start, rows) - lo, 0, len(part))
        low = sliding_min(part, window)
        first = np.arange(len(low))
        row = np.searchsorted(cuts, first, "right") - 1
        chosen.append(position(low[first + window <= cuts[row + 1]]) + lo)
        size = np.diff(cuts)
        short = np.flatnonzero((size > 0) & (size < window))
        if len(short):
            bounds = np.stack([cuts[:-1][short], cuts[1:][short]], axis=1).reshape(-1)
            bounds = bounds[:-1] if bounds[-1] == len(part) else bounds
            chosen.append(position(np.minimum.reduceat(part, bounds)[::2]) + lo)
    at = np.unique(np.concatenate(chosen))
    return grams[at], start[at]


def chains(a: Sequence[int], b: Sequence[int], k: int, gap: float) -> list[list[int]]:
    """Chains of matches (a[i], b[i]), each a list of match numbers, best first.

    A match joins the best chain that ends before it in both texts if that is worth the words
    skipped. With costs of gap * (words skipped in a + in b) the best predecessor is the largest
    of score + gap * (a + b), which a Fenwick tree over b keeps while a is swept.
    """
    if len(a) == 1:
        return [[0]]
    order = sorted(range(len(a)), key=lambda i: (a[i], -b[i]))
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(b)))}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ranks) + 1)
    score, before = [0.0] * len(a), [-1] * len(a)
    for i in order:
        best, at = (float("-inf"), -1), ranks[b[i]] - 1
        while at:
            best = max(best, tree[at])
            at -= at & -at
        # steps of up to k words overlap or touch: only what lies beyond is skipped
        gain = best[0] - gap * max(a[i] + b[i] - 2 * k, 0) if best[1] >= 0 else 0.0
        if best[1] >= 0 and gain > 0:
            j = best[1]
            score[i], before[i] = gain + min(k, a[i] - a[j], b[i] - b[j]), j
        else:
            score[i] = float(k)
        entry, at = (score[i] + gap * (a[i] + b[i]), i), ranks[b[i]]
        while at < len(tree):
            tree[at] = max(tree[at], entry)
            at += at & -at
    used, found = [False] * len(a), []
    for i in sorted(range(len(a)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            found.append(chain[::-1])
    return found


def _common(x: list[int], i: int, y: list[int], j: int, n: int) -> int:
    """Equal words from x[i] and y[j] on, n at most: steps double while they are equal, then halve."""
    at, step = 0, 1
    while at + step <= n and x[i + at:i + at + step] == y[j + at:j + at + step]:
        at, step = at + step, 2 * step
    while step > 1:
        step //= 2
        if at + step <= n and x[i + at:i + at + step] == y[j + at:j + at + step]:
            at += step
    return at


def _lcs(x: list[int], y: list[int]) -> int:
    """Longest common subsequence: a row of the table is one whole number, a bit per word of y
    that is 0 where the length grows, so space is linear."""
    places: dict[int, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    whole = (1 << len(y)) - 1
    row = whole
    for u in x:
        if u in places:
            met = row & places[u]
            row = (row + met | row - met) & whole
    return len(y) - row.bit_count()


def _between(x: Sequence[int], y: Sequence[int]) -> int:
    """Equal words of two gaps in order."""
    x, y = list(x), list(y)
    head = _common(x, 0, y, 0, min(len(x), len(y)))
    x, y = x[:head - 1:-1] if head else x[::-1], y[:head - 1:-1] if head else y[::-1]
    tail = _common(x, 0, y, 0, min(len(x), len(y)))
    both = set(x[tail:]) & set(y[tail:])
    return head + tail + (_lcs([v for v in x[tail:] if v in both], [v for v in y[tail:] if v in both]) if both else 0)


def _extend(x: list[int], i: int, end: int, y: list[int], j: int, end2: int) -> tuple[int, int, int]:
    """How far two texts go on alike from x[i] and y[j], up to `end` and `end2`: words taken of each
    and how many are equal. A changed, added or lost word is stepped over if at least three equal words follow it."""
    start, start2, equal = i, j, 0
    while True:
        run = _common(x, i, y, j, min(end - i, end2 - j))
        i, j, equal = i + run, j + run, equal + run
        for u, v in ((1, 1), (1, 0), (0, 1), (2, 2)):
            if i + u + 3 <= end and j + v + 3 <= end2 and x[i + u:i + u + 3] == y[j + v:j + v + 3]:
                i, j = i + u, j + v
                break
        else:
            return i - start, j - start2, equal


class Words:
    """The word hashes of a text, as an array and as lists in both directions."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.ahead = hashes.tolist()
        self.back = self.ahead[::-1]


def aligned(x: Words, y: Words, a: Sequence[int], b: Sequence[int], k: int, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages of a chain of matches of k words: span in x, span in y and equal words of each.

    Seeds that touch or overlap are one run. If the chain as a whole is not similar enough, its
    longest part that is becomes a passage and the runs on both sides of that are looked at again,
    down to single runs. No part reaches beyond the whole, so a whole that is too short is none.
    """
    runs: list[list[int]] = []  # start and end in x, start and end in y
    for p, q in zip(a, b, strict=True):
        if runs:
            step = max(runs[-1][1] - p, runs[-1][3] - q, 0)  # the part of this seed that is counted already
            if step >= k:
                continue
            p, q, end = p + step, q + step, k - step
            if p == runs[-1][1] and q == runs[-1][3]:
                runs[-1][1], runs[-1][3] = p + end, q + end
                continue
            runs.append([p, p + end, q, q + end])
        else:
            runs.append([p, p + k, q, q + k])
    n_x, n_y = len(x.ahead), len(y.ahead)

    def before(run: list[int], low: int, low2: int) -> tuple[int, int, int]:
        return _extend(x.back, n_x - run[0], n_x - low, y.back, n_y - run[2], n_y - low2)

    def behind(run: list[int], high: int, high2: int) -> tuple[int, int, int]:
        return _extend(x.ahead, run[1], high, y.ahead, run[3], high2)

    # how far the chain goes on into the text
    head, tail = before(runs[0], 0, 0), behind(runs[-1], n_x, n_y)
    s, e, s2, e2 = runs[0][0] - head[0], runs[-1][1] + tail[0], runs[0][2] - head[1], runs[-1][3] + tail[1]
    if min(e - s, e2 - s2) < min_words:
        return []
    # equal words between each run and the next
    equal = [_between(x.ahead[r[1]:t[0]], y.ahead[r[3]:t[2]]) for r, t in zip(runs[:-1], runs[1:], strict=True)]
    same = head[2] + sum(r[1] - r[0] for r in runs) + sum(equal) + tail[2]
    if same >= similarity * max(e - s, e2 - s2):
        return [(s, e, s2, e2, same)]
    n = len(runs)
    if n == 1:
        return []
    start_x, stop_x, start_y, stop_y = np.array(runs, np.int64).T
    # equal words before each run, counted from the first
    upto = np.concatenate([[0], np.cumsum((stop_x - start_x)[:-1] + np.array(equal, np.int64))])
    # how far each run goes on to the left and to the right: into the gap, at the ends of the chain into the text
    left = np.array([head, *[before(t, r[1], r[3]) for r, t in zip(runs[:-1], runs[1:], strict=True)]], np.int64)
    right = np.array([*[behind(r, t[0], t[2]) for r, t in zip(runs[:-1], runs[1:], strict=True)], tail], np.int64)

    def spans(first: np.ndarray, last: np.ndarray) -> tuple:
        s, e = start_x[first] - left[first, 0], stop_x[last] + right[last, 0]
        s2, e2 = start_y[first] - left[first, 1], stop_y[last] + right[last, 1]
        return s, e, s2, e2, upto[last] - upto[first] + stop_x[last] - start_x[last] + left[first, 2] + right[last, 2]

    out, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        for size in range(hi - lo, 0, -1):
            first = np.arange(lo, hi - size + 1)
            s, e, s2, e2, same = spans(first, first + size - 1)
            fits = np.flatnonzero((np.minimum(e - s, e2 - s2) >= min_words) & (same >= similarity * np.maximum(e - s, e2 - s2)))
            if len(fits):
                i, at = lo + int(fits[0]), fits[0]
                out.append(tuple(int(c[at]) for c in (s, e, s2, e2, same)))
                todo += [part for part in ((lo, i), (i + size, hi)) if part[0] < part[1]]
                break
    return sorted(out)


_DOCUMENT = ["_none", "_key", "_hash"]
_LEADER = ["r_none", "r_key", "r_hash"]
_SEED = "_none boolean, _key long, _hash long, seed long, at int"
_FOUND = "r_none boolean, r_key long, start long, stop long, other_start long, other_stop long, n_equal long, similarity double"


def _first_seeds(rows: DataFrame, k: int, window: int) -> DataFrame:
    """The seeds of whole texts."""
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(3))
            for lo, hi in pieces(offsets):
                words, cuts = word_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], SPACE_WORD)
                found, at = seed_positions(words, cuts, k, window)
                row = np.searchsorted(cuts, at, "right") - 1
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(3)], pa.array(found.view(np.int64)), pa.array((at - cuts[row]).astype(np.int32))],
                                                 [*_DOCUMENT, "seed", "at"])

    return rows.mapInArrow(seeds, _SEED)


def _matches(seeded: DataFrame) -> DataFrame:
    """One row per document and the first document with one of its seeds, with the places of these
    seeds in both; no more than the seeds of one text. `_part` deals the documents of a leader out."""
    first = F.min(F.struct(*_DOCUMENT, "at"))
    firsts = seeded.groupBy("seed").agg(F.count("*").alias("_n"), first.alias("f")).filter("_n > 1").select("seed", "f")
    star = salted_join(seeded, firsts, ["seed"]).filter(F.struct(*_DOCUMENT) != F.struct(*[F.col(f"f.{c}") for c in _DOCUMENT]))
    pairs = star.groupBy(*_DOCUMENT, *[F.col(f"f.{c}").alias(r) for c, r in zip(_DOCUMENT, _LEADER, strict=True)]).agg(
        F.array_sort(F.collect_set(F.struct("at", F.col("f.at").alias("r_at")))).alias("matches"))
    parts = F.ceil(F.col("_members") / MEMBERS)
    return attach_group(write_once(pairs, "pairs", drop_shuffles=True), _LEADER, {"_members": F.count(F.lit(1))}).select(
        *_DOCUMENT, *_LEADER, F.pmod(F.xxhash64(*_DOCUMENT), parts).alias("_part"), "matches")


def _compared(rows: DataFrame, pairs: DataFrame, k: int, next_level: tuple[int, int] | None, min_words: int, similarity: float, gap: float) -> DataFrame:
    """Passages of every document and its leader, and below them the seeds of the next level (`seed` is not null)."""
    lead = pairs.select(*[F.col(r).alias(c) for c, r in zip(_DOCUMENT, _LEADER, strict=True)], *_LEADER, "_part").distinct()
    roles = pairs.unionByName(lead.withColumn("matches", F.lit(None).cast("array<struct<at:int,r_at:int>>")))
    # only texts that take part; one text per document
    texts = rows.join(roles.select(*_DOCUMENT).distinct(), _DOCUMENT, "left_semi").dropDuplicates(_DOCUMENT)
    stream = texts.join(roles, _DOCUMENT).select(*_DOCUMENT, *_LEADER, "_part", "matches", "_text")
    stream = stream.repartition(*_LEADER, "_part").sortWithinPartitions(*_LEADER, "_part", F.col("matches").isNotNull(), *_DOCUMENT)

    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.float64()]
    names = [c.split()[0] for c in f"{_SEED}, {_FOUND}".split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        missed: set[int] = set()  # places in the leader of matches outside passages
        around: list[tuple] = []  # texts that give longer seeds: document, words, places, spans

        def close() -> None:
            """Seeds of the leader: wherever it has one of the grams that were missed."""
            if missed and next_level:
                grams, start = gram_hashes(held.hashes, np.array([0, len(held.hashes)]), k)
                around.append((at[:3], held.hashes, start[np.isin(grams, grams[np.searchsorted(start, sorted(missed))])], []))
            missed.clear()

        def seeds() -> pa.RecordBatch:
            rows = np.concatenate([[0], np.cumsum([len(words) for _, words, _, _ in around])])
            found, where = seeds_around(
                np.concatenate([words for _, words, _, _ in around]), rows, np.concatenate([places + begin for (_, _, places, _), begin in zip(around, rows[:-1], strict=True)]), k,
                [(s + begin, e + begin) for (*_, spans), begin in zip(around, rows[:-1].tolist(), strict=True) for s, e in spans], min_words, *next_level)
            row = np.searchsorted(rows, where, "right") - 1
            take = pa.array(row)
            who = [pa.array([x[0][i] for x in around], kinds[i]).take(take) for i in range(3)]
            around.clear()
            return pa.RecordBatch.from_arrays([*who, pa.array(found.view(np.int64)), pa.array((where - rows[row]).astype(np.int32)), *[pa.nulls(len(row), t) for t in kinds[5:]]], names)

        for batch in batches:
            out: list[tuple] = []
            data, offsets = buffers(batch.column(8))
            me, lead_of = (list(zip(*[batch.column(i).to_pylist() for i in columns], strict=True)) for columns in (range(3), range(3, 7)))
            leads, bounds = batch.column(7).is_null().to_pylist(), batch.column(7).offsets.to_pylist()
            places, other_places = (c.to_numpy() for c in batch.column(7).values.flatten())
            for lo, hi in pieces(offsets):
                words, cuts = word_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], SPACE_WORD)
                for i in range(lo, hi):
                    mine = Words(words[cuts[i - lo]:cuts[i - lo + 1]])
                    if leads[i]:
                        close()
                        held, at = Words(mine.hashes.copy()), lead_of[i]
                        continue
                    a, b = places[bounds[i]:bounds[i + 1]].tolist(), other_places[bounds[i]:bounds[i + 1]].tolist()
                    done: list[tuple[int, int]] = []
                    for chain in chains(a, b, k, gap):
                        # a chain inside a passage that is out already says nothing new
                        if any(s <= a[chain[0]] and a[chain[-1]] + k <= e for s, e in done):
                            continue
                        for s, e, s2, e2, equal in aligned(mine, held, [a[c] for c in chain], [b[c] for c in chain], k, min_words, similarity):
                            done.append((s, e))
                            out.append((*me[i], None, None, at[0], at[1], s, e, s2, e2, equal, equal / max(e - s, e2 - s2)))
                    if next_level:
                        around.append((me[i], mine.hashes, np.array(a, np.int64), done))
                        missed.update(q for p, q in zip(a, b, strict=True) if not any(s <= p and p + k <= e for s, e in done))
                if around:
                    yield seeds()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        close()
        if around:
            yield seeds()

    return stream.mapInArrow(align, f"{_SEED}, {_FOUND}")


def shared_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = KMER, window: int = WINDOW,
                    min_words: int = MIN_WORDS, similarity: float = SIMILARITY, gap: float = GAP) -> DataFrame:
    """One row per passage of a document and the earlier document that it is linked to.

    doc_id, [start, stop) in words, other_id, [other_start, other_stop), n_equal, similarity
    (n_equal by the longer span). Passages have at least `min_words` words in both texts. `other`
    has the smallest id, then text hash, of the documents with one of the seeds, so documents
    with a common passage meet in stars; if that document has only a piece of the passage, the
    others meet by longer seeds. Words are runs without ASCII white space, A-Z lower-cased.
    Null, empty and short texts share nothing; a null id sorts last; rows alike in id and text
    are one document; copies with ids of their own are linked as whole passages. Other columns
    are not read.
    """
    rows = (docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).filter("_text is not null")
            .select(F.col("_id").isNull().alias("_none"), F.coalesce("_id", F.lit(0)).cast("long").alias("_key"), F.xxhash64("_text").alias("_hash"), "_text"))
    steps = levels(k, window, min_words)
    seeded, found = write_once(_first_seeds(rows, k, window), "seeds", drop_shuffles=True), None
    for n, (size, _) in enumerate(steps):
        level = write_once(_compared(rows, _matches(seeded), size, steps[n + 1] if n + 1 < len(steps) else None, min_words, similarity, gap), "compared", drop_shuffles=True)
        passages = level.filter("seed is null")
        found = passages if found is None else found.unionAll(passages)
        seeded = level.filter("seed is not null").select(*_DOCUMENT, "seed", "at")
        if seeded.isEmpty():
            break
    shown = found.dropDuplicates([*_DOCUMENT, "r_none", "r_key", "start", "stop", "other_start", "other_stop"])
    return shown.select(F.when(~F.col("_none"), F.col("_key")).alias("doc_id"), "start", "stop", F.when(~F.col("r_none"), F.col("r_key")).alias("other_id"),
                        "other_start", "other_stop", "n_equal", "similarity")
