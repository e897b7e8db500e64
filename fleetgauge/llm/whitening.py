"""Embedding whitening with a covariance by polarisation, exact up to the eigenvectors.

Entries become whole numbers on a grid. For every dimension, and for the sum of every two
dimensions, the squares of the centred values are added up as whole numbers of any size;
cov(a, b) = (var(a + b) - var(a) - var(b)) / 2 then gives all cross-covariances from variances
alone. Only these sums, D * (D + 1) / 2 numbers for D dimensions, come to the driver, where the
matrix is assembled for `eigh`. Equal vectors count once in the fit, and are all projected.

Values are centred on the whole part of the mean before they are multiplied; what the mean has
beyond it is put right exactly: with d = x - floor(S / n) and r = S - n * floor(S / n), the sum
of (n * x - S)^2 over the n vectors is n * (n * sum(d^2) - r^2).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import write_once

#: Steps of the grid per unit, and the number that stands for 0.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues below this share of the largest are rounding noise: no such component is returned.
LEAST_SHARE = 1e-9
#: Vectors taken at once.
CHUNK = 2048
#: Partial sums travel as signed digits of this many bits, so that adding them cannot overflow.
DIGIT_BITS = 40


@dataclass
class Whitening:
    """What the fit found. `low` and `rest`: whole part of each mean, and n times what is beyond."""

    n: int
    low: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = _minus(x, self.low).astype(np.float64) - np.array([int(r) / self.n for r in self.rest])
        return centred @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None where that is beyond 64 bits."""
        d = _minus(x, self.low)
        most = int(abs(d).max(initial=0)) + 1
        if len(self.low) * (self.n * most) ** 2 < 2**63:
            return ((self.n * d - self.rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        if max(most, self.n) * most * len(self.low) >= 2**62:
            d = d.astype(object)
        rest = self.rest if d.dtype == object else self.rest.astype(np.int64)
        squares, mixed, constant = (d * d).sum(axis=1), (d * rest).sum(axis=1), sum(int(r) ** 2 for r in self.rest)
        exact = (self.n**2 * int(a) - 2 * self.n * int(b) + constant for a, b in zip(squares, mixed, strict=True))
        return [v if v < 2**63 else None for v in exact]


def _minus(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """x - low, in 64 bits where both are small."""
    if int(abs(x).max(initial=0)) < 2**61 and max(map(abs, low.tolist()), default=0) < 2**61:
        return x - low.astype(np.int64)
    return x.astype(object) - low


def _grid(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and steps floor(scale * c), rows of one length at a time. Rows that are null or
    empty, or hold a null, a number that is not finite or one without a place in 64 bits, are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.cast(pa.float64())
    with np.errstate(invalid="ignore", over="ignore"):
        steps = np.floor(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False) * scale)
        good = np.abs(steps) < 2.0**61
    bad = np.concatenate([[0], np.cumsum(~good)])
    lengths = np.diff(offsets)
    fine = (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0)
    if column.null_count:
        fine &= ~column.is_null().to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths[fine]).tolist():
        rows = np.flatnonzero(fine & (lengths == dims))
        for lo in range(0, len(rows), CHUNK):
            some = rows[lo:lo + CHUNK]
            yield some, steps[offsets[some][:, None] + np.arange(dims)].astype(np.int64)


def _coded(steps: np.ndarray) -> list[bytes]:
    """One byte string per vector, equal exactly for equal vectors: two bytes an entry if all its
    entries fit, else eight."""
    short = (np.abs(steps) < 2**15).all(axis=1)
    two, eight = steps.astype("<i2"), steps.astype("<i8")
    return [(two if s else eight)[i].tobytes() for i, s in enumerate(short)]


def _decoded(keys: pa.Array, dims: int, shift: int) -> Iterator[np.ndarray]:
    found = keys.to_pylist()
    for kind, width in (("<i2", 2), ("<i8", 8)):
        some = [k for k in found if len(k) == width * dims]
        for lo in range(0, len(some), CHUNK):
            yield np.frombuffer(b"".join(some[lo:lo + CHUNK]), kind).reshape(-1, dims).astype(np.int64) + shift


def distinct_vectors(vectors: DataFrame, embedding: str, scale: int = SCALE) -> DataFrame:
    """Each vector of the grid once: `dims` and `key`. Equal rows are merged before the shuffle."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, steps in _grid(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array([steps.shape[1]] * len(steps), pa.int32()), pa.array(_coded(steps), pa.binary())], ["dims", "key"])

    return vectors.select(F.col(embedding).cast("array<double>")).mapInArrow(read, "dims int, key binary").distinct()


def exact_sums(keys: DataFrame, dims: int, shift: int, parts: Callable[[np.ndarray], np.ndarray]) -> dict[int, int]:
    """Sum over all vectors of the whole numbers `parts` gives per chunk, by their place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _decoded(batch.column(0), dims, shift):
                add = parts(x).astype(object)
                total = add if total is None else total + add
        if total is None:
            return
        slots, digits, values = [], [], []
        for slot, value in enumerate(total):
            sign, rest, digit = (-1 if value < 0 else 1), abs(int(value)), 0
            while rest or not digit:
                slots.append(slot)
                digits.append(digit)
                values.append(sign * (rest & ((1 << DIGIT_BITS) - 1)))
                rest, digit = rest >> DIGIT_BITS, digit + 1
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(digits, pa.int32()), pa.array(values, pa.int64())], ["slot", "digit", "value"])

    rows = keys.select("key").mapInArrow(read, "slot int, digit int, value long").groupBy("slot", "digit").agg(F.sum("value").alias("value"))
    out: dict[int, int] = {}
    for r in rows.collect():
        out[r.slot] = out.get(r.slot, 0) + (r.value << (DIGIT_BITS * r.digit))
    return out


def pair_squares(low: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of squares of every centred dimension and of every sum of two, row by row of the
    upper triangle."""

    def squares(x: np.ndarray) -> np.ndarray:
        d = _minus(x, low)
        if int(abs(d).max(initial=0)) >= 2**24:  # 2048 * (2 * 2^24)^2 = 2^61
            d = d.astype(object)
        out = []
        for i in range(d.shape[1]):
            both = d[:, i:] + d[:, i:i + 1]
            both[:, 0] = d[:, i]
            out.append((both * both).sum(axis=0))
        return np.concatenate(out)

    return squares


def fit(vectors: DataFrame, embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors, by falling eigenvalue; None without a vector.

    Vectors of other lengths than the most frequent one (of several, the longest) say nothing.
    """
    every = write_once(distinct_vectors(vectors, embedding, scale), "vectors")
    counted = [(r["count"], r.dims) for r in every.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()]
    if not counted:
        return None
    n, dims = counted[0]
    keys = every.filter(F.col("dims") == dims)
    sums = exact_sums(keys, dims, shift, lambda x: x.sum(axis=0) if int(abs(x).max(initial=0)) < 2**50 else x.astype(object).sum(axis=0))
    low = np.array([sums[i] // n for i in range(dims)], object)
    rest = np.array([sums[i] % n for i in range(dims)], object)
    squares = exact_sums(keys, dims, shift, pair_squares(low))

    def spread(total: int, beyond: int) -> int:
        return n * total - beyond**2  # n^2 times the variance

    own, place = {}, 0
    for i in range(dims):
        own[i] = spread(squares[place], rest[i])
        place += dims - i
    covariance, place = np.zeros((dims, dims)), 0
    for i in range(dims):
        covariance[i, i] = own[i] / n**2
        for j in range(i + 1, dims):
            both = spread(squares[place + j - i], rest[i] + rest[j])
            covariance[i, j] = covariance[j, i] = (both - own[i] - own[j]) / (2 * n**2)
        place += dims - i
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    use = int((values[:components] > LEAST_SHARE * max(values[0], 0)).sum()) if values[0] > 0 else 0
    values, axes = values[:use], axes[:, :use]
    if use:
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(use)])
    model = Whitening(n, low, rest, covariance, axes, values, values / max(np.trace(covariance), 1e-300))
    model.identity_error = identity_error(keys, dims, shift, model) if use else 0.0
    return model


def identity_error(keys: DataFrame, dims: int, shift: int, model: Whitening) -> float:
    """Largest absolute entry of the measured covariance of the whitened vectors minus the identity."""
    size = len(model.values)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            for x in _decoded(batch.column(0), dims, shift):
                z = model.whitened(x)
                total += np.concatenate([z.T @ z, z.sum(axis=0, keepdims=True)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["slot", "value"])

    rows = keys.select("key").mapInArrow(read, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((size + 1) * size)
    for r in rows:
        total[r.slot] = r.value
    mean = total.reshape(size + 1, size) / model.n
    return round(float(np.abs(mean[:size] - np.outer(mean[size], mean[size]) - np.eye(size)).max()), 12)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """Per vector row and component (1 to at most `components`): vec_id, component, n (distinct
    vectors), deviation, whitened, explained and identity_error.

    Left out are null and empty vectors, those with an entry that is null, not finite or beyond
    64 bits on the grid, and those of another length than the most frequent. Repeated rows count
    once in the fit and are returned each; a null vec_id stays null; other columns are not read. A
    deviation beyond 64 bits is null. Directions without spread are not returned, so a table
    of one distinct vector, or an empty one, gives no rows. Signs are fixed by making each component's
    largest entry positive.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, embedding, scale, shift, components)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    size, dims = len(model.values), len(model.low)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, steps in _grid(batch.column(1), scale):
                if steps.shape[1] != dims:
                    continue
                x, m = steps + shift, len(steps)
                deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), size)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, size))), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * size, model.n)), deviation, pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * size, model.identity_error))], [f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(read, schema)
