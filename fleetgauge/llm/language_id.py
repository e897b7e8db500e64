"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads windows of bytes in both directions, labels every position, and the position
probabilities of a whole text are averaged. It is trained here, in numpy, by backpropagation
through time on a bounded sample of labelled texts; a trained network is some tens of kilobytes.
Texts are read whole: a document is all its windows, and tasks work on many windows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.bytewise import buffers, pieces

#: Labelled texts per language used for training, and characters of each: the bound of the sample.
SAMPLE_TEXTS, SAMPLE_CHARS = 200, 2000
UNITS, STEPS, BATCH, TRAIN_WINDOW, RATE = 8, 240, 96, 48, 0.02
#: Bytes per window when labelling, and windows worked on together.
WINDOW, TOGETHER = 128, 4096
UNDETERMINED = "und"


def _tanh(x: np.ndarray) -> np.ndarray:
    """Hyperbolic tangent by a continued fraction, within 0.01 and several times as fast."""
    a = x * x
    top = a + 105
    top *= a
    top += 945
    top *= x
    a *= 15 * a + 420
    a += 945
    top /= a
    return np.clip(top, -1, 1, out=top)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    x = _tanh(x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Direction:
    """One gated recurrent layer. Per gate (update, reset, candidate): a table of inputs by byte
    and recurrent weights; and the output weights. The reset gate acts on what the candidate
    gets from the state before."""

    tables: list[np.ndarray]
    weights: list[np.ndarray]
    out: np.ndarray

    @classmethod
    def fresh(cls, units: int, classes: int, rng: np.random.Generator) -> Direction:
        def random(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.3).astype(np.float32)

        return cls([random(256, units) for _ in range(3)], [random(units, units) for _ in range(3)], random(units, classes))

    def arrays(self) -> list[np.ndarray]:
        return [*self.tables, *self.weights, self.out]

    def run(self, x: np.ndarray, valid: np.ndarray | None = None, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each row of `x` (steps by windows); `valid` marks steps that count."""
        units = self.out.shape[0]
        h = np.zeros((x.shape[1], units), np.float32)
        states, kept = np.empty((*x.shape, units), np.float32), []
        for t in range(len(x)):
            z, r, n = (table.take(x[t], axis=0) for table in self.tables)
            z += h @ self.weights[0]
            r += h @ self.weights[1]
            inner = h @ self.weights[2]
            z, r = _sigmoid(z), _sigmoid(r)
            n += r * inner
            n = _tanh(n)
            new = h - n
            new *= z
            new += n
            if valid is not None and not valid[t].all():
                new = np.where(valid[t][:, None], new, h)
            if keep:
                kept.append((h, z, r, inner, n))
            h = states[t] = new
        return states, kept

    def learn(self, x: np.ndarray, kept: list, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of tables and weights, backwards through time."""
        d_tables, d_weights = [np.zeros_like(a) for a in self.tables], [np.zeros_like(a) for a in self.weights]
        carry = np.zeros_like(d_states[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, inner, n = kept[t]
            d = d_states[t] + carry
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (h - n) * z * (1 - z)
            d_r = d_n * inner * r * (1 - r)
            carry = d * z
            for k, (d_input, d_product) in enumerate(((d_z, d_z), (d_r, d_r), (d_n, d_n * r))):
                np.add.at(d_tables[k], x[t], d_input)
                d_weights[k] += h.T @ d_product
                carry += d_product @ self.weights[k].T
        return [*d_tables, *d_weights]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    back: Direction
    bias: np.ndarray

    def positions(self, x: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
        """Class probabilities at every step of every window."""
        there, _ = self.ahead.run(x, valid)
        again, _ = self.back.run(x[::-1], None if valid is None else valid[::-1])
        return _softmax(there @ self.ahead.out + again[::-1] @ self.back.out + self.bias)

    def documents(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Mean position probabilities of each row; a row without bytes has zeros."""
        lengths = np.diff(offsets)
        per = -(-lengths // window)
        row = np.repeat(np.arange(len(lengths)), per)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        start = offsets[:-1][row] + nth * window
        size = np.minimum(window, offsets[1:][row] - start)
        out = np.zeros((len(lengths), len(self.languages)))
        order = np.argsort(-size, kind="stable")  # full windows first, so few are masked
        steps = np.arange(window)[:, None]
        for lo in range(0, len(order), TOGETHER):
            pick = order[lo:lo + TOGETHER]
            n = int(size[pick[0]])
            at = start[pick][None, :] + steps[:n]
            valid = steps[:n] < size[pick][None, :]
            whole = bool(valid.all())
            chance = self.positions(data[np.minimum(at, len(data) - 1)], None if whole else valid)
            total = chance.sum(axis=0) if whole else (chance * valid[:, :, None]).sum(axis=0)
            np.add.at(out, row[pick], total)
        return out / np.maximum(lengths, 1)[:, None]


def train(samples: dict[str, list[bytes]], units: int = UNITS, steps: int = STEPS, batch: int = BATCH, window: int = TRAIN_WINDOW, rate: float = RATE, seed: int = 7) -> Network:
    """A network for the languages of `samples`, by Adam on windows drawn evenly over languages."""
    languages = sorted(samples)
    rng = np.random.default_rng(seed)
    net = Network(languages, Direction.fresh(units, len(languages), rng), Direction.fresh(units, len(languages), rng), np.zeros(len(languages), np.float32))
    texts = [np.frombuffer(b"".join(t if len(t) >= window else t + b" " * (window - len(t)) for t in samples[k]), np.uint8) for k in languages]
    params = [*net.ahead.arrays(), *net.back.arrays(), net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(languages), batch)
        begin = [rng.integers(0, len(texts[k]) - window + 1) for k in label]
        x = np.stack([texts[k][b:b + window] for k, b in zip(label, begin, strict=True)], axis=1)
        there, kept = net.ahead.run(x, keep=True)
        again, kept_back = net.back.run(x[::-1], keep=True)
        again_here = again[::-1]
        error = _softmax(there @ net.ahead.out + again_here @ net.back.out + net.bias)
        error[:, np.arange(batch), label] -= 1
        error /= window * batch
        flat = error.reshape(-1, len(languages))
        grads = [*net.ahead.learn(x, kept, error @ net.ahead.out.T), there.reshape(len(flat), -1).T @ flat,
                 *net.back.learn(x[::-1], kept_back, (error @ net.back.out.T)[::-1]), again_here.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)]
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept from training: remainder of the CRC of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, doc_id: str, text: str, lang: str, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> Network | None:
    """Train on at most `texts` texts per language and `chars` characters of each, picked by hash
    of id and text; None if nothing is labelled. The sample is all that comes to the driver."""
    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(doc_id)))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id), F.lit(1)).alias("o")).filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("text", F.substring("text", 1, chars))
    best = rows.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))).filter(F.col("rn") <= texts)
    samples: dict[str, list[bytes]] = {}
    for r in sorted(best.select("lang", "o", "text").collect()):
        samples.setdefault(r.lang, []).append(r.text.encode())
    return train(samples) if samples else None


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred and score (mean probability, 0 to 1).

    `und` with score 0 for a null text, one without a letter, or if nothing is labelled. A
    document without an id is neither held out nor learned from. Only the text is looked at to
    predict. Repeated rows are predicted each; other columns are not read.
    """
    net = learn(docs, doc_id, text, lang, texts, chars)
    value = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.when(value.rlike(r"\p{L}"), value).alias("text"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            best, score = [], []
            for lo, hi in pieces(offsets):
                chance = net.documents(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                top = chance.argmax(axis=1)
                best += [net.languages[k] if size else UNDETERMINED for k, size in zip(top, np.diff(offsets[lo:hi + 1]), strict=True)]
                score += np.clip(chance[np.arange(hi - lo), top], 0.0, 1.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")
