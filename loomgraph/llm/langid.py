"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads segments of SEGMENT bytes in both directions, gives every byte position a distribution over
the learned languages, and a document's distribution is the mean over all of its positions, to its last byte.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when there is nothing to
learn from.  Rows without a language are never learned from.  Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh_worker, hash_sample, result_schema, shipped, slices

#: Bytes that the network reads in one go; its state starts anew after them.
SEGMENT = 64
#: Segments that are computed together.
BLOCK = 4096
#: Bytes of text that are judged together.
CHUNK = 8_000_000
#: The symbol behind the end of a text; it leaves the state as it is.
PAD = 256
UNDETERMINED = "und"


def _bend(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the network's squashing function, some ten times cheaper here than tanh."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


@dataclass
class ByteGRU:
    """Weights by gate (update, reset, candidate) and direction: inputs (3, 2, 257, H), recurrent (3, 2, H, H); output (2, H, C), bias (C)."""

    languages: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> ByteGRU:
        f = lambda *shape: (rng.standard_normal(shape) * 0.4).astype(np.float32)
        net = cls(languages, f(3, 2, PAD + 1, hidden), f(3, 2, hidden, hidden), f(2, hidden, len(languages)), np.zeros(len(languages), np.float32))
        net._pad()
        return net

    def _pad(self) -> None:
        self.inputs[:, :, PAD] = 0
        self.inputs[0, :, PAD] = 1e9  # the update gate is 1: padding keeps the state

    @staticmethod
    def _symbols(x: np.ndarray) -> np.ndarray:
        """Rows of the flattened input table for x (T, B): (T, 3, 2, B); the second direction runs over reversed time."""
        both = np.stack([x, x[::-1] + (PAD + 1)], axis=1)
        return both[:, None] + (2 * (PAD + 1) * np.arange(3))[None, :, None, None]

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: symbols (T, B). The states (T, 2, B, H). keep: gets what learning needs."""
        t, b = x.shape
        hidden = self.recurrent.shape[3]
        table, rows = self.inputs.reshape(-1, hidden), self._symbols(x)
        out = np.empty((t, 2, b, hidden), np.float32)
        h = np.zeros((2, b, hidden), np.float32)
        for i in range(t):
            a = table.take(rows[i], axis=0)
            g = np.matmul(h, self.recurrent)
            zr = a[:2]
            zr += g[:2]
            _bend(zr)
            zr += 1
            zr *= 0.5
            n = zr[1] * g[2]
            n += a[2]
            _bend(n)
            if keep is not None:
                keep.append((h, zr[0], zr[1], g[2], n))
            h = h - n
            h *= zr[0]
            h += n
            out[i] = h
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, C) of each language at each position."""
        return self._softmax(self.states(x))

    def _softmax(self, s: np.ndarray) -> np.ndarray:
        p = np.matmul(s[:, 0], self.output[0])
        p += np.matmul(s[::-1, 1], self.output[1])
        p += self.bias
        np.clip(p, -30, 30, out=p)
        np.exp(p, out=p)
        p /= np.matmul(p, np.ones((p.shape[2], p.shape[2]), np.float32))  # the sum over languages, a short axis
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time of the mean cross entropy over all positions of x (T, B) that aren't padding; y: (B)."""
        kept: list = []
        s = self.states(x, kept)
        p = self._softmax(s)
        t, b, _ = p.shape
        p[:, np.arange(b), y] -= 1
        p *= ((x != PAD) / max(1, (x != PAD).sum()))[:, :, None]
        grads = [np.zeros_like(w) for w in (self.inputs, self.recurrent, self.output, self.bias)]
        hidden = s.shape[3]
        grads[2][0] = np.tensordot(s[:, 0], p, axes=([0, 1], [0, 1]))
        grads[2][1] = np.tensordot(s[::-1, 1], p, axes=([0, 1], [0, 1]))
        grads[3][:] = p.sum(axis=(0, 1))
        down = np.stack([np.matmul(p, self.output[0].T), np.matmul(p[::-1], self.output[1].T)], axis=1)
        d_in = np.empty((t, 3, 2, b, hidden), np.float32)
        back = self.recurrent.transpose(0, 1, 3, 2)
        dh = np.zeros((2, b, hidden), np.float32)
        slope = lambda v: (1 - np.abs(v)) ** 2  # noqa: E731  of the squashing function, by its value
        for i in range(t - 1, -1, -1):
            h, z, r, gn, n = kept[i]
            dh = dh + down[i]
            dn = dh * (1 - z) * slope(n)
            d = d_in[i]
            d[0] = dh * (h - n) * slope(2 * z - 1) * 0.5
            d[1] = dn * gn * slope(2 * r - 1) * 0.5
            d[2] = dn
            dg = d.copy()
            dg[2] *= r
            grads[1] += np.matmul(h.transpose(0, 2, 1), dg)
            dh = dh * z + np.matmul(dg, back).sum(axis=0)
        np.add.at(grads[0].reshape(-1, hidden), self._symbols(x).reshape(-1), d_in.reshape(-1, hidden))
        grads[0][:, :, PAD] = 0
        return grads


def train(texts: list[bytes], languages: list[str], hidden: int = 6, steps: int = 200, batch: int = 128, rate: float = 0.04, seed: int = 7) -> ByteGRU | None:
    """A network from texts and their languages, by Adam on random segments, each language drawn equally often; None without texts."""
    names = sorted(set(languages))
    known = [(t, names.index(k)) for t, k in zip(texts, languages, strict=True) if t]
    if not known:
        return None
    rng = np.random.default_rng(seed)
    net = ByteGRU.new(names, hidden, rng)
    weights = [net.inputs, net.recurrent, net.output, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    data = [np.frombuffer(t, np.uint8) for t, _ in known]
    by = [np.array([i for i, (_, k) in enumerate(known) if k == c], dtype=np.int64) for c in range(len(names))]
    by = [rows for rows in by if len(rows)]
    for step in range(1, steps + 1):
        picked = np.concatenate([rng.choice(by[c], size=1) for c in rng.integers(0, len(by), batch)])
        x = np.full((SEGMENT, batch), PAD, np.int64)
        for j, i in enumerate(picked):
            at = int(rng.integers(0, max(1, len(data[i]) - SEGMENT + 1)))
            part = data[i][at : at + SEGMENT]
            x[: len(part), j] = part
        grads = net.gradients(x, np.array([known[i][1] for i in picked]))
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        lr = rate * (1 - step / (steps + 1))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g *= min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        net._pad()
    return net


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts data[starts[i]:ends[i]]: the document and the first byte of each of their segments."""
    count = -(-(ends - starts) // SEGMENT)
    doc = np.repeat(np.arange(len(starts)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, starts[doc] + within * SEGMENT


def pooled(net: ByteGRU, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean probabilities (documents, languages) over all positions of each text; zeros for an empty one."""
    doc, first = segments(data, starts, ends)
    sums = np.zeros((len(starts), len(net.languages)))
    step = np.arange(SEGMENT)[:, None]
    for at in range(0, len(doc), BLOCK):
        d, f = doc[at : at + BLOCK], first[at : at + BLOCK]
        index = f[None, :] + step
        inside = index < ends[d][None, :]
        x = np.where(inside, data[np.minimum(index, len(data) - 1)].astype(np.int64), PAD)
        p = net.positions(x)
        p *= inside[:, :, None]
        np.add.at(sums, d, p.sum(axis=0))
    return sums / np.maximum(1, ends - starts)[:, None]


def learn(docs: DataFrame, usable: Callable | None = None, text: str = "text", lang: str = "lang", id_col: str = "doc_id", most_rows: int = 1500, most_chars: int = 512, **options) -> ByteGRU | None:
    """Fits the network on a bounded sample: of the rows with a language (and where ``usable`` holds) the most_rows ones of the
    smallest hash, most_chars characters of each from a place that the hash chooses. Only training is bounded; every text is classified whole."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    h = F.xxhash64(F.col(id_col).cast("string"))
    start = F.lit(1) + F.pmod(h, F.greatest(F.lit(1), F.length(text) - F.lit(most_chars))).cast("int")
    sample = rows.select(F.col(id_col).alias("id"), F.substring(F.col(text), start, F.lit(most_chars)).alias("t"), F.col(lang).cast("string").alias("l"))
    got = hash_sample(sample, most_rows)
    return train([r["t"].encode() for r in got], [r["l"] for r in got], **options)


def classify(docs: DataFrame, net: ByteGRU | None, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language and its pooled probability for each whole text."""
    flag = "__lg_letter"
    marked = docs.withColumn(flag, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = result_schema(docs, f"`{prediction}` string, `{score}` double")
    weights = shipped(docs.sparkSession, net)  # some 100 kB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        model = weights()
        names = schema.names
        for batch in (part for whole in batches for part in slices(whole, text, CHUNK)):
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            n = len(column)
            _, offsets, data = column.buffers()
            letter = batch.column(batch.schema.get_field_index(flag)).to_numpy(zero_copy_only=False).astype(bool)
            best, value = np.full(n, -1), np.zeros(n)
            if model is not None and n and data is not None and data.size:
                ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
                starts, stops = ends[:-1], np.where(letter, ends[1:], ends[:-1])
                p = pooled(model, np.frombuffer(data, np.uint8), starts, stops)
                best = np.where(letter, p.argmax(axis=1), -1)
                value = np.where(letter, p.max(axis=1), 0.0).clip(0, 1)
            langs = [UNDETERMINED if k < 0 else model.languages[k] for k in best]
            new = {prediction: pa.array(langs, pa.string()), score: pa.array(value, pa.float64())}
            yield pa.RecordBatch.from_arrays([new[k] if k in new else batch.column(batch.schema.get_field_index(k)) for k in names], names=names)

    return marked.mapInArrow(run, schema)
