"""Quality rules: a linear-chain conditional random field labels each line of a text as content or boilerplate.

The field is trained in numpy (forward-backward, Adam) on a bounded sample: whole labelled documents (2000 at most), cut into runs of
60 lines from the first line to the last, of which 4000 at most count; all lines take their document's quality as label; Viterbi decoding then labels every line of every whole text, and the share of words
in content lines decides retention.  Plain rules on counts come first.

Cases: a null or empty text has no word and fails the base rules; lines without a word take part in the chain but not in
the share; without labelled documents of both kinds there is no field and the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh_worker, hash_sample, result_schema, shipped, slices, staged, text_bytes
from loomgraph.llm.repeats import Words

REPEAT = 5
#: Base rules: fewest words, and most words in repeated windows, in per cent.
LEAST_WORDS, MOST_REPEATED = 10, 20
LEAST_CONTENT = 0.5
#: Bounds of the training sample: documents, and runs of lines of them; lines of a run.
SAMPLE, SAMPLE_RUNS, RUN = 2000, 4000, 60
CHUNK = 6_000_000

_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_UPPER, _DIGITS, _STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?"
N_FEATURES = 17


def line_features(text: bytes) -> tuple[list[list[float]], list[int], int]:
    """Features and words of each line, and how many lines with a word equal an earlier one."""
    rows, words, seen, repeated = [], [], set(), 0
    for line in text.split(b"\n"):
        w = line.split()
        n = len(w)
        size = max(1, len(line))
        again = n > 0 and line in seen
        if n and not again:
            seen.add(line)
        repeated += again
        symbols = len(line) - len(line.translate(None, _SYMBOLS))
        upper = len(line) - len(line.translate(None, _UPPER))
        digits = len(line) - len(line.translate(None, _DIGITS))
        stops = len(line) - len(line.translate(None, _STOPS))
        mean = (size - n) / n if n else 0.0
        rows.append(
            [
                1.0,
                n == 0,
                0 < n < 3,
                2 < n < 8,
                7 < n < 25,
                n > 24,
                symbols > 0,
                symbols * 20 > size,
                upper * 2 > size,
                min(1.0, upper / size * 5),
                min(1.0, digits / size * 5),
                min(1.0, stops / max(1, n)),
                b"!!" in line,
                b"|" in line,
                mean > 9,
                again,
                line.rstrip()[-1:] in (b".", b"!", b"?"),
            ]
        )
        words.append(n)
    return rows, words, repeated


@dataclass
class LineField:
    """Weights of the features for each label (0: boilerplate, 1: content), and of label pairs."""

    emit: np.ndarray
    step: np.ndarray

    def decode(self, scores: list[list[float]]) -> list[int]:
        """The most likely labels for the emission scores of a text's lines; of equal ways the one ending in content."""
        (s00, s01), (s10, s11) = self.step.tolist()
        back, (a, b) = [], scores[0]
        for x, y in scores[1:]:
            from0, from1 = a + s00 > b + s10, a + s01 > b + s11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + s00 if from0 else b + s10) + x, (a + s01 if from1 else b + s11) + y
        label = 0 if a > b else 1
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def runs(rows: list[list[float]]) -> list[np.ndarray]:
    """All lines of a text's features, cut into runs of RUN lines; what is left at the end is a run of its own."""
    return [np.array(rows[i : i + RUN], np.float32) for i in range(0, len(rows), RUN)]


def fit(texts: list[bytes], labels: list[int], steps: int = 120, rate: float = 0.1) -> LineField | None:
    """Trains on whole texts of which each line has the text's label."""
    cut = [(r, y) for t, y in zip(texts, labels, strict=True) for r in runs(line_features(t)[0])]
    return fit_lines([r for r, _ in cut], [y for _, y in cut], steps, rate)


def fit_lines(feats: list[np.ndarray], labels: list[int], steps: int = 120, rate: float = 0.1) -> LineField | None:
    """Trains on the features of the lines of texts, each with its text's label; the two labels weigh the same. None unless both occur."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    count = np.array([len(f) for f in feats])
    t_max = int(count.max())
    x = np.zeros((t_max, len(feats), N_FEATURES))
    for i, f in enumerate(feats):
        x[: len(f), i] = f
    inside = np.arange(t_max)[:, None] < count[None, :]
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) / count
    emit, step = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    first, second = np.zeros(emit.size + 4), np.zeros(emit.size + 4)
    truth = np.stack([y == 0, y == 1], axis=1).astype(float)
    pairs = np.einsum("tb,bi,bj,b->ij", inside[1:].astype(float), truth, truth, weight)
    seen = np.einsum("tbf,bc,b->fc", x, truth, weight)
    for k in range(1, steps + 1):
        e = np.exp(np.clip(x @ emit, -30, 30))
        m = np.exp(step)
        # scaled forward and backward passes; behind a text's last line nothing changes
        alpha, beta, scale = np.zeros((t_max, len(y), 2)), np.ones((t_max, len(y), 2)), np.ones((t_max, len(y)))
        for t in range(t_max):
            a = e[t] * (alpha[t - 1] @ m if t else 1.0)
            scale[t] = np.where(inside[t], a.sum(axis=1), 1.0)
            alpha[t] = np.where(inside[t][:, None], a / scale[t][:, None], alpha[t - 1] if t else a)
        for t in range(t_max - 2, -1, -1):
            b = ((e[t + 1] * beta[t + 1]) @ m.T) / scale[t + 1][:, None]
            beta[t] = np.where(inside[t + 1][:, None], b, 1.0)
        node = alpha * beta
        node /= node.sum(axis=2, keepdims=True)
        node *= (inside * weight)[:, :, None]
        edge = np.einsum("tbi,tbj,tb->ij", alpha[:-1], e[1:] * beta[1:] / scale[1:, :, None], inside[1:] * weight) * m
        g = np.concatenate([(seen - np.einsum("tbf,tbc->fc", x, node) - 1e-4 * emit).ravel(), (pairs - edge - 1e-4 * step).ravel()])
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        move = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        emit += move[:-4].reshape(emit.shape)
        step += move[-4:].reshape(2, 2)
    return LineField(emit, step)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = SAMPLE, most_runs: int = SAMPLE_RUNS) -> LineField | None:
    """Fits the field on a bounded sample: the whole texts of ``sample`` labelled documents at most, those of the smallest hash, cut into runs of lines;
    where these are more than most_runs, those of the smallest hash, wherever in a text they stand."""
    spark = docs.sparkSession
    named = labels.where(F.col(quality).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(quality).cast("int").alias("y"))
    known = spark.createDataFrame(hash_sample(named, sample), named.schema)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(F.broadcast(known), "id")  # sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for whole in batches:
            for b in slices(whole, "t", CHUNK):
                t, y = text_bytes(b.column(b.schema.get_field_index("t"))), b.column(b.schema.get_field_index("y")).to_pylist()
                found = [(k, r.tobytes()) for x, k in zip(t, y, strict=True) for r in runs(line_features(x)[0])]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([r for _, r in found], pa.binary())], names=["y", "lines"])

    got = hash_sample(staged(rows.select("t", "y").mapInArrow(run, "y int, lines binary"), "runs"), most_runs)  # some kB a row
    return fit_lines([np.frombuffer(r["lines"], np.float32).reshape(-1, N_FEATURES) for r in got], [int(r["y"] > 0) for r in got])


def repeat_words(words: Words, size: int = REPEAT) -> np.ndarray:
    """For each text the words inside runs of size words that it has twice or more."""
    n = words.n - size + 1
    out = np.zeros(len(words.count), np.int64)
    if n <= 0:
        return out
    has = np.flatnonzero(words.count)
    doc = np.repeat(has, words.count[has])
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    hi, lo, own = words.rolling(0, size, at), words.rolling(1, size, at), doc[at]
    order = np.argsort(hi + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    hi, lo, own = hi[order], lo[order], own[order]
    same = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1]) & (own[1:] == own[:-1])
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    change = np.zeros(words.n + 1, np.int64)
    place = at[order[twice]]
    np.add.at(change, place, 1)
    np.add.at(change, place + size, -1)
    covered = np.cumsum(change[:-1]) > 0
    out[has] = np.add.reduceat(covered, words.start[has], dtype=np.int64)
    return out


_ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(docs: DataFrame, field: LineField | None, text: str = "text", least_content: float = LEAST_CONTENT) -> DataFrame:
    """docs with, in place of the text, its counts, base_failed, the share of words in content lines (null without a field) and kept."""
    schema = result_schema(docs.drop(text), _ADDED)
    weights = shipped(docs.sparkSession, field)  # some forty numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        model: LineField | None = weights()
        for whole in batches:
            for batch in slices(whole, text, CHUNK):
                texts = text_bytes(batch.column(batch.schema.get_field_index(text)))
                words = Words(texts)
                n, again = words.count, repeat_words(words)
                chars = [len(t.translate(None, _SPACE).decode()) for t in texts]
                symbols = [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts]
                dups, share = [], []
                for t in texts:
                    rows, count, repeated = line_features(t)
                    dups.append(repeated)
                    total = sum(count)
                    if model is None or not total:
                        share.append(None)
                        continue
                    labels = model.decode((np.array(rows) @ model.emit).tolist())
                    share.append(sum(c for c, k in zip(count, labels, strict=True) if k) / total)
                failed = (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)
                kept = [not f and (s is None or s >= least_content) for f, s in zip(failed.tolist(), share, strict=True)]
                new = {
                    "n_words": pa.array(n),
                    "word_chars": pa.array(chars, pa.int64()),
                    "n_symbols": pa.array(symbols, pa.int64()),
                    "n_dup_lines": pa.array(dups, pa.int64()),
                    "n_repeat_words": pa.array(again),
                    "base_failed": pa.array(failed),
                    "kept": pa.array(kept, pa.bool_()),
                    "content_share": pa.array(share, pa.float64()),
                }
                yield pa.RecordBatch.from_arrays([new[k] if k in new else batch.column(batch.schema.get_field_index(k)) for k in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)
