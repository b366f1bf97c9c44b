"""Substring dedup: a count-min prefilter over windows of words, then exact grouping of what it estimates repeated.

First pass: each partition keeps a sketch of its windows, saturating at two; the merged sketches overestimate every
window's count.  A window enters by its minimizer, the least hash among its inner runs of words: equal windows have equal
minimizers at different places, so counting the places where a minimizer stands never falls below a window's count, with
about a tenth of the entries.  Second pass: windows whose minimizer may be there twice, and no others, are grouped
exactly by a 128-bit digest of their words; so none is lost, and what the sketch let through by collision drops out.

The sketch has as many cells as the text asks for, up to MOST_CELLS in each of its rows; beyond that it lets more
windows through to the exact pass, which costs time but no result.  Its bits are all that is broadcast (128 MB at most).
A window that many texts share leaves each task once: what repeats within a task is settled there.

Cases: a null text has no word; a text shorter than a window has no window; rows with equal text repeat each other;
a window repeated within its own text, overlapping itself or not, counts as repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh_worker, frequent, join_spread, result_schema, slices, text_bytes, text_size

WINDOW = 35
#: Cells of a row of the sketch: the least, and the most.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 29
#: Rows of the sketch.
DEPTH = 2
#: Cells in one slice of a row; slices are merged apart.
SLICE = 1 << 21
#: Entries that a task holds before it hands them on.
HOLD = 1_000_000
#: Bytes of text that are hashed together, and bytes of text for each shard of the exact grouping.
CHUNK, SHARD_BYTES = 4_000_000, 16_000_000

#: Fixed odd multipliers: of the two rolling hashes, and of the rows of the sketch.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROWS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Words:
    """The word hashes of some texts in one row, and rolling hashes over them."""

    def __init__(self, texts: list[bytes]) -> None:
        digest = xxhash.xxh3_128_digest
        parts, counts = [], []
        for t in texts:
            words = t.split()  # bytes: at 0x20 and 0x09 to 0x0D
            parts.append(b"".join(map(digest, words)))
            counts.append(len(words))
        self.count = np.array(counts, np.int64)
        self.start = np.cumsum(self.count) - self.count
        hashes = np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)
        self.n = len(hashes)
        size = 1 << max(12, int(self.n).bit_length())
        self.sums, self.inverse = [], []
        for k, base in enumerate(BASES):
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, k] * _powers(base, size)[: self.n], dtype=np.uint64)]))
            self.inverse.append(_powers(pow(base, -1, 1 << 64), size))

    def rolling(self, k: int, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """The k-th hash of every run of length words (or of those that begin at the places at)."""
        s, inv = self.sums[k], self.inverse[k]
        if at is not None:
            return (s[at + length] - s[at]) * inv[at]
        n = self.n - length + 1
        return (s[length:] - s[:-length]) * inv[:n] if n > 0 else np.zeros(0, np.uint64)

    def minimizers(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows, their minimizers, and the minimizers of all places where one stands."""
        none = np.zeros(0, np.uint64)
        if self.n < window:
            return np.zeros(0, np.int64), none, none
        gram = window // 2 + 1
        wide = window - gram + 1
        a = self.rolling(0, gram)
        a ^= a >> np.uint64(29)
        a *= np.uint64(ROWS[0])
        a |= np.uint64(1)  # 0 marks what is no window
        least = _sliding(np.minimum, a, wide)
        inside = np.zeros(len(least), bool)
        for s, c in zip(self.start.tolist(), self.count.tolist(), strict=True):
            if c >= window:
                inside[s : s + c - window + 1] = True
        pad = np.zeros(wide - 1, np.uint64)
        above = _sliding(np.maximum, np.concatenate([pad, np.where(inside, least, np.uint64(0)), pad]), wide)
        at = np.flatnonzero(inside)
        return at, least[at], a[a == above]


def _sliding(f: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """f over each width neighbours."""
    n, done = len(a) - width + 1, 1
    while done * 2 <= width:
        a = f(a[:-done], a[done:])
        done *= 2
    return f(a[:n], a[width - done : width - done + n])


def cells_of(v: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each minimizer in one row of the sketch."""
    h = v ^ (v >> np.uint64(32))
    h *= np.uint64(ROWS[row])
    h ^= h >> np.uint64(31)
    h *= np.uint64(BASES[1 - row])
    return h >> np.uint64(64 - (cells.bit_length() - 1))


def _sketch_rows(values: list[np.ndarray], cells: int) -> pa.RecordBatch:
    """One partition sketch, sparse: for each slice the cells counted once, and those counted twice or more."""
    v = np.concatenate(values)
    width = min(SLICE, cells)
    out: list[tuple[int, bytes, bytes]] = []
    for row in range(DEPTH):
        cell, n = np.unique(cells_of(v, row, cells), return_counts=True)
        part = (cell // np.uint64(width)).astype(np.int64)
        cut = np.searchsorted(part, np.arange(cells // width + 1))
        within = (cell % np.uint64(width)).astype(np.uint32)
        for k in range(cells // width):
            c, m = within[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]
            if len(c):
                out.append((row * (cells // width) + k, c[m == 1].tobytes(), c[m > 1].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["slice", "once", "more"])


def sketch(docs: DataFrame, cells: int, text: str = "text", window: int = WINDOW) -> np.ndarray:
    """The merged sketch as bits (DEPTH, cells / 8): set where a cell counts two or more."""
    width = min(SLICE, cells)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in slices(batch, text, CHUNK):
                found = Words(text_bytes(part.column(0))).minimizers(window)[2]
                held.append(found)
                size += len(found)
                if size >= HOLD:
                    yield _sketch_rows(held, cells)
                    held, size = [], 0
        if size:
            yield _sketch_rows(held, cells)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(width, np.uint8)
        for b in batches:
            for once, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                i = np.frombuffer(once, np.uint32)
                count[i] = np.minimum(count[i] + 1, 2)
                count[np.frombuffer(more, np.uint32)] = 2
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], names=["slice", "bits"])

    merge.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    merged = docs.select(text).mapInArrow(partial, "slice int, once binary, more binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary")
    bits = np.zeros((DEPTH * (cells // width), max(1, width // 8)), np.uint8)
    for r in merged.toLocalIterator():  # a bounded number of slices of bounded size
        bits[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(DEPTH, -1)


def _maybe_repeated(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether the sketch estimates two or more for each minimizer."""
    out = np.ones(len(v), bool)
    for row in range(len(bits)):
        c = cells_of(v, row, bits.shape[1] * 8)
        out &= (bits[row][(c >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return out


def merged_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unites overlapping or touching spans [start, end) of each owner; sorted."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    reach = np.maximum.accumulate((owner << 32) + end)
    new = np.concatenate([[True], (owner[1:] << 32) + start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(owner)]]) - 1
    return owner[first], start[first], reach[last] - (owner[first] << 32)


_CANDIDATES = "shard int, hi binary, lo binary, n binary, doc binary, pos binary, keys binary, spans binary"


class _Held:
    """Windows of one task that may be repeated, until they are handed on."""

    def __init__(self, window: int, shards: int) -> None:
        self.window, self.shards, self.keys, self.parts, self.size = window, shards, [], [], 0

    def add(self, texts: list[bytes], bits: np.ndarray) -> None:
        words = Words(texts)
        at, v, _ = words.minimizers(self.window)
        hot = _maybe_repeated(bits, v)
        at, v = at[hot], v[hot]
        if not len(at):
            return
        doc = np.searchsorted(words.start, at, side="right") - 1
        # empty texts share their start with the text behind them; the last of equal starts is the one with words
        used, doc_here = np.unique(doc, return_inverse=True)
        base = len(self.keys)
        self.keys += [hashlib.md5(texts[i]).digest() for i in used.tolist()]
        self.parts.append((words.rolling(0, self.window, at), words.rolling(1, self.window, at), v, doc_here + base, at - words.start[doc]))
        self.size += len(at)

    def rows(self) -> pa.RecordBatch:
        hi, lo, v, doc, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((lo, hi))
        new = np.concatenate([[True], (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])])
        first = np.flatnonzero(new)
        n = np.diff(np.concatenate([first, [len(order)]]))
        # of windows found here several times one witness goes on, and their places are settled
        twice = np.repeat(n > 1, n)
        settled = order[twice]
        places = order[first]
        count = np.minimum(n, 2).astype(np.uint8)
        by_text = np.argsort(places)
        places, count = places[by_text], count[by_text]
        shard = (v[places] % np.uint64(self.shards)).astype(np.int64)  # windows of one minimizer meet in one shard
        by_shard = np.argsort(shard, kind="stable")
        places, count, shard = places[by_shard], count[by_shard], shard[by_shard]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        keys = np.frombuffer(b"".join(self.keys), "V16")
        out = []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            p = places[i:j]
            used, own = np.unique(doc[p], return_inverse=True)
            out.append((int(shard[i]), hi[p].tobytes(), lo[p].tobytes(), count[i:j].tobytes(), np.diff(own, prepend=0).astype(np.int32).tobytes(), np.diff(pos[p], prepend=0).astype(np.int32).tobytes(), keys[used].tobytes(), b""))
        if len(settled):
            unique, own = np.unique(keys, return_inverse=True)
            owner, start, end = merged_spans(own[doc[settled]].astype(np.int64), pos[settled], pos[settled] + self.window)
            to = np.frombuffer(unique.tobytes(), "<u8").reshape(-1, 2)[owner, 0] % np.uint64(self.shards)
            by = np.argsort(to, kind="stable")
            owner, start, end, to = owner[by], start[by], end[by], to[by]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                used, own = np.unique(owner[i:j], return_inverse=True)
                spans = np.stack([own, start[i:j], end[i:j]]).astype(np.int32)
                out.append((int(to[i]), b"", b"", b"", b"", b"", unique[used].tobytes(), spans.tobytes()))
        columns = list(zip(*out, strict=True))
        self.keys, self.parts, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=[x.split()[0] for x in _CANDIDATES.split(", ")])


def _settle(batches: list[pa.RecordBatch], window: int) -> pa.RecordBatch:
    """Exact grouping within one shard: for each text the spans of its repeated windows."""
    rows = [r for b in batches for r in b.to_pylist()]
    keys, base = [], 0
    hi, lo, n, doc, pos, spans = [], [], [], [], [], []
    for r in rows:
        if r["spans"]:
            s = np.frombuffer(r["spans"], np.int32).reshape(3, -1).astype(np.int64)
            spans.append((s[0] + base, s[1], s[2]))
        else:
            hi.append(np.frombuffer(r["hi"], np.uint64))
            lo.append(np.frombuffer(r["lo"], np.uint64))
            n.append(np.frombuffer(r["n"], np.uint8))
            doc.append(np.cumsum(np.frombuffer(r["doc"], np.int32), dtype=np.int64) + base)
            pos.append(np.cumsum(np.frombuffer(r["pos"], np.int32), dtype=np.int64))
        keys.append(r["keys"])
        base += len(r["keys"]) // 16
    del rows
    unique, own = np.unique(np.frombuffer(b"".join(keys), "V16"), return_inverse=True)
    if hi:
        h, low, c, d, p = np.concatenate(hi), np.concatenate(lo), np.concatenate(n), np.concatenate(doc), np.concatenate(pos)
        order = np.lexsort((low, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (low[order][1:] != low[order][:-1])])
        first = np.flatnonzero(new)
        total = np.add.reduceat(c[order].astype(np.int64), first)
        repeated = np.repeat(total > 1, np.diff(np.concatenate([first, [len(order)]])))
        hit = order[repeated & (c[order] == 1)]
        spans.append((d[hit], p[hit], p[hit] + window))
    owner, start, end = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
    owner, start, end = merged_spans(own[owner].astype(np.int64), start, end)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else [0]
    flat = np.stack([start, end], axis=1).astype(np.int32)
    k = [unique[owner[i]].tobytes() for i in cut[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array([flat[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["key", "spans"])


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, spans): by the md5 of a text, parts of the word spans [start, end) that its repeated windows cover, as pairs of 32-bit numbers."""
    spark = docs.sparkSession
    _, size = text_size(docs, text)
    cells = 1 << min(MOST_CELLS.bit_length() - 1, max(LEAST_CELLS.bit_length() - 1, int(size // 16).bit_length()))
    bits = spark.sparkContext.broadcast(sketch(docs, cells, text, window))
    shards = max(1, -(-size // SHARD_BYTES))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        held = _Held(window, shards)
        for batch in batches:
            for part in slices(batch, text, CHUNK):
                held.add(text_bytes(part.column(0)), bits.value)
                if held.size >= HOLD:
                    yield held.rows()
        if held.size:
            yield held.rows()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _settle(list(batches), window)

    settle.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return docs.select(text).mapInArrow(candidates, _CANDIDATES).groupBy("shard").applyInArrow(settle, "key binary, spans binary")


def remove_repeats(docs: DataFrame, text: str = "text", kept: str = "kept_text", window: int = WINDOW, changed_only: bool = False) -> DataFrame:
    """docs with n_words, n_removed and the kept words joined by single spaces.
    With changed_only, a text that loses nothing stays as it is."""
    key = "__lg_key"
    spans = repeated_spans(docs, text, window).groupBy("key").agg(F.collect_set("spans").alias("__lg_spans")).withColumnRenamed("key", key)  # of one text, from each shard at most one
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    copies = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = join_spread(keyed, spans, key, frequent(copies, key, "n"), "left").drop(key)
    schema = result_schema(docs, f"n_words long, n_removed long, `{kept}` string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 4 * CHUNK):
                texts = text_bytes(batch.column(batch.schema.get_field_index(text)))
                found = batch.column(batch.schema.get_field_index("__lg_spans")).to_pylist()
                n, removed, left = [], [], []
                for t, parts in zip(texts, found, strict=True):
                    words = t.split()
                    keep = words
                    if parts:
                        s = np.concatenate([np.frombuffer(p, np.int32).reshape(-1, 2) for p in parts])
                        gone = np.zeros(len(words) + 1, np.int64)
                        np.add.at(gone, s[:, 0], 1)
                        np.add.at(gone, s[:, 1], -1)
                        gone = np.cumsum(gone[:-1]) > 0
                        keep = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    n.append(len(words))
                    removed.append(len(words) - len(keep))
                    left.append(t if changed_only and len(keep) == len(words) else b" ".join(keep))
                new = {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), kept: pa.array(left, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays([new[k] if k in new else batch.column(batch.schema.get_field_index(k)) for k in schema.names], names=schema.names)

    return joined.mapInArrow(cut, schema)
