"""Benchmark decontamination with suffix arrays over the training texts.

Every task cuts its documents into shards, builds a suffix array over the words of each shard and binary-searches every
suffix of every benchmark item in it: the range of equal prefixes gives all places of a window, runs of places on one
diagonal give the longest verbatim matches and where they stand.  Documents that enough items occur in are removed.

A word that no item has cannot be part of a match, so a suffix enters the array only where enough words known to the
benchmark follow each other; it is compared to the depth of a window, beyond which a match is followed on its diagonal.
The benchmark travels to the tasks in blocks of about BLOCK_BYTES of text, one pass over all rows for each block; passes are staged
apart, so a task holds one block, however large the benchmark is.

Cases: a null text has no word; an item without a word occurs nowhere; an item shorter than a window is one window;
items of one identifier count once; items with a null identifier mark words but are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import fresh_worker, result_schema, shipped, slices, staged, text_bytes

WINDOW = 8
LEAST_ITEMS = 2
#: Bytes of text that make one shard of the training data.
SHARD_BYTES = 8_000_000
#: Bytes of benchmark text that are searched for at once.
BLOCK_BYTES = 4_000_000

#: A-Z to a-z, all else below 0x80 but digits and letters to a space; what is above belongs to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters a-z and characters from 0x80 on."""
    return text.translate(_FOLD).split()


def _key(ids: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like them."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").ravel()


class Probe:
    """A block of benchmark items, made ready to be looked up."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names = [n for n, _ in items]
        rows, item, place, length = [], [], [], []
        for i, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for j in range(max(1, len(ids) - window + 1) if ids else 0):
                part = ids[j : j + window]
                rows.append(part + [0] * (window - len(part)))
                item.append(i)
                place.append(j)
                length.append(len(part))
        self.item, self.place, self.length = (np.array(x, np.int64) for x in (item, place, length))
        table = np.array(rows, np.uint32).reshape(-1, window)
        self.low = _key(table)
        # the highest suffix that begins with a short item
        self.high = _key(np.where(np.arange(window)[None, :] < self.length[:, None], table, np.uint32(0xFFFFFFFF)))
        self.shortest = int(self.length.min()) if len(rows) else 0

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a shard's word numbers (0: no word of the benchmark, or a gap between documents): places and probes of all windows found."""
        none = np.zeros(0, np.int64)
        if not len(self.item) or len(ids) < self.shortest:
            return none, none
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(known[self.shortest :] - known[: -self.shortest] == self.shortest)
        if not len(at):
            return none, none
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        suffixes = _key(padded[at[:, None] + np.arange(self.window)[None, :]])
        order = np.argsort(suffixes, kind="stable")  # the suffix array
        suffixes, at = suffixes[order], at[order]
        low, high = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        n = high - low
        probe = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(probe)) - np.repeat(np.cumsum(n) - n, n)
        return at[low[probe] + inside], probe


def _runs(place: np.ndarray, probe: np.ndarray, p: Probe) -> tuple[np.ndarray, ...]:
    """Maximal matches from the windows found: first word here, words, item, first word there."""
    item, there, length = p.item[probe], p.place[probe], p.length[probe]
    order = np.lexsort((place, place - there, item))
    place, item, there, length = place[order], item[order], there[order], length[order]
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] - there[1:] != place[:-1] - there[:-1]) | (place[1:] - place[:-1] > 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return place[first], place[last] + length[last] - place[first], item[first], there[first]


#: What a pass over one block of items adds to a document, and hands to the next pass.
_LONGEST = "struct<words:int,start:int,item:string,item_start:int>"
_CARRY = {"__lg_hits": "binary", "__lg_items": "array<string>", "__lg_longest": _LONGEST, "__lg_n": "long", "__lg_n_hit": "long"}


def _blocks(benchmark: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[str | None, bytes]]]:
    block: list[tuple[str | None, bytes]] = []
    size = 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        data = r["t"].encode()
        if size and size + len(data) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["i"], data))
        size += len(data)
    yield block


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, item_col: str, item_text: str, window: int) -> DataFrame:
    """docs and the columns of _CARRY after all blocks."""
    df = docs
    blocks = _blocks(benchmark, item_col, item_text)
    block = next(blocks)
    while block is not None:
        probe = shipped(docs.sparkSession, Probe(block, window))
        schema = result_schema(df, ", ".join(f"{k} {v}" for k, v in _CARRY.items()))
        df = df.mapInArrow(_search(probe, schema, text, df is docs), schema)
        block = next(blocks, None)
        if block is not None:
            df = staged(df, "pass")
    return df


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window), n_items, items (sorted as strings) and longest, the longest
    verbatim match: words, first word, item and first word in the item (of equal ones the first in the text, then the first item)."""
    new = {"n_words": F.col("__lg_n"), "n_hit": F.col("__lg_n_hit"), "n_items": F.size("__lg_items").cast("long"), "items": F.col("__lg_items"), "longest": F.col("__lg_longest")}
    found = _passes(docs, benchmark, text, item_col, item_text, window)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def _search(probe_of, schema: T.StructType, text: str, first: bool):
    inner = list(_CARRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        probe: Probe = probe_of()
        number = probe.vocabulary.get
        for whole in batches:
            for batch in slices(whole, text, SHARD_BYTES):
                parts, counts = [], []
                for t in text_bytes(batch.column(batch.schema.get_field_index(text))):
                    words = words_of(t)
                    counts.append(len(words))
                    parts.append(np.fromiter((number(w, 0) for w in words), np.int64, len(words)))
                    parts.append(np.zeros(1, np.int64))
                count = np.array(counts, np.int64)
                start = np.cumsum(count + 1) - count - 1
                place, found = probe.matches(np.concatenate(parts) if parts else np.zeros(0, np.int64))
                new = _decide(probe, place, found, start, count, None if first else [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in inner])
                columns = dict(zip(inner, new, strict=True))
                yield pa.RecordBatch.from_arrays([columns[k] if k in columns else batch.column(batch.schema.get_field_index(k)) for k in schema.names], names=schema.names)

    return run


def _decide(p: Probe, place: np.ndarray, probe: np.ndarray, start: np.ndarray, count: np.ndarray, before: list | None) -> list[pa.Array]:
    """What the windows found in one shard, and what was found before, mean for each of its documents."""
    n = len(start)
    hits, items, longest = (list(x) for x in before[:3]) if before else ([b""] * n, [[]] * n, [{"words": 0, "start": -1, "item": None, "item_start": -1}] * n)
    if len(place):
        doc = np.searchsorted(start, place, side="right") - 1
        r_place, r_words, r_item, r_there = _runs(place, probe, p)
        r_doc = np.searchsorted(start, r_place, side="right") - 1
        for d in np.unique(doc).tolist():
            mark = np.zeros(int(count[d]), np.uint8) if not hits[d] else np.frombuffer(hits[d], np.uint8).copy()
            own = r_doc == d
            for a, w in zip((r_place[own] - start[d]).tolist(), r_words[own].tolist(), strict=True):
                mark[a : a + w] = 1
            hits[d] = mark.tobytes()
            items[d] = sorted({*items[d], *(p.names[i] for i in np.unique(r_item[own]).tolist() if p.names[i] is not None)})
            best = min(zip((-r_words[own]).tolist(), (r_place[own] - start[d]).tolist(), (p.names[i] or "" for i in r_item[own].tolist()), r_there[own].tolist(), strict=True))
            old = longest[d]
            if (best[0], best[1], best[2]) < (-old["words"], old["start"], old["item"] or ""):
                longest[d] = {"words": -best[0], "start": best[1], "item": best[2], "item_start": best[3]}
    kind = pa.struct([("words", pa.int32()), ("start", pa.int32()), ("item", pa.string()), ("item_start", pa.int32())])
    return [pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(longest, kind), pa.array(count, pa.int64()), pa.array([h.count(1) for h in hits], pa.int64())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", least_items: int = LEAST_ITEMS, **options) -> DataFrame:
    """The documents in which fewer than least_items items occur."""
    settings = {"item_col": "item_id", "item_text": "text", "window": WINDOW} | options
    found = _passes(docs, benchmark, text, **settings)
    return found.where(F.size("__lg_items") < least_items).select(*[F.col(f"`{c}`") for c in docs.columns])
