"""Packing token sequences by non-negative least squares over shallow length combinations.

Each document is cut into full windows and a rest; the rests' lengths, in classes of GRAIN tokens, form a histogram.
All combinations of at most DEPTH classes that fill a window exactly are enumerated, non-negative least squares finds how
often to repeat each one, the counts are rounded within what the histogram holds, and what is left over is packed
greedily: laid end to end and cut at the window's end.  The plan sees the histogram only, so it is of a fixed size; pieces
are matched to it by their rank in their class, counted in two levels, so no task ever holds a class.

Cases: a null text is the end-of-document id alone; an empty table gives no piece; rows with equal text are packed each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh_worker, result_schema, shipped, slices, staged, text_bytes

LENGTH = 2048
GRAIN = 16
DEPTH = 3
END_ID = 1
#: Units (parts of words) whose ids a worker remembers, in each of two generations.
REMEMBERED = 300_000
#: Bytes of text that are tokenised together.
CHUNK = 2_000_000


def default_vocabulary() -> str:
    """The place of the public vocabulary that packing uses unless it is given another."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What the bytes of a text are: white space, letters, digits, marks, and all else. An apostrophe joins with letters, and < may begin a special token.
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
_KINDS = bytes(
    SPACE if c in b" \t\n\x0b\x0c\r" else OTHER if c in b"'<" or not 32 < c < 127 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK for c in range(256)
)
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_SPACES = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Bytes of the longest run of letters that is merged in arrays.
LONGEST = 64

#: The steps of a vocabulary that WordIds takes apart: they drop white space and case, and split off runs of letters, digits and runs of other marks.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary of bytes: printable ones for themselves, the others for letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + k) for k in range(256))
    return [chr(c) if c in shown else next(others) for c in range(256)]


class Merges:
    """The pair merges of a vocabulary, done on many words at once: of a word's adjacent pairs the one of least rank is merged, the leftmost of equals, until none is left.

    All words of as many tokens form one matrix. A merge makes a row one token shorter, so rows go from the longest width
    to the next, where the words that begin with that width join them."""

    def __init__(self, model: dict) -> None:
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.inner = np.array([ids[c] for c in _byte_letters()], np.uint16)
        self.last = np.array([ids[c + "</w>"] for c in _byte_letters()], np.uint16)
        self.none = len(pairs)
        self.made = np.array([ids[a + b] for a, b in pairs], np.uint16)
        # pairs by a hash, each in the first free place from there on
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.ranks = np.full(size + 1, self.none, np.int32)
        self.pairs = np.zeros(size + 1, np.uint32)
        for (a, b), rank in {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}.items():
            key = a << 16 | b
            at = (key * 2654435769 & 0xFFFFFFFF) >> (32 - self.bits)
            while self.ranks[at] != self.none:
                at = (at + 1) % size
            self.pairs[at], self.ranks[at] = key, rank

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; self.none where it is not merged."""
        key = (a.astype(np.uint32) << np.uint32(16)) | b
        at = ((key * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)
        out = self.ranks[at]
        ask = np.flatnonzero((self.pairs[at] != key) & (out != self.none))
        while len(ask):
            at[ask] = (at[ask] + 1) & ((1 << self.bits) - 1)
            out[ask] = self.ranks[at[ask]]
            ask = ask[(self.pairs[at[ask]] != key[ask]) & (out[ask] != self.none)]
        return out

    def of(self, words: list[bytes]) -> list[bytes]:
        """The token ids of each word (one byte at least), as little-endian 16-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_width.setdefault(len(w), []).append(i)
        which, rows, ranks = np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.int32)
        for width in range(max(by_width, default=0), 0, -1):
            # a rank for each token and the next one, none for the last
            rows, ranks = rows.reshape(-1, width), ranks.reshape(-1, width)
            if own := by_width.get(width):
                letters = np.frombuffer(b"".join([words[i] for i in own]), np.uint8).reshape(-1, width)
                fresh = self.inner[letters]
                fresh[:, -1] = self.last[letters[:, -1]]
                first = np.full(fresh.shape, self.none, np.int32)
                first[:, :-1] = self.rank(fresh[:, :-1].ravel(), fresh[:, 1:].ravel()).reshape(-1, width - 1) if width > 1 else 0
                which, rows, ranks = np.concatenate([which, own]), np.concatenate([rows, fresh]), np.concatenate([ranks, first])
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            go = least < self.none
            data = rows[~go].astype("<u2").tobytes()
            for k, i in enumerate(which[~go].tolist()):
                out[i] = data[2 * width * k : 2 * width * (k + 1)]
            which, rows, ranks, at, least = which[go], rows[go], ranks[go], at[go], least[go]
            here = np.arange(len(rows))
            rows[here, at] = self.made[least]
            keep = np.ones(rows.shape, bool)
            keep[here, at] = False
            ranks = ranks[keep].reshape(len(here), width - 1)
            keep[here, at] = True
            keep[here, at + 1] = False
            rows = rows[keep].reshape(len(here), width - 1)
            left, right = here[at > 0], here[at < width - 2]
            ranks[left, at[left] - 1] = self.rank(rows[left, at[left] - 1], rows[left, at[left]])
            ranks[right, at[right]] = self.rank(rows[right, at[right]], rows[right, at[right] + 1])
        return out


class WordIds:
    """Token ids of texts as little-endian bytes.

    The public vocabulary drops white space and case, so no token crosses words, and splits words into runs of letters, digits
    and runs of marks. Texts are taken apart in arrays into these units, a word with anything else in it being one unit; each
    different unit of a chunk is looked up once. Unknown letters are merged together (Merges), other units go to the tokeniser.
    Any other kind of vocabulary gets whole texts."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # units in two generations: what is still in use moves from the older to the newer one
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        parts = json.loads(definition)
        self.merges = Merges(parts["model"]) if size <= 1 << 16 and self._splits(parts) else None

    @staticmethod
    def _splits(parts: dict) -> bool:
        """Whether the vocabulary's steps are those that this class does in arrays."""
        model, added = parts["model"], parts.get("added_tokens") or []
        return (
            parts.get("normalizer") == _NORMALIZER
            and parts.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
            and not any(parts.get(k) for k in ("truncation", "padding", "post_processor"))
            and all(model.get(k) == v for k, v in _MODEL.items())
            and all(c in model["vocab"] and c + "</w>" in model["vocab"] for c in _byte_letters())
            and all(t["content"].startswith("<") and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        )

    def _each(self, units: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(units), 20_000):
            part = [u.decode() for u in units[i : i + 20_000]]
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _look_up(self, units: list[bytes]) -> list[bytes]:
        """The ids of each of the different units."""
        known, older = self.known, self.older
        ids = list(map(known.get, units))
        new = [i for i, x in enumerate(ids) if x is None]
        if older:
            for i in new:
                ids[i] = older.get(units[i])
            known.update([(units[i], ids[i]) for i in new if ids[i] is not None])
            new = [i for i in new if ids[i] is None]
        if len(known) + len(new) > REMEMBERED:
            self.older = known
            self.known = known = {u: x for u, x in zip(units, ids, strict=True) if x is not None}
        letters = _LETTERS.fullmatch
        stems = [i for i in new if len(units[i]) <= LONGEST and letters(units[i])]
        others = sorted(set(new).difference(stems))
        for at, found in ((stems, self.merges.of([units[i] for i in stems])), (others, self._each([units[i] for i in others]))):
            for i, x in zip(at, found, strict=True):
                ids[i] = known[units[i]] = x
        return ids

    def _chunk(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, of all units at once."""
        data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        kind = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
        low = np.frombuffer(bytearray(data.lower()), np.uint8)  # of bytes: A-Z alone
        lead = np.flatnonzero(raw == 0xC3)
        tail = raw[lead + 1]
        letter = (tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)
        lead, tail = lead[letter], tail[letter]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = np.where(tail < 0x9F, tail + 32, tail)
        other = np.flatnonzero(kind == OTHER)
        if len(other):  # the words that they are in, as they stand
            spaces = np.flatnonzero(kind == SPACE)
            word = np.unique(np.searchsorted(spaces, other))
            begin = np.where(word > 0, spaces[word - 1] + 1, 0)
            size = spaces[word] - begin
            at = _ranges(begin, size)
            kind[at], low[at] = OTHER, raw[at]
        inside = kind != SPACE
        first = kind == DIGIT
        first[0] |= inside[0]
        first[1:] |= kind[1:] != kind[:-1]
        first &= inside
        starts = np.flatnonzero(first[inside])
        letters = low[inside]
        places = np.append(starts, len(letters)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)]).dictionary_encode()
        index = np.frombuffer(units.indices.buffers()[1], np.int32, len(starts))
        _, ends, content = units.dictionary.buffers()
        ends, content = np.frombuffer(ends, np.int32, len(units.dictionary) + 1).tolist(), content.to_pybytes()
        ids = self._look_up([content[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        begins = np.cumsum(sizes) - sizes
        own = sizes[index]
        tokens = np.frombuffer(b"".join(ids), self.dtype)[_ranges(begins[index], own)].tobytes()
        upto = np.concatenate([[0], np.cumsum(own)])
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = (upto[np.searchsorted(np.flatnonzero(first), text_ends)] * width).tolist()
        return [tokens[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; long texts go in parts."""
        if self.merges is None:
            return self._each(texts)
        if sum(map(len, texts)) <= 2 * CHUNK:
            return self._chunk(texts)
        return [b"".join([self._chunk([p])[0] for p in _parts(t)]) for t in texts]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its size, one range behind the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK bytes that end before white space."""
    at = 0
    while at < len(text):
        space = _SPACES.search(text, at + CHUNK)
        to = space.start() if space else len(text)
        yield text[at:to]
        at = to


def _worker_ids(definition: str) -> WordIds:
    """The WordIds of this Python worker: what it has learnt stays for its next tasks, up to REMEMBERED units."""
    import sys
    import types

    store = sys.modules.setdefault("loomgraph_worker_state", types.ModuleType("loomgraph_worker_state"))
    known = store.__dict__.setdefault("word_ids", {})
    name = hash(definition)
    if name not in known:
        known.clear()
        known[name] = WordIds(definition)
    return known[name]


def tokenize(docs: DataFrame, vocabulary: str | None = None, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """docs with, in place of the text, ids (with the end-of-document id, little-endian, as wide as the vocabulary asks for) and n, how many."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, some MB
    schema = result_schema(docs.drop(text), "ids binary, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _worker_ids(definition.value)
        end, width = np.array([end_id], words.dtype).tobytes(), words.dtype.itemsize
        for whole in batches:
            for batch in slices(whole, text, CHUNK):
                ids = [x + end for x in words.of(text_bytes(batch.column(batch.schema.get_field_index(text))))]
                new = {"ids": pa.array(ids, pa.binary()), "n": pa.array([len(x) // width for x in ids], pa.int64())}
                yield pa.RecordBatch.from_arrays([new[k] if k in new else batch.column(batch.schema.get_field_index(k)) for k in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)


def combinations(top: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All falling sequences of at most depth numbers from 1 to top that add up to top."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < depth:
            for x in range(min(left, most), 0, -1):
                extend((*head, x), left - x, x)

    extend((), top, top)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Least squares of a x = b with x >= 0, by active sets on the normal equations."""
    n = a.shape[1]
    gram, rhs = a.T @ a, a.T @ b
    x, free = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, float(np.abs(rhs).max(initial=0)))
    for _ in range(rounds):
        cols = np.flatnonzero(free)
        gain = rhs - gram[:, cols] @ x[cols]
        gain[free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= slack:
            break
        free[best] = True
        while True:
            cols = np.flatnonzero(free)
            s = np.linalg.solve(gram[np.ix_(cols, cols)] + 1e-9 * np.eye(len(cols)), rhs[cols])
            if (s > 0).all():
                x[:] = 0
                x[cols] = s
                break
            bad = s <= 0
            old = x[cols]
            step = float((old[bad] / np.maximum(old[bad] - s[bad], 1e-300)).min())
            x[cols] = old + step * (s - old)
            gone = cols[(x[cols] <= 1e-12) & bad]
            if not len(gone):
                gone = cols[bad][:1]
            x[gone] = 0
            free[gone] = False
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which combination; histogram[c]: pieces of class c, from 1 to the class that fills a window.
    No more pieces of a class are used than there are."""
    top = len(histogram) - 1
    combos = combinations(top, depth)
    a = np.zeros((top + 1, len(combos)))
    for j, c in enumerate(combos):
        for x in c:
            a[x, j] += 1
    x = nnls(a, histogram.astype(float))
    left = histogram.astype(np.int64).copy()
    out = []
    for rounding in (np.floor, np.ceil):  # what rounding down leaves may hold a few more
        for j in np.argsort(-x, kind="stable"):
            if x[j] <= 0:
                break
            need = a[:, j].astype(np.int64)
            used = need > 0
            times = int(min((left[used] // need[used]).min(), rounding(x[j])))
            if rounding is np.ceil:
                times = min(times, 1)
            if times > 0:
                left -= times * need
                out.append((combos[j], times))
    return out


def _assignment(entries: list[tuple[tuple[int, ...], int]], classes: int) -> tuple[list[np.ndarray], int]:
    """For each class rows (first rank, ranks, first sequence, slot) in order of rank; and the number of sequences."""
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(classes + 1)]
    used = [0] * (classes + 1)
    sequence = 0
    for combo, times in entries:
        for slot, c in enumerate(combo):
            rows[c].append((used[c], times, sequence, slot))
            used[c] += times
        sequence += times
    return [np.array(r, np.int64).reshape(-1, 4) for r in rows], sequence


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """Pieces of all documents: the identifier, start, length, ids (little-endian 32-bit numbers), doc_tokens, sequence_id and offset. A sequence holds at most length ids."""
    if length % grain:
        raise ValueError("the window must hold a whole number of grains")
    spark = docs.sparkSession
    mark = F.monotonically_increasing_id()
    tokens = staged(
        tokenize(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), vocabulary).withColumn("at", mark).select("id", "ids", "n", F.shiftright("at", 33).alias("pid"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("idx")),
        "tokens",
    )
    top = length // grain
    sizes = tokens.select("pid", "idx", "n", F.floor(F.col("n") / length).alias("q"), (F.col("n") % length).alias("r")).withColumn("c", F.ceil(F.col("r") / grain))
    counted = sizes.where("r > 0").groupBy("pid", "c").agg(F.count(F.lit(1)).alias("k"))
    histogram = np.zeros(top + 1, np.int64)
    for row in counted.groupBy("c").agg(F.sum("k").alias("k")).collect():  # at most one row for each class
        histogram[row["c"]] = row["k"]
    chosen, planned = _assignment(plan(histogram, depth), top)
    tables_of = shipped(spark, chosen)  # bounded by the number of combinations

    before = Window.partitionBy("c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("pid", "c", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("pid", "c").orderBy("idx")) - 1
    ranked = sizes.where("r > 0").withColumn("inner", inner).join(offsets, ["pid", "c"]).select("pid", "idx", "r", "c", (F.col("base") + F.col("inner")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        tables = tables_of()
        for b in batches:
            c, rank = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            seq, slot = np.full(len(c), -1, np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c).tolist():
                t, own = tables[k], np.flatnonzero(c == k)
                if len(t):
                    i = np.searchsorted(t[:, 0], rank[own], side="right") - 1
                    inside = rank[own] - t[i, 0] < t[i, 1]
                    seq[own] = np.where(inside, t[i, 2] + rank[own] - t[i, 0], -1)
                    slot[own] = t[i, 3]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(seq), pa.array(slot)], names=["pid", "idx", "r", "seq", "slot"])

    placed = staged(ranked.mapInArrow(place, "pid long, idx long, r long, seq long, slot long"), "placed")
    slots = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    fitted = placed.where("seq >= 0").select("pid", "idx", "seq", F.coalesce(F.sum("r").over(slots), F.lit(0)).alias("off"))
    rest = placed.where("seq < 0").select("pid", "idx", F.col("r").alias("left"))

    # full windows and left-over rests are numbered through by partition, then within
    narrow = sizes.join(rest, ["pid", "idx"], "left").select("pid", "idx", "n", "q", F.coalesce("left", F.lit(0)).alias("left"))
    sums = narrow.groupBy("pid").agg(F.sum("q").alias("q"), F.sum("left").alias("left")).orderBy("pid").collect()  # a row for each input partition
    full = np.cumsum([0, *(int(s["q"]) for s in sums)])
    loose = np.cumsum([0, *(int(s["left"]) for s in sums)])
    bases = spark.createDataFrame([(int(s["pid"]), int(full[i]), int(loose[i])) for i, s in enumerate(sums)], "pid long, q_base long, left_base long")
    earlier = Window.partitionBy("pid").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        narrow.select("pid", "idx", "left", "q", F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("q0"), F.coalesce(F.sum("left").over(earlier), F.lit(0)).alias("l0"))
        .join(bases, "pid")
        .select("pid", "idx", "left", (F.col("q_base") + F.col("q0") + F.lit(planned)).alias("q_seq"), (F.col("left_base") + F.col("l0")).alias("line"))
        .join(fitted, ["pid", "idx"], "left")
    )
    line_base = planned + int(full[-1])
    schema = "id " + dict(docs.dtypes)[id_col] + ", start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {k: b.column(b.schema.get_field_index(k)).to_pylist() for k in ("ids", "n", "left", "q_seq", "line", "seq", "off")}
            out = []
            for i, (ids, n, left, q_seq, line, seq, off) in enumerate(zip(*col.values(), strict=True)):
                whole = n // length
                pieces = [(k * length, length, q_seq + k, 0) for k in range(whole)]
                at, r = whole * length, n % length
                if seq is not None:
                    pieces.append((at, r, seq, off))
                elif left:
                    s, o = divmod(line, length)
                    head = min(r, length - o)
                    pieces.append((at, head, line_base + s, o))
                    if head < r:
                        pieces.append((at + head, r - head, line_base + s + 1, 0))
                whole_ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                out += [(i, a, m, whole_ids[a : a + m].tobytes(), n, q, o) for a, m, q, o in pieces]
            if out:
                i, a, m, data, n, q, o = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")).take(pa.array(i)), *(pa.array(x, pa.int64()) for x in (a, m)), pa.array(data, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, q, o))], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    pieces = tokens.join(numbered, ["pid", "idx"]).mapInArrow(cut, schema)
    return pieces.withColumnRenamed("id", id_col)
