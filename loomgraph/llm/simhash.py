"""SimHash near-duplicates: tiled exact comparison with numpy exclusive-or and bit counts.

Fingerprints that differ in at most RADIUS bits agree in at least one of RADIUS + 1 blocks of bits, so tiles are cut
inside groups of equal block value: every pair within the radius meets in some tile, few others do.  In a tile the
fingerprints stand in order of their population counts and tile pairs whose counts differ beyond the radius are skipped.
A group of more than TILE fingerprints is dealt out as pairs of tiles, each of one population count, over many tasks.
A tile gives a spanning forest of its links, never all pairs; components come from large-star and small-star rounds.

near_duplicates() links fingerprints by a small radius, whatever the texts. similar() is for texts that share most of their shingles, which
can be far more bits apart: its radius is wide, so tiles are cut inside groups of texts that have least shingle hashes in common, and a link
must also be confirmed by a sketch of the shingle sets. keep_one() then leaves one row of each component.

Cases: a text without a word has fingerprint 0 and links like any other (in similar() only with its equals); rows with equal text share
everything; a null identifier is no candidate for component_id, which is null where a component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, frequent, fresh_worker, hex64, join_spread, result_schema, slices, staged, text_bytes

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Most fingerprints of a group, or of a tile of a larger group.
TILE = 32_768
#: Side of the squares that are compared at once within a tile.
SQUARE = 1024
#: Bytes of text whose shingle hashes a worker holds at once.
CHUNK = 2_000_000

#: For similar(): words of a shingle, least share of common shingles, and the radius that pairs of that share stay within.
WORDS, LEAST_SHARE, WIDE = 5, 0.8, 16
#: Groups that a text is in, each by PAIRED least hashes: pairs of LEAST_SHARE miss all of them in one case of 160.
BANDS, PAIRED = 5, 2
#: Bins of the sketch: one byte for the least hash in each.
BINS = 256
#: Pairs whose sketches are compared at once.
AT_ONCE = 20_000

_LOW = np.uint64(0x0101010101010101)


def _shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of the shingles of a text, of the whole sequence if it is shorter, none if it has no word."""
    words = text.lower().split()  # bytes: A-Z, and white space is 0x20 and 0x09 to 0x0D
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))  # of each word but the first, whose own length starts the sum
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def _gathered(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in a row, and how many each text has."""
    parts, counts = [np.zeros(0, np.uint64)], []
    for t in texts:
        h = np.array(_shingle_hashes(t, size), np.uint64)
        parts.append(h)
        counts.append(len(h))
    return np.concatenate(parts), np.array(counts, np.int64)


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if it is in over half of the shingle hashes."""
    return _majority(*_gathered(texts, size))


def _majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # eight counters of a byte each in one word, so at most 255 hashes to a chunk
    per = -(-n[full] // 255)
    chunk_doc = np.repeat(np.arange(len(full)), per)
    within = np.arange(len(chunk_doc)) - np.repeat(np.cumsum(per) - per, per)
    chunk_start = (np.cumsum(n[full]) - n[full])[chunk_doc] + within * 255
    doc_start = np.cumsum(per) - per
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _LOW, chunk_start)
        bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), doc_start, axis=0)  # column: byte of the hash
        on = (2 * bits > n[full][:, None]).astype(np.uint64)
        out[full] |= np.bitwise_or.reduce(on << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k)), axis=1)
    return out


def _bands(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text BANDS numbers (int64), each made of PAIRED least hashes; texts without a shingle have zeros."""
    out = np.zeros((len(n), BANDS), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        start = (np.cumsum(n) - n)[full]
        factors = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * PAIRED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for k, factor in enumerate(factors):
            mixed = h * factor
            mixed ^= mixed >> np.uint64(32)
            least = np.minimum.reduceat(mixed * factor, start)
            out[full, k // PAIRED] = (out[full, k // PAIRED] + least) * np.uint64(0x9E3779B97F4A7C15)
        out[full] ^= np.arange(BANDS, dtype=np.uint64)[None, :]
    return out.view(np.int64)


def _sketches(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text BINS bytes: of the hashes that fall into a bin one byte (not 0) of the least, 0 where there is none."""
    out = np.zeros((len(n), BINS), np.uint8)
    if len(h):
        order = np.argsort(h, kind="stable")
        own = np.repeat(np.arange(len(n)), n)[order]
        place = own * BINS + (h[order] >> np.uint64(56)).astype(np.int64)
        cell, first = np.unique(place, return_index=True)  # the first of a cell is the least of its hashes
        out.reshape(-1)[cell] = ((h[order][first] >> np.uint64(16)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of common shingles of each pair of sketches (rows of a and b), estimated over the bins that either fills."""
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    return ((a == b) & (a != 0)).sum(axis=1) / np.maximum(1, filled)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", size: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint as a signed long in place of the text."""
    schema = result_schema(docs.drop(text), f"`{name}` long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for whole in batches:
            for batch in slices(whole, text, CHUNK):
                fp = pa.array(fingerprints(text_bytes(batch.column(batch.schema.get_field_index(text))), size).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([fp if k == name else batch.column(batch.schema.get_field_index(k)) for k in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)


class Forest:
    """Components among n items; joins whole arrays of links at once."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.root[u], self.root[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def tile_links(fp: np.ndarray, other: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fp, or between fp and other, as pairs of fingerprints."""
    both = fp if other is None else np.concatenate([fp, other])
    side = None if other is None else np.arange(len(both)) >= len(fp)
    u, v = _spanning(both, side, radius)
    return both[u], both[v]


def _spanning(both: np.ndarray, side: np.ndarray | None, radius: int, sketch: np.ndarray | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of places, of the links among both: at most radius bits apart, where there are sides from one to the other, and
    where there are sketches that share ``least`` or more."""
    order = np.argsort(np.bitwise_count(both), kind="stable")
    both = both[order]
    side = None if side is None else side[order]
    pop = np.bitwise_count(both).astype(np.int64)
    forest = Forest(len(both))
    for i in range(0, len(both), SQUARE):
        rows = slice(i, min(len(both), i + SQUARE))
        end = int(np.searchsorted(pop, pop[rows.stop - 1] + radius, side="right"))  # what stands behind is beyond the radius
        for j in range(i, end, SQUARE):
            cols = slice(j, min(end, j + SQUARE))
            if pop[cols.start] - pop[rows.stop - 1] > radius:
                break
            near = np.bitwise_count(both[rows, None] ^ both[None, cols]) <= radius
            if side is not None:
                near &= side[rows, None] != side[None, cols]
            u, v = np.nonzero(near)
            u, v = u + i, v + j
            ahead = u < v
            u, v = u[ahead], v[ahead]
            if sketch is None:
                if len(u):
                    forest.join(u, v)
                continue
            while len(u):  # what earlier pairs have joined needs no look at its sketches
                a, b = u[:AT_ONCE], v[:AT_ONCE]
                same = shared(sketch[order[a]], sketch[order[b]]) >= least
                if same.any():
                    forest.join(a[same], b[same])
                u, v = u[AT_ONCE:], v[AT_ONCE:]
                apart = forest.root[u] != forest.root[v]
                u, v = u[apart], v[apart]
    low = np.flatnonzero(forest.root != np.arange(len(both)))
    return order[low], order[forest.root[low]]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fp`` that hold every component of the relation "at most radius bits apart" together."""
    blocks = radius + 1
    width = -(-64 // blocks)
    values = [F.shiftrightunsigned(F.col("fp"), i * width).bitwiseAND(F.lit((1 << min(width, 64 - i * width)) - 1)) + F.lit(i << width) for i in range(blocks)]
    return _linked(prints.select("fp", F.explode(F.array(*values)).alias("block")), radius, tile)


def _linked(rows: DataFrame, radius: int, tile: int, least: float | None = None) -> DataFrame:
    """Links (u, v) inside the blocks of rows (fp, block): pairs of fp; with ``least`` pairs of ``node``, whose ``sketch`` must share as much."""
    extra = [] if least is None else ["node", "sketch"]
    rows = rows.withColumn("pop", F.bit_count("fp"))
    sizes = rows.groupBy("block", "pop").agg(F.count(F.lit(1)).alias("n"))
    large = (
        sizes.groupBy("block")
        .agg(F.sum("n").alias("total"), F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("m"))).alias("tiles"))  # 65 at most
        .where(F.col("total") > tile)
        .select("block", "tiles")
    )
    # a row of a large group goes to every pair of tiles that its own tile is in, unless their counts are too far apart
    placed = rows.join(large, "block", "left").withColumn("own", F.expr("filter(tiles, t -> t.pop = pop)[0].m"))
    placed = placed.withColumn("own", F.struct(F.col("pop"), F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("own"))).cast("int").alias("s")))
    near = F.expr(f"flatten(transform(filter(tiles, t -> abs(t.pop - pop) <= {radius}), t -> transform(sequence(0, t.m - 1), s -> struct(t.pop as pop, s as s))))")
    dealt = placed.select("fp", *extra, "block", "own", F.explode_outer(near).alias("other"))
    alone = F.col("other").isNull()
    low, high = F.least("own", "other"), F.greatest("own", "other")
    keyed = dealt.select(
        "fp",
        *extra,
        F.when(alone, F.lit(-1)).otherwise(low.getField("pop") * 128 + high.getField("pop")).alias("pops"),
        F.when(alone, F.lit(-1)).otherwise(low.getField("s")).alias("s1"),
        F.when(alone, F.lit(-1)).otherwise(high.getField("s")).alias("s2"),
        "block",
        (~alone & (F.col("own") != low)).alias("second"),
    )
    key = ["block", "pops", "s1", "s2"]
    together = keyed.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        held: list[tuple] = []
        last: tuple = ()
        for now, *part in _groups(batches, key):
            if now != last and held:
                yield from _forest(last, held, radius, least)
                held = []
            last = now
            held.append(part)
        if held:
            yield from _forest(last, held, radius, least)

    return together.mapInArrow(run, "u long, v long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple]:
    """Runs of equal key in sorted batches: the key, the fingerprints, the side of each, and where there are some its nodes and sketches."""
    for b in batches:
        if not b.num_rows:
            continue
        col = lambda k, b=b: b.column(b.schema.get_field_index(k))
        keys = np.stack([col(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in key])
        parts = [col("fp").to_numpy().view(np.uint64), col("second").to_numpy(zero_copy_only=False).astype(bool)]
        if "node" in b.schema.names:
            parts += [col("node").to_numpy(), np.frombuffer(b"".join(col("sketch").to_pylist()), np.uint8).reshape(-1, BINS)]
        cut = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [b.num_rows]])
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield tuple(keys[:, i].tolist()), *(x[i:j] for x in parts)


def _forest(key: tuple, held: list[list], radius: int, least: float | None) -> Iterator[pa.RecordBatch]:
    """The links of one tile or pair of tiles."""
    fp, second, *more = (np.concatenate(x) for x in zip(*held, strict=True))
    if len(fp) < 2:
        return
    pair = second.any() and not second.all()
    if key[1] >= 0 and (key[1] // 128 != key[1] % 128 or key[2] != key[3]) and not pair:
        return  # one of the two tiles had no rows after all
    u, v = _spanning(fp, second if pair else None, radius, more[1] if more else None, least or 0.0)
    if len(u):
        name = more[0] if more else fp.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(name[u]), pa.array(name[v])], names=["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of the links (u, v) the least node that it reaches. Large-star and small-star rounds, each checkpointed, until nothing changes."""
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s")).first()
    return r["n"], r["x"], r["s"]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """For each row: its identifier, fingerprint (16 hex digits) and component_id, the smallest identifier that links lead to."""
    prints = staged(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))), "fingerprints")
    known = prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    found = components(links(known.select("fp"), radius, tile))
    # of the components with several fingerprints; all others are their own
    joined = found.join(known, found["node"] == known["fp"]).select("root", "node", "rep")
    least = joined.groupBy("root").agg(F.min("rep").alias("least"))
    moved = joined.join(least, "root").select(F.col("node").alias("fp"), F.lit(True).alias("moved"), "least")
    place = known.join(moved, "fp", "left").select("fp", F.when(F.col("moved"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    return join_spread(prints, place, "fp", frequent(known, "fp", "rows")).select(F.col("id").alias(id_col), hex64(F.col("fp")).alias("fingerprint"), "component_id")


def _described(docs: DataFrame, size: int) -> DataFrame:
    """Rows (id, source, text) as (id, source, node, fp, bands, sketch): node is a hash of the lower-cased words, which stands for the text."""
    schema = result_schema(docs.drop("text"), "node long, fp long, bands array<long>, sketch binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
                h, n = _gathered(texts, size)
                node = np.array([xxhash.xxh3_64_intdigest(b" ".join(t.lower().split()), SEED) for t in texts], np.uint64)
                new = {
                    "node": pa.array(node.view(np.int64)),
                    "fp": pa.array(_majority(h, n).view(np.int64)),
                    "bands": pa.array([b if k else [] for b, k in zip(_bands(h, n).tolist(), n.tolist(), strict=True)], pa.list_(pa.int64())),
                    "sketch": pa.array([x.tobytes() for x in _sketches(h, n)], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([new[k] if k in new else batch.column(batch.schema.get_field_index(k)) for k in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)


def similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WORDS, least: float = LEAST_SHARE, radius: int = WIDE, tile: int = TILE) -> DataFrame:
    """For each row: its identifier as id, source (a hash of its text as it is), node (one of its words) and root, the least node that links lead to.
    Linked are texts of which ``least`` or more of the different shingles of ``size`` words are common, as their sketches estimate it: exactly for texts of some
    hundred words, within about 0.025 (one standard deviation) for long ones."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("source"), F.col(text).alias("text"))
    prints = staged(_described(rows, size), "described")
    known = prints.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    # groups of one text need no look; what is left carries its sketch into its tile
    grouped = prints.select("node", F.explode("bands").alias("block")).distinct()
    several = grouped.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block")
    met = grouped.join(several, "block", "left_semi")
    sketches = prints.groupBy("node").agg(F.min(F.struct("fp", "sketch")).alias("s")).select("node", "s.fp", "s.sketch")
    found = components(_linked(met.join(sketches, "node"), radius, tile, least))
    place = known.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return join_spread(prints.select("id", "source", "node"), place, "node", frequent(known, "node", "rows")).select("id", "source", "node", "root")


def keep_one(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of similar(): the one with the least identifier (a null one last), of repeated rows any one. Rows of one identifier whose
    texts are in different components stay apart."""
    n, mark = "__lg_n", "__lg_mark"
    first = decisions.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "source")).alias("s"))
    # one key of identifier and text, by which rows move once, for the join and for the choice among repeated ones
    key = lambda i, x: F.md5(F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("")), i.isNull().cast("string"), x.cast("string")).cast("binary"))
    heads = first.select(key(F.col("s.id"), F.col("s.source")).alias(mark))
    rows = docs.withColumn(mark, key(F.col(id_col), F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    kept = rows.join(heads, mark, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(mark).orderBy(mark)))
    return kept.where(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
