"""Operators on whole texts against brute force, with nulls, empty and long texts, repeats, empty tables and extra columns."""

import hashlib
import os
import re
import subprocess
import sys
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomgraph.llm import common, langid, licences, linecrf, packing, queries, repeats, simhash, suffixes

SF = "/root/testdata/sf0.001"
SPACE = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 700} é{i % 31}" for i in range(3000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [None, "", "  \n\t ", "one", "Two words", PASSAGE, "Before it. " + PASSAGE + " and behind", LONG, LONG, LONG + " end", "a b " * 60, "x\u00a0y z\x1cq \x85", "Same line here\nSame line here\nother * # $ line"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", -1, "x", "x") for i, t in enumerate(TEXTS)] + [(3, "one", "en", -1, "x", "x"), (None, "Two words", None, -1, "x", "x")]
    # columns whose names the operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, key string, fp string")


def by_text(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def words(t):
    return SPACE.findall(t or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert by_text(df, *columns) == sorted(want, key=repr)


def test_repeats(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    count = Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))

    def expected(t):
        w = words(t)
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        return (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))

    got = repeats.remove_repeats(docs)
    assert by_text(got, "doc_id", "n_words", "n_removed", "kept_text") == sorted(((i, *expected(t)) for i, t in rows), key=repr)
    same = repeats.remove_repeats(docs, changed_only=True).where("doc_id = 12").first()
    assert same["kept_text"] == TEXTS[12]
    assert repeats.remove_repeats(docs.limit(0)).collect() == []


def test_repeats_keeps_exact_counts_when_the_sketch_is_full(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "LEAST_CELLS", 1 << 6)
    monkeypatch.setattr(repeats, "MOST_CELLS", 1 << 6)
    small = by_text(repeats.remove_repeats(docs), "doc_id", "n_words", "n_removed")
    monkeypatch.undo()
    assert small == by_text(repeats.remove_repeats(docs), "doc_id", "n_words", "n_removed")


def fingerprint(t):
    w = [x.lower() for x in (t or "").encode().split()]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in got), key=repr) == sorted(((i, f"{fingerprint(t):016x}") for i, t in rows), key=repr)
    at = {r["doc_id"]: r["component_id"] for r in got}
    assert at[8] == at[7] == 7 and at[0] == at[1] == at[2] == 0 and at[None] == 4
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_one_of_each_group_stays(spark, docs):
    kept = simhash.keep_one(docs, simhash.similar(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5, 7, 10, 11, 12]  # 6 is near 5, 8 a copy of 7, 9 near it
    assert simhash.keep_one(docs.limit(0), simhash.similar(docs.limit(0))).collect() == []
    nameless = spark.createDataFrame([(None, "a b c d e f"), (None, "q r s t u v w"), (None, "a b c d e f"), (5, "x y z x1 y1"), (None, "X y z  x1 y1")], "doc_id long, text string")
    left = simhash.keep_one(nameless, simhash.similar(nameless)).collect()
    assert sorted((r["text"], r["doc_id"]) for r in left) == [("a b c d e f", None), ("q r s t u v w", None), ("x y z x1 y1", 5)]


def test_one_identifier_of_different_texts(spark):
    """A row goes only for one of its own group."""
    x, y, z = "a b c d e f g", "q r s t u v w", "k l m n o p"
    near = [" ".join(f"w{i}" for i in range(400)) + tail for tail in ("", " end")]
    rows = [(1, x), (1, y), (1, y), (2, x), (3, y), (3, z), (4, near[0]), (4, near[1]), (5, near[1]), (6, z)]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string")
    kept = sorted(simhash.keep_one(docs, simhash.similar(docs)).collect())
    assert [(r["doc_id"], r["text"]) for r in kept if r["doc_id"] != 4] == [(1, x), (1, y), (3, z)] and {r["fingerprint"] for r in kept} == {"f"}
    assert [r["text"] in near for r in kept if r["doc_id"] == 4] == [True]


def shingles(t):
    w = t.lower().encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("tile", [simhash.TILE, 8])
def test_similar_texts_against_brute_force(spark, tile):
    """Pairs of 0.84 and more are found, pairs of 0.74 and less are not, and between them the sketch decides."""
    rng = np.random.default_rng(3)
    texts = []
    for g in range(12):
        base = [f"v{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 500)))]
        for _ in range(9):
            own = list(base)
            for k in rng.integers(0, len(own), int(rng.integers(0, 1 + len(own) // 25))):
                own[k] = f"n{rng.integers(0, 10**9)}"
            texts.append(" ".join(own) + (" tail" if g % 3 else ""))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r["id"]: r["root"] for r in simhash.similar(docs, tile=tile).collect()}
    sets = [shingles(t) for t in texts]
    share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i)}
    sure = [p for p, s in share.items() if s >= 0.84]
    assert len(sure) > 50 and sum(root[i] == root[j] for i, j in sure) >= 0.98 * len(sure)
    loose = simhash.Forest(len(texts))
    for (i, j), s in share.items():
        if s > 0.74:
            loose.join(np.array([i]), np.array([j]))
    assert all(loose.root[i] == loose.root[j] for i, j in share if root[i] == root[j])


def test_sketches_estimate_the_share():
    base = [f"w{i}" for i in range(3000)]
    for changed in (0, 20, 60, 150):
        other = [f"x{i}" if changed and i % (3000 // changed) == 0 else w for i, w in enumerate(base)]
        a, b = " ".join(base).encode(), " ".join(other).encode()
        k = simhash._sketches(*simhash._gathered([a, b], 5))
        want = len(shingles(a.decode()) & shingles(b.decode())) / len(shingles(a.decode()) | shingles(b.decode()))
        assert abs(float(simhash.shared(k[:1], k[1:])[0]) - want) < 0.1


def test_frequent_keys_are_spread(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "FREQUENT", 5)
    spark.createDataFrame([(i, 1 if i < 50 else i) for i in range(80)] + [(99, None)], "id long, k long").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    other = spark.createDataFrame([(k, f"v{k}") for k in range(70)], "k long, v string")
    often = common.frequent(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "n")
    assert often == [1]
    for how in ("inner", "left"):
        want = by_text(rows.join(other, "k", how), "id", "k", "v")
        assert by_text(common.join_spread(rows, other, "k", often, how), "id", "k", "v") == want


def test_samples_of_repeated_rows(spark):
    same = spark.range(20_000).select(F.lit(7).alias("id"), F.lit("x").alias("t"))
    few = same.withColumn("id", F.when(F.rand(1) < 0.5, 1).otherwise(F.lit(2)))
    assert [len(common.hash_sample(df, 1500)) for df in (same, few, same.limit(3), same.limit(0))] == [1500, 1500, 3, 0]
    mixed = spark.range(20_000).select(F.lit(7).alias("id"), F.col("id").cast("string").alias("t"))
    assert len({r["t"] for r in common.hash_sample(mixed, 1500)}) == 1500


def test_what_is_shipped_needs_no_package(spark, tmp_path):
    """A worker that can't import this package reads models and probes all the same."""
    net = langid.train([b"abc abd", b"xyz xyw"], ["a", "b"], hidden=2, steps=2)
    for value in (net, suffixes.Probe([("1", b"a b c")], 8), linecrf.LineField(np.zeros((17, 2)), np.zeros((2, 2)))):
        file = tmp_path / "value"
        file.write_bytes(cloudpickle.dumps(value))
        code = f"import pickle, sys; x = pickle.load(open({str(file)!r}, 'rb')); assert 'loomgraph' not in sys.modules; print(type(x).__name__)"
        said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
        assert said.stdout.strip() == type(value).__name__, said.stderr


@pytest.mark.parametrize("tile", [simhash.TILE, 40])
def test_links_hold_components_together(spark, tile):
    rng = np.random.default_rng(1)
    prints = {int(b) ^ sum({1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 6))}) for b in rng.integers(0, 2**63, 12, dtype=np.uint64) for _ in range(40)}
    fps = np.array(sorted(prints), dtype=np.uint64)
    want = simhash.Forest(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4)
        want.join(np.full(len(j), i), j)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, 4, tile)).collect()}
    groups = {}
    for f, w in zip(fps.view(np.int64).tolist(), want.root.tolist(), strict=True):
        groups.setdefault(w, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_suffix_arrays(spark, docs):
    items = [(1, "shared3 shared4 shared5 shared6 shared7 shared8 shared9 shared10 shared11 nope"), (2, "SHARED20 shared21 shared22 shared23 shared24 shared25 shared26 shared27"), (3, "two WORDS!"), (4, None), (5, "..."), (None, "one"), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in suffixes.find(docs, bench).collect()}
    assert (got[5]["n_hit"], got[5]["items"], got[5]["longest"]["words"], got[5]["longest"]["start"]) == (9 + 8, ["1", "2"], 9, 3)
    assert (got[4]["n_words"], got[4]["n_hit"], got[4]["items"]) == (2, 2, ["3"])
    assert (got[3]["n_hit"], got[3]["items"]) == (1, ["2"])  # the item without identifier marks the word only
    assert (got[0]["n_words"], got[0]["n_items"]) == (0, 0)
    kept = suffixes.decontaminate(docs, bench)
    assert kept.columns == docs.columns and not {5, 6} & {r["doc_id"] for r in kept.collect()} and kept.count() == docs.count() - 2
    assert {r["n_items"] for r in suffixes.find(docs, bench.limit(0)).collect()} == {0}
    assert suffixes.find(docs.limit(0), bench).collect() == []


def test_suffix_arrays_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"shared{k}" for k in range(i, i + 9))) for i in range(0, 40, 3)], "item_id long, text string")
    whole = by_text(suffixes.find(docs, bench), "doc_id", "n_hit", "items", "longest")
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 200)
    assert by_text(suffixes.find(docs, bench), "doc_id", "n_hit", "items", "longest") == whole


def brute_counts(t):
    t = t or ""
    w = words(t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dups, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_line_field(spark, docs):
    got = linecrf.judge(docs, None)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_text(got, "doc_id", *columns) == sorted(((r["doc_id"], *brute_counts(r["text"])) for r in docs.collect()), key=repr)
    assert all(r["kept"] is not r["base_failed"] for r in got.collect())  # without a field the base rules decide
    assert linecrf.judge(docs.limit(0), None).collect() == []


def test_line_field_learns_boilerplate():
    good = [b"The house stands on the hill, and the wind is cold.\nNobody came that day, so we left early." * 2 for _ in range(20)]
    bad = [b"Home | About | Contact | Terms | Login\n$$$ buy### now*** &&& cheap%%% pills" for _ in range(20)]
    field = linecrf.fit(good + bad, [1] * 20 + [0] * 20)
    label = lambda t: field.decode((np.array(linecrf.line_features(t)[0]) @ field.emit).tolist())
    assert set(label(good[0])) == {1} and set(label(bad[0])) == {0}
    assert linecrf.fit(good, [1] * 20) is None
    # Viterbi against all label sequences
    rng = np.random.default_rng(0)
    for _ in range(20):
        s = rng.normal(size=(6, 2))
        best = max(np.ndindex(*[2] * 6), key=lambda y: sum(s[i, k] for i, k in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert tuple(field.decode(s.tolist())) == best


def test_gradients_of_the_network():
    rng = np.random.default_rng(2)
    net = langid.ByteGRU.new(["a", "b"], 3, rng)
    for k in ("inputs", "recurrent", "output", "bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, y = rng.integers(0, 256, (7, 4)), np.array([0, 1, 1, 0])
    x[5:, 1] = langid.PAD

    def loss():
        p = net.positions(x)[:, np.arange(4), y]
        inside = x != langid.PAD
        return float(-(np.log(p) * inside).sum() / inside.sum())

    grads = net.gradients(x, y)
    for w, g in zip((net.recurrent, net.output, net.bias), grads[1:], strict=True):
        at = tuple(int(rng.integers(0, n)) for n in w.shape)
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        down = loss()
        w[at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 1e-3


def test_pooled_probabilities_against_one_text_at_a_time(monkeypatch):
    net = langid.ByteGRU.new(["a", "b", "c"], 4, np.random.default_rng(5))
    texts = [b"", b"x", bytes(range(256)), "é word ".encode() * 40, b"y" * 64, b"z" * 65]
    ends = np.cumsum([len(t) for t in texts])
    monkeypatch.setattr(langid, "BLOCK", 3)
    got = langid.pooled(net, np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)
    for t, p in zip(texts, got, strict=True):
        parts = [net.positions(np.frombuffer(t[i : i + langid.SEGMENT], np.uint8).astype(np.int64)[:, None]) for i in range(0, len(t), langid.SEGMENT)]
        want = np.concatenate(parts).sum(axis=(0, 1)) / len(t) if parts else np.zeros(3)
        assert np.allclose(p, want, atol=1e-5)


def test_language_id(spark, docs):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.learn(train, queries.third() != 1)
    held = langid.classify(train.where(queries.third() == 1), net)
    right = held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()["a"]
    assert right > 0.97
    got = {r["doc_id"]: r for r in langid.classify(docs, net).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2)) and got[3]["lang_pred"] in net.languages
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.classify(docs, langid.learn(docs.where("lang is null")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"} and langid.classify(docs.limit(0), net).collect() == []


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows)
    pieces = packing.pack(docs).collect()
    whole, sequences = {}, {}
    for p in sorted(pieces, key=lambda p: (repr(p["doc_id"]), p["doc_tokens"], p["start"])):
        assert len(p["ids"]) == 4 * p["length"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(p["length"] for p in pieces) == sum(len(x) // 4 for x in want)
    one = {r["doc_id"] for r in docs.collect()} - {3, 7, 8}
    for i in one:
        whole[i] = b"".join(bytes(p["ids"]) for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]))
        assert whole[i] in want
    assert packing.pack(docs.limit(0)).collect() == []


def _syllables(seed, n):
    """Texts of words that hardly come twice."""
    rng = np.random.default_rng(seed)
    parts = np.array("the an re ing tion or er ou th en ble ly sh nd ea ti in at on es is hé ça ñu ED Wh".split())
    words = ["".join(w) for w in parts[rng.integers(0, len(parts), (n, 4))]]
    return [" ".join(words[i : i + 500]) + "." for i in range(0, n, 500)]


def test_packing_ids_of_odd_texts(monkeypatch):
    """Units, looked up, merged in arrays or tokenised, in parts and with a small memory, are what the tokeniser makes of whole texts."""
    from tokenizers import Tokenizer

    definition = open(packing.default_vocabulary(), encoding="utf-8").read()
    rng = np.random.default_rng(3)
    bits = ["a", "B", "th", "ing", "É", "é", "ß", "ÿ", "×", "÷", "'", "'s", "<", "<|endoftext|>", "<|StartOfText|>", "7", "12", "٣", "²", "ª", "_", "!!", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\x85", "\x1c"]
    bits += ["\0", "\x7f", "\u0301", "İ", "ſ", "中文", "😀", "가", "\u1100\u1161", "œ", "Z", "|", "\x0b", "\r", "x" * 70, "é" * 40]
    texts = ["".join(rng.choice(bits, k)) for k in rng.integers(0, 40, 3000)] + ["", " ", "\n\n"] + _syllables(1, 5000)
    want = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_str(definition).encode_batch_fast(texts, add_special_tokens=False)]
    data = [t.encode() for t in texts]
    words = packing.WordIds(definition)
    assert words.of(data) == want and words.of([b""]) == [b""] and words.of([b" ", b"", b"\n"]) == [b""] * 3
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    monkeypatch.setattr(packing, "CHUNK", 2000)
    words = packing.WordIds(definition)
    assert [words.of([t])[0] for t in data[::7]] == want[::7] and words.of(data) == want


def test_packing_unseen_words_are_cheap():
    """Words that no memory knows take less than the time of the tokeniser itself."""
    import time

    definition = open(packing.default_vocabulary(), encoding="utf-8").read()
    words = packing.WordIds(definition)
    ratios = []
    for seed in range(3):
        texts = _syllables(10 + seed, 60_000)
        began = time.process_time()
        ids = words.of([t.encode() for t in texts])
        between = time.process_time()
        want = words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ratios.append((between - began) / (time.process_time() - between))
        assert [len(x) // 2 for x in ids] == [len(e.ids) for e in want]
    assert min(ratios) < 1, ratios


def test_packing_other_vocabulary():
    """A vocabulary that tells cases apart is not taken apart into lower-case units."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "The": 1, "the": 2, "cat": 3}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    got = packing.WordIds(tokenizer.to_str()).of([b"The cat the", b"", b"the The dog"])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[1, 3, 2], [], [2, 1, 0]]


def test_packing_plan():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 500, 129)
    h[0] = 0
    used = np.zeros(129, int)
    for combo, times in packing.plan(h):
        assert sum(combo) == 128 and len(combo) <= 3 and times > 0
        for c in combo:
            used[c] += times
    assert (used <= h).all() and used.sum() > 0.75 * h.sum()
    a, b = rng.random((6, 4)), rng.random(6)
    x = packing.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and (g < 1e-6).all() and abs(g[x > 0]).max() < 1e-6


def test_licences(spark, docs):
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + next(t for n, t in licences.KNOWN if n == "MIT")
    text = next(t for n, t in licences.KNOWN if n == "ISC")
    rows = spark.createDataFrame([(1, "COPYRIGHT 2001 me\n" + text.upper().replace(",", " ,")), (2, "Intro.\nreleased under the mit licence!\nLicensed under the Apache License, version 2.0"), (3, None), (4, "© x"), (5, mit)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licences.scan(rows).collect()}
    assert got == {1: ("ISC", None), 2: (None, "Apache-2.0,MIT"), 3: (None, None), 4: (None, None), 5: ("MIT", None)}
    own = spark.createDataFrame([("OWN", "one"), ("A", "ONE."), ("E", "")], "license_id string, text string")
    assert {r["doc_id"]: r["license_id"] for r in licences.scan(docs, own).collect()}[3] == "A"
    assert licences.scan(docs.limit(0)).collect() == []
    assert hashlib.sha256(b"one").hexdigest() == licences.digest(b" ONE! ")


ISC_AS_PUBLISHED = """ISC License

Copyright (c) 2004-2010 by Somebody
Copyright Other Body, Inc.

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""


def test_licences_as_published(spark):
    rows = spark.createDataFrame([(1, ISC_AS_PUBLISHED), (2, ISC_AS_PUBLISHED.upper().replace("COPYRIGHT OTHER BODY, INC.\n", ""))], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licences.scan(rows).collect()} == {1: "ISC", 2: "ISC"}
    mit = next(t for n, t in licences.KNOWN if n == "MIT")
    for width in range(30, 100):  # the form does not depend on where lines are wrapped
        wrapped = "\n\n".join(textwrap.fill(p, width) for p in mit.split("\n\n"))
        assert licences.digest(wrapped.encode()) == licences.digest(mit.encode()), width
    for notice in ("Copyright (c) 2020 A", "COPYRIGHT 2001 me", "copyright © me", "© me", "(c) me", "(C) 2020 me", "Copyright [yyyy] [name of copyright owner]", "Copyright Joyent, Inc.", "Copyright by Me", "  Copyright: 2001 me"):
        assert licences.canonical(f"x\n{notice}\ny".encode()) == b"x y", notice
    for prose in ("copyright notice and", "COPYRIGHT HOLDERS BE", "copyright license to", "Copyright Notice", "copyright, or", "copyright"):
        assert licences.canonical(f"x\n{prose}\ny".encode()) == licences.canonical(f"x {prose} y".encode()), prose
    assert licences.canonical(b"(a) x\n(b) y\n(c) z") == b"a x b y c z"


def test_licences_whole(spark):
    """Whole texts of common licences, wrapped and noted as in published packages."""
    texts = dict(licences.whole_texts()[::-1])
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "Zlib"} <= set(texts)
    rows = [(n, "\n".join(textwrap.wrap(t, 66, break_on_hyphens=False)) if not re.search(r"(?m)^\s*Copyright [(\[]", t) else t) for n, t in texts.items()]  # a wrapped notice would be no line of its own
    rows += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Me\nAll rights reserved.\n\n" + texts["BSD-3-Clause"].replace("1.", "*").replace("2.", "*").replace("3.", "*"))]
    rows += [("Apache-2.0", texts["Apache-2.0"].partition("   APPENDIX")[0])]
    got = licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r["license_id"] == r["doc_id"] for r in got)


def test_line_field_learns_from_the_end_of_long_texts(spark):
    """Boilerplate that only stands behind the first lines and characters of long texts is learned."""
    plain = "\n".join(f"this is the line number {i} of a text that all of the documents share" for i in range(70))
    assert len(plain) > 4000
    good = [plain + "\n" + "\n".join(f"and here the story goes on with sentence {i} of document {d}." for i in range(300)) for d in range(30)]
    bad = [plain + "\n" + "\n".join(f"BUY | {i} | {d} !!" for i in range(300)) for d in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, quality int")
    field = linecrf.learn(docs, labels)
    assert field is not None
    share = {r["doc_id"]: r["content_share"] for r in linecrf.judge(docs, field).collect()}
    assert min(share[i] for i in range(30)) > 0.9 and all(share[i] < share[j] for i in range(30, 60) for j in range(30))
