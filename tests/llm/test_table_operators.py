"""Operators on rows: tool calls, sharding, urls; and the pipeline's stages."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, queries, sharding, suffixes, urls

SF = "/root/testdata/sf0.001"


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "add", '{"y": 2, "x": 1}', []), (1, 1, "b", "add", '{"x": "1"}', ["a"]), (1, 2, "c", "add", '{"x": 1, "y": 2, "z": 3}', ["a", "b"]), (1, 3, "d", "none", "{}", ["zz"]), (2, 0, "e", "add", "{oops", ["f"]),
            (2, 1, "f", "add", None, ["e"]), (2, 2, "a", "add", "{}", []), (None, None, None, None, None, None), (2, 3, "g", "add", '{"x": 1.5, "y": true}', None),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(5, "a", "3"), (4, "a", "é\n"), (9, "lost", "x")], "turn long, call_id string, content string")
    schema = {"add": {"type": "object", "required": ["x", "y"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 0}, "y": {"type": "integer"}}}}
    got = {r["call_id"]: r for r in chat.link(calls, results, schema).collect()}
    assert {k: r["level"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "g": 0}
    assert got["a"]["valid"] and got["a"]["result_turn"] == 4 and got["a"]["json"] == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"é\\n"}'
    assert got["b"]["errors"] == ["$.y: missing", "$.x: not of type integer"] and got["c"]["errors"] == ["$.z: not known"]
    assert got["d"]["errors"] == ["no such tool", "depends on zz, which is not there"]
    assert got["e"]["errors"] == ["$: no JSON", "held back by a cycle"] and "$: no arguments" in got["f"]["errors"]
    assert got["g"]["errors"] == ["$.x: not of type integer", "$.y: not of type integer"] and json.loads(got["g"]["json"])["result"] is None
    assert chat.link(calls.limit(0), results, schema).collect() == []


def test_levels_of_long_chains(spark):
    rows = [(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(70)] + [("j", ["c69", "c3", "c69"]), ("k", ["j"]), ("m", ["k", "c0"]), ("x", ["y"]), ("y", ["x"]), ("z", ["x", "c1"])]
    got = {r["call_id"]: r["level"] for r in chat.levels(spark.createDataFrame(rows, "call_id string, depends_on array<string>")).collect()}
    assert got == {f"c{i}": i for i in range(70)} | {"j": 70, "k": 71, "m": 72}


@pytest.mark.parametrize(("value", "schema", "n"), [("ab", {"type": "string", "minLength": 3}, 1), ([1, "x"], {"type": "array", "items": {"type": "integer"}}, 1), (5, {"enum": [1, 5]}, 0), (5, {"maximum": 4, "minimum": 6}, 2), (None, {"type": "null"}, 0)])
def test_violations(value, schema, n):
    assert len(chat.violations(value, schema)) == n


def test_sharding(spark):
    rows = [(i % 50, None if i % 9 == 0 else f"t{i % 7}", i, i) for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, slot long").repartition(7)
    got = sharding.shuffle(docs).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 1003 and set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((a, b) for a, b, _, _ in rows)
    few = sharding.shuffle(docs.limit(3)).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shuffle(docs.limit(0)).collect() == []


def test_communication_matrix():
    counts, sizes = [100, 0, 37, 63], sharding.shard_sizes(200, 7)
    m = sharding.matrix(counts, sizes)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes.tolist()
    mean = np.mean([sharding.matrix([50, 50], np.array([30, 70]), seed=s)[0, 0] for s in range(400)])
    assert 14 < mean < 16
    big = [sharding.draw(np.random.default_rng(s), 10**9, 3 * 10**9, 4000) for s in range(200)]
    assert abs(np.mean(big) - 1000) < 10 and 20 < np.std(big) < 36


def test_urls(spark):
    cases = [
        (1, "http://Example.COM/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"), (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "x://a.b.com/de", "a.b.com", "/de", "com/", "allow"),
        (4, "http://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"), (5, "http://notcom/x", "notcom", "/x", None, None), (6, None, "", "", None, None), (7, "no scheme", "", "", None, None), (8, "http://a.com", "a.com", "", None, None), (9, "http://a.com?x=/en/", "a.com", "", None, None),
        (1, "http://Example.COM/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"), (None, "ftp://h.org/a://b/" + "z" * 5000, "h.org", "/a://b/" + "z" * 5000, None, None),
    ]
    pages = spark.createDataFrame([(a, b, "v") for a, b, *_ in cases], "page_id long, url string, verdict string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in urls.judge(pages).collect()), key=repr)
    assert got == sorted(((a, h, p, r) for a, _, h, p, r, _ in cases), key=repr)
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}
    assert all(verdicts[a] == v for a, *_, v in cases if v) and set(verdicts.values()) <= {"allow", "block"}
    assert {r["verdict"] for r in urls.judge(pages.where("page_id = 4")).collect()} == {"block"} and urls.judge(pages.limit(0)).collect() == []
    assert urls.allowed(pages).columns == pages.columns


def test_entropy(spark):
    e = lambda t: spark.range(1).select(urls.entropy(F.lit(t)).alias("e")).first()["e"]
    assert e("") == 0 and e("aaaa") == 0 and abs(e("abca") - (0.5 * np.log(2) + 2 * 0.25 * np.log(4))) < 1e-9


def test_every_query_has_its_name():
    assert [next(k for k in queries.QUERIES if k.startswith(f"op{n}_")) for n in range(1, 11)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", "s", 0), (900002, "12 34", None, None, None)], docs.schema)
    last = docs.unionByName(odd)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, last, SF)
        n = out.count()
        assert n > 0, name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and n <= last.count()
            assert stage(spark, last.limit(0), SF).count() == 0
        if name == "language_id":
            assert not {900001, 900002} & {r["doc_id"] for r in out.select("doc_id").collect()} and n == docs.count()
        if name == "decontamination":  # every document with an item goes, every other one stays
            found = suffixes.find(last, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert found.where("n_items = 0").count() == n
        last = spark.createDataFrame(out.toPandas(), out.schema)


def test_pipeline_removes_a_document_with_a_single_item(spark):
    import corpus_pipeline

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(1, "nothing of it in here, just words", "en", "s", 1, "k"), (2, f"Behind this: {item} and so on", "en", "s", 1, "k"), (3, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, __lg_hits string")
    left = corpus_pipeline.decontamination(spark, docs.drop("__lg_hits"), SF)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_pipeline_cuts_and_drops(spark):
    """A near copy goes, a passage that two texts share is cut out of both and n_chars follows; other columns come through."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    passage, a, b, c = fresh(60), fresh(80), fresh(80), fresh(300)
    rows = [(1, f"{a} {passage}", "e"), (2, f"{passage} {b}", "f"), (3, c, "g"), (4, c + " one more", "h")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), x) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, n_removed string")
    one = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == [1, 2, 3]
    cut = {r["doc_id"]: r for r in corpus_pipeline.substring_dedup(spark, docs.drop("n_removed"), SF).where("doc_id < 3").collect()}
    assert (cut[1]["text"], cut[2]["text"]) == (a, b) and all(r["n_chars"] == len(r["text"]) for r in cut.values())


def test_trees_decide_where_no_rule_fits(spark):
    """Trees that learn from looks alone judge hosts that no rule names, and get both verdicts right."""
    rules = (("allow", "good.test", "/"), ("block", "bad.test", "/"))
    rng = np.random.default_rng(4)
    good = lambda h, i: f"https://{h}/{'abcdefgh'[i % 8]}{i}"
    bad = lambda h, i: f"https://{h}/x/y/{rng.integers(10**12)}/{i}?a={rng.integers(10**9)}&b=2&c=3"
    rows = [(i, good("good.test", i)) for i in range(150)] + [(1000 + i, bad("bad.test", i)) for i in range(150)]
    held = [(2000 + i, good("new.test", i)) for i in range(50)] + [(3000 + i, bad("new.test", i)) for i in range(50)] + [(2000, good("new.test", 0))]
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in rows + held], "page_id long, url string, suffix string, f_length double")
    got = [(r["page_id"], r["verdict"]) for r in urls.judge(pages, rules).where("rule is null").collect()]
    assert len(got) == len(held) and {v for _, v in got} == {"allow", "block"}
    assert sum((v == "block") == (i >= 3000) for i, v in got) >= 0.95 * len(got)
    statistics = {r["suffix"]: (r["rows"], r["seen"]) for r in urls.suffix_statistics(urls.prepared(pages, rules)).collect()}
    assert statistics["test"][0] == len(rows + held) and 100 < statistics["test"][1] < 200


def test_copies_of_a_url_leave_others_in_the_sample(spark):
    """One url with more rows than the sample, and the smallest hash, is one url of the sample."""
    rules = (("allow", "good.com", "/"), ("block", "bad.com", "/"))
    allow = [f"https://good.com/{i}" for i in range(60)]
    block = [f"https://bad.com/{'x' * 40}/{i}/a/b/c/d?p=1&q=2" for i in range(60)]
    hashes = spark.createDataFrame([(u,) for u in allow], "url string").select("url", F.xxhash64("url").alias("h")).orderBy("h").limit(1)
    most = hashes.first()
    blocked = spark.createDataFrame([(u,) for u in block], "url string").where(F.xxhash64("url") > most["h"])
    block = [r["url"] for r in blocked.collect()]
    assert len(block) > 30
    rows = allow + block + [most["url"]] * 300 + [f"https://other.com/{'x' * 40}/7/a/b/c/d?p=1&q=2", "https://other.com/7"]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules, sample=200).collect()
    assert len(got) == len(rows)
    assert [r["verdict"] for r in sorted(got, key=lambda r: r["page_id"])[-2:]] == ["block", "allow"]
