"""What must hold however many rows there are: no product of a group with itself, no single task for a whole table, no key that only few rows keep apart."""

import io
import re
from contextlib import redirect_stdout

from loomgraph import bridge, catalog, catalog_build, catalog_more
from loomgraph.operators import graph
from loomgraph.sources import csharp

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_handlers_meet_one_method_of_their_name(spark):
    """All classes have a method Send, and each handler meets that of its own class alone."""
    text = "class C{0} {{ public void Send(int x) {{ app.MapGet(\"/{0}\", C{0}.Send); app.MapPost(\"/{0}\", Send); app.MapPut(\"/{0}\", Z.Send); }} }}"
    files = spark.createDataFrame([(f"{i}.cs", text.format(i)) for i in range(20)], "file string, text string")
    found = csharp.resolved(csharp.records(files))
    assert not re.findall(r"Join \[__action#\d+\]", plan(found))
    got = {(r["file"], r["method"]): r["source"] for r in found.collect()}
    assert got == {(f"{i}.cs", m): s for i in range(20) for m, s in (("GET", f"C{i}.Send(int)"), ("POST", f"C{i}.Send(int)"), ("PUT", None))}


def test_files_of_one_row_group_are_many_tasks(spark):
    """F8, F18, F21, F24."""
    for made in (catalog_build._sources, catalog_build._specifications, catalog_more._collections):
        assert made(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_pages_of_one_short_hash(spark, tmp_path):
    """the names of these two pages have the same eight digits."""
    pages = spark.createDataFrame([(31833, "http://a/b"), (71633, "http://a/c"), (1, "http://a/d")], "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["js_call_sites"](spark, str(tmp_path)).collect())
    assert [n for _, n in got] == [4, 4, 4] and len({v for v, _ in got}) == 2


def test_lines_are_joined_once_for_usages(spark):
    """Edges, their ends and what is asked for read one written table."""
    for name in ("usage_edges", "usage_counts", "source_excerpt"):
        assert "lineitem.parquet" not in plan(catalog.QUERIES[name](spark, SF))


def test_levels_read_written_edges(spark, monkeypatch):
    """the Contains edges are written before the first level, with their identifiers."""
    written, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df.columns) or real(df))
    catalog.QUERIES["describe_api"](spark, SF)
    assert written[0] == ["workspace", "from_id", "to_id"] and len(written) == 6


def test_partitions_follow_the_rows(spark, monkeypatch):
    """what a task tells apart does not grow with the table."""
    monkeypatch.setattr(bridge, "TASK_ROWS", 100)
    used = bridge.supply_graph(spark, SF).edges
    assert bridge.parts(spark, SF, "lineitem") >= 60 and re.search(r"project_key#\d+L?, package_key#\d+L?, (6\d|\d{3,})\)", plan(used))
