"""What the small tables are too plain to show."""

import duckdb
import pytest

from loreforge.jobs import catalog, retrieval
from loreforge.operators import graph, search, writers


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("block", [2, 1000])
def test_short_passages_are_found(spark, block):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alphabet agamma"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "beta"), (2, "alpha beta"), (3, "beta gamma delta"), (4, "gamma"), (5, "lphabet a"), (6, None), (7, "epsilon")], "item_id long, passage string")
    want = [(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if d.text is not None and i.passage is not None and i.passage in d.text]
    assert _rows(search.holding(docs, items, block)) == sorted(want, key=repr)


def test_membership_goes_on_to_the_end(spark, monkeypatch, sf):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(12)] + [("n12", "n3"), ("n5", None)]
    monkeypatch.setattr(retrieval, "_edges", lambda *_: spark.createDataFrame(chain, "src string, dst string"))
    got = {r.member: r.distance for r in retrieval.reach_membership(spark, sf).where("application = 'n0'").collect()}
    assert got == {f"n{k}": k for k in range(1, 13)}


def test_reach_carries_evidence(spark):
    edges = spark.createDataFrame([("a", "b", ["e1"]), ("b", "c", ["e2", "e1"]), ("c", "a", ["e3"])], "src string, dst string, evidence array<string>")
    got = _rows(graph.reach(edges, spark.createDataFrame([("s", "a")], "seed string, node string")))
    assert got == [("s", "a", 0, []), ("s", "b", 1, ["e1"]), ("s", "c", 2, ["e1", "e2"])]


def test_paths_of_cycles_without_roots_and_of_each_edge_back(spark):
    edges = spark.createDataFrame([("p", "q"), ("q", "p"), ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("z", "z")], "src string, dst string")
    want = [("a>b>c", 3, "cycle", "b"), ("a>b>c>d", 4, "leaf", None), ("p>q", 2, "cycle", "p"), ("z", 1, "cycle", "z")]
    assert _rows(graph.call_paths(edges, 5)) == want
    assert _rows(graph.call_paths(edges, 2)) == [("a>b", 2, "limit", None), ("c>b", 2, "limit", None), ("c>d", 2, "leaf", None), ("p>q", 2, "limit", None), ("z", 1, "cycle", "z")]


def test_files_and_entries_of_one_path_are_compared_one_by_one(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    files = make([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1"), ("c", "3"), ("d", None), ("e", "1"), ("e", "2"), ("e", "3"), (None, "5")])
    manifest = make([("a", "2"), ("a", "9"), ("b", "1"), ("c", "7"), ("c", "8"), ("d", None), ("e", "3"), ("e", "2"), ("e", "1"), (None, "6")])
    edges = spark.createDataFrame([("n", "n")], "src string, dst string")
    links = spark.createDataFrame([("a", "a"), ("b", "x"), ("b", "x")], "path string, target string")
    want = [(None, "CHANGED"), ("a", "CHANGED"), ("b", "BROKEN_LINK"), ("b", "UNLISTED"), ("c", "CHANGED"), ("c", "MISSING")]
    assert _rows(writers.export_faults(files, manifest, links, edges.select(edges.src.alias("node")), edges)) == sorted(want, key=repr)


def test_pages_that_share_an_address_are_validated_as_the_sql_does(spark, tmp_path):
    html = lambda *langs: "".join(f'<p lang="{x}"><a href="u{k}">' for k, x in enumerate(langs))
    pages = [("u0", html("de")), ("u0", html("en")), ("u0", html("de")), ("u1", html("fr")), ("u1", html("en")), ("u2", html("de", "fr")), ("u2", html("fr", "fr", "fr", "fr")), ("u4", None), ("u4", html("de"))]
    spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, 1, -5.0), (2, 1, 5.0), (3, 1, None)], "s_suppkey long, s_nationkey long, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1,)], "n_nationkey long").coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    duck = duckdb.connect()
    for name in ("pages", "supplier", "nation"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = duck.execute(catalog.oracle_sql()["bundle_validation"]).fetchall()
    assert _rows(catalog.queries()["bundle_validation"](spark, str(tmp_path))) == sorted(want, key=repr)
