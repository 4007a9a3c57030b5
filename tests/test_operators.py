"""Semantics that the small tables don't show."""

import json

from pyspark.sql import functions as F

from loreforge.functions import canonical, text, vectors
from loreforge.operators import graph, intervals, packing, relational, search


def _pairs(df):
    return sorted(map(tuple, df.collect()), key=lambda row: [(x is None, x if isinstance(x, str) else "", x if isinstance(x, (int, float)) else 0) for x in row])


def test_canonical_forms_and_rejects(spark):
    # Accepted and rejected cases of the canonical form.
    accept = {
        '{"\\uFB33": "BMP", "\\uD83D\\uDE00": "supplementary"}': ('{"\U0001F600":"supplementary","\uFB33":"BMP"}', None),
        '{"amount": {"decimal": "123.40"}}': ('{"amount":{"decimal":"123.40"}}', "cce8080a529f08904b297ea3c5448dc82a4d63fe1a631130c417be35c1b93bb8"),
        '{"count": {"integer": "18446744073709551615"}}': ('{"count":{"integer":"18446744073709551615"}}', "01a35d9bbb6d2a673cc5ffea6b06d41c312ca48dc7cd329e9fdf9d359c4ae40e"),
        '{"n": 9007199254740991}': ('{"n":9007199254740991}', "e1da48c6a6089f06ecb4e0a2259e658e3786b2420f52baccdf929ec6460d7b41"),
        "[2.0, true, null]": ("[2,true,null]", None),
    }
    reject = {"1.25": "INVALID_NUMBER", "9007199254740992": "UNSAFE_INTEGER", '{"a": 1, "a": 2}': "DUPLICATE_KEY", "NaN": "INVALID_NUMBER", '"\\ud800"': "INVALID_UNICODE", "{": "INVALID_JSON"}
    rows = spark.createDataFrame([(t,) for t in [*accept, *reject, None]], "j string").select("j", canonical.canonical("j").alias("c")).collect()
    for j, c in rows:
        if j is None:
            assert c.canonical is None and c.error is None
        elif j in reject:
            assert c.error == reject[j] and c.sha256 is None
        else:
            assert c.canonical == accept[j][0] and (accept[j][1] is None or c.sha256 == accept[j][1]) and json.loads(c.canonical) == json.loads(j)


def test_masking(spark):
    rows = [("password: hunter2, then", "password=[REDACTED], then"), ('api_key="a b" x', "api_key=[REDACTED] x"), ("Bearer abc.def-1", "Bearer [REDACTED]"), ("see https://u:p@host/x", "see https://[REDACTED]@host/x"), ("plain", "plain")]
    df = spark.createDataFrame(rows, "t string, want string").select(text.mask(F.col("t")), "want")
    assert all(a == b for a, b in df.collect())


def test_paths_and_globs(spark):
    rows = [("a/b.txt", True, False), ("a/../b", False, False), ("/a", False, False), ("a//b", False, False), ("c:\\x", False, False), ("", False, False), ("src/.git/config", True, True), ("keys/id.pem", True, True), ("x/node_modules/y/z.js", True, True), ("a.b", True, False)]
    df = spark.createDataFrame(rows, "p string, ok boolean, ex boolean").select(text.relative_path_ok(F.col("p")).alias("a"), "ok", text.excluded(F.col("p")).alias("b"), "ex", "p")
    assert all(r.a == r.ok and r.b == r.ex for r in df.collect())


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(vectors.valid(F.col("v"), 2)).collect()] == [True, False, False, False, False]
    assert search.vector_top(df.withColumn("id", F.monotonically_increasing_id()), "id", "v", [1.0, 1.0], 3).count() == 1


def test_resolution_never_picks_the_first(spark):
    refs = spark.createDataFrame([(1, "A", "x", False), (2, None, "x", False), (3, None, "x", True), (4, "C", "x", False), (5, None, "y", False)], "ref int, library string, name string, dynamic boolean")
    entities = spark.createDataFrame([("A", "x"), ("B", "x"), ("A", "y"), ("A", "y")], "library string, name string")
    got = {r.ref: (r.resolution, r.candidates, r.target) for r in relational.resolve(refs, entities).collect()}
    assert got == {1: ("resolved", "", "A"), 2: ("ambiguous", "A,B", None), 3: ("dynamic", "", None), 4: ("missing", "", None), 5: ("resolved", "", "A")}


def test_latest_is_frozen_at_the_watermark(spark):
    events = spark.createDataFrame([("a", 1, "p"), ("a", 5, "q"), ("b", 9, "r")], "id string, seq int, s string")
    assert _pairs(relational.latest_as_of(events, ["id"], "seq", 4)) == [("a", 1, "p")]


def test_bfs_bounds_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", None), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("s", "a")], "seed string, node string")
    assert _pairs(graph.bounded_bfs(edges, seeds, 0)) == [("s", "a", 0, "traversal_limit")]
    assert _pairs(graph.bounded_bfs(edges, seeds, 2)) == [("s", "a", 0, ""), ("s", "b", 1, "unresolved"), ("s", "c", 2, "traversal_limit")]
    assert _pairs(graph.closure(edges.where("dst is not null"), spark.createDataFrame([("b",)], "node string"))) == [("a",), ("b",), ("c",), ("d",)]


def test_paths_end_at_leaves_cycles_and_the_limit(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "d"), ("x", "y"), ("y", "z"), ("z", "w")], "src string, dst string")
    assert _pairs(graph.simple_paths(edges, 3)) == [("a>b>c", 3, "cycle"), ("a>d", 2, "leaf"), ("x>y>z", 3, "limit")]


def test_layers_show_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "node string")
    assert _pairs(graph.layers(nodes, edges)) == [("a", 0), ("b", 1), ("c", 2), ("x", None), ("y", None)]


def test_intervals_across_bins(spark):
    points = spark.createDataFrame([("k", 5), ("k", 10), ("k", 19), ("j", 5)], "k string, at long")
    spans = spark.createDataFrame([("k", 0, 10, 1), ("k", 10, 20, 2), ("k", 3, 18, 3)], "k string, a long, b long, id int")
    assert _pairs(intervals.containing(points, spans, "k", "at", "a", "b", 4).select("at", "id")) == [(5, 1), (5, 3), (10, 2), (10, 3), (19, 2)]
    other = spans.selectExpr("k", "a as c", "b as d", "id as other")
    assert _pairs(intervals.overlapping(spans, other, "k", ("a", "b"), ("c", "d"), 4).where("id < other").select("id", "other")) == [(1, 3), (2, 3)]


def test_greedy_takes_smaller_ones_after_a_skip(spark):
    rows = spark.createDataFrame([("r", 1, 6), ("r", 2, 5), ("r", 3, 4), ("r", 4, 99), ("s", 1, 99)], "req string, id int, size long")
    assert _pairs(packing.greedy(rows, "req", "id", "size", 10).select("req", "id", "used")) == [("r", 1, 6), ("r", 3, 10)]
    assert _pairs(packing.budget_prefix(rows, "req", "id", "size", 10).select("req", "id")) == [("r", 1)]


def test_appends_and_heads(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (4, None)], "id int, p string")
    assert _pairs(relational.appended(old, new, "id", "p").select("id", "outcome")) == [(1, "same"), (2, "conflict"), (3, "insert"), (4, "insert")]
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, None)], "id int, prev int")
    assert _pairs(relational.heads(chain, "id", "prev")) == [(3, 2), (9, None)]


def test_snapshots_are_closed_and_bounded(spark):
    import pytest

    from loreforge.operators import snapshots

    docs = spark.createDataFrame([(1, "a"), (2, "password=x")], "id int, t string")
    snapshot = snapshots.members({"doc": (docs, "id"), "gone": (docs.where("id = 2"), "id")})
    facts = snapshots.scan(snapshot, {"doc": (docs, "id", F.col("t"))})
    assert _pairs(snapshots.missing(snapshot, facts)) == [("gone", "2")]
    assert snapshots.bounded(facts, 2).count() == 2
    with pytest.raises(ValueError, match="RESULT_LIMIT"):
        snapshots.bounded(facts, 1)
    pages = snapshots.exported(facts)
    assert sorted(r.content for r in pages.collect()) == ["# doc 1\n\na\n", "# doc 2\n\npassword=[REDACTED]\n"]
    assert snapshots.faults(pages, pages).count() == 0
