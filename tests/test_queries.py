"""Each registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

from loreforge.jobs import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = os.environ.get("TEST_SMALL_DIR", "/root/testdata/sf0.001")


def _rows(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SMALL)
    columns = sorted(frame.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    assert _rows(frame.select(*columns).collect()) == _rows(want)


def test_greedy_pack_against_a_loop(spark):
    got = {}
    for r in catalog.queries()["greedy_pack"](spark, SMALL).collect():
        got.setdefault(r.source, []).append((r.doc_id, r.bytes))
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        key, size = f"{r.source}/{r.lang}", len(r.text.encode())
        if sum(n for _, n in want.get(key, [])) + size <= 20000:
            want.setdefault(key, []).append((r.doc_id, size))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["scan_filter_namespace"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src0)" in plan and "text" not in plan.split("ReadSchema")[1]
