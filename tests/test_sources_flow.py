"""Members, their encodings and columns; data flow over small graphs."""

import io
import zipfile

from pyspark.sql import functions as F

from loreforge.operators import flow
from loreforge.sources import members


def _pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_archives_and_folders(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("src/A.rpgle", "one")
        z.writestr("SRC/a.RPGLE", "two")
        z.writestr("../up", "x")
        z.writestr("keys/id.pem", "secret")
        z.writestr("zeros", b"\0" * 5_000_000)
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "target")
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows = members.archive_members(spark, f"file://{tmp_path}/*.zip").collect()
    got = {r.path: (r.status, r.content) for r in rows}
    assert got["src/A.rpgle"] == ("accepted", bytearray(b"one"))
    assert {k: v[0] for k, v in got.items() if k != "src/A.rpgle"} == {"SRC/a.RPGLE": "duplicate", "../up": "path", "keys/id.pem": "excluded", "zeros": "ratio", "link": "linked", None: "damaged"}
    assert all(v[1] is None for k, v in got.items() if k != "src/A.rpgle")
    (tmp_path / "tree/.git").mkdir(parents=True)
    (tmp_path / "tree/.git/config").write_text("x")
    (tmp_path / "tree/m.clle").write_text("y")
    assert [r.path for r in members.folder_members(spark, f"file://{tmp_path}/tree").collect()] == ["m.clle"]


def test_encodings(spark):
    rows = [("é".encode("cp037"), "IBM037", "é", "accepted"), (b"\xff\xfea\0", "utf-16le", "a", "accepted"), (b"\xfe\xff\0a", "utf-16le", None, "BOM_MISMATCH"), (b"\xff", "utf-8", None, "INVALID_ENCODING"), (b"a", "koi8", None, "UNSUPPORTED_ENCODING"), (None, "ascii", None, "UNSUPPORTED_ENCODING")]
    df = spark.createDataFrame([(bytearray(a) if a is not None else None, b, c, d) for a, b, c, d in rows], "c binary, e string, t string, s string")
    assert all((r.d.text, r.d.status) == (r.t, r.s) for r in df.select(members.decoded("c", "e").alias("d"), "t", "s").collect())


def test_description_lines(spark):
    source = [
        "     A                                      UNIQUE",
        "     A          R CUSTOMER                  PFILE(LIB1/CUSTOMER)",
        "     A            ID             5P         RANGE(1 99999)",
        "     A          K ID                        DESCEND",
        "     A                                  1  2'Details'",
        "     A* a comment",
        "     A            WIDE          20A" + " " * 60 + "beyond",
    ]
    body = spark.createDataFrame([("m", "\r\n".join(source))], "key string, text string")
    rows = members.description_kinds(members.lines(body, "key", "text")).orderBy("line_no").collect()
    assert [r.kind for r in rows] == ["keyword", "record", "field", "key", "constant", "field"]
    assert [r.overflow for r in rows] == [False] * 5 + [True]
    assert (rows[2].d_name, rows[2].d_length, rows[2].d_datatype, rows[2].d_functions) == ("ID", "5", "P", "RANGE(1 99999)")
    assert rows[0].line.endswith("UNIQUE")


def _graph(spark, spec, links):
    nodes = spark.createDataFrame([("p", n, b, d, u) for n, b, d, u in spec], "artifact string, node int, barrier boolean, defines array<string>, uses array<string>")
    edges = spark.createDataFrame([("p", a, b) for a, b in links], "artifact string, src int, dst int")
    return nodes, edges, spark.createDataFrame([("p", 0)], "artifact string, node int")


def test_branches_that_both_assign_are_definite(spark):
    nodes, edges, entry = _graph(spark, [(0, False, [], []), (1, False, ["x"], []), (3, False, ["x"], []), (4, False, [], ["x"])], [(0, 1), (0, 3), (1, 4), (3, 4)])
    assert [(r.node, r.definitions, r.definite) for r in flow.reaching(nodes, edges, entry).collect()] == [(4, [1, 3], True)]
    assert _pairs(flow.dominators(edges, entry)) == [("p", 1, 0), ("p", 3, 0), ("p", 4, 0)]


def test_one_branch_barriers_and_loops(spark):
    nodes, edges, entry = _graph(spark, [(0, False, [], []), (1, False, ["x"], []), (4, False, [], ["x"])], [(0, 1), (0, 4), (1, 4)])
    assert [(r.definitions, r.definite) for r in flow.reaching(nodes, edges, entry).collect()] == [([1], False)]
    nodes, edges, entry = _graph(spark, [(0, False, ["x"], []), (1, True, [], []), (2, False, [], ["x"]), (9, False, [], ["x"])], [(0, 1), (1, 2), (2, 0)])
    assert [(r.node, r.definitions, r.definite) for r in flow.reaching(nodes, edges, entry).collect()] == [(2, [], False)]
    assert _pairs(flow.reachable(edges, entry).select(F.col("node"))) == [(0,), (1,), (2,)]
