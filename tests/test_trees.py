"""Trees of files: round trips, commits, and what failed attempts leave."""

import hashlib
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loreforge.sources import trees


def _root():
    return tempfile.mkdtemp(prefix="spark-") + "/tree"


def _files(spark, rows, parts=3):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary").repartition(parts)


def test_round_trip_and_next_version(spark):
    root = _root()
    rows = [("index.md", b"# all"), ("a/one.md", "é\n".encode()), ("a/b/two.bin", bytes(range(256))), ("empty", b""), ("null", None)]
    trees.write_tree(_files(spark, rows), root)
    got = {r.path: bytes(r.content) for r in trees.read_tree(spark, root).collect()}
    assert got == {p: c or b"" for p, c in rows}
    assert {(r.path, r.bytes, r.sha256) for r in trees.listing(spark, root).collect()} == {(p, len(c or b""), hashlib.sha256(c or b"").hexdigest()) for p, c in rows}
    assert trees.tree_faults(spark, root).isEmpty()
    trees.write_tree(_files(spark, [("only", b"x")]), root)
    assert [r.path for r in trees.read_tree(spark, root).collect()] == ["only"]
    trees.write_tree(_files(spark, [("only", b"x")]).limit(0), root)
    assert trees.read_tree(spark, root).isEmpty() and trees.listing(spark, root).isEmpty()


def test_a_failed_job_changes_nothing(spark):
    root = _root()
    trees.write_tree(_files(spark, [("a", b"1"), ("b", b"2")]), root)
    for bad in ([("c", b"3"), ("../out", b"4")], [("c", b"3"), ("x//y", b"4")]):
        with pytest.raises(Exception, match="INVALID_PATH"):
            trees.write_tree(_files(spark, bad, 2), root)
        assert sorted(r.path for r in trees.read_tree(spark, root).collect()) == ["a", "b"]
    assert not (Path(root).parent / "out").exists()
    assert len(list(Path(root).glob("data-*"))) == 1  # what the failed jobs wrote is gone
    with pytest.raises(ValueError, match="DUPLICATE_PATH"):
        trees.write_tree(_files(spark, [("a", b"1"), ("a", b"2")]), root)


def test_faults_of_a_tree(spark):
    root = _root()
    trees.write_tree(_files(spark, [("a", b"1"), ("b", b"2"), ("c", b"3")], 1), root)
    folder = next(Path(root).glob("data-*/*"))
    (folder / "a").write_bytes(b"?")
    (folder / "b").unlink()
    (folder / "d").write_bytes(b"4")
    assert sorted(map(tuple, trees.tree_faults(spark, root).collect())) == [("a", "CHANGED"), ("b", "MISSING"), ("d", "UNLISTED")]


def test_files_of_attempts_that_do_not_count_are_not_seen(spark):
    root = _root()
    trees.write_tree(_files(spark, [("a", b"1")], 1), root)
    lost = next(Path(root).glob("data-*")) / "0-999"
    lost.mkdir()
    (lost / "a").write_bytes(b"half")
    assert [bytes(r.content) for r in trees.read_tree(spark, root).select("content", F.lit(1)).collect()] == [b"1"]
