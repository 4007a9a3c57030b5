"""The extendible-hash index against plain grouping."""

import hashlib

import numpy as np
import pyarrow as pa

from loreforge.llm import exact


def _plain(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(exact.normalised(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = []
    for data, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for m in members:
            out.append((None if m[1] else m[2], keep, len(members), hashlib.sha256(data).hexdigest()))
    return sorted(out, key=repr)


ROWS = (
    [(k, f"text {k % 7} of\tmany\n" + " " * (k % 3)) for k in range(60)]
    + [(100, None), (101, ""), (102, " \t\r\n\x0b\x0c"), (103, None)]  # all of these are equal; the longest stays
    + [(110, "a b c"), (111, "abc"), (112, "ab c "), (112, "ab c "), (113, "ab c"), (None, "a  b  c"), (None, "only this"), (120, "x" * 300_000), (121, "x" * 299_999 + " x")]
    + [(200 + k, "the hot one") for k in range(200)]
)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, kept int").repartition(5)


def test_groups_against_plain_grouping(spark):
    for capacity in (1, 1024):
        got = exact.exact_groups(_frame(spark, ROWS), capacity).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == _plain(ROWS)
        kept = [r for r in got if r.kept]
        assert len(kept) == len({r.text_sha256 for r in got})  # one of each, also of rows that repeat
        assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    assert exact.exact_groups(_frame(spark, ROWS).limit(0)).collect() == []


def test_a_task_that_forgets_its_texts_gives_the_same(spark):
    frame = _frame(spark, ROWS)
    marks = np.full(1 << (exact.MOST_BITS - 3), 255, np.uint8)
    few, many = (exact.rows(frame, marks, n).where("text is not null").count() for n in (1 << 30, 1000))
    assert few < many <= len(ROWS)


def test_directory_doubles_until_no_bucket_is_overfull():
    rng = np.random.default_rng(5)
    counts = np.zeros(1 << 12, np.int64)
    np.add.at(counts, rng.integers(0, 1 << 12, 3000), 1)
    np.add.at(counts, rng.integers(0, 1 << 5, 4000), 1)  # a crowded stretch
    d = exact.Directory(counts, 50)
    buckets = d.buckets()
    assert len(buckets) == 1 << d.bits == len(d.depth)
    width = len(counts) >> d.bits
    for b in np.unique(buckets):
        own = np.flatnonzero(buckets == b)
        assert len(own) == 1 << (d.bits - d.depth[b]) and (np.diff(own) == 1).all()  # one range of keys
        n = counts[own[0] * width : (own[-1] + 1) * width].sum()
        assert n <= 50 or d.depth[b] == 12
        if d.depth[b]:  # it was split only because the two halves were too many
            left = d.bits - int(d.depth[b]) + 1
            parent = int(own[0]) >> left << left
            assert counts[parent * width : (parent + (1 << left)) * width].sum() > 50
    keys = rng.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2)
    assert (d.slot(keys) == keys >> np.uint64(64 - d.bits)).all()
    assert exact.Directory(np.zeros(16, np.int64)).bits == 0


def test_texts_of_one_key_are_told_apart_by_their_bytes():
    best = lambda n, i: {"chars": -n, "no_id": False, "doc_id": i, "row": i}
    rows = []
    for first, (text, size) in enumerate([(b"one", 3), (b"two", 2), (b"one", 4), (b"three", 1)]):
        rows += [(7, first, text, None, None), (7, first, None, size, best(9, 50 - first))]
    rows += [(8, 9, None, 5, best(1, 1))]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["key", "first", "text", "size", "best"])
    got = [r for b in exact._chains([batch.slice(0, 3), batch.slice(3)]) for r in b.to_pylist()]
    assert [(r["first"], r["chain"], r["keep_id"], r["group_size"]) for r in got] == [(0, 0, 48, 7), (1, 1, 49, 2), (2, 0, 48, 7), (3, 2, 47, 1), (9, 0, 1, 5)]


def test_entries_name_each_text_once(spark):
    index = exact.Index(_frame(spark, ROWS), 4)
    entries = index.entries().collect()
    assert len(entries) == len({exact.normalised(t) for _, t in ROWS})
    assert sum(e.group_size for e in entries) == len(ROWS)
    assert index.slots.count() == 1 << index.directory.bits
    index.drop()
