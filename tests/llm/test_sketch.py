import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loreforge.llm import sketch


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 400), max_size=300), st.lists(st.integers(0, 400), max_size=300)), min_size=1, max_size=6))
def test_peeling_counts_the_difference(pairs):
    a = [np.array(sorted(set(x)), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x, _ in pairs]
    b = [np.array(sorted(set(y)), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _, y in pairs]
    want = np.array([len(set(x) ^ set(y)) for x, y in pairs])
    assert (sketch.differences(a, b) == want).all()
    near = sketch.near(sketch.fingerprints(a), sketch.fingerprints(b))
    both = np.array([max(1, len(x) + len(y)) for x, y in zip(a, b)])
    few = want <= np.array([min(len(x), len(y)) for x, y in zip(a, b)]) * 0.3  # so many are given back for certain but for bad luck
    assert ((near >= 0) & (near <= 1)).all()
    assert np.abs(near - (1 - want / both))[few].sum() <= 0.2
    assert (near[want == 0] == 1).all()


def _rows(spark, docs):
    return {(r.doc_id, r.n_chars): r for r in sketch.compare_versions(docs).collect()}


def test_versions_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(400).selectExpr("doc_id", "text", "doc_id as part", "text as copy")
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in sketch.compare_versions(docs).collect()}
    assert len(got) == len(texts)
    errors = []
    for k, i in enumerate(order):
        t, following = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(t) // 3
        new = t[: len(t) - n] + following[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (sketch.paragraphs(x.encode()).tolist() for x in (t, new, following))
        assert (r.differ_edited, r.differ_next) == (len(set(a) ^ set(b)), len(set(a) ^ set(c)))
        # What the columns say follows from the fingerprints in them, and is close to the truth.
        assert r.near_edited == sketch.near([r.fingerprint], [r.edited_fingerprint])[0]
        assert r.near_next == sketch.near([r.fingerprint], [got[order[(k + 1) % len(order)]].fingerprint])[0]
        errors += [(len(a), near - (1 - differ / max(1, len(a) + len(other)))) for near, differ, other in ((r.near_edited, r.differ_edited, b), (r.near_next, r.differ_next, c))]
    edits, nexts = ([abs(e) for n, e in errors[side::2] if n >= 20] for side in (0, 1))
    print("errors", np.sqrt(np.mean(np.square(edits))), np.sqrt(np.mean(np.square(nexts))), np.mean(np.array(edits) < 1e-9))
    assert np.sqrt(np.mean(np.square(edits))) < 0.1 and np.sqrt(np.mean(np.square(nexts))) < 0.2
    assert np.mean(np.array(edits) < 1e-9) > 0.3  # peeled whole
    same = {}
    for i, t in texts.items():
        same.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    long = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.55 and np.mean([r.near_next for r in long]) < 0.2


def test_a_folded_sketch_is_the_smaller_one():
    rng = np.random.default_rng(2)
    one = np.unique(rng.integers(1, 1 << 62, 900).astype(np.uint64))
    small = sketch.Sketches(np.array([8]))
    small.add(one, np.zeros(len(one), np.int64), np.ones(len(one), np.int64))
    large = sketch.Sketches(np.array([256]))
    large.add(one, np.zeros(len(one), np.int64), np.ones(len(one), np.int64))
    assert (large.count.reshape(3, -1, 8).sum(axis=1).ravel() == small.count).all()
    assert (large.key.reshape(3, -1, 8).sum(axis=1).ravel() == small.key).all()
    assert sketch.near(sketch.fingerprints([one]), sketch.fingerprints([one[:3]]))[0] < 0.3  # sizes far apart
    assert sketch.near(sketch.fingerprints([one]), sketch.fingerprints([one[:0]]))[0] == 0


def test_nulls_ties_and_small_tables(spark):
    schema = "doc_id long, text string, key string"
    rows = [(3, "abc def ghi", "k"), (3, "abc def ghi", "k"), (2, None, None), (1, "", None), (None, "zzz yyy xxx", None), (4, "x " * 200_000, None)]
    got = sketch.compare_versions(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t, _ in rows)
    empty = next(r for r in got if r.doc_id == 2)
    assert (empty.n_paragraphs, empty.near_edited, empty.near_next) == (0, 1.0, 1.0)
    assert sketch.compare_versions(spark.createDataFrame([], schema)).count() == 0
    alone = sketch.compare_versions(spark.createDataFrame(rows[:1], schema)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
