import numpy as np
import pytest

import corpus_pipeline
from loreforge.llm import simhash, similar


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def kept(texts):
    """Ids that stay, by comparing all pairs."""
    sets, bits, parent = {i: _shingles(t) for i, t in texts.items()}, {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            shared = len(sets[a] & sets[b])
            if a < b and ((bits[a] ^ bits[b]).bit_count() <= 3 or 5 * shared >= 4 * len(sets[a] | sets[b]) > 0):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in texts if find(i) == i}


def _synthetic():
    rng, texts = np.random.default_rng(5), []
    vocabulary = np.array([f"w{k}" for k in range(3000)])
    for size, changes in ((60, 1), (200, 1), (200, 4), (600, 5), (600, 11), (600, 16)) * 8:
        words = rng.choice(vocabulary, size)
        texts.append(" ".join(words))
        for _ in range(2):
            near = words.copy()
            near[rng.choice(size, changes, replace=False)] = rng.choice(vocabulary, changes)
            texts.append(" ".join(near))
    words = rng.choice(vocabulary, 100)  # a chain, each link a word further from the first
    for k in range(0, 60, 6):
        words[k] = "new"
        texts.append(" ".join(words))
    return texts


def test_recall_against_brute_force(spark):
    texts = dict(enumerate([*_synthetic(), "", "one two", "One  two\n", "one three"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = kept(texts)
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, docs, None).collect()} == want
    assert len(want) < simhash.one_of_each(docs).count()  # three bits alone leave near copies


@pytest.mark.parametrize("rows", [1000])
def test_recall_on_documents(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(rows)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, docs, sf).collect()} == kept(texts)


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(similar, "LONG", 3000)  # second keys and blocks
    rng = np.random.default_rng(2)
    words = np.array([f"w{k}" for k in range(2000)])
    first, texts = rng.choice(words, 150), {}
    for i in range(120):
        near = first.copy()
        near[rng.choice(150, rng.integers(1, 9), replace=False)] = rng.choice(words, 1)
        texts[i] = " ".join(near)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each(docs, alike=True).collect()}
    assert got == kept(texts) and 1 < len(got) < 100


def test_spanning_joins_what_is_alike():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(6):
        base = rng.choice(1 << 40, 50, replace=False)
        for _ in range(8):
            one = base.copy()
            one[rng.choice(50, rng.integers(0, 10), replace=False)] = rng.choice(1 << 40, 1)
            sets.append(np.unique(one).astype(np.uint64))
    roots = np.arange(len(sets)) // 2  # every two hang together already

    def classes(pairs):
        label = roots.copy()
        for i, j in pairs:
            label[label == label[i]] = label[j]
        return [set(np.flatnonzero(label == x).tolist()) for x in np.unique(label)]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    links = similar.spanning(roots, sets)
    assert sorted(map(sorted, classes(links))) == sorted(map(sorted, classes(every))) and len(links) < len(sets)
