import re

import numpy as np
import xxhash

from loreforge.llm import simhash


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(ids, bits):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (bits[a] ^ bits[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "doc_id as bits", "lang as component_id").limit(500)
    texts = {r.doc_id: r.text for r in docs.collect()}
    bits = {i: _fingerprint(t) for i, t in texts.items()}
    roots = _roots(sorted(texts), bits)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert all(got[i].fingerprint == f"{bits[i]:016x}" and got[i].component_id == roots[i] for i in texts)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(roots.values())


def test_dense_clusters_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", 60)  # both ways through the index
    rng = np.random.default_rng(1)
    values = set()
    for x in rng.integers(0, 1 << 62, 3).tolist():
        for _ in range(400):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                y ^= 1 << int(b)
            values.add(y)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "bits long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = _roots(sorted(signed), {v: v & (1 << 64) - 1 for v in signed})
    assert all(got.get(v, v) == want[v] for v in signed)


def test_nulls_empties_and_repeated_rows(spark):
    rows = [(7, None), (8, ""), (9, " \n"), (3, "One two three four"), (3, "one TWO three four"), (None, "one two three four"), (None, "alone here now"), (5, "w " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {7}
    assert sum(r.component_id == 3 for r in got) == 3
    assert sorted(map(str, (r.doc_id for r in simhash.one_of_each(docs).collect()))) == sorted(["7", "3", "None", "5"])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0
