"""Packing of hot requests: what tasks drop beforehand is nothing that a plain loop takes."""

import json
import random

import pytest

from loreforge.operators import assembly, packing


def _greedy(rows, budget):
    out, used = [], {}
    for req, ident, size in sorted(rows, key=lambda r: (r[0], r[1])):
        if used.get(req, 0) + size <= budget:
            used[req] = used.get(req, 0) + size
            out.append((req, ident, size, used[req]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_against_a_loop(spark, seed):
    rng = random.Random(seed)
    sizes = [lambda: rng.randint(0, 120), lambda: rng.randint(40, 60), lambda: int(2 ** rng.uniform(0, 7))][seed - 1]
    rows = [("hot" if rng.random() < 0.8 else f"r{rng.randint(0, 5)}", i, sizes()) for i in rng.sample(range(10_000), 3000)]
    frame = spark.createDataFrame(rows, "req string, id long, size long").repartition(7)
    got = packing.greedy(frame, "req", "id", "size", 1000).collect()
    assert sorted(map(tuple, got)) == sorted(_greedy(rows, 1000))


def test_a_hot_request_leaves_few_rows(spark):
    frame = spark.range(200_000).selectExpr("'hot' as req", "id", "1 + pmod(xxhash64(id), 500) as size").repartition(4)
    left = packing.could_fit(frame, "req", ["id"], "size", "size", 2000)
    assert left.count() < 20_000
    rows = [(r.req, r.id, r.size) for r in frame.collect()]
    got = packing.greedy(frame, "req", "id", "size", 2000).collect()
    assert sorted(map(tuple, got)) == _greedy(rows, 2000)


def test_packages_against_a_loop(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b"]), rng.randint(0, 1), f"k{i:04d}", [f"e{rng.randint(0, 30)}" for _ in range(rng.randint(0, 3))], rng.randint(1, 90)) for i in range(1500)]
    frame = spark.createDataFrame(rows, "request string, place int, key string, evidence array<string>, bytes long").repartition(6)
    want, used, cited = [], {}, {}
    for req, _, key, evidence, size in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if size + 20 * len(evidence) > 900:
            continue
        new = [e for e in evidence if e not in cited.setdefault(req, set())]
        cost = size + 20 * len(new)
        if used.get(req, 0) + cost <= 900:
            used[req] = used.get(req, 0) + cost
            cited[req] |= set(new)
            want.append((req, key, used[req]))
    assert sorted(map(tuple, assembly.package(frame, 900, 20).collect())) == sorted(want)


def _package(request, asked, notes, rows, budget, reserve):
    """The package by serialising all of it anew for each candidate."""
    dump = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)

    def made(chunks, cited, taken):
        used = 0
        for _ in range(20):
            body = dump({"budget": {"count_method": "utf8_bytes", "max": budget, "reserved": reserve, "used": used}, "chunks": chunks, "limitations": [*notes, f"{len(rows) - taken} retrieved facts omitted."], "omitted_evidence_ids": sorted(set(asked) - cited), "request": request})
            if len(body.encode()) == used:
                return body
            used = len(body.encode())
        raise AssertionError

    chunks, cited = [], set()
    for _, ident, fact, evidence, classification in sorted(rows, key=lambda r: r[:2]):
        evidence = sorted(evidence)
        text = dump({"trust": "untrusted_source_data", "fact": fact, "citations": [{"evidence_id": i, "record": r} for i, r in evidence if i not in cited]})
        chunk = {"chunk_id": ident, "text": text, "evidence_ids": [i for i, _ in evidence], "classification": classification, "token_count": len(text.encode())}
        trial = cited | {i for i, _ in evidence}
        if len(made([*chunks, chunk], trial, len(chunks) + 1).encode()) <= budget - reserve:
            chunks.append(chunk)
            cited = trial
    body = made(chunks, cited, len(chunks))
    return (body, len(chunks)) if len(body.encode()) <= budget - reserve else (None, 0)


@pytest.mark.parametrize("budget", [900, 4000, 60_000])
def test_packages_are_within_their_bytes_to_the_last(spark, budget):
    rng = random.Random(9)
    records = {f"e{k}": "é\"x\n" * rng.randint(0, 12) for k in range(25)}
    asked = {"hot": sorted(rng.sample(sorted(records), 12)), "b": ["e1", "gone"], "empty": ["e3"], "große": []}
    notes = {"hot": ["Retrieval was truncated."], "b": [], "empty": [], "große": ["ü" * 300]}
    rows = {r: [(rng.randint(0, 2), f"c{i:03d}", "fäct " * rng.randint(0, 30), [(e, records[e]) for e in rng.sample(sorted(records), rng.randint(1, 4))], rng.choice(["observed", "inferred"])) for i in range(n)] for r, n in (("hot", 220), ("b", 12), ("große", 9), ("empty", 0))}
    requests = spark.createDataFrame([(r, asked[r], notes[r]) for r in asked], "request string, asked array<string>, notes array<string>")
    candidates = spark.createDataFrame([(r, *row) for r, held in rows.items() for row in held] + [("nobody", 0, "c", "f", [("e1", "x")], "observed")], "request string, place int, id string, fact string, evidence array<struct<id: string, record: string>>, classification string").repartition(5)
    got = {r.request: r for r in packing.serialised(requests, candidates, budget, 100).collect()}
    assert set(got) == set(asked)
    for r in asked:
        body, facts = _package(r, asked[r], notes[r], rows[r], budget, 100)
        assert got[r].package == body and got[r].facts == facts
        if body:
            assert got[r].used == len(body.encode()) == json.loads(body)["budget"]["used"] <= budget - 100
        else:
            assert got[r].fault == "CONTEXT_BUDGET_EXCEEDED"
