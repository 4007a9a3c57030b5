"""Dominator trees, counted inclusion and bounded paths against plain loops."""

import random

import pytest

from loreforge.operators import flow, graph, structure


def _reach(edges, entries, avoid=None):
    seen, todo = set(), [e for e in entries if e != avoid]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b for a, b in edges if a == n and b != avoid]
    return seen


def _programs(seed, count):
    rng = random.Random(seed)
    out = {}
    for i in range(count):
        k = rng.randint(1, 14)
        edges = {(n, n + 1) for n in range(k - 1) if rng.random() < 0.85} | {(rng.randrange(k), rng.randrange(k)) for _ in range(rng.randint(0, 10))}
        out[f"p{i}"] = edges, [0] if rng.random() < 0.8 else [0, rng.randrange(k)], [rng.randrange(k) for _ in range(3)]
    return out


def _frames(spark, programs):
    edges = spark.createDataFrame([(p, a, b) for p, (e, _, _) in programs.items() for a, b in e], "artifact string, src long, dst long")
    entries = spark.createDataFrame([(p, n) for p, (_, e, _) in programs.items() for n in e], "artifact string, node long")
    return edges, entries, spark.createDataFrame([(p, n) for p, (_, _, c) in programs.items() for n in c], "artifact string, node long")


def test_dominators_against_ways_around_each_node(spark):
    programs = _programs(5, 150)
    edges, entries, candidates = _frames(spark, programs)
    want, arms = set(), set()
    for p, (e, start, asked) in programs.items():
        nodes = _reach(e, start)
        strict = {(n, d) for d in nodes for n in nodes if n != d and n not in _reach(e, start, d)}
        want |= {(p, n, d) for n, d in strict}
        for n in set(asked) & nodes:
            for h in {d for m, d in strict if m == n}:
                after = {b for a, b in e if a == h}
                led = [a for a in after if n in _reach({(x, y) for x, y in e if x != h}, [a])]
                if len(after) > 1 and len(led) == 1:
                    arms.add((p, n, h, led[0]))
    assert {tuple(r) for r in flow.dominators(edges, entries).collect()} == want
    assert {tuple(r) for r in flow.arm_conditions(edges, entries, candidates).collect()} == arms and arms
    tree = flow.dominator_tree(edges, entries).collect()
    assert len(tree) == sum(len(_reach(e, s)) for e, s, _ in programs.values())  # a row for each node
    by = {}
    for r in tree:
        by.setdefault(r.artifact, []).append(r)
    assert {(p, y.node, x.node) for p, rows in by.items() for x in rows for y in rows if x.first < y.first <= x.last} == want
    assert all((p, r.node, r.idom) in want for p, rows in by.items() for r in rows if r.idom is not None)


def test_a_long_artifact_has_a_row_for_each_node(spark):
    n = 2000
    edges = spark.createDataFrame([("a", k, k + 1) for k in range(n - 1)] + [("a", k, k - 3) for k in range(5, n, 7)], "artifact string, src long, dst long")
    entries = spark.createDataFrame([("a", 0)], "artifact string, node long")
    rows = flow.dominator_tree(edges, entries).collect()
    assert sorted((r.node, r.idom) for r in rows if r.node) == [(k, k - 1) for k in range(1, n)]


def _included(includes, members, depth):
    out = {}
    def walk(root, at, way):
        for a, nxt in includes:
            if a != at:
                continue
            copies = members.get(nxt, 0)
            status = "cycle" if nxt in way else "limit" if len(way) > depth else "missing" if copies == 0 else "ambiguous" if copies > 1 else "included"
            key = root, nxt, len(way), status
            out[key] = out.get(key, 0) + 1
            if status == "included":
                walk(root, nxt, [*way, nxt])
    for m, copies in members.items():
        if copies == 1:
            walk(m, m, [m])
    return {(*k, n) for k, n in out.items()}


@pytest.mark.parametrize("depth", [2, 5])
def test_inclusion_against_a_walk(spark, depth):
    rng = random.Random(8)
    includes = sorted({(f"m{rng.randrange(12)}", f"m{rng.randrange(14)}") for _ in range(26)} | {("m1", "m2"), ("m2", "m1"), ("m3", "m3"), ("m2", "m4"), ("m4", "m5")})
    members = {f"m{k}": 2 if k == 7 else 1 for k in range(12)}
    got = structure.expanded(spark.createDataFrame(includes, "member string, includes string"), spark.createDataFrame(list(members.items()), "member string, copies int"), depth)
    assert {tuple(r) for r in got.collect()} == _included(includes, members, depth)


def test_diamonds_are_counted_not_listed(spark):
    links = []
    for k in range(12):
        links += [(f"a{k}", f"b{k}"), (f"a{k}", f"c{k}"), (f"b{k}", f"a{k + 1}"), (f"c{k}", f"a{k + 1}")]
    members = sorted({m for link in links for m in link})
    got = structure.expanded(spark.createDataFrame(links, "member string, includes string"), spark.createDataFrame([(m, 1) for m in members], "member string, copies int"), 30)
    of = {(r.member, r.level): (r.status, r.n) for r in got.where("root = 'a0'").collect()}
    assert len(of) == 36 and of["a12", 24] == ("included", 2**12)


def _paths(edges, depth):
    """All paths in order: roots first, then the least node that is not met yet."""
    after = {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)
    roots = [a for a in sorted(after) if all(b != a for _, b in edges)]
    met, out = set(), []
    def walk(path, phase):
        met.update(path)
        on = after.get(path[-1], [])
        if not on:
            out.append((phase, path, "leaf", None, path))
        elif len(path) == depth:
            out.append((phase, path, "limit", None, path))
        else:
            for b in on:
                if b in path:
                    out.append((phase, [*path, b], "cycle", b, path))
                else:
                    walk([*path, b], phase)
    for r in roots:
        walk([r], 0)
    for r in sorted(after):
        if r not in met:
            walk([r], 1)
    out.sort(key=lambda r: (r[0], r[1]))
    return [(">".join(p), len(p), ending, back) for _, _, ending, back, p in out]


@pytest.mark.parametrize("most", [4, 1000])
def test_bounded_paths_are_the_first(spark, most):
    rng = random.Random(3)
    for edges in (
        [("p", "q"), ("q", "p"), ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("z", "z")],
        sorted({(rng.choice("abcdefgh"), rng.choice("defghijk")) for _ in range(14)}),
    ):
        want = _paths(edges, 4)
        frame = spark.createDataFrame(edges, "src string, dst string")
        got, limits = graph.bounded_paths(frame, 4, most)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want[:most], key=repr)
        assert ("path_limit" in limits) == (len(want) > most)
        assert ("depth_limit" in limits) == any(e == "limit" for _, _, e, _ in want[:most])


def test_work_ends_with_what_is_done(spark):
    edges = [("r", "leaf")] + [(f"n{i}", f"n{j}") for i in range(8) for j in range(i + 1, 8)] + [("r", "n0")]
    frame = spark.createDataFrame(edges, "src string, dst string")
    got, limits = graph.bounded_paths(frame, 8, 1000, work=20)
    assert "work_limit" in limits
    assert {r.path for r in got.collect()} <= {p for p, *_ in _paths(edges, 8)}


def _reaching(nodes, edges, entries):
    """Definitions by ways: states (node, variable) -> definitions until nothing changes."""
    reach = _reach(edges, entries)
    names = {v for _, _, _, uses in nodes for v in uses}
    held = {(n, v): set() for n in reach for v in names}
    for e in entries:
        for v in names:
            held[e, v].add(-1)
    moved = True
    while moved:
        moved = False
        for n, barrier, defines, _ in nodes:
            if n in reach:
                for v in names:
                    out = {-1} if barrier else {n} if v in defines else held[n, v]
                    for a, b in edges:
                        if a == n and not out <= held[b, v]:
                            held[b, v] |= out
                            moved = True
    return {(n, v): (sorted(held[n, v] - {-1}), bool(held[n, v] - {-1}) and -1 not in held[n, v]) for n, _, _, uses in nodes if n in reach for v in set(uses)}


def test_reaching_definitions_against_rounds(spark):
    rng = random.Random(14)
    want, rows = {}, []
    programs = _programs(15, 60)
    for p, (edges, entries, _) in programs.items():
        k = 1 + max([n for e in edges for n in e] + entries)
        nodes = [(n, rng.random() < 0.15, [v for v in "abc" if rng.random() < 0.25], [v for v in "abcd" if rng.random() < 0.3]) for n in range(k)]
        rows += [(p, *n) for n in nodes]
        want |= {(p, *key): value for key, value in _reaching(nodes, edges, entries).items()}
    frame = spark.createDataFrame(rows, "artifact string, node long, barrier boolean, defines array<string>, uses array<string>")
    edges, entries, _ = _frames(spark, programs)
    got = {(r.artifact, r.node, r.variable): (r.definitions, r.definite) for r in flow.reaching(frame, edges, entries.distinct()).collect()}
    assert got == want and any(d for _, d in want.values())
