"""Graphs against plain Python, and the rounds they take."""

from collections import defaultdict

import pytest

from tarn.operators import graph


def table(spark, edges):
    return spark.createDataFrame(edges, "parent long, child long")


def walk(edges):
    """All pairs with a way of one edge or more."""
    out = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            out[a].add(b)
    pairs = set()
    for a in list(out):
        front = set(out[a])
        seen = set()
        while front:
            seen |= front
            front = {c for b in front for c in out.get(b, ())} - seen
        pairs |= {(a, b) for b in seen}
    return pairs


def depths(edges, roots, stop=()):
    found = {}
    for r in set(roots) - set(stop):
        found[r, r] = 0
        front = [r]
        while front:
            new = []
            for a in front:
                for x, y in edges:
                    if x == a and y is not None and y not in stop and (r, y) not in found:
                        found[r, y] = found[r, a] + 1
                        new.append(y)
            front = new
    return sorted((r, n, d) for (r, n), d in found.items())


def components(edges):
    pairs = walk(edges)
    nodes = {x for e in edges if None not in e for x in e}
    return sorted((n, min({n} | {b for a, b in pairs if a == n and (b, n) in pairs}), (n, n) in pairs) for n in nodes)


def made(rng, n, m, chains):
    """A random graph with chains of several lengths, rings, loops and repeated edges."""
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
    at = n
    for k in range(chains):
        size = int(rng.integers(1, 9))
        ids = list(range(at, at + size))
        at += size
        ends = [int(x) for x in rng.integers(0, n, 2)] if k % 4 else [0, 0] if k % 8 else None
        way = [ends[0], *ids, ends[1]] if ends else [*ids, ids[0]]
        edges += list(zip(way, way[1:]))
    return edges + edges[:5] + [(None, 1), (1, None)]


@pytest.mark.parametrize("seed", (1, 3))
def test_against_plain_python(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    edges = made(rng, 14, (12, 16, 20, 30)[seed], 10)
    df = table(spark, edges)
    roots = sorted({int(x) for x in rng.integers(0, 40, 4)})
    got = graph.closure(spark.createDataFrame([(r,) for r in roots], "root long"), df)
    assert sorted(map(tuple, got.collect())) == depths(edges, roots)
    stop = [int(x) for x in rng.integers(0, 40, 3)]
    got = graph.closure(spark.createDataFrame([(r,) for r in roots], "root long"), df, spark.createDataFrame([(x,) for x in stop], "node long"))
    assert sorted(map(tuple, got.collect())) == depths(edges, roots, stop)
    assert sorted(map(tuple, graph.components(df).collect())) == components(edges)
    cyclic = {n for n, _, c in components(edges) if c}
    assert {r.node for r in graph.leading_to_cycles(df).collect()} == cyclic | {a for a, b in walk(edges) if b in cyclic}


def test_updates(spark, rng):
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 25, (34, 2))}
    pairs = graph.reachable(table(spark, sorted(edges)))
    assert {tuple(r) for r in pairs.collect()} == walk(edges)
    for _ in range(3):
        gone = {e for e in edges if rng.random() < 0.15}
        come = {(int(a), int(b)) for a, b in rng.integers(0, 30, (4, 2))}
        pairs = graph.updated(pairs, table(spark, sorted(edges)), table(spark, sorted(come)), table(spark, [*sorted(gone), (99, 98)]))
        edges = edges - gone | come
        assert {tuple(r) for r in pairs.collect()} == walk(edges) and pairs.count() == len(walk(edges))


def test_an_update_looks_at_what_changes(spark, monkeypatch):
    """Rows that an update takes out, puts back or brings in are those that the changed edges touch."""
    edges = [(10 * k + i, 10 * k + i + 1) for k in range(300) for i in range(8)]
    pairs = graph.reachable(table(spark, edges))
    sizes = []
    written = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (out := written(df, name), sizes.append((name, out.count())))[0])
    out = graph.updated(pairs, table(spark, edges), table(spark, [(8, 10)]), table(spark, [(23, 24)]))
    assert {tuple(r) for r in out.collect()} == walk([e for e in edges if e != (23, 24)] + [(8, 10)])
    assert max(n for name, n in sizes if name in ("gone", "lost", "first", "back", "added", "new")) <= 81


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """100,000 nodes in a row, a ring as long, and what leads into it."""
    rounds = []
    written = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (rounds.append(name), written(df, name))[1])
    n = 100_000
    line = spark.range(n).selectExpr("id as parent", "id + 1 as child")
    got = graph.closure(spark.createDataFrame([(0,)], "root long"), line)
    assert got.where("depth = node and root = 0").count() == n + 1 and len(rounds) < 40
    rounds.clear()
    ring = spark.range(n).selectExpr("id as parent", f"(id + 1) % {n} as child").unionByName(table(spark, [(-1, 5), (-2, -1)]))
    found = graph.components(ring)
    assert found.where("component = 0 and cyclic").count() == n and found.where("not cyclic").count() == 2 and len(rounds) < 60


def test_empty(spark):
    none = table(spark, [])
    assert graph.components(none).count() == graph.reachable(none).count() == graph.on_cycles(none).count() == graph.leading_to_cycles(none).count() == 0
    assert graph.updated(none, none, table(spark, [(1, 1)])).collect() == [(1, 1)]
    assert graph.closure(none.selectExpr("parent as root"), none).count() == 0
