"""Layers, reachability and cycles against a walk over small graphs, and long chains in few rounds."""

from __future__ import annotations

import random

import pytest

from stillfresh.operators import audit, explain, graphs

EDGES = "src string, dst string"


def random_graph(rng, n, extra, acyclic):
    edges = set()
    for i in range(n - 1):
        if rng.random() < 0.8:
            edges.add((i, i + 1))
    for _ in range(extra):
        a, b = rng.sample(range(n), 2)
        edges.add((min(a, b), max(a, b)) if acyclic else (a, b))
    names = list(range(n))
    rng.shuffle(names)
    return [(f"n{names[a]}", f"n{names[b]}") for a, b in edges]


def follow(edges, start):
    out, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in out:
                out.add(b)
                todo.append(b)
    return out


def longest(edges):
    nodes = {x for e in edges for x in e}
    layer = {}

    def of(n):
        if n not in layer:
            layer[n] = max((of(a) + 1 for a, b in edges if b == n), default=0)
        return layer[n]

    return {n: of(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_acyclic_graphs(spark, seed):
    rng = random.Random(seed)
    edges = random_graph(rng, 30, 6 * seed, acyclic=True)
    df = spark.createDataFrame(edges, EDGES)
    assert {r.node: r.layer for r in audit.lineage_layers(df).collect()} == longest(edges)
    starts = sorted({a for a, _ in edges})[::4]
    asked = spark.createDataFrame([(s,) for s in [*starts, "alone"]], "node string")
    assert {(r.start, r.node) for r in graphs.closure(asked, df).collect()} == {(s, n) for s in starts for n in follow(edges, s)} | {("alone", "alone")}
    back = [(b, a) for a, b in edges]
    want = {"alone"} | {n for s in starts for n in follow(edges, s) | follow(back, s)}
    assert sorted(r.node for r in audit.expand_selection(asked, df, up=True, down=True).collect()) == sorted(want)
    assert explain.cyclic_views(df.toDF("name", "dep")).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_cycles(spark, seed):
    rng = random.Random(10 + seed)
    edges = random_graph(rng, 24, 5, acyclic=False) + [("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    df = spark.createDataFrame(edges, EDGES)
    on = {n for a, n in edges if a in follow(edges, n)}
    assert sorted(r.name for r in explain.cyclic_views(df.toDF("name", "dep")).collect()) == sorted(on) and "r2" in on
    starts = sorted({a for a, _ in edges})[::5]
    got = explain.view_leaves(df.toDF("name", "dep"), spark.createDataFrame([], "name string"), spark.createDataFrame([(s,) for s in starts], "start string"))
    views = {a for a, _ in edges}
    want = {(s, n, "unknown") for s in starts for n in follow(edges, s) if n not in views} | {(s, n, "cycle") for s in starts for n in follow(edges, s) if n in on}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "a"), ("x", "y")], [("a", "a")], [("s", "a"), ("a", "b"), ("b", "c"), ("c", "a")]])
def test_a_cycle_is_an_error(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        audit.lineage_layers(spark.createDataFrame(edges, EDGES)).collect()


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert audit.lineage_layers(none).isEmpty()
    assert [r.node for r in audit.expand_selection(spark.createDataFrame([("a",)], "node string"), none, True, True).collect()] == ["a"]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, tables = 10_000, []
    inner = graphs.written
    monkeypatch.setattr(graphs, "written", lambda df: tables.append(1) or inner(df))
    chain = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    rows = audit.lineage_layers(chain)
    assert rows.filter("node <> layer").isEmpty() and rows.count() == n + 1
    assert len(tables) < 20
    tables.clear()
    some = spark.createDataFrame([(17,), (5_000,)], "node long")
    assert audit.expand_selection(some, chain, up=False, down=True).count() == n + 1 - 17
    assert len(tables) < 20
