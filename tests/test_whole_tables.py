"""As-of steps on whole tables with a hot name, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stillfresh.operators import audit, explain, history


def test_producers_of_a_hot_name(spark):
    rng = random.Random(1)
    name = lambda: "hot" if rng.random() < 0.8 else f"n{rng.randrange(9)}"
    reads = [(i, name(), rng.choice((None, rng.randrange(500)))) for i in range(400)]
    builds = [(name(), rng.choice((None, rng.randrange(500))), i, rng.choice((None, f"h{i}"))) for i in range(400)]
    out = history.batch_producers(spark.createDataFrame(reads, "read_id long, name string, read_epoch long"), spark.createDataFrame(builds, "name string, epoch long, ord long, logic_hash string"), scope=())
    want = {}
    for i, n, e in reads:
        later = [(b[1], -b[2], b[3]) for b in builds if b[0] == n and e is not None and b[1] is not None and b[1] >= e]
        want[i] = min(later)[2] if later else None
    assert "name" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)  # no pairs of a name
    assert {r.read_id: r.logic_hash for r in out.collect()} == want and out.count() == len(reads)


def test_copy_parents_of_a_hot_key(spark):
    rng = random.Random(2)
    key = lambda: rng.choice(("a", "a", "a", "b", "c"))
    rows = [(7 + 3 * i, key(), rng.choice((None, key())), rng.randrange(300), rng.randrange(300)) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, target_key string, source_key string, created_ms long, confirmed_ms long")
    parent = {}
    for i, _, source, created, _ in rows:
        known = [(c, j) for j, t, _, _, c in rows if source is not None and t == source and c <= created and j < i]
        if known:
            parent[i] = max(known)[1]
    assert {r.id: r.parent for r in history.copy_parents(table, ()).collect()} == parent
    copy = {r[0] for r in rows if r[2] is not None}
    depth = lambda i, left: 1 + (depth(parent[i], left - 1) if left and parent.get(i) in copy else 0)
    assert {r.id: r.depth for r in history.copy_chain_depth(table, 3, ()).collect()} == {i: depth(i, 3) for i in copy}
    assert history.copy_chain_depth(table.limit(0), scope=()).count() == 0


def test_names_meet_within_their_org_family_and_namespace(spark):
    orgs, rows = [("o1", "f", "n"), ("o2", "f", "n"), ("o1", "g", "n"), ("o1", "f", None)], []
    for k, (o, f, n) in enumerate(orgs):
        rows.append((k + 1, o, f, n, "t", "t", 100 + k, 10, 20, f"l{k}", "p", "e", "u", None))
    cols = "id long, org_id string, family string, namespace string, target_key string, name string, epoch long, created_ms long, confirmed_ms long, logic_hash string, project string, environment string, node_uid string, source_key string"
    built = spark.createDataFrame(rows, cols)
    reads = built.select("org_id", "family", "namespace", "name", F.col("id").alias("read_id"), F.lit(1).cast("long").alias("read_epoch"))
    got = history.batch_producers(reads, built.withColumn("ord", F.col("id")))
    assert {r.read_id: r.logic_hash for r in got.collect()} == {k + 1: f"l{k}" for k in range(4)}
    assert {r.id for r in history.no_pending(built, built.filter("id = 4")).collect()} == {1, 2, 3}
    found = history.resolve_deferred(built.withColumn("target", F.col("name")), built.filter("org_id = 'o2'"))
    assert [(r.org_id, r.id) for r in found.collect()] == [("o2", 2)]
    copies = built.unionByName(built.withColumns({"id": F.col("id") + 10, "source_key": F.lit("t"), "target_key": F.lit("c"), "created_ms": F.lit(50).cast("long")}))
    assert {r.id: r.parent for r in history.copy_parents(copies).collect()} == {11: 1, 12: 2, 13: 3, 14: 4}


def test_view_leaves_by_all_paths(spark):
    views = spark.createDataFrame([("s", "x"), ("s", "y"), ("x", "z"), ("y", "z"), ("z", "y"), ("w", "t"), ("z", "t")], "name string, dep string")
    out = explain.view_leaves(views, spark.createDataFrame([("t",)], "name string"), spark.createDataFrame([("s",), ("w",)], "start string"))
    assert {tuple(r) for r in out.collect()} == {("s", "t", "table"), ("s", "y", "cycle"), ("s", "z", "cycle"), ("w", "t", "table")}
    edges = views.filter("name <> 'z'").select(F.col("name").alias("src"), F.col("dep").alias("dst"))
    assert {r.node: r.layer for r in audit.lineage_layers(edges).collect()}["z"] == 2
    with pytest.raises(ValueError, match="cycle"):
        audit.lineage_layers(views.select(F.col("name").alias("src"), F.col("dep").alias("dst")))
