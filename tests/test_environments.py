"""Identities across environments, judged equivalents, result relations and kept versions on small cases."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F


from stillfresh.functions import identity, names
from stillfresh.operators import explain, selection
from stillfresh.sources.tables import write_result
from stillfresh.streaming import states

SUBMISSION = "submission_id long, dialect string, catalog string, default_schema string, sql string, extras map<string,string>, deps array<struct<name:string,query:string,catalog:string,schema:string>>"


def one(i, schema, sql, deps, dialect="snowflake"):
    return (i, dialect, "cdo", schema, sql, {}, deps and [(*d, "cdo", schema) if len(d) == 2 else d for d in deps])


def hashes(spark, rows):
    return {r.submission_id: r.namespace_hash for r in explain.namespace_hash(spark.createDataFrame(rows, SUBMISSION)).collect()}


def test_same_logic_in_other_schemas(spark):
    a, b = ("cdo.prod.a", "select 1"), ("cdo.prod.b", "select 2")
    h = hashes(spark, [
        one(1, "prod", "select * from cdo.prod.a join CDO.PROD.b", [a, b]),
        one(2, "dev", 'select * from cdo.dev.a join "CDO"."DEV"."B"', [("cdo.dev.b", "select 2"), ("cdo.dev.a", "select 1")]),
        one(3, "prod", "select * from cdo.prod.a join CDO.PROD.b", [("cdo.prod.a", "select 2"), ("cdo.prod.b", "select 1")]),
        one(4, "prod", "select * from cdo.prod.a join cdo.prod.ab", [a, b]),
        one(5, "dev", "select * from cdo.prod.a join CDO.PROD.b", [a, b]),
        one(6, "prod", "select a.prod from cdo.prod.a join CDO.PROD.b", [a, b]),
        one(7, "prod", "select 1", [], "duckdb"), one(8, "dev", "select 1", [], "duckdb"),
        one(9, None, "select 1", []), one(10, "", "select 1", None), one(11, None, None, [("plain", None)]),
    ])
    assert h[1] == h[2]  # spelling and order of dependencies don't count
    assert len({h[i] for i in (1, 3, 4, 5, 6)}) == 5  # swapped definitions, another table, a fixed schema, an unqualified word
    assert h[7] != h[8]
    assert set(h) == set(range(1, 12))
    assert hashes(spark, []) == {}


def test_rehomed_into_the_source_schema(spark):
    deps = [("cdo.prod.raw", "x")]
    rows = [one(1, "prod", "select * from cdo.prod.raw", deps), one(2, "dev", "select * from cdo.prod.raw", deps), one(3, "dev", "select 1", []), one(4, None, "select * from cdo.prod.raw", deps), one(5, "dev", "x", deps, "duckdb")]
    own = hashes(spark, rows)
    got = explain.rehomed_hashes(spark.createDataFrame(rows, SUBMISSION)).collect()
    assert [(r.submission_id, r.schema, r.named) for r in got] == [(2, "PROD", ["PROD"])]
    assert got[0].hash == own[1] != own[2]


def test_where_a_dependency_resolves_counts(spark):
    dep = lambda catalog, schema: [("cdo.raw.a", "select * from x", catalog, schema)]
    rows = [one(1, "dev", "q", dep("cdo", "s1"), "duckdb"), one(2, "dev", "q", dep("cdo", "s2"), "duckdb"), one(3, "dev", "q", dep("cdx", "s1"), "duckdb"), one(4, "dev", "q", dep("cdo", "s1"), "duckdb")]
    got = hashes(spark, rows)
    assert got[1] == got[4] and len({got[1], got[2], got[3]}) == 3
    df = spark.createDataFrame(rows, SUBMISSION)
    lit = F.lit
    whole = lambda dialect, macros=None, signature="c", schema="s": identity.template_hash(lit("v"), lit(dialect), lit("cat"), lit(schema), lit("Body"), F.col("extras"), F.col("deps"), lit(signature).cast("string"), lit(macros).cast("string"))
    r = df.filter("submission_id < 3").select("submission_id", *(c.alias(n) for n, c in {
        "a": whole("duckdb"), "schema": whole("duckdb", schema="t"), "bricks": whole("databricks"), "none": whole("databricks", None), "empty": whole("databricks", ""), "some": whole("databricks", "m"), "other": whole("databricks", None, "d"), "upper": whole("Databricks", None, "C"),
    }.items())).orderBy("submission_id").collect()
    assert r[0].a != r[1].a and r[0].a != r[0].schema and r[0].bricks == r[0].none == r[0].upper and len({r[0].none, r[0].empty, r[0].some, r[0].other}) == 4


def test_pieces_of_a_text(spark):
    text = 'select a.b.c.d, .x.y.z, "A"."b".c, 1.5e3, \'it\'\'s a.b.c\', é.b.c.d "open'
    row = spark.createDataFrame([(text,)], "t string").select(names.text_pieces(F.col("t")).alias("p")).first()
    assert "".join(x.text for x in row.p) == text
    keyed = [(x.key.split(names.JOIN), x.rest) for x in row.p if x.key is not None]
    assert keyed == [(["A", "B", "C"], ".d"), (["A", "b", "C"], ""), (["A", "B", "C"], "")]


def test_judged_equivalents(spark):
    subs = spark.createDataFrame([(1, "c.dev.o", 1, "any", 0, 1000)], "submission_id long, target_key string, execution_type int, policy string, tolerance_ms long, now_ms long")
    now = spark.createDataFrame([(1, "c.raw.x", 200, None), (1, "c.dev.o", 5, None)], "submission_id long, name string, epoch long, producer string")
    then = spark.createDataFrame([(7, "C.raw.x", 200, None), (8, "c.raw.x", 100, None), (9, "c.other.x", 200, None)], "execution_id long, name string, epoch long, producer string")
    met = spark.createDataFrame([(1, i, f"c.p{i}.o", 500, i > 9, i - 6) for i in (7, 8, 9, 10, 11)] + [(1, 12, "c.p12.o", 150, True, 6), (1, 13, "c.p13.o", 500, False, 7)], "submission_id long, source_id long, source_key string, source_epoch long, is_copy boolean, rank int")
    got = {r.source_id: (r.same_upstreams, r.reusable) for r in selection.judge_equivalents(met, subs, now, then).collect()}
    assert got[7] == (True, True) and got[8] == (True, False) and got[9][0] is False
    assert got[10] == got[11] == (True, True)  # copies without inputs read what the submission reads
    assert got[12] == (True, False)  # but no later than the copy
    assert got[13][0] is False
    assert selection.judge_equivalents(met.limit(0), subs, now, then).count() == 0


def test_result_relations(spark):
    name = f"result_{uuid.uuid4().hex}"  # the warehouse folder outlives a session
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, p string")
    write_result(df, name, "table", ("p",))
    write_result(df.filter("k = 1").selectExpr("k + 10 AS k", "p"), name, "incremental")
    assert sorted(map(tuple, spark.table(name).select("k", "p").collect()), key=str) == [(11, "a"), (2, "b"), (3, None)]
    write_result(df.filter("k = 2"), name, "append")
    assert spark.table(name).count() == 4
    write_result(df.limit(0), name, "incremental")
    assert spark.table(name).count() == 4
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    write_result(df, f"{name}_v", "view")
    assert spark.table(f"{name}_v").count() == 3
    with pytest.raises(ValueError, match="no relation"):
        write_result(df, f"{name}_x", "other")


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.range(4000).selectExpr("id", "id AS node").coalesce(1).write.parquet(folder)
    for i in range(3):
        spark.range(20).selectExpr(f"10000 * {i + 1} + id AS id", "id AS node").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id long, node long").option("maxFilesPerTrigger", 1).parquet(folder)
    q = states.stream_node_state(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ["node"], "id")
    q.awaitTermination()
    logged = spark.read.parquet(f"{tmp_path}/out").groupBy("b").count().collect()
    assert {r.b: r["count"] for r in logged if r["count"]} == {0: 4000, 1: 20, 2: 20, 3: 20}
    updated = {p["batchId"]: sum(o["numRowsUpdated"] for o in p["stateOperators"]) for p in q.recentProgress if p["numInputRows"]}
    assert updated == {0: 4000, 1: 20, 2: 20, 3: 20}
    rows = {r.node: r.id for r in states.last_rows(spark, f"{tmp_path}/out", ["node"]).collect()}
    assert rows == {i: 30000 + i if i < 20 else i for i in range(4000)}
