"""Registered queries on explanations and audits, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain, freshness
from .choices import TRACE, trace
from .queries import CHAIN_OF, EDGES, HUMAN, edges, judged, query, upstreams

LINES = """lines AS (SELECT submission_id, '0' AS path, 'table analysis' AS text, NULL AS badge FROM judged
  UNION ALL SELECT submission_id, '0.0', CASE WHEN has_prior THEN 'target table has a recorded build' ELSE 'target table has no recorded build' END, NULL FROM judged
  UNION ALL SELECT submission_id, '1', 'query analysis', NULL FROM judged WHERE has_prior
  UNION ALL SELECT submission_id, '1.0', CASE WHEN same THEN 'query has not changed' ELSE 'query has changed' END, NULL FROM judged WHERE has_prior
  UNION ALL SELECT submission_id, '2', 'data freshness analysis', NULL FROM judged WHERE has_prior AND same
  UNION ALL SELECT submission_id, '2.0', CASE WHEN n = 0 OR coalesce(unchanged, false) THEN 'upstream data is up to date' WHEN rebuild IS NULL THEN 'upstream data is tolerated: ' || CASE WHEN stale THEN 'within_lag_tolerance' WHEN d > 0 THEN 'tolerated_stale' ELSE 'fresh' END ELSE rebuild END, NULL FROM judged WHERE has_prior AND same
  UNION ALL SELECT submission_id, '2.1.' || (row_number() OVER (PARTITION BY submission_id ORDER BY name) - 1), name || CASE WHEN NOT unprovable AND epoch > recorded_epoch THEN ' changed ' || """ + HUMAN + """ || ' after the build read it' ELSE '' END, CASE WHEN unprovable OR epoch > recorded_epoch THEN 'OUTDATED' ELSE 'FRESH' END
    FROM (SELECT *, (epoch - recorded_epoch) // 1000 AS s FROM verdicts) v WHERE EXISTS (SELECT 1 FROM judged j WHERE j.submission_id = v.submission_id AND has_prior AND same))"""


@query("l30_explain", "SELECT * FROM lines", *CHAIN_OF, LINES)
def _(t):
    out = explain.explain(freshness.decide(judged(t)), upstreams(t))
    return out.select("submission_id", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "text", "badge")


@query("l31_reusable", "SELECT submission_id, CASE WHEN stale THEN 'within_lag_tolerance' WHEN d > 0 THEN 'tolerated_stale' ELSE 'fresh' END AS reuse FROM judged WHERE rebuild IS NULL", *CHAIN_OF)
def _(t):
    return freshness.reusable(judged(t)).select("submission_id", "reuse")


@query("c11_explain_inputs", "SELECT d.decision_id, m.id AS matched, u.id AS unmatched, c.id AS compared FROM decisions d LEFT JOIN executions m ON m.id = d.decision_id % 1500 AND d.decision_id % 3 = 0 LEFT JOIN executions u ON u.id = d.decision_id % 1500 AND d.decision_id % 3 = 1 LEFT JOIN executions c ON c.request_id = d.request_id")
def _(t):
    d = t("decisions").select(
        "decision_id", F.when(F.col("decision_id") % 3 == 0, F.col("decision_id") % 1500).alias("matched_id"), F.when(F.col("decision_id") % 3 == 1, F.col("decision_id") % 1500).alias("unmatched_id"), F.col("request_id").alias("compared_request")
    )
    return explain.explain_inputs(d, t("executions")).select("decision_id", F.col("matched_id_row.id").alias("matched"), F.col("unmatched_id_row.id").alias("unmatched"), F.col("compared_request_row.id").alias("compared"))


@query("c12_project_view", "SELECT invocation, project, environment, region, built, reused FROM (SELECT invocation, project, environment, count(*) FILTER (decision = 'build') AS built, count(*) FILTER (decision <> 'build') AS reused FROM decisions GROUP BY ALL) JOIN (SELECT 'p' || n_nationkey AS project, n_regionkey AS region FROM nation WHERE n_nationkey <> 3) USING (project)")
def _(t):
    projects = t("nation").filter("n_nationkey <> 3").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("project"), F.col("n_regionkey").alias("region"))
    envs = t("decisions").select("environment").distinct()
    return explain.project_view(t("decisions"), projects, envs).select("invocation", "project", "environment", "region", "built", "reused")


@query(
    "m5_view_leaves",
    "SELECT start, name, CASE WHEN right(name, 1) = '9' THEN 'unknown' ELSE 'table' END AS kind FROM walk WHERE name NOT IN (SELECT dst FROM edges)",
    EDGES,
    "walk AS (WITH RECURSIVE w AS (SELECT DISTINCT dst AS start, dst AS name FROM edges UNION SELECT start, src FROM w JOIN edges ON dst = name) SELECT * FROM w)",
)
def _(t):
    e = edges(t).select(F.col("dst").alias("name"), F.col("src").alias("dep"))
    return explain.view_leaves(e, t("nodes").filter("right(uid, 1) <> '9'").select(F.col("uid").alias("name")), e.select(F.col("name").alias("start")).distinct())


@query("m8_audit_policy", "SELECT node_uid AS uid, bool_and(CASE WHEN id % 60 % 2 = 0 THEN true ELSE id % 120 > 60 END) AS ok FROM (SELECT *, CAST(split_part(node_uid, '.', 2) AS INT) AS id FROM (SELECT DISTINCT node_uid FROM executions)) GROUP BY 1".replace("id % 60 % 2 = 0 THEN true ELSE id % 120 > 60", "id % 2 = 0 THEN true ELSE false"))
def _(t):
    rows = t("executions").select(F.col("node_uid").alias("uid"), F.concat_ws("|", "id", "logic_hash").alias("row"))
    number = F.split("uid", r"\.")[1].cast("int")
    decided = rows.select("uid").distinct().withColumn("decision", F.when(number % 2 == 0, "skip").otherwise("build"))
    return explain.audit_policy(decided, rows, rows.withColumn("row", F.concat("row", F.lit("+"))), rows)


POLICY = """saved AS (SELECT coalesce(part, '-') AS uid, k || '|' || name AS row FROM prev), fresh AS (SELECT coalesce(part, '-') AS uid, k || '|' || name AS row FROM sel),
  taken AS (SELECT uid, CASE WHEN right(uid, 1) IN ('1', '2', '-') THEN 'skip' ELSE 'build' END AS decision FROM (SELECT uid FROM saved UNION SELECT uid FROM fresh)),
  wanted AS (SELECT uid, row FROM saved JOIN taken USING (uid) WHERE decision = 'skip' UNION ALL SELECT uid, row FROM fresh JOIN taken USING (uid) WHERE decision = 'build'),
  stored AS (SELECT uid, row FROM wanted WHERE right(uid, 2) <> '21' OR right(row, 1) <> 'L' UNION ALL SELECT uid, row FROM wanted WHERE right(uid, 2) = '17' AND right(row, 1) = '!')"""


@query(
    "m8_policy_tables",
    "SELECT uid, uid NOT IN (SELECT uid FROM (SELECT * FROM wanted EXCEPT ALL SELECT * FROM stored) UNION SELECT uid FROM (SELECT * FROM stored EXCEPT ALL SELECT * FROM wanted)) AS ok FROM taken",
    POLICY,
)
def _(t):
    rows = lambda name: t(name).select(F.coalesce("part", F.lit("-")).alias("uid"), F.concat_ws("|", "k", "name").alias("row"))
    saved, fresh = rows("prev"), rows("sel")
    taken = saved.select("uid").union(fresh.select("uid")).distinct().withColumn("decision", F.when(F.substring("uid", -1, 1).isin("1", "2", "-"), "skip").otherwise("build"))
    kept = saved.join(taken.filter("decision = 'skip'"), "uid").unionByName(fresh.join(taken.filter("decision = 'build'"), "uid")).select("uid", "row")
    # two tables that aren't as their decisions say: one lacks rows, one has some twice
    lacks = kept.filter((F.substring("uid", -2, 2) != "21") | (F.substring("row", -1, 1) != "L"))
    stored = lacks.unionByName(kept.filter((F.substring("uid", -2, 2) == "17") & (F.substring("row", -1, 1) == "!")))
    return explain.audit_policy(taken, saved, fresh, stored)


@query("m10_audit_chain", "SELECT target, p1 < p2 AND p2 < p3 AND p3 < p4 AND p4 < p5 AS ok FROM (SELECT request_id AS target, min(position) AS p1, min(position) + (count(*) % 2) AS p2, min(position) + 2 AS p3, min(position) + 3 AS p4, min(position) + 4 AS p5 FROM trace GROUP BY 1)", TRACE)
def _(t):
    first = trace(t).groupBy("request_id").agg(F.min("position").alias("p"), F.count(F.lit(1)).alias("n"))
    steps = F.array(*(F.struct(F.lit(s).alias("step"), (F.col("p") + d).alias("position")) for s, d in (("submit", F.lit(0)), ("confirm", F.col("n") % 2), ("register", F.lit(2)), ("copy_confirm", F.lit(3)), ("resubmit", F.lit(4)))))
    return explain.audit_chain(first.select(F.col("request_id").alias("target"), F.explode(steps).alias("x")).select("target", "x.step", "x.position"))


@query(
    "l5_rehomed",
    """SELECT execution_id AS submission_id, schema, string_agg(DISTINCT CASE WHEN split_part(name, '.', 2) = 's1' THEN split_part(name, '.', 1) || '.' || schema || '.' || split_part(name, '.', 3) ELSE name END, ',' ORDER BY CASE WHEN split_part(name, '.', 2) = 's1' THEN split_part(name, '.', 1) || '.' || schema || '.' || split_part(name, '.', 3) ELSE name END) AS reads
       FROM inputs JOIN (SELECT DISTINCT execution_id, split_part(name, '.', 2) AS schema FROM inputs WHERE split_part(name, '.', 2) <> 's1') USING (execution_id) GROUP BY 1, 2""",
)
def _(t):
    subs = t("inputs").groupBy(F.col("execution_id").alias("submission_id")).agg(F.collect_list("name").alias("reads")).withColumn("own_schema", F.lit("s1"))
    return explain.rehomed(subs).withColumn("reads", F.array_join("reads", ","))


VALUE = "md5('seed|' || decision_id || '|' || node_uid || '|' || c)"


@query(
    "l8_render_volatile",
    f"""SELECT decision_id, node_uid AS query, c AS call, CASE c WHEN 'now' THEN '1700000000000' ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS value
        FROM (SELECT *, {VALUE} AS h FROM (SELECT *, CASE WHEN decision_id % 2 = 0 THEN 'now' ELSE 'uuid' END AS c FROM decisions) WHERE kind = 'model' AND decision = 'build')""",
)
def _(t):
    d = t("decisions").select("decision_id", "kind", F.col("decision").alias("outcome"), F.lit("own").alias("side"), F.col("node_uid").alias("query"), F.when(F.col("decision_id") % 2 == 0, "now").otherwise("uuid").alias("call"))
    spark = d.sparkSession
    rules = spark.createDataFrame([("now", "clock"), ("uuid", "uuid"), ("random", "random")], "call string, rule string")
    cells = spark.createDataFrame([("model", "build", "own")], "kind string, outcome string, side string")
    return explain.render_volatile(d, rules, cells, 1_700_000_000_000, "seed")
