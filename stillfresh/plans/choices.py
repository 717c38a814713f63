"""Registered queries on reuse candidates, copies, traces and node tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, names
from ..operators import audit, evidence, explain, freshness, history, selection, traces
from ..sources import tables as sources
from .queries import CANDIDATES, CURRENT, RANKED, query

B = "CAST({0} AS BOOLEAN)"


def flag(expr: str):
    return F.expr(expr)


CASES = "cases AS (SELECT *, id % 7 > 0 AS has_current, id % 3 > 0 AS same_identity, id % 4 > 0 AS same_kind, id % 2 = 0 AS same_upstreams, id % 5 = 0 AS is_copy, id % 6 > 2 AS copy_logic_matches, id % 11 = 0 AS context_changed, id % 13 = 0 AS binding_changed, id % 17 > 0 AS qualified, CASE id % 19 WHEN 0 THEN 'modified' WHEN 1 THEN 'missing' WHEN 2 THEN 'ambiguous' ELSE 'as_built' END AS own_target FROM executions)"


def cases(t):
    return t("executions").selectExpr(
        "*", "id % 7 > 0 AS has_current", "id % 3 > 0 AS same_identity", "id % 4 > 0 AS same_kind", "id % 2 = 0 AS same_upstreams", "id % 5 = 0 AS is_copy", "id % 6 > 2 AS copy_logic_matches",
        "id % 11 = 0 AS context_changed", "id % 13 = 0 AS binding_changed", "id % 17 > 0 AS qualified", "CASE id % 19 WHEN 0 THEN 'modified' WHEN 1 THEN 'missing' WHEN 2 THEN 'ambiguous' ELSE 'as_built' END AS own_target",
    )


@query(
    "l11_select_model",
    """SELECT id, no_candidate, no_candidate IS NULL AS candidate FROM (SELECT id, CASE WHEN NOT has_current THEN 'first_build'
         WHEN NOT m AND NOT same_kind AND (same_identity AND same_upstreams OR is_copy AND copy_logic_matches) THEN 'execution_type_changed' WHEN NOT m AND is_copy THEN 'copy_logic_mismatch'
         WHEN NOT m AND same_identity AND NOT same_kind THEN 'upstream_names_changed' WHEN NOT m AND context_changed THEN 'resolution_context_changed' WHEN NOT m AND binding_changed THEN 'input_binding_changed'
         WHEN NOT m THEN 'identity_mismatch' WHEN NOT qualified THEN 'failed_reuse_qualification' WHEN own_target = 'modified' THEN 'own_target_modified' WHEN own_target = 'missing' THEN 'own_target_missing'
         WHEN own_target = 'ambiguous' THEN 'own_target_changed_or_missing' END AS no_candidate
       FROM (SELECT *, same_kind AND (same_identity AND NOT is_copy OR is_copy AND copy_logic_matches) AS m FROM cases))""",
    CASES,
)
def _(t):
    return selection.select_model(cases(t)).select("id", "no_candidate", "candidate")


@query("l12_select_test", "SELECT id, CASE WHEN NOT has_current THEN 'first_build' WHEN NOT same_identity THEN 'identity_mismatch' WHEN NOT qualified THEN 'failed_reuse_qualification' WHEN id % 5 > 0 THEN 'incomplete_cached_test_results' END AS no_candidate FROM cases WHERE execution_type = 9", CASES)
def _(t):
    return selection.select_test(cases(t).filter("execution_type = 9").withColumn("results_complete", F.col("is_copy"))).select("id", "no_candidate")


@query("l12_select_seed", "SELECT id, CASE WHEN NOT has_current THEN 'first_build' WHEN NOT same_identity OR NOT same_upstreams THEN 'identity_mismatch' WHEN own_target <> 'as_built' THEN 'own_target_modified' END AS no_candidate FROM cases WHERE execution_type = 8", CASES)
def _(t):
    return selection.select_seed(cases(t).filter("execution_type = 8").withColumn("same_values", F.col("same_upstreams"))).select("id", "no_candidate")


@query(
    "l15_qualifies",
    "SELECT id, coalesce(trim(CASE WHEN id % 5 = 0 THEN ' ' ELSE logic_hash END), '') <> '' AND same_kind AND (NOT same_upstreams OR qualified) AND NOT (is_copy AND context_changed) AS ok FROM cases",
    CASES,
)
def _(t):
    df = cases(t).withColumns({
        "sql": F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("logic_hash")), "deps_complete": F.col("same_kind"), "compare_template": F.col("same_upstreams"),
        "body_hash": F.when(F.col("qualified"), "x"), "evaluation_requested": F.col("is_copy"), "volatile": F.col("context_changed"),
    })
    return df.select("id", selection.qualifies(df).alias("ok"))


@query(
    "l16_rejection_codes",
    """SELECT id, skip_code, clone_code FROM (SELECT id,
         CASE WHEN d = 'skip' THEN NULL WHEN d = 'clone' THEN 1 WHEN context_changed THEN 8 WHEN r THEN 2 WHEN binding_changed THEN 4 WHEN is_copy AND same_upstreams THEN 1 WHEN is_copy AND execution_type BETWEEN 2 AND 11 AND execution_type NOT IN (8, 9) THEN 1 ELSE 6 END AS skip_code,
         CASE WHEN d = 'skip' OR d = 'clone' THEN NULL WHEN context_changed THEN 7 WHEN r THEN 2 WHEN binding_changed THEN 7 WHEN is_copy AND same_upstreams THEN 10
              WHEN is_copy AND execution_type BETWEEN 2 AND 11 AND execution_type NOT IN (8, 9) THEN CASE WHEN e <> execution_type THEN 2 WHEN execution_type > 6 THEN 3 ELSE 6 END ELSE 6 END AS clone_code
       FROM (SELECT *, CASE id % 8 WHEN 0 THEN 'skip' WHEN 1 THEN 'clone' ELSE 'build' END AS d, id % 23 = 0 AS r, CASE WHEN id % 3 = 0 THEN execution_type ELSE 1 END AS e FROM cases))""",
    CASES,
)
def _(t):
    df = cases(t).selectExpr(
        "id", "execution_type", "CASE id % 8 WHEN 0 THEN 'skip' WHEN 1 THEN 'clone' ELSE 'build' END AS decision", "IF(id % 23 = 0, 'execution_type_changed', 'x') AS reason", "context_changed AS older_matches",
        "binding_changed AS absent_target_matches", "is_copy AS equivalent", "same_upstreams AS copy_forbidden", "IF(id % 3 = 0, execution_type, 1) AS equivalent_type",
    )
    return selection.rejection_codes(df).select("id", "skip_code", "clone_code")


@query("l18_copy_lookup", "SELECT id FROM cases WHERE NOT same_kind AND execution_type <> 9 AND namespace IS NOT NULL AND NOT (is_copy AND same_upstreams)", CASES)
def _(t):
    df = cases(t).withColumns({"candidate": F.col("same_kind"), "evaluation_requested": F.col("is_copy"), "volatile": F.col("same_upstreams")})
    return selection.copy_lookup(df).select("id")


@query(
    "l20_copy_search",
    """SELECT submission_id, min(rank) FILTER (v = 'choose') AS c, min(rank) FILTER (v = 'stop') AS s
       FROM (SELECT *, CASE WHEN source_id % 7 = 0 THEN 'stop' WHEN source_id % 2 = 0 THEN CASE WHEN source_id % 3 = 0 THEN 'choose' ELSE 'next' END WHEN submission_id % 3 > 0 AND coalesce(stale, 0) = 0 THEN 'choose' ELSE 'stop' END AS v
             FROM (SELECT *, max(CASE WHEN source_id % 2 = 0 AND source_id % 7 > 0 AND source_id % 3 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY submission_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stale FROM met WHERE rank <= 16)) GROUP BY 1""",
    RANKED, CURRENT, CANDIDATES,
)
def _(t):
    met = history.copy_candidates(t("submissions"), history.current_state(t("executions")), 16)
    df = met.withColumns({"same_upstreams": flag("source_id % 2 = 0"), "reusable": flag("source_id % 3 = 0"), "exists": flag("source_id % 7 > 0"), "own_candidate": flag("submission_id % 3 = 0")})
    # candidates of one epoch and target may tie; the counts below don't depend on their order
    out = selection.search_offers(df).groupBy("submission_id")
    return out.agg(F.min(F.when(F.col("verdict") == "choose", F.col("rank"))).alias("c"), F.min(F.when(F.col("verdict") == "stop", F.col("rank"))).alias("s"))


@query("l21_copy_plan", "SELECT id, CASE WHEN NOT same_kind THEN 'refused' WHEN is_copy THEN 'copies_disabled' WHEN id % 3 = 0 OR id % 6 >= id % 3 THEN 'chain_limit' WHEN binding_changed THEN 'unavailable' ELSE 'copy' END AS plan FROM cases", CASES)
def _(t):
    df = cases(t).withColumns({"kind_admits": F.col("same_kind"), "allow_clones": ~F.col("is_copy"), "chain_limit": F.expr("id % 3"), "copy_depth": F.expr("id % 6"), "source_available": ~F.col("binding_changed")})
    return selection.copy_plan(df).select("id", "plan")


@query("l25_publish_copy", "SELECT id, id % 3 = id % 6 AND NOT is_copy AND id % 10 >= id % 7 AS ok FROM cases", CASES)
def _(t):
    df = cases(t).withColumns({"source_id": F.expr("id % 3"), "current_id": F.expr("id % 6"), "source_epoch": F.expr("id % 7"), "current_epoch": F.expr("id % 7"), "source_pending": F.col("is_copy"), "completed_epoch": F.expr("id % 10")})
    return df.select("id", selection.publish_copy(df).alias("ok"))


@query(
    "l24_adopt_inputs",
    "SELECT execution_id, string_agg(name || '@' || coalesce(CAST(least(epoch, 900000000000) AS VARCHAR), '900000000000'), ',' ORDER BY name, coalesce(least(epoch, 900000000000), 900000000000)) AS inputs FROM inputs GROUP BY 1",
)
def _(t):
    grouped = t("inputs").groupBy("execution_id").agg(F.array_sort(F.collect_list(F.struct("name", "epoch"))).alias("now"))
    none = F.array().cast("array<struct<name:string,epoch:bigint>>")
    adopted = grouped.select("execution_id", F.explode(selection.adopt_inputs(none, F.col("now"), F.lit(900000000000))).alias("x"), "now").select("execution_id", "x.name", "x.epoch")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("name", "epoch"))), lambda x: F.concat_ws("@", x["name"], x["epoch"].cast("string")))
    return adopted.groupBy("execution_id").agg(F.array_join(listed, ",").alias("inputs"))


@query("b6_own_target", "SELECT id AS submission_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN coalesce(e <= last_modified_epoch, false) THEN 'as_built' ELSE 'modified' END AS status FROM (SELECT e.id, last_modified_epoch, count(*) FILTER (name = target_key) AS n, max(CASE WHEN name = target_key THEN epoch END) AS e FROM executions e LEFT JOIN inputs i ON execution_id = id GROUP BY ALL)")
def _(t):
    subs = t("executions").select(F.col("id").alias("submission_id"), F.col("target_key").alias("target"), F.col("last_modified_epoch").alias("built_epoch"))
    return freshness.own_target_status(t("inputs").withColumnRenamed("execution_id", "submission_id"), subs)


@query("b9_test_results", "SELECT event_id, value > 0 AND event_id % 3 > 0 AS complete FROM events")
def _(t):
    r = F.struct(F.when(F.col("value") > 0, F.col("value")).alias("failures"), F.when(F.col("event_id") % 3 > 0, True).alias("should_error"), F.lit(False).alias("should_warn"))
    return t("events").select("event_id", selection.complete_test_results(r).alias("complete"))


@query("b11_other_schema", "SELECT execution_id, name, split_part(name, '.', 3) = split_part(target_key, '.', 3) AND split_part(name, '.', 2) <> split_part(target_key, '.', 2) AS sibling FROM (SELECT DISTINCT execution_id, name FROM inputs) JOIN executions ON execution_id = id")
def _(t):
    pairs = t("inputs").select("execution_id", "name").distinct().join(t("executions").select(F.col("id").alias("execution_id"), "target_key"), "execution_id")
    return pairs.select("execution_id", "name", names.same_object_other_schema(F.col("name"), F.col("target_key")).alias("sibling"))


@query("g1_dependency_set", "SELECT execution_id, count(*) > count(DISTINCT name) OR bool_or(producer IS NULL) AS changed FROM inputs GROUP BY 1")
def _(t):
    sets = t("inputs").groupBy("execution_id").agg(F.collect_list("name").alias("now"), F.collect_list(F.when(F.col("producer").isNull(), F.concat("name", F.lit("?"))).otherwise(F.col("name"))).alias("then"))
    return sets.select("execution_id", freshness.dependency_set_changed(F.col("now"), F.col("then")).alias("changed"))


@query("g6_canonical_reads", "SELECT execution_id, string_agg(DISTINCT upper(name), ',' ORDER BY upper(name)) AS reads FROM inputs GROUP BY 1")
def _(t):
    return t("inputs").groupBy("execution_id").agg(F.array_join(selection.canonical_reads(F.collect_list("name")), ",").alias("reads"))


@query("h6_map_hash", "SELECT id, sha256('1:2;' || strlen('1:a;' || f || '1:b;' || g) || ':1:a;' || f || '1:b;' || g || ';') AS h FROM (SELECT id, strlen(project) || ':' || project || ';' AS f, strlen(org_id) || ':' || org_id || ';' AS g FROM executions)")
def _(t):
    return t("executions").select("id", identity.map_hash(F.create_map(F.lit("b"), "org_id", F.lit("a"), "project")).alias("h"))


@query("h21_decision_variant", "SELECT decision_id, CASE WHEN decision = 'build' THEN 'ready_to_execute' ELSE 'skip_execution' END AS variant FROM decisions")
def _(t):
    body = F.concat(F.lit('{"response": {"'), F.when(F.col("decision") == "build", "ready_to_execute").otherwise("skip_execution"), F.lit('": {"id": 1}}}'))
    return t("decisions").select("decision_id", traces.decision_variant(body).alias("variant"))


@query("l9_identity_match", "SELECT id, id % 3 = 0 OR (id % 5 > 0 AND id % 4 = 0) AS ok FROM executions")
def _(t):
    same = identity.identity_matches(F.lit("a"), F.when(F.col("id") % 3 == 0, "a").otherwise("b"), F.when(F.col("id") % 5 > 0, "t"), F.when(F.col("id") % 4 == 0, "t").otherwise("u"))
    return t("executions").select("id", same.alias("ok"))


@query(
    "l4_namespace_hash",
    """SELECT execution_id, sha256(strlen(reads) || ':' || reads || ';') AS h FROM (
         SELECT execution_id, string_agg(a, ',' ORDER BY a) AS reads FROM (
           SELECT DISTINCT execution_id, split_part(name, '.', 1) || '.ns__' || CAST(dense_rank() OVER (PARTITION BY execution_id ORDER BY split_part(name, '.', 2)) - 1 AS VARCHAR) || '.' || split_part(name, '.', 3) AS a FROM inputs) GROUP BY 1)""",
)
def _(t):
    each = t("inputs").groupBy("execution_id").agg(F.array_distinct(F.collect_list("name")).alias("ns"))
    tokens = each.withColumn("tokens", names.schema_tokens(F.transform("ns", names.schema_of)))
    reads = F.array_join(F.array_sort(F.array_distinct(F.transform("ns", lambda n: names.abstract_name(n, F.col("tokens"))))), ",")
    return tokens.select("execution_id", identity.framed_hash(reads).alias("h"))


# Texts that read the inputs of an execution, which runs in schema s0 to s3; one dependency has a definition.
READ_NAMES = "n AS (SELECT DISTINCT execution_id AS id, upper(name) AS name, split_part(upper(name), '.', 2) AS s FROM inputs)"
HOMES = "homes AS (SELECT DISTINCT id, 'S' || CAST(id % 4 AS VARCHAR) AS own FROM n)"
KEYS = "keys AS (SELECT id, s FROM n UNION SELECT id, own FROM homes)"
READ_IN = "read_in AS (SELECT id, own, own AS dest FROM homes UNION SELECT id, own, s FROM homes JOIN keys USING (id))"
TOKENS = "tokens AS (SELECT id, dest, own, s, m, 'ns__' || CAST(dense_rank() OVER (PARTITION BY id, dest ORDER BY m) - 1 AS VARCHAR) AS tk FROM (SELECT id, dest, own, s, CASE WHEN s = own THEN dest ELSE s END AS m FROM read_in JOIN keys USING (id)))"
WRITTEN = """texts AS (SELECT id, dest, own, 'select * from ' || string_agg(x, ' join ' ORDER BY name) AS body, 'select 1 from ' || arg_min(x, name) AS def,
  string_agg('1:3;3:CAT;' || strlen(tk) || ':' || tk || ';' || strlen(o) || ':' || o || ';' || CASE WHEN name = first THEN strlen('select 1 from ' || x) || ':select 1 from ' || x ELSE '1:x' END || ';', '' ORDER BY tk, strlen(o) || ':' || o, x) AS deps, count(*) AS k
  FROM (SELECT *, 'CAT.' || chr(1) || tk || '.' || o AS x, min(name) OVER (PARTITION BY id, dest) AS first FROM (SELECT n.*, t.dest, t.own, t.tk, split_part(n.name, '.', 3) AS o FROM n JOIN tokens t USING (id, s))) GROUP BY id, dest, own)"""
ABSTRACTED = "hashed AS (SELECT t.id, t.dest, t.own, sha256('5:ns-v1;9:snowflake;' || strlen(tk) || ':' || tk || ';' || strlen(body) || ':' || body || ';' || '64:' || sha256('1:0;0:;') || ';' || strlen(CAST(k AS VARCHAR)) || ':' || k || ';' || strlen(deps) || ':' || deps || ';') AS h FROM texts t JOIN tokens o ON t.id = o.id AND t.dest = o.dest AND o.s = t.own)"
READING = (READ_NAMES, HOMES, KEYS, READ_IN, TOKENS, WRITTEN, ABSTRACTED)


def reading(t):
    """Submissions whose SQL reads an execution's inputs, with names as dependencies.

    Rows are small but costly to hash, so they are dealt to all cores, where they would come
    together by bytes.
    """
    each = t("inputs").groupBy("execution_id").agg(F.array_sort(F.collect_set("name")).alias("ns"))
    each = each.repartition(2 * each.sparkSession.sparkContext.defaultParallelism, "execution_id")
    first = lambda n: F.when(n == F.col("ns")[0], F.concat(F.lit("select 1 from "), n)).otherwise("x")
    return each.select(
        F.col("execution_id").alias("submission_id"), F.lit("snowflake").alias("dialect"), F.lit("cat").alias("catalog"), F.concat(F.lit("s"), (F.col("execution_id") % 4).cast("string")).alias("default_schema"),
        F.concat(F.lit("select * from "), F.array_join("ns", " join ")).alias("sql"), F.expr("CAST(map() AS MAP<STRING, STRING>)").alias("extras"),
        F.transform("ns", lambda n: F.struct(n.alias("name"), first(n).alias("query"), F.lit("cat").alias("catalog"), F.lit("s").alias("schema"))).alias("deps"),
    )


@query("l4_namespace_identity", "SELECT id AS submission_id, h AS namespace_hash FROM hashed WHERE dest = own", *READING)
def _(t):
    return explain.namespace_hash(reading(t))


@query(
    "l5_rehomed_hashes",
    "SELECT a.id AS submission_id, a.dest AS schema, a.h AS hash, named FROM hashed a JOIN (SELECT id, h FROM hashed WHERE dest = own) b ON a.id = b.id AND a.h <> b.h JOIN (SELECT id, dest, string_agg(DISTINCT m, ',' ORDER BY m) AS named FROM tokens GROUP BY 1, 2) c ON a.id = c.id AND a.dest = c.dest WHERE a.dest <> a.own",
    *READING,
)
def _(t):
    return explain.rehomed_hashes(reading(t)).withColumn("named", F.array_join("named", ","))


# Reads cut to two relations, so that candidates' and submissions' sets can be the same.
FEW = "few AS (SELECT execution_id, 'raw.s.t' || CAST(CAST(split_part(name, '.t', 2) AS INT) % 2 AS VARCHAR) AS name, max(epoch) AS epoch, max(producer) AS producer FROM inputs GROUP BY 1, 2)"
JUDGED_PAIRS = """pairs AS (SELECT m.submission_id, rank, source_id, source_epoch, source_id % 5 = 0 AS is_copy, execution_type, policy, tolerance_ms, now_ms - source_epoch AS age FROM met m JOIN submissions s USING (submission_id) WHERE rank <= 16),
  now_p AS (SELECT p.*, name, epoch, producer FROM pairs p JOIN few ON execution_id = submission_id),
  then_p AS (SELECT p.submission_id, source_id, name, epoch, producer FROM pairs p JOIN few ON execution_id = source_id),
  read_p AS (SELECT * FROM then_p UNION ALL SELECT submission_id, source_id, name, CASE WHEN epoch IS NULL THEN source_epoch ELSE least(epoch, source_epoch) END, NULL FROM now_p n WHERE is_copy AND NOT EXISTS (SELECT 1 FROM then_p t WHERE t.submission_id = n.submission_id AND t.source_id = n.source_id)),
  side AS (SELECT submission_id, source_id, a.name IS NULL OR b.name IS NULL AS other, a.epoch IS NULL OR b.epoch IS NULL AS unknown, coalesce(a.epoch > b.epoch, true) AS moved, coalesce(a.producer <> b.producer, false) AS made
    FROM now_p a FULL JOIN read_p b USING (submission_id, source_id, name)),
  fold AS (SELECT submission_id, source_id, bool_or(other) AS other, bool_or(unknown) AS unknown, bool_or(made) AS made, count(*) FILTER (moved OR unknown) AS d, count(*) AS n FROM side GROUP BY 1, 2),
  offers AS (SELECT p.submission_id, rank, p.source_id, NOT coalesce(other, false) AS same, n IS NULL OR NOT (other OR unknown OR made OR CASE WHEN execution_type = 9 OR policy = 'any' THEN d > 0 ELSE d = n END AND NOT (tolerance_ms > 0 AND age < tolerance_ms)) AS reusable
    FROM pairs p LEFT JOIN fold f ON p.submission_id = f.submission_id AND p.source_id = f.source_id)"""


@query(
    "l20_judged_search",
    """SELECT submission_id, same, reusable, verdict, count(*) AS n FROM (
         SELECT *, CASE WHEN source_id % 7 = 0 THEN 'stop' WHEN same THEN CASE WHEN reusable THEN 'choose' ELSE 'next' END WHEN submission_id % 3 > 0 AND coalesce(stale, 0) = 0 THEN 'choose' ELSE 'stop' END AS verdict
         FROM (SELECT *, max(CASE WHEN same AND NOT reusable AND source_id % 7 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY submission_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stale FROM offers)) GROUP BY ALL""",
    RANKED, CURRENT, CANDIDATES, FEW, JUDGED_PAIRS,
)
def _(t):
    met = history.copy_candidates(t("submissions"), history.current_state(t("executions")), 16).select("submission_id", "rank", "source_id", "source_key", "source_epoch", F.expr("source_id % 5 = 0").alias("is_copy"))
    name = F.concat(F.lit("raw.s.t"), (F.split_part("name", F.lit(".t"), F.lit(2)).cast("int") % 2).cast("string"))
    few = t("inputs").groupBy("execution_id", name.alias("name")).agg(F.max("epoch").alias("epoch"), F.max("producer").alias("producer"))
    offers = selection.judge_equivalents(met, t("submissions"), few.withColumnRenamed("execution_id", "submission_id"), few)
    offers = offers.withColumns({"exists": F.expr("source_id % 7 > 0"), "own_candidate": F.expr("submission_id % 3 = 0")})
    return selection.search_offers(offers).groupBy("submission_id", F.col("same_upstreams").alias("same"), "reusable", "verdict").agg(F.count(F.lit(1)).alias("n"))


TRACE = """trace AS (SELECT event_id AS position, CASE WHEN event_type IN ('view', 'click') THEN 'confirm' ELSE 'submit' END AS method, 'r' || (event_id % 300) AS request_id,
  CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE 't' || (event_id % 40) END AS target, event_id * 3 AS epoch, event_id % 7 > 0 AS ok, 'model.' || (event_id % 60) AS uid FROM events)"""
PAIRED = "paired AS (SELECT t.position, t.epoch, s.target FROM trace t JOIN (SELECT request_id, min(position) AS p, arg_min(target, position) AS target FROM trace WHERE method <> 'confirm' AND target IS NOT NULL GROUP BY 1) s USING (request_id) WHERE method = 'confirm' AND ok AND s.p < t.position)"


def trace(t):
    return t("events").selectExpr(
        "event_id AS position", "IF(event_type IN ('view', 'click'), 'confirm', 'submit') AS method", "concat('r', event_id % 300) AS request_id",
        "IF(event_type IN ('view', 'click'), NULL, concat('t', event_id % 40)) AS target", "event_id * 3 AS epoch", "event_id % 7 > 0 AS ok", "concat('model.', event_id % 60) AS uid",
    )


@query("c13_confirmed_targets", "SELECT target, arg_max(epoch, position) AS epoch FROM paired GROUP BY 1", TRACE, PAIRED)
def _(t):
    return traces.confirmed_targets(trace(t))


@query("m11_suppression", "SELECT position, equivalent, coalesce(c < position, false) AS proven FROM (SELECT position, 't' || (position % 50) AS equivalent FROM trace) LEFT JOIN (SELECT target, min(position) AS c FROM paired GROUP BY 1) ON target = equivalent", TRACE, PAIRED)
def _(t):
    claims = trace(t).selectExpr("position", "concat('t', position % 50) AS equivalent")
    return traces.audit_suppression(trace(t), claims).select("position", "equivalent", "proven")


@query("m11_all_suppression", "SELECT position, equivalent, coalesce(c < position, false) AS proven FROM (SELECT position, 't' || (position % 50) AS equivalent FROM trace) LEFT JOIN (SELECT target, min(position) AS c FROM paired GROUP BY 1) ON target = equivalent", TRACE, PAIRED)
def _(t):
    claims = trace(t).selectExpr("position", "concat('t', position % 50) AS equivalent")
    return traces.audit_suppression(trace(t), claims).select("position", "equivalent", "proven")


@query("d18_trace_by_node", "SELECT uid, string_agg(method, ',' ORDER BY position) AS calls FROM trace GROUP BY 1", TRACE)
def _(t):
    return traces.trace_by_node(trace(t)).select("uid", F.array_join(F.col("calls.method"), ",").alias("calls"))


@query("c17_replay_compare", "SELECT coalesce(e.session, a.session) AS fixture, coalesce(e.decision_id, a.decision_id) AS entry, CASE WHEN e.decision IS NULL THEN 'unexpected' WHEN a.decision IS NULL THEN 'missing' WHEN e.decision = a.decision THEN 'same' ELSE 'different' END AS outcome FROM (SELECT * FROM decisions WHERE decision_id % 5 > 0) e FULL JOIN (SELECT session, decision_id, CASE WHEN decision_id % 3 = 0 THEN 'skip' ELSE decision END AS decision FROM decisions WHERE decision_id % 7 > 0) a USING (session, decision_id)")
def _(t):
    d = t("decisions").select(F.col("session").alias("fixture"), F.col("decision_id").alias("entry"), F.col("decision").alias("response"))
    return traces.replay_compare(d.filter("entry % 5 > 0"), d.filter("entry % 7 > 0").withColumn("response", F.when(F.col("entry") % 3 == 0, "skip").otherwise(F.col("response"))))


@query("d14_rule_score", "SELECT kind AS file, count(*) FILTER (decision_id % 4 > 0) AS decidable, count(*) FILTER (decision_id % 4 > 0 AND decision <> 'skip') AS mismatches FROM decisions GROUP BY 1")
def _(t):
    return traces.score_rule(t("decisions").select(F.col("kind").alias("file"), "decision", F.when(F.col("decision_id") % 4 > 0, F.col("decision")).alias("expected"), F.lit("skip").alias("actual")))


@query("a10_scrub_metadata", "SELECT user_id, count(*) FILTER (h NOT IN ('authorization', 'x-api-key', 'grpc-status', 'date')) AS n FROM (SELECT user_id, CASE event_id % 6 WHEN 0 THEN 'authorization' WHEN 1 THEN 'x-api-key' WHEN 2 THEN 'grpc-status' WHEN 3 THEN 'date' WHEN 4 THEN 'x-request-id' ELSE 'x-org' END AS h FROM events) GROUP BY 1")
def _(t):
    header = F.element_at(F.array(*map(F.lit, ("Authorization", "x-api-key", "grpc-status", "date", "x-request-id", "x-org"))), (F.col("event_id") % 6 + 1).cast("int"))
    rows = t("events").groupBy("user_id").agg(F.collect_list(F.array(header, F.lit("v"))).alias("metadata"))
    return sources.scrub_metadata(rows).select("user_id", F.size("metadata").cast("long").alias("n"))


@query("a11_verify_capture", "SELECT 'f' || user_id AS file, user_id % 4 > 0 AND user_id % 9 > 0 AS valid FROM events GROUP BY user_id")
def _(t):
    rows = t("events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), "user_id")
    cars = rows.groupBy("file", "user_id").agg(F.count(F.lit(1)).alias("n")).selectExpr("file", "user_id % 4 > 0 AS complete", "false AS failed", "n AS started", "IF(user_id % 9 > 0, n, n + 1) AS recorded")
    return sources.verify_capture(rows, cars)


@query("m15_incremental_supported", "SELECT k, n % 2 = 0 AND part IS NOT NULL AND day IS NOT NULL AS ok FROM prev")
def _(t):
    df = t("prev").selectExpr("k", "IF(n % 2 = 0, 'delete+insert', 'merge') AS strategy", "IF(part IS NULL, 'a,b', 'id') AS unique_key", "IF(day IS NULL, 'ignore', 'fail') AS on_schema_change", "array() AS predicates")
    return df.select("k", F.coalesce(selection.incremental_supported(df), F.lit(False)).alias("ok"))


@query("m16_copy_config", "SELECT k, n % 3 > 0 AS ok FROM prev")
def _(t):
    keys = F.array(F.lit("tags"), F.lit("run_cache_lag"), F.when(F.col("n") % 3 == 0, "pre_hook").otherwise("alias"))
    return t("prev").select("k", selection.copy_config_ok(keys, F.array(F.lit("tags"), F.lit("alias"))).alias("ok"))


@query("m17_run_completed", "SELECT session AS run_id, bool_and(decision IN ('skip', 'clone') OR kind = 'test') AS completed FROM decisions GROUP BY 1")
def _(t):
    items = t("decisions").selectExpr("session AS run_id", "kind AS resource", "CASE WHEN decision IN ('skip', 'clone') THEN 'skipped' ELSE 'fail' END AS status")
    return selection.run_completed(items)


SEEDS = "seeds AS (SELECT * FROM current WHERE execution_type = 8)"
SEED_PAIRS = "pairs AS (SELECT a.id, b.id AS source_id, a.target_key, b.target_key AS source_key, b.last_modified_epoch AS epoch FROM executions a JOIN seeds b ON a.org_id = b.org_id AND a.family = b.family AND coalesce(a.namespace, '') = b.namespace AND a.namespace_hash = b.namespace_hash AND a.id % 2 = b.id % 2 AND a.target_key <> b.target_key WHERE a.execution_type = 8)"


def seed_pairs(t):
    seeds = lambda d: d.withColumns({"logic_hash": F.col("namespace_hash"), "values_hash": F.col("id") % 2})
    subs = seeds(t("executions")).filter("execution_type = 8").select(F.col("id").alias("submission_id"), *history.TENANT, "logic_hash", "values_hash", "target_key")
    return selection.seed_candidates(subs, seeds(history.current_state(t("executions"))))


@query("c8_seed_candidates", "SELECT id, source_id FROM pairs", RANKED, CURRENT, SEEDS, SEED_PAIRS)
def _(t):
    return seed_pairs(t).select(F.col("submission_id").alias("id"), "source_id")


@query(
    "f4_seed_source",
    "SELECT id AS submission_id, source_key, source_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY epoch DESC, source_id) AS n FROM pairs WHERE epoch IS NOT NULL AND source_id % 3 > 0) WHERE n = 1",
    RANKED, CURRENT, SEEDS, SEED_PAIRS,
)
def _(t):
    return selection.seed_source(seed_pairs(t), F.col("source_id") % 3 > 0)


@query("m3_lineage", "SELECT n.uid, coalesce(d.decision, 'none') AS decision, count(i.name) AS inputs FROM nodes n LEFT JOIN (SELECT 'n' || split_part(node_uid, '.', 2) AS uid, arg_max(decision, decision_id) AS decision FROM decisions GROUP BY 1) d USING (uid) LEFT JOIN node_inputs i USING (uid) GROUP BY ALL")
def _(t):
    last = audit.dedupe_decisions(t("decisions").withColumn("uid", F.concat(F.lit("n"), F.split_part("node_uid", F.lit("."), F.lit(2)))), "uid").select("uid", "decision")
    counts = t("node_inputs").groupBy("uid").agg(F.count("name").alias("inputs"))
    return t("nodes").select("uid").join(last, "uid", "left").join(counts, "uid", "left").select("uid", F.coalesce("decision", F.lit("none")).alias("decision"), F.coalesce("inputs", F.lit(0)).alias("inputs"))


@query("m3_all_lineage", "SELECT n.uid, coalesce(d.decision, 'none') AS decision, count(i.name) AS inputs FROM nodes n LEFT JOIN (SELECT 'n' || split_part(node_uid, '.', 2) AS uid, arg_max(decision, decision_id) AS decision FROM decisions GROUP BY 1) d USING (uid) LEFT JOIN node_inputs i USING (uid) GROUP BY ALL")
def _(t):
    last = audit.dedupe_decisions(t("decisions").withColumn("uid", F.concat(F.lit("n"), F.split_part("node_uid", F.lit("."), F.lit(2)))), "uid").select("uid", "decision")
    counts = t("node_inputs").groupBy("uid").agg(F.count("name").alias("inputs"))
    return t("nodes").select("uid").join(last, "uid", "left").join(counts, "uid", "left").select("uid", F.coalesce("decision", F.lit("none")).alias("decision"), F.coalesce("inputs", F.lit(0)).alias("inputs"))


@query("m7_audit_table", "SELECT k, n, side FROM (SELECT k, n, 'left' AS side FROM (SELECT k, n FROM prev EXCEPT ALL SELECT k, n FROM prev WHERE n % 5 > 0) UNION ALL SELECT k, n, 'right' FROM (SELECT k, n FROM prev WHERE n % 5 > 0 EXCEPT ALL SELECT k, n FROM prev))")
def _(t):
    rows = t("prev").select("k", "n")
    return evidence.bag_difference(rows, rows.filter("n % 5 > 0"))
