"""Registered queries of copies and their diagnostics, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import copies, evidence, history
from .queries import CURRENT, RANKED, SHORT, query

TENANT_SQL = "{0}.org_id = {1}.org_id AND {0}.family = {1}.family AND {0}.namespace = {1}.namespace"


@query("k16_copyable", "SELECT p_partkey AS k, p_size % 3 > 0 AND p_partkey % 5 > 0 AND p_partkey % 7 > 0 AND p_size % 4 > 0 AND p_partkey % 11 > 0 AS ok FROM part")
def _(t):
    column = F.struct((F.expr("p_size % 4") > 0).alias("nullable"), F.lit(None).cast("string").alias("key"), F.when(F.expr("p_partkey % 11") == 0, "0").alias("default"))
    kind = F.when(F.expr("p_size % 3") > 0, "BASE TABLE").otherwise("VIEW")
    ok = copies.copyable(kind, (F.expr("p_partkey % 5") == 0).cast("int"), (F.expr("p_partkey % 7") == 0).cast("int"), F.array(column, column))
    return t("part").select(F.col("p_partkey").alias("k"), ok.alias("ok"))


@query("k15_copy_table", "SELECT k, name, day, 'same' AS proof FROM prev")
def _(t):
    rows = t("prev").select("k", "name", "day")
    recorded = evidence.content_digest(rows)
    other = evidence.content_digest(rows.filter("k > 1"))
    return copies.copy_table(rows, recorded).withColumn("proof", F.lit("same")).unionByName(copies.copy_table(rows, other).withColumn("proof", F.lit("other")))


@query(
    "c9_frozen_source",
    f"""SELECT e.id, coalesce(s.id = e.id - e.id % 3 AND NOT busy, false) AS direct_current, coalesce(s.id = e.id - e.id % 3 AND NOT busy AND e.id % 2 = 0, false) AS submit_current
        FROM (SELECT *, coalesce(namespace, '') AS ns FROM executions) e
        LEFT JOIN current s ON s.org_id = e.org_id AND s.family = e.family AND s.namespace = e.ns AND s.target_key = e.target_key AND s.last_modified_epoch IS NOT NULL
        LEFT JOIN (SELECT org_id, family, coalesce(namespace, '') AS ns, target_key, true AS busy FROM executions WHERE confirmed_ms IS NULL GROUP BY ALL) b0 ON b0.org_id = e.org_id AND b0.family = e.family AND b0.ns = e.ns AND b0.target_key = e.target_key""".replace("NOT busy", "busy IS NULL"),
    RANKED, CURRENT,
)
def _(t):
    e = t("executions")
    latest = history.current_state(e).select(*history.SCOPE, F.col("last_modified_epoch").alias("known_epoch"))
    with_epoch = e.withColumn("namespace", F.coalesce("namespace", F.lit(""))).join(latest, list(history.SCOPE), "left")
    proof = F.struct(F.col("target_key").alias("source_key"), (F.col("id") - F.col("id") % 3).alias("source_id"), F.col("known_epoch").alias("source_epoch"))
    pending = with_epoch.select("id", *history.TENANT, (F.col("known_epoch") - F.col("id") % 2).alias("completed_epoch"), proof.alias("direct"), proof.alias("submit"))
    return copies.frozen_source_check(pending, e)


@query(
    "g7_matching_inputs",
    """WITH_ SELECT id, coalesce(bool_and(epoch IS NOT NULL AND producer IS NOT NULL) AND count(DISTINCT name) = count(DISTINCT (name, epoch, producer)), false) AND id % 4 > 0 AS ok FROM (SELECT execution_id AS id, * FROM inputs) GROUP BY id""".replace("WITH_ ", ""),
)
def _(t):
    each = t("inputs").groupBy(F.col("execution_id").alias("id")).agg(F.collect_list(F.struct("name", "epoch", "producer")).alias("now"))
    later = F.transform("now", lambda x: F.struct(F.upper(x["name"]).alias("name"), F.when(F.col("id") % 4 == 0, x["epoch"] + 1).otherwise(x["epoch"]).alias("epoch"), x["producer"].alias("producer")))
    return each.select("id", copies.matching_inputs(F.col("now"), F.reverse(later)).alias("ok"))


@query(
    "l10_strict_match",
    """SELECT id, id % 3 > 0 AND id % 4 > 0 AND id % 5 > 0 AND ((family = 'databricks' AND id % 2 > 0) OR id % 7 > 1) AND (id % 11 > 0 OR (id % 13 > 0 AND id % 2 = 0)) AS ok FROM executions""",
)
def _(t):
    df = t("executions").withColumns({
        "identity_matches": F.expr("id % 3 > 0"), "recorded_type": F.when(F.expr("id % 4 = 0"), F.col("execution_type") + 1).otherwise(F.col("execution_type")), "copy_reusable": F.expr("id % 5 > 0"),
        "is_copy": F.expr("id % 2 = 0"), "ns_hash": F.col("namespace_hash"), "recorded_ns_hash": F.when(F.expr("id % 7 <= 1"), "other").when(F.expr("id % 7 > 2"), F.col("namespace_hash")),
        "dialect": F.lit("d"), "recorded_dialect": F.when(F.expr("id % 11 = 0"), "e").otherwise("d"), "sql_hash": F.col("logic_hash"),
        "recorded_sql_hash": F.when(F.expr("id % 13 > 0"), F.col("logic_hash")), "dialect_alias": F.expr("id % 2 = 0"),
    })
    return df.select("id", copies.strict_match(df).alias("ok"))


@query("l29_binding_changed", "SELECT id, id % 2 = 0 AND (min(name) <> max(name) AND id % 3 = 0 OR id % 5 = 0) AS changed FROM (SELECT execution_id AS id, name FROM inputs) GROUP BY id")
def _(t):
    each = t("inputs").groupBy(F.col("execution_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("now"))
    then = F.when(F.expr("id % 3 = 0"), F.slice("now", 1, 1)).otherwise(F.reverse(F.transform("now", F.upper)))
    return each.select("id", copies.binding_changed(F.expr("id % 2 = 0"), F.col("now"), then, F.lit("cat"), F.when(F.expr("id % 5 > 0"), "cat")).alias("changed"))


TYPED = f"typed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id, family, namespace, target_key, execution_type ORDER BY rank) AS n FROM ranked) WHERE n = 1)"


@query(
    "l26_type_change",
    f"""SELECT s.submission_id, c.id AS latest_id, b.id AS build_id FROM submissions s JOIN current c ON {TENANT_SQL.format('s', 'c')} AND s.target_key = c.target_key AND c.logic_hash = s.submitted_hash AND c.execution_type <> s.execution_type
        LEFT JOIN typed b ON {TENANT_SQL.format('s', 'b')} AND s.target_key = b.target_key AND b.execution_type = s.execution_type AND b.logic_hash = s.submitted_hash""",
    RANKED, CURRENT, TYPED,
)
def _(t):
    return copies.judge_type_change(t("submissions"), t("executions"))


@query("l27_decide_early", "SELECT id, CASE WHEN execution_type = 9 AND id % 3 = 0 AND id % 4 > 0 AND id % 7 > 0 THEN 'skip' END AS early FROM executions")
def _(t):
    df = t("executions").select("id", "execution_type", F.when(F.expr("id % 3 > 0"), F.col("target")).alias("target"), F.when(F.expr("id % 4 > 0"), 0).otherwise(2).alias("n_inputs"), F.when(F.expr("id % 7 > 0"), "skip").otherwise("build").alias("decision"))
    return copies.decide_early(df).select("id", "early")


@query(
    "l22_seed_copy",
    """SELECT id, CASE WHEN id % 4 > 1 OR id % 3 = 0 THEN 'ordinary' WHEN id % 5 = 0 THEN 'copies_disabled' WHEN id % 7 = 0 THEN 'chain_limit' WHEN id % 11 = 0 THEN 'ordinary' ELSE 'copy' END AS outcome FROM executions""",
)
def _(t):
    state = F.element_at(F.array(*map(F.lit, ("absent", "other_values", "as_built", "foreign"))), (F.col("id") % 4 + 1).cast("int"))
    df = t("executions").select(
        "id", state.alias("target_state"), F.when(F.expr("id % 3 > 0"), F.col("target_key")).alias("source_key"), F.when(F.expr("id % 5 = 0"), False).alias("allow_clones"),
        F.when(F.expr("id % 2 = 0 OR id % 7 = 0"), F.col("id") % 7).alias("chain_limit"), F.expr("id % 11 > 0").alias("source_available"),
    )
    return copies.seed_copy(df).select("id", "outcome")


@query(
    "l23_register_copy",
    f"""SELECT copy_id, plan, CASE WHEN plan = 'plan' THEN source_id END AS source_id, CASE WHEN plan = 'plan' THEN logic_hash END AS logic_hash, CASE WHEN plan = 'plan' THEN runtime_ms END AS runtime_ms
        FROM (SELECT submission_id AS copy_id, c.id AS source_id, logic_hash, runtime_ms, CASE WHEN submission_id % 9 = 0 THEN 'chain_limit' WHEN submission_id % 3 = 1 THEN 'not_eligible'
                WHEN submission_id % 3 = 2 AND (s.namespace = '' OR submission_id % 2 = 0) THEN 'not_eligible' WHEN submission_id % 3 = 0 AND submission_id % 5 = 0 THEN 'unsupported' WHEN c.id IS NULL THEN 'no_source'
                WHEN submission_id % 2 > 0 AND last_modified_epoch IS DISTINCT FROM 1 THEN 'not_eligible' ELSE 'plan' END AS plan
              FROM submissions s LEFT JOIN current c USING (org_id, family, namespace, target_key))""",
    RANKED, CURRENT,
)
def _(t):
    contract = F.element_at(F.array(*map(F.lit, ("not_required", "missing", "declared"))), (F.col("submission_id") % 3 + 1).cast("int"))
    requests = t("submissions").select(
        F.col("submission_id").alias("copy_id"), *history.TENANT, F.col("target_key").alias("source_key"), F.when(F.expr("submission_id % 2 > 0"), 1).cast("long").alias("source_epoch"),
        (F.col("submission_id") % 9).alias("chain_limit"), contract.alias("contract"), F.expr("submission_id % 5 > 0").alias("ddl_supported"),
    )
    return copies.register_copy(requests, history.current_state(t("executions")))


@query(
    "e13_diagnostic_current",
    """SELECT submission_id, other_id, rank FROM (SELECT submission_id, c.id AS other_id, row_number() OVER (PARTITION BY submission_id ORDER BY confirmed_ms DESC NULLS LAST, c.id DESC) AS rank
       FROM submissions s JOIN current c ON s.org_id = c.org_id AND s.family = c.family AND s.target_key <> c.target_key) WHERE rank <= 3""",
    RANKED, CURRENT,
)
def _(t):
    return copies.diagnostic_current(t("submissions"), t("executions"), 3).select("submission_id", "other_id", "rank")


@query(
    "l17_older_build",
    f"""SELECT s.submission_id, arg_min(r.id, r.rank) AS older_id FROM submissions s JOIN ranked r ON {TENANT_SQL.format('s', 'r')} AND s.target_key = r.target_key AND r.rank > 1 AND r.logic_hash = s.submitted_hash AND r.execution_type = s.execution_type
        WHERE s.submission_id % 4 > 0 GROUP BY 1""",
    RANKED,
)
def _(t):
    decided = t("submissions").withColumn("decision", F.when(F.expr("submission_id % 4 > 0"), "build").otherwise("skip"))
    return copies.report_older(decided, t("executions"))


@query("f5_ordered_messages", "SELECT request, decision_id, row_number() OVER (PARTITION BY request ORDER BY decision_id) AS ordinal FROM (SELECT session AS request, decision_id FROM decisions)")
def _(t):
    asked = t("decisions").select(F.col("session").alias("request"), "decision_id")
    return copies.ordered_messages(t("decisions").select("decision_id", "decision"), asked.unionByName(asked)).select("request", "decision_id", "ordinal")


@query(
    "g5_volatile_calls",
    """SELECT node, call, row_number() OVER (PARTITION BY node ORDER BY part, position, call) AS ordinal
       FROM (SELECT conv_id AS node, 0 AS part, turn AS position, 'd' || turn AS call FROM sql_log WHERE turn % 2 = 0 UNION ALL SELECT conv_id, 1, turn, 'o' || turn FROM sql_log)""",
)
def _(t):
    calls = lambda d, mark: d.select(F.col("conv_id").alias("node"), F.col("turn").alias("position"), F.concat(F.lit(mark), F.col("turn").cast("string")).alias("call"))
    return copies.volatile_calls(calls(t("sql_log"), "o"), calls(t("sql_log").filter("turn % 2 = 0"), "d"))


@query(
    "b12_upstream_names",
    """SELECT id, string_agg(CASE WHEN id % 3 = 0 THEN 'in:' || name ELSE name END, ',' ORDER BY name) AS names FROM (SELECT DISTINCT execution_id AS id, name FROM inputs) GROUP BY id""",
)
def _(t):
    each = t("inputs").groupBy(F.col("execution_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("n"))
    strings = F.to_json("n")
    objects = F.to_json(F.transform("n", lambda x: F.struct(x.alias("name"))))
    deps = F.when(F.expr("id % 3 = 0"), "[]").when(F.expr("id % 3 = 1"), strings).otherwise(objects)
    inputs = F.to_json(F.transform("n", lambda x: F.struct(F.concat(F.lit("in:"), x).alias("name"))))
    return each.select("id", F.array_join(copies.upstream_names(deps, inputs), ",").alias("names"))
