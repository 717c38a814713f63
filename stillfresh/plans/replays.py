"""Registered queries of diagnostics, replays and identities, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, identity
from ..operators import audit, diagnose, scoring, selection, traces
from .queries import HUMAN, RANKED, query

ROUNDED = """CASE WHEN family = 'databricks' AND age BETWEEN 3600000 AND 86399999 THEN CAST(round_even(age // 1000 / 3600.0, 0) AS BIGINT) * 3600000
                  WHEN age BETWEEN 60000 AND 3599999 THEN CASE WHEN family = 'databricks' THEN CAST(round_even(age // 1000 / 60.0, 0) AS BIGINT) ELSE (age // 1000 + 30) // 60 END * 60000 ELSE age END"""


@query(
    "h10_relative_age",
    f"""SELECT id, CASE WHEN age < 1000 THEN 'now' ELSE {HUMAN} || ' ago' END AS text
        FROM (SELECT id, age, {ROUNDED} // 1000 AS s FROM (SELECT id, family, CASE id % 4 WHEN 0 THEN runtime_ms * 15 WHEN 1 THEN runtime_ms * 720 WHEN 2 THEN runtime_ms * 20000 ELSE greatest(runtime_ms - 900, 0) END AS age FROM executions))""",
)
def _(t):
    age = F.expr("CASE id % 4 WHEN 0 THEN runtime_ms * 15 WHEN 1 THEN runtime_ms * 720 WHEN 2 THEN runtime_ms * 20000 ELSE runtime_ms - 900 END")
    return t("executions").select("id", display.relative_age(F.col("created_ms") + age, F.col("created_ms"), F.col("family")).alias("text"))


@query("h12_micros", "SELECT id, CASE WHEN id % 10 > 0 THEN created_ms * 1000 + id * 7 % 1000000 END AS us, strftime(make_timestamp(created_ms * 1000 + id * 7 % 1000000), '%Y-%m-%d %H:%M:%S.%f') AS text FROM executions")
def _(t):
    text = display.micros_text(F.expr("created_ms * 1000 + id * 7 % 1000000"))
    given = F.when(F.expr("id % 10 > 0"), text).when(F.expr("id % 20 > 0"), F.concat(text, F.lit("0"))).otherwise(F.substring(text, 1, 19))
    return t("executions").select("id", display.micros(given).alias("us"), text.alias("text"))


CODES = "[" + ", ".join(f"'{c}'" for c in display.REASONS) + "]"


@query("h19_reason_code", f"SELECT event_id, code, CASE WHEN event_id % 4 > 0 AND code IS NOT NULL THEN event_id % 30 END AS number FROM (SELECT event_id, {CODES}[event_id % 30 + 1] AS code FROM events)")
def _(t):
    code = display.reason_code((F.col("event_id") % 30).cast("int"))
    stored = F.when(F.expr("event_id % 4 > 0"), code).otherwise(F.concat(code, F.lit(".other")))
    return t("events").select("event_id", code.alias("code"), display.reason_number(stored).cast("long").alias("number"))


def frame(x: str) -> str:
    return f"strlen({x}) || ':' || {x} || ';'"


EXTRAS = f"sha256('1:2;' || strlen(b) || ':' || b || ';') AS m FROM (SELECT *, '1:a;' || {frame('project')} || '1:z;' || {frame('family')} AS b FROM executions)"


@query(
    "l2_template_hash",
    f"""SELECT id, sha256('2:v1;' || {frame('family')} || '3:cat;' || {frame('project')} || '8:template;' || {frame('body')} || {frame('settings')} || {frame('k')} || {frame('listed')}) AS h
        FROM (SELECT *, CASE WHEN family = 'databricks' THEN lower(logic_hash) ELSE logic_hash END AS body,
                CASE WHEN family = 'databricks' THEN '25:declared-config-signature;' || strlen(lower(coalesce(namespace, ''))) || ':' || lower(coalesce(namespace, '')) || ';' || CASE WHEN id % 3 = 0 THEN '13:macros-absent;0:;' ELSE '14:macros-present;2:mx;' END ELSE '64:' || m || ';' END AS settings
              FROM (SELECT *, {EXTRAS}))
        JOIN (SELECT execution_id AS id, CAST(count(*) AS VARCHAR) AS k, string_agg({frame('name')} || '1:q;3:cat;' || {frame('s')}, '' ORDER BY name, s) AS listed FROM (SELECT execution_id, name, 's' || CAST(execution_id % 3 AS VARCHAR) AS s FROM inputs) GROUP BY 1) USING (id)""",
)
def _(t):
    extras = F.create_map(F.lit("z"), "family", F.lit("a"), "project")
    dep = F.struct("name", F.lit("q").alias("query"), F.lit("cat").alias("catalog"), F.concat(F.lit("s"), (F.col("execution_id") % 3).cast("string")).alias("schema"))
    deps = t("inputs").groupBy(F.col("execution_id").alias("id")).agg(F.collect_list(dep).alias("deps"))
    macros = F.when(F.col("id") % 3 != 0, "mx")
    h = identity.template_hash(F.lit("v1"), F.col("family"), F.lit("cat"), F.col("project"), F.col("logic_hash"), extras, F.col("deps"), F.col("namespace"), macros)
    return t("executions").join(deps, "id").select("id", h.alias("h"))


@query("l3_seed_hash", f"SELECT id, sha256({frame('family')} || {frame('org_id')} || '64:' || m || ';') AS h FROM (SELECT *, {EXTRAS})")
def _(t):
    extras = F.create_map(F.lit("z"), "family", F.lit("a"), "project")
    return t("executions").select("id", identity.seed_hash(F.col("family"), F.col("org_id"), extras).alias("h"))


@query(
    "l19_admits",
    """SELECT id, coalesce(id % 3 = 0, false) OR (id % 4 > 0 AND id % 5 > 0 AND n < 4) AS ok FROM (SELECT execution_id AS id, count(DISTINCT name) AS n FROM inputs GROUP BY 1)""",
)
def _(t):
    each = t("inputs").groupBy(F.col("execution_id").alias("id")).agg(F.collect_list("name").alias("names"))
    reads = selection.canonical_reads(F.col("names"))
    asked = F.array(F.struct(F.lit("h0").alias("hash"), F.lit("s0").alias("schema"), reads.alias("reads")), F.struct(F.lit("h1").alias("hash"), F.lit("s1").alias("schema"), reads.alias("reads")))
    own = F.when(F.expr("id % 3 = 0"), "h1").when(F.expr("id % 2 = 0"), "h2")
    schema = F.when(F.expr("id % 4 > 0"), "s1").otherwise("s0")
    candidate = F.when(F.expr("id % 5 > 0"), F.slice(F.reverse(F.array_sort(reads)), 1, 3)).otherwise(F.array(F.lit("X")))
    return each.select("id", selection.admits(own, asked, F.lit("h1"), schema, F.array_sort(candidate)).alias("ok"))


@query(
    "b5_drop_audit_inputs",
    """SELECT id, kept || CASE WHEN id % 5 = 0 OR id % 3 = 2 THEN CASE id % 3 WHEN 0 THEN ',cat.aud.t_own' WHEN 1 THEN ',cat.aud.x' ELSE ',cat.aud.x,cat.aud.y' END ELSE '' END AS names
       FROM (SELECT execution_id AS id, 'cat.aud.seen,' || string_agg(DISTINCT name, ',' ORDER BY name) AS kept FROM inputs GROUP BY 1)""",
)
def _(t):
    each = t("inputs").groupBy(F.col("execution_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("reads"))
    seen = F.concat(F.array(F.lit("cat.aud.seen")), "reads")
    extra = F.when(F.expr("id % 3 = 0"), F.array(F.lit("cat.aud.t_own"))).when(F.expr("id % 3 = 1"), F.array(F.lit("cat.aud.x"))).otherwise(F.array(F.lit("cat.aud.x"), F.lit("cat.aud.y")))
    sql = F.concat(F.lit("select 1 from "), F.array_join(seen, ", "))
    left = selection.drop_audit_inputs(F.concat(seen, extra), F.lit("t_own"), F.lit("aud"), sql, F.expr("id % 5 > 0"))
    return each.select("id", F.array_join(left, ",").alias("names"))


# --- replays ----------------------------------------------------------------------------------


@query(
    "c17_correlated",
    """SELECT session AS fixture, decision_id AS entry, CASE WHEN decision_id % 7 = 0 THEN 'missing' WHEN decision_id % 3 = 0 AND decision <> 'skip' THEN 'different' WHEN decision_id % 11 = 0 THEN 'different' ELSE 'same' END AS outcome FROM decisions""",
)
def _(t):
    d = t("decisions").select(F.col("session").alias("fixture"), F.col("decision_id").alias("entry"), "decision")
    side = lambda x, mark: x.select("fixture", "entry", F.concat(F.lit(mark), F.col("entry").cast("string")).alias("minted"), F.concat(F.lit(mark), (F.col("entry")).cast("string")).alias("refers"), "decision")
    told = lambda x: x.select("fixture", "entry", F.to_json(F.struct("minted", "refers", "decision")).alias("response"))
    expected = side(d, "r").withColumn("response", F.col("decision"))
    other = d.filter("entry % 7 > 0").withColumn("decision", F.when(F.expr("entry % 3 = 0"), "skip").otherwise(F.col("decision")))
    actual = side(other, "other-").withColumn("refers", F.when(F.expr("entry % 11 = 0"), "nobody").otherwise(F.col("refers"))).withColumn("response", F.col("decision"))
    return traces.replay_compare(told(expected), told(traces.correlate(expected, actual)))


TREES = """trees AS (SELECT kind, decision, 'o' || (decision_id % 2) AS origin, decision_id % 4 AS n, decision_id FROM decisions),
  facts AS (SELECT kind, decision, 'tree' AS measure, '' AS name FROM trees UNION ALL SELECT kind, decision, 'origin', origin FROM trees UNION ALL SELECT kind, decision, 'empty', '' FROM trees WHERE n = 0
    UNION ALL SELECT kind, decision, 'marker', 'm' || (i % 2) FROM trees, range(1, 4) r(i) WHERE i <= n UNION ALL SELECT kind, decision, 'badge', CASE WHEN i = 3 THEN '' ELSE 'b' || (decision_id % 3) END FROM trees, range(1, 4) r(i) WHERE i <= n)"""


@query("d12_tree_census", "SELECT kind, decision, measure, name, count(*) AS n FROM facts GROUP BY GROUPING SETS ((kind, decision, measure, name), (measure, name))", TREES)
def _(t):
    line = lambda i: F.struct(F.concat(F.lit("m"), (i % 2).cast("string")).alias("marker"), F.when(i < 3, F.concat(F.lit("b"), (F.col("decision_id") % 3).cast("string"))).alias("badge"))
    lines = F.when(F.expr("decision_id % 4 > 0"), F.transform(F.sequence(F.lit(1), F.greatest(F.expr("CAST(decision_id % 4 AS INT)"), F.lit(1))), line))
    return audit.tree_census(t("decisions").select("kind", "decision", F.concat(F.lit("o"), (F.col("decision_id") % 2).cast("string")).alias("origin"), lines.alias("lines")))


REPLAY = """replay AS (SELECT event_id AS position, 'f' || (event_id // 600) AS file, CASE WHEN event_id % 3 = 2 THEN 'confirm' WHEN event_id % 22 = 0 THEN 'values' ELSE 'submit' END AS method,
    'r' || CASE WHEN event_id % 3 = 2 THEN event_id - 1 - event_id % 2 ELSE event_id END AS request_id, 't' || (event_id // 3 % 6) AS target, 'i' || CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS identity,
    1 + event_id % 10 AS execution_type, CASE WHEN event_id % 12 > 0 THEN greatest(0, event_id - 40) * 10 END AS own, 's' || (event_id // 60 % 2) AS source, (event_id - event_id % 50) * 10 AS source_epoch,
    't' || ((event_id // 3 + 1) % 6) AS up, (event_id - 20 - event_id % 25) * 10 AS up_epoch, CASE event_id % 3 WHEN 0 THEN 0 ELSE 300 + event_id % 2 * 100000 END AS tolerance_ms, CASE WHEN event_id // 7 % 2 = 0 THEN 'any' ELSE 'all' END AS policy,
    event_id * 10 AS now_ms, CASE event_id % 4 WHEN 3 THEN 'skip' WHEN 2 THEN 'clone' ELSE 'build' END AS variant FROM events)"""
STEPS = """asked AS (SELECT * FROM replay WHERE method <> 'confirm' AND variant <> 'skip'),
  builds AS (SELECT a.file, a.target, a.identity, a.position AS submit, a.source, a.source_epoch, a.up, a.up_epoch, a.method, min(c.position) AS position FROM asked a JOIN replay c ON c.method = 'confirm' AND c.file = a.file AND c.request_id = a.request_id AND c.position > a.position GROUP BY ALL),
  reads AS (SELECT file, position, source AS name, source_epoch AS epoch FROM replay WHERE method = 'submit' UNION ALL SELECT file, position, up, up_epoch FROM replay WHERE method = 'submit'),
  made AS (SELECT r.file, r.position, r.name, any_value(r.epoch) AS epoch, CASE WHEN any_value(r.epoch) <= arg_max(b.position, b.position) * 10 THEN arg_max(b.identity, b.position) END AS producer
           FROM reads r LEFT JOIN builds b ON b.file = r.file AND b.target = r.name AND b.position < r.position GROUP BY r.file, r.position, r.name),
  last AS (SELECT s.file, s.position, any_value(s) AS s, max(b.position) * 10 AS epoch, arg_max(b.identity, b.position) AS identity, arg_max(b.submit, b.position) AS submit
           FROM replay s JOIN builds b ON b.file = s.file AND b.target = s.target AND b.position < s.position WHERE s.method = 'submit' AND s.execution_type <= 7 GROUP BY 1, 2),
  keyed AS (SELECT * FROM last WHERE identity = s.identity AND s.own <= epoch),
  sides AS (SELECT k.file, k.position, m.name, m.epoch AS now, m.producer AS maker, 1 AS has, NULL AS then_, NULL AS made_by, 0 AS had FROM keyed k JOIN made m ON m.file = k.file AND m.position = k.position
            UNION ALL SELECT k.file, k.position, m.name, NULL, NULL, 0, m.epoch, m.producer, 1 FROM keyed k JOIN made m ON m.file = k.file AND m.position = k.submit),
  paired AS (SELECT file, position, name, max(now) AS now, max(maker) AS maker, max(has) AS has, max(then_) AS then_, max(made_by) AS made_by, max(had) AS had FROM sides GROUP BY 1, 2, 3),
  folded AS (SELECT file, position, bool_or(has = 0 OR had = 0) AS other_set, bool_or(maker IS DISTINCT FROM made_by) AS flagged, count(*) FILTER (coalesce(now > then_, true)) AS d, count(*) AS n, bool_and(now IS NOT DISTINCT FROM then_) AS unchanged FROM paired GROUP BY 1, 2),
  ruled AS (SELECT k.file, k.position, s.variant AS recorded, d, unchanged, s.tolerance_ms > 0 AND s.now_ms - epoch < s.tolerance_ms AS within, s, other_set OR flagged OR (d > 0 AND (s.policy = 'any' OR d = n) AND NOT (s.tolerance_ms > 0 AND s.now_ms - epoch < s.tolerance_ms)) AS rebuild
            FROM keyed k JOIN folded f USING (file, position))"""
LEAD = "CASE WHEN s.execution_type = 7 THEN 'snapshot' ELSE 'model' END || ' was a no-op because '"
RULED = f"""SELECT file, position, recorded, CASE WHEN rebuild THEN 'build' ELSE 'skip' END AS variant, NOT rebuild AND d > 0 AS stale,
    CASE WHEN rebuild THEN NULL WHEN s.execution_type = 7 OR s.tolerance_ms = 0 OR unchanged THEN {LEAD} || 'both its query and its upstream data are up to date'
         WHEN within THEN {LEAD} || 'its query is up to date and its data is within lag tolerance' ELSE {LEAD} || 'its query is up to date and at least one upstream dependency is unchanged' END AS description FROM ruled"""


def replay(t):
    """A recorded session of submissions and confirmations, from the events in their order."""
    e = t("events").selectExpr(
        "event_id AS position", "concat('f', event_id div 600) AS file", "CASE WHEN event_id % 3 = 2 THEN 'confirm' WHEN event_id % 22 = 0 THEN 'values' ELSE 'submit' END AS method",
        "concat('r', IF(event_id % 3 = 2, event_id - 1 - event_id % 2, event_id)) AS request_id", "concat('t', event_id div 3 % 6) AS target", "concat('i', IF(event_id % 31 = 0, 1, 0)) AS identity",
        "CAST(1 + event_id % 10 AS INT) AS execution_type", "IF(event_id % 12 > 0, greatest(0L, event_id - 40) * 10, NULL) AS own", "concat('s', event_id div 60 % 2) AS source", "(event_id - event_id % 50) * 10 AS source_epoch",
        "concat('t', (event_id div 3 + 1) % 6) AS up", "(event_id - 20 - event_id % 25) * 10 AS up_epoch", "IF(event_id % 3 = 0, 0L, 300 + event_id % 2 * 100000) AS tolerance_ms", "IF(event_id div 7 % 2 = 0, 'any', 'all') AS policy",
        "event_id * 10 AS recorded_ms", "event_id * 10 AS epoch", "CASE event_id % 4 WHEN 3 THEN 'skip' WHEN 2 THEN 'clone' ELSE 'build' END AS variant",
    )
    table = lambda name, epoch: F.struct(F.col(name).alias("name"), F.col(epoch).alias("epoch"))
    own = F.when(F.col("own").isNotNull(), F.array(table("target", "own"))).otherwise(F.array().cast("array<struct<name:string,epoch:bigint>>"))
    told = e.withColumn("tables", F.concat(F.array(table("source", "source_epoch"), table("up", "up_epoch")), own))
    return told.withColumns({"stale": F.lit(False), "description": F.when(F.col("variant") == "skip", "model was a no-op because both its query and its upstream data are up to date")}).drop("own", "source", "source_epoch", "up", "up_epoch")


@query("m9_predictions", RULED, REPLAY, STEPS)
def _(t):
    return scoring.predictions(replay(t)).select("file", "position", F.col("recorded.variant").alias("recorded"), "rule.*")


@query(
    "m9_score_trace",
    f"""SELECT file, count(*) AS judged, count(*) FILTER (recorded = variant AND (variant <> 'skip' OR (NOT stale AND description = 'model was a no-op because both its query and its upstream data are up to date'))) AS agree FROM ({RULED}) GROUP BY 1""",
    REPLAY, STEPS,
)
def _(t):
    return scoring.score_trace(replay(t))


# --- diagnostics ------------------------------------------------------------------------------

GIVEN = ("first_build", "existing_target_without_history", "upstream_outdated", "no_reuse_candidate.identity_mismatch", "no_reuse_candidate.own_target_missing", "no_reuse_candidate.own_target_modified")
NAMED = ("target_history", "other_target", "absent_target", "absent_scope", "snapshot_peer", "submit_copy", "direct_copy")
DECIDED = f"""rows_ AS (SELECT *, id % 3 > 0 AS sourceless FROM ranked),
  d0 AS (SELECT submission_id, org_id, family, namespace, target_key, submitted_hash AS logic_hash, namespace_hash, execution_type, CASE WHEN submission_id % 8 = 0 THEN 'skip' ELSE 'build' END AS decision, {list(GIVEN)}[submission_id // 3 % 6 + 1] AS reason,
           6 AS skip_code, 6 AS clone_code, submission_id % 7 = 0 AS has_candidate, submission_id % 2 = 0 AS absent, {list(NAMED)}[submission_id // 18 % 8 + 1] AS barred FROM submissions),
  d1 AS (SELECT *, decision = 'build' AS b,
      EXISTS (SELECT 1 FROM rows_ r WHERE r.sourceless AND r.rank > 1 AND r.org_id = d.org_id AND r.family = d.family AND r.logic_hash = d.logic_hash AND r.target_key = d.target_key) AS older_here,
      EXISTS (SELECT 1 FROM rows_ r WHERE r.sourceless AND r.rank = 1 AND r.org_id = d.org_id AND r.family = d.family AND r.logic_hash = d.logic_hash AND r.target_key <> d.target_key AND (d.namespace = '' OR r.namespace = d.namespace)) AS other_now,
      EXISTS (SELECT 1 FROM rows_ r WHERE r.sourceless AND r.org_id = d.org_id AND r.family = d.family AND r.logic_hash = d.logic_hash AND r.target_key <> d.target_key AND (d.namespace = '' OR r.namespace = d.namespace)) AS other_ever,
      EXISTS (SELECT 1 FROM rows_ r WHERE r.namespace = '' AND r.org_id = d.org_id AND r.family = d.family AND r.target_key = d.target_key AND r.logic_hash <> d.logic_hash) AS absent_scope,
      EXISTS (SELECT 1 FROM rows_ r WHERE r.rank = 1 AND r.execution_type = 7 AND r.org_id = d.org_id AND r.family = d.family AND r.namespace = d.namespace AND r.logic_hash = d.logic_hash AND r.target_key <> d.target_key) AS peer,
      EXISTS (SELECT 1 FROM rows_ r WHERE r.rank = 1 AND r.org_id = d.org_id AND r.family = d.family AND r.namespace = d.namespace AND r.namespace_hash = d.namespace_hash AND r.target_key <> d.target_key) AS equivalent
    FROM d0 d),
  d2 AS (SELECT * REPLACE (CASE WHEN hit THEN CASE WHEN absent THEN 4 ELSE 8 END ELSE skip_code END AS skip_code, CASE WHEN hit THEN 7 ELSE clone_code END AS clone_code,
      CASE WHEN hit AND absent THEN 'no_reuse_candidate.own_target_missing' WHEN hit AND reason = 'existing_target_without_history' THEN 'query_observed_outside_scope' ELSE reason END AS reason)
    FROM (SELECT *, coalesce(b AND NOT has_candidate AND older_here AND barred IS DISTINCT FROM 'target_history' AND (reason IN ('first_build', 'existing_target_without_history', 'no_reuse_candidate.identity_mismatch', 'no_reuse_candidate.own_target_missing')), false) AS hit FROM d1)),
  d3 AS (SELECT * REPLACE (CASE WHEN o THEN 1 ELSE skip_code END AS skip_code, CASE WHEN o THEN CASE WHEN execution_type = 10 THEN 3 ELSE 10 END ELSE clone_code END AS clone_code,
      CASE WHEN o AND execution_type = 1 THEN 'existing_target_copy_disabled_diagnostic' WHEN o AND reason = 'existing_target_without_history' THEN 'query_observed_outside_scope' ELSE reason END AS reason, b AND NOT (o AND execution_type = 1) AS b)
    FROM (SELECT *, b AND NOT has_candidate AND other_now AND barred IS DISTINCT FROM 'other_target' AND reason IN ('first_build', 'existing_target_without_history') AS o FROM d2)),
  d4 AS (SELECT * REPLACE (CASE WHEN a THEN 1 ELSE skip_code END AS skip_code, CASE WHEN a THEN 9 ELSE clone_code END AS clone_code, CASE WHEN u THEN 'query_changed_outside_scope' ELSE reason END AS reason)
    FROM (SELECT *, b AND NOT has_candidate AND other_ever AND barred IS DISTINCT FROM 'absent_target' AND reason = 'first_build' AS a, b AND NOT has_candidate AND absent_scope AND barred IS DISTINCT FROM 'absent_scope' AND reason = 'existing_target_without_history' AS u FROM d3)),
  d5 AS (SELECT *, b AND peer AND barred IS DISTINCT FROM 'snapshot_peer' AND reason IN ('first_build', 'upstream_outdated') AS p, b AND equivalent AND barred IS DISTINCT FROM 'submit_copy' AND reason <> 'no_reuse_candidate.own_target_modified' AS q,
      b AND equivalent AND barred IS DISTINCT FROM 'direct_copy' AND reason = 'upstream_outdated' AS z FROM d4)"""


@query(
    "l28_diagnose",
    """SELECT submission_id, CAST(CASE WHEN p OR q OR z THEN 1 ELSE skip_code END AS INTEGER) AS skip_code, CAST(CASE WHEN z AND execution_type = 3 THEN 10 WHEN z THEN 3 WHEN q THEN 6 WHEN p THEN 3 ELSE clone_code END AS INTEGER) AS clone_code,
              CASE WHEN z AND execution_type = 3 THEN 'copy_chain_limit' ELSE reason END AS reason FROM d5""",
    RANKED, DECIDED,
)
def _(t):
    pick = lambda given, at: F.get(F.array(*map(F.lit, given)), F.expr(at).cast("int"))
    decided = t("submissions").withColumnRenamed("submitted_hash", "logic_hash").withColumns({
        "decision": F.when(F.expr("submission_id % 8 = 0"), "skip").otherwise("build"), "reason": pick(GIVEN, "submission_id div 3 % 6"), "skip_code": F.lit(6), "clone_code": F.lit(6),
        "has_candidate": F.expr("submission_id % 7 = 0"), "target_absent": F.expr("submission_id % 2 = 0"),
        "permitted": F.filter(F.array(*map(F.lit, NAMED)), lambda n: ~n.eqNullSafe(pick(NAMED, "submission_id div 18 % 8"))),
    })
    executions = t("executions").withColumn("sourceless", F.expr("id % 3 > 0"))
    return diagnose.diagnose(decided, executions).select("submission_id", "skip_code", "clone_code", "reason")
