"""Registered queries of the build-reuse operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, identity, names
from ..operators import audit, evidence, freshness, history, querylog, tables
from .fixtures import fixture, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Latest first within a physical target, as SQL.
LATEST = "ORDER BY last_modified_epoch DESC NULLS FIRST, confirmed_ms DESC NULLS LAST, id DESC"
SCOPED = "SELECT * REPLACE (coalesce(namespace, '') AS namespace) FROM executions WHERE confirmed_ms IS NOT NULL"
RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY org_id, family, namespace, target_key {LATEST}) AS rank FROM ({SCOPED}))"
CURRENT = "current AS (SELECT * FROM ranked WHERE rank = 1)"
SHORT = "org_id, family, namespace, target_key, id, last_modified_epoch, confirmed_ms"


def query(name: str, body: str | None, *ctes: str) -> Callable[[Callable], Callable]:
    """Register ``f(t)``, ``t`` giving a fixture or table by name, and its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: fixture(spark, sf_dir, table))
        if body:
            ORACLES[name] = oracle(body, *ctes)
        return f

    return add


def short(df: DataFrame) -> DataFrame:
    return df.select(*SHORT.split(", "))


# --- scopes and names ------------------------------------------------------------------------


@query("b1_scope_keys", "SELECT id, family, target_key FROM executions")
def _(t):
    return names.with_scope_keys(t("raw_executions")).select("id", "family", "target_key")


@query("b2_scope_filter", "SELECT id, target_key FROM executions WHERE org_id = 'org1' AND confirmed_ms IS NOT NULL AND family = 'databricks' AND coalesce(namespace, '') = ''")
def _(t):
    return names.in_scope(t("executions"), "org1", "databricks", None).select("id", "target_key")


@query("b4_genuine_inputs", "SELECT execution_id, name, i.epoch FROM inputs i JOIN executions e ON execution_id = id WHERE name <> target_key")
def _(t):
    joined = t("inputs").join(t("executions").select(F.col("id").alias("execution_id"), F.col("target_key").alias("target")), "execution_id")
    return freshness.genuine_inputs(joined).select("execution_id", "name", "epoch")


@query("b7_not_modified_since", "SELECT e.id, coalesce(i.epoch <= last_modified_epoch, false) AS fresh FROM executions e JOIN (SELECT execution_id, max(epoch) AS epoch FROM inputs GROUP BY 1) i ON execution_id = id")
def _(t):
    top = t("inputs").groupBy(F.col("execution_id").alias("id")).agg(F.max("epoch").alias("epoch"))
    return t("executions").join(top, "id").select("id", names.not_modified_since(F.col("epoch"), F.col("last_modified_epoch")).alias("fresh"))


@query(
    "b8_complete_deps",
    "SELECT id, bool_and(name <> '' AND coalesce(producer, '') <> '') AND count(DISTINCT name) = count(*) AS complete FROM (SELECT execution_id AS id, name, producer FROM inputs) GROUP BY id",
)
def _(t):
    deps = t("inputs").groupBy(F.col("execution_id").alias("id")).agg(F.collect_list(F.struct("name", F.col("producer").alias("query"))).alias("deps"))
    return deps.select("id", names.complete_deps(F.col("deps")).alias("complete"))


@query(
    "h1_name_parts",
    "SELECT id, 'Cat' AS catalog, upper(split_part(target, '.', 1)) AS canon, split_part(target, '.', 2) AS schema, 3 AS n FROM raw_executions",
)
def _(t):
    parts = names.name_parts(F.col("target"))
    return t("raw_executions").select("id", parts[0].alias("catalog"), names.canon_ident(parts[0]).alias("canon"), names.schema_of(F.col("target")).alias("schema"), F.size(parts).alias("n"))


@query(
    "h4_abstract_names",
    """SELECT execution_id, name, split_part(name, '.', 1) || '.ns__' || CAST(dense_rank() OVER (PARTITION BY execution_id ORDER BY split_part(name, '.', 2)) - 1 AS VARCHAR) || '.' || split_part(name, '.', 3) AS abstract
       FROM (SELECT DISTINCT execution_id, name FROM inputs)""",
)
def _(t):
    each = t("inputs").select("execution_id", "name").distinct()
    tokens = each.groupBy("execution_id").agg(names.schema_tokens(F.collect_set(names.schema_of(F.col("name")))).alias("tokens"))
    return each.join(tokens, "execution_id").select("execution_id", "name", names.abstract_name(F.col("name"), F.col("tokens")).alias("abstract"))


@query("h14_mentions", "SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_$])the($|[^a-z0-9_$])') AS has FROM documents WHERE text IS NOT NULL")
def _(t):
    return t("documents").filter("text IS NOT NULL").select("doc_id", names.mentions(F.col("text"), F.lit("The")).alias("has"))


# --- identities -------------------------------------------------------------------------------


@query(
    "h5_framed_hash",
    "SELECT id, sha256(strlen(org_id) || ':' || org_id || ';' || CASE WHEN namespace IS NULL THEN 'N;' ELSE strlen(namespace) || ':' || namespace || ';' END || strlen(target) || ':' || target || ';') AS h FROM raw_executions",
)
def _(t):
    return t("raw_executions").select("id", identity.framed_hash(F.col("org_id"), F.col("namespace"), F.col("target")).alias("h"))


@query("h7_logic_identity", "SELECT id, coalesce('sql:' || logic_hash || ':', 'ns:' || namespace_hash) AS logic FROM executions")
def _(t):
    return t("executions").select("id", identity.logic_identity(F.col("logic_hash"), F.lit(None).cast("string"), F.col("namespace_hash"), F.col("id")).alias("logic"))


FRAME = "strlen({0}) || ':' || {0} || ';'"


@query(
    "l1_logic_hash",
    f"""SELECT id, sha256('1:1;' || {FRAME.format('family')} || '3:cat;' || {FRAME.format('namespace_')} || '8:rendered;' || {FRAME.format('logic_hash')} || {FRAME.format('m')} || strlen(CAST(n AS VARCHAR)) || ':' || n || ';' || {FRAME.format('listed')}) AS logic
        FROM (SELECT id, family, coalesce(namespace, '') AS namespace_, logic_hash, sha256('1:1;' || strlen('7:project;' || {FRAME.format('project')}) || ':' || '7:project;' || {FRAME.format('project')} || ';') AS m FROM executions)
        JOIN (SELECT execution_id AS id, count(*) AS n, string_agg({FRAME.format('name')} || {FRAME.format('q')} || '3:cat;' || {FRAME.format('s')}, '' ORDER BY name, q, s) AS listed
              FROM (SELECT execution_id, name, coalesce(producer, '-') AS q, 's' || CAST(execution_id % 3 AS VARCHAR) AS s FROM inputs) GROUP BY 1) USING (id)""",
)
def _(t):
    deps = t("inputs").groupBy(F.col("execution_id").alias("id")).agg(F.collect_list(F.struct("name", F.coalesce("producer", F.lit("-")).alias("query"), F.lit("cat").alias("catalog"), F.concat(F.lit("s"), (F.col("execution_id") % 3).cast("string")).alias("schema"))).alias("deps"))
    one = F.lit("1"), F.col("family"), F.lit("cat"), F.coalesce("namespace", F.lit("")), F.col("logic_hash"), F.create_map(F.lit("project"), "project"), F.col("deps")
    return t("executions").join(deps, "id").select("id", identity.logic_hash(*one).alias("logic"))


@query("h8_scd_id", "SELECT o_orderkey AS k, md5(o_custkey || '|' || rtrim(rtrim(strftime(CAST(o_orderdate AS TIMESTAMP) + to_milliseconds(o_orderkey % 100 * 50), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')) AS id FROM orders")
def _(t):
    stamp = F.timestamp_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 100 * 50)
    return t("orders").select(F.col("o_orderkey").alias("k"), identity.scd_id(F.col("o_custkey").cast("string"), stamp).alias("id"))


# --- displays ---------------------------------------------------------------------------------

HUMAN = """CASE WHEN s = 0 THEN 'a moment' WHEN s = 1 THEN 'a second' WHEN s < 60 THEN s || ' seconds' WHEN s // 60 = 1 THEN 'a minute' WHEN s < 3600 THEN (s // 60) || ' minutes'
           WHEN s // 3600 = 1 THEN 'an hour' WHEN s < 86400 THEN (s // 3600) || ' hours' WHEN s // 86400 = 1 THEN 'a day' WHEN s // 86400 < 31 THEN (s // 86400) || ' days'
           WHEN s // 86400 < 365 THEN CASE WHEN CAST(floor(s // 86400 / 30.5 + 0.5) AS BIGINT) = 1 THEN 'a month' ELSE CAST(floor(s // 86400 / 30.5 + 0.5) AS BIGINT) || ' months' END
           WHEN s // 86400 // 365 = 1 THEN 'a year' ELSE (s // 86400 // 365) || ' years' END"""


@query("h9_humanize", f"SELECT id, {HUMAN} AS text FROM (SELECT id, runtime_ms * runtime_ms * (id % 17) // 1000 AS s FROM executions)")
def _(t):
    return t("executions").select("id", display.humanize_ms(F.expr("runtime_ms * runtime_ms * (id % 17)")).alias("text"))


@query("h11_utc_text", "SELECT id, strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS text FROM executions")
def _(t):
    return t("executions").select("id", display.utc_text(F.col("created_ms")).alias("text"))


@query("h15_runtime", "SELECT id, CASE WHEN runtime_ms >= 1000 THEN printf('%.1f', (runtime_ms - runtime_ms % 100) / 1000.0) || 's' ELSE runtime_ms || 'ms' END AS text FROM executions")
def _(t):
    return t("executions").select("id", display.fmt_runtime(F.expr("CASE WHEN runtime_ms >= 1000 THEN runtime_ms - runtime_ms % 100 ELSE runtime_ms END")).alias("text"))


@query("h20_names", f"SELECT id, list_extract({list(display.KINDS)}, execution_type + 1) AS kind, CASE execution_type WHEN 7 THEN 'snapshot' WHEN 9 THEN 'data test' WHEN 8 THEN 'seed' ELSE 'model' END AS noun FROM executions")
def _(t):
    return t("executions").select("id", display.kind_name(F.col("execution_type")).alias("kind"), display.node_noun(F.col("execution_type")).alias("noun"))


@query("h22_day_bounds", "SELECT n_nationkey, CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-01' + CAST(n_nationkey + 1 AS INTEGER), INTERVAL 1 DAY)) AS DATE)::VARCHAR AS day FROM nation")
def _(t):
    spans = t("nation").select("n_nationkey", F.lit("2024-01-01").alias("a"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey")).alias("b"))
    return tables.day_bounds(spans, "a", "b").select("n_nationkey", F.col("day").cast("string"))


@query("h22_order_days", "SELECT o_orderkey, CAST(unnest(range(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 + 1 AS INTEGER), INTERVAL 1 DAY)) AS DATE)::VARCHAR AS day FROM orders")
def _(t):
    spans = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a")).withColumn("b", F.date_add("a", (F.col("o_orderkey") % 5).cast("int")))
    return tables.day_bounds(spans, "a", "b").select("o_orderkey", F.col("day").cast("string"))


# --- history ----------------------------------------------------------------------------------


@query("e1_current_state", f"SELECT {SHORT} FROM current", RANKED, CURRENT)
def _(t):
    return short(history.current_state(t("executions")))


@query("e2_target_history", f"SELECT {SHORT} FROM ranked WHERE rank <= 5", RANKED)
def _(t):
    return short(history.target_history(t("executions"), 5))


@query("e3_latest_test", f"SELECT {SHORT} FROM (SELECT *, row_number() OVER (PARTITION BY org_id, node_uid, project, namespace, family ORDER BY confirmed_ms DESC, id DESC) AS n FROM ({SCOPED}) WHERE execution_type = 9) WHERE n = 1")
def _(t):
    return short(history.latest_test(t("executions")))


@query("e5_deferral", "SELECT org_id, project, environment, node_uid, target, id FROM (SELECT *, row_number() OVER (PARTITION BY org_id, project, environment, node_uid ORDER BY confirmed_ms DESC, id DESC) AS n FROM executions WHERE confirmed_ms IS NOT NULL) WHERE n = 1 AND environment <> '' AND project <> 'p0'")
def _(t):
    wanted = t("executions").select("org_id", "project", "environment").filter("project <> 'p0'")
    return history.resolve_deferred(t("executions"), wanted)


@query("e7_older_match", f"SELECT {SHORT} FROM (SELECT *, row_number() OVER (PARTITION BY org_id, family, namespace, target_key ORDER BY rank) AS n FROM ranked WHERE rank > 1 AND id % 3 = 0) WHERE n = 1", RANKED)
def _(t):
    return short(history.older_match(t("executions"), F.col("id") % 3 == 0))


@query("e10_latest_of_type", f"SELECT {SHORT}, execution_type FROM (SELECT *, row_number() OVER (PARTITION BY org_id, family, namespace, target_key, execution_type {LATEST}) AS n FROM ({SCOPED})) WHERE n = 1")
def _(t):
    return history.latest_of_type(t("executions")).select(*SHORT.split(", "), "execution_type")


CONFIRMS = "confirms AS (SELECT l_orderkey * 8 + l_linenumber AS confirm_id, 'r' || l_orderkey AS request_id, min(l_partkey) % 5 AS arrival, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE min(l_suppkey) END AS epoch FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def confirms(t):
    grouped = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 5).alias("arrival"), F.min("l_suppkey").alias("s"))
    return grouped.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("confirm_id"), F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("request_id"), "arrival",
        F.when(F.col("l_linenumber") % 4 != 0, F.col("s")).alias("epoch"),
    )


@query("e8_first_confirm", "SELECT confirm_id, request_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY arrival, confirm_id) AS n FROM confirms) WHERE n = 1", CONFIRMS)
def _(t):
    return history.first_confirm(confirms(t)).select("confirm_id", "request_id")


@query(
    "a3_confirm",
    """SELECT confirm_id, request_id, epoch, CASE WHEN target IS NULL THEN 'missing' WHEN done IS NOT NULL THEN 'already_confirmed' WHEN NOT valid THEN 'invalid' WHEN n > 1 THEN 'already_confirmed' ELSE 'published' END AS outcome
       FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN valid THEN 0 ELSE 1 END, arrival, confirm_id) AS n
             FROM (SELECT c.*, target, p.confirmed_ms AS done, (coalesce(target, '') <> '') = (epoch IS NOT NULL) AS valid FROM confirms c LEFT JOIN (SELECT * FROM executions WHERE id % 5 > 0) p USING (request_id)))""",
    CONFIRMS,
)
def _(t):
    pending = t("executions").filter("id % 5 > 0").select("request_id", "target", "confirmed_ms")
    return history.confirm(pending, confirms(t))


@query("a4_record_batch", "SELECT id, target FROM (SELECT * FROM executions WHERE last_modified_epoch IS NOT NULL)")
def _(t):
    return history.record_batch(t("executions").filter("last_modified_epoch IS NOT NULL")).select("id", "target")


@query("a5_upsert_latest", "SELECT org_id, project, environment, node_uid, max_by(id, created_ms * 100000 + id) AS id FROM executions WHERE environment <> '' OR id % 2 = 0 GROUP BY ALL")
def _(t):
    rows = t("executions").select("org_id", "project", "environment", "node_uid", "id", (F.col("created_ms") * 100000 + F.col("id")).alias("ord"))
    out = history.upsert_latest(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["org_id", "project", "environment", "node_uid"], "ord")
    return out.drop("ord")


DIM = "(SELECT project AS k, max(CASE WHEN id % 3 = 0 THEN target END) AS label, min(created_ms) AS first_seen, max(created_ms) AS last_seen FROM executions WHERE {0} GROUP BY 1)"


@query(
    "a8_upsert_dimension",
    f"SELECT coalesce(o.k, n.k) AS k, coalesce(n.label, o.label) AS label, least(o.first_seen, n.first_seen) AS first_seen, greatest(o.last_seen, n.last_seen) AS last_seen FROM {DIM.format('id % 2 = 0')} o FULL JOIN {DIM.format('id % 5 = 1')} n ON o.k = n.k",
)
def _(t):
    dim = lambda cond: t("executions").filter(cond).groupBy(F.col("project").alias("k")).agg(F.max(F.when(F.col("id") % 3 == 0, F.col("target"))).alias("label"), F.min("created_ms").alias("first_seen"), F.max("created_ms").alias("last_seen"))
    return history.upsert_dimension(dim("id % 2 = 0"), dim("id % 5 = 1"), ["k"])


@query("c1_attach_current", "SELECT submission_id, c.id AS prev_id FROM submissions s LEFT JOIN current c USING (org_id, family, namespace, target_key)", RANKED, CURRENT)
def _(t):
    return history.attach_current(t("submissions"), history.current_state(t("executions"))).select("submission_id", F.col("prev.id").alias("prev_id"))


READS = "reads AS (SELECT execution_id, name, i.epoch AS read_epoch, org_id, family, coalesce(namespace, '') AS namespace FROM inputs i JOIN executions e ON execution_id = e.id)"


@query(
    "c2_producers",
    """SELECT execution_id, name, read_epoch, CASE WHEN read_epoch <= last_modified_epoch THEN 'build' ELSE 'no_build' END AS producer_state, CASE WHEN read_epoch <= last_modified_epoch THEN logic_hash END AS producer_logic
       FROM reads r LEFT JOIN current c ON r.org_id = c.org_id AND r.family = c.family AND r.namespace = c.namespace AND name = target_key""",
    RANKED, CURRENT, READS,
)
def _(t):
    scope = t("executions").select(F.col("id").alias("execution_id"), "org_id", "family", "namespace")
    reads = t("inputs").select("execution_id", "name", F.col("epoch").alias("read_epoch")).join(scope, "execution_id")
    out = history.resolve_producers(reads, history.current_state(t("executions")))
    return out.select("execution_id", "name", "read_epoch", "producer_state", "producer_logic")


@query(
    "c3_batch_producers",
    """SELECT execution_id AS read_id, r.name, read_epoch, logic_hash, CASE WHEN logic_hash IS NULL THEN 'no_build' ELSE 'build' END AS producer_state
       FROM (SELECT execution_id, name, org_id, family, namespace, min(read_epoch) AS read_epoch FROM reads GROUP BY ALL) r
       ASOF LEFT JOIN (SELECT org_id, family, coalesce(namespace, '') AS namespace, target_key AS name, last_modified_epoch AS epoch, arg_max(logic_hash, id) AS logic_hash
                       FROM executions WHERE last_modified_epoch IS NOT NULL GROUP BY 1, 2, 3, 4, 5) b
       ON r.org_id = b.org_id AND r.family = b.family AND r.namespace = b.namespace AND r.name = b.name AND r.read_epoch <= b.epoch""",
    READS,
)
def _(t):
    scope = t("executions").select(F.col("id").alias("execution_id"), *history.in_tenant(t("executions"), history.TENANT))
    reads = t("inputs").groupBy("execution_id", "name").agg(F.min("epoch").alias("read_epoch")).join(scope, "execution_id").withColumn("read_id", F.struct("execution_id", "name"))
    builds = t("executions").select(*history.TENANT, F.col("target_key").alias("name"), F.col("last_modified_epoch").alias("epoch"), F.col("id").alias("ord"), "logic_hash")
    out = history.batch_producers(reads.drop("execution_id"), builds)
    return out.select(F.col("read_id.execution_id").alias("read_id"), "name", "read_epoch", "logic_hash", "producer_state")


@query(
    "c3_all_producers",
    """SELECT read_id, r.name, read_epoch, logic_hash, CASE WHEN logic_hash IS NULL THEN 'no_build' ELSE 'build' END AS producer_state
       FROM (SELECT execution_id AS read_id, name, min(epoch) AS read_epoch FROM inputs GROUP BY 1, 2) r
       ASOF LEFT JOIN (SELECT target_key AS name, last_modified_epoch AS epoch, arg_max(logic_hash, id) AS logic_hash FROM executions WHERE last_modified_epoch IS NOT NULL GROUP BY 1, 2) b
       ON r.name = b.name AND r.read_epoch <= b.epoch""",
)
def _(t):
    reads = t("inputs").groupBy(F.struct("execution_id", "name").alias("read_id"), "name").agg(F.min("epoch").alias("read_epoch"))
    builds = t("executions").select(F.col("target_key").alias("name"), F.col("last_modified_epoch").alias("epoch"), F.col("id").alias("ord"), "logic_hash")
    return history.batch_producers(reads, builds, scope=()).withColumn("read_id", F.col("read_id.execution_id"))


CHAIN = "chain AS (SELECT id, target_key, CASE WHEN id % 2 = 0 THEN 'cat.s' || (id % 4) || '.t' || (id % 60) END AS source_key, created_ms, confirmed_ms, org_id, family, coalesce(namespace, '') AS namespace FROM executions WHERE confirmed_ms IS NOT NULL)"


def chain_of(t):
    source = F.when(F.col("id") % 2 == 0, F.concat(F.lit("cat.s"), (F.col("id") % 4).cast("string"), F.lit(".t"), (F.col("id") % 60).cast("string")))
    return t("executions").filter("confirmed_ms IS NOT NULL").select("id", "target_key", source.alias("source_key"), "created_ms", "confirmed_ms", *history.TENANT)


@query(
    "c4_copy_chain",
    "SELECT id, max(depth) AS depth FROM walk GROUP BY id",
    CHAIN,
    """parents AS (SELECT id, parent FROM (SELECT c.id, p.id AS parent, p.source_key, row_number() OVER (PARTITION BY c.id ORDER BY p.confirmed_ms DESC, p.id DESC) AS n
         FROM chain c JOIN chain p ON p.target_key = c.source_key AND p.org_id = c.org_id AND p.family = c.family AND p.namespace = c.namespace AND p.confirmed_ms <= c.created_ms AND p.id < c.id) WHERE n = 1 AND source_key IS NOT NULL)""",
    """walk AS (WITH RECURSIVE w AS (SELECT id, id AS at_id, 1 AS depth FROM chain WHERE source_key IS NOT NULL
         UNION ALL SELECT w.id, p.parent, w.depth + 1 FROM w JOIN parents p ON p.id = w.at_id WHERE w.depth <= 3) SELECT * FROM w)""",
)
def _(t):
    return history.copy_chain_depth(chain_of(t), 3)


@query(
    "c4_all_copy_chains",
    "SELECT id, max(depth) AS depth FROM walk GROUP BY id",
    CHAIN,
    """parents AS (SELECT id, parent FROM (SELECT c.id, p.id AS parent, p.source_key, row_number() OVER (PARTITION BY c.id ORDER BY p.confirmed_ms DESC, p.id DESC) AS n
         FROM chain c JOIN chain p ON p.target_key = c.source_key AND p.confirmed_ms <= c.created_ms AND p.id < c.id) WHERE n = 1 AND source_key IS NOT NULL)""",
    """walk AS (WITH RECURSIVE w AS (SELECT id, id AS at_id, 1 AS depth FROM chain WHERE source_key IS NOT NULL
         UNION ALL SELECT w.id, p.parent, w.depth + 1 FROM w JOIN parents p ON p.id = w.at_id WHERE w.depth <= 3) SELECT * FROM w)""",
)
def _(t):
    return history.copy_chain_depth(chain_of(t), 3, scope=())


@query("c6_no_pending", "SELECT id FROM executions e WHERE confirmed_ms IS NOT NULL AND NOT EXISTS (SELECT 1 FROM executions p WHERE p.confirmed_ms IS NULL AND p.org_id = e.org_id AND p.family = e.family AND coalesce(p.namespace, '') = coalesce(e.namespace, '') AND p.target_key = e.target_key)")
def _(t):
    e = t("executions")
    return history.no_pending(e.filter("confirmed_ms IS NOT NULL"), e.filter("confirmed_ms IS NULL")).select("id")


@query("c6_all_pending", "SELECT id FROM executions e WHERE confirmed_ms IS NOT NULL AND NOT EXISTS (SELECT 1 FROM executions p WHERE p.confirmed_ms IS NULL AND p.org_id = e.org_id AND p.family = e.family AND coalesce(p.namespace, '') = coalesce(e.namespace, '') AND p.target_key = e.target_key)")
def _(t):
    e = t("executions")
    return history.no_pending(e.filter("confirmed_ms IS NOT NULL"), e.filter("confirmed_ms IS NULL")).select("id")


CANDIDATES = """met AS (SELECT submission_id, c.target_key AS source_key, last_modified_epoch AS source_epoch, row_number() OVER (PARTITION BY submission_id ORDER BY last_modified_epoch DESC, c.target_key) AS rank, c.id AS source_id
  FROM submissions s JOIN current c ON s.org_id = c.org_id AND s.family = c.family AND s.namespace = c.namespace AND s.namespace_hash = c.namespace_hash AND s.target_key <> c.target_key WHERE last_modified_epoch IS NOT NULL)"""


def candidates(t, n):
    return history.copy_candidates(t("submissions"), history.current_state(t("executions")), n)


@query("f1_top_candidates", "SELECT submission_id, max(source_epoch) AS best, count(*) AS n FROM met WHERE rank <= 3 GROUP BY 1", RANKED, CURRENT, CANDIDATES)
def _(t):
    return candidates(t, 3).groupBy("submission_id").agg(F.max("source_epoch").alias("best"), F.count(F.lit(1)).alias("n"))


@query(
    "f2_first_choice",
    "SELECT submission_id, CASE WHEN c < coalesce(s, 1000000) THEN c END AS chosen_rank FROM (SELECT submission_id, min(CASE WHEN source_epoch % 3 = 0 THEN rank END) AS c, min(CASE WHEN source_epoch % 3 = 1 THEN rank END) AS s FROM met WHERE rank <= 16 GROUP BY 1)",
    RANKED, CURRENT, CANDIDATES.replace("last_modified_epoch AS source_epoch", "last_modified_epoch // 86400000 AS source_epoch").replace("DESC, c.target_key)", "DESC, c.target_key, c.id)"),
)
def _(t):
    day = F.floor(F.col("source_epoch") / 86400000) % 3
    return history.first_choice(candidates(t, 16).withColumn("verdict", F.when(day == 0, "choose").when(day == 1, "stop").otherwise("next")))


# --- freshness and decisions ------------------------------------------------------------------

NOW = "now_in AS (SELECT submission_id, name, epoch + CASE WHEN submission_id % 3 = 0 THEN 1 ELSE 0 END AS epoch, producer FROM submissions s JOIN current c USING (org_id, family, namespace, target_key) JOIN (SELECT execution_id AS id, * FROM inputs) USING (id) WHERE name <> s.target_key AND (submission_id % 7 > 0 OR epoch % 5 > 0))"
THEN = "then_in AS (SELECT submission_id, name, epoch, producer FROM submissions s JOIN current c USING (org_id, family, namespace, target_key) JOIN (SELECT execution_id AS id, * FROM inputs) USING (id) WHERE name <> s.target_key)"
VERDICTS = """verdicts AS (SELECT submission_id, name, n_now IS NULL OR n_then IS NULL OR n_now > 1 AS set_changed, a.epoch IS NULL OR b.epoch IS NULL OR n_then > 1 AS unprovable, coalesce(a.producer <> b.producer, false) AS producer_changed, a.epoch, b.epoch AS recorded_epoch
  FROM (SELECT submission_id, name, count(*) AS n_now, max(epoch) AS epoch, max(producer) AS producer FROM now_in GROUP BY 1, 2) a
  FULL JOIN (SELECT submission_id, name, count(*) AS n_then, max(epoch) AS epoch, max(producer) AS producer FROM then_in GROUP BY 1, 2) b USING (submission_id, name))"""
FOLDED = """folded AS (SELECT submission_id, count(*) AS considered, count(*) FILTER (unprovable OR epoch > recorded_epoch) AS drifted, bool_or(unprovable) AS any_unprovable, bool_or(producer_changed) AS any_producer_changed,
  bool_or(set_changed) AS set_changed, bool_and(coalesce(epoch = recorded_epoch, false)) AS unchanged FROM verdicts GROUP BY 1)"""
JUDGED = """judged AS (SELECT *, CASE WHEN coalesce(set_changed, false) THEN 'dependency_set_changed' WHEN n > 0 AND prev_epoch IS NULL AND NOT test THEN 'no_build_anchor' WHEN coalesce(any_unprovable, false) THEN 'upstream_outdated'
    WHEN coalesce(any_producer_changed, false) THEN 'upstream_query_changed' WHEN stale AND NOT lag THEN 'upstream_outdated' END AS rebuild
  FROM (SELECT *, coalesce(tolerance_ms > 0 AND age < tolerance_ms, false) AS lag, CASE WHEN n = 0 THEN false WHEN test OR policy = 'any' THEN d > 0 ELSE d = n END AS stale
    FROM (SELECT s.*, f.* EXCLUDE (submission_id), c.id IS NOT NULL AS has_prior, coalesce(c.logic_hash = submitted_hash, false) AS same, c.last_modified_epoch AS prev_epoch, now_ms - c.last_modified_epoch AS age,
            coalesce(considered, 0) AS n, coalesce(drifted, 0) AS d, s.execution_type = 9 AS test
          FROM submissions s LEFT JOIN current c USING (org_id, family, namespace, target_key) LEFT JOIN folded f ON s.submission_id = f.submission_id)))"""
CHAIN_OF = (RANKED, CURRENT, NOW, THEN, VERDICTS, FOLDED, JUDGED)


def upstreams(t):
    prev = history.attach_current(t("submissions"), history.current_state(t("executions"))).filter("prev IS NOT NULL").select("submission_id", "target_key", F.col("prev.id").alias("execution_id"))
    then = prev.join(t("inputs"), "execution_id").filter("name <> target_key").select("submission_id", "name", "epoch", "producer")
    now = then.filter("submission_id % 7 > 0 OR epoch % 5 > 0").withColumn("epoch", F.col("epoch") + F.when(F.col("submission_id") % 3 == 0, 1).otherwise(0))
    return freshness.upstream_verdicts(now, then)


def judged(t):
    subs = history.attach_current(t("submissions"), history.current_state(t("executions")))
    subs = subs.withColumns({
        "has_prior": F.col("prev").isNotNull(), "identity_matches": F.coalesce(F.col("prev.logic_hash") == F.col("submitted_hash"), F.lit(False)), "prev_epoch": F.col("prev.last_modified_epoch"),
        "build_age_ms": freshness.build_age_ms(F.col("now_ms"), F.col("prev.last_modified_epoch"), F.col("prev.confirmed_ms"), F.lit(False)),
    })
    return freshness.judge_freshness(subs, freshness.fold_freshness(upstreams(t)))


@query("d7_freshness_fold", "SELECT * FROM folded", *CHAIN_OF[:-1])
def _(t):
    return freshness.fold_freshness(upstreams(t))


@query("d8_ambiguity", "SELECT execution_id, name, count(*) AS n FROM inputs GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return freshness.input_ambiguity(t("inputs"), "execution_id")


@query("l13_judge_freshness", "SELECT submission_id, rebuild, CASE WHEN rebuild IS NULL THEN CASE WHEN stale THEN 'within_lag_tolerance' WHEN d > 0 THEN 'tolerated_stale' ELSE 'fresh' END END AS reuse, d > 0 AS drift_present FROM judged", *CHAIN_OF)
def _(t):
    return judged(t).select("submission_id", "rebuild", "reuse", "drift_present")


@query(
    "l14_decide",
    """SELECT submission_id, CASE WHEN skip THEN 'skip' ELSE 'build' END AS decision, skip AND d > 0 AS is_stale,
         CASE WHEN NOT has_prior THEN 'first_build' WHEN NOT same THEN 'identity_mismatch' WHEN skip THEN 'reused_' || CASE WHEN stale THEN 'within_lag_tolerance' WHEN d > 0 THEN 'tolerated_stale' ELSE 'fresh' END ELSE rebuild END AS reason
       FROM (SELECT *, has_prior AND same AND rebuild IS NULL AS skip FROM judged)""",
    *CHAIN_OF,
)
def decide_all(t):
    return freshness.decide(judged(t)).select("submission_id", "decision", "is_stale", "reason")


@query(
    "h17_descriptions",
    """SELECT submission_id, CASE WHEN has_prior AND same AND rebuild IS NULL THEN
           CASE WHEN execution_type = 8 THEN 'seed was a no-op because its data has not changed'
                WHEN execution_type = 7 OR tolerance_ms = 0 OR n = 0 OR coalesce(unchanged, false) THEN noun || ' was a no-op because both its query and its upstream data are up to date'
                WHEN lag THEN noun || ' was a no-op because its query is up to date and its data is within lag tolerance'
                ELSE noun || ' was a no-op because its query is up to date and at least one upstream dependency is unchanged' END
         WHEN execution_type = 8 THEN CASE WHEN has_prior THEN 'seed was loaded because its data changed' ELSE 'seed was loaded because it did not exist' END
         WHEN test THEN 'data test was executed because it has no prior execution or its query changed'
         WHEN NOT has_prior THEN noun || ' was executed because its table did not exist'
         ELSE noun || ' was executed because either its query didn''t match or its upstream data is out of date' END AS description
       FROM (SELECT *, CASE execution_type WHEN 7 THEN 'snapshot' WHEN 9 THEN 'data test' WHEN 8 THEN 'seed' ELSE 'model' END AS noun FROM judged)""",
    *CHAIN_OF,
)
def _(t):
    return freshness.decide(judged(t)).select("submission_id", "description")


@query("m12_audit_skips", "SELECT submission_id, 'skip' AS decision FROM judged WHERE has_prior AND same AND rebuild IS NULL AND (coalesce(set_changed, false) OR coalesce(any_unprovable, false) OR drifted > 0 AND NOT (d > 0))", *CHAIN_OF)
def _(t):
    return freshness.decide(judged(t)).transform(audit.audit_skips).select("submission_id", "decision")


# --- decisions' rollups -----------------------------------------------------------------------

BUILT = "count(*) FILTER (decision = 'build')"


@query("d1_overview", f"SELECT {BUILT} AS built, count(*) FILTER (decision = 'skip') AS reused, count(*) FILTER (decision = 'clone') AS cloned, count(*) AS total, count(DISTINCT project) AS projects, count(DISTINCT environment) AS environments, count(DISTINCT invocation) AS invocations, CAST(floor(100.0 * count(*) FILTER (decision <> 'build') / count(*) + 0.5) AS BIGINT) AS reuse_rate FROM decisions")
def _(t):
    return audit.overview(t("decisions"))


@query("d2_daily_activity", f"SELECT CAST(created_at AS DATE)::VARCHAR AS day, {BUILT} AS built, count(*) - {BUILT} AS reused FROM decisions WHERE created_at >= TIMESTAMP '2024-01-05' GROUP BY 1")
def _(t):
    return audit.daily_activity(t("decisions"), "2024-01-05").withColumn("day", F.col("day").cast("string"))


@query("d3_rollup_project", f"SELECT 'p' || n_nationkey AS project, coalesce(b, 0) AS built, coalesce(r, 0) AS reused FROM nation LEFT JOIN (SELECT project, {BUILT} AS b, count(*) - {BUILT} AS r FROM decisions GROUP BY 1) ON project = 'p' || n_nationkey")
def _(t):
    return audit.rollup_dimension(t("nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("project")), t("decisions"), "project")


@query("d4_decision_rollup", f"SELECT org_id, project, environment, invocation, CAST(bit_count(grouping_id(org_id, project, environment, invocation)) AS INTEGER) AS level, count(*) AS total, {BUILT} AS built FROM decisions GROUP BY ROLLUP (org_id, project, environment, invocation)")
def _(t):
    return audit.decision_rollup(t("decisions"))


@query("d6_invocation_counts", f"SELECT CASE WHEN invocation <> '' THEN invocation ELSE 'session:' || session END AS invocation, {BUILT} AS built, count(*) FILTER (decision = 'skip') AS reused, count(*) FILTER (decision = 'clone') AS cloned FROM decisions GROUP BY 1")
def _(t):
    return audit.invocation_counts(t("decisions"))


@query("d12_explain_census", "SELECT kind, decision, CAST(grouping_id(kind, decision) AS INTEGER) AS gid, count(*) AS n FROM decisions GROUP BY CUBE (kind, decision)")
def _(t):
    return audit.explain_census(t("decisions"))


@query("d13_agreement", "SELECT axis, count(*) AS total, count(*) FILTER (expected = actual) AS agree, count(*) FILTER (expected = actual AND expected = 'build') AS agree_execute, count(*) FILTER (expected = actual AND expected = 'skip') AS real_skip, count(*) FILTER (expected <> actual) AS divergence FROM (SELECT kind AS axis, decision AS expected, CASE WHEN decision_id % 10 = 0 THEN 'build' ELSE decision END AS actual FROM decisions) GROUP BY ROLLUP (axis)")
def _(t):
    return audit.agreement_report(t("decisions").select(F.col("kind").alias("axis"), F.col("decision").alias("expected"), F.when(F.col("decision_id") % 10 == 0, "build").otherwise(F.col("decision")).alias("actual")))


@query("d15_key_quality", "SELECT part, name, count(*) AS n, part IS NULL OR name IS NULL AS has_null FROM prev GROUP BY part, name HAVING count(*) > 1 OR part IS NULL OR name IS NULL")
def _(t):
    return tables.key_quality(t("prev"), ["part", "name"])


@query("d17_upstream_set", "SELECT execution_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT execution_id, name FROM inputs) GROUP BY 1")
def _(t):
    return audit.upstream_set(t("inputs"), "execution_id")


@query("e4_latest_decisions", "SELECT org_id, environment, node_uid, decision_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY org_id, environment, node_uid ORDER BY created_at DESC, decision_id DESC) AS n FROM decisions) WHERE n = 1")
def _(t):
    return audit.latest_decisions(t("decisions")).select("org_id", "environment", "node_uid", "decision_id", "decision")


@query("e6_dedupe_decisions", "SELECT request_id, max(decision_id) AS decision_id FROM decisions GROUP BY 1")
def _(t):
    return audit.dedupe_decisions(t("decisions"), "request_id").select("request_id", "decision_id")


@query("f3_recent_invocations", f"SELECT invocation, max(decision_id) AS last_id, count(*) AS total, {BUILT} AS built FROM decisions GROUP BY 1 ORDER BY last_id DESC, invocation LIMIT 20")
def _(t):
    return audit.recent_invocations(t("decisions"), 20)


@query("f6_invocation_decisions", "SELECT invocation, decision_id, row_number() OVER (PARTITION BY invocation ORDER BY created_at, decision_id) AS n FROM decisions")
def _(t):
    return audit.invocation_decisions(t("decisions")).select("invocation", "decision_id", "n")


@query("m13_scope_audit", "SELECT family, project AS target_key, count(DISTINCT org_id) AS orgs, count(*) AS n FROM executions GROUP BY 1, 2 HAVING count(DISTINCT org_id) > 1")
def _(t):
    return audit.audit_scope(t("executions").withColumn("target_key", F.col("project")))


# --- table building ---------------------------------------------------------------------------

BAG = "k, part, name, n, day"


@query("k1_full", f"SELECT {BAG} FROM sel")
def _(t):
    return tables.build_full(t("sel"))


@query("k2_append", f"SELECT {BAG} FROM prev UNION ALL SELECT {BAG} FROM sel")
def _(t):
    return tables.build_append(t("prev"), t("sel"))


@query("k3_merge", f"SELECT {BAG} FROM sel UNION ALL SELECT {BAG} FROM prev WHERE k NOT IN (SELECT k FROM sel)")
def _(t):
    return tables.build_merge(t("prev"), t("sel"), ["k"])


@query("k3_merge_predicate", f"SELECT {BAG} FROM sel UNION ALL SELECT {BAG} FROM prev WHERE NOT (coalesce(day >= 20, false) AND k IN (SELECT k FROM sel))")
def _(t):
    return tables.build_merge(t("prev"), t("sel"), ["k"], "day >= 20")


@query("k4_insert_overwrite", f"SELECT {BAG} FROM sel UNION ALL SELECT {BAG} FROM prev p WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.part IS NOT DISTINCT FROM p.part AND s.day IS NOT DISTINCT FROM p.day)")
def _(t):
    return tables.build_insert_overwrite(t("prev"), t("sel"), ["part", "day"])


@query("k5_delete_insert", f"SELECT {BAG} FROM sel UNION ALL SELECT {BAG} FROM prev p WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.day IS NOT DISTINCT FROM p.day AND s.part IS NOT DISTINCT FROM p.part AND s.name IS NOT DISTINCT FROM p.name)")
def _(t):
    return tables.build_delete_insert(t("prev"), t("sel"), ["day", "part", "name"])


@query("k5_delete_insert_equal", f"SELECT {BAG} FROM sel UNION ALL SELECT {BAG} FROM prev p WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.day = p.day AND s.part = p.part)")
def _(t):
    return tables.build_delete_insert(t("prev"), t("sel"), ["day", "part"], null_safe=False)


@query("k6_microbatch", f"SELECT {BAG} FROM prev WHERE NOT coalesce(day >= 10 AND day < 20, false) UNION ALL SELECT {BAG} FROM sel WHERE day >= 10 AND day < 20")
def _(t):
    return tables.build_microbatch(t("prev"), t("sel"), "day", 10, 20)


@query("k7_replace_where", f"SELECT {BAG} FROM prev WHERE NOT coalesce(day < 15, false) UNION ALL SELECT {BAG} FROM sel WHERE day < 15")
def _(t):
    return tables.build_replace_where(t("prev"), t("sel").filter("day < 15"), "day < 15")


SCD = "k, name, n, changed_at, dbt_scd_id, dbt_updated_at, dbt_valid_from, dbt_valid_to"


def snapshot(strategy: str, hard: str):
    def run(t):
        hist, src = t("history"), t("source")
        hist = hist.withColumn("changed_at", F.col("dbt_updated_at"))
        stamp = lambda d, *cs: d.withColumns({c: F.timestamp_seconds(F.col(c) * 3600) for c in cs})
        hist, src = stamp(hist, "changed_at", "dbt_updated_at", "dbt_valid_from", "dbt_valid_to"), stamp(src, "changed_at")
        now = F.timestamp_seconds(F.lit(360000))
        out = tables.build_snapshot(hist, src, "k", strategy, now, "changed_at", ("name", "n"), hard)
        hours = {c: (F.unix_seconds(c) / 3600).cast("long") for c in ("changed_at", "dbt_updated_at", "dbt_valid_from", "dbt_valid_to")}
        return out.withColumns(hours).drop("dbt_scd_id")

    return run


def snapshot_sql(strategy: str, hard: str) -> str:
    differs = "o.dbt_valid_from < s.changed_at" if strategy == "timestamp" else "(o.name IS DISTINCT FROM s.name OR o.n IS DISTINCT FROM s.n)"
    gone = "WHEN s.k IS NULL THEN 100" if hard == "invalidate" else ""
    return f"""SELECT k, name, n, dbt_updated_at AS changed_at, dbt_updated_at, dbt_valid_from, dbt_valid_to FROM history WHERE dbt_valid_to IS NOT NULL
      UNION ALL SELECT o.k, o.name, o.n, o.dbt_updated_at, o.dbt_updated_at, o.dbt_valid_from, CASE WHEN s.k IS NOT NULL AND {differs} THEN s.changed_at {gone} END FROM (SELECT * FROM history WHERE dbt_valid_to IS NULL) o LEFT JOIN source s ON o.k = s.k
      UNION ALL SELECT s.k, s.name, s.n, s.changed_at, s.changed_at, s.changed_at, NULL FROM source s LEFT JOIN (SELECT * FROM history WHERE dbt_valid_to IS NULL) o ON o.k = s.k WHERE o.k IS NULL OR {differs}"""


for _s in ("timestamp", "check"):
    for _h in ("ignore", "invalidate"):
        query(f"k8_snapshot_{_s}_{_h}", snapshot_sql(_s, _h))(snapshot(_s, _h))


@query("k11_append_new_columns", f"SELECT {BAG}, NULL::BIGINT AS extra FROM prev UNION ALL SELECT {BAG}, n * 2 AS extra FROM sel")
def _(t):
    prev, sel = tables.reconcile_schema(t("prev"), t("sel").withColumn("extra", F.col("n") * 2), "append_new_columns")
    return tables.build_append(prev, sel)


@query("k12_transition", f"SELECT {BAG} FROM sel UNION ALL SELECT {BAG} FROM (SELECT * FROM prev UNION ALL SELECT * FROM sel) WHERE k NOT IN (SELECT k FROM sel)")
def _(t):
    appended = tables.transition(t("prev"), t("sel"), "append", "append", ["k"])
    # a merge needs unique target keys: rows the append added go first
    kept = appended.join(t("sel").select("k"), "k", "left_anti").select(*appended.columns)
    return tables.transition(kept, t("sel"), "append", "merge", ["k"])


@query("k14_select_new", f"SELECT {BAG} FROM sel WHERE k > (SELECT coalesce(max(k), 0) FROM prev WHERE day < 7)")
def _(t):
    return tables.select_new(t("sel"), t("prev").filter("day < 7"), "k", 0)


@query("e12_close_versions", "SELECT k, start, lead(start) OVER (PARTITION BY k ORDER BY start) AS dbt_valid_to FROM (SELECT DISTINCT o_custkey AS k, epoch_ms(o_orderdate) AS start FROM orders)")
def _(t):
    versions = t("orders").select(F.col("o_custkey").alias("k"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("start")).distinct()
    return tables.close_versions(versions, "k", "start")


# --- evidence ---------------------------------------------------------------------------------


@query("g2_bag_difference", f"SELECT *, 'left' AS side FROM (SELECT {BAG} FROM prev EXCEPT ALL SELECT k - 5, part, left(name, length(name) - 1), n - 1, day FROM sel) UNION ALL SELECT *, 'right' FROM (SELECT k - 5, part, left(name, length(name) - 1), n - 1, day FROM sel EXCEPT ALL SELECT {BAG} FROM prev)")
def _(t):
    back = t("sel").select((F.col("k") - 5).alias("k"), "part", F.expr("left(name, length(name) - 1)").alias("name"), (F.col("n") - 1).alias("n"), "day")
    return evidence.bag_difference(t("prev"), back)


@query(
    "d9_content_digest",
    """SELECT 'bag-v1' AS format, true AS known, count(*) AS n_rows, sha256(count(*) || '|' || CAST(sum(w0) AS VARCHAR) || '|' || CAST(sum(w1) AS VARCHAR) || '|' || CAST(sum(w2) AS VARCHAR) || '|' || CAST(sum(w3) AS VARCHAR)) AS digest
       FROM (SELECT CAST(('0x' || h[1:15]) AS BIGINT) AS w0, CAST(('0x' || h[16:30]) AS BIGINT) AS w1, CAST(('0x' || h[31:45]) AS BIGINT) AS w2, CAST(('0x' || h[46:60]) AS BIGINT) AS w3
             FROM (SELECT sha256('6:bigint;' || strlen(CAST(k AS VARCHAR)) || ':' || k || ';' || '6:string;' || strlen(name) || ':' || name || ';' || '6:bigint;' || CASE WHEN day IS NULL THEN 'N;' ELSE strlen(CAST(day AS VARCHAR)) || ':' || day || ';' END) AS h FROM prev))""",
)
def _(t):
    return evidence.content_digest(t("prev").select("k", "name", "day"))


@query(
    "e9_ordinals",
    """SELECT generation, relation, seq, CAST(max(CASE WHEN changed THEN n END) OVER (PARTITION BY generation, relation ORDER BY seq) AS BIGINT) AS ordinal
       FROM (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY generation ORDER BY seq) AS n
             FROM (SELECT *, known_write OR lag(seq) OVER w IS NULL OR lag(schema_hash) OVER w <> schema_hash OR lag(content_hash) OVER w <> content_hash AS changed FROM observations WINDOW w AS (PARTITION BY generation, relation ORDER BY seq)))""",
)
def _(t):
    return evidence.assign_ordinals(t("observations")).select("generation", "relation", "seq", "ordinal")


@query("m14_diff_versions", "SELECT coalesce(p.k, s.k) AS k, CASE WHEN p.k IS NULL THEN 'added' WHEN s.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM prev p FULL JOIN sel s ON p.k = s.k")
def _(t):
    return evidence.diff_versions(t("prev"), t("sel"), ["k"])


@query(
    "m18_evidence_valid",
    "SELECT generation, bool_and(ordinal BETWEEN 1 AND 1000 AND seq % 997 > 0) AS valid FROM (SELECT *, seq % 1001 AS ordinal FROM observations) GROUP BY 1",
)
def _(t):
    obs = t("observations").select(
        "generation", F.lit("bag-v1").alias("format"), F.sha2("schema_hash", 256).alias("schema_hash"), F.sha2("content_hash", 256).alias("content_hash"), (F.col("seq") % 1001).alias("ordinal"), (F.col("seq") % 997 == 0).alias("dirty")
    )
    return evidence.evidence_valid(obs, t("observations").select("generation").distinct().withColumn("clock", F.lit(1000)))


# --- selectors, lineage, tests ----------------------------------------------------------------

EDGES = "edges AS (SELECT DISTINCT n.uid AS src, i.uid AS dst FROM node_inputs i JOIN nodes n ON i.name = n.relation WHERE n.uid <> i.uid)"


def edges(t):
    return audit.lineage_edges(t("nodes"), t("node_inputs"))


@query("c10_lineage_edges", "SELECT src, dst FROM edges", EDGES)
def _(t):
    return edges(t)


@query(
    "m4_lineage_layers",
    "SELECT node, max(layer) AS layer FROM walk GROUP BY node",
    EDGES,
    "walk AS (WITH RECURSIVE w AS (SELECT DISTINCT src AS node, 0 AS layer FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT dst, layer + 1 FROM w JOIN edges ON node = src) SELECT * FROM w)",
)
def _(t):
    return audit.lineage_layers(edges(t))


@query(
    "m2_expand_selection",
    "SELECT DISTINCT node FROM walk",
    EDGES,
    "walk AS (WITH RECURSIVE w AS (SELECT uid AS node FROM nodes WHERE uid IN ('n1', 'n2') UNION SELECT dst FROM w JOIN edges ON node = src) SELECT * FROM w)",
)
def _(t):
    return audit.expand_selection(t("nodes").filter("uid IN ('n1', 'n2')").select(F.col("uid").alias("node")), edges(t), up=False, down=True)


FLAGS = {c: f"s.uid IS NULL OR n.{c} IS DISTINCT FROM s.{c}" for c in (*audit.COMPONENTS, "relation")}
MODIFIED = "s.uid IS NULL OR " + " OR ".join(f"n.{c} IS DISTINCT FROM s.{c}" for c in audit.COMPONENTS)


@query(
    "m1_select_state",
    f"SELECT n.org_id, n.project, n.environment, n.uid, s.uid IS NULL AS is_new, s.uid IS NOT NULL AS is_old, {', '.join(f'({x}) AS {c}_changed' for c, x in FLAGS.items())}, ({MODIFIED}) AS modified, NOT ({MODIFIED}) AS unmodified FROM nodes n LEFT JOIN state s USING (org_id, project, environment, uid)",
)
def _(t):
    return audit.classify_nodes(t("nodes"), t("state"))


@query("d11_test_outcome", "SELECT count(*) AS failures, count(*) > 100 AS should_error, count(*) > 0 AS should_warn, CASE WHEN count(*) > 100 THEN 'fail' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status FROM orders WHERE o_totalprice < 0 OR o_orderkey % 10 = 0")
def _(t):
    return audit.test_outcome(t("orders").filter("o_totalprice < 0 OR o_orderkey % 10 = 0"), "count(*)", "> 100", "> 0")


@query(
    "l6_fingerprint_log",
    "SELECT sha256(txt) AS fingerprint, count(*) AS n, count(DISTINCT query) AS variants FROM (SELECT query, CASE turn % 4 WHEN 0 THEN 'select a , b from t' || (conv_id % 20) || ' where x <> ''It''''s -- not''' WHEN 1 THEN 'select a , b from t' || (conv_id % 20) || ' where x <> ''It''''s -- not''' WHEN 2 THEN 'select now ( ) , \"random(\" from t' || (conv_id % 20) ELSE 'select rand , ''now()'' from t' END AS txt FROM sql_log) GROUP BY 1",
)
def _(t):
    return querylog.fingerprint_log(t("sql_log"), "query")


@query("l7_volatile_calls", "SELECT conv_id, turn, turn % 4 = 2 AS volatile FROM sql_log")
def _(t):
    return querylog.scan_volatile(t("sql_log"), "query").select("conv_id", "turn", "volatile")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decide every submission against the log, then count the outcomes."""
    decided = decide_all(lambda table: fixture(spark, sf_dir, table))
    return decided.groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES["flagship_decisions"] = flagship
ORACLES["flagship_decisions"] = oracle(f"SELECT decision, reason, count(*) AS n FROM ({ORACLES['l14_decide'].split('judged AS')[-1].split(')))', 1)[1].lstrip()}) GROUP BY 1, 2", *CHAIN_OF)
