"""One answer for each submission, from evidence: skip, clone or build, decided for all at once.

The stages of :func:`answer` are tables of submissions. Each stage carries on only what the
ones before left undecided: the build under judgement is selected from the target's history,
freshness settles what may be skipped, the search for equivalents settles what may be cloned,
and what is left is built, with the reason and the codes of what was refused. All flags come
from the log of executions, the inputs and the submissions; the latest states, the reads of
builds and the search's verdicts are settled in written tables once and shared by the stages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import SEED, TEST, VIEW
from ..functions.names import name_parts
from ..sources.tables import written
from . import copies, freshness, history, querylog, selection
from .history import SCOPE, TENANT

FULL = 1
#: Fixed values, which must match the service: copies behind a source that may still be copied on
#: duckdb, and how many equivalents are considered.
MOST_COPIES = 2
CANDIDATES = 16
#: Rebuilds that a fresh equivalent elsewhere can spare, and those for which an older build is reported.
STALE = ("upstream_outdated", "upstream_query_changed")
OLDER = (*STALE, "dependency_set_changed", "identity_mismatch", "upstream_names_changed", "copy_logic_mismatch", "input_binding_changed")


@dataclass
class Evidence:
    """What a batch of submissions is decided on.

    ``submissions``: submission_id, the scope (org_id, family, namespace, target_key), execution_type,
    node_uid, project, sql, sql_hash, text_hash, root, template_hash, compare_template, body_hash,
    namespace_hash, values_hash, evaluation_requested, ignore_external, policy, tolerance_ms, now_ms,
    allow_clones, chain_limit. ``inputs``: submission_id, name, epoch, producer. ``deps``:
    submission_id, name, query. ``readings``, the submission read in other schemas:
    submission_id, hash, schema, reads (canonical names in order, joined by commas).
    ``executions``: id, the scope, execution_type, node_uid, project, sql_hash, text_hash, root,
    template_hash, namespace_hash, values_hash, last_modified_epoch, created_ms, confirmed_ms,
    source_key, source_epoch and published (of copies), table_type, failures, should_error,
    should_warn. ``recorded``: execution_id, name, epoch, producer.
    """

    submissions: DataFrame
    inputs: DataFrame
    deps: DataFrame
    readings: DataFrame
    executions: DataFrame
    recorded: DataFrame


def known_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def row_of(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}.{name}")


def identity_equal(row: str) -> Column:
    """Whether a recorded row has the submission's rendered identity, or its template's where there is one,
    its namespace identity doesn't contradict, and a copy on databricks was published."""
    same = known_equal(F.col("sql_hash"), row_of(row, "sql_hash")) | known_equal(F.col("template_hash"), row_of(row, "template_hash"))
    databricks, ordinary = F.col("family") == "databricks", row_of(row, "source_key").isNull()
    logic = (databricks & ordinary) | F.coalesce(row_of(row, "namespace_hash") == F.col("namespace_hash"), F.lit(True))
    return same & logic & usable(row)


def usable(row: str) -> Column:
    """Builds, copies that clients registered, and published copies; only databricks asks."""
    return (F.col("family") != "databricks") | row_of(row, "source_key").isNull() | row_of(row, "sql_hash").isNull() | F.coalesce(row_of(row, "published"), F.lit(False))


def build_time(row: str) -> Column:
    """When a recorded build was made, by the clock its family's epochs allow."""
    copied = row_of(row, "source_key").isNotNull()
    of_copy = F.when(F.coalesce(row_of(row, "published"), F.lit(False)) & (row_of(row, "source_epoch") > 0), row_of(row, "source_epoch"))
    return F.when(F.col("family") == "duckdb", row_of(row, "confirmed_ms")).when((F.col("family") == "databricks") & copied, of_copy).otherwise(row_of(row, "last_modified_epoch"))


def reads_of(inputs: DataFrame, key: str, own: DataFrame) -> DataFrame:
    """(key, reads): the names that each row of ``own`` (key, own) reads besides its own target, canonical, in order, joined by commas."""
    met = own.join(inputs.select(key, F.upper("name").alias("name")), key, "left").filter("name IS NULL OR name <> upper(own)")
    return own.select(key).join(met.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("reads")), key, "left").withColumn("reads", F.coalesce("reads", F.lit("")))


def facts(e: Evidence) -> DataFrame:
    """The submissions with what follows from them and their inputs alone: n_own and own_epoch of their own target, reads,
    deps_complete, volatile."""
    subs = e.submissions.withColumn("namespace", F.coalesce("namespace", F.lit("")))
    own = subs.select("submission_id", F.col("target_key").alias("own"))
    mine = e.inputs.join(own, "submission_id").filter("name = own").groupBy("submission_id").agg(F.count(F.lit(1)).alias("n_own"), F.max("epoch").alias("own_epoch"))
    blank = (F.coalesce(F.trim("name"), F.lit("")) == "") | (F.coalesce(F.trim("query"), F.lit("")) == "")
    deps = e.deps.groupBy("submission_id").agg((~F.bool_or(blank) & (F.countDistinct("name") == F.count(F.lit(1)))).alias("deps_complete"), F.bool_or(querylog.is_volatile(F.coalesce("query", F.lit("")))).alias("dep_volatile"))
    out = subs.join(mine, "submission_id", "left").join(deps, "submission_id", "left").join(reads_of(e.inputs, "submission_id", own), "submission_id")
    return out.withColumns({
        "n_own": F.coalesce("n_own", F.lit(0)), "deps_complete": F.coalesce("deps_complete", F.lit(True)),
        "volatile": querylog.is_volatile(F.coalesce("sql", F.lit(""))) | F.coalesce("dep_volatile", F.lit(False)),
    }).drop("dep_volatile")


def own_target(row: str) -> Column:
    """What a submission says of its own target against a build of it: as_built, modified, missing or ambiguous."""
    later = F.col("own_epoch") > row_of(row, "last_modified_epoch")
    return (
        F.when(F.col("n_own") == 0, "missing")
        .when((F.col("n_own") > 1) | F.col("own_epoch").isNull() | row_of(row, "last_modified_epoch").isNull(), "ambiguous")
        .when(later & ~F.col("ignore_external"), "modified").otherwise("as_built")
    )


def select_builds(e: Evidence, subs: DataFrame, current: DataFrame) -> DataFrame:
    """Adds ``no_candidate`` (the reason, or NULL), ``base``, the recorded row under judgement, ``prev``, the target's
    latest row, and has_prior.

    Models and seeds are judged against their target's current state, data tests against their
    latest outcome. Where the kind of an otherwise equal node changed, the newest of its last
    50 builds with the submission's own kind and identity takes its place.
    """
    models = history.attach_current(subs.filter(F.col("execution_type") != TEST), current)
    test_keys = ["org_id", "node_uid", "project", "namespace", "family"]
    outcomes = history.latest_test(e.executions, TEST).select(*test_keys, F.struct(*e.executions.columns).alias("prev"))
    tests = subs.filter(F.col("execution_type") == TEST).join(outcomes, test_keys, "left")
    plain = lambda df: df.withColumn("prev", F.when(F.col("prev").isNotNull(), F.struct(*(F.col(f"prev.{c}") for c in e.executions.columns))))
    both = written(plain(models).unionByName(plain(tests)))
    latest = both.select("submission_id", F.col("prev.id").alias("execution_id"), F.col("prev.target_key").alias("own")).filter("execution_id IS NOT NULL")
    then = reads_of(e.recorded, "execution_id", latest.select("execution_id", "own").distinct()).select(F.col("execution_id").alias("_id"), F.col("reads").alias("recorded_reads"))
    registered = F.col("prev.source_key").isNotNull() & F.col("prev.sql_hash").isNull()
    homes = e.readings.select("submission_id", F.col("schema").alias("_schema"), F.col("hash").alias("home_hash"))
    seen = both.withColumn("_schema", F.lower(F.get(name_parts(F.col("prev.source_key")), 1))).join(then, F.col("prev.id") == F.col("_id"), "left").drop("_id")
    seen = seen.join(homes, ["submission_id", "_schema"], "left").drop("_schema")
    generic = known_equal(F.col("prev.namespace_hash"), F.col("namespace_hash")) | (registered & known_equal(F.col("home_hash"), F.col("prev.namespace_hash")))
    copied_logic = F.col("prev.source_key").isNotNull() & F.when(F.col("family") == "databricks", F.col("prev.sql_hash").isNotNull() & usable("prev")).otherwise(generic)
    same_text = known_equal(F.col("prev.text_hash"), F.col("text_hash"))
    same_kind = known_equal(F.col("prev.execution_type"), F.col("execution_type"))
    exact = F.col("sql_hash") == F.col("prev.sql_hash")
    adopted = F.col("prev.source_key").isNotNull() & ~registered & copied_logic & same_kind
    flagged = seen.withColumns({
        "has_current": F.col("prev").isNotNull(), "same_kind": same_kind, "is_copy": F.coalesce(registered, F.lit(False)), "copy_logic_matches": F.coalesce(copied_logic, F.lit(False)),
        "same_identity": F.coalesce(F.when(F.col("execution_type") == TEST, exact | known_equal(F.col("template_hash"), F.col("prev.template_hash"))).otherwise(identity_equal("prev") | adopted), F.lit(False)),
        "same_upstreams": known_equal(F.col("reads"), F.col("recorded_reads")), "context_changed": same_text & ~F.col("prev.root").eqNullSafe(F.col("root")),
        "binding_changed": F.coalesce(copies.binding_changed(same_text, F.split("reads", ","), F.split("recorded_reads", ","), F.col("root"), F.col("prev.root")), F.lit(False)),
        "own_target": own_target("prev"), "same_values": known_equal(F.col("values_hash"), F.col("prev.values_hash")) & F.coalesce(exact, F.lit(False)) & same_kind,
        "results_complete": selection.complete_test_results(F.col("prev")),
    })
    by_template = (F.col("family") == "snowflake") & F.col("compare_template") & known_equal(F.col("template_hash"), F.col("prev.template_hash"))
    whole = selection.qualifies(flagged.withColumn("evaluation_requested", F.lit(False)))
    flagged = written(flagged.withColumn("_whole", whole)).withColumn("qualified", F.col("_whole") & (by_template | ~(F.col("evaluation_requested") & F.col("volatile"))) & (~F.col("compare_template") | F.col("template_hash").isNull() | (F.coalesce("body_hash", F.lit("")) != "")))
    kinds = {
        "test": selection.select_test(flagged.filter(F.col("execution_type") == TEST)),
        "seed": select_seeds(flagged.filter(F.col("execution_type") == SEED)),
        "model": selection.select_model(flagged.filter(~F.col("execution_type").isin(TEST, SEED))),
    }
    return over_build_of_type(e, written(kinds["model"].unionByName(kinds["seed"]).unionByName(kinds["test"]).withColumn("base", F.col("prev"))))


def select_seeds(df: DataFrame) -> DataFrame:
    reason = (
        F.when(~F.col("has_current"), "first_build").when(~F.col("same_values"), "identity_mismatch").when(F.coalesce("values_hash", F.lit("")) == "", "failed_reuse_qualification")
        .when(F.col("own_target") == "missing", "own_target_missing").when(F.col("own_target") != "as_built", "own_target_changed_or_missing")
    )
    return df.withColumn("no_candidate", reason).withColumn("candidate", reason.isNull())


def of_targets(e: Evidence, subs: DataFrame) -> DataFrame:
    """The executions of the targets of ``subs``."""
    named = e.executions.withColumn("namespace", F.coalesce("namespace", F.lit("")))
    return named.join(subs.select(*SCOPE).distinct(), list(SCOPE), "left_semi")


def over_build_of_type(e: Evidence, selected: DataFrame, n: int = 50) -> DataFrame:
    """Nodes whose kind changed, judged against the target's latest build of their own kind; what speaks against that build is
    the reason. If nothing does, the change of kind is."""
    changed = selected.filter("no_candidate = 'execution_type_changed' AND NOT is_copy")
    keyed = history.target_history(of_targets(e, changed), n)
    own = changed.select(*SCOPE, "submission_id", "execution_type", "sql_hash", "template_hash", "namespace_hash")
    met = own.join(keyed.select(*SCOPE, "rank", F.struct(*e.executions.columns).alias("row")), list(SCOPE)).filter((F.col("row.execution_type") == F.col("execution_type")) & F.coalesce(identity_equal("row"), F.lit(False)))
    best = met.groupBy("submission_id").agg(F.min_by("row", "rank").alias("own_build"))
    out = selected.join(best, "submission_id", "left")
    against = F.when(~F.col("qualified"), "failed_reuse_qualification").when(own_target("own_build") == "modified", "own_target_modified").when(own_target("own_build") == "missing", "own_target_missing").when(own_target("own_build") == "ambiguous", "own_target_changed_or_missing")
    has = F.col("own_build").isNotNull() & against.isNotNull()
    return out.withColumns({"no_candidate": F.when(has, against).otherwise(F.col("no_candidate")), "base": F.when(has, F.col("own_build")).otherwise(F.col("base"))}).drop("own_build")


def upstream_rows(e: Evidence, asked: DataFrame, row: str = "base") -> DataFrame:
    """Verdicts on each upstream of ``asked`` against the recorded row ``row``, as :func:`freshness.upstream_verdicts` gives them.

    A copy that recorded no inputs reads what the submission reads, no later than the copy.
    """
    pairs = asked.select("submission_id", "target_key", F.col(f"{row}.id").alias("execution_id"), F.col(f"{row}.target_key").alias("own"), F.col(f"{row}.last_modified_epoch").alias("_epoch"), F.col(f"{row}.source_key").isNotNull().alias("_copy"))
    now = pairs.join(e.inputs, "submission_id").filter("name <> target_key")
    then = pairs.join(e.recorded, "execution_id").filter("name <> own")
    adopted = now.filter("_copy").join(then.select("submission_id").distinct(), "submission_id", "left_anti").withColumns({"epoch": F.least("epoch", "_epoch"), "producer": F.lit(None).cast("string")})
    cut = lambda df: df.select("submission_id", F.upper("name").alias("name"), "epoch", "producer")
    return freshness.upstream_verdicts(cut(now), cut(then).unionByName(cut(adopted)))


def judge(e: Evidence, asked: DataFrame, row: str = "base") -> DataFrame:
    """``asked`` with what :func:`freshness.judge_freshness` adds for the recorded row ``row``."""
    folded = freshness.fold_freshness(upstream_rows(e, asked, row))
    aged = asked.withColumns({"prev_epoch": F.col(f"{row}.last_modified_epoch"), "build_age_ms": F.col("now_ms") - build_time(row)})
    return freshness.judge_freshness(aged, folded)


def lookups(undecided: DataFrame) -> DataFrame:
    """The undecided submissions that may look for an equivalent, with ``own_candidate`` and ``copies_kind``.

    On databricks only plain requests may: full tables with exact freshness that allow one copy.
    """
    may = undecided.filter("(no_candidate IS NOT NULL AND no_candidate <> 'own_target_modified') OR (no_candidate IS NULL AND rebuild IN ('upstream_outdated', 'upstream_query_changed'))")
    may = may.withColumn("own_candidate", F.col("no_candidate").isNull()).filter((F.col("execution_type") != SEED) & (F.col("namespace") != ""))
    plain = (
        (F.col("execution_type") == FULL) & ~F.col("compare_template") & ~F.col("evaluation_requested") & ~F.col("ignore_external") & F.coalesce("allow_clones", F.lit(False))
        & F.coalesce(F.col("chain_limit") == 1, F.lit(False)) & (F.col("tolerance_ms") == 0) & (F.col("policy") == "any")
    )
    asked = selection.copy_lookup(may.withColumn("candidate", F.lit(False))).drop("candidate")
    return asked.filter((F.col("family") != "databricks") | plain).withColumn("copies_kind", F.col("execution_type") == FULL)


def equivalents(e: Evidence, asked: DataFrame, current: DataFrame) -> DataFrame:
    """Up to 16 equivalents of each submission with rank, copy_depth, equivalent_type, same_upstreams, reusable and verdict.

    A submission of a kind that is copied finds states of its own kind, another one finds all.
    Readings in other schemas count if the equivalent stands in that schema and read what is
    read there. On duckdb, sources more than two copies deep are left out; on databricks,
    all but builds of the same node with the very same inputs and no pending write are
    passed over.
    """
    kinds = F.array(F.concat_ws(":", "namespace_hash", F.col("execution_type").cast("string")), F.concat_ws(":", "namespace_hash", F.lit("any")))
    states = current.filter("namespace_hash IS NOT NULL").withColumn("namespace_hash", F.explode(kinds))
    kind = F.when(F.col("copies_kind"), F.col("execution_type").cast("string")).otherwise("any")
    known = e.readings.groupBy("submission_id").agg(F.collect_set("hash").alias("_read"))
    wanted = asked.join(known, "submission_id", "left").withColumn("hashes", F.transform(F.concat(F.array("namespace_hash"), F.coalesce("_read", F.array().cast("array<string>"))), lambda h: F.concat_ws(":", h, kind)))
    small = wanted.select("submission_id", *SCOPE, "hashes", F.col("namespace_hash").alias("own_hash"), "copies_kind", "own_candidate", "node_uid")
    found = history.copy_candidates(small, states, CANDIDATES).withColumn("met", F.element_at(F.split("namespace_hash", ":"), 1))
    facts_of = current.select(F.col("id").alias("source_id"), F.col("execution_type").alias("equivalent_type"), "table_type", (F.col("source_key").isNotNull()).alias("is_copy"), F.col("node_uid").alias("source_node"), F.col("confirmed_ms").alias("source_confirmed"))
    found = written(found.join(facts_of, "source_id"))
    sources = found.select(F.col("source_id").alias("execution_id"), F.col("source_key").alias("own")).distinct()
    read = reads_of(e.recorded, "execution_id", sources).select(F.col("execution_id").alias("source_id"), F.col("reads").alias("source_reads"))
    homes = e.readings.select("submission_id", F.col("hash").alias("met"), F.col("schema").alias("_schema"), F.col("reads").alias("home_reads"))
    placed = found.join(read, "source_id").withColumn("_schema", F.lower(F.get(name_parts(F.col("source_key")), 1))).join(homes, ["submission_id", "met", "_schema"], "left")
    at_home = F.col("home_reads").isNotNull() & (~F.col("copies_kind") | (F.col("home_reads") == F.col("source_reads")))
    admitted = placed.filter((F.col("met") == F.col("own_hash")) | at_home).drop("_schema", "home_reads")
    depths = history.copy_chain_depth(e.executions.filter("family = 'duckdb'"), MOST_COPIES + 1).select(F.col("id").alias("source_id"), F.col("depth").alias("copy_depth"))
    deep = admitted.join(depths, "source_id", "left").withColumn("copy_depth", F.coalesce("copy_depth", F.lit(0))).filter(F.col("copy_depth") <= MOST_COPIES)
    timed = deep.withColumn("build_ms", F.when(F.col("family") == "duckdb", F.col("source_confirmed")).otherwise(F.col("source_epoch")))
    judged = written(selection.judge_equivalents(written(timed), e.submissions, e.inputs, e.recorded).withColumn("exists", F.lit(True)))
    searched = selection.search_offers(judged)
    strict = exact_sources(e, judged.filter("family = 'databricks'"))
    out = searched.join(strict, ["submission_id", "source_id"], "left")
    passed = F.when(F.coalesce("exact", F.lit(False)) & F.col("reusable"), "choose").otherwise("next")
    return out.withColumn("verdict", F.when(F.col("family") == "databricks", passed).otherwise(F.col("verdict"))).drop("exact")


def exact_sources(e: Evidence, pairs: DataFrame) -> DataFrame:
    """(submission_id, source_id, exact): builds of the same node, with known epoch, the very same inputs and no pending write."""
    keys = ["submission_id", "source_id"]
    listed = lambda df: F.collect_list(F.struct("name", "epoch", "producer"))
    now = pairs.select(*keys, "target_key").join(e.inputs, "submission_id").filter("name <> target_key")
    then = pairs.select(*keys, "source_key").join(e.recorded.withColumnRenamed("execution_id", "source_id"), "source_id").filter("name <> source_key")
    met = pairs.join(now.groupBy(*keys).agg(listed(now).alias("now")), keys, "left").join(then.groupBy(*keys).agg(listed(then).alias("then")), keys, "left")
    busy = e.executions.filter("confirmed_ms IS NULL").select(*history.in_tenant(e.executions, TENANT), F.col("target_key").alias("source_key")).distinct()
    free = met.join(busy, [*TENANT, "source_key"], "left_anti")
    none = F.array().cast("array<struct<name:string,epoch:bigint,producer:string>>")
    same = copies.matching_inputs(F.coalesce("now", none), F.coalesce("then", none))
    return free.select(*keys, (same & ~F.col("is_copy") & (F.col("source_node") == F.col("node_uid")) & (F.col("source_epoch") > 0)).alias("exact"))


def chosen_equivalents(searched: DataFrame, asked: DataFrame) -> DataFrame:
    """One row for each submission whose search chose: source_id, source_key, equivalent_type, plan."""
    first = history.first_choice(searched).filter("chosen_rank IS NOT NULL").select("submission_id", F.col("chosen_rank").alias("rank"))
    limits = asked.select("submission_id", "allow_clones", F.when(F.col("family") == "duckdb", F.least(F.coalesce("chain_limit", F.lit(MOST_COPIES)), F.lit(MOST_COPIES))).when(F.col("chain_limit") == 0, 0).alias("chain_limit"))
    met = searched.join(first, ["submission_id", "rank"]).join(limits, "submission_id")
    ready = (F.coalesce(F.instr(F.upper("table_type"), "VIEW"), F.lit(0)) == 0) & ((F.col("family") != "duckdb") | F.col("source_epoch").isNotNull())
    return selection.copy_plan(met.withColumns({"kind_admits": F.col("copies_kind"), "source_available": ready})).select("submission_id", "source_id", "source_key", "equivalent_type", "plan", F.col("family").alias("_family"))


def seed_sources(undecided: DataFrame, current: DataFrame) -> DataFrame:
    """One row for each seed that may be copied from a load of the same object elsewhere: source_id, source_key, plan.

    Snowflake only, and only into an absent target or over a load of other values.
    """
    open_ = (F.col("n_own") == 0) | ((F.col("no_candidate") == "identity_mismatch") & F.coalesce(F.col("prev.execution_type") == SEED, F.lit(False)))
    asked = undecided.filter((F.col("execution_type") == SEED) & (F.col("family") == "snowflake") & (F.col("namespace") != "") & F.col("no_candidate").isNotNull() & open_)
    asked = asked.withColumn("logic_hash", F.col("sql_hash")).filter(F.coalesce("values_hash", F.lit("")) != "")
    best = selection.seed_choice(asked.select("submission_id", *SCOPE, "logic_hash", "values_hash"), current.withColumn("logic_hash", F.col("sql_hash")))
    types = current.select(F.col("id").alias("source_id"), "table_type")
    met = best.join(types, "source_id").join(asked.select("submission_id", "allow_clones", F.when(F.col("chain_limit") == 0, 0).alias("chain_limit"), F.lit("absent").alias("target_state")), "submission_id")
    ready = F.coalesce(F.instr(F.upper("table_type"), "VIEW"), F.lit(0)) == 0
    plan = F.when(F.col("outcome") == "ordinary", "unavailable").otherwise(F.col("outcome"))
    return copies.seed_copy(met.withColumn("source_available", ready)).select("submission_id", "source_id", "source_key", F.lit(SEED).alias("equivalent_type"), plan.alias("plan"), F.lit("snowflake").alias("_family"))


def older_builds(e: Evidence, rest: DataFrame, n: int = 50) -> DataFrame:
    """(submission_id, older_id): rebuilds one of whose target's earlier builds has their identity and would still be reusable."""
    asked = rest.filter((F.col("n_own") > 0) & F.col("reason").isin(*OLDER) & F.col("qualified") & (F.col("execution_type") != TEST))
    rows = history.target_history(of_targets(e, asked), n).filter("rank > 1")
    met = asked.select("submission_id", *SCOPE, "execution_type", "sql_hash", "template_hash", "namespace_hash", "values_hash").join(rows.select(*SCOPE, "rank", F.struct(*e.executions.columns).alias("row")), list(SCOPE))
    seed = (F.col("row.values_hash") == F.col("values_hash")) & (F.col("row.sql_hash") == F.col("sql_hash"))
    fits = (F.col("row.execution_type") == F.col("execution_type")) & F.col("row.source_key").isNull() & F.when(F.col("execution_type") == SEED, seed).otherwise(identity_equal("row"))
    first = met.filter(F.coalesce(fits, F.lit(False))).groupBy("submission_id").agg(F.min_by("row", "rank").alias("older"))
    judged = judge(e, written(asked.drop(*JUDGED).join(first, "submission_id")), "older")
    return judged.filter("rebuild IS NULL").select("submission_id", F.col("older.id").alias("older_id"))


#: What judging adds.
JUDGED = ("considered", "drifted", "any_unprovable", "any_producer_changed", "set_changed", "unchanged", "rebuild", "reuse", "drift_present", "upstreams_unchanged", "within_lag", "prev_epoch", "build_age_ms")


def selected(e: Evidence) -> tuple[DataFrame, DataFrame]:
    """Written tables: the submissions with the build under judgement and its freshness, and the current states."""
    current = written(history.current_state(e.executions).select(*e.executions.columns))
    chosen = written(select_builds(e, written(facts(e)), current))
    fit = judge(e, chosen.filter("no_candidate IS NULL"))
    rest = chosen.filter("no_candidate IS NOT NULL")
    return written(fit.unionByName(rest, allowMissingColumns=True)), current


def answer(e: Evidence) -> DataFrame:
    """submission_id, decision (skip, clone or build), reason, is_stale, matched_id, source_id, skip_code, clone_code.

    ``matched_id`` is the build that was reused or judged, ``source_id`` the execution that is
    copied or, with codes, would have been. A repeated submission_id is not supported.
    """
    return answer_settled(e, *selected(e))


def answer_settled(e: Evidence, settled: DataFrame, current: DataFrame) -> DataFrame:
    """:func:`answer` from what :func:`selected` has written."""
    skipped = settled.filter("no_candidate IS NULL AND rebuild IS NULL").select("submission_id", F.concat(F.lit("reused_"), "reuse").alias("reason"), F.col("drift_present").alias("is_stale"), F.col("base.id").alias("matched_id"))
    undecided = settled.filter("no_candidate IS NOT NULL OR rebuild IS NOT NULL")
    asked = written(lookups(undecided))
    searched = written(equivalents(e, asked, current))
    found = written(chosen_equivalents(searched, asked).unionByName(seed_sources(undecided, current)))
    with_copy = undecided.join(found, "submission_id", "left")
    cloned = with_copy.filter("plan = 'copy'").select("submission_id", F.lit("result_copy").alias("reason"), F.when(F.col("no_candidate").isNull(), F.col("base.id")).alias("matched_id"), "source_id", "execution_type", "equivalent_type")
    forbidden = F.col("plan").isin("chain_limit", "copies_disabled") & F.col("no_candidate").isNotNull() & (F.col("_family") != "databricks")
    rest = with_copy.filter("plan IS NULL OR plan <> 'copy'").withColumns({
        "copy_forbidden": F.coalesce(forbidden, F.lit(False)), "refused": F.coalesce((F.col("plan") == "refused") & (F.col("no_candidate").isNotNull() | (F.col("rebuild") == "upstream_outdated")), F.lit(False)),
        "reason": F.coalesce("no_candidate", "rebuild"),
    })
    older = written(older_builds(e, rest))
    named = rest.join(older, "submission_id", "left").withColumn("_reason", F.when(F.col("copy_forbidden") & F.col("older_id").isNull(), F.when(F.col("plan") == "chain_limit", "copy_chain_limit").otherwise("copy_disabled")).otherwise(F.col("reason")))
    shown = F.col("copy_forbidden") | F.col("refused")
    built = named.select(
        "submission_id", F.lit("build").alias("decision"), F.col("_reason").alias("reason"), F.lit(False).alias("is_stale"), F.coalesce("older_id", F.when(~F.col("_reason").isin("first_build"), F.col("base.id"))).alias("matched_id"),
        F.when(shown, F.col("source_id")).alias("source_id"), F.col("older_id").isNotNull().alias("older_matches"), (F.col("_reason") == "own_target_missing").alias("absent_target_matches"), shown.alias("equivalent"),
        "copy_forbidden", "execution_type", "equivalent_type",
    )
    no = F.lit(False)
    skips = skipped.join(settled.select("submission_id", "execution_type"), "submission_id").select("submission_id", F.lit("skip").alias("decision"), "reason", "is_stale", "matched_id", F.lit(None).cast("long").alias("source_id"), no.alias("older_matches"), no.alias("absent_target_matches"), no.alias("equivalent"), no.alias("copy_forbidden"), "execution_type", F.lit(None).cast("int").alias("equivalent_type"))
    clones = cloned.select("submission_id", F.lit("clone").alias("decision"), "reason", no.alias("is_stale"), "matched_id", "source_id", no.alias("older_matches"), no.alias("absent_target_matches"), no.alias("equivalent"), no.alias("copy_forbidden"), "execution_type", "equivalent_type")
    coded = selection.rejection_codes(skips.unionByName(clones).unionByName(built))
    return coded.select("submission_id", "decision", "reason", "is_stale", "matched_id", "source_id", "skip_code", "clone_code")


def published_copies(executions: DataFrame, confirms: DataFrame) -> DataFrame:
    """(id, outcome) of confirmations of pending copies: published, source_replaced, source_busy or too_early.

    ``confirms``: id, completed_epoch. A copy's proof is the source it was planned from
    (source_key, source_id, source_epoch); what stands there now comes from the log.
    """
    pending = executions.filter("confirmed_ms IS NULL AND source_key IS NOT NULL").join(confirms, "id")
    proof = F.struct("source_key", "source_id", "source_epoch")
    latest = history.current_state(executions).select(*SCOPE, F.col("id").alias("current_id"), F.col("last_modified_epoch").alias("current_epoch"))
    busy = executions.filter("confirmed_ms IS NULL").select(*history.in_tenant(executions, SCOPE)).distinct().withColumn("_busy", F.lit(True))
    at = pending.select("id", *history.in_tenant(pending, TENANT), F.col("source_key").alias("target_key"), "source_id", "source_epoch", "completed_epoch", proof.alias("submit"))
    met = at.join(latest, list(SCOPE), "left").join(busy, list(SCOPE), "left").withColumn("source_pending", F.coalesce("_busy", F.lit(False)))
    stands = F.coalesce((F.col("source_id") == F.col("current_id")) & (F.col("source_epoch") == F.col("current_epoch")), F.lit(False))
    outcome = F.when(~stands, "source_replaced").when(F.col("source_pending"), "source_busy").when(F.coalesce(selection.publish_copy(met), F.lit(False)), "published").otherwise("too_early")
    return met.select("id", outcome.alias("outcome"))
