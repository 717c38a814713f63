"""Which recorded build may be reused or copied, and the codes of a refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import SEED, SNAPSHOT, TEST, VIEW

INCREMENTAL = (2, 3, 4, 5, 6)
CUSTOM = 11


def complete_test_results(results: Column) -> Column:
    """Cached test results (failures, should_error, should_warn) with a finite number and both flags."""
    n = results["failures"]
    return n.isNotNull() & ~F.isnan(n.cast("double")) & (F.abs(n) < float("inf")) & results["should_error"].isNotNull() & results["should_warn"].isNotNull()


def qualifies(df: DataFrame) -> Column:
    """SQL is there, dependencies are complete, a compared template has a body, and volatile SQL isn't evaluated."""
    return (
        (F.coalesce(F.trim("sql"), F.lit("")) != "") & F.col("deps_complete") & (~F.col("compare_template") | (F.coalesce("body_hash", F.lit("")) != ""))
        & ~(F.col("evaluation_requested") & F.col("volatile"))
    )


def select_model(df: DataFrame) -> DataFrame:
    """Adds ``candidate`` and ``no_candidate``, the one reason when there is none.

    Columns: has_current, same_identity, same_kind, same_upstreams, is_copy, copy_logic_matches,
    context_changed, binding_changed, qualified, own_target (as_built, modified, missing,
    ambiguous). An adoptable copy has the submission's logic and kind.
    """
    adoptable = F.col("is_copy") & F.col("copy_logic_matches") & F.col("same_kind")
    strict = F.col("same_identity") & F.col("same_kind") & ~F.col("is_copy")
    matched = strict | adoptable
    kind_changed = ~F.col("same_kind") & ((F.col("same_identity") & F.col("same_upstreams")) | (F.col("is_copy") & F.col("copy_logic_matches")))
    reason = (
        F.when(~F.col("has_current"), "first_build")
        .when(~matched & kind_changed, "execution_type_changed")
        .when(~matched & F.col("is_copy"), "copy_logic_mismatch")
        .when(~matched & F.col("same_identity") & ~F.col("same_kind"), "upstream_names_changed")
        .when(~matched & F.col("context_changed"), "resolution_context_changed")
        .when(~matched & F.col("binding_changed"), "input_binding_changed")
        .when(~matched, "identity_mismatch")
        .when(~F.col("qualified"), "failed_reuse_qualification")
        .when(F.col("own_target") == "modified", "own_target_modified")
        .when(F.col("own_target") == "missing", "own_target_missing")
        .when(F.col("own_target") == "ambiguous", "own_target_changed_or_missing")
    )
    return df.withColumn("no_candidate", reason).withColumn("candidate", F.col("no_candidate").isNull())


def select_test(df: DataFrame) -> DataFrame:
    """A data test reuses its latest outcome if it is the same test, qualifies, and has complete results."""
    reason = F.when(~F.col("has_current"), "first_build").when(~F.col("same_identity"), "identity_mismatch").when(~F.col("qualified"), "failed_reuse_qualification").when(~F.col("results_complete"), "incomplete_cached_test_results")
    return df.withColumn("no_candidate", reason).withColumn("candidate", reason.isNull())


def select_seed(df: DataFrame) -> DataFrame:
    """A seed is a no-op if its target was last loaded with the same identity and values, and stands as built."""
    reason = F.when(~F.col("has_current"), "first_build").when(~F.col("same_identity") | ~F.col("same_values"), "identity_mismatch").when(F.col("own_target") != "as_built", "own_target_modified")
    return df.withColumn("no_candidate", reason).withColumn("candidate", reason.isNull())


def rejection_codes(df: DataFrame) -> DataFrame:
    """Adds ``skip_code`` and ``clone_code``.

    Columns: decision, reason, older_matches (an overwritten build would still serve),
    absent_target_matches, equivalent (an equivalent exists elsewhere), copy_forbidden,
    execution_type, equivalent_type. The first row that applies gives both codes.
    """
    kind = F.col("execution_type")
    refused = F.col("equivalent") & (kind.isin(SNAPSHOT, VIEW, CUSTOM, *INCREMENTAL))
    rows = (
        (F.col("decision") == "skip", None, None),
        (F.col("decision") == "clone", 1, None),
        (F.col("older_matches"), 8, 7),
        (F.col("reason") == "execution_type_changed", 2, 2),
        (F.col("absent_target_matches"), 4, 7),
        (F.col("equivalent") & F.col("copy_forbidden"), 1, 10),
        (refused & ~kind.isin(*INCREMENTAL) & (F.col("equivalent_type") == kind), 1, 3),
        (refused & (F.col("equivalent_type") == kind), 1, 6),
        (refused, 1, 2),
        (F.lit(True), 6, 6),
    )
    chain = lambda i: F.coalesce(*[F.when(c[0], F.lit(-1 if c[i] is None else c[i])) for c in rows])
    return df.withColumns({"skip_code": F.nullif(chain(1), F.lit(-1)), "clone_code": F.nullif(chain(2), F.lit(-1))})


def copy_lookup(df: DataFrame) -> DataFrame:
    """Submissions that may look for an equivalent to copy: no candidate, not a test, namespace and hash known, no volatile SQL under evaluation."""
    return df.filter(~F.col("candidate") & (F.col("execution_type") != TEST) & F.col("namespace").isNotNull() & F.col("namespace_hash").isNotNull() & ~(F.col("evaluation_requested") & F.col("volatile")))


def admits(own_hash: Column, rehomed: Column, candidate_hash: Column, candidate_schema: Column, candidate_reads: Column) -> Column:
    """Whether a candidate is an equivalent: the submission's own logic, or its logic read in
    the candidate's schema with the same upstream reads. ``rehomed``: array of (hash, schema, reads)."""
    met = F.exists(rehomed, lambda r: (r["hash"] == candidate_hash) & (r["schema"] == candidate_schema) & (r["reads"] == candidate_reads))
    return F.coalesce(own_hash == candidate_hash, F.lit(False)) | F.coalesce(met, F.lit(False))


def canonical_reads(names: Column) -> Column:
    """Names as upper-case part lists, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(names, F.upper)))


def search_offers(df: DataFrame) -> DataFrame:
    """Adds ``verdict`` (choose, next, stop) to candidates (submission_id, rank, same_upstreams, reusable, exists, own_candidate).

    A same-upstream candidate is judged like a reuse candidate; if it is stale the next one is
    tried. One of another environment is taken unjudged, but only before any was found stale
    and only for a target without a candidate of its own; all else ends the search.
    """
    before = Window.partitionBy("submission_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    stale = F.coalesce(F.max((F.col("same_upstreams") & F.col("exists") & ~F.col("reusable")).cast("int")).over(before), F.lit(0)) > 0
    verdict = F.when(~F.col("exists"), "stop").when(F.col("same_upstreams"), F.when(F.col("reusable"), "choose").otherwise("next")).when(~F.col("own_candidate") & ~stale, "choose").otherwise("stop")
    return df.withColumn("verdict", verdict)


def judge_equivalents(candidates: DataFrame, submissions: DataFrame, current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Adds ``same_upstreams`` and ``reusable`` to candidates (submission_id, source_id, source_key, source_epoch, is_copy).

    ``submissions``: submission_id, target_key, execution_type, policy, tolerance_ms, now_ms;
    ``current``: submission_id, name, epoch, producer; ``recorded``: execution_id and the
    same. A candidate reads the same upstreams if its names, its own target left out, are the
    submission's; it is then judged as if it were the reuse candidate. A copy that recorded
    nothing reads what the submission reads, no later than the copy. A column build_ms, where
    there is one, is the time from which the age counts instead of the epoch.
    """
    from . import freshness

    subs = submissions.select("submission_id", "target_key", "execution_type", "policy", "tolerance_ms", "now_ms")
    built = F.col("build_ms" if "build_ms" in candidates.columns else "source_epoch").alias("build_ms")
    pairs = candidates.select("submission_id", "source_id", "source_key", "source_epoch", "is_copy", built).withColumn("pair", F.concat_ws(":", "submission_id", "source_id")).join(subs, "submission_id")
    each = lambda df: df.select("pair", F.upper("name").alias("name"), "epoch", "producer")
    now = pairs.join(current, "submission_id").filter("name <> target_key")
    then = pairs.join(recorded.withColumnRenamed("execution_id", "source_id"), "source_id").filter("name <> source_key")
    adopted = now.filter("is_copy").join(then.select("pair").distinct(), "pair", "left_anti").withColumns({"epoch": F.least("epoch", "source_epoch"), "producer": F.lit(None).cast("string")})
    named = lambda df: each(df).withColumnRenamed("pair", "submission_id")
    verdicts = freshness.upstream_verdicts(named(now), named(then).unionByName(named(adopted)))
    folded = freshness.fold_freshness(verdicts).join(verdicts.groupBy("submission_id").agg(F.bool_or(F.col("n_now").isNull() | F.col("n_then").isNull()).alias("other")), "submission_id")
    asked = pairs.select(F.col("pair").alias("submission_id"), "execution_type", "policy", "tolerance_ms", (F.col("now_ms") - F.col("build_ms")).alias("build_age_ms"), F.col("source_epoch").alias("prev_epoch"))
    judged = freshness.judge_freshness(asked, folded).select(F.col("submission_id").alias("_pair"), (~F.coalesce("other", F.lit(False))).alias("same_upstreams"), F.col("rebuild").isNull().alias("reusable"))
    return candidates.withColumn("_pair", F.concat_ws(":", "submission_id", "source_id")).join(judged, "_pair").drop("_pair")


def copy_plan(df: DataFrame) -> DataFrame:
    """Adds ``plan``: refused, copies_disabled, chain_limit, unavailable or copy; the first that applies."""
    limit = F.col("chain_limit")
    plan = (
        F.when(~F.col("kind_admits"), "refused").when(~F.coalesce("allow_clones", F.lit(True)), "copies_disabled").when((limit == 0) | (F.col("copy_depth") >= limit), "chain_limit")
        .when(~F.col("source_available"), "unavailable").otherwise("copy")
    )
    return df.withColumn("plan", plan)


def adopt_inputs(recorded: Column, current: Column, copy_epoch: Column) -> Column:
    """A copy without inputs takes the submission's (name, epoch), no later than the copy; producers stay unrecorded."""
    taken = F.transform(current, lambda x: F.struct(x["name"].alias("name"), F.least(x["epoch"], copy_epoch).alias("epoch")))
    return F.when(F.size(recorded) == 0, taken).otherwise(recorded)


def drop_audit_inputs(tables: Column, own: Column, schema: Column, sql: Column, stores_failures: Column) -> Column:
    """Tables of a test that stores failures, without its own result relation: the one named so,
    else the only one of its schema that the SQL doesn't mention; several such stay."""
    from ..functions.names import mentions, name_parts

    other = F.filter(tables, lambda x: ~(F.element_at(name_parts(x), -1) == own))
    unnamed = F.filter(tables, lambda x: (F.get(name_parts(x), 1) == schema) & ~mentions(sql, F.element_at(name_parts(x), -1)))
    by_elimination = F.when(F.size(unnamed) == 1, F.filter(tables, lambda x: ~F.array_contains(unnamed, x))).otherwise(tables)
    return F.when(~stores_failures, tables).when(F.size(other) < F.size(tables), other).otherwise(by_elimination)


def publish_copy(df: DataFrame) -> Column:
    """Whether a copy may be confirmed: its source stands at the recorded id and epoch, has no pending write, and the copy ended no earlier."""
    return (F.col("source_id") == F.col("current_id")) & (F.col("source_epoch") == F.col("current_epoch")) & ~F.col("source_pending") & (F.col("completed_epoch") >= F.col("source_epoch"))


def incremental_supported(df: DataFrame) -> Column:
    """Incremental nodes whose rebuilds are understood: delete and insert on one plain key, failing on schema change, no predicates."""
    return (
        (F.col("strategy") == "delete+insert") & F.coalesce(F.col("unique_key").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False)) & (F.col("on_schema_change") == "fail") & F.coalesce(F.size("predicates") <= 0, F.lit(True))
    )


def copy_config_ok(config_keys: Column, allowed: Column) -> Column:
    """Whether all set keys are allowed; those of the client (run_cache_*) always are."""
    return F.size(F.filter(F.array_except(config_keys, allowed), lambda k: ~k.startswith("run_cache_"))) == 0


def run_completed(results: DataFrame) -> DataFrame:
    """run_id, completed: every item ended well, or is a test that failed."""
    ok = F.col("status").isin("success", "pass", "warn", "skipped") | ((F.col("resource") == "test") & (F.col("status") == "fail"))
    return results.groupBy("run_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("completed"))


def seed_candidates(submissions: DataFrame, current: DataFrame) -> DataFrame:
    """Loads of the same seed, values included, on other targets of the same org, family and namespace."""
    from .history import TENANT, in_tenant

    other = current.filter(F.col("execution_type") == SEED).select(*in_tenant(current, TENANT), "logic_hash", "values_hash", F.col("target_key").alias("source_key"), F.col("id").alias("source_id"), F.col("last_modified_epoch").alias("source_epoch"))
    asked = submissions.withColumn("namespace", F.coalesce("namespace", F.lit("")))
    return asked.join(other, [*TENANT, "logic_hash", "values_hash"]).filter(F.col("source_key") != F.col("target_key"))


def seed_choice(submissions: DataFrame, current: DataFrame) -> DataFrame:
    """submission_id, source_key, source_id: the newest load of the same seed, values included, in another schema.

    Loads meet by database and object too, and only the two best of such a key are joined, as
    one of them at most is the submission's own target; so no seed's loads are paired with
    all submissions of it. Ties go to smaller ids.
    """
    from ..functions.names import name_parts
    from .history import TENANT, in_tenant

    def placed(df: DataFrame) -> DataFrame:
        parts = name_parts(F.lower("target_key"))
        return df.withColumn("_parts", parts).filter(F.size("_parts") == 3).withColumns({"_database": F.col("_parts")[0], "_schema": F.col("_parts")[1], "_object": F.col("_parts")[2]}).drop("_parts")

    keys = [*TENANT, "logic_hash", "values_hash", "_database", "_object"]
    loads = placed(current.filter((F.col("execution_type") == SEED) & F.col("last_modified_epoch").isNotNull()).select(*in_tenant(current, TENANT), "logic_hash", "values_hash", "target_key", "id", "last_modified_epoch"))
    order = Window.partitionBy(*keys).orderBy(F.desc("last_modified_epoch"), "id")
    best = loads.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= 2).select(*keys, "_n", F.col("_schema").alias("_other"), F.col("target_key").alias("source_key"), F.col("id").alias("source_id"))
    asked = placed(submissions.withColumn("namespace", F.coalesce("namespace", F.lit("")))).select("submission_id", *keys, "_schema")
    met = asked.join(best, keys).filter(F.col("_other") != F.col("_schema"))
    return met.groupBy("submission_id").agg(F.min_by(F.struct("source_key", "source_id"), "_n").alias("s")).select("submission_id", "s.source_key", "s.source_id")


def seed_source(candidates: DataFrame, same_object: Column) -> DataFrame:
    """The newest candidate of each submission that names the same object in another schema; ties go to smaller keys.

    No paging: what isn't admitted is left out before the best one is picked.
    """
    best = F.max_by(F.struct("source_key", "source_id"), F.struct("source_epoch", (-F.col("source_id")).alias("i")))
    return candidates.filter(same_object & F.col("source_epoch").isNotNull()).groupBy("submission_id").agg(best.alias("s")).select("submission_id", "s.source_key", "s.source_id")
