"""Diagnostics: builds elsewhere that explain a BUILD's codes and reason, and never change the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import SNAPSHOT, VIEW
from .history import SCOPE, TENANT, ranked

FULL, APPEND, MERGE, MICROBATCH = 1, 2, 3, 5
# Numbers of rejection codes.
OTHER_TARGET, NOT_FULL, TARGET_ABSENT, NO_MATCH, SAME_TARGET, OTHER_QUERY, TOO_OLD, CHAIN_LIMIT = 1, 3, 4, 6, 7, 8, 9, 10
EVERYWHERE = ("org_id", "family")
FIRST, UNKNOWN, OUTDATED = "first_build", "existing_target_without_history", "upstream_outdated"


def elsewhere(df: DataFrame, builds: DataFrame, keys: tuple[str, ...], flag: str) -> DataFrame:
    """Adds ``flag``: a build with the same keys has another target.

    Builds are folded to the least and greatest target of each key, so a key that many builds
    share is one row of the join.
    """
    ends = builds.groupBy(*keys).agg(F.min("target_key").alias("_lo"), F.max("target_key").alias("_hi"))
    other = (F.col("_lo") != F.col("target_key")) | (F.col("_hi") != F.col("target_key"))
    return df.join(ends, list(keys), "left").withColumn(flag, F.coalesce(other, F.lit(False))).drop("_lo", "_hi")


def present(df: DataFrame, builds: DataFrame, keys: tuple[str, ...], flag: str) -> DataFrame:
    """Adds ``flag``: a build with the same keys exists."""
    return df.join(builds.select(*keys).distinct().withColumn("_is", F.lit(True)), list(keys), "left").withColumn(flag, F.coalesce("_is", F.lit(False))).drop("_is")


def evidence(decided: DataFrame, executions: DataFrame) -> DataFrame:
    """Adds what history has beside the decision's own scope, a boolean a question.

    ``older_here``: an older build without sources of the same logic on the target, in any
    namespace. ``other_now``, ``other_ever``: such a build is, or once was, another target's
    state; without a namespace all are searched. ``absent_scope``: the target was built with
    another query outside all namespaces. ``peer``: a snapshot of the same logic is another
    target's state. ``equivalent``: so is a build of the same namespace identity.
    """
    rows = ranked(executions)
    sourceless, now = rows.filter("sourceless"), rows.filter("rank = 1")
    of = (*EVERYWHERE, "logic_hash")
    out = decided.withColumn("namespace", F.coalesce("namespace", F.lit("")))
    out = present(out, sourceless.filter("rank > 1"), (*of, "target_key"), "older_here")
    for name, builds in (("other_now", sourceless.filter("rank = 1")), ("other_ever", sourceless)):
        out = elsewhere(elsewhere(out, builds, of, "_any"), builds, (*of, "namespace"), "_here")
        out = out.withColumn(name, F.when(F.col("namespace") == "", F.col("_any")).otherwise(F.col("_here"))).drop("_any", "_here")
    outside = rows.filter("namespace = '' AND logic_hash IS NOT NULL").groupBy(*EVERYWHERE, "target_key").agg(F.min("logic_hash").alias("_lo"), F.max("logic_hash").alias("_hi"))
    changed = (F.col("_lo") != F.col("logic_hash")) | (F.col("_hi") != F.col("logic_hash"))
    out = out.join(outside, [*EVERYWHERE, "target_key"], "left").withColumn("absent_scope", F.coalesce(changed, F.lit(False))).drop("_lo", "_hi")
    out = elsewhere(out, now.filter(F.col("execution_type") == SNAPSHOT), (*TENANT, "logic_hash"), "peer")
    return elsewhere(out, now, (*TENANT, "namespace_hash"), "equivalent")


def diagnose(decided: DataFrame, executions: DataFrame) -> DataFrame:
    """``decided`` with ``reason``, ``skip_code`` and ``clone_code`` as the diagnostics leave them.

    ``decided``: org_id, family, namespace, target_key, logic_hash, namespace_hash, execution_type, decision,
    reason, skip_code, clone_code, has_candidate, target_absent, and ``permitted``, the names of
    the diagnostics that the warehouse and the request allow. Only a BUILD changes. They apply
    in the order of the code below, each to what the one before left; a full table that has its
    query elsewhere takes none of the later ones. NULL hashes find nothing.
    """
    df = evidence(decided, executions).withColumn("_on", F.col("decision") == "build")
    free = ~F.col("has_candidate")

    def applies(name: str, found: Column, *reasons: str) -> Column:
        asked = F.col("_on") & F.array_contains("permitted", name) & found
        return F.coalesce(asked & F.col("reason").isin(*reasons) if reasons else asked, F.lit(False))

    def put(df: DataFrame, when: Column, skip=None, clone=None, reason=None) -> DataFrame:
        df = df.withColumn("_do", when)
        change = {"skip_code": skip, "clone_code": clone, "reason": reason}
        return df.withColumns({c: F.when(F.col("_do"), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in change.items() if v is not None}).drop("_do")

    absent, kind, reason = F.col("target_absent"), F.col("execution_type"), F.col("reason")
    outside = F.when(reason == UNKNOWN, "query_observed_outside_scope").otherwise(reason)
    missing = "no_reuse_candidate.own_target_missing"
    df = put(
        df, applies("target_history", free & F.col("older_here"), FIRST, UNKNOWN, "no_reuse_candidate.identity_mismatch", missing),
        F.when(absent, TARGET_ABSENT).otherwise(OTHER_QUERY), SAME_TARGET, F.when(absent, missing).otherwise(outside),
    )
    df = df.withColumn("_found", applies("other_target", free & F.col("other_now"), FIRST, UNKNOWN))
    df = put(df, F.col("_found"), OTHER_TARGET, F.when(kind == VIEW, NOT_FULL).otherwise(CHAIN_LIMIT), F.when(kind == FULL, "existing_target_copy_disabled_diagnostic").otherwise(outside))
    df = df.withColumn("_on", F.col("_on") & ~(F.col("_found") & (kind == FULL))).drop("_found")
    df = put(df, applies("absent_target", free & F.col("other_ever"), FIRST), OTHER_TARGET, TOO_OLD)
    df = put(df, applies("absent_scope", free & F.col("absent_scope"), UNKNOWN), reason="query_changed_outside_scope")
    df = put(df, applies("snapshot_peer", F.col("peer"), FIRST, OUTDATED), OTHER_TARGET, NOT_FULL)
    df = put(df, applies("submit_copy", F.col("equivalent") & (reason != "no_reuse_candidate.own_target_modified")), OTHER_TARGET, NO_MATCH)
    merge = kind == MERGE
    df = put(df, applies("direct_copy", F.col("equivalent"), OUTDATED), OTHER_TARGET, F.when(merge, CHAIN_LIMIT).otherwise(NOT_FULL), F.when(merge, "copy_chain_limit").otherwise(reason))
    return df.drop("_on", "older_here", "other_now", "other_ever", "absent_scope", "peer", "equivalent")


def kind_runs(executions: DataFrame) -> DataFrame:
    """The scope, since_id, run_length: of each target's history the latest run of builds of one kind, and the build it began with."""
    of = Window.partitionBy(*SCOPE).orderBy("rank")
    rows = ranked(executions).withColumn("_other", ~F.col("execution_type").eqNullSafe(F.first("execution_type").over(of)))
    past = F.max(F.col("_other").cast("int")).over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_past", past).filter("_past = 0").groupBy(*SCOPE).agg(F.max_by("id", "rank").alias("since_id"), F.count(F.lit(1)).alias("run_length"))


def exact_request() -> Column:
    """Requests on databricks that want exact freshness by rendered SQL."""
    return (F.col("family") == "databricks") & (F.col("tolerance_ms") == 0) & (F.col("policy") == "any") & ~F.col("compare_template")


def plain_reads(inputs: DataFrame, own: DataFrame, key: str, known: Column) -> DataFrame:
    """(key, n, plain) of ``own`` (key, own): how many inputs there are besides the own target, and whether all are plain sources."""
    met = inputs.join(own, key).filter("name <> own")
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce((F.col("producer") == "none") & known, F.lit(False))).alias("plain"))


def transitions(settled: DataFrame, answered: DataFrame, verdicts: DataFrame, inputs: DataFrame, recorded: DataFrame, executions: DataFrame) -> DataFrame:
    """(submission_id, latest_id, since_id, run_length, drifted): rebuilds that only a change between append and merge forced.

    They are shown against the target's latest build: it stands as built, all its upstreams
    are plain sources whose epochs both sides know, and ``drifted`` says whether one has changed
    since. ``since_id`` is the first build of that kind's run. ``settled`` and ``answered`` are from
    :mod:`answers`, ``verdicts`` of each upstream against the latest build.
    """
    turned = ((F.col("execution_type") == APPEND) & (F.col("prev.execution_type") == MERGE)) | ((F.col("execution_type") == MERGE) & (F.col("prev.execution_type") == APPEND))
    stands = F.col("prev.source_key").isNull() & (F.col("n_own") > 0) & (F.col("own_epoch") > 0) & (F.col("own_epoch") == F.col("prev.last_modified_epoch"))
    asked = settled.filter(exact_request() & turned & stands & F.col("same_identity") & F.col("same_upstreams")).join(answered.filter("decision = 'build' AND reason IN ('execution_type_changed', 'own_target_modified')").select("submission_id"), "submission_id")
    own = asked.select("submission_id", F.col("target_key").alias("own"))
    now = plain_reads(inputs, own, "submission_id", F.col("epoch") > 0).filter("plain").select("submission_id")
    then = plain_reads(recorded, asked.select(F.col("prev.id").alias("execution_id"), F.col("prev.target_key").alias("own")).distinct(), "execution_id", F.lit(True)).filter("plain").select(F.col("execution_id").alias("latest_id"))
    folded = verdicts.groupBy("submission_id").agg(F.bool_or("unprovable").alias("_unknown"), F.bool_and(F.coalesce((F.col("epoch") > 0) & (F.col("recorded_epoch") > 0), F.lit(False))).alias("_known"), F.bool_or("drifted").alias("drifted"))
    met = asked.select("submission_id", *SCOPE, F.col("prev.id").alias("latest_id")).join(now, "submission_id").join(then, "latest_id").join(folded.filter("_known AND NOT _unknown"), "submission_id").join(kind_runs(executions), list(SCOPE))
    return met.select("submission_id", "latest_id", "since_id", "run_length", "drifted")


def partial_targets(settled: DataFrame, answered: DataFrame, inputs: DataFrame, deps: DataFrame) -> DataFrame:
    """(submission_id, reason): first builds of microbatch nodes whose table is there all the same, left by a batch that failed.

    Their reason says so, and nothing of the partial table is reused.
    """
    own = settled.select("submission_id", F.col("target_key").alias("own"))
    reads = plain_reads(inputs, own, "submission_id", F.col("epoch") > 0).filter("plain AND n = 1").select("submission_id")
    first = answered.filter("decision = 'build' AND reason = 'first_build'").select("submission_id")
    asked = settled.filter(exact_request() & (F.col("execution_type") == MICROBATCH) & (F.col("namespace") != "") & (F.col("n_own") == 1) & (F.col("own_epoch") > 0))
    return asked.join(first, "submission_id").join(reads, "submission_id").join(deps.select("submission_id").distinct(), "submission_id", "left_anti").select("submission_id", F.lit(UNKNOWN).alias("reason"))
