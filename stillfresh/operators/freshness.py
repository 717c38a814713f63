"""Is a recorded build still fresh? Verdicts for whole tables of submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display

TEST = display.TEST


def genuine_inputs(inputs: DataFrame) -> DataFrame:
    """Inputs other than the node's own target; needs columns name and target."""
    return inputs.filter(F.col("target").isNull() | (F.col("name") != F.col("target")))


def own_target_status(inputs: DataFrame, submissions: DataFrame) -> DataFrame:
    """submission_id, status: what the current inputs say of the node's own target.

    ``submissions`` has built_epoch. as_built if it is listed once, unchanged; modified,
    missing (not listed) or ambiguous (listed more than once) else.
    """
    own = submissions.select("submission_id", "target", "built_epoch").join(inputs.select("submission_id", "name", "epoch"), "submission_id", "left")
    mine = F.col("name") == F.col("target")
    seen = own.groupBy("submission_id", "built_epoch").agg(F.count_if(mine).alias("n"), F.max(F.when(mine, F.col("epoch"))).alias("now"))
    status = (
        F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").when(F.coalesce(F.col("now") <= F.col("built_epoch"), F.lit(False)), "as_built").otherwise("modified")
    )
    return seen.select("submission_id", status.alias("status"))


def input_ambiguity(inputs: DataFrame, key: str) -> DataFrame:
    """Names that one submission or execution lists more than once."""
    return inputs.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def upstream_verdicts(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row for each submission and upstream name, from either side.

    ``current``: submission_id, name, epoch, producer; ``recorded``: the same of the build
    under judgement. Unknown epochs and names recorded twice can't prove freshness; a
    producer counts as changed only if both sides know theirs.
    """
    now = current.groupBy("submission_id", "name").agg(F.count(F.lit(1)).alias("n_now"), F.max("epoch").alias("epoch"), F.max("producer").alias("producer"))
    then = recorded.groupBy("submission_id", "name").agg(F.count(F.lit(1)).alias("n_then"), F.max("epoch").alias("recorded_epoch"), F.max("producer").alias("recorded_producer"))
    both = now.join(then, ["submission_id", "name"], "full_outer")
    unprovable = F.col("epoch").isNull() | F.col("recorded_epoch").isNull() | (F.col("n_then") > 1)
    return both.withColumns({
        "unprovable": unprovable,
        "drifted": F.when(unprovable, True).otherwise(F.col("epoch") > F.col("recorded_epoch")),
        "producer_changed": F.coalesce(F.col("producer") != F.col("recorded_producer"), F.lit(False)),
        "set_changed": F.col("n_now").isNull() | F.col("n_then").isNull() | (F.col("n_now") > 1),
    })


def fold_freshness(verdicts: DataFrame) -> DataFrame:
    """One row for each submission: counts and flags over its upstreams."""
    return verdicts.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("considered"), F.count_if("drifted").alias("drifted"), F.bool_or("unprovable").alias("any_unprovable"), F.bool_or("producer_changed").alias("any_producer_changed"),
        F.bool_or("set_changed").alias("set_changed"), F.bool_and(F.coalesce(F.col("epoch") == F.col("recorded_epoch"), F.lit(False))).alias("unchanged"),
    )


def within_lag(tolerance_ms: Column, age_ms: Column) -> Column:
    """Whether a build is younger than the tolerance; an unknown age never is."""
    return F.coalesce((tolerance_ms > 0) & (age_ms < tolerance_ms), F.lit(False))


def build_age_ms(now_ms: Column, epoch: Column, confirmed_ms: Column, ordinal: Column) -> Column:
    """Age of a build; where epochs are ordinals, since the confirmation's receipt."""
    return now_ms - F.when(ordinal, confirmed_ms).otherwise(epoch)


def judge_freshness(submissions: DataFrame, folded: DataFrame) -> DataFrame:
    """Adds ``rebuild`` (a reason or NULL), ``reuse`` and ``drift_present``.

    ``submissions``: submission_id, execution_type, policy (any/all), tolerance_ms,
    build_age_ms, prev_epoch. A changed dependency set, then a missing build epoch, then an
    unprovable upstream, then a changed producer rebuild; then the policy decides whether
    drift makes the node stale, and the tolerance whether a stale build may still be used.
    Data tests follow ANY.
    """
    s = submissions.join(folded, "submission_id", "left")
    n, d = F.coalesce("considered", F.lit(0)), F.coalesce("drifted", F.lit(0))
    test = F.col("execution_type") == TEST
    stale = F.when(n == 0, False).when(test | (F.col("policy") == "any"), d > 0).otherwise(d == n)
    lag = within_lag(F.col("tolerance_ms"), F.col("build_age_ms"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rebuild = (
        F.when(flag("set_changed"), "dependency_set_changed")
        .when((n > 0) & F.col("prev_epoch").isNull() & ~test, "no_build_anchor")
        .when(flag("any_unprovable"), "upstream_outdated")
        .when(flag("any_producer_changed"), "upstream_query_changed")
        .when(stale & ~lag, "upstream_outdated")
    )
    reuse = F.when(stale, "within_lag_tolerance").when(d > 0, "tolerated_stale").otherwise("fresh")
    out = s.withColumn("rebuild", rebuild)
    return out.withColumns({"reuse": F.when(F.col("rebuild").isNull(), reuse), "drift_present": d > 0, "upstreams_unchanged": (n == 0) | flag("unchanged"), "within_lag": lag})


def reusable(judged: DataFrame) -> DataFrame:
    """submission_id, reuse, build_age_ms: how fresh each build would be if it were reused; those that must be rebuilt are left out."""
    return judged.filter("rebuild IS NULL").select("submission_id", "reuse", "build_age_ms")


def decide(judged: DataFrame) -> DataFrame:
    """SKIP or BUILD for each submission; only a tolerated skip is stale.

    ``judged`` has has_prior (a build of the target is recorded) and identity_matches
    besides what :func:`judge_freshness` adds.
    """
    matched = F.col("has_prior") & F.col("identity_matches")
    skip = matched & F.col("rebuild").isNull()
    reason = F.when(~F.col("has_prior"), "first_build").when(~F.col("identity_matches"), "identity_mismatch").when(skip, F.concat(F.lit("reused_"), F.col("reuse"))).otherwise(F.col("rebuild"))
    kind = F.col("execution_type")
    text = F.when(skip, display.skip_description(kind, F.col("tolerance_ms"), F.col("upstreams_unchanged"), F.col("within_lag"))).otherwise(
        display.execute_description(kind, F.col("has_prior"), F.lit(False))
    )
    return judged.withColumns({"decision": F.when(skip, "skip").otherwise("build"), "is_stale": skip & F.col("drift_present"), "reason": reason, "description": text})


def dependency_set_changed(current: Column, recorded: Column) -> Column:
    """Whether two arrays of names differ as sets, or the current one has duplicates."""
    return (F.size(F.array_except(current, recorded)) > 0) | (F.size(F.array_except(recorded, current)) > 0) | (F.size(F.array_distinct(current)) != F.size(current))
