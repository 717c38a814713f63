"""Recorded submissions against the lag rule: each decision is recomputed from the calls before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display
from .history import last_known

MODELS = (1, 2, 3, 4, 5, 6, 7)


def builds_of(trace: DataFrame) -> DataFrame:
    """file, target, position, epoch, identity, submit: confirmed builds, ``submit`` being the position that asked.

    Only answers that ask for a build or a copy can be confirmed, each by its first confirmation.
    """
    asked = trace.filter(F.col("method").isin("submit", "values") & F.col("variant").isin("build", "clone") & F.col("target").isNotNull())
    asked = asked.groupBy("file", "request_id").agg(F.min_by(F.struct("position", "target", "identity"), "position").alias("s"))
    done = trace.filter("method = 'confirm'").join(asked, ["file", "request_id"]).filter(F.col("s.position") < F.col("position"))
    first = done.groupBy("file", "request_id").agg(F.min_by(F.struct("position", "epoch", F.col("s.target").alias("target"), F.col("s.identity").alias("identity"), F.col("s.position").alias("submit")), "position").alias("b"))
    return first.select("file", "b.*")


def latest_build(reads: DataFrame, builds: DataFrame) -> DataFrame:
    """Adds ``build``: the last build of the file's relation ``name`` confirmed before ``position``; ordered windows, no pairs."""
    made = builds.select("file", F.col("target").alias("name"), "position", F.struct("epoch", "identity", "submit").alias("_build"))
    both = reads.withColumn("_read", F.lit(True)).unionByName(made, allowMissingColumns=True)
    return last_known(both, ["file", "name"], ["position"], "_build").filter("_read").withColumnRenamed("last", "build").drop("_read", "_build")


def predictions(trace: DataFrame) -> DataFrame:
    """Submissions that the rule speaks about, with ``rule`` (variant, stale, description).

    ``trace``: file, position, method (submit, values, confirm), request_id, target, identity,
    execution_type, tables (array of name and epoch), tolerance_ms, policy (any, all),
    recorded_ms, epoch, variant, stale, description; positions are unique in a file, and names
    in a submission's tables. The rule speaks about models whose last build has their identity
    and an epoch, and whose own relation is listed with an epoch no later than it.
    """
    builds = builds_of(trace)
    submits = trace.filter("method = 'submit'")
    read = submits.select("file", "position", F.explode("tables").alias("t")).select("file", "position", "t.name", F.col("t.epoch").alias("read_epoch"))
    made = latest_build(read, builds).withColumn("producer", F.when(F.col("read_epoch") <= F.col("build.epoch"), F.col("build.identity")))
    reads = made.select("file", "position", "name", "read_epoch", "producer")

    models = submits.filter(F.col("execution_type").isin(*MODELS) & F.col("target").isNotNull()).withColumn("name", F.col("target"))
    judged = latest_build(models, builds).filter((F.col("build.identity") == F.col("identity")) & F.col("build.epoch").isNotNull())
    own = reads.select("file", "position", F.col("name").alias("target"), F.col("read_epoch").alias("own_epoch"))
    judged = judged.join(own, ["file", "position", "target"]).filter(F.col("own_epoch") <= F.col("build.epoch")).drop("own_epoch", "name")

    keys = judged.select("file", "position", "target", F.col("build.submit").alias("submit"))
    now = keys.join(reads, ["file", "position"]).filter("name <> target").select("file", "position", "name", F.col("read_epoch").alias("now"), F.col("producer").alias("maker"), F.lit(True).alias("has"))
    # the build's own reads; a seed's load lists none
    then = keys.join(reads.withColumnRenamed("position", "submit"), ["file", "submit"]).filter("name <> target").select("file", "position", "name", F.col("read_epoch").alias("then"), F.col("producer").alias("made"), F.lit(True).alias("had"))
    drift = F.coalesce(F.col("now") > F.col("then"), F.lit(True))
    folded = now.join(then, ["file", "position", "name"], "full_outer").groupBy("file", "position").agg(
        F.bool_or(F.col("has").isNull() | F.col("had").isNull()).alias("other_set"), F.bool_or(~F.col("maker").eqNullSafe(F.col("made"))).alias("flagged"),
        F.count_if(drift).alias("drifted"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("now").eqNullSafe(F.col("then"))).alias("unchanged"),
    )
    j = judged.join(folded, ["file", "position"], "left").fillna({"other_set": False, "flagged": False, "drifted": 0, "n": 0, "unchanged": True})
    within = (F.col("tolerance_ms") > 0) & (F.col("recorded_ms") - F.col("build.epoch") < F.col("tolerance_ms"))
    stale = (F.col("drifted") > 0) & ((F.col("policy") != "all") | (F.col("drifted") == F.col("n")))
    rebuild = F.col("other_set") | F.col("flagged") | (stale & ~within)
    text = display.skip_description(F.col("execution_type"), F.col("tolerance_ms"), F.col("unchanged"), within)
    rule = F.when(rebuild, verdict(F.lit("build"), F.lit(False), F.lit(None).cast("string"))).otherwise(verdict(F.lit("skip"), F.col("drifted") > 0, text))
    return j.select("file", "position", verdict(F.col("variant"), F.col("stale"), F.col("description")).alias("recorded"), rule.alias("rule"))


def verdict(variant: Column, stale: Column, description: Column) -> Column:
    return F.struct(variant.alias("variant"), stale.alias("stale"), description.alias("description"))


def score_trace(trace: DataFrame) -> DataFrame:
    """file, judged, agree: recomputed decisions, and those that equal the recorded ones; of a skip its staleness and text count too."""
    same = (F.col("recorded.variant") == F.col("rule.variant")) & ((F.col("rule.variant") != "skip") | F.col("recorded").eqNullSafe(F.col("rule")))
    return predictions(trace).groupBy("file").agg(F.count(F.lit(1)).alias("judged"), F.count_if(same).alias("agree"))
