"""Recorded calls: correlation, comparison and causal audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decision_variant(response: Column) -> Column:
    """The first key of a response's inner object, from its JSON."""
    return F.get(F.json_object_keys(F.get_json_object(response, "$.response")), F.lit(0))


def trace_by_node(trace: DataFrame) -> DataFrame:
    """Each node's calls (position, method), in order."""
    return trace.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("position", "method"))).alias("calls"))


def confirmed_targets(trace: DataFrame, before: int | None = None) -> DataFrame:
    """target, epoch: the last confirmation of each target whose submit came before it.

    ``trace``: position, method, request_id, target, epoch, ok. Only the first submit of a
    request counts, and only calls before position ``before``.
    """
    seen = trace if before is None else trace.filter(F.col("position") < before)
    submits = seen.filter(F.col("method") != "confirm").filter("target IS NOT NULL").groupBy("request_id").agg(F.min_by(F.struct("position", "target"), "position").alias("s"))
    pairs = seen.filter((F.col("method") == "confirm") & F.col("ok")).join(submits, "request_id").filter(F.col("s.position") < F.col("position"))
    return pairs.groupBy(F.col("s.target").alias("target")).agg(F.max_by("epoch", "position").alias("epoch"))


def audit_suppression(trace: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds ``proven`` to claims (position, equivalent): the equivalent was confirmed before the claim."""
    submits = trace.filter((F.col("method") != "confirm") & F.col("target").isNotNull()).groupBy("request_id").agg(F.min_by(F.struct("position", "target"), "position").alias("s"))
    done = trace.filter((F.col("method") == "confirm") & F.col("ok")).join(submits, "request_id").filter(F.col("s.position") < F.col("position"))
    first = done.groupBy(F.col("s.target").alias("equivalent")).agg(F.min("position").alias("confirmed_at"))
    return claims.join(first, "equivalent", "left").withColumn("proven", F.coalesce(F.col("confirmed_at") < F.col("position"), F.lit(False))).drop("confirmed_at")


def replay_compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """fixture, entry, outcome: same, different, or missing on a side."""
    e, a = expected.select("fixture", "entry", F.col("response").alias("e")), actual.select("fixture", "entry", F.col("response").alias("a"))
    outcome = F.when(F.col("e").isNull(), "unexpected").when(F.col("a").isNull(), "missing").when(F.col("e") == F.col("a"), "same").otherwise("different")
    return e.join(a, ["fixture", "entry"], "full_outer").select("fixture", "entry", outcome.alias("outcome"))


def correlate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The actual replay with the expected one's request ids.

    Both: fixture, entry, minted (the id a response gave, or NULL), refers (the id a request
    names, or NULL), response. Ids of the same fixture and entry are the same call's; an id
    that no entry gave stays as it is.
    """
    ids = lambda d, name: d.filter("minted IS NOT NULL").select("fixture", "entry", F.col("minted").alias(name))
    same = ids(actual, "_a").join(ids(expected, "_e"), ["fixture", "entry"]).groupBy("fixture", "_a").agg(F.min_by("_e", "entry").alias("_e"))
    out = actual
    for column in ("minted", "refers"):
        out = out.join(same.withColumnRenamed("_a", column), ["fixture", column], "left").withColumn(column, F.coalesce("_e", column)).drop("_e")
    return out.select(*actual.columns)


def score_rule(trace: DataFrame) -> DataFrame:
    """file, decidable, mismatches of recomputed decisions (expected, actual)."""
    known = F.col("expected").isNotNull() & F.col("actual").isNotNull()
    return trace.groupBy("file").agg(F.count_if(known).alias("decidable"), F.count_if(known & (F.col("expected") != F.col("actual"))).alias("mismatches"))
