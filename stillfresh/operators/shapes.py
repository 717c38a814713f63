"""Shapes of explanations: which sections a decision's tree has, from tables that are joined to decisions.

A tree is rows (submission_id, path, text, marker, badge); sorting by path gives its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import SEED, SNAPSHOT, TEST, VIEW, humanize_ms, node_noun

BUILT_KINDS = (1, 2, 3, 4, 5, 6, 7, 11)
CHANGING_KINDS = (1, 2, 3, 4, 5, 6, 7)
# Shapes by group, class, reason and kinds (none: all of the group), and the facts that must hold (with !: must
# not). They must match the service's; the first row that applies counts, and what no row names has no tree.
SHAPES = (
    ("seed", "skip", "reused_fresh", (), (), "seed_unchanged"),
    ("seed", "build", "first_build", (), (), "first_build"),
    ("seed", "build", "own_target_missing", (), (), "first_build"),
    ("seed", "build", "identity_mismatch", (), ("older",), "seed_unchanged"),
    ("seed", "build", "identity_mismatch", (), (), "seed_changed"),
    ("seed", "clone", "result_copy", (), ("over",), "seed_copy_over"),
    ("seed", "clone", "result_copy", (), (), "seed_copy"),
    ("seed", "build", "copy_disabled", (), ("equivalent", "over"), "copy_disabled_over"),
    ("seed", "build", "copy_disabled", (), ("equivalent",), "copy_disabled"),
    ("test", "skip", "reused_fresh", (), (), "skip"),
    ("test", "build", "existing_target_without_history", (), ("!upstreams",), "data_test_existing_target_without_history"),
    ("test", "build", "first_build", (), (), "data_test_execute"),
    ("test", "build", "identity_mismatch", (), (), "data_test_execute"),
    ("test", "build", "failed_reuse_qualification", (), ("rendered",), "data_test_execute"),
    ("test", "build", "upstream_outdated", (), ("upstreams",), "data_test_execute"),
    ("test", "build", "upstream_query_changed", (), ("upstreams",), "data_test_execute"),
    ("model", "build", "copy_chain_limit", (3,), ("equivalent", "anchored", "drifted", "!absent"), "copy_over_refused"),
    ("model", "build", "existing_target_copy_disabled_diagnostic", (), ("absent", "equivalent", "!upstreams"), "absent_target_copy_chain"),
    ("model", "build", "existing_target_copy_disabled_diagnostic", (), ("!upstreams",), "existing_target_copy_disabled"),
    ("model", "build", "query_changed_outside_scope", (), ("!upstreams",), "query_changed"),
    ("model", "build", "query_observed_outside_scope", (), ("!upstreams",), "query_observed_outside_scope"),
    ("model", "build", "existing_target_without_history", (5,), ("!absent", "!anchored"), "existing_target_without_history"),
    ("model", "build", "existing_target_without_history", (), ("!upstreams",), "existing_target_without_history"),
    ("model", "skip", "reused_fresh", (VIEW,), ("!upstreams",), "skip"),
    ("model", "skip", "reused_fresh", BUILT_KINDS, (), "skip"),
    ("model", "skip", "reused_within_lag_tolerance", BUILT_KINDS, (), "skip"),
    ("model", "skip", "reused_tolerated_stale", tuple(k for k in BUILT_KINDS if k != SNAPSHOT), (), "skip"),
    ("model", "build", "first_build", (), (), "first_build"),
    ("model", "build", "own_target_missing", (), (), "first_build"),
    ("model", "build", "upstream_outdated", BUILT_KINDS, ("drifted",), "upstream_outdated"),
    ("model", "build", "upstream_query_changed", BUILT_KINDS, ("anchored",), "upstream_outdated"),
    ("model", "build", "own_target_modified", (1,), ("!upstreams",), "own_target_modified"),
    ("model", "build", "own_target_modified", (1, 2, 3, 4, 5, 6), ("anchored",), "own_target_modified"),
    ("model", "build", "execution_type_changed", CHANGING_KINDS, ("anchored", "same_upstreams"), "own_target_modified"),
    ("model", "build", "upstream_names_changed", (VIEW, 11), ("!absent",), "upstream_names_changed"),
    ("model", "build", "resolution_context_changed", (), (), "resolution_context_changed"),
    ("model", "build", "input_binding_changed", (), (), "input_binding_changed"),
    ("model", "build", "identity_mismatch", (), ("absent",), "first_build"),
    ("model", "build", "identity_mismatch", (), (), "query_changed"),
    ("model", "build", "copy_logic_mismatch", (), (), "copy_logic_changed"),
    ("model", "build", "copy_disabled", (), ("equivalent",), "copy_disabled"),
    ("model", "clone", "result_copy", (), ("over",), "copy_over"),
    ("model", "clone", "result_copy", (), (), "clone"),
)
TABLE, QUERY, DATA = "table analysis ({target})", "query analysis", "data freshness analysis"
EXISTS, MISSING = ("ok", "the {noun} table exists already"), ("fail", "the {noun} table does not exist")
SAME, OTHER = ("ok", "the {noun} query has not changed"), ("fail", "the {noun} query has changed")
LISTED = ("list", "upstream dependencies")
# The sections of each shape and their lines, in order; "list" stands for a line of each upstream.
SECTIONS = {
    "skip": ((TABLE, (EXISTS,)), (QUERY, (SAME,)), (DATA, (LISTED,))),
    "first_build": ((TABLE, (MISSING, ("fail", "there is no other table that the {noun} could be cloned from"))),),
    "existing_target_without_history": ((TABLE, (EXISTS,)), (QUERY, ()), (DATA, (LISTED,))),
    "query_observed_outside_scope": ((TABLE, (EXISTS,)), (QUERY, (SAME,)), (DATA, ())),
    "existing_target_copy_disabled": ((TABLE, (EXISTS, ("fail", "but it's old. We would have cloned from {source}, but cloning is disabled"))), (QUERY, (SAME,)), (DATA, ())),
    "absent_target_copy_chain": ((TABLE, (MISSING, ("fail", "the {noun} table could have been cloned from {source}, but the maximum number of nested clones has been reached"))),),
    "query_changed": ((TABLE, (EXISTS,)), (QUERY, (OTHER,))),
    "resolution_context_changed": ((TABLE, (EXISTS,)), (QUERY, (SAME, ("fail", "names resolve in another catalog or schema")))),
    "input_binding_changed": ((TABLE, (EXISTS,)), (QUERY, (SAME, ("fail", "the query reads other relations")))),
    "copy_logic_changed": ((TABLE, (("ok", "the {noun} table was cloned"),)), (QUERY, (OTHER,))),
    "upstream_outdated": ((TABLE, (EXISTS,)), (QUERY, (SAME,)), (DATA, (("fail", "upstream data is outdated"), LISTED))),
    "own_target_modified": ((TABLE, (EXISTS, ("fail", "but it was modified after its build"))), (QUERY, (SAME,)), (DATA, (LISTED,))),
    "seed_changed": ((TABLE, (EXISTS,)), ("data analysis", (("fail", "the seed data has changed"),))),
    "seed_unchanged": ((TABLE, (EXISTS,)), ("data analysis", (("ok", "the seed data has not changed"),))),
    "seed_copy": ((TABLE, (MISSING, ("ok", "the {noun} table could be cloned from {source}"))),),
    "seed_copy_over": ((TABLE, (EXISTS, ("ok", "but its data is old, so we will clone from {source}"))),),
    "copy_over": ((TABLE, (EXISTS, ("ok", "but it's old, so we will clone from {source}"))), (QUERY, (SAME,)), (DATA, (LISTED,))),
    "copy_over_refused": ((TABLE, (EXISTS, ("fail", "but it's old, and it can't be cloned from {source}"))), (QUERY, (SAME,)), (DATA, (LISTED,))),
    "clone": ((TABLE, (MISSING, ("ok", "the {noun} table could be cloned from {source}"))), (QUERY + " (vs clone)", (SAME,)), (DATA + " (vs clone)", (LISTED,))),
    "upstream_names_changed": ((TABLE, (EXISTS,)), (QUERY, (SAME, ("fail", "the query's upstreams have changed")))),
    "copy_disabled": ((TABLE, (MISSING, ("fail", "We would have cloned from {source}, but cloning is disabled"))),),
    "copy_disabled_over": ((TABLE, (EXISTS, ("fail", "but its data is old. We would have cloned from {source}, but cloning is disabled"))),),
    "data_test_execute": ((QUERY, (LISTED,)),),
    "data_test_existing_target_without_history": ((QUERY, ()),),
}


def shape_table(spark) -> DataFrame:
    rows = [(i, g, c, r, list(kinds), [n for n in needs if not n.startswith("!")], [n[1:] for n in needs if n.startswith("!")], s) for i, (g, c, r, kinds, needs, s) in enumerate(SHAPES)]
    return spark.createDataFrame(rows, "place int, grp string, decision string, reason string, kinds array<int>, needs array<string>, lacks array<string>, shape string")


def section_table(spark) -> DataFrame:
    rows = []
    for shape, sections in SECTIONS.items():
        for i, (title, lines) in enumerate(sections):
            rows.append((shape, [i], title, None))
            rows += [(shape, [i, j], text, mark) for j, (mark, text) in enumerate(lines)]
    return spark.createDataFrame(rows, "shape string, path array<int>, text string, marker string")


def with_shape(answered: DataFrame, facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Answers with ``shape``, ``noun``, target and source names; those of no shape are left out.

    ``answered``: submission_id, decision, reason, matched_id, source_id, skip_code; ``facts``: submission_id,
    execution_type, target_key, source_key, n_own, reads, same_upstreams, has_current, volatile;
    ``verdicts``: of each upstream against the build under judgement.
    """
    drift = verdicts.groupBy("submission_id").agg(F.bool_or(F.col("drifted") & ~F.col("unprovable")).alias("drifted"))
    kind = F.col("execution_type")
    group = F.when(kind == SEED, "seed").when(kind == TEST, "test").otherwise("model")
    met = answered.join(facts, "submission_id").join(drift, "submission_id", "left").withColumn("grp", group)
    holds = {
        "absent": F.col("n_own") == 0, "upstreams": F.col("reads") != "", "drifted": F.col("drifted"), "anchored": F.col("matched_id").isNotNull(), "equivalent": F.col("source_id").isNotNull(),
        "over": F.col("has_current") & (F.col("n_own") > 0), "older": F.col("skip_code") == 8, "same_upstreams": F.col("same_upstreams"), "rendered": F.col("volatile"),
    }
    met = met.withColumn("facts", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in holds.items()))))
    table = shape_table(answered.sparkSession)  # a few dozen rows
    fits = met.join(F.broadcast(table), ["grp", "decision", "reason"]).filter(
        ((F.size("kinds") == 0) | F.array_contains("kinds", kind)) & (F.size(F.array_except("needs", "facts")) == 0) & (F.size(F.array_intersect("lacks", "facts")) == 0)
    )
    first = fits.groupBy("submission_id").agg(F.min_by("shape", "place").alias("shape"))
    return met.join(first, "submission_id").withColumn("noun", node_noun(kind))


def filled(text: Column) -> Column:
    for name, value in (("{noun}", F.col("noun")), ("{target}", F.col("target_key")), ("{source}", F.coalesce("source_key", F.lit("")))):
        text = F.replace(text, F.lit(name), value)
    return text


def tree_rows(shaped: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of each answer's tree: its shape's sections and lines, and below a list a line for each upstream.

    An upstream's badge says FRESH or OUTDATED where it was judged against a build; a
    drifted one says how long after the build read it. Copies from elsewhere and tests list
    names alone.
    """
    lines = shaped.join(F.broadcast(section_table(shaped.sparkSession)), "shape")
    plain = lines.select("submission_id", "path", filled(F.col("text")).alias("text"), F.when(F.col("marker") != "list", F.col("marker")).alias("marker"), F.lit(None).cast("string").alias("badge"))
    lists = lines.filter("marker = 'list'").select("submission_id", "path", "shape")
    judged = ~F.col("shape").isin("clone", "data_test_execute", "existing_target_without_history")
    gap = F.when(F.col("drifted") & ~F.col("unprovable") & judged, F.concat(F.lit(" changed "), humanize_ms(F.col("epoch") - F.col("recorded_epoch")), F.lit(" after the build read it"))).otherwise("")
    each = lists.join(verdicts.filter("n_now IS NOT NULL"), "submission_id").groupBy("submission_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("name", F.concat("name", gap).alias("text"), F.when(judged, F.when(F.col("drifted"), "OUTDATED").otherwise("FRESH")).alias("badge")))).alias("all")
    )
    below = each.select("submission_id", "path", F.posexplode("all").alias("i", "x")).select("submission_id", F.concat("path", F.array("i")).alias("path"), F.col("x.text").alias("text"), F.lit(None).cast("string").alias("marker"), F.col("x.badge").alias("badge"))
    return plain.unionByName(below)
