"""Rollups of decisions, lineage, selectors and data tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.display import reuse_rate
from ..sources.tables import written
from . import graphs


def _is(name: str) -> Column:
    return F.col("decision") == name


def overview(decisions: DataFrame) -> DataFrame:
    """One row: decisions by outcome, and how many projects, environments and invocations they come from."""
    counted = decisions.agg(
        F.count_if(_is("build")).alias("built"), F.count_if(_is("skip")).alias("reused"), F.count_if(_is("clone")).alias("cloned"), F.count(F.lit(1)).alias("total"),
        F.countDistinct("project").alias("projects"), F.countDistinct("environment").alias("environments"), F.countDistinct("invocation").alias("invocations"),
    )
    return counted.withColumn("reuse_rate", reuse_rate(F.col("reused") + F.col("cloned"), F.col("total")))


def daily_activity(decisions: DataFrame, since: str) -> DataFrame:
    """Built and reused decisions of each UTC day from ``since`` on."""
    day = F.to_date("created_at")
    recent = decisions.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return recent.groupBy(day.alias("day")).agg(F.count_if(_is("build")).alias("built"), F.count_if(~_is("build")).alias("reused"))


def rollup_dimension(dimension: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Counts for every row of a dimension, 0 for those without decisions."""
    counts = decisions.groupBy(key).agg(F.count_if(_is("build")).alias("built"), F.count_if(~_is("build")).alias("reused"))
    return dimension.select(key).join(counts, key, "left").na.fill(0, ["built", "reused"])


def decision_rollup(decisions: DataFrame) -> DataFrame:
    """Totals of every level from org down to invocation, in one pass; ``level`` counts the keys that are rolled up."""
    rolled = decisions.rollup("org_id", "project", "environment", "invocation").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("total"), F.count_if(_is("build")).alias("built"))
    return rolled.select("org_id", "project", "environment", "invocation", F.bit_count("gid").alias("level"), "total", "built")


def invocation_counts(decisions: DataFrame) -> DataFrame:
    """Counters of each invocation; decisions without one count for their session."""
    name = F.coalesce(F.when(F.col("invocation") != "", F.col("invocation")), F.concat(F.lit("session:"), F.col("session")))
    return decisions.groupBy(name.alias("invocation")).agg(
        F.sum(_is("build").cast("long")).alias("built"), F.sum(_is("skip").cast("long")).alias("reused"), F.sum(_is("clone").cast("long")).alias("cloned")
    )


def recent_invocations(decisions: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest invocations with their counts."""
    counts = decisions.groupBy("invocation").agg(F.max("decision_id").alias("last_id"), F.count(F.lit(1)).alias("total"), F.count_if(_is("build")).alias("built"))
    return counts.orderBy(F.desc("last_id"), "invocation").limit(n)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The newest decision on each node of an environment."""
    order = Window.partitionBy("org_id", "environment", "node_uid").orderBy(F.col("created_at").desc(), F.col("decision_id").desc())
    return decisions.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def dedupe_decisions(decisions: DataFrame, key: str) -> DataFrame:
    """The last row of each request."""
    order = Window.partitionBy(key).orderBy(F.col("decision_id").desc())
    return decisions.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def explain_census(decisions: DataFrame) -> DataFrame:
    """Counts by kind and decision, with totals of each and of all."""
    sets = decisions.cube("kind", "decision").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
    return sets.select("kind", "decision", F.col("gid").cast("int").alias("gid"), "n")


def tree_census(trees: DataFrame) -> DataFrame:
    """(kind, decision, measure, name, n): what explain trees hold, by kind and decision and over all (both NULL).

    ``trees``: kind, decision, origin, lines (array of marker and badge; NULL or empty for an
    empty tree). Measures: tree, empty, origin, marker, badge; a NULL name counts as ''.
    """
    fact = lambda measure, name: F.struct(F.lit(measure).alias("measure"), F.coalesce(name, F.lit("")).alias("name"))
    lines = F.coalesce("lines", F.array().cast(trees.schema["lines"].dataType))
    whole = F.array(fact("tree", F.lit("")), fact("origin", F.col("origin")))
    empty = F.when(F.size(lines) == 0, F.array(fact("empty", F.lit("")))).otherwise(F.array().cast("array<struct<measure:string,name:string>>"))
    of_lines = [F.transform(lines, lambda x: fact("marker", x["marker"])), F.transform(lines, lambda x: fact("badge", x["badge"]))]
    facts = trees.select("kind", "decision", F.explode(F.concat(whole, empty, *of_lines)).alias("f")).select("kind", "decision", "f.measure", "f.name")
    keys = [F.col(c) for c in ("kind", "decision", "measure", "name")]
    return facts.groupingSets([keys, keys[2:]], *keys).agg(F.count(F.lit(1)).alias("n"))


def agreement_report(compared: DataFrame) -> DataFrame:
    """Totals by mutation axis and over all: agreements, skips only one side took, divergences."""
    same = F.col("expected") == F.col("actual")
    return compared.rollup("axis").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(same).alias("agree"), F.count_if(same & (F.col("expected") == "build")).alias("agree_execute"),
        F.count_if((F.col("expected") == "skip") & same).alias("real_skip"), F.count_if(~same).alias("divergence"),
    )


def lineage_edges(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(src, dst): an input that another node produces; no self-edges, each once.

    ``nodes``: uid, relation; ``inputs``: uid, name.
    """
    made = nodes.select(F.col("uid").alias("src"), F.col("relation").alias("name"))
    return inputs.join(made, "name").filter("src <> uid").select("src", F.col("uid").alias("dst")).distinct()


def lineage(decisions: DataFrame, nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """uid, label, decision, upstreams, downstreams: each node with its latest decision and its edges by :func:`lineage_edges`.

    ``decisions``: uid, decision_id, decision; ``nodes``: uid, relation; ``inputs``: uid, name. A
    node without a decision says none; ``upstreams`` has the names of the nodes before it, in order.
    """
    last = dedupe_decisions(decisions, "uid").select("uid", "decision")
    edges = written(lineage_edges(nodes, inputs))
    before = edges.groupBy(F.col("dst").alias("uid")).agg(F.array_sort(F.collect_list("src")).alias("upstreams"))
    after = edges.groupBy(F.col("src").alias("uid")).agg(F.count(F.lit(1)).alias("downstreams"))
    joined = nodes.select("uid", F.element_at(F.split("relation", r"\."), -1).alias("label")).join(last, "uid", "left").join(before, "uid", "left").join(after, "uid", "left")
    return joined.select("uid", "label", F.coalesce("decision", F.lit("none")).alias("decision"), F.coalesce("upstreams", F.array().cast("array<string>")).alias("upstreams"), F.coalesce("downstreams", F.lit(0)).alias("downstreams"))


def invocation_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions with ``n``, their place within their invocation, by time, then id."""
    return decisions.withColumn("n", F.row_number().over(Window.partitionBy("invocation").orderBy("created_at", "decision_id")).cast("long"))


def lineage_layers(edges: DataFrame) -> DataFrame:
    """(node, layer): the longest path to each node from nodes without inputs.

    A cycle is an error, also one that no other node leads to. Long chains cost few rounds.
    """
    return graphs.layers(edges)


def expand_selection(selected: DataFrame, edges: DataFrame, up: bool, down: bool) -> DataFrame:
    """The selected nodes (column node) with all their ancestors and/or descendants."""
    found = selected.select("node").distinct()
    for a, b, wanted in (("dst", "src", up), ("src", "dst", down)):
        if wanted:
            found = found.unionByName(graphs.descendants(selected, edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))))
    return found.distinct()


COMPONENTS = ("body", "configs", "descriptions", "macros", "contract")


def classify_nodes(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """Each submitted node against its recorded state: new, old, one flag for each component, relation, modified, unmodified.

    A new node counts as changed in every component. NULL and a value differ. The relation
    alone never makes a node modified.
    """
    keys = ("org_id", "project", "environment", "uid")
    recorded = state.select(*keys, *(F.col(c).alias(f"_{c}") for c in (*COMPONENTS, "relation")), F.lit(True).alias("_known"))
    both = nodes.join(recorded, list(keys), "left")
    new = F.col("_known").isNull()
    flags = {c: new | ~names.eq_ns(F.col(c), F.col(f"_{c}")) for c in (*COMPONENTS, "relation")}
    modified = new
    for c in COMPONENTS:
        modified = modified | flags[c]
    return both.select(
        *keys, new.alias("is_new"), (~new).alias("is_old"), *(f.alias(f"{c}_changed") for c, f in flags.items()), modified.alias("modified"), (~new & ~modified).alias("unmodified")
    )


def test_outcome(rows: DataFrame, fail_calc: str, error_if: str, warn_if: str, severity: str = "error") -> DataFrame:
    """One row: failures of a data test, which thresholds it passes, and its status."""
    counted = rows.agg(F.expr(fail_calc).cast("long").alias("failures"))
    flags = counted.withColumns({"should_error": F.expr(f"failures {error_if}"), "should_warn": F.expr(f"failures {warn_if}")})
    fails = F.col("should_error") if severity == "error" else F.lit(False)
    return flags.withColumn("status", F.when(fails, "fail").when(F.col("should_warn"), "warn").otherwise("pass"))


@dataclass(frozen=True)
class DataTest:
    """A test of a table: ``failing`` is the predicate of rows that fail it."""

    name: str
    failing: str
    fail_calc: str = "count(*)"
    error_if: str = "> 0"
    warn_if: str = "> 0"
    severity: str = "error"


def run_tests(rows: DataFrame, tests: list[DataTest], store: str | None = None) -> DataFrame:
    """test, failures, should_error, should_warn, status: all tests of a table from one scan of it.

    The predicates of all tests are folded in one pass; a NULL predicate is no failure. With
    ``store``, the failing rows are written there, a folder test=name for each test, and the
    outcomes come from what was written, so the table is still scanned once.
    """
    spark = rows.sparkSession
    if store:
        mark = fresh_name(rows, "test")
        hit = F.filter(F.array(*(F.when(F.expr(t.failing), F.lit(t.name)) for t in tests)), lambda n: n.isNotNull())
        rows.withColumn(mark, F.explode(hit)).write.partitionBy(mark).mode("overwrite").parquet(store)
        failing = spark.read.schema(rows.schema.add(mark, "string")).parquet(store)
        counted = failing.agg(*(F.expr(f"{t.fail_calc} FILTER (WHERE {mark} = '{t.name}')").cast("long").alias(f"f{i}") for i, t in enumerate(tests)))
    else:
        counted = rows.agg(*(F.expr(f"{t.fail_calc} FILTER (WHERE {t.failing})").cast("long").alias(f"f{i}") for i, t in enumerate(tests)))
    each = F.array(*(
        F.struct(
            F.lit(t.name).alias("test"), F.col(f"f{i}").alias("failures"), F.expr(f"coalesce(f{i} {t.error_if}, false)").alias("should_error"), F.expr(f"coalesce(f{i} {t.warn_if}, false)").alias("should_warn"),
            F.lit(t.severity == "error").alias("errs"),
        ) for i, t in enumerate(tests)
    ))
    told = counted.select(F.explode(each).alias("x")).select("x.*")
    return told.select("test", "failures", "should_error", "should_warn", F.when(F.col("should_error") & F.col("errs"), "fail").when(F.col("should_warn"), "warn").otherwise("pass").alias("status"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column has."""
    while name in df.columns:
        name += "_"
    return name


def audit_scope(df: DataFrame) -> DataFrame:
    """Physical targets that more than one org's rows claim under one org-less key; for eyes, not an error."""
    return df.groupBy("family", "target_key").agg(F.countDistinct("org_id").alias("orgs"), F.count(F.lit(1)).alias("n")).filter("orgs > 1")


def audit_skips(decided: DataFrame) -> DataFrame:
    """Skips that no evidence allows; must be empty."""
    unsafe = F.coalesce(F.col("set_changed"), F.lit(False)) | F.coalesce(F.col("any_unprovable"), F.lit(False)) | (F.coalesce("drifted", F.lit(0)) > 0) & ~F.col("is_stale")
    return decided.filter((F.col("decision") == "skip") & unsafe)


def upstream_set(inputs: DataFrame, key: str) -> DataFrame:
    """key, names: the distinct upstream names of each execution or submission, in order, comma-joined."""
    return inputs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
