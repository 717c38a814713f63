"""Copies of results: which source may be copied, who may register a copy, and what may publish it.

Names of physical targets meet within their org, family and namespace only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import TEST
from ..sources.tables import written
from .evidence import content_digest
from .history import SCOPE, TENANT, attach_current, copy_parents, current_state, in_tenant, latest_of_type, ranked


def copyable(kind: Column, constraints: Column, indexes: Column, columns: Column) -> Column:
    """Whether a physical relation is plain enough to copy: a base table without constraints and
    indexes, all of whose columns may be NULL and have no key and no default.

    ``columns``: array of (nullable, key, default).
    """
    plain = F.forall(columns, lambda c: c["nullable"] & c["key"].isNull() & c["default"].isNull())
    return F.coalesce((kind == "BASE TABLE") & (constraints == 0) & (indexes == 0) & (F.size(columns) > 0) & plain, F.lit(False))


def copy_table(source: DataFrame, recorded: DataFrame) -> DataFrame:
    """The source's rows, if its content's digest is still the ``recorded`` one; else none.

    Digest and rows come from one plan over the same table; write them over the target.
    """
    now = content_digest(source)
    same = now.join(recorded.select(*(F.col(c).alias(f"_{c}") for c in ("format", "digest"))), (F.col("format") == F.col("_format")) & (F.col("digest") == F.col("_digest")) & F.col("known"), "left_semi")
    return source.crossJoin(F.broadcast(same.select(F.lit(True).alias("_same")))).drop("_same")  # one row at most


def copy_into(source: DataFrame, recorded: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Copy the source by ``write`` if its content's digest is the ``recorded`` one, and return the number of rows.

    A refused copy is an error, so an empty source can't be taken for one and a target stays as it
    was. The rows are settled first: what is digested is what is written.
    """
    settled = written(source)
    now = content_digest(settled).first()
    then = recorded.first()
    if then is None or not now.known or (now.format, now.digest) != (then.format, then.digest):
        raise ValueError("the source isn't what was recorded: nothing was copied")
    write(settled)
    return settled.count()


def frozen_source_check(pending: DataFrame, executions: DataFrame) -> DataFrame:
    """(id, direct_current, submit_current): whether a pending copy's source stands as its proof says.

    ``pending``: id, the columns of the tenant, completed_epoch, and ``direct`` and ``submit``,
    proofs of (source_key, source_id, source_epoch) or NULL. A source stands if its latest
    confirmed state has that id and epoch and no write to it is pending; a submitted copy must
    also have ended no earlier than its source.
    """
    proofs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("body")) for k in ("direct", "submit")))
    each = pending.select("id", *in_tenant(pending, TENANT), "completed_epoch", F.explode(proofs).alias("p")).select("*", F.col("p.kind").alias("kind"), F.col("p.body.source_key").alias("target_key"), F.col("p.body").alias("body"))
    latest = current_state(executions).select(*SCOPE, F.col("id").alias("_id"), F.col("last_modified_epoch").alias("_epoch"))
    busy = executions.filter("confirmed_ms IS NULL").select(*in_tenant(executions, SCOPE)).distinct().withColumn("_busy", F.lit(True))
    met = each.join(latest, list(SCOPE), "left").join(busy, list(SCOPE), "left")
    stands = F.coalesce((F.col("_id") == F.col("body.source_id")) & (F.col("_epoch") == F.col("body.source_epoch")), F.lit(False)) & F.col("_busy").isNull()
    in_time = F.coalesce(F.col("completed_epoch") >= F.col("_epoch"), F.lit(False))
    return met.groupBy("id").agg(F.bool_or((F.col("kind") == "direct") & stands).alias("direct_current"), F.bool_or((F.col("kind") == "submit") & stands & in_time).alias("submit_current"))


def matching_inputs(current: Column, recorded: Column) -> Column:
    """Whether two arrays of (name, epoch, producer) say the same of the same names, in any order.

    An unknown epoch or producer, or a name with two different entries, matches nothing.
    """
    keyed = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda x: F.struct(F.lower(x["name"]).alias("name"), x["epoch"].alias("epoch"), x["producer"].alias("producer")))))
    known = lambda a: F.forall(a, lambda x: F.coalesce((x["epoch"] > 0) & x["producer"].isNotNull(), F.lit(False)))
    once = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["name"]))) == F.size(a)
    now, then = keyed(current), keyed(recorded)
    return F.coalesce(known(now) & known(then) & once(now) & once(then) & (now == then), F.lit(False))


def strict_match(df: DataFrame) -> Column:
    """Whether a recorded build is the submission's: identity and kind are equal, its copy may be reused,
    namespace hashes don't differ where both are known (plain builds of databricks don't ask), and the
    dialect is the same or an alias of it under an equal rendered hash."""
    both = F.coalesce(F.col("recorded_ns_hash") == F.col("ns_hash"), F.lit(True))
    logic = ((F.col("family") == "databricks") & ~F.col("is_copy")) | both
    dialect = (F.col("recorded_dialect") == F.col("dialect")) | (F.coalesce(F.col("recorded_sql_hash") == F.col("sql_hash"), F.lit(False)) & F.col("dialect_alias"))
    return F.coalesce(F.col("identity_matches") & (F.col("recorded_type") == F.col("execution_type")) & F.col("copy_reusable") & logic & dialect, F.lit(False))


def binding_changed(same_sql: Column, now: Column, then: Column, root_now: Column, root_then: Column) -> Column:
    """Whether the same SQL reads other relations than recorded, or resolves names from another root.

    ``now`` and ``then``: arrays of resolved names; their order doesn't matter.
    """
    names = lambda a: F.array_sort(F.array_distinct(F.transform(a, F.lower)))
    return F.coalesce(same_sql, F.lit(False)) & (~names(now).eqNullSafe(names(then)) | ~root_now.eqNullSafe(root_then))


def judge_type_change(submissions: DataFrame, executions: DataFrame) -> DataFrame:
    """(submission_id, latest_id, build_id): submissions whose target's latest row has their identity but
    another kind, with the target's latest build of their own kind and identity, NULL if there is none.

    Such a submission is judged against that build. ``submissions``: scope, submitted_hash, execution_type.
    """
    met = attach_current(submissions, current_state(executions)).filter((F.col("prev.logic_hash") == F.col("submitted_hash")) & (F.col("prev.execution_type") != F.col("execution_type")))
    own = latest_of_type(executions).select(*SCOPE, "execution_type", F.col("logic_hash").alias("submitted_hash"), F.col("id").alias("build_id"))
    return met.join(own, [*SCOPE, "execution_type", "submitted_hash"], "left").select("submission_id", F.col("prev.id").alias("latest_id"), "build_id")


def decide_early(df: DataFrame) -> DataFrame:
    """Adds ``early``: skip for a data test without target and inputs that would be skipped, else NULL, undecided.

    ``df``: execution_type, target, n_inputs, decision.
    """
    ready = (F.col("execution_type") == TEST) & (F.coalesce("target", F.lit("")) == "") & (F.col("n_inputs") == 0)
    return df.withColumn("early", F.when(ready & (F.col("decision") == "skip"), "skip"))


def seed_copy(df: DataFrame) -> DataFrame:
    """Adds ``outcome`` of a seed that can't be skipped: copy, copies_disabled, chain_limit or ordinary.

    ``df``: target_state (absent, other_values, as_built, foreign), source_key (an equivalent
    load elsewhere, or NULL), allow_clones, chain_limit, source_available. Only an absent
    target, or one that holds a load of other values, is copied over.
    """
    open_ = F.col("target_state").isin("absent", "other_values") & F.col("source_key").isNotNull()
    outcome = (
        F.when(~open_, "ordinary").when(~F.coalesce("allow_clones", F.lit(True)), "copies_disabled").when(F.coalesce(F.col("chain_limit") == 0, F.lit(False)), "chain_limit")
        .when(~F.col("source_available"), "ordinary").otherwise("copy")
    )
    return df.withColumn("outcome", outcome)


def register_copy(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Copies that clients ask for: ``plan`` (chain_limit, not_eligible, unsupported, no_source or plan), and
    for planned ones the logic, runtime and id they take from the source's current state.

    ``requests``: copy_id, the tenant, source_key, source_epoch, chain_limit, contract
    (not_required, missing, declared), ddl_supported. What needs no history is refused first.
    A source that is a copy itself has already taken over its own source's logic.
    """
    state = current.select(*in_tenant(current, TENANT), F.col("target_key").alias("source_key"), F.col("id").alias("source_id"), F.col("last_modified_epoch").alias("_epoch"), "logic_hash", "runtime_ms")
    met = requests.withColumn("namespace", F.coalesce("namespace", F.lit(""))).join(state, [*TENANT, "source_key"], "left")
    declared = F.col("contract") == "declared"
    plan = (
        F.when(F.coalesce(F.col("chain_limit") == 0, F.lit(False)), "chain_limit")
        .when(F.col("contract") == "missing", "not_eligible")
        .when(declared & ((F.col("namespace") == "") | F.col("source_epoch").isNull()), "not_eligible")
        .when(~declared & ~F.col("ddl_supported"), "unsupported")
        .when(F.col("source_id").isNull(), "no_source")
        .when(F.col("source_epoch").isNotNull() & ~F.col("_epoch").eqNullSafe(F.col("source_epoch")), "not_eligible")
        .otherwise("plan")
    )
    kept = lambda c: F.when(F.col("plan") == "plan", F.col(c)).alias(c)
    return met.withColumn("plan", plan).select("copy_id", "plan", kept("source_id"), kept("logic_hash"), kept("runtime_ms"))


def inherited(history: DataFrame, recorded: DataFrame, scope: tuple[str, ...] = TENANT, doublings: int = 3) -> DataFrame:
    """(id, root_id, depth, namespace_hash, runtime_ms, inputs) of copies that clients registered: what each took over.

    A copy is made of its source's latest state before it; a source that is a registered copy
    itself passes on what it took over. So a copy's logic and inputs are those of the first
    state behind it that is none, its runtime the nearest that was reported on the way. ``depth``
    counts the copies in between, itself included; ``inputs`` has the root's names but its own,
    in order, joined by commas. A chain that ends at an unknown state has no root.

    ``history``: id, the scope, target_key, source_key, sql_hash (NULL: registered), namespace_hash,
    runtime_ms, created_ms, confirmed_ms; ``recorded``: execution_id, name. Each copy's pointer
    leaps to where its parent's points, so a chain of n copies takes log n joins.
    """
    registered = history.filter("source_key IS NOT NULL AND sql_hash IS NULL").select("id", "runtime_ms")
    parents = copy_parents(history, scope)
    met = registered.join(parents, "id", "left").join(registered.select(F.col("id").alias("parent"), F.lit(True).alias("goes")), "parent", "left")
    at = written(met.select("id", F.col("parent").alias("to"), F.lit(1).alias("depth"), "runtime_ms", F.coalesce("goes", F.lit(False)).alias("open")))
    while not at.filter("open").isEmpty():
        for _ in range(doublings):
            further = at.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("runtime_ms").alias("reported"), F.col("open").alias("goes"))
            on = at.join(further, "to", "left")
            leap = lambda then, own: F.when(F.col("open"), then).otherwise(own)
            at = on.select("id", leap(F.col("next"), F.col("to")).alias("to"), (F.col("depth") + leap(F.col("more"), F.lit(0))).alias("depth"), leap(F.coalesce("runtime_ms", "reported"), F.col("runtime_ms")).alias("runtime_ms"), (F.col("open") & F.coalesce("goes", F.lit(False))).alias("open"))
        at = written(at)
    roots = history.select(F.col("id").alias("to"), F.col("target_key").alias("_key"), "namespace_hash", F.col("runtime_ms").alias("_runtime"))
    used = at.select(F.col("to").alias("execution_id")).distinct().join(roots.select(F.col("to").alias("execution_id"), "_key"), "execution_id")
    names = used.join(recorded.select("execution_id", "name"), "execution_id").filter("name <> _key").groupBy("execution_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("inputs"))
    out = at.join(roots, "to", "left").join(names.withColumnRenamed("execution_id", "to"), "to", "left")
    return out.select("id", F.col("to").alias("root_id"), "depth", "namespace_hash", F.coalesce("runtime_ms", "_runtime").alias("runtime_ms"), F.when(F.col("to").isNotNull(), F.coalesce("inputs", F.lit(""))).alias("inputs"))


def diagnostic_current(submissions: DataFrame, executions: DataFrame, n: int = 50) -> DataFrame:
    """For each submission the ``n`` other targets of its org and family that were confirmed last, any namespace.

    Only the n + 1 best of an org and family are joined, as a submission leaves out its own key
    in at most one namespace each; namespaces with that key are few and counted in.
    """
    state = current_state(executions).select("org_id", "family", F.col("namespace").alias("other_namespace"), F.col("target_key").alias("other_key"), F.col("confirmed_ms").alias("_at"), F.col("id").alias("other_id"))
    order = F.col("_at").desc_nulls_last(), F.col("other_id").desc()
    spread = state.groupBy("org_id", "family", "other_key").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    best = state.withColumn("_n", F.row_number().over(Window.partitionBy("org_id", "family").orderBy(*order))).filter(F.col("_n") <= n + spread).drop("_n")
    met = submissions.join(best, ["org_id", "family"]).filter(F.col("other_key") != F.col("target_key"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("submission_id").orderBy(*order))).filter(F.col("rank") <= n).select("submission_id", "other_namespace", "other_key", "other_id", "rank")


def report_older(decided: DataFrame, executions: DataFrame) -> DataFrame:
    """(submission_id, older_id): rebuilds of a target one of whose earlier builds has the submission's logic and kind.

    ``decided``: submission_id, the scope, submitted_hash, execution_type, decision.
    """
    wanted = decided.filter("decision = 'build'").withColumn("namespace", F.coalesce("namespace", F.lit("")))
    older = ranked(executions).filter("rank > 1").select(*SCOPE, F.col("logic_hash").alias("submitted_hash"), "execution_type", "rank", "id")
    first = older.groupBy(*SCOPE, "submitted_hash", "execution_type").agg(F.min_by("id", "rank").alias("older_id"))
    return wanted.join(first, [*SCOPE, "submitted_hash", "execution_type"]).select("submission_id", "older_id")


def ordered_messages(decisions: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested decisions with ``ordinal``, their place in ascending id within a request, whatever the request's order.

    ``requested``: request, decision_id; an id that is asked for twice comes once.
    """
    met = requested.select("request", "decision_id").distinct().join(decisions, "decision_id")
    return met.withColumn("ordinal", F.row_number().over(Window.partitionBy("request").orderBy("decision_id")))


def volatile_calls(own: DataFrame, inherited: DataFrame) -> DataFrame:
    """(node, call, ordinal): a node's volatile calls, those of its dependencies first, each part in its own order.

    Both have node, position and call.
    """
    both = inherited.select("node", F.lit(0).alias("part"), "position", "call").unionByName(own.select("node", F.lit(1).alias("part"), "position", "call"))
    order = Window.partitionBy("node").orderBy("part", "position", "call")
    return both.withColumn("ordinal", F.row_number().over(order)).select("node", "call", "ordinal")


def upstream_names(dependencies: Column, inputs: Column) -> Column:
    """Names in a JSON array of strings or of objects with a name; those of the inputs if there are none."""
    of = lambda c, plain: F.filter(
        F.transform(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x if plain else None)), lambda x: x.isNotNull()
    )
    return F.when(F.size(of(dependencies, True)) > 0, of(dependencies, True)).otherwise(of(inputs, False))
