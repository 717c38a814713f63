"""The execution log: latest states, confirmations, producers and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

SCOPE = ("org_id", "family", "namespace", "target_key")
TENANT = SCOPE[:3]


def physical_order() -> list[Column]:
    """Latest first. A NULL epoch counts as latest: such a state is never known to be old."""
    return [F.col("last_modified_epoch").desc_nulls_first(), F.col("confirmed_ms").desc_nulls_last(), F.col("id").desc()]


def _scoped(executions: DataFrame) -> DataFrame:
    return executions.filter(F.col("confirmed_ms").isNotNull()).withColumn("namespace", F.coalesce("namespace", F.lit("")))


def ranked(executions: DataFrame, keys: tuple[str, ...] = SCOPE) -> DataFrame:
    """Confirmed rows with ``rank`` within their physical target, latest first."""
    return _scoped(executions).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*physical_order())))


def current_state(executions: DataFrame) -> DataFrame:
    """The latest confirmed row of every physical target. Eligibility is tested afterwards, never before."""
    return ranked(executions).filter("rank = 1").drop("rank")


def target_history(executions: DataFrame, n: int = 50) -> DataFrame:
    return ranked(executions).filter(F.col("rank") <= n)


def latest_test(executions: DataFrame, test_kind: int = 9) -> DataFrame:
    """The latest data-test outcome of each node, by confirmation; tests have no epoch."""
    keys = ("org_id", "node_uid", "project", "namespace", "family")
    order = Window.partitionBy(*keys).orderBy(F.col("confirmed_ms").desc(), F.col("id").desc())
    return _scoped(executions).filter(F.col("execution_type") == test_kind).withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def latest_of_type(executions: DataFrame) -> DataFrame:
    """The latest row of each execution type of every target."""
    return ranked(executions, (*SCOPE, "execution_type")).filter("rank = 1").drop("rank")


def older_match(executions: DataFrame, wanted: Column) -> DataFrame:
    """The first row after the latest of its target for which ``wanted`` holds."""
    again = Window.partitionBy(*SCOPE).orderBy("rank")
    return ranked(executions).filter((F.col("rank") > 1) & wanted).withColumn("n", F.row_number().over(again)).filter("n = 1").drop("n")


def first_confirm(confirms: DataFrame) -> DataFrame:
    """The first confirmation of each request; later ones never replace it."""
    order = Window.partitionBy("request_id").orderBy(F.col("arrival").asc(), F.col("confirm_id").asc())
    return confirms.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def confirm(pending: DataFrame, confirms: DataFrame) -> DataFrame:
    """Every confirmation with its outcome, and the epoch it publishes.

    ``pending``: request_id, target, confirmed_ms. A request is published once; it needs an
    epoch exactly if it has a target. Outcomes: published, already_confirmed, invalid, missing.
    """
    known = pending.select("request_id", F.col("target").alias("_target"), F.col("confirmed_ms").alias("_done"))
    with_target = confirms.join(known, "request_id", "left")
    valid = (F.coalesce("_target", F.lit("")) != "") == F.col("epoch").isNotNull()
    order = Window.partitionBy("request_id").orderBy(F.when(F.col("_valid"), 0).otherwise(1), "arrival", "confirm_id")
    tried = with_target.withColumn("_valid", valid).withColumn("_n", F.row_number().over(order))
    outcome = (
        F.when(F.col("_target").isNull(), "missing")
        .when(F.col("_done").isNotNull(), "already_confirmed")
        .when(~F.col("_valid"), "invalid")
        .when(F.col("_n") > 1, "already_confirmed")
        .otherwise("published")
    )
    return tried.select("confirm_id", "request_id", "epoch", outcome.alias("outcome"))


def record_batch(records: DataFrame) -> DataFrame:
    """All of a batch or nothing: a target needs an epoch and an epoch a target, in every record."""
    bad = records.agg(F.coalesce(F.bool_or((F.coalesce("target", F.lit("")) != "") != F.col("last_modified_epoch").isNotNull()), F.lit(False)).alias("bad"))
    return records.crossJoin(F.broadcast(bad)).filter(~F.col("bad")).drop("bad")  # one row


def upsert_latest(state: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins for each key, of equal orders the same row in every run; updates with an empty key part are left out."""
    filled = updates.filter(F.forall(F.array(*(F.col(k).cast("string") for k in keys)), lambda k: F.coalesce(k, F.lit("")) != ""))
    both = state.unionByName(filled, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), F.struct(order, F.xxhash64(*both.columns))).alias("r")).select("r.*")


def upsert_dimension(dim: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """New values where they are known, old ones else; first and last sight widen."""
    old, new = dim.alias("o"), updates.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = old.join(new, on, "full_outer")
    rest = [c for c in dim.columns if c not in (*keys, "first_seen", "last_seen")]
    return joined.select(
        *(F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys),
        *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest),
        F.least("o.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
    )


def attach_current(submissions: DataFrame, current: DataFrame) -> DataFrame:
    """Each submission with its target's current state, as ``prev``; NULL where there is none."""
    keyed = current.select(*SCOPE, F.struct("*").alias("prev"))
    return submissions.withColumn("namespace", F.coalesce("namespace", F.lit(""))).join(keyed, list(SCOPE), "left")


def resolve_producers(inputs: DataFrame, current: DataFrame) -> DataFrame:
    """Which build made what an input read: its logic if the read isn't after the build, else none.

    ``inputs``: org_id, family, namespace, name, read_epoch. Adds ``producer_state`` and
    ``producer_logic``; a relation with no recorded build has no producer.
    """
    built = current.select("org_id", "family", "namespace", F.col("target_key").alias("name"), F.col("last_modified_epoch").alias("_built"), F.col("logic_hash").alias("_logic"))
    joined = inputs.withColumn("namespace", F.coalesce("namespace", F.lit(""))).join(built, ["org_id", "family", "namespace", "name"], "left")
    made = F.coalesce(F.col("read_epoch") <= F.col("_built"), F.lit(False))
    return joined.withColumns({"producer_state": F.when(made, "build").otherwise("no_build"), "producer_logic": F.when(made, F.col("_logic"))}).drop("_built", "_logic")


def last_known(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``last``: the last ``value`` that isn't NULL at or before each row, in ``order`` within ``keys``.

    Rows are cut by range into a written table, so that a hot key is split in that order;
    what each part ends with is carried into the parts after it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    ends = cut.groupBy("_part", *keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).filter("_carried IS NOT NULL").drop("_end")
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = cut.withColumn("_seen", F.last(value, ignorenulls=True).over(within)).join(carried, ["_part", *keys], "left")
    return seen.withColumn("last", F.coalesce("_seen", "_carried")).drop("_part", "_seen", "_carried")


def in_tenant(df: DataFrame, scope: tuple[str, ...]) -> list[Column]:
    """The scope's columns, '' for a namespace that is NULL."""
    return [F.coalesce(c, F.lit("")).alias(c) if c == "namespace" else F.col(c) for c in scope]


def batch_producers(reads: DataFrame, builds: DataFrame, scope: tuple[str, ...] = TENANT) -> DataFrame:
    """Forward as-of in one batch: the earliest build at or after the read, later records winning ties.

    ``reads``: read_id, name, read_epoch; ``builds``: name, epoch, ord, logic_hash; both with the
    columns of ``scope``, within which names meet. Reads and builds of a name are read
    backwards in time, so no read meets more than one build.
    """
    read = reads.filter("read_epoch IS NOT NULL AND name IS NOT NULL").select(
        *in_tenant(reads, scope), "name", (-F.col("read_epoch")).alias("_t"), F.lit(1).alias("_kind"), F.xxhash64("read_id").alias("_ord"), "read_id"
    )
    built = builds.filter("epoch IS NOT NULL AND name IS NOT NULL").select(
        *in_tenant(builds, scope), "name", (-F.col("epoch")).alias("_t"), F.lit(0).alias("_kind"), F.col("ord").alias("_ord"), F.struct("logic_hash").alias("_build")
    )
    met = last_known(read.unionByName(built, allowMissingColumns=True), [*scope, "name"], ["_t", "_kind", "_ord"], "_build")
    first = met.filter("_kind = 1").select("read_id", F.col("last.logic_hash").alias("logic_hash"))
    return reads.join(first, "read_id", "left").withColumn("producer_state", F.when(F.col("logic_hash").isNotNull(), "build").otherwise("no_build"))


def no_pending(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """Rows whose physical target, in its org, family and namespace, has no pending write."""
    busy = pending.select(*(c.alias(f"_{n}") for c, n in zip(in_tenant(pending, SCOPE), SCOPE, strict=True))).distinct()
    same = [F.coalesce(rows[c], F.lit("")) == busy[f"_{c}"] if c == "namespace" else rows[c] == busy[f"_{c}"] for c in SCOPE]
    return rows.join(busy, same, "left_anti")


def resolve_deferred(executions: DataFrame, requests: DataFrame, scope: tuple[str, ...] = ("org_id", "project", "environment")) -> DataFrame:
    """The latest confirmed relation of each node in a request's scope; one with an empty part finds nothing.

    ``scope`` may have further columns, such as a profile; both tables hold all of them.
    """
    order = Window.partitionBy(*scope, "node_uid").orderBy(F.col("confirmed_ms").desc(), F.col("id").desc())
    latest = executions.filter(F.col("confirmed_ms").isNotNull() & (F.coalesce("target", F.lit("")) != "")).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    wanted = requests.filter(F.forall(F.array(*scope), lambda x: F.coalesce(x, F.lit("")) != "")).select(*scope).distinct()
    return latest.join(wanted, list(scope)).select(*scope, "node_uid", "target", "id")


def copy_chain_depth(history: DataFrame, max_depth: int = 5, scope: tuple[str, ...] = TENANT) -> DataFrame:
    """(id, depth) of copies: how many copies deep a state's source is, at most ``max_depth`` + 1.

    ``history``: id, target_key, source_key (NULL for builds), created_ms, confirmed_ms, and the
    columns of ``scope``, which a copy and its source share. A copy's parent is its source's latest state with a smaller id that was confirmed by the
    copy's creation; each step goes to the parent.
    """
    copies = history.filter("source_key IS NOT NULL")
    parents = written(copy_parents(history, scope).join(copies.select(F.col("id").alias("parent")), "parent", "left_semi"))
    at = copies.select("id", F.col("id").alias("at_id"), F.lit(1).alias("depth"))
    out = at.select("id", "depth")
    hop = parents.select(F.col("id").alias("at_id"), "parent")
    for _ in range(max_depth):
        at = at.join(hop, "at_id").select("id", F.col("parent").alias("at_id"), (F.col("depth") + 1).alias("depth"))
        out = out.unionByName(at.select("id", "depth"))
    return out.groupBy("id").agg(F.max("depth").alias("depth"))


def copy_parents(history: DataFrame, scope: tuple[str, ...] = TENANT) -> DataFrame:
    """(id, parent) of copies: the state each copies, where one is known.

    The smaller ids are a union of one block of ids for each bit that is set in the copy's
    own; in each block the latest state by time is found as in :func:`last_known`. So rows
    grow by the ids' number of bits, never by pairs.
    """
    ids = history.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    if ids.a is None:
        return history.select("id", F.col("id").alias("parent")).limit(0)
    bits = history.withColumn("_x", F.col("id") - F.lit(ids.a)).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(max(1, int(ids.b - ids.a).bit_length()) - 1))))
    block, is_set = F.expr("shiftright(_x, _bit)"), F.expr("shiftright(_x, _bit) % 2 = 1")
    states = bits.filter(~is_set & F.col("confirmed_ms").isNotNull() & F.col("target_key").isNotNull()).select(
        *in_tenant(history, scope), F.col("target_key").alias("_key"), "_bit", block.alias("_block"), F.col("confirmed_ms").alias("_t"), F.lit(0).alias("_kind"), "id", F.struct("confirmed_ms", "id").alias("_state")
    )
    asked = bits.filter(is_set & F.col("created_ms").isNotNull() & F.col("source_key").isNotNull()).select(
        *in_tenant(history, scope), F.col("source_key").alias("_key"), "_bit", (block - 1).alias("_block"), F.col("created_ms").alias("_t"), F.lit(1).alias("_kind"), "id"
    )
    met = last_known(asked.unionByName(states, allowMissingColumns=True), [*scope, "_key", "_bit", "_block"], ["_t", "_kind", "id"], "_state")
    return met.filter("_kind = 1 AND last IS NOT NULL").groupBy("id").agg(F.max("last").alias("s")).select("id", F.col("s.id").alias("parent"))


def copy_candidates(submissions: DataFrame, current: DataFrame, n: int = 16) -> DataFrame:
    """Other targets of the same org, family and namespace whose current state has one of a
    submission's namespace identities: the ``n`` latest of each.

    ``submissions``: namespace_hash, or ``hashes``, an array of them. Ranked by epoch (unknown
    epochs don't count), then target. Only the n + 1 best states of an identity are joined, as
    a submission leaves out no other than its own target's.
    """
    keys = [*TENANT, "namespace_hash"]
    order = F.col("source_epoch").desc_nulls_last(), F.col("source_key").asc()
    other = current.filter("last_modified_epoch IS NOT NULL").select(
        *in_tenant(current, TENANT), "namespace_hash", F.col("target_key").alias("source_key"), F.col("last_modified_epoch").alias("source_epoch"), F.col("id").alias("source_id")
    )
    best = other.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n + 1).drop("_n")
    asked = submissions.withColumn("namespace", F.coalesce("namespace", F.lit("")))
    if "hashes" in submissions.columns:
        asked = asked.withColumn("namespace_hash", F.explode(F.array_distinct("hashes")))
    met = asked.join(best, keys).filter(F.col("source_key") != F.col("target_key"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("submission_id").orderBy(*order))).filter(F.col("rank") <= n)


def first_choice(candidates: DataFrame) -> DataFrame:
    """The first candidate that says choose, unless an earlier one says stop.

    ``candidates``: submission_id, rank, verdict (choose, stop or next).
    """
    found = candidates.groupBy("submission_id").agg(
        F.min(F.when(F.col("verdict") == "choose", F.col("rank"))).alias("chosen"), F.min(F.when(F.col("verdict") == "stop", F.col("rank"))).alias("stopped")
    )
    return found.select("submission_id", F.when(F.col("chosen") < F.coalesce("stopped", F.lit(1 << 30)), F.col("chosen")).alias("chosen_rank"))
