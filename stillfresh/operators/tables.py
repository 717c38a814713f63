"""Table building: each function returns the next version of a table as a bag of rows.

``prev`` is the table as it stands, ``sel`` the newly selected rows. Duplicates and NULLs
count; columns are matched by name.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import scd_id


def build_full(sel: DataFrame) -> DataFrame:
    """A full table, a seed or a full refresh: what was selected."""
    return sel


def build_seed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """A seed's next version: the file's rows in the declared columns and types; a value that doesn't fit fails the build."""
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def build_view(name: str, definition: DataFrame) -> DataFrame:
    """A view holds no rows: its definition is registered under ``name`` and read anew each time."""
    definition.createOrReplaceTempView(name)
    return definition.sparkSession.table(name)


def build_append(prev: DataFrame, sel: DataFrame) -> DataFrame:
    return prev.unionByName(sel)


def key_quality(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are NULL in some part, or held by several rows."""
    null = F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("has_null", null).filter("n > 1 OR has_null")


def merge_match(prev: DataFrame, sel: DataFrame, key: list[str], dest_pred: str | None = None) -> DataFrame:
    """Full outer match of target rows ``t`` and source rows ``s`` on the key, within the predicate on the target."""
    t, s = prev.select(F.struct("*").alias("t")), sel.select(F.struct("*").alias("s"))
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"t.{k}") == F.col(f"s.{k}"))
    if dest_pred:
        inside = prev.select(F.struct("*").alias("t"), F.coalesce(F.expr(dest_pred), F.lit(False)).alias("inside"))
        return inside.join(s, on & F.col("inside"), "full_outer").select("t", "s")
    return t.join(s, on, "full_outer")


def build_merge(prev: DataFrame, sel: DataFrame, key: list[str], dest_pred: str | None = None) -> DataFrame:
    """Update matched rows, insert unmatched source rows, keep target rows without a source.

    A target row outside ``dest_pred`` matches nothing, so its key is inserted again.
    """
    both = merge_match(prev, sel, key, dest_pred)
    return both.select(F.when(F.col("s").isNotNull(), F.col("s")).otherwise(F.col("t")).alias("r")).select("r.*")


def anti_by_keys(prev: DataFrame, sel: DataFrame, keys: list[str], null_safe: bool = True) -> DataFrame:
    """Target rows whose key tuple the selection doesn't have; NULL-safe, or by plain equality."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    wanted = sel.select(*(F.col(k).alias(n) for k, n in names.items())).distinct()
    on = F.lit(True)
    for k, n in names.items():
        on = on & (F.col(k).eqNullSafe(F.col(n)) if null_safe else F.col(k) == F.col(n))
    return prev.join(wanted, on, "left_anti")


def build_insert_overwrite(prev: DataFrame, sel: DataFrame, partitions: list[str]) -> DataFrame:
    """Replace every partition that the selection has rows of; an empty selection keeps all."""
    return anti_by_keys(prev, sel, partitions).unionByName(sel)


def build_delete_insert(prev: DataFrame, sel: DataFrame, keys: list[str], null_safe: bool = True) -> DataFrame:
    """Delete rows whose key the selection has, then insert it with its duplicates."""
    return anti_by_keys(prev, sel, keys, null_safe).unionByName(sel)


def in_window(t: Column, start, end) -> Column:
    """start <= t < end; NULL for a NULL time."""
    return (t >= F.lit(start)) & (t < F.lit(end))


def build_microbatch(prev: DataFrame, src: DataFrame, time: str, start, end, pred: str | None = None) -> DataFrame:
    """Replace the rows of a window of time; target rows without a time stay, source rows without one don't come."""
    inside = in_window(F.col(time), start, end)
    gone = inside & F.expr(pred) if pred else inside
    return prev.filter(~F.coalesce(gone, F.lit(False))).unionByName(src.filter(F.coalesce(inside, F.lit(False))))


def microbatch_windows(now: datetime, lookback: int, begin: datetime, start: datetime | None = None) -> list[tuple[datetime, datetime]]:
    """Day windows to process: to the end of today, from ``lookback`` days before the last day, not before ``begin``."""
    day = lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0)
    end = day(now) if now == day(now) else day(now) + timedelta(days=1)
    first = day(start) if start else max(end - timedelta(days=1 + lookback), day(begin))
    return [(first + timedelta(days=i), first + timedelta(days=i + 1)) for i in range(max(0, (end - first).days))]


def day_bounds(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each UTC day from ``start`` to ``end`` (columns of dates), with the day's bounds."""
    days = F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date")))
    return df.select("*", days.alias("day")).withColumns({"day_start": F.col("day").cast("timestamp"), "day_end": F.date_add("day", 1).cast("timestamp")})


def build_replace_where(prev: DataFrame, sel: DataFrame, pred: str) -> DataFrame:
    """Drop target rows for which the predicate is true, add the selection.

    A selected row for which it isn't true fails the whole build when the plan runs.
    """
    holds = F.coalesce(F.expr(pred), F.lit(False))
    checked = sel.filter(F.when(holds, True).otherwise(F.raise_error(F.lit("a selected row lies outside the replaced range")).cast("boolean")))
    return prev.filter(~holds).unionByName(checked)


def snapshot_match(open_: DataFrame, src: DataFrame, key: str) -> DataFrame:
    """Open versions ``o`` and source rows ``s`` of the same key; either is NULL where the other side has no such key."""
    o, s = open_.select(F.struct("*").alias("o")), src.select(F.struct("*").alias("s"))
    return o.join(s, F.col(f"o.{key}") == F.col(f"s.{key}"), "full_outer")


def build_snapshot(
    hist: DataFrame, src: DataFrame, key: str, strategy: str, now, updated_at: str | None = None, check_cols: tuple[str, ...] = (), hard_deletes: str = "ignore"
) -> DataFrame:
    """The next version of an SCD2 history.

    ``hist`` has the business columns and dbt_scd_id, dbt_updated_at, dbt_valid_from,
    dbt_valid_to. The source's keys are unique and not NULL (:func:`key_quality` tells). A
    changed key closes its open version and opens one; ``timestamp`` is a source time strictly
    after the open version's start, ``check`` a listed column that differs, NULLs being equal.
    ``invalidate`` closes open versions whose key the source lacks.
    """
    open_, closed = hist.filter("dbt_valid_to IS NULL"), hist.filter("dbt_valid_to IS NOT NULL")
    both = snapshot_match(open_, src, key)
    when = F.col(f"s.{updated_at}") if updated_at else F.lit(now)
    if strategy == "timestamp":
        differs = F.coalesce(F.col("o.dbt_valid_from") < F.col(f"s.{updated_at}"), F.lit(False))
    else:
        differs = F.lit(False)
        for c in check_cols:
            differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    was, is_ = F.col("o").isNotNull(), F.col("s").isNotNull()
    ends = F.when(was & is_ & differs, when).when(was & ~is_ & F.lit(hard_deletes == "invalidate"), F.lit(now))
    end_type = hist.schema["dbt_valid_to"].dataType
    old = both.filter(was).select("o.*", ends.cast(end_type).alias("_end")).withColumn("dbt_valid_to", F.col("_end")).drop("_end")
    fresh = both.filter(is_ & (~was | differs)).select("s.*", when.cast(end_type).alias("dbt_updated_at"))
    new = fresh.withColumns({
        "dbt_scd_id": scd_id(F.col(key).cast("string"), F.col("dbt_updated_at")), "dbt_valid_from": F.col("dbt_updated_at"), "dbt_valid_to": F.lit(None).cast(end_type),
    })
    return closed.unionByName(old).unionByName(new)


def close_versions(versions: DataFrame, key: str, start: str) -> DataFrame:
    """Each version ends where the key's next one starts."""
    from pyspark.sql import Window

    return versions.withColumn("dbt_valid_to", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def reconcile_schema(prev: DataFrame, sel: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """(prev, sel) with the columns to build on: policies fail, ignore and append_new_columns."""
    new = [c for c in sel.columns if c not in prev.columns]
    if policy == "fail" and (new or set(prev.columns) - set(sel.columns)):
        raise ValueError(f"the selection's columns differ: {sorted(set(prev.columns) ^ set(sel.columns))}")
    if policy == "append_new_columns":
        prev = prev.select("*", *(F.lit(None).cast(sel.schema[c].dataType).alias(c) for c in new))
    filled = [F.col(c) if c in sel.columns else F.lit(None).cast(prev.schema[c].dataType).alias(c) for c in prev.columns]
    return prev, sel.select(*filled)


def high_watermark(target: DataFrame, column: str, default) -> DataFrame:
    """One row: the target's largest value, or ``default`` for an empty table."""
    return target.agg(F.coalesce(F.max(column), F.lit(default).cast(target.schema[column].dataType)).alias("high"))


def select_new(src: DataFrame, target: DataFrame, column: str, default) -> DataFrame:
    """Source rows beyond the target's watermark; none on unchanged input."""
    return src.join(F.broadcast(high_watermark(target, column, default)), F.col(column) > F.col("high")).drop("high")  # one row


def transition(prev: DataFrame, sel: DataFrame, before: str, after: str, key: list[str]) -> DataFrame:
    """A node of another kind on the same name: an incremental kind goes on with the rows that one left; all else starts anew.

    Incremental kinds: append, merge, delete_insert and insert_overwrite (``key`` names its
    partitions). A table, seed or view before or after means the selection alone.
    """
    go_on = {
        "append": lambda: build_append(prev, sel), "merge": lambda: build_merge(prev, sel, key),
        "delete_insert": lambda: build_delete_insert(prev, sel, key), "insert_overwrite": lambda: build_insert_overwrite(prev, sel, key),
    }
    return go_on[after]() if before in go_on and after in go_on else build_full(sel)
