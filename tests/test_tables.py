"""Table building against literal bags."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stillfresh.functions import display, names
from stillfresh.operators import evidence, history, tables


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def prev(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "k int, v string")


@pytest.fixture(scope="module")
def sel(spark):
    return spark.createDataFrame([(2, "B"), (3, "c"), (None, "N")], "k int, v string")


def test_append_keeps_duplicates(prev, sel):
    assert bag(tables.build_append(prev, sel)) == Counter([(1, "a"), (2, "b"), (2, "b"), (None, "n"), (2, "B"), (3, "c"), (None, "N")])


def test_merge_never_matches_null_keys(prev, sel):
    assert bag(tables.build_merge(prev.distinct(), sel, ["k"])) == Counter([(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "N")])


def test_delete_insert_null_safe_and_equal(prev, sel):
    assert bag(tables.build_delete_insert(prev, sel, ["k"])) == Counter([(1, "a"), (2, "B"), (3, "c"), (None, "N")])
    assert bag(tables.build_delete_insert(prev, sel, ["k"], null_safe=False)) == Counter([(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "N")])


def test_empty_selection_keeps_all(prev, sel):
    assert bag(tables.build_insert_overwrite(prev, sel.limit(0), ["k"])) == bag(prev)


def test_replace_where_refuses_rows_outside(prev, sel):
    with pytest.raises(Exception, match="outside the replaced range"):
        tables.build_replace_where(prev, sel, "k < 3").collect()
    assert bag(tables.build_replace_where(prev, sel.filter("k < 3"), "k < 3")) == Counter([(2, "B"), (None, "n")])


def test_microbatch_keeps_rows_without_time(prev, sel):
    assert bag(tables.build_microbatch(prev, sel, "k", 2, 4)) == Counter([(1, "a"), (None, "n"), (2, "B"), (3, "c")])


def test_schema_policies(prev, sel):
    wide = sel.withColumn("x", F.lit(1))
    with pytest.raises(ValueError):
        tables.reconcile_schema(prev, wide, "fail")
    assert tables.build_append(*tables.reconcile_schema(prev, wide, "ignore")).columns == ["k", "v"]
    assert (1, "a", None) in bag(tables.build_append(*tables.reconcile_schema(prev, wide, "append_new_columns")))


def test_rerun_on_unchanged_input_selects_nothing(prev, sel):
    assert tables.select_new(prev, prev, "k", 0).count() == 0


def test_snapshot_twice_is_a_fixed_point(spark):
    hist = spark.createDataFrame([], "k int, v string, at timestamp, dbt_scd_id string, dbt_updated_at timestamp, dbt_valid_from timestamp, dbt_valid_to timestamp")
    src = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (2, None, datetime(2024, 1, 1))], "k int, v string, at timestamp")
    now = F.lit("2024-02-01").cast("timestamp")
    one = tables.build_snapshot(hist, src, "k", "timestamp", now, "at")
    assert bag(tables.build_snapshot(one, src, "k", "timestamp", now, "at")) == bag(one)
    gone = tables.build_snapshot(one, src.filter("k = 1"), "k", "check", now, "at", ("v",), "invalidate")
    assert {r.k: r.dbt_valid_to is None for r in gone.collect()} == {1: True, 2: False}


def test_microbatch_windows():
    w = tables.microbatch_windows(datetime(2024, 1, 10, 5), 2, datetime(2024, 1, 9))
    assert w == [(datetime(2024, 1, 9), datetime(2024, 1, 10)), (datetime(2024, 1, 10), datetime(2024, 1, 11))]


def test_digest_ignores_order_and_counts_duplicates(spark, prev):
    d = lambda x: evidence.content_digest(x).first().digest
    assert d(prev) == d(prev.repartition(7).orderBy(F.desc("v"))) != d(prev.distinct())
    assert not evidence.content_digest(spark.range(1).select(F.lit(1.0).alias("x"))).first().known


def test_unknown_epoch_is_latest(spark):
    rows = spark.createDataFrame([(1, 5, 9), (2, None, 1), (3, 7, 2)], "id long, last_modified_epoch long, confirmed_ms long")
    rows = rows.select("*", *(F.lit("x").alias(c) for c in history.SCOPE))
    assert history.current_state(rows).first().id == 2


def test_batch_with_one_bad_record_records_nothing(spark):
    rows = spark.createDataFrame([(1, "t", 1), (2, "", 5)], "id int, target string, last_modified_epoch long")
    assert history.record_batch(rows).count() == 0 and history.record_batch(rows.limit(1)).count() == 1


def test_names_and_ages(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(names.name_parts(F.lit('a."b.c".d'))) == ["a", '"b.c"', "d"]
    assert get(names.canon_ident(F.lit('"x""Y"'))) == 'x"Y' and get(names.canon_ident(F.lit("ab"))) == "AB"
    assert get(names.mentions(F.lit("from My_T, u"), F.lit("my_t"))) and not get(names.mentions(F.lit("my_table"), F.lit("my_t")))
    assert get(names.warehouse_family(F.lit(" Spark , x"))) == "databricks"
    ages = {0: "a moment", 1000: "a second", 59_999: "59 seconds", 60_000: "a minute", 3_600_000: "an hour", 86_400_000: "a day", 31 * 86_400_000: "a month", 800 * 86_400_000: "2 years"}
    for ms, text in ages.items():
        assert get(display.humanize_ms(F.lit(ms).cast("long"))) == text
    assert get(display.relative_age(F.lit(150_000), F.lit(0), F.lit("databricks"))) == "2 minutes ago"
    assert get(display.relative_age(F.lit(150_000), F.lit(0), F.lit("snowflake"))) == "3 minutes ago"
