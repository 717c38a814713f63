"""Texts for people: ages, run times, codes and descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers of execution kinds and decisions.
KINDS = ("unspecified", "full", "append", "merge", "delete_insert", "microbatch", "insert_overwrite", "snapshot", "values", "data_test", "view", "custom")
DECISIONS = ("unspecified", "build", "skip", "clone")
SNAPSHOT, SEED, TEST, VIEW = 7, 8, 9, 10

# Stored codes of decision reasons, by number.
REASONS = (
    "first_build", "existing_target_without_history", "data_test_existing_target_without_history", "query_observed_outside_scope",
    "query_changed_outside_scope", "existing_target_copy_disabled_diagnostic", "no_reuse_candidate.identity_mismatch",
    "no_reuse_candidate.resolution_context_changed", "no_reuse_candidate.input_binding_changed", "no_reuse_candidate.execution_type_changed",
    "no_reuse_candidate.upstream_names_changed", "no_reuse_candidate.copy_logic_mismatch", "no_reuse_candidate.failed_reuse_qualification",
    "no_reuse_candidate.own_target_changed_or_missing", "no_reuse_candidate.own_target_modified", "no_reuse_candidate.own_target_missing",
    "no_reuse_candidate.incomplete_cached_test_results", "dependency_set_changed", "no_build_anchor", "upstream_outdated",
    "upstream_query_changed", "reused.fresh", "reused.tolerated_stale", "reused.within_lag_tolerance", "result_copy", "copy_chain_limit", "copy_disabled",
)


def humanize_ms(ms: Column) -> Column:
    """A duration in whole units, rounded down; months are 30.5 days, rounded to the nearest."""
    s = F.expr("0").cast("long") + F.floor(F.greatest(ms, F.lit(0)) / 1000)
    days = F.floor(s / 86400)

    def some(n: Column, one: str, unit: str) -> Column:
        return F.when(n == 1, one).otherwise(F.concat(n.cast("long").cast("string"), F.lit(" " + unit)))

    return (
        F.when(s == 0, "a moment")
        .when(s < 60, some(s, "a second", "seconds"))
        .when(s < 3600, some(F.floor(s / 60), "a minute", "minutes"))
        .when(days == 0, some(F.floor(s / 3600), "an hour", "hours"))
        .when(days < 31, some(days, "a day", "days"))
        .when(days < 365, some(F.floor(days / 30.5 + 0.5), "a month", "months"))
        .otherwise(some(F.floor(days / 365), "a year", "years"))
    )


def relative_age(now_ms: Column, then_ms: Column, family: Column) -> Column:
    """Age with minutes rounded (half up; half to even on databricks, there hours too)."""
    age = F.greatest(now_ms - then_ms, F.lit(0))
    s = F.floor(age / 1000)
    lake = family == "databricks"
    even = lambda unit: F.bround(s / F.lit(float(unit))) * (unit * 1000)
    rounded = (
        F.when(lake & age.between(3_600_000, 86_399_999), even(3600))
        .when(age.between(60_000, 3_599_999), F.when(lake, even(60)).otherwise(F.floor((s + 30) / 60) * 60_000))
        .otherwise(age)
    )
    return F.when(age < 1000, "now").otherwise(F.concat(F.transform(F.array(rounded), humanize_ms)[0], F.lit(" ago")))  # an array, so that the rounded age is worked out once


def utc_text(ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def micros_text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def micros(text: Column) -> Column:
    """Microseconds of a UTC time text; NULL unless :func:`micros_text` gives the same text back."""
    us = F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return F.when(micros_text(us) == text, us)


def fmt_runtime(ms: Column) -> Column:
    return F.when(ms >= 1000, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s"))).when(ms.isNotNull(), F.concat(ms.cast("string"), F.lit("ms"))).otherwise("—")


def kind_name(kind: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, KINDS)), kind), F.lit("unknown"))


def decision_name(decision: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, DECISIONS)), decision), F.lit("unknown"))


def reason_code(number: Column) -> Column:
    """The stored code of a reason's number; NULL for numbers that name none."""
    return F.get(F.array(*map(F.lit, REASONS)), number)


def reason_number(code: Column) -> Column:
    """The number of a stored code; NULL for any other text."""
    place = F.array_position(F.array(*map(F.lit, REASONS)), code)
    return F.when(place > 0, place - 1)


def node_noun(kind: Column) -> Column:
    return F.when(kind == SNAPSHOT, "snapshot").when(kind == TEST, "data test").when(kind == SEED, "seed").otherwise("model")


def skip_description(kind: Column, tolerance_ms: Column, unchanged: Column, within_lag: Column) -> Column:
    """Why a node was reused."""
    lead = F.concat(node_noun(kind), F.lit(" was a no-op because "))
    return (
        F.when(kind == SEED, "seed was a no-op because its data has not changed")
        .when((kind == SNAPSHOT) | (tolerance_ms == 0) | unchanged, F.concat(lead, F.lit("both its query and its upstream data are up to date")))
        .when(within_lag, F.concat(lead, F.lit("its query is up to date and its data is within lag tolerance")))
        .otherwise(F.concat(lead, F.lit("its query is up to date and at least one upstream dependency is unchanged")))
    )


def execute_description(kind: Column, had_prior: Column, own_target_modified: Column) -> Column:
    """Why a node was built."""
    noun = node_noun(kind)
    return (
        F.when(own_target_modified & (kind == VIEW), "model was executed because the view definition is newer than the cached execution")
        .when(own_target_modified, F.concat(noun, F.lit(" was executed because the table was modified after the cached execution")))
        .when((kind == SEED) & ~had_prior, "seed was loaded because it did not exist")
        .when(kind == SEED, "seed was loaded because its data changed")
        .when(kind == TEST, "data test was executed because it has no prior execution or its query changed")
        .when(~had_prior, F.concat(noun, F.lit(" was executed because its table did not exist")))
        .otherwise(F.concat(noun, F.lit(" was executed because either its query didn't match or its upstream data is out of date")))
    )


def reuse_rate(reused: Column, total: Column) -> Column:
    """Percent of reused decisions, rounded half up; 0 when there are none."""
    return F.when(total > 0, F.floor(100.0 * reused / total + 0.5)).otherwise(0).cast("long")
