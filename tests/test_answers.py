"""Single submissions whose answer follows from a few rows of history, and that stages don't lose any."""

from __future__ import annotations

import pytest

from stillfresh.operators import answers, copies, evidence

SUBS = "submission_id long, org_id string, family string, namespace string, target_key string, execution_type int, node_uid string, project string, sql string, sql_hash string, text_hash string, root string, template_hash string, compare_template boolean, body_hash string, namespace_hash string, values_hash string, evaluation_requested boolean, ignore_external boolean, policy string, tolerance_ms long, now_ms long, allow_clones boolean, chain_limit int"
RUNS = "id long, org_id string, family string, namespace string, target_key string, execution_type int, node_uid string, project string, sql_hash string, text_hash string, root string, template_hash string, namespace_hash string, values_hash string, last_modified_epoch long, created_ms long, confirmed_ms long, source_key string, source_epoch long, published boolean, table_type string, failures double, should_error boolean, should_warn boolean"
INPUTS, RECORDED = "submission_id long, name string, epoch long, producer string", "execution_id long, name string, epoch long, producer string"
DEV, PROD, RAW = "cdo.dev.orders", "cdo.prod.orders", "cdo.raw.orders"


def names_of(schema):
    return [f.split()[0] for f in schema.split(", ")]


def sub(**k):
    row = dict(submission_id=1, org_id="o", family="snowflake", namespace="ns", target_key=DEV, execution_type=1, node_uid="m", project="p", sql="select 1", sql_hash="dev", text_hash="t", root="r", compare_template=False, body_hash="b", namespace_hash="ns1", evaluation_requested=False, ignore_external=False, policy="any", tolerance_ms=0, now_ms=10_000)
    return tuple((row | k).get(n) for n in names_of(SUBS))


def run(**k):
    row = dict(id=7, org_id="o", family="snowflake", namespace="ns", target_key=PROD, execution_type=1, node_uid="m", project="p", sql_hash="prod", text_hash="t", root="r", namespace_hash="ns1", last_modified_epoch=9_000, created_ms=8_900, confirmed_ms=9_100, table_type="TABLE")
    return tuple((row | k).get(n) for n in names_of(RUNS))


def read(at, epoch, name=RAW, producer="none"):
    return (at, name, epoch, producer)


def settle(spark, subs, inputs, runs, recorded, readings=()):
    e = answers.Evidence(
        spark.createDataFrame(subs, SUBS), spark.createDataFrame(inputs, INPUTS), spark.createDataFrame([], "submission_id long, name string, query string"),
        spark.createDataFrame(list(readings), "submission_id long, hash string, schema string, reads string"), spark.createDataFrame(runs, RUNS), spark.createDataFrame(recorded, RECORDED),
    )
    return {r.submission_id: (r.decision, r.reason, r.source_id, r.skip_code, r.clone_code) for r in answers.answer(e).collect()}


def test_search_for_equivalents(spark):
    """Many independent cases in one batch, each in an org of its own."""
    cases = {
        "fresh_elsewhere": ([sub()], [read(1, 200)], [run()], [read(7, 200)], ("clone", "result_copy", 7, 1, None)),
        "stale_then_older": ([sub()], [read(1, 200)], [run(), run(id=8, target_key="cdo.qa.orders", last_modified_epoch=8_000)], [read(7, 100), read(8, 200)], ("clone", "result_copy", 8, 1, None)),
        "stale_then_other_environment": ([sub()], [read(1, 200)], [run(), run(id=8, target_key="cdo.qa.orders", last_modified_epoch=8_000)], [read(7, 100), read(8, 50, "cdo.raw_ci.orders")], ("build", "first_build", None, 6, 6)),
        "other_environment_unjudged": ([sub()], [read(1, 200)], [run()], [read(7, 50, "cdo.raw_ci.orders")], ("clone", "result_copy", 7, 1, None)),
        "not_over_an_existing_target": ([sub()], [read(1, 200), read(1, 8_500, DEV)], [run(), run(id=6, target_key=DEV, sql_hash="dev", last_modified_epoch=8_500)], [read(7, 50, "cdo.raw_ci.orders"), read(6, 100)], ("build", "upstream_outdated", None, 6, 6)),
        "over_a_stale_target": ([sub()], [read(1, 200), read(1, 8_500, DEV)], [run(), run(id=6, target_key=DEV, sql_hash="dev", last_modified_epoch=8_500)], [read(7, 200), read(6, 100)], ("clone", "result_copy", 7, 1, None)),
        "modified_target_builds": ([sub()], [read(1, 200), read(1, 8_600, DEV)], [run(), run(id=6, target_key=DEV, sql_hash="dev", last_modified_epoch=8_500)], [read(7, 200), read(6, 200)], ("build", "own_target_modified", None, 6, 6)),
        "skip": ([sub()], [read(1, 200), read(1, 8_500, DEV)], [run(id=6, target_key=DEV, sql_hash="dev", last_modified_epoch=8_500)], [read(6, 200)], ("skip", "reused_fresh", None, None, None)),
        "copies_disabled": ([sub(allow_clones=False)], [read(1, 200)], [run()], [read(7, 200)], ("build", "copy_disabled", 7, 1, 10)),
        "chain_limit": ([sub(chain_limit=0)], [read(1, 200)], [run()], [read(7, 200)], ("build", "copy_chain_limit", 7, 1, 10)),
        "kind_not_copied": ([sub(execution_type=10)], [read(1, 200)], [run(execution_type=10, table_type="VIEW")], [read(7, 200)], ("build", "first_build", 7, 1, 3)),
        "other_kind_elsewhere": ([sub(execution_type=3)], [read(1, 200)], [run()], [read(7, 200)], ("build", "first_build", 7, 1, 2)),
        "volatile": ([sub(sql="select now()", evaluation_requested=True)], [read(1, 200)], [run()], [read(7, 200)], ("build", "first_build", None, 6, 6)),
        "overwritten_source": ([sub()], [read(1, 200)], [run(), run(id=9, namespace_hash="other", last_modified_epoch=9_500)], [read(7, 200)], ("build", "first_build", None, 6, 6)),
        "unknown_epoch_hides": ([sub()], [read(1, 200)], [run(), run(id=9, last_modified_epoch=None)], [read(7, 200)], ("build", "first_build", None, 6, 6)),
        "pending_write_on_databricks": ([sub(family="databricks", allow_clones=True, chain_limit=1)], [read(1, 200)], [run(family="databricks"), run(id=9, family="databricks", confirmed_ms=None)], [read(7, 200)], ("build", "first_build", None, 6, 6)),
        "exact_on_databricks": ([sub(family="databricks", allow_clones=True, chain_limit=1)], [read(1, 200)], [run(family="databricks")], [read(7, 200)], ("clone", "result_copy", 7, 1, None)),
        "older_epoch_on_databricks": ([sub(family="databricks", allow_clones=True, chain_limit=1)], [read(1, 200)], [run(family="databricks")], [read(7, 201)], ("build", "first_build", None, 6, 6)),
        "rehomed": ([sub(namespace_hash="of_dev")], [read(1, 200, "cdo.dev.raw")], [run(namespace_hash="of_prod")], [read(7, 50, "cdo.prod.raw")], ("clone", "result_copy", 7, 1, None)),
        "seed_elsewhere": ([sub(execution_type=8, sql_hash="seed", values_hash="v")], [], [run(execution_type=8, sql_hash="seed", values_hash="v")], [], ("clone", "result_copy", 7, 1, None)),
        "seed_of_another_name": ([sub(execution_type=8, sql_hash="seed", values_hash="v")], [], [run(execution_type=8, sql_hash="seed", values_hash="v", target_key="cdo.prod.other")], [], ("build", "first_build", None, 6, 6)),
        "older_build_serves": ([sub()], [read(1, 200), read(1, 9_000, DEV)], [run(target_key=DEV, sql_hash="else", text_hash="u", namespace_hash="other"), run(id=6, target_key=DEV, sql_hash="dev", last_modified_epoch=8_500)], [read(6, 200)], ("build", "identity_mismatch", None, 8, 7)),
        "kind_changed_back": ([sub()], [read(1, 200), read(1, 9_000, DEV)], [run(target_key=DEV, sql_hash="dev", execution_type=3), run(id=6, target_key=DEV, sql_hash="dev", last_modified_epoch=8_500)], [read(6, 200), read(7, 200)], ("build", "own_target_modified", None, 6, 6)),
        "deep_copy_on_duckdb": (
            [sub(family="duckdb")], [read(1, 200)],
            [run(id=1, family="duckdb", target_key="cdo.a.orders", created_ms=10, confirmed_ms=20, namespace_hash="x")]
            + [run(id=i, family="duckdb", target_key=f"cdo.{t}.orders", source_key=f"cdo.{s}.orders", created_ms=10 * i + 15, confirmed_ms=10 * i + 20, namespace_hash="ns1" if t == "d" else "x") for i, s, t in ((2, "a", "b"), (3, "b", "c"), (4, "c", "d"))],
            [read(4, 200)], ("build", "first_build", None, 6, 6),
        ),
    }
    subs, inputs, runs, recorded, want = [], [], [], [], {}
    for k, (s, i, r, rec, answer) in enumerate(cases.values()):
        at = lambda row, place, value: (*row[:place], value, *row[place + 1 :])
        subs += [at(at(x, 0, k), 1, f"o{k}") for x in s]
        inputs += [at(x, 0, k) for x in i]
        runs += [at(at(x, 0, 100 * k + x[0]), 1, f"o{k}") for x in r]
        recorded += [at(x, 0, 100 * k + x[0]) for x in rec]
        want[k] = (answer[0], answer[1], None if answer[2] is None else 100 * k + answer[2], *answer[3:])
    names = list(cases)
    readings = [(names.index("rehomed"), "of_prod", "prod", "CDO.PROD.RAW")]
    got = settle(spark, subs, inputs, runs, recorded, readings)
    assert {names[k]: v for k, v in got.items()} == {names[k]: v for k, v in want.items()}


@pytest.mark.parametrize("runs", [[], [run(org_id="another")]])
def test_nothing_recorded(spark, runs):
    assert settle(spark, [sub()], [read(1, None)], runs, []) == {1: ("build", "first_build", None, 6, 6)}
    assert settle(spark, [], [], runs, []) == {}


def test_copies_of_copies(spark):
    """Chains of eleven copies: what each takes over is found by following them one by one."""
    rows, n = [], 0
    for c in range(6):  # chains that share nothing but names in other orgs
        for i in range(12):
            n += 1
            kind = "build" if i == 0 else "submitted" if (c == 1 and i == 6) else "registered"
            confirmed = None if (c == 2 and i == 4) else n * 10 + 5
            rows.append((n, f"o{c}", "snowflake", None if c % 2 else "", f"t{i}", f"t{i - 1}" if i else None, None if kind == "registered" else "s", f"ns{c}.{i}", 100 * c + i if (i % 4 == c % 4 or i == 0) else None, n * 10, confirmed))
    schema = "id long, org_id string, family string, namespace string, target_key string, source_key string, sql_hash string, namespace_hash string, runtime_ms long, created_ms long, confirmed_ms long"
    recorded = [(r[0], x) for r in rows for x in (f"raw{r[0] % 3}", "raw", r[4]) if r[6] is not None]
    by_id = {r[0]: r for r in rows}
    state = lambda org, key, before: max((r for r in rows if r[1] == org and r[4] == key and r[10] is not None and r[0] < before), key=lambda r: (r[10], r[0]), default=None)
    want = {}
    for r in rows:
        if r[5] is not None and r[6] is None:
            at, depth, run = r, 0, None
            while at is not None and at[5] is not None and at[6] is None:
                run, depth, at = at[8] if run is None else run, depth + 1, state(at[1], at[5], at[0])
            inputs = None if at is None else ",".join(sorted({x for i, x in recorded if i == at[0]} - {at[4]}))
            want[r[0]] = (at and at[0], depth, at and at[7], run if run is not None else at and at[8], inputs)
    got = copies.inherited(spark.createDataFrame(rows, schema), spark.createDataFrame(recorded, "execution_id long, name string"))
    assert {r.id: tuple(r)[1:] for r in got.collect()} == want
    assert max(d for _, d, *_ in want.values()) == 11 and any(root is None for root, *_ in want.values()) and by_id
    assert copies.inherited(spark.createDataFrame([], schema), spark.createDataFrame([], "execution_id long, name string")).isEmpty()


def test_a_refused_copy_is_told_from_an_empty_one(spark):
    rows, none = spark.range(5), spark.range(0)
    done = []
    assert copies.copy_into(rows, evidence.content_digest(rows), lambda df: done.append(df.count())) == 5 and done == [5]
    assert copies.copy_into(none, evidence.content_digest(none), lambda df: done.append(df.count())) == 0 and done == [5, 0]
    for source, recorded in ((rows, none), (none, rows)):
        with pytest.raises(ValueError, match="nothing was copied"):
            copies.copy_into(source, evidence.content_digest(recorded), lambda df: done.append("written"))
    assert done == [5, 0]
