"""Replayed decisions against a sequential replay, diagnostics by scope, ordinals of a hot generation."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stillfresh.functions import display
from stillfresh.operators import audit, diagnose, evidence, scoring, tables, traces
from stillfresh.streaming import states

TRACE = (
    "file string, position long, method string, request_id string, target string, identity string, execution_type int, tables array<struct<name:string,epoch:long>>, "
    "tolerance_ms long, policy string, recorded_ms long, epoch long, variant string, stale boolean, description string"
)


def session(rng, file):
    names, rows, asked = [f"t{i}" for i in range(4)], [], []
    for p in range(160):
        if asked and rng.random() < 0.4:
            rows.append((file, p, "confirm", rng.choice((asked[-1], rng.choice(asked), "nobody")), None, None, None, None, None, None, None, rng.choice((None, *[p * 10] * 5)), None, None, None))
            continue
        target = rng.choice(names)
        ups = ["s1", names[names.index(target) - 1]] + ["s2"] * (rng.random() < 0.1)
        reads = [(n, rng.choice((None, *[p // 40 * 100] * 12, *[p * 10] * 2))) for n in ups]
        own = [(target, rng.choice((0, 0, 10, p * 10)))] if rng.random() < 0.9 else []
        method = "values" if rng.random() < 0.1 else "submit"
        variant = rng.choice(("build", "clone", "skip"))
        rows.append((file, p, method, f"r{p}", target, rng.choice(("a", "a", "a", "b")), rng.choice((1, 3, 7, 9)), [] if method == "values" else reads + own, rng.choice((0, 150, 10**6)), rng.choice(("any", "all")), p * 10, None, variant, rng.random() < 0.5, None))
        asked.append(f"r{p}")
    return rows


def sequential(rows):
    """The rule, call after call: position to (variant, stale, text)."""
    pending, builds, out = {}, {}, {}
    maker = lambda name, epoch: builds[name][1] if name in builds and builds[name][0] is not None and epoch is not None and epoch <= builds[name][0] else None
    for _, p, method, request, target, identity, kind, reads, tolerance, policy, now, epoch, variant, *_ in rows:
        if method == "confirm":
            if request in pending:
                target, identity, reads, makers = pending.pop(request)
                builds[target] = (epoch, identity, reads, makers)
            continue
        made = {n: maker(n, e) for n, e in reads if n != target}
        if method == "submit" and kind <= 7 and target in builds and builds[target][1] == identity and builds[target][0] is not None:
            built, _, then, makers = builds[target]
            own = dict(reads).get(target)
            if own is not None and own <= built:
                now_, then_ = ({n: e for n, e in r if n != target} for r in (reads, then))
                if now_.keys() != then_.keys():
                    out[p] = ("build", False, None)
                else:
                    drift = [e is None or then_[n] is None or e > then_[n] for n, e in now_.items()]
                    within = tolerance > 0 and now - built < tolerance
                    stale = any(drift) and (policy == "any" or all(drift))
                    noun = "snapshot" if kind == 7 else "model"
                    if any(made[n] != makers.get(n) for n in now_) or (stale and not within):
                        out[p] = ("build", False, None)
                    else:
                        both = kind == 7 or tolerance == 0 or now_ == then_
                        why = "both its query and its upstream data are up to date" if both else "its query is up to date and its data is within lag tolerance" if within else "its query is up to date and at least one upstream dependency is unchanged"
                        out[p] = ("skip", any(drift), f"{noun} was a no-op because {why}")
        if variant != "skip":
            pending[request] = (target, identity, reads, made)
    return out


def test_predictions_equal_a_sequential_replay(spark):
    rng = random.Random(7)
    files = {f: session(rng, f) for f in ("a", "b", "c")}
    rows = [r for f in files.values() for r in f]
    got = {(r.file, r.position): tuple(r.rule) for r in scoring.predictions(spark.createDataFrame(rows, TRACE)).collect()}
    want = {(f, p): v for f, r in files.items() for p, v in sequential(r).items()}
    assert got == want and {v[0] for v in want.values()} == {"build", "skip"}


def test_ordinals_of_a_hot_generation_in_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.choice("xyz"), i, rng.choice("pq"), rng.choice("uv"), rng.random() < 0.1) for i in range(300)]
    seen = spark.createDataFrame(rows, "generation string, relation string, seq long, schema_hash string, content_hash string, known_write boolean")
    clock, last, want = {}, {}, {}
    for g, r, i, s, c, known in rows:
        if known or last.get((g, r), (None,))[0] != (s, c):
            clock[g] = clock.get(g, 0) + 1
            last[g, r] = ((s, c), clock[g])
        want[i] = last[g, r][1]
    assert {r.seq: r.ordinal for r in evidence.assign_ordinals(seen).collect()} == want
    for i in range(3):
        seen.filter(F.col("seq").between(100 * i, 100 * i + 99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = states.stream_observations(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    run.awaitTermination()
    got = {(r.generation, r.relation): r.ordinal for r in states.last_observations(spark, f"{tmp_path}/out").collect()}
    assert got == {k: v[1] for k, v in last.items()}
    assert evidence.assign_ordinals(seen.limit(0)).isEmpty()


def test_diagnostics_stay_in_the_org(spark):
    execution = "id long, org_id string, family string, namespace string, target_key string, logic_hash string, namespace_hash string, execution_type int, last_modified_epoch long, confirmed_ms long, sourceless boolean"
    builds = [(1, "o1", "f", "", "other", "h", "n", 1, 5, 5, True), (2, "o2", "f", "", "t", "h", "n", 1, 5, 5, True)]
    log = spark.createDataFrame(builds, execution)
    asked = [(i, org, "f", None, "t", h, "n", kind, decision, "first_build", 6, 6, False, True) for i, (org, h, kind, decision) in enumerate((("o1", "h", 1, "build"), ("o2", "h", 1, "build"), ("o1", "h", 1, "skip"), ("o1", None, 1, "build"), ("o1", "h", 10, "build")))]
    decided = spark.createDataFrame(asked, "submission_id long, org_id string, family string, namespace string, target_key string, logic_hash string, namespace_hash string, execution_type int, decision string, reason string, skip_code int, clone_code int, has_candidate boolean, target_absent boolean")
    out = diagnose.diagnose(decided.withColumn("permitted", F.array(F.lit("other_target"))), log).orderBy("submission_id").collect()
    same = ("first_build", 6, 6)
    assert [(r.reason, r.skip_code, r.clone_code) for r in out] == [("existing_target_copy_disabled_diagnostic", 1, 10), same, same, same, ("first_build", 1, 3)]
    assert [r.decision for r in out] == [a[8] for a in asked]
    assert diagnose.diagnose(decided.limit(0).withColumn("permitted", F.array(F.lit("other_target"))), log).isEmpty()


def test_reason_codes_and_times(spark):
    n = spark.range(-1, 28).select("id", display.reason_code(F.col("id").cast("int")).alias("code")).withColumn("back", display.reason_number(F.col("code")))
    rows = n.collect()
    assert [r.back for r in rows] == [None, *range(27), None] and len({r.code for r in rows}) == 28
    given = ["2024-02-29 01:02:03.000004", "2024-02-29 01:02:03", "2023-02-29 01:02:03.000004", "", None]
    got = spark.createDataFrame([(g,) for g in given], "text string").select(display.micros(F.col("text"))).collect()
    assert [r[0] for r in got] == [1709168523000004, None, None, None, None]


def test_census_correlation_and_transitions(spark):
    trees = spark.createDataFrame([("m", "skip", "o", [("a", None), ("a", "b")]), ("m", "skip", None, None), ("s", "build", "o", [])], "kind string, decision string, origin string, lines array<struct<marker:string,badge:string>>")
    got = {(r.kind, r.measure, r.name): r.n for r in audit.tree_census(trees).collect()}
    assert got["m", "tree", ""] == 2 and got["m", "marker", "a"] == 2 and got["m", "badge", ""] == 1 and got["m", "empty", ""] == 1 and got[None, "empty", ""] == 2 and got[None, "origin", "o"] == 2
    calls = "fixture string, entry long, minted string, refers string, response string"
    expected = spark.createDataFrame([("f", 1, "r1", None, "x"), ("f", 2, None, "r1", "y")], calls)
    actual = spark.createDataFrame([("f", 1, "z9", None, "x"), ("f", 2, None, "z9", "y"), ("f", 3, None, "q", "y")], calls)
    assert [(r.minted, r.refers) for r in traces.correlate(expected, actual).orderBy("entry").collect()] == [("r1", None), (None, "r1"), (None, "q")]
    prev, sel = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c")], "k long, v string")
    kept = lambda before, after: sorted(map(tuple, tables.transition(prev, sel, before, after, ["k"]).collect()))
    assert kept("append", "merge") == [(1, "a"), (2, "c")] and kept("merge", "append") == [(1, "a"), (2, "b"), (2, "c")] and kept("append", "insert_overwrite") == [(1, "a"), (2, "c")]
    assert kept("append", "table") == kept("view", "append") == kept("table", "merge") == [(2, "c")]
