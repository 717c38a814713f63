"""Every shape from facts that call for it, and its tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillfresh.operators import shapes

ANSWER = "submission_id long, decision string, reason string, matched_id long, source_id long, skip_code int"
FACTS = "submission_id long, execution_type int, target_key string, source_key string, n_own int, reads string, same_upstreams boolean, has_current boolean, volatile boolean"
VERDICTS = "submission_id long, name string, n_now int, epoch long, recorded_epoch long, unprovable boolean, drifted boolean"
KIND = {"seed": 8, "test": 9, "model": 1}


def build(rows):
    """Answers, facts and verdicts of rows of SHAPES, each with what it needs and no more."""
    answers, facts, verdicts = [], [], []
    for i, (group, decision, reason, kinds, needs, _) in enumerate(rows):
        has = lambda n: n in needs  # noqa: E731, B023
        here = not has("absent") and "!over" not in needs
        answers.append((i, decision, reason, 7 if has("anchored") else None, 9 if has("equivalent") else None, 8 if has("older") else 6))
        facts.append((i, kinds[0] if kinds else KIND[group], "c.s.t", "c.p.t" if has("equivalent") else None, int(here), "A" if has("upstreams") or has("drifted") else "", has("same_upstreams"), has("over"), has("rendered")))
        if has("upstreams") or has("drifted"):
            verdicts += [(i, "A", 1, 90_000, 30_000, False, has("drifted")), (i, "B", 1, None, 30_000, True, True), (i, "GONE", None, None, 1, True, True)]
    return answers, facts, verdicts


def wanted(row):
    """The first row of the table that applies to what ``row`` was built from."""
    group, decision, reason, kinds, needs, _ = row
    facts = set(n for n in needs if n[0] != "!") | ({"upstreams"} if "drifted" in needs else set())
    kind = kinds[0] if kinds else KIND[group]
    for g, c, r, ks, ns, shape in shapes.SHAPES:
        if (g, c, r) == (group, decision, reason) and (not ks or kind in ks) and all((n in facts) if n[0] != "!" else (n[1:] not in facts) for n in ns):
            return shape
    return None


def test_every_shape(spark):
    answers, facts, verdicts = (spark.createDataFrame(x, s) for x, s in zip(build(shapes.SHAPES), (ANSWER, FACTS, VERDICTS), strict=True))
    shaped = shapes.with_shape(answers, facts, verdicts)
    got = {r.submission_id: r.shape for r in shaped.collect()}
    assert got == {i: wanted(row) for i, row in enumerate(shapes.SHAPES)}
    assert set(got.values()) == {s for *_, s in shapes.SHAPES} == set(shapes.SECTIONS)
    trees = {}
    for r in shapes.tree_rows(shaped, verdicts).collect():
        trees.setdefault(r.submission_id, []).append((tuple(r.path), r.text, r.marker, r.badge))
    for i, shape in got.items():
        tree = sorted(trees[i])
        assert [t[0] for t in tree if len(t[0]) == 1] == [(k,) for k in range(len(shapes.SECTIONS[shape]))]
        assert not any("{" in t[1] for t in tree)
    outdated = sorted(trees[next(i for i, s in got.items() if s == "upstream_outdated")])
    assert outdated[-2:] == [((2, 1, 0), "A changed a minute after the build read it", None, "OUTDATED"), ((2, 1, 1), "B", None, "OUTDATED")]


def test_what_no_row_names_has_no_tree(spark):
    answers = spark.createDataFrame([(1, "build", "incomplete_cached_test_results", None, None, 6), (2, "skip", "reused_within_lag_tolerance", None, None, None)], ANSWER)
    facts = spark.createDataFrame([(1, 9, "t", None, 0, "", False, True, False), (2, 8, "t", None, 1, "", False, True, False)], FACTS)
    verdicts = spark.createDataFrame([], VERDICTS)
    shaped = shapes.with_shape(answers, facts, verdicts)
    assert shaped.isEmpty() and shapes.tree_rows(shaped.select("*", F.lit("x").alias("y")), verdicts).isEmpty()
