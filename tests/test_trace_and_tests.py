"""Bad lines by file and number, and many data tests from one scan."""

from __future__ import annotations

import json

import pytest

from stillfresh.operators import audit
from stillfresh.sources import tables as sources


def test_a_bad_line_in_a_later_split(spark, tmp_path):
    good = json.dumps({"service": "s", "method": "m", "request": "x" * 50})
    first, second = [good] * 400, [good] * 300
    second[287], second[5] = '{"service": ', ""
    (tmp_path / "a.jsonl").write_text("\n".join(first) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(second) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        found = sources.bad_lines(spark, str(tmp_path), sources.TRACE).collect()
        assert [(r.file.rsplit("/", 1)[1], r.line, r.text) for r in found] == [("b.jsonl", 288, '{"service": ')]
        with pytest.raises(ValueError, match=r"b\.jsonl, line 288"):
            sources.read_trace(spark, str(tmp_path))
        (tmp_path / "b.jsonl").unlink()
        assert sources.read_trace(spark, str(tmp_path)).count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_tests_in_one_scan(spark, tmp_path):
    spark.range(500).selectExpr("id", "IF(id % 9 = 0, NULL, id % 13) AS n", "'x' AS test").write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    tests = [audit.DataTest(f"t{i}", f"n = {i} OR id < {i}", "count(*)" if i % 3 else "sum(n)", f"> {i * 3}", "> 2", "error" if i % 4 else "warn") for i in range(50)]
    plain = audit.run_tests(rows, tests)
    assert plain._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    stored = audit.run_tests(rows, tests, f"{tmp_path}/out")
    want = {}
    for t in tests:
        r = audit.test_outcome(rows.filter(t.failing), t.fail_calc, t.error_if, t.warn_if, t.severity).first()
        want[t.name] = (r.failures, bool(r.should_error), bool(r.should_warn), "pass" if r.failures is None else r.status)
    for got in (plain, stored):
        assert {r.test: tuple(r)[1:] for r in got.collect()} == want
    kept = spark.read.parquet(f"{tmp_path}/out")
    for t in (tests[0], tests[7], tests[49]):
        assert sorted(r.id for r in kept.filter(f"test_ = '{t.name}'").collect()) == sorted(r.id for r in rows.filter(t.failing).collect())
    assert {r.status for r in audit.run_tests(rows.limit(0), tests).collect()} == {"pass"}
