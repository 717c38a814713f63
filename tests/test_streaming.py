"""Streams give what their batch twins give, in any order of arrival."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import functions as F

from stillfresh.operators import audit, history
from stillfresh.plans.fixtures import fixture
from stillfresh.streaming import states

SF = "/root/testdata/sf0.001"


def as_stream(spark, df, folder):
    df.repartition(3).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(map(str, df.collect()))


def test_current_state_out_of_order(spark, tmp_path):
    log = fixture(spark, SF, "executions").filter("confirmed_ms IS NOT NULL")
    again = log.unionByName(log.filter("id % 5 = 0")).orderBy(F.rand(3))
    q = states.stream_current_state(as_stream(spark, again, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    last = states.last_rows(spark, f"{tmp_path}/out", list(history.SCOPE))
    want = history.current_state(log)
    assert rows(last.select("id", "target_key")) == rows(want.select("id", "target_key"))


def test_first_confirm_and_node_state(spark, tmp_path):
    log = fixture(spark, SF, "executions")
    confirms = log.select("id", F.col("node_uid").alias("request_id"), (F.col("id") * 7 % 1000).alias("arrival"), F.col("id").alias("confirm_id"))
    q = states.stream_first_confirm(as_stream(spark, confirms, f"{tmp_path}/a"), f"{tmp_path}/b", f"{tmp_path}/c")
    q.awaitTermination()
    assert rows(states.last_rows(spark, f"{tmp_path}/b", ["request_id"]).select("request_id", "confirm_id")) == rows(history.first_confirm(confirms).select("request_id", "confirm_id"))
    state = log.select("org_id", "node_uid", "id")
    q = states.stream_node_state(as_stream(spark, state, f"{tmp_path}/d"), f"{tmp_path}/e", f"{tmp_path}/f", ["org_id", "node_uid"], "id")
    q.awaitTermination()
    assert rows(states.last_rows(spark, f"{tmp_path}/e", ["org_id", "node_uid"])) == rows(state.groupBy("org_id", "node_uid").agg(F.max("id").alias("id")))


def test_counts(spark, tmp_path):
    decisions = fixture(spark, SF, "decisions").withColumn("created_at", F.col("created_at").cast("timestamp"))
    stream = as_stream(spark, decisions, f"{tmp_path}/in")
    q = states.invocation_counts(stream).writeStream.outputMode("complete").format("memory").queryName("inv").trigger(availableNow=True).start()
    q.awaitTermination()
    want = decisions.withColumn("session", F.lit("")).filter("invocation <> ''").transform(audit.invocation_counts)
    assert rows(spark.table("inv").filter("invocation <> ''").select(want.columns)) == rows(want)
    q = states.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    day = audit.daily_activity(decisions, "2020-01-01")
    assert rows(spark.table("days").select(F.to_date("day").alias("day"), "built", "reused")) == rows(day)


PENDING, CONFIRM = "org_id string, request_id string, target string, confirmed_ms long, at timestamp", "org_id string, request_id string, confirm_id long, arrival long, epoch long, at timestamp"


def two_streams(spark, tmp_path, batches):
    """Streams of pending rows and confirmations, a file of each for every (pending, confirms) of ``batches``."""
    clock = lambda s: datetime.datetime.fromtimestamp(s, datetime.UTC)
    for pending, confirms in batches:
        spark.createDataFrame([("o", r, t, d, clock(s)) for r, t, d, s in pending], PENDING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/pending")
        spark.createDataFrame([("o", r, c, a, e, clock(s)) for r, c, a, e, s in confirms], CONFIRM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/confirms")
    read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    return read(PENDING, "pending"), read(CONFIRM, "confirms")


def test_confirms_before_with_and_after_their_pending_rows(spark, tmp_path):
    batches = [
        ([("with", "t", None, 10), ("after", "t", None, 10), ("none", "", None, 10)], [("with", 1, 1, 100, 11), ("before", 2, 1, 200, 11), ("before", 3, 0, None, 12), ("never", 4, 1, 100, 12)]),
        ([("before", "t", None, 20), ("done", "t", 5, 20)], [("with", 5, 0, 300, 21), ("none", 6, 1, 7, 21), ("done", 7, 1, 7, 21)]),
        ([("far", "t", None, 90_000)], [("none", 8, 2, None, 90_000), ("far", 9, 1, 1, 90_001)]),
        ([], [("after", 10, 1, 400, 90_002), ("unknown", 11, 1, 1, 15)]),  # long after its pending row; long after the watermark
        ([("unknown", "t", None, 90_003)], [("unknown", 12, 1, 2, 90_003), ("before", 13, 9, 5, 90_003)]),
    ]
    pending, confirms = two_streams(spark, tmp_path, batches)
    q = states.stream_confirm(pending, confirms, f"{tmp_path}/out", f"{tmp_path}/cp", "1 hour")
    q.awaitTermination()
    got = {r.confirm_id: (r.outcome, r.epoch) for r in states.outcomes(spark, f"{tmp_path}/out").collect()}
    assert got == {
        1: ("published", 100), 2: ("published", 200), 3: ("invalid", None), 4: ("missing", 100), 5: ("already_confirmed", 300), 6: ("invalid", 7), 7: ("already_confirmed", 7),
        8: ("published", None), 9: ("published", 1), 10: ("published", 400), 12: ("published", 2), 13: ("already_confirmed", 5),
    }
    assert [(r.confirm_id, r.request_id) for r in states.late_rows(spark, f"{tmp_path}/out").collect()] == [(11, "unknown")]
    again = states.stream_confirm(pending, confirms, f"{tmp_path}/out", f"{tmp_path}/cp", "1 hour")  # nothing new: nothing changes
    again.awaitTermination()
    assert {r.confirm_id: (r.outcome, r.epoch) for r in states.outcomes(spark, f"{tmp_path}/out").collect()} == got


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = [("g", f"r{i % 7}", i, "s", f"c{i // 40}", i % 31 == 0) for i in range(300)]
    seen = spark.createDataFrame(rows, "generation string, relation string, seq long, schema_hash string, content_hash string, known_write boolean")
    for i in range(3):
        seen.filter(F.floor(F.col("seq") / 100) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    states.stream_observations(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    want = rows_of = sorted(map(str, states.last_observations(spark, f"{tmp_path}/out").collect()))
    commits = f"{tmp_path}/cp/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # the driver was lost after the batch's writes, before its commit
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    states.stream_observations(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(str, states.last_observations(spark, f"{tmp_path}/out").collect())) == want == rows_of
    written = {r.b: r["count"] for r in spark.read.parquet(f"{tmp_path}/out/seen").groupBy("b").count().collect()}
    assert all(n == 100 for n in written.values()) and len(written) == 3
