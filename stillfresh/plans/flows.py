"""Registered queries of sources, sinks and streams, each with its SQL twin.

Rows are written to the shared folder first, so that what is read back has gone through the
format; streams read one file a micro-batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audit, evidence, history, tables
from ..sources import tables as sources
from ..streaming import states
from .queries import BUILT, CONFIRMS, CURRENT, RANKED, confirms, query

QUOTE = "chr(39)"


def reread(df: DataFrame, write: Callable, read: Callable) -> DataFrame:
    path = sources.shared_folder(df.sparkSession, "flow")
    write(df, path)
    return read(path)


def stream_of(df: DataFrame, files: int = 3) -> DataFrame:
    """``df`` as a stream of as many micro-batches as files."""
    path = sources.shared_folder(df.sparkSession, "stream")
    df.repartition(files).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ran(start: Callable, stream: DataFrame) -> str:
    """The folder that a stream has logged to when its input is used up."""
    path = sources.shared_folder(stream.sparkSession, "state")
    start(stream, path, sources.shared_folder(stream.sparkSession, "progress")).awaitTermination()
    return path


def last_counts(counts: DataFrame) -> DataFrame:
    """The counts that a stream in complete mode gives when its input is used up."""
    spark = counts.sparkSession
    path = sources.shared_folder(spark, "counts")
    run = counts.writeStream.outputMode("complete").option("checkpointLocation", sources.shared_folder(spark, "progress"))
    run = run.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/v={number}")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/v={run.lastProgress['batchId']}")


# --- sources and sinks ------------------------------------------------------------------------


@query("a12_write_result", "SELECT k, part, name, n FROM prev WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.part IS NOT DISTINCT FROM prev.part AND sel.k % 5 = 0) UNION ALL SELECT k, part, name, n FROM sel WHERE k % 5 = 0 UNION ALL SELECT k, part, name, n FROM sel WHERE k % 5 = 1")
def _(t):
    relation = f"result_{uuid.uuid4().hex}"
    cut = lambda df: df.select("k", "part", "name", "n")
    sources.write_result(cut(t("prev")), relation, "table", ("part",))
    sources.write_result(cut(t("sel").filter("k % 5 = 0")), relation, "incremental")
    sources.write_result(cut(t("sel").filter("k % 5 = 1")), relation, "append")
    spark = t("prev").sparkSession
    sources.write_result(spark.table(relation), f"{relation}_view", "view")
    return spark.table(f"{relation}_view").select("k", "part", "name", "n")


@query("a1_read_executions", "SELECT id, target, namespace, confirmed_ms, true AS no_inputs FROM raw_executions")
def _(t):
    old = t("raw_executions").drop("project", "environment", "runtime_ms")
    log = reread(old, lambda d, p: d.write.parquet(p), lambda p: sources.read_executions(old.sparkSession, p))
    return log.select("id", "target", "namespace", "confirmed_ms", (F.col("inputs").isNull() & F.col("results").isNull()).alias("no_inputs"))


@query("a2_append_pending", "SELECT id, request_id, strftime(make_timestamp(created_ms * 1000), '%Y-%m-01') AS day FROM executions")
def _(t):
    e = t("executions").select("id", "request_id", "created_ms")
    day = F.trunc(F.timestamp_millis("created_ms"), "month")  # old logs are kept by month

    def twice(d, path):
        sources.append_log(d.filter("id % 2 = 0"), path, day)
        sources.append_log(d.filter("id % 2 <> 0"), path, day)

    return reread(e, twice, e.sparkSession.read.parquet).select("id", "request_id", F.col("day").cast("string").alias("day"))


@query("a9_append_decisions", f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, {BUILT} AS built FROM decisions GROUP BY 1")
def _(t):
    d = t("decisions")
    log = reread(d, lambda x, p: sources.append_log(x, p, F.to_date("created_at")), d.sparkSession.read.parquet)
    return log.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "build").alias("built"))


@query("a6_read_trace", "SELECT event_type AS method, 'r' || event_id AS request, 'k' || user_id AS header, true AS has_file FROM events")
def _(t):
    calls = t("events").select(
        F.lit("cache").alias("service"), F.col("event_type").alias("method"), F.col("ts").cast("string").alias("recorded_at"),
        F.array(F.array(F.lit("key"), F.concat(F.lit("k"), F.col("user_id").cast("string")))).alias("metadata"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request"), F.lit(None).cast("string").alias("response"),
    )
    trace = reread(calls, lambda d, p: d.write.json(p), lambda p: sources.read_trace(calls.sparkSession, p))
    return trace.select("method", "request", F.col("metadata")[0][1].alias("header"), F.endswith("file", F.lit(".json")).alias("has_file"))


@query("a6_bad_lines", "SELECT count(*) AS bad, CAST(sum(line) AS BIGINT) AS places FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS line FROM events) WHERE event_id % 7 = 3")
def _(t):
    spark = t("events").sparkSession
    text = F.when(F.expr("event_id % 7 = 3"), F.concat(F.lit("{"), F.col("event_type"))).otherwise(F.to_json(F.struct(F.col("event_type").alias("method"))))
    path = sources.shared_folder(spark, "flow")
    t("events").select("event_id", text.alias("value")).repartitionByRange(1, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")  # many splits of one file
    try:
        found = sources.written(sources.bad_lines(spark, path, sources.TRACE))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return found.agg(F.count(F.lit(1)).alias("bad"), F.sum("line").alias("places"))


TESTS = [audit.DataTest(f"t{i}", f"o_orderkey % {i + 3} = 0 AND o_totalprice > {i * 9000}", "count(*)" if i % 2 else "sum(o_custkey)", f"> {i * 100}", "> 0", "error" if i % 3 else "warn") for i in range(50)]


@query(
    "m6_run_tests",
    " UNION ALL ".join(
        f"SELECT '{x.name}' AS test, CAST(f AS BIGINT) AS failures, coalesce(f {x.error_if}, false) AS should_error, coalesce(f {x.warn_if}, false) AS should_warn, CASE WHEN {str(x.severity == 'error').lower()} AND coalesce(f {x.error_if}, false) THEN 'fail' WHEN coalesce(f {x.warn_if}, false) THEN 'warn' ELSE 'pass' END AS status FROM (SELECT {x.fail_calc} AS f FROM orders WHERE {x.failing})"
        for x in TESTS
    ),
)
def _(t):
    return audit.run_tests(t("orders"), TESTS, sources.shared_folder(t("orders").sparkSession, "failures"))


@query(
    "a7_read_seed",
    f"""SELECT k, name, day FROM (SELECT c_custkey AS k, c_mktsegment || ';' || {QUOTE} || 'x' AS name, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 50 END AS day FROM customer)
        UNION ALL SELECT c_custkey, c_mktsegment || ';' || {QUOTE} || 'x', CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 50 END FROM customer WHERE c_custkey % 10 = 0""",
)
def _(t):
    rows = t("customer").select(F.col("c_custkey").alias("k"), F.concat("c_mktsegment", F.lit(";'x")).alias("name"), F.expr("IF(c_custkey % 5 > 0, c_custkey % 50, NULL)").alias("day"))
    rows = rows.unionByName(rows.filter("k % 10 = 0"))  # duplicates stay
    write = lambda d, p: d.write.csv(p, header=True, sep=";", quote="'", escape="'")
    return reread(rows, write, lambda p: sources.read_seed(rows.sparkSession, p, rows.schema, ";", "'"))


@query("k9_seed", "SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS BIGINT) AS n, CAST(c_custkey / 4 AS DECIMAL(12, 2))::DOUBLE AS price FROM customer")
def _(t):
    texts = t("customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_nationkey").cast("string").alias("n"), (F.col("c_custkey") / 4).cast("string").alias("price"))
    wanted = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("price", T.DecimalType(12, 2))])
    seed = tables.build_seed(texts, wanted)
    return seed.withColumn("price", F.col("price").cast("double"))


@query("k10_view", "SELECT day, count(*) AS n FROM prev WHERE name IS NOT NULL GROUP BY 1")
def _(t):
    view = tables.build_view("stillfresh_days", t("prev").filter("name IS NOT NULL").groupBy("day").agg(F.count(F.lit(1)).alias("n")))
    return view


@query("k12_transition_chain", "SELECT k, part, name, n, day FROM sel UNION ALL SELECT k, part, name, n, day FROM prev WHERE k % 2 = 0 AND k > 9")
def _(t):
    sel, some = t("sel"), t("prev").filter("k % 2 = 0")
    at = t("prev")
    for before, after, rows in (("append", "table", sel), ("table", "view", sel), ("view", "append", some), ("append", "delete_insert", some.filter("k > 9"))):
        at = tables.transition(at, rows, before, after, ["k"])
    kept = at.filter("k > 9")  # the append's rows that no later selection replaced
    return tables.transition(kept, sel, "delete_insert", "append", ["k"])


@query(
    "c16_snapshot_match",
    """SELECT coalesce(o.k, s.k) AS k, o.dbt_scd_id AS open_id, s.changed_at AS changed_at FROM (SELECT * FROM history WHERE dbt_valid_to IS NULL) o FULL JOIN source s ON o.k = s.k""",
)
def _(t):
    both = tables.snapshot_match(t("history").filter("dbt_valid_to IS NULL"), t("source"), "k")
    return both.select(F.coalesce("o.k", "s.k").alias("k"), F.col("o.dbt_scd_id").alias("open_id"), F.col("s.changed_at").alias("changed_at"))


@query(
    "d10_schema_digest",
    """SELECT count(*) AS n_rows, sha256('0:k:bigint:True;1:part:string:True;2:day:bigint:True;') AS digest FROM prev""",
)
def _(t):
    rows = t("prev").select("k", "part", "day")
    return evidence.content_digest(rows).select("n_rows", evidence.schema_hash(rows.schema).alias("digest"))


# --- streams ----------------------------------------------------------------------------------


@query(
    "i1_stream_confirm",
    """SELECT confirm_id, request_id, epoch, CASE WHEN target IS NULL THEN 'missing' WHEN done IS NOT NULL THEN 'already_confirmed' WHEN NOT valid THEN 'invalid' WHEN n > 1 THEN 'already_confirmed' ELSE 'published' END AS outcome
       FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN valid THEN 0 ELSE 1 END, arrival, confirm_id) AS n
             FROM (SELECT c.*, target, p.confirmed_ms AS done, (coalesce(target, '') <> '') = (epoch IS NOT NULL) AS valid FROM confirms c LEFT JOIN (SELECT * FROM executions WHERE id % 5 > 0) p USING (request_id)))""",
    CONFIRMS,
)
def _(t):
    at = lambda seconds: F.timestamp_seconds(seconds).alias("at")
    pending = t("executions").filter("id % 5 > 0").select(F.lit("org").alias("org_id"), "request_id", "target", "confirmed_ms", at(F.lit(1000)))
    asked = confirms(t).select(F.lit("org").alias("org_id"), "request_id", "confirm_id", "arrival", "epoch", at(F.col("arrival") + 1000))
    spark = pending.sparkSession
    paths = [sources.shared_folder(spark, "stream") for _ in range(2)]
    # a request's confirmations come in one batch; its pending row comes in any, before or after
    pending.repartition(3).write.parquet(paths[0])
    asked.repartition(3, "request_id").write.parquet(paths[1])
    for i in range(2):  # the end of the streams: events far ahead, on which the watermark passes those that wait
        pending.limit(1).select(F.lit("end").alias("org_id"), F.lit("end").alias("request_id"), "target", "confirmed_ms", at(F.lit(10_000_000 + i))).coalesce(1).write.mode("append").parquet(paths[0])
        asked.limit(1).select(F.lit("end").alias("org_id"), F.lit("end").alias("request_id"), "confirm_id", "arrival", "epoch", at(F.lit(10_000_000 + i))).coalesce(1).write.mode("append").parquet(paths[1])
    first, second = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(p) for df, p in zip((pending, asked), paths, strict=True))
    path = ran(lambda s, p, c: states.stream_confirm(s, second, p, c), first)
    return states.outcomes(spark, path).filter("request_id <> 'end'").drop("org_id")


@query("i2_stream_current_state", "SELECT id, target_key, last_modified_epoch FROM current", RANKED, CURRENT)
def _(t):
    log = t("executions").filter("confirmed_ms IS NOT NULL")
    path = ran(states.stream_current_state, stream_of(log.unionByName(log.filter("id % 5 = 0"))))
    return states.last_rows(log.sparkSession, path, list(history.SCOPE)).select("id", "target_key", "last_modified_epoch")


@query("i3_stream_invocation_counts", f"SELECT invocation, {BUILT} AS built, count(*) FILTER (decision = 'skip') AS reused, count(*) FILTER (decision = 'clone') AS cloned FROM decisions GROUP BY 1")
def _(t):
    return last_counts(states.invocation_counts(stream_of(t("decisions"))))


@query("i4_stream_daily", f"SELECT strftime(created_at, '%Y-%m-%d') AS day, {BUILT} AS built, count(*) - {BUILT} AS reused FROM decisions GROUP BY 1")
def _(t):
    timed = t("decisions").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return last_counts(states.daily_counts(stream_of(timed), "3650 days")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


OLD = "SELECT o_orderkey AS k, 'old' AS v, CASE WHEN o_orderkey % 19 > 0 THEN o_orderdate END AS moment FROM orders"
NEW = "SELECT o_orderkey AS k, 'new' AS v, CASE WHEN o_orderkey % 17 > 0 THEN o_orderdate END AS moment FROM orders WHERE o_custkey % 3 > 0"


def versions(t):
    o = t("orders").withColumn("moment", F.col("o_orderdate").cast("timestamp"))
    make = lambda v, n: o.select(F.col("o_orderkey").alias("k"), F.lit(v).alias("v"), F.when(F.col("o_orderkey") % n > 0, F.col("moment")).alias("moment"), "o_custkey")
    return make("old", 19).drop("o_custkey"), make("new", 17).filter("o_custkey % 3 > 0").drop("o_custkey")


@query(
    "i5_microbatch_windows",
    f"""SELECT k, v FROM ({OLD}) WHERE moment IS NULL OR moment < TIMESTAMP '1995-04-16' OR moment >= TIMESTAMP '1995-06-16' UNION ALL SELECT k, v FROM ({NEW}) WHERE moment >= TIMESTAMP '1995-04-16' AND moment < TIMESTAMP '1995-06-16'""",
)
def _(t):
    table, src = versions(t)
    days = tables.microbatch_windows(datetime(1995, 6, 15, 5), 60, datetime(1993, 1, 1))
    return tables.build_microbatch(table, src, "moment", days[0][0], days[-1][1]).select("k", "v")  # days without a gap are one window


@query(
    "i6_late_rows",
    f"""SELECT k, v FROM ({OLD}) WHERE moment IS NULL OR moment < TIMESTAMP '1995-06-13' OR moment >= TIMESTAMP '1995-06-16' UNION ALL SELECT k, v FROM ({NEW}) WHERE moment >= TIMESTAMP '1995-06-13' AND moment < TIMESTAMP '1995-06-16'""",
)
def _(t):
    table, src = versions(t)
    for start, end in tables.microbatch_windows(datetime(1995, 6, 15, 5), 9, datetime(1995, 6, 13)):
        table = tables.build_microbatch(table, src, "moment", start, end)
    return table.select("k", "v")


@query("i7_stream_node_state", "SELECT org_id, node_uid, max(id) AS id, arg_max(logic_hash, id) AS logic_hash FROM executions GROUP BY 1, 2")
def _(t):
    updates = t("executions").select("org_id", "node_uid", "id", "logic_hash")
    path = ran(lambda s, p, c: states.stream_node_state(s, p, c, ["org_id", "node_uid"], "id"), stream_of(updates))
    return states.last_rows(updates.sparkSession, path, ["org_id", "node_uid"])


@query(
    "i8_stream_observations",
    """SELECT generation, relation, max(seq) AS seq, CAST(max(CASE WHEN changed THEN n END) AS BIGINT) AS ordinal
       FROM (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY generation ORDER BY seq) AS n
             FROM (SELECT *, known_write OR lag(seq) OVER w IS NULL OR lag(schema_hash) OVER w <> schema_hash OR lag(content_hash) OVER w <> content_hash AS changed FROM observations WINDOW w AS (PARTITION BY generation, relation ORDER BY seq)))
       GROUP BY 1, 2""",
)
def _(t):
    seen = t("observations")
    path = sources.shared_folder(seen.sparkSession, "stream")
    third = seen.agg(F.expr("CAST(max(seq) / 3 + 1 AS BIGINT)")).first()[0] or 1
    for i in range(3):  # files in the order in which they were written
        seen.filter(F.floor(F.col("seq") / third) == i).coalesce(1).write.mode("append").parquet(path)
    stream = seen.sparkSession.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return states.last_observations(seen.sparkSession, ran(states.stream_observations, stream)).select("generation", "relation", "seq", "ordinal")
