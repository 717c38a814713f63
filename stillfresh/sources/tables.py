"""Sources and sinks: the execution log, traces, seeds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INPUT = T.StructType([T.StructField("name", T.StringType()), T.StructField("epoch", T.LongType()), T.StructField("producer", T.StructType([T.StructField("state", T.StringType()), T.StructField("logic", T.StringType())]))])
EXECUTION = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("request_id", T.StringType()), T.StructField("org_id", T.StringType()), T.StructField("warehouse", T.StringType()),
    T.StructField("namespace", T.StringType()), T.StructField("target", T.StringType()), T.StructField("node_uid", T.StringType()), T.StructField("execution_type", T.IntegerType()),
    T.StructField("last_modified_epoch", T.LongType()), T.StructField("created_ms", T.LongType()), T.StructField("confirmed_ms", T.LongType()),
    T.StructField("logic_hash", T.StringType()), T.StructField("namespace_hash", T.StringType()), T.StructField("inputs", T.ArrayType(INPUT)), T.StructField("results", T.StringType()),
])
TRACE = T.StructType([
    T.StructField("service", T.StringType()), T.StructField("method", T.StringType()), T.StructField("recorded_at", T.StringType()),
    T.StructField("metadata", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("request", T.StringType()), T.StructField("response", T.StringType()),
])

# Headers of the transport, and parts of names that mark credentials.
TRANSPORT = ("authorization", "proxy-authorization", "cookie", "set-cookie", "content-type", "te", "user-agent", "host", "date")
CREDENTIAL = ("authorization", "cookie", "token", "secret", "password", "credential", "api-key", "api_key")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local master without the setting takes this machine's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/stillfresh-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that its rows and their places are settled."""
    path = shared_folder(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_result(df: DataFrame, relation: str, kind: str, partition: tuple[str, ...] = ()) -> None:
    """A node's rows as the relation of its kind in the session's catalog.

    table, seed and snapshot replace the relation; incremental replaces the partitions that
    ``df`` has rows of and makes the relation if it is missing; append adds rows; view names
    the query and stores nothing.
    """
    spark = df.sparkSession
    there = kind in ("incremental", "append") and spark.catalog.tableExists(relation)
    if kind == "view":
        df.createOrReplaceTempView(relation)
    elif there:
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")  # tables of the session's catalog take it from the session alone
        try:
            df.select(*spark.table(relation).columns).write.insertInto(relation, overwrite=kind == "incremental")
        finally:
            spark.conf.set(mode, before)
    elif kind in ("table", "seed", "snapshot", "incremental", "append"):
        df.write.format("parquet").partitionBy(*partition).saveAsTable(relation, mode="overwrite")
    else:
        raise ValueError(f"no relation of kind {kind}")


def read_executions(spark: SparkSession, path: str) -> DataFrame:
    """The log under its fixed schema; columns that older files lack are NULL."""
    return spark.read.schema(EXECUTION).parquet(path)


def append_log(df: DataFrame, path: str, day: Column) -> None:
    """Append executions or decisions, a folder for each day; rows of a day come together first, and large days are split."""
    df.withColumn("day", day).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line, text): the lines of JSON files that don't fit the schema, counted from 1; blank lines are none.

    Files are read in splits. A line's number is its place in its split and the lines of the
    file's splits before it, which are counted in the same scan's rows: a row for each split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flagged = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = F.from_json("value", flagged, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = lines.filter(F.trim("value") != "").filter(read["_corrupt"].isNotNull())
    return bad.join(splits.withColumn("before", before), ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def read_trace(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """JSON lines of recorded calls with their file; a bad line is an error that names the first such line of a file.

    The check is a scan of its own; without it a bad line fails the read when it is met.
    """
    found = bad_lines(spark, path, TRACE).orderBy("file", "line").limit(1).collect() if check else []
    if found:
        raise ValueError(f"{found[0].file}, line {found[0].line}: no recorded call: {found[0].text[:200]}")
    return spark.read.schema(TRACE).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())


def read_seed(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", quote: str = '"') -> DataFrame:
    """A CSV file with typed columns; duplicates and NULLs stay."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, quote=quote, escape=quote, mode="FAILFAST", enforceSchema=False)


def recorded_header(key: Column) -> Column:
    """Whether a header may be kept: neither transport nor credential."""
    secret = F.lit(False)
    for part in CREDENTIAL:
        secret = secret | key.contains(part)
    return ~key.isin(*TRANSPORT) & ~key.startswith("grpc-") & ~secret


def scrub_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """Metadata pairs (key, value) without transport and credential headers."""
    return df.withColumn(column, F.filter(column, lambda p: recorded_header(F.lower(p[0]))))


def verify_capture(rows: DataFrame, sidecars: DataFrame) -> DataFrame:
    """file, valid: a capture is whole if it says so and its counts agree with its rows.

    ``sidecars``: file, complete, failed, started, recorded.
    """
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    fits = F.col("complete") & ~F.col("failed") & (F.col("started") == F.col("recorded")) & (F.col("recorded") == F.coalesce("n", F.lit(0)))
    return sidecars.join(counts, "file", "left").select("file", F.coalesce(fits, F.lit(False)).alias("valid"))
