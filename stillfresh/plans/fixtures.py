"""Execution logs, submissions and decisions derived from the driver's tables.

Each is one SELECT that Spark and DuckDB both run; MS(x) stands for a timestamp's
milliseconds, which the engines name differently. The work grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FAMILY = "CASE WHEN lower(trim({w})) = 'spark' THEN 'databricks' ELSE lower(trim({w})) END"

SELECTS = {
    "raw_executions": """
        SELECT o_orderkey AS id, 'r' || CAST(o_orderkey AS VARCHAR(20)) AS request_id, 'org' || CAST(o_custkey % 3 AS VARCHAR(20)) AS org_id,
               CASE o_custkey % 4 WHEN 0 THEN ' Spark' WHEN 1 THEN 'databricks' WHEN 2 THEN 'snowflake' ELSE 'DuckDB ' END AS warehouse,
               CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN '' ELSE 'ns' || CAST(o_custkey % 2 AS VARCHAR(20)) END AS namespace,
               'Cat.s' || CAST(o_custkey % 4 AS VARCHAR(20)) || '.t' || CAST(o_custkey % 60 AS VARCHAR(20)) AS target,
               'model.' || CAST(o_custkey % 60 AS VARCHAR(20)) AS node_uid, CAST(1 + o_orderkey % 10 AS INT) AS execution_type,
               CASE WHEN o_orderkey % 11 = 0 AND o_custkey % 60 % 7 = 0 THEN NULL ELSE MS(o_orderdate) END AS last_modified_epoch,
               MS(o_orderdate) - 60000 AS created_ms,
               CASE WHEN o_orderkey % 13 = 0 AND o_custkey % 60 % 4 = 1 THEN NULL ELSE MS(o_orderdate) + o_orderkey % 7 * 1000 END AS confirmed_ms,
               md5('logic' || CAST(o_custkey % 60 AS VARCHAR(20)) || CAST(o_orderkey % 3 AS VARCHAR(20))) AS logic_hash,
               md5('ns' || CAST(o_custkey % 6 AS VARCHAR(20))) AS namespace_hash,
               'p' || CAST(o_custkey % 7 AS VARCHAR(20)) AS project, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE 'env' || CAST(o_custkey % 2 AS VARCHAR(20)) END AS environment,
               o_orderkey * 37 % 5000 AS runtime_ms
        FROM orders""",
    "executions": """
        SELECT *, CASE WHEN lower(trim(warehouse)) = 'spark' THEN 'databricks' ELSE lower(trim(warehouse)) END AS family, lower(target) AS target_key
        FROM raw_executions""",
    "inputs": """
        SELECT l_orderkey AS execution_id, 'cat.s' || CAST(l_partkey % 4 AS VARCHAR(20)) || '.t' || CAST(l_partkey % 60 AS VARCHAR(20)) AS name,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE MS(l_shipdate) END AS epoch,
               CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'l' || CAST(l_partkey % 2 AS VARCHAR(20)) END AS producer
        FROM lineitem""",
    "submissions": """
        SELECT c_custkey AS submission_id, 'org' || CAST(c_custkey % 3 AS VARCHAR(20)) AS org_id,
               CASE c_custkey % 4 WHEN 0 THEN 'databricks' WHEN 1 THEN 'databricks' WHEN 2 THEN 'snowflake' ELSE 'duckdb' END AS family,
               CASE WHEN c_custkey % 5 < 2 THEN '' ELSE 'ns' || CAST(c_custkey % 2 AS VARCHAR(20)) END AS namespace,
               'cat.s' || CAST(c_custkey % 4 AS VARCHAR(20)) || '.t' || CAST(c_custkey % 60 AS VARCHAR(20)) AS target_key,
               md5('logic' || CAST(c_custkey % 60 AS VARCHAR(20)) || CAST(c_custkey % 3 AS VARCHAR(20))) AS submitted_hash,
               md5('ns' || CAST(c_custkey % 6 AS VARCHAR(20))) AS namespace_hash,
               CAST(1 + c_custkey % 10 AS INT) AS execution_type, CASE WHEN c_custkey % 2 = 0 THEN 'any' ELSE 'all' END AS policy,
               CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 86400000 ELSE 31536000000 END AS tolerance_ms, 1100000000000 AS now_ms
        FROM customer""",
    "decisions": """
        SELECT event_id AS decision_id, 'r' || CAST(event_id % 997 AS VARCHAR(20)) AS request_id, ts AS created_at, 'org' || CAST(user_id % 3 AS VARCHAR(20)) AS org_id,
               'p' || CAST(user_id % 7 AS VARCHAR(20)) AS project, 'env' || CAST(user_id % 2 AS VARCHAR(20)) AS environment,
               CASE WHEN user_id % 10 = 0 THEN '' ELSE 'inv' || CAST(event_id % 211 AS VARCHAR(20)) END AS invocation, CAST(user_id AS VARCHAR(20)) AS session,
               'model.' || CAST(event_id % 60 AS VARCHAR(20)) AS node_uid, CASE event_id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'seed' ELSE 'test' END AS kind,
               CASE event_type WHEN 'view' THEN 'skip' WHEN 'click' THEN 'skip' WHEN 'purchase' THEN 'clone' ELSE 'build' END AS decision, value
        FROM events""",
    "prev": """
        SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS part, p_type AS name, CAST(p_size AS BIGINT) AS n,
               CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey % 40 END AS day
        FROM part""",
    "sel": """
        SELECT p_partkey + 5 AS k, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS part, p_type || '!' AS name, CAST(p_size + 1 AS BIGINT) AS n,
               CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey % 40 END AS day
        FROM part WHERE p_partkey % 3 = 0""",
    "history": """
        SELECT c_custkey AS k, c_mktsegment AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS n,
               'id' || CAST(c_custkey AS VARCHAR(20)) AS dbt_scd_id, c_custkey % 50 AS dbt_updated_at, c_custkey % 50 AS dbt_valid_from,
               CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 50 + 100 ELSE NULL END AS dbt_valid_to
        FROM customer""",
    "source": """
        SELECT c_custkey + 3 AS k, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || '!' ELSE c_mktsegment END AS name,
               CASE WHEN (c_custkey + 3) % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS n, c_custkey % 90 AS changed_at
        FROM customer WHERE c_custkey % 3 > 0""",
    "observations": """
        SELECT 'g' || CAST(user_id % 4 AS VARCHAR(20)) AS generation, 'rel' || CAST(event_id % 25 AS VARCHAR(20)) AS relation, event_id AS seq,
               md5('s' || CAST(event_id % 50 AS VARCHAR(20))) AS schema_hash, md5(event_type) AS content_hash, event_id % 29 = 0 AS known_write
        FROM events""",
    "nodes": """
        SELECT 'n' || CAST(s_suppkey AS VARCHAR(20)) AS uid, 'rel' || CAST(s_suppkey AS VARCHAR(20)) AS relation, 'org' || CAST(s_suppkey % 2 AS VARCHAR(20)) AS org_id, 'p' AS project, 'dev' AS environment,
               md5(CAST(s_nationkey AS VARCHAR(20))) AS body, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'c' || CAST(s_suppkey % 3 AS VARCHAR(20)) END AS configs,
               'd' AS descriptions, 'm' || CAST(s_suppkey % 2 AS VARCHAR(20)) AS macros, CAST(NULL AS VARCHAR(20)) AS contract
        FROM supplier""",
    "state": """
        SELECT 'n' || CAST(s_suppkey AS VARCHAR(20)) AS uid, 'old' || CAST(s_suppkey % 4 AS VARCHAR(20)) AS relation, 'org' || CAST(s_suppkey % 2 AS VARCHAR(20)) AS org_id, 'p' AS project, 'dev' AS environment,
               md5(CAST(CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE s_nationkey END AS VARCHAR(20))) AS body, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE 'c' || CAST(s_suppkey % 3 AS VARCHAR(20)) END AS configs,
               'd' AS descriptions, 'm' || CAST(s_suppkey % 2 AS VARCHAR(20)) AS macros, CASE WHEN s_suppkey % 6 = 1 THEN 'x' ELSE NULL END AS contract
        FROM supplier WHERE s_suppkey % 8 > 0""",
    "node_inputs": """
        SELECT 'n' || CAST(s_suppkey AS VARCHAR(20)) AS uid, 'rel' || CAST((s_suppkey - s_suppkey % 3) / 2 AS VARCHAR(20)) AS name FROM supplier
        UNION ALL SELECT 'n' || CAST(s_suppkey AS VARCHAR(20)) AS uid, 'rel' || CAST(s_suppkey AS VARCHAR(20)) AS name FROM supplier WHERE s_suppkey % 4 = 0""",
    "sql_log": """
        SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'SELECT  a,B FROM T' || CAST(conv_id % 20 AS VARCHAR(20)) || ' -- ' || role || chr(10) || ' WHERE x != ''It''''s -- not'';'
                                            WHEN 1 THEN 'select a , b from t' || CAST(conv_id % 20 AS VARCHAR(20)) || ' where X <> ''It''''s -- not'''
                                            WHEN 2 THEN 'select Now ( ), "random(" from t' || CAST(conv_id % 20 AS VARCHAR(20)) ELSE 'select rand, ''now()'' from /* now() */ t' END AS query
        FROM conversations""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
MS = re.compile(r"MS\(([a-z_]+)\)")
USES = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b")


def needed(text: str, have: tuple[str, ...] = ()) -> list[str]:
    """The fixtures a text reads, each after those it reads itself."""
    out = list(have)
    for name in USES.findall(text):
        if name in SELECTS and name not in out:
            out = needed(SELECTS[name], tuple(out))
            out.append(name)
    return out


def oracle(body: str, *extra: str) -> str:
    """A DuckDB query: the fixtures that ``body`` reads, then ``extra`` CTEs, then ``body``."""
    parts = [f"{n} AS ({MS.sub(r'epoch_ms(\1)', SELECTS[n]).replace('(s_suppkey - s_suppkey % 3) / 2', '(s_suppkey - s_suppkey % 3) // 2')})" for n in needed(" ".join([*extra, body]))]
    return "WITH " + ", ".join([*parts, *extra]) + " " + body if parts or extra else body


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or one of the driver's tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = MS.sub(r"unix_millis(CAST(\1 AS TIMESTAMP))", SELECTS[name]).replace("AS VARCHAR(20)", "AS STRING").replace("(s_suppkey - s_suppkey % 3) / 2", "(s_suppkey - s_suppkey % 3) div 2")
    used = {t: fixture(spark, sf_dir, t) for t in dict.fromkeys(USES.findall(text))}
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)
