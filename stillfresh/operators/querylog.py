"""Jobs over a log of SQL texts: fingerprints and volatile calls. Lexical, nothing is parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*[\s\S]*?\*/|[A-Za-z_][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|<>|!=|<=|>=|\|\||::|\s+|."""
# Functions whose value changes between runs, and bare names of clocks.
CALLS = ("now", "current_timestamp", "current_date", "current_time", "getdate", "sysdate", "localtimestamp", "random", "rand", "randn", "uuid", "uuid_string", "gen_random_uuid", "nextval", "seq1", "seq2", "seq4", "seq8", "systimestamp", "localtime", "randstr", "normal", "uniform", "zipf")
BARE = ("current_timestamp", "current_date", "current_time", "localtimestamp", "localtime")


def sql_tokens(sql: Column) -> Column:
    """Tokens without comments and white space; words in lower case, != as <>, quoted text exact."""
    raw = F.regexp_extract_all(sql, F.lit(f"({TOKEN})"), 1)
    kept = F.filter(raw, lambda t: ~(t.startswith("--") | t.startswith("/*") | (F.trim(F.regexp_replace(t, r"\s", "")) == "")))
    return F.transform(kept, lambda t: F.when(t == "!=", "<>").when(t.rlike(r"""^['"`]""") | ~t.rlike(r"^[\x00-\x7f]*$"), t).otherwise(F.lower(t)))


def normalized(sql: Column) -> Column:
    """Tokens at single spaces, without a trailing ; or comma."""
    return F.regexp_replace(F.array_join(sql_tokens(sql), " "), r"(?: [;,])+$", "")


def fingerprint_log(df: DataFrame, column: str) -> DataFrame:
    """fingerprint, n, variants: how often each normalized text occurs, and in how many spellings."""
    return df.groupBy(F.sha2(normalized(F.col(column)), 256).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(column).alias("variants"))


def is_volatile(sql: Column) -> Column:
    """Whether a text calls a function of CALLS or names a clock, outside comments and quotes; unsure means yes."""
    tokens = sql_tokens(sql)
    after = F.concat(F.slice(tokens, 2, 1_000_000), F.array(F.lit("")))
    pairs = F.arrays_zip(tokens.alias("t"), after.alias("a"))
    called = F.exists(pairs, lambda p: p["t"].isin(*BARE) | (p["t"].isin(*CALLS) & (p["a"] == "(")))
    return F.coalesce(called, F.lit(False))  # a text without tokens calls nothing


def scan_volatile(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("volatile", is_volatile(F.col(column)))
