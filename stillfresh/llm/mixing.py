"""Mixing to target weights: iterative proportional fitting of token weights, then sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, BUDGET, FLATTEN, SEED = 16, 0.8, 0.7, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
ONE_PLACE = 200_000


def removed(text: Column, char: str) -> Column:
    """How often an ASCII character stands in a text: the bytes lost without it."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def topic_of(text: Column) -> Column:
    """A document's form, by fixed rules: table, symbols, numbers, shout, lines or prose."""
    n = F.greatest(F.length(text), F.lit(1))
    count = lambda chars: sum(removed(text, c) for c in chars)
    return (
        F.when(100 * count("|") >= 2 * n, "table")
        .when(100 * count("#*$%&<>") >= 4 * n, "symbols")
        .when(100 * count("0123456789") >= 8 * n, "numbers")
        .when(100 * count("!") >= 3 * n, "shout")
        .when(50 * count("\n") >= n, "lines")
        .otherwise("prose")
    )


def keyword_topics(topics: dict[str, list[str]]) -> Callable[[Column], Column]:
    """A topic function: the topic whose words stand in a text most often, in the given order at ties; else ''."""

    def hits_of(words: Column, own: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*own)))

    def topic(text: Column) -> Column:
        words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
        hits = [hits_of(words, own) for own in topics.values()]
        out = F.lit("")
        for name, n in reversed(list(zip(topics, hits, strict=True))):
            out = F.when((n > 0) & (n == F.greatest(*hits, F.lit(0))), name).otherwise(out)
        return out

    return topic


def measured(docs: DataFrame, topic: Callable[[Column], Column] = topic_of) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens: runs of anything but white space; nulls become ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")]
    return docs.select("doc_id", *named, topic(text).alias("topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))


def flattened_targets(cells: DataFrame, dimension: str, flatten: float, budget: float) -> DataFrame:
    """(dimension, want): tokens wanted of each value, ``budget`` of all tokens in sum.

    Shares are those of the values' tokens raised to ``flatten``, filled up like water: a value
    whose share is more than it has gives all it has, and the others share the rest.
    """
    totals = cells.groupBy(dimension).agg(F.sum("n").cast("double").alias("have"))
    order = Window.orderBy("have", dimension)  # one row for each value
    filled = totals.withColumn("p", F.pow("have", F.lit(flatten))).withColumns({
        "before": F.coalesce(F.sum("have").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("p").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "whole": F.sum("have").over(Window.partitionBy()),
    })
    level = filled.withColumn("c", (budget * F.col("whole") - F.col("before")) / F.col("rest"))
    first = level.filter(F.col("c") * F.col("p") < F.col("have")).agg(F.min_by("c", F.struct("have", dimension)).alias("level"))
    return level.crossJoin(F.broadcast(first)).select(dimension, F.coalesce(F.least("have", F.col("level") * F.col("p")), "have").alias("want"))  # one row


def in_one_place(cells: DataFrame) -> DataFrame:
    """Few cells lie in one partition, so that sums over any dimension move no rows."""
    return cells.coalesce(1) if cells.count() <= ONE_PLACE else cells


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """The cells with ``weight``: tokens to take of each.

    Each round scales the weights of each value of each dimension to the value's target, one
    dimension after another, and trims each cell to what it has. Cells are the combinations
    of source, language and topic, counted from all documents; a value without a target keeps
    its weight. Every fourth round's cells are a written table, so plans stay short.
    """
    own = cells.withColumn("weight", F.col("n").cast("double"))
    for d, target in targets.items():
        own = own.join(target.select(d, F.col("want").alias(f"want_{d}")), d, "left")
    for r in range(rounds):
        if r % 4 == 0:
            own = in_one_place(materialize(own, "weights"))
        for d in targets:
            now = F.sum("weight").over(Window.partitionBy(d))
            factor = F.when(F.col(f"want_{d}").isNull() | (now <= 0), 1.0).otherwise(F.col(f"want_{d}") / now)
            own = own.withColumn("weight", F.least(F.col("weight") * factor, F.col("n").cast("double")))
    return materialize(own.select(*cells.columns, "weight"), "weights")


def marginal_errors(weights: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, want, got, error): how far each raked marginal is from its target, relative to it."""
    out = None
    for d, target in targets.items():
        sums = weights.groupBy(d).agg(F.sum("weight").alias("got")).join(target, d)
        part = sums.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "want", "got", F.abs(F.col("got") / F.col("want") - 1).alias("error"))
        out = part if out is None else out.unionByName(part)
    return out


def draw(seed: str) -> Column:
    """A number in 0..1 from the document's id, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|" + seed))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def share(weight: Column, n: Column) -> Column:
    """A cell's probability; one of a cell without tokens."""
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), weight / n))


def weighted(rows: DataFrame, targets: dict[str, DataFrame] | None, rounds: int, budget: float, flatten: float) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(raked cells, targets) of measured documents."""
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")), "cells")
    targets = targets or {d: materialize(flattened_targets(cells, d, flatten, budget), f"want-{d}") for d in DIMENSIONS}
    return rake(cells, targets, rounds), targets


def mix_probabilities(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    rounds: int = ROUNDS,
    budget: float = BUDGET,
    flatten: float = FLATTEN,
    seed: str = SEED,
    topic: Callable[[Column], Column] = topic_of,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, sampled: one row for each document.

    ``targets`` gives (value, want in tokens) by dimension; without it, those of
    :func:`flattened_targets`, which the values can reach. A document's probability is its
    cell's raked weight over the cell's tokens. The draw hashes the doc_id, so repeated rows of
    an id share their fate. Null source or lang count as ''. Documents without words, null and
    empty texts among them, weigh nothing and stay; texts are counted whole. An empty table gives no rows. Aggregation is in two
    steps, so a source of any share costs one row for each task and cell.
    """
    rows = materialize(measured(docs, topic), "measured")
    weights, _ = weighted(rows, targets, rounds, budget, flatten)
    weights = weights.select(*DIMENSIONS, share(F.col("weight"), F.col("n")).alias("probability"))
    out = rows.join(F.broadcast(weights) if weights.count() <= ONE_PLACE else weights, list(DIMENSIONS))
    out = out.withColumn("probability", F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.col("probability")))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", "probability", (draw(seed) < F.col("probability")).alias("sampled"))


def mix_documents(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    rounds: int = ROUNDS,
    budget: float = BUDGET,
    flatten: float = FLATTEN,
    seed: str = SEED,
    topic: Callable[[Column], Column] = topic_of,
) -> DataFrame:
    """The sampled documents, all columns as they are, whatever their names.

    Nulls, empty and long texts, repeated rows and empty tables as in :func:`mix_probabilities`.
    """
    weights, _ = weighted(measured(docs, topic), targets, rounds, budget, flatten)
    own = {d: fresh(docs, f"cell_{d}") for d in DIMENSIONS}
    p = fresh(docs, "cell_p")
    weights = weights.select(*(F.col(d).alias(own[d]) for d in DIMENSIONS), share(F.col("weight"), F.col("n")).alias(p))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = (F.col(own["topic"]) == topic(text)) & (F.col(own["source"]) == F.coalesce(F.col("source").cast("string"), F.lit(""))) & (F.col(own["lang"]) == F.coalesce(F.col("lang").cast("string"), F.lit("")))
    kept = docs.join(F.broadcast(weights) if weights.count() <= ONE_PLACE else weights, same).filter((draw(seed) < F.col(p)) | ~text.rlike(r"[^ \t-\r]"))
    return kept.drop(*own.values(), p)


def oracle_sql(rounds: int = ROUNDS, budget: float = BUDGET, flatten: float = FLATTEN, seed: str = SEED) -> str:
    """The same rows in DuckDB's SQL, the rounds written out."""
    count = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    ctes = [
        f"""rows AS (SELECT doc_id, source, lang,
              CASE WHEN 100 * {count('|')} >= 2 * n THEN 'table' WHEN 100 * {count('#*$%&<>')} >= 4 * n THEN 'symbols'
                   WHEN 100 * {count('0123456789')} >= 8 * n THEN 'numbers' WHEN 100 * {count('!')} >= 3 * n THEN 'shout'
                   WHEN 50 * (length(t) - length(replace(t, chr(10), ''))) >= n THEN 'lines' ELSE 'prose' END AS topic,
              CAST(len(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens
            FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, greatest(length(coalesce(text, '')), 1) AS n FROM documents))""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS n FROM rows GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        ctes.append(f"""fill_{d} AS (SELECT {d}, have, p, ({budget} * sum(have) OVER () - coalesce(sum(have) OVER (ORDER BY have, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(p) OVER (ORDER BY have, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
            FROM (SELECT {d}, CAST(sum(n) AS DOUBLE) AS have, pow(CAST(sum(n) AS DOUBLE), {flatten}) AS p FROM cells GROUP BY {d}))""")
        ctes.append(f"want_{d} AS (SELECT {d}, coalesce(least(have, p * (SELECT c FROM fill_{d} WHERE c * p < have ORDER BY have, {d} LIMIT 1)), have) AS want_{d} FROM fill_{d})")
    ctes.append("w0 AS MATERIALIZED (SELECT *, CAST(n AS DOUBLE) AS weight FROM cells " + " ".join(f"JOIN want_{d} USING ({d})" for d in DIMENSIONS) + ")")
    now = "w0"
    for r in range(rounds):
        for d in DIMENSIONS:
            name = f"w{r + 1}_{d}"
            ctes.append(
                f"{name} AS MATERIALIZED (SELECT * REPLACE (least(CASE WHEN sum(weight) OVER (PARTITION BY {d}) <= 0 THEN weight ELSE weight * (want_{d} / sum(weight) OVER (PARTITION BY {d})) END, CAST(n AS DOUBLE)) AS weight) FROM {now})"
            )
            now = name
    return f"""WITH {', '.join(ctes)}
        SELECT doc_id, source, lang, topic, n_tokens, round(probability, 9) AS probability,
               CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|{seed}'), 1, 12)) AS BIGINT) / 281474976710656.0 < probability AS sampled
        FROM (SELECT rows.*, CASE WHEN n = 0 OR n_tokens = 0 THEN 1.0 ELSE least(1.0, weight / n) END AS probability FROM rows JOIN {now} USING (source, lang, topic))"""
