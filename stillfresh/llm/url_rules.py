"""URL filters: fixed host and path rules, then association rules mined from labelled urls."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize

# Fixed values: (rule, host, path, verdict).
RULES = (
    ("com/", "com", "/", "allow"),
    ("example.com/en/", "example.com", "/en/", "block"),
    ("www.example.com/en/", "www.example.com", "/en/", "allow"),
    ("net/es/", "net", "/es/", "block"),
    ("net/fr/", "net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_COUNT, Z = 0.005, 0.7, 5, 1.96
SALTS = 16


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the rest of each url; null urls and those without :// have empty parts."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    cut = pages.select("page_id", F.coalesce(after, F.lit("")).alias("rest"))
    host = F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)
    tail = F.regexp_extract("rest", r"(?s)^[^/?#]*(.*)$", 1)
    return cut.select("page_id", F.translate(host, UPPER, LOWER).alias("host"), tail.alias("tail")).select(
        "page_id", "host", F.regexp_extract("tail", r"(?s)^([^?#]*)", 1).alias("path"), F.regexp_extract("tail", r"(?s)^[^?#]*\?([^#]*)", 1).alias("query")
    )


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule whose host is the url's or a parent, and whose path the url's starts with."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, h, p, v in sorted(RULES, key=lambda r: len(r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """All distinct tokens: host labels from the right, path words by depth, file ending, query names."""
    labels = F.reverse(F.split(host, r"\."))
    tld = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    words = F.filter(F.split(path, "/"), lambda x: x != "")
    steps = F.transform(words, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "0")))
    ending = F.array(F.concat(F.lit("end="), F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,6}|/)$", 1)))
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(tld, steps, ending, names))


def twins(labelled: DataFrame, least: float) -> DataFrame:
    """(lead, members) of the tokens in ``least`` urls or more: those that always come together form one group."""
    each = labelled.select(F.explode("tokens").alias("t"), F.xxhash64("tokens").cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), "tokens").cast("decimal(38,0)").alias("b"))
    seen = each.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("n") >= least)
    groups = seen.groupBy("n", "a", "b").agg(F.sort_array(F.collect_list("t")).alias("members"))
    return materialize(groups.select(F.element_at("members", 1).alias("lead"), "members"), "twins")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(verdict, antecedent, confidence, support, low) of the rules that say block or allow.

    ``labelled`` has tokens and verdict of all labelled urls. FP-growth finds the token sets
    with ``min_support`` (and in five urls at least); rules under ``min_confidence`` go, rules
    whose confidence isn't surely over the verdict's share of all labelled urls (``low``, the
    lower end of Wilson's interval), and rules that hold a shorter one of at least their
    confidence. Support bounds the tokens (at most a url's mean
    number of tokens / min_support are frequent), not the rows. FP-growth's work grows with the
    subsets of one url's tokens, so tokens that always come together are mined as one; a rule
    then holds for each of them, and those that hold two of them would go anyway.
    """
    sizes = {r.verdict: r.n for r in labelled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).filter("verdict IN ('allow', 'block')").collect()}
    n = sum(sizes.values())
    share = min(1.0, max(min_support, MIN_COUNT / max(1, n)))
    groups = twins(labelled, share * n - 1e-6)
    leads = groups.agg(F.sort_array(F.collect_list("lead")).alias("leads"), F.map_from_entries(F.collect_list(F.struct("lead", "members"))).alias("of"))  # one row
    kept = labelled.crossJoin(F.broadcast(leads.select("leads")))
    baskets = kept.select(F.concat(F.array_intersect("tokens", "leads"), F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(baskets)
    base, p, met = F.lit(None).cast("double"), F.col("confidence"), F.col("support") * n / F.col("confidence")
    for name, count in sizes.items():
        base = F.when(F.col("verdict") == name, count / n).otherwise(base)
    low = (p + Z * Z / 2 / met - Z * F.sqrt((p * (1 - p) + Z * Z / 4 / met) / met)) / (1 + Z * Z / met)
    said = model.associationRules.filter(F.element_at("consequent", 1).startswith("verdict=")).withColumn("verdict", F.substring_index(F.element_at("consequent", 1), "=", -1))
    mined = said.withColumn("low", low).filter(F.col("low") > base).crossJoin(F.broadcast(leads.select("of")))
    spread = F.aggregate("antecedent", F.array(F.array().cast("array<string>")), lambda out, x: F.flatten(F.transform(out, lambda o: F.transform(F.col("of")[x], lambda m: F.concat(o, F.array(m))))))
    rules = materialize(mined.select("verdict", F.explode(spread).alias("antecedent"), "confidence", "support", "low").withColumn("antecedent", F.array_sort("antecedent")), "rules")
    short, long = rules.alias("s"), rules.alias("l")
    # a rule's shorter forms hold its first or its second token in order: found by an index of tokens
    index = short.select("verdict", F.explode("antecedent").alias("t"), F.col("antecedent").alias("a"), F.col("confidence").alias("c"))
    idle = (
        long.select("verdict", "antecedent", "confidence", F.explode("antecedent").alias("t"))
        .join(index, ["verdict", "t"])
        .filter((F.size("a") < F.size("antecedent")) & (F.size(F.array_except("a", "antecedent")) == 0) & (F.col("c") >= F.col("confidence")))
        .select("verdict", "antecedent")
        .distinct()
    )
    return materialize(rules.join(idle, ["verdict", "antecedent"], "left_anti"), "pruned")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(signature, confidence, block, allow) for each distinct set of rule tokens.

    ``confidence`` is the best block rule's; ``block`` and ``allow`` are the best lower ends of
    the rules that say so. The inverted index keeps each rule under its least token; a
    signature meets the rules under its own tokens and keeps those it holds in full. Urls with
    one signature are matched once, so a common host costs one row.
    """
    signatures = urls.select("signature").filter(F.size("signature") > 0).distinct()
    index = rules.select(F.element_at("antecedent", 1).alias("t"), "antecedent", "verdict", "confidence", "low")
    met = signatures.select("signature", F.explode("signature").alias("t")).join(index, "t")
    of = lambda verdict, c: F.max(F.when(F.col("verdict") == verdict, F.col(c)))
    held = met.filter(F.size(F.array_except("antecedent", "signature")) == 0)
    return held.groupBy("signature").agg(of("block", "confidence").alias("confidence"), of("block", "low").alias("block"), of("allow", "low").alias("allow"))


def decided(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with ``mined`` (block or allow) and ``confidence``, by the rules alone.

    A url is blocked where a block rule holds whose lower end beats those of all allow rules
    that hold. A signature may be that of a third of all urls: its rules go to each of a few
    salts, over which the urls are dealt.
    """
    words = rules.select(F.explode("antecedent").alias("t")).distinct().agg(F.sort_array(F.collect_list("t")).alias("words"))  # frequent tokens only
    signed = rows.crossJoin(F.broadcast(words)).withColumn("signature", F.array_sort(F.array_intersect("tokens", "words"))).drop("words")  # one row
    matched = match_rules(signed, rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = signed.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(matched, ["signature", "salt"], "left")
    blocked = F.col("block").isNotNull() & (F.col("block") > F.coalesce("allow", F.lit(0.0))) & (F.col("host") != "")
    return out.withColumn("mined", F.when(blocked, "block").otherwise("allow")).drop("signature", "salt", "tokens", "block", "allow")


def tokened(pages: DataFrame) -> DataFrame:
    """page_id, host, path, tokens, rule, given: the fixed rule of each url and its verdict."""
    parts = url_parts(pages)
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return parts.select("page_id", "host", "path", url_tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"), rule.alias("rule"), verdict.alias("given"))


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence: one row for each page.

    A url that a fixed rule fits has that rule's verdict; any other the one of the mined rules
    (:func:`decided`). Rules are mined from ``labels`` (page_id, verdict), by default from
    the pages that the fixed rules judge. Pages without a host, and all pages where nothing
    could be mined, are allowed. Urls may be of any length: all their tokens count. Repeated
    page_ids keep a row each; an empty table gives no rows. DataFrame functions only.
    """
    rows = tokened(pages)
    known = rows.filter("given IS NOT NULL").select("tokens", F.col("given").alias("verdict"))
    if labels is not None:
        known = rows.select("page_id", "tokens").join(labels.select("page_id", "verdict"), "page_id").select("tokens", "verdict")
    out = decided(rows, mine_rules(known, min_support, min_confidence))
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "mined").alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))


def held_out_report(pages: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(given, mined, n): how rules mined from four fifths of the judged pages judge the last fifth."""
    rows = tokened(pages).filter("given IS NOT NULL")
    fold = held_out(F.col("page_id"))
    rules = mine_rules(rows.filter(~fold).select("tokens", F.col("given").alias("verdict")), min_support, min_confidence)
    return decided(rows.filter(fold), rules).groupBy("given", "mined").agg(F.count(F.lit(1)).alias("n"))
