"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

# The base patterns. Keyword letters match in either case.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24


@dataclass(frozen=True)
class EntropyRule:
    """Settings of the entropy scan.

    A candidate is a maximal run of ``[A-Za-z0-9+/_=-]`` of at least ``window`` characters.
    Each window of that length belongs to the narrowest class of ``thresholds`` that holds
    all its characters; it is suspicious when its entropy in bits reaches the class's
    threshold. Windows of letters of one case only never are: prose has those.
    A candidate that fits one of ``allowed`` is left alone.
    """

    window: int = 20
    thresholds: dict[str, float] = field(
        default_factory=lambda: {"hex": 3.1, "HEX": 3.1, "lower": 3.7, "upper": 3.7, "mixed": 3.8}
    )
    allowed: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
        r"[0-9_+=/-]+",  # numbers, rules, dates
        r"[-_/+=]*(?:[A-Za-z]+[-_/+=]+)*[A-Za-z]*",  # words joined by dashes, slashes, underscores; paths
        r"(?i:example|sample|dummy|placeholder|changeme|xxxx).*",
    )


CLASSES = (
    ("hex", frozenset("0123456789abcdef")),
    ("HEX", frozenset("0123456789ABCDEF")),
    ("lower", frozenset("0123456789abcdefghijklmnopqrstuvwxyz")),
    ("upper", frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
)


def window_spans(run: str, rule: EntropyRule) -> list[tuple[int, int]]:
    """Merged [start, end) spans of the suspicious windows of one candidate.

    The counts, the sum of c*log2(c), the number of characters outside each class, and the
    number of capitals after letters and of small letters after other characters are updated
    by the character that leaves and the one that enters.
    """
    w = rule.window
    weight = [0.0] + [c * log2(c) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    outside = [0] * len(CLASSES)
    digits, turns, total = 0, 0, 0.0
    turn = [i > 0 and (c.isupper() if run[i - 1].isalpha() else c.islower()) for i, c in enumerate(run)]  # against the use of capitals in names
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(run):
        if i >= w:
            gone = run[i - w]
            c = counts[gone]
            total += weight[c - 1] - weight[c]
            counts[gone] = c - 1
            digits -= gone.isdigit()
            turns -= turn[i - w + 1]
            for k, (_, members) in enumerate(CLASSES):
                outside[k] -= gone not in members
        c = counts.get(ch, 0)
        total += weight[c + 1] - weight[c]
        counts[ch] = c + 1
        digits += ch.isdigit()
        turns += turn[i]
        for k, (_, members) in enumerate(CLASSES):
            outside[k] += ch not in members
        if i < w - 1:
            continue
        name = next((n for (n, _), bad in zip(CLASSES, outside, strict=True) if not bad), "mixed")
        if not digits and (name != "mixed" or not (turns or run[i - w + 1].islower())):
            continue
        if log2(w) - total / w >= rule.thresholds[name]:
            start, end = i - w + 1, i + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
    return spans


def whole_token(run: str, start: int, end: int) -> tuple[int, int]:
    """The part of a candidate that a suspicious span lies in: up to an equals sign on both sides, padding included."""
    left = run.rfind("=", 0, start) + 1
    right = run.find("=", end)
    if right < 0:
        return left, len(run)
    while right < len(run) and run[right] == "=":
        right += 1
    return left, right


def find_secrets(text: str, rule: EntropyRule, candidates: re.Pattern, allowed: re.Pattern):
    """(kind, start, end) of one text, by start, then kind in the order of KINDS."""
    found: list[tuple[int, int, int]] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    runs = [(m.start(), m[0]) for m in candidates.finditer(text)]
    for at, run in runs:
        found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if len(m[0]) >= MIN_HEX]
    base = sorted(found)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for at, run in runs:
        if allowed.fullmatch(run):
            continue
        for s, e in window_spans(run, rule):
            s, e = whole_token(run, s, e)
            s, e = at + s, at + e
            k = bisect_right(starts, s) - 1
            if (k < 0 or reach[k] < e) and (s, 3, e) not in found[-1:]:
                found.append((s, 3, e))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: EntropyRule | None = None
) -> DataFrame:
    """One row per document: ``doc_id`` and ``found``, an array of (kind, start, end).

    Works on whole texts, each row by itself: no shuffle, and repeated rows give repeated
    rows. A null or empty text has no spans. Positions are code points, end exclusive.
    An entropy span is the whole token that a suspicious window was found in; those that lie
    wholly in a base span are not repeated.
    """
    rule = rule or EntropyRule()
    rows = texts(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    candidates = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min(rule.window, MIN_HEX))
    allowed = re.compile("|".join(f"(?:{p})" for p in rule.allowed) or r"(?!)")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t, rule, candidates, allowed)]
            for t in batch.column(1).to_pylist()
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return map_batches(rows, scan, f"doc_id {id_type}, found array<struct<kind:string,start:bigint,end:bigint>>")


def spans_text(found):
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", rule: EntropyRule | None = None) -> DataFrame:
    """The documents, each suspicious span (overlapping ones merged) replaced by ``mark``.

    Keeps every row and column; ``n_chars``, where present, is counted again. A null text
    stays null, an empty one empty. Each row is rewritten where it lies, whole and whatever
    its length, so nothing is shuffled or joined; repeated rows are rewritten alike, and an
    empty table gives no rows.
    """
    rule = rule or EntropyRule()
    candidates = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min(rule.window, MIN_HEX))
    allowed = re.compile("|".join(f"(?:{p})" for p in rule.allowed) or r"(?!)")
    names = docs.columns
    at = names.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done, open_from = [], 0, None
        for _, s, e in find_secrets(text, rule, candidates, allowed):
            if open_from is None or s > done:
                out += [text[done:s], mark]
                open_from, done = s, e
            else:
                done = max(done, e)
        return "".join([*out, text[done:]]) if out else text

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], columns[at].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = map_batches(docs, rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def secrets_digest(docs: DataFrame, rule: EntropyRule | None = None) -> DataFrame:
    """The query's columns, from :func:`scan_secrets`."""
    found = scan_secrets(docs, rule=rule)
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(spans_text(F.filter("found", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
        of("entropy").alias("n_entropy"),
    )


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base result of one text by the patterns alone, for tests."""
    t = text or ""
    all_ = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= MIN_VALUE]
    all_ += [("access", m.start(), m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= MIN_ACCESS]
    all_ += [("hex", m.start(), m.end()) for m in HEX.finditer(t) if len(m[0]) >= MIN_HEX]
    all_.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    count = lambda k: sum(x[0] == k for x in all_)
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in all_)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(joined.encode()).hexdigest()
