"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, member_filter, passes

#: A sentence ends after one of . ! ? and white space, or at a line break. Fixed values.
BOUNDARY = re.compile(r"[.!?][\x20\x09-\x0D]+|[\x0A\x0D]+")
SPACE = " \t\n\v\f\r"
SPAN, MIN_WORDS = 3, 25
_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def split_sentences(text: str) -> list[str]:
    """The sentences that have a word, as they stand in the text."""
    out, at = [], 0
    for m in BOUNDARY.finditer(text):
        end = m.start() + (m[0][0] not in "\n\r")
        out.append(text[at:end])
        at = m.end()
    out.append(text[at:])
    return [s for s in out if s.strip(SPACE)]


def sentence_marks(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, 128-bit hash as two numbers) of sentences in lower case, spaces evened out."""
    words = [p.lower().encode().split() for p in parts]
    raw = b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words)
    return np.array([len(w) for w in words], np.int64), np.frombuffer(raw, "<u8").reshape(-1, 2)


def spans_of(words: np.ndarray, cuts: np.ndarray, span: int | None, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs to hash, in sentences of all texts laid end to end.

    ``cuts`` has the texts' bounds. With ``span`` n: every run of n sentences, and shorter runs
    that have ``min_words`` words. With None: from every sentence the shortest run with
    ``min_words`` words, and the shortest one to every sentence; together they cover every
    run with as many words, as what is left of it at its end lies in the one to its end.
    """
    n = len(words)
    stop = np.repeat(cuts[1:], np.diff(cuts))
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    if span is not None:
        found = []
        for k in range(1, span + 1):
            i = at[at + k <= stop]
            found.append((i if k == span else i[total[i + k] - total[i] >= min_words], k))
        return np.concatenate([i for i, _ in found]), np.concatenate([np.full(len(i), k, np.int64) for i, k in found])
    end = np.searchsorted(total, total[:-1] + min_words)
    ahead = end <= stop
    begin = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    back = (total[1:] >= min_words) & (begin >= np.repeat(cuts[:-1], np.diff(cuts)))
    both = np.unique(np.stack([np.concatenate([at[ahead], begin[back]]), np.concatenate([end[ahead], at[back] + 1])]), axis=1)
    return both[0], both[1] - both[0]


def run_hashes(marks: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash of each run: sums of its sentences' hashes times powers of a base."""
    out = []
    with np.errstate(over="ignore"):
        for lane, base in enumerate(_BASE):
            powers, back = (np.full(len(marks) + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
            powers[0] = back[0] = 1
            powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks[:, lane] * powers[:-1])])
            h = (sums[start + length] - sums[start]) * back[start] + length.astype(np.uint64) * np.uint64(_BASE[1 - lane])
            h = (h ^ (h >> np.uint64(31))) * np.uint64(_BASE[1])
            out.append(h ^ (h >> np.uint64(29)))
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def hashed_spans(docs: DataFrame, span: int | None, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, parts and the runs' at, k, h, g of every document: one written table."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lists = {"at": pa.int32(), "k": pa.int32(), "h": pa.int64(), "g": pa.int32()}
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("parts", pa.list_(pa.string())), *((c, pa.list_(t)) for c, t in lists.items())])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            parts = [split_sentences(t) for t in b.column("text").to_pylist()]
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            words, marks = sentence_marks([s for p in parts for s in p])
            start, length = spans_of(words, cuts, span, min_words)
            h, g = run_hashes(marks, start, length)
            owner = np.searchsorted(cuts, start, side="right") - 1
            order = np.argsort(owner, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(parts)))]).astype(np.int32)
            runs = [(start - cuts[owner])[order], length[order], h[order], g[order]]
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(t.to_pandas_dtype()), t)) for v, t in zip(runs, lists.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.list_(pa.string())), *arrays], schema=schema)

    return materialize(rows.mapInArrow(one, "row bigint, doc_id bigint, parts array<string>, at array<int>, k array<int>, h array<bigint>, g array<int>"), "spans")


def by_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def repeated_runs(base: DataFrame) -> DataFrame:
    """The runs (row, doc_id, at, k) whose hash another place has too, with ``first_id`` and whether they are that ``first`` place.

    A hash's first place is the one of the smallest (doc_id, row, place). Counts and least ids
    are summed up in each task before rows move, so a span that a third of all documents
    share costs one row a task; a bitset of the repeated hashes lets only their runs move.
    """
    last = F.lit((1 << 63) - 1)
    each = base.select(F.coalesce("doc_id", last).alias("d"), F.explode(F.arrays_zip("h", "g")).alias("x")).select("x.h", "x.g", "d")
    again = materialize(each.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_id")).filter("n > 1").drop("n"), "again")
    shared = base.sparkSession.sparkContext.broadcast(member_filter(again.select("h")))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_rows(batches):
            flat = [b.column(c).flatten() for c in ("at", "k", "h", "g")]
            keep = passes(shared.value, flat[2].to_numpy()) if len(flat[2]) else np.zeros(0, bool)
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(b.column("h").offsets)))[keep]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(owner)) for c in ("row", "doc_id")), *(c.filter(pa.array(keep)) for c in flat)], ["row", "doc_id", "at", "k", "h", "g"])

    met = base.select("row", "doc_id", "at", "k", "h", "g").mapInArrow(likely, "row bigint, doc_id bigint, at int, k int, h bigint, g int")
    met = materialize(met.join(again, ["h", "g"]), "met")
    own = met.filter(F.coalesce("doc_id", last) == F.col("first_id"))
    firsts = own.groupBy("h", "g").agg(F.min(F.struct("row", "at")).alias("p")).select("h", "g", F.col("p.row").alias("row"), F.col("p.at").alias("at"), F.lit(True).alias("first"))
    return met.join(firsts, ["h", "g", "row", "at"], "left").select("row", "doc_id", "at", "k", "first_id", F.coalesce("first", F.lit(False)).alias("first"))


def rows_passing(base: DataFrame, rows: DataFrame, wanted: bool) -> DataFrame:
    """row, doc_id, parts of the rows that a bitset of ``rows`` lets pass, or of the others; nothing moves."""
    shared = base.sparkSession.sparkContext.broadcast(member_filter(rows.select(F.xxhash64("row").alias("h"))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_rows(batches):
            good = passes(shared.value, b.column(0).to_numpy()) == wanted
            if good.any():
                yield b.select(["row", "doc_id", "parts"]).filter(pa.array(good))

    return base.select(F.xxhash64("row").alias("h"), "row", "doc_id", "parts").mapInArrow(keep, "row bigint, doc_id bigint, parts array<string>")


def repeated_sentences(
    docs: DataFrame, min_words: int = MIN_WORDS, span: int | None = SPAN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document with its sentences and those that a repeated span covers.

    Every run of ``span`` consecutive sentences is hashed, whatever its words, and every
    shorter one that has ``min_words`` words (96 bits each); the hashes are joined over all
    documents. Longer repeats are covered by their runs. With ``span`` None only runs with
    ``min_words`` words count, of any number of sentences, and each goes in full.
    A hash's first place is the one of the smallest (doc_id, row, place); sentences that any
    other of its places covers are marked. Returns doc_id, row, parts, removed (sorted
    places), first_ids (sorted doc_ids of the first places). Works within a document too.
    Null and empty texts have no sentences; a null doc_id comes after all others. Repeated
    rows keep a row each, and all but the first lose what they repeat.
    """
    base = hashed_spans(docs, span, min_words, id_col, text_col)
    again = repeated_runs(base).filter(~F.col("first"))
    covered = again.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("k") - 1))))).alias("removed"),
        F.array_sort(F.collect_set("first_id")).alias("first_ids"),
    )
    covered = materialize(covered, "covered")
    none = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    met = rows_passing(base, covered, True).join(covered, "row", "left").withColumns({"removed": F.coalesce("removed", none[0]), "first_ids": F.coalesce("first_ids", none[1])})
    rest = rows_passing(base, covered, False).withColumns({"removed": none[0], "first_ids": none[1]})
    columns = "doc_id", "row", "parts", "removed", "first_ids"
    return met.select(*columns).unionByName(rest.select(*columns))


def drop_repeats(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, row, text: the sentences that stay, one a line; a document that loses all is empty."""
    found = repeated_sentences(docs, **settings)
    kept = F.filter("parts", lambda p, i: ~F.array_contains("removed", i))
    return found.select("doc_id", "row", F.array_join(kept, "\n").alias("text"))


def repeats_digest(docs: DataFrame, **settings) -> DataFrame:
    """The query's rows: documents that lose sentences, where their first copies are, and a hash of what stays.

    Nulls, empty texts, ties and repeated rows as in :func:`repeated_sentences`; an empty
    table gives no rows.
    """
    found = repeated_sentences(docs, **settings).filter(F.size("removed") > 0).withColumnsRenamed({"removed": "gone", "first_ids": "firsts"})
    kept = F.filter("parts", lambda p, i: ~F.array_contains("gone", i))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select(
        "doc_id",
        F.size("parts").cast("long").alias("n_sentences"),
        F.size("gone").cast("long").alias("n_removed"),
        joined("gone").alias("removed"),
        joined("firsts").alias("first_doc_ids"),
        F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"),
    )


def oracle_sql(min_words: int = MIN_WORDS, span: int = SPAN) -> str:
    """The same rows in DuckDB's SQL; doc_ids must differ."""
    lead = lambda c, j: f"lead({c}, {j}) OVER w" if j else c
    words = lambda k: " + ".join(lead("n", j) for j in range(k))
    text = lambda k: " || chr(2) || ".join(lead("flat", j) for j in range(k))
    space = "[ \\t\\n\\x0B\\f\\r]+"
    runs = " UNION ALL ".join(
        f"SELECT doc_id, pos, {k} AS k, t FROM (SELECT doc_id, pos, {text(k)} AS t, {words(k)} AS w FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE t IS NOT NULL" + ("" if k == span else f" AND w >= {min_words}")
        for k in range(1, span + 1)
    )
    return f"""WITH cut AS (
          SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?]){space}|[\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS list FROM documents),
        raw AS (SELECT doc_id, unnest(list) AS s, generate_subscripts(list, 1) AS i FROM cut),
        flats AS (SELECT doc_id, i, s, trim(regexp_replace(lower(s), '{space}', ' ', 'g')) AS flat FROM raw),
        parts AS (SELECT doc_id, s, flat, length(flat) - length(replace(flat, ' ', '')) + 1 AS n,
                         row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM flats WHERE flat <> ''),
        runs AS MATERIALIZED ({runs}),
        firsts AS (SELECT k, t, min(struct_pack(d := doc_id, a := pos)) AS f FROM runs GROUP BY k, t HAVING count(*) > 1),
        again AS (SELECT doc_id, pos, runs.k AS k, f.d AS d FROM runs JOIN firsts USING (k, t) WHERE doc_id <> f.d OR pos <> f.a),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS pos FROM again),
        named AS (SELECT doc_id, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS first_doc_ids FROM (SELECT DISTINCT doc_id, d FROM again) GROUP BY doc_id),
        sums AS (SELECT p.doc_id, count(*) AS n_sentences, count(g.pos) AS n_removed, string_agg(CAST(g.pos AS VARCHAR), ',' ORDER BY g.pos) FILTER (g.pos IS NOT NULL) AS removed,
                        coalesce(string_agg(s, chr(10) ORDER BY p.pos) FILTER (g.pos IS NULL), '') AS kept
                 FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
        SELECT doc_id, n_sentences, n_removed, removed, first_doc_ids, sha256(kept) AS kept_sha256 FROM sums JOIN named USING (doc_id) WHERE n_removed > 0"""
