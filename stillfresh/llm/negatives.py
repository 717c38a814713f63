"""Exact hard-negative mining over an inverted multi-index.

Vectors are cut into two halves, each with a codebook; a pair of codes is a cell. For a query,
a half score of a code is the inner product with its centre plus the query's length times the
code's radius: no vector of the code exceeds it. The sum of two half scores bounds every
vector of the cell, and a heap walks the cells by falling sums (the multi-sequence walk). Cells
are visited in rounds, each some times larger than all before; a query's window of scores is
certified when no cell that is left can hold a row that belongs among its best, and then it
stops. A round is one job: visits are dealt by cell to the tasks that have the cell's vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, row_fraction
from .topk import matrix

SAMPLE = 20_000
CODE_ROWS = 512
MOST_CODES = 256
TILE = 1024
ASKERS = 1024
FIRST_ROWS, GROWTH = 4096, 4
LOWEST, HIGHEST = -(1 << 62), 1 << 62


class Codebooks:
    """Centres of both halves, and each code's radius, measured over all rows."""

    def __init__(self, centres: list[np.ndarray], width: int):
        self.centres, self.width, self.cut = centres, width, width // 2
        self.radii = [np.zeros(len(c)) for c in centres]
        self.cells: dict[int, int] = {}
        self.tile = TILE

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = v.astype(np.float64)
        return v[:, : self.cut], v[:, self.cut :]

    def codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(2, n) codes and distances to their centres."""
        out = [closest(x, c) for x, c in zip(self.halves(v), self.centres, strict=True)]
        return np.stack([o[0] for o in out]), np.stack([o[1] for o in out])

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half, the most that a vector of each code scores with each query.

        A little more than exact arithmetic gives, so that rounding can't lose a row.
        """
        out = []
        for x, c, r in zip(self.halves(q), self.centres, self.radii, strict=True):
            size = np.sqrt((x * x).sum(1))[:, None]
            far = np.sqrt((c * c).sum(1))[None]
            out.append(x @ c.T + size * r[None] + 1e-9 * (1 + size * (far + r[None])))
        return out


def closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (centres * centres).sum(1)[None] - 2 * (x @ centres.T)
    code = d.argmin(1)
    return code, np.sqrt(((x - centres[code]) ** 2).sum(1))


def half_codebook(x: np.ndarray, codes: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Lloyd's centres of a bounded sample; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(codes, len(x)), replace=False)]
    for _ in range(rounds):
        code = closest(x, centres)[0]
        n = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def multi_sequence(a: np.ndarray, b: np.ndarray, cells: dict[int, int], skip: int, rows: int) -> tuple[list[int], float | None]:
    """Cells after the first ``skip`` by falling sum of half bounds, until they have ``rows`` rows; the next cell's bound.

    ``cells`` has the number of rows of each cell that isn't empty. None: no cell is left.
    """
    first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen, out, met, held = [(-(a[first[0]] + b[second[0]]), 0, 0)], {(0, 0)}, [], 0, 0
    while heap:
        bound, i, j = heap[0]
        n = cells.get(int(first[i]) * len(b) + int(second[j]), 0)
        if n and met >= skip and held >= rows:
            return out, -bound
        heapq.heappop(heap)
        if n:
            if met >= skip:
                out.append(int(first[i]) * len(b) + int(second[j]))
                held += n
            met += 1
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[first[x]] + b[second[y]]), x, y))
    return out, None


def build_index(rows: DataFrame, sample: int = SAMPLE, code_rows: int = CODE_ROWS, tile: int = TILE) -> tuple[DataFrame, Codebooks]:
    """A written table of vec_id, label, v, cell and part, and its codebooks.

    Codebooks are fitted on about ``sample`` rows; every row is put into its cell, and radii
    cover all rows. The number of codes grows with the root of the table, up to 256 a half, so
    at most 65,536 cells pass the driver. A cell is cut into parts of about ``tile`` rows.
    """
    rows = materialize(rows, "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    width = max(2, facts.d or 0)
    fraction = row_fraction(rows, sample)
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) < int(np.ceil(fraction * (1 << 20)))).select("vec_id", "v").orderBy("vec_id", "v").limit(2 * sample).toArrow()
    codes = int(min(MOST_CODES, max(2, np.ceil(np.sqrt(facts.n / code_rows)))))
    if picked.num_rows:
        v = matrix(picked.column(1).combine_chunks(), width)
        books = Codebooks([], width)
        books = Codebooks([half_codebook(x, codes) for x in books.halves(v)], width)
    else:
        books = Codebooks([np.zeros((1, width // 2)), np.zeros((1, width - width // 2))], width)
    n_second = len(books.centres[1])

    def place(batches):
        for b in batches:
            code, away = books.codes(matrix(b.column(2), width))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (code[0] * n_second + code[1], away[0], away[1]))], names=["vec_id", "label", "v", "cell", "r0", "r1"])

    coded = materialize(rows.select("vec_id", "label", "v").mapInArrow(place, "vec_id bigint, label bigint, v array<bigint>, cell bigint, r0 double, r1 double"), "cells")
    for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r0").alias("r0"), F.max("r1").alias("r1")).collect():
        books.cells[r.cell] = r.n
        for half, code in enumerate(divmod(r.cell, n_second)):
            books.radii[half][code] = max(books.radii[half][code], r[f"r{half}"])
    books.tile = tile
    cut = coded.join(F.broadcast(cell_table(rows.sparkSession, books)), "cell")
    return cut.select("vec_id", "label", "v", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int").alias("part")), books


def cell_table(spark: SparkSession, books: Codebooks) -> DataFrame:
    """cell, n and parts: at most 65,536 rows."""
    return spark.createDataFrame([(c, n, -(-n // books.tile)) for c, n in books.cells.items()], "cell bigint, n bigint, parts int")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each window; ties to smaller ids."""
    order = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "vec_id", "label")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def search(index: DataFrame, books: Codebooks, asks: DataFrame, k: int, same_label: bool, first_rows: int = FIRST_ROWS, growth: int = GROWTH, report: list[int] | None = None) -> DataFrame:
    """aid, w, vec_id, label, score, r: the k best rows of each window of scores.

    ``asks`` has aid, vec_id, label, q and windows, an array of (w, lo, hi). A row belongs to a
    window if its score lies in it, its label is the asker's (or another, as ``same_label``
    says) and its id is another. ``report`` gets the number of products of each round.
    """
    width, schema = books.width, "aid bigint, w int, vec_id bigint, label bigint, score bigint"
    fields = ["aid", "w", "vec_id", "label", "score"]
    none = pa.table({"aid": pa.array([], pa.int64()), "w": pa.array([], pa.int32()), **{x: pa.array([], pa.int64()) for x in fields[2:]}})

    def visits_of(rows: int):
        def walk(batches):
            for b in batches:
                bounds = books.bounds(matrix(b.column(1), width))
                done, out, left = b.column(2).to_pylist(), [], []
                for i, skip in enumerate(done):
                    cells, bound = multi_sequence(bounds[0][i], bounds[1][i], books.cells, skip, rows)
                    out.append(cells)
                    left.append(bound)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64())), pa.array(left, pa.float64())], names=["aid", "cells", "left"])

        return walk

    def products(a: pa.Table, b: pa.Table) -> pa.Table:
        """The best rows of a part of a cell for each window that visits it."""
        if not len(a) or not len(b):
            return none
        a, b = a.combine_chunks(), b.combine_chunks()
        q, v = matrix(a["q"].combine_chunks(), width), matrix(b["v"].combine_chunks(), width)
        exact = np.abs(q).max(initial=0) * float(np.abs(v).max(initial=0)) * width < 2**53
        kind = np.float64 if exact else np.int64
        scores = (q.astype(kind) @ v.astype(kind).T).astype(np.int64)
        ids, labels = b["vec_id"].to_numpy(), b["label"].to_numpy()
        own, own_label = a["vec_id"].to_numpy(), a["label"].to_numpy()
        out = []
        for i, (aid, windows) in enumerate(zip(a["aid"].to_pylist(), a["windows"].to_pylist(), strict=True)):
            s = scores[i]
            fits = ((labels == own_label[i]) == same_label) & (ids != own[i])
            fits &= (s >= min(w["lo"] for w in windows)) & (s <= max(w["hi"] for w in windows))
            at = np.flatnonzero(fits)
            at = at[np.lexsort((labels[at], ids[at], -s[at]))]
            for w in windows:
                start = np.searchsorted(-s[at], -w["hi"])
                for j in at[start : start + k]:
                    if s[j] < w["lo"]:
                        break
                    out.append((aid, w["w"], int(ids[j]), int(labels[j]), int(s[j])))
        return pa.table(dict(zip(fields, map(list, zip(*out, strict=True)), strict=True)), schema=none.schema) if out else none

    spark = index.sparkSession
    cells = cell_table(spark, books)
    found = spark.createDataFrame([], schema)
    open_asks = materialize(asks.select("aid", "vec_id", "label", "q", "windows").withColumn("done", F.lit(0)), "asks")
    rows = first_rows
    while True:
        walked = materialize(open_asks.select("aid", "q", "done").mapInArrow(visits_of(rows), "aid bigint, cells array<bigint>, left double"), "walked")
        visits = walked.select("aid", F.explode("cells").alias("cell"))
        blocks = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("blocks"))  # a row for each cell
        blocks = materialize(blocks, "blocks")
        askers = visits.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("aid"), F.col("blocks")).cast("int"))
        left = askers.join(F.broadcast(cells.select("cell", "parts")), "cell").join(open_asks, "aid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = index.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = left.select("cell", "part", "block", "aid", "vec_id", "label", "q", "windows")
        right = right.select("cell", "part", "block", "vec_id", "label", "v")
        if report is not None:
            report.append(visits.join(F.broadcast(cells), "cell").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        new = left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(products, schema)
        found = materialize(best_of(found.unionByName(new), k).select(*fields, "r"), "found")
        last = found.groupBy("aid", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        each = open_asks.join(walked, "aid").filter("left IS NOT NULL").select("aid", "vec_id", "label", "q", "left", (F.col("done") + F.size("cells")).alias("done"), F.explode("windows").alias("x"))
        # a window of k rows takes no row under its least score; one with fewer takes all in its range
        floor = F.when(F.col("n") >= k, F.col("least")).otherwise(F.col("x.lo"))
        still = each.select("*", F.col("x.w").alias("w")).join(last, ["aid", "w"], "left").withColumn("lo", F.coalesce(floor, F.col("x.lo"))).filter(F.col("left") >= F.col("lo"))
        windows = F.collect_list(F.struct("w", "lo", F.col("x.hi").alias("hi"))).alias("windows")
        again = still.groupBy("aid", "done").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("q").alias("q"), windows)
        open_asks = materialize(again.select("aid", "vec_id", "label", "q", "windows", "done"), "asks")
        if open_asks.isEmpty():
            return found
        found = found.drop("r")
        rows *= growth


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    relabel_every: int | None = 7,
    classes: int = 10,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    report: list[int] | None = None,
    **index_options: int,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``; their positives the best other rows
    of the same label, and a positive's negatives the best rows of other labels whose score is
    ``low`` to ``high`` hundredths of the positive's (none where that is negative). Scores are
    integer inner products of ``floor(scale * x)``; higher ones first, ties by smaller id.
    Where the id is divisible by ``relabel_every``, the label first becomes (label + 1) modulo
    ``classes``; None leaves all labels. Vectors of unequal length are compared as if filled
    up with zeros. Rows with a null id or label, or a vector that is null or holds null or
    non-finite components, take no part. Rows equal in id, vector and label are one row; rows
    that share an id only are rows of their own, none of which is another's positive or
    negative, and an anchor each. No rows: no rows. Other columns don't matter.
    """
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    label = F.col("label")
    if relabel_every:
        label = F.when(F.col("vec_id") % relabel_every == 0, F.pmod(label + 1, F.lit(classes))).otherwise(label)
    rows = kept.filter(F.col("vec_id").isNotNull() & label.isNotNull() & F.col("x").isNotNull() & finite)
    rows = rows.select("vec_id", label.alias("label"), F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")).distinct()
    index, books = build_index(rows, **index_options)
    anchors = index.filter(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("aid"), "vec_id", "label", F.col("v").alias("q"))
    anchors = materialize(anchors, "anchors")
    window = lambda w, lo, hi: F.struct(w.cast("int").alias("w"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    everything = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(LOWEST), F.lit(HIGHEST))))
    near = search(index, books, everything, positives, True, report=report)
    p = F.col("score")
    span = near.withColumn("lo", F.expr(f"(score * {low} + 99) div 100")).withColumn("hi", F.expr(f"(score * {high}) div 100")).filter("score >= 0")
    asks = anchors.join(span.groupBy("aid").agg(F.collect_list(window(F.col("r"), F.col("lo"), F.col("hi"))).alias("windows")), "aid")
    hard = search(index, books, asks, negatives, False, report=report)
    pairs = near.select("aid", F.col("r").alias("w"), F.col("vec_id").alias("positive_id"), p.alias("positive_score"))
    out = hard.select("aid", "w", "r", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["aid", "w"]).join(anchors.select("aid", "vec_id"), "aid")
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("r").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
  WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
             WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
  n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
  SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
