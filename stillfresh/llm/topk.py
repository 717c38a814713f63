"""Exact top-k by inner product: three phases with a uniform threshold.

Each vector's dimensions are split into lists; a score is the sum of its local scores. Phase
one gathers the best local scores of each list, and the k-th best sum among the rows found is
a safe cutoff: a row whose local scores all lie under cutoff / lists has a sum under it. Phase
two collects the entries at or over that uniform threshold, which are sufficient, and drops
rows whose upper bound stays under the cutoff. Phase three resolves what these rows lack, in
the task that has their vectors, so only the best few of each tile and query move on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LISTS = 2
TILE = 4096
QUERY_TILE = 1024


def quantized(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, floor(scale * x) of every component; vectors that are null, or hold null or non-finite components, are left out."""
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    good = x.isNotNull() & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return rows.filter(good).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def vector_groups(rows: DataFrame, k: int) -> DataFrame:
    """v and ids: each distinct vector with its k + 1 smallest ids; more can't be in a result.

    The window keeps k + 1 rows of a group in each task before rows move, so copies of one
    vector never meet in one place.
    """
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id")))).filter(F.col("n") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros, which add nothing."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy()
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def local_scores(q: np.ndarray, v: np.ndarray, lists: int) -> np.ndarray:
    """(lists, queries, vectors): exact inner products over each stretch of dimensions."""
    exact = np.abs(q).max(initial=0) * float(np.abs(v).max(initial=0)) * q.shape[1] < 2**53
    kind = np.float64 if exact else np.int64
    cuts = np.linspace(0, q.shape[1], lists + 1).astype(int)
    return np.stack([(q[:, a:b].astype(kind) @ v[:, a:b].astype(kind).T).astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)])


def on_grid(queries: DataFrame, tiles: DataFrame, n_query_tiles: int, n_tiles: int, work, schema: str) -> DataFrame:
    """``work(queries, vectors)`` on every pair of a block of queries and a tile of vectors."""
    left = queries.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    right = tiles.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_query_tiles - 1))))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return work(a.combine_chunks(), b.combine_chunks())

    return left.groupBy("b", "t").cogroup(right.groupBy("b", "t")).applyInArrow(both, schema)


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, lists: int = LISTS, tile: int = TILE, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_tile: int = QUERY_TILE
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by integer inner product.

    Queries are the rows whose id is divisible by ``every``; ties go to smaller ids. Equal
    vectors are searched once and share their result, from which each query drops itself, so
    a vector of a third of all rows costs one row. Vectors of unequal length are compared as
    if filled up with zeros. Null ids take no part, nor do vectors that are null or hold null
    or non-finite components. Rows equal in id and vector are one row; rows that share an id
    only are rows of their own, each a query and a candidate of the others. Fewer than k other
    rows give fewer ranks; an empty table, none.
    """
    rows = quantized(vectors, scale, id_col, vector_col).filter("vec_id IS NOT NULL").distinct()
    groups = materialize(vector_groups(rows, k).withColumn("vid", F.monotonically_increasing_id()), "groups")
    asked = materialize(rows.filter(F.col("vec_id") % every == 0), "asked")
    of_query = asked.select("v").distinct().join(groups.select("v", "vid"), "v").select(F.col("vid").alias("qid"), F.col("v").alias("q"))
    shape = groups.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, width = shape.n or 0, max(lists, shape.d or 0)
    n_tiles = max(1, -(-n // tile))
    queries = materialize(of_query.withColumn("h", F.xxhash64("qid")), "queries")
    n_blocks = max(1, -(-queries.count() // query_tile))
    queries = queries.select("qid", "q", F.pmod("h", F.lit(n_blocks)).cast("int").alias("b"))
    tiles = groups.select("vid", "v", F.col("ids")[0].alias("least"), F.pmod(F.xxhash64("vid"), F.lit(n_tiles)).cast("int").alias("t"))
    take = k + 1  # one may be the query itself
    none = pa.table({x: pa.array([], pa.int64()) for x in ("qid", "total", "vid", "least")})
    schema = "qid bigint, total bigint, vid bigint, least bigint"

    def scores(a: pa.Table, b: pa.Table) -> np.ndarray:
        return local_scores(matrix(a["q"].combine_chunks(), width), matrix(b["v"].combine_chunks(), width), lists)

    def found(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray, total: np.ndarray) -> pa.Table:
        """The best ``take`` of the rows j for each query i; equal scores by least id."""
        least = b["least"].to_numpy()
        order = np.lexsort((least[j], -total, i))
        i, j, total = i[order], j[order], total[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < take
        return pa.table({"qid": a["qid"].to_numpy()[i[keep]], "total": total[keep], "vid": b["vid"].to_numpy()[j[keep]], "least": least[j[keep]]})

    def gather(a: pa.Table, b: pa.Table) -> pa.Table:
        """Phase one: the rows with the best local scores of each list, and their sums."""
        if not len(a) or not len(b):
            return none
        s = scores(a, b)
        m = min(take, s.shape[2])
        best = np.concatenate([np.argpartition(-one, m - 1, axis=1)[:, :m] for one in s], axis=1)
        pairs = np.unique(np.stack([np.repeat(np.arange(len(a)), best.shape[1]), best.ravel()], axis=1), axis=0)
        i, j = pairs.T
        return found(a, b, i, j, s[:, i, j].sum(axis=0))

    order = Window.partitionBy("qid").orderBy(F.desc("total"), "least")
    seen = on_grid(queries, tiles, n_blocks, n_tiles, gather, schema)
    ranked = seen.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= take)
    cutoff = ranked.groupBy("qid").agg(F.min("total").alias("low"), F.count(F.lit(1)).alias("m"))
    # with fewer rows than asked for, every row is sufficient
    cutoff = materialize(cutoff.select("qid", F.when(F.col("m") >= take, F.col("low")).alias("cutoff")), "cutoff")

    def collect(a: pa.Table, b: pa.Table) -> pa.Table:
        """Phases two and three: entries at or over cutoff / lists; bounds; what is missing."""
        if not len(a) or not len(b):
            return none
        s = scores(a, b)
        known = a["cutoff"].is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        limit = a["cutoff"].fill_null(0).to_numpy()
        sent = (s * lists >= limit[None, :, None]) | ~known[None, :, None]
        i, j = np.nonzero(sent.any(axis=0))
        local, has = s[:, i, j], sent[:, i, j]
        # a list that sent nothing has less than cutoff / lists for this row
        upper = (local * has).sum(axis=0) * lists + limit[i] * (lists - has.sum(axis=0))
        stay = ~known[i] | (upper >= limit[i] * lists)
        i, j, local, has = i[stay], j[stay], local[:, stay], has[:, stay]
        total = (local * has).sum(axis=0)
        total += (local * ~has).sum(axis=0)  # the missing cells, from the vectors at hand
        return found(a, b, i, j, total)

    kept = on_grid(queries.join(cutoff, "qid"), tiles, n_blocks, n_tiles, collect, schema)
    few = kept.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= take).select("qid", "vid", F.col("total").alias("score"))
    scored = few.join(groups.select("vid", "ids"), "vid").select("qid", "score", (F.col("qid") == F.col("vid")).alias("same"), F.explode("ids").alias("vec_id"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= take)
    lists_of = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score", "same"))).alias("best"))
    named = of_query.join(lists_of, "qid").select("q", "best")
    out = asked.join(named, F.col("v") == F.col("q")).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda x: ~(x["same"] & (x["vec_id"] == F.col("vec_id")))), 1, k).alias("best"))
    return out.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


ORACLE_SQL = """
  WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
