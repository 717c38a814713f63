"""Exact centroid clustering with a pivot table (LAESA): stored pivot distances spare exact ones.

The distance of every vector to a few fixed pivots is computed once and written beside the
vector. In each round the centroids' distances to the pivots are computed on the driver; by
the triangle inequality the largest difference of the two over all pivots is a lower bound of
the distance between a vector and a centroid. Centroids are visited by rising bound; those
whose bound is over the best exact distance so far fall out, the others get exact integer
distances. Sums of clusters are added up inside tasks before a row moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .topk import matrix, quantized

DIMS, CENTROIDS, ROUNDS, PIVOTS = 64, 40, 5, 8
#: Components up to this size leave every squared distance and pivot difference exact in a long.
LARGEST = 1 << 26


def start_vectors(vectors: DataFrame, k: int, seed: str) -> list[tuple[int, ...]]:
    """The k vectors whose ids have the smallest sha256 of ``seed``:id, in that order; ties by vector, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [tuple(r.v) for r in vectors.withColumn("h", key).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each the farthest from those before it; the first is the first."""
    if not len(points):
        return points
    chosen, away = [0], squared(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, squared(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len a, len b): exact squared distances of integer vectors."""
    most = 2.0 * max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    kind = np.float64 if most * most * a.shape[1] < 2**52 else np.int64
    x, y = a.astype(kind), b.astype(kind)
    return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties: the smaller number), its squared distance, and how many distances were computed.

    ``to_pivots`` and ``pivots_of`` hold distances of vectors and centroids to the pivots. The
    bounds are lowered by more than rounding can add, so no nearest centroid falls out.
    """
    bound = np.zeros((len(v), len(centroids)))
    for p in range(pivots_of.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - pivots_of[None, :, p]), out=bound)
    slack = 1e-9 * (1 + to_pivots.max(axis=1, initial=0) + pivots_of.max(initial=0))
    low = np.maximum(bound - slack[:, None], 0) ** 2
    order = np.argsort(low, axis=1, kind="stable")
    best, which = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), len(centroids))
    active, computed = np.arange(len(v)), 0
    for step in range(len(centroids)):
        c = order[active, step]
        alive = low[active, c] <= best[active]
        active, c = active[alive], c[alive]
        if not len(active):
            break
        away = v[active] - centroids[c]
        d = np.einsum("ij,ij->i", away, away)
        computed += len(active)
        better = (d < best[active]) | ((d == best[active]) & (c < which[active]))
        best[active[better]], which[active[better]] = d[better], c[better]
    return which, best, computed


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(v, pivots).astype(np.float64))


def pivot_table(rows: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """vec_id, v and away, the distances to the pivots: written once and read in every round."""

    def measure(batches):
        for b in small_batches(batches):
            away = distances(matrix(b.column(1), dims), pivots)
            places = np.arange(len(away) + 1, dtype=np.int32) * away.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(places, away.reshape(-1))], names=["vec_id", "v", "away"])

    return materialize(rows.select("vec_id", "v").mapInArrow(measure, "vec_id bigint, v array<bigint>, away array<double>"), "pivots")


def parts_of(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    away = b.column(2).flatten().to_numpy()
    return matrix(b.column(1), dims), away.reshape(b.num_rows, -1)


def round_sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> list:
    """Rows of cluster, n, inertia, computed and the sum of each component, for clusters that have vectors.

    A task adds its vectors up and sends a row for each cluster, whatever it read.
    """
    dims, k, pivots_of = centroids.shape[1], len(centroids), distances(centroids, pivots)
    names = ["n", "inertia", "computed", *(f"s{i}" for i in range(dims))]

    def add(batches):
        total = np.zeros((k, 3 + dims), np.int64)
        for b in small_batches(batches):
            v, away = parts_of(b, dims)
            which, best, computed = nearest(v, away, centroids, pivots_of)
            order = np.argsort(which, kind="stable")
            at = np.flatnonzero(np.diff(which[order], prepend=-1))
            total[which[order][at], 3:] += np.add.reduceat(v[order], at, axis=0)
            total[which[order][at], 1] += np.add.reduceat(best[order], at)
            total[:, 0] += np.bincount(which, minlength=k)
            total[0, 2] += computed
        full = np.flatnonzero(total[:, 0] | total[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(full), *map(pa.array, total[full].T)], names=["cluster", *names])

    sums = table.mapInArrow(add, "cluster bigint, " + ", ".join(f"{x} bigint" for x in names))
    return sums.groupBy("cluster").agg(*(F.sum(x).alias(x) for x in names)).collect()


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    n_pivots: int = PIVOTS,
    seed: str = "2",
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    report: list[float] | None = None,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: Lloyd's rounds in exact integers.

    Vectors are ``floor(scale * x)``; those that are null, have another number of components
    than ``dims``, or hold null or non-finite ones are left out. Centroids start as the k
    vectors with the smallest sha256 of ``seed``:id. Each round assigns every vector to the
    nearest centroid (ties: the smaller number) and moves every non-empty centroid to the floor
    of its mean; a last assignment follows. Rows that repeat an id are vectors of their own;
    null ids are clustered, and start a centroid only if other ids are too few. Fewer than k
    vectors give fewer centroids; equal starts leave the later one empty. No vectors: no rows.
    A component over 2^26 after scaling is an error, as distances would not fit a long. Other
    columns of ``vectors`` are ignored, whatever their names. Centroids, pivots and a round's
    sums are all that passes the driver: k rows each. ``report`` gets, for each assignment, the
    share of exact distances that was computed.
    """
    rows = quantized(vectors, scale, id_col, vector_col).filter(F.size("v") == dims)
    starts = start_vectors(rows, k, seed)
    if not starts:
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    largest = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    if largest > LARGEST:
        raise ValueError(f"a component of {largest} after scaling: squared distances would not fit a long")
    centroids = np.array(starts, np.int64)
    pivots = far_apart(centroids, n_pivots)
    table = pivot_table(rows, pivots, dims)
    for _ in range(rounds):
        sums = round_sums(table, centroids, pivots)
        for r in sums:
            if r["n"]:
                centroids[r["cluster"]] = np.array(r[4:], np.int64) // r["n"]
        note(report, sums, k=len(centroids))
    last = round_sums(table, centroids, pivots)
    note(report, last, k=len(centroids))
    pivots_of = distances(centroids, pivots)
    inertia = np.zeros(len(centroids), np.int64)
    for r in last:
        inertia[r["cluster"]] = r["inertia"]
    names = pa.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids])

    def assign(batches):
        for b in small_batches(batches):
            v, away = parts_of(b, dims)
            which, best, _ = nearest(v, away, centroids, pivots_of)
            out = [b.column(0), pa.array(which, pa.int32()), pa.array(best), pa.array(inertia[which]), pa.array(np.full(len(v), inertia.sum())), names.take(pa.array(which))]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return table.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")


def note(report: list[float] | None, sums: list, k: int) -> None:
    if report is not None:
        report.append(sum(r["computed"] for r in sums) / max(1, k * sum(r["n"] for r in sums)))


def oracle_sql(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: str = "2") -> str:
    """The same in DuckDB's SQL: one pair of views for each round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v AS m FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    distance = "CAST(list_sum(list_transform(list_zip(v.v, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min((d, c)) AS best FROM (SELECT v.vec_id, v.v, c.c, {distance} AS d FROM v, c{i} c) GROUP BY vec_id)")
        if i < rounds:
            floors = ", ".join(f"CAST(floor(sum(v[{j}])::DOUBLE / count(*)) AS BIGINT)" for j in range(1, dims + 1))
            parts.append(f"m{i} AS MATERIALIZED (SELECT best[2] AS c, [{floors}] AS m FROM a{i} GROUP BY 1)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.m, c.m) AS m FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return f"""WITH {", ".join(parts)}
        SELECT a.vec_id, CAST(a.best[2] AS INTEGER) AS cluster, CAST(a.best[1] AS BIGINT) AS distance,
               CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best[2]"""
