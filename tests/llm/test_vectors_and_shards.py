"""Hard negatives, centroid clustering and the hash ring against brute force, on odd rows too."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stillfresh.llm import centroids, negatives, ring

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, cell string, v string, part int"


def vec(i, x, label=1):
    return (i, x, label, 3, "c", "v", 0)


def odd_rows(dims, rng):
    x = lambda: rng.normal(size=dims).round(2).tolist()
    return [vec(900, None), vec(901, [*x()[:-1], None]), vec(902, [*x()[:-1], float("nan")]), vec(903, [*x()[:-1], float("inf")]), vec(None, x()), vec(904, x(), None), vec(905, [])]


def grouped(n, dims, groups, rng, spread=0.2):
    """Vectors around a few centres: a third of all rows is one vector."""
    centre = rng.normal(size=(groups, dims))
    return [centre[0].round(2).tolist() if i % 3 == 0 else (centre[i % groups] + rng.normal(size=dims) * spread).tolist() for i in range(n)]


def brute_negatives(rows, every=100, k=5, m=10):
    kept = set()
    for i, x, label, *_ in rows:
        if i is not None and label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * c)) for c in x)))
    out = []
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    for a, la, va in kept:
        if a % every == 0:
            scored = sorted((-dot(va, v), i, lab) for i, lab, v in kept if i != a)
            for s, p, _ in [t for t in scored if t[2] == la][:k]:
                fits = [t for t in scored if t[2] != la and 30 * -s <= 100 * -t[0] <= 90 * -s][:m]
                out += [(a, p, r + 1, t[1], -s, -t[0]) for r, t in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"code_rows": 4, "tile": 7}])
def test_hard_negatives(spark, options):
    rng = np.random.default_rng(1)
    rows = [vec(i, x, int(rng.integers(4))) for i, x in enumerate(grouped(230, 12, 6, rng))]
    rows += [vec(i, x, 2) for i, x, *_ in rows[90:110]] + rows[100:103] * 3 + [vec(300, rows[5][1][:7], 1), vec(400, [0.0] * 12, 1)] + odd_rows(12, rng)
    out = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == brute_negatives(rows)


def test_hard_negatives_stop_early(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(9, 16))
    rows = [vec(i, (centre[i % 9] + rng.normal(size=16) * 0.02).tolist(), int(rng.integers(3))) for i in range(2000)]
    report = []
    asked = spark.createDataFrame(rows, VECTORS)
    rows_index, books = negatives.build_index(asked.select("vec_id", F.col("label").cast("long"), F.transform("embedding", lambda c: F.floor(c * 256).cast("long")).alias("v")), code_rows=20)
    asks = rows_index.filter("vec_id % 100 = 0").selectExpr("vec_id AS aid", "vec_id", "label", "v AS q", f"array(struct(0 AS w, CAST({negatives.LOWEST} AS BIGINT) AS lo, CAST({negatives.HIGHEST} AS BIGINT) AS hi)) AS windows")
    found = negatives.search(rows_index, books, asks, 5, True, first_rows=60, growth=2, report=report).collect()
    q = {i: np.floor(256 * np.array(x)).astype(np.int64) for i, x, *_ in rows}
    labels = {r[0]: r[2] for r in rows}
    for a in range(0, 2000, 100):
        best = sorted((-int(q[a] @ q[i]), i) for i in q if i != a and labels[i] == labels[a])[:5]
        assert [(-r.score, r.vec_id) for r in sorted(found, key=lambda r: r.r) if r.aid == a] == best
    assert sum(report) < 0.5 * 20 * 2000  # products of all anchors and rows


def test_negatives_of_few_rows(spark):
    rng = np.random.default_rng(3)
    for rows in ([], odd_rows(5, rng), [vec(0, [1.0, 2.0])], [vec(0, [1.0, 2.0]), vec(1, [1.0, 2.0], 2), vec(2, [1.0, 1.0], 2)]):
        assert sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect())) == brute_negatives(rows)


def test_multi_sequence_order():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=5), rng.normal(size=7)
    cells = {c: int(rng.integers(1, 9)) for c in rng.choice(35, 20, replace=False).tolist()}
    want = sorted(cells, key=lambda c: -(a[c // 7] + b[c % 7]))
    whole, left = negatives.multi_sequence(a, b, cells, 0, 10**9)
    assert whole == want and left is None
    first, bound = negatives.multi_sequence(a, b, cells, 0, 20)
    assert sum(cells[c] for c in first) >= 20 and bound == pytest.approx(a[want[len(first)] // 7] + b[want[len(first)] % 7])
    assert negatives.multi_sequence(a, b, cells, len(first), 10**9)[0] == want[len(first) :]


def brute_clusters(rows, k, rounds, dims, seed="2"):
    kept = [(i, np.array([int(np.floor(256 * c)) for c in x], object)) for i, x, *_ in rows if x is not None and len(x) == dims and all(c is not None and np.isfinite(c) for c in x)]
    first = sorted(kept, key=lambda r: ((0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), tuple(r[1])))[:k]
    centre = [x for _, x in first]

    def assign():
        return [min((int(((x - c) ** 2).sum()), j) for j, c in enumerate(centre)) for _, x in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centre)):
            own = [x for (_, x), (_, c) in zip(kept, found, strict=True) if c == j]
            if own:
                centre[j] = np.array([s // len(own) for s in sum(own)], object)
    found = assign()
    inertia = {j: sum(d for d, c in found if c == j) for j in range(len(centre))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=str)


@pytest.mark.parametrize("scale", [1, 40_000])
def test_clusters(spark, scale):
    rng = np.random.default_rng(5)
    rows = [vec(i, (np.array(x) * scale).tolist()) for i, x in enumerate(grouped(160, 6, 7, rng))]
    rows += rows[:40] + odd_rows(6, rng) + [vec(700, [1.0] * 5)]
    report = []
    out = centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), k=12, rounds=3, dims=6, n_pivots=4, report=report)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute_clusters(rows, 12, 3, 6)
    assert len(report) == 4 and max(report) < 0.6  # pivots spare many distances of grouped vectors


def test_clusters_of_few_rows(spark):
    rng = np.random.default_rng(6)
    for rows in ([], odd_rows(5, rng)[:4], [vec(1, [1.0] * 5)], [vec(1, [1.0] * 5), vec(2, [1.0] * 5), vec(None, [3.0] * 5)]):
        out = centroids.cluster(spark.createDataFrame(rows, VECTORS), k=3, rounds=2, dims=5)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, out.collect()), key=str) == brute_clusters(rows, 3, 2, 5)
    with pytest.raises(ValueError, match="fit a long"):
        centroids.cluster(spark.createDataFrame([vec(1, [1e9] * 5)], VECTORS), dims=5)


DOCS = "doc_id long, text string, shard int, slot string, size int, hash string, at int, part int"


def doc(i, text):
    return (i, text, 1, "a", 2, "b", 3, 4)


def brute_ring(ids, shards):
    """Row by row: turns by hash bits, each row to the next shard clockwise that has room."""
    hashed = [(xxhash.xxh64_intdigest((i if i is not None else 0).to_bytes(8, "little", signed=True), seed=42) if i is not None else 42) for i in ids]
    order, room = ring.clockwise(shards, ring.NODES), ring.capacities(len(ids), shards)
    cell = lambda h: h >> (64 - ring.CELL_BITS)
    turn = lambda h: h >> (64 - ring.CELL_BITS - ring.TURN_BITS) & (ring.TURNS - 1)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    out = []
    for h, i in sorted(((h, i) for h, i in zip(hashed, ids, strict=True)), key=lambda t: (turn(t[0]), cell(t[0]), signed(t[0]))):
        s = next(s for s in order[cell(h)] if room[s])
        room[s] -= 1
        out.append((str(i), s))
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 5, 900])
def test_ring(spark, n):
    texts = [None, "", "é日本", "x" * 200_000, "same", "same"]
    rows = [doc(i, texts[i % 6]) for i in range(n)] + [doc(7, f"hot {i % 3}") for i in range(n // 2)] + [doc(None, "null")] * (n // 30)
    out = ring.sharding_digest(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted((str(r.doc_id), r.shard) for r in out) == brute_ring([r[0] for r in rows], 8)
    raw = lambda t: (t or "").encode()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(i), len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t, *_ in rows)
    counts = [sorted(r.slot for r in out if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert all(r.law == "rows" and r.grown_shard is None for r in out)


def test_ring_doesnt_depend_on_layout(spark):
    rows = [doc(i % 300, f"text {i % 17}") for i in range(700)]
    one, two = (ring.sharding_digest(spark.createDataFrame(r, DOCS).repartition(p)).collect() for r, p in ((rows, 2), (rows[::-1], 7)))
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)


def test_ring_moves_little(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    before, after = (ring.assign_shards(ids, n).withColumnRenamed("shard", f"s{n}").drop("slot") for n in (8, 9))
    moved = before.join(after, "doc_id").agg(F.avg((F.col("s8") != F.col("s9")).cast("int")), F.avg((F.col("s9") == 8).cast("int"))).first()
    assert moved[0] < 1.35 / 9 and abs(moved[1] - 1 / 9) < 1e-3


def test_written_shards(spark):
    rows = [doc(i % 40, f"text {i % 7}" * (i % 5)) for i in range(200)] + [doc(None, None)] * 9
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    back = spark.read.parquet(ring.write_shards(docs))
    assert set(back.columns) == set(docs.columns)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    assert sorted(map(tuple, back.select(own).collect()), key=str) == sorted(map(tuple, docs.select(own).collect()), key=str)
    digest = sorted(((r.doc_id, r.text_crc32, r.shard, r.slot) for r in ring.sharding_digest(docs).collect()), key=str)
    assert sorted(((r.doc_id, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in back.collect()), key=str) == digest
