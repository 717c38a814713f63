"""Packing along a space-filling curve: neighbouring documents share sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, texts
from .tokens import default_path, encoder

DIMS, CELL_BITS, BUCKETS = 3, 16, 1 << 12


def projection(dims: int = DIMS, buckets: int = BUCKETS, seed: int = 7) -> np.ndarray:
    """A fixed random direction for each bucket of hashed ids."""
    return np.random.default_rng(seed).standard_normal((buckets, dims)).astype(np.float32)


def hashed_points(ids: np.ndarray, offsets: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Each document's mean direction over its hashed ids; zero for a document without ids."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(np.log2(len(directions))))
    counts = np.diff(offsets)
    full = counts > 0
    out = np.zeros((len(counts), directions.shape[1]), np.float32)
    if full.any():
        out[full] = np.add.reduceat(directions[bucket], offsets[:-1][full], axis=0) / counts[full, None]
    return out


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (n, dims) of ``bits`` bits each.

    The transposed form by Skilling (2004): undo the excess work from the top bit down,
    Gray-decode across the dimensions, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip = np.where((x[-1] & q) > 0, flip ^ (q - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def encoded_rows(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n, point, ids (little-endian 16- or 32-bit): one written table, encoded once."""
    rows = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    directions = projection()
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("point", pa.list_(pa.float32())), ("ids", pa.binary())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        ids, offsets = enc.encode(batch.column(2))
        point = hashed_points(ids, offsets, directions)
        width = "<u2" if len(enc.ends) <= 1 << 16 else "<u4"
        end = np.array([end_id], width).tobytes()
        raw = ids.astype(width).tobytes()
        size = np.dtype(width).itemsize
        cut = (offsets * size).tolist()
        blobs = pa.array([raw[a:b] + end for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
        places = pa.ListArray.from_arrays(np.arange(len(point) + 1, dtype=np.int32) * point.shape[1], point.reshape(-1))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets) + 1), places, blobs], schema=schema)

    def small(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield one(batch.slice(i, 1000))

    return materialize(rows.mapInArrow(small, "row bigint, doc_id bigint, n bigint, point array<float>, ids binary"), "encoded")


def curve_order(encoded: DataFrame) -> DataFrame:
    """row, key: each document's cell on the curve.

    The cells span four standard deviations to both sides of the mean in each dimension;
    these few figures come from all documents.
    """
    stats = encoded.agg(*(f(F.col("point")[i].cast("double")).alias(f"{n}{i}") for i in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(DIMS)])
    spread = np.array([stats[f"s{i}"] or 1.0 for i in range(DIMS)])
    top = (1 << CELL_BITS) - 1
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        point = batch.column(3).flatten().to_numpy().reshape(-1, DIMS)
        cells = np.clip(((point - mean) / (8 * spread) + 0.5) * top, 0, top).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(hilbert_key(cells, CELL_BITS))], schema=schema)

    return map_batches(encoded.select("row", "doc_id", "n", "point"), place, "row bigint, doc_id bigint, n bigint, key bigint")


def with_global_start(ordered: DataFrame, by: list[str], size: str = "n") -> DataFrame:
    """Adds ``g``, the sum of ``size`` over all earlier rows in the order ``by``.

    Rows are range-sorted into a written table; each partition's sum is one row, and the
    sums before it are added to the running sum inside it.
    """
    parts = materialize(ordered.repartitionByRange(*by).select("*", F.spark_partition_id().alias("p")), "ordered")
    sums = parts.groupBy("p").agg(F.sum(size).alias("total"))
    before = sums.select("p", (F.sum("total").over(Window.orderBy("p")) - F.col("total")).alias("base"))
    inside = F.sum(size).over(Window.partitionBy("p").orderBy(*by)) - F.col(size)
    return parts.withColumn("inside", inside).join(before, "p").withColumn("g", F.col("base") + F.col("inside")).drop("p", "base", "inside")


def pack_documents(
    docs: DataFrame, length: int = 2048, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids, neighbours on the curve together.

    A document's point is the mean random direction of its hashed ids; its place is the
    point's key on a Hilbert curve, ties by doc_id, then row. The documents' ids, laid end
    to end in that order, are cut every ``length`` ids, so all sequences but the last are
    full. Returns doc_id, row (one number for each document, also where ids repeat), start,
    length, ids_crc32, doc_tokens, sequence_id, offset, ids (the piece's, as stored).
    Null and empty texts hold the end id alone; an empty table gives no rows. A document
    longer than a sequence runs over several.
    """
    encoded = encoded_rows(docs, path or default_path(), end_id, id_col, text_col)
    places = with_global_start(curve_order(encoded), ["key", "doc_id", "row"]).select("row", "g")
    both = encoded.select("row", "doc_id", "n", "ids").join(places.hint("shuffle_hash"), "row").select("row", "doc_id", "n", "g", "ids")
    schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for row, doc, n, g, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size = len(raw) // n
            wide = np.frombuffer(raw, f"<u{size}").astype("<u4").tobytes()
            at = 0
            while at < n:
                offset = (g + at) % length
                end = min(n, at + length - offset)
                out.append((doc, row, at, end - at, zlib.crc32(wide[4 * at : 4 * end]), n, (g + at) // length, offset, raw[size * at : size * end]))
                at = end
        columns = zip(*out, strict=True) if out else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return map_batches(both, cut, "doc_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def packing_digest(docs: DataFrame, length: int = 2048, path: str | None = None) -> DataFrame:
    """The query's columns."""
    return pack_documents(docs, length, path).drop("ids", "row")
