"""What the training-data operators share: shared scratch tables, clean inputs, batches of texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    The setting is read from the session. Where it is unset, a temporary folder of this
    machine stands in if all of Spark runs on it; on a cluster that is an error, as other
    executors could not read the folder.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/stillfresh-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The write commits whole files, so a lost executor repeats tasks and changes nothing.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, so that extra columns cannot clash; a null text is empty."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows whose crc32 of the id's text is divisible by ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | object
) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def row_fraction(df: DataFrame, bound: int) -> float:
    """Share of rows to keep for at most about ``bound`` of them."""
    return min(1.0, bound / max(1, df.count()))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts reach a few megabytes."""
    for b in batches:
        if b.num_rows:
            size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
            chunk = (np.cumsum(size.astype(np.int64) + 64) - 1) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                yield b.slice(i, j - i)


def member_filter(hashes: DataFrame, most_bits: int = 28) -> np.ndarray:
    """A bitset of the hashes (column h), for dropping most other rows before they move.

    About 16 bits for each hash, 2^28 bits (32 MB) at most: beyond that it lets more rows
    through. What it lets through is joined exactly afterwards.
    """
    bits = int(min(most_bits, max(16, np.ceil(np.log2(16 * max(1, hashes.count()))))))
    h = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(h, 6).alias("word"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return out


def passes(bitset: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.int64(64 * len(bitset) - 1)
    return (bitset[place >> 6] >> (place & 63)) & 1 == 1
