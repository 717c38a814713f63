"""Token-id files in patched frame-of-reference blocks, and documents read back from them."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, texts
from .tokens import default_path, encoder

BLOCK = 256
MAGIC = b"PFORIDS1"
END_ID = 1
SHARD_TOKENS = 4_000_000


def bits_of(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> dict[str, np.ndarray]:
    """PFOR sections of a run of ids.

    Each block of 256 ids stores its minimum and the differences to it, at the width that
    holds ``percentile`` of them; what exceeds the width goes, by place and high bits, to
    the exception list. ``starts`` has the first 64-bit word of each block.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint64)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1, initial=np.iinfo(np.uint64).max) if blocks else np.zeros(0, np.uint64)
    delta = grid - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = bits_of(np.partition(delta, at, axis=1)[:, at]) if blocks else np.zeros(0, np.uint8)
    words = width.astype(np.int64) * BLOCK // 64
    starts = np.concatenate([[0], np.cumsum(words)])
    payload = np.zeros(int(starts[-1]), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        values = np.ascontiguousarray((delta[which] & np.uint64((1 << w) - 1)).T)
        out = np.zeros((w * BLOCK // 64, len(which)), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            out[word] |= values[j] << np.uint64(shift)
            if shift + w > 64:
                out[word + 1] |= values[j] >> np.uint64(64 - shift)
        payload[starts[which][:, None] + np.arange(len(out))] = out.T
    high = delta >> width.astype(np.uint64)[:, None]
    block, place = np.nonzero(high)
    return {
        "payload": payload, "starts": starts[:-1].astype(np.uint64), "low": low.astype(np.uint32), "width": width,
        "odd_count": np.bincount(block, minlength=blocks).astype(np.uint16), "odd_place": place.astype(np.uint8), "odd_high": high[block, place].astype(np.uint32),
    }


def unpack_blocks(s: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The ids that :func:`pack_blocks` was given."""
    width, starts = s["width"], s["starts"].astype(np.int64)
    delta = np.zeros((len(width), BLOCK), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        words = np.ascontiguousarray(s["payload"][starts[which][:, None] + np.arange(w * BLOCK // 64)].T)
        mask = np.uint64((1 << w) - 1)
        values = np.empty((BLOCK, len(which)), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            v = words[word] >> np.uint64(shift)
            if shift + w > 64:
                v = v | (words[word + 1] << np.uint64(64 - shift))
            values[j] = v & mask
        delta[which] = values.T
    block = np.repeat(np.arange(len(width)), s["odd_count"])
    delta[block, s["odd_place"]] |= s["odd_high"].astype(np.uint64) << width[block].astype(np.uint64)
    return (delta + s["low"].astype(np.uint64)[:, None]).reshape(-1)[:n].astype(np.uint32)


def to_bytes(sections: dict[str, np.ndarray], **facts: int) -> bytes:
    """Magic, the sections one after another, a JSON footer that tells their places, its length."""
    parts, at, table = [MAGIC], len(MAGIC), {}
    for name, a in sections.items():
        raw = np.ascontiguousarray(a).tobytes()
        table[name] = [at, len(a), a.dtype.str]
        parts.append(raw)
        at += len(raw)
    footer = json.dumps({"sections": table, **facts}).encode()
    return b"".join([*parts, footer, len(footer).to_bytes(8, "little")])


def from_bytes(raw: bytes) -> tuple[dict[str, np.ndarray], dict]:
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id file")
    size = int.from_bytes(raw[-8:], "little")
    facts = json.loads(raw[-8 - size : -8])
    return {k: np.frombuffer(raw, kind, n, at) for k, (at, n, kind) in facts["sections"].items()}, facts


def write_token_ids(
    docs: DataFrame, out_dir: str | None = None, path: str | None = None, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode whole texts and write their ids to files, in ascending ``doc_id`` order.

    Returns the manifest: partition, seq (files in order), file, n_docs, n_tokens. Rows are
    range-partitioned by id (repeated ids spread by text and row), so each task writes one
    stretch of the order, in files of about ``shard_tokens`` ids: a task holds one file's
    ids at a time. Files have new names for each attempt, and only those of the attempt
    whose rows the manifest kept are read, so repeated tasks do no harm. Null texts are
    empty; null ids come first. An empty table gives an empty manifest.
    """
    path = path or default_path()
    out_dir = out_dir or shared_dir(docs.sparkSession, "ids")
    rows = texts(docs, id_col, text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("r")
    )
    rows = rows.repartitionByRange("doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r").select(
        F.spark_partition_id().alias("partition"), "doc_id", "text"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(out_dir)
        fs.create_dir(base, recursive=True)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        n, seq, part = 0, 0, 0

        def flush() -> pa.RecordBatch:
            doc = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            sections = pack_blocks(ids) | {
                "doc_id": doc.fill_null(0).to_numpy(), "doc_null": doc.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), "doc_tokens": np.concatenate([h[2] for h in held]).astype(np.uint32),
            }
            name = f"ids-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.pfor"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(to_bytes(sections, n_tokens=len(ids), n_docs=len(doc)))
            row = {"partition": [part], "seq": [seq], "file": [name], "n_docs": [len(doc)], "n_tokens": [len(ids)]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("partition", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        enc = encoder(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                part = batch.column(0)[0].as_py()
                ids, offsets = enc.encode(batch.column(2), end_id)
                held.append((batch.column(1), ids, np.diff(offsets)))
                n += len(ids)
                if n >= shard_tokens:
                    yield flush()
                    held, n, seq = [], 0, seq + 1
        if held:
            yield flush()

    manifest = rows.mapInArrow(write, "partition int, seq int, file string, n_docs bigint, n_tokens bigint")
    return materialize(manifest, "manifest").withColumn("file", F.concat(F.lit(out_dir.rstrip("/") + "/"), "file"))


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds the ids of earlier partitions, of earlier files and of earlier documents
    in the file, so no task sees more than one file, or one row for each partition or file.
    """
    sums = manifest.groupBy("partition").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("partition", (F.sum("n").over(Window.orderBy("partition")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("partition").orderBy("seq")) - F.col("n_tokens")
    files = manifest.withColumn("inside", inside).join(before, "partition").select("file", (F.col("base") + F.col("inside")).alias("base"))
    n_files = max(1, manifest.count())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = pa.fs.FileSystem.from_uri(file)
                with fs.open_input_stream(name) as f:
                    s, facts = from_bytes(f.read())
                ids = unpack_blocks(s, facts["n_tokens"]).astype("<u4").tobytes()
                counts = s["doc_tokens"].astype(np.int64)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                doc = pa.array(s["doc_id"], mask=s["doc_null"].astype(bool))
                yield pa.RecordBatch.from_arrays([doc, pa.array(base + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], schema=schema)

    return files.repartition(min(n_files, 10_000), "file").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_id_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's rows: written, then read back."""
    return read_token_ids(write_token_ids(docs, path=path))
