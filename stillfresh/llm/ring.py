"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A key's 64-bit hash gives its place on the ring (one of CELLS cells, top bits) and its turn
(one of TURNS, the bits below). Each shard has virtual nodes on the ring; a key belongs to the
shard of the next node clockwise. Shards have capacities that add up to the number of rows;
rows take their turns, and a row whose shard is full goes on clockwise to the next shard that
has room. Rows of one turn and cell are alike in all of that, so their counts suffice to settle
every row: a table of CELLS x TURNS counts, which doesn't grow with the data, is walked once,
and only the few groups in which a shard fills up are split by rank.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, shared_dir

SHARDS, NODES = 8, 256
CELL_BITS, TURN_BITS = 12, 6
CELLS, TURNS = 1 << CELL_BITS, 1 << TURN_BITS


def clockwise(shards: int, nodes: int) -> list[list[int]]:
    """For each cell of the ring, all shards in the order in which their nodes follow."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}/{i}"), s) for s in range(shards) for i in range(nodes))
    order: dict[int, list[int]] = {}

    def following(at: int) -> list[int]:
        if at not in order:
            seen: dict[int, None] = {}
            for k in range(len(points)):
                seen.setdefault(points[(at + k) % len(points)][1])
                if len(seen) == shards:
                    break
            order[at] = list(seen)
        return order[at]

    places = [p for p, _ in points]
    return [following(bisect_left(places, cell << (64 - CELL_BITS)) % len(points)) for cell in range(CELLS)]


def capacities(rows: int, shards: int) -> list[int]:
    """Rows of each shard: counts at most one apart that add up to all rows; the larger ones go to shards by hash."""
    larger = set(sorted(range(shards), key=lambda s: xxhash.xxh64_intdigest(f"{s}"))[: rows % shards])
    return [rows // shards + (s in larger) for s in range(shards)]


def walk(counts: np.ndarray, room: list[int], order: list[list[int]]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
    """The shard of each group of one turn and cell, and for groups in which a shard fills up (shard, rows) in clockwise order.

    ``counts`` has the rows of group turn x CELLS + cell. Groups are settled by turn, then cell.
    """
    room, shard, split = list(room), np.full(len(counts), -1, np.int32), {}
    for g in np.flatnonzero(counts).tolist():
        left, parts = int(counts[g]), []
        for s in order[g % CELLS]:
            if room[s] and left:
                take = min(room[s], left)
                parts.append((s, take))
                room[s] -= take
                left -= take
        if len(parts) == 1:
            shard[g] = parts[0][0]
        else:
            split[g] = parts
    return shard, split


def group_of(h: Column) -> Column:
    cell = F.shiftrightunsigned(h, 64 - CELL_BITS)
    turn = F.shiftrightunsigned(h, 64 - CELL_BITS - TURN_BITS).bitwiseAND(F.lit(TURNS - 1))
    return (turn * CELLS + cell).cast("int")


def ranked(rows: DataFrame, within: list[str], by: list[str], name: str) -> DataFrame:
    """Adds ``name``: the number of rows before each row of its ``within``, in the order ``by``.

    Rows are range-sorted by both into a written table, so a large ``within`` is spread over
    tasks; each task's counts are added up before it, and added to the place inside it.
    """
    part = fresh(rows, "part")
    sorted_rows = materialize(rows.repartitionByRange(*within, *by).withColumn(part, F.spark_partition_id()), "ranked")
    sums = sorted_rows.groupBy(part, *within).agg(F.count(F.lit(1)).alias("n"))
    before = sums.withColumn("n", F.sum("n").over(Window.partitionBy(*within).orderBy(part)) - F.col("n"))
    inside = sorted_rows.withColumn(name, F.row_number().over(Window.partitionBy(part, *within).orderBy(*by)) - 1)
    return inside.join(before, [part, *within]).withColumn(name, F.col("n") + F.col(name)).drop("n", part)


def assign_shards(keys: DataFrame, shards: int = SHARDS, nodes: int = NODES, key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Counts of shards are at most one apart. A row's place comes from the hash of its ``key``
    (null: one place for all nulls); the order in a shard is that of the hash, so a shard's
    rows are a shuffled sample. Equal keys, however many, start at one place and overflow
    clockwise like others; ``ties`` are columns that order them, so that the result doesn't
    depend on the layout; rows equal in all of these change places freely. Fewer rows than
    shards leave some empty; no rows give none. Columns that ``keys`` has pass through; those
    named shard and slot are replaced.

    Growing by a shard moves about the rows that the new shard takes, and those that smaller
    capacities push on clockwise.
    """
    rows = keys.drop("shard", "slot")
    at, h, g = (fresh(rows, x) for x in ("at", "hash", "group"))
    rows = materialize(rows.withColumn(at, F.monotonically_increasing_id()).withColumn(h, F.xxhash64(key)).withColumn(g, group_of(F.col(h))), "keys")
    found = rows.groupBy(g).count().toArrow()  # at most CELLS x TURNS rows
    counts = np.zeros(CELLS * TURNS, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    shard, split = walk(counts, capacities(int(counts.sum()), shards), clockwise(shards, nodes))
    spark, full = rows.sparkSession, np.flatnonzero(shard >= 0)
    of_group = spark.createDataFrame(list(zip(full.tolist(), shard[full].tolist(), strict=True)), f"{g} int, shard int")
    placed = rows.filter(~F.col(g).isin(list(split)) if split else F.lit(True)).join(F.broadcast(of_group), g)
    if split:
        rank = fresh(rows, "rank")
        cut = ranked(rows.filter(F.col(g).isin(list(split))), [g], [h, *ties, at], rank)
        shard_of = F.lit(None).cast("int")
        for one, parts in split.items():
            ends = np.cumsum([n for _, n in parts]).tolist()
            for end, (s, _) in reversed(list(zip(ends, parts, strict=True))):
                shard_of = F.when((F.col(g) == one) & (F.col(rank) < end), F.lit(s)).otherwise(shard_of)
        placed = placed.unionByName(cut.withColumn("shard", shard_of).drop(rank))
    return ranked(placed.drop(g), ["shard"], [h, *ties, at], "slot").drop(h, at)


def text_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and one more), text_crc32; a null text is empty. Texts don't move."""
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def sharding_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The query's columns. The law is ``rows``: counts of shards are at most one apart."""
    placed = assign_shards(text_facts(docs), shards, ties=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all columns of ``docs`` as Parquet, a folder shard=N for each shard with rows by slot; returns the folder.

    Rows that repeat an id are told apart by size and checksum of their texts, so rows of the
    same id and text get one of the slots each. A column named shard or slot is replaced.
    """
    path = path or shared_dir(docs.sparkSession, "shards")
    own = docs.drop("shard", "slot")
    facts = [fresh(own, "size"), fresh(own, "text_crc32")]
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    measured = own.withColumn(facts[0], F.octet_length(raw)).withColumn(facts[1], F.crc32(raw))
    placed = assign_shards(measured, shards, key=id_col, ties=tuple(facts)).drop(*facts)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
