"""N-gram Jaccard join: exact links between documents' shingle sets, and their components.

1. Documents with equal sets form one class at once; links are sought between classes.
2. Two sets of similarity t and sizes a <= b differ in at most k = a * (1 - t) / t members.
   Sets of one band of sizes, and those of the next, are cut into more than k parts by their
   members' hashes, so the parts of two similar sets can't all differ: some part of both is
   the same. Each part's hash is a signature, its tile. Of k + 1 + e parts the e lightest of
   a set are not sent, as 1 + e parts must be the same and both sets rank these alike.
3. Classes that share a tile are candidates; candidates that hang together form a group.
   Texts with a passage in common share a part now and then, so such groups grow with the
   table, faster than it does. Large ones are taken apart by sketches, a bit for each
   member's hash: two sets differ in at least as many members as their sketches in bits, so
   pairs that differ in too many aren't similar, and what no other pairs join is a group.
4. Each group is worked through in blocks of bounded size. A bitmap of hashed members bounds
   two sets' overlap from above (their difference has at least as many members as the bitmaps
   differ in bits); what passes is intersected exactly, as sorted arrays. A block returns no
   more than the links that join its components, so no pairs pile up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fresh, materialize, member_filter, passes, texts

BLOCK_CLASSES, BLOCK_TOKENS, BLOCKS = 256, 1 << 20, 10
SKETCH_CLASSES, SKETCH_BYTES, SKETCH_BITS = 8192, 1 << 22, (8, 15)
SIG_BYTES = 6
SALTS = 8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[3]
    return x ^ (x >> np.uint64(29))


def shingle_sets(batch_texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a text of
    fewer words than ``width`` has its whole sequence as its only shingle.
    """
    words = pc.ascii_split_whitespace(batch_texts.cast(pa.large_string()))
    flat = words.flatten()
    coded = flat.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode().lower()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashed = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    real = np.asarray(pc.binary_length(flat)) > 0 if len(flat) else np.zeros(0, bool)
    cuts = np.concatenate([[0], np.cumsum(real)])[np.asarray(words.offsets) - words.offsets[0].as_py()]
    h = hashed[real]
    with np.errstate(over="ignore"):
        whole = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for i in range(width):
            whole = mixed(whole * _MIX[i % 3] + h[i : len(h) - width + 1 + i]) if len(whole) else whole
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(whole[a : b - width + 1]))
            else:
                s = np.full(min(1, b - a), b - a, np.uint64)
                for i in range(b - a):
                    s = mixed(s * _MIX[i % 3] + h[a + i])
                out.append(s)
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


def size_bands(percent: int, most: int) -> np.ndarray:
    """Least sizes of the bands; a set's partners lie in its own band or the ones next to it."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array([*out, out[-1] * 100 // percent + 1], np.int64)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, 48-bit signature) of the parts that the sets send, sorted by set.

    A set has parts in the tiles of its own band and, where it can be the larger one of a
    pair, in those of the band below. Parts are stretches of the range of hashes.
    """
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(n)])
    bands = size_bands(percent, int(n.max(initial=0)))
    own = np.searchsorted(bands, n, side="right") - 1
    owners, sigs = [], []
    for below in (0, 1):
        band = own - below
        top = bands[np.maximum(band, 0) + 1] - 1
        k = top * (100 - percent) // percent
        used = np.flatnonzero((n > 0) & (band >= 0) & (k > 0) & (n <= top * 100 // percent))
        if not len(used):
            continue
        k, band = k[used], band[used].astype(np.uint64)
        m = k + 1 + (k + 3) // 4
        base = np.concatenate([[0], np.cumsum(m)])
        owner = np.repeat(np.arange(len(used)), n[used])
        at = np.repeat(first[used], n[used]) + np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n[used])[:-1]]), n[used])
        tokens = flat[at]
        with np.errstate(over="ignore"):
            part = base[owner] + (((tokens >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            begins = np.flatnonzero(np.diff(part, prepend=-1))
            total = np.zeros(base[-1], np.uint64)
            total[part[begins]] = np.add.reduceat(mixed(tokens ^ _MIX[1]), begins)
            size = np.bincount(part, minlength=base[-1])
            row = np.repeat(np.arange(len(used)), m)
            place = (np.arange(base[-1]) - base[row]).astype(np.uint64)
            sig = mixed(mixed(total + _MIX[2]) + (band[row] << np.uint64(32)) + place) >> np.uint64(16)
        order = np.argsort((row << 24) - np.minimum(size, (1 << 24) - 1), kind="stable")
        sent = order[np.arange(base[-1]) - base[row] <= k[row]]
        owners.append(used[row[sent]])
        sigs.append(sig[sent])
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, sig = np.concatenate(owners), np.concatenate(sigs)
    order = np.argsort(owner, kind="stable")
    return owner[order], sig[order]


def sketch(s: np.ndarray) -> bytes:
    """A bit for each residue of the members' hashes, set where an odd number of members has it.

    There are as many bits as members, rounded up to a power of two, within SKETCH_BITS.
    """
    bits = 1 << int(np.clip(int(max(1, len(s)) - 1).bit_length(), *SKETCH_BITS))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def packed(values: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
    """Binary values holding ``counts`` numbers each, ``width`` low bytes of every one."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    ends = np.concatenate([[0], np.cumsum(counts)]) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def unpacked(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many each value holds) of :func:`packed` values."""
    counts = np.asarray(pc.binary_length(column)) // width
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.view("<u8").reshape(-1), counts


def keyed(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, key, n, fp, h, sigs, bits of every document: one written table.

    ``h``, the first 48 bits of the set's fingerprint, names classes while candidates are
    sought; ``fp`` is the whole fingerprint. Sets that share a name are candidates of each
    other, which the exact test then tells apart.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("h", pa.int64()), ("sigs", pa.binary()), ("bits", pa.binary())])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            sets = shingle_sets(b.column(2), width)
            owner, sig = signatures(sets, percent)
            fps = [fingerprint(s) for s in sets]
            h = pa.array([int.from_bytes(f[:6], "little") for f in fps], pa.int64())
            sigs = packed(sig, np.bincount(owner, minlength=len(sets)), SIG_BYTES)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), h, sigs, pa.array(map(sketch, sets), pa.binary())], schema=schema)

    return materialize(rows.mapInArrow(one, "doc_id bigint, key bigint, n bigint, fp binary, h bigint, sigs binary, bits binary"), "keyed")


def runs_of(sig: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (sig, h) rows: each signature once with its least h, and the links least h - other h."""
    order = np.lexsort((h, sig))
    sig, h = sig[order], h[order]
    new = np.diff(sig, prepend=sig[:1] ^ np.uint64(1)) != 0 if len(sig) else np.zeros(0, bool)
    head = h[new][np.cumsum(new) - 1] if len(sig) else h
    other = head != h
    links = np.unique(np.stack([head[other], h[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return sig[new], h[new], links[:, 0], links[:, 1]


def candidate_links(table: DataFrame) -> DataFrame:
    """(a, b): classes h that share a signature, each with one least class of that signature.

    Tasks first join what they hold of a signature and send one class on, so a signature
    with a third of all rows sends no more than one entry from each batch. Signatures are
    dealt out by their first bits, into groups of about 2^19 of them.
    """
    bits = min(24, max(8, int(np.ceil(np.log2(1 + (table.agg(F.sum(F.length("sigs"))).first()[0] or 0) / SIG_BYTES / (1 << 19))))))
    low, schema = np.uint64(48 - bits), pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("hs", pa.binary())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:  # a set is sent once; sets that share their 48 bits are both sent, under one name
            new = [f not in seen and not seen.add(f) for f in b.column(2).to_pylist()]
            b = b.filter(pa.array(new, pa.bool_()))
            if not b.num_rows:
                continue
            sig, counts = unpacked(b.column(1), SIG_BYTES)
            sig, h, a, c = runs_of(sig, np.repeat(b.column(0).to_numpy(), counts))
            buckets, per = np.unique(sig >> low, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), packed(sig, per, SIG_BYTES), packed(h, per, SIG_BYTES)], schema=schema)
            if len(a):  # links found here: rows of their own, dealt by one of their classes
                order = np.argsort(a, kind="stable")
                at, per = np.unique(a[order] % (1 << bits), return_counts=True)
                order = np.argsort(a % (1 << bits), kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array((-1 - at).astype(np.int32)), packed(a[order], per, SIG_BYTES), packed(c[order], per, SIG_BYTES)], schema=schema)

    def meet(key, t):
        first, second = (unpacked(t.column(c).combine_chunks(), SIG_BYTES)[0] for c in ("sigs", "hs"))
        if key[0].as_py() < 0:
            both = np.unique(np.stack([first, second], axis=1).astype(np.int64), axis=0)
            a, b = both[:, 0], both[:, 1]
        else:
            _, _, a, b = runs_of(first, second.astype(np.int64))
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    routed = table.filter("n > 0").select("h", "sigs", "fp").mapInArrow(route, "bucket int, sigs binary, hs binary")
    return routed.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex in ``edges`` (a, b): root is its component's least vertex.

    Alternating large-star and small-star rounds (Kiveris and others, 2014): each round
    joins every vertex's neighbours to the least one it knows, so paths shorten by half or
    more. Each round's edges are a written table; rounds end when no edge is new.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "edges")
    hashed = [F.sum(F.xxhash64(F.lit(seed), "v", "u").cast("decimal(38,0)")) for seed in (1, 2)]
    before = tuple(e.agg(F.count(F.lit(1)), *hashed).first())
    while before[0]:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        met = large.join(low, "v")  # all of v's smaller neighbours, and v itself, go to the least of them
        small = met.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u")))
        e = materialize(small.filter("v <> u").distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), *hashed).first())
        if now == before:
            break
        before = now
    return e.select("v", F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())


def enough(n_a, n_b, common, percent: int):
    return 100 * common >= percent * (n_a + n_b - common)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set: about 16 for each member of a mean set, 2^16 at most."""
    mean = sum(map(len, sets)) / max(1, len(sets))
    size = 1 << int(min(16, max(8, np.ceil(np.log2(16 * mean + 1)))))
    out = np.zeros((len(sets), size), np.uint8) if size * len(sets) <= 1 << 26 else None
    if out is None:
        out = np.zeros((len(sets), 1 << 12), np.uint8)
    for i, s in enumerate(sets):
        out[i, (s & np.uint64(out.shape[1] - 1)).astype(np.int64)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def block_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (numbers of sets) whose links join the block's components; no more than sets.

    ``side``: in a block of two different halves only sets of different sides are compared.
    """
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        good = enough(n[0], n[1], len(np.intersect1d(sets[0], sets[1], assume_unique=True)), percent)
        return [(0, 1)] if good else []
    bits, label, out = bitmaps(sets), np.arange(len(sets)), []
    split = side.min() != side.max()
    numbers = np.arange(len(sets))
    for at in range(len(sets)):
        other = np.flatnonzero((label != label[at]) & ((side > side[at]) if split else (numbers > at)) & (100 * np.minimum(n, n[at]) >= percent * np.maximum(n, n[at])))
        if not len(other):
            continue
        differ = np.bitwise_count(bits[other] ^ bits[at]).sum(axis=1).astype(np.int64)
        good = enough(n[other], n[at], (n[other] + n[at] - differ) // 2, percent)
        other = other[good][np.argsort(differ[good], kind="stable")]
        for k in other.tolist():
            if label[k] != label[at] and enough(n[at], n[k], len(np.intersect1d(sets[at], sets[k], assume_unique=True)), percent):
                out.append((at, k))
                label[label == label[k]] = label[at]
    return out


def verified_links(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) fingerprints of linked classes; ``blocks`` has root, i, j, mine, text.

    Blocks are streams of neighbouring rows of a sorted partition; only the open block's sets
    are held: of each half 16 * BLOCK_CLASSES classes or BLOCK_TOKENS members on average.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def links(sets: list[np.ndarray], mine: np.ndarray) -> list[tuple[bytes, bytes]]:
        fps = [fingerprint(s) for s in sets]
        once = list({f: i for i, f in enumerate(fps)}.values())
        if len(once) < 2:
            return []
        found = block_links([sets[i] for i in once], mine[once], percent)
        return [(fps[once[a]], fps[once[b]]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_mine: list[int] = []
        open_key = None
        for b in by_bytes(batches):
            out: list[tuple[bytes, bytes]] = []
            sets = shingle_sets(b.column("text"), width)
            keys = list(zip(*(b.column(c).to_pylist() for c in ("root", "i", "j")), strict=True))
            for key, s, m in zip(keys, sets, b.column("mine").to_pylist(), strict=True):
                if key != open_key:
                    out += links(held, np.array(held_mine)) if held else []
                    held, held_mine, open_key = [], [], key
                held.append(s)
                held_mine.append(m)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=schema)
        if out := links(held, np.array(held_mine)) if held else []:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=schema)

    dealt = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(run, "a binary, b binary")


def sketch_links(n: np.ndarray, bits: list[bytes], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (numbers of sets) that may be similar by their sketches and join the block's components.

    ``n``: sizes in ascending order, so that a set's larger partners are the next ones. A
    longer sketch is folded to the length of the smaller set's.
    """
    label, out = np.arange(len(n)), []
    split = side.min() != side.max()
    end = np.searchsorted(n, n * 100 // percent, side="right")
    width = np.array([len(b) // 8 for b in bits])
    for w in np.unique(width).tolist():
        first, last = (f(width, w, side=x) for f, x in ((np.searchsorted, "left"), (np.searchsorted, "right")))
        far = int(end[first:last].max())
        rows = np.empty((far - first, w), np.uint64)
        for i in range(first, far):
            rows[i - first] = np.bitwise_xor.reduce(np.frombuffer(bits[i], "<u8").reshape(-1, w), axis=0)
        for at in range(first, last):
            a, b = at + 1, int(end[at])
            open_ = label[a:b] != label[at]
            if split:
                open_ &= side[a:b] != side[at]
            if not open_.any():
                continue
            differ = np.bitwise_count(rows[a - first : b - first] ^ rows[at - first]).sum(axis=1, dtype=np.int64)
            for k in (a + np.flatnonzero(open_ & enough(n[a:b], n[at], (n[a:b] + n[at] - differ) // 2, percent))).tolist():
                if label[k] != label[at]:
                    out.append((at, k))
                    label[label == label[k]] = label[at]
    return out


def taken_apart(groups: DataFrame, percent: int) -> DataFrame:
    """(fp, root) of the classes of ``groups`` (root, fp, n, bits) that some other one may be similar to by
    their sketches; ``root`` names those that hang together by such pairs.

    All pairs of a group are looked at, in blocks of SKETCH_CLASSES classes or SKETCH_BYTES.
    A block returns no more links than classes.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    size = F.greatest(F.count(F.lit(1)) / SKETCH_CLASSES, F.sum(F.length("bits")) / SKETCH_BYTES)
    parts = groups.groupBy("root").agg(F.ceil(size).cast("int").alias("parts"))
    placed = groups.join(parts, "root").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    blocks = placed.select("root", "mine", F.explode(pairs_of("parts")).alias("x"), "n", "fp", "bits").select("root", "x.i", "x.j", "mine", "n", "fp", "bits")

    def links(held: list[tuple]) -> list[tuple[bytes, bytes]]:
        mine, n, fps, bits = zip(*held, strict=True)
        return [(fps[a], fps[b]) for a, b in sketch_links(np.array(n, np.int64), bits, np.array(mine), percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        open_key = None
        for b in batches:
            out: list[tuple[bytes, bytes]] = []
            columns = [c.to_pylist() for c in b.columns]
            for key, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if key != open_key:
                    out += links(held) if held else []
                    held, open_key = [], key
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=schema)
        if out := links(held) if held else []:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=schema)

    dealt = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "n")
    return components(dealt.mapInArrow(run, "a binary, b binary")).select(F.col("v").alias("fp"), F.xxhash64("root").alias("root"))


def pairs_of(parts: str) -> Column:
    """The blocks (i, j) of a group of ``parts`` parts that its part ``mine`` goes to."""
    return F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))


def blocks_of(wanted: DataFrame) -> DataFrame:
    """(root, parts): a large group is dealt to about BLOCKS blocks, to more where those would be large themselves."""
    k = F.count(F.lit(1))
    size = F.greatest(F.least(k / BLOCK_CLASSES, F.lit(BLOCKS)), k / (16 * BLOCK_CLASSES), F.sum("n") / BLOCK_TOKENS)
    return wanted.groupBy("root").agg(F.ceil(size).cast("int").alias("parts"))


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the wanted keys, and a few others: a text once from each task.

    A bitset of the keys picks the texts, so that others don't move.
    """
    shared = rows.sparkSession.sparkContext.broadcast(member_filter(wanted.select(F.col("key").alias("h"))))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            b = b.filter(pa.array(passes(shared.value, b.column(0).to_numpy())))
            both = [(k, hash(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            new = [x not in seen and not seen.add(x) for x in both]
            b = b.filter(pa.array(new, pa.bool_()))
            if b.num_rows:
                yield b

    return rows.select("key", "text").mapInArrow(one, "key bigint, text string")


def similar_classes(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): every document's doc_id, n, fp; links (a, b) between classes
    that give all components. See :func:`jaccard_components`."""
    rows = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    table = keyed(rows, width, percent)
    members = components(candidate_links(table)).withColumnRenamed("v", "h")
    one = table.filter("n > 0").select("h", "fp", "key", "n", "bits").join(members, "h")
    wanted = materialize(one.groupBy("fp").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("root").alias("root"), F.first("bits").alias("bits")), "wanted")
    large = materialize(blocks_of(wanted).filter("parts > 1").select("root"), "large")
    if not large.isEmpty():
        apart = taken_apart(wanted.join(large, "root", "left_semi"), percent)
        small = wanted.join(large, "root", "left_anti")
        wanted = materialize(small.unionByName(wanted.drop("root").join(apart, "fp")), "wanted")
    placed = wanted.join(blocks_of(wanted), "root").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    placed = placed.select("key", "root", "mine", pairs_of("parts").alias("pairs"))
    blocks = texts_of(rows, wanted).join(placed, "key").select("root", "mine", F.explode("pairs").alias("x"), "text").select("root", "x.i", "x.j", "mine", "text")
    return table, materialize(verified_links(blocks, width, percent), "links")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of distinct
    ``width``-word shingles; component_id is the smallest doc_id that links reach. Documents
    without words (null texts too) link with nothing. Repeated ids keep a row each; a null
    id's component is the smallest id it reaches, else null. An empty table gives no rows.
    """
    table, edges = similar_classes(docs, width, percent, id_col, text_col)
    known = components(edges).withColumnRenamed("v", "fp")
    classes = table.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).join(known, "fp", "left")
    classes = materialize(classes.withColumn("root", F.coalesce("root", "fp")), "classes")
    whole = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("k").alias("size"))
    named = classes.join(whole.filter("size > 1"), "root").select("fp", "component_id")
    # a class may hold a third of all rows: its name goes to each of a few salts
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = table.select("doc_id", "n", "fp", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "key"), F.lit(SALTS)).cast("int").alias("salt"))
    out = salted.join(named, ["fp", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that another of their component stands for: its smallest doc_id.

    Repeated rows of that id stay, and so do rows with a null id. All columns stay as they
    are, whatever their names. Null and empty texts are no copies of each other. An empty
    table gives no rows.
    """
    found = jaccard_components(docs, width, percent)
    gone = fresh(docs, "gone")
    dropped = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def brute_force(documents: dict[int, str | None], width: int = 3, percent: int = 90) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component_id) by comparing all pairs, for tests."""
    sets = {}
    for d, text in documents.items():
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    top = {d: d for d in sets}

    def root(d: int) -> int:
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}

