"""Quality rules and an isolation forest on their statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, materialize, texts

SYMBOLS = b"#*$%&|<>"  # fixed value
SPACE = b" \t\n\v\f\r"
WINDOW = 5
SLICE = 500
PLACES = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ("capitals", "symbols", "bars", "marks", "repeats", "dup_lines", "digits", "word_length", "lines", "odd_words", "short", "echoes")


def repeated_words(codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each text, its words in windows of five words that occur twice or more in it.

    ``codes`` numbers the words, ``cuts`` has the texts' bounds. Windows are told apart by a
    64-bit hash of their text and words.
    """
    n, docs = len(codes), len(cuts) - 1
    if n < WINDOW:
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(cuts))
    with np.errstate(over="ignore"):
        h = doc[: n - WINDOW + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        for i in range(WINDOW):
            h = (h ^ codes[i : n - WINDOW + 1 + i].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    inside = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    order = np.argsort(h[at], kind="stable")
    sorted_h = h[at][order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = sorted_h[1:] == sorted_h[:-1]
    twice = at[order[same[:-1] | same[1:]]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(cover[:-1]) > 0, minlength=docs).astype(np.int64)


def dup_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            n += 1
            seen.add(line)
    return n, n - len(seen)


def rule_statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, statistics) of a batch of texts, in the order of COUNTS and STATS.

    Words are runs of anything but ASCII white space. The statistics lie in 0..1.
    """
    words = pc.ascii_split_whitespace(column.cast(pa.large_string()))
    flat = words.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0 if len(flat) else np.zeros(0, bool)
    cuts = np.concatenate([[0], np.cumsum(real)])[np.asarray(words.offsets) - words.offsets[0].as_py()]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(coded) else np.zeros(0, np.int64)
    alpha = np.asarray(pc.utf8_is_alpha(pc.utf8_trim(coded.dictionary, ".,;:")).cast(pa.int8())) if len(coded) else np.zeros(0, np.int8)
    doc = np.repeat(np.arange(len(column)), np.diff(cuts))
    odd = np.bincount(doc, weights=1 - alpha[codes], minlength=len(column)) if len(codes) else np.zeros(len(column))
    n_words = np.diff(cuts)
    echo = np.bincount(doc[1:], weights=(codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]), minlength=len(column)) if len(codes) else odd
    repeat = repeated_words(codes, cuts)
    counts = np.zeros((len(column), len(COUNTS)), np.int64)
    stats = np.zeros((len(column), len(STATS)))
    for i, text in enumerate(column.to_pylist()):
        raw = text.encode()
        chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        lines, dup = dup_lines(raw)
        counts[i] = n_words[i], chars, symbols, dup, repeat[i]
        n, c = max(1, n_words[i]), max(1, chars)
        lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        digits = len(raw) - len(raw.translate(None, b"0123456789"))
        stats[i] = (
            upper / max(1, upper + lower), min(1, 2 * symbols / c), min(1, 2 * raw.count(b"|") / n), min(1, raw.count(b"!") / n), repeat[i] / n, dup / max(1, lines),
            min(1, 2 * digits / c), min(1, c / n / 20), min(1, 5 * lines / n), odd[i] / n, np.exp(-n_words[i] / 10), min(1, 2 * echo[i] / n),
        )
    return counts, stats


@dataclass
class IsolationForest:
    """Trees of random splits; the shorter the mean path, the odder the row.

    A split takes a random statistic and a random point of the cell's range in it (at the
    root the whole range, 0..1), not of the range of the cell's rows. So a row outside what
    the counted rows fill soon lies in a cell without any, and trees are drawn before any row
    is seen: every row is counted in its lowest cells, and a cell has the rows of those below.
    """

    feature: np.ndarray  # by tree and node; node i has the children 2i + 1 and 2i + 2
    point: np.ndarray
    rows: np.ndarray  # by tree and lowest cell
    crowd: int  # a path ends at a cell with one of so many rows, or less

    @classmethod
    def draw(cls, width: int, trees: int = 100, depth: int = 12, crowd: int = 256, seed: int = 3) -> IsolationForest:
        rng = np.random.default_rng(seed)
        low, high = np.zeros((trees, 1, width)), np.ones((trees, 1, width))
        feature, point = [], []
        for d in range(depth):
            j = rng.integers(width, size=(trees, 1 << d))
            at = np.arange(trees)[:, None], np.arange(1 << d)[None, :], j
            cut = rng.uniform(low[at], high[at])
            feature.append(j), point.append(cut)
            low, high = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
            left = np.arange(0, 2 << d, 2)[None, :]
            high[at[0], left, j] = cut
            low[at[0], left + 1, j] = cut
        return cls(np.concatenate(feature, axis=1).astype(np.int32), np.concatenate(point, axis=1), np.zeros((trees, 1 << depth), np.int64), crowd)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The number of each row's lowest cell, by row and tree."""
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        while len(x) and node[0, 0] < self.feature.shape[1]:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.point[tree, node])
        return node - self.feature.shape[1]

    def paths(self, own: int = 0) -> np.ndarray:
        """Path lengths by tree and lowest cell; ``own`` = 1: of a counted row, itself left out.

        Counts are scaled to ``crowd`` rows in all, if there are more. A path ends at the first
        cell with one row or less, or at the lowest, and is longer there the more rows share it.
        """
        trees, cells = self.rows.shape
        depth = cells.bit_length() - 1
        total = int(self.rows[0].sum()) - own
        path = np.full((trees, cells), -1.0)
        for d in range(depth + 1):
            here = np.maximum(0, self.rows.reshape(trees, 1 << d, -1).sum(axis=2) - own) * min(1.0, self.crowd / max(1, total))
            length = np.repeat(np.where((here <= 1) | (d == depth), d + average_path(here), -1.0), cells >> d, axis=1)
            path = np.where(path < 0, length, path)
        return path

    def score(self, x: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """2^(-mean path / usual path), in 0..1, to PLACES places."""
        mean = paths[np.arange(len(paths))[None, :], self.cells(x)].mean(axis=1)
        usual = max(1.0, float(average_path(np.array(min(self.crowd, self.rows[0].sum())))))
        return np.round(2 ** (-mean / usual), PLACES)


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    m = np.maximum(n, 2)
    return np.where(n < 2, 0.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m)


@dataclass
class QualityModel:
    forest: IsolationForest | None = None
    threshold: float = 2.0

    def __post_init__(self) -> None:
        self.paths = self.forest.paths() if self.forest else None

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.zeros(len(stats)) if self.forest is None else self.forest.score(stats, self.paths)


def best_threshold(score: np.ndarray, good: np.ndarray, junk: np.ndarray) -> float:
    """The score from which rows are junk, in the middle of the gap: best for both kinds' shares, a lost good row weighing twice.

    ``score`` has distinct scores in ascending order, ``good`` and ``junk`` the rows of each.
    """
    good_kept = np.concatenate([[0], np.cumsum(good)]) / max(1, good.sum())
    junk_out = 1 - np.concatenate([[0], np.cumsum(junk)]) / max(1, junk.sum())
    at = int(np.argmax(2 * good_kept + junk_out))
    edges = np.concatenate([[score[0] - 1], score, [score[-1] + 1]])
    return float((edges[at] + edges[at + 1]) / 2)


def rule_table(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and ``stats`` (an array) of every row's whole text."""
    rows = texts(docs)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [rule_statistics(batch.column(1).slice(i, SLICE)) for i in range(0, batch.num_rows, SLICE)]
        counts, stats = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), lists(stats)], ["doc_id", *COUNTS, "stats"])

    return map_batches(rows, measure, f"doc_id {id_type}, {', '.join(f'{c} bigint' for c in COUNTS)}, stats array<double>")


def lists(stats: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, len(STATS)), pa.int32()), pa.array(stats.ravel()))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The forest and its threshold from every labelled row outside the held-out fold.

    See :func:`fit_rules`.
    """
    return fit_rules(rule_table(docs), labels)


def fit_rules(rules: DataFrame, labels: DataFrame) -> QualityModel:
    """The forest counts all good rows; the threshold is set by all of them, each with itself left out, and all bad ones.

    ``rules`` is a :func:`rule_table`. Rows whose crc32(doc_id) mod 5 is 0 take no part; labels
    without a value are left out, repeated ones averaged. Tasks count rows by cell and by
    score, so what reaches the driver has a bound (trees times lowest cells, 10^PLACES + 1
    scores) that doesn't depend on the rows. Without bad labels, or with too few good ones,
    nothing is cut.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    train = materialize(rules.select("doc_id", "stats").join(known, "doc_id").select("stats", "y"), "train")
    sizes = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sizes.get(1, 0) < 8 or not sizes.get(0, 0):
        return QualityModel()
    forest = IsolationForest.draw(len(STATS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(forest.rows.size, np.int64)
        first = np.arange(len(forest.rows)) * forest.rows.shape[1]
        for batch in batches:
            x = matrix(batch.column(0))
            for i in range(0, len(x), SLICE):
                rows += np.bincount((forest.cells(x[i : i + SLICE]) + first).ravel(), minlength=rows.size)
        cell = np.flatnonzero(rows)
        if len(cell):
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(rows[cell])], ["cell", "n"])

    counted = train.filter("y = 1").select("stats").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most forest.rows.size
    forest.rows.ravel()[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    paths = forest.paths(), forest.paths(own=1)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = matrix(batch.column(0)), batch.column(1).to_numpy()
        out = np.zeros(len(x))
        for own in (0, 1):
            at = np.flatnonzero(y == own)
            for i in range(0, len(at), SLICE):
                out[at[i : i + SLICE]] = forest.score(x[at[i : i + SLICE]], paths[own])
        return pa.RecordBatch.from_arrays([pa.array(out), batch.column(1)], ["score", "y"])

    scored = map_batches(train, score, "score double, y int").groupBy("score").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("junk"))
    at = scored.orderBy("score").toArrow()  # at most 10^PLACES + 1
    return QualityModel(forest, best_threshold(*(at[c].to_numpy() for c in ("score", "good", "junk"))))


def quality_verdicts(docs: DataFrame, labels: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept.

    One row for each row of ``docs``, from its whole text, however long; null and empty texts
    have no words and fail the base rules. Repeated rows have equal verdicts; an empty table
    gives no rows. Texts are read once, where they lie: fitting writes their statistics, and
    only these meet the labels.
    """
    rules = rule_table(docs)
    if model is None:
        rules = materialize(rules, "rules")
        model = fit_rules(rules, labels)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, repeat, x = batch.column(1).to_numpy(), batch.column(len(COUNTS)).to_numpy(), matrix(batch.column(len(COUNTS) + 1))
        failed = (n_words < 10) | (100 * repeat > 20 * n_words)
        score = np.concatenate([model.score(x[i : i + SLICE]) for i in range(0, len(x), SLICE)])
        columns = [*batch.columns[:-1], pa.array(failed), pa.array(score), pa.array(~failed & (score < model.threshold))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "anomaly", "kept"])

    id_type = rules.schema["doc_id"].dataType.simpleString()
    return map_batches(rules, judge, f"doc_id {id_type}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, anomaly double, kept boolean")
