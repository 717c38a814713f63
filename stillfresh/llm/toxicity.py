"""Toxicity by weak supervision: voters, a label model of them, a linear classifier on its posteriors."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, materialize, texts

WORD = re.compile(r"[^\W\d_]+")
BEYOND_ASCII, CAPITALS = re.compile(r"[^\x00-\x7f]+"), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEMS = (4, 5, 6, 7)
MAX_TRAIN = 12_000
MAX_TERMS = 400
MIN_PRECISION = 0.8
VOTERS = 8


def terms_of(text: str) -> set[str]:
    """Words and word beginnings (marked by a trailing dash) of one text."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "-" for w in words for k in STEMS if len(w) > k}


def lexicon_hits(text: str, lexicon: dict[str, int], starts: set[str]) -> list[int]:
    """Numbers of the lexicon's terms in a text; as :func:`terms_of`, for few words only."""
    hits = set()
    for w in set(WORD.findall(text.lower())):
        if w[:4] in starts:
            if w in lexicon:
                hits.add(lexicon[w])
            for k in STEMS:
                if len(w) > k and (i := lexicon.get(w[:k] + "-")) is not None:
                    hits.add(i)
    return sorted(hits)


def shape(text: str) -> tuple[float, float, float]:
    """What the pattern voters see: share of capitals, exclamation marks, log of the length."""
    n = max(1, len(text))
    plain = text.encode("ascii", "ignore")
    capitals = len(plain) - len(plain.translate(None, CAPITALS))
    if len(plain) < len(text):
        capitals += sum(map(str.isupper, "".join(BEYOND_ASCII.findall(text))))
    return capitals / n, text.count("!!") / n, float(np.log1p(n))


@dataclass
class ToxicityModel:
    """A linear classifier over lexicon terms, voters and shape.

    The lexicon is in order of its terms' odds, and each lexicon voter has a stretch of it, so
    that sure terms and unsure ones don't share a voter.
    """

    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    prior: float = 0.25
    accuracies: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.starts = {t.rstrip("-")[:4] for t in self.lexicon}
        self.group = np.arange(len(self.lexicon)) * VOTERS // max(1, len(self.lexicon))

    def features(self, hits: list[list[int]], shapes: list[tuple[float, float, float]]) -> np.ndarray:
        x = np.zeros((len(hits), len(self.lexicon) + VOTERS + 4))
        for i, h in enumerate(hits):
            x[i, h] = 1
        votes = self.votes(hits, shapes)
        x[:, len(self.lexicon) :] = np.concatenate([votes[:, :VOTERS], np.log1p([[len(h)] for h in hits]).reshape(-1, 1), np.array(shapes).reshape(-1, 3) * [1, 10, 0.1]], axis=1)
        return x

    def votes(self, hits: list[list[int]], shapes: list[tuple[float, float, float]]) -> np.ndarray:
        """1 where a voter says toxic: lexicon voters, then pattern voters (several hits, dense hits, capitals, exclamations)."""
        v = np.zeros((len(hits), VOTERS + 4))
        for i, h in enumerate(hits):
            v[i, self.group[h]] = 1
            v[i, VOTERS:] = [len(h) >= 3, len(h) > 0.002 * np.expm1(shapes[i][2]), shapes[i][0] > 0.5, shapes[i][1] > 0.02]
        return v

    def score(self, documents: list[str]) -> np.ndarray:
        if not self.lexicon:
            return np.full(len(documents), self.prior)
        x = self.features([lexicon_hits(t, self.lexicon, self.starts) for t in documents], [shape(t) for t in documents])
        return sigmoid(x @ self.weights[1:] + self.weights[0])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def correlated_groups(votes: np.ndarray, post: np.ndarray, least: float = 0.4, most: int = 3) -> list[list[int]]:
    """Voters dealt into groups of at most ``most`` whose votes agree beyond what the class explains."""
    left = votes.astype(float)
    for side in (post, 1 - post):
        left = left - np.outer(side, side @ votes / max(1e-9, side.sum()))
    sd = np.sqrt(np.maximum((left**2).mean(axis=0), 1e-9))
    corr = left.T @ left / max(1, len(left)) / sd[:, None] / sd[None, :]
    np.fill_diagonal(corr, 0)
    groups = [[j] for j in range(votes.shape[1])]
    for i, j in sorted(((i, j) for i in range(len(corr)) for j in range(i)), key=lambda x: -abs(corr[x])):
        if abs(corr[i, j]) < least:
            break
        one, two = (next(g for g in groups if k in g) for k in (i, j))
        if one is not two and len(one) + len(two) <= most:
            one.extend(two)
            groups.remove(two)
    return groups


def label_model(votes: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(posterior of toxic, hit rates by class, groups of correlated voters), from the votes alone.

    A generative model fitted by EM: within a class, groups of voters are independent, and a
    group's votes together have any distribution over their patterns, so correlated voters
    don't count twice. Groups are near copies at first, then also what agreement is left
    after some rounds. No label takes part: the class with more votes is called toxic.
    """
    said = votes.sum(axis=1)
    post = sigmoid(2 * (said - said.mean()) / max(1e-9, said.std()) - 1)
    groups = correlated_groups(votes, np.full(len(votes), 0.5), 0.9)
    for r in range(rounds):
        if r == 2 * rounds // 3:
            groups = correlated_groups(votes, post)
        odds = np.full(len(votes), np.log((post.sum() + 1) / ((1 - post).sum() + 1)))
        for g in groups:
            pattern = votes[:, g].astype(np.int64) @ (1 << np.arange(len(g)))
            n = np.stack([np.bincount(pattern, weights=w, minlength=1 << len(g)) + 0.5 / len(g) for w in (1 - post, post)])
            p = np.log(n / n.sum(axis=1, keepdims=True))
            odds += (p[1] - p[0])[pattern]
        post = sigmoid(odds)
    if (post @ said) / max(1e-9, post.sum()) < ((1 - post) @ said) / max(1e-9, (1 - post).sum()):
        post = 1 - post
    w = np.stack([1 - post, post])
    return post, (w @ votes + 0.5) / (w.sum(axis=1, keepdims=True) + 1), groups


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic fit to soft targets, by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (target - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y, half) of at most about ``bound`` labelled rows outside the held-out fold; ``half`` is 0 or 1 by the id's hash.

    A row is drawn by its id's hash; labels without a value are left out, repeated ones averaged.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    share = min(1.0, bound / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return materialize(texts(docs).join(F.broadcast(drawn), "doc_id").select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")), "train")  # at most about `bound` labels


def once_each(train: DataFrame) -> DataFrame:
    """One row of each group of near copies of a training sample, which are no independent evidence.

    Copies are told by their two runs of three words of least hash, which small changes seldom
    touch.
    """

    def least_runs(text: str) -> str:
        w = WORD.findall(text.lower())
        if not w:
            return ""  # texts without words teach nothing
        runs = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        return ",".join(map(str, sorted(zlib.crc32(r.encode()) for r in runs)[:2]))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        least = [least_runs(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.string())], [*batch.schema.names, "sketch"])

    sketched = map_batches(train, sketch, "text string, y int, half int, sketch string").filter("sketch <> ''")
    first = F.min_by(F.struct("text", "half"), F.struct(F.xxhash64("text"), "text")).alias("first")  # the same one in every run
    return materialize(sketched.groupBy("sketch", "y").agg(first).select("first.text", "y", "first.half"), "once")


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS) -> ToxicityModel:
    """Fit on at most about ``max_train`` labelled rows whose crc32(doc_id) mod 5 isn't 0.

    The lexicon holds words and word beginnings that toxic training rows surely have more often
    than others; lexicon and pattern voters vote on each row; the label model's posteriors,
    from the votes alone, are the targets of the linear classifier, which the labels calibrate. Without rows of both labels there is no
    lexicon, and every score is a smoothed base rate.
    """
    train = once_each(train_sample(docs, labels, "toxic", max_train))
    sizes = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    t, c = sizes.get(1, 0), sizes.get(0, 0)
    if not t or not c:
        return ToxicityModel(prior=min(0.49, (t + 0.5) / (t + c + 2)))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: dict[str, list[int]] = {}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term in terms_of(text):
                n.setdefault(term, [0, 0])[y] += 1
        return pa.RecordBatch.from_pydict({"term": list(n), "c": [v[0] for v in n.values()], "t": [v[1] for v in n.values()]})

    counts = map_batches(train, count, "term string, c bigint, t bigint").groupBy("term").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    # how sure it is that toxic rows have a term more often, against as many tries as there are terms;
    # and of the training rows with it, most must be toxic, or it would not be a voter of its own
    odds = F.log((F.col("t") + 0.5) / (t + 1)) - F.log((F.col("c") + 0.5) / (c + 1))
    tries = counts.filter("t >= 2").agg(F.count(F.lit(1))).first()[0]
    met = F.col("t") + F.col("c")
    gain = F.col("t") * F.log(F.col("t") / (met * (t / (t + c)))) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (met * (c / (t + c))))).otherwise(0)
    sure = gain >= float(np.log(max(2, tries)))
    best = counts.filter("t >= 3").withColumn("odds", odds).filter(sure & (F.col("t") >= MIN_PRECISION * (F.col("t") + F.col("c")))).orderBy(F.desc(F.col("odds") * F.col("t")), "term").limit(max_terms)
    lexicon = {r.term: i for i, r in enumerate(sorted(best.collect(), key=lambda r: (-r.odds, r.term)))}  # at most max_terms
    if not lexicon:
        return ToxicityModel(prior=min(0.49, (t + 0.5) / (t + c + 2)))
    model = ToxicityModel(lexicon)

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_ = batch.column(0).to_pylist()
        return pa.RecordBatch.from_arrays(
            [pa.array([lexicon_hits(x, model.lexicon, model.starts) for x in all_], pa.list_(pa.int32())), pa.array([shape(x) for x in all_], pa.list_(pa.float64())), batch.column(1)], ["hits", "shape", "y"]
        )

    rows = map_batches(train, look, "hits array<int>, shape array<double>, y int").collect()  # bounded by max_train
    rows.sort(key=lambda r: (r.hits, r.shape, r.y))  # sums of floats don't depend on tasks
    hits, shapes, y = [r.hits for r in rows], [tuple(r.shape) for r in rows], np.array([r.y for r in rows], float)
    votes = model.votes(hits, shapes)
    post, rate, _ = label_model(votes)
    x = model.features(hits, shapes)
    weights = logistic(x, post)
    # the labels set the scale: where a score of 0.5 lies
    shift, slope = logistic((x @ weights[1:] + weights[0])[:, None], y, ridge=1e-3)
    model.weights = weights * max(slope, 1e-3)
    model.weights[0] += shift
    model.accuracies = {f"voter{j}": float(post @ votes[:, j] / max(1e-9, votes[:, j].sum())) for j in range(votes.shape[1])}
    return model


def score_column(text, model: ToxicityModel):
    """The score of a text column; a null text counts as empty."""

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.score([x or "" for x in s.tolist()]))

    return score(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; one row for each row of ``docs``.

    Scores read the whole text alone. A null doc_id counts as held out. Null and empty texts
    get the score of a text without words.
    """
    model = model or fit_toxicity(docs, labels)
    rows = texts(docs)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5, all columns as they are, whatever their names.

    Null and empty texts have the score of a text without words and stay; texts are scored
    whole, whatever their length; repeated rows share their fate. An empty table gives no rows.
    """
    return docs.filter(score_column(F.col("text"), fit_toxicity(docs, labels)) < 0.5)
