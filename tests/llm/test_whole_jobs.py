"""Jobs over whole texts and tables, on inputs beyond the bounds that once cut them."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stillfresh.llm import ngram_join, quality, sentences, toxicity, url_rules


def brute_repeats(texts, min_words=25, span=1 << 30):
    """doc to the sorted places under any run with ``min_words`` words, or ``span`` sentences, that stands at an earlier place too."""
    firsts, gone = {}, {d: set() for d in texts}
    for d, parts in sorted(texts.items()):
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                if j - i >= span or sum(len(p.split()) for p in parts[i:j]) >= min_words:
                    if firsts.setdefault(tuple(parts[i:j]), (d, i)) != (d, i):
                        gone[d] |= set(range(i, j))
    return {d: sorted(g) for d, g in gone.items() if g}


def test_repeats_of_short_sentences(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(n)) + "."
    shared = [[line(1) for _ in range(30)], [line(rng.choice((1, 2, 3, 9, 14, 20, 27))) for _ in range(20)], [line(20), line(10), line(3)], [line(8) for _ in range(3)]]
    texts = {}
    for d in range(24):
        texts[d] = [line(rng.randint(1, 30)) for _ in range(3)]
        for part in rng.sample(shared, 2):
            texts[d] += part[rng.randint(0, 2) :] + [line(rng.randint(1, 30))]
    rows = spark.createDataFrame([(d, "\n".join(t)) for d, t in texts.items()], "doc_id long, text string").repartition(3)
    for span, want in ((None, brute_repeats(texts)), (3, brute_repeats(texts, span=3)), (2, brute_repeats(texts, span=2))):
        got = {r.doc_id: r.removed for r in sentences.repeats_digest(rows, span=span).collect()}
        assert got == {d: ",".join(map(str, g)) for d, g in want.items()}
    assert {r.doc_id: r.text for r in sentences.drop_repeats(rows, span=None).collect()} == {d: "\n".join(p for i, p in enumerate(t) if i not in brute_repeats(texts).get(d, ())) for d, t in texts.items()}


def test_capitals_of_the_whole_text():
    for text in ("Abc" * 4_000, "xÄy" * 3_000, "Aa" * 3_000 + "ΑΣσİß日Ǆǅ" * 500, "", "É", "aB"):
        assert toxicity.shape(text)[0] == sum(map(str.isupper, text)) / max(1, len(text))


def test_deep_urls(spark):
    deep = "/".join(f"d{i}" for i in range(40))
    urls = [f"http://a.b.c.d.e{i % 2}.f.org/p/q/r/s/{'bad' if i % 3 == 0 else 'good'}/x{'' if i % 5 else '?a&b&c&d&e&f&g&h'}" for i in range(90)] + [f"http://x.org/{deep}"] * 30
    labels = [(i, "block" if "/bad/" in u else "allow") for i, u in enumerate(urls) if i < 60 or "d39" in u]
    out = url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(labels, "page_id long, verdict string")).collect()
    assert {r.page_id: r.verdict for r in out} == {i: "block" if "/bad/" in u else "allow" for i, u in enumerate(urls)}


@pytest.fixture(scope="module")
def lists_and_prose(spark):
    """(documents, labels) of 9,000 labelled rows. Good ones are prose, or lists of codes where the id's hash is high: a draw of 6,000 rows by that hash took no list."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9)))
    code = lambda: "".join(rng.choice("ABCDEFG") + rng.choice("0123456789") for _ in range(rng.randint(1, 4)))
    ids = spark.range(9_000).withColumnRenamed("id", "doc_id").withColumn("held", toxicity.held_out(F.col("doc_id"))).withColumn("late", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) >= 840_000)
    rows = []
    for r in ids.orderBy("doc_id").collect():
        bad = r.doc_id % 9 == 0
        kind = "junk" if bad else "list" if r.late else "prose"
        text = {"junk": lambda: " ".join(rng.choice(["|", "##", "!!", "$$", "&&"]) + word() for _ in range(rng.randint(12, 40))), "list": lambda: "\n".join(code() for _ in range(rng.randint(12, 40))), "prose": lambda: ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(rng.randint(2, 6)))}[kind]()
        rows.append((r.doc_id, text, kind, int(not bad), r.held))
    rows = spark.createDataFrame(rows, "doc_id long, text string, kind string, quality int, held boolean").repartition(5)
    return rows.cache(), rows.select("doc_id", "quality")


def test_quality_learns_from_every_labelled_row(lists_and_prose):
    rows, labels = lists_and_prose
    assert rows.filter("NOT held").count() > 7_000 and rows.filter("kind = 'list' AND held").count() > 100
    out = quality.quality_verdicts(rows, labels).join(rows.filter("held").select("doc_id", "kind"), "doc_id").groupBy("kind").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.kind: r.kept for r in out}
    assert kept["prose"] > 0.95 and kept["list"] > 0.95 and kept["junk"] < 0.05


def test_quality_forest_equals_direct_counts(lists_and_prose):
    rows, labels = lists_and_prose
    model = quality.fit_quality(rows, labels)
    train = rows.filter("NOT held").orderBy("doc_id").collect()
    x = quality.rule_statistics(pa.array([r.text for r in train]))[1]
    y = np.array([r.quality for r in train])
    forest, good = model.forest, x[y == 1]
    assert (forest.rows.sum(axis=1) == len(good)).all()

    def way(tree, row):
        """The cells of a row from the root down, as words of turns."""
        node, cells = 0, [""]
        while node < forest.feature.shape[1]:
            side = int(row[forest.feature[tree, node]] > forest.point[tree, node])
            node, cells = 2 * node + 1 + side, [*cells, cells[-1] + str(side)]
        return cells

    def length(cells, counts, total):
        for depth, cell in enumerate(cells):
            n = counts.get(cell, 0) * min(1, forest.crowd / total)
            if n <= 1 or depth == len(cells) - 1:
                return depth + (0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)

    for tree in (0, 57):
        counts = {}
        for row in good:
            for cell in way(tree, row):
                counts[cell] = counts.get(cell, 0) + 1
        for own, some in ((1, good[::600]), (0, x[y == 0][::100])):
            for row in some:
                cells = way(tree, row)
                left = {**counts, **{c: counts[c] - 1 for c in cells}} if own else counts
                assert forest.paths(own)[tree, int(cells[-1], 2)] == pytest.approx(length(cells, left, len(good) - own))
                assert forest.cells(row[None, :])[0, tree] == int(cells[-1], 2)

    score = np.where(y == 1, forest.score(x, forest.paths(1)), forest.score(x, forest.paths()))
    worth = lambda cut: 2 * (score[y == 1] < cut).mean() + (score[y == 0] >= cut).mean()
    assert worth(model.threshold) == pytest.approx(max(worth(c) for c in [*np.unique(score), 2.0]))


def test_documents_with_one_passage_in_common_are_taken_apart_before_texts_move(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = words(30)
    texts = {i: [*words(60), *passage] for i in range(700)}
    texts |= {1000 + i: ["changed", *texts[i][1:]] for i in range(0, 700, 7)}  # a copy with another first word
    moved, verified = [], ngram_join.verified_links
    monkeypatch.setattr(ngram_join, "verified_links", lambda blocks, *a: moved.append(blocks.count()) or verified(blocks, *a))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table, 5, 80).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i in texts}
    assert moved[0] <= 2 * len(texts) / 7 + 20  # the copies and what they are of; several times all documents before


def test_sketches_let_every_similar_pair_through():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 5, 250, 255, 300, 511, 1000)]
    for s in list(sets):
        for share in (0.06, 0.1, 0.2, 0.5):
            sets.append(np.unique(np.concatenate([s[int(len(s) * share) :], rng.integers(0, 1 << 63, int(len(s) * share * 0.4)).astype(np.uint64)])))
    sets = sorted((s for s in sets if len(s)), key=len)
    n = np.array([len(s) for s in sets])
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if ngram_join.enough(n[a], n[b], len(np.intersect1d(sets[a], sets[b])), 80)]
    bits = [ngram_join.sketch(s) for s in sets]
    for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        label = list(range(len(sets)))
        for a, b in ngram_join.sketch_links(n, bits, side, 80):
            label = [label[a] if x == label[b] else x for x in label]
        assert pairs and all(label[a] == label[b] for a, b in pairs if side.max() == 0 or side[a] != side[b])
