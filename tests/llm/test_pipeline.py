"""The pipeline's stages, each against a brute-force version of its step on its own input."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stillfresh.llm import mixing, ngram_join, secrets, tokens, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxicity(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.toxicity_scores(steps[0], labels).filter("predicted = 1").collect()}
    assert set(texts(steps[1])) == set(texts(steps[0])) - rejected
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    assert sum((d in rejected) == bool(t) for d, t in toxic.items()) >= 0.9 * len(toxic)


def test_near_copies(steps):
    want = {d for d, (_, c) in ngram_join.brute_force(texts(steps[1]), width=5, percent=80).items() if c == d}
    assert set(texts(steps[2])) == want


def test_secrets(steps):
    before, after = texts(steps[2]), texts(steps[3])
    assert set(before) == set(after) and any(sum(secrets.brute_force(t)[:3]) for t in before.values())
    for d, t in after.items():
        assert secrets.brute_force(t)[1:3] == (0, 0)
        if secrets.brute_force(before[d])[:3] == (0, 0, 0) and "[SECRET]" not in t:
            assert t == before[d]
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())


def brute_mix(rows):
    """IPF over a dictionary of cells, then the same draw."""
    cells = {}
    for r in rows:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    w = {c: float(n) for c, n in cells.items()}
    total = sum(cells.values())
    want = []
    for i in range(3):
        have = {}
        for c, n in cells.items():
            have[c[i]] = have.get(c[i], 0) + n
        full, goal = set(), {}
        while not goal:
            left = sum(v**mixing.FLATTEN for k, v in have.items() if k not in full)
            c = (total * mixing.BUDGET - sum(have[k] for k in full)) / left
            more = {k for k, v in have.items() if k not in full and c * v**mixing.FLATTEN >= v}
            full |= more
            goal = {} if more else {k: float(v) if k in full else c * v**mixing.FLATTEN for k, v in have.items()}
        want.append(goal)
    for _ in range(mixing.ROUNDS):
        for i in range(3):
            now = {}
            for c, x in w.items():
                now[c[i]] = now.get(c[i], 0) + x
            w = {c: min(x * want[i][c[i]] / now[c[i]], float(cells[c])) for c, x in w.items()}
    draw = lambda d: int(hashlib.md5(f"{d}|{mixing.SEED}".encode()).hexdigest()[:12], 16) / 2**48
    return {r.doc_id for r in rows if r.n_tokens == 0 or draw(r.doc_id) < w[r.source, r.lang, r.topic] / cells[r.source, r.lang, r.topic]}


def test_mixing(steps):
    assert set(texts(steps[4])) == brute_mix(mixing.measured(steps[3]).collect())


def test_packing(steps):
    whole = Tokenizer.from_file(tokens.default_path())
    ids = {d: whole.encode(t, add_special_tokens=False).ids + [1] for d, t in texts(steps[4]).items()}
    rows = steps[5].orderBy("doc_id", "start").collect()
    covered = dict.fromkeys(ids, 0)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == covered[r.doc_id] and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
    assert covered == {d: len(i) for d, i in ids.items()}
    sizes = steps[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n < 2048").count()
    assert sizes <= 1


def test_empty_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.count() == 0


def odd_documents(spark):
    """A few documents beside rows with nulls, no text, a very long text and repeats, and columns whose names the stages use."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 200")
    clash = {"h": F.lit(1), "key": F.lit("k"), "row": F.lit(2), "n": F.lit(3), "_row": F.lit(4), "_p": F.lit(0.5), "_dropped": F.lit(True), "topic": F.lit("t"), "score": F.lit(9), "predicted": F.lit(7)}
    long = " ".join(f"w{i % 7919}x{i}" for i in range(60_000))
    twice = "the same row comes two times in this table"
    rows = [
        (900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (900_003, long, "en", "s", len(long)), (None, "a row without an id has words of its own", "en", "s", 40),
        (900_004, "seven words are here without a source", None, None, 38), (900_005, twice, "en", "s", len(twice)), (900_005, twice, "en", "s", len(twice)),
    ]
    return docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).withColumns(clash)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    at = odd_documents(spark)
    columns, odd = at.columns, "doc_id IS NULL OR doc_id > 900000"
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = at
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert at.columns == columns
            assert at.select("h", "key", "row", "n", "_row", "_p", "_dropped", "topic", "score", "predicted").distinct().count() == 1
        if name in ("toxicity", "ngram_jaccard_join", "secret_scans"):  # none of them is toxic, a copy of another, or secret
            assert sorted(map(str, at.filter(odd).select("doc_id", "text").collect())) == sorted(map(str, before.filter(odd).select("doc_id", "text").collect()))
        if name == "mixing":
            assert at.exceptAll(before).isEmpty() and at.filter("doc_id IN (900001, 900002)").count() == before.filter("doc_id IN (900001, 900002)").count()
    whole = Tokenizer.from_file(tokens.default_path())
    want = {r.doc_id: len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.filter("doc_id > 900000").collect()}
    assert {r.doc_id: r.n for r in at.filter("doc_id > 900000").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
