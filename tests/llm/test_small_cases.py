"""Edge cases of the training-data operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stillfresh.llm import mixing, ngram_join, packing, pfor, quality, secrets, sentences, tokens, topk, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h int, key string, row string, n string"
SENTENCE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), 1, "x", "y", "z")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9)))
    base = [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(30)]
    near = [" ".join(w if rng.random() > 0.01 else word() for w in b.split()) for b in base[:15]]
    rows = [doc(i, t) for i, t in enumerate([*base, *base[:5], *near])]
    odd = ["", None, " \n\t ", "Ärger, İstanbul ΑΣ 's don't <|endoftext|> é!!", "one", "ONE", "two words", "x " * 30_000, "\x00nul \x1c sep", "日本 語 12 3.4"]
    rows += [doc(100 + i, t) for i, t in enumerate(odd)] + [doc(7, base[7]), doc(7, base[7]), doc(None, base[3]), doc(None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def expected_ids(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab'sS.,!?é ß\t\nİ", max_size=60), max_size=6))
def test_encoder_equals_the_library(whole, texts):
    enc = tokens.encoder(tokens.default_path())
    ids, offsets = enc.encode(pa.array(texts, pa.string()), 1)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [expected_ids(whole, t) for t in texts]


def test_encoder_forgets_and_goes_on(whole):
    enc = tokens.Encoder(tokens.default_path(), max_words=50)
    for k in range(6):
        text = " ".join(f"w{'abcdef'[k]}{'xyz'[j % 3]}{'klmno'[j % 5]}" for j in range(30)) + " the the"
        assert enc.encode(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 9), max_size=700))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    sections, facts = pfor.from_bytes(pfor.to_bytes(pfor.pack_blocks(ids), n_tokens=len(ids)))
    assert pfor.unpack_blocks(sections, facts["n_tokens"]).tolist() == values


def test_token_ids(docs, whole):
    got = pfor.read_token_ids(pfor.write_token_ids(docs, shard_tokens=2000)).collect()
    want = sorted(((r.doc_id, expected_ids(whole, r.text)) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(i), crc(i)) for d, i in want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    assert [r.doc_id for r in ordered] == [d for d, _ in want]
    assert pfor.token_id_digest(docs.limit(0)).count() == 0


def test_packing(docs, whole):
    rows = packing.pack_documents(docs, 64).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(expected_ids(whole, r.text))
    parts, places = {}, {}
    for r in rows:
        raw = np.frombuffer(r.ids, f"<u{len(r.ids) // r.length}").tolist()
        assert crc(raw) == r.ids_crc32 and r.offset + r.length <= 64
        parts.setdefault((r.doc_id, r.row), []).append((r.start, raw))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    found = {}
    for (d, _), p in parts.items():
        found.setdefault(d, []).append([i for _, raw in sorted(p) for i in raw])
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(x) for d, x in texts.items()}
    full = [sum(n for _, n in p) for _, p in sorted(places.items())]
    assert all(sorted(p)[k][0] == sum(n for _, n in sorted(p)[:k]) for p in places.values() for k in range(len(p))) and set(full[:-1]) <= {64}
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert_key(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_secrets(spark, docs):
    texts = ['API_KEY = "abc/def123" token: x password=12345', "AKIA" + "A1" * 10 + " akia AKIAB", "é " + "0123456789abcdef" * 2, "paſsword=abcdefgh", "k Zx9Qm2Lr7Vt4Kp1Ws8Yd3 end", "123e4567-e89b-12d3-a456-426614174000", "secret:'" + "=" * 7]
    own = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    rows = own.unionByName(docs)
    out = secrets.secrets_digest(rows).collect()
    want = sorted((str(r.doc_id), *secrets.brute_force(r.text)) for r in rows.collect())
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out) == want
    found = {r.doc_id: r.found for r in secrets.scan_secrets(own).collect()}
    assert [x.kind for x in found[4]] == ["entropy"] and not found[5] and not found[3]
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(own).collect()}
    assert "abc/def123" not in clean[0] and "Zx9Qm2" not in clean[4] and clean[5] == texts[5]
    assert secrets.redact_secrets(docs).columns == docs.columns and secrets.redact_secrets(docs).count() == docs.count()


def test_whole_tokens_are_redacted(spark):
    key = "aGVsbG9Xb3JsZDEyMzQ1Njc4OTBhYmNkZWZ5LZXk"
    texts = [f"k {key} end", f"k x={key}== end", f"{key}={key[::-1]}"]
    own = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: [(x.start, x.end) for x in r.found if x.kind == "entropy"] for r in secrets.scan_secrets(own).collect()}
    assert found == {0: [(2, 42)], 1: [(2, 46)], 2: [(0, 81)]}
    assert {r.doc_id: r.text for r in secrets.redact_secrets(own).collect()} == {0: "k [SECRET] end", 1: "k [SECRET] end", 2: "[SECRET]"}


def test_sets_that_share_a_name_send_all_signatures(spark):
    pack = lambda *s: ngram_join.packed(np.array(s, np.uint64), np.array([len(s)]), ngram_join.SIG_BYTES)[0].as_py()
    rows = [(5, pack(11, 12), b"one", 3), (5, pack(21, 22), b"two", 3), (9, pack(21, 33), b"three", 3)]
    table = spark.createDataFrame(rows, "h long, sigs binary, fp binary, n long").coalesce(1)
    assert {(r.a, r.b) for r in ngram_join.candidate_links(table).collect()} == {(5, 9)}


@settings(max_examples=60, deadline=None)
@given(st.text("abcdefABCDEF0123456789+/", min_size=20, max_size=70))
def test_entropy_windows_equal_direct_counts(run):
    from collections import Counter
    from math import log2

    rule = secrets.EntropyRule(allowed=())
    w, covered, near = rule.window, set(), set()
    for i in range(len(run) - w + 1):
        part = run[i : i + w]
        name = next((n for n, members in secrets.CLASSES if set(part) <= members), "mixed")
        if not any(map(str.isdigit, part)) and (name != "mixed" or part.title() == part):
            continue
        bits = -sum(c / w * log2(c / w) for c in Counter(part).values())
        covered |= set(range(i, i + w)) if bits >= rule.thresholds[name] + 1e-9 else set()
        near |= set(range(i, i + w)) if bits >= rule.thresholds[name] - 1e-9 else set()
    got = {k for s, e in secrets.window_spans(run, rule) for k in range(s, e)}
    assert covered <= got <= near


def test_planted_secrets(spark):
    import base64
    import uuid

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    raw = lambda n: bytes(rng.randrange(256) for _ in range(n))
    kinds = {
        "base64": lambda: base64.b64encode(raw(30)).decode(),
        "url-safe": lambda: base64.urlsafe_b64encode(raw(33)).decode(),
        "HEX": lambda: raw(20).hex().upper(),
        "lower": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)),
        "prefixed": lambda: "sk_live_" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(28)),
    }
    clean = [
        lambda: str(uuid.UUID(bytes=raw(16))), lambda: "-".join(word() for _ in range(6)), lambda: "2024-01-02/2025-03-04_00000000", lambda: "/usr/local/" + "/".join(word() for _ in range(4)),
        lambda: "".join(word().title() for _ in range(5)), lambda: "=" * 40, lambda: "EXAMPLE" + raw(11).hex(), lambda: "x" * 30 + "1" * 10,  # 24 hex digits would be a base span
    ]
    rows, planted = [], {}
    for i in range(400):
        words = [word() for _ in range(60)]
        kind = [*kinds, None, None, None][i % 8]
        words[rng.randrange(60)] = (kinds[kind] if kind else clean[i // 8 % len(clean)])()
        rows.append((i, " ".join(words)))
        planted[i] = kind
    found = {r.doc_id: {x.kind for x in r.found} for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {k: sum(bool(found[i]) for i, p in planted.items() if p == k) / sum(p == k for p in planted.values()) for k in kinds}
    wrong = sum(bool(found[i]) for i, p in planted.items() if p is None)
    assert min(hit.values()) >= 0.95, hit
    assert sum(bool(found[i]) for i, p in planted.items() if p) / max(1, wrong + sum(bool(found[i]) for i, p in planted.items() if p)) >= 0.98


def test_jaccard(docs):
    unique = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = ngram_join.brute_force({r.doc_id: r.text for r in unique.collect()})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(unique).collect()} == want
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == docs.count() and {r.component_id for r in got if r.doc_id == 7} == {7}
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and not {30, 31} & {r.doc_id for r in kept.collect()}
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join(base[: 60 - i % 9] + [f"t{i % 40}"] * (i % 3)) for i in range(700)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = ngram_join.brute_force(dict(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(rows).collect()} == want


def test_sentence_repeats(spark, docs):
    shared = f"{SENTENCE} one. {SENTENCE} two! {SENTENCE} three?"
    texts = [f"First here. {shared} Own end one.", f"Other start.\n{shared.upper()}\nOther end.", f"{shared} {shared}", "Short. Short. Short.", "Short. Short. Short.", "No. One. Two.", "One. Two. No."]
    rows = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    out = {r.doc_id: r for r in sentences.repeats_digest(rows).collect()}
    assert {d: r.removed for d, r in out.items()} == {1: "1,2,3", 2: "0,1,2,3,4,5", 4: "0,1,2"} and out[1].first_doc_ids == "0"
    assert {r.doc_id: r.text for r in sentences.drop_repeats(rows).collect()}[1] == "Other start.\nOther end."
    assert sentences.drop_repeats(docs).count() == docs.count() and sentences.repeats_digest(docs.limit(0)).count() == 0


def test_mixing(docs):
    out = mixing.mix_probabilities(docs, rounds=3)
    assert out.count() == docs.count() and out.filter("probability < 0 OR probability > 1 OR probability IS NULL").count() == 0
    kept = mixing.mix_documents(docs, rounds=3)
    assert kept.columns == docs.columns and kept.count() == out.filter("sampled").count()
    assert mixing.mix_probabilities(docs.limit(0), rounds=1).count() == 0


def test_documents_without_words_stay(spark):
    rows = [doc(i, " \t\n" if i % 3 else None) for i in range(40)] + [doc(100 + i, "some words here") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_probabilities(docs).collect()
    assert all(r.sampled and r.probability == 1 for r in out if r.doc_id < 100) and not all(r.sampled for r in out)
    assert sorted(r.doc_id for r in mixing.mix_documents(docs).collect()) == sorted(r.doc_id for r in out if r.sampled)


def test_mixing_keeps_clashing_columns(docs):
    names = docs.withColumns({"cell_p": F.lit(7), "CELL_topic": F.lit("a"), "topic": F.lit("b"), "weight": F.lit(None).cast("string")})
    kept = mixing.mix_documents(names, rounds=2)
    assert kept.columns == names.columns and {(r.cell_p, r.CELL_topic, r.topic) for r in kept.collect()} == {(7, "a", "b")}
    assert kept.count() == mixing.mix_documents(docs, rounds=2).count()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_marginals_of_the_given_tables(spark, sf):
    rows = mixing.measured(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    weights, targets = mixing.weighted(rows, None, mixing.ROUNDS, mixing.BUDGET, mixing.FLATTEN)
    errors = mixing.marginal_errors(weights, targets).collect()
    assert {r.dimension for r in errors} == set(mixing.DIMENSIONS) and max(r.error for r in errors) < 0.02
    kept, have = (weights.agg(F.sum(c)).first()[0] for c in ("weight", "n"))
    assert abs(kept / have - mixing.BUDGET) < 0.01


def test_keyword_topics(spark):
    topic = mixing.keyword_topics({"sea": ["ship", "wave"], "sky": ["cloud", "Wave".lower()]})
    df = spark.createDataFrame([("Ship, ship cloud",), ("cloud wave cloud",), ("none",), ("wave",)], "text string")
    assert [r.t for r in df.select(topic(F.col("text")).alias("t")).collect()] == ["sea", "sky", "", "sea"]


def test_mixing_meets_reachable_targets(spark):
    rows = spark.createDataFrame([doc(i, "w " * 50, ("en", "de")[i % 2], f"s{i % 3}") for i in range(600)], DOCS)
    want = {"source": spark.createDataFrame([("s0", 9000.0), ("s1", 5000.0), ("s2", 1000.0)], "source string, want double"), "lang": spark.createDataFrame([("en", 9000.0), ("de", 6000.0)], "lang string, want double")}
    out = mixing.mix_probabilities(rows, want, rounds=12)
    for d, target in (("source", {"s0": 9000, "s1": 5000, "s2": 1000}), ("lang", {"en": 9000, "de": 6000})):
        got = {r[d]: r.t for r in out.groupBy(d).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t")).collect()}
        assert all(abs(got[k] - v) < 0.01 * v for k, v in target.items())


VECTORS = "vec_id long, embedding array<double>, v string"


def test_topk(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8)) / 3
    x[10:60] = x[10]
    rows = [(i, [float(v) for v in r], "clash") for i, r in enumerate(x)]
    rows += [(1000, None, ""), (1050, [1.0, None], ""), (1100, [float("nan")] * 8, ""), (1150, [float("inf")] * 8, ""), (None, [1.0] * 8, ""), (1200, [], ""), (1250, [0.5, 0.25], "")]
    df = spark.createDataFrame(rows, VECTORS)
    q = {i: [int(np.floor(256 * v)) for v in r] for i, r, _ in rows if i is not None and r is not None and all(v is not None and np.isfinite(v) for v in r)}
    want = set()
    for a in q:
        if a % 50 == 0:
            best = sorted((-sum(s * t for s, t in zip(q[a], q[b], strict=False)), b) for b in q if b != a)[:5]
            want |= {(a, k + 1, b, -s) for k, (s, b) in enumerate(best)}
    for lists, tile in ((2, 4096), (3, 64)):
        assert {tuple(r) for r in topk.top_k(df, lists=lists, tile=tile).collect()} == want
    same = df.filter("vec_id < 20").unionByName(df.filter("vec_id = 0")).unionByName(df.filter("vec_id = 0")).unionByName(df.filter("vec_id = 7"))
    assert sorted(map(tuple, topk.top_k(same).collect())) == sorted(map(tuple, topk.top_k(df.filter("vec_id < 20")).collect()))
    seven = spark.createDataFrame([(50, [1.0, 0.0], "")] * 7 + [(50, [0.0, 2.0], "")] + [(60 + i, [0.5, 0.1 * i], "") for i in range(3)], VECTORS)
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(seven).collect())
    assert [g[1] for g in got].count(50) == 2 and len(got) == 8  # each of both rows of id 50 finds the other and the three
    few = df.filter("vec_id IN (0, 1, 2)")
    assert topk.top_k(few).count() == 2 and topk.top_k(df.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "no host", "://", "http://WWW.Example.com/en/1?a=b#c", "https://example.com/en/2", "https://m.example.com/en/", "http://x.com", "http://x.com/", "http://xcom/", "http://a.net/es/1", "http://a.net/de/1", "ftp://B.NET/fr/?q", "http://a.org?x=/y", "http://h#f/"]
    pages = spark.createDataFrame([(i, u, "<p>", "c") for i, u in enumerate(urls)] + [(5, urls[5], "", "")], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_rules.judge_urls(pages).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = rest[:k].lower(), rest[k:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [n for n, h, p, _ in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, max(fits, key=len, default=None))
    assert url_rules.judge_urls(pages).count() == 16 and url_rules.judge_urls(pages.limit(0)).count() == 0


def test_url_rules_equal_counted_sets(spark):
    from itertools import combinations

    rng = random.Random(4)
    pages = [(i, f"http://{rng.choice(['a', 'b'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['x', 'y'])}") for i in range(300)]
    labels = [(i, "block" if ("net" in u and u.endswith("x")) or i % 17 == 0 else "allow") for i, u in pages]
    out = {r.page_id: r for r in url_rules.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, verdict string"), 0.05, 0.8).collect()}
    df = spark.createDataFrame(pages, "page_id long, url string")
    host, path = url_rules.url_parts(df).select("page_id", url_rules.url_tokens(F.col("host"), F.col("path"), F.col("query")).alias("t")), dict(labels)
    bags = {r.page_id: frozenset(r.t) for r in host.collect()}
    counts = {}
    for i, b in bags.items():
        for k in range(1, len(b) + 1):
            for c in combinations(sorted(b), k):
                n = counts.setdefault(c, [0, 0])
                n[0] += 1
                n[1] += path[i] == "block"
    good = {c: n[1] / n[0] for c, n in counts.items() if n[1] >= 0.05 * 300 and n[1] / n[0] >= 0.8}
    for i, b in bags.items():
        best = max((v for c, v in good.items() if set(c) <= b), default=None)
        if out[i].rule is None:
            assert (out[i].verdict == "block") == (best is not None) and (best is None or abs(out[i].confidence - best) < 1e-9)


def learnable(spark, n=600):
    rng = random.Random(9)
    words = ["the", "of", "river", "stone", "walk", "green", "paper", "light", "table", "window"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        text = " ".join(rng.choice(words) for _ in range(40))
        rows.append(doc(i, text + (" you " + rng.choice(["idiot", "moron", "lostraan", "lostraun", "lostrabe"]) + " there" if bad else "")))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, docs):
    rows, labels = learnable(spark)
    out = toxicity.toxicity_scores(rows.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000)), labels).join(labels, "doc_id", "left").collect()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held) and sum(r.toxic for r in held) > 5
    kept = toxicity.drop_toxic(rows, labels)
    assert kept.columns == rows.columns and kept.count() < rows.count()


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()} == {0}
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_label_model_trusts_good_voters():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    votes = np.stack([np.where(rng.random(3000) < a, y, ~y) for a in (0.95, 0.9, 0.55)], axis=1).astype(float)
    post, rate, groups = toxicity.label_model(votes)
    assert rate[1, 0] > 0.85 and rate[1, 1] > 0.85 and max(rate[0, :2]) < 0.15 and abs(rate[1, 2] - 0.55) < 0.05 and len(groups) >= 2
    assert ((post >= 0.5) == y).mean() > 0.92


def test_label_model_counts_copies_of_a_voter_once():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.85, y, ~y) for _ in range(3)]
    poor = np.where(rng.random(4000) < 0.7, y, ~y)
    votes = np.stack([*good, poor, poor, np.where(rng.random(4000) < 0.98, poor, ~poor)], axis=1).astype(float)
    post, _, groups = toxicity.label_model(votes)
    assert [3, 4, 5] in map(sorted, groups) and ((post >= 0.5) == y).mean() > 0.9


def test_rule_statistics(docs):
    rows = docs.collect()
    counts, stats = quality.rule_statistics(pa.array([r.text or "" for r in rows]))
    assert ((stats >= 0) & (stats <= 1)).all()
    for r, c in zip(rows, counts, strict=True):
        raw = (r.text or "").encode()
        w = raw.split()
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 5)} if len(w) < 2000 else set(range(len(w)))
        lines = [x for x in (r.text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        assert c.tolist() == [len(w), sum(len(x.decode()) for x in w), sum((r.text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_quality_keeps_clean(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9)))
    rows, labels = [], []
    for i in range(400):
        text = ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(5))
        bad = i % 8 == 0
        rows.append(doc(i, text.upper().replace(" ", "!! ") if bad else text))
        labels.append((i, int(not bad), 0))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    data = spark.createDataFrame(rows, DOCS)
    out = quality.quality_verdicts(data, labels).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum(r.kept == bool(r.quality) for r in out) >= 0.95 * len(out)
    assert all(r.base_failed for r in quality.quality_verdicts(docs, labels).filter("n_words < 10").collect())
    assert quality.quality_verdicts(docs, labels.limit(0)).filter("kept = base_failed").count() == 0
    assert quality.quality_verdicts(docs.limit(0), labels).count() == 0
