"""Embedding near-duplicates against all pairs, toxicity on held-out labels, language-model counts against brute force, the pipeline stage by stage."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tokenizers import Tokenizer

import corpus_pipeline
from latticeweave.llm import embedding_dedup, lm_score, packing, quality, simhash, toxicity
from latticeweave.llm.common import tokenizer_path


def brute_links(rows, threshold=embedding_dedup.THRESHOLD):
    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links, parent = Counter(), {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, v, label) in enumerate(rows):
        for j, w, other in rows[:k]:
            if label is None or label != other or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            a, b = np.array(v, float), np.array(w, float)
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (links[i], root(i)) for i, *_ in rows}


def clustered_vectors(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 25), width))
    v = centres[rng.integers(len(centres), size=n)] + spread * rng.normal(size=(n, width))
    return v.astype(np.float32).tolist()


@pytest.mark.parametrize("cell,block", [(1000, 2000), (20, 2000), (30, 15)])
def test_embedding_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    v = clustered_vectors(1, 300, 8, 0.35)
    rows = [(i, x, i % 3 if i % 7 else 0) for i, x in enumerate(v)]
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [1e-30, 2e-30], v[0], v[0], [2 * x for x in v[0]]]
    rows += [(1000 + k, x, 0) for k, x in enumerate(odd)] + [(2000, v[0], None), (2001, v[0], 1)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, label int, rep long, n_links long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df.repartition(3)).collect()}
    want = brute_links(rows)
    assert {i: g[:2] for i, g in got.items()} == want and sum(n for n, _ in want.values()) > 100
    assert all(kept == (i == component) for i, (_, component, kept) in got.items())
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_cover_tree_pairs():
    for seed, spread in ((0, 0.1), (1, 0.4), (2, 5.0)):
        x = embedding_dedup._unit(np.array(clustered_vectors(seed, 700, 6, spread)))
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)))}
        got = [(min(p), max(p)) for i, j, _ in embedding_dedup.close_pairs(x, None, 0.93) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and want == set(got)
        a, b = x[:300], x[300:]
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(a @ b.T >= 0.93))}
        got = [p for i, j, _ in embedding_dedup.close_pairs(a, b, 0.93) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and want == set(got)


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.judge(docs, toxicity.train(docs, labels, toxicity.learnable())).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic]
    wrong = [r.predicted for r in rows if not r.toxic]
    assert sum(caught) / len(caught) > 0.75 and sum(wrong) / len(wrong) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_toxicity_states():
    g = toxicity.Grammar({"idiot": 4.0, "moro*": 4.0})
    plain, aimed, denied, quoted = (sum(g.clauses(w)[0].values()) for w in ("an idiot here", "you idiot", "not an idiot", "it said idiot"))
    assert denied < plain < aimed and quoted < plain and denied > 0
    assert g.clauses("they will kill")[0] and not g.clauses("to kill. you")[0]
    assert g.clauses("moronic") == ({("moronic",): 4.0}, 1) and g.clauses("moronic! moronic")[1] == 2


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "x", 0.1), (3, "a" * 100000, 0.1), (3, "a" * 100000, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.judge(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5}
    assert toxicity.judge(docs.where("false"), toxicity.train(docs, labels)).count() == 0


@pytest.mark.parametrize("entries", [lm_score.ENTRIES, 12])
def test_language_model_counts(spark, entries):
    rng = random.Random(3)
    words = ["a", "B", "b", "cc", "é", "x" * 50, "d\x1ce", "the"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(80)] + [None, "", " \n", "new words here", "a a a"] + ["a the\tthe"] * 4
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, "a b")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, n long, score double")
    got = lm_score.score(df.repartition(3), entries=entries).collect()

    def tokens(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [b"\n"]

    def held(i):
        return zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1

    train = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted(
        (-1 if i is None else i, held(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_score.score(df.where("false")).count() == 0
    assert lm_score.score(df.where("doc_id = 1")).count() == 1


@pytest.mark.parametrize("entries", [lm_score.ENTRIES, 4, 1])
def test_language_model_keeps_all_counts(spark, entries):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(0, 25)))) for i in range(120)]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), entries=entries).collect()}
    chains = {i: [b"\n", *t.encode().split(), b"\n"] for i, t in rows}
    train = [c for i, c in chains.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two, kept = Counter(w for c in train for w in c[1:]), Counter(p for c in train for p in zip(c, c[1:])), Counter()
    q = {p: lm_score.BASE ** math.floor(math.log(n) / math.log(lm_score.BASE) + 1e-9) for p, n in two.items()}
    for (u, _), x in q.items():
        kept[u] += x
    whole = sum(one.values()) + 0.5 * (len(one) + 1)

    def p(u, w):
        return (q.get((u, w), 0) + (max(one[u] - kept[u], 0) + lm_score.MU) * (one[w] + 0.5) / whole) / (one[u] + lm_score.MU)

    for i, c in chains.items():
        assert abs(got[i].score - sum(math.log10(p(*x)) for x in zip(c, c[1:]))) < 1e-6


def test_bloom_filter_levels(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 3000)
    n = rng.integers(4, 4000, 3000)
    pairs = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys, n)], "key long, n long")
    f = lm_score.build_filter(pairs.repartition(5), 4)
    q = f.counts(keys.view(np.uint64))
    exact = 4 * lm_score.BASE ** (lm_score.levels_of(n, 4) - 1)
    assert (q >= exact - 1e-6).all() and (np.abs(q - exact) < 1e-6).mean() > 0.98 and (exact <= n + 1e-6).all()
    assert (f.counts(rng.integers(0, 2**63, 3000).view(np.uint64)) > 0).mean() < 0.02


def test_model_beats_single_tokens(spark, sf):
    rows = lm_score.score(spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_pipeline_stages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.judge(docs, toxicity.train(docs, labels, toxicity.learnable())).where("predicted = 1").collect()}
    kept = docs.where(~docs.doc_id.isin(list(toxic)))
    bad = {r.doc_id for r in quality.judge(kept, quality.train(docs, labels)).where("not kept").collect()}
    kept = [(r.doc_id, r.text) for r in kept.collect() if r.doc_id not in bad]
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in kept}
    ids, first = sorted(fps), {}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    first = {i for i in ids if root(i) == i}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == first
    tokenizer, texts, pieces = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY)), dict(kept), {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, own in pieces.items():
        ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [packing.END_ID]
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids) for r in own)
    ends = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= packing.WINDOW


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        stage(spark, docs.where("false"), "/root/testdata/sf0.001").count()
