"""Rows with null, repeated and text ids, columns with clashing names, and the methods' own results against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latticeweave.llm import bpe, common, gbt, grammar, license_scan, lm_score, packing, quality, sharding, simhash, toxicity, url_filter
from latticeweave.llm.common import tokenizer_path
from test_text_operators import odd_texts

CLASHING = ["quality", "toxic", "_id", "_gone", "_first", "fp", "_file", "_index", "h", "_h", "_n_bytes", "_depth", "shard", "held_out", "score"]


def clashing(df):
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_special_names_as_the_plain_call():
    from tokenizers import Tokenizer

    path = tokenizer_path(packing.VOCABULARY)
    plain = Tokenizer.from_file(path)
    texts = ["x <|endoftext|> y", "<|startoftext|>", "a<|EndOfText|>b", "<|endoftext", "é <|endoftext|>\n<|startoftext|> 's", "中文<|endoftext|>", "", "no name"]
    got = packing.WordEncoder(path).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert 49407 in np.frombuffer(got[0], "<u4")


def test_write_shards_keeps_every_row(spark, tmp_path):
    rows = [(i % 5, "x" * (i % 90), i) for i in range(60)] + [(None, "y" * 80, 100 + i) for i in range(30)] + [(7, "z" * 70, 200 + i) for i in range(40)] + [(8, "w" * 900, 300), (9, None, 301), (9, None, 301), (10, "", 302)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(5))
    path = str(tmp_path / "shards")
    name = sharding.write_shards(df, path, limit=400)
    back = spark.read.parquet(path)
    assert name == "shard_" and rows_of(back.select(df.columns)) == rows_of(df)
    size = defaultdict(list)
    for r in back.select(name, F.octet_length("text").alias("n")).collect():
        size[r[name]].append(r.n or 0)
    assert len(size) > 10 and all(s.startswith("b") and (sum(v) <= 400 or len(v) == 1) for s, v in size.items())
    assigned = sharding.assign_shards(df, limit=400).groupBy("shard").count().count()
    assert assigned == len(size)
    sharding.write_shards(df.where("false"), str(tmp_path / "none"))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_clashing_names_and_text_ids(spark, kind):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["good", "plain", "words", "idiot", "you", "line\n", "##"]) for _ in range(rng.randrange(0, 120))) for _ in range(60)] + [None, "", "a b", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a b"), (3, "other")], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    labels = spark.createDataFrame([(i, i % 2, int("idiot" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    wide = clashing(df)
    forest, learned = quality.train(wide, labels), toxicity.train(wide, labels)
    for one, two in (
        (quality.judge(wide, forest), quality.judge(df, quality.train(df, labels))), (toxicity.judge(wide, learned), toxicity.judge(df, toxicity.train(df, labels))),
        (simhash.near_duplicates(wide), simhash.near_duplicates(df)), (license_scan.scan_licenses(wide), license_scan.scan_licenses(df)), (sharding.assign_shards(wide), sharding.assign_shards(df)),
        (lm_score.score(wide).drop("score", "base_score"), lm_score.score(df).drop("score", "base_score")),
    ):
        assert rows_of(one) == rows_of(two) and one.count() == df.count()
    kept = Counter(r.text for r in quality.judge(df, forest).where("kept").join(df, "doc_id").collect())
    assert set(kept) >= {r.text for r in quality.keep(wide, forest).collect()} and quality.keep(wide, forest).columns == wide.columns
    toxic = toxicity.judge(df, learned).where("predicted = 1").count()
    assert toxicity.keep(wide, learned).count() == df.count() - toxic
    assert simhash.keep_first(wide).columns == wide.columns


def test_dedup_keeps_one_row_of_each_component(spark):
    a, b = "one two three four five six", "quite other words stand in this text"
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, "x"), (None, "x"), (3, None), (4, "")]
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_first(clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, "x"), (3, None)], key=str)
    # a row without an id links others
    base = [f"w{k}" for k in range(400)]
    chain = [" ".join(base), " ".join([*base[:-1], "q"]), " ".join([*base[:-2], "r", "q"])]
    prints = [simhash.fingerprint(t.encode()) for t in chain]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 and (prints[1] ^ prints[2]).bit_count() <= 3
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(5, chain[0]), (None, chain[1]), (6, chain[2])], "doc_id long, text string")).collect()}
    assert found == {5: 5, 6: 5, None: None}


def test_simhash_refuses_distances_it_cannot_keep(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        simhash.near_duplicates(df, distance=4)


def test_stages_by_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = "/root/testdata/sf0.01"
    fine = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").join(spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'"), "doc_id")
    text = max((r.text for r in fine.collect()), key=lambda t: (len(set(t.split())) / len(t.split()) > 0.5, len(t)))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, "en", "s", 1), (1, "bad ### " * 80, "en", "s", 2), (None, "bad ### " * 80, "en", "s", 2)]
    docs = clashing(spark.createDataFrame(rows, schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(docs.columns) == 5 + len(CLASHING)
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert [(r.doc_id, r.text) for r in docs.collect()] == [(1, text)]


def test_quality_verdict_by_walking_trees(spark):
    texts = odd_texts(7) + ["many different words stand here " * k for k in range(8, 14)]
    labels = spark.createDataFrame([(i, (i // 3) % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forest = quality.train(docs, labels)
    for r in quality.judge(docs, forest).collect():
        counts, x = quality.counts_of((texts[r.doc_id] or "").encode())
        z = forest.bias
        for feature, threshold, value in zip(forest.feature.tolist(), forest.threshold.tolist(), forest.value.tolist()):
            k = 0
            while k < len(feature):
                k = 2 * k + (2 if x[feature[k]] > threshold[k] else 1)
            z += value[k - len(feature)]
        p = 1 / (1 + math.exp(-z))
        assert abs(p - r.score) < 1e-9 and r.kept == (not r.base_failed and p >= 0.5)
    # a leaf that holds row 0 alone has its value
    forest = gbt.fit(np.r_[np.zeros((1, 1)), np.ones((30, 1))], np.r_[1.0, np.zeros(30)], [0], trees=1, depth=1)
    assert forest.value.shape == (1, 2)


def license_texts():
    rng = random.Random(11)
    texts = odd_texts(8, 40)
    for label, text, _ in license_scan.TEMPLATES:
        words = text.split()
        texts += [text, "before it " + text + " after it", " ".join(words[: len(words) // 2])]
        for share in (0.03, 0.12, 0.3):
            texts.append(" ".join(w for w in words if rng.random() > share))
            texts.append(" ".join(x for w in words for x in ([w, "extra"] if rng.random() < share / 2 else [w])))
    return texts + ["copyright notice see mit license file", "this is not the mit license", "general public version 3 license gnu", None, "mit license " * 3000]


def test_license_labels_against_every_begin(spark):
    texts = license_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df.repartition(3)).collect()}
    cut = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    templates = [(label, re.findall(r"[a-z0-9]+", t.lower()), [k.split() for k in keys]) for label, t, keys in license_scan.TEMPLATES]
    known = {w for _, t, _ in templates for w in t} | {w for p, _ in license_scan.BASE_PHRASES for w in p.split()}
    df_of = Counter(w for words in cut for w in set(words) & known)
    idf = {w: 1 + math.log((len(texts) + 1) / (df_of[w] + 1)) for w in known}
    for i, words in enumerate(cut):
        if len(words) > 2000:
            assert got[i].labels == ""
            continue
        want, at = {}, defaultdict(list)
        for p, w in enumerate(words):
            at[w].append(p)
        for label, t, keys in templates:
            slack = max(3, len(t) // 20)
            anchors = sorted(range(len(t)), key=lambda q: (-idf[t[q]], q))[: license_scan.ANCHORS]
            for begin in {p - q for q in anchors for p in at[t[q]]}:
                near = lambda q, w: any(abs(p - begin - q) <= slack for p in at[w])
                if sum(idf[t[q]] for q in anchors if near(q, t[q])) < license_scan.AGREE * sum(idf[t[q]] for q in anchors) - 1e-9:
                    continue
                stand = True
                for key in keys:
                    q = next(k for k in range(len(t)) if t[k : k + len(key)] == key)
                    stand &= any(p >= 0 and words[p : p + len(key)] == key for p in range(begin + q - slack, begin + q + slack + 1))
                share = sum(idf[w] for q, w in enumerate(t) if near(q, w)) / sum(idf[w] for w in t)
                if stand and share >= license_scan.SHARE:
                    want[label] = max(want.get(label, 0), share)
        base = set(got[i].base_labels.split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == base | set(want), texts[i]
        assert abs(got[i].score - min(1, max([1.0] * bool(base) + list(want.values()), default=0))) < 1e-9
    labels = [got[i].labels for i in range(len(texts))]
    assert labels[-5:] == ["", "", "", "", ""] and set(",".join(labels).split(",")) >= {label for label, *_ in license_scan.TEMPLATES}


def all_paths(transducer, symbols):
    """Every (written symbols, weight) of the words (symbol, own weight)."""
    paths = [(transducer.start, (), 0.0)]
    for symbol, own in symbols:
        paths = [(to, (*out, write), total + a * own + b) for state, out, total in paths for s, read, write, (a, b), to in transducer.arcs if s == state and read == symbol]
    return [(out, total) for state, out, total in paths if state in transducer.finals]


def brute_best(symbols):
    """Rewrites the clause by the five transducers one after the other, along every path."""
    now = {tuple(s for s, _ in symbols): 0.0}
    for k, transducer in enumerate(grammar.parts()):
        after = {}
        for string, total in now.items():
            for out, weight in all_paths(transducer, [(s, own if k == 0 else 0.0) for s, (_, own) in zip(string, symbols)]):
                after[out] = max(after.get(out, -math.inf), total + weight)
        now = after
    return max(now.values())


def test_composed_machine_against_every_path():
    machine = grammar.composed()
    for n in range(4):
        for clause in itertools.product(grammar.WORDS, repeat=n):
            symbols = [(s, 1.7 if s == grammar.INSULT else 0.0) for s in clause]
            total, written = machine.best(symbols)
            assert abs(total - brute_best(symbols)) < 1e-12 and len(written) == n
    rng = random.Random(1)
    for _ in range(60):
        symbols = [(s, rng.choice([0.3, 2.5, 6.0]) if s == grammar.INSULT else 0.0) for s in rng.choices(grammar.WORDS, [3, 2, 1, 1, 1, 2], k=7)]
        assert abs(machine.best(symbols)[0] - brute_best(symbols)) < 1e-12


def test_toxicity_scores_against_every_path(spark):
    rng = random.Random(9)
    words = ["idiot", "moron", "moronic", "you", "kill", "not", "said", "the", "tree", "é", "they", "never"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", "### "]) for _ in range(rng.randrange(0, 22))) for _ in range(80)] + [None, "", "IDIOT! " * 40, "idiot " * 3]
    learned = toxicity.Grammar({"idiot": 4.0, "moro*": 3.0}, np.array([-3.0, 2.0, 1.0, 0.5, 0.2, 5.0, 2.0, 3.0, 2.0]))
    got = {r.doc_id: r for r in toxicity.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learned).collect()}

    def symbol(w):
        if w == "idiot" or w.startswith("moro"):
            return grammar.INSULT, 4.0 if w == "idiot" else 3.0
        return {"you": grammar.TARGET, "they": grammar.TARGET, "kill": grammar.THREAT, "not": grammar.NEGATION, "never": grammar.NEGATION, "said": grammar.REPORT}.get(w, grammar.OTHER), 0.0

    for i, text in enumerate(texts):
        clauses = [c for c in (re.findall(r"[^\W\d_]+", part) for part in re.split(r"[.!?;:,\n]+", (text or "").lower())) if c]
        found = {}
        for c in clauses:
            if len(c) > 12:
                break
            total = brute_best([symbol(w) for w in c])
            key = tuple(w for w, t in zip(c, learned.machine.best([symbol(w) for w in c])[1]) if t in grammar.MARKED)
            if total > 0:
                found[key] = max(found.get(key, 0), total)
        else:
            z = -3.0
            if found:
                total = sum(found.values())
                x = [max(found.values()), math.log1p(total), math.log1p(len(found)), math.log1p(total / math.sqrt(len(clauses)))]
                z += sum(w * v / s for w, v, s in zip(learned.model[1:5], x, learned.model[5:]))
            assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9 and got[i].n_matched == len(found)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_url_filter_rows_and_long_urls(spark):
    urls = ["http://a.net/x", "http://a.net/x", None, "http://casino.org/" + "p/" * 150_000 + "login", "http://" + "a." * 100_000 + "org/fr/1", "http://h/" + "x" * 9000 + ".exe", "http://x.com/a.zip"] + [f"http://h{k}.com/{'y' * k}" for k in range(40)]
    df = spark.createDataFrame([(str(k), u, "h", "p", "r", "v", "q") for k, u in enumerate(urls)], "page_id string, url string, host string, path string, rule string, verdict string, pattern string")
    got = {r.page_id: r for r in url_filter.filter_urls(df.repartition(2)).collect()}
    assert [got[str(k)].rule for k in (0, 1, 2, 4)] == ["net/", "net/", None, "org/fr/"]
    assert [got[str(k)].verdict for k in range(8)] == ["block", "block", "allow", "block", "allow", "block", "block", "allow"]
    assert got["3"].pattern in ("casino*.**", "**/login**") and got["5"].pattern == "**.exe"
    assert url_filter.filter_urls(df.where("false")).count() == 0
    machine = url_filter.Automaton.of([g for _, g in url_filter.EXTRA_GLOBS])
    raw = [(u or "").encode() for u in urls]
    together = machine.match(raw)
    assert all((machine.match([u])[0] == together[k]).all() for k, u in enumerate(raw))


def test_offsets_touch_their_characters(spark):
    texts = ["a 😀b", "plain words", None, "", "é😀 中"]
    for r in bpe.offsets_frame(clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect():
        text = texts[r.doc_id] or ""
        codec = bpe.codec(tokenizer_path(bpe.VOCABULARY))
        assert codec.decode(r.ids) == text and len(r.ids) == len(r.begin) == len(r.end)
        for i, b, e in zip(r.ids, r.begin, r.end):
            assert b < e <= len(text) and codec.decode_bytes([i]) in text[b:e].encode()


def test_rows_with_dots_in_names(spark):
    """The stages that keep rows look at no column by a name that Spark would read as a path."""
    df = spark.createDataFrame([(1, "one", "u"), (2, None, "v"), (3, "two", None)], "doc_id long, text string, `meta.url` string")
    out = common.keep_rows(df, "text", lambda: lambda texts: np.array([t is None or t == b"two" for t in texts]))
    assert out.schema == df.schema and sorted(map(tuple, out.collect())) == [(2, None, "v"), (3, "two", None)]
