"""License scan, quality rules, URL filter, byte-level BPE and packing against brute force on odd texts."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from latticeweave.llm import bpe, gbt, license_scan, packing, quality, url_filter
from latticeweave.llm.common import tokenizer_path
from latticeweave.llm.license_texts import MIT_TEXT

SCHEMA = "doc_id long, text string, label string, shard string, fp long"  # with columns whose names clash


def odd_texts(seed=0, n=60):
    rng = random.Random(seed)
    parts = ["the", "Über", "mit", "MIT", "under the mit license", "Apache License, Version 2.0", "cc by-nc", "###", "|", "\n", " ", "\t", "\xa0", "\x0b", "\x1c", "É\u0301", "中文", "😀", "x" * 70, "a.b", "Released", "\u2028", "'s"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(0, 90))) for _ in range(n)]
    return [None, "", " ", "\n\n", "word", "w " * 60, ("long text. " * 3000), "under the mit license " * 3] + texts + texts[:3]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("operator", [license_scan.scan_licenses, bpe.round_trip_digest, packing.pack])
def test_empty_table(spark, operator):
    assert operator(frame(spark, ["a"]).where("false")).count() == 0


def test_license_base_counts(spark):
    texts = odd_texts(1)
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, texts).repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places, labels = [], set()
        for phrase, label in license_scan.BASE_PHRASES:
            p = phrase.split()
            for k in range(len(words)):
                if words[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_own_labels(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "general public version 3 license gnu", "Copyright X. " + MIT_TEXT, MIT_TEXT[:70]]
    got = [r.labels for r in license_scan.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["gpl-3", "", "mit", ""]  # a few words of a whole text are too small a share of it


def test_quality_counts(spark):
    texts = odd_texts(2) + ["a b c a b c", "a a a a", "x\nx\n\n x\nx"]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8, 60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeat = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * rng.random(800) > 0.6) ^ (x[:, 1] > 0.9)).astype(float)
    forest = gbt.fit(x, y, [-1, 0, 1], trees=20)
    grid = np.repeat(rng.random((50, 3)), 21, axis=0).reshape(50, 21, 3)
    for j, sign in ((0, -1), (2, 1)):
        g = grid.copy()
        g[:, :, j] = np.linspace(0, 1, 21)
        p = forest.probability(g.reshape(-1, 3)).reshape(50, 21)
        assert (sign * np.diff(p, axis=1) >= -1e-12).all()
    free = gbt.fit(x, y, [0, 0, 0], trees=40)
    assert ((free.probability(x) > 0.5) == y).mean() > 0.9
    assert gbt.fit(x[:0], y[:0], [0, 0, 0]).probability(x[:2]).tolist() == [0.5, 0.5]


def test_quality_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge(docs, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").selectExpr("kept = (quality = 1) as right").collect()
    assert sum(r.right for r in rows) / len(rows) > 0.95


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://X.NeT/EN?q", "https://www.example.net/en/1#x", "https://example.com/de/1", "https://notexample.com/de/1", "https://m.example.com/fr", "http://w.example.org/fr/1",
            "http://m.casino-win.example.com/en/1", "http://free-bets.example.com", "http://h/a.net/x", "http://h/x.exe", "http://h/x.exe?y", "a://b://c.net/", "http://net/?", "http://h:80/login/", "http://" + "é" * 3000 + ".net/" + "p" * 5000]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(2)).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=(0, None, None))
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule[2]), url
        own = [g for _, g in url_filter.EXTRA_GLOBS if re.fullmatch("".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", g)), host + path, re.S)]
        assert r.verdict == (rule[1] or ("block" if own else "allow")), url


def test_byte_bpe_matches_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    path = tokenizer_path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts(3) + ["<|endoftext|> x", "aaaaaaaaab" * 30, "a\x1c!\x1c b\u3000 c   d\r\n\r\n  e"]
    got = {r.doc_id: r for r in bpe.round_trip_digest(frame(spark, texts)).collect()}
    back = {r.doc_id: r.text for r in bpe.decode_frame(bpe.encode_frame(frame(spark, texts))).collect()}
    for i, text in enumerate(texts):
        ids = own.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert back[i] == (text or "")
    c = bpe.ByteCodec(path)
    ids, offsets = c.encode_with_offsets("a 😀b")
    assert own.encode_ordinary("a 😀b") == ids and offsets[-1] == (3, 4)
    assert "\ufffd" in c.decode(own.encode_ordinary("😀")[:1])


def test_whole_table_encodes_as_the_libraries_do(spark):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path(bpe.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.round_trip_digest(docs).collect():
        ids = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    path = tokenizer_path(packing.VOCABULARY)
    whole = Tokenizer.from_file(path)
    names = sorted(texts)
    assert packing.WordEncoder(path).encode([texts[i] for i in names]) == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch([texts[i] for i in names], add_special_tokens=False)]


def test_packing_pieces(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    texts = odd_texts(4) + ["x <|endoftext|> y"] + ["word " * n for n in (4094, 4095, 4096, 8191, 9000)]
    rows = packing.pack(frame(spark, texts).repartition(2), with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and own[0].start == 0
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        size = sum(r.length for r in own)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and size <= 4096
        padding += 0 if size & (size - 1) == 0 else 4096 - size
        total += size
    assert padding < 0.01 * total


def test_best_fit_decreasing_is_best_fit():
    rng = random.Random(5)
    for _ in range(20):
        lengths = [rng.randrange(1, 65) for _ in range(rng.randrange(0, 80))]
        rooms, windows = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = [r for r in rooms if r >= lengths[i]]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - lengths[i])
            else:
                rooms.append(64 - lengths[i])
        windows = packing.best_fit_decreasing(lengths, 64)
        assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
        assert sorted(64 - sum(lengths[i] for i in w) for w in windows) == sorted(rooms)


def test_word_encoder_on_every_character():
    from tokenizers import Tokenizer

    path = tokenizer_path(packing.VOCABULARY)
    whole = Tokenizer.from_file(path)
    texts = [f"a{chr(c)}b {chr(c)}1!{chr(c)}\n{chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    got = packing.WordEncoder(path).encode(texts)
    assert [x.tobytes() for x in (np.array(e.ids, "<u4") for e in whole.encode_batch(texts, add_special_tokens=False))] == got
