"""Sharding against its SQL and limits; SimHash against all pairs."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from latticeweave.llm import sharding, simhash

SCHEMA = "doc_id long, text string, h long, cell long, depth int, fp long, rep long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1, 1, 1) for i, t in rows], SCHEMA)


def test_sharding_limits(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(0, 400)) for i in range(500)] + [(7, "y" * 90)] * 120 + [(8, "z" * 5000), (None, None), (None, "q" * 50), (9, "")]
    out = sharding.assign_shards(frame(spark, rows), limit=1000).collect()
    assert len(out) == len(rows)
    size, names = defaultdict(int), set()
    for r in out:
        size[r.shard] += r.n_bytes
    for r in out:
        assert size[r.shard] <= 1000 or r.oversized
    plain = sorted({r.shard for r in out if "/" not in r.shard})
    assert all(not b.startswith(a) for a, b in zip(plain, plain[1:]))  # a prefix code
    for name in plain:  # only oversized buckets split: the parent of each shard is too large
        if name:
            assert sum(n for s, n in size.items() if s.startswith(name[:-1])) > 1000


def test_sharding_empty(spark):
    assert sharding.assign_shards(frame(spark, [(1, "a")]).where("false")).count() == 0
    assert [tuple(r) for r in sharding.assign_shards(frame(spark, [(1, "ab")])).collect()] == [(1, 2, "", 0, False)]


def test_sharding_sql(spark, sf):
    sf = sf.replace("0.001", "0.01")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(db.execute(f"select doc_id, n_bytes, shard, depth, oversized from ({sharding.ORACLE_SQL})").fetchall())
    got = sorted(tuple(r) for r in sharding.assign_shards(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "n_bytes", "shard", "depth", "oversized").collect())
    assert got == want and len({r[2] for r in got}) > 1


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, distance=3):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: root(i) for i in ids}


def test_simhash_texts(spark):
    rng = random.Random(2)
    words = ["w%d" % k for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    texts = base + [b.replace("w1", "W1", 1) for b in base[:10]] + [" ".join(b.split()[:-1]) for b in base] + [None, "", " ", "a", "a b", "é ß\x1cx y", base[0], base[0], "x y " * 9000]
    df = frame(spark, list(enumerate(texts)) + [(None, "a b")])
    got = {r.doc_id: r for r in simhash.near_duplicates(df.repartition(3)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = components(list(fps), fps)
    assert {i: got[i].fingerprint for i in fps} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: got[i].component_id for i in fps} == want
    assert got[None].component_id is None
    kept = {r.doc_id for r in simhash.keep_first(df).collect()}
    assert kept == set(want.values())  # the row without an id is a copy of another


def test_simhash_empty(spark):
    assert simhash.near_duplicates(frame(spark, [(1, "a")]).where("false")).count() == 0


def check_links(spark, fps, split):
    ids = {f: i for i, f in enumerate(fps)}
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in ids.items()], "fp long, rep long")
    links = simhash.links_of(classes, split=split).collect()
    by = {i: f for f, i in ids.items()}
    want = components(list(by), by)
    parent = dict(zip(by, by))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = sorted((root(r.src), root(r.dst)))
        parent[b] = a
    assert {i: root(i) for i in by} == want


def clustered(seed, centres, members, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(members):
            f = c
            for b in rng.sample(range(64), rng.randrange(flips + 1)):
                f ^= 1 << b
            out.append(f)
    return list(dict.fromkeys(out))


def test_links_both_deals(spark):
    fps = clustered(3, 40, 12, 5)
    check_links(spark, fps, split=10**9)
    check_links(spark, fps, split=2)  # every shared segment goes the finer way
    check_links(spark, clustered(4, 2, 400, 6), split=50)  # large buckets


def test_links_by_enumeration(spark, monkeypatch):
    fp = np.array(sorted(clustered(6, 3, 150, 4)), np.uint64)
    monkeypatch.setattr(simhash, "ENUMERATE", 10)
    # only pairs whose chain starts at an equal segment 1 are found by enumeration; both agree on such buckets
    same = np.array(sorted({int(f) & ~(0xFFFF << 16) for f in fp.tolist()}), np.uint64)
    a = simhash._large_bucket(same, 1, 3)
    monkeypatch.setattr(simhash, "ENUMERATE", 10**9)
    assert np.array_equal(a, simhash._large_bucket(same, 1, 3))


def test_links_by_enumeration_of_both_signs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ENUMERATE", 64)
    rng = random.Random(7)
    # one bucket of both signs; pairs differ once in each of the other segments, so that only this bucket joins them
    fps = [rng.getrandbits(48) << 16 | 5 for _ in range(150)]
    fps += [f ^ (1 << 20) ^ (1 << 40) ^ (1 << rng.choice([50, 63])) for f in fps]
    check_links(spark, fps, split=10**9)


@pytest.mark.parametrize("broadcast_rows", [simhash.BROADCAST_ROWS, 10])
def test_keep_first_by_bits(spark, broadcast_rows):
    """Files of several words of bits, null and repeated ids, columns with dots and of the names used within: the same rows by bits and by shuffle, and no text is shuffled for bits."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices("abcdefghijklmnop", k=40)) for _ in range(300)]
    rows = [(rnd.choice([None, *range(200)]), rnd.choice(texts), k, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long, f long").repartition(3)
    kept = simhash.keep_first(df, broadcast_rows=broadcast_rows)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text, r["a.b"], r.f) for r in kept.collect()]
    assert len(set(got)) == len(got) and set(got) <= set(rows)
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(prints) for b in prints[:k])  # so each text is a component
    want = {}
    for i, t, _, _ in rows:
        want[t] = min(want.get(t, (True, 0)), (i is None, i or 0))
    assert {t: (i is None, i or 0) for i, t, _, _ in got} == want and len(got) == len(want)
    if broadcast_rows > 1000:
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
