"""Language-model scores from a log-frequency Bloom filter.

Counting: tokens, then all pairs of neighbouring tokens, are counted over all training documents; no count is too small to be kept.

Frequent tokens are the ``ENTRIES`` most frequent at most (all that reach one count); their places and exact counts are broadcast.
Whether a token is among them only tells where it is looked up, never what the model gives.

The filter holds the pairs of two frequent tokens: a pair of count c is entered once for each level 1..q, where level q means
c >= base^(q-1). A probe asks for level 1, 2, ... until one is missing; the last level found gives the (lower) quantised count. The
filter grows with the distinct pairs. It is never gathered: it is split by key into parts, as many as the training tokens ask for, and
blocks of the documents' pairs are dealt to the parts by shuffle. Pairs with a rarer token are joined by shuffle with their counts, quantised alike.

The model: P(w | u) = (q(u, w) + (c(u) - K(u) + MU) * P(w)) / (c(u) + MU), with the quantised count q(u, w) and its sum K(u) over
all w, so it is a distribution over w; P(w) comes from exact counts. A document begins in the context of the end token.

Null text counts as empty (the end token alone). Null ids count as empty text for the split; ids may be of any type. Repeated rows are
counted and scored each on its own; very long texts are counted and scored whole. Without training documents all counts are zero; an empty
table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.materialise import discard, materialise
from .common import as_bytes, short_batches, slim, split_remainder

ENTRIES = 1 << 20  # no more: places of frequent tokens have 20 bits
BASE = math.sqrt(2)
BITS_PER_ITEM = 14
PROBES = 7
MU = 20.0
#: Least number of parts. Numbers of parts are odd: were they powers of two, a pair's second token alone would tell its part.
SEGMENTS = 61
#: Training tokens for each part of the filter, once there are more parts than ``SEGMENTS``.
PART_TOKENS = 1 << 21
#: Bits that any part has: in very small parts false positives would be common.
LEAST_BITS = 4096
#: Places of tokens in one slot, when sums over the parts are put together.
SLOT = 1 << 15
#: Documents in one block: their numbers have 16 bits.
BLOCK_DOCS = 1 << 16
#: Tokens that a task gathers before it counts them.
BLOCK_TOKENS = 3_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of the places of two frequent tokens, each below 2^20, so that pairs can't collide."""
    return (u.astype(_U) << _U(20)) | w.astype(_U)


def rare_pair_keys(u: np.ndarray, w: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of the hashes of two tokens that aren't both frequent: negative as longs, and -2^62 or more where the first is frequent."""
    return (mix(mix(u) + w) >> _U(2)) | (_U(1) << _U(63)) | (known.astype(_U) << _U(62))


class Words:
    """The tokens of some texts: ``numbers`` of all in a row, the empty word as the end of each text, and where each text ``begins``.
    For each number the word's hash and its place and count among the frequent tokens (count 0: not among them)."""

    def __init__(self, texts: pa.Array, keys: np.ndarray, counts: np.ndarray):
        import xxhash

        # a blank behind a text makes its last word the empty one; a text without words is that word alone
        lower = ((t or b"").translate(_LOWER).lstrip() for t in as_bytes(texts))
        ended = pa.array([t + b"\n" if t else t for t in lower], pa.large_binary()).view(pa.large_string())
        cut = pc.ascii_split_whitespace(ended)
        self.begins = np.zeros(len(cut) + 1, np.int64)
        np.cumsum(cut.value_lengths().to_numpy(), out=self.begins[1:])
        coded = cut.flatten().cast(pa.large_binary()).dictionary_encode()
        self.numbers = coded.indices.to_numpy().astype(np.int64)
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), _U, len(coded.dictionary))
        self.place, self.count = np.zeros(len(self.hash), np.int64), np.zeros(len(self.hash), np.int64)
        if len(keys):
            order = np.argsort(self.hash)  # sorted, they are found faster
            at = np.minimum(np.searchsorted(keys, self.hash[order]), len(keys) - 1)
            self.place[order] = at
            self.count[order] = np.where(keys[at] == self.hash[order], counts[at], 0)

    def contexts(self) -> np.ndarray:
        """The number of the token before each; before the first word of a text stands the end token."""
        before = np.empty_like(self.numbers)
        before[1:] = self.numbers[:-1]
        before[0] = self.numbers[-1]
        return before  # what stands before another text's first word is the end of the text before it


def _count(texts: DataFrame) -> DataFrame:
    """(key, n): counts of tokens."""

    def run(batches):
        held, size = [], 0

        def counted():
            key, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(key)
            key, n = key[order], n[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(np.add.reduceat(n, first))], ["key", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words = Words(batch.column(0), np.zeros(0, _U), np.zeros(0, np.int64))
            held.append((words.hash, np.bincount(words.numbers, minlength=len(words.hash))))
            size += len(words.hash)
            if size >= BLOCK_TOKENS:
                yield counted()
                size = 0
        if held:
            yield counted()

    short_batches(texts.sparkSession)
    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


_PAIRS = "part long, key long, u long, n long, data array<binary>"


def _count_pairs(texts: DataFrame, frequent, parts: int) -> DataFrame:
    """Counts by block of texts. Pairs of frequent tokens are packed, one row for each part (n: how many keys).
    Pairs with a rare token have rows of their own, without a part; u is the first token's place or (if rare) hash."""
    schema = to_arrow_schema(StructType.fromDDL(_PAIRS))

    def run(batches):
        held, rare, size = [], [], 0

        def counted():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            key, ends, n = _by_part(key, parts, n)
            for p in np.flatnonzero(np.diff(ends)).tolist():
                k, c = key[ends[p] : ends[p + 1]], n[ends[p] : ends[p + 1]]
                yield pa.RecordBatch.from_pylist([{"part": p, "n": len(k), "data": [_pack_keys(k, parts), _pack(c.astype("<u4"))]}], schema=schema)
            keys, us = (np.concatenate(x) for x in zip(*rare))
            key, at, n = np.unique(keys, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(key.view(np.int64)), pa.array(us[at]), pa.array(n), pa.nulls(len(key), schema.field("data").type)], schema=schema)
            held.clear()
            rare.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = Words(batch.column(0), *frequent.value)
            numbers, before = table.numbers, table.contexts()
            known = table.count[before] > 0
            both = known & (table.count[numbers] > 0)
            held.append(pair_keys(table.place[before[both]], table.place[numbers[both]]))
            one = np.flatnonzero(~both)
            u, known = before[one], known[one]
            rare.append((rare_pair_keys(table.hash[u], table.hash[numbers[one]], known), np.where(known, table.place[u], table.hash[u].view(np.int64))))
            size += len(numbers)
            if size >= BLOCK_TOKENS:
                yield from counted()
                size = 0
        if held:
            yield from counted()

    short_batches(texts.sparkSession)
    return texts.mapInArrow(run, _PAIRS)


def levels_of(n: np.ndarray, least: int) -> np.ndarray:
    return 1 + np.floor(np.log(n / least) / np.log(BASE) + 1e-9).astype(np.int64)


def _quantised():
    return F.pow(F.lit(BASE), _level(1) - 1)


def _level(least: int):
    return F.floor(F.log(F.col("n") / F.lit(least)) / F.lit(math.log(BASE)) + 1e-9) + 1


class LogFrequencyFilter:
    """Bits in parts; an item (key, level) has PROBES places, all in its key's part."""

    def __init__(self, bits: np.ndarray, least: int):
        self.bits, self.least = bits, least  # bits: (parts, bytes), or one part alone

    @staticmethod
    def places(key: np.ndarray, level: int | np.ndarray, probe: int, width: int) -> np.ndarray:
        a = mix(key + _U(0x9E3779B97F4A7C15) * np.asarray(level, _U))
        b = (a >> _U(32)) | _U(1)
        return ((a & _U(0xFFFFFFFF)) + _U(probe) * b) % _U(width)

    def _has(self, key: np.ndarray, level: int) -> np.ndarray:
        parts, width = _U(len(self.bits)), self.bits.shape[1] * 8
        alive = np.arange(len(key))
        for probe in range(PROBES):
            k = key[alive]
            at = self.places(k, level, probe, width)
            alive = alive[(self.bits[(k % parts).astype(np.int64), (at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1]
        return alive

    def counts(self, key: np.ndarray) -> np.ndarray:
        """Quantised counts: 0 for what isn't kept."""
        out, alive, level = np.zeros(len(key)), np.arange(len(key)), 1
        while len(alive) and self.bits.shape[1] and level < 400:
            alive = alive[self._has(key[alive], level)]
            out[alive] = self.least * BASE ** (level - 1)
            level += 1
        return out


def part_bits(key: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """The bits of a part of the filter that holds these keys at all levels that their counts reach."""
    top = levels_of(n, least)
    width = max(LEAST_BITS, 8 * math.ceil(int(top.sum()) * BITS_PER_ITEM / 8))
    bits = np.zeros(width // 8, np.uint8)
    for s in range(0, len(key), 1 << 18):
        t = top[s : s + (1 << 18)]
        k = np.repeat(key[s : s + (1 << 18)], t)
        level = np.arange(1, len(k) + 1) - np.repeat(np.cumsum(t) - t, t)
        for probe in range(PROBES):
            at = LogFrequencyFilter.places(k, level, probe, width)
            for bit in range(8):
                bits[(at[(at & _U(7)) == bit] >> _U(3)).astype(np.int64)] |= 1 << bit
    return bits


def build_filter(pairs: DataFrame, least: int) -> LogFrequencyFilter:
    """From (key, n), every n >= least: a filter of one part, on the driver."""
    found = pairs.where(F.col("n") >= least).toPandas()
    return LogFrequencyFilter(part_bits(found["key"].to_numpy(np.int64).view(_U), found["n"].to_numpy(np.int64), least)[None], least)


def _merge(parts: int):
    """From packed counts sorted by part: each part's bits (slot -1), and the quantised counts' sums by first token (packed, by slot of places)."""
    schema = pa.schema([("part", pa.int64()), ("slot", pa.int64()), ("data", pa.list_(pa.binary()))])

    def merged(now, held):
        key, n = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, n = key[first], np.add.reduceat(n, first, dtype=np.int64)
        yield pa.RecordBatch.from_pylist([{"part": now, "slot": -1, "data": [part_bits(key, n, 1).tobytes()]}], schema=schema)
        u = (key >> _U(20)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        u, q = u[first], np.add.reduceat(BASE ** (levels_of(n, 1) - 1), first)
        for s in np.unique(u // SLOT).tolist():
            a, b = np.searchsorted(u, [s * SLOT, (s + 1) * SLOT])
            yield pa.RecordBatch.from_pylist([{"part": now, "slot": s, "data": [u[a:b].astype("<i4").tobytes(), q[a:b].astype("<f8").tobytes()]}], schema=schema)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now and held:
                    yield from merged(now, held)
                now = r["part"]
                held.append((_unpack_keys(r["data"][0], r["n"], parts, now), _unpack(r["data"][1], r["n"], "<u4")))
        if held:
            yield from merged(now, held)

    return run


_MERGED = "part long, slot long, data array<binary>"


def _slot_sums(batches):
    """Sums of a slot over all parts; rows are sorted by slot."""
    now, sums = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["slot", "sums"])

    for batch in batches:
        for r in batch.to_pylist():
            if r["slot"] != now:
                if now is not None:
                    yield row()
                now, sums = r["slot"], np.zeros(SLOT)
            u, q = np.frombuffer(r["data"][0], "<i4"), np.frombuffer(r["data"][1], "<f8")
            sums[u - now * SLOT] += q  # each token once in a row
    if now is not None:
        yield row()


def _packed_rows(batches):
    """Keys and counts of a task as bytes, some thousands a row."""
    held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    for s in range(0, len(held), 100):
        key, n = (np.concatenate(x) for x in zip(*held[s : s + 100]))
        yield pa.RecordBatch.from_arrays([pa.array([key.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["key", "n"])


def _by_part(key: np.ndarray, parts: int, other: np.ndarray):
    """Sorted keys dealt to parts, still sorted within each, where each part begins, and what goes with the keys."""
    part = (key % _U(parts)).astype(np.int16 if parts < 1 << 15 else np.int64)
    order = np.argsort(part, kind="stable")
    return key[order], np.searchsorted(part[order], np.arange(parts + 1)), other[order]


def _pack(x: np.ndarray) -> bytes:
    """Numbers as bytes, the first bytes of all first, so that small ones take little room."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def _pack_keys(key: np.ndarray, parts: int) -> bytes:
    """Sorted keys of one part: all leave the same remainder, so differences of the quotients tell them."""
    return _pack(np.diff(key // _U(parts), prepend=_U(0)))


def _unpack_keys(data: bytes, n: int, parts: int, part: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n, "<u8"), dtype=_U) * _U(parts) + _U(part)


def _blocks(held: list, block: int, docs: int, parts: int):
    """Rows of one block, one for each part: its distinct keys (differences of the sorted), how often each comes, and the documents it comes in."""
    key, doc = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(key)
    key, ends, doc = _by_part(key[order], parts, doc[order])
    for p in np.flatnonzero(np.diff(ends)).tolist():
        k, d = key[ends[p] : ends[p + 1]], doc[ends[p] : ends[p + 1]]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        times = np.diff(np.r_[first, len(k)]).astype("<u4")
        yield {"part": p, "kind": 1, "block": block, "size": docs, "n": [len(first), len(k)], "data": [_pack_keys(k[first], parts), _pack(times), _pack(d)]}


def _least_frequent(tokens: DataFrame, total: int, entries: int) -> int:
    """The least count that makes a token frequent: as small as it can be with ``entries`` tokens at most."""
    enough = max(1, math.ceil(total / entries))  # total / enough <= entries tokens at most have this count
    left, out = entries, enough
    for n, kinds in sorted(map(tuple, tokens.groupBy(F.least("n", F.lit(enough)).alias("n")).count().collect()), reverse=True):
        left -= kinds
        if left < 0:
            break
        out = n
    return out


_TAIL = "key long, u long, w long, u_count long, u_kept double, w_count long"


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 1, entries: int = ENTRIES, mu: float = MU) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    docs = slim(df, id_col, text_col).withColumn("held", split_remainder(F.col("doc_id"), modulus) == held_out)
    train = docs.where("not held").select("text")
    tokens = materialise(_count(train))
    total, kinds = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = _least_frequent(tokens, total, entries)
    short_batches(spark)
    known = [(np.frombuffer(r.key, _U), np.frombuffer(r.n, np.int64)) for r in tokens.where(F.col("n") >= common).select("key", "n").mapInArrow(_packed_rows, "key binary, n binary").toLocalIterator()]
    keys, counts = (np.concatenate(x) for x in zip(*known)) if known else (np.zeros(0, _U), np.zeros(0, np.int64))
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], counts[order]))
    parts = max(SEGMENTS, math.ceil(total / PART_TOKENS)) | 1
    packed = materialise(_count_pairs(train, frequent, parts))
    pairs = materialise(packed.where("part is null").groupBy("key").agg(F.max("u").alias("u"), F.sum("n").alias("n")))  # those with a rare token
    merged = materialise(packed.where("part is not null").select("part", "n", "data").repartition("part").sortWithinPartitions("part").mapInArrow(_merge(parts), _MERGED))
    filters = merged.where("slot < 0")
    mass = np.zeros(len(keys) + SLOT)  # K(u)
    for r in merged.where("slot >= 0").repartition("slot").sortWithinPartitions("slot", "part").mapInArrow(_slot_sums, "slot long, sums binary").toLocalIterator():
        x = mass[r.slot * SLOT : (r.slot + 1) * SLOT]
        x += np.frombuffer(r.sums, float)[: len(x)]
    of_known = pairs.where(F.col("key") >= -(1 << 62)).groupBy("u").agg(F.sum(_quantised()).alias("k"))
    for r in of_known.mapInArrow(_packed_rows, "key binary, n binary").toLocalIterator():
        mass[np.frombuffer(r.key, np.int64)] += np.frombuffer(r.n, float)
    kept = spark.sparkContext.broadcast(mass[: len(keys)])
    discard(packed)
    whole = total + 0.5 * (kinds + 1)

    def cut(batches):
        """Documents, each with its pairs of rare tokens, and blocks of the other pairs."""
        task, block, held, size, row = TaskContext.get().partitionId() << 33, 0, [], 0, 0

        def rows(found):
            return pa.RecordBatch.from_pylist(found, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= BLOCK_TOKENS or row + batch.num_rows > BLOCK_DOCS:
                for found in _blocks(held, task + block, row, parts) if size else ():
                    yield rows([found])
                block, held, size, row = block + 1, [], 0, 0
            table = Words(batch.column(1), *frequent.value)
            numbers, begins, before = table.numbers, table.begins, table.contexts()
            c, context = table.count[numbers], table.count[before]
            head = c > 0
            both = head & (context > 0)
            doc = np.repeat(np.arange(row, row + batch.num_rows, dtype="<u2"), np.diff(begins))
            held.append((pair_keys(table.place[before[both]], table.place[numbers[both]]), doc[both]))
            size += int(both.sum())
            base = np.where(head, np.log10((c + 0.5) / whole), 0.0)
            sums = [np.add.reduceat(x, begins[:-1]) for x in (head.astype(np.int64), base)]
            rare = np.flatnonzero(~both)
            u, w = before[rare], numbers[rare]
            there = context[rare] > 0
            k = np.where(there, kept.value[table.place[u]], 0.0) if len(kept.value) else np.zeros(len(rare))
            key = rare_pair_keys(table.hash[u], table.hash[w], there)
            hash_u, hash_w = (np.where(known, 0, table.hash[x].view(np.int64)) for x, known in ((u, there), (w, c[rare] > 0)))  # known ones aren't looked up
            tail = [key.view(np.int64), hash_u, hash_w, context[rare], k, c[rare]]
            ends = pa.array(np.searchsorted(rare, begins).astype(np.int32))
            tail = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x) for x in tail], names=names))
            n = batch.num_rows
            own = {
                "part": pa.array(np.arange(row, row + n) % parts), "kind": pa.array(np.full(n, 2, np.int32)), "block": pa.array(np.full(n, task + block)), "size": pa.array(np.arange(row, row + n)),
                "doc_id": batch.column(0), "held_out": batch.column(2), "n_tokens": pa.array(np.diff(begins)), "n_known": pa.array(sums[0]), "base_score": pa.array(sums[1]), "tail": tail,
            }
            yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)
            row += n
        if size:
            for found in _blocks(held, task + block, row, parts):
                yield rows([found])

    def probe(batches):
        """Each block's pairs against their part of the filter, whose bits come first: the block's documents' sums. Documents pass."""
        now, bits = None, None
        n, k = frequent.value[1], kept.value
        for batch in batches:
            rest = batch.filter(pa.array(batch.column("kind").to_numpy() == 2))
            if rest.num_rows:
                yield rest
            if rest.num_rows == batch.num_rows:
                continue
            for r in batch.filter(pa.array(batch.column("kind").to_numpy() < 2)).to_pylist():
                if r["part"] != now:
                    now, bits = r["part"], np.zeros(0, np.uint8)
                if r["kind"] == 0:
                    bits = np.frombuffer(r["data"][0], np.uint8)
                    continue
                key = _unpack_keys(r["data"][0], r["n"][0], parts, now)
                times, doc = _unpack(r["data"][1], r["n"][0], "<u4"), _unpack(r["data"][2], r["n"][1], "<u2")
                u, w = (key >> _U(20)).astype(np.int64), (key & _U((1 << 20) - 1)).astype(np.int64)
                joint = np.minimum(LogFrequencyFilter(bits[None], 1).counts(key), np.minimum(n[u], n[w]))
                model = np.log10((joint + (np.maximum(n[u] - k[u], 0) + mu) * ((n[w] + 0.5) / whole)) / (n[u] + mu))
                sums = np.bincount(doc, np.repeat(model, times), minlength=r["size"])
                yield pa.RecordBatch.from_pylist([{"part": now, "kind": 1, "block": r["block"], "size": r["size"], "data": [sums.astype("<f8").tobytes()]}], schema=schema)

    def gather(batches):
        """Sums of all parts, which come first, given to the block's documents."""
        now, sums, row = None, None, TaskContext.get().partitionId() << 33
        for batch in batches:
            kind, block, size = (batch.column(c).to_numpy() for c in ("kind", "block", "size"))
            starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])]) if len(block) else []
            for s, e in zip(starts, [*starts[1:], len(block)]):
                if block[s] != now:
                    now, sums = block[s], np.zeros(BLOCK_DOCS)
                if kind[s] == 1:
                    for data in batch.column("data").slice(s, e - s).to_pylist():
                        x = np.frombuffer(data[0], "<f8")
                        sums[: len(x)] += x
                    continue
                own = batch.slice(s, e - s)
                score = sums[size[s:e]]
                ids = np.arange(row, row + e - s)
                row += e - s
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(own.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(score), own.column("tail")], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"])

    kind = dict(df.dtypes)[id_col]
    names = [f.split()[0] for f in _TAIL.split(", ")]
    tail_type = "array<struct<" + ", ".join(f.replace(" ", ": ") for f in _TAIL.split(", ")) + ">>"
    wire = f"part long, kind int, block long, size long, n array<long>, data array<binary>, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, tail {tail_type}"
    schema = to_arrow_schema(StructType.fromDDL(wire))
    stream = docs.select("doc_id", "text", "held").mapInArrow(cut, wire)
    bits = filters.select("part", F.lit(0).alias("kind"), "data")
    probed = stream.unionByName(bits, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "kind").mapInArrow(probe, wire)
    scored = materialise(
        probed.repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(gather, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail {tail_type}")
    )
    discard(merged)
    # pairs with a rare token: each rare token's count is joined, then the pair's own; known tokens (count above 0) are looked up nowhere
    rare_kept = pairs.where(F.col("key") < -(1 << 62)).groupBy("u").agg(F.sum(_quantised()).alias("k"))
    rare = tokens.where(F.col("n") < common).join(rare_kept, F.col("key") == F.col("u"), "left").select(F.col("key").alias("h"), "n", F.coalesce("k", F.lit(0.0)).alias("k"))
    of_w, of_u = rare.select(F.col("h").alias("w"), F.col("n").alias("n_w")), rare.select(F.col("h").alias("u"), F.col("n").alias("n_u"), "k")
    tail = scored.select("row", F.inline("tail"))
    tail = tail.where("w_count > 0").unionByName(tail.where("w_count = 0").join(of_w, "w", "left"), allowMissingColumns=True)
    tail = tail.where("u_count > 0").unionByName(tail.where("u_count = 0").join(of_u, "u", "left"), allowMissingColumns=True)
    tail = tail.join(pairs.select("key", _quantised().alias("q")), "key", "left")
    zero = F.lit(0)
    tail = tail.select(
        "row",
        (F.col("w_count") == 0).alias("own"),
        F.when(F.col("w_count") > 0, F.col("w_count")).otherwise(F.coalesce("n_w", zero)).alias("w"),
        F.when(F.col("u_count") > 0, F.col("u_count")).otherwise(F.coalesce("n_u", zero)).alias("u"),
        F.when(F.col("u_count") > 0, F.col("u_kept")).otherwise(F.coalesce("k", F.lit(0.0))).alias("k"),
        F.coalesce("q", F.lit(0.0)).alias("q"),
    ).withColumn("p", (F.col("w") + 0.5) / F.lit(float(whole)))
    found = tail.select(
        "row",
        F.when(F.col("own") & (F.col("w") > 0), 1).otherwise(0).cast("long").alias("n_known"),
        F.when(F.col("own"), F.log10("p")).otherwise(0.0).alias("base_score"),
        F.log10((F.col("q") + (F.greatest(F.col("u") - F.col("k"), F.lit(0.0)) + mu) * F.col("p")) / (F.col("u") + mu)).alias("score"),
    )
    lines = scored.drop("tail").unionByName(found, allowMissingColumns=True)
    out = lines.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")), *(F.sum(c).alias(c) for c in ("n_known", "base_score", "score")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
