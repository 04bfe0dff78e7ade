"""SimHash near-duplicates: 64-bit fingerprints linked at 3 or fewer differing bits, by pigeonring filtering.

The fingerprint has four segments of 16 bits, laid out as a ring. If two fingerprints differ in at most 3 bits, some
segment starts a chain whose sums of differences keep to their share at every length: 0 in the first segment, at most 1 in
the first two, 2 in three, 3 in four. So:

1. Equal fingerprints are one class; classes alone are compared.
2. Classes are dealt by (segment number, its 16 bits). Where more than ``SPLIT`` classes meet, they are dealt instead by
   the first two segments of the chain: one bit of the second is masked out, for each of the 16 bits, so that classes
   which differ in at most one bit there still meet. The count of classes by segment (2^18 numbers at most) tells which way to go.
3. Within a bucket, pairs are held against the chain sums, then the whole distance. A bucket hands on at most one
   link for each of its classes (to the least class of its piece), never all pairs.
4. Links are joined to components in rounds (operators.components).

Null text counts as empty: it has the fingerprint zero, like any text without words. Classes are known by their fingerprints, so ids
may be of any type and null: rows without an id have no component_id, but link others like any row. Very long texts are hashed whole, piece by piece.
Repeated rows fall into one class. An empty table gives an empty result; other columns are not read (keep_first hands them on).
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.components import connected_components
from ..operators.materialise import materialise
from .common import PIECE, as_bytes, fresh, map_arrow, pieces_of, slim

DISTANCE = 3
SHINGLE = 3
SEED = 42
SPLIT = 256
#: Above this many classes in one bucket, neighbours are enumerated and looked up; below, classes are compared with each other.
ENUMERATE = 200_000

#: Tables of at most so many rows are told by bits which of them are kept: 8 MB. Beyond, kept places are joined by shuffle.
BROADCAST_ROWS = 1 << 26

#: Members of the front whose neighbours are looked up at once.
FRONT = 64

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED, size: int = PIECE) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if set in over half of the shingles' hashes. Long texts are read in pieces of ``size`` bytes."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    set_bits, n, words = np.zeros(64, np.int64), 0, []
    for piece in pieces_of(text, _SPACE, size):
        words += piece.translate(_LOWER).split()
        if len(words) < shingle:
            continue
        h = np.array([digest(s, seed) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle))))], "<u8")
        n += len(h)
        for k in range(0, len(h), 65536):
            part = h[k : k + 65536]
            set_bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words = words[len(words) - shingle + 1 :]  # the next piece's first shingles begin in them
    if not n:
        return digest(b" ".join(words), seed) if words else 0
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def make():
        def step(batch):
            fp = np.array([fingerprint(t or b"") for t in as_bytes(batch.column(1))], _U)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

        return step

    return map_arrow(slim(df, id_col, text_col), make, f"doc_id {dict(df.dtypes)[id_col]}, fp long")


def placed_fingerprints(df: DataFrame, id_col: str, text_col: str, file_col: str, index_col: str) -> DataFrame:
    """id, f and r (the row's place) and fp (the fingerprint as a signed long); the texts go no further."""

    def make():
        def step(batch):
            fp = np.array([fingerprint(t or b"") for t in as_bytes(batch.column(3))], _U)
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fp.view(np.int64))], ["id", "f", "r", "fp"])

        return step

    rows = df.select(F.col(id_col).alias("id"), F.col(file_col).alias("f"), F.col(index_col).alias("r"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, make, StructType([*rows.schema.fields[:3], StructField("fp", LongType())]))


def _pieces(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's piece under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _viable(x: np.ndarray, segment: np.ndarray | int, distance: int) -> np.ndarray:
    """Do these differences keep to the chain that starts at the (equal) segment? Segment 0 is the lowest 16 bits."""
    total, low = np.zeros(x.shape, np.uint8), _U(0xFFFF)
    keep = np.ones(x.shape, bool)
    for length in range(4):
        shift = (_U(16) * ((np.asarray(segment, _U) + _U(length)) % _U(4))).astype(_U)
        total = total + np.bitwise_count((x >> shift) & low)
        keep &= total * 4 <= (length + 1) * distance
    return keep


def _large_bucket(fp: np.ndarray, segment: int, distance: int, above: int | None = None) -> np.ndarray:
    """Pieces of one bucket of distinct fingerprints in unsigned order: a search outwards, so that no list of pairs is made."""
    n = len(fp)
    label = np.full(n, -1)
    flips = None
    if n > (ENUMERATE if above is None else above):
        free = [_U(1) << _U(k) for k in range(64) if k // 16 != segment]
        flips = np.array([np.bitwise_or.reduce(c) for d in range(1, distance + 1) for c in combinations(free, d)], _U)
        flips = flips[_viable(flips, segment, distance)]
    rest = np.arange(n)
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first], front = first, np.array([first])
        while len(front):
            if flips is not None:
                found = []
                for k in range(0, len(front), FRONT):
                    near = np.unique(fp[front[k : k + FRONT], None] ^ flips)
                    at = np.minimum(np.searchsorted(fp, near), n - 1)
                    at = at[(fp[at] == near) & (label[at] < 0)]
                    label[at] = first
                    found.append(at)
                found = np.concatenate(found)
            else:
                rest = rest[label[rest] < 0]
                near = np.zeros(len(rest), bool)
                for f in front:
                    near |= _viable(fp[rest] ^ fp[f], segment, distance)
                found = rest[near]
            label[found] = first
            front = found
    return label


def _bucket_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int, above: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) for whole buckets, sorted by key; fp are signed longs."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    segment = (key >> np.int64(40)) & np.int64(3)
    fp = fp.view(_U)
    a, b = [], []
    small = np.repeat(sizes <= 64, sizes)
    widest = int(sizes[sizes <= 64].max(initial=1))
    for shift in range(1, widest):
        i = np.flatnonzero(small[:-shift] & (key[shift:] == key[:-shift]))
        if not len(i):
            break
        i = i[_viable(fp[i] ^ fp[i + shift], segment[i], distance)]
        a.append(i)
        b.append(i + shift)
    for g in np.flatnonzero(sizes > 64):
        s, e = starts[g], starts[g] + sizes[g]
        order = s + np.argsort(fp[s:e])
        label = _large_bucket(fp[order], int(segment[s]), distance, above)
        tied = np.flatnonzero(label != np.arange(e - s))
        a.append(order[label[tied]])
        b.append(order[tied])
    if not a:
        return rep[:0], rep[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    # positions taken into account are renumbered, and each piece keeps one link for each of its members
    used, inverse = np.unique(np.r_[a, b], return_inverse=True)
    # pieces must not run across buckets: positions differ by bucket, so they don't
    label = _pieces(len(used), inverse[: len(a)], inverse[len(a) :])
    tied = np.flatnonzero(label != np.arange(len(used)))
    return rep[used[label[tied]]], rep[used[tied]]


def links_of(classes: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """Links (src, dst) that join all classes (fp, rep) within the distance; rep is a long, fp are distinct.

    Four segments hold an equal one only for 3 differing bits or fewer, so greater distances are refused.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"distance {distance}: an equal segment is sure for 0 to {DISTANCE} differing bits only")
    segment = lambda i: F.shiftrightunsigned("fp", 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))
    parts = classes.select("fp", "rep", F.posexplode(F.array(*(segment(i) for i in range(4)))).alias("i", "s")).withColumn(
        "next", F.expr("shiftrightunsigned(fp, 16 * ((i + 1) % 4)) & 65535")
    )
    key = F.expr("(cast(i as bigint) << 40) | (s << 24)")
    crowded = parts.groupBy("i", "s").count().where(F.col("count") > split).select("i", "s", F.lit(True).alias("crowded"))
    dealt = parts.join(F.broadcast(crowded), ["i", "s"], "left")  # 2^18 rows at most, whatever the input
    # crowded: one key for each bit masked out of the next segment, else one key
    masks = F.expr("case when crowded then transform(sequence(0, 15), k -> ((1L << 42) | (cast(k as bigint) << 16) | (next & ~(1L << k)))) else array(0L) end")
    rows = dealt.select((F.expr("(cast(i as bigint) << 40)").bitwiseOR(F.shiftleft("s", 24))).alias("k0"), "fp", "rep", F.explode(masks).alias("m"))
    # 16 bits of next, 4 bits of k, 16 bits of s, 2 bits of i and the mark of the finer deal make one key
    rows = rows.select(F.expr("k0 | (m & ((1L << 42) | 65535L)) | ((m & (15L << 16)) << 4)").alias("key"), "fp", "rep")
    rows = rows.repartition("key").sortWithinPartitions("key", "fp")
    above = ENUMERATE

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            last = now[0][-1]
            if held and held[0][-1] == last and now[0][0] == last:  # a bucket over more than this batch
                held_parts.append(now)
                held[0] = now[0]
                continue
            if held:
                now = [np.concatenate(x) for x in zip(*held_parts, now)]
            cut = np.searchsorted(now[0], last, side="left")
            held, held_parts = [now[0][cut:]], [[x[cut:] for x in now]]
            if cut:
                src, dst = _bucket_links(*(x[:cut] for x in now), distance, above)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])
        if held:
            src, dst = _bucket_links(*(np.concatenate(x) for x in zip(*held_parts)), distance, above)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def _named(classes: DataFrame, distance: int) -> DataFrame:
    """classes: one row for each fingerprint fp, with its least row rep. The same with the least rep of all that links lead to."""
    classes = materialise(classes)
    tied = connected_components(links_of(classes.select("fp", F.col("fp").alias("rep")), distance))
    met = classes.join(tied, F.col("fp") == F.col("node"), "left").select("fp", "rep", "component")
    least = met.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    return met.join(least, "component", "left").select("fp", F.coalesce("least", "rep").alias("first"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id reachable)."""
    prints = materialise(fingerprints(df, id_col, text_col))
    out = prints.join(_named(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), distance), "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("component_id"))


def _bits_of(places: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each file f: a bit for each of its rows, in longs of 64, set for those kept. places: every row's f and r, kept: those of the kept rows."""
    word = F.expr("r div 64").alias("word")
    words = places.select("f", word, F.lit(0).cast("long").alias("bits")).unionByName(kept.select("f", word, F.expr("shiftleft(1L, cast(r % 64 as int))").alias("bits")))
    words = words.groupBy("f", "word").agg(F.expr("bit_or(bits)").alias("bits"))  # all words of a file are there, as all its rows are
    return words.groupBy("f").agg(F.expr("transform(array_sort(collect_list(struct(word, bits))), x -> x.bits)").alias("kept"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row of each component, all columns as they are: that of the least id (null ids last), of several rows of that id the first written.

    Rows are written once and known by their place in those files, so repeated and null ids do no harm. Which are kept is told by a bit for each row,
    so texts aren't shuffled; tables of more than ``broadcast_rows`` rows are joined with the kept places by shuffle.
    """
    held = materialise(df)
    file, index, bits, of = (fresh(held, name) for name in ("_file", "_index", "_bits", "_of"))
    place = held.metadataColumn("_metadata")
    held = held.select("*", place["file_name"].alias(file), place["row_index"].alias(index))
    prints = materialise(placed_fingerprints(held, id_col, text_col, file, index))
    at = F.struct(F.col("id").isNull().alias("none"), "id", "f", "r")
    first = _named(prints.select("fp", at.alias("at")).groupBy("fp").agg(F.min("at").alias("rep")), distance)
    first = first.select("first.f", "first.r")
    if prints.count() > broadcast_rows:
        return held.join(first.select(F.col("f").alias(file), F.col("r").alias(index)).distinct(), [file, index], "left_semi").drop(file, index)
    kept = materialise(_bits_of(prints, first)).toDF(of, bits)
    is_kept = F.expr(f"getbit(get({bits}, cast({index} div 64 as int)), cast({index} % 64 as int)) = 1")
    return held.join(F.broadcast(kept), (F.col(file) == F.col(of)) & is_kept, "left_semi").drop(file, index)
