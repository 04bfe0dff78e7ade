"""Quality rules: counts of each document, hard limits on them, and gradient-boosted trees for the rest.

The trees are trained on ``labels.quality`` from a bounded sample (``sample_rows`` documents with the smallest hash of
their id, a documented parameter); counts and verdicts cover every whole text. Scores never rise with the
shares of symbols, repeated lines or repeated words (monotonic constraints).

Null text has no words; documents under ``min_words`` words fail. Null labels are not used; without labels of both
classes the trees say "keep". Repeated rows are judged each on its own; very long texts are counted whole; an empty table gives an
empty result; ids may be of any type; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import PIECE, as_bytes, keep_rows, map_arrow, pieces_of, slim

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
SAMPLE_ROWS = 6000
#: Texts of more bytes are counted in pieces: measured on 6.9 MB of short words, in 9 times their bytes of memory instead of 25 times.
LONG = 1 << 21

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in _SYMBOLS)
_UPPER, _DIGITS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?"
_HAS_WORD = re.compile(rb"[^\x20\x09-\x0D]").search
_SPACE, _NEWLINE = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"\n")

#: Features of the trees with their constraint on the chance to be kept.
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("distinct_share", 0), ("upper_share", 0),
    ("digit_share", 0), ("stop_share", 0), ("words_per_line", 0), ("short_share", 0), ("long_share", 0), ("top_word_share", -1),
)


def counts_of(text: bytes) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of one text."""
    if len(text) > LONG:
        return _counts_of_long(text)
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(text.translate(None, _NOT_SYMBOLS)), 0, 0), [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    if not text.isascii():
        joined = b"".join(words)
        chars = len(joined.decode())
    symbols = len(text.translate(None, _NOT_SYMBOLS))
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup = full = 0
    for line in lines:
        if _HAS_WORD(line):
            full += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) < n - 2:
        last = -1  # the last word counted so far
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += i + 2 - max(last, i - 1)
                last = i + 2
    own = Counter(words)
    size = max(len(text), 1)
    share = lambda table: (size - len(text.translate(None, table))) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    features = [
        float(np.log1p(n)), chars / n, symbols / n, dup / max(full, 1), repeated / n, len(own) / n, share(_UPPER), share(_DIGITS), share(_STOPS),
        n / max(full, 1), float((lengths <= 3).mean()), float((lengths >= 10).mean()), max(own.values()) / n,
    ]
    return (n, chars, symbols, dup, repeated), features


def _multiplicity(digests: list[bytes], buckets: int = 64) -> tuple[int, int, np.ndarray]:
    """Of 16-byte digests, in joined runs: how many different ones, the largest number of equal ones, and whether each occurs twice or more."""
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    again, distinct, most = np.zeros(len(both), bool), 0, 0
    for bucket in range(buckets):  # sorted a part at a time: the sort's own arrays stay small
        at = np.flatnonzero(both[:, 0] % np.uint64(buckets) == bucket)
        if not len(at):
            continue
        at = at[np.lexsort((both[at, 1], both[at, 0]))]
        starts = np.flatnonzero(np.r_[True, (both[at[1:]] != both[at[:-1]]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(at)])
        again[at] = np.repeat(sizes > 1, sizes)
        distinct, most = distinct + len(sizes), max(most, int(sizes.max()))
    return distinct, most, again


def _counts_of_long(text: bytes, size: int = PIECE) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """What counts_of gives, without lists of all words and lines: they and the windows are known by 128-bit digests."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    n = chars = symbols = short = long = 0
    without = dict.fromkeys((_UPPER, _DIGITS, _STOPS), 0)
    own, windows, carry = [], [], []
    for piece in pieces_of(text, _SPACE, size):
        symbols += len(piece.translate(None, _NOT_SYMBOLS))
        for table in without:
            without[table] += len(piece.translate(None, table))
        words = piece.split()
        joined = b"".join(words)
        n, chars = n + len(words), chars + (len(joined) if joined.isascii() else len(joined.decode()))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        short, long = short + int((lengths <= 3).sum()), long + int((lengths >= 10).sum())
        own.append(b"".join(map(digest, words)))
        words = carry + words
        windows.append(b"".join(map(digest, map(b" ".join, zip(words, words[1:], words[2:])))))
        carry = words[-2:]
    if not n:
        return (0, 0, symbols, 0, 0), [0.0] * len(FEATURES)
    again = _multiplicity(windows)[2]
    windows.clear()
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    repeated = int(covered.sum())
    distinct, top, _ = _multiplicity(own)
    own.clear()
    lines = [b"".join(digest(line) for line in piece.split(b"\n") if _HAS_WORD(line)) for piece in pieces_of(text, _NEWLINE, size)]
    full = sum(map(len, lines)) // 16
    dup = full - _multiplicity(lines)[0]
    share = lambda table: (len(text) - without[table]) / len(text)
    features = [
        float(np.log1p(n)), chars / n, symbols / n, dup / max(full, 1), repeated / n, distinct / n, share(_UPPER), share(_DIGITS), share(_STOPS),
        n / max(full, 1), short / n, long / n, top / n,
    ]
    return (n, chars, symbols, dup, repeated), features


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> gbt.Forest:
    """Trees from at most ``sample_rows`` labelled documents, whose features alone come to the driver."""
    ids = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = slim(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("quality").cast("int"))

    def make():
        def step(batch):
            features = [counts_of(t or b"")[1] for t in as_bytes(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "y"])

        return step

    sample = map_arrow(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, x array<double>, y int").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample_rows).collect()
    x = np.array([r.x for r in sample], float).reshape(len(sample), len(FEATURES))
    return gbt.fit(x, np.array([r.y for r in sample], float), [s for _, s in FEATURES])


def keep(df: DataFrame, forest: gbt.Forest, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, whose text is kept."""
    model = df.sparkSession.sparkContext.broadcast(forest)

    def make():
        def test(texts):
            rows = [counts_of(t or b"") for t in texts]
            counts = np.array([c for c, _ in rows], np.int64)
            return ~base_failed(counts[:, 0], counts[:, 4]) & (model.value.probability(np.array([f for _, f in rows], float)) >= KEEP_FROM)

        return test

    return keep_rows(df, text_col, make)


def judge(df: DataFrame, forest: gbt.Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept, score (the chance to be of good quality)."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(forest)  # some thousand numbers, whatever the input

    def make():
        trees = model.value

        def step(batch):
            rows = [counts_of(t or b"") for t in as_bytes(batch.column(1))]
            counts = np.array([c for c, _ in rows], np.int64)
            score = trees.probability(np.array([f for _, f in rows], float))
            failed = base_failed(counts[:, 0], counts[:, 4])
            columns = [batch.column(0), *(pa.array(counts[:, j]) for j in range(5)), pa.array(failed), pa.array(~failed & (score >= KEEP_FROM)), pa.array(score)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

        return step

    kind = dict(df.dtypes)[id_col]
    return map_arrow(slim(df, id_col, text_col), make, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


#: The base columns by DuckDB.
BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
seen AS (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
again AS (SELECT r, count(DISTINCT i + o) AS n FROM seen, (VALUES (0), (1), (2)) v(o) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, len(w) < {MIN_WORDS} OR 100 * coalesce(again.n, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed
FROM d LEFT JOIN again USING (r) LEFT JOIN lines USING (r)
"""
