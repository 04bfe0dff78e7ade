"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, decoding by the reversed byte table.

A text is first cut before each run of white space (always a border of the pattern's matches), so that a chunk can be encoded
on its own and the ids of frequent chunks kept in two bounded tables. Chunks go to the library as byte-level
characters; every split of a vocabulary entry into two entries is a merge at the entry's own rank, as ranks alone define it.

Null text counts as empty (no ids). Long texts are encoded whole; long chunks are not kept. Repeated rows are encoded each on its own; an empty
table gives an empty result; ids may be of any type; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slim, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"

#: White space as the pattern's \s has it (Unicode White_Space; not what Python adds to it).
_WS = r" \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+").findall

#: Chunks in a table; once it is full, a new one begins and takes over what is asked for again. Two are kept at most.
TABLE_ENTRIES = 300_000
LONGEST_KEPT = 48


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    table |= {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in table)}
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        ranks = read_ranks(path)
        shown = byte_characters()
        self.of_character = {c: b for b, c in shown.items()}
        text_of = {token: "".join(map(shown.__getitem__, token)) for token in ranks}
        merges = [(text_of[t[:k]], text_of[t[k:]]) for t in sorted(ranks, key=ranks.__getitem__) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.tokenizer = Tokenizer(models.BPE({text_of[t]: i for t, i in ranks.items()}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in text_of.items():
            self.token_bytes[ranks[token]] = bytes(map(self.of_character.__getitem__, i))
        self.table: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the table that was full before this one

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        ends = [4 * n for n in accumulate(map(len, ids), initial=0)]
        flat = np.fromiter(chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes()
        return [flat[a:b] for a, b in pairwise(ends)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [_CHUNK(t) for t in texts]
        wanted = {c for chunks in cut for c in chunks}
        if len(self.table) + len(wanted) > TABLE_ENTRIES:
            self.before, self.table = self.table, {}
        table, before = self.table, self.before
        missing = wanted.difference(table)
        new = sorted(missing.difference(before))
        table.update((c, before[c]) for c in missing.intersection(before))
        table.update(zip(new, self._encode_chunks(new)))
        out = [b"".join(map(table.__getitem__, chunks)) for chunks in cut]
        for c in new:
            if len(c) > LONGEST_KEPT:
                del table[c]
        return out

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and, for each, the characters it touches; the parts of a split character all touch that character."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of any run of ids; bytes of a character cut off at either end become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODECS: dict[str, ByteCodec] = {}


def codec(path: str) -> ByteCodec:
    """One codec for each file and worker process."""
    if path not in _CODECS:
        _CODECS[path] = ByteCodec(path)
    return _CODECS[path]


def encode_frame(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = "") -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def make():
        c = codec(tokenizer_path(vocabulary, folder))

        def step(batch):
            ids = c.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0] + [len(x) // 4 for x in ids])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["doc_id", "ids"])

        return step

    return map_arrow(slim(df, id_col, text_col), make, f"doc_id {dict(df.dtypes)[id_col]}, ids array<int>")


def offsets_frame(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = "") -> DataFrame:
    """doc_id, ids, and the characters [begin, end) that each id touches; ids that share a split character touch the same one."""

    def make():
        c = codec(tokenizer_path(vocabulary, folder))

        def step(batch):
            found = c.tokenizer.encode_batch([t or "" for t in batch.column(1).to_pylist()], add_special_tokens=False)
            ends = pa.array(np.cumsum([0] + [len(e.ids) for e in found]), pa.int32())
            flat = [[x for e in found for x in e.ids], *([o[k] for e in found for o in e.offsets] for k in (0, 1))]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in flat)], ["doc_id", "ids", "begin", "end"])

        return step

    return map_arrow(slim(df, id_col, text_col), make, f"doc_id {dict(df.dtypes)[id_col]}, ids array<int>, begin array<int>, end array<int>")


def decode_frame(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY, folder: str = "") -> DataFrame:
    """doc_id and text of every list of ids (null counts as empty)."""
    from pyspark.sql import functions as F

    def make():
        c = codec(tokenizer_path(vocabulary, folder))

        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(ids or ()) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

        return step

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_arrow(rows, make, f"doc_id {dict(df.dtypes)[id_col]}, text string")


def round_trip_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = "") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes, then decodes the ids, in one pass."""

    def make():
        c = codec(tokenizer_path(vocabulary, folder))

        def step(batch):
            ids = c.encode([t or "" for t in batch.column(1).to_pylist()])
            back = [c.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in ids]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in v], pa.string()) for v in (ids, back))]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_arrow(slim(df, id_col, text_col), make, f"doc_id {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
