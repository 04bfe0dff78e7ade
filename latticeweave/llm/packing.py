"""Packing of tokenised documents into sequences of a fixed length, by best-fit decreasing.

Each document becomes its ids and an end id. Documents of a full window or more are first cut into full
windows, which are sequences of their own. The rests are packed, longest first, each into the open window with the least room
that still holds it; a segment tree over the remaining capacity finds that window. At the end, windows with more than
``MAX_GAP`` free places are taken apart, laid end to end and cut anew into full windows; what is left over is cut into
powers of two, which need no padding.

Work is done in each task on blocks of at most ``BLOCK_TOKENS`` tokens, so memory is bounded and nothing is
shuffled. Null text counts as empty (the end id alone); repeated rows are packed each on its own; an empty table gives an empty
result; other columns are not read. Sequence ids are the task's number and a count, the same when a lost task is run again.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import byte_characters
from .common import short_batches, slim, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
WINDOW = 4096
END_ID = 2
MAX_GAP = 24
BLOCK_TOKENS = 6_000_000
TABLE_ENTRIES = 600_000
LONGEST_KEPT = 48

#: White space always parts the tokenizer's words, so each run of other characters can be encoded on its own.
_CHUNK = re.compile(r"[^ \t\n\x0b\x0c\r]+").findall

#: Texts of Latin characters alone (below U+0130) are composed already, and their words can be cut here as the tokenizer's own pattern does it.
_BEYOND = re.compile("[^\x00-\u012f]").search
_OF = {kind: "".join(re.escape(chr(c)) for c in range(0x130) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
_SPACE = r" \t\n\x0b\x0c\r\x85\xa0"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_OF['L']}]+|[{_OF['N']}]|[^{_SPACE}{_OF['L']}{_OF['N']}]+").findall


class WordEncoder:
    """Ids of whole texts, as the library's plain call gives them; those of short words are kept in bounded tables.

    Latin texts are lower-cased and cut into words here, and each new word goes straight to the model. All other texts go
    through the whole tokenizer, one run of non-space characters at a time. Texts that hold the name of one of the vocabulary's own
    tokens (which the plain call turns into that token's id) go to the whole tokenizer in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.named = re.compile("|".join(names) or "(?!)", re.IGNORECASE).search
        self.model = Tokenizer(self.tokenizer.model)
        self.shown = {b: c for b, c in byte_characters().items() if chr(b) != c}
        self.tables: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _encode(self, cut: list[list[str]], which: int) -> list[bytes]:
        wanted = set().union(*cut)
        table = self.tables[which]
        if len(table) + len(wanted) > TABLE_ENTRIES:
            table.clear()
        new = sorted(wanted.difference(table))
        if which:
            found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        else:  # the model reads bytes as characters
            found = self.model.encode_batch_fast([w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.shown) for w in new], add_special_tokens=False)
        done = {w: array("I", e.ids).tobytes() for w, e in zip(new, found)}
        table.update((w, v) for w, v in done.items() if len(w) <= LONGEST_KEPT)
        held = table if all(len(w) <= LONGEST_KEPT for w in new) else table | done
        return [b"".join(map(held.__getitem__, words)) for words in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = [k for k, t in enumerate(texts) if self.named(t)]
        for k, e in zip(whole, self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False) if whole else ()):
            out[k] = array("I", e.ids).tobytes()
        beyond = [None if out[k] else bool(_BEYOND(t)) for k, t in enumerate(texts)]
        for which, cut in enumerate((lambda t: _CUT(t.lower()), _CHUNK)):
            own = [k for k, b in enumerate(beyond) if b is bool(which)]
            for k, ids in zip(own, self._encode([cut(texts[k]) for k in own], which) if own else ()):
                out[k] = ids
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker process; its tables serve all tasks of the process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class RoomTree:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, and that room."""
        count, k = self.count, need + self.leaves
        while not count[k]:
            while k & 1:  # a right child: on to the parent
                k >>= 1
            if k == 0:
                return None
            k += 1  # the sibling to the right
        while k < self.leaves:
            k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.leaves
        while k:
            count[k] -= 1
            k >>= 1
        return self.stacks[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows as lists of item numbers; no length may exceed the capacity."""
    tree, windows = RoomTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = tree.take(lengths[item])
        window, room = got if got else (len(windows), capacity)
        if not got:
            windows.append([])
        windows[window].append(item)
        tree.add(room - lengths[item], window)
    return windows


def _packed(pieces: list[tuple[int, int, bytes]], capacity: int, max_gap: int):
    """Sequences as lists of (document, start, ids): best fit first, then the loose windows cut anew."""
    size = [len(p[2]) // 4 for p in pieces]
    loose: list[tuple[int, int, bytes]] = []
    for window in best_fit_decreasing(size, capacity):
        gap = capacity - sum(size[i] for i in window)
        if gap <= max_gap:
            yield [pieces[i] for i in window]
        else:
            loose += [pieces[i] for i in window]
    left = sum(len(p[2]) // 4 for p in loose)
    run, room = [], 0
    for doc, start, ids in loose:
        at, n = 0, len(ids) // 4
        while at < n:
            if not room:  # the next sequence: a full window, else the largest power of two
                room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
            part = min(room, n - at)
            run.append((doc, start + at, ids[4 * at : 4 * (at + part)]))
            at, room, left = at + part, room - part, left - part
            if not room:
                yield run
                run = []


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = "", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    kind = dict(df.dtypes)[id_col]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, sequence, held = None, TaskContext.get().partitionId() << 32, 0
        ids_of: list = []  # of the documents of the block: id and number of tokens
        rests: list[tuple[int, int, bytes]] = []
        rows: list[tuple] = []

        def put(pieces):
            nonlocal sequence
            offset = 0
            for doc, start, ids in pieces:
                n = len(ids) // 4
                rows.append((*ids_of[doc], start, n, zlib.crc32(ids), sequence, offset, ids))
                offset += n
            sequence += 1

        def out(batch_type):
            doc, tokens, start, n, crc, seq, offset, ids = zip(*rows)
            columns = [pa.array(doc, batch_type), *(pa.array(c, pa.int64()) for c in (start, n, crc, tokens, seq, offset))]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or word_encoder(tokenizer_path(vocabulary, folder))
            id_type = batch.column(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                n, doc = len(ids) // 4, len(ids_of)
                ids_of.append((doc_id, n))
                whole = n - n % window
                for start in range(0, whole, window):
                    put([(doc, start, ids[4 * start : 4 * (start + window)])])
                if n > whole:
                    rests.append((doc, whole, ids[4 * whole :]))
                    held += n - whole
            if held >= BLOCK_TOKENS:
                for pieces in _packed(rests, window, MAX_GAP):
                    put(pieces)
                rests.clear()
                held = 0
            if rows:
                yield out(id_type)
            if not rests:
                ids_of.clear()
        if rests:
            for pieces in _packed(rests, window, MAX_GAP):
                put(pieces)
            yield out(id_type)

    short_batches(df.sparkSession)
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return slim(df, id_col, text_col).mapInArrow(run, schema)
