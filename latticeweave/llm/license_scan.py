"""License scan by a positional rare-token index.

Templates are whole licence texts and notices (license_texts.py). The rarity of their words (IDF) is counted over all texts that are
scanned: one pass counts in how many texts each word of the templates stands, some hundred sums. The ``ANCHORS`` rarest words of each template are
posted as (template, position, IDF).

Of each file only the words that the index knows are looked at. Each occurrence at word p of a posting at position q votes
for the template to begin at p - q, and a template's votes are intersected by relative position: a begin is a candidate if the anchors
that vote for it, give or take ``slack`` words for insertions, hold at least ``AGREE`` of the anchors' IDF. A candidate counts
if every mandatory key phrase of the template stands at its place word for word (within the slack) and words with at least
``SHARE`` of the template's IDF stand at theirs. The score is the best such share.

Base phrases are templates that are their own key phrase, with no slack, so all their places are found exactly, by their rarest word.
Null text counts as empty (no words, no labels, score 0); texts are scanned whole, whatever their length; repeated
rows are counted and scanned each on its own; equal shares give the same labels in any order; an empty table gives an empty
result; ids may be of any type; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, slim
from .license_texts import TEMPLATES

#: Words: runs of ASCII letters (lower-cased), digits and all non-ASCII characters; the rest becomes blank.
_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Rarest words of each template that are posted, and the shares of IDF that must agree on a begin and stand in place.
ANCHORS, AGREE, SHARE = 12, 0.6, 0.8


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_TABLE).split()


def vocabulary(base=BASE_PHRASES, templates=TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for text in [p for p, _ in base] + [t for _, t, _ in templates] for w in words_of(text.encode()))


def background(texts: DataFrame, base=BASE_PHRASES, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many texts each word of the templates stands, and under the empty word how many texts there are. texts: doc_id, text (common.slim)."""
    known = vocabulary(base, templates)

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                seen[b""] += 1
                seen.update(known.intersection(words_of(text or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return {bytes(r.word): r.n for r in texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


class PositionalIndex:
    """Postings of each template's rarest words. seen: what background() counted."""

    def __init__(self, seen: dict[bytes, int], base=BASE_PHRASES, templates=TEMPLATES, anchors: int = ANCHORS):
        self.base, self.base_labels = [words_of(p.encode()) for p, _ in base], [label for _, label in base]
        self.labels = [label for label, *_ in templates]
        self.words = [words_of(t.encode()) for _, t, _ in templates]
        self.slack = [max(3, len(t) // 20) for t in self.words]
        self.keys = [[self._place(t, words_of(k.encode())) for k in keys] for t, (*_, keys) in zip(self.words, templates)]
        texts = seen.get(b"", 0)
        self.idf = {w: 1 + math.log((texts + 1) / (seen.get(w, 0) + 1)) for w in vocabulary(base, templates)}
        self.weight = [sum(self.idf[w] for w in t) for t in self.words]
        self.pins: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # of each base phrase its rarest word
        for b, phrase in enumerate(self.base):
            q = max(range(len(phrase)), key=lambda i: self.idf[phrase[i]])
            self.pins[phrase[q]].append((b, q))
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchored = []
        for t, words in enumerate(self.words):
            rarest = sorted(range(len(words)), key=lambda q: (-self.idf[words[q]], q))[:anchors]
            self.anchored.append(sum(self.idf[words[q]] for q in rarest))
            for q in rarest:
                self.postings[words[q]].append((t, q))
        self.known = frozenset(self.postings) | frozenset(self.pins)

    @staticmethod
    def _place(words: list[bytes], key: list[bytes]) -> tuple[int, list[bytes]]:
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return at, key

    def base_places(self, words: list[bytes], hits: list[int]) -> list[tuple[int, int]]:
        """(begin, phrase) of every place of a base phrase."""
        out = []
        for p in hits:
            for b, q in self.pins.get(words[p], ()):
                if p >= q and words[p - q : p - q + len(self.base[b])] == self.base[b]:
                    out.append((p - q, b))
        return out

    def candidates(self, words: list[bytes], hits: list[int]) -> dict[int, list[int]]:
        """Template -> begins on which anchors with enough IDF agree."""
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in hits:
            for t, q in self.postings.get(words[p], ()):
                votes[t].append((p - q, q))
        out = {}
        for t, own in votes.items():
            wanted = AGREE * self.anchored[t] - 1e-9
            if sum(self.idf[self.words[t][q]] for q in {q for _, q in own}) < wanted:
                continue  # the anchors found at all don't suffice
            own.sort()
            slack, low, high, weight, held = self.slack[t], 0, 0, 0.0, Counter()
            found = []
            for begin, _ in own:  # a window of begins moves along
                while high < len(own) and own[high][0] <= begin + slack:
                    q = own[high][1]
                    weight += self.idf[self.words[t][q]] * (held[q] == 0)
                    held[q] += 1
                    high += 1
                while own[low][0] < begin - slack:
                    q = own[low][1]
                    held[q] -= 1
                    weight -= self.idf[self.words[t][q]] * (held[q] == 0)
                    low += 1
                if weight >= wanted and (not found or found[-1] != begin):
                    found.append(begin)
            if found:
                out[t] = found
        return out

    def share(self, words: list[bytes], t: int, begin: int) -> float:
        """The share of the template's IDF that stands in place, 0 without a key phrase."""
        slack = self.slack[t]
        if not all(any(words[i : i + len(key)] == key for i in range(max(0, begin + q - slack), max(0, begin + q + slack + 1))) for q, key in self.keys[t]):
            return 0.0
        return sum(self.idf[w] for q, w in enumerate(self.words[t]) if w in words[max(0, begin + q - slack) : max(0, begin + q + slack + 1)]) / self.weight[t]

    def matches(self, words: list[bytes], hits: list[int]) -> dict[str, float]:
        """Label -> best share, for the templates found."""
        found: dict[str, float] = {}
        for t, begins in self.candidates(words, hits).items():
            best = found.get(self.labels[t], 0.0)
            for begin in begins:
                if best < 1 - 1e-12:  # no other place can be better than a whole one
                    best = max(best, self.share(words, t, begin))
            if best >= SHARE:
                found[self.labels[t]] = best
        return found


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE_PHRASES, templates=TEMPLATES, seen: dict[bytes, int] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. seen: counts of another background than df itself."""
    rows = slim(df, id_col, text_col)
    seen = background(rows, base, templates) if seen is None else seen

    def make():
        index = PositionalIndex(seen, base, templates)
        known = index.known

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in as_bytes(batch.column(1)):
                words = words_of(text or b"")
                hits = [i for i, w in enumerate(words) if w in known]
                places, found = index.base_places(words, hits), index.matches(words, hits)
                begins, own = [p for p, _ in places], {index.base_labels[b] for _, b in places}
                score = min(1.0, max([1.0] * bool(own) + list(found.values()), default=0.0))
                rows.append((len(words), len(places), min(begins, default=None), max(begins, default=None), ",".join(sorted(own)), ",".join(sorted(own | found.keys())), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

        return step

    kind = dict(df.dtypes)[id_col]
    return map_arrow(rows, make, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _stands_sql(phrase: str) -> str:
    return " AND ".join(f"{'word' if k == 0 else f'lead(word, {k}) OVER o'} = '{w}'" for k, w in enumerate(phrase.split()))


#: The base columns by DuckDB.
BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
places AS ({" UNION ALL ".join(f"SELECT r, i, '{label}' AS label FROM words WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY {_stands_sql(phrase)}" for phrase, label in BASE_PHRASES)}),
found AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN found USING (r)
"""
