"""Toxicity by a weighted finite-state pattern grammar over clauses.

Each word of a clause becomes one symbol: insult, threat, target, negation, report or other. Insults come from a trie of stems with weights, learned
from labels: whole words, or beginnings of words, that toxic training documents hold far more often than others, chosen greedily by evidence so that a
common beginning stands for all its words. The other classes are fixed word lists.

Five transducers rewrite the clause, each a table of weighted arcs (grammar.py): *insult* marks an insult with its weight or
leaves it unmarked; *threat* marks a threat in a clause with a target, before or after; *target* makes a marked insult an aimed one
if the clause has a target; *negation* lowers what follows within three words; *reported speech* lowers what follows to the end of the clause. They are composed into
one machine, and the score of a clause is its best path's weight (max, +); a clause whose matches are all outweighed scores 0.

A document's score comes from its matched clauses by logistic regression: the best one, and the sum and number of different ones.

Labels are learned from at most ``SAMPLE_ROWS`` labelled documents with the smallest hash of their id (a documented bound);
every text is scored whole, however long. Near copies in the sample teach once: of labelled texts with one label and one min-hash of their
word triples, only the first counts when stems are weighed. Ids, languages and sources are no inputs. Null text has no clauses; null labels are not
used; without labels of both classes every score is the share of toxic labels (0.5 without any). Repeated rows are scored
each on its own. An empty table gives an empty result; ids may be of any type; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialise import materialise
from . import grammar
from .common import keep_rows, map_arrow, slim, split_remainder

TOXIC_FROM = 0.7
SAMPLE_ROWS = 12_000
#: A form is a stem from this many toxic documents, this log-odds weight and this evidence on.
STEM_DOCS, STEM_WEIGHT, STEM_EVIDENCE = 5, 1.5, 25.0
STEM_LENGTHS = range(3, 11)

# Fixed word lists.
THREAT = frozenset("kill killing murder hurt stab shoot destroy beat burn tuer frapper töten schlagen umbringen matar golpear".split())
TARGET = frozenset("you your yours u he she they him her them tu te toi vous votre du dich dir ihr euch sie tú usted ustedes vosotros".split())
NEGATION = frozenset("not no never nor isn aren wasn don doesn didn won pas jamais non nicht kein keine nie nunca ni".split())
REPORTED = frozenset("said says wrote reported quoted called stated told dit écrit sagte schrieb dijo escribió".split())

_WORDS = re.compile(r"[^\W\d_]+").findall
_CLAUSES = re.compile(r"[.!?;:,\n]+").split
FEATURES = 4


@dataclass
class Grammar:
    """stems: whole words ("word") and beginnings ("begin*") with weights; model: bias, weights and scales of the features."""

    stems: dict[str, float]
    model: np.ndarray | None = None
    machine: grammar.Machine = field(default_factory=grammar.composed)
    kept: dict[str, tuple[str, float]] = field(default_factory=dict)

    def insult(self, word: str) -> float:
        """The best weight on the trie's path along the word."""
        best = max((self.stems.get(word[:k] + "*", 0.0) for k in STEM_LENGTHS if k <= len(word)), default=0.0)
        return max(best, self.stems.get(word, 0.0))

    def symbol(self, word: str) -> tuple[str, float]:
        """The word's class and its own weight, from a bounded table."""
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) > 500_000:
                self.kept.clear()
            weight = self.insult(word)
            classes = ((grammar.INSULT, weight > 0), (grammar.THREAT, word in THREAT), (grammar.TARGET, word in TARGET), (grammar.NEGATION, word in NEGATION), (grammar.REPORT, word in REPORTED))
            found = next((c for c, fits in classes if fits), grammar.OTHER), weight
            if len(word) < 40:
                self.kept[word] = found
        return found

    def clauses(self, text: str) -> tuple[dict[tuple[str, ...], float], int]:
        """Scores of the different matched clauses, each known by its marked words, and the number of clauses with a word."""
        lower, found, n = text.lower(), {}, 0
        if not any(self.symbol(w)[0] in grammar.MATCHING for w in _WORDS(lower)):
            return found, n
        for clause in _CLAUSES(lower):
            words = _WORDS(clause)
            n += bool(words)
            symbols = [self.symbol(w) for w in words]
            if any(s in grammar.MATCHING for s, _ in symbols):
                score, tags = self.machine.best(symbols)
                if score > 0:
                    key = tuple(w for w, t in zip(words, tags) if t in grammar.MARKED)
                    found[key] = max(found.get(key, 0.0), score)
        return found, n

    def features(self, text: str) -> list[float]:
        found, n = self.clauses(text)
        if not found:
            return [0.0] * FEATURES
        total = sum(found.values())
        return [max(found.values()), float(np.log1p(total)), float(np.log1p(len(found))), float(np.log1p(total / np.sqrt(n)))]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.model[0] + (x / self.model[1 + FEATURES :]) @ self.model[1 : 1 + FEATURES]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forms_of(text: str) -> Counter:
    """How many different words of the text are this word ("word") or begin so ("begin*")."""
    out: Counter = Counter()
    for w in set(_WORDS(text.lower())):
        if 2 < len(w):
            out[w] += 1
        out.update(w[:k] + "*" for k in STEM_LENGTHS if k < len(w))
    return out


def _chosen(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Stems with weights: again and again the one of largest evidence (count times log-odds), without what the chosen ones below it hold already.

    counts: of each form, how often toxic and clean documents hold it; toxic, clean: words in all.
    """
    left, stems = dict(counts), {}

    def rate(s: str) -> tuple[float, float]:
        t, c = left[s]
        w = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))) if t > 0 else 0.0
        return t * w, w

    rated = {s: rate(s) for s in left}
    while rated:
        s = max(rated, key=lambda x: (rated[x][0], x))
        gain, w = rated[s]
        if gain < STEM_EVIDENCE:
            break
        if w < STEM_WEIGHT:
            del rated[s]
            continue
        stems[s] = w
        t, c = left[s]
        body = s.rstrip("*")
        for x in [x for x in rated if x == s or (s.endswith("*") and x.rstrip("*").startswith(body))]:
            del rated[x]
        for k in STEM_LENGTHS:  # what is left of its beginnings
            x = body[:k] + "*"
            if k <= len(body) and x in rated:
                left[x] = (left[x][0] - t, left[x][1] - c)
                rated[x] = rate(x)
    return stems


def _signature(text: str) -> int:
    """Min-hash of the text's word triples; near copies mostly share it."""
    import xxhash

    words = _WORDS(text.lower())
    return min((xxhash.xxh64_intdigest(" ".join(t)) for t in zip(words, words[1:], words[2:])), default=xxhash.xxh64_intdigest(" ".join(words))) >> 1


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1) -> np.ndarray:
    """Bias, weights and scales; weights of matches are held at zero or above, by Newton steps in those that may move, halved until they gain."""
    scale = np.maximum(np.abs(x).max(axis=0, initial=0), 1e-9)
    a = np.c_[np.ones(len(x)), x / scale]
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.r_[0, np.full(len(w) - 1, l2)]

    def gain(v):
        z = a @ v
        return float((y * z - np.logaddexp(0, z)).sum() - 0.5 * (penalty * v * v).sum())

    for _ in range(100) if len(y) and y.min() < y.max() else ():
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        slope = a.T @ (y - p) - penalty * w
        free = np.flatnonzero(np.r_[True, (w[1:] > 0) | (slope[1:] > 0)])
        curve = (a[:, free].T * (p * (1 - p))) @ a[:, free] + np.diag(penalty[free] + 1e-9)
        step, held = np.zeros(len(w)), gain(w)
        step[free] = np.linalg.solve(curve, slope[free])
        for k in range(40):
            after = w + step / 2**k
            after[1:] = np.maximum(after[1:], 0)
            if gain(after) > held + 1e-9:
                break
        else:
            break
        w = after
    return np.r_[w, scale]


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Learn stems and the regression from labelled documents; use: which doc_id may be learned from (default: all)."""
    ids = labels.where("toxic in (0, 1) and doc_id is not null")
    if use is not None:
        ids = ids.where(use)
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = slim(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("toxic").cast("int"))
    rows = materialise(rows)  # the sample: the corpus is read once for it
    kind = dict(rows.dtypes)["doc_id"]

    def sign():
        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([_signature(t or "") for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "toxic", "sign"])

        return step

    first = map_arrow(rows, sign, f"doc_id {kind}, toxic int, sign long").groupBy("toxic", "sign").agg(F.min("doc_id").alias("_first"))
    teaching = rows.join(F.broadcast(first.select("_first")), F.col("doc_id") == F.col("_first"), "left_semi")  # at most sample_rows ids

    def count(batches):
        seen, docs_with = (Counter(), Counter()), Counter()
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                forms = _forms_of(text or "")
                forms[""] = sum(n for f, n in forms.items() if not f.endswith("*"))  # all words
                seen[y].update(forms)
                if y:
                    docs_with.update(forms.keys())
            if len(seen[0]) > 1_000_000:
                yield flush(seen, docs_with)
                seen, docs_with = (Counter(), Counter()), Counter()
        if seen[0] or seen[1]:
            yield flush(seen, docs_with)

    def flush(seen, docs_with):
        forms = list(seen[0] | seen[1])
        return pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), *(pa.array([s[k] for k in forms], pa.int64()) for s in (seen[1], seen[0], docs_with))], ["form", "t", "c", "d"])

    counts = materialise(teaching.mapInArrow(count, "form string, t long, c long, d long").groupBy("form").agg(*(F.sum(x).alias(x) for x in "tcd")))
    toxic, clean = next(((r.t, r.c) for r in counts.where("form = ''").collect()), (0, 0))
    # forms that can become stems (weights only fall when others are taken out of them); the sample is bounded, and so are they
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    able = (F.col("form") != "") & (F.col("d") >= STEM_DOCS) & (weight >= STEM_WEIGHT) & (F.col("t") * weight >= STEM_EVIDENCE)
    top = counts.where(able).collect()
    stems = _chosen({r.form: (r.t, r.c) for r in top}, toxic, clean)
    learned = Grammar(stems)
    model = docs.sparkSession.sparkContext.broadcast(learned)  # stems of the bounded sample

    def make():
        def step(batch):
            x = [model.value.features(t or "") for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "y"])

        return step

    sample = map_arrow(rows, make, f"doc_id {kind}, x array<double>, y int").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample_rows).collect()
    learned.model = _logistic(np.array([r.x for r in sample], float).reshape(len(sample), FEATURES), np.array([r.y for r in sample], float))
    learned.kept.clear()
    return learned


def keep(df: DataFrame, learned: Grammar, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, whose text isn't predicted to be toxic."""
    model = df.sparkSession.sparkContext.broadcast(learned)

    def make():
        return lambda texts: model.value.probability(np.array([model.value.features((t or b"").decode()) for t in texts], float)) < TOXIC_FROM

    return keep_rows(df, text_col, make)


def judge(df: DataFrame, learned: Grammar, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held_out: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_matched (different matched clauses)."""
    model = df.sparkSession.sparkContext.broadcast(learned)

    def make():
        def step(batch):
            x = np.array([model.value.features(t or "") for t in batch.column(1).to_pylist()], float)
            p = model.value.probability(x)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= TOXIC_FROM).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, 2])).astype(np.int64))], ["doc_id", "held_out", "score", "predicted", "n_matched"])

        return step

    rows = slim(df, id_col, text_col).withColumn("held_out", split_remainder(F.col("doc_id"), modulus) == held_out)
    return map_arrow(rows, make, f"doc_id {dict(df.dtypes)[id_col]}, held_out boolean, score double, predicted int, n_matched long")


def learnable(modulus: int = 3, held_out: int = 1) -> Column:
    return split_remainder(F.col("doc_id"), modulus) != held_out
