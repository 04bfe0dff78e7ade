"""URL filter: many glob rules run at once as a bit-parallel automaton.

Each rule is a glob over the canonical URL ``host + path``: ``**`` stands for any run of bytes, ``*`` for
any run without ``/``; everything else stands for itself. All rules are packed one after another
into 64-bit words. One bit is the state "this many pattern bytes are matched"; a step shifts
all words by one (with carry between words), keeps the bits whose byte fits, and adds the
states that a wildcard lets stay where they are. The step is done for every URL of an
Arrow batch together, so the Python loop runs over byte positions, not over URLs or rules. Where few URLs are left, as long as ever, each is run to
its end by itself, its state one integer of all words.

Verdict: the base rule if one fits (the longest wins), else the longest of the extra globs (of equally long ones the first listed), else allow.
Null URLs and URLs without ``://`` have empty host and path and are allowed. Very long URLs are read whole. Repeated rows are judged
each on its own; an empty table gives an empty result; ids may be of any type; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: (verdict, host, path prefix) of the base list.
BASE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: (verdict, glob) of the method's own list, for URLs that no base rule fits.
EXTRA_GLOBS = (
    ("block", "casino*.**"), ("block", "*.casino*.**"), ("block", "*-bets.**"), ("block", "*-bets.*/**"),
    ("block", "cheap-pills.**"), ("block", "*.cheap-pills.**"), ("block", "ads-*.**"), ("block", "*.ads-*.**"),
    ("block", "**/login**"), ("block", "**/wp-admin/**"), ("block", "**.exe"), ("block", "**.zip"),
)


#: So many URLs at most are run to their end one by one.
FEW = 4


@dataclass(frozen=True)
class Automaton:
    """Packed globs. ``fits[c]``: bits that byte c may enter; ``stays[c]``: bits that byte c may leave as they are."""

    fits: np.ndarray
    stays: np.ndarray
    start: np.ndarray
    ends: np.ndarray  # the accepting bit of each glob

    @classmethod
    def of(cls, globs: list[str]) -> Automaton:
        parsed = []
        for glob in globs:
            chars, loops = [], {}  # loops: state -> True if "/" may be skipped too
            raw, k = glob.encode(), 0
            while k < len(raw):
                if raw[k] == 0x2A:
                    deep = raw[k + 1 : k + 2] == b"*"
                    loops[len(chars)] = loops.get(len(chars), False) or deep
                    k += 1 + deep
                else:
                    chars.append(raw[k])
                    k += 1
            parsed.append((chars, loops))
        words = (sum(len(c) + 1 for c, _ in parsed) + 63) // 64 or 1
        fits, stays = np.zeros((2, 256, words), np.uint64)
        start, ends, bit = np.zeros(words, np.uint64), [], 0
        one = np.uint64(1)
        for chars, loops in parsed:
            start[bit // 64] |= one << np.uint64(bit % 64)
            for k, deep in loops.items():
                mask = one << np.uint64((bit + k) % 64)
                stays[:, (bit + k) // 64] |= mask
                if not deep:
                    stays[0x2F, (bit + k) // 64] &= ~mask
            for k, c in enumerate(chars, bit + 1):
                fits[c, k // 64] |= one << np.uint64(k % 64)
            bit += len(chars)
            ends.append(bit)
            bit += 1
        return cls(fits, stays, start, np.array(ends, np.int64))

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix: URL x glob."""
        n, words = len(urls), len(self.start)
        lengths = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        state = np.tile(self.start, (n, 1))
        live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        one, top = np.uint64(1), np.uint64(63)
        for step, k in enumerate(live):
            if k <= FEW:
                self._finish(state[:k], flat, at[:k] + step, lengths[order[:k]] - step)
                break
            c, s = flat[at[:k] + step], state[:k]
            moved = s << one
            if words > 1:
                moved[:, 1:] |= s[:, :-1] >> top
            state[:k] = (moved & self.fits[c]) | (s & self.stays[c])
        hit = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & one
        out = np.zeros((n, len(self.ends)), bool)
        out[order] = hit.astype(bool)
        return out


    def _finish(self, state: np.ndarray, flat: np.ndarray, at: np.ndarray, left: np.ndarray) -> None:
        """Run each of these URLs on from its place to its end."""
        whole = lambda words: int.from_bytes(words.astype("<u8").tobytes(), "little")
        fits, stays = [whole(x) for x in self.fits], [whole(x) for x in self.stays]
        for row, (begin, n) in enumerate(zip(at.tolist(), left.tolist())):
            now = whole(state[row])
            for c in flat[begin : begin + n].tolist():
                now = (now << 1) & fits[c] | now & stays[c]
            state[row] = np.frombuffer(now.to_bytes(8 * state.shape[1], "little"), "<u8")


def base_globs(rules=BASE_RULES) -> list[tuple[str, str, str]]:
    """(verdict, rule as text, glob): each rule once for its host and once for all subdomains."""
    return [(v, host + path, lead + host + path + "**") for v, host, path in rules for lead in ("", "*.")]


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=BASE_RULES, extra=EXTRA_GLOBS) -> DataFrame:
    """Judge every URL; returns page_id, host, path, rule, verdict, pattern (the extra glob that decided, else null)."""
    base = base_globs(rules)

    def make():
        automaton = Automaton.of([g for *_, g in base] + [g for _, g in extra])
        rank = np.array([len(r) for _, r, _ in base] + [len(g) for _, g in extra])
        names = np.array([r for _, r, _ in base] + [g for _, g in extra], object)
        verdicts = np.array([v for v, *_ in base] + [v for v, _ in extra], object)
        n = len(base)

        def best(hit: np.ndarray, lo: int, hi: int) -> np.ndarray:
            score = np.where(hit[:, lo:hi], rank[lo:hi], -1)
            return np.where(score.max(axis=1, initial=-1) >= 0, lo + score.argmax(axis=1), -1) if hi > lo else np.full(len(hit), -1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            host, path = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = automaton.match([(h + p).encode() for h, p in zip(host, path)])
            b, x = best(hit, 0, n), best(hit, n, len(rank))
            chosen = np.where(b >= 0, b, x)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.where(b >= 0, names[b], None), pa.string()),
                 pa.array(np.where(chosen >= 0, verdicts[chosen], "allow"), pa.string()), pa.array(np.where((b < 0) & (x >= 0), names[x], None), pa.string())],
                ["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

        return step

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(coalesce(cast(`{url_col}` as string), ''), instr(`{url_col}`, '://') + 3)")).otherwise("")
    parts = df.select(F.col(id_col).alias("page_id"), rest.alias("rest"))
    host = F.regexp_extract("rest", r"\A[^/?#]*", 0)
    path = F.expr("substring(rest, length(regexp_extract(rest, '\\\\A[^/?#]*', 0)) + 1)")
    parts = parts.select("page_id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.regexp_extract(path, r"\A[^?#]*", 0).alias("path"))
    kind = dict(df.dtypes)[id_col]
    return map_arrow(parts, make, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")


def _regex(glob: str) -> str:
    """A glob as a regular expression over the whole URL."""
    import re

    return "(?s)" + re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace("'", "''")


def _rules_sql(rows: list[tuple[str, str, str]]) -> str:
    return ", ".join(f"({k}, '{verdict}', '{name}', '{_regex(glob)}', {len(name)})" for k, (verdict, name, glob) in enumerate(rows))


#: The same verdicts by DuckDB, a regular expression for each glob.
ORACLE_SQL = f"""
WITH base(k, verdict, name, expr, size) AS (VALUES {_rules_sql(base_globs())}), extra(k, verdict, name, expr, size) AS (VALUES {_rules_sql([(v, g, g) for v, g in EXTRA_GLOBS])}),
r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM r),
u AS (SELECT page_id, host, regexp_extract(tail, '^[^?#]*') AS path FROM h),
b AS (SELECT u.*, (SELECT struct_pack(name := name, verdict := verdict) FROM base WHERE regexp_full_match(host || path, expr) ORDER BY size DESC, k LIMIT 1) AS one,
  (SELECT struct_pack(name := name, verdict := verdict) FROM extra WHERE regexp_full_match(host || path, expr) ORDER BY size DESC, k LIMIT 1) AS two FROM u)
SELECT page_id, host, path, one.name AS rule, coalesce(one.verdict, two.verdict, 'allow') AS verdict, CASE WHEN one IS NULL THEN two.name END AS pattern FROM b
"""
