"""Embedding near-duplicates: exact pairs of cosine >= threshold within a label, by dual traversal of cover trees.

1. Equal vectors of a label are one class with a count; classes alone are compared.
2. Each label's classes are dealt to cells around pivots (``2 * PIVOTS`` of them at most for all labels, taken by hash, in proportion to the labels' sizes): a
   class goes to the nearest pivot. A cell is the top level of a cover tree; its covering radius is the largest distance found.
3. Each class looks for the cells that may hold a partner, by itself and in tasks: a cell is left out if its pivot lies further than the cell's radius
   and the threshold's distance, or if the class lies further than that distance on its own side of the plane between the two pivots. So a class is sent
   once to its own cell and once to each cell that is left. A cell of more than ``BLOCK`` classes is cut into blocks by hash, an exact way for any size.
4. In each pair of blocks a cover tree (nested levels of halving radii) is built over either
   side, and both are walked together; a pair of nodes is dropped when the distance of their centres exceeds both covering
   radii and the threshold's distance. Pairs left are settled by their cosine in double precision.
5. A group hands on, for each class, the rows linked to it and one link to the least class of its piece, never pairs. Links are
   joined to components in rounds (operators.components).

Copies grow with a label's size over ``BLOCK`` where vectors have no structure that bounds could use (all about as far from each other); where they lie in
clusters, a class is sent about once.

Vectors that are null, empty, zero or hold null or non-finite components, and rows whose label is null, link with nothing: n_links
0, component their own. Repeated rows are copies of one class: they link with each other. Vectors of different lengths
link with nothing of the other length. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.materialise import materialise
from .common import short_batches
from .simhash import _pieces

THRESHOLD = 0.93
PIVOTS = 2048
#: Classes for each pivot, unless that would make too many pivots, and classes of one side of a group at most (8 MB of 64 components).
CELL = 16_000
BLOCK = 16_000
LEAF = 24


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, so that neither tiny nor huge components lose their squares."""
    top = np.abs(rows).max(axis=1, keepdims=True, initial=0)
    return rows / np.exp2(np.floor(np.log2(np.where(top > 0, top, 1))))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components in a row, and where each vector begins."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]


class CoverTree:
    """Nodes as arrays: centre (row), covering radius, children (slice of nodes) or, in a leaf, rows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.nodes: list[tuple[int, float, list[int] | None, np.ndarray]] = []
        distance = self._from(0, np.arange(len(x)))
        self.root = self._build(0, np.arange(len(x)), distance, max(float(distance.max(initial=0)), 1e-12))

    def _from(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((self.x[rows] - self.x[centre]) ** 2).sum(axis=1), 0))

    def _build(self, centre: int, rows: np.ndarray, distance: np.ndarray, reach: float) -> int:
        """A node over rows at these distances from the centre; its children cover within half the reach."""
        radius, own = float(distance.max(initial=0)), len(self.nodes)
        self.nodes.append((centre, radius, None, rows))
        if len(rows) <= LEAF or radius < 1e-9:
            return own
        half = reach / 2
        while half > radius:
            half /= 2
        children, left, far = [], rows, distance
        at = int(np.flatnonzero(rows == centre)[0]) if centre in rows else 0
        middle, near_distance = int(left[at]), far
        while len(left):
            d = near_distance if middle == centre else self._from(middle, left)
            near = d <= half
            children.append((middle, left[near], d[near]))
            left, near_distance = left[~near], near_distance[~near]
            if len(left):
                middle = int(left[np.argmax(near_distance)])
                near_distance = self._from(middle, left) if middle == centre else near_distance
            if len(children) > 64 and len(left):  # spread too evenly for small balls: the rest stays one child
                d = self._from(middle, left)
                rest = len(self.nodes)
                self.nodes.append((middle, float(d.max()), None, left))
                self.nodes[own] = (centre, radius, [self._build(c, r, e, half) for c, r, e in children] + [rest], rows)
                return own
        self.nodes[own] = (centre, radius, [self._build(c, r, e, half) for c, r, e in children], rows)
        return own


def close_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float):
    """Yields arrays (i, j, cosine) of all pairs of unit rows of a and b (of a with itself, i < j, without b) that may reach the threshold."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    ta = CoverTree(a)
    tb = ta if b is None else CoverTree(b)
    y = a if b is None else b
    stack = [(ta.root, tb.root)]
    while stack:
        p, q = stack.pop()
        (cp, rp, kp, xp), (cq, rq, kq, xq) = ta.nodes[p], tb.nodes[q]
        if kp is None and kq is None or len(xp) * len(xq) <= 4096:
            for s in range(0, len(xp), 1024):
                cosine = a[xp[s : s + 1024]] @ y[xq].T
                i, j = np.nonzero(cosine >= threshold - 1e-9)
                if len(i):
                    i, j, c = xp[s + i], xq[j], cosine[i, j]
                    if b is None and p == q:
                        i, j, c = i[i < j], j[i < j], c[i < j]
                    yield i, j, c
            continue
        left, right = kp or [p], kq or [q]
        cl, rl = np.array([ta.nodes[k][0] for k in left]), np.array([ta.nodes[k][1] for k in left])
        cr, rr = np.array([tb.nodes[k][0] for k in right]), np.array([tb.nodes[k][1] for k in right])
        apart = np.sqrt(np.maximum(2 - 2 * (a[cl] @ y[cr].T), 0))
        for i, j in zip(*np.nonzero(apart <= rl[:, None] + rr[None, :] + reach)):
            if b is None and p == q and left[i] > right[j]:
                continue  # the same two nodes come the other way round
            stack.append((left[i], right[j]))


def _group_links(a, wa, ida, b, wb, idb, threshold):
    """Links of one group: (class, rows linked, least class of its piece)."""
    unit_a, unit_b = _unit(a), None if b is None else _unit(b)
    n = len(a)
    ids, weights = (ida, wa) if b is None else (np.r_[ida, idb], np.r_[wa, wb])
    raw = a if b is None else np.vstack([a, b])
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j, c in close_pairs(unit_a, unit_b, threshold):
        j = j if b is None else j + n
        unsure = np.abs(c - threshold) <= 1e-9
        if unsure.any():  # settled by the plain formula
            u, v = _scaled(raw[i[unsure]]), _scaled(raw[j[unsure]])
            c[unsure] = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
            i, j = i[c >= threshold], j[c >= threshold]
        if not len(i):
            continue
        np.add.at(links, i, weights[j])
        np.add.at(links, j, weights[i])
        used, inverse = np.unique(np.r_[label[i], label[j]], return_inverse=True)
        piece = used[_pieces(len(used), inverse[: len(i)], inverse[len(i) :])]
        change = np.arange(len(label))
        change[used] = piece
        label = change[label]
    hit = np.flatnonzero(links)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return ids[hit], links[hit], least[label[hit]]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = (F.size("v") > 0) & F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = materialise(rows.withColumn("fine", F.coalesce(fine, F.lit(False))))
    good = rows.where("fine")
    classes = materialise(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")).withColumn("space", F.xxhash64("label", F.size("v"))))

    # pivots: by hash, in proportion to the spaces' sizes, PIVOTS at most in all
    total = classes.count()
    per = max(CELL, math.ceil(total / PIVOTS))  # classes for each pivot
    tagged = classes.withColumn("h", F.xxhash64("v", F.lit(7)))
    pivots = tagged.where(F.pmod("h", F.lit(per)) == 0).orderBy("h").limit(2 * PIVOTS).select("space", "v", "rep").collect()
    around: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for p, r in enumerate(pivots):
        around.setdefault(r.space, ([], []))[0].append(r.v)
        around[r.space][1].append(p)
    around = {k: (_unit(np.array(v)), np.array(p)) for k, (v, p) in around.items()}
    near = spark.sparkContext.broadcast(around)

    def distances(batch, column: int, spaces: np.ndarray):
        """For up to 2,000 vectors of one space with pivots at a time: their rows, and the squares of their distances from its pivots."""
        flat, at = _vectors(batch.column(column))
        for k in np.unique(spaces).tolist():
            if k in near.value:
                own = np.flatnonzero(spaces == k)
                for s in range(0, len(own), 2000):
                    part = own[s : s + 2000]
                    x = np.concatenate([flat[at[i] : at[i + 1]] for i in part]).reshape(len(part), -1)
                    yield k, part, np.maximum(2 - 2 * (_unit(x) @ near.value[k][0].T), 0)

    def to_cells(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            space = batch.column(1).to_numpy()
            cell, far = np.full(len(space), -1, np.int64), np.full(len(space), 2.0)
            for k, own, d in distances(batch, 2, space):
                best = d.argmin(axis=1)
                cell[own], far[own] = near.value[k][1][best], np.sqrt(d[np.arange(len(own)), best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], ["rep", "space", "v", "times", "cell", "far"])

    short_batches(spark)
    dealt = materialise(classes.select("rep", "space", "v", "times").mapInArrow(to_cells, "rep long, space long, v array<double>, times long, cell long, far double"))

    # radii and blocks of the cells: 2 * PIVOTS rows at most
    sizes = dealt.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    radius, blocks = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
    for r in sizes:
        radius[r.cell], blocks[r.cell] = r.far, math.ceil(r.n / BLOCK)
    known = spark.sparkContext.broadcast((radius, blocks))
    reach = math.sqrt(2 - 2 * threshold) + 1e-6

    def to_groups(batches):
        """Each class with the groups (two cells and a block of each, in order) that it takes part in, and on which side."""
        radius, blocks = known.value
        between = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, space, cell = (batch.column(k).to_numpy() for k in (0, 1, 3))
            groups: list = [[] for _ in rep]
            for k, own, d in distances(batch, 2, space):
                unit, number = near.value[k]
                if k not in between:
                    between[k] = np.sqrt(np.maximum(2 - 2 * unit @ unit.T, 0))
                a = np.searchsorted(number, cell[own])
                block = (((rep[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % blocks[cell[own]].astype(np.uint64)).tolist()
                mine = d[np.arange(len(own)), a][:, None]
                gap = between[k][a]
                beyond = np.divide(d - mine, 2 * gap, out=np.zeros_like(d), where=gap > 1e-6)  # distance to the plane between the pivots
                open_ = (beyond <= reach) & (np.sqrt(d) <= radius[number] + reach) & (blocks[number] > 0)
                open_[np.arange(len(own)), a] = True
                for i, row, c, at in zip(own.tolist(), open_, cell[own].tolist(), block):
                    for other in number[row].tolist():
                        for b in range(int(blocks[other])):
                            left = (c, at) <= (other, b)
                            groups[i].append((c, at, other, b, True) if left else (other, b, c, at, False))
            ends = np.cumsum([0] + [len(g) for g in groups])
            parts = list(zip(*(x for g in groups for x in g))) or [()] * 5
            made = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(parts, [pa.int32()] * 4 + [pa.bool_()])], names=["c", "b", "d", "e", "left"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], ["rep", "space", "v", "times", "groups"])

    met = dealt.where("cell >= 0").select("rep", "space", "v", "cell", "times").mapInArrow(to_groups, "rep long, space long, v array<double>, times long, groups array<struct<c: int, b: int, d: int, e: int, left: boolean>>")
    met = met.select("rep", "times", "v", "space", F.inline("groups"))
    # a space without a pivot is one cell of its own, in blocks
    few = dealt.where("cell < 0").groupBy("space").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    lone = dealt.where("cell < 0").join(few, "space").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")).withColumn("with", F.explode(F.expr("sequence(0, n - 1)")))
    none, low, high = F.lit(-1), F.least("own", "with"), F.greatest("own", "with")
    lone = lone.select("rep", "times", "v", "space", none.alias("c"), low.alias("b"), none.alias("d"), high.alias("e"), (F.col("own") <= F.col("with")).alias("left"))
    key = ["space", "c", "b", "d", "e"]

    def search(batches):
        held: list = []

        def solve(parts):
            left, rep, times, vectors = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
            one, two = np.flatnonzero(left), np.flatnonzero(~left)
            same = parts[0][0][1:3] == parts[0][0][3:5]
            if not len(one) or not (same or len(two)):
                return None  # nobody on the other side
            b = (vectors[two], times[two], rep[two]) if len(two) else (None, None, None)
            ids, links, least = _group_links(vectors[one], times[one], rep[one], *b, threshold)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(least)], ["rep", "links", "least"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
            left, rep, times = (batch.column(k).to_numpy(zero_copy_only=False) for k in (5, 6, 7))
            flat, at = _vectors(batch.column(8))
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist() + [len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                now = tuple(keys[s].tolist())
                if held and held[0][0] != now:
                    out = solve(held)
                    held.clear()
                    if out is not None and out.num_rows:
                        yield out
                held.append((now, left[s:e].astype(bool), rep[s:e], times[s:e], flat[at[s] : at[e]].reshape(e - s, -1)))
        if held:
            out = solve(held)
            if out is not None and out.num_rows:
                yield out

    columns = [*key, "left", "rep", "times", "v"]
    dealt_groups = met.select(columns).unionByName(lone.select(columns)).repartition(*key).sortWithinPartitions(*key)
    found = materialise(dealt_groups.mapInArrow(search, "rep long, links long, least long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = connected_components(found.select(F.col("rep").alias("src"), F.col("least").alias("dst")))
    named = classes.join(links, "rep", "left").join(tied, F.col("rep") == F.col("node"), "left")
    named = named.select("label", "v", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = good.select("vec_id", "label", "v").join(named, ["label", "v"]).select("vec_id", (F.col("links") + F.col("times") - 1).alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The same links by DuckDB: every pair within a label, then all that is reachable (for its small tables).
ORACLE_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT vec_id, label, v FROM e WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= {THRESHOLD}),
reach AS (SELECT a AS vec_id, a AS root FROM pair UNION SELECT p.b, r.root FROM reach r JOIN pair p ON p.a = r.vec_id),
named AS (SELECT vec_id, min(root) AS root FROM reach GROUP BY vec_id), linked AS (SELECT a AS vec_id, count(*) AS n FROM pair GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, e.vec_id) AS component_id, coalesce(coalesce(root, e.vec_id) = e.vec_id, true) AS kept
FROM e LEFT JOIN named ON named.vec_id = e.vec_id LEFT JOIN linked ON linked.vec_id = e.vec_id
"""
