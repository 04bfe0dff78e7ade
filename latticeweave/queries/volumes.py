"""Overlap, exchange and maps of one- and three-dimensional grids, stretched grids, and connections read from files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import geometry
from ..functions.newton import inverse_udf
from ..operators import exchange as X
from ..operators.materialise import shared_folder
from ..operators.overlap import detect_overlap
from ..plans import assembly as A
from ..sources import connectivity as C
from ..sources.grids import analytic_points, cells_of, default_points
from . import lattices as L
from .grids import IJK, _CELLS, _OVERLAP, _overlap
from .index_space import _ROWS, KEY, _rows
from .registry import query, table

#: The looked-for points; a third of them, as the events fall, are inactive.
_N = (7, 7, 4)
_AT = ("0.5 + 1.25 * i", "0.5 + 1.25 * j", "0.25 + 1.75 * k")


def _live(spark, sf_dir):
    at = zip("ijk", (f"user_id % {_N[0]}", f"event_id % {_N[1]}", f"(event_id div {_N[1]}) % {_N[2]}"))
    return table(spark, sf_dir, "events").groupBy(*(F.expr(f"cast({e} as int)").alias(a) for a, e in at)).agg(F.count("*").alias("s"))


_SUMS = f"sums AS (SELECT (user_id % {_N[0]})::INT i, (event_id % {_N[1]})::INT j, (event_id // {_N[1]} % {_N[2]})::INT k, count(*) AS s FROM events GROUP BY ALL)"
_POINTS = f"""{_SUMS}, p AS (SELECT a.i::INT AS ni, b.j::INT AS nj, c.k::INT AS nk, (0.5 + 1.25 * a.i)::DOUBLE AS x, (0.5 + 1.25 * b.j)::DOUBLE AS y, (0.25 + 1.75 * c.k)::DOUBLE AS z
  FROM range(0, {_N[0]}) a(i), range(0, {_N[1]}) b(j), range(0, {_N[2]}) c(k) LEFT JOIN sums q ON q.i = a.i AND q.j = b.j AND q.k = c.k WHERE coalesce(s, 0) % 3 <> 0)"""


def _edges(cell: str, f: str) -> tuple[str, str]:
    return f.replace("#", cell), f.replace("#", f"({cell} + 1)")


def _volume_sql(a: str, b: str, c: str, f: str = "#", digits: int = 9, cells=(7, 6, 5)) -> str:
    """The points' places a, b, c along the cell directions, the first of which has its nodes at f(index)."""
    low, high = _edges("ci", f)
    return f"""WITH {_POINTS}, g AS (SELECT *, ({a})::DOUBLE AS a, ({b})::DOUBLE AS b, ({c})::DOUBLE AS c FROM p),
h AS (SELECT ni, nj, nk, ci, cj, ck, (a - {low}) / ({high} - {low}) AS u, b - cj AS v, c - ck AS w
  FROM g, (SELECT q.i::INT AS ci, r.j::INT AS cj, s.k::INT AS ck FROM range(0, {cells[0]}) q(i), range(0, {cells[1]}) r(j), range(0, {cells[2]}) s(k)) WHERE a BETWEEN {low} AND {high} AND b BETWEEN cj AND cj + 1 AND c BETWEEN ck AND ck + 1)
SELECT 1 AS m, 2 AS n, ni, nj, nk, ci, cj, ck, round(u, {digits}) AS u, round(v, {digits}) AS v, round(w, {digits}) AS w
FROM (SELECT *, row_number() OVER (PARTITION BY ni, nj, nk ORDER BY greatest(abs(u - 0.5), abs(v - 0.5), abs(w - 0.5)), ck, cj, ci) AS r FROM h) WHERE r = 1"""


def _points(spark, sf_dir, kind: str, x: str, y: str, z: str, size=(8, 7, 6)):
    grids = [S.Grid(1, size, geometry=kind), S.Grid(2, _N, geometry=S.UNIFORM)]
    points = analytic_points(spark, grids, {1: (x, y, z), 2: _AT}).join(_live(spark, sf_dir), IJK, "left")
    live = (F.col("grid_id") == 1) | (F.coalesce("s", F.lit(0)) % 3 != 0)
    return grids, points.withColumn("flags", F.when(live, 1).otherwise(0)).drop("s")


def _found(spark, sf_dir, kind: str, x: str, y: str, z: str, digits: int = 9, size=(8, 7, 6)):
    grids, points = _points(spark, sf_dir, kind, x, y, z, size)
    meta = S.grid_table(spark, grids)
    out = detect_overlap(points, cells_of(points, meta, 3), meta, grids, spark.createDataFrame([(1, 2, 1e-12)], "m int, n int, tolerance double"))
    return out.withColumns({c: F.round(c, digits) for c in "uvw"})


@query(_volume_sql("(x - 4 + y) / 2", "(y - x + 4) / 2", "z / 2"))
def overlap_oriented_3d(spark, sf_dir):
    """A box turned by 45 degrees about its last direction."""
    return _found(spark, sf_dir, S.ORIENTED_UNIFORM, "i - j + 4", "i + j", "2 * k")


@query(_volume_sql("x", "y / 1.5", "z / 2", "(# * # / 4.0)"))
def overlap_rectilinear_3d(spark, sf_dir):
    return _found(spark, sf_dir, S.RECTILINEAR, "i * i / 4.0D", "1.5D * j", "2 * k")


@query(_volume_sql("(x - 4 + y) / 2", "(y - x + 4) / 2", "z / 2", "(# * # / 4.0)"))
def overlap_oriented_rectilinear_3d(spark, sf_dir):
    return _found(spark, sf_dir, S.ORIENTED_RECTILINEAR, "i * i / 4.0D - j + 4", "i * i / 4.0D + j", "2 * k")


@query(_volume_sql("(x - 4.03125 + y) / 2", "(y - x + 4.03125) / 2", "(z + 0.0625) / 2", digits=6))
def overlap_curvilinear_3d(spark, sf_dir):
    """The turned box, moved by 1/32, as a curvilinear grid: containment by tetrahedra, local coordinates by the cubic inverse over 64 points."""
    return _found(spark, sf_dir, S.CURVILINEAR, "i - j + 4.03125D", "i + j", "2 * k - 0.0625D", 6)


def _line_sql(digits: int = 6) -> str:
    return f"""WITH sums AS (SELECT (l_partkey % 50)::INT AS i, sum(l_quantity::BIGINT) AS s FROM lineitem GROUP BY 1),
p AS (SELECT a.i::INT AS ni, (0.3125 + 0.75 * a.i)::DOUBLE AS x FROM range(0, 50) a(i) LEFT JOIN sums USING (i) WHERE coalesce(s, 0) % 4 <> 0),
h AS (SELECT 1 AS m, ni, ci, x - ci AS u FROM p, (SELECT i::INT AS ci FROM range(0, 39) c(i)) WHERE x BETWEEN ci AND ci + 1
  UNION ALL SELECT 2, ni, ci, (x - 1.125 * ci - 0.03125) / 1.125 FROM p, (SELECT i::INT AS ci FROM range(0, 29) c(i)) WHERE x BETWEEN 1.125 * ci + 0.03125 AND 1.125 * (ci + 1) + 0.03125
  UNION ALL SELECT 3, ni, ci, (x - ci * ci / 16.0) / ((2 * ci + 1) / 16.0) FROM p, (SELECT i::INT AS ci FROM range(0, 23) c(i)) WHERE x BETWEEN ci * ci / 16.0 AND (ci + 1) * (ci + 1) / 16.0)
SELECT m, 4 AS n, ni, ci, round(u, {digits}) AS u FROM (SELECT *, row_number() OVER (PARTITION BY m, ni ORDER BY abs(u - 0.5), ci) AS r FROM h) WHERE r = 1"""


@query(_line_sql())
def overlap_1d(spark, sf_dir):
    """Lines: a uniform, a curvilinear (local coordinates over four points) and a rectilinear one."""
    grids = [S.Grid(1, (40, 1, 1), geometry=S.UNIFORM), S.Grid(2, (30, 1, 1), geometry=S.CURVILINEAR), S.Grid(3, (24, 1, 1), geometry=S.RECTILINEAR), S.Grid(4, (50, 1, 1), geometry=S.UNIFORM)]
    sums = table(spark, sf_dir, "lineitem").groupBy(F.expr("cast(l_partkey % 50 as int)").alias("i")).agg(F.sum(F.col("l_quantity").cast("long")).alias("s"))
    points = analytic_points(spark, grids, {1: ("i", "0", "0"), 2: ("1.125D * i + 0.03125D", "0", "0"), 3: ("i * i / 16.0D", "0", "0"), 4: ("0.3125D + 0.75D * i", "0", "0")}).join(sums, "i", "left")
    points = points.withColumn("flags", F.when((F.col("grid_id") < 4) | (F.coalesce("s", F.lit(0)) % 4 != 0), 1).otherwise(0)).drop("s")
    meta = S.grid_table(spark, grids)
    pairs = spark.createDataFrame([(m, 4, 1e-12) for m in (1, 2, 3)], "m int, n int, tolerance double")
    return detect_overlap(points, cells_of(points, meta, 1), meta, grids, pairs).select("m", "n", "ni", "ci", F.round("u", 6).alias("u"))


@query("""WITH p AS (SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS pid, (l_extendedprice / 128.0 - floor(l_extendedprice / 128.0))::DOUBLE AS f, (l_partkey % 2000) AS r FROM lineitem),
one AS (SELECT pid, min(pow(2.0, r / 100.0 - 10) + f / 1048576.0) AS x FROM p GROUP BY pid),
edge AS (SELECT i::INT AS ci, pow(2.0, i / 8.0 - 10) AS x0, pow(2.0, (i + 1) / 8.0 - 10) AS x1 FROM range(0, 160) t(i))
SELECT ci, count(*) AS points, round(sum(u), 4) AS total FROM (SELECT ci, (x - x0) / (x1 - x0) AS u FROM one JOIN edge ON x >= x0 AND x < x1) GROUP BY ci""")
def overlap_stretched(spark, sf_dir):
    """A line whose cells span six orders of magnitude, and one point for each line number of an order on it: counts and sums of local coordinates by cell."""
    grids = [S.Grid(1, (161, 1, 1), geometry=S.RECTILINEAR), S.Grid(2, (2, 1, 1), geometry=S.UNIFORM)]
    line = analytic_points(spark, grids[:1], {1: ("pow(2.0D, i / 8.0D - 10)", "0", "0")})
    x = F.expr("pow(2.0D, (l_partkey % 2000) / 100.0D - 10) + (l_extendedprice / 128.0D - floor(l_extendedprice / 128.0D)) / 1048576.0D")
    key = F.expr("l_orderkey * 8 + l_linenumber")  # any point table will do: i and j carry the row's key
    points = table(spark, sf_dir, "lineitem").select(F.lit(2).alias("grid_id"), (key % 1048576).cast("int").alias("i"), F.floor(key / 1048576).cast("int").alias("j"), F.lit(0).alias("k"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1).alias("flags"))
    points = points.groupBy("grid_id", *IJK, "y", "z", "flags").agg(F.min("x").alias("x"))
    meta = S.grid_table(spark, grids)
    cells = cells_of(line, meta, 1)
    found = detect_overlap(points, cells, meta, grids, spark.createDataFrame([(1, 2, 0.0)], "m int, n int, tolerance double"))
    # here cells are half open: a point on an edge, which the lower cell wins, belongs to the upper one. Its u is exactly 1 there, and that of no other point
    edge = F.col("u") == 1.0
    found = found.select(F.when(edge, F.col("ci") + 1).otherwise(F.col("ci")).alias("ci"), F.when(edge, 0.0).otherwise(F.col("u")).alias("u"))
    return found.groupBy("ci").agg(F.count("*").alias("points"), F.round(F.sum("u"), 4).alias("total"))


_TRILINEAR = """c AS (SELECT h.*, a.a, b.b, c.c, (CASE WHEN a.a = 1 THEN u ELSE 1 - u END) * (CASE WHEN b.b = 1 THEN v ELSE 1 - v END) * (CASE WHEN c.c = 1 THEN w ELSE 1 - w END) AS t FROM best h, range(0, 2) a(a), range(0, 2) b(b), range(0, 2) c(c)),
got AS (SELECT ni AS i, nj AS j, nk AS k, sum(t * ((ci + a) * 2.0 + (cj + b) * (ck + c))) AS one, sum(t * ((ci + a) - 3.0 * (ck + c))) AS two FROM c GROUP BY ni, nj, nk)"""


@query(f"""WITH best AS ({_volume_sql('(x - 4 + y) / 2', '(y - x + 4) / 2', 'z / 2').replace('WITH ', 'WITH ', 1)}), {_TRILINEAR},
f AS (SELECT 1 AS grid_id, a.i::INT AS i, b.j::INT AS j, c.k::INT AS k, a.i * 2.0 + b.j * c.k AS one, a.i - 3.0 * c.k AS two FROM range(0, 8) a(i), range(0, 7) b(j), range(0, 6) c(k)
  UNION ALL SELECT 2, a.i, b.j, c.k, a.i * 2.0 + b.j * c.k, a.i - 3.0 * c.k FROM range(0, {_N[0]}) a(i), range(0, {_N[1]}) b(j), range(0, {_N[2]}) c(k))
SELECT grid_id, f.i, f.j, f.k, round(CASE WHEN grid_id = 2 THEN coalesce(g.one, f.one) ELSE f.one END, 6)::DOUBLE AS one, round(CASE WHEN grid_id = 2 THEN coalesce(g.two, f.two) ELSE f.two END, 6)::DOUBLE AS two
FROM f LEFT JOIN got g ON grid_id = 2 AND g.i = f.i AND g.j = f.j AND g.k = f.k""")
def exchange_3d(spark, sf_dir):
    """Two values at once from the turned box to the points it holds, trilinear."""
    grids, points = _points(spark, sf_dir, S.ORIENTED_UNIFORM, "i - j + 4", "i + j", "2 * k")
    meta = S.grid_table(spark, grids)
    overlap = detect_overlap(points, cells_of(points, meta, 3), meta, grids, spark.createDataFrame([(1, 2, 1e-12)], "m int, n int, tolerance double"))
    fields = points.select("grid_id", *IJK, F.expr("cast(i * 2 + j * k as double)").alias("one"), F.expr("cast(i - 3 * k as double)").alias("two"))
    out = X.exchange(X.connections_of(overlap, dims=3), fields, meta, value=["one", "two"])
    return out.withColumns({c: F.round(c, 6) for c in ("one", "two")})


@query(f"{L.sql_points()}, {_CELLS}, {_OVERLAP} SELECT DISTINCT m, n, ci + a AS i, cj + b AS j FROM over JOIN pts p ON p.grid_id = n AND p.i = ni AND p.j = nj, corner WHERE (p.flags & 3) = 3")
def cover_projection(spark, sf_dir):
    """Boundary points of each grid, cast on the corners of the cells that hold them."""
    points, _, _, overlap = _overlap(spark, sf_dir)
    domain = A.Domain(spark, L.GRIDS, points)
    side = A.receivers_side(overlap)
    return A.project(domain, overlap, side.join(A.boundary(points), A.POINT, "left_semi")).select("m", "n", "i", "j")


@query(f"{L.sql_points()}, {_CELLS}, {_OVERLAP} SELECT m, n, ni, nj, ci AS begin_i, cj AS begin_j, CASE WHEN u <= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS wi0, CASE WHEN v <= 0.5 THEN 0.0 ELSE 1.0 END::DOUBLE AS wj1 FROM over")
def connectivity_nearest(spark, sf_dir):
    made = X.connections_of(_overlap(spark, sf_dir)[3], "NEAREST")
    return made.select("m", "n", "ni", "nj", F.col("begin")[0].alias("begin_i"), F.col("begin")[1].alias("begin_j"), F.col("wi")[0].alias("wi0"), F.col("wj")[1].alias("wj1"))


@query(f"{L.sql_points(True)} SELECT grid_id, i, j, i::DOUBLE AS x, j::DOUBLE AS y, 0.0::DOUBLE AS z, 1 AS flags FROM pts")
def default_coordinates(spark, sf_dir):
    """Before anything is loaded, points stand at their indices and are active."""
    return default_points(spark, L.GRIDS).drop("k")


def _write_interface(folder: str) -> tuple[str, str]:
    """A connectivity file of two stacked grids of 48 columns: rows 15 of the lower one give to row 0 of the upper one, and the upper one's row 1 gives to row 16 of the lower one."""
    width, sizes = 48, {1: (48, 32, 1), 2: (48, 17, 1)}
    gives = {1: (15, 1), 2: (1, 1 + width)}  # donor row, first connection
    takes = {1: (16, 1 + width), 2: (0, 1)}  # receiver row, first connection
    i = np.arange(1, width + 1)

    def record(*arrays) -> bytes:
        data = b"".join(np.asarray(a).astype(k).tobytes() for a, k in arrays)
        mark = np.array([len(data)], "<i4").tobytes()
        return mark + data + mark

    head = record(([2, 0, 0, 0, 0], "<i4"))
    one, two = head, head
    for g, size in sizes.items():
        row, first = gives[g]
        own, ids = takes[g]
        one += record(([width, width, 0, first], "<i4"), (size, "<i4")) + record(([*i, *np.full(width, row + 1), *np.ones(width)], "<i4"), (np.zeros(3 * width), "<f8"))
        one += record(([*i, *np.full(width, own + 1), *np.ones(width)], "<i4"), (np.arange(ids, ids + width), "<i4"))
        two += record((np.ones(3 * width), "<i4")) + record((np.ones(3 * width), "<f8")) + record(([0, 0, 0], "<i4"))
    paths = f"{folder}/interface.donors", f"{folder}/interface.stencils"
    for path, data in zip(paths, (one, two)):
        with open(path, "wb") as f:
            f.write(data)
    return paths


@query(f"""{L.sql_points()}, rows AS (SELECT i, j, value FROM pts WHERE grid_id = 1)
SELECT 1 AS grid_id, a.i, a.j, CASE WHEN a.j = 16 THEN b.value ELSE a.value END AS value FROM rows a LEFT JOIN rows b ON a.j = 16 AND b.i = a.i AND b.j = 16
UNION ALL SELECT 2, a.i, a.j - 15, CASE WHEN a.j = 15 THEN b.value ELSE a.value END FROM rows a LEFT JOIN rows b ON a.j = 15 AND b.i = a.i AND b.j = 15 WHERE a.j >= 15""")
def exchange_imported(spark, sf_dir):
    """Values pass between two stacked halves of the background through connections read from a pair of connectivity files."""
    import os
    import uuid
    from urllib.parse import urlparse

    folder = f"{urlparse(shared_folder(spark)).path}/latticeweave-files-{uuid.uuid4().hex}"
    os.makedirs(folder)
    grids = [S.Grid(1, (48, 32, 1)), S.Grid(2, (48, 17, 1))]
    made = C.import_connections(spark, *_write_interface(folder), grids)
    rows = L.summed(spark, sf_dir).where("grid_id = 1").select("i", "j", "k", "value")
    fields = rows.select(F.lit(1).alias("grid_id"), *IJK, "value").unionByName(rows.where("j >= 15").select(F.lit(2).alias("grid_id"), "i", (F.col("j") - 15).alias("j"), "k", "value"))
    return X.exchange(made, fields, S.grid_table(spark, grids), ordered=True).drop("k")


_HEX = [(x, y, z) for z in ("0.0", "2.0 + q / 64.0") for x, y in (("p + 0.0", "s + 0.0"), ("p + 4.0", "s + 0.5"), ("p - 0.5", "s + 3.0"), ("p + 5.0", "s + 4.0"))]


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber, round(q / 64.0, 6)::DOUBLE AS line, round(q / 64.0, 6)::DOUBLE AS hu, round(q / 128.0, 6)::DOUBLE AS hv, round(q / 96.0, 6)::DOUBLE AS hw,
  round(q / 64.0, 6)::DOUBLE AS cu, round(q / 128.0, 6)::DOUBLE AS cv, round(q / 96.0, 6)::DOUBLE AS cw FROM r""")
def iso_inverse_newton_lines_and_hexes(spark, sf_dir):
    """Forward maps of lines of four points and of hexes of 8 and 64, and their Newton inverses."""
    u, v, w = (F.expr(f"cast(q / {d}.0 as double)") for d in (64, 128, 96))
    flat = lambda nodes: F.array(*(x for n in nodes for x in n))
    line = [[F.lit(float(i)) + F.lit(0.0625 * i * i)] for i in range(-1, 3)]
    hexa = [[F.expr(f"cast({x} as double)") for x in n] for n in _HEX]
    bent = [[F.lit(i + 0.0625 * (j - 1) * j), F.lit(j + 0.03125 * i * i), F.lit(k + 0.03125 * i * k)] for k in range(-1, 3) for j in range(-1, 3) for i in range(-1, 3)]
    found = {"a": inverse_udf(1, True)(flat(line), F.array(*geometry.iso_forward(line, [u], cubic=True))), "b": inverse_udf(3, False)(flat(hexa), F.array(*geometry.iso_forward(hexa, [u, v, w]))),
             "c": inverse_udf(3, True)(flat(bent), F.array(*geometry.iso_forward(bent, [u, v, w], cubic=True)))}
    rows = _rows(spark, sf_dir).select(*KEY, *(f.alias(n) for n, f in found.items()))
    names = [("a", 0, "line"), *(("b", d, f"h{x}") for d, x in enumerate("uvw")), *(("c", d, f"c{x}") for d, x in enumerate("uvw"))]
    return rows.select(*KEY, *(F.round(F.col(n)[d], 6).alias(x) for n, d, x in names))


#: A box with perpendicular edges (2, 2, 0), (-2, 2, 0) and (0, 0, 4).
_TURNED = [(x, y, z) for z in (0.0, 4.0) for x, y in ((0.0, 0.0), (2.0, 2.0), (-2.0, 2.0), (0.0, 4.0))]


@query(f"""{_ROWS}, t AS (SELECT *, (p + s) / 4.0::DOUBLE AS u, (s - p) / 4.0::DOUBLE AS v, q / 16.0::DOUBLE AS w FROM r)
SELECT l_orderkey, l_linenumber, u, v, w, u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AS inside, 32.0::DOUBLE AS volume, p + 0.0::DOUBLE AS fx, 1.0 - (q / 64.0) AS d0 FROM t""")
def oriented_hex(spark, sf_dir):
    """Local coordinates, containment and volume in a turned box, and the forward map of the same coordinates."""
    nodes = [[F.lit(x) for x in n] for n in _TURNED]
    point = [F.col("p") * 1.0, F.col("s") * 1.0, F.col("q") / F.lit(4.0)]
    local = geometry.inverse_oriented(nodes, point)
    there = geometry.contains(S.ORIENTED_UNIFORM, nodes, point)
    fx = geometry.iso_forward(nodes, local)[0]
    return _rows(spark, sf_dir).select(*KEY, *(x.alias(n) for x, n in zip(local, "uvw")), there.alias("inside"), geometry.volume(S.ORIENTED_UNIFORM, nodes).alias("volume"), fx.alias("fx"), geometry.linear_weights(F.col("q") / F.lit(64.0))[0].alias("d0"))
