"""Scans of grids, active masks, volumes, overlap detection, exchange and remapping over the lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.index import has
from ..operators import exchange as X
from ..operators.overlap import detect_overlap
from ..plans.remap import remap as remap_fields
from ..sources.grids import analytic_points, cells_of, corners_of, index_cells, index_points, point_volumes
from . import lattices as L
from .registry import query, table

IJK = ["i", "j", "k"]
_PAIRS = [(1, 2), (2, 1), (1, 3), (3, 1)]


@query(f"{L.sql_points()} SELECT grid_id, i, j, k, (i + ni * j)::BIGINT AS pid, flags, value FROM pts JOIN meta USING (grid_id)")
def grid_points(spark, sf_dir):
    return index_points(spark, L.GRIDS).join(L.summed(spark, sf_dir).select("grid_id", *IJK, "flags", "value"), ["grid_id", *IJK])


@query(f"{L.sql_points(True)} SELECT m.grid_id, a.i::INT AS i, b.j::INT AS j, 0 AS k, (a.i + m.di * b.j)::BIGINT AS cid FROM meta m JOIN range(0, 64) a(i) ON a.i < m.di JOIN range(0, 64) b(j) ON b.j < m.dj")
def grid_cells(spark, sf_dir):
    return index_cells(spark, L.MASK_GRIDS)


@query(f"{L.sql_points()} SELECT grid_id, i, j, k, (flags & 1) <> 0 AS active, (flags & 3) = 3 AS boundary, (flags & 5) = 5 AS internal FROM pts")
def active_masks(spark, sf_dir):
    f = F.col("flags")
    return L.summed(spark, sf_dir).select("grid_id", *IJK, has(f, S.ACTIVE).alias("active"), (has(f, S.ACTIVE) & has(f, S.DOMAIN_BOUNDARY)).alias("boundary"), (has(f, S.ACTIVE) & has(f, S.INTERNAL_BOUNDARY)).alias("internal"))


_CELLS = """corner(a, b) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
cells AS MATERIALIZED (SELECT grid_id, i - a AS ci, j - b AS cj, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, bool_and((flags & 1) = 1) AS active, (max(x) - min(x)) * (max(y) - min(y)) AS volume
  FROM pts, corner GROUP BY grid_id, i - a, j - b HAVING count(*) = 4),
vols AS MATERIALIZED (SELECT grid_id, ci + a AS i, cj + b AS j, avg(volume) AS volume FROM cells, corner GROUP BY grid_id, ci + a, cj + b)"""


def _cells(spark, sf_dir):
    points = L.summed(spark, sf_dir)
    meta = S.grid_table(spark, L.GRIDS)
    return points, meta, cells_of(points, meta, 2)


@query(f"{L.sql_points()}, {_CELLS} SELECT grid_id, ci AS i, cj AS j, active, volume FROM cells")
def cell_active_mask(spark, sf_dir):
    return _cells(spark, sf_dir)[2].select("grid_id", F.col("ci").alias("i"), F.col("cj").alias("j"), "active", "volume")


@query(f"{L.sql_points()}, {_CELLS} SELECT grid_id, i, j, volume FROM vols")
def point_volume(spark, sf_dir):
    _, meta, cells = _cells(spark, sf_dir)
    return point_volumes(cells, meta, 2).select("grid_id", "i", "j", "volume")


_OVERLAP = f"""pairs(m, n) AS (VALUES {', '.join(map(str, _PAIRS))}), lattice(m, ox, oy, sx, sy) AS (VALUES (1, 0.0, 0.0, 1.0, 1.0), (2, 8.25, 4.25, 0.75, 0.75), (3, 30.125, 10.125, 0.5, 0.5)),
near AS (SELECT q.m, q.n, p.i AS ni, p.j AS nj, p.x, p.y, floor((p.x - ox) / sx)::INT - a AS ci, floor((p.y - oy) / sy)::INT - b AS cj FROM pairs q JOIN pts p ON p.grid_id = q.n AND (p.flags & 1) = 1 JOIN lattice l ON l.m = q.m, corner),
hits AS (SELECT h.m, h.n, h.ni, h.nj, h.ci, h.cj, (h.x - c.x0) / (c.x1 - c.x0) AS u, (h.y - c.y0) / (c.y1 - c.y0) AS v
  FROM near h JOIN cells c ON c.grid_id = h.m AND c.ci = h.ci AND c.cj = h.cj AND c.active WHERE h.x BETWEEN c.x0 AND c.x1 AND h.y BETWEEN c.y0 AND c.y1),
over AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, n, ni, nj ORDER BY greatest(abs(u - 0.5), abs(v - 0.5)), cj, ci) AS best FROM hits) WHERE best = 1)"""


def _overlap(spark, sf_dir):
    points, meta, cells = _cells(spark, sf_dir)
    pairs = spark.createDataFrame([(*p, 1e-12) for p in _PAIRS], "m int, n int, tolerance double")
    return points, meta, cells, detect_overlap(points, cells, meta, L.GRIDS, pairs)


@query(f"{L.sql_points()}, {_CELLS}, {_OVERLAP} SELECT m, n, ni, nj, 0 AS nk, ci, cj, 0 AS ck, u, v, 0.0::DOUBLE AS w FROM over")
def overlap_uniform_2d(spark, sf_dir):
    return _overlap(spark, sf_dir)[3]


@query(f"{L.sql_points()}, {_CELLS}, {_OVERLAP} SELECT p.grid_id, p.i, p.j, p.flags | CASE WHEN EXISTS (SELECT 1 FROM over o WHERE o.n = p.grid_id AND o.ni = p.i AND o.nj = p.j) THEN 8 ELSE 0 END AS flags FROM pts p")
def overlapped_flags(spark, sf_dir):
    from ..plans.assembly import receivers_side, update

    points, _, _, overlap = _overlap(spark, sf_dir)
    return update(points, (receivers_side(overlap).select("grid_id", *IJK).distinct(), S.OVERLAPPED, 0)).select("grid_id", "i", "j", "flags")


_CORNERS = """corners AS (SELECT o.m, o.n, o.ni, o.nj, a.a + 2 * b.b AS v, o.ci + a.a AS i, o.cj + b.b AS j,
  (CASE WHEN a.a = 1 THEN o.u ELSE 1.0 - o.u END) * (CASE WHEN b.b = 1 THEN o.v ELSE 1.0 - o.v END) AS weight FROM over o, range(0, 2) a(a), range(0, 2) b(b)),
stencil AS (SELECT c.*, p.value, p.flags FROM corners c JOIN pts p ON p.grid_id = c.m AND p.i = c.i AND p.j = c.j)"""


@query(f"{L.sql_points()}, {_CELLS}, {_OVERLAP}, {_CORNERS} SELECT m, n, ni, nj, sum(weight * volume) AS donor_volume FROM corners c JOIN vols ON vols.grid_id = c.m AND vols.i = c.i AND vols.j = c.j GROUP BY m, n, ni, nj")
def overlap_volumes(spark, sf_dir):
    from ..plans.assembly import Domain
    from ..plans.assembly import overlap_volumes as volumes_of

    points, meta, cells, overlap = _overlap(spark, sf_dir)
    return volumes_of(Domain(spark, L.GRIDS, points), overlap, point_volumes(cells, meta, 2)).select("m", "n", "ni", "nj", "donor_volume")


def _collect_query(op: str, sql: str):
    def f(spark, sf_dir):
        points, meta, _, overlap = _overlap(spark, sf_dir)
        fields = points.select("grid_id", *IJK, "value" if op in ("INTERPOLATE", "MIN", "MAX") else F.expr("flags & 2").alias("value"))
        return X.collect(X.connections_of(overlap), fields, meta, op).select("m", "n", "ni", "nj", "value")

    f.__name__ = f"collect_{op.lower()}"
    f.__doc__ = f"{op} over the stencil of every overlapped point."
    query(f"{L.sql_points()}, {_CELLS}, {_OVERLAP}, {_CORNERS} SELECT m, n, ni, nj, {sql} AS value FROM stencil GROUP BY m, n, ni, nj")(f)


for _op, _sql in {
    "INTERPOLATE": "sum(weight * value)", "NONE": "(NOT bool_or((flags & 2) <> 0))::INT", "ANY": "bool_or((flags & 2) <> 0)::INT", "NOT_ALL": "(NOT bool_and((flags & 2) <> 0))::INT",
    "ALL": "bool_and((flags & 2) <> 0)::INT", "MIN": "min(value)", "MAX": "max(value)",
}.items():
    _collect_query(_op, _sql)


_GOT = """got AS (SELECT m, n, ni, nj, sum(weight * value) AS value FROM stencil GROUP BY m, n, ni, nj),
arrived AS (SELECT n AS grid_id, ni AS i, nj AS j, {how} AS new FROM got GROUP BY n, ni, nj)
SELECT grid_id, i, j, {put} AS value FROM pts LEFT JOIN arrived USING (grid_id, i, j)"""


@query(f"{L.sql_points()}, {_CELLS}, {_OVERLAP}, {_CORNERS}, {_GOT.format(how='arg_max(value, m)', put='coalesce(new, value)')}")
def disperse_overwrite(spark, sf_dir):
    points, meta, _, overlap = _overlap(spark, sf_dir)
    fields = points.select("grid_id", *IJK, "value")
    return X.exchange(X.connections_of(overlap), fields, meta, ordered=True).drop("k")


@query(f"{L.sql_points()}, {_CELLS}, {_OVERLAP}, {_CORNERS}, {_GOT.format(how='sum(value)', put='value + coalesce(new, 0)')}")
def disperse_append(spark, sf_dir):
    points, meta, _, overlap = _overlap(spark, sf_dir)
    fields = points.select("grid_id", *IJK, "value")
    return X.exchange(X.connections_of(overlap), fields, meta, disperse_op="APPEND").drop("k")


def _remap_sql(weight: str) -> str:
    return f"""{L.sql_points()}, {_CELLS}, {_OVERLAP}, {_CORNERS.replace('(CASE WHEN a.a = 1 THEN o.u ELSE 1.0 - o.u END) * (CASE WHEN b.b = 1 THEN o.v ELSE 1.0 - o.v END)', weight)}
SELECT n AS grid_id, ni AS i, nj AS j, sum(weight * value) AS value FROM stencil WHERE m = 1 AND n = 2 GROUP BY n, ni, nj"""


@query(_remap_sql("(CASE WHEN a.a = 1 THEN o.u ELSE 1.0 - o.u END) * (CASE WHEN b.b = 1 THEN o.v ELSE 1.0 - o.v END)"))
def remap_linear(spark, sf_dir):
    """The field of the background on the points of the finer grid, bilinear."""
    return remap_fields(spark, L.GRIDS, L.summed(spark, sf_dir), 1, 2, "LINEAR").select("grid_id", "i", "j", "value")


@query(_remap_sql("(CASE WHEN (o.u > 0.5) = (a.a = 1) AND (o.v > 0.5) = (b.b = 1) THEN 1.0 ELSE 0.0 END)"))
def remap_nearest(spark, sf_dir):
    return remap_fields(spark, L.GRIDS, L.summed(spark, sf_dir), 1, 2, "NEAREST").select("grid_id", "i", "j", "value")


@query(f"{L.sql_points()}, {_CELLS}, {_OVERLAP} SELECT m, n, ni, nj, ci AS begin_i, cj AS begin_j, ci + 2 AS end_i, cj + 2 AS end_j, 1.0 - u AS wi0, u AS wi1, 1.0 - v AS wj0, v AS wj1 FROM over")
def connectivity_rows(spark, sf_dir):
    made = X.connections_of(_overlap(spark, sf_dir)[3])
    ends = [F.col(e)[d].alias(f"{e}_{a}") for e in ("begin", "end") for d, a in enumerate("ij")]
    return made.select("m", "n", "ni", "nj", *ends, *(F.col(f"w{a}")[v].alias(f"w{a}{v}") for a in "ij" for v in (0, 1)))


@query(f"""{L.sql_points()}, rows AS (SELECT i, j, value FROM pts WHERE grid_id = 1)
SELECT 1 AS grid_id, a.i, a.j, CASE WHEN a.j < 16 THEN a.value WHEN a.j = 16 THEN b.value ELSE a.value END AS value FROM rows a JOIN rows b ON b.i = a.i AND b.j = 15
UNION ALL SELECT 2, a.i, a.j - 15, CASE WHEN a.j = 15 THEN b.value ELSE a.value END FROM rows a JOIN rows b ON b.i = a.i AND b.j = 15 WHERE a.j >= 15 AND a.i >= 0""")
def exchange_interface(spark, sf_dir):
    """Two halves of the background, stacked with shared rows, pass their values through connections given by the user."""
    rows = L.summed(spark, sf_dir).where("grid_id = 1").select("i", "j", "k", "value")
    fields = rows.select(F.lit(1).alias("grid_id"), *IJK, "value").unionByName(rows.where("j >= 15").select(F.lit(2).alias("grid_id"), "i", (F.col("j") - 15).alias("j"), "k", "value"))
    one, zero = F.array(F.lit(1.0)), F.lit(0.0)
    end = lambda *x: F.array(*(v + 1 for v in x)).alias("end")
    line = rows.where("j = 0").select("i")
    made = None
    for m, n, donor, receiver in ((1, 2, 15, 0), (1, 1, 15, 16)):
        part = line.select(F.lit(m).alias("m"), F.lit(n).alias("n"), F.col("i").alias("ni"), F.lit(receiver).alias("nj"), F.lit(0).alias("nk"), F.array("i", F.lit(donor), F.lit(0)).alias("begin"),
                           end(F.col("i"), F.lit(donor), F.lit(0)), zero.alias("u"), zero.alias("v"), zero.alias("w"), one.alias("wi"), one.alias("wj"), one.alias("wk"))
        made = part if made is None else made.unionByName(part)
    meta = S.grid_table(spark, [S.Grid(1, (48, 32, 1)), S.Grid(2, (48, 17, 1))])
    return X.exchange(made, fields, meta, ordered=True).drop("k")


_3D = [S.Grid(1, (6, 5, 4), geometry=S.UNIFORM), S.Grid(2, (5, 4, 3), geometry=S.UNIFORM)]


@query("""WITH sums AS (SELECT (user_id % 5)::INT i, (event_id % 4)::INT j, (event_id // 4 % 3)::INT k, count(*) AS s FROM events GROUP BY ALL),
p AS (SELECT a.i::INT AS ni, b.j::INT AS nj, c.k::INT AS nk, 0.5 + 0.75 * a.i AS x, 0.25 + 0.75 * b.j AS y, 0.125 + c.k AS z FROM range(0, 5) a(i), range(0, 4) b(j), range(0, 3) c(k)
  WHERE coalesce((SELECT s FROM sums q WHERE q.i = a.i AND q.j = b.j AND q.k = c.k), 0) % 3 <> 0),
h AS (SELECT *, (x - ci)::DOUBLE AS u, (y - cj)::DOUBLE AS v, (z - ck)::DOUBLE AS w FROM p, (SELECT a.i::INT AS ci, b.j::INT AS cj, c.k::INT AS ck FROM range(0, 5) a(i), range(0, 4) b(j), range(0, 3) c(k))
  WHERE x BETWEEN ci AND ci + 1 AND y BETWEEN cj AND cj + 1 AND z BETWEEN ck AND ck + 1)
SELECT 1 AS m, 2 AS n, ni, nj, nk, ci, cj, ck, u, v, w FROM (SELECT *, row_number() OVER (PARTITION BY ni, nj, nk ORDER BY greatest(abs(u - 0.5), abs(v - 0.5), abs(w - 0.5)), ck, cj, ci) AS r FROM h) WHERE r = 1""")
def overlap_uniform_3d(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy(F.expr("cast(user_id % 5 as int)").alias("i"), F.expr("cast(event_id % 4 as int)").alias("j"), F.expr("cast((event_id div 4) % 3 as int)").alias("k")).agg(F.count("*").alias("s"))
    points = analytic_points(spark, _3D, {1: ("i", "j", "k"), 2: ("0.5 + 0.75 * i", "0.25 + 0.75 * j", "0.125 + k")})
    live = (F.col("grid_id") == 1) | (F.coalesce("s", F.lit(0)) % 3 != 0)
    points = points.drop("flags").join(sums, IJK, "left").withColumn("flags", F.when(live, 1).otherwise(0)).drop("s")
    meta = S.grid_table(spark, _3D)
    return detect_overlap(points, cells_of(points, meta, 3), meta, _3D, spark.createDataFrame([(1, 2, 1e-12)], "m int, n int, tolerance double"))


def _overlap_of(spark, points, grids):
    meta = S.grid_table(spark, grids)
    return detect_overlap(points, cells_of(points, meta, 2), meta, grids, spark.createDataFrame([(1, 2, 1e-12)], "m int, n int, tolerance double")).drop("w", "nk", "ck")


def _moved(spark, sf_dir, kind, x, y):
    grids = [S.Grid(1, (48, 32, 1), geometry=kind), S.Grid(2, (24, 20, 1), geometry=S.UNIFORM)]
    points = L.summed(spark, sf_dir).where("grid_id < 3").withColumn("x", F.expr(f"case when grid_id = 1 then cast({x} as double) else x end")).withColumn("y", F.expr(f"case when grid_id = 1 then cast({y} as double) else y end"))
    return _overlap_of(spark, points, grids)


_BEST = "SELECT 1 AS m, 2 AS n, ni, nj, ci, cj, u, v FROM (SELECT *, row_number() OVER (PARTITION BY ni, nj ORDER BY greatest(abs(u - 0.5), abs(v - 0.5)), cj, ci) AS r FROM h) WHERE r = 1"


@query(f"""{L.sql_points()}, {_CELLS}, h AS (SELECT p.i AS ni, p.j AS nj, ci, cj, (p.x + p.y) / 2 - 4 - ci AS u, (p.y - p.x) / 2 + 16 - cj AS v FROM pts p, cells c WHERE p.grid_id = 2 AND (p.flags & 1) = 1 AND c.grid_id = 1 AND c.active
  AND (p.x + p.y) / 2 - 4 - ci BETWEEN 0 AND 1 AND (p.y - p.x) / 2 + 16 - cj BETWEEN 0 AND 1)
{_BEST}""")
def overlap_oriented_2d(spark, sf_dir):
    """The background turned by 45 degrees: x = (i - j) + 20, y = (i + j) - 12."""
    return _moved(spark, sf_dir, S.ORIENTED_UNIFORM, "i - j + 20", "i + j - 12")


@query(f"""{L.sql_points()}, {_CELLS}, h AS (SELECT p.i AS ni, p.j AS nj, ci, cj, (p.x - ci * ci / 16.0) / ((ci + 1) * (ci + 1) / 16.0 - ci * ci / 16.0) AS u, (p.y - cj) / 1.0 AS v FROM pts p, cells c
  WHERE p.grid_id = 2 AND (p.flags & 1) = 1 AND c.grid_id = 1 AND c.active AND p.x BETWEEN ci * ci / 16.0 AND (ci + 1) * (ci + 1) / 16.0 AND p.y BETWEEN cj AND cj + 1)
{_BEST}""")
def overlap_rectilinear_2d(spark, sf_dir):
    return _moved(spark, sf_dir, S.RECTILINEAR, "i * i / 16.0D", "j")


@query(f"""{L.sql_points()}, {_CELLS}, h AS (SELECT p.i AS ni, p.j AS nj, ci, cj, (p.x - 0.03125 + p.y) / 2 - 4 - ci AS u, (p.y - p.x + 0.03125) / 2 + 16 - cj AS v FROM pts p, cells c WHERE p.grid_id = 2 AND (p.flags & 1) = 1 AND c.grid_id = 1 AND c.active
  AND (p.x - 0.03125 + p.y) / 2 - 4 - ci BETWEEN 0 AND 1 AND (p.y - p.x + 0.03125) / 2 + 16 - cj BETWEEN 0 AND 1), best AS ({_BEST})
SELECT m, n, ni, nj, ci, cj, round(u, 6) AS u, round(v, 6) AS v FROM best""")
def overlap_curvilinear_2d(spark, sf_dir):
    """The turned background, moved by 1/32 so that no point lies on an edge, as a curvilinear grid: containment by triangles, local coordinates by the cubic inverse."""
    found = _moved(spark, sf_dir, S.CURVILINEAR, "i - j + 20.03125D", "i + j - 12")
    return found.withColumn("u", F.round("u", 6)).withColumn("v", F.round("v", 6))


@query("""WITH d AS (SELECT l_partkey % 3 + 1 AS m, l_orderkey * 8 + l_linenumber AS id, l_partkey % 40 AS ci, l_suppkey % 30 AS cj FROM lineitem)
SELECT m::INT AS m, (o_orderkey % 3 + 1)::INT AS n, (o_custkey % 24)::INT AS ni, (o_orderkey % 20)::INT AS nj, ci::INT AS begin_i, (ci + 2)::INT AS end_i, (cj + 1)::INT AS end_j FROM d JOIN orders ON o_orderkey * 8 + 1 = id""")
def import_connectivity_match(spark, sf_dir):
    """Donor and receiver records, as a connectivity file holds them, matched by connection id."""
    from ..sources.connectivity import match

    ids = F.expr("l_orderkey * 8 + l_linenumber").alias("connection_id")
    one, w = F.lit(0.5), F.array(F.lit(0.5), F.lit(0.5))
    donors = table(spark, sf_dir, "lineitem").select(
        F.expr("cast(l_partkey % 3 + 1 as int)").alias("grid_id"), ids, F.expr("array(cast(l_partkey % 40 as int), cast(l_suppkey % 30 as int), 0)").alias("begin"), F.expr("array(2, 1, 1)").alias("size"),
        one.alias("u"), one.alias("v"), one.alias("w"), F.array(w, F.array(F.lit(1.0)), F.array(F.lit(1.0))).alias("coefs"),
    )
    receivers = table(spark, sf_dir, "orders").select(
        F.expr("cast(o_orderkey % 3 + 1 as int)").alias("grid_id"), F.expr("o_orderkey * 8 + 1").alias("connection_id"), F.expr("cast(o_custkey % 24 as int)").alias("ni"), F.expr("cast(o_orderkey % 20 as int)").alias("nj"), F.lit(0).alias("nk"),
    )
    made = match(donors, receivers)
    return made.select("m", "n", "ni", "nj", F.col("begin")[0].alias("begin_i"), F.col("end")[0].alias("end_i"), F.col("end")[1].alias("end_j"))
