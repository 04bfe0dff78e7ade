"""Mask operators over the wrapped lattices. The SQL looks at each point's neighbours (a gather), the operators scatter true points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text
from ..functions.index import has
from ..operators import masks as M
from . import lattices as L
from .registry import query

CONDITIONS = (M.FALSE, M.TRUE, M.MIRROR)


def _mask(spark, sf_dir):
    points = L.summed(spark, sf_dir, wrapped=True)
    return points.where(has(F.col("flags"), S.ACTIVE)).select("grid_id", *M.IJK), S.grid_table(spark, L.MASK_GRIDS)


def _conditions(build) -> DataFrame:
    return reduce(DataFrame.unionByName, (build(bc).withColumn("bc", F.lit(bc)) for bc in CONDITIONS)).drop("k")


def _keys(spark):
    return spark.createDataFrame([(g.grid_id,) for g in L.MASK_GRIDS], "grid_id int")


def _neighbours(radius: int, points: str = "pts") -> str:
    """CTE nbr: each point, boundary condition and neighbour's value."""
    wrap = lambda a, n, q: f"CASE WHEN m.per_{a} AND (p.{a} + o.{a} < 0 OR p.{a} + o.{a} >= m.{n}) THEN ((p.{a} + o.{a}) % m.{q} + m.{q}) % m.{q} WHEN b.bc = 'MIRROR' THEN greatest(0, least(m.{n} - 1, p.{a} + o.{a})) ELSE p.{a} + o.{a} END"
    return f"""off AS (SELECT a.i::INT AS i, b.j::INT AS j FROM range({-radius}, {radius + 1}) a(i), range({-radius}, {radius + 1}) b(j)), bcs(bc) AS (VALUES ('FALSE'), ('TRUE'), ('MIRROR')),
nbr AS (SELECT p.grid_id, p.i, p.j, b.bc, o.i = 0 AND o.j = 0 AS self, coalesce((p.flags & 1) = 1, false) AS own, coalesce((q.flags & 1) = 1, b.bc = 'TRUE') AS value
  FROM {points} p JOIN meta m USING (grid_id) CROSS JOIN off o CROSS JOIN bcs b
  LEFT JOIN pts q ON q.grid_id = p.grid_id AND q.i = {wrap('i', 'ni', 'qi')} AND q.j = {wrap('j', 'nj', 'qj')})"""


_SEEN = "seen AS (SELECT grid_id, i, j, bc, any_value(own) AS own, bool_or(value) AS any_true, bool_and(value) AS every FROM nbr GROUP BY grid_id, i, j, bc)"


def _sql(radius: int, where: str) -> str:
    return f"{L.sql_points(True)}, {_neighbours(radius)}, {_SEEN} SELECT grid_id, i, j, bc FROM seen WHERE {where}"


@query(f"{L.sql_points(True)} SELECT grid_id, count(*) AS n FROM pts WHERE (flags & 1) = 1 GROUP BY grid_id")
def mask_count(spark, sf_dir):
    return M.count_true(_mask(spark, sf_dir)[0])


@query(_sql(1, "own AND NOT every"))
def mask_edge_inner(spark, sf_dir):
    mask, meta = _mask(spark, sf_dir)
    return _conditions(lambda bc: M.inner_edge(mask, meta, bc))


@query(_sql(1, "any_true AND NOT own"))
def mask_edge_outer(spark, sf_dir):
    mask, meta = _mask(spark, sf_dir)
    return _conditions(lambda bc: M.outer_edge(mask, meta, bc, keys=_keys(spark)))


_RING = """ringed AS (SELECT m.grid_id, a.i::INT AS i, b.j::INT AS j, p.flags FROM meta m JOIN range(-1, 65) a(i) ON a.i >= CASE WHEN m.per_i THEN 0 ELSE -1 END AND a.i <= CASE WHEN m.per_i THEN m.ni - 1 ELSE m.ni END
  JOIN range(-1, 65) b(j) ON b.j >= CASE WHEN m.per_j THEN 0 ELSE -1 END AND b.j <= CASE WHEN m.per_j THEN m.nj - 1 ELSE m.nj END LEFT JOIN pts p ON p.grid_id = m.grid_id AND p.i = a.i AND p.j = b.j)"""


@query(f"{L.sql_points(True)}, {_RING}, {_neighbours(1, 'ringed')}, {_SEEN} SELECT grid_id, i, j FROM seen WHERE bc = 'FALSE' AND any_true AND NOT own")
def mask_edge_exterior(spark, sf_dir):
    """The outer edge with the ring of points just outside the grids."""
    mask, meta = _mask(spark, sf_dir)
    return M.outer_edge(mask, meta, M.FALSE, exterior=True).drop("k")


@query(f"""{L.sql_points(True)}, {_RING}, {_neighbours(1, 'ringed')}, seen AS (SELECT grid_id, i, j, bc, bool_or(value) FILTER (self) AS own, bool_or(value) AS any_true, bool_and(value) AS every FROM nbr GROUP BY grid_id, i, j, bc)
SELECT grid_id, i, j, bc, 'OUTER' AS edge FROM seen WHERE any_true AND NOT own UNION ALL SELECT grid_id, i, j, bc, 'INNER' FROM seen WHERE own AND NOT every""")
def mask_edge_exterior_all(spark, sf_dir):
    """Both edges with the ring of points outside, whose values are the boundary condition's."""
    mask, meta = _mask(spark, sf_dir)
    outer = _conditions(lambda bc: M.outer_edge(mask, meta, bc, exterior=True, keys=_keys(spark))).withColumn("edge", F.lit("OUTER"))
    return outer.unionByName(_conditions(lambda bc: M.inner_edge(mask, meta, bc, exterior=True, keys=_keys(spark))).withColumn("edge", F.lit("INNER")))


@query(f"{L.sql_points(True)} SELECT grid_id, j, string_agg(' ' || (CASE WHEN length((s % 100)::VARCHAR) >= 2 THEN (s % 100)::VARCHAR ELSE lpad((s % 100)::VARCHAR, 2, ' ') END) || ' ', '' ORDER BY i) AS line FROM pts GROUP BY grid_id, j")
def print_field(spark, sf_dir):
    """Each row of points as a line of text."""
    points = L.summed(spark, sf_dir, wrapped=True)
    return text.print_field(points.select("grid_id", *M.IJK, (F.col("s") % 100).alias("value")), width=2).drop("k")


@query(_sql(2, "any_true"))
def mask_dilate(spark, sf_dir):
    mask, meta = _mask(spark, sf_dir)
    return _conditions(lambda bc: M.dilate(mask, meta, 2, bc, keys=_keys(spark)))


@query(_sql(1, "every"))
def mask_erode(spark, sf_dir):
    mask, meta = _mask(spark, sf_dir)
    return _conditions(lambda bc: M.erode(mask, meta, 1, bc))


@query(f"""{L.sql_points(True)}, {_neighbours(1)}, {_SEEN}, edge AS (SELECT grid_id, i, j FROM seen WHERE bc = 'FALSE' AND own AND NOT every),
far AS (SELECT p.grid_id, p.i, p.j, any_value(p.flags & 1) AS own, min(greatest(CASE WHEN m.per_i THEN least((p.i - e.i + m.qi) % m.qi, (e.i - p.i + m.qi) % m.qi) ELSE abs(p.i - e.i) END,
  CASE WHEN m.per_j THEN least((p.j - e.j + m.qj) % m.qj, (e.j - p.j + m.qj) % m.qj) ELSE abs(p.j - e.j) END)) AS d FROM pts p JOIN meta m USING (grid_id) JOIN edge e USING (grid_id) GROUP BY p.grid_id, p.i, p.j)
SELECT grid_id, i, j, (CASE WHEN own = 1 THEN -d ELSE d END)::INT AS distance FROM far WHERE d < 3""")
def mask_distance(spark, sf_dir):
    mask, meta = _mask(spark, sf_dir)
    return M.receiver_distance(mask, meta, 3).drop("k")


_STEP = """(SELECT p.grid_id, p.i, p.j, q.i AS qi, q.j AS qj FROM pts p JOIN meta m USING (grid_id) CROSS JOIN (SELECT a.i::INT AS i, b.j::INT AS j FROM range(-1, 2) a(i), range(-1, 2) b(j)) o JOIN pts q ON q.grid_id = p.grid_id
  AND q.i = CASE WHEN m.per_i AND (p.i + o.i < 0 OR p.i + o.i >= m.ni) THEN (p.i + o.i + m.qi) % m.qi ELSE p.i + o.i END AND q.j = CASE WHEN m.per_j AND (p.j + o.j < 0 OR p.j + o.j >= m.nj) THEN (p.j + o.j + m.qj) % m.qj ELSE p.j + o.j END
  WHERE {same} UNION SELECT grid_id, i, 0, i, 8 FROM pts WHERE grid_id = 3 AND j = 0 AND {own} UNION SELECT grid_id, i, 8, i, 0 FROM pts WHERE grid_id = 3 AND j = 0 AND {own})"""


@query(f"""{L.sql_points(True)}, step AS MATERIALIZED {_STEP.format(same="(p.s % 2) = (q.s % 2) AND p.grid_id > 1", own="true")},
reach AS (SELECT grid_id, i, j, i AS ri, j AS rj FROM pts WHERE grid_id > 1 UNION SELECT s.grid_id, s.qi, s.qj, r.ri, r.rj FROM reach r JOIN step s ON s.grid_id = r.grid_id AND s.i = r.i AND s.j = r.j),
root AS (SELECT grid_id, i, j, min(ri + ni * rj) AS root FROM reach JOIN meta USING (grid_id) GROUP BY grid_id, i, j)
SELECT grid_id, i, j, s % 2 = 0 AS value, (dense_rank() OVER (PARTITION BY grid_id ORDER BY root) - 1)::INT AS label FROM root JOIN pts USING (grid_id, i, j)""")
def mask_components(spark, sf_dir):
    """Labels of the regions of equal value, of both values, on the two smaller grids."""
    points = L.summed(spark, sf_dir, wrapped=True).where("grid_id > 1").select("grid_id", *M.IJK, (F.col("s") % 2 == 0).alias("value"))
    return M.components(points, S.grid_table(spark, L.MASK_GRIDS)).drop("k")


@query(f"""{L.sql_points(True)}, step AS MATERIALIZED {_STEP.format(same="(p.flags & 1) = 1 AND (q.flags & 1) = 1", own="(flags & 1) = 1")},
reach AS (SELECT grid_id, i, j FROM pts WHERE (flags & 3) = 3 UNION SELECT s.grid_id, s.qi, s.qj FROM reach r JOIN step s ON s.grid_id = r.grid_id AND s.i = r.i AND s.j = r.j)
SELECT grid_id, i, j FROM reach""")
def mask_flood(spark, sf_dir):
    """Active boundary points flood everything they reach through active points."""
    points = L.summed(spark, sf_dir, wrapped=True)
    seeds = points.where(has(F.col("flags"), S.ACTIVE) & has(F.col("flags"), S.DOMAIN_BOUNDARY)).select("grid_id", *M.IJK)
    barrier = points.where(~has(F.col("flags"), S.ACTIVE)).select("grid_id", *M.IJK)
    return M.flood(seeds, barrier, S.grid_table(spark, L.MASK_GRIDS)).drop("k")
