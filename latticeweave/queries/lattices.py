"""Structured grids made from the driver's tables, as DataFrames and as SQL.

Each grid's points get a number s from one table, summed over the rows that fall on the point: its flags and its field follow from s. Coordinates
are multiples of 1/16, so both engines compute the same doubles. The sums are partial aggregates over the whole table; what is left has one row per point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.grids import analytic_points
from .registry import table

BACK, FRONT, RING = 1, 2, 3
#: 2-D: a background, a finer grid over it (turned round along i in the mask queries), and one whose last column repeats the first.
GRIDS = [S.Grid(BACK, (48, 32, 1), geometry=S.UNIFORM), S.Grid(FRONT, (24, 20, 1), geometry=S.UNIFORM), S.Grid(RING, (13, 9, 1), geometry=S.UNIFORM)]
MASK_GRIDS = [GRIDS[0], S.Grid(FRONT, (24, 20, 1), periodic=(True, False, False), geometry=S.UNIFORM), S.Grid(RING, (13, 9, 1), periodic=(False, True, False), storage=S.DUPLICATED, geometry=S.UNIFORM)]
COORDS = {BACK: ("i", "j", "0"), FRONT: ("8.25 + 0.75 * i", "4.25 + 0.75 * j", "0"), RING: ("30.125 + 0.5 * i", "10.125 + 0.5 * j", "0")}

_SUMS = {
    BACK: ("lineitem", "l_partkey % 48", "l_suppkey % 32", "sum(cast(l_quantity as bigint))"),
    FRONT: ("orders", "o_custkey % 24", "o_orderkey % 20", "sum(cast(floor(o_totalprice) as bigint))"),
    RING: ("events", "user_id % 13", "event_id % 8", "sum(cast(floor(value) as bigint))"),
}
FLAGS = "case when s % 4 <> 0 then 1 else 0 end + case when s % 7 = 0 then 2 else 0 end + case when s % 11 = 0 then 4 else 0 end"
#: For whole assemblies: few points are inactive or on a boundary, so that occlusion leaves something to do.
CALM = "case when s % 61 <> 0 then 1 else 0 end + case when s % 47 = 0 then 2 else 0 end + case when s % 53 = 0 then 4 else 0 end"


def summed(spark: SparkSession, sf_dir: str, wrapped: bool = False, flags: str = FLAGS) -> DataFrame:
    """(grid_id, i, j, k, x, y, z, s, flags, value); wrapped: the third grid's last column is the first again."""
    points = analytic_points(spark, GRIDS, COORDS).drop("flags")
    rows = None
    for g, (name, i, j, s) in _SUMS.items():
        one = table(spark, sf_dir, name).groupBy(F.expr(f"cast({i} as int)").alias("_i"), F.expr(f"cast({j} as int)").alias("_j")).agg(F.expr(s).alias("s")).withColumn("_g", F.lit(g))
        rows = one if rows is None else rows.unionByName(one)
    j = F.when(F.col("grid_id") == RING, F.col("j") % 8).otherwise(F.col("j")) if wrapped else F.col("j")
    met = points.join(rows, (F.col("grid_id") == F.col("_g")) & (F.col("i") == F.col("_i")) & (j == F.col("_j")), "left")
    met = met.withColumn("s", F.coalesce("s", F.lit(1)))
    return met.select("grid_id", "i", "j", "k", "x", "y", "z", "s", F.expr(flags).cast("int").alias("flags"), F.expr("cast(s % 1000 as double)").alias("value"))


def sql_points(wrapped: bool = False, flags: str = FLAGS) -> str:
    """CTEs up to pts (grid_id, i, j, k, x, y, s, flags, value) and meta (grid_id, ni, nj, per_i, per_j, qi, qj, pair ends of cells di, dj)."""
    sums = " UNION ALL ".join(f"SELECT {g} AS g, ({i})::INT AS i, ({j})::INT AS j, {s}::BIGINT AS s FROM {name} GROUP BY 2, 3" for g, (name, i, j, s) in _SUMS.items())
    grids = MASK_GRIDS if wrapped else GRIDS
    meta = ", ".join(f"({g.grid_id}, {g.size(0)}, {g.size(1)}, {g.periodic[0]}, {g.periodic[1]}, {g.period(0)}, {g.period(1)}, {g.cell_end(0)}, {g.cell_end(1)})" for g in grids)
    x, y = (" ".join(f"WHEN {g} THEN {COORDS[g][d]}" for g in COORDS) for d in (0, 1))
    at = "CASE WHEN m.grid_id = 3 THEN b.j % 8 ELSE b.j END" if wrapped else "b.j"
    return f"""WITH RECURSIVE meta(grid_id, ni, nj, per_i, per_j, qi, qj, di, dj) AS (VALUES {meta}), sums AS MATERIALIZED ({sums}),
pts0 AS (SELECT m.grid_id, a.i::INT AS i, b.j::INT AS j, coalesce(q.s, 1) AS s FROM meta m JOIN range(0, 64) a(i) ON a.i < m.ni JOIN range(0, 64) b(j) ON b.j < m.nj
  LEFT JOIN sums q ON q.g = m.grid_id AND q.i = a.i AND q.j = {at}),
pts AS MATERIALIZED (SELECT grid_id, i, j, 0 AS k, (CASE grid_id {x} END)::DOUBLE AS x, (CASE grid_id {y} END)::DOUBLE AS y, s, ({flags})::INT AS flags, (s % 1000)::DOUBLE AS value FROM pts0)"""
