"""Points, cells and volumes of structured grids as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.newton import tensor_offsets
from ..operators.masks import IJK
from ..schema import ACTIVE, GEOMETRIES, Grid


#: Points of one task's piece of a grid.
PIECE = 1 << 20


def index_points(spark: SparkSession, grids: list[Grid]) -> DataFrame:
    """(grid_id, i, j, k, pid) of every point, i fastest. One plan for all grids: one row for each grid becomes rows for its pieces, which are dealt out and become points."""
    rows = [(g.grid_id, *g.begin, g.size(0), g.size(1), g.size(0) * g.size(1) * g.size(2)) for g in grids]
    table = spark.createDataFrame(rows, "grid_id int, bi int, bj int, bk int, ni long, nj long, n long")
    pieces = table.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {PIECE})")))
    if sum(r[-1] for r in rows) > PIECE:
        pieces = pieces.repartition("grid_id", "piece")
    pid = pieces.withColumn("pid", F.explode(F.expr(f"sequence(piece * {PIECE}, least(n, (piece + 1) * {PIECE}) - 1)")))
    return pid.select(
        "grid_id", F.expr("cast(pid % ni + bi as int)").alias("i"), F.expr("cast((pid div ni) % nj + bj as int)").alias("j"), F.expr("cast(pid div (ni * nj) + bk as int)").alias("k"), "pid"
    )


def index_cells(spark: SparkSession, grids: list[Grid]) -> DataFrame:
    """(grid_id, i, j, k, cid) of every cell; cid is the linear index within the range of cells."""
    shrunk = [Grid(g.grid_id, tuple(g.cell_end(d) for d in range(3)), g.begin, num_dims=g.num_dims) for g in grids]
    return index_points(spark, shrunk).withColumnRenamed("pid", "cid")


def default_points(spark: SparkSession, grids: list[Grid]) -> DataFrame:
    """Points whose coordinates are their indices and whose flags say ACTIVE, until other columns are put in their place."""
    return index_points(spark, grids).select("grid_id", *IJK, *(F.col(a).cast("double").alias(x) for a, x in zip(IJK, "xyz")), F.lit(ACTIVE).alias("flags"))


def analytic_points(spark: SparkSession, grids: list[Grid], coords: dict[int, tuple], flags=None) -> DataFrame:
    """Points with coordinates given for each grid as three expressions of i, j and k."""
    parts = []
    for g in grids:
        x, y, z = (c if isinstance(c, Column) else F.expr(str(c)) for c in coords[g.grid_id])
        parts.append(index_points(spark, [g]).select("grid_id", *IJK, x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), (F.lit(ACTIVE) if flags is None else flags).cast("int").alias("flags")))
    return reduce(DataFrame.unionByName, parts)


def _cell_corners(meta: DataFrame, points: DataFrame, dims: int) -> DataFrame:
    """Each point as corner v of the cells around it: (grid_id, ci, cj, ck, v, x, y, z, active)."""
    out = points.join(F.broadcast(meta), "grid_id")
    corners = F.array(*(F.struct(F.lit(v).alias("v"), *(F.lit(o).alias(f"o{a}") for a, o in zip(IJK, offset))) for v, offset in enumerate(tensor_offsets(2, dims))))
    out = out.withColumn("_o", F.explode(corners))
    for a in IJK:
        c = F.col(a) - F.col(f"_o.o{a}")
        wraps = F.col(f"per_{a}") & ~F.col("duplicated") & (c < F.col(f"b{a}"))
        out = out.withColumn(f"c{a}", F.when(wraps, c + F.col(f"q{a}")).otherwise(c).cast("int"))
    # a corner read across the period lies one periodic length further on
    moved = [(F.col(x) + F.when((F.col(f"c{a}") > F.col(a)), F.col(f"l{x}")).otherwise(0.0)).alias(x) for a, x in zip(IJK, "xyz")]
    inside = reduce(lambda p, q: p & q, ((F.col(f"c{a}") >= F.col(f"b{a}")) & (F.col(f"c{a}") < F.col(f"d{a}")) for a in IJK))
    return out.where(inside).select("grid_id", "geometry", "ci", "cj", "ck", F.col("_o.v").alias("v"), *moved, (F.col("flags").bitwiseAND(F.lit(ACTIVE)) != 0).alias("active"))


def by_geometry(build) -> Column:
    """build(geometry) for the geometry of each row."""
    out = None
    for g in GEOMETRIES:
        out = F.when(F.col("geometry") == g, build(g)) if out is None else out.when(F.col("geometry") == g, build(g))
    return out


def cells_of(points: DataFrame, meta: DataFrame, dims: int) -> DataFrame:
    """One row per cell: grid_id, geometry, ci, cj, ck, nodes (2^d structs, i fastest), active (all corners are), volume and bounds lo_*, hi_*. One shuffle."""
    corners = _cell_corners(meta, points, dims)
    packed = corners.groupBy("grid_id", "geometry", "ci", "cj", "ck").agg(
        F.sort_array(F.collect_list(F.struct("v", "x", "y", "z"))).alias("nodes"), F.bool_and("active").alias("active"), F.count("*").alias("_n")
    )
    nodes = geometry.nodes_of("nodes", 2**dims, dims)
    bounds = geometry.bounds(nodes)
    out = packed.where(F.col("_n") == 2**dims).withColumn("volume", by_geometry(lambda g: geometry.volume(g, nodes)))
    for x, (lo, hi) in zip("xyz", bounds):
        out = out.withColumn(f"lo_{x}", lo).withColumn(f"hi_{x}", hi)
    return out.drop("_n")


def point_volumes(cells: DataFrame, meta: DataFrame, dims: int) -> DataFrame:
    """(grid_id, i, j, k, volume): the mean volume of the cells around each point, inactive ones included."""
    offsets = F.array(*(F.struct(*(F.lit(o).alias(f"o{a}") for a, o in zip(IJK, offset))) for offset in tensor_offsets(2, dims)))
    out = cells.select("grid_id", "ci", "cj", "ck", "volume").join(F.broadcast(meta), "grid_id").withColumn("_o", F.explode(offsets))
    for a in IJK:
        p = F.col(f"c{a}") + F.col(f"_o.o{a}")
        p = F.when(F.col(f"per_{a}"), F.pmod(p - F.col(f"b{a}"), F.col(f"q{a}")) + F.col(f"b{a}")).otherwise(p).cast("int")
        twin = F.col("duplicated") & F.col(f"per_{a}") & (p == F.col(f"b{a}"))
        out = out.withColumn(a, F.explode(F.when(twin, F.array(p, F.col(f"e{a}") - 1)).otherwise(F.array(p))))
    return out.groupBy("grid_id", *IJK).agg(F.avg("volume").alias("volume"))


def corners_of(rows: DataFrame, meta: DataFrame, dims: int, grid: str = "m", cell=("ci", "cj", "ck")) -> DataFrame:
    """Each row once for each corner of its cell: adds v (corner number), a vertex's grid_id, i, j, k (wrapped)."""
    offsets = F.array(*(F.struct(F.lit(v).alias("v"), *(F.lit(o).alias(f"o{a}") for a, o in zip(IJK, offset))) for v, offset in enumerate(tensor_offsets(2, dims))))
    names = rows.columns
    small = meta.select(F.col("grid_id").alias("_g"), *(F.col(f"{p}{a}").alias(f"_{p}{a}") for p in ("b", "e", "per_", "q") for a in IJK))
    out = rows.withColumn("_o", F.explode(offsets)).join(F.broadcast(small), F.col(grid) == F.col("_g"))
    vertex = []
    for a, c in zip(IJK, cell):
        p = F.col(c) + F.col(f"_o.o{a}")
        vertex.append(F.when(F.col(f"_per_{a}") & (p >= F.col(f"_e{a}")), p - F.col(f"_q{a}")).otherwise(p).cast("int").alias(a))
    return out.select(*names, F.col("_o.v").alias("v"), F.col(grid).alias("grid_id"), *vertex)
