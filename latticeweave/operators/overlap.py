"""Overlap detection: for each allowed pair of grids (m, n), the cell of m that holds each active point of n.

A range join would be a nested loop, so cells are dealt to the bins of uniform lattices that their boxes touch; a point lies
in exactly one bin of each lattice, and the join is on the bin. What is left is tested exactly. There is a lattice for each size of cells, direction by direction, in
powers of ``STEP`` of the mean box (times ``bin_scale``): every cell lies on the lattice of its own size, where it touches two bins along a direction at
most and few cells share one, so stretched grids make neither crowded bins nor cells in many of them. A point asks all
sizes that its partner grid has, a number that grows with the logarithm of the stretching.

Of several cells the best is kept: one with local coordinates within [0, 1], nearest to its own middle; else the
one least outside; ties go to the lowest cell index. Points with coordinates that are null, not a number or infinite are never found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.newton import inverse_udf, tensor_offsets
from ..schema import ACTIVE, CURVILINEAR, Grid
from .masks import IJK

XYZ = ("x", "y", "z")


#: Ratio of one lattice's bins to the next finer one's.
STEP = 4.0


def _bin_table(cells: DataFrame, dims: int, bin_scale: float) -> DataFrame:
    """One row per grid: the edge of its middle lattice's bins along each direction."""
    sizes = [F.avg(F.col(f"hi_{x}") - F.col(f"lo_{x}")) for x in XYZ[:dims]]
    return cells.groupBy(F.col("grid_id").alias("m")).agg(*(F.when(s > 0, 2.0 * bin_scale * s).otherwise(1.0).alias(f"s{x}") for s, x in zip(sizes, XYZ)))


def _bin(x, edge, level):
    return F.floor(x / (edge * F.pow(F.lit(STEP), level)))


def candidates(points: DataFrame, cells: DataFrame, pairs: DataFrame, dims: int, bin_scale: float = 1.0) -> DataFrame:
    """(point of n, cell of m) where m's widened box holds the point: m, n, ni, nj, nk, px, py, pz, tolerance and the cell's columns."""
    xyz = XYZ[:dims]
    live = cells.where("active")
    bins = _bin_table(live, dims, bin_scale)
    widest = pairs.groupBy("m").agg(F.max("tolerance").alias("_wide"))
    boxes = live.withColumnRenamed("grid_id", "m").join(F.broadcast(widest), "m").join(F.broadcast(bins), "m")
    for x in xyz:
        middle, half = 0.5 * (F.col(f"lo_{x}") + F.col(f"hi_{x}")), 0.5 * (F.col(f"hi_{x}") - F.col(f"lo_{x}")) * (1.0 + 2.0 * F.col("_wide"))
        boxes = boxes.withColumn(f"lo_{x}", middle - half).withColumn(f"hi_{x}", middle + half)
        width = F.col(f"hi_{x}") - F.col(f"lo_{x}")
        level = F.ceil(F.log(width / F.col(f"s{x}")) / F.log(F.lit(STEP)))
        boxes = boxes.withColumn(f"_l{x}", F.when(width > 0, F.greatest(F.lit(-20), level)).otherwise(-20).cast("int"))  # 4^-20 of the mean: as good as a point
    levels = [f"_l{x}" for x in xyz]
    present = boxes.select("m", *levels).distinct()  # sizes of cells, not cells
    for x in xyz:
        first, last = (_bin(F.col(f"{e}_{x}"), F.col(f"s{x}"), F.col(f"_l{x}")) for e in ("lo", "hi"))
        boxes = boxes.withColumn(f"_b{x}", F.explode(F.sequence(first, last)))
    boxes = boxes.drop("_wide", "volume", "active", *(f"s{x}" for x in xyz))
    fine = reduce(lambda a, b: a & b, (~geometry.is_missing(F.col(x)) for x in xyz))
    found = points.where((F.col("flags").bitwiseAND(F.lit(ACTIVE)) != 0) & fine)
    found = found.select(F.col("grid_id").alias("n"), *(F.col(a).alias(f"n{a}") for a in IJK), *(F.col(x).alias(f"p{x}") for x in XYZ))
    found = found.join(F.broadcast(pairs.select("m", "n", "tolerance")), "n").join(F.broadcast(bins), "m").join(F.broadcast(present), "m")
    found = found.select("m", "n", *(f"n{a}" for a in IJK), *(f"p{x}" for x in XYZ), "tolerance", *levels, *(_bin(F.col(f"p{x}"), F.col(f"s{x}"), F.col(f"_l{x}")).alias(f"_b{x}") for x in xyz))
    met = found.join(boxes, ["m", *levels, *(f"_b{x}" for x in xyz)]).drop(*levels, *(f"_b{x}" for x in xyz))
    within = reduce(lambda a, b: a & b, (F.col(f"p{x}").between(F.col(f"lo_{x}"), F.col(f"hi_{x}")) for x in xyz))
    return met.where(within).drop(*(f"{e}_{x}" for e in ("lo", "hi") for x in xyz))


def _stencils(cells: DataFrame, points: DataFrame, meta: DataFrame, dims: int) -> DataFrame:
    """For the given cells (m, ci, cj, ck): the flat coordinates of their 4^d points and the shift (s*) of the local coordinates. Cells of grids with under four points have none."""
    rows = cells.join(F.broadcast(meta.withColumnRenamed("grid_id", "m")), "m")
    for d, a in enumerate(IJK):
        if d >= dims:
            rows = rows.withColumn(f"_f{a}", F.col(f"b{a}")).withColumn(f"s{a}", F.lit(0))
            continue
        first = F.col(f"c{a}") - 1
        held = F.when(F.col(f"per_{a}"), first).otherwise(F.greatest(F.col(f"b{a}"), F.least(first, F.col(f"e{a}") - 4)))
        rows = rows.where(F.col(f"per_{a}") | (F.col(f"e{a}") - F.col(f"b{a}") >= 4))
        rows = rows.withColumn(f"_f{a}", held).withColumn(f"s{a}", (held - first).cast("int"))
    offsets = F.array(*(F.struct(F.lit(v).alias("v"), *(F.lit(o).alias(f"o{a}") for a, o in zip(IJK, offset))) for v, offset in enumerate(tensor_offsets(4, dims))))
    rows = rows.withColumn("_o", F.explode(offsets))
    for a, x in zip(IJK, XYZ):
        raw = F.col(f"_f{a}") + F.col(f"_o.o{a}")
        outside = F.col(f"per_{a}") & ((raw < F.col(f"b{a}")) | (raw >= F.col(f"e{a}")))
        turns = F.when(outside, F.floor((raw - F.col(f"b{a}")) / F.col(f"q{a}"))).otherwise(0)
        rows = rows.withColumn(a, (raw - turns * F.col(f"q{a}")).cast("int")).withColumn(f"_t{x}", turns * F.col(f"l{x}"))
    rows = rows.select("m", "ci", "cj", "ck", "si", "sj", "sk", *IJK, "_tx", "_ty", "_tz", F.col("_o.v").alias("v"))
    coords = points.select(F.col("grid_id").alias("m"), *IJK, *XYZ)
    met = rows.join(coords, ["m", *IJK]).select("m", "ci", "cj", "ck", "si", "sj", "sk", F.struct("v", *((F.col(x) + F.col(f"_t{x}")).alias(x) for x in XYZ[:dims])).alias("node"))
    packed = met.groupBy("m", "ci", "cj", "ck", "si", "sj", "sk").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    flat = F.flatten(F.transform("nodes", lambda s: F.array(*(s[x] for x in XYZ[:dims]))))
    return packed.where(F.size("nodes") == 4**dims).select("m", "ci", "cj", "ck", "si", "sj", "sk", flat.alias("stencil"))


def _best(found: DataFrame, dims: int) -> DataFrame:
    local = [F.col(c) for c in ("u", "v", "w")[:dims]]
    inside = geometry.inside_unit(local)
    metric = F.when(inside, geometry.chebyshev_to_centre(local)).otherwise(geometry.outside_distance(local))
    order = F.struct((~inside).alias("outside"), metric.alias("metric"), "ck", "cj", "ci")
    kept = F.min_by(F.struct("ci", "cj", "ck", "u", "v", "w"), order).alias("b")
    return found.groupBy("m", "n", "ni", "nj", "nk").agg(kept).select("m", "n", "ni", "nj", "nk", "b.*")


def detect_overlap(points: DataFrame, cells: DataFrame, meta: DataFrame, grids: list[Grid], pairs: DataFrame, bin_scale: float = 1.0) -> DataFrame:
    """One row per overlapped point and pair: m, n, ni, nj, nk, ci, cj, ck, u, v, w. pairs: m, n, tolerance; a grid never overlaps itself."""
    dims = grids[0].num_dims
    pairs = pairs.where("m <> n")
    kinds = sorted({g.geometry for g in grids})
    nodes = geometry.nodes_of("nodes", 2**dims, dims)
    p = [F.col(f"p{x}") for x in XYZ[:dims]]
    zero = F.lit(0.0)
    parts = []
    for kind in kinds:
        own = cells.where(F.col("geometry") == kind)
        met = candidates(points, own, pairs, dims, bin_scale).where(geometry.contains(kind, nodes, p, F.col("tolerance")))
        key = ["m", "n", "ni", "nj", "nk", "ci", "cj", "ck"]
        if kind == CURVILINEAR:
            met = met.select(*key, F.array(*p).alias("p"))
            stencils = _stencils(met.select("m", "ci", "cj", "ck").distinct(), points, meta, dims)
            solved = met.join(stencils, ["m", "ci", "cj", "ck"]).withColumn("_l", inverse_udf(dims, True)("stencil", "p")).where("_l is not null")
            local = [F.col("_l")[d] + F.col(f"s{a}") for d, a in zip(range(dims), IJK)]
            met = solved
        else:
            local = geometry.inverse_uniform(nodes[0], nodes[-1], p) if kind in ("UNIFORM", "RECTILINEAR") or dims == 1 else geometry.inverse_oriented(nodes, p)
        local = local + [zero] * (3 - dims)
        parts.append(met.select(*key, *(u.alias(c) for u, c in zip(local, ("u", "v", "w")))))
    return _best(reduce(DataFrame.unionByName, parts), dims)


def linear_weight(v: Column, dims: int) -> Column:
    """Weight of corner v of a cell at local coordinates u, v, w."""
    out = F.lit(1.0)
    for d, c in enumerate(("u", "v", "w")[:dims]):
        out = out * F.when(F.shiftright(v, d).bitwiseAND(F.lit(1)) == 1, F.col(c)).otherwise(1.0 - F.col(c))
    return out
