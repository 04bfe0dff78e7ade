"""Neighbourhood operators on masks of structured grids.

A mask is the set of its true points: rows of key columns (grid_id, and any more, such as a pair of grids) and i, j, k. meta is the
table of grids (schema.grid_table), one small row for each grid, joined by broadcast. All grids and keys are done in one plan.

Points look at the 3^d neighbours (Moore). Along periodic directions the neighbourhood wraps; with duplicated storage the first
and the last point are the same point: masks hold both or neither, and results do, too. Beyond other sides the boundary condition
counts: FALSE, TRUE or MIRROR. A mirrored neighbour always lies in the neighbourhood already, so MIRROR is the same as FALSE
when dilating and as TRUE when eroding, and leaves neighbours out when edges are found.

Everything is a scatter of true points to their neighbours, followed by one aggregation: never a join of points with points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .materialise import materialise

FALSE, TRUE, MIRROR = "FALSE", "TRUE", "MIRROR"
IJK = ["i", "j", "k"]
_META = ["bi", "bj", "bk", "ei", "ej", "ek", "per_i", "per_j", "per_k", "duplicated", "qi", "qj", "qk", "num_dims"]


def _with_meta(mask: DataFrame, meta: DataFrame) -> DataFrame:
    return mask.join(F.broadcast(meta.select("grid_id", *_META)), "grid_id")


def _keys(mask: DataFrame) -> list[str]:
    return [c for c in mask.columns if c not in IJK]


def _last_twin(a: str) -> Column:
    """Is the index the duplicate of the first one?"""
    return F.col("duplicated") & F.col(f"per_{a}") & (F.col(a) == F.col(f"e{a}") - 1)


def unique_points(mask: DataFrame, meta: DataFrame) -> DataFrame:
    """Without the duplicates of periodic directions."""
    return _with_meta(mask, meta).where(~(_last_twin("i") | _last_twin("j") | _last_twin("k"))).select(mask.columns)


def with_twins(mask: DataFrame, meta: DataFrame) -> DataFrame:
    """Add the duplicates of first points along duplicated periodic directions; extra columns are copied."""
    out, names = _with_meta(mask, meta), mask.columns
    for a in IJK:
        twin = F.col("duplicated") & F.col(f"per_{a}") & (F.col(a) == F.col(f"b{a}"))
        out = out.withColumn(a, F.explode(F.when(twin, F.array(F.col(a), F.col(f"e{a}") - 1)).otherwise(F.array(a))))
    return out.select(names)


def _scatter(mask: DataFrame, meta: DataFrame, radius, ring: int = 0, along: str = "ijk") -> DataFrame:
    """One row for each (true point, neighbour) with the neighbour's indices in place of the point's; ring: how far outside it may lie; along: directions to look in."""
    radius = radius if isinstance(radius, Column) else F.lit(radius)
    out = _with_meta(mask, meta).where(~(_last_twin("i") | _last_twin("j") | _last_twin("k"))).withColumn("_r", radius.cast("int"))
    for d, a in enumerate(IJK):
        if a not in along:
            continue
        reach = F.when(F.col("num_dims") > d, F.col("_r")).otherwise(0)
        out = out.withColumn(a, F.explode(F.sequence(F.col(a) - reach, F.col(a) + reach)))
        inside = (F.col(a) >= F.col(f"b{a}") - (ring if ring else 0)) & (F.col(a) < F.col(f"e{a}") + (ring if ring else 0))
        out = out.where(F.col(f"per_{a}") | inside)
        out = out.withColumn(a, F.when(F.col(f"per_{a}"), (F.pmod(F.col(a) - F.col(f"b{a}"), F.col(f"q{a}")) + F.col(f"b{a}"))).otherwise(F.col(a)).cast("int"))
    return out


def _in_grid_neighbours(radius: int) -> Column:
    """Size of a point's neighbourhood without what lies outside the grid."""
    out = F.lit(1)
    for d, a in enumerate(IJK):
        low = F.greatest(F.col(a) - radius, F.col(f"b{a}"))
        high = F.least(F.col(a) + radius, F.col(f"e{a}") - 1)
        out = out * F.when(F.col("num_dims") <= d, 1).when(F.col(f"per_{a}"), 2 * radius + 1).otherwise(high - low + 1)
    return out


def _near_side(radius) -> Column:
    """Does the neighbourhood reach beyond a side that isn't periodic?"""
    terms = [(F.col("num_dims") > d) & ~F.col(f"per_{a}") & ((F.col(a) - radius < F.col(f"b{a}")) | (F.col(a) + radius >= F.col(f"e{a}"))) for d, a in enumerate(IJK)]
    return terms[0] | terms[1] | terms[2]


def all_points(keys: DataFrame, meta: DataFrame) -> DataFrame:
    """Every point of the grids of the given key rows."""
    out = _with_meta(keys, meta)
    for a in IJK:
        out = out.withColumn(a, F.explode(F.sequence(F.col(f"b{a}"), F.col(f"e{a}") - 1)))
    return out.select(*keys.columns, *IJK)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, [c for c in a.columns if c in b.columns], "left_anti")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, [c for c in a.columns if c in b.columns], "left_semi")


def either(*masks: DataFrame) -> DataFrame:
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m.select(out.columns))
    return out.distinct()


def dilate(mask: DataFrame, meta: DataFrame, radius=1, bc: str = FALSE, keys: DataFrame | None = None) -> DataFrame:
    """True points and all within the Chebyshev radius (a number or a column); with TRUE also all as near to a side of the key rows' grids."""
    names = mask.columns
    if isinstance(radius, Column) or radius > 2:  # a ball is a product: one direction after the other
        out = mask
        for a in IJK:
            out = _scatter(out, meta, radius, along=a).select(names).distinct()
    else:
        out = _scatter(mask, meta, radius).select(names).distinct()
    if bc == TRUE:
        keys = mask.select(_keys(mask)).distinct() if keys is None else keys
        sides = _with_meta(all_points(keys, meta), meta).where(_near_side(F.lit(radius) if not isinstance(radius, Column) else radius)).select(names)
        return either(with_twins(out, meta), sides)
    return with_twins(out, meta)


def erode(mask: DataFrame, meta: DataFrame, radius: int = 1, bc: str = FALSE) -> DataFrame:
    """True points whose whole neighbourhood is true."""
    names = mask.columns
    met = _scatter(mask, meta, radius).groupBy(names).agg(F.count("*").alias("_met"))
    full = F.pow(F.lit(2 * radius + 1), F.col("num_dims")).cast("int") if bc == FALSE else _in_grid_neighbours(radius)
    return with_twins(_with_meta(met, meta).where(F.col("_met") == full).select(names), meta)


def _mirrored_ring(mask: DataFrame, meta: DataFrame) -> DataFrame:
    """Points just outside the grids whose nearest grid point is true."""
    out, names = _with_meta(mask, meta).withColumn("_out", F.lit(False)), mask.columns
    for d, a in enumerate(IJK):
        side = (F.col("num_dims") > d) & ~F.col(f"per_{a}")
        low, high = F.when(side & (F.col(a) == F.col(f"b{a}")), F.col(a) - 1), F.when(side & (F.col(a) == F.col(f"e{a}") - 1), F.col(a) + 1)
        moved = F.array_compact(F.array(F.struct(F.col(a).alias("x"), F.lit(False).alias("o")), F.when(low.isNotNull(), F.struct(low.alias("x"), F.lit(True).alias("o"))), F.when(high.isNotNull(), F.struct(high.alias("x"), F.lit(True).alias("o")))))
        out = out.withColumn("_m", F.explode(moved)).withColumn(a, F.col("_m.x")).withColumn("_out", F.col("_out") | F.col("_m.o"))
    return out.where("_out").select(names)


def _outside(points: DataFrame, meta: DataFrame) -> DataFrame:
    beyond = [(F.col(a) < F.col(f"b{a}")) | (F.col(a) >= F.col(f"e{a}")) for a in IJK]
    return _with_meta(points, meta).where(beyond[0] | beyond[1] | beyond[2]).select(points.columns)


def inner_edge(mask: DataFrame, meta: DataFrame, bc: str = FALSE, exterior: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """True points with a false neighbour; exterior: also those of the ring of points outside, whose value is bc's (of the key rows' grids)."""
    edge = minus(mask, erode(mask, meta, 1, bc))
    if not exterior or bc == FALSE:
        return edge
    keys = mask.select(_keys(mask)).distinct() if keys is None else keys
    near_false = _outside(with_twins(_scatter(minus(all_points(keys, meta), mask), meta, 1, ring=1).select(mask.columns).distinct(), meta), meta)
    return edge.unionByName(near_false if bc == TRUE else both(near_false, _mirrored_ring(mask, meta)))


def outer_edge(mask: DataFrame, meta: DataFrame, bc: str = FALSE, exterior: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """False points with a true neighbour; exterior: also those of the ring of points outside, whose value is bc's (with TRUE none of them is false)."""
    if exterior and bc != TRUE:
        near = with_twins(_scatter(mask, meta, 1, ring=1).select(mask.columns).distinct(), meta)
        return minus(near, mask if bc == FALSE else mask.unionByName(_mirrored_ring(mask, meta)))
    return minus(dilate(mask, meta, 1, TRUE if bc == TRUE else FALSE, keys), mask)


def count_true(mask: DataFrame) -> DataFrame:
    return mask.groupBy(_keys(mask)).agg(F.count("*").alias("n"))


def receiver_distance(mask: DataFrame, meta: DataFrame, cap) -> DataFrame:
    """Signed Chebyshev distance to the mask's inner edge, for points nearer than cap (a number or a column): 0 on the edge, below 0 inside."""
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    names = mask.columns
    edge = inner_edge(mask, meta, FALSE).select("*", *(F.col(a).alias(f"_{a}") for a in IJK))
    away = [F.abs(F.col(a) - F.col(f"_{a}")) for a in IJK]
    # along periodic directions the shorter way round
    away = [F.when(F.col(f"per_{a}"), F.least(F.pmod(F.col(a) - F.col(f"_{a}"), F.col(f"q{a}")), F.pmod(F.col(f"_{a}") - F.col(a), F.col(f"q{a}")))).otherwise(x) for a, x in zip(IJK, away)]
    reach = cap - 1
    near = _scatter(edge, meta, reach).withColumn("_d", F.greatest(*away)).groupBy(names).agg(F.min("_d").alias("distance"))
    near = with_twins(near, meta)
    signed = near.join(mask.withColumn("_in", F.lit(True)), names, "left")
    return signed.select(*names, F.when(F.col("_in"), -F.col("distance")).otherwise(F.col("distance")).cast("int").alias("distance"))


def neighbour_edges(points: DataFrame, meta: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Pairs of neighbouring points (src, dst as longs of one numbering over all keys) of a table of points with equal extra columns."""
    extra = extra or []
    keys = [c for c in points.columns if c not in IJK and c not in extra and c != "node"]
    near = _scatter(points.select(*keys, *extra, *IJK, "node"), meta, 1).select(*keys, *extra, *IJK, F.col("node").alias("src"))
    return near.join(points.select(*keys, *extra, *IJK, F.col("node").alias("dst")), [*keys, *extra, *IJK]).where("src < dst").select("src", "dst")


def numbered(points: DataFrame, meta: DataFrame) -> DataFrame:
    """node: one long for each point of a grid (its grid in the upper bits, its linear index below)."""
    size = [F.col(f"e{a}") - F.col(f"b{a}") for a in IJK]
    pid = (F.col("i") - F.col("bi")).cast("long") + size[0].cast("long") * ((F.col("j") - F.col("bj")) + size[1].cast("long") * (F.col("k") - F.col("bk")))
    return _with_meta(points, meta).select(*points.columns, (F.shiftleft(F.col("grid_id").cast("long"), 40) + pid).alias("node"))


def components(values: DataFrame, meta: DataFrame) -> DataFrame:
    """Components of equal value over dense points (grid_id, i, j, k, value): adds label, from 0 on in each grid in the order of their first points."""
    nodes = numbered(values, meta)
    single = _with_meta(nodes, meta).where(~(_last_twin("i") | _last_twin("j") | _last_twin("k"))).select(nodes.columns)
    tied = connected_components(neighbour_edges(single, meta, ["value"]))
    rooted = single.join(tied, "node", "left").select(*values.columns, F.coalesce("component", "node").alias("root"))
    return with_twins(rooted.join(_ranked(rooted.select("grid_id", "root").distinct()), ["grid_id", "root"]).drop("root"), meta)


def _ranked(roots: DataFrame) -> DataFrame:
    """label: the place of each root among its grid's, from 0 on. Roots are dealt by range and numbered within their part; parts' counts give the rest."""
    from pyspark.sql import Window

    parts = materialise(roots.repartitionByRange("grid_id", "root").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("grid_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    counts = parts.groupBy("grid_id", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("grid_id", "_part").orderBy("root")) - 1
    out = parts.withColumn("_within", within).join(counts.select("grid_id", "_part", "_before"), ["grid_id", "_part"])
    return out.select("grid_id", "root", (F.col("_before") + F.col("_within")).cast("int").alias("label"))


def flood(seeds: DataFrame, barrier: DataFrame, meta: DataFrame) -> DataFrame:
    """Seeds and every point that a path of neighbours joins to a seed without touching the barrier; seeds on the barrier stay as they are."""
    names = seeds.columns
    open_points = minus(all_points(seeds.select(_keys(seeds)).distinct(), meta), barrier)
    nodes = unique_points(numbered(open_points, meta), meta)
    tied = connected_components(neighbour_edges(nodes, meta))
    rooted = nodes.join(tied, "node", "left").select(*names, F.coalesce("component", "node").alias("root"))
    reached = both(rooted, unique_points(seeds, meta)).select("root").distinct()
    return either(with_twins(rooted.join(reached, "root", "left_semi").select(names), meta), seeds)
