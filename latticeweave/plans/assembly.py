"""Assembly of a domain of overlapping grids: overlap, boundaries, holes, fringes, occlusion, donors, connections.

Each stage is one lazy plan over sparse masks. Rows that many later plans read (cells, overlap, flags) are written to the shared folder, which also
keeps plans short.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.index import has
from ..operators import masks as M
from ..operators.exchange import KEY, connections_of
from ..operators.materialise import materialise
from ..operators.masks import IJK
from ..operators.overlap import detect_overlap, linear_weight
from ..sources.grids import cells_of, corners_of, point_volumes
from .observe import Profile
from .options import Options

DONOR_TOLERANCE = 1e-12
COARSER = 1.0 + 1e-10
POINT = ["grid_id", *IJK]


@dataclass
class Domain:
    """Grids and their points (schema.POINTS)."""

    spark: SparkSession
    grids: list[S.Grid]
    points: DataFrame

    def __post_init__(self):
        if len({g.num_dims for g in self.grids}) > 1:
            raise ValueError("all grids of a domain have the same number of dimensions")
        self.dims = self.grids[0].num_dims
        self.meta = S.grid_table(self.spark, self.grids)


@dataclass
class Assembly:
    points: DataFrame  # with the new flags
    overlap: DataFrame
    connections: DataFrame
    orphans: DataFrame
    meta: DataFrame
    #: What stages in between found: padded, occluded, removed, inner_fringe, receivers, candidates (valid overlap of receivers with distances).
    stages: dict[str, DataFrame] = field(default_factory=dict)

    def report(self) -> DataFrame:
        """Counts of points by grid."""
        names = {"active": S.ACTIVE, "inferred": S.INFERRED_DOMAIN_BOUNDARY, "holes": S.BOUNDARY_HOLE, "occluded": S.OCCLUDED, "outer_fringe": S.OUTER_FRINGE,
                 "inner_fringe": S.INNER_FRINGE, "minimized": S.OVERLAP_MINIMIZED, "receivers": S.RECEIVER, "orphans": S.ORPHAN}
        return self.points.groupBy("grid_id").agg(*(F.count_if(has(F.col("flags"), b)).alias(n) for n, b in names.items()))

    def iblank(self) -> DataFrame:
        """1 for active points, 0 for inactive ones, -m for those that receive from grid m."""
        to = self.connections.select(F.col("n").alias("grid_id"), *(F.col(f"n{a}").alias(a) for a in IJK), "m")
        out = self.points.join(to, POINT, "left")
        return out.select(*POINT, F.when(F.col("m").isNotNull(), -F.col("m")).otherwise(has(F.col("flags"), S.ACTIVE).cast("int")).alias("iblank"))


def reset_flags(points: DataFrame) -> DataFrame:
    """Undo what an earlier assembly did: its holes are active again, its inferred boundaries are none."""
    f = F.col("flags")
    f = F.when(has(f, S.BOUNDARY_HOLE | S.OVERLAP_MINIMIZED), f.bitwiseOR(F.lit(S.ACTIVE))).otherwise(f)
    f = F.when(has(f, S.INFERRED_DOMAIN_BOUNDARY), f.bitwiseAND(F.lit(~S.DOMAIN_BOUNDARY))).otherwise(f)
    return points.withColumn("flags", f.bitwiseAND(F.lit(~S.ASSEMBLY_FLAGS)).cast("int"))


def active(points: DataFrame) -> DataFrame:
    return points.where(has(F.col("flags"), S.ACTIVE)).select(POINT)


def boundary(points: DataFrame, bits: int = S.DOMAIN_BOUNDARY) -> DataFrame:
    return points.where(has(F.col("flags"), S.ACTIVE) & has(F.col("flags"), bits)).select(POINT)


def update(points: DataFrame, *changes: tuple[DataFrame, int, int]) -> DataFrame:
    """Set and clear bits at the points of masks: one join, whatever the number of changes."""
    rows = [m.select(*POINT, F.lit(on).alias("_on"), F.lit(off).alias("_off")) for m, on, off in changes]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    every = every.groupBy(POINT).agg(F.bit_or("_on").alias("_on"), F.bit_or("_off").alias("_off"))
    flags = F.col("flags").bitwiseAND(F.bitwise_not(F.coalesce("_off", F.lit(0)))).bitwiseOR(F.coalesce("_on", F.lit(0)))
    return points.join(every, POINT, "left").withColumn("flags", flags.cast("int")).drop("_on", "_off")


def receivers_side(overlap: DataFrame) -> DataFrame:
    """Overlapped points: m, n, grid_id = n and the point."""
    return overlap.select("m", "n", F.col("n").alias("grid_id"), *(F.col(f"n{a}").alias(a) for a in IJK))


def infer_boundaries(domain: Domain, points: DataFrame, overlap: DataFrame, options: Options) -> DataFrame:
    """Edge points of active regions that no grid overlaps and that aren't boundary already, for the grids with the option."""
    chosen = [g.grid_id for g in domain.grids if options.grid("infer_boundaries", g.grid_id)]
    live = active(points).where(F.col("grid_id").isin(chosen))
    edge = M.minus(M.inner_edge(live, domain.meta, M.FALSE), boundary(points))
    return M.minus(edge, receivers_side(overlap).select(POINT).distinct())


def project(domain: Domain, overlap: DataFrame, mask: DataFrame) -> DataFrame:
    """For masks of n by pair (m, n): the corners of the cells of m that hold their points, as masks of m under the same pair."""
    at = overlap.join(mask.select("m", "n", *(F.col(a).alias(f"n{a}") for a in IJK)), KEY, "left_semi")
    return corners_of(at.select("m", "n", "ci", "cj", "ck").distinct(), domain.meta, domain.dims).select("m", "n", *POINT).distinct()


def swap(mask: DataFrame) -> DataFrame:
    return mask.select(F.col("n").alias("m"), F.col("m").alias("n"), *POINT)


def cut_holes(domain: Domain, points: DataFrame, overlap: DataFrame, options: Options) -> DataFrame:
    """Points of each grid that lie beyond the domain boundary of a grid that cuts it."""
    meta = domain.meta
    present = {(r.m, r.n) for r in overlap.select("m", "n").distinct().collect()}  # pairs of grids
    cut = [p for p in present if options.pair("cut_boundary_holes", *p) and p[::-1] in present]
    empty = points.select(POINT).where("false")
    if not cut:
        return empty
    spark = domain.spark
    pair_schema = "m int, n int"
    wanted = spark.createDataFrame(cut, pair_schema)
    back = spark.createDataFrame([p[::-1] for p in cut], pair_schema)
    side = receivers_side(overlap)
    held = side.join(F.broadcast(wanted), ["m", "n"], "left_semi")  # points of n that m overlaps
    reverse = side.join(F.broadcast(back), ["m", "n"], "left_semi")  # pair (n, m): points of m that n overlaps
    # edge of m's overlapped region, seen on n; the pair is turned round so that it is (m, n) again
    cover = materialise(swap(project(domain, overlap, M.inner_edge(reverse, meta, M.FALSE))))
    bare = materialise(M.minus(M.outer_edge(held, meta, M.MIRROR), cover))
    radius = dict.fromkeys(cut, 0)
    covered = {(r.m, r.n) for r in cover.select("m", "n").distinct().collect()}
    spread, grown = 0, cover
    while True:
        open_pairs = [(r.m, r.n) for r in bare.select("m", "n").distinct().collect() if (r.m, r.n) in covered]
        if not open_pairs:
            break
        spread += 1
        for p in open_pairs:
            radius[p] = spread
        grown = materialise(M.dilate(grown, meta, 1))  # one step further each round
        bare = materialise(M.minus(bare, grown))
    far = spark.createDataFrame([(*p, r) for p, r in radius.items()], "m int, n int, _far int")
    edge = boundary(points)
    hit = M.both(reverse, edge)
    cast = swap(project(domain, overlap, hit)).join(F.broadcast(far), ["m", "n"])
    # the radius is a column of its own pair, so it goes along as a key and is dropped again
    spread_out = M.dilate(cast, meta, F.col("_far")).drop("_far")
    projected = materialise(M.both(M.outer_edge(M.minus(spread_out, held), meta, M.FALSE), held))
    seeds = M.both(M.outer_edge(projected, meta, M.FALSE), held).select(POINT).distinct()
    own = boundary(points)
    targets = sorted({n for _, n in cut})
    barrier = M.either(own.where(F.col("grid_id").isin(targets)), projected.select(POINT))
    seeds = materialise(seeds)
    seeded = [r.grid_id for r in seeds.select("grid_id").distinct().collect()]
    if not seeded:
        return empty
    barrier = barrier.where(F.col("grid_id").isin(seeded))
    interior = materialise(M.flood(seeds, barrier, meta))
    live = active(points).where(F.col("grid_id").isin(seeded))
    loose = M.minus(M.both(M.both(own, M.inner_edge(live, meta, M.FALSE)), barrier), M.outer_edge(interior, meta, M.FALSE))
    return M.minus(M.minus(live, interior), M.minus(barrier, loose))


def valid_overlap(domain: Domain, points: DataFrame, overlap: DataFrame) -> DataFrame:
    """Overlap rows whose cell has only active corners."""
    corners = corners_of(overlap.select(*KEY, "ci", "cj", "ck"), domain.meta, domain.dims).join(points.select(*POINT, has(F.col("flags"), S.ACTIVE).alias("_a")), POINT)
    whole = corners.groupBy(KEY).agg(F.bool_and("_a").alias("_all")).where("_all").select(KEY)
    return overlap.join(whole, KEY, "left_semi")


def outer_fringe(domain: Domain, points: DataFrame, options: Options) -> DataFrame:
    sizes = {g.grid_id: options.grid("fringe_size", g.grid_id) for g in domain.grids}
    live = active(points).where(F.col("grid_id").isin([g for g, s in sizes.items() if s]))
    meta = domain.meta
    side = M.either(boundary(points), boundary(points, S.INTERNAL_BOUNDARY))
    side_edge = M.outer_edge(M.both(side, live), meta, M.FALSE, exterior=True)
    free_edge = M.outer_edge(M.minus(live, side), meta, M.FALSE, exterior=True)
    ring = M.outer_edge(live, meta, M.FALSE, exterior=True)
    cover = M.either(M.minus(ring, side_edge), M.both(ring, free_edge))
    size = _map_column(sizes, "grid_id")
    return M.both(M.dilate(cover, meta, size), live)


def _map_column(values: dict[int, int], column: str):
    """The number of each row's grid: one map, folded to a constant, whatever the number of grids."""
    held = {g: v for g, v in values.items() if v}
    if not held:
        return F.lit(0)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for gv in held.items() for x in gv)), F.col(column)), F.lit(0))


def overlap_volumes(domain: Domain, overlap: DataFrame, volumes: DataFrame) -> DataFrame:
    """The overlap's key and donor_volume, m's point volumes interpolated at the overlapped point."""
    corners = corners_of(overlap.select(*KEY, "ci", "cj", "ck", "u", "v", "w").withColumnRenamed("v", "lv"), domain.meta, domain.dims)
    weight = F.lit(1.0)
    for d, c in enumerate(("u", "lv", "w")[: domain.dims]):
        weight = weight * F.when(F.shiftright("v", d).bitwiseAND(F.lit(1)) == 1, F.col(c)).otherwise(1.0 - F.col(c))
    return corners.join(volumes, POINT).groupBy(KEY).agg(F.sum(weight * F.col("volume")).alias("donor_volume"))


def coarser(rows: DataFrame, volumes: DataFrame, donor_volumes: DataFrame) -> DataFrame:
    """Overlap rows whose point is coarser than what m offers there."""
    names = rows.columns
    rated = rows.join(donor_volumes, KEY, "left").join(volumes.select(F.col("grid_id").alias("n"), *(F.col(a).alias(f"n{a}") for a in IJK), "volume"), ["n", "ni", "nj", "nk"], "left")
    return rated.where(F.col("volume") > COARSER * F.col("donor_volume")).select(names)


def settle_mutual(domain: Domain, overlap: DataFrame, pairwise: DataFrame, mutual: list[tuple[int, int]]) -> DataFrame:
    """Pairs that occlude each other where coarser: first those with n > m by what their partners hold, then the others by what the first left."""
    for upper in (True, False) if mutual else ():
        now = domain.spark.createDataFrame([p for p in mutual if (p[1] > p[0]) == upper], "m int, n int")
        of_pair = overlap.join(F.broadcast(now), ["m", "n"], "left_semi")
        theirs = swap(pairwise)  # is a corner of the donor cell occluded by n?
        touched = corners_of(of_pair.select(*KEY, "ci", "cj", "ck"), domain.meta, domain.dims).join(theirs, ["m", "n", *POINT], "left_semi").select(KEY).distinct()
        kept = receivers_side(of_pair.join(touched, KEY, "left_anti"))
        pairwise = materialise(pairwise.join(F.broadcast(now), ["m", "n"], "left_anti").unionByName(kept))
    return pairwise if mutual else materialise(pairwise)


def occlusion(domain: Domain, points: DataFrame, overlap: DataFrame, valid: DataFrame, volumes: DataFrame, donor_volumes: DataFrame, fringe: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairwise occlusion (m, n, point of n) after padding, the points occluded by any grid after smoothing, and what padding took out before that."""
    spark, meta = domain.spark, domain.meta
    rows = options.pair_rows()
    kinds = {(r["m"], r["n"]): r["occludes"] for r in rows if r["occludes"] != "NONE"}
    none = receivers_side(overlap).where("false")
    if not kinds:
        return none, none.select(POINT), none
    table = spark.createDataFrame([(*p, k) for p, k in kinds.items()], "m int, n int, occludes string")
    # the overlap that counts: valid rows (the mask of later stages), with a coarser point for COARSE
    every = valid.join(F.broadcast(table), ["m", "n"])
    names = valid.columns
    first = every.where("occludes = 'ALL'").select(names).unionByName(coarser(every.where("occludes = 'COARSE'").select(names), volumes, donor_volumes))
    mutual = [p for p, k in kinds.items() if k == "COARSE" and kinds.get(p[::-1]) == "COARSE"]
    pairwise = settle_mutual(domain, overlap, receivers_side(first), mutual)
    # padding: points whose donor cell touches what m must not give
    occluding = spark.createDataFrame([(m, n, options.pair("edge_padding", m, n), kinds.get((n, m)) is not None) for m, n in kinds], "m int, n int, _far int, _back boolean")
    rim = F.broadcast(occluding.withColumn("grid_id", F.col("m")))
    barred = fringe.join(rim, "grid_id").select("m", "n", *POINT, "_far")
    dead = points.where(~has(F.col("flags"), S.ACTIVE)).select(POINT).join(rim.where("_back"), "grid_id").select("m", "n", *POINT, "_far")
    theirs = swap(pairwise).join(F.broadcast(occluding.where("_back").select("m", "n", "_far")), ["m", "n"]).select("m", "n", *POINT, "_far")
    barred = M.dilate(M.either(barred, dead, theirs), meta, F.col("_far")).drop("_far")
    at = overlap.join(F.broadcast(table.select("m", "n")), ["m", "n"], "left_semi").select(*KEY, "ci", "cj", "ck")
    touched = corners_of(at, meta, domain.dims).join(barred, ["m", "n", *POINT], "left_semi").select(KEY).distinct()
    padded = materialise(M.both(pairwise, receivers_side(touched)))
    base = pairwise.select(POINT).distinct()
    free = M.minus(pairwise, padded).select(POINT).distinct()
    smooth = {g.grid_id: options.grid("edge_smoothing", g.grid_id) for g in domain.grids}
    parts = [free.where(F.col("grid_id").isin([g for g, s in smooth.items() if not s]))]
    for size in sorted({s for s in smooth.values() if s}):
        own = free.where(F.col("grid_id").isin([g for g, s in smooth.items() if s == size]))
        parts.append(M.both(M.erode(M.dilate(own, meta, size, M.MIRROR), meta, size, M.MIRROR), base))
    occluded = parts[0]
    for p in parts[1:]:
        occluded = occluded.unionByName(p)
    occluded = materialise(occluded.distinct())
    # padded points that smoothing took in again count as occluded by their pair, too
    pairwise = materialise(M.minus(pairwise, M.minus(padded, occluded)))
    return pairwise, occluded, padded


def minimize_overlap(domain: Domain, points: DataFrame, pairwise: DataFrame, occluded: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Points to remove, and the inner fringe that is left around them."""
    meta = domain.meta
    chosen = [(r["m"], r["n"]) for r in options.pair_rows() if r["minimize_overlap"] and r["occludes"] != "NONE"]
    none = occluded.where("false")
    if not chosen:
        return none, none
    wanted = domain.spark.createDataFrame(chosen, "m int, n int")
    may = pairwise.join(F.broadcast(wanted), ["m", "n"], "left_semi").select(POINT).distinct()
    sizes = {g.grid_id: options.grid("fringe_size", g.grid_id) for g in domain.grids}
    removed, fringe = [may.where(F.col("grid_id").isin([g for g, s in sizes.items() if not s]))], [none]
    live = active(points)
    for size in sorted({s for s in sizes.values() if s}):
        own = F.col("grid_id").isin([g for g, s in sizes.items() if s == size])
        dead = points.where(own & ~has(F.col("flags"), S.ACTIVE)).select(POINT)
        deep = M.erode(M.either(occluded.where(own), dead), meta, size, M.TRUE)
        gone = materialise(M.both(M.both(may.where(own), deep), live))
        removed.append(gone)
        fringe.append(M.minus(M.both(M.dilate(gone, meta, size), live), gone))
    return _union(removed), _union(fringe)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def receivers(points: DataFrame) -> DataFrame:
    """Outer and inner fringe, and occluded points that are still active."""
    f = F.col("flags")
    return points.where(has(f, S.OUTER_FRINGE | S.INNER_FRINGE) | (has(f, S.OCCLUDED) & has(f, S.ACTIVE))).select(POINT)


def donor_candidates(domain: Domain, receiving: DataFrame, overlap: DataFrame, valid: DataFrame, donor_volumes: DataFrame, options: Options) -> DataFrame:
    """Valid overlap rows of receivers with their normalised distance from m's own receivers, at most 1, and donor volume."""
    rows = options.pair_rows()
    caps = {g.grid_id: max([1] + [1 + r["edge_padding"] for r in rows if r["m"] == g.grid_id]) for g in domain.grids}
    distance = M.receiver_distance(receiving, domain.meta, _map_column(caps, "grid_id"))
    kinds = domain.spark.createDataFrame([(r["m"], r["n"], 1 + r["edge_padding"], r["connection_type"], r["disjoint_connections"]) for r in rows], "m int, n int, reach int, kind string, disjoint boolean")
    wanted = valid.join(F.broadcast(kinds.where("kind <> 'NONE'")), ["m", "n"])
    wanted = wanted.join(receiving.select(F.col("grid_id").alias("n"), *(F.col(a).alias(f"n{a}") for a in IJK)), ["n", "ni", "nj", "nk"], "left_semi")
    corners = corners_of(wanted.select(*KEY, "ci", "cj", "ck"), domain.meta, domain.dims).join(distance, POINT, "left")
    least = corners.groupBy(KEY).agg(F.min(F.coalesce("distance", _map_column(caps, "m"))).alias("distance"))
    out = wanted.join(least, KEY).join(donor_volumes, KEY, "left")
    return out.withColumn("near", F.least(F.col("distance") / F.col("reach"), F.lit(1.0)))


def choose_donors(found: DataFrame, options: Options) -> DataFrame:
    """One row for each receiver with a donor: an ordered fold over its candidates in ascending m."""
    others: dict[int, dict[int, str]] = {}  # of each grid, the grids that occlude it, and how
    for (m, n), kind in options.held_pairs("occludes"):
        others.setdefault(n, {})[m] = kind
    small = found.sparkSession.createDataFrame(list(others.items()), "m int, occluders map<int, string>")
    found = found.join(F.broadcast(small), "m", "left")
    fields = ["m", "near", "donor_volume", "disjoint", "kind", "ci", "cj", "ck", "u", "v", "w", "occluders"]
    order = F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["m"] - b["m"])  # one candidate from each m

    def step(now, new):
        allowed = ~new["disjoint"] | (new["near"] > 0)
        how = F.coalesce(F.try_element_at(new["occluders"], now["m"]), F.lit("NONE"))
        tie = F.when(how == "ALL", F.lit(False)).when(how == "NONE", F.lit(True)).otherwise(new["donor_volume"] < now["donor_volume"])
        better = F.when(F.abs(new["near"] - now["near"]) > DONOR_TOLERANCE, new["near"] > now["near"]).otherwise(tie)
        return F.when(allowed & (now["m"].isNull() | better), new).otherwise(now)

    types = dict(found.dtypes)
    none = F.struct(*(F.lit(None).cast(types[f]).alias(f) for f in fields))
    folded = found.groupBy("n", "ni", "nj", "nk").agg(order.alias("_c")).withColumn("_d", F.aggregate("_c", none, step))
    return folded.where("_d.m is not null").select("n", "ni", "nj", "nk", "_d.*").drop("occluders")


def assemble(domain: Domain, options: Options, profile: Profile | None = None) -> Assembly:
    """The whole assembly; the result doesn't depend on how rows are dealt. profile: gets the seconds of each stage."""
    options.validate()
    spark, meta, dims = domain.spark, domain.meta, domain.dims
    profile = profile or Profile()
    points = materialise(reset_flags(domain.points))
    with profile.stage("overlap detection"):
        cells = materialise(cells_of(points, meta, dims))
        volumes = materialise(point_volumes(cells, meta, dims))
        pairs = options.pair_table(spark)
        scale = 2.0 ** -max([options.grid("overlap_accel_resolution_adjust", g.grid_id) for g in domain.grids], default=0.0)
        overlap = materialise(detect_overlap(points, cells, meta, domain.grids, pairs, bin_scale=scale))
        donor_volumes = materialise(overlap_volumes(domain, overlap, volumes))
        seen = receivers_side(overlap).select(POINT).distinct()
    with profile.stage("boundary inference"):
        inferred = infer_boundaries(domain, points, overlap, options)
        points = materialise(update(points, (seen, S.OVERLAPPED, 0), (inferred, S.DOMAIN_BOUNDARY | S.INFERRED_DOMAIN_BOUNDARY, 0)))
    with profile.stage("hole cutting"):
        points = materialise(update(points, (cut_holes(domain, points, overlap, options), S.BOUNDARY_HOLE, S.ACTIVE)))
        valid = materialise(valid_overlap(domain, points, overlap))
    with profile.stage("outer fringe"):
        fringe = materialise(outer_fringe(domain, points, options))
        points = materialise(update(points, (fringe, S.FRINGE | S.OUTER_FRINGE, 0)))
    with profile.stage("occlusion"):
        pairwise, occluded, padded = occlusion(domain, points, overlap, valid, volumes, donor_volumes, fringe, options)
        points = materialise(update(points, (occluded, S.OCCLUDED, 0)))
    with profile.stage("overlap minimization"):
        removed, inner = minimize_overlap(domain, points, pairwise, occluded, options)
        points = materialise(update(points, (removed, S.OVERLAP_MINIMIZED, S.ACTIVE | S.OUTER_FRINGE), (inner, S.FRINGE | S.INNER_FRINGE, 0)))
        valid = materialise(valid_overlap(domain, points, overlap))
    with profile.stage("connections"):
        receiving = materialise(receivers(points))
        found = materialise(donor_candidates(domain, receiving, overlap, valid, donor_volumes, options))
        donors = materialise(choose_donors(found, options))
        made = None
        for kind in ("NEAREST", "LINEAR"):
            part = connections_of(donors.where(F.col("kind") == kind), kind, dims)
            made = part if made is None else made.unionByName(part)
        made = materialise(made)
        orphans = materialise(M.minus(receiving, donors.select(F.col("n").alias("grid_id"), *(F.col(f"n{a}").alias(a) for a in IJK))))
        points = materialise(update(points, (receiving, S.RECEIVER, 0), (orphans, S.ORPHAN, 0)))
    stages = {"padded": padded, "occluded": occluded, "removed": removed, "inner_fringe": inner, "receivers": receiving, "candidates": found}
    return Assembly(points, overlap, made, orphans, meta, stages)
