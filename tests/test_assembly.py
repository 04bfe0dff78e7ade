"""Whole assemblies against a dense NumPy model that works through the stages point by point, and the invariants every assembly keeps."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeweave import schema as S
from latticeweave.operators import exchange as X
from latticeweave.plans import assembly as A
from latticeweave.plans.options import Options
from latticeweave.queries import assembly as Q
from latticeweave.queries import lattices as L
from latticeweave.sources.grids import analytic_points, cells_of, point_volumes

MOVES = list(itertools.product((-1, 0, 1), repeat=2))


class Dense:
    """Masks of one grid as arrays; periodic directions close on themselves."""

    def __init__(self, g: S.Grid):
        self.shape, self.per = (g.size(0), g.size(1)), g.periodic[:2]

    def near(self, mask, outside, ring=0):
        """Stack of the neighbours' values; ring: of the points of a frame around the grid, too."""
        pad = 1 + ring
        out = mask
        for d in (0, 1):
            width = [(0, 0), (0, 0)]
            width[d] = (pad, pad)
            out = np.pad(out, width, mode="wrap") if self.per[d] else np.pad(out, width, constant_values=outside)
        n = [s + 2 * ring for s in self.shape]
        return np.stack([out[1 + a : 1 + a + n[0], 1 + b : 1 + b + n[1]] for a, b in MOVES])

    def dilate(self, mask, n):  # MIRROR is the same
        for _ in range(n):
            mask = self.near(mask, False).any(axis=0)
        return mask

    def erode(self, mask, n):  # with TRUE, which is MIRROR
        for _ in range(n):
            mask = self.near(mask, True).all(axis=0)
        return mask

    def inner(self, mask):
        return mask & ~self.near(mask, False).all(axis=0)

    def outer(self, mask):
        return self.near(mask, False).any(axis=0) & ~mask

    def framed_outer(self, mask):
        frame = np.pad(mask, 1)
        for d in (0, 1):
            if self.per[d]:  # a periodic side has no outside
                frame = np.roll(frame, 0, d)
        return self.near(mask, False, ring=1).any(axis=0) & ~frame

    def framed_dilate(self, frame, n):
        """Of a mask with a frame, back on the grid."""
        assert not any(self.per)
        for _ in range(n):
            wide = np.pad(frame, 1)
            frame = np.stack([wide[1 + a : 1 + a + frame.shape[0], 1 + b : 1 + b + frame.shape[1]] for a, b in MOVES]).any(axis=0)
        return frame[1:-1, 1:-1]

    def flood(self, seeds, barrier):
        while True:
            more = seeds | (self.dilate(seeds & ~barrier, 1) & ~barrier)
            if (more == seeds).all():
                return seeds
            seeds = more


def model(grids, flags, overlap, volumes, o: Options):
    """flags: by grid; overlap: {(m, n): {(i, j): (ci, cj, u, v)}}. Returns the new flags and {(n, i, j): m}."""
    D = {g.grid_id: Dense(g) for g in grids}
    ids = sorted(D)
    has = lambda g, b: (flags[g] & b) != 0
    pairs = sorted(overlap)

    def blank(g):
        return np.zeros(D[g].shape, bool)

    def corners(m, c):
        return [((c[0] + a) % D[m].shape[0], (c[1] + b) % D[m].shape[1]) for b in (0, 1) for a in (0, 1)]

    held = {p: blank(p[1]) for p in pairs}
    for p, rows in overlap.items():
        for at in rows:
            held[p][at] = True

    def project(p, mask):
        out = blank(p[0])
        for at, c in overlap[p].items():
            if mask[at]:
                for x in corners(p[0], c):
                    out[x] = True
        return out

    def valid():
        out = {p: blank(p[1]) for p in pairs}
        for p, rows in overlap.items():
            for at, c in rows.items():
                out[p][at] = all(flags[p[0]][x] & 1 for x in corners(p[0], c))
        return out

    donor_volume = {(p, at): sum(volumes[p[0]][x] * w for x, w in zip(corners(p[0], c), [(1 - c[2]) * (1 - c[3]), c[2] * (1 - c[3]), (1 - c[2]) * c[3], c[2] * c[3]])) for p, rows in overlap.items() for at, c in rows.items()}
    over_any = {g: np.any([held[p] for p in pairs if p[1] == g] or [blank(g)], axis=0) for g in ids}
    for g in ids:
        if o.grid("infer_boundaries", g):
            new = D[g].inner(has(g, 1)) & ~(has(g, 1) & has(g, 2)) & ~over_any[g]
            flags[g][new] |= 2 | 16
        flags[g][over_any[g]] |= 8
    # holes
    cut = [p for p in pairs if o.pair("cut_boundary_holes", *p) and overlap[p] and overlap.get(p[::-1])]
    wall, seed = ({g: blank(g) for g in ids} for _ in range(2))
    for m, n in cut:
        cover = project((n, m), D[m].inner(held[n, m]))
        bare, d = D[n].outer(held[m, n]) & ~cover, 0
        while bare.any() and cover.any():
            cover, d = D[n].dilate(cover, 1), d + 1
            bare &= ~cover
        cast = D[n].dilate(project((n, m), has(m, 1) & has(m, 2)), d) & ~held[m, n]
        cast = D[n].outer(cast) & held[m, n]
        wall[n] |= cast
        seed[n] |= D[n].outer(cast) & held[m, n]
    for n in {n for _, n in cut}:
        if seed[n].any():
            own = has(n, 1) & has(n, 2)
            barrier = wall[n] | own
            interior = D[n].flood(seed[n], barrier)
            barrier &= ~(own & D[n].inner(has(n, 1)) & ~D[n].outer(interior))
            hole = has(n, 1) & ~interior & ~barrier
            flags[n][hole] = (flags[n][hole] & ~1) | 32
    ok = valid()
    for g in ids:
        size = o.grid("fringe_size", g)
        if size:
            live, side = has(g, 1), has(g, 1) & has(g, 6)
            ring = D[g].framed_outer(live)
            rim = ring & (D[g].framed_outer(live & ~side) | ~D[g].framed_outer(side))
            if any(D[g].per):  # take the frame off the periodic sides, dilate by hand
                points = np.argwhere(rim) - 1
                fringe = blank(g)
                for i, j in points:
                    if (D[g].per[0] and not 0 <= i < D[g].shape[0]) or (D[g].per[1] and not 0 <= j < D[g].shape[1]):
                        continue
                    for a, b in itertools.product(range(-size, size + 1), repeat=2):
                        x = [v % s if per else v for v, s, per in zip((i + a, j + b), D[g].shape, D[g].per)]
                        if all(0 <= v < s for v, s in zip(x, D[g].shape)):
                            fringe[tuple(x)] = True
            else:
                fringe = D[g].framed_dilate(rim, size)
            flags[g][fringe & live] |= 128 | 256
    # occlusion
    kinds = {p: o.pair("occludes", *p) for p in pairs if o.pair("occludes", *p) != "NONE"}
    occ = {p: blank(p[1]) for p in kinds}
    for p, kind in kinds.items():
        for at in overlap[p]:
            occ[p][at] = ok[p][at] and (kind == "ALL" or volumes[p[1]][at] > (1 + 1e-10) * donor_volume[p, at])
    for upper in (True, False):
        for m, n in [p for p in kinds if kinds[p] == "COARSE" and kinds.get(p[::-1]) == "COARSE" and (p[1] > p[0]) == upper]:
            for at, c in overlap[m, n].items():
                occ[m, n][at] = not any(occ[n, m][x] for x in corners(m, c))
    base, union, padded = {g: blank(g) for g in ids}, {g: blank(g) for g in ids}, {}
    for m, n in kinds:
        bad = has(m, 256)
        if (n, m) in kinds:
            bad = bad | occ[n, m] | ~has(m, 1)
        bad = D[m].dilate(bad, o.pair("edge_padding", m, n))
        padded[m, n] = blank(n)
        for at, c in overlap[m, n].items():
            padded[m, n][at] = occ[m, n][at] and any(bad[x] for x in corners(m, c))
        base[n] |= occ[m, n]
        union[n] |= occ[m, n] & ~padded[m, n]
    for g in ids:
        k = o.grid("edge_smoothing", g)
        if k:
            union[g] = D[g].erode(D[g].dilate(union[g], k), k) & base[g]
        flags[g][union[g]] |= 64
    for p in kinds:
        occ[p] &= ~(padded[p] & ~union[p[1]])
    # minimise
    for g in ids:
        may = np.any([occ[p] for p in kinds if p[1] == g and o.pair("minimize_overlap", *p)] or [blank(g)], axis=0)
        size, inner = o.grid("fringe_size", g), blank(g)
        if size:
            may = may & D[g].erode(union[g] | ~has(g, 1), size) & has(g, 1)
            inner = D[g].dilate(may, size) & has(g, 1) & ~may
        flags[g][may] = (flags[g][may] & ~(1 | 256)) | 1024
        flags[g][inner] |= 128 | 512
    ok = valid()
    receiver = {g: has(g, 256) | has(g, 512) | (union[g] & has(g, 1)) for g in ids}
    far = {}
    for g in ids:
        cap = max([1] + [1 + o.pair("edge_padding", *p) for p in pairs if p[0] == g])
        far[g], cover = np.full(D[g].shape, cap), D[g].inner(receiver[g])
        for d in range(cap):
            now = (far[g] == cap) & cover
            far[g][now] = np.where(receiver[g], -d, d)[now]
            cover = D[g].dilate(cover, 1)
    donors = {}
    for m, n in pairs:
        if o.pair("connection_type", m, n) == "NONE":
            continue
        for at, c in overlap[m, n].items():
            if not (receiver[n][at] and ok[m, n][at]):
                continue
            near = min(1.0, min(far[m][x] for x in corners(m, c)) / (1 + o.pair("edge_padding", m, n)))
            if o.pair("disjoint_connections", m, n) and near <= 0:
                continue
            now = donors.get((n, *at))
            if now is not None:
                if abs(near - now[1]) > 1e-12:
                    better = near > now[1]
                else:
                    better = {"ALL": False, "NONE": True, "COARSE": donor_volume[(m, n), at] < now[2]}[o.pair("occludes", now[0], m)]
                if not better:
                    continue
            donors[(n, *at)] = (m, near, donor_volume[(m, n), at])
    for g in ids:
        flags[g][receiver[g]] |= 2048
        for at in np.argwhere(receiver[g]):
            if (g, *map(int, at)) not in donors:
                flags[g][tuple(at)] |= 4096
    return flags, {k: v[0] for k, v in donors.items()}


def dense(grids, rows, column, kind=int):
    out = {g.grid_id: np.zeros((g.size(0), g.size(1)), kind) for g in grids}
    for r in rows:
        out[r.grid_id][r.i, r.j] = r[column]
    return out


def lattices(spark, sf):
    domain = A.Domain(spark, L.GRIDS, L.summed(spark, sf).select("grid_id", "i", "j", "k", "x", "y", "z", "flags"))
    o = Options([1, 2, 3])
    for m, n in ((1, 2), (2, 1), (1, 3), (3, 1)):
        for k, v in {"overlappable": True, "occludes": "ALL" if n == 1 else "COARSE", "edge_padding": n - 1, "connection_type": "NEAREST", "minimize_overlap": True, "disjoint_connections": n != 2}.items():
            o.set_pair(k, m, n, v)
    o.set_grid("fringe_size", 1, 1).set_grid("edge_smoothing", S.ALL_GRIDS, 1).set_grid("infer_boundaries", 2, True)
    return domain, o


@pytest.mark.parametrize("case", ["boxes", "blobs", "lattices"])
def test_against_model(spark, sf, case):
    domain, o = {"boxes": lambda: Q.box_in_box(spark, 17), "blobs": lambda: Q.blobs(spark, 25), "lattices": lambda: lattices(spark, sf)}[case]()
    got = A.assemble(domain, o)
    overlap = {(r["m"], r["n"]): {} for r in o.pair_rows()}
    for r in got.overlap.collect():
        overlap[r.m, r.n][r.ni, r.nj] = (r.ci, r.cj, r.u, r.v)
    volumes = dense(domain.grids, point_volumes(cells_of(domain.points, domain.meta, 2), domain.meta, 2).collect(), "volume", float)
    flags, donors = model(domain.grids, dense(domain.grids, domain.points.collect(), "flags"), overlap, volumes, o)
    now = dense(domain.grids, got.points.collect(), "flags")
    names = {v: k for k, v in vars(S).items() if isinstance(v, int) and k.isupper() and k not in ("ALL_GRIDS", "MAX_DIMS", "ASSEMBLY_FLAGS")}
    for g in now:
        wrong = {names[1 << b]: int(((now[g] ^ flags[g]) >> b & 1).sum()) for b in range(13)}
        assert not any(wrong.values()), (g, wrong)
    connections = got.connections.collect()
    assert {(r.n, r.ni, r.nj): r.m for r in connections} == donors and donors
    counts = {r.grid_id: r.asDict() for r in got.report().collect()}
    assert counts[1]["receivers"] == int(((flags[1] & 2048) != 0).sum())
    if case == "blobs":
        assert counts[1]["holes"] > 0 and counts[1]["minimized"] > 0
    # what every assembly keeps
    orphans = {(r.grid_id, r.i, r.j) for r in got.orphans.collect()}
    receivers = {(g, *map(int, x)) for g in now for x in np.argwhere(now[g] & 2048)}
    assert orphans.isdisjoint(donors) and orphans | set(donors) == receivers
    assert all(abs(sum(a * b for a in r.wi for b in r.wj) - 1) < 1e-12 for r in connections)
    iblank = {(r.grid_id, r.i, r.j): r.iblank for r in got.iblank().collect()}
    assert all(iblank[k] == -m for k, m in donors.items())
    # once more on the result: the same again
    if case == "boxes":
        again = A.assemble(A.Domain(spark, domain.grids, got.points), o)
        assert {tuple(r) for r in again.points.select("grid_id", "i", "j", "flags").collect()} == {tuple(r) for r in got.points.select("grid_id", "i", "j", "flags").collect()}


def flags_of(result, by):
    out = {}
    for r in result.points.collect():
        out.setdefault((r.grid_id, *(r[c] for c in by)), set()).add(r.flags)
    return out


def test_extruded_boxes_assemble_as_their_sections(spark):
    """Boxes repeated along a third, periodic direction: each layer is the two-dimensional assembly."""
    flat, o = Q.box_in_box(spark, 13)
    grids = [S.Grid(g.grid_id, (13, 13, 3), periodic=(False, False, True), geometry=g.geometry, periodic_length=(0.0, 0.0, 3.0)) for g in flat.grids]
    layers = spark.range(3).select(F.col("id").cast("int").alias("k"))
    points = flat.points.drop("k", "z").crossJoin(layers).withColumn("z", F.col("k").cast("double")).select("grid_id", "i", "j", "k", "x", "y", "z", "flags")
    two, three = A.assemble(flat, o), A.assemble(A.Domain(spark, grids, points), o)
    want = flags_of(two, "ij")
    assert flags_of(three, "ij") == want and all(len(v) == 1 for v in want.values())
    donors = {(r.n, r.ni, r.nj): (r.m, tuple(r.begin[:2]), len(r.wi), len(r.wj)) for r in two.connections.collect()}
    rows = three.connections.collect()
    assert {(r.n, r.ni, r.nj): (r.m, tuple(r.begin[:2]), len(r.wi), len(r.wj)) for r in rows} == donors and len(rows) == 3 * len(donors)
    assert all(len(r.wk) == 2 and abs(sum(r.wk) - 1) < 1e-12 for r in rows)
    assert three.orphans.count() == 3 * two.orphans.count()


def test_duplicated_rings_assemble_as_unique_ones(spark):
    """The first column of each ring once more at its end: flags stay what they were, and both copies agree."""
    n = 21
    unique, o = Q.blobs(spark, n)
    grids = [unique.grids[0], *(S.Grid(g.grid_id, (g.size(0), n + 1, 1), periodic=(False, True, False), storage=S.DUPLICATED) for g in unique.grids[1:])]
    twins = unique.points.where("grid_id > 1 and j = 0").withColumn("j", F.lit(n))
    one, two = A.assemble(unique, o), A.assemble(A.Domain(spark, grids, unique.points.unionByName(twins)), o)
    got = flags_of(two, "ij")
    assert {k: v for k, v in got.items() if k[2] < n or k[0] == 1} == flags_of(one, "ij")
    assert all(got[g, i, n] == got[g, i, 0] for g, i, j in got if g > 1 and j == 0)


def test_options():
    o = Options([1, 2, 3])
    o.set_pair("overlappable", S.ALL_GRIDS, 2, True)
    assert [(r["m"], r["n"]) for r in o.pair_rows()] == [(1, 2), (3, 2)]  # never with itself
    assert o.set_pair("overlappable", 1, 2, False).pair_rows()[0]["m"] == 3
    assert o.pair("overlap_tolerance", 1, 3) == 1e-12 and o.pair("disjoint_connections", 1, 1)
    with pytest.raises(ValueError, match="both ways"):
        o.set_pair("cut_boundary_holes", 3, 2, True).validate()
    with pytest.raises(NotImplementedError):
        Options([1, 2]).set_pair("connection_type", 1, 2, "CUBIC").validate()
    with pytest.raises(ValueError):
        o.set_pair("occludes", 1, 2, "SOME")
    with pytest.raises(KeyError):
        o.set_grid("fringe_size", 7, 1)


def test_linear_fields_are_reproduced(spark):
    grids = [S.Grid(1, (9, 8, 1), geometry=S.UNIFORM), S.Grid(2, (5, 5, 1), geometry=S.ORIENTED_UNIFORM)]
    points = analytic_points(spark, grids, {1: ("i", "j", "0"), 2: ("3 + 0.6D * i - 0.2D * j", "2 + 0.2D * i + 0.6D * j", "0")})
    from latticeweave.plans.remap import remap

    got = remap(spark, grids, points.withColumn("value", 2 * F.col("x") - 3 * F.col("y") + 1), 1, 2)
    rows = got.join(points.select("grid_id", "i", "j", "k", "x", "y"), ["grid_id", "i", "j", "k"]).collect()
    assert len(rows) == 25 and all(abs(r.value - (2 * r.x - 3 * r.y + 1)) < 1e-9 for r in rows)
    with pytest.raises(NotImplementedError):
        X.connections_of(points, "CUBIC")
    with pytest.raises(TypeError):
        X.collect(X.connections_of(spark.createDataFrame([], S.OVERLAP)), points.select("grid_id", "i", "j", "k", F.lit(1).alias("value")), S.grid_table(spark, grids))
