"""Stages of the assembly and whole assemblies. Two domains: the lattices of the driver's tables, and generated ones of two and four grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.index import has
from ..operators.masks import IJK
from ..plans import assembly as A
from ..plans.options import Options
from ..sources.grids import analytic_points
from . import lattices as L
from .grids import _CELLS, _OVERLAP
from .masks import _RING, _SEEN, _neighbours
from .registry import query

P2 = ["grid_id", "i", "j"]


def _options(**pair) -> Options:
    o = Options([g.grid_id for g in L.GRIDS])
    for m, n in ((1, 2), (2, 1), (1, 3), (3, 1)):
        for k, v in ({"overlappable": True} | pair).items():
            o.set_pair(k, m, n, v)
    return o


def _lattice_domain(spark, sf_dir, flags: str = L.FLAGS):
    return A.Domain(spark, L.GRIDS, L.summed(spark, sf_dir, flags=flags).select("grid_id", *IJK, "x", "y", "z", "flags"))


def box_in_box(spark, n: int = 25) -> tuple[A.Domain, Options]:
    """A square within a square, turned by a small angle, with the options of an ordinary overset run."""
    grids = [S.Grid(1, (n, n, 1), geometry=S.UNIFORM), S.Grid(2, (n, n, 1), geometry=S.ORIENTED_UNIFORM)]
    u, v = f"(2.0D * i / {n - 1} - 1)", f"(2.0D * j / {n - 1} - 1)"
    turned = (f"0.5D * ({u} * cos(radians(5)) - {v} * sin(radians(5)))", f"0.5D * ({u} * sin(radians(5)) + {v} * cos(radians(5)))", "0")
    points = analytic_points(spark, grids, {1: (u, v, "0"), 2: turned})
    return A.Domain(spark, grids, points), usual_options([1, 2])


def usual_options(ids, padding: int = 2) -> Options:
    o, every = Options(ids), S.ALL_GRIDS
    for name, value in {"overlappable": True, "cut_boundary_holes": True, "occludes": "COARSE", "edge_padding": padding, "connection_type": "LINEAR", "minimize_overlap": True}.items():
        o.set_pair(name, every, every, value)
    for name, value in {"infer_boundaries": True, "edge_smoothing": 2, "fringe_size": 2}.items():
        o.set_grid(name, every, value)
    return o


def blobs(spark, n: int = 25) -> tuple[A.Domain, Options]:
    """A square background and three rings around round bodies; the rings' inner rows are domain boundaries."""
    centres = {2: (-0.25, -0.15), 3: (-0.15, 0.3), 4: (0.3, 0.15)}
    rings = [S.Grid(g, (n // 2, n, 1), periodic=(False, True, False)) for g in centres]
    grids = [S.Grid(1, (n, n, 1), geometry=S.UNIFORM), *rings]
    r, a = f"(0.1D + 0.2D * i / {n // 2 - 1})", f"(2 * pi() * j / {n})"
    coords = {1: (f"2.0D * i / {n - 1} - 1", f"2.0D * j / {n - 1} - 1", "0")} | {g: (f"{x}D + {r} * cos({a})", f"{y}D + {r} * sin({a})", "0") for g, (x, y) in centres.items()}
    coords = {g: tuple(c.replace("--", "+") for c in xyz) for g, xyz in coords.items()}
    wall = F.when((F.col("grid_id") > 1) & (F.col("i") == 0), S.ACTIVE | S.DOMAIN_BOUNDARY).otherwise(S.ACTIVE)
    return A.Domain(spark, grids, analytic_points(spark, grids, coords, wall)), usual_options([g.grid_id for g in grids], 3).set_pair("occludes", S.ALL_GRIDS, 1, "ALL")


@query(f"""{L.sql_points()}, {_CELLS}, {_OVERLAP}, {_neighbours(1)}, {_SEEN}
SELECT s.grid_id, s.i, s.j FROM seen s JOIN pts p USING (grid_id, i, j) WHERE s.bc = 'FALSE' AND s.own AND NOT s.every AND (p.flags & 2) = 0 AND NOT EXISTS (SELECT 1 FROM over o WHERE o.n = s.grid_id AND o.ni = s.i AND o.nj = s.j)""")
def infer_boundaries(spark, sf_dir):
    domain, options = _lattice_domain(spark, sf_dir), _options().set_grid("infer_boundaries", S.ALL_GRIDS, True)
    from .grids import _overlap

    return A.infer_boundaries(domain, domain.points, _overlap(spark, sf_dir)[3], options).select(P2)


def _touch(name: str, condition: str) -> str:
    """Points of the ring just outside active regions that touch an active point of the given kind."""
    return f"""{name} AS (SELECT DISTINCT r.grid_id, r.i, r.j FROM ringed r JOIN pts q ON q.grid_id = r.grid_id AND q.i BETWEEN r.i - 1 AND r.i + 1 AND q.j BETWEEN r.j - 1 AND r.j + 1
  WHERE (q.flags & 1) = 1 AND {condition})"""


@query(f"""{L.sql_points()}, {_RING}, out AS (SELECT grid_id, i, j FROM ringed WHERE coalesce(flags & 1, 0) = 0), {_touch('near', 'true')}, {_touch('wall', '(q.flags & 6) <> 0')}, {_touch('free', '(q.flags & 6) = 0')},
rim AS (SELECT n.* FROM near n JOIN out USING (grid_id, i, j) WHERE (n.grid_id, n.i, n.j) NOT IN (SELECT (grid_id, i, j) FROM wall) OR (n.grid_id, n.i, n.j) IN (SELECT (grid_id, i, j) FROM free))
SELECT DISTINCT p.grid_id, p.i, p.j FROM pts p JOIN rim r ON r.grid_id = p.grid_id AND abs(r.i - p.i) <= 2 AND abs(r.j - p.j) <= 2 WHERE (p.flags & 1) = 1""")
def outer_fringe(spark, sf_dir):
    domain = _lattice_domain(spark, sf_dir)
    return A.outer_fringe(domain, domain.points, _options().set_grid("fringe_size", S.ALL_GRIDS, 2)).select(P2)


@query(f"""{L.sql_points()}, {_CELLS}, {_OVERLAP} SELECT m, n, ni AS i, nj AS j FROM over o
WHERE (SELECT volume FROM vols v WHERE v.grid_id = o.n AND v.i = o.ni AND v.j = o.nj) > (1 + 1e-10) * (SELECT sum(v.volume * (CASE WHEN v.i = o.ci THEN 1 - u ELSE u END) * (CASE WHEN v.j = o.cj THEN 1 - o.v ELSE o.v END))
  FROM vols v WHERE v.grid_id = o.m AND v.i BETWEEN o.ci AND o.ci + 1 AND v.j BETWEEN o.cj AND o.cj + 1)""")
def occlusion_coarse(spark, sf_dir):
    """Coarser points are occluded: one way only, so nothing is decided twice."""
    from .grids import _overlap
    from ..sources.grids import point_volumes

    domain = _lattice_domain(spark, sf_dir)
    points, meta, cells, overlap = _overlap(spark, sf_dir)
    volumes = point_volumes(cells, meta, 2)
    donor = A.overlap_volumes(domain, overlap, volumes)
    return A.coarser(overlap, volumes, donor).select("m", "n", F.col("ni").alias("i"), F.col("nj").alias("j"))


@query(f"""{L.sql_points()}, {_CELLS}, {_OVERLAP},
start AS (SELECT m, n, ni, nj FROM over o WHERE (SELECT volume FROM vols v WHERE v.grid_id = o.n AND v.i = o.ni AND v.j = o.nj) > (1 + 1e-10) * (SELECT sum(v.volume * (CASE WHEN v.i = o.ci THEN 1 - u ELSE u END) * (CASE WHEN v.j = o.cj THEN 1 - o.v ELSE o.v END))
  FROM vols v WHERE v.grid_id = o.m AND v.i BETWEEN o.ci AND o.ci + 1 AND v.j BETWEEN o.cj AND o.cj + 1)),
upper1 AS (SELECT m, n, ni, nj FROM over o WHERE n > m AND NOT EXISTS (SELECT 1 FROM start s WHERE s.m = o.n AND s.n = o.m AND s.ni BETWEEN o.ci AND o.ci + 1 AND s.nj BETWEEN o.cj AND o.cj + 1)),
lower1 AS (SELECT m, n, ni, nj FROM over o WHERE n < m AND NOT EXISTS (SELECT 1 FROM upper1 s WHERE s.m = o.n AND s.n = o.m AND s.ni BETWEEN o.ci AND o.ci + 1 AND s.nj BETWEEN o.cj AND o.cj + 1))
SELECT m, n, ni AS i, nj AS j FROM upper1 UNION ALL SELECT m, n, ni, nj FROM lower1""")
def occlusion_mutual(spark, sf_dir):
    """Both grids of a pair occlude each other where coarser: settled in two ordered passes."""
    from .grids import _overlap
    from ..sources.grids import point_volumes

    domain = _lattice_domain(spark, sf_dir)
    points, meta, cells, overlap = _overlap(spark, sf_dir)
    volumes = point_volumes(cells, meta, 2)
    first = A.receivers_side(A.coarser(overlap, volumes, A.overlap_volumes(domain, overlap, volumes)))
    return A.settle_mutual(domain, overlap, first, [(1, 2), (2, 1), (1, 3), (3, 1)]).select("m", "n", "i", "j")


def _whole(name: str, build, doc: str):
    def assembled(spark, sf_dir):
        domain, options = build(spark)
        return A.assemble(domain, options).report()

    assembled.__name__, assembled.__doc__ = name, doc
    query()(assembled)


_whole("assemble_box_in_box", box_in_box, "Counts of a whole assembly of two boxes, turned against each other.")
_whole("assemble_blobs", blobs, "Counts of a whole assembly of a background and three rings.")


#: Which grid occludes which (ALL), and whether the other does so in turn.
_KINDS = ((2, 1, False), (3, 1, True), (1, 3, True))
_ASSEMBLIES: dict[tuple[str, str], A.Assembly] = {}


def _lattice_assembly(spark, sf_dir) -> A.Assembly:
    """The whole assembly of the driver's lattices; one in a session serves all queries over it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ASSEMBLIES:
        o = _options(edge_padding=1, connection_type="LINEAR", minimize_overlap=True)
        for m, n, _ in _KINDS:
            o.set_pair("occludes", m, n, "ALL")
        o.set_grid("fringe_size", S.ALL_GRIDS, 1).set_grid("edge_smoothing", S.ALL_GRIDS, 1).set_grid("infer_boundaries", S.ALL_GRIDS, True)
        _ASSEMBLIES[key] = A.assemble(_lattice_domain(spark, sf_dir, L.CALM), o)
    return _ASSEMBLIES[key]


def _around(name: str, mask: str) -> str:
    """CTE: how many of the mask's points lie within one of each point (grid_id, i, j, n)."""
    return f"{name} AS MATERIALIZED (SELECT grid_id, i + a AS i, j + b AS j, count(*) AS n FROM {mask}, moves GROUP BY grid_id, i + a, j + b)"


_WHOLE = "((least(i + 1, ni - 1) - greatest(i - 1, 0) + 1) * (least(j + 1, nj - 1) - greatest(j - 1, 0) + 1))"  # a point's neighbourhood within its grid

#: The same assembly, stage by stage.
_ASSEMBLY = f"""{L.sql_points(flags=L.CALM)}, {_CELLS}, {_OVERLAP}, kind(m, n, back) AS (VALUES {", ".join(map(str, _KINDS))}), wanted AS MATERIALIZED (SELECT * FROM over SEMI JOIN kind USING (m, n)), moves AS MATERIALIZED (SELECT a.a, b.a AS b FROM (VALUES (-1), (0), (1)) a(a), (VALUES (-1), (0), (1)) b(a)),
seen AS MATERIALIZED (SELECT DISTINCT n AS grid_id, ni AS i, nj AS j FROM over), act AS MATERIALIZED (SELECT grid_id, i, j FROM pts WHERE (flags & 1) = 1), {_around('act_near', 'act')},
inferred AS MATERIALIZED (SELECT grid_id, i, j FROM act JOIN act_near USING (grid_id, i, j) JOIN pts USING (grid_id, i, j) ANTI JOIN seen USING (grid_id, i, j) WHERE n < 9 AND (flags & 2) = 0),
p1 AS MATERIALIZED (SELECT p.grid_id, p.i, p.j, p.flags | CASE WHEN s.grid_id IS NULL THEN 0 ELSE 8 END | CASE WHEN f.grid_id IS NULL THEN 0 ELSE 18 END AS flags
  FROM pts p LEFT JOIN seen s USING (grid_id, i, j) LEFT JOIN inferred f USING (grid_id, i, j)),
rim AS MATERIALIZED (SELECT * FROM (SELECT grid_id, i + a AS i, j + b AS j, bool_or((flags & 6) <> 0) AS wall, bool_or((flags & 6) = 0) AS free FROM p1, moves WHERE (flags & 1) = 1 GROUP BY grid_id, i + a, j + b)
  ANTI JOIN act USING (grid_id, i, j) WHERE NOT wall OR free), {_around('rim_near', 'rim')},
fringe AS MATERIALIZED (SELECT grid_id, i, j FROM act SEMI JOIN rim_near USING (grid_id, i, j)),
barred0 AS (SELECT m, n, i, j FROM kind JOIN fringe ON grid_id = m UNION SELECT m, n, i, j FROM kind JOIN pts ON grid_id = m WHERE back AND (flags & 1) = 0
  UNION SELECT k.m, k.n, ni, nj FROM kind k JOIN wanted w ON w.m = k.n AND w.n = k.m WHERE back),
barred AS MATERIALIZED (SELECT DISTINCT m, n, i + a AS i, j + b AS j FROM barred0, moves),
padded AS MATERIALIZED (SELECT DISTINCT m, n, ni, nj FROM (SELECT m, n, ni, nj, ci + a AS i, cj + b AS j FROM wanted, corner) SEMI JOIN barred USING (m, n, i, j)),
free AS MATERIALIZED (SELECT DISTINCT n AS grid_id, ni AS i, nj AS j FROM wanted ANTI JOIN padded USING (m, n, ni, nj)), base AS (SELECT DISTINCT n AS grid_id, ni AS i, nj AS j FROM wanted),
grown AS MATERIALIZED (SELECT DISTINCT p.grid_id, p.i, p.j FROM free f, moves, pts p WHERE p.grid_id = f.grid_id AND p.i = f.i + a AND p.j = f.j + b), {_around('grown_near', 'grown')},
occluded AS MATERIALIZED (SELECT grid_id, i, j FROM grown JOIN grown_near USING (grid_id, i, j) JOIN meta USING (grid_id) SEMI JOIN base USING (grid_id, i, j) WHERE n = {_WHOLE}),
may AS MATERIALIZED (SELECT DISTINCT n AS grid_id, ni AS i, nj AS j FROM wanted o LEFT JOIN padded p USING (m, n, ni, nj) LEFT JOIN occluded c ON c.grid_id = n AND c.i = ni AND c.j = nj WHERE p.m IS NULL OR c.grid_id IS NOT NULL),
shut AS MATERIALIZED (SELECT grid_id, i, j FROM occluded UNION SELECT grid_id, i, j FROM pts WHERE (flags & 1) = 0), {_around('shut_near', 'shut')},
gone AS MATERIALIZED (SELECT grid_id, i, j FROM shut JOIN shut_near USING (grid_id, i, j) JOIN meta USING (grid_id) SEMI JOIN may USING (grid_id, i, j) SEMI JOIN act USING (grid_id, i, j) WHERE n = {_WHOLE}), {_around('gone_near', 'gone')},
inside AS MATERIALIZED (SELECT grid_id, i, j FROM act SEMI JOIN gone_near USING (grid_id, i, j) ANTI JOIN gone USING (grid_id, i, j)),
p3 AS MATERIALIZED (SELECT p.grid_id, p.i, p.j, ((p.flags | CASE WHEN f.grid_id IS NULL THEN 0 ELSE 384 END | CASE WHEN o.grid_id IS NULL THEN 0 ELSE 64 END | CASE WHEN s.grid_id IS NULL THEN 0 ELSE 640 END)
    & CASE WHEN g.grid_id IS NULL THEN -1 ELSE ~257 END) | CASE WHEN g.grid_id IS NULL THEN 0 ELSE 1024 END AS flags
  FROM p1 p LEFT JOIN fringe f USING (grid_id, i, j) LEFT JOIN occluded o USING (grid_id, i, j) LEFT JOIN gone g USING (grid_id, i, j) LEFT JOIN inside s USING (grid_id, i, j)),
valid AS MATERIALIZED (SELECT m, n, ni, nj FROM (SELECT m, n, ni, nj, ci + a AS i, cj + b AS j FROM over, corner) c JOIN p3 ON p3.grid_id = m AND p3.i = c.i AND p3.j = c.j GROUP BY m, n, ni, nj HAVING bool_and((flags & 1) = 1)),
receiving AS MATERIALIZED (SELECT grid_id, i, j FROM p3 WHERE (flags & 768) <> 0 OR (flags & 65) = 65), {_around('receiving_near', 'receiving')},
near_edge AS MATERIALIZED (SELECT grid_id, i + a AS i, j + b AS j, min(greatest(abs(a), abs(b))) AS d FROM receiving JOIN receiving_near USING (grid_id, i, j), moves WHERE n < 9 GROUP BY grid_id, i + a, j + b),
distance AS MATERIALIZED (SELECT e.grid_id, e.i, e.j, CASE WHEN r.grid_id IS NULL THEN d ELSE -d END AS distance FROM near_edge e LEFT JOIN receiving r USING (grid_id, i, j)),
found AS MATERIALIZED (SELECT o.m, o.n, o.ni, o.nj, any_value(o.ci) AS ci, any_value(o.cj) AS cj, any_value(o.u) AS u, any_value(o.v) AS v, min(coalesce(d.distance, 2))::INT AS distance
  FROM over o SEMI JOIN valid USING (m, n, ni, nj) JOIN receiving r ON r.grid_id = o.n AND r.i = o.ni AND r.j = o.nj CROSS JOIN corner LEFT JOIN distance d ON d.grid_id = o.m AND d.i = o.ci + a AND d.j = o.cj + b GROUP BY o.m, o.n, o.ni, o.nj),
donors AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, ni, nj ORDER BY least(distance / 2.0, 1.0) DESC, m DESC) AS place FROM found WHERE distance > 0) WHERE place = 1),
lost AS MATERIALIZED (SELECT r.grid_id, r.i, r.j FROM receiving r LEFT JOIN donors d ON d.n = r.grid_id AND d.ni = r.i AND d.nj = r.j WHERE d.n IS NULL),
p4 AS MATERIALIZED (SELECT p.grid_id, p.i, p.j, (p.flags | CASE WHEN r.grid_id IS NULL THEN 0 ELSE 2048 END | CASE WHEN l.grid_id IS NULL THEN 0 ELSE 4096 END)::INT AS flags
  FROM p3 p LEFT JOIN receiving r USING (grid_id, i, j) LEFT JOIN lost l USING (grid_id, i, j))"""


def _assembled(select: str):
    return query(f"{_ASSEMBLY} {select}")


@_assembled("SELECT grid_id, i, j, flags FROM p4")
def assemble_lattices(spark, sf_dir):
    """Flags of every point after a whole assembly of the driver's lattices."""
    return _lattice_assembly(spark, sf_dir).points.select(*P2, "flags")


@_assembled("SELECT m, n, ni, nj, ci, cj, round(u, 9) AS u, round(v, 9) AS v FROM donors")
def choose_donors(spark, sf_dir):
    """The connections of that assembly: one donor grid and cell for each receiver that has one."""
    return _lattice_assembly(spark, sf_dir).connections.select("m", "n", "ni", "nj", F.col("begin")[0].alias("ci"), F.col("begin")[1].alias("cj"), F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


@_assembled("SELECT grid_id, i, j FROM lost")
def orphans(spark, sf_dir):
    return _lattice_assembly(spark, sf_dir).orphans.select(P2)


@_assembled("SELECT p.grid_id, p.i, p.j, coalesce(-d.m, p.flags & 1)::INT AS iblank FROM p4 p LEFT JOIN donors d ON d.n = p.grid_id AND d.ni = p.i AND d.nj = p.j")
def iblank(spark, sf_dir):
    return _lattice_assembly(spark, sf_dir).iblank().select(*P2, "iblank")


@_assembled("""SELECT grid_id, count(*) FILTER ((flags & 1) <> 0) AS active, count(*) FILTER ((flags & 16) <> 0) AS inferred, count(*) FILTER ((flags & 32) <> 0) AS holes, count(*) FILTER ((flags & 64) <> 0) AS occluded,
  count(*) FILTER ((flags & 256) <> 0) AS outer_fringe, count(*) FILTER ((flags & 512) <> 0) AS inner_fringe, count(*) FILTER ((flags & 1024) <> 0) AS minimized, count(*) FILTER ((flags & 2048) <> 0) AS receivers,
  count(*) FILTER ((flags & 4096) <> 0) AS orphans FROM p4 GROUP BY grid_id""")
def assembly_report(spark, sf_dir):
    return _lattice_assembly(spark, sf_dir).report()


@_assembled("SELECT m, n, ni AS i, nj AS j FROM padded")
def edge_padding(spark, sf_dir):
    """Overlapped points that padding keeps from occlusion, by pair."""
    return _lattice_assembly(spark, sf_dir).stages["padded"].select("m", "n", "i", "j")


@_assembled("SELECT grid_id, i, j FROM occluded")
def edge_smoothing(spark, sf_dir):
    """Points occluded by any grid, after padding and smoothing."""
    return _lattice_assembly(spark, sf_dir).stages["occluded"].select(P2)


@_assembled("SELECT grid_id, i, j, true AS removed FROM gone UNION ALL SELECT grid_id, i, j, false FROM inside")
def minimize_overlap(spark, sf_dir):
    """Points that minimising takes away, and the inner fringe it leaves."""
    stages = _lattice_assembly(spark, sf_dir).stages
    return stages["removed"].select(*P2, F.lit(True).alias("removed")).unionByName(stages["inner_fringe"].select(*P2, F.lit(False).alias("removed")))


@_assembled("SELECT grid_id, i, j FROM receiving")
def receivers(spark, sf_dir):
    return _lattice_assembly(spark, sf_dir).stages["receivers"].select(P2)


@_assembled("SELECT m, n, ni, nj, distance FROM found")
def donor_edge_distance(spark, sf_dir):
    """How far the donor cells of receivers lie from their own grid's receivers."""
    return _lattice_assembly(spark, sf_dir).stages["candidates"].select("m", "n", "ni", "nj", "distance")


@query()
def cut_boundary_holes(spark, sf_dir):
    """Points of the background within the bodies of the three rings."""
    domain, options = blobs(spark)
    out = A.assemble(domain, options).points
    return out.where(has(F.col("flags"), S.BOUNDARY_HOLE)).select(P2)
