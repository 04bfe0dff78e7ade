"""Index arithmetic, boxes, ranges, flags, arrays and small linear algebra over the rows of lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import arrays, geometry, index, text
from .registry import query, table

#: Small integers of each row, as Spark and as DuckDB have them.
_NUMBERS = "l_orderkey, l_linenumber, cast(l_partkey % 41 - 20 as int) p, cast(l_suppkey % 17 - 8 as int) s, cast(l_quantity as int) q, l_returnflag = 'A' per"
_ROWS = f"WITH r AS (SELECT {_NUMBERS} FROM lineitem)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(x.strip() if " " not in x.strip() else x.strip()[: x.strip().rindex(" ")] + " as " + x.strip().split()[-1] for x in _NUMBERS.split(", ")))


KEY = ["l_orderkey", "l_linenumber"]
c = F.col


@query(f"{_ROWS} SELECT l_orderkey, l_linenumber, ((p - s) % (q + 1) + q + 1) % (q + 1) + s AS adjusted, floor((p - s) / (q + 1))::INT AS period_no FROM r")
def index_periodic_adjust(spark, sf_dir):
    return _rows(spark, sf_dir).select(*KEY, index.periodic_adjust(c("p"), c("s"), c("q") + 1).alias("adjusted"), index.period_number(c("p"), c("s"), c("q") + 1).alias("period_no"))


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber, CASE WHEN t >= s AND t < s + 6 THEN t END AS mapped
FROM (SELECT *, CASE WHEN per THEN s + ((p - s) % 11 + 11) % 11 ELSE p END AS t FROM r)""")
def index_map_to_range(spark, sf_dir):
    return _rows(spark, sf_dir).select(*KEY, index.map_to_range(c("p"), F.lit(-20), F.lit(11), c("per"), c("s"), c("s") + 6).alias("mapped"))


@query(f"""{_ROWS}, t AS (SELECT *, q % 6 AS wide, CASE WHEN per THEN ((s + 20) % 11 + 11) % 11 - 20 ELSE s END AS s0, CASE WHEN per THEN ((p + 20) % 11 + 11) % 11 - 20 ELSE p END AS p0 FROM r),
u AS (SELECT *, CASE WHEN per THEN s + ((p - s) % 11 + 11) % 11 ELSE p END AS corner FROM t),
b AS (SELECT *, CASE WHEN wide > 0 AND p < s + 6 AND s < p + wide THEN p WHEN corner >= s AND corner < s + 6 THEN corner WHEN wide > 0 AND p0 < s0 + 6 AND s0 < p0 + wide THEN p0
  WHEN wide > 0 AND per AND p0 - 11 < s0 + 6 AND s0 < p0 - 11 + wide THEN p0 - 11 END AS mapped FROM u)
SELECT l_orderkey, l_linenumber, mapped AS begin_at, mapped + wide AS end_at, mapped IS NOT NULL AS possible FROM b""")
def index_map_range(spark, sf_dir):
    begin, end = index.map_range([(F.lit(-20), F.lit(11), c("per"))], [(c("s"), c("s") + 6)], [(c("p"), c("p") + c("q") % 6)])[0][0]
    possible = index.map_range([(F.lit(-20), F.lit(11), c("per"))], [(c("s"), c("s") + 6)], [(c("p"), c("p") + c("q") % 6)])[1]
    return _rows(spark, sf_dir).select(*KEY, begin.alias("begin_at"), end.alias("end_at"), possible.alias("possible"))


@query(f"""{_ROWS}, t AS (SELECT *, greatest(-20, p) AS b, least(21, p + 8) AS e FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN b <> -20 OR per THEN b - 2 ELSE b END AS halo_b, CASE WHEN e <> 21 OR per THEN e + 2 ELSE e END AS halo_e, CASE WHEN b = -20 AND NOT per THEN b - 1 ELSE b END AS ring_b,
  CASE WHEN e = 21 AND NOT per THEN e + 1 ELSE e END AS ring_e, e + 1 AS points_e, s AS second_b, s + 3 AS second_e FROM t""")
def range_extents(spark, sf_dir):
    """Halos, exterior rings, points of cells, and intervals put together."""
    own, whole, per = [(F.greatest(F.lit(-20), c("p")), F.least(F.lit(21), c("p") + 8))], [(F.lit(-20), F.lit(21))], [c("per")]
    halo, ring, both = index.extend_local_range(own, whole, per, 2)[0], index.with_exterior(own, whole, per)[0], index.concat(own, [(c("s"), c("s") + 3)])
    return _rows(spark, sf_dir).select(*KEY, halo[0].alias("halo_b"), halo[1].alias("halo_e"), ring[0].alias("ring_b"), ring[1].alias("ring_e"), index.points_of_cells(own)[0][1].alias("points_e"), both[1][0].alias("second_b"), both[1][1].alias("second_e"))


@query(f"""{_ROWS}, t AS (SELECT *, p + 20 AS i, s + 8 AS j, q % 7 AS k FROM r)
SELECT l_orderkey, l_linenumber, (i + 41 * (j + 17 * k))::BIGINT AS by_column, (k + 7 * (j + 17 * i))::BIGINT AS by_row, p AS ti, s AS tj, k + 3 AS tk FROM t""")
def index_linearise(spark, sf_dir):
    k = c("q") % 7 + 3
    rows = _rows(spark, sf_dir).withColumn("n", index.linear_index(c("p"), c("s"), k, -20, -8, 3, 41, 17))
    back = index.tuple_of(c("n"), F.lit(-20), F.lit(-8), F.lit(3), F.lit(41), F.lit(17))
    return rows.select(*KEY, c("n").alias("by_column"), index.linear_index_row_major(c("p"), c("s"), k, -20, -8, 3, 17, 7).alias("by_row"), *(x.alias(n) for x, n in zip(back, ("ti", "tj", "tk"))))


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber, floor((p * 0.25 - s) / 0.75)::BIGINT AS cell_real, floor((p - s) / 3)::BIGINT AS cell_int FROM r""")
def index_uniform_cell(spark, sf_dir):
    return _rows(spark, sf_dir).select(*KEY, index.uniform_cell(c("p") * 0.25, c("s"), 0.75).alias("cell_real"), index.uniform_cell(c("p"), c("s"), 3).alias("cell_int"))


@query(f"""{_ROWS}, t AS (SELECT *, p AS b1, p + q % 9 - 2 AS e1, s AS b2, s + 5 AS e2, q % 9 - 2 <= 0 AS empty1 FROM r)
SELECT l_orderkey, l_linenumber, greatest(b1, b2) AS inter_b, least(e1, e2) AS inter_e,
  CASE WHEN empty1 THEN b2 ELSE least(b1, b2) END AS union_b, CASE WHEN empty1 THEN e2 ELSE greatest(e1, e2) END AS union_e,
  NOT empty1 AND greatest(b1, b2) < least(e1, e2) AS overlap,
  CASE WHEN empty1 THEN s ELSE least(b1, s) END AS ext_b, CASE WHEN empty1 THEN s + 1 ELSE greatest(e1, s + 1) END AS ext_e,
  greatest(b2, least(e2 - 1, p)) AS clamped, p >= b2 AND p < e2 AS contains, empty1 OR (b1 >= b2 AND e1 <= e2) AS includes, CASE WHEN empty1 THEN 0 ELSE e1 - b1 END::BIGINT AS n FROM t""")
def range_ops(spark, sf_dir):
    one, two = [(c("p"), c("p") + c("q") % 9 - 2)], [(c("s"), c("s") + 5)]
    (ib, ie), (ub, ue), (eb, ee) = index.intersect(one, two)[0], index.union(one, two)[0], index.extend_range(one, [c("s")])[0]
    return _rows(spark, sf_dir).select(
        *KEY, ib.alias("inter_b"), ie.alias("inter_e"), ub.alias("union_b"), ue.alias("union_e"), index.ranges_overlap(one, two).alias("overlap"), eb.alias("ext_b"), ee.alias("ext_e"),
        index.clamp_to_range(two, [c("p")])[0].alias("clamped"), index.range_contains(two, [c("p")]).alias("contains"), index.includes(two, one).alias("includes"), index.count(one).alias("n"),
    )


@query(f"""{_ROWS}, t AS (SELECT *, p * 0.5 AS b1, p * 0.5 + (q % 9 - 2) AS e1, s * 0.25 AS b2, s * 0.25 + 5 AS e2, q % 9 - 2 < 0 AS empty1 FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN empty1 THEN b2 ELSE least(b1, b2) END::DOUBLE AS union_b, CASE WHEN empty1 THEN e2 ELSE greatest(e1, e2) END::DOUBLE AS union_e,
  NOT empty1 AND greatest(b1, b2) <= least(e1, e2) AS overlap, (CASE WHEN empty1 THEN b1 ELSE b1 - 0.5 END)::DOUBLE AS grow_b, (CASE WHEN empty1 THEN e1 ELSE e1 + 0.5 END)::DOUBLE AS grow_e,
  ((b1 + e1) / 2 - (e1 - b1))::DOUBLE AS scale_b, ((b1 + e1) / 2 + (e1 - b1))::DOUBLE AS scale_e, (b1 + s)::DOUBLE AS move_b, (e1 + s)::DOUBLE AS move_e,
  greatest(b2, least(e2, p))::DOUBLE AS clamped, p BETWEEN b2 AND e2 AS contains, (CASE WHEN empty1 THEN p ELSE least(b1, p) END)::DOUBLE AS ext_b, (CASE WHEN empty1 THEN p ELSE greatest(e1, p) END)::DOUBLE AS ext_e,
  (CASE WHEN empty1 THEN 0 ELSE e1 - b1 END)::DOUBLE AS volume FROM t""")
def box_ops(spark, sf_dir):
    one, two, p = [(c("p") * F.lit(0.5), c("p") * F.lit(0.5) + (c("q") % 9 - 2))], [(c("s") * F.lit(0.25), c("s") * F.lit(0.25) + 5.0)], c("p").cast("double")
    pairs = {"union": index.union(one, two, index.box_empty)[0], "grow": index.grow_box(one, [0.5])[0], "scale": index.scale_box(one, [2.0])[0], "move": index.move_box(one, [c("s")])[0], "ext": index.extend_box(one, [p])[0]}
    return _rows(spark, sf_dir).select(
        *KEY, *(x.alias(f"{n}_{e}") for n, be in pairs.items() for e, x in zip("be", be)), index.boxes_overlap(one, two).alias("overlap"),
        index.clamp_to_box(two, [p])[0].alias("clamped"), index.box_contains(two, [p]).alias("contains"), index.box_volume(one).alias("volume"),
    )


@query(f"""{_ROWS}, t AS (SELECT *, (q * 37 + p + 20) & 8191 AS f FROM r)
SELECT l_orderkey, l_linenumber, f | 2048 AS set_bits, f & ~65 AS cleared, (f & 5) <> 0 AS has_any, xor(f, 8191) AS flipped, (f & 3) = 3 AS boundary, (f & 5) = 5 AS internal FROM t""")
def state_flags_ops(spark, sf_dir):
    f = (c("q") * 37 + c("p") + 20).bitwiseAND(F.lit(8191))
    return _rows(spark, sf_dir).select(
        *KEY, index.set_bits(f, S.RECEIVER).alias("set_bits"), index.clear_bits(f, S.ACTIVE | S.OCCLUDED).alias("cleared"), index.has(f, S.ACTIVE | S.INTERNAL_BOUNDARY).alias("has_any"), f.bitwiseXOR(F.lit(8191)).alias("flipped"),
        (index.has(f, S.ACTIVE) & index.has(f, S.DOMAIN_BOUNDARY)).alias("boundary"), (index.has(f, S.ACTIVE) & index.has(f, S.INTERNAL_BOUNDARY)).alias("internal"),
    )


@query(f"""{_ROWS}, t AS (SELECT *, (q * 37 + p + 20) & 8191 AS f FROM r),
u AS (SELECT *, CASE WHEN (f & (32 | 1024)) <> 0 THEN f | 1 ELSE f END AS g FROM t)
SELECT l_orderkey, l_linenumber, f AS flags, (CASE WHEN (g & 16) <> 0 THEN g & ~2 ELSE g END) & ~8184 AS reset FROM u""")
def reset_assembly_flags(spark, sf_dir):
    from ..plans.assembly import reset_flags

    rows = _rows(spark, sf_dir).withColumn("before", (c("q") * 37 + c("p") + 20).bitwiseAND(F.lit(8191))).withColumn("flags", c("before"))
    return reset_flags(rows).select(*KEY, c("before").alias("flags"), c("flags").alias("reset"))


@query(f"""{_ROWS}, t AS (SELECT *, [p, s, q, p] AS a FROM r)
SELECT l_orderkey, l_linenumber, list_sum(a)::BIGINT AS total, p * 1000 + s * 100 + q * 10 + p AS folded, p - s - q - p AS collapsed, list_min(a) AS least, list_max(a) AS most,
  p > 0 OR s > 0 OR q > 0 AS any_positive, p > 0 AND s > 0 AND q > 0 AS all_positive, NOT (p > 0 OR s > 0 OR q > 0) AS none_positive, NOT (p > 0 AND s > 0 AND q > 0) AS not_all_positive,
  array_to_string([2 * p, 2 * s, 2 * q, 2 * p], ',') AS doubled, array_to_string([p, 7, 7, p], ',') AS filled FROM t""")
def array_toolbox(spark, sf_dir):
    a, up = c("a"), lambda x: x > 0
    folded = arrays.array_reduce(a, F.lit(0), lambda acc, x: acc * 10 + x)
    return _rows(spark, sf_dir).withColumn("a", F.array("p", "s", "q", "p")).select(
        *KEY, arrays.array_sum(a, F.lit(0).cast("long")).alias("total"), folded.alias("folded"), arrays.array_collapse(a, lambda acc, x: acc - x).alias("collapsed"), arrays.array_min(a).alias("least"), arrays.array_max(a).alias("most"),
        arrays.array_any(a, up).alias("any_positive"), arrays.array_all(a, up).alias("all_positive"), arrays.array_none(a, up).alias("none_positive"), arrays.array_not_all(a, up).alias("not_all_positive"),
        F.array_join(arrays.array_transform(a, lambda x: 2 * x), ",").alias("doubled"), F.array_join(arrays.array_fill_interval(a, 1, 3, 7), ",").alias("filled"),
    )


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber, array_to_string([9, 8, q, p], ',') AS listed, array_to_string([s, s, s, s], ',') AS copied, array_to_string([7, 7, 7, 7], ',') AS same FROM r""")
def array_fills(spark, sf_dir):
    """Arrays filled from a list, from another array and with one value."""
    a = F.array("p", "s", "q", "p")
    named = {"listed": arrays.array_fill_list(a, [9, 8]), "copied": arrays.array_fill_from(a, F.array("s", "s", "s", "s")), "same": arrays.array_fill(a, 7)}
    return _rows(spark, sf_dir).select(*KEY, *(F.array_join(x, ",").alias(n) for n, x in named.items()))


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber, i::INT AS i FROM r, range(0, 6) t(i) WHERE i >= q % 4 AND i < p % 6""")
def index_for_each(spark, sf_dir):
    """One row for each index of an interval."""
    return _rows(spark, sf_dir).select(*KEY, arrays.for_each_index(c("q") % 4, c("p") % 6).alias("i"))


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber, (p % 5 = 0) AS missing FROM r""")
def missing_values(spark, sf_dir):
    """Null, not a number or infinite."""
    x = F.when(c("p") % 10 == 0, F.lit(float("nan"))).when(c("p") % 5 == 0, F.when(c("s") > 0, F.lit(float("inf")))).otherwise(c("q") * 1.0)
    return _rows(spark, sf_dir).select(*KEY, geometry.is_missing(x).alias("missing"))


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber,
  (SELECT string_agg(i::VARCHAR, ',' ORDER BY x, i) FROM (VALUES (0, p), (1, s), (2, q), (3, p)) v(i, x)) AS places FROM r""")
def array_order(spark, sf_dir):
    return _rows(spark, sf_dir).select(*KEY, F.array_join(arrays.array_order(F.array("p", "s", "q", "p")), ",").alias("places"))


@query("""SELECT l_returnflag, l_linestatus, concat(format('{:,}', count(*)), CASE WHEN count(*) = 1 THEN ' row' ELSE ' rows' END) AS message,
  concat(l_returnflag, '/', l_linestatus, ' has ', count(*)) AS printed, replace(concat(l_returnflag, '-', l_linestatus), '-', '::') AS replaced FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def text_messages(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.select(
        "l_returnflag", "l_linestatus", text.format_number(c("n"), "rows", "row").alias("message"), text.string_print("%s/%s has %d", c("l_returnflag"), c("l_linestatus"), c("n")).alias("printed"),
        text.string_replace(text.string_join(F.array("l_returnflag", "l_linestatus"), "-"), "-", "::").alias("replaced"),
    )


@query(f"""{_ROWS}, t AS (SELECT *, (p / 8)::DOUBLE AS u FROM r)
SELECT l_orderkey, l_linenumber, 1.0 - u AS w0, u AS w1, u * (1.0 - u) * (u - 2.0) / 6.0 AS c0, (u * u - 1.0) * (u - 2.0) / 2.0 AS c1, u * (u + 1.0) * (2.0 - u) / 2.0 AS c2, u * (u * u - 1.0) / 6.0 AS c3,
  -(3.0 * u * u - 6.0 * u + 2.0) / 6.0 AS d0, (3.0 * u * u - 4.0 * u - 1.0) / 2.0 AS d1, -(3.0 * u * u - 2.0 * u - 2.0) / 2.0 AS d2, (3.0 * u * u - 1.0) / 6.0 AS d3 FROM t""")
def lagrange_weights(spark, sf_dir):
    u = c("p") / F.lit(8.0)
    named = {"w": geometry.linear_weights(u), "c": geometry.cubic_weights(u), "d": geometry.cubic_slopes(u)}
    return _rows(spark, sf_dir).select(*KEY, *(x.alias(f"{n}{i}") for n, xs in named.items() for i, x in enumerate(xs)))


@query(f"""{_ROWS}, t AS (SELECT *, p::DOUBLE a, s::DOUBLE b, q::DOUBLE c, 2.0::DOUBLE d, 3.0::DOUBLE r0, (p + s)::DOUBLE r1 FROM r)
SELECT l_orderkey, l_linenumber, a * d - b * c AS det, CASE WHEN a * d - b * c <> 0 THEN (r0 * d - r1 * c) / (a * d - b * c) END AS x0, CASE WHEN a * d - b * c <> 0 THEN (a * r1 - b * r0) / (a * d - b * c) END AS x1 FROM t""")
def column_solve_2d(spark, sf_dir):
    a, b, r = [c("p") * 1.0, c("s") * 1.0], [c("q") * 1.0, F.lit(2.0)], [F.lit(3.0), (c("p") + c("s")) * 1.0]
    x = geometry.solve2(a, b, r)
    return _rows(spark, sf_dir).select(*KEY, geometry.det2(a, b).alias("det"), x[0].alias("x0"), x[1].alias("x1"))


@query(f"""{_ROWS}, t AS (SELECT *, p::DOUBLE a0, s::DOUBLE a1, q::DOUBLE b0, p::DOUBLE b2, s::DOUBLE c1, q::DOUBLE c2 FROM r),
u AS (SELECT *, a0 * (2.0 * c2 - b2 * c1) + a1 * (b2 * 1.0 - b0 * c2) + 1.0 * (b0 * c1 - 2.0 * 1.0) AS det,
  5.0 * (2.0 * c2 - b2 * c1) + 6.0 * (b2 * 1.0 - b0 * c2) + 7.0 * (b0 * c1 - 2.0 * 1.0) AS n0,
  a0 * (6.0 * c2 - 7.0 * c1) + a1 * (7.0 * 1.0 - 5.0 * c2) + 1.0 * (5.0 * c1 - 6.0 * 1.0) AS n1,
  a0 * (2.0 * 7.0 - b2 * 6.0) + a1 * (b2 * 5.0 - b0 * 7.0) + 1.0 * (b0 * 6.0 - 2.0 * 5.0) AS n2 FROM t)
SELECT l_orderkey, l_linenumber, det, CASE WHEN det <> 0 THEN n0 / det END AS x0, CASE WHEN det <> 0 THEN n1 / det END AS x1, CASE WHEN det <> 0 THEN n2 / det END AS x2 FROM u""")
def column_solve_3d(spark, sf_dir):
    p, s, q = (c(x) * 1.0 for x in "psq")
    one, two, three, r = [p, s, F.lit(1.0)], [q, F.lit(2.0), p], [F.lit(1.0), s, q], [F.lit(5.0), F.lit(6.0), F.lit(7.0)]
    return _rows(spark, sf_dir).select(*KEY, geometry.det3(one, two, three).alias("det"), *(x.alias(f"x{i}") for i, x in enumerate(geometry.solve3(one, two, three, r))))


#: Corners of a quadrilateral and a hexahedron that move with the row's numbers; all coordinates are eighths, so arithmetic is exact.
_QUAD = [("p", "s"), ("p + 4 + q / 8.0", "s + 0.5"), ("p - 0.5", "s + 3"), ("p + 5", "s + 4 + q / 8.0")]
_HEX = [(x, y, z) for z, lift in (("0.0", "0.0"), ("3 + q / 8.0", "0.25")) for x, y in ((f"p + {lift}", "s + 0.0"), (f"p + 4 + {lift}", "s + 0.5"), ("p + 0.0", f"s + 3 + {lift}"), (f"p + 4.5 + {lift}", "s + 4.0"))]


def _nodes(corners):
    return [[F.expr(f"cast({x} as double)") for x in n] for n in corners]


def _sql_nodes(corners) -> str:
    return ", ".join(f"({x})::DOUBLE AS {a}{v}" for v, n in enumerate(corners) for a, x in zip("xyz", n))


def _sql_simplices(parts, d: int) -> list[str]:
    """The determinant of each simplex's sides."""
    side = lambda v, o, a: f"({a}{v} - {a}{o})"
    out = []
    for o, *rest in parts:
        m = [[side(v, o, a) for a in "xyz"[:d]] for v in rest]
        if d == 2:
            out.append(f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})")
        else:
            out.append("(" + " + ".join(f"{m[0][i]} * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]})" for i in range(3)) + ")")
    return out


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber, (q - p)::DOUBLE AS line, ((q - p) * (s + 2))::DOUBLE AS quad, ((q - p) * (s + 2) * 3)::DOUBLE AS hex, (2 * (q * q + 1))::DOUBLE AS oriented FROM r""")
def cell_volume_uniform(spark, sf_dir):
    p, s, q = (c(x) * 1.0 for x in "psq")
    z = F.lit(0.0)
    square = [[z, z], [q, z + 1.0], [z - 2.0, 2.0 * q], [q - 2.0, 2.0 * q + 1.0]]  # perpendicular edges
    return _rows(spark, sf_dir).select(
        *KEY, geometry.volume("UNIFORM", [[p], [q]]).alias("line"), geometry.volume("UNIFORM", [[p, z], None, None, [q, s + 2.0]]).alias("quad"),
        geometry.volume("RECTILINEAR", [[p, z, z], [q, s + 2.0, z + 3.0]]).alias("hex"), geometry.volume("ORIENTED_UNIFORM", square).alias("oriented"),
    )


@query(f"""{_ROWS}, t AS (SELECT *, {_sql_nodes(_QUAD)} FROM r)
SELECT l_orderkey, l_linenumber, ({' + '.join('abs' + x for x in _sql_simplices(geometry.TRIANGLES, 2))}) / 2 AS volume FROM t""")
def cell_volume_quad(spark, sf_dir):
    return _rows(spark, sf_dir).select(*KEY, geometry.volume("CURVILINEAR", _nodes(_QUAD)).alias("volume"))


@query(f"""{_ROWS}, t AS (SELECT *, {_sql_nodes(_HEX)} FROM r)
SELECT l_orderkey, l_linenumber, ({' + '.join('abs' + x for x in _sql_simplices(geometry.TETRAHEDRA, 3))}) / 6 AS volume FROM t""")
def cell_volume_hex(spark, sf_dir):
    return _rows(spark, sf_dir).select(*KEY, geometry.volume("CURVILINEAR", _nodes(_HEX)).alias("volume"))


@query(f"""{_ROWS}, t AS (SELECT *, {_sql_nodes(_HEX)} FROM r)
SELECT l_orderkey, l_linenumber, {', '.join(f"{f}({', '.join(f'{a}{v}' for v in range(8))}) AS {n}_{a}" for a in 'xyz' for f, n in (('least', 'lo'), ('greatest', 'hi')))} FROM t""")
def cell_bounds(spark, sf_dir):
    return _rows(spark, sf_dir).select(*KEY, *(x.alias(f"{n}_{a}") for a, be in zip("xyz", geometry.bounds(_nodes(_HEX))) for n, x in zip(("lo", "hi"), be)))


def _sql_contains(parts, d: int) -> str:
    """Barycentric coordinates by the areas (volumes) of the parts with one corner moved to the point (number 9)."""
    tests = []
    for part in parts:
        whole = _sql_simplices([part], d)[0]
        shares = [_sql_simplices([[*part[:k], 9, *part[k + 1 :]]], d)[0] for k in range(d + 1)]
        tests.append(f"({whole} <> 0 AND {' AND '.join(f'{x} / {whole} >= 0' for x in shares)})")
    return " OR ".join(tests)


@query(f"""{_ROWS}, t AS (SELECT *, {_sql_nodes(_QUAD)}, (p + q / 8.0)::DOUBLE AS x9, (s + q / 16.0)::DOUBLE AS y9 FROM r)
SELECT l_orderkey, l_linenumber, {_sql_contains(geometry.TRIANGLES, 2)} AS inside FROM t""")
def contains_quad_triangles(spark, sf_dir):
    point = [F.expr("cast(p + q / 8.0 as double)"), F.expr("cast(s + q / 16.0 as double)")]
    return _rows(spark, sf_dir).select(*KEY, geometry.contains("CURVILINEAR", _nodes(_QUAD), point).alias("inside"))


@query(f"""{_ROWS}, t AS (SELECT *, {_sql_nodes(_HEX)}, (p + q / 8.0)::DOUBLE AS x9, (s + q / 16.0)::DOUBLE AS y9, (q / 32.0)::DOUBLE AS z9 FROM r)
SELECT l_orderkey, l_linenumber, {_sql_contains(geometry.TETRAHEDRA, 3)} AS inside FROM t""")
def contains_hex_tets(spark, sf_dir):
    point = [F.expr("cast(p + q / 8.0 as double)"), F.expr("cast(s + q / 16.0 as double)"), F.expr("cast(q / 32.0 as double)")]
    return _rows(spark, sf_dir).select(*KEY, geometry.contains("CURVILINEAR", _nodes(_HEX), point).alias("inside"))


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber, q BETWEEN 10 AND 14 AS on_line, q BETWEEN 10 AND 14 AND s BETWEEN -2 AND 2 AS in_quad, q BETWEEN 9 AND 15 AS with_tolerance FROM r""")
def contains_uniform(spark, sf_dir):
    q, s = c("q") * 1.0, c("s") * 1.0
    line, corner = lambda x: [F.lit(float(x))], lambda x, y: [F.lit(float(x)), F.lit(float(y))]
    return _rows(spark, sf_dir).select(
        *KEY, geometry.contains("UNIFORM", [line(10), line(14)], [q]).alias("on_line"), geometry.contains("RECTILINEAR", [corner(10, -2), None, None, corner(14, 2)], [q, s]).alias("in_quad"),
        geometry.contains("UNIFORM", [line(10), line(14)], [q], 0.25).alias("with_tolerance"),
    )


@query(f"""{_ROWS}, t AS (SELECT *, {_sql_nodes(_QUAD)}, (q / 64.0)::DOUBLE AS u FROM r)
SELECT l_orderkey, l_linenumber, {', '.join(f'(1 - u) * (1 - u) * {a}0 + u * (1 - u) * {a}1 + (1 - u) * u * {a}2 + u * u * {a}3 AS f{a}' for a in 'xy')} FROM t""")
def iso_forward_maps(spark, sf_dir):
    u = F.expr("cast(q / 64.0 as double)")
    return _rows(spark, sf_dir).select(*KEY, *(x.alias(f"f{a}") for a, x in zip("xy", geometry.iso_forward(_nodes(_QUAD), [u, u]))))


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber, (p - s) / 4.0::DOUBLE AS u, CASE WHEN q <> 3 THEN (p - 3) / (q - 3)::DOUBLE END AS v, (p + s) / 4.0::DOUBLE AS ou, (s - p) / 4.0::DOUBLE AS ov FROM r""")
def iso_inverse_affine(spark, sf_dir):
    p, s, q, z = c("p") * 1.0, c("s") * 1.0, c("q") * 1.0, F.lit(0.0)
    u, v = geometry.inverse_uniform([s, F.lit(3.0)], [s + 4.0, q], [p, p])
    turned = [[z, z], [z + 2.0, z + 2.0], [z - 2.0, z + 2.0], [z, z + 4.0]]
    ou, ov = geometry.inverse_oriented(turned, [p, s])
    return _rows(spark, sf_dir).select(*KEY, u.alias("u"), v.alias("v"), ou.alias("ou"), ov.alias("ov"))


@query(f"""{_ROWS} SELECT l_orderkey, l_linenumber, round(q / 64.0, 6)::DOUBLE AS u, round(q / 128.0, 6)::DOUBLE AS v, round(q / 64.0, 6)::DOUBLE AS cu, round(q / 128.0, 6)::DOUBLE AS cv FROM r""")
def iso_inverse_newton(spark, sf_dir):
    """Points mapped forward by known local coordinates are found again, in bilinear and in bicubic cells."""
    from ..functions.newton import inverse_udf

    u, v = F.expr("cast(q / 64.0 as double)"), F.expr("cast(q / 128.0 as double)")
    flat = lambda nodes: F.array(*(x for n in nodes for x in n))
    quad = _nodes(_QUAD)
    bent = [[F.lit(float(i)) + F.lit(0.0625 * (j - 1) * j), F.lit(float(j)) + F.lit(0.03125 * i * i)] for j in range(-1, 3) for i in range(-1, 3)]
    rows = _rows(spark, sf_dir).select(*KEY, inverse_udf(2, False)(flat(quad), F.array(*geometry.iso_forward(quad, [u, v]))).alias("a"), inverse_udf(2, True)(flat(bent), F.array(*geometry.iso_forward(bent, [u, v], cubic=True))).alias("b"))
    return rows.select(*KEY, *(F.round(F.col(n)[d], 6).alias(x) for n, d, x in (("a", 0, "u"), ("a", 1, "v"), ("b", 0, "cu"), ("b", 1, "cv"))))
