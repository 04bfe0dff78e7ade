"""Newton inverses against known local coordinates, and what they do with bad input; grid and point edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeweave import schema as S
from latticeweave.functions.newton import inverse_udf, invert, tensor_offsets
from latticeweave.operators.overlap import detect_overlap
from latticeweave.sources.grids import analytic_points, cells_of


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("cubic", [False, True])
def test_invert(dims, cubic):
    rng = np.random.default_rng(dims)
    order = 4 if cubic else 2
    offsets = np.array([o[:dims] for o in tensor_offsets(order, dims)], float) - (1 if cubic else 0)
    nodes = offsets + 0.05 * rng.normal(size=(200, len(offsets), dims))
    local = rng.random((200, dims))
    weights = np.ones((200, 1))
    for d in range(dims):
        u = local[:, d]
        w = np.stack([u * (1 - u) * (u - 2) / 6, (u * u - 1) * (u - 2) / 2, u * (u + 1) * (2 - u) / 2, u * (u * u - 1) / 6] if cubic else [1 - u, u], 1)
        weights = (w[:, :, None] * weights[:, None, :]).reshape(200, -1)
    points = np.einsum("rn,rnd->rd", weights, nodes)
    found = invert(nodes, points, cubic)
    assert np.abs(found - local).max() < 1e-9


def test_inverse_of_bad_input(spark):
    square = [0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0]
    rows = [(0, square, [0.25, 0.5]), (1, None, [0.25, 0.5]), (2, square, None), (3, square[:6], [0.25, 0.5]), (4, square, [float("nan"), 0.5]), (5, [0.0] * 8, [1.0, 0.5]), (6, square, [None, 0.5])]
    df = spark.createDataFrame(rows, "id int, nodes array<double>, p array<double>").select("id", inverse_udf(2, False)("nodes", "p").alias("local"))
    assert {r.id: r.local for r in df.collect()} == {0: [0.25, 0.5]} | {k: None for k in range(1, 7)}


def wavy(spark, size=10):
    """Two wavy grids, the second over the middle of the first, which has a hole already cut."""
    a, pi = 0.125, "pi()"
    h = 2 * (size // 4 - 1)
    lo, hi = (size - h) // 2, (size - h) // 2 + h
    grids = [S.Grid(1, (size, size, 1)), S.Grid(2, (size, size, 1))]
    coords = {}
    for g, (start, step) in ((1, (0, 1)), (2, (0.25 * (size - 1), 0.5))):
        u, v = (f"(({start}D + {step}D * {x}) / {size - 1})" for x in "ij")
        coords[g] = (f"-1 + 2 * {u} + {a}D * sin(2 * {pi} * {v})", f"-1 + 2 * {v} + {a}D * sin(2 * {pi} * {u})", "0")
    hole = (F.col("grid_id") == 1) & F.col("i").between(lo, hi - 1) & F.col("j").between(lo, hi - 1)
    return grids, analytic_points(spark, grids, coords, F.when(hole, 0).otherwise(S.ACTIVE))


def test_wavy_overlap(spark):
    grids, points = wavy(spark)
    meta = S.grid_table(spark, grids)
    pairs = spark.createDataFrame([(1, 2, 1e-12), (2, 1, 1e-12), (1, 1, 1e-12)], "m int, n int, tolerance double")
    rows = detect_overlap(points, cells_of(points, meta, 2), meta, grids, pairs).collect()
    one, two = ([r for r in rows if (r.m, r.n) == p] for p in ((1, 2), (2, 1)))
    assert (len(rows), len(one), len(two)) == (76, 64, 12)  # a grid never overlaps itself
    for r in one:
        assert (r.ci, r.cj) == (2 + r.ni // 2, 2 + r.nj // 2)
        assert abs(r.u - (0.75 if r.ni % 2 else 0.25)) < 1e-2 and abs(r.v - (0.75 if r.nj % 2 else 0.25)) < 1e-2
    for r in two:
        assert (r.ci, r.cj) == (2 * (r.ni - 3) + 1, 2 * (r.nj - 3) + 1)


def test_cylinder_overlap(spark):
    size, overlap, s = 8, 4, 0.5
    inner, outer = (size // 2 + 1 + overlap - overlap // 2, 2 * size, 1), (size - size // 2 + 1 + overlap // 2, 2 * size, 1)
    grids = [S.Grid(1, inner, periodic=(False, True, False)), S.Grid(2, outer, periodic=(False, True, False))]
    r, a = (lambda x: f"(0.1D * power(10, ({x}) / {size + s}))"), (lambda y: f"(2 * pi() * ({y}) / {2 * size})")
    x2, y2 = f"{inner[0]} - {s}D - {overlap} + i", f"{s}D + j"
    coords = {1: (f"{r('i')} * cos({a('j')})", f"{r('i')} * sin({a('j')})", "0"), 2: (f"{r(x2)} * cos({a(y2)})", f"{r(x2)} * sin({a(y2)})", "0")}
    points = analytic_points(spark, grids, coords)
    meta = S.grid_table(spark, grids)
    rows = detect_overlap(points, cells_of(points, meta, 2), meta, grids, spark.createDataFrame([(1, 2, 1e-12), (2, 1, 1e-12)], "m int, n int, tolerance double")).collect()
    one, two = ([r for r in rows if (r.m, r.n) == p] for p in ((1, 2), (2, 1)))
    assert {(r.ni, r.nj, r.ci, r.cj) for r in one} == {(i, j, i + 2, j) for i in range(4) for j in range(16)}
    assert {(r.ni, r.nj, r.ci, r.cj) for r in two} == {(i, j, i - 3, (j - 1) % 16) for i in range(3, 7) for j in range(16)}
    assert all(abs(r.u - 0.5) < 1e-2 and abs(r.v - 0.5) < 1e-2 for r in rows)


def test_missing_coordinates_are_never_found(spark):
    grids, points = wavy(spark)
    meta = S.grid_table(spark, grids)
    bad = points.withColumn("x", F.when((F.col("grid_id") == 2) & (F.col("i") == 0), F.lit(float("nan"))).when((F.col("grid_id") == 2) & (F.col("i") == 1), F.lit(float("inf"))).when((F.col("grid_id") == 2) & (F.col("i") == 2), F.lit(None)).otherwise(F.col("x")))
    pairs = spark.createDataFrame([(1, 2, 1e-12)], "m int, n int, tolerance double")
    rows = detect_overlap(bad, cells_of(bad.where("grid_id = 1"), meta, 2), meta, grids, pairs).collect()
    assert rows and min(r.ni for r in rows) > 2
