"""Mask operators on the case grid (1 to 3 dimensions, every kind of side) against dense arrays; tables written and read back."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeweave import schema as S
from latticeweave.operators import masks as M
from latticeweave.sources import tables as T
from latticeweave.sources.grids import default_points

SIDES = {"plain": (False, S.UNIQUE), "unique": (True, S.UNIQUE), "duplicated": (True, S.DUPLICATED)}


def neighbours(mask, per, dup, bc):
    """Every neighbour's value at each point, by looking each one up."""
    n, dims = mask.shape, mask.ndim
    out = np.zeros((3**dims, *n), bool)
    for at in np.ndindex(*n):
        for k, move in enumerate(itertools.product((-1, 0, 1), repeat=dims)):
            x, value = [], None
            for a, m, size in zip(at, move, n):
                v = a + m
                if per and not 0 <= v < size:
                    v = v % (size - dup)
                elif not 0 <= v < size:
                    value = {"TRUE": True, "FALSE": False}.get(bc)
                    v = min(max(v, 0), size - 1)
                x.append(v)
            out[(k, *at)] = mask[tuple(x)] if value is None else value
    return out


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("side", SIDES)
def test_case_grid(spark, dims, side):
    per, storage = SIDES[side]
    dup = per and storage == S.DUPLICATED
    rng = np.random.default_rng(dims)
    shapes, masks = [(9 - g, 6, 5)[:dims] for g in range(2)], []
    for shape in shapes:
        m = rng.random(shape) < 0.6
        for d in range(dims) if dup else ():
            m[(slice(None),) * d + (-1,)] = m[(slice(None),) * d + (0,)]
        masks.append(m)
    grids = [S.Grid(g, (*shape, 1, 1)[:3], periodic=tuple(per and d < dims for d in range(3)), storage=storage, num_dims=dims) for g, shape in enumerate(shapes, 1)]
    meta = S.grid_table(spark, grids)
    rows = [(g, *map(int, (*at, 0, 0)[:3])) for g, m in enumerate(masks, 1) for at in np.argwhere(m)]
    df = spark.createDataFrame(rows, "grid_id int, i int, j int, k int")
    keys = spark.createDataFrame([(1,), (2,)], "grid_id int")

    def got(x):
        return {tuple(r) for r in x.select("grid_id", "i", "j", "k").collect()}

    def want(f):
        return {(g, *map(int, (*at, 0, 0)[:3])) for g, m in enumerate(masks, 1) for at in np.argwhere(f(m))}

    assert {r.grid_id: r.n for r in M.count_true(df).collect()} == {g: int(m.sum()) for g, m in enumerate(masks, 1)}
    for bc in (M.FALSE, M.TRUE, M.MIRROR):
        near = {id(m): neighbours(m, per, dup, bc) for m in masks}
        assert got(M.inner_edge(df, meta, bc)) == want(lambda m: m & ~near[id(m)].all(axis=0))
        assert got(M.outer_edge(df, meta, bc, keys=keys)) == want(lambda m: ~m & near[id(m)].any(axis=0))
        assert got(M.dilate(df, meta, 1, bc, keys)) == want(lambda m: near[id(m)].any(axis=0))
        assert got(M.erode(df, meta, 1, bc)) == want(lambda m: near[id(m)].all(axis=0))


def test_flood_keeps_to_the_barrier(spark):
    meta = S.grid_table(spark, [S.Grid(1, (9, 1, 1))])
    line = lambda *x: spark.createDataFrame([(1, i, 0, 0) for i in x], "grid_id int, i int, j int, k int")
    flooded = {r.i for r in M.flood(line(2, 6), line(1, 6), meta).collect()}
    assert flooded == {2, 3, 4, 5, 6}  # the seed on the barrier stays as it was
    assert {r.i for r in M.flood(M.flood(line(2), line(1, 6), meta), line(1, 6), meta).collect()} == {2, 3, 4, 5}


def test_labels_count_on_from_the_first_root(spark):
    meta = S.grid_table(spark, [S.Grid(1, (8, 1, 1)), S.Grid(2, (3, 1, 1))])
    values = [(1, i, 0, 0, i // 2 % 2 == 0) for i in range(8)] + [(2, i, 0, 0, i != 1) for i in range(3)]
    rows = M.components(spark.createDataFrame(values, "grid_id int, i int, j int, k int, value boolean"), meta).collect()
    assert {(r.grid_id, r.i): r.label for r in rows} == {(1, i): i // 2 for i in range(8)} | {(2, i): i for i in range(3)}


def test_tables(spark, tmp_path):
    grids = [S.Grid(1, (4, 3, 2)), S.Grid(2, (3, 3, 1))]
    points = default_points(spark, grids).withColumn("value", F.col("x") + 10 * F.col("y"))
    assert all((r.x, r.y, r.z) == (r.i, r.j, r.k) and r.flags == S.ACTIVE for r in points.collect())
    T.write_table(points, str(tmp_path / "t"), ["value"], ((1, 3), (0, 3), (0, 1)))
    back = T.read_table(spark, str(tmp_path / "t"), grids[:1], box=((1, 2), (0, 3), (0, 9)))
    assert sorted((r.grid_id, r.i, r.j, r.k, r.value) for r in back.collect()) == [(1, 1, j, 0, 1.0 + 10 * j) for j in range(3)]
    T.write_geometry(points, str(tmp_path / "g"), "xy")
    assert T.read_table(spark, str(tmp_path / "g")).columns == ["grid_id", "i", "j", "k", "x", "y"] and T.read_table(spark, str(tmp_path / "g")).count() == 33
