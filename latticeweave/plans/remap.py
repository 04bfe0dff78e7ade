"""Remapping: values of one grid on all points of another that lie inside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exchange import collect, connections_of
from ..operators.masks import IJK
from ..operators.overlap import detect_overlap
from ..schema import Grid, grid_table
from ..sources.grids import cells_of


def remap(spark: SparkSession, grids: list[Grid], points: DataFrame, source: int, target: int, kind: str = "LINEAR", value: str = "value", tolerance: float = 1e-12) -> DataFrame:
    """(grid_id, i, j, k, value) of the active target points within active source cells. points: schema.POINTS and the value column."""
    own = [g for g in grids if g.grid_id in (source, target)]
    meta, dims = grid_table(spark, own), own[0].num_dims
    cells = cells_of(points.where(F.col("grid_id") == source), meta, dims)
    pairs = spark.createDataFrame([(source, target, tolerance)], "m int, n int, tolerance double")
    overlap = detect_overlap(points.where(F.col("grid_id").isin(source, target)), cells, meta, own, pairs)
    got = collect(connections_of(overlap, kind, dims), points.select("grid_id", *IJK, F.col(value).alias("value")), meta, ordered=True)
    return got.select(F.col("n").alias("grid_id"), *(F.col(f"n{a}").alias(a) for a in IJK), F.col("value").alias(value))
