"""Sinks and sources of geometry and fields: Parquet, one folder per grid, so that a reader of some grids, columns or index ranges skips the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileOpenError
from ..operators.masks import IJK
from ..schema import Grid

Box = tuple[tuple[int, int], tuple[int, int], tuple[int, int]]


def _within(df: DataFrame, box: Box | None) -> DataFrame:
    """Rows whose indices lie in the half-open range."""
    if box is None:
        return df
    return df.where(reduce(lambda a, b: a & b, ((F.col(x) >= b) & (F.col(x) < e) for x, (b, e) in zip(IJK, box))))


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, box: Box | None = None, mode: str = "errorifexists") -> None:
    """Write grid_id, i, j, k and the given columns (all, without a choice), of an index range if given. Rows keep their partitions: no shuffle."""
    chosen = columns or [c for c in df.columns if c not in ("grid_id", *IJK)]
    _within(df, box).select("grid_id", *IJK, *chosen).write.mode(mode).partitionBy("grid_id").parquet(path)


def write_geometry(points: DataFrame, path: str, dims: str = "xyz", box: Box | None = None, mode: str = "errorifexists") -> None:
    write_table(points, path, list(dims), box, mode)


def write_grids(spark: SparkSession, grids: list[Grid], path: str, mode: str = "errorifexists") -> None:
    """The catalogue beside a table: its grids with ranges, periodicity, geometry and names."""
    rows = [(g.grid_id, g.name, list(g.begin), list(g.end), list(g.periodic), g.storage, g.geometry, list(map(float, g.periodic_length)), g.num_dims) for g in grids]
    schema = "grid_id int, name string, begin array<int>, end array<int>, periodic array<boolean>, storage string, geometry string, periodic_length array<double>, num_dims int"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path.rstrip("/") + ".grids")


def read_grids(spark: SparkSession, path: str) -> list[Grid]:
    """Open a table: the grids that its catalogue names."""
    where = path.rstrip("/") + ".grids"
    try:
        rows = spark.read.parquet(where).collect()
    except AnalysisException as e:
        raise FileOpenError(where, "there is no catalogue") from e
    return [Grid(r.grid_id, tuple(r.end), tuple(r.begin), tuple(r.periodic), r.storage, r.geometry, tuple(r.periodic_length), r.name, r.num_dims) for r in sorted(rows, key=lambda r: r.grid_id)]


def attributes(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and types of the table's attributes (all columns but grid and indices)."""
    try:
        return {n: t for n, t in spark.read.parquet(path).dtypes if n not in ("grid_id", *IJK)}
    except AnalysisException as e:
        raise FileOpenError(path, "there is no table") from e


def read_table(spark: SparkSession, path: str, grids: list[Grid] | None = None, columns: list[str] | None = None, box: Box | None = None) -> DataFrame:
    """The rows of the given grids (folders of other grids aren't listed in the scan) within an index range (pushed into the scan)."""
    df = spark.read.parquet(path)
    if grids is not None:
        df = df.where(F.col("grid_id").isin([g.grid_id for g in grids]))
    chosen = columns or [c for c in df.columns if c not in ("grid_id", *IJK)]
    return _within(df, box).select(F.col("grid_id").cast("int").alias("grid_id"), *IJK, *chosen)
