"""Data model: flag bits, enumerations, grid descriptions and the schemas of all tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

ACTIVE, DOMAIN_BOUNDARY, INTERNAL_BOUNDARY, OVERLAPPED = 1, 2, 4, 8
INFERRED_DOMAIN_BOUNDARY, BOUNDARY_HOLE, OCCLUDED, FRINGE = 16, 32, 64, 128
OUTER_FRINGE, INNER_FRINGE, OVERLAP_MINIMIZED, RECEIVER, ORPHAN = 256, 512, 1024, 2048, 4096
DEBUG = tuple(1 << k for k in range(13, 18))
#: Flags that an assembly sets and the next one clears.
ASSEMBLY_FLAGS = OVERLAPPED | INFERRED_DOMAIN_BOUNDARY | BOUNDARY_HOLE | OCCLUDED | FRINGE | OUTER_FRINGE | INNER_FRINGE | OVERLAP_MINIMIZED | RECEIVER | ORPHAN

UNIFORM, ORIENTED_UNIFORM, RECTILINEAR, ORIENTED_RECTILINEAR, CURVILINEAR = GEOMETRIES = ("UNIFORM", "ORIENTED_UNIFORM", "RECTILINEAR", "ORIENTED_RECTILINEAR", "CURVILINEAR")
UNIQUE, DUPLICATED = "UNIQUE", "DUPLICATED"
ALL_GRIDS = -1
MAX_DIMS = 3

POINTS = "grid_id int, i int, j int, k int, x double, y double, z double, flags int"
OVERLAP = "m int, n int, ni int, nj int, nk int, ci int, cj int, ck int, u double, v double, w double"
CONNECTIONS = "m int, n int, ni int, nj int, nk int, begin array<int>, end array<int>, u double, v double, w double, wi array<double>, wj array<double>, wk array<double>"


@dataclass(frozen=True)
class Grid:
    """One structured grid: index range [begin, end), periodicity and kind of geometry."""

    grid_id: int
    end: tuple[int, int, int]
    begin: tuple[int, int, int] = (0, 0, 0)
    periodic: tuple[bool, bool, bool] = (False, False, False)
    storage: str = UNIQUE
    geometry: str = CURVILINEAR
    periodic_length: tuple[float, float, float] = (0.0, 0.0, 0.0)
    name: str = ""
    num_dims: int = field(default=0)

    def __post_init__(self):
        if self.geometry not in GEOMETRIES or self.storage not in (UNIQUE, DUPLICATED):
            raise ValueError(f"unknown geometry or periodic storage: {self.geometry}, {self.storage}")
        if any(e <= b for b, e in zip(self.begin, self.end)):
            raise ValueError("a grid's range must not be empty")
        if not self.num_dims:
            size = [e - b for b, e in zip(self.begin, self.end)]
            object.__setattr__(self, "num_dims", max([d + 1 for d in range(3) if size[d] > 1], default=1))

    def size(self, d: int) -> int:
        return self.end[d] - self.begin[d]

    def period(self, d: int) -> int:
        """Points of one period: a duplicated last point is the first one again."""
        return self.size(d) - (self.periodic[d] and self.storage == DUPLICATED)

    def cell_end(self, d: int) -> int:
        """Cells run one short of the points, except along a direction that closes on itself with unique points."""
        if d >= self.num_dims:
            return self.begin[d] + 1
        return self.end[d] - (0 if self.periodic[d] and self.storage == UNIQUE else 1)


META = (
    "grid_id int, num_dims int, bi int, bj int, bk int, ei int, ej int, ek int, per_i boolean, per_j boolean, per_k boolean, "
    "duplicated boolean, qi int, qj int, qk int, di int, dj int, dk int, geometry string, lx double, ly double, lz double"
)


def grid_table(spark: SparkSession, grids: list[Grid]) -> DataFrame:
    """One row per grid: ranges (b*, e*), periodicity, periods q*, ends of the cells d*, geometry and periodic lengths."""
    rows = [
        (g.grid_id, g.num_dims, *g.begin, *g.end, *g.periodic, g.storage == DUPLICATED, *(g.period(d) for d in range(3)), *(g.cell_end(d) for d in range(3)), g.geometry, *map(float, g.periodic_length))
        for g in grids
    ]
    return spark.createDataFrame(rows, META)
