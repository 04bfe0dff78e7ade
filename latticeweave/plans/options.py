"""Options of an assembly: defaults, wildcards, validation, and the small tables that plans join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import ALL_GRIDS

PAIR_DEFAULTS = {
    "overlappable": False, "overlap_tolerance": 1e-12, "cut_boundary_holes": False, "occludes": "NONE", "edge_padding": 0,
    "connection_type": "NONE", "minimize_overlap": False, "disjoint_connections": True,
}
GRID_DEFAULTS = {"overlap_accel_depth_adjust": 0.0, "overlap_accel_resolution_adjust": 0.0, "infer_boundaries": False, "edge_smoothing": 0, "fringe_size": 0}
CHOICES = {"occludes": ("NONE", "ALL", "COARSE"), "connection_type": ("NONE", "NEAREST", "LINEAR", "CUBIC")}
#: May hold for a grid with itself.
_SELF = {"disjoint_connections"}


class Options:
    """Options by pair of grids (m, n) or by grid. ALL_GRIDS stands for all grids known now; later calls override earlier ones."""

    def __init__(self, grid_ids):
        self.grid_ids = sorted(grid_ids)
        self._pairs: dict[str, dict[tuple[int, int], object]] = {k: {} for k in PAIR_DEFAULTS}
        self._grids: dict[str, dict[int, object]] = {k: {} for k in GRID_DEFAULTS}

    def _spread(self, g: int) -> list[int]:
        if g == ALL_GRIDS:
            return self.grid_ids
        if g not in self.grid_ids:
            raise KeyError(f"no grid {g}")
        return [g]

    def set_pair(self, name: str, m: int, n: int, value) -> Options:
        if name in CHOICES and value not in CHOICES[name]:
            raise ValueError(f"{name}: {value!r} is none of {CHOICES[name]}")
        if name in ("overlap_tolerance", "edge_padding") and value < 0:
            raise ValueError(f"{name} must not be negative")
        held = self._pairs[name]
        for a in self._spread(m):
            for b in self._spread(n):
                if value == PAIR_DEFAULTS[name] or (a == b and name not in _SELF):
                    held.pop((a, b), None)
                else:
                    held[a, b] = value
        return self

    def set_grid(self, name: str, g: int, value) -> Options:
        if name in ("edge_smoothing", "fringe_size") and value < 0:
            raise ValueError(f"{name} must not be negative")
        for a in self._spread(g):
            if value == GRID_DEFAULTS[name]:
                self._grids[name].pop(a, None)
            else:
                self._grids[name][a] = value
        return self

    def reset_pair(self, name: str, m: int, n: int) -> Options:
        return self.set_pair(name, m, n, PAIR_DEFAULTS[name])

    def reset_grid(self, name: str, g: int) -> Options:
        return self.set_grid(name, g, GRID_DEFAULTS[name])

    def pair(self, name: str, m: int, n: int):
        return self._pairs[name].get((m, n), PAIR_DEFAULTS[name])

    def grid(self, name: str, g: int):
        return self._grids[name].get(g, GRID_DEFAULTS[name])

    def held_pairs(self, name: str) -> list[tuple[tuple[int, int], object]]:
        """Pairs whose option isn't the default."""
        return sorted(self._pairs[name].items())

    def validate(self) -> None:
        for m, n in self._pairs["cut_boundary_holes"]:
            if not (self.pair("overlappable", m, n) and self.pair("overlappable", n, m)):
                raise ValueError(f"cutting holes in {n} by {m} needs both grids to be overlappable both ways")
        for pair, kind in self._pairs["connection_type"].items():
            if kind == "CUBIC":
                raise NotImplementedError(f"cubic connections are not available (pair {pair})")

    def pair_rows(self) -> list[dict]:
        return [{"m": m, "n": n} | {k: self.pair(k, m, n) for k in PAIR_DEFAULTS} for m in self.grid_ids for n in self.grid_ids if m != n and self.pair("overlappable", m, n)]

    def pair_table(self, spark: SparkSession) -> DataFrame:
        """One row for each overlappable pair."""
        schema = "m int, n int, overlappable boolean, tolerance double, cut boolean, occludes string, padding int, kind string, minimize boolean, disjoint boolean"
        rows = [(r["m"], r["n"], True, float(r["overlap_tolerance"]), r["cut_boundary_holes"], r["occludes"], r["edge_padding"], r["connection_type"], r["minimize_overlap"], r["disjoint_connections"]) for r in self.pair_rows()]
        return spark.createDataFrame(rows, schema)

    def occlusion(self, m: int, n: int) -> str:
        return self.pair("occludes", m, n)
