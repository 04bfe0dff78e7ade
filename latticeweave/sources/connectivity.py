"""Reader of legacy connectivity files: a pair of binary files with donors and receivers, and with stencil sizes and coefficients.

Two layouts. STANDARD: every record stands between two 4-byte lengths, counts and ids are 4-byte integers. EXTENDED: one leading 4-byte length,
then bare data with 8-byte counts and ids. Either byte order. All datasets lie dimension by dimension, indices count from 1.

The driver reads headers only and cuts each grid's datasets into chunks of at most ``CHUNK_ROWS`` rows; tasks add up each chunk's stencil sizes (three numbers a chunk come
back), then seek to their chunk and decode it with numpy, so memory is bounded by the chunk. Both files must lie where all executors can open them. Donors and receivers are then matched by an equi-join on the connection id.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileOpenError, FileReadError
from ..schema import Grid

STANDARD, EXTENDED = "STANDARD", "EXTENDED"
CHUNK_ROWS = 500_000
DONORS = "grid_id int, connection_id long, begin array<int>, size array<int>, u double, v double, w double, coefs array<array<double>>"
RECEIVERS = "grid_id int, connection_id long, ni int, nj int, nk int"


class ConnectivityFileError(FileReadError, ValueError):
    """The file is cut short, of another format, or doesn't fit the grids."""

    def __init__(self, message: str):
        super().__init__("connectivity file", message)


@dataclass(frozen=True)
class Part:
    """Where the datasets of one grid lie."""

    grid_id: int
    donors: int
    receivers: int
    first_id: int
    size: tuple[int, int, int]
    cells: int
    coords: int
    points: int
    ids: int
    sizes: int
    coefs: int


class _Cursor:
    """Reads numbers of a known byte order at a moving place of a file."""

    def __init__(self, path: str, order: str):
        self.path, self.order, self.at = path, order, 0
        self.length = os.path.getsize(path)

    def peek(self, kind: str, n: int = 1) -> np.ndarray:
        out = read_at(self.path, self.order + kind, self.at, n)
        if len(out) < n:
            raise ConnectivityFileError(f"{self.path} ends at byte {self.length}, in the middle of what should stand at {self.at}")
        return out

    def take(self, kind: str, n: int = 1) -> np.ndarray:
        out = self.peek(kind, n)
        self.at += out.nbytes
        return out

    def skip(self, n: int) -> int:
        """The place before the step."""
        before, self.at = self.at, self.at + int(n)
        return before


def read_at(path: str, kind: str, at: int, n: int) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(at)
        return np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)


def sniff(path: str) -> tuple[str, str]:
    """(byte order "<" or ">", layout): a little-endian file doesn't begin with a zero byte, and the first length tells the layout."""
    try:
        with open(path, "rb") as f:
            head = f.read(4)
    except OSError as e:
        raise FileOpenError(path, f"can't be opened ({e.strerror})") from e
    if len(head) < 4:
        raise ConnectivityFileError(f"{path} is no connectivity file: it has {len(head)} bytes")
    order = "<" if head[0] else ">"
    length = int(np.frombuffer(head, f"{order}i4")[0])
    layouts = {5 * 4: STANDARD, 4 + 4 * 8: EXTENDED}
    if length not in layouts:
        raise ConnectivityFileError(f"{path} is no connectivity file: its header would have {length} bytes")
    return order, layouts[length]


def parts_of(donor_path: str, stencil_path: str, grids: list[Grid] | None = None) -> tuple[str, str, list[Part]]:
    """Byte order, layout and the places of all grids' datasets. grids, if given, must have ids 1, 2, ... and the sizes in the file."""
    order, layout = sniff(donor_path)
    plain = layout == STANDARD
    mark, count = (4, "i4") if plain else (0, "i8")
    one, two = _Cursor(donor_path, order), _Cursor(stencil_path, order)
    one.skip(4)
    total = int(one.peek("i4")[0])
    for c in (one, two):
        c.at = 4 + (20 if plain else 36) + mark
    if grids is not None and (len(grids) != total or sorted(g.grid_id for g in grids) != list(range(1, total + 1))):
        raise ConnectivityFileError(f"{donor_path} has grids 1 to {total}")
    blanks, out = None, []
    for g in range(1, total + 1):
        one.skip(mark)
        if plain:
            head = one.take("i4", 7)
            receivers, donors, first, size = int(head[0]), int(head[1]), int(head[3]), tuple(map(int, head[4:7]))
            coefs = 0
        else:
            head, size = one.take("i8", 4), tuple(map(int, one.take("i4", 3)))
            receivers, donors, first, coefs = int(head[0]), int(head[1]), int(head[3]), int(one.take("i8")[0])
        one.skip(mark)
        if grids is not None and size != tuple(next(x for x in grids if x.grid_id == g).size(d) for d in range(3)):
            raise ConnectivityFileError(f"grid {g} of {donor_path} has the size {size}")
        one.skip(mark)
        cells, coords = one.skip(12 * donors), one.skip(24 * donors)
        one.skip(2 * mark)
        points, ids = one.skip(12 * receivers), one.skip(receivers * np.dtype(count).itemsize)
        one.skip(mark)
        if blanks is None:  # the record after the first grid: as long as its point flags would be, or not
            following = read_at(donor_path, f"{order}i4", one.at, 1) if plain else np.zeros(0)
            blanks = bool(len(following)) and int(following[0]) == 4 * int(np.prod(size, dtype=np.int64))
        if blanks:
            one.skip(2 * mark + 4 * int(np.prod(size, dtype=np.int64)))
        two.skip(mark)
        sizes = two.skip(12 * donors)
        two.skip(mark)
        if plain:
            coefs = int(two.peek("i4")[0]) // 8
        two.skip(mark)
        weights = two.skip(8 * coefs)
        two.skip(2 * mark + 12 + mark)
        out.append(Part(g, donors, receivers, first - 1, size, cells, coords, points, ids, sizes, weights))
    return order, layout, out


def _chunks(n: int, rows: int) -> Iterator[tuple[int, int]]:
    for begin in range(0, n, rows):
        yield begin, min(n, begin + rows)


def _donor_plan(spark: SparkSession, parts: list[Part], order: str, stencil_path: str, rows: int) -> list[tuple]:
    """(part number, begin, end, coefficients before the chunk in each direction's block)."""

    def sizes(row: dict) -> pa.RecordBatch:
        p, n = parts[row["k"]], row["e"] - row["b"]
        sums = [int(read_at(stencil_path, f"{order}i4", p.sizes + 4 * (d * p.donors + row["b"]), n).sum(dtype=np.int64)) for d in range(3)]
        return pa.RecordBatch.from_pylist([row | {f"s{d}": x for d, x in enumerate(sums)}])

    chunks = [(k, b, e) for k, p in enumerate(parts) for b, e in _chunks(p.donors, rows)]
    plan, totals, part = [], [0, 0, 0], -1
    found = sorted(map(tuple, _run(spark, chunks, "k int, b long, e long", sizes, "k long, b long, e long, s0 long, s1 long, s2 long").collect()))
    whole = {k: np.sum([x[3:] for x in found if x[0] == k], axis=0) for k in {x[0] for x in found}}
    for k, b, e, *sums in found:
        if k != part:
            part, totals = k, np.cumsum([0, *whole[k]])[:3].tolist()
        plan.append((k, b, e, *map(int, totals)))
        totals = [t + x for t, x in zip(totals, sums)]
    return plan


def _lists(flat: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat, kind))


def _run(spark: SparkSession, plan: list[tuple], schema: str, decode, output: str) -> DataFrame:
    if not plan:
        return spark.createDataFrame([], output)
    tasks = spark.createDataFrame(plan, schema).repartition(min(len(plan), 4096))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield decode(row)

    return tasks.mapInArrow(run, output)


def read_connectivity(spark: SparkSession, donor_path: str, stencil_path: str, grids: list[Grid] | None = None, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(donors, receivers) of all grids, indices and connection ids from 0; a grid's donors have consecutive ids."""
    order, layout, parts = parts_of(donor_path, stencil_path, grids)
    id_kind = f"{order}i4" if layout == STANDARD else f"{order}i8"

    def column(path: str, kind: str, at: int, row: dict) -> np.ndarray:
        n = row["e"] - row["b"]
        out = read_at(path, kind, at + row["b"] * np.dtype(kind).itemsize, n)
        if len(out) < n:
            raise ConnectivityFileError(f"{path} is cut short")
        return out.astype(kind[1:])

    def donors(row: dict) -> pa.RecordBatch:
        p = parts[row["k"]]
        n = row["e"] - row["b"]
        begin = np.stack([column(donor_path, f"{order}i4", p.cells + 4 * d * p.donors, row) - 1 for d in range(3)], 1)
        local = [column(donor_path, f"{order}f8", p.coords + 8 * d * p.donors, row) for d in range(3)]
        size = np.stack([column(stencil_path, f"{order}i4", p.sizes + 4 * d * p.donors, row) for d in range(3)], 1)
        blocks = [read_at(stencil_path, f"{order}f8", p.coefs + 8 * row[f"c{d}"], int(size[:, d].sum())).astype("f8") for d in range(3)]
        if any(len(b) < size[:, d].sum() for d, b in enumerate(blocks)):
            raise ConnectivityFileError(f"{stencil_path} is cut short")
        # coefficients lie direction by direction; each donor's three lists come together
        owner = np.concatenate([np.repeat(np.arange(n), size[:, d]) for d in range(3)])
        flat = np.concatenate(blocks)[np.argsort(owner, kind="stable")]
        inner = _lists(flat, size.ravel(), pa.float64())
        coefs = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3, dtype=np.int32)), inner)
        three = np.full(n, 3)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, p.grid_id, np.int32)), pa.array(np.arange(row["b"], row["e"]) + p.first_id), _lists(begin.ravel(), three, pa.int32()), _lists(size.ravel(), three, pa.int32()), *map(pa.array, local), coefs],
            ["grid_id", "connection_id", "begin", "size", "u", "v", "w", "coefs"],
        )

    def receivers(row: dict) -> pa.RecordBatch:
        p = parts[row["k"]]
        at = [column(donor_path, f"{order}i4", p.points + 4 * d * p.receivers, row) - 1 for d in range(3)]
        ids = column(donor_path, id_kind, p.ids, row).astype(np.int64) - 1
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), p.grid_id, np.int32)), pa.array(ids), *(pa.array(x, pa.int32()) for x in at)], ["grid_id", "connection_id", "ni", "nj", "nk"])

    plan = [(k, b, e) for k, p in enumerate(parts) for b, e in _chunks(p.receivers, chunk_rows)]
    return (
        _run(spark, _donor_plan(spark, parts, order, stencil_path, chunk_rows), "k int, b long, e long, c0 long, c1 long, c2 long", donors, DONORS),
        _run(spark, plan, "k int, b long, e long", receivers, RECEIVERS),
    )


def match(donors: DataFrame, receivers: DataFrame) -> DataFrame:
    """Connections (schema.CONNECTIONS): donors and receivers of one connection id."""
    other = receivers.select(F.col("grid_id").alias("n"), "connection_id", "ni", "nj", "nk")
    met = donors.withColumnRenamed("grid_id", "m").join(other, "connection_id")
    end = F.transform(F.arrays_zip("begin", "size"), lambda x: x["begin"] + x["size"])
    return met.select("m", "n", "ni", "nj", "nk", "begin", end.alias("end"), "u", "v", "w", *(F.col("coefs")[d].alias(f"w{a}") for d, a in enumerate("ijk")))


def import_connections(spark: SparkSession, donor_path: str, stencil_path: str, grids: list[Grid] | None = None) -> DataFrame:
    return match(*read_connectivity(spark, donor_path, stencil_path, grids))
