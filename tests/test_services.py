"""Errors, log levels, stage seconds, command options, catalogue of stored grids, shared folders; stretched grids and wide neighbourhoods against brute force."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeweave import errors, schema as S
from latticeweave.operators import masks as M
from latticeweave.operators import materialise as mat
from latticeweave.operators import overlap as O
from latticeweave.plans.command import Command, CommandLineError
from latticeweave.plans.observe import DEBUG, ERRORS, STATUS, WARNINGS, Logger, Profile
from latticeweave.sources import connectivity, tables
from latticeweave.sources.grids import analytic_points, cells_of, index_points


def test_errors_have_codes(spark, tmp_path):
    got, error = errors.captured(connectivity.sniff, str(tmp_path / "none"))
    assert got is None and isinstance(error, errors.FileOpenError) and errors.code_of(error) == errors.ErrorCode.FILE_OPEN and error.path.endswith("none")
    short = tmp_path / "short"
    short.write_bytes(b"ab")
    error = errors.captured(connectivity.sniff, str(short))[1]
    assert isinstance(error, errors.FileReadError) and isinstance(error, ValueError) and errors.code_of(error) == errors.ErrorCode.FILE_READ
    assert errors.code_of(None) == errors.ErrorCode.NONE and errors.captured(lambda x: x + 1, 1) == (2, None)
    assert errors.active_session() is not None


def test_log_levels_and_threshold(caplog):
    caplog.set_level(logging.DEBUG, "latticeweave")
    log = Logger(ERRORS | STATUS, status_threshold=2)
    log.error("bad %d", 1)
    log.warning("unseen")
    log.status("one")
    with log.deeper():
        log.status("two")
        with log.deeper():
            log.status("three")
    log.levels = WARNINGS | DEBUG
    log.warning("seen")
    log.debug("detail")
    assert [r.message for r in caplog.records] == ["ERROR: bad 1", "one", "  two", "WARNING: seen", "detail"]


def test_profile(spark, tmp_path):
    profile = Profile()
    for name in ("a", "b", "a"):
        with profile.stage(name):
            pass
    assert [(r.stage, r.calls) for r in profile.table(spark).collect()] == [("a", 2), ("b", 1)]
    profile.write(str(tmp_path / "profile"))
    assert [x.split()[:2] for x in (tmp_path / "profile").read_text().splitlines()] == [["a", "2"], ["b", "1"]]


def test_command_options():
    command = Command("Runs it").add("size", "n", "int", "Points").add("angle", "", "float").add("name", "s", "str").add("quick", "q", "bool").add("mark", "m", "char")
    values, rest = command.parse(["--size=81", "-q", "x", "--angle", "-2.5", "-s", "a b", "--mark=c", "--", "--size=1"])
    assert values == {"size": 81, "quick": True, "angle": -2.5, "name": "a b", "mark": "c"} and rest == ["x", "--size=1"]
    assert "--size <int>" in command.usage() and "-h, --help" in command.usage()
    for words in (["--none"], ["--size"], ["--size=x"], ["--mark=cc"], ["--quick=maybe"]):
        with pytest.raises(CommandLineError):
            command.parse(words)
    with pytest.raises(ValueError):
        command.add("size", "", "int")


def test_catalogue(spark, tmp_path):
    path = str(tmp_path / "fields")
    grids = [S.Grid(1, (4, 3, 1), periodic=(True, False, False), name="ring"), S.Grid(7, (3, 3, 2), geometry=S.UNIFORM, periodic_length=(0.0, 1.5, 0.0))]
    tables.write_grids(spark, grids, path)
    tables.write_table(index_points(spark, grids).withColumn("value", F.lit(1.5)), path)
    assert tables.read_grids(spark, path) == grids
    assert tables.attributes(spark, path) == {"pid": "bigint", "value": "double"}
    with pytest.raises(errors.FileOpenError):
        tables.read_grids(spark, str(tmp_path / "other"))
    with pytest.raises(errors.FileOpenError):
        tables.attributes(spark, str(tmp_path / "other"))


def test_index_points_in_pieces(spark, monkeypatch):
    from latticeweave.sources import grids as G

    grids = [S.Grid(1, (5, 4, 3), begin=(1, -2, 0)), S.Grid(2, (3, 1, 1))]
    want = sorted(map(tuple, index_points(spark, grids).collect()))
    monkeypatch.setattr(G, "PIECE", 7)
    assert sorted(map(tuple, index_points(spark, grids).collect())) == want and len(want) == 4 * 6 * 3 + 3


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Held:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("C", (), {"getCheckpointDir": staticmethod(Held)})

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})
    with pytest.raises(RuntimeError):
        mat.shared_folder(session)


def test_overlap_on_a_stretched_grid(spark):
    n = 33
    x = "pow(2.0D, i / 2.0D - 8)"
    grids = [S.Grid(1, (n, n, 1), geometry=S.RECTILINEAR), S.Grid(2, (40, 40, 1), geometry=S.UNIFORM)]
    points = analytic_points(spark, grids, {1: (x, x.replace("i", "j"), "0"), 2: ("pow(2.0D, i / 2.4D - 8) * 1.01D", "pow(2.0D, j / 2.4D - 8) * 1.013D", "0")})
    meta = S.grid_table(spark, grids)
    cells = cells_of(points, meta, 2)
    pairs = spark.createDataFrame([(1, 2, 1e-12)], "m int, n int, tolerance double")
    found = {(r.ni, r.nj): (r.ci, r.cj) for r in O.detect_overlap(points, cells, meta, grids, pairs).collect()}
    nodes = 2.0 ** (np.arange(n) / 2 - 8)
    want = {}
    for i in range(40):
        for j in range(40):
            at = [float(2.0 ** (k / 2.4 - 8) * f) for k, f in ((i, 1.01), (j, 1.013))]
            if all(nodes[0] <= a <= nodes[-1] for a in at):
                want[i, j] = tuple(int(np.searchsorted(nodes, a, side="right")) - 1 for a in at)
    assert found == want and len(want) > 1000
    # few candidates for each point, though cells span five orders of magnitude
    assert O.candidates(points, cells, pairs, 2).count() < 1.1 * len(want)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_wide_dilation_is_a_product(spark, radius):
    rng = np.random.default_rng(radius)
    grid = S.Grid(1, (9, 8, 7), periodic=(True, False, True), storage=S.DUPLICATED)
    meta = S.grid_table(spark, [grid])
    at = [tuple(map(int, p)) for p in rng.integers(0, (8, 8, 6), (4, 3))]
    rows = {(1, i, j, k) for i0, j, k0 in at for i in ([0, 8] if i0 == 0 else [i0]) for k in ([0, 6] if k0 == 0 else [k0])}
    mask = spark.createDataFrame(sorted(rows), "grid_id int, i int, j int, k int")
    got = {(r.i, r.j, r.k) for r in M.dilate(mask, meta, radius).collect()}
    want = set()
    for i in range(9):
        for j in range(8):
            for k in range(7):
                away = lambda a, b, q: min((a - b) % q, (b - a) % q)
                if any(max(away(i, x, 8), abs(j - y), away(k, z, 6)) <= radius for x, y, z in at):
                    want.add((i, j, k))
    assert got == want
