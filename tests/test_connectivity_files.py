"""Legacy connectivity files, written here in all layouts and byte orders, and read back."""

import numpy as np
import pytest

from latticeweave.schema import Grid
from latticeweave.sources import connectivity as C

SIZES = {1: (6, 5, 1), 2: (4, 7, 1)}


def case(seed=3):
    """Connections 1..11: grid 1 gives the first seven, grid 2 the rest; receivers lie on the other grid in another order."""
    rng = np.random.default_rng(seed)
    donors = {g: [dict(id=i, cell=rng.integers(1, 4, 3), local=rng.random(3), coefs=[rng.random(s) for s in (2, rng.integers(1, 4), 1)]) for i in ids] for g, ids in ((1, range(1, 8)), (2, range(8, 12)))}
    receivers = {3 - g: [dict(id=int(i), point=rng.integers(1, 4, 3)) for i in rng.permutation([d["id"] for d in ds])] for g, ds in donors.items()}
    return donors, receivers


def write(folder, donors, receivers, layout, order, blanks):
    plain = layout == C.STANDARD
    count = f"{order}i{4 if plain else 8}"

    def record(*arrays):
        data = b"".join(np.asarray(a, k).tobytes() for a, k in arrays)
        mark = np.array([len(data)], f"{order}i4").tobytes() if plain else b""
        return mark + data + mark

    i4, f8 = f"{order}i4", f"{order}f8"
    head = record(([2, 0, 0, 0, 0], i4)) if plain else np.array([36], i4).tobytes() + np.array([2], i4).tobytes() + np.zeros(4, f"{order}i8").tobytes()
    one = two = head
    for g in (1, 2):
        ds, rs = donors[g], receivers[g]
        coefs = [x for d in range(3) for k in ds for x in k["coefs"][d]]
        lead = [len(rs), len(ds), 0, ds[0]["id"]]
        one += record((lead, count), (SIZES[g], i4)) if plain else record((lead, count), (SIZES[g], i4), ([len(coefs)], count))
        one += record((np.array([k["cell"] for k in ds]).T.ravel(), i4), (np.array([k["local"] for k in ds]).T.ravel(), f8))
        one += record((np.array([k["point"] for k in rs]).T.ravel(), i4), ([k["id"] for k in rs], count))
        if blanks:
            one += record((np.ones(np.prod(SIZES[g])), i4))
        two += record(([len(k["coefs"][d]) for d in range(3) for k in ds], i4)) + record((coefs, f8)) + record(([0, 0, 0], i4))
    paths = str(folder / "donors"), str(folder / "stencils")
    for path, data in zip(paths, (one, two)):
        with open(path, "wb") as f:
            f.write(data)
    return paths


@pytest.mark.parametrize("layout,order,blanks", [(C.STANDARD, "<", False), (C.STANDARD, ">", True), (C.EXTENDED, "<", False), (C.EXTENDED, ">", False)])
def test_round_trip(spark, tmp_path, layout, order, blanks):
    donors, receivers = case()
    paths = write(tmp_path, donors, receivers, layout, order, blanks)
    assert C.sniff(paths[0]) == (order, layout)
    grids = [Grid(g, s) for g, s in SIZES.items()]
    got_donors, got_receivers = C.read_connectivity(spark, *paths, grids, chunk_rows=3)
    got = {r.connection_id: r for r in got_donors.collect()}
    for g, ds in donors.items():
        for d in ds:
            r = got[d["id"] - 1]
            assert (r.grid_id, r.begin, r.size, [r.u, r.v, r.w]) == (g, [int(x) - 1 for x in d["cell"]], [len(x) for x in d["coefs"]], d["local"].tolist())
            assert r.coefs == [x.tolist() for x in d["coefs"]]
    assert {(r.grid_id, r.connection_id, r.ni, r.nj, r.nk) for r in got_receivers.collect()} == {(g, k["id"] - 1, *(int(x) - 1 for x in k["point"])) for g, rs in receivers.items() for k in rs}
    made = C.match(got_donors, got_receivers)
    assert sorted((r.m, r.n) for r in made.collect()) == [(1, 2)] * 7 + [(2, 1)] * 4
    assert all([e - b for b, e in zip(r.begin, r.end)] == [len(r.wi), len(r.wj), len(r.wk)] for r in made.collect())


def test_faulty_files(tmp_path):
    donors, receivers = case()
    paths = write(tmp_path, donors, receivers, C.STANDARD, "<", False)
    with pytest.raises(C.ConnectivityFileError, match="size"):
        C.parts_of(*paths, [Grid(1, (6, 5, 1)), Grid(2, (4, 6, 1))])
    with pytest.raises(C.ConnectivityFileError, match="grids 1 to 2"):
        C.parts_of(*paths, [Grid(1, (6, 5, 1))])
    for text, reason in ((b"ab", "2 bytes"), (b"\x11\0\0\0 and more", "17 bytes")):
        (tmp_path / "other").write_bytes(text)
        with pytest.raises(C.ConnectivityFileError, match=reason):
            C.sniff(str(tmp_path / "other"))
    data = open(paths[0], "rb").read()
    (tmp_path / "short").write_bytes(data[:60])
    with pytest.raises(C.ConnectivityFileError, match="ends at byte"):
        C.parts_of(str(tmp_path / "short"), paths[1])
