"""TIFF checks and kinds of pixels, auxiliary grids, surrogates, noise, the map query of events."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tofcube.operators import cube as C
from tofcube.operators import extras as X
from tofcube.operators import records as R
from tofcube.operators import surrogate as S
from tofcube.plans import extras, fits
from tofcube.sources import tiff

SF = "/root/testdata/sf0.001"


def pages(arrays, end="<"):
    """A multi-page file of arrays of any kind, uncompressed."""
    out = bytearray(b"II*\0" if end == "<" else b"MM\0*") + struct.pack(f"{end}I", 0)
    link = 4
    for a in arrays:
        data = np.ascontiguousarray(a).astype(a.dtype.newbyteorder(end)).tobytes()
        at = len(out)
        out += data + b"\0" * (len(data) % 2)
        ifd = len(out)
        struct.pack_into(f"{end}I", out, link, ifd)
        kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        entries = [(256, 4, a.shape[1]), (257, 4, a.shape[0]), (258, 3, 8 * a.itemsize), (259, 3, 1), (273, 4, at), (277, 3, 1), (279, 4, len(data)), (339, 3, kind)]
        out += struct.pack(f"{end}H", len(entries))
        for tag, k, v in entries:
            out += struct.pack(f"{end}HHI", tag, k, 1) + (struct.pack(f"{end}HH", v, 0) if k == 3 else struct.pack(f"{end}I", v))
        link = len(out)
        out += struct.pack(f"{end}I", 0)
    return bytes(out)


@pytest.mark.parametrize("kind", ["u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f2", "f4", "f8"])
@pytest.mark.parametrize("end", "<>")
def test_kinds_of_pixels(kind, end):
    a = (np.arange(12).reshape(3, 4) - (3 if kind[0] != "u" else 0)).astype(kind)
    got = list(tiff.frames(pages([a, a + 1], end)))
    assert len(got) == 2 and (got[0] == a.astype(float)).all() and (got[1] == a.astype(float) + 1).all()


def test_stacks_and_folders(spark, tmp_path):
    one = np.arange(6.0).reshape(2, 3)
    (tmp_path / "s.tif").write_bytes(pages([one, one + 10]))
    stack = tiff.load_tiff(spark, str(tmp_path / "s.tif"))
    assert {tuple(r) for r in stack.collect()} == {(k, i // 3, i % 3, 10.0 * k + i) for k in range(2) for i in range(6)}
    folder = tmp_path / "f"
    folder.mkdir()
    with pytest.raises(ValueError, match="no TIFF"):
        tiff.load_tiff_folder(spark, str(folder))
    (folder / "a.tif").write_bytes(pages([one]))
    (folder / "b.tif").write_bytes(pages([one + 1]))
    assert tiff.load_tiff_folder(spark, str(folder)).count() == 12
    with pytest.raises(ValueError, match="no TIFF"):
        tiff.load_tiff_folder(spark, str(folder), "z*")
    with pytest.raises(ValueError, match="not one file"):
        tiff.load_tiff_stack(spark, str(folder))
    (folder / "c.tif").write_bytes(pages([one, one]))
    with pytest.raises(ValueError, match="2 frames"):
        tiff.load_tiff_folder(spark, str(folder))
    (folder / "c.tif").write_bytes(pages([np.ones((3, 3))]))
    with pytest.raises(ValueError, match="different sizes"):
        tiff.load_tiff_folder(spark, str(folder))
    (tmp_path / "mixed.tif").write_bytes(pages([one, np.ones((2, 2))]))
    with pytest.raises(ValueError, match="different sizes"):
        tiff.load_tiff_stack(spark, str(tmp_path / "mixed.tif"))
    (tmp_path / "none.tif").write_bytes(b"II*\0\0\0\0\0")
    with pytest.raises(ValueError, match="no frames"):
        tiff.load_tiff_stack(spark, str(tmp_path / "none.tif"))


def test_surrogate_outside_its_box(spark):
    plan = S.chebyshev_plan(spark.createDataFrame([(0, 50.0), (1, 0.0)], "i int, sigma double"), None, 0.02)
    got = {(r["i"], r["n"]): r["v"] for r in plan.join(spark.createDataFrame([(x,) for x in (0.0, 0.013, 0.02, 0.021, -1.0)], "n double")).select("i", "n", S.chebyshev_value(F.col("coefficients"), F.col("box"), F.col("n")).alias("v")).collect()}
    assert got[0, 0.021] is None and got[0, -1.0] is None and abs(got[0, 0.013] - np.exp(-0.65)) < 1e-12 and abs(got[1, 0.02] - 1) < 1e-12


def test_fingerprints(spark):
    df = spark.createDataFrame([(k, i, float(i) + (0.0 if k < 2 else 1e-16 + 1e-9 * (i == 3))) for k in range(3) for i in range(9)], "k int, i int, value double").repartition(5)
    f = {r["k"]: r["fingerprint"] for r in R.fingerprint(df, ["k"]).collect()}
    assert f[0] == f[1] != f[2]


def test_noise_is_that_of_its_pixel(spark):
    px = spark.createDataFrame([(y, x, [0.5, 0.0, -1.0, 1.0]) for y in range(20) for x in range(20)], "y int, x int, spectrum array<double>")
    got = X.add_poisson_noise(px.repartition(7), 1000.0, 3).orderBy("y", "x").collect()
    assert got == X.add_poisson_noise(px.coalesce(1), 1000.0, 3).orderBy("y", "x").collect()
    t = np.array([r["transmission"] for r in got])
    assert abs(t[:, 0].mean() - 0.5) < 0.005 and abs(t[:, 0].std() - np.sqrt(500) / 1000) < 0.003 and (t[:, 1:3] == 0).all()
    assert all(np.isclose(r["sigma"][0], np.sqrt(r["transmission"][0] * 1000) / 1000) and r["sigma"][1] == 0.001 for r in got)
    assert extras.QUERIES["noisy_cube"](spark, SF).count() == 100


def test_event_map_against_a_scan(spark):
    """The map query of the events: each live pixel's density is the least of the deviance on a fine scan."""
    from tofcube.plans import cubes

    get = lambda kind: {(r["tof_bin"], r["y"], r["x"]): r["value"] for r in cubes.full(spark, SF, kind).collect()}
    s, o = get("view"), get("click")
    dead = {(r["y"], r["x"]) for r in C.dead_pixels(cubes.full(spark, SF, "view")).collect()}
    live = {(y, x) for _, y, x in s} - dead
    sig = np.array([1 + 20 / (1 + ((t - 12) / 4) ** 2) for t in range(50)])
    beam = np.array([np.mean([o[t, y, x] for y, x in live]) for t in range(50)])
    n = np.linspace(0, 2, 8001)[:, None]
    m = np.maximum(np.exp(-n * sig), 1e-10)
    checked = 0
    for r in fits.event_map(spark, SF).collect():
        if not r["converged"]:
            continue
        k = np.array([s[t, r["y"], r["x"]] for t in range(50)], float)
        both = np.maximum(k + beam, 1e-300)
        dev = 2 * (np.where(k > 0, k * np.log(np.maximum(k, 1e-300) * (1 + m) / (both * m)), 0) + np.where(beam > 0, beam * np.log(np.maximum(beam, 1e-300) * (1 + m) / both), 0)).sum(1)
        assert r["objective_r"] * 49 <= dev.min() + 1e-4
        checked += 1
    assert checked > 5
