"""The fit and broadening queries on a small table of their own, against plain versions over all its rows."""

import numpy as np
import pytest

from tests.test_reference import plain_doppler
from tofcube.operators import broaden as B
from tofcube.plans import fits

IDS = (0, 7, 399, 400, 1999)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("fits"))
    vecs = [(k, "g", [float(0.05 + 0.07 * ((k + 3 * i) % 6)) for i in range(8)]) for k in IDS]
    spark.createDataFrame(vecs, "vec_id bigint, label string, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    parts = [(k, f"Brand#{b}", 3 + 4 * k) for b in (11, 12, 13) for k in (1, 2)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    return d


def plain_density(k, kind):
    i = np.arange(8)
    sig = np.abs(np.float32(0.05 + 0.07 * ((k + 3 * i) % 6)).astype(float)) * 100 + 1
    t, wob = np.exp(-(0.01 + k % 5 * 0.01) * sig), (k * 31 + i * 17) % 13 - 6
    n = np.linspace(0, 0.1, 100001)[:, None]
    m = np.exp(-n * sig)
    if kind == "lm":
        f = ((t + wob * 0.001 - m) ** 2).sum(1)
    else:
        c, o = np.round(t * 1000 + wob * 2), 1000.0
        f = (2 * (np.where(c > 0, c * np.log(np.maximum(c, 1e-9) * (1 + m) / ((c + o) * m)), 0) + o * np.log(o * (1 + m) / (c + o)))).sum(1)
    return n[f.argmin(), 0]


@pytest.mark.parametrize("name,kind", [("fit_spectrum_lm", "lm"), ("fit_counts_kl", "kl")])
def test_every_embedding_is_a_pixel(spark, sf, name, kind):
    got = {(r["y"], r["x"]): r for r in fits.QUERIES[name](spark, sf).collect()}
    assert got.keys() == {(k // 20, k % 20) for k in IDS}
    for k in IDS:
        r = got[k // 20, k % 20]
        assert r["converged"] and abs(r["density"] - plain_density(k, kind)) < 3e-5


def test_report_counts_every_pixel(spark, sf):
    r = fits.QUERIES["map_report"](spark, sf).first()
    assert (r["n_total"], r["n_converged"]) == (len(IDS), len(IDS))
    assert abs(r["mean"] - np.mean([plain_density(k, "lm") for k in IDS])) < 3e-5


def test_every_isotope_is_a_curve(spark, sf):
    raw, broad = (d.orderBy("e").toPandas() for d in (fits.curves(spark, sf), fits.QUERIES["doppler_broaden"](spark, sf)))
    assert raw.grp.nunique() == broad.grp.nunique() == 3 and len(raw) == len(broad) == 2400
    for g, one in raw.groupby("grp"):
        assert np.allclose(broad[broad.grp == g].sigma, plain_doppler(one.e.to_numpy(), one.sigma.to_numpy(), 293.6, 178.0), rtol=2e-3)
    assert fits.QUERIES["resolution_broaden"](spark, sf).groupBy("grp").count().orderBy("grp").toPandas()["count"].tolist() == [800] * 3
    sums = broad.groupby("e").sigma.sum().reset_index()
    t = spark.createDataFrame([("a", float(e), float(np.exp(-0.002 * s))) for e, s in zip(sums.e, sums.sigma, strict=True)], "grp string, e double, value double")
    want = B.gaussian_resolution(t, 25.0, 0.5, 0.01, ["grp"]).orderBy("e").toPandas().value
    assert np.allclose(fits.QUERIES["forward_model"](spark, sf).orderBy("e").toPandas().value, want, atol=1e-6)
