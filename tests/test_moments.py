"""Wide windows over long curves: by moments as segment by segment, with few pieces for each."""

import numpy as np
import pytest

from tofcube.operators import broaden as B
from tofcube.operators import moments as M
from tofcube.operators.pieces import Ends

AT = (25.0, 0.5, 0.01)


def made(n, steps, seed=1):
    rng = np.random.default_rng(seed)
    return 1000.0 + np.cumsum(rng.choice(steps, n)), 50.0 + rng.random(n) * 300.0


def plain(e, v, at):
    """Each segment of the window by itself, by quadrature in short steps."""
    w, (g, h) = B.width(e, *AT), np.polynomial.legendre.leggauss(12)
    out = []
    for i in at:
        a, b = np.searchsorted(e, e[i] - 5.0 * w[i], "left"), np.searchsorted(e, e[i] + 5.0 * w[i], "right")
        x, y = e[a:b], v[a:b]
        cuts = np.repeat(np.diff(x) / 8, 8)
        x0 = np.repeat(x[:-1], 8) + np.tile(np.arange(8), len(x) - 1) * cuts
        t = x0 + 0.5 * (g[:, None] + 1.0) * cuts
        k = h[:, None] * cuts * np.exp(-(((t - e[i]) / w[i]) ** 2))
        out.append((k * np.interp(t, x, y)).sum() / k.sum())
    return np.array(out)


@pytest.mark.parametrize("steps", [[0.02, 0.03, 0.05, 0.3], [0.02] * 40 + [30.0], [0.004]])
@pytest.mark.parametrize("rows", [64, 1 << 14])
def test_wide_windows(spark, monkeypatch, steps, rows):
    """30,000 points, thousands of them in a window. Segment by segment this is over 1e8 pairs."""
    n = 6000 if rows == 64 else 30_000
    e, v = made(n, steps)
    monkeypatch.setattr(B, "BLOCK_ROWS", rows)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(e, v, strict=True)], "c int, e double, value double").repartition(5)
    out = B.gaussian_resolution(df, *AT, ["c"]).orderBy("e").toPandas()
    assert np.array_equal(out.e.to_numpy(), e)
    at = np.array([0, 1, 7, *range(50, n, 997), n - 2, n - 1])
    assert np.allclose(out.value.to_numpy()[at], plain(e, v, at), rtol=0, atol=2e-9)


def test_a_piece_wants_few_pieces():
    """In a curve of 400 pieces whose windows hold a half of them, none wants more than the ends' pieces and some sums; the sums and pieces hold each segment once."""
    import pyarrow as pa

    e, v = made(400 * 50, [0.05])
    w = np.full(len(e), 50.0)
    rows = []
    for k in range(400):
        x, y, u = e[k * 50 : k * 50 + 50], v[k * 50 : k * 50 + 50], w[:50]
        own = M.of_segments(x, y, np.zeros(1, int), (x[:1] + x[-1:]) / 2, (x[-1:] - x[:1]) / 2)[0]
        rows.append({"piece": k, "lo": x[0], "v_lo": y[0], "hi": x[-1], "v_hi": y[-1], "n": 50, "facts": [x[0] - 5 * u[0], x[-1] - 5 * u[0], x[0] + 5 * u[0], x[-1] + 5 * u[0], u[0], *own]})
    ends = Ends(pa.Table.from_pylist(rows))
    for k, wanted, nodes in M._plan(ends):
        assert k in wanted and len(wanted) <= 12 and len(nodes) <= 40
        held = sum(2 * x[1] for x in nodes) + sum(ends.end[j] - ends.lo[j] for j in wanted)
        a, b = np.searchsorted(ends.end, ends.facts[k][0], "left"), np.searchsorted(ends.lo, ends.facts[k][3], "right")
        assert held == pytest.approx(ends.end[b - 1] - ends.lo[a], abs=1e-6)
        assert all(x[1] <= 50.0 for x in nodes)
