"""Gaussian windows over long curves: what is narrow beside the Gaussian stands in a sum by its moments.

A run of segments within one width of its center counts, for any point, as the series of the
Gaussian's derivatives there times the run's moments. With TERMS terms the rest is below 1e-16 of the
run's own weight, so no segment is left out and each still counts where it lies. Which
segments a window holds is settled point by point: at its two ends the segments count one by one,
and only runs that lie whole within it by their moments. A window of n points costs
some log n sums and not n.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from tofcube.operators import broaden
from tofcube.operators.pieces import Ends, Held, cut, meet

#: Moments of a run. The n-th counts (r / w)**n 2**(n/2) / sqrt(n!) at most, with r <= w.
TERMS = 36
#: Segments of the smallest runs, and how many of each size make one of the next.
LEAF, FAN = 64, 8
#: Points whose window holds no more points are summed segment by segment.
DIRECT = 1024
#: Points that share their sums.
SHARE = 256
#: Where more pieces (and twice DIRECT points) lie within all windows of a piece, moments may take their place.
FEW = 4

_SIZE = [0.5 * n * math.log(2.0) - 0.5 * math.lgamma(n + 1) for n in range(TERMS + 1)]
#: The ratios r / w up to which so many terms do.
_REACH = np.array([0.0] + [math.exp((math.log(1e-17) - _SIZE[n]) / n) for n in range(1, TERMS)])
_SHORT, _LONG = np.polynomial.legendre.leggauss(5), np.polynomial.legendre.leggauss(TERMS // 2 + 2)


def of_segments(x: np.ndarray, y: np.ndarray, first: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integrals of the lines between points times ((x - c) / r)**n, for runs of segments that start at the numbers `first`."""
    own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x) - 1)))
    out = np.zeros((len(first), TERMS))
    scale = np.where(r > 0, r, 1.0)[own]
    a, step = (x[:-1] - c[own]) / scale, np.diff(x) / scale
    long = step > 1.0 / 16
    for some, (nodes, weights) in ((~long, _SHORT), (long, _LONG)):
        k = np.flatnonzero(some)
        if len(k):
            g = 0.5 * (nodes[:, None] + 1.0)
            u = a[k] + g * step[k]
            power = (y[k] + g * (y[k + 1] - y[k])) * (0.5 * weights[:, None]) * (x[k + 1] - x[k])
            for n in range(TERMS):
                out[:, n] += np.bincount(own[k], power.sum(0), len(first))
                power *= u
    return out


def moved(m: np.ndarray, c: np.ndarray, r: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Moments about c, in units of r, as those about `to` in units of `size`."""
    size = np.where(size > 0, size, 1.0)
    q, d, out = r / size, (c - to) / size, np.zeros_like(m)
    scaled = m * q[:, None] ** np.arange(TERMS)
    powers = d[:, None] ** np.arange(TERMS)
    for n in range(TERMS):
        choose = np.array([math.comb(n, k) for k in range(n + 1)], float)
        out[:, n] = (scaled[:, : n + 1] * powers[:, n::-1] * choose).sum(1)
    return out


def gathered(lo: np.ndarray, hi: np.ndarray, m: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi and moments of each `fan` runs beside each other; a rest stays out."""
    n = len(lo) // fan
    to_lo, to_hi = lo[: n * fan : fan], hi[fan - 1 : n * fan : fan]
    at = np.repeat(np.arange(n), fan)
    a, b = lo[: n * fan], hi[: n * fan]
    each = moved(m[: n * fan], (a + b) / 2, (b - a) / 2, ((to_lo + to_hi) / 2)[at], ((to_hi - to_lo) / 2)[at])
    return to_lo, to_hi, each.reshape(n, fan, TERMS).sum(1)


def series(e: np.ndarray, w: np.ndarray, c: np.ndarray, r: np.ndarray, m: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Sums over runs of their integrals under exp(-((x - e) / w)**2), for each point. inside: the runs that count for it."""
    out = np.zeros(len(e))
    if not len(c):
        return out
    order = np.argsort(-r, kind="stable")
    c, r, m = c[order], r[order], m[order]
    terms = np.minimum(np.searchsorted(_REACH, r / w.min(), "left") + 1, TERMS)
    t, ratio = (c[:, None] - e) / w, r[:, None] / w
    now = np.exp(-t * t)
    if inside is not None:
        now *= inside.T[order]
    before = np.zeros_like(now)
    twice, square = -2.0 * ratio * t, 2.0 * ratio * ratio
    for n in range(TERMS):
        live = int(np.count_nonzero(terms > n))
        if not live:
            break
        out += m[:live, n] @ now[:live]
        now[:live], before[:live] = (twice[:live] * now[:live] - square[:live] * before[:live]) / (n + 1), now[:live].copy()
    return out


class Tree:
    """A run of points with the moments of its segments, LEAF at a time, FAN of these, and so on."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        self.slope = np.diff(y) / np.where(np.diff(x) > 0, np.diff(x), 1.0)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def grow(self) -> None:
        if self.levels or len(self.x) <= LEAF:
            return
        n = (len(self.x) - 1) // LEAF
        x, y = self.x[: n * LEAF + 1], self.y[: n * LEAF + 1]
        lo, hi = x[:-1:LEAF], x[LEAF::LEAF]
        level = lo, hi, of_segments(x, y, np.arange(n) * LEAF, (lo + hi) / 2, (hi - lo) / 2)
        while len(level[0]):
            self.levels.append(level)
            level = gathered(*level, FAN)

    def covers(self, a: int, b: int, w: float) -> tuple[list[tuple[int, int]], list[int]]:
        """Runs (level, number) no wider than w to each side for the leaves from a to before b, and the leaves that none holds."""
        runs, rest = [], []
        while a < b:
            k = 0
            while k + 1 < len(self.levels) and a % FAN ** (k + 1) == 0 and a + FAN ** (k + 1) <= b and a // FAN ** (k + 1) < len(self.levels[k + 1][0]) and self._half(k + 1, a // FAN ** (k + 1)) <= w:
                k += 1
            at = a // FAN**k
            if self._half(k, at) <= w:
                runs.append((k, at))
            else:
                rest.append(a)
            a += FAN**k
        return runs, rest

    def _half(self, k: int, at: int) -> float:
        return (self.levels[k][1][at] - self.levels[k][0][at]) / 2

    def sums(self, e: np.ndarray, w: np.ndarray, i0: np.ndarray, i1: np.ndarray) -> np.ndarray:
        """The curve's integral under exp(-((x - e) / w)**2) over the segments [i0, i1) of each point."""
        self.grow()
        out, narrow = np.zeros(len(e)), float(w.min())
        leaves = len(self.levels[0][0]) if self.levels else 0
        l0, l1 = -(-i0 // LEAF), np.minimum(i1 // LEAF, leaves)
        some = l0 < l1
        direct = [(np.flatnonzero(~some), i0[~some], i1[~some]), (np.flatnonzero(some), i0[some], l0[some] * LEAF), (np.flatnonzero(some), l1[some] * LEAF, i1[some])]
        if some.any():
            low, high = int(l0[some].min()), int(l1[some].max())
            a, b = int(l0[some].max()), int(l1[some].min())
            if not some.all() or a >= b:
                a = b = high
            runs, rest = self.covers(a, b, narrow)
            for k in {k for k, _ in runs}:
                lo, hi, m = (x[[at for j, at in runs if j == k]] for x in self.levels[k])
                out += series(e, w, (lo + hi) / 2, (hi - lo) / 2, m)
            ends = np.array([*range(low, a), *range(b, high)], int)
            lo, hi, m = (x[ends] for x in self.levels[0])
            wide = (hi - lo) / 2 > narrow
            near = ends[~wide]
            out += series(e, w, ((lo + hi) / 2)[~wide], ((hi - lo) / 2)[~wide], m[~wide], some[:, None] & (near >= l0[:, None]) & (near < l1[:, None]))
            for leaf in [*rest, *ends[wide]]:
                k = np.flatnonzero(some & (l0 <= leaf) & (leaf < l1))
                direct.append((k, np.full(len(k), leaf * LEAF), np.full(len(k), (leaf + 1) * LEAF)))
        k, first, stop = (np.concatenate(x) for x in zip(*direct, strict=True))
        full = stop > first
        k, first, stop = k[full], first[full], stop[full]
        return out + np.bincount(k, self.one_by_one(e[k], w[k], first, stop), len(e))

    def one_by_one(self, e: np.ndarray, w: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The same, segment by segment: by five nodes where it is short beside w (differences of erfc have few digits there), else by the closed form."""
        out, (nodes, weights) = np.zeros(len(e)), _SHORT
        for rows, own, k in broaden._blocks(first, stop):
            step, at = self.x[k + 1] - self.x[k], rows[own]
            long = step > 0.25 * w[at]
            each = np.zeros(len(k))
            for g, weight in zip(0.5 * (nodes + 1.0), weights, strict=True):
                t = (self.x[k] + g * step - e[at]) / w[at]
                each += 0.5 * weight * (self.y[k] + g * (self.y[k + 1] - self.y[k])) * np.exp(-t * t)
            each *= step
            if long.any():
                at, k = at[long], k[long]
                each[long] = broaden.segment_sums(self.x, self.y, self.slope, e[at], w[at], k, k + 2)[1] * (math.sqrt(math.pi) / 2 * w[at])
            out[rows] = np.bincount(own, each, len(rows))
        return out


def _run(width: Callable[[np.ndarray], np.ndarray]) -> Callable[[Held], dict[str, np.ndarray]]:
    def run(held: Held) -> dict[str, np.ndarray]:
        e, out, w = held.e, held.value.copy(), width(held.e)
        trees = [Tree(x, y) for x, y in held.runs]
        first = [np.searchsorted(t.x, e - 5.0 * w, "left") for t in trees]
        stop = [np.searchsorted(t.x, e + 5.0 * w, "right") for t in trees]
        n = sum(b - a for a, b in zip(first, stop, strict=True))
        wide = w > 1e-60
        plain = np.flatnonzero(wide & (n > 1) & (n <= DIRECT)) if len(trees) == 1 else np.zeros(0, int)
        norm, part = np.zeros(len(e)), np.zeros(len(e))
        if len(plain):
            norm[plain], part[plain] = broaden.segment_sums(trees[0].x, trees[0].y, trees[0].slope, e[plain], w[plain], first[0][plain], stop[0][plain])
        many = np.flatnonzero(wide & ((n > DIRECT) | (len(trees) > 1)))
        for at in range(0, len(many), SHARE):
            k = many[at : at + SHARE]
            a, b = np.full(len(k), np.inf), np.full(len(k), -np.inf)
            total = np.zeros(len(k))
            if len(held.nodes):
                total += series(e[k], w[k], held.nodes[:, 0], held.nodes[:, 1], held.nodes[:, 2:])
            for t, i0, i1 in zip(trees, first, stop, strict=True):
                i0, i1 = i0[k], i1[k]
                some = i1 > i0
                a[some], b[some] = np.minimum(a[some], t.x[i0[some]]), np.maximum(b[some], t.x[i1[some] - 1])
                total += t.sums(e[k], w[k], np.where(some, i0, 0), np.where(some, i1 - 1, 0))
            norm[k] = broaden._erfc((a - e[k]) / w[k]) - broaden._erfc((b - e[k]) / w[k])
            part[k] = total * (2.0 / math.sqrt(math.pi)) / w[k]
        good = norm > broaden.K.DIVISION_FLOOR
        out[good] = part[good] / norm[good]
        return {"value": out}

    return run


def _plan(ends: Ends) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Pieces that the windows' ends sweep, and the largest sums that lie in all windows of a piece and are within its least width."""
    facts = np.array(ends.facts)
    low, low_most, high_least, high, w = facts[:, :5].T
    c, r = (ends.lo + ends.end) / 2, (ends.end - ends.lo) / 2
    m = moved(facts[:, 5:], (ends.lo + ends.hi) / 2, (ends.hi - ends.lo) / 2, c, r)
    link = np.flatnonzero(ends.end > ends.hi)
    if len(link):
        x, y = np.column_stack((ends.hi, ends.next_e))[link].ravel(), np.column_stack((ends.v_hi, ends.next_value))[link].ravel()
        # of the segments between these points every second is a link
        m[link] += of_links(x[::2], x[1::2], y[::2], y[1::2], c[link], r[link])
    levels = [(ends.lo, ends.end, m)]
    while len(levels[-1][0]) > 1:
        levels.append(gathered(*levels[-1], 2))
    half = [(hi - lo) / 2 for lo, hi, _ in levels]
    for k in range(len(c)):
        a, b = int(np.searchsorted(ends.end, low[k], "left")), int(np.searchsorted(ends.lo, high[k], "right"))
        p, q = int(np.searchsorted(ends.lo, low_most[k], "left")), int(np.searchsorted(ends.end, high_least[k], "right"))
        p, q = max(p, 1), min(q, len(c) - 1)  # the curve's own ends end windows too
        take = np.ones(b - a, bool)
        nodes = []
        if q - p > FEW and ends.n[p:q].sum() > 2 * DIRECT:
            for at, stop in ((p, min(q, k)), (max(p, k + 1), q)):
                while at < stop:
                    j = 0
                    if half[0][at] <= w[k]:
                        while j + 1 < len(levels) and at % 2 ** (j + 1) == 0 and at + 2 ** (j + 1) <= stop and half[j + 1][at >> (j + 1)] <= w[k]:
                            j += 1
                        lo, hi, sums = (x[at >> j] for x in levels[j])
                        nodes.append(np.concatenate(([(lo + hi) / 2, (hi - lo) / 2], sums)))
                        take[max(at - a, 0) : at + 2**j - a] = False
                    at += 2**j
        yield k, a + np.flatnonzero(take), nodes


def of_links(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The moments of one segment each."""
    nodes, weights = _LONG
    g = 0.5 * (nodes[:, None] + 1.0)
    u = (x0 + g * (x1 - x0) - c) / r
    power = (y0 + g * (y1 - y0)) * (0.5 * weights[:, None]) * (x1 - x0)
    out = np.empty((len(c), TERMS))
    for n in range(TERMS):
        out[:, n] = power.sum(0)
        power *= u
    return out


def blurred(curves: DataFrame, by: list[str], width: Callable[[np.ndarray], np.ndarray], rows: int) -> DataFrame:
    """by, e, value: curves (by, e, value) under a Gaussian of a width for each energy, over five widths, normalised by the window's own weight."""

    def facts(e: np.ndarray, v: np.ndarray) -> np.ndarray:
        w = width(e)
        own = of_segments(e, v, np.zeros(1, int), (e[:1] + e[-1:]) / 2, (e[-1:] - e[:1]) / 2)[0] if len(e) > 1 else np.zeros(TERMS)
        return np.concatenate(([(e - 5.0 * w).min(), (e - 5.0 * w).max(), (e + 5.0 * w).min(), (e + 5.0 * w).max(), w.min()], own))

    # a piece's widths are alike: within a factor of two
    octave = lambda e: np.floor(np.log2(np.maximum(width(e), 1e-300)))
    return meet(cut(curves, by, octave, facts, rows), by, _plan, _run(width), ["value"])
