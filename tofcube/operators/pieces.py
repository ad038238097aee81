"""Long curves as rows of arrays: pieces of some thousand points that move as one row each.

A curve is range-partitioned and sorted once and cut into pieces. What a piece wants of its curve
is told by a plan over the pieces' few facts (a row of numbers for some thousand points): pieces
as they are, or sums that stand for them. Each piece is then one group with what it wants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube.work import written

#: Points of a piece.
PIECE_ROWS = 1 << 13
#: What a plan says: the piece that wants, the piece it wants (none with a node), whether it is its own, whether the next piece isn't wanted, the next point, and sums in a piece's place.
_PLAN = "target bigint, piece bigint, own boolean, last boolean, next_e double, next_value double, node array<double>"


def _kinds(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def lists(rows: np.ndarray) -> pa.ListArray:
    """A row of numbers each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), pa.float64()))


def cut(curves: DataFrame, by: list[str], mark: Callable[[np.ndarray], np.ndarray], facts: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int) -> DataFrame:
    """by, piece, first and last point, n, facts, e, value: the pieces of curves (by, e, value), numbered in order; none goes beyond a change of `mark`."""

    def piece(t: pa.Table) -> pa.RecordBatch:
        e, v = t.column("e").to_numpy(), t.column("value").to_numpy()
        one = [pa.array([float(x)]) for x in (e[0], v[0], e[-1], v[-1])]
        out = t.select(by).slice(0, 1)
        for name, x in zip(("lo", "v_lo", "hi", "v_hi", "n", "facts", "e", "value"), [*one, pa.array([len(e)], pa.int64()), *(lists(a[None]) for a in (facts(e, v), e, v))], strict=True):
            out = out.append_column(name, x)
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            new = np.zeros(t.num_rows, bool)
            for x in (*(pc.dictionary_encode(t.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy() for c in by), mark(t.column("e").to_numpy())):
                new[1:] |= x[1:] != x[:-1]
            starts = [0, *np.flatnonzero(new)]
            for a, z in zip(starts, [*starts[1:], t.num_rows], strict=True):
                while z - a > rows:
                    yield piece(t.slice(a, rows))
                    a += rows
                if z < t.num_rows:
                    yield piece(t.slice(a, z - a))
            held = t.slice(a, z - a)
        if held is not None:
            yield piece(held)

    placed = curves.select(*by, F.col("e").cast("double").alias("e"), F.col("value").cast("double").alias("value")).repartitionByRange(*by, "e").sortWithinPartitions(*by, "e")
    made = placed.mapInArrow(run, f"{_kinds(curves, by)}lo double, v_lo double, hi double, v_hi double, n bigint, facts array<double>, e array<double>, value array<double>")
    return written(made.withColumn("piece", F.monotonically_increasing_id()), "pieces")


class Ends:
    """The pieces of one curve in order, without their points."""

    def __init__(self, t: pa.Table):
        t = t.sort_by("piece")
        self.piece, self.lo, self.v_lo, self.hi, self.v_hi, self.n = (t.column(c).to_numpy() for c in ("piece", "lo", "v_lo", "hi", "v_hi", "n"))
        self.facts = [np.asarray(x) for x in t.column("facts").to_pylist()]
        self.next_e, self.next_value = np.append(self.lo[1:], np.nan), np.append(self.v_lo[1:], np.nan)
        #: where the segment to the next piece ends
        self.end = np.append(self.lo[1:], self.hi[-1:])


def meet(pieces: DataFrame, by: list[str], plan: Callable[[Ends], Iterator[tuple[int, np.ndarray, list[np.ndarray]]]], run: Callable[["Held"], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """by, e (the piece's own, if run gives none) and the columns of run for each piece, from what the plan says that it wants: its number among the curve's, the numbers of pieces (its own among them), and nodes."""
    kinds = _kinds(pieces, by)

    def planned(t: pa.Table) -> pa.Table:
        ends, raw, nodes = Ends(t), [], []
        for k, wanted, sums in plan(ends):
            raw.append((np.full(len(wanted), ends.piece[k]), ends.piece[wanted], wanted == k, np.append(np.diff(wanted) > 1, True), ends.next_e[wanted], ends.next_value[wanted]))
            nodes += [(ends.piece[k], x) for x in sums]
        cols = [np.concatenate(c) for c in zip(*raw, strict=True)]
        m, n = len(cols[0]), len(nodes)
        out = {name: pa.concat_arrays([pa.array(c), pa.nulls(n, pa.array(c).type)]) for name, c in zip(("piece", "own", "last", "next_e", "next_value"), cols[1:], strict=True)}
        out = {"target": pa.array(np.append(cols[0], [x[0] for x in nodes]).astype(np.int64)), **out, "node": pa.concat_arrays([pa.nulls(m, pa.list_(pa.float64())), lists(np.array([x[1] for x in nodes])) if n else pa.nulls(0, pa.list_(pa.float64()))])}
        same = pa.array(np.zeros(m + n, np.int64))
        return pa.table({**{c: t.column(c).take(same) for c in by}, **out})

    few = pieces.select(*by, "piece", "lo", "v_lo", "hi", "v_hi", "n", "facts")
    plans = written(few.groupBy(*by).applyInArrow(planned, kinds + _PLAN), "curve-plan")
    points = pieces.select(F.col("piece").alias("_piece"), "e", "value")
    raw = plans.where("node IS NULL").join(points, F.col("piece") == F.col("_piece")).drop("_piece")
    none = F.lit(None).cast("array<double>")
    items = raw.unionByName(plans.where("node IS NOT NULL").withColumns({"e": none, "value": none}))

    def one(t: pa.Table) -> pa.Table:
        held = Held(t)
        out = run(held)
        e = out.get("e", held.e)
        found = t.select(by).take(pa.array(np.zeros(len(e), np.int64))).append_column("e", pa.array(e))
        for name in names:
            found = found.append_column(name, pa.array(out[name], pa.float64()))
        return found

    return items.groupBy(*by, "target").applyInArrow(one, f"{kinds}e double, " + ", ".join(f"{c} double" for c in names))


class Held:
    """What one piece has: its own points (e, value), runs of points beside each other in order, each with the first point behind it, and nodes."""

    def __init__(self, t: pa.Table):
        raw = t.filter(pc.is_null(t.column("node"))).sort_by("piece")
        self.nodes = np.array([x for x in t.column("node").to_pylist() if x is not None])
        xs, vs = ([x.values.to_numpy() for x in raw.column(c)] for c in ("e", "value"))
        own = raw.column("own").to_pylist().index(True)
        self.e, self.value, self.next_e = xs[own], vs[own], raw.column("next_e")[own].as_py()
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        for k, (last, ne, nv) in enumerate(zip(*(raw.column(c).to_pylist() for c in ("last", "next_e", "next_value")), strict=True)):
            if last:
                more = [] if np.isnan(ne) else [[ne], [nv]]
                self.runs.append((np.concatenate(xs[at : k + 1] + more[:1]), np.concatenate(vs[at : k + 1] + more[1:])))
                at = k + 1
