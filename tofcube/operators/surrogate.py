"""Density surrogates: dimensions that are built once and broadcast by their size.

A Chebyshev surrogate tabulates a blurred transmission at a few densities; each bin's polynomial
is a row, built by grouped sums and evaluated by Clenshaw's recurrence in place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chebyshev_plan(sigma: DataFrame, matrix: DataFrame | None, most: float, order: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """by, i, box, coefficients: of each bin, the polynomial in the density from 0 to `most` of R exp(-n sigma).

    sigma: (by, i, sigma); matrix: (i, j, w) or None. Each bin is exploded over the nodes, blurred by the
    sparse matrix, and summed into coefficients."""
    nodes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(0.5 * most * (1 + math.cos(math.pi * (k + 0.5) / order))).alias("n")) for k in range(order)])
    t = sigma.select(*by, "i", "sigma", F.explode(nodes).alias("node")).select(*by, "i", F.col("node.k").alias("k"), F.exp(-F.col("node.n") * F.col("sigma")).alias("t"))
    if matrix is not None:
        t = matrix.join(t.withColumnRenamed("i", "j"), "j").groupBy(*by, "i", "k").agg(F.sum(F.col("w") * F.col("t")).alias("t"))
    cos = lambda m: F.cos(F.lit(math.pi * m / order) * (F.col("k") + 0.5))
    coefs = [(F.sum(F.col("t") * cos(m)) * ((1.0 if m == 0 else 2.0) / order)) for m in range(order)]
    return t.groupBy(*by, "i").agg(F.array(*coefs).alias("coefficients")).select(*by, "i", F.lit(float(most)).alias("box"), "coefficients")


def chebyshev_value(coefficients: Column, box: Column, n: Column) -> Column:
    """The polynomial at a density; null outside the box."""
    x = 2.0 * n / box - 1.0
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    rest = F.reverse(F.slice(coefficients, 2, F.size(coefficients)))
    s = F.aggregate(rest, start, lambda s, c: F.struct((c + 2.0 * x * s["a"] - s["b"]).alias("a"), s["a"].alias("b")))
    return F.when((n >= 0) & (n <= box), F.element_at(F.transform(F.array(s), lambda s: F.element_at(coefficients, 1) + x * s["a"] - s["b"]), 1))
