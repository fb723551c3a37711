"""Least squares from Gram matrices, as column expressions.

A Gram matrix holds the sums of products of all pairs of columns of a regression, the target last. It is an ordinary
aggregate (``gram_sums``), so its parts merge map-side, or it comes from vectors held in arrays (``gram_of``).
``swept`` eliminates its columns one by one. After k steps the first k rows hold the coefficients of the regression
on the first k columns, the rest holds what that regression leaves of the other columns: so one pass serves all nested
regressions. Matrices are arrays of rows of doubles, of a size that the number of lags bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A column of which the earlier ones leave less than this share is explained by them and skipped.
REST = 1e-10


def gram_sums(columns: Sequence[str], where: str) -> Column:
    """Gram matrix of SQL expressions over the rows of a group that satisfy a condition."""
    entry = lambda i, j: f"sum(CASE WHEN {where} THEN ({columns[i]}) * ({columns[j]}) END)"
    rows = [", ".join(entry(min(i, j), max(i, j)) for j in range(len(columns))) for i in range(len(columns))]
    return F.expr(f"array({', '.join(f'array({r})' for r in rows)})")


def gram_of(vectors: Column) -> Column:
    """Gram matrix of an array of equally long arrays."""
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, v: total + v)
    return F.transform(vectors, lambda a: F.transform(vectors, lambda b: dot(a, b)))


def swept(matrix: Column, steps: Column | int) -> Column:
    """(m, pivots, corners) after eliminating the first ``steps`` columns of a matrix column.

    pivots[k] is what was left of column k when its turn came (null if it was skipped); corners[k] is the last
    diagonal element after k steps, the residual sum of squares of the target on the first k columns.
    """
    steps = F.lit(steps) if isinstance(steps, int) else steps
    at = lambda m, i, j: F.get(F.get(m, i), j)
    end = F.size(matrix) - 1
    start = F.struct(
        matrix.alias("m"), F.array().cast("array<double>").alias("pivots"),
        F.array(at(matrix, end, end)).alias("corners"))

    def eliminate(state: Column, k: Column) -> Column:
        m = state["m"]
        pivot = at(m, k, k)
        usable = pivot > REST * at(matrix, k, k)
        rows = F.transform(m, lambda row, i: F.when(
            i == k, F.transform(row, lambda v: v / pivot)
        ).otherwise(F.transform(row, lambda v, j: v - F.get(row, k) / pivot * at(m, k, j))))
        corner = F.element_at(state["corners"], -1)
        return F.struct(
            F.when(usable, rows).otherwise(m).alias("m"),
            F.concat(state["pivots"], F.array(F.when(usable, pivot))).alias("pivots"),
            F.concat(state["corners"], F.array(F.when(
                usable, F.greatest(F.lit(0.0), corner - at(m, k, end) * at(m, k, end) / pivot)
            ).otherwise(corner))).alias("corners"))

    turns = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, start, eliminate)


def part(matrix: Column, lead: int, size: int, trail: int) -> Column:
    """The first ``lead`` and the last ``trail`` rows and columns of a matrix of ``size``."""
    pick = lambda items: F.concat(F.slice(items, 1, lead), F.slice(items, size - trail + 1, trail))
    return F.transform(pick(matrix), pick)
