"""Distances between vectors as Spark expressions, and the same sums as an Arrow kernel.

All sums are left folds in double precision over the dimensions in order, in every engine, so that a prefix of a
distance, the whole distance and a threshold made from it agree to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def squares(a: Column, b: Column) -> Column:
    """Squared differences by dimension."""
    return F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _fold(squares(a, b))


def prefix_l2(a: Column, b: Column, ends: Sequence[int]) -> Column:
    """Array of the distances over the first `end` dimensions, for each end. The squares are made once."""
    prefixes = lambda s: F.array(*[_fold(F.slice(s, 1, e)) for e in ends])
    return F.transform(F.array(squares(a, b)), prefixes)[0]


def segment(vector: Column, offset: int, dim: int) -> Column:
    """Dimensions offset .. offset + dim - 1."""
    return F.slice(vector, offset + 1, dim)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def safe_sqrt(x: Column) -> Column:
    """Square root; 1 where x is not positive."""
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.sqrt(x))


def fold_l2(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(n, m) squared distances of the rows of x and q, summed dimension by dimension like `l2`."""
    out = np.zeros((len(x), len(q)))
    for d in range(x.shape[1]):
        diff = x[:, d].astype(np.float64)[:, None] - q[:, d].astype(np.float64)[None]
        out += diff * diff
    return out


# The bound of `product_l2`: both sums of n terms err by n + 3 roundings of |x|^2 + |q|^2 at most, a fraction of this.
SLACK = 16 * np.finfo(np.float64).eps


def product_l2(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, m) squared distances of the rows of x and q (doubles) by one matrix product, NaN where a row is not finite, and for each
    row of q how far they may lie from those of `fold_l2`. They tell which pairs need the exact sum."""
    with np.errstate(invalid="ignore", over="ignore"):
        xx, qq = np.einsum("nd,nd->n", x, x), np.einsum("nd,nd->n", q, q)
        odd_x, odd_q = ~np.isfinite(xx), ~np.isfinite(qq)
        d = x @ q.T
        d *= -2
        d += xx[:, None]
        d += qq
    d[odd_x], d[:, odd_q] = np.nan, np.nan
    return d, SLACK * (x.shape[1] + 16) * (np.where(odd_q, 0, qq) + np.where(odd_x, 0, xx).max(initial=0))


PAIRS = 2048  # taken together by `prefixes_l2`, so that their differences stay in the cache


def prefixes_l2(x: np.ndarray, q: np.ndarray, row: np.ndarray, at: np.ndarray, ends: Sequence[int]) -> np.ndarray:
    """(pairs, ends) squared distances of the pairs (x[row], q[at]) over the first `end` dimensions, summed like `fold_l2`."""
    out, last = np.empty((len(row), len(ends))), np.array(ends) - 1
    for s in range(0, len(row), PAIRS):
        diff = x[row[s : s + PAIRS], : ends[-1]].astype(np.float64, copy=False)
        diff -= q[at[s : s + PAIRS], : ends[-1]]
        diff *= diff
        out[s : s + PAIRS] = np.add.accumulate(diff, axis=1, out=diff)[:, last]
    return out


def pair_l2(x: np.ndarray, q: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (x[row], q[at]), summed like `fold_l2`."""
    return prefixes_l2(x, q, row, at, [x.shape[1]])[:, 0]


def where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`np.nonzero` of a matrix; much faster where little is set."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def l2_sql(a: str, b: str) -> str:
    """The same distance in DuckDB."""
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
