"""Vector algebra on ``array<float|double>`` columns as native expressions.

All accumulation happens in double; float32 storage is only widened, never summed in float.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Σ aᵢ·bᵢ in double (arrays of equal length)."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, v: s + v)


def norm(a) -> Column:
    sq = F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda s, v: s + v))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has zero norm (V4)."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def vadd(a, b) -> Column:
    """Element-wise add."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vmul(a, b) -> Column:
    """Element-wise multiply (X16). The reference kernel adds here; we build the multiply."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def flatten_matrix(m) -> Column:
    """Row-major flatten of ``array<array<T>>``."""
    return F.flatten(_c(m))


def vslice(a, start: int, length: int) -> Column:
    """0-based column range of a flattened row, e.g. the 16-wide weight slices."""
    return F.slice(_c(a), start + 1, length)
