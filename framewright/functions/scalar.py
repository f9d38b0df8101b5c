"""Column helpers that stay within code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def finite(x: str | Column) -> Column:
    """Null instead of NaN and infinities; for columns on entry."""
    c = col(x)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clamp01(x: str | Column) -> Column:
    """Within 0 and 1; null and NaN are 0, and so are infinities in a column given by name.

    An expression stands in the result only once: these nest, and copies of it would multiply at every level.
    """
    c = finite(x) if isinstance(x, str) else F.nanvl(x.cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def weighted(values: Sequence[tuple[str | Column, float]]) -> Column:
    """Mean of clamped values by weight; weights of 0 or less are left out, and without any the mean is 0."""
    used = [(v, w) for v, w in values if w > 0]
    if not used:
        return F.lit(0.0)
    total = sum(w for _, w in used)
    return clamp01(reduce(lambda a, b: a + b, [clamp01(v) * F.lit(float(w)) for v, w in used]) / F.lit(float(total)))


def ratio(n: str | Column, total: str | Column) -> Column:
    return F.coalesce(F.try_divide(col(n).cast("double"), col(total).cast("double")), F.lit(0.0))


def saturation(duration: str | Column, full: float) -> Column:
    return clamp01(col(duration) / F.lit(max(full, 1e-9)))


def r6(x: str | Column) -> Column:
    """Six decimals.  The cut stands a little off the middle, so that decimals ending in 5 go the same way everywhere."""
    return F.floor(col(x) * F.lit(1e6) + F.lit(0.50001371)) / F.lit(1e6)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def round_even(x: str | Column, n: int) -> Column:
    """Half to even, as Python rounds."""
    return F.bround(col(x), n)


def zero_if_null(x: str | Column) -> Column:
    return F.coalesce(col(x), F.lit(0.0))
