"""Joins on time: points in intervals, nearest points, last before and first after.

A join on a range alone compares all pairs.  These add equality on the key and on a time bucket, so each is a hash or
merge join whose range condition is checked on the few rows of a bucket.  A point is in one bucket only, so no pair is
found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def points_in(points: DataFrame, spans: DataFrame, key: str, at: str, lo: Column, hi: Column, width: float, exact: Column, how: str = "inner") -> DataFrame:
    """Rows of ``spans`` joined to the points of the same key for which ``exact`` holds.

    ``lo`` and ``hi`` bound (over the columns of ``spans``) where such points can be; ``width`` is the bucket in seconds,
    best about as long as a usual span.  ``how`` is 'inner', or 'left' to keep spans without a point.
    """
    b = lambda c: F.floor(c / F.lit(float(width)))
    p = points.withColumn("_bucket", b(F.col(at)))
    s = spans.withColumn("_span", F.monotonically_increasing_id()) if how == "left" else spans
    cut = s.withColumn("_bucket", F.explode(F.sequence(b(lo), F.greatest(b(lo), b(hi)))))
    met = cut.join(p, [key, "_bucket"]).where(exact).drop("_bucket")
    if how == "inner":
        return met
    found = [c for c in points.columns if c != key]
    return s.join(met.select("_span", *found), "_span", "left").drop("_span")


def last_before(rows: DataFrame, events: DataFrame, key: str, at: str, event_at: str, value: str, name: str, inclusive: bool = True) -> DataFrame:
    """Adds ``name``: ``value`` of the last event at or before (before, if not ``inclusive``) each row's ``at``."""
    return _as_of(rows, events, key, at, event_at, value, name, True, inclusive)


def first_after(rows: DataFrame, events: DataFrame, key: str, at: str, event_at: str, value: str, name: str, inclusive: bool = True) -> DataFrame:
    """Adds ``name``: ``value`` of the first event at or after (after, if not ``inclusive``) each row's ``at``."""
    return _as_of(rows, events, key, at, event_at, value, name, False, inclusive)


def _as_of(rows, events, key, at, event_at, value, name, back, inclusive):
    """One pass over both sides in time order instead of a join on a range."""
    r = rows.withColumn("_is_row", F.lit(True)).withColumn("_at", F.col(at))
    e = events.select(key, F.col(event_at).alias("_at"), F.col(value).alias("_v"), F.lit(False).alias("_is_row"))
    both = r.unionByName(e, allowMissingColumns=True)
    first = F.col("_is_row") if inclusive else ~F.col("_is_row")  # events at the same time come before the row that may see them
    order = [F.col("_at").asc(), first.asc()] if back else [F.col("_at").desc(), first.asc()]
    w = Window.partitionBy(key).orderBy(*order, F.col("_v").asc() if back else F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.last(F.when(~F.col("_is_row"), F.col("_v")), ignorenulls=True).over(w)).where("_is_row").drop("_is_row", "_at", "_v")
