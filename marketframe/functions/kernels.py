"""Column building blocks shared by every feature module.

All of them follow the same null rules: NULL is the only missing value, a
comparison with a missing value makes a flag 0, and a rolling value is missing
until its window holds enough non-null rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def prices() -> tuple[Column, Column, Column, Column]:
    """open, high, low, close"""
    return tuple(F.col(c) for c in ("open", "high", "low", "close"))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def safe_div(a: Column, b: Column, fill: float = 0.0) -> Column:
    """a / b with ``fill`` for a zero or missing denominator or numerator."""
    return F.coalesce(F.try_divide(a, b), F.lit(float(fill)))


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    """Bound x on both sides, keeping NULL as NULL."""
    bounded = F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    return F.when(x.isNotNull(), bounded)


def round4(x: Column) -> Column:
    """Half-even rounding to 4 places by scaling, as vectorised libraries do it."""
    return F.rint(x * 10000.0) / 10000.0


def sum_of(columns: list[Column]) -> Column:
    return reduce(add, columns)


class Frames:
    """Window expressions over one ordering, all sharing one partition spec.

    Because every frame uses the same partitioning and order, Catalyst puts them
    on one Exchange and one Sort however many are asked for.
    """

    def __init__(self, keys: list[str], order: Column):
        self.w = Window.partitionBy(*keys).orderBy(order)
        self.so_far = self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.whole = Window.partitionBy(*keys)

    def last_rows(self, k: int):
        return self.w.rowsBetween(-(k - 1), Window.currentRow)

    def rows_before(self, k: int):
        return self.w.rowsBetween(-k, -1)

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(x, n).over(self.w)

    def diff(self, x: Column, n: int = 1) -> Column:
        return x - self.lag(x, n)

    def row(self) -> Column:
        return F.row_number().over(self.w)

    def roll(self, fn, x: Column, k: int, min_rows: int | None = None) -> Column:
        """``fn`` over the last k rows, NULL until ``min_rows`` of them are non-null."""
        frame = self.last_rows(k)
        need = k if min_rows is None else min_rows
        return F.when(F.count(x).over(frame) >= need, fn(x).over(frame))

    def mean(self, x: Column, k: int, min_rows: int | None = None) -> Column:
        return self.roll(F.avg, x, k, min_rows)

    def total(self, x: Column, k: int) -> Column:
        return self.roll(F.sum, x, k)

    def std(self, x: Column, k: int, min_rows: int | None = None) -> Column:
        return self.roll(F.stddev_samp, x, k, min_rows)

    def high(self, x: Column, k: int, min_rows: int | None = None) -> Column:
        return self.roll(F.max, x, k, min_rows)

    def low(self, x: Column, k: int, min_rows: int | None = None) -> Column:
        return self.roll(F.min, x, k, min_rows)

    def quantile(self, x: Column, q: float, k: int, min_rows: int) -> Column:
        """Linearly interpolated quantile of the last k rows."""
        return self.roll(lambda v: F.percentile(v, F.lit(q)), x, k, min_rows)

    def slope(self, y: Column, t: Column, k: int) -> Column:
        """Least-squares slope of y on t over the last k rows."""
        frame = self.last_rows(k)
        return F.when(F.count(y).over(frame) >= k, F.regr_slope(y, t).over(frame))

    def skew(self, x: Column, k: int) -> Column:
        """Bias-corrected skewness; Spark's own is the population form."""
        factor = (k * (k - 1)) ** 0.5 / (k - 2)
        return self.roll(F.skewness, x, k) * F.lit(factor)

    def recent(self, x: Column, k: int) -> Column:
        """The last k non-null values, oldest first (never more than k)."""
        return F.collect_list(x).over(self.last_rows(k))

    def ewm(self, x: Column, alpha: float) -> Column:
        """Adjusted exponential mean of everything so far, missing values skipped.

        Spark ships this window expression for its pandas API; the accessor is
        internal, so this is the one place that touches it.
        """
        return InternalFunction.ewm(x, alpha, True).over(self.w)


def rank_in(recent: Column, x: Column, min_rows: int) -> Column:
    """Percentile rank of x within an array of recent values, ties averaged."""
    below = F.size(F.filter(recent, lambda v: v < x))
    equal = F.size(F.filter(recent, lambda v: v == x))
    rank = below + (equal + 1) / 2
    return F.when(F.size(recent) >= min_rows, rank / F.size(recent))


def below_quantile(recent: Column, x: Column, q: float, min_rows: int) -> Column:
    """1 if x, itself in ``recent``, is below the interpolated q-quantile of ``recent``.

    Counting decides it: the quantile lies between the sorted values at floor(q(n-1)) and
    the next one, and no member of the window lies strictly between those two.
    """
    n = F.size(recent)
    at = (n - 1) * F.lit(q)
    low = F.floor(at)
    not_above = F.size(F.filter(recent, lambda v: v <= x))
    return flag(x.isNotNull() & (n >= min_rows) & ((not_above <= low) | ((not_above == low + 1) & (at > low))))


def above_quantile(recent: Column, x: Column, q: float, min_rows: int) -> Column:
    """1 if x, itself in ``recent``, is above the interpolated q-quantile of ``recent``."""
    n = F.size(recent)
    below = F.size(F.filter(recent, lambda v: v < x))
    return flag(x.isNotNull() & (n >= min_rows) & (below > F.floor((n - 1) * F.lit(q))))
