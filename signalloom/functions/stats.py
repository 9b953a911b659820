"""Column expressions that Spark has no single function for."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def average_rank(value: str | Column, keys: Sequence[str]) -> Column:
    """Average-tie rank within keys: the mean of the smallest and the largest rank, by one window."""
    w = Window.partitionBy(*keys).orderBy(col(value))
    return (F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2


def max_rank(value: str | Column, keys: Sequence[str]) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(col(value)))


def size_of(keys: Sequence[str]) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*keys))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), col(b))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of the pairs without nulls; null where a side is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def annual(x: str | Column, days: int = 252) -> Column:
    return F.avg(col(x)) * days


def annual_deviation(x: str | Column, days: int = 252) -> Column:
    return F.stddev_samp(col(x)) * F.sqrt(F.lit(float(days)))


def share_positive(x: str | Column) -> Column:
    return F.avg((F.signum(col(x)) + 1) / 2)


def no_nan(x: str | Column) -> Column:
    return F.when(~F.isnan(col(x)), col(x))


def two_sided_p(t: Column, freedom: Column) -> Column:
    """The p-value of a t-statistic: twice the upper tail of Student's distribution, by its finite series."""

    @F.pandas_udf("double")
    def tail(ts: pd.Series, ns: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(ts, ns, strict=True):
            if pd.isna(x) or pd.isna(n) or n < 1:
                out.append(None)
                continue
            n, angle = int(n), math.atan(abs(x) / math.sqrt(n))
            term = total = float(n > 1)
            for k in range(2 + n % 2, n - 1, 2):
                term *= math.cos(angle) ** 2 * (k - 1) / k
                total += term
            inside = 2 / math.pi * (angle + math.sin(angle) * math.cos(angle) * total) if n % 2 else math.sin(angle) * total
            out.append(min(max(1 - inside, 0.0), 1.0))
        return pd.Series(out, dtype="float64")

    return tail(t, freedom)
