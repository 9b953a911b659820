"""Joins of signals with panels, and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def returns_on(signal: DataFrame, ret: DataFrame, day: str = "date_ret", opening: bool = False) -> DataFrame:
    """The signal's rows with date, ret and resret of that day; at the open, the open-to-open returns."""
    names = ("openret", "resopenret") if opening else ("ret", "resret")
    right = ret.select("security_id", "date", F.col(names[0]).alias("ret"), F.col(names[1]).alias("resret"))
    return signal.withColumnRenamed(day, "date").join(right, ["security_id", "date"])


def build_master(ret: DataFrame, risk: DataFrame) -> DataFrame:
    """ret joined with risk; columns that both have come from ret."""
    keys = ["security_id", "date"]
    return ret.join(risk.drop(*(c for c in risk.columns if c in ret.columns and c not in keys)), keys)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_day: str,
    right_day: str,
    columns: Sequence[str],
    tolerance: int | None = None,
) -> DataFrame:
    """left with columns of the latest right row of the same key on or before its day, at most tolerance days old.

    Both sides are stacked and the last right row is carried forward as one struct, so nulls inside it stay. One
    shuffle and one sort by key; no row meets more than its own key's rows.
    """
    packed = F.struct(F.col(right_day).alias("__day"), *(F.col(c).alias(c) for c in columns))
    kind = F.struct(*(F.col(c) for c in left.columns))
    a = left.select(*by, F.col(left_day).alias("__at"), F.lit(1).alias("__side"), kind.alias("__left"))
    b = right.select(*by, F.col(right_day).alias("__at"), F.lit(0).alias("__side"), packed.alias("__right"))
    w = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("__right", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    fresh = F.lit(True) if tolerance is None else F.datediff("__at", "__right.__day") <= tolerance
    return both.select("__left.*", *(F.when(fresh, F.col(f"__right.{c}")).alias(c) for c in columns))


def asof_bucketed(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_day: str,
    right_day: str,
    columns: Sequence[str],
    tolerance: int | None = None,
    days: int = 64,
) -> DataFrame:
    """asof_backward for keys of long histories: the same result, by (key, bucket of so many days) instead of by key.

    Within a bucket the last right row is carried forward as before. What a bucket begins with is the last right row of the
    buckets before it: each bucket's own last row comes from one aggregate, and is carried over buckets that have none by a
    second pass over (key, bucket), which has a row for each bucket and no others. So a key that holds all rows is as many
    tasks' work as it has buckets.
    """
    bucket = lambda day: F.floor(F.unix_date(F.to_date(day)) / days).alias("__bucket")
    packed = F.struct(F.col(right_day).alias("__day"), *(F.col(c).alias(c) for c in columns))
    kind = F.struct(*(F.col(c) for c in left.columns))
    a = left.select(*by, bucket(left_day), F.col(left_day).alias("__at"), F.lit(1).alias("__side"), kind.alias("__left"))
    b = right.select(*by, bucket(right_day), F.col(right_day).alias("__at"), F.lit(0).alias("__side"), packed.alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)

    ends = b.groupBy(*by, "__bucket").agg(F.max_by("__right", "__at").alias("__end"))
    ends = a.select(*by, "__bucket").distinct().join(ends, [*by, "__bucket"], "full_outer")
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "__bucket", F.last("__end", ignorenulls=True).over(before).alias("__begin"))

    w = Window.partitionBy(*by, "__bucket").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__right", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    both = both.join(ends, [*by, "__bucket"], "left").withColumn("__right", F.coalesce("__right", "__begin"))
    fresh = F.lit(True) if tolerance is None else F.datediff("__at", "__right.__day") <= tolerance
    return both.select("__left.*", *(F.when(fresh, F.col(f"__right.{c}")).alias(c) for c in columns))


def panel_days(bounds: DataFrame, dates: DataFrame) -> DataFrame:
    """Calendar days between each group's low and high date; the calendar has a row a day and is broadcast."""
    days = F.broadcast(dates.select("date", "n"))
    return bounds.join(days, days["date"].between(bounds["low"], bounds["high"])).drop("low", "high")


def previous_holdings(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weights beside those of the period before, entries and exits included: w and w_before, one of them null."""
    before = weights.select("security_id", *keys, (F.col("n") + 1).alias("n"), F.col("weight").alias("w_before"))
    now = weights.select("security_id", *keys, "n", F.col("weight").alias("w"))
    return now.join(before, ["security_id", *keys, "n"], "full_outer")


def exits(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Holdings of the period before that are gone, in the period in which they are."""
    before = weights.select("security_id", *keys, (F.col("n") + 1).alias("n"), "weight")
    return before.join(weights.select("security_id", *keys, "n"), ["security_id", *keys, "n"], "left_anti")


def forward_returns(
    signal: DataFrame, ret: DataFrame, days: int = 1, day: str = "date_avail", dates: DataFrame | None = None
) -> DataFrame:
    """Adds forward_ret, the return so many calendar days after the signal's day; with dates, so many trading days.

    Signals of a day that is no trading day then drop out; the calendar has a row a day and is broadcast.
    """
    if dates is not None:
        now = dates.select(F.col("date").alias(day), (F.col("n") + days).alias("n"))
        ahead = now.join(dates.select("n", F.col("date").alias("__ahead")), "n").drop("n")
        right = ret.select("security_id", F.col("date").alias("__ahead"), F.col("ret").alias("forward_ret"))
        return signal.join(F.broadcast(ahead), day).join(right, ["security_id", "__ahead"]).drop("__ahead")
    right = ret.select("security_id", F.date_sub("date", days).alias(day), F.col("ret").alias("forward_ret"))
    return signal.join(right, ["security_id", day])


def by_regime(daily: DataFrame, series: DataFrame, value: str, high: str = "high", low: str = "low") -> DataFrame:
    """daily with regime: whether the series is above its median (rounded to 1 decimal) that day."""
    median = series.agg(F.round(F.percentile(value, F.lit(0.5)), 1).alias("median"))
    series = series.crossJoin(F.broadcast(median))  # one row
    label = F.when(F.col(value) > F.col("median"), high).otherwise(low)
    return daily.join(F.broadcast(series.select("date", label.alias("regime"))), "date")
