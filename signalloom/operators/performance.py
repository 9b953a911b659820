"""Daily results and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.stats import annual, annual_deviation, average_rank, correlation, ratio, share_positive, size_of
from signalloom.operators.cost import running
from signalloom.operators.joins import panel_days


#: Sums of weighted returns are rounded to so many decimals: what cancels out is 0 in whatever order it is summed.
DECIMALS = 12


def weighted_sums(columns: Sequence[str] = ("ret", "resret")) -> list[Column]:
    return [F.round(F.sum(F.col("weight") * F.col(c)), DECIMALS).alias(c) for c in columns]


def daily_portfolio(weights: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("ret", "resret")) -> DataFrame:
    """(keys, sums of weight times each column)"""
    return weights.groupBy(*keys).agg(*weighted_sums(columns))


def date_bounds(names: DataFrame, keys: Sequence[str]) -> DataFrame:
    return names.groupBy(*keys).agg(F.min("date").alias("low"), F.max("date").alias("high"))


def on_panel(bounds: DataFrame, dates: DataFrame, keys: Sequence[str], *parts: DataFrame) -> DataFrame:
    """All calendar days of each group with the parts' columns, 0 where a part has no row."""
    out = panel_days(bounds, dates)
    for part in parts:
        on = [*keys, "n"] if "n" in part.columns else [*keys, "date"]
        new = [c for c in part.columns if c not in on and c not in ("date", "n")]
        out = out.join(part.select(*on, *new), on, "left").fillna(0, new)
    return out


def net_returns(daily: DataFrame) -> DataFrame:
    tc = F.coalesce("tc", F.lit(0.0))
    return daily.withColumns({f"{c}_net": F.round(F.col(c) - tc, DECIMALS) for c in ("ret", "resret")})


def cumulate(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive cumulative returns and the distance from their running maximum; a group has a row a day."""
    w = running(keys)
    daily = daily.withColumns({"cumret": F.sum("ret").over(w), "cumretnet": F.sum("ret_net").over(w)})
    return daily.withColumn("drawdown", F.col("cumret") - F.max("cumret").over(w))


def return_stats(column: str, name: str) -> list:
    mean, dev = annual(column), annual_deviation(column)
    return [
        mean.alias(f"{name}_ann"),
        dev.alias(f"{name}_std"),
        ratio(mean, dev).alias(f"{name}_sharpe"),
        share_positive(column).alias(f"{name}_pos"),
    ]


def summary(daily: DataFrame, keys: Sequence[str], factors: Sequence[str] = (), full: bool = True) -> DataFrame:
    """One row a group: days with a return, annualised statistics, drawdown, turnover / 4, names, factor exposures."""
    stats = [*return_stats("ret", "ret"), *(return_stats("resret", "resret") if full else []), *return_stats("ret_net", "retnet")]
    return daily.groupBy(*keys).agg(
        F.count(F.when(F.col("ret") != 0, 1)).alias("num_date"),
        *stats,
        F.min("drawdown").alias("maxdd"),
        (F.avg("turnover") / 4).alias("turnover"),
        F.avg("n_long").alias("numcos_l"),
        F.avg("n_short").alias("numcos_s"),
        *(F.avg(f).alias(f) for f in factors),
    )


def fractile_profile(
    df: DataFrame, keys: Sequence[str], factors: Sequence[str] = (), mincos: int = 3, how: str = "equal"
) -> DataFrame:
    """One row a fractile: mean annualised return, factor exposures and names over days with enough names at both ends.

    keys tell days apart; the last is the day. df has fractile. Weights within a fractile: equal, or by mcap or adv.
    """
    w = Window.partitionBy(*keys, "fractile")
    size = {"equal": F.lit(1.0), "value": F.col("mcap"), "volume": F.col("adv")}[how]
    df = df.withColumn("weight", ratio(size, F.sum(size).over(w)))
    daily = df.groupBy(*keys, "fractile").agg(
        F.count("*").alias("numcos"), *(F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("ret", "resret", *factors))
    )
    day, ends = Window.partitionBy(*keys), F.col("fractile")
    low, high = F.lit(1), F.col("__top")
    # over a row a day and fractile; an aggregate beside it would rank all rows a second time
    daily = daily.withColumn("__top", F.max("fractile").over(Window.partitionBy(F.lit(1))))
    count_at = lambda f: F.coalesce(F.max(F.when(ends == f, F.col("numcos"))).over(day), F.lit(0))
    daily = daily.withColumn("__least", F.least(count_at(low), count_at(high))).where(F.col("__least") >= mincos)
    return daily.groupBy(*keys[:-1], "fractile").agg(
        (F.avg("ret") * 252).alias("ret"),
        (F.avg("resret") * 252).alias("resret"),
        F.avg("numcos").alias("numcos"),
        *(F.avg(f).alias(f) for f in factors),
    )


def cap_columns(daily: DataFrame) -> DataFrame:
    """One column of cumulative return for each cap tier."""
    names = ["LargeCap", "MediumCap", "SmallCap"]
    return daily.groupBy("date").pivot("grp", names).agg(F.first("cumret"))


def coverage(signal: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: mean securities a day, their share of the universe in percent, days, distinct securities."""
    day = signal.groupBy("date_sig").agg(F.countDistinct("security_id").alias("k"))
    out = day.agg(F.avg("k").alias("per_day"), F.count("*").alias("days"))
    total = signal.agg(F.countDistinct("security_id").alias("securities"))
    everyone = universe.agg(F.countDistinct("security_id").alias("universe"))
    out = out.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(everyone))  # one row each
    return out.select("per_day", (ratio("per_day", "universe") * 100).alias("percent"), "days", "securities")


def coverage_series(signal: DataFrame) -> DataFrame:
    out = signal.groupBy("date_sig").agg(F.count("*").alias("rows"), F.countDistinct("security_id").alias("securities"))
    return out.crossJoin(F.broadcast(out.agg(F.avg("securities").alias("average"))))  # one row


def information_coefficients(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Rank correlation of x and y within keys, for groups with enough pairs."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    df = df.withColumns({"__x": average_rank(x, keys), "__y": average_rank(y, keys), "__n": size_of(keys)})
    return df.where(F.col("__n") >= least).groupBy(*keys).agg(correlation("__x", "__y").alias("ic"), F.count("*").alias("pairs"))


def several_coefficients(df: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str], least: int = 10) -> DataFrame:
    """(keys, a rank correlation of x with each of ys, named as it): as information_coefficients, in one shuffle and one sort for
    each column; of groups that have enough pairs with each.

    The ranks of x are those among the rows that have the other column: counts of such rows up to x, half of its ties taken off.
    """
    df, order = df.where(F.col(x).isNotNull()), Window.partitionBy(*keys).orderBy(x)
    new = {}
    for y in ys:
        here = F.when(F.col(y).isNotNull(), 1)
        new[f"__x_{y}"] = F.count(here).over(order) - (F.count(here).over(order.rangeBetween(0, 0)) - 1) / 2
    new |= {f"__y_{y}": average_rank(y, keys) for y in ys}  # nulls come first and shift the others alike
    df = df.withColumns(new)
    both = [F.when(F.col(y).isNotNull(), F.col(f"__x_{y}")) for y in ys]
    out = df.groupBy(*keys).agg(
        F.least(*(F.count(y) for y in ys), F.lit(2**62)).alias("__least"),
        *(correlation(r, f"__y_{y}").alias(y) for r, y in zip(both, ys, strict=True)),
    )
    return out.where(F.col("__least") >= least).drop("__least")


def ic_stats(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """mean, std (population), t, hit_rate in percent, ir, n; t and ir are 0 where the deviation is."""
    mean, dev, n = F.avg("ic"), F.stddev_pop("ic"), F.count("ic")
    safe = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return daily.groupBy(*keys).agg(
        mean.alias("mean"),
        dev.alias("std"),
        safe(mean, dev / F.sqrt(n)).alias("t"),
        (F.avg(F.when(F.col("ic") > 0, 1.0).when(F.col("ic").isNotNull(), 0.0)) * 100).alias("hit_rate"),
        safe(mean, dev).alias("ir"),
        n.alias("n"),
    )


def moving_average(df: DataFrame, keys: Sequence[str], column: str, rows: int = 21, order: str = "date") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn(f"{column}_ma", F.avg(column).over(w))


def pct_change(df: DataFrame, keys: Sequence[str], column: str, name: str, order: str = "date") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, ratio(column, F.lag(column).over(w)) - 1)


def compound_return(df: DataFrame, rows: int, name: str, column: str = "ret") -> DataFrame:
    """Compound return of a security's last rows, null until there are so many without a null."""
    w = Window.partitionBy("security_id").orderBy("date").rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.when(F.count(column).over(w) == rows, F.product(1 + F.col(column)).over(w) - 1))
