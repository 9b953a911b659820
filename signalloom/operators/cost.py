"""Turnover and transaction cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.stats import ratio


def weight_changes(
    weights: DataFrame, keys: Sequence[str], known: Sequence[str] = (), tasks: int | None = None, begin: DataFrame | None = None
) -> DataFrame:
    """(security_id, keys, n, change, held, known): absolute weight changes over the union of two periods' holdings.

    One shuffle brings a security's holdings together; each is compared with the one of the period before, and is taken off
    in the next period if it is not there. A group's first period has no changes. Each name in known is looked up in the columns
    now_<name> for the holding's period, then_<name> for the next. Groups are numbered, so that what is shuffled and sorted is
    numbers; tasks, if known, is how many tasks the holdings are dealt to, and begin(keys, first) the groups and their first
    periods, which are else looked for in all holdings.
    """
    if begin is None:
        begin = weights.groupBy(*keys).agg(F.min("n").alias("first"))
    groups = begin.select(*keys, F.col("first").alias("__first"))
    groups = groups.withColumn("__grp", F.row_number().over(Window.orderBy(*keys)))  # a row a group
    df = weights.join(F.broadcast(groups.select(*keys, "__grp")), list(keys))
    same = [F.col("security_id"), F.col("__grp")]
    df = df.select(*same, "n", "weight", *(f"{when}_{c}" for c in known for when in ("now", "then")))
    df = df.repartition(*same) if tasks is None else df.repartition(tasks, *same)
    order = Window.partitionBy(*same).orderBy("n")
    whole = F.sum("weight").over(order.rangeBetween(0, 0))
    df = df.withColumns({"weight": whole, "__next": F.lead("n").over(order)}).where("__next is null or __next <> n")  # one row a period
    df = df.withColumns({"__n": F.lag("n").over(order), "__w": F.lag("weight").over(order)})
    before = F.when(F.col("__n") == F.col("n") - 1, F.col("__w")).otherwise(0.0)
    row = lambda n, change, held, when: F.struct(
        n.alias("n"), change.alias("change"), F.lit(held).alias("held"), *(F.col(f"{when}_{c}").alias(c) for c in known)
    )
    now = row(F.col("n"), F.abs(F.col("weight") - before), 1, "now")
    gone = F.when(F.col("__next").isNull() | (F.col("__next") > F.col("n") + 1), row(F.col("n") + 1, F.abs("weight"), 0, "then"))
    moves = df.select(*same, F.explode(F.array_compact(F.array(now, gone))).alias("__m")).select(*same, "__m.*")
    moves = moves.join(F.broadcast(groups), "__grp")
    change = F.when(F.col("n") > F.col("__first"), F.col("change")).otherwise(0.0).alias("change")
    return moves.select("security_id", *keys, "n", change, "held", *known)


def block_moves(weights: DataFrame, keys: Sequence[str], known: Sequence[str], columns: Sequence[str], days: int) -> DataFrame:
    """(keys, n, held, weight, columns, change, known) of weights in blocks of so many periods, each with a copy of the period before.

    keys have __block, by which rows are dealt already, so nothing is shuffled. A holding is a row with its weight and its
    columns, and with its change if it is its security's only or last row of the period (held = 1); what is given up in the next
    period is a row of that one, without a weight (held = 0). Changes in a group's first period are those from nothing.
    """
    same = ["security_id", *keys]
    order = Window.partitionBy(*same).orderBy("n")
    df = weights.select(*same, "n", "weight", *columns, *(f"{when}_{c}" for c in known for when in ("now", "then")))
    df = df.withColumns({"__next": F.lead("n").over(order), "__w": F.sum("weight").over(order.rangeBetween(0, 0))})
    # a period's rows, should a security have several, have one sum, and those of the period before another
    df = df.withColumn("__before", F.coalesce(F.first("__w").over(order.rangeBetween(-1, -1)), F.lit(0.0)))
    last = F.col("__next").isNull() | (F.col("__next") > F.col("n"))
    none = F.lit(None).cast("double")
    row = lambda n, held, weight, own, change, when: F.struct(
        n.alias("n"), held.alias("held"), weight.alias("weight"), *(own(c).alias(c) for c in columns), change.alias("change"),
        *(F.col(f"{when}_{c}").alias(c) for c in known),
    )
    own = lambda n: F.floor(n / days) == F.col("__block")
    change = F.when(last, F.abs(F.col("__w") - F.col("__before")))
    now = F.when(own(F.col("n")), row(F.col("n"), F.lit(1), F.col("weight"), F.col, change, "now"))
    after = F.col("n") + 1
    left = last & (F.col("__next").isNull() | (F.col("__next") > after)) & own(after)
    gone = F.when(left, row(after, F.lit(0), none, lambda c: none, F.abs("__w"), "then"))
    return df.select(*keys, F.explode(F.array_compact(F.array(now, gone))).alias("__m")).select(*keys, "__m.*")


def turnover(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, turnover) of the periods that have holdings."""
    out = changes.groupBy(*keys, "n").agg(F.sum("change").alias("turnover"), F.max("held").alias("held"))
    return out.where("held = 1").drop("held")


def naive_cost(cap: str | Column = "cap", large: float = 2.0, medium: float = 5.0, small: float = 10.0) -> Column:
    """Basis points by cap tier as a rate; an unknown tier is small."""
    cap = F.col(cap) if isinstance(cap, str) else cap
    return F.when(cap == 1, large).when(cap == 2, medium).otherwise(small) / 10000


def power_law_cost(beta: float = 0.35, alpha: float = 0.4, gmv: float = 10.0, change: str = "change") -> Column:
    size = ratio(F.lit(gmv * 1e6) * F.col(change), "adv")
    return ratio(beta * F.col("vol") * F.pow(size, F.lit(alpha)), "close_adj")


def power_law_unit(beta: float = 0.35, alpha: float = 0.4, gmv: float = 10.0, vol: str = "vol", adv: str = "adv", close: str = "close_adj") -> Column:
    """What power_law_cost times a change is for a change of 1; it goes by the change to the power of 1 + alpha."""
    return ratio(beta * F.col(vol) * F.pow(ratio(F.lit(gmv * 1e6), adv), F.lit(alpha)), close)


def daily_cost(changes: DataFrame, rate: Column, keys: Sequence[str]) -> DataFrame:
    """(keys, n, tc): cost of all changes, those of periods without holdings too."""
    return changes.groupBy(*keys, "n").agg(F.sum(rate * F.col("change")).alias("tc"))


def daily_trades(changes: DataFrame, rate: Column, keys: Sequence[str]) -> DataFrame:
    """(keys, n, turnover, tc) in one aggregate; turnover is null in periods without holdings, which have costs all the same."""
    out = changes.groupBy(*keys, "n").agg(
        F.max("held").alias("held"), F.sum("change").alias("turnover"), F.sum(rate * F.col("change")).alias("tc")
    )
    return out.withColumn("turnover", F.when(F.col("held") == 1, F.col("turnover"))).drop("held")


def running(keys: Sequence[str], order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
