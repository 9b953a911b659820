"""Ranks, positions and weights of daily cross-sections.

``keys`` names the columns that tell cross-sections apart, the day among them (signal, configuration, slice, group,
date), so any number of configurations runs in one plan. A cross-section holds one row a security, so no window
partition outgrows the universe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from signalloom.functions.stats import average_rank, max_rank, ratio, size_of
from signalloom.operators.joins import asof_backward

CAP_LABELS = {1: "LargeCap", 2: "MediumCap", 3: "SmallCap"}


def cap_label(cap: str | Column) -> Column:
    cap = F.col(cap) if isinstance(cap, str) else cap
    return F.when(cap == 1, "LargeCap").when(cap == 2, "MediumCap").when(cap.isNotNull(), "SmallCap")


def percentile(df: DataFrame, keys: Sequence[str], value: str = "signal", stretch: bool = False) -> DataFrame:
    """Adds p: the percent bucket of value; stretched, largest ranks are spread over the whole range."""
    if not stretch:
        return df.withColumn("p", F.ceil(average_rank(value, keys) * 100 / size_of(keys)))
    df = df.withColumn("p", F.ceil(max_rank(value, keys) * 100 / size_of(keys)))
    w = Window.partitionBy(*keys)
    low, high = F.min("p").over(w), F.max("p").over(w)
    return df.withColumn("p", (F.col("p") - low + 1) * 100 / (high - low + 1))


def position(p: str = "p", low: int = 20, high: int = 80) -> Column:
    return F.when(F.col(p) <= low, -1).when(F.col(p) > high, 1).otherwise(0)


def double_sort(
    df: DataFrame, second: DataFrame, value: str, keys: Sequence[str], groups: int, low: int, high: int, stretch: bool = False
) -> DataFrame:
    """Positions within buckets of a second variable, attached as of the signal's day without tolerance."""
    df = asof_backward(df, second, ["security_id"], "date_sig", "date_sig", [value]).where(F.col(value).isNotNull())
    df = df.withColumn("bucket", F.ceil(average_rank(value, keys) * groups / size_of(keys)))
    return percentile(df, [*keys, "bucket"], stretch=stretch).withColumn("position", position("p", low, high))


def position_from_fractile(df: DataFrame, value: str = "signal") -> DataFrame:
    """Already bucketed: the table's smallest bucket is short, its largest long."""
    ends = df.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    side = F.when(F.col(value) == F.col("__low"), -1).when(F.col(value) == F.col("__high"), 1).otherwise(0)
    return df.crossJoin(F.broadcast(ends)).withColumn("position", side).drop("__low", "__high")  # one row


def fractiles(df: DataFrame, keys: Sequence[str], n: int, value: str = "signal") -> DataFrame:
    return df.withColumn("fractile", F.ceil(average_rank(value, keys) * n / size_of(keys)))


def winsorized(column: str, keys: Sequence[str], upper: float = 95.0) -> Column:
    """Clipped to the exact quantiles upper and 100 - upper of its cross-section, linearly interpolated."""
    w, q = Window.partitionBy(*keys), upper / 100
    low, high = F.percentile(column, F.lit(1 - q)).over(w), F.percentile(column, F.lit(q)).over(w)
    return F.least(F.greatest(F.col(column), low), high)


def winsorize(df: DataFrame, column: str, keys: Sequence[str], upper: float = 95.0, accuracy: int | None = None) -> DataFrame:
    """df with column clipped to its quantiles within keys.

    Exact and interpolated without an accuracy: a group's distinct values are then in memory at once. With one, the quantiles
    are values of the group whose rank is off by its size / accuracy at most; the sketches merge before the shuffle and are as
    large as the accuracy, however large a group is. Groups whose column is null throughout keep their nulls.
    """
    if accuracy is None:
        return df.withColumn(column, winsorized(column, keys, upper))
    q = F.array(F.lit((100 - upper) / 100), F.lit(upper / 100))
    ends = df.groupBy(*keys).agg(F.percentile_approx(column, q, F.lit(accuracy)).alias("__ends"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = df.alias("a").join(ends.alias("b"), same).select("a.*", F.col("b.__ends").alias("__ends"))
    clipped = F.least(F.greatest(F.col(column), F.get("__ends", F.lit(0))), F.get("__ends", F.lit(1)))
    return both.withColumn(column, F.when(F.col(column).isNotNull(), clipped)).drop("__ends")


def weigh(df: DataFrame, keys: Sequence[str], how: str = "equal", upper: float = 95.0) -> DataFrame:
    """Adds weight to rows with a position; each side of a cross-section sums to 1 or -1.

    how: equal, value (winsorised mcap), volume (winsorised adv), given (signal is the weight, its sign the position)
    or renormalize (signal is a weight, shared out within each side).
    """
    side = Window.partitionBy(*keys, "position")
    if how == "given":
        return df.withColumns({"weight": F.col("signal"), "position": F.when(F.col("signal") > 0, 1).otherwise(-1)})
    df = df.where(F.col("position").isin(-1, 1))
    if how == "equal":
        # both sides are counted in windows of whole cross-sections, which are in order already
        whole = Window.partitionBy(*keys)
        names = [F.count(F.when(F.col("position") == x, 1)).over(whole) for x in (1, -1)]
        return df.withColumn("weight", F.col("position") / F.when(F.col("position") == 1, names[0]).otherwise(names[1]))
    column = {"value": "mcap", "volume": "adv", "renormalize": "signal"}[how]
    df = df.withColumn("__size", F.col("signal") if how == "renormalize" else winsorized(column, [*keys, "position"], upper))
    share = ratio("__size", F.sum("__size").over(side))
    return df.withColumn("weight", share * F.col("position")).drop("__size")


def long_only(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.greatest("weight", F.lit(0.0)))


def side_counts(w: WindowSpec | None = None) -> list[Column]:
    """Of an aggregate, or of a window."""
    count = lambda c: F.count(F.when(c, 1)) if w is None else F.count(F.when(c, 1)).over(w)
    long, short = count(F.col("weight") > 0), count(F.col("weight") < 0)
    return [long.alias("n_long"), short.alias("n_short"), F.least(long, short).alias("n_min")]


def names_per_side(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    return weights.groupBy(*keys).agg(*side_counts())


def enough_names(names: DataFrame, mincos: int, only_long: bool = False) -> DataFrame:
    return names.where(F.col("n_long" if only_long else "n_min") >= mincos)


def groups(df: DataFrame, byvars: Sequence[str], taken: Sequence[str] = ()) -> dict[str, Column | None]:
    """The group of a row in each slice, null if it is in none.

    byvars: overall, year (of date), cap, capyr or any column. The names of factors, mcap and adv are not allowed.
    """
    bad = sorted({"mcap", "adv", *taken} & set(byvars))
    if bad:
        raise ValueError(f"not a group variable: {', '.join(bad)}")
    own = {
        "overall": F.lit("overall"),
        "year": F.year("date").cast("string"),
        "cap": cap_label("cap") if "cap" in df.columns else None,
        "capyr": F.concat_ws("_", cap_label("cap"), F.year("date").cast("string")) if "cap" in df.columns else None,
    }
    if own["capyr"] is not None:
        own["capyr"] = F.when(F.col("cap").isNotNull(), own["capyr"])
    return {b: own.get(b, F.col(b).cast("string") if b not in own else None) for b in byvars}


def slices(df: DataFrame, byvars: Sequence[str], taken: Sequence[str] = ()) -> DataFrame:
    """A row for each slice that a row belongs to: (byvar, grp), see groups. Rows with a null group leave that slice only."""
    pairs = [F.struct(F.lit(b).alias("byvar"), grp.alias("grp")) for b, grp in groups(df, byvars, taken).items()]
    return df.withColumn("__slice", F.explode(F.array(*pairs))).select("*", "__slice.*").drop("__slice").where("grp is not null")


#: Slices that split the groups of another one by date, so that a day's cross-section is the same in both.
SPLIT_BY_DATE = {"year": "overall", "capyr": "cap"}


def split_by_date(df: DataFrame, byvars: Sequence[str]) -> DataFrame:
    """Rows of undivided slices (byvar, grp, date) as those of byvars: a row of a slice belongs to a part of each that splits it."""
    if not set(byvars) & set(SPLIT_BY_DATE):
        return df
    year = F.year("date").cast("string")
    grp = {"year": year, "capyr": F.concat_ws("_", "grp", year)}
    each = (
        F.struct(F.lit(SPLIT_BY_DATE.get(b, b)).alias("of"), F.lit(b).alias("byvar"), grp.get(b, F.col("grp")).alias("grp")) for b in byvars
    )
    own = F.filter(F.array(*each), lambda x: x["of"] == F.col("byvar"))
    rest = [c for c in df.columns if c not in ("byvar", "grp")]
    return df.withColumn("__slice", F.explode(own)).select(*rest, "__slice.byvar", "__slice.grp")
