"""Cleaning, projections and filters of signal tables and panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RISK_FACTORS = ["size", "value", "growth", "leverage", "volatility", "momentum"]
ALL_FACTORS = [*RISK_FACTORS, "yield"]


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last by order, nulls before all values."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def normalize_panel(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Unique (security_id int, date): NaN is null, the last row of a key by order stays."""
    floats = {c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    df = df.withColumns(floats) if floats else df
    df = df.withColumns({"security_id": F.col("security_id").cast("int"), "date": F.to_date("date")})
    return keep_last(df, ["security_id", "date"], order or [c for c in df.columns if c not in ("security_id", "date")])


def normalize_calendar(df: DataFrame) -> DataFrame:
    df = df.withColumns({"date": F.to_date("date"), "n": F.col("n").cast("int")})
    return keep_last(df, ["date"], ["n"])


def last_complete(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, and none where that row has a null."""
    return keep_last(df, keys, order).dropna()


def between(df: DataFrame, low: str, high: str, column: str = "date") -> DataFrame:
    """Inclusive date bounds; a yearly partitioned table is pruned by year as well."""
    df = df.where(F.col(column).between(F.lit(low).cast("date"), F.lit(high).cast("date")))
    return df.where(F.col("year").between(int(low[:4]), int(high[:4]))) if "year" in df.columns else df


def in_universe(risk: DataFrame) -> DataFrame:
    return risk.where(F.col("universe_flag") == 1)


def plausible_open_returns(df: DataFrame, least: float = -0.95) -> DataFrame:
    return df.where(F.col("ret") > least)


def in_sample(df: DataFrame, dates: DataFrame, flag: str) -> DataFrame:
    """Rows on days that the calendar flags; the calendar has a row a day and is broadcast."""
    return df.join(F.broadcast(dates.where(F.col(flag) == 1).select("date")), "date", "left_semi")


def factors_of(risk: DataFrame, wanted: Sequence[str] = RISK_FACTORS) -> DataFrame:
    return risk.select("security_id", "date", *(c for c in wanted if c in risk.columns))


def year_groups(df: DataFrame, group: str = "grp") -> DataFrame:
    return df.where(F.expr(f"try_cast({group} AS int)").between(2000, 2030))
