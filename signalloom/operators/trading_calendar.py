"""The signal contract, and its alignment to trading days.

A calendar has a row a day (date, n), so it is small whatever the panel's size and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ["security_id", "date_sig", "date_avail", "signal"]


def validate_counts(signal: DataFrame) -> DataFrame:
    """One row: rows, duplicate_rows, infinite, missing, lookahead."""
    s = F.col("signal").cast("double")
    per_key = signal.groupBy("security_id", "date_sig").agg(
        F.count("*").alias("k"),
        F.sum((F.abs(s) == float("inf")).cast("long")).alias("infinite"),
        F.sum((F.isnan(s) | s.isNull()).cast("long")).alias("missing"),
        F.sum((F.col("date_avail") < F.col("date_sig")).cast("long")).alias("lookahead"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_key.agg(
        zero("k").alias("rows"),
        zero(F.when(F.col("k") > 1, F.col("k"))).alias("duplicate_rows"),
        *(zero(c).alias(c) for c in ("infinite", "missing", "lookahead")),
    )


def validate(signal: DataFrame) -> tuple[bool, list[str]]:
    """(whether the signal keeps the contract, what is against it)."""
    kinds = dict(signal.dtypes)
    errors = [f"no column {c}" for c in REQUIRED if c not in kinds]
    if errors:
        return False, errors
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    if kinds["signal"] not in numeric and not kinds["signal"].startswith("decimal"):
        errors.append(f"signal is {kinds['signal']}")
    errors += [f"{c} is {kinds[c]}" for c in ("date_sig", "date_avail") if kinds[c] not in ("date", "timestamp", "timestamp_ntz")]
    if errors:
        return False, errors
    found = validate_counts(signal).first()
    if not found["rows"]:
        errors.append("no rows")
    for name in ("duplicate_rows", "infinite", "missing", "lookahead"):
        if found[name]:
            errors.append(f"{name}: {found[name]}")
    return not errors, errors


def known(signal: DataFrame) -> DataFrame:
    """The rows with a signal: neither null nor NaN, which would rank above all others."""
    return signal.where(F.col("signal").isNotNull() & ~F.isnan(F.col("signal").cast("double")))


def _on_day(df: DataFrame, dates: DataFrame, day: str, n: str) -> DataFrame:
    return df.join(F.broadcast(dates.select(F.col("date").alias(day), F.col("n").alias(n))), day)


def _day_of(df: DataFrame, dates: DataFrame, n: str, day: str, how: str = "inner") -> DataFrame:
    return df.join(F.broadcast(dates.select(F.col("n").alias(n), F.col("date").alias(day))), n, how)


def infer_available(signal: DataFrame, dates: DataFrame) -> DataFrame:
    """date_avail: the trading day after date_sig; signals on other days drop out."""
    df = _on_day(signal, dates, "date_sig", "__n").withColumn("__n", F.col("__n") + 1)
    return _day_of(df, dates, "__n", "date_avail").drop("__n")


def infer_signal_day(signal: DataFrame, dates: DataFrame) -> DataFrame:
    """date_sig: the trading day before date_avail."""
    df = _on_day(signal, dates, "date_avail", "__n").withColumn("__n", F.col("__n") - 1)
    return _day_of(df, dates, "__n", "date_sig").drop("__n")


def align(signal: DataFrame, dates: DataFrame, hour: int | Column = 8, lags: Sequence[int] = (0,)) -> DataFrame:
    """Adds lag, date_openret and date_ret, a row for each lag.

    What is available by 8 trades at the day's open, by 15 at its close. Signals available on no trading day drop out.
    """
    hour = F.lit(hour) if isinstance(hour, int) else hour
    df = signal.withColumn("lag", F.explode(F.array(*(F.lit(int(x)) for x in lags))))
    df = _on_day(df.withColumn("__hour", hour), dates, "date_avail", "__n")
    df = df.withColumns(
        {
            "__open": F.col("__n") + F.when(F.col("__hour") <= 8, 0).otherwise(1) + F.col("lag"),
            "__ret": F.col("__n") + F.when(F.col("__hour") <= 15, 1).otherwise(2) + F.col("lag"),
        }
    )
    df = _day_of(_day_of(df, dates, "__open", "date_openret"), dates, "__ret", "date_ret")
    return df.drop("__hour", "__n", "__open", "__ret")


def forward_fill(df: DataFrame, column: str, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def align_calendar_days(signal: DataFrame, dates: DataFrame, hour: int | Column = 8) -> DataFrame:
    """As align, but a signal available on another day takes the day number of its security's row before."""
    hour = F.lit(hour) if isinstance(hour, int) else hour
    days = F.broadcast(dates.select(F.col("date").alias("date_avail"), F.col("n").alias("__n")))
    df = signal.join(days, "date_avail", "left").withColumn("__on", F.col("__n").isNotNull())
    df = forward_fill(df, "__n", ["security_id"], "date_avail").withColumn("__hour", hour)
    early, late = F.col("__on") & (F.col("__hour") <= 8), ~F.col("__on") | (F.col("__hour") > 15)
    df = df.withColumns(
        {
            "__open": F.col("__n") + F.when(early, 0).otherwise(1),
            "__ret": F.col("__n") + F.when(late, 2).otherwise(1),
        }
    )
    df = _day_of(_day_of(df, dates, "__open", "date_openret"), dates, "__ret", "date_ret")
    return df.drop("__on", "__hour", "__n", "__open", "__ret")


def prepare(signal: DataFrame, dates: DataFrame, lags: Sequence[int] = (0,), hour: int | Column = 8, check: bool = True) -> DataFrame:
    """Validate, drop missing signals, align. Raises ValueError on a broken contract."""
    if "signal" in signal.columns:
        signal = known(signal)
    if check:
        good, errors = validate(signal)
        if not good:
            raise ValueError("; ".join(errors))
    signal = signal.withColumn("security_id", F.col("security_id").cast("int"))
    return align(signal, dates, hour, lags)
