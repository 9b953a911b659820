"""Signals that others are compared with; a registry of functions from a panel to a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.operators.performance import compound_return


def _signal(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(
        F.lit(name).alias("signal_name"),
        "security_id",
        F.col("date").alias("date_sig"),
        F.date_add("date", 1).alias("date_avail"),
        F.col(value).alias("signal"),
    )


def reversal(ret: DataFrame, risk: DataFrame | None = None, rows: int = 5) -> DataFrame:
    df = compound_return(ret, rows, "__r").withColumn("__r", -F.col("__r"))
    return _signal(df, f"reversal_{rows}d", "__r")


def momentum(ret: DataFrame, risk: DataFrame | None = None, rows: int = 252, skipped: int = 21) -> DataFrame:
    df = compound_return(compound_return(ret, rows, "__long"), skipped, "__short")
    return _signal(df.withColumn("__m", F.col("__long") - F.col("__short")), "momentum", "__m")


def value(ret: DataFrame | None, risk: DataFrame) -> DataFrame:
    return _signal(risk, "value", "value")


REGISTRY = {"reversal_5d": reversal, "value": value}


def all_baselines(ret: DataFrame, risk: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """All registered baselines; those found in stored are read from there."""
    have = set()
    if stored is not None:
        have = {r[0] for r in stored.select("signal_name").distinct().collect()}  # a row a baseline
    parts = [f(ret, risk) for name, f in REGISTRY.items() if name not in have]
    if have:
        parts.append(stored.where(F.col("signal_name").isin(*REGISTRY)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
