"""Fingerprints of tables by content: independent of row order, by partial aggregates over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)), 256), 1, 16)


def states(df: DataFrame, keys: Sequence[str] = (), day: str = "date") -> DataFrame:
    """(keys, layout, rows, total, mixed, low, high): what a fingerprint is made of, by keys; states merge to those of unions."""
    columns = sorted(c for c in df.columns if c not in keys)
    kinds = dict(df.dtypes)
    h = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    low, high = (F.min(day), F.max(day)) if day in columns else (F.lit(None).cast("date"),) * 2
    layout = F.lit(",".join(f"{c}:{kinds[c]}" for c in columns))
    total = F.sum(h.cast("decimal(38,0)"))
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), total.alias("total"), F.bit_xor(h).alias("mixed"), low.alias("low"), high.alias("high"))
    return out.select(*keys, layout.alias("layout"), "rows", "total", "mixed", "low", "high")


def merged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of the unions of the parts that share keys; parts of different layouts do not merge."""
    total, mixed = F.sum("total").cast("decimal(38,0)"), F.bit_xor("mixed")
    return df.groupBy(*keys, "layout").agg(
        F.sum("rows").alias("rows"), total.alias("total"), mixed.alias("mixed"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def digest_of(days: bool = True) -> Column:
    """The fingerprint of a state; days says whether the table has a day."""
    return _digest(*map(F.col, ["layout", "rows", "total", "mixed", *(["low", "high"] if days else [])]))


def fingerprint(df: DataFrame, keys: Sequence[str] = (), day: str = "date") -> DataFrame:
    """(keys, fingerprint): a digest of the schema, the row count, the day range and all values."""
    found = states(df, keys, day)
    return found.select(*keys, "rows", digest_of(day in df.columns and day not in keys).alias("fingerprint"))


def fingerprints(**components: DataFrame) -> DataFrame:
    """(component, fingerprint)"""
    out = None
    for name, df in components.items():
        part = fingerprint(df).select(F.lit(name).alias("component"), "fingerprint")
        out = part if out is None else out.unionByName(part)
    return out


def snapshot_fingerprint(parts: DataFrame) -> DataFrame:
    """One row: SHA-256 of the sorted name:hash pairs joined by |, 12 digits. parts has a row a component."""
    pairs = F.array_sort(F.collect_list(F.concat_ws(":", "component", "fingerprint")))
    return parts.agg(F.substring(F.sha2(F.array_join(pairs, "|"), 256), 1, 12).alias("fingerprint"))


def verify(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(component, status): ok, changed, missing or extra."""
    was = stored.select("component", F.col("fingerprint").alias("was"))
    status = (
        F.when(F.col("fingerprint").isNull(), "missing").when(F.col("was").isNull(), "extra")
        .when(F.col("was") == F.col("fingerprint"), "ok").otherwise("changed")
    )
    return now.join(was, "component", "full_outer").select("component", status.alias("status"))


def signal_hash(signal: DataFrame) -> DataFrame:
    """One row: a 12-digit digest of a signal, the same for any order of its rows."""
    return fingerprint(signal, day="date_sig").select(F.substring("fingerprint", 1, 12).alias("signal_hash"))
