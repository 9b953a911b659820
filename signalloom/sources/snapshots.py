"""Snapshots: panels by year, what is derived from them, and a manifest that knows which years depend on which.

Under a snapshot's path lie ``ret``, ``risk`` and what follows from them, ``master`` and ``factors``, a folder a year each, and
the calendar ``dates``. ``states`` has the fingerprint's parts of each component and year, ``members`` the securities of each,
and ``manifest`` what these add up to. An update finds changed years by the stored states, replaces only these, derives only
the years that depend on them, and adds up anew; years that have not changed are neither read nor written. The manifest is
written last: after a crash, the same update finds the same years changed and does all of it again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators import audit, clean, joins
from signalloom.sources import tables

GIVEN = ("ret", "risk")
#: What each derived component is made of, and how.
DERIVED = {
    "master": (("ret", "risk"), lambda ret, risk: joins.build_master(ret, risk)),
    "factors": (("risk",), lambda risk: clean.factors_of(risk)),
}
COMPONENTS = (*GIVEN, *DERIVED)
STATE = "component string, year int, layout string, rows long, total decimal(38,0), mixed long, low date, high date"


def _among(year: Column, years: Iterable[int | None]) -> Column:
    """Whether a year is one of years, of which null may be one."""
    known = [y for y in years if y is not None]
    return F.coalesce(year.isin(*known), F.lit(None in years)) if known else year.isNull() & F.lit(None in years)


def component(spark: SparkSession, path: str, name: str, years: Iterable[int] | None = None) -> DataFrame:
    """A component of a snapshot, all of it or the folders of some years."""
    df = spark.read.parquet(f"{path}/{name}")
    return (df if years is None else df.where(_among(F.col("year"), years))).drop("year")


def _with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("date"))


def _states(df: DataFrame, name: str) -> list[tuple]:
    """A row a year, as STATE says."""
    found = audit.states(_with_year(df), ["year"]).select(F.lit(name).alias("component"), "*")
    return [tuple(r) for r in found.collect()]


def _key(year: int | None) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if year is None else str(year)


def _replace(df: DataFrame, path: str, name: str, years: Iterable[int] | None = None) -> None:
    """Years of a component, and their securities, become those of df; a year of which df has nothing goes.

    Without years, df is all there is, and nothing is there yet. df comes from a shuffle by security and day or from a scan, so
    its rows are written where they lie.
    """
    spark = df.sparkSession
    for folder in (f"{path}/{name}", f"{path}/members/component={name}"):
        for year in years or ():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/year={_key(year)}")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    tables.write_yearly(df, f"{path}/{name}", mode="append", dealt=True)
    written = _with_year(component(spark, path, name, years))
    members = written.select(F.lit(name).alias("component"), "year", "security_id").distinct()
    members.write.mode("append").partitionBy("component", "year").parquet(f"{path}/members")


def _add_up(spark: SparkSession, path: str, states: list[tuple]) -> DataFrame:
    """Write states and the manifest: rows, securities, days and fingerprint of each component."""
    parts = spark.createDataFrame(states, STATE).coalesce(1)  # a row for each component and year
    parts.write.mode("overwrite").parquet(f"{path}/states")
    securities = spark.read.parquet(f"{path}/members").groupBy("component").agg(F.countDistinct("security_id").alias("securities"))
    whole = audit.merged(spark.read.parquet(f"{path}/states"), ["component"]).withColumn("fingerprint", audit.digest_of())
    whole = whole.join(securities, "component")
    whole = whole.select("component", "rows", "securities", F.col("low").alias("first_day"), F.col("high").alias("last_day"), "fingerprint")
    whole.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _derive(spark: SparkSession, path: str, changed: dict[str, set[int]]) -> list[tuple]:
    """Derive the years that depend on changed ones; their states."""
    states = []
    for name, (sources, how) in DERIVED.items():
        years = set().union(*(changed.get(s, set()) for s in sources))
        if years:
            _replace(how(*(component(spark, path, s, years) for s in sources)), path, name, years)
            states += _states(component(spark, path, name, years), name)
            changed[name] = years
    return states


def build(ret: DataFrame, risk: DataFrame, dates: DataFrame, path: str) -> DataFrame:
    """Write a snapshot of normalised panels and what is derived from them under a new path; returns its manifest."""
    spark, states, changed = ret.sparkSession, [], {}
    clean.normalize_calendar(dates).write.mode("overwrite").parquet(f"{path}/dates")
    for name, df in (("ret", ret), ("risk", risk)):
        _replace(clean.normalize_panel(df), path, name)
        states += _states(component(spark, path, name), name)
        changed[name] = {s[1] for s in states if s[0] == name}
    return _add_up(spark, path, states + _derive(spark, path, changed))


def update(spark: SparkSession, path: str, **new: DataFrame) -> DataFrame:
    """Bring the given components (ret, risk) up to date: (component, year, status), a row for each year that is now there.

    status is added, changed or same for the given years, rebuilt for the derived ones, and kept for what the update does not
    speak of: years that new lacks stay as they are. new must not be read from the snapshot itself. Raises ValueError for a
    component that a snapshot is not given, and for one of other columns or types than it has.
    """
    if unknown := set(new) - set(GIVEN):
        raise ValueError(f"not given to a snapshot: {', '.join(sorted(unknown))}")
    stored = {(r[0], r[1]): tuple(r) for r in spark.read.parquet(f"{path}/states").select(*[c.split()[0] for c in STATE.split(", ")]).collect()}
    status, changed = dict.fromkeys(stored, "kept"), {}
    for name, df in new.items():
        df = clean.normalize_panel(df)
        found = {(s[0], s[1]): s for s in _states(df, name)}
        if {s[2] for k, s in stored.items() if k[0] == name} - {s[2] for s in found.values()} and found:
            raise ValueError(f"{name} has other columns or types than it had")
        status |= {k: "added" if k not in stored else "same" if stored[k] == s else "changed" for k, s in found.items()}
        years = {k[1] for k in found if status[k] in ("added", "changed")}
        if years:
            _replace(df.where(_among(F.year("date"), years)), path, name, years)
            changed[name] = years
            stored |= {k: s for k, s in found.items() if k[1] in years}
    derived = {(s[0], s[1]): s for s in _derive(spark, path, changed)}
    for name in DERIVED:
        for year in changed.get(name, ()):
            stored.pop((name, year), None)
            status.pop((name, year), None)
    stored |= derived
    status |= dict.fromkeys(derived, "rebuilt")
    if changed:
        _add_up(spark, path, list(stored.values()))
    return spark.createDataFrame([(*k, v) for k, v in status.items()], "component string, year int, status string")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(component, status): whether what is there has the fingerprint that the manifest says; reads everything."""
    now = audit.fingerprints(**{name: component(spark, path, name) for name in COMPONENTS})
    return audit.verify(now, spark.read.parquet(f"{path}/manifest"))
