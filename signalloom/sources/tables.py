"""Sources and sinks: signal files, yearly partitioned panels, snapshots and run tables, all Parquet datasets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.operators import audit, clean

SIGNAL_SCHEMA = "security_id int, date_sig date, date_avail date, signal double"


def _signal_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a CSV with a header: raw, the columns as text by the names in SIGNAL_SCHEMA, and value, what they say.

    Columns are found by the header's names, wherever they stand; others are ignored. A folder's files must have one header.
    """
    lines = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = {c.strip().lstrip("\ufeff"): c for c in lines.columns}
    wanted = [c.split() for c in SIGNAL_SCHEMA.split(", ")]
    if missing := [name for name, _ in wanted if name not in named]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")

    def parsed(name: str, kind: str) -> Column:
        text = F.col(f"`{named[name]}`")
        if kind != "int":
            return text.try_cast(kind)
        number = text.try_cast("double")  # 12.0 is 12, as a column of whole numbers with gaps is often written
        return F.when(number == F.floor(number), number.try_cast(kind))

    raw = F.struct(*(F.col(f"`{named[n]}`").alias(n) for n, _ in wanted)).alias("raw")
    return lines.select(raw, F.struct(*(parsed(*c).alias(c[0]) for c in wanted)).alias("value"))


def _unread(lines: DataFrame) -> Column:
    """The names of the columns whose text says nothing; an empty signal is a missing one, not a fault."""
    names = lines.schema["raw"].dataType.names
    bad = (F.when(F.col(f"value.{n}").isNull() & (F.col(f"raw.{n}").isNotNull() | F.lit(n != "signal")), F.lit(n)) for n in names)
    return F.concat_ws(",", *bad)


def scan_signal(spark: SparkSession, path: str, bad_lines: str = "fail") -> DataFrame:
    """A signal file: CSV with a header, or Parquet, by its name.

    A CSV's columns are found by name and read as in SIGNAL_SCHEMA. A line with a key or date that cannot be read, or with a
    signal that is no number, ends the job that reads it; with bad_lines='drop' it is left out, see signal_rejects.
    """
    if path.endswith((".csv", ".csv.gz")):
        lines = _signal_lines(spark, path)
        unread = _unread(lines)
        if bad_lines == "drop":
            return lines.where(unread == "").select("value.*")
        message = F.concat(F.lit("cannot read "), unread, F.lit(" of the line "), F.to_json("raw"))
        first, *rest = lines.schema["value"].dataType.names
        checked = F.when(unread == "", F.col(f"value.{first}")).otherwise(F.raise_error(message).cast("int"))
        return lines.select(checked.alias(first), *(f"value.{n}" for n in rest))
    df = spark.read.parquet(path)
    return df.withColumns({"date_sig": F.to_date("date_sig"), "date_avail": F.to_date("date_avail")})


def signal_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(columns, security_id, date_sig, date_avail, signal): the lines of a CSV that cannot be read, as text, and why."""
    lines = _signal_lines(spark, path)
    return lines.select(_unread(lines).alias("columns"), "raw.*").where("columns <> ''")


def scan_universe(spark: SparkSession, path: str, low: str, high: str) -> DataFrame:
    """Distinct (security_id, date) of the investable rows of a descriptor table; three columns are read."""
    df = spark.read.parquet(path).select("security_id", F.to_date("as_of_date").alias("date"), "universe_flag")
    return clean.between(clean.in_universe(df), low, high).select("security_id", "date").distinct()


def by_year(df: DataFrame, column: str = "date", dealt: bool = False) -> DataFrame:
    """df with its year, dealt for a folder a year: rows of a year are spread over as many tasks as it needs, not gathered in one.

    Rows that are dealt to tasks of a fitting size already stay where they are; a task then writes a file for each year it has.
    """
    df = df.withColumn("year", F.year(column))
    return df if dealt else df.hint("rebalance", "year")


def write_yearly(df: DataFrame, path: str, column: str = "date", mode: str = "overwrite", dealt: bool = False) -> None:
    """A folder a year; dealt is that of by_year."""
    by_year(df, column, dealt).write.mode(mode).partitionBy("year").parquet(path)


def read_yearly(spark: SparkSession, path: str, years: Sequence[int] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("year").isin(*years)) if years else df


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str] = ("security_id", "date"), buckets: int = 64) -> DataFrame:
    """Write df as an external table under path, dealt by keys into so many buckets and sorted in each; the table.

    Tables of the same keys and number of buckets are joined by these keys where they lie: no side is shuffled. A table
    that is not bucketed is dealt alike and meets them, so only that side is shuffled.
    """
    dealt = df.repartition(buckets, *keys)  # a file a bucket
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def manifest(**components: DataFrame) -> DataFrame:
    """(component, rows, securities, first_day, last_day), a row a component."""
    out = None
    for name, df in components.items():
        part = df.agg(
            F.lit(name).alias("component"),
            F.count("*").alias("rows"),
            F.countDistinct("security_id").alias("securities"),
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def changed_years(old: DataFrame, new: DataFrame) -> DataFrame:
    """(year, status) of years in new: added, changed or same, by content."""
    a = audit.fingerprint(old, ["year"]).select("year", F.col("fingerprint").alias("was"))
    b = audit.fingerprint(new, ["year"]).select("year", "fingerprint")
    status = F.when(F.col("was").isNull(), "added").when(F.col("was") != F.col("fingerprint"), "changed").otherwise("same")
    return b.join(a, "year", "left").select("year", status.alias("status"))


def update_yearly(new: DataFrame, path: str, column: str = "date") -> DataFrame:
    """Replace the years of a yearly dataset whose content differs in new, and no others; returns what was done."""
    spark = new.sparkSession
    new = new.withColumn("year", F.year(column))
    old = read_yearly(spark, path).select(*new.columns)
    status = changed_years(old, new).collect()  # a row a year
    years = [r["year"] for r in status if r["status"] != "same"]
    if years:
        part = new.where(F.col("year").isin(*years)).hint("rebalance", "year")
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    return spark.createDataFrame([tuple(r) for r in status], "year int, status string")


#: What a run is made of besides its row in runs; each is a dataset partitioned by run_id.
RUN_PARTS = ["run_metrics", "run_daily", "run_baselines", "run_correlations", "run_breakdowns"]


def write_runs(
    path: str,
    runs: DataFrame,
    metrics: DataFrame,
    daily: DataFrame,
    baselines: DataFrame | None = None,
    correlations: DataFrame | None = None,
    breakdowns: DataFrame | None = None,
) -> None:
    """Write runs(run_id, start_time, tags map) and what belongs to them, each with run_id.

    metrics(config, type, metric, value), daily(config, type, date, ...), baselines(baseline, sharpe),
    correlations(baseline, signal_corr, pnl_corr), breakdowns(byvar, grp, metric, value) of the best configuration.

    The parts are written under the name of this attempt, and the rows in runs, which name it, last, in one commit: readers
    take the parts of the attempt that the newest row of a run names. So a run that is listed is complete, a run written again
    replaces the one before, all of it, and what a broken attempt has left is never read.
    """
    spark = runs.sparkSession
    before = published(spark, path).agg(F.max("attempt")).first()[0] if _exists(spark, f"{path}/runs") else None
    attempt = f"{int((before or '0').split('-')[0]) + 1:09d}-{uuid.uuid4().hex}"
    parts = zip(RUN_PARTS, (metrics, daily, baselines, correlations, breakdowns), strict=True)
    for name, df in parts:
        if df is not None:
            df.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{path}/{name}")
    runs.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("run_id").parquet(f"{path}/runs")


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _folder(spark, path)
    return fs.exists(folder)


def _by_run(spark: SparkSession, path: str) -> DataFrame:
    """A dataset by run_id, which is text whatever it looks like."""
    schema = spark.read.parquet(path).schema
    text = [T.StructField(f.name, T.StringType()) if f.name in ("run_id", "attempt") else f for f in schema.fields]
    return spark.read.schema(T.StructType(text)).parquet(path)


def published(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, start_time, tags, attempt) of every run: the row written last."""
    runs = _by_run(spark, f"{path}/runs")
    rest = [c for c in runs.columns if c != "run_id"]
    return runs.groupBy("run_id").agg(F.max_by(F.struct(*rest), "attempt").alias("row")).select("run_id", "row.*")


def run_part(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A part of all runs (see RUN_PARTS), as their published attempts have it."""
    named = published(spark, path).select("run_id", "attempt")
    return _by_run(spark, f"{path}/{name}").join(named, ["run_id", "attempt"]).drop("attempt")


def sweep_runs(spark: SparkSession, path: str) -> int:
    """Remove the parts of attempts that are not published, while nothing is being written; the number of folders removed."""
    named, gone = {(r.run_id, r.attempt) for r in published(spark, path).select("run_id", "attempt").collect()}, 0  # a row a run
    for part in RUN_PARTS:
        folder, fs = _folder(spark, f"{path}/{part}")
        for run in fs.listStatus(folder) if fs.exists(folder) else ():
            for attempt in fs.listStatus(run.getPath()) if run.isDirectory() else ():
                key = run.getPath().getName().partition("=")[2], attempt.getPath().getName().partition("=")[2]
                if key not in named and fs.delete(attempt.getPath(), True):
                    gone += 1
    return gone


def write_run(path: str, run_id: str, started: str, tags: dict[str, str], metrics: DataFrame, daily: DataFrame, **more: DataFrame) -> None:
    """Write one run; see write_runs."""
    runs = metrics.sparkSession.createDataFrame([(run_id, started, tags)], "run_id string, start_time string, tags map<string,string>")
    parts = {"metrics": metrics, "daily": daily, **more}
    write_runs(path, runs, **{name: df.withColumn("run_id", F.lit(run_id)) for name, df in parts.items() if df is not None})


def run_history(runs: DataFrame, most: int = 100) -> DataFrame:
    """The latest runs, newest first."""
    return runs.orderBy(F.desc("start_time"), "run_id").limit(most)


def read_run(spark: SparkSession, path: str, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, run_metrics, run_daily) of one run, empty if it is not listed; only its folders are read."""
    own = published(spark, path).where(F.col("run_id") == run_id)
    row = own.select("attempt").first()
    attempt = (F.col("run_id") == run_id) & (F.col("attempt") == (row.attempt if row else ""))
    parts = (_by_run(spark, f"{path}/{t}").where(attempt).drop("attempt") for t in ("run_metrics", "run_daily"))
    return (own.drop("attempt"), *parts)


def delete_runs(spark: SparkSession, path: str, gone: Sequence[str]) -> DataFrame:
    """Remove runs, the row in runs first; (run_id, status): deleted, or failed where there is no such run."""
    found = []
    for run_id in dict.fromkeys(gone):
        status = "failed"
        for table in ("runs", *RUN_PARTS):
            folder, fs = _folder(spark, f"{path}/{table}/run_id={run_id}")
            if run_id and fs.exists(folder) and fs.delete(folder, True) and table == "runs":
                status = "deleted"
        found.append((run_id, status))
    return spark.createDataFrame(found, "run_id string, status string")


def write_baselines(signals: DataFrame, path: str) -> None:
    signals.hint("rebalance", "signal_name").write.mode("overwrite").partitionBy("signal_name").parquet(path)


def read_baselines(spark: SparkSession, path: str, low: str, high: str) -> DataFrame:
    return clean.between(spark.read.parquet(path), low, high, "date_sig")


def factor_library(*tables: DataFrame) -> DataFrame:
    """Percent factor tables with lower-cased column names, joined on date, as fractions."""
    out = None
    for df in tables:
        df = df.select(*(F.col(f"`{c}`").alias(c.strip().lower()) for c in df.columns))
        df = df.select("date", *((F.col(f"`{c}`") / 100).alias(c) for c in df.columns if c != "date"))
        out = df if out is None else out.join(df, "date")
    return out
