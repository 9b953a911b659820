"""The registered queries: each operator on the fixtures, beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions.stats import max_rank
from signalloom.operators import audit, baselines, clean, cost, joins, performance, portfolio, regress, suite
from signalloom.operators import trading_calendar as tc
from signalloom.plans import backtest as bt
from signalloom.plans import sql as Q
from signalloom.plans.fixtures import DailyPanel, WeeklyPanel
from signalloom.plans.held import hold, scratch
from signalloom.registry import add
from signalloom.sources import snapshots, tables

P, E = WeeklyPanel, DailyPanel
G = bt.KEYS
KEY = "security_id date"
SIG = "security_id date_sig date_avail signal:r"
FACTORS = ["size", "value", "growth", "leverage", "volatility", "momentum"]


def _config(**how) -> bt.Config:
    """The smallest tables have too few names a week for more than one a side."""
    return bt.Config(**{"mincos": 1} | how)


# --- sources and sinks -------------------------------------------------------------------------------------------


def _written(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def _scan_signal(spark, d):
    return tables.scan_signal(spark, _written(P(spark, d).signal.drop("signal_name"), "signal"))


add("scan_signal", SIG, _scan_signal, "FROM signal")


def _signal_csv(spark, d) -> str:
    """The columns in another order, among others, and every fifth security's lines with a day that is none."""
    path, signal = f"{scratch(spark, 'signal')}.csv", P(spark, d).signal
    day = F.date_format("date_sig", "yyyy-MM-dd")
    lines = signal.select(
        F.when(F.col("security_id") % 5 == 0, F.concat(F.lit("on "), day)).otherwise(day).alias("date_sig"),
        F.lit("a, b").alias("note"),
        "signal",
        F.col("security_id").cast("double").alias("security_id"),
        F.date_format("date_avail", "yyyy-MM-dd HH:mm:ss").alias("date_avail"),
    )
    lines.write.csv(path, header=True)
    return path


add("scan_signal_csv", SIG, lambda s, d: tables.scan_signal(s, _signal_csv(s, d), "drop"), "SELECT * FROM signal WHERE security_id % 5 <> 0")
add(
    "signal_rejects",
    "columns security_id lines",
    lambda s, d: tables.signal_rejects(s, _signal_csv(s, d)).groupBy("columns", F.col("security_id").cast("double").cast("int").alias("security_id")).agg(F.count("*").alias("lines")),
    "SELECT 'date_sig' AS columns, security_id, count(*) AS lines FROM signal WHERE security_id % 5 = 0 GROUP BY security_id",
)
add("scan_panel", f"{KEY} ret:r resret:r vol:r adv:r close_adj:r", lambda s, d: P(s, d).ret, "FROM ret")


def _scan_universe(spark, d):
    risk = P(spark, d).risk.select("security_id", F.col("date").alias("as_of_date"), "universe_flag", "cap")
    return tables.scan_universe(spark, _written(risk, "descriptor"), "1996-01-01", "1998-12-31")


add(
    "scan_descriptor_universe",
    KEY,
    _scan_universe,
    "SELECT DISTINCT security_id, date FROM risk WHERE universe_flag = 1 AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
)


def _yearly(spark, d) -> str:
    path = scratch(spark, "ret")
    tables.write_yearly(P(spark, d).ret, path)
    return path


add(
    "write_yearly_partitions",
    "year rows first_day last_day",
    lambda s, d: tables.read_yearly(s, _yearly(s, d)).groupBy("year").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    ),
    "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, min(date) AS first_day, max(date) AS last_day FROM ret GROUP BY 1",
)
add(
    "read_partitions_union",
    f"{KEY} ret:r",
    lambda s, d: tables.read_yearly(s, _yearly(s, d), [1996, 1997]),
    "SELECT * FROM ret WHERE year(date) IN (1996, 1997)",
)


def _snapshot(spark, d):
    p = P(spark, d)
    return snapshots.build(p.ret, p.risk, p.dates, scratch(spark, "snapshot"))


def _updated(spark, d):
    """A snapshot to 2000, brought up to date by returns that are new in 2001 and others in 1997: its path, what was done."""
    p, path = P(spark, d), scratch(spark, "snapshot")
    snapshots.build(p.ret.where("year(date) < 2001"), p.risk, p.dates, path)
    new = p.ret.withColumn("ret", F.when(F.year("date") == 1997, F.col("ret") + 1).otherwise(F.col("ret")))
    return path, snapshots.update(spark, path, ret=new)


def _by_year(spark, path, name):
    df = snapshots.component(spark, path, name)
    return df.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("rows"), F.sum("ret").alias("total"))


def _update(spark, d):
    path, done = _updated(spark, d)
    return _by_year(spark, path, "ret").join(done.where("component = 'ret'"), "year")


def _rebuilt(spark, d):
    path, done = _updated(spark, d)
    return _by_year(spark, path, "master").join(done.where("component = 'master'"), "year")


def _verified(spark, d):
    path, _ = _updated(spark, d)
    return snapshots.verify(spark, path).join(spark.read.parquet(f"{path}/manifest"), "component")


def _update_yearly(spark, d):
    ret, path = P(spark, d).ret.select("security_id", "date", "ret"), scratch(spark, "ret")
    tables.write_yearly(ret.where("year(date) < 2001"), path)
    new = ret.withColumn("ret", F.when(F.year("date") == 1997, F.col("ret") + 1).otherwise(F.col("ret")))
    done = tables.update_yearly(new, path)
    now = tables.read_yearly(spark, path).groupBy("year").agg(F.count("*").alias("rows"), F.sum("ret").alias("total"))
    return now.join(done, "year")


UPDATED = """SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, sum(CASE WHEN year(date) = 1997 THEN ret + 1 ELSE ret END) AS total,
   CASE year(date) WHEN 1997 THEN 'changed' WHEN 2001 THEN 'added' ELSE 'same' END AS status FROM ret GROUP BY 1, 4"""
add("incremental_update", "year rows total:r status", _update, UPDATED)
add("yearly_update", "year rows total:r status", _update_yearly, UPDATED)
add(
    "update_rebuilds_master",
    "year rows total:r status",
    _rebuilt,
    """SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, sum(CASE WHEN year(date) = 1997 THEN ret + 1 ELSE ret END) AS total,
       CASE WHEN year(date) IN (1997, 2001) THEN 'rebuilt' ELSE 'kept' END AS status
       FROM ret JOIN (SELECT security_id, date FROM risk) USING (security_id, date) GROUP BY 1, 4""",
)
MANIFEST = "count(*) AS rows, count(DISTINCT security_id) AS securities, min(date) AS first_day, max(date) AS last_day"
add(
    "manifest_stats",
    "component rows securities first_day last_day",
    lambda s, d: tables.manifest(ret=P(s, d).ret, risk=P(s, d).risk),
    f"SELECT 'ret' AS component, {MANIFEST} FROM ret UNION ALL SELECT 'risk', {MANIFEST} FROM risk",
)
SNAPSHOT_PARTS = (("ret", "ret"), ("risk", "risk"), ("master", "ret JOIN (SELECT security_id, date FROM risk) USING (security_id, date)"), ("factors", "risk"))
#: The manifest's fingerprints are of a hash that only Spark has, so its twin has the other columns.
add(
    "build_snapshot",
    "component rows securities first_day last_day",
    _snapshot,
    " UNION ALL ".join(f"SELECT '{name}' AS component, {MANIFEST} FROM {table}" for name, table in SNAPSHOT_PARTS),
)

add(
    "update_verifies",
    "component status rows securities first_day last_day",
    _verified,
    " UNION ALL ".join(f"SELECT '{name}' AS component, 'ok' AS status, {MANIFEST} FROM {table}" for name, table in SNAPSHOT_PARTS),
)


def _runs(spark, d, again: bool = False) -> str:
    """A run for each region, of its yearly and weekly returns, started on the day of its first return."""
    p, path = P(spark, d), scratch(spark, "runs")
    by_region = p.base.join(p.suppliers, "security_id").join(F.broadcast(p.nations), "s_nationkey")  # 25 nations
    run_id = F.concat(F.lit("run"), F.col("n_regionkey").cast("string")).alias("run_id")
    kind = [run_id, F.lit("lag0_residoff").alias("config"), F.lit("signal").alias("type")]
    value = F.sum("dsc") / (F.sum("k") * 100) - 0.05
    daily = hold(by_region.groupBy(*kind, "date").agg(value.alias("ret")))
    metrics = by_region.groupBy(*kind, F.concat(F.lit("y"), F.year("date").cast("string")).alias("metric")).agg(value.alias("value"))
    nation = F.col("s_nationkey").cast("string")
    breakdowns = by_region.groupBy(run_id, F.lit("nation").alias("byvar"), nation.alias("grp"), F.lit("ret").alias("metric")).agg(value.alias("value"))
    baselines_ = by_region.groupBy(run_id, F.lit("tax").alias("baseline")).agg((F.sum("tx") / F.sum("k")).alias("sharpe"))
    correlations = daily.join(p.market, "date").groupBy("run_id", F.lit("market").alias("baseline"))
    correlations = correlations.agg(F.corr("ret", "market_ret").alias("signal_corr"), F.corr("ret", "market_ret").alias("pnl_corr"))
    runs = daily.groupBy("run_id").agg(F.min("date").cast("string").alias("start_time"), F.create_map(F.lit("days"), F.count("*").cast("string")).alias("tags"))
    if again:  # a first attempt with other values, and one that ends after its first part
        less = metrics.withColumn("value", F.col("value") - 1)
        tables.write_runs(path, runs.withColumn("start_time", F.lit("1990-01-01")), less, daily.limit(1), baselines_, correlations, breakdowns)
        less.withColumn("attempt", F.lit("000000002-lost")).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{path}/run_metrics")
    tables.write_runs(path, runs, metrics, daily, baselines_, correlations, breakdowns)
    return path


R_SUP = "(SELECT *, 'run' || n_regionkey AS run_id FROM p_sup)"
R_DAILY = f"SELECT run_id, date, sum(dsc) / (sum(k) * 100) - 0.05e0 AS ret FROM {R_SUP} GROUP BY ALL"
R_RUNS = f"SELECT run_id, CAST(min(date) AS VARCHAR) AS start_time, count(*) AS days FROM ({R_DAILY}) GROUP BY ALL"


def _stored_runs(s, d, again: bool = False):
    path = _runs(s, d, again)
    read = lambda t: tables.run_part(s, path, t)
    out = tables.published(s, path).select("run_id", "start_time")
    for t, n in (("run_metrics", "metrics"), ("run_daily", "days"), ("run_breakdowns", "breakdowns")):
        out = out.join(read(t).groupBy("run_id").agg(F.count("*").alias(n)), "run_id")
    return out.join(read("run_baselines"), "run_id").join(read("run_correlations").select("run_id", "pnl_corr"), "run_id")


STORED_RUNS = f"""SELECT r.run_id, r.start_time, m.metrics, r.days, m.breakdowns, m.sharpe, c.pnl_corr FROM ({R_RUNS}) r
        JOIN (SELECT run_id, count(DISTINCT year(date)) AS metrics, count(DISTINCT s_nationkey) AS breakdowns, sum(tx) / sum(k) AS sharpe
              FROM {R_SUP} GROUP BY 1) m USING (run_id)
        JOIN (SELECT run_id, corr(ret, market_ret) AS pnl_corr FROM ({R_DAILY}) JOIN market USING (date) GROUP BY 1) c USING (run_id)"""
RUN_COLUMNS = "run_id start_time metrics days breakdowns sharpe:r pnl_corr:r"
add("write_run", RUN_COLUMNS, _stored_runs, STORED_RUNS)
add("rewrite_run", RUN_COLUMNS, lambda s, d: _stored_runs(s, d, again=True), STORED_RUNS)
YEARLY = f"SELECT 'y' || year(date) AS metric, sum(dsc) / (sum(k) * 100) - 0.05e0 AS value FROM {R_SUP} WHERE run_id = 'run2' GROUP BY 1"
add("reread_run", "metric value:r", lambda s, d: tables.read_run(s, _runs(s, d, again=True), "run2")[1], YEARLY)
add(
    "run_history",
    "run_id start_time",
    lambda s, d: tables.run_history(tables.published(s, _runs(s, d)), 3),
    f"SELECT run_id, start_time FROM ({R_RUNS}) ORDER BY start_time DESC, run_id LIMIT 3",
)


def _delete(spark, d):
    """The runs with the most and the fewest days go, and one that is not there."""
    path = _runs(spark, d)
    runs = tables.published(spark, path).withColumn("days", F.col("tags")["days"].cast("int"))
    ends = runs.agg(F.max_by("run_id", F.struct("days", "run_id")).alias("a"), F.min_by("run_id", F.struct("days", "run_id")).alias("b")).first()
    status = tables.delete_runs(spark, path, [ends["a"], ends["b"], "none"])
    return status.unionByName(tables.published(spark, path).select("run_id", F.lit("kept").alias("status")))


add(
    "delete_runs",
    "run_id status",
    _delete,
    f"""SELECT run_id, CASE WHEN 1 IN (first, last) THEN 'deleted' ELSE 'kept' END AS status FROM (
          SELECT run_id, row_number() OVER (ORDER BY days, run_id) AS first, row_number() OVER (ORDER BY days DESC, run_id DESC) AS last FROM ({R_RUNS}))
        UNION ALL SELECT 'none', 'failed'""",
)
add(
    "read_run",
    "metric value:r",
    lambda s, d: tables.read_run(s, _runs(s, d), "run2")[1],
    YEARLY,
)
REVERSAL = """SELECT 'reversal_5d' AS signal_name, security_id, date AS date_sig, CAST(date + 1 AS DATE) AS date_avail, -r AS signal FROM (
  SELECT security_id, date, CASE WHEN count(ret) OVER w = 5 THEN product(1 + ret) OVER w - 1 END AS r FROM ret
  WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS 4 PRECEDING)) WHERE r IS NOT NULL"""
VALUE = "SELECT 'value' AS signal_name, security_id, date AS date_sig, CAST(date + 1 AS DATE) AS date_avail, value AS signal FROM risk"


def _stored_baselines(spark, d):
    p, path = P(spark, d), scratch(spark, "baselines")
    tables.write_baselines(baselines.all_baselines(p.ret, p.risk), path)
    return tables.read_baselines(spark, path, "1997-01-01", "1997-12-31")


add(
    "precomputed_baselines",
    f"signal_name {SIG}",
    _stored_baselines,
    f"SELECT * FROM ({REVERSAL} UNION ALL {VALUE}) WHERE date_sig BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'",
)
CLOSE = "SELECT date, sum(px) / sum(qty) AS close FROM p_base GROUP BY date"


def _close(s, d):
    return P(s, d).base.groupBy("date").agg((F.sum("px") / F.sum("qty")).alias("close"))


add(
    "benchmark_returns",
    "date market_ret:r",
    lambda s, d: performance.pct_change(_close(s, d).withColumn("series", F.lit(1)), ["series"], "close", "market_ret"),
    f"SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS market_ret FROM ({CLOSE})",
)


def _factor_tables(s, d):
    base = P(s, d).base.groupBy("date").agg(*(F.sum(c).alias(c) for c in ("k", "dsc", "tx", "qty", "px")))
    a = base.select("date", (F.col("dsc") / F.col("k")).alias(" Mkt-RF"), (F.col("tx") / F.col("k")).alias("SMB"))
    b = base.select("date", (F.col("qty") / F.col("k")).alias("HML")).where("year(date) >= 1996")
    return tables.factor_library(a, b)


FACTOR_SQL = """SELECT date, sum(dsc) / sum(k) / 100 AS "mkt-rf", sum(tx) / sum(k) / 100 AS smb, sum(qty) / sum(k) / 100 AS hml
  FROM p_base WHERE year(date) >= 1996 GROUP BY date"""
add("factor_library", "date mkt-rf:r smb:r hml:r", _factor_tables, FACTOR_SQL)

# --- cleaning ----------------------------------------------------------------------------------------------------

DUP = "SELECT security_id, date, 1 AS part, ret FROM ret UNION ALL SELECT security_id, date, 2, CASE WHEN security_id % 3 = 0 THEN NULL ELSE ret + 1 END FROM ret WHERE security_id % 2 = 0"
LAST = f"SELECT * FROM ({DUP}) QUALIFY row_number() OVER (PARTITION BY security_id, date ORDER BY part DESC) = 1"


def _dup(s, d):
    ret = P(s, d).ret.select("security_id", "date", F.lit(1).alias("part"), "ret")
    again = F.when(F.col("security_id") % 3 == 0, None).otherwise(F.col("ret") + 1)
    return ret.unionByName(ret.where("security_id % 2 = 0").select("security_id", "date", F.lit(2).alias("part"), again.alias("ret")))


add("dedup_keep_last", f"{KEY} ret:r", lambda s, d: clean.keep_last(_dup(s, d), ["security_id", "date"], ["part"]), LAST)
add(
    "dedup_calendar",
    "date n",
    lambda s, d: clean.normalize_calendar(
        P(s, d).dates.select("date", "n").unionByName(P(s, d).dates.where("n % 5 = 0").select("date", (F.col("n") + 1000).alias("n")))
    ),
    "SELECT date, CAST(CASE WHEN n % 5 = 0 THEN n + 1000 ELSE n END AS INTEGER) AS n FROM dates",
)
add(
    "normalize_panel",
    f"{KEY} ret:r",
    lambda s, d: clean.normalize_panel(
        _dup(s, d).withColumn("ret", F.coalesce("ret", F.lit(float("nan")))).withColumn("security_id", F.col("security_id").cast("long")), ["part"]
    ),
    LAST,
)
add("drop_null_rows", f"{KEY} ret:r", lambda s, d: clean.last_complete(_dup(s, d), ["security_id", "date"], ["part"]), f"SELECT * FROM ({LAST}) WHERE ret IS NOT NULL")
add("drop_null_signal", f"{KEY} ret:r", lambda s, d: _dup(s, d).where("ret is not null"), f"SELECT * FROM ({DUP}) WHERE ret IS NOT NULL")
add(
    "project_rename",
    f"{KEY} ret:r resret:r",
    lambda s, d: P(s, d).ret.select("security_id", "date", F.col("openret").alias("ret"), F.col("resopenret").alias("resret")),
    "SELECT security_id, date, openret AS ret, resopenret AS resret FROM ret",
)
add("factor_projection", f"{KEY} " + " ".join(f"{c}:r" for c in FACTORS), lambda s, d: clean.factors_of(P(s, d).risk), "FROM risk")
add(
    "filter_date_range",
    f"{KEY} ret:r",
    lambda s, d: clean.between(P(s, d).ret, "1996-01-01", "1996-12-30"),
    "SELECT * FROM ret WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-30'",
)
add("filter_universe_flag", f"{KEY} cap", lambda s, d: clean.in_universe(P(s, d).risk), "SELECT * FROM risk WHERE universe_flag = 1")
add(
    "filter_bad_open_return",
    f"{KEY} ret:r",
    lambda s, d: clean.plausible_open_returns(P(s, d).ret.select("security_id", "date", (F.col("openret") * 100).alias("ret"))),
    "SELECT security_id, date, openret * 100 AS ret FROM ret WHERE openret * 100 > -0.95e0",
)
add(
    "filter_insample",
    f"{KEY} ret:r sample",
    lambda s, d: clean.in_sample(P(s, d).ret, P(s, d).dates, "insample").withColumn("sample", F.lit("i1")).unionByName(
        clean.in_sample(P(s, d).ret, P(s, d).dates, "insample2").withColumn("sample", F.lit("i2"))
    ),
    """SELECT ret.*, 'i1' AS sample FROM ret JOIN dates USING (date) WHERE insample = 1
       UNION ALL SELECT ret.*, 'i2' FROM ret JOIN dates USING (date) WHERE insample2 = 1""",
)

# --- the signal contract and the calendar ------------------------------------------------------------------------


def _broken(s, d):
    e = E(s, d).signal
    odd = e.where("security_id % 5 = 0").withColumns({"signal": F.lit(float("inf")), "date_avail": F.date_sub("date_sig", 1)})
    return e.unionByName(odd).withColumn("signal", F.when(F.col("security_id") % 7 == 0, None).otherwise(F.col("signal")))


BROKEN = """SELECT security_id, date_sig, date_avail, CASE WHEN security_id % 7 = 0 THEN NULL ELSE signal END AS signal FROM (
  SELECT security_id, date_sig, date_avail, signal FROM e_signal
  UNION ALL SELECT security_id, date_sig, CAST(date_sig - 1 AS DATE), CAST('inf' AS DOUBLE) FROM e_signal WHERE security_id % 5 = 0)"""
add(
    "validate_signal",
    "rows duplicate_rows infinite missing lookahead",
    lambda s, d: tc.validate_counts(_broken(s, d)),
    f"""SELECT count(*) AS rows, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_rows,
        count(*) FILTER (isinf(signal)) AS infinite, count(*) FILTER (signal IS NULL) AS missing,
        count(*) FILTER (date_avail < date_sig) AS lookahead
        FROM (SELECT *, count(*) OVER (PARTITION BY security_id, date_sig) AS k FROM ({BROKEN}))""",
)
ALIGNED = "signal_name security_id date_sig date_avail date_openret date_ret signal:r"


def trading_days(source: str, dates: str, hour: str, lag: str = "0") -> str:
    return f"""SELECT s.*, o.date AS date_openret, r.date AS date_ret FROM {source} s JOIN {dates} c ON c.date = s.date_avail
      JOIN {dates} o ON o.n = c.n + CASE WHEN {hour} <= 8 THEN 0 ELSE 1 END + {lag}
      JOIN {dates} r ON r.n = c.n + CASE WHEN {hour} <= 15 THEN 1 ELSE 2 END + {lag}"""


add("align_trading_days", ALIGNED, lambda s, d: tc.align(E(s, d).signal, E(s, d).dates, 8), trading_days("e_signal", "e_dates", "8"))
add(
    "avail_hour_from_ts",
    f"{ALIGNED} hour",
    lambda s, d: tc.align(E(s, d).signal, E(s, d).dates, F.col("hour")),
    trading_days("e_signal", "e_dates", "s.hour"),
)
add(
    "infer_avail_date",
    SIG,
    lambda s, d: tc.infer_available(E(s, d).signal.drop("date_avail"), E(s, d).dates),
    """SELECT s.security_id, s.date_sig, o.date AS date_avail, s.signal FROM e_signal s JOIN e_dates c ON c.date = s.date_sig
       JOIN e_dates o ON o.n = c.n + 1""",
)
add(
    "infer_sig_date",
    SIG,
    lambda s, d: tc.infer_signal_day(E(s, d).signal.drop("date_sig"), E(s, d).dates),
    """SELECT s.security_id, o.date AS date_sig, s.date_avail, s.signal FROM e_signal s JOIN e_dates c ON c.date = s.date_avail
       JOIN e_dates o ON o.n = c.n - 1""",
)
add(
    "align_calendar_days",
    ALIGNED,
    lambda s, d: tc.align_calendar_days(E(s, d).signal, E(s, d).dates, F.col("hour")),
    """SELECT f.*, o.date AS date_openret, r.date AS date_ret FROM (
         SELECT s.*, c.n IS NOT NULL AS on_day,
                last_value(c.n IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY date_avail ROWS UNBOUNDED PRECEDING) AS n
         FROM e_signal s LEFT JOIN e_dates c ON c.date = s.date_avail) f
       JOIN e_dates o ON o.n = f.n + CASE WHEN on_day AND hour <= 8 THEN 0 ELSE 1 END
       JOIN e_dates r ON r.n = f.n + CASE WHEN NOT on_day OR hour > 15 THEN 2 ELSE 1 END""",
)
add(
    "lag_shift",
    f"{ALIGNED} lag",
    lambda s, d: tc.align(E(s, d).signal, E(s, d).dates, 8, (0, 1, 2, 5)),
    trading_days("(SELECT * FROM e_signal CROSS JOIN (VALUES (0), (1), (2), (5)) l(lag))", "e_dates", "8", "s.lag"),
)
add(
    "prepare_signal",
    ALIGNED,
    lambda s, d: tc.prepare(
        E(s, d).signal.withColumn("signal", F.when(F.col("security_id") % 7 == 0, None).otherwise(F.col("signal"))), E(s, d).dates
    ),
    trading_days("(SELECT * FROM e_signal WHERE security_id % 7 <> 0)", "e_dates", "8"),
)
add(
    "cast_security_id",
    SIG,
    lambda s, d: E(s, d).signal.withColumn("security_id", F.col("security_id").cast("long")).withColumn("security_id", F.col("security_id").cast("int")),
    "FROM e_signal",
)
add(
    "forward_fill",
    f"{KEY} filled:r",
    lambda s, d: tc.forward_fill(
        P(s, d).ret.withColumn("filled", F.when(F.dayofmonth("date") > 15, F.col("ret"))), "filled", ["security_id"], "date"
    ),
    """SELECT security_id, date, last_value(CASE WHEN day(date) > 15 THEN ret END IGNORE NULLS)
       OVER (PARTITION BY security_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS filled FROM ret""",
)

# --- joins -------------------------------------------------------------------------------------------------------


def _aligned(s, d, lags=(0,)):
    return tc.align(P(s, d).signal, P(s, d).dates, 8, lags)


add(
    "join_returns",
    f"{KEY} date_sig signal:r ret:r resret:r",
    lambda s, d: joins.returns_on(_aligned(s, d), P(s, d).ret),
    "SELECT * FROM prepared",
    Q.prepared(),
)
add(
    "build_master",
    f"{KEY} ret:r resret:r vol:r adv:r close_adj:r industry_id cap mcap:r value:r",
    lambda s, d: joins.build_master(P(s, d).ret, P(s, d).risk),
    "SELECT * FROM ret JOIN (SELECT * EXCLUDE (adv) FROM risk) USING (security_id, date)",
)


def _late_risk(s, d, days=7):
    """Attributes a week late; the weeks that suppliers miss make exact, stale and too old matches."""
    return P(s, d).risk.select("security_id", F.date_add("date", days).alias("date_risk"), "value", "cap")


LATE = "SELECT security_id, CAST(date + 7 AS DATE) AS date_risk, value, cap FROM risk"


def asof(tolerance: str) -> str:
    fresh = f"CASE WHEN s.date_sig - k.date_risk <= {tolerance} THEN"
    return f"""SELECT s.*, {fresh} k.value END AS value, {fresh} k.cap END AS cap FROM signal s
      ASOF LEFT JOIN ({LATE}) k ON s.security_id = k.security_id AND s.date_sig >= k.date_risk"""


ASOF = "security_id date_sig signal:r value:r cap"
for _name, _days in (("asof_backward_tolerance", 10), ("asof_backward_no_tolerance", None)):
    add(
        _name,
        ASOF,
        lambda s, d, t=_days: joins.asof_backward(
            P(s, d).signal, _late_risk(s, d), ["security_id"], "date_sig", "date_risk", ["value", "cap"], t
        ),
        asof(str(_days or 1_000_000)),
    )
for _name, _days in (("asof_bucketed", 10), ("asof_bucketed_no_tolerance", None)):
    add(
        _name,
        ASOF,
        lambda s, d, t=_days: joins.asof_bucketed(
            P(s, d).signal, _late_risk(s, d), ["security_id"], "date_sig", "date_risk", ["value", "cap"], t, 28
        ),
        asof(str(_days or 1_000_000)),
    )
#: All securities are one key here, and its rows are told apart by their days and securities: the worst case of an as-of join.
add(
    "asof_bucketed_one_key",
    "security_id date_sig close:r",
    lambda s, d: joins.asof_bucketed(
        P(s, d).signal.withColumn("key", F.lit(1)),
        _close(s, d).where("month(date) % 3 = 0").select(F.lit(1).alias("key"), F.date_add("date", 2).alias("day"), "close"),
        ["key"], "date_sig", "day", ["close"], None, 28,
    ),
    f"""SELECT s.security_id, s.date_sig, k.close FROM signal s
        ASOF LEFT JOIN (SELECT CAST(date + 2 AS DATE) AS day, close FROM ({CLOSE}) WHERE month(date) % 3 = 0) k ON s.date_sig >= k.day""",
)


def _bucketed(s, d):
    """ret and risk, each dealt once by security and date."""
    found = []
    for name, df in (("ret", P(s, d).ret), ("risk", P(s, d).risk)):
        table = f"signalloom_{name}_{uuid.uuid4().hex}"
        found.append(tables.write_bucketed(df, table, scratch(s, table), buckets=16))
    return found


add(
    "build_master_bucketed",
    f"{KEY} ret:r resret:r vol:r adv:r close_adj:r industry_id cap mcap:r value:r",
    lambda s, d: joins.build_master(*_bucketed(s, d)),
    "SELECT * FROM ret JOIN (SELECT * EXCLUDE (adv) FROM risk) USING (security_id, date)",
)
add(
    "join_returns_bucketed",
    f"{KEY} date_sig signal:r ret:r resret:r",
    lambda s, d: joins.returns_on(_aligned(s, d), _bucketed(s, d)[0]),
    "SELECT * FROM prepared",
    Q.prepared(),
)
add(
    "semi_join_universe",
    f"{KEY} ret:r",
    lambda s, d: P(s, d).ret.join(clean.in_universe(P(s, d).risk).select("security_id", "date"), ["security_id", "date"], "left_semi"),
    "SELECT ret.* FROM ret SEMI JOIN (SELECT * FROM risk WHERE universe_flag = 1) USING (security_id, date)",
)
add(
    "inner_join_universe_filter",
    SIG,
    lambda s, d: P(s, d).signal.join(
        P(s, d).risk.where("universe_flag <> 1").select("security_id", F.col("date").alias("date_sig")).distinct(),
        ["security_id", "date_sig"],
        "left_semi",
    ),
    "SELECT s.* FROM signal s SEMI JOIN risk k ON k.security_id = s.security_id AND k.date = s.date_sig AND k.universe_flag <> 1",
)


def _run(s, d, config=None, signal=None) -> bt.Result:
    p = P(s, d)
    ret = p.ret
    return bt.run(p.signal if signal is None else signal, ret, p.risk, p.dates, config or _config(), keep=hold, rows=ret.count())


def _held(s, d):
    return _run(s, d).held


BT = Q.backtest()
GK = " ".join(G)
add(
    "prev_period_outer_join",
    f"security_id n w:r w_before:r",
    lambda s, d: joins.previous_holdings(_held(s, d), G),
    f"""SELECT coalesce(a.security_id, b.security_id) AS security_id, coalesce(a.n, b.n) AS n, a.w, b.w_before
        FROM (SELECT security_id, n, weight AS w FROM held) a
        FULL JOIN (SELECT security_id, n + 1 AS n, weight AS w_before FROM held) b ON a.security_id = b.security_id AND a.n = b.n""",
    BT,
)
add(
    "exits_anti_join",
    "security_id n weight:r",
    lambda s, d: joins.exits(_held(s, d), G),
    """SELECT h.security_id, h.n + 1 AS n, h.weight FROM held h
       ANTI JOIN (SELECT security_id, n - 1 AS n FROM held) x ON h.security_id = x.security_id AND h.n = x.n""",
    BT,
)
YEARS = _config(byvars=("overall", "year"))
BT_YEARS = Q.backtest(byvars=("overall", "year"))
add(
    "panel_range_join",
    f"{GK} date n",
    lambda s, d: joins.panel_days(performance.date_bounds(_run(s, d, YEARS).names, G), P(s, d).dates),
    "FROM panel",
    BT_YEARS,
)
add(
    "date_minmax",
    f"{GK} low high",
    lambda s, d: performance.date_bounds(_run(s, d, YEARS).names, G),
    "FROM bounds",
    BT_YEARS,
)
add("left_join_fill_zero", f"{GK} date ret:r resret:r tc:r", lambda s, d: _run(s, d, YEARS).daily, "FROM daily", BT_YEARS)
add(
    "join_risk_attributes",
    f"{KEY} signal:r industry_id cap mcap:r adv:r",
    lambda s, d: bt.prepared(P(s, d).signal, P(s, d).ret, P(s, d).risk, P(s, d).dates, _config()),
    "FROM prepared",
    Q.prepared(),
)
add(
    "signal_overlap_join",
    "security_id date_sig signal:r other:r",
    lambda s, d: P(s, d).signal.join(
        P(s, d).price_signal.select("security_id", "date_sig", F.col("signal").alias("other")), ["security_id", "date_sig"]
    ),
    "SELECT s.*, p.signal AS other FROM signal s JOIN price p USING (security_id, date_sig)",
)
add(
    "forward_return_join",
    "security_id date_sig signal:r forward_ret:r",
    lambda s, d: joins.forward_returns(E(s, d).signal, E(s, d).ret),
    "SELECT s.*, r.ret AS forward_ret FROM e_signal s JOIN e_ret r ON r.security_id = s.security_id AND r.date = s.date_avail + 1",
)
add(
    "date_join_daily",
    "date ret:r market_ret:r",
    lambda s, d: _run(s, d).daily.join(P(s, d).market, "date"),
    "SELECT * FROM daily JOIN market USING (date)",
    BT,
)
EVENT = """SELECT security_id, date, l_returnflag FROM (
  SELECT CAST(l_suppkey AS INTEGER) AS security_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_returnflag, count(*) AS c
  FROM lineitem GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY security_id, date ORDER BY c DESC, l_returnflag) = 1"""


def _event(s, d):
    items = s.read.parquet(f"{d}/lineitem.parquet")
    week = F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")
    counted = items.groupBy(F.col("l_suppkey").cast("int").alias("security_id"), week, "l_returnflag").count()
    best = counted.groupBy("security_id", "date").agg(F.min(F.struct(-F.col("count"), "l_returnflag")).alias("b"))
    return best.select("security_id", "date", F.col("b.l_returnflag").alias("l_returnflag"))


add(
    "event_window_join",
    f"{KEY} l_returnflag signal:r ret:r",
    lambda s, d: joins.returns_on(_aligned(s, d), P(s, d).ret).join(_event(s, d), ["security_id", "date"]),
    f"SELECT * FROM prepared JOIN ({EVENT}) USING (security_id, date)",
    Q.prepared(),
)
add(
    "regime_join",
    "date ret:r regime",
    lambda s, d: joins.by_regime(_run(s, d).daily, _close(s, d), "close"),
    f"""SELECT date, ret, CASE WHEN close > median THEN 'high' ELSE 'low' END AS regime FROM daily JOIN ({CLOSE}) USING (date)
        CROSS JOIN (SELECT round(quantile_cont(close, 0.5), 1) AS median FROM ({CLOSE}))""",
    BT,
)

# --- ranks, positions, weights -----------------------------------------------------------------------------------

DAY = ["signal_name", "date_sig"]
D = "signal_name, date_sig"


def _ranked(s, d, **how):
    return portfolio.percentile(P(s, d).signal, DAY, **how)


S = "security_id date_sig"
add(
    "rank_average",
    f"{S} rank:r",
    lambda s, d: P(s, d).signal.withColumn("rank", portfolio.average_rank("signal", DAY)),
    f"SELECT *, {Q.average_rank('signal', D)} AS rank FROM signal",
)
add(
    "rank_max",
    f"{S} rank",
    lambda s, d: P(s, d).signal.withColumn("rank", max_rank("signal", DAY)),
    f"SELECT *, count(*) OVER (PARTITION BY {D} ORDER BY signal) AS rank FROM signal",
)
add("percentile_bucket", f"{S} p", _ranked, f"SELECT *, {Q.percentile('signal', D)} AS p FROM signal")
STRETCH = f"""SELECT *, (q - min(q) OVER (PARTITION BY {D}) + 1) * 100 / (max(q) OVER (PARTITION BY {D}) - min(q) OVER (PARTITION BY {D}) + 1) AS p
  FROM (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY {D} ORDER BY signal) * 100 / count(*) OVER (PARTITION BY {D})) AS BIGINT) AS q FROM signal)"""
add("percentile_stretch", f"{S} p:r", lambda s, d: _ranked(s, d, stretch=True), STRETCH)
POSITIONS = f"SELECT *, CAST({Q.POSITION} AS INTEGER) AS position FROM (SELECT *, {Q.percentile('signal', D)} AS p FROM signal)"


def _positions(s, d):
    return _ranked(s, d).withColumn("position", portfolio.position())


add("position_single_sort", f"{S} p position", _positions, POSITIONS)
add(
    "position_double_sort",
    f"{S} bucket position",
    lambda s, d: portfolio.double_sort(
        P(s, d).signal, P(s, d).risk.select("security_id", F.date_add("date", 7).alias("date_sig"), "value"), "value", DAY, 3, 20, 80
    ),
    f"""SELECT *, CAST({Q.POSITION} AS INTEGER) AS position FROM (SELECT *, {Q.percentile('signal', D + ', bucket')} AS p FROM (
        SELECT *, CAST(ceil({Q.average_rank('value', D)} * 3 / count(*) OVER (PARTITION BY {D})) AS BIGINT) AS bucket FROM (
        SELECT s.*, k.value FROM signal s ASOF JOIN (SELECT security_id, CAST(date + 7 AS DATE) AS date_risk, value FROM risk) k
        ON s.security_id = k.security_id AND s.date_sig >= k.date_risk)))""",
)
FRACTILE = f"SELECT *, CAST(ceil({Q.average_rank('signal', D)} * 5 / count(*) OVER (PARTITION BY {D})) AS BIGINT) AS fractile FROM signal"


def _fractiles(s, d):
    return portfolio.fractiles(P(s, d).signal, DAY, 5)


add("fractile_assign", f"{S} fractile", _fractiles, FRACTILE)
add(
    "position_from_fractile",
    f"{S} fractile position",
    lambda s, d: portfolio.position_from_fractile(_fractiles(s, d), "fractile"),
    f"""SELECT *, CAST(CASE WHEN fractile = min(fractile) OVER () THEN -1 WHEN fractile = max(fractile) OVER () THEN 1 ELSE 0 END AS INTEGER) AS position
        FROM ({FRACTILE})""",
)
add(
    "position_passthrough",
    f"{S} position:r",
    lambda s, d: _positions(s, d).select("security_id", "date_sig", F.col("position").cast("double").alias("signal")).withColumn("position", F.col("signal")),
    f"SELECT security_id, date_sig, CAST(position AS DOUBLE) AS position FROM ({POSITIONS})",
)
add("filter_positions", f"{S} position", lambda s, d: _positions(s, d).where(F.col("position").isin(-1, 1)), f"SELECT * FROM ({POSITIONS}) WHERE position IN (-1, 1)")


def _sized(s, d):
    risk = P(s, d).risk.select("security_id", F.col("date").alias("date_sig"), "mcap", "adv")
    return _positions(s, d).join(risk, ["security_id", "date_sig"])


SIZED = f"SELECT p.*, k.mcap, k.adv FROM ({POSITIONS}) p JOIN risk k ON k.security_id = p.security_id AND k.date = p.date_sig WHERE position <> 0"
add("weight_equal", f"{S} position weight:r", lambda s, d: portfolio.weigh(_sized(s, d), DAY, "equal"),
    f"SELECT *, position / count(*) OVER (PARTITION BY {D}, position) AS weight FROM ({SIZED})")


def clipped(c: str) -> str:
    w = f"OVER (PARTITION BY {D}, position)"
    return f"least(greatest({c}, quantile_cont({c}, 0.05) {w}), quantile_cont({c}, 0.95) {w})"


add(
    "winsorize_quantile",
    f"{S} position clipped:r",
    lambda s, d: _sized(s, d).where("position <> 0").withColumn("clipped", portfolio.winsorized("mcap", [*DAY, "position"])),
    f"SELECT *, {clipped('mcap')} AS clipped FROM ({SIZED})",
)
#: An accuracy beyond the size of the groups makes the sketch exact: the values at the quantiles' ranks, not between them.
add(
    "winsorize_sketch",
    f"{S} position clipped:r",
    lambda s, d: portfolio.winsorize(
        _sized(s, d).where("position <> 0").withColumn("clipped", F.col("mcap")), "clipped", [*DAY, "position"], accuracy=1_000_000
    ),
    f"""SELECT *, least(greatest(mcap, quantile_disc(mcap, 0.05) OVER (PARTITION BY {D}, position)),
        quantile_disc(mcap, 0.95) OVER (PARTITION BY {D}, position)) AS clipped FROM ({SIZED})""",
)
for _how, _col in (("value", "mcap"), ("volume", "adv")):
    add(
        f"weight_{_how}",
        f"{S} position weight:r",
        lambda s, d, h=_how: portfolio.weigh(_sized(s, d), DAY, h),
        f"SELECT *, x / sum(x) OVER (PARTITION BY {D}, position) * position AS weight FROM (SELECT *, {clipped(_col)} AS x FROM ({SIZED}))",
    )
GIVEN = "SELECT security_id, date_sig, signal_name, signal - 25.5e0 AS signal FROM signal"


def _given(s, d):
    return P(s, d).signal.withColumn("signal", F.col("signal") - 25.5)


add("weight_given", f"{S} position weight:r", lambda s, d: portfolio.weigh(_given(s, d), DAY, "given"),
    f"SELECT *, signal AS weight, CAST(CASE WHEN signal > 0 THEN 1 ELSE -1 END AS INTEGER) AS position FROM ({GIVEN})")
add("weight_renormalize", f"{S} position weight:r", lambda s, d: portfolio.weigh(_sized(s, d), DAY, "renormalize"),
    f"SELECT *, signal / nullif(sum(signal) OVER (PARTITION BY {D}, position), 0) * position AS weight FROM ({SIZED})")
add("clip_long_only", f"{S} weight:r", lambda s, d: portfolio.long_only(portfolio.weigh(_sized(s, d), DAY, "equal")),
    f"SELECT security_id, date_sig, greatest(position / count(*) OVER (PARTITION BY {D}, position), 0) AS weight FROM ({SIZED})")


def _compound(rows):
    return lambda s, d: performance.compound_return(P(s, d).ret, rows, "compound")


add("rolling_compound_return", f"{KEY} compound:r", _compound(10), """SELECT security_id, date, CASE WHEN count(ret) OVER w = 10 THEN product(1 + ret) OVER w - 1 END AS compound
    FROM ret WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS 9 PRECEDING)""")
add("cumulative_sum", "date cumret:r cumretnet:r", lambda s, d: _run(s, d).daily, "FROM daily", BT)
add("drawdown", "date drawdown:r", lambda s, d: _run(s, d).daily, "FROM daily", BT)
add("pct_change", "date change:r", lambda s, d: performance.pct_change(_close(s, d).withColumn("series", F.lit(1)), ["series"], "close", "change"),
    f"SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS change FROM ({CLOSE})")
add("capyr_label", f"{KEY} capyr", lambda s, d: portfolio.slices(P(s, d).risk, ["capyr"]).withColumnRenamed("grp", "capyr"),
    f"SELECT security_id, date, {Q.GROUP_OF['capyr']} AS capyr FROM risk")

# --- portfolios and their statistics -----------------------------------------------------------------------------

STATS = "num_date " + " ".join(f"{n}_{m}:r" for n in ("ret", "resret", "retnet") for m in ("ann", "std", "sharpe", "pos")) + " maxdd:r"
SLICED = _config(byvars=("overall", "year", "cap", "capyr", "industry_id"))
BT_SLICED = Q.backtest(byvars=SLICED.byvars)
GAINS = f"{GK} date ret:r resret:r"
add("names_per_side", f"{GK} date n_long n_short n_min",
    lambda s, d: portfolio.names_per_side(_run(s, d, YEARS).weights, [*G, "date", "n"]), "FROM all_names", BT_YEARS)
add("filter_min_names", f"{GK} date n_long n_short", lambda s, d: _run(s, d, YEARS).names, "FROM names", BT_YEARS)
add("daily_portfolio", GAINS, lambda s, d: performance.daily_portfolio(_held(s, d), [*G, "date"]), "FROM gains", BT)
add("net_return", "date ret:r tc:r ret_net:r resret_net:r", lambda s, d: _run(s, d).daily, "FROM daily", BT)
add("summary_stats", f"{GK} {STATS}", lambda s, d: _run(s, d, YEARS).summary, "FROM summary", BT_YEARS)
add("turnover_avg", f"{GK} turnover:r numcos_l:r numcos_s:r", lambda s, d: _run(s, d, YEARS).summary, "FROM summary", BT_YEARS)
add("summary_combine", f"{GK} {STATS} turnover:r numcos_l:r numcos_s:r", lambda s, d: _run(s, d, SLICED).summary, "FROM summary", BT_SLICED)
add("group_slices", f"{GK} num_date ret_sharpe:r turnover:r", lambda s, d: _run(s, d, SLICED).summary, "FROM summary", BT_SLICED)
add("daily_stats", "date ret:r ret_net:r resret:r cumret:r cumretnet:r drawdown:r turnover:r", lambda s, d: _run(s, d).daily, "FROM daily", BT)
LONG = _config(byvars=("overall", "year"), long_only=True)
add("benchmark_stats", f"{GK} num_date ret_ann:r ret_std:r ret_sharpe:r maxdd:r", lambda s, d: _run(s, d, LONG).summary, "FROM summary",
    Q.backtest(byvars=LONG.byvars, long_only=True))


def _exposed(s, d):
    return _run(s, d, _config(byvars=("overall", "year"), factors=["value", "size"])).summary


add("factor_exposure_avg", f"{GK} value:r size:r", _exposed,
    f"""SELECT p.*, x.value, x.size FROM (SELECT DISTINCT {Q.G} FROM panel) p JOIN (
        SELECT {Q.G}, avg(coalesce(v, 0)) AS value, avg(coalesce(z, 0)) AS size FROM panel LEFT JOIN (
        SELECT {Q.G}, date, sum(weight * value) AS v, sum(weight * size) AS z FROM held GROUP BY ALL) USING ({Q.G}, date) GROUP BY {Q.G}) x USING ({Q.G})""",
    BT_YEARS)


def _profile(s, d, how="equal"):
    df = bt.prepared(P(s, d).signal, P(s, d).ret, P(s, d).risk, P(s, d).dates, _config(factors=["value"]))
    return performance.fractile_profile(portfolio.fractiles(df, ["signal_name", "date"], 5), ["signal_name", "date"], ["value"], 1, how)


def profile_sql(how: str = "equal") -> str:
    w = {"equal": "1.0e0", "value": "mcap", "volume": "adv"}[how]
    return f"""SELECT signal_name, fractile, avg(ret) * 252 AS ret, avg(resret) * 252 AS resret, avg(numcos) AS numcos, avg(value) AS value FROM (
      SELECT *, least(coalesce(max(CASE WHEN fractile = 1 THEN numcos END) OVER (PARTITION BY signal_name, date), 0),
                      coalesce(max(CASE WHEN fractile = top THEN numcos END) OVER (PARTITION BY signal_name, date), 0)) AS enough FROM (
        SELECT *, max(fractile) OVER () AS top FROM (
          SELECT signal_name, date, fractile, count(*) AS numcos, sum(w * ret) AS ret, sum(w * resret) AS resret, sum(w * value) AS value FROM (
            SELECT *, {w} / sum({w}) OVER (PARTITION BY signal_name, date, fractile) AS w FROM (
              SELECT *, CAST(ceil({Q.average_rank('signal', 'signal_name, date')} * 5 / count(*) OVER (PARTITION BY signal_name, date)) AS BIGINT) AS fractile
              FROM prepared)) GROUP BY ALL))) WHERE enough >= 1 GROUP BY ALL"""


for _how, _name in (("equal", "fractile_profile"), ("value", "fractile_profile_value"), ("volume", "fractile_profile_volume")):
    add(_name, "signal_name fractile ret:r resret:r numcos:r value:r", lambda s, d, h=_how: _profile(s, d, h), profile_sql(_how), Q.prepared())
CAPS = _config(byvars=("cap",))
add("pivot_cap_cumret", "date LargeCap:r MediumCap:r SmallCap:r", lambda s, d: performance.cap_columns(_run(s, d, CAPS).daily),
    "SELECT date, " + ", ".join(f'max(cumret) FILTER (grp = \'{c}\') AS "{c}"' for c in ("LargeCap", "MediumCap", "SmallCap")) + " FROM daily GROUP BY date",
    Q.backtest(byvars=("cap",)))
add("coverage", "per_day:r percent:r days securities", lambda s, d: performance.coverage(P(s, d).signal, P(s, d).risk),
    """SELECT avg(k) AS per_day, avg(k) / (SELECT count(DISTINCT security_id) FROM risk) * 100 AS percent, count(*) AS days,
       (SELECT count(DISTINCT security_id) FROM signal) AS securities
       FROM (SELECT date_sig, count(DISTINCT security_id) AS k FROM signal GROUP BY 1)""")
add("coverage_series", "date_sig rows securities average:r", lambda s, d: performance.coverage_series(P(s, d).signal),
    """SELECT *, avg(securities) OVER () AS average FROM (
       SELECT date_sig, count(*) AS rows, count(DISTINCT security_id) AS securities FROM signal GROUP BY 1)""")

# --- turnover and cost -------------------------------------------------------------------------------------------


def _traded(s, d, model="naive"):
    return _run(s, d, _config(tc_model=model)).traded


add("turnover", "n turnover:r", lambda s, d: cost.turnover(cost.weight_changes(_held(s, d), G), G), "FROM turnover", BT)
add("tc_naive", "security_id n change:r cost:r",
    lambda s, d: _traded(s, d).withColumn("cost", cost.naive_cost() * F.col("change")),
    "SELECT *, (CASE WHEN cap = 1 THEN 2.0e0 WHEN cap = 2 THEN 5.0e0 ELSE 10.0e0 END) / 10000 * change AS cost FROM traded", BT)
add("tc_power_law", "security_id n change:r cost:r",
    lambda s, d: _traded(s, d, "power_law").withColumn("cost", cost.power_law_cost() * F.col("change")),
    """SELECT c.*, 0.35e0 * r.vol * pow(10e6 * c.change / nullif(r.adv, 0), 0.4e0) / nullif(r.close_adj, 0) * c.change AS cost FROM traded c
       LEFT JOIN ret r ON r.security_id = c.security_id AND r.date = c.date""", BT)
add("tc_daily", "n tc:r",
    lambda s, d: cost.daily_cost(_traded(s, d), cost.naive_cost(), G), "FROM costs", BT)
add("turnover_panel", "date n turnover:r", lambda s, d: _run(s, d).daily, "FROM daily", BT)

# --- residuals and regressions -----------------------------------------------------------------------------------


def _prepared(s, d, factors=("value",)):
    return bt.prepared(P(s, d).signal, P(s, d).ret, P(s, d).risk, P(s, d).dates, _config(factors=list(factors)))


RD = "PARTITION BY signal_name, date"
add("resid_industry", f"{KEY} signal:r", lambda s, d: regress.resid_industry(_prepared(s, d), ["signal_name", "date"]),
    f"SELECT security_id, date, round(signal - avg(signal) OVER ({RD}, industry_id), 9) AS signal FROM prepared", Q.prepared())


def one_factor(keys: str) -> str:
    y, x = f"signal - avg(signal) OVER ({keys})", f"value - avg(value) OVER ({keys})"
    return f"""SELECT security_id, date, round(y - (sum(x * y) OVER ({RD})) / (sum(x * x) OVER ({RD}) + 1e-10) * x, 9) AS signal
      FROM (SELECT *, {y} AS y, {x} AS x FROM prepared)"""


add("resid_factor", f"{KEY} signal:r", lambda s, d: regress.resid_factor(_prepared(s, d), ["signal_name", "date"], ["value"]), one_factor(RD), Q.prepared())
add("resid_all", f"{KEY} signal:r", lambda s, d: regress.resid_all(_prepared(s, d), ["signal_name", "date"], ["value"]), one_factor(f"{RD}, industry_id"), Q.prepared())
REGRESSORS = ["size", "value", "growth", "leverage", "volatility"]


def many_factors(keys: str, style: str) -> str:
    """Least squares by orthogonalising one regressor after the other, which is what all of them at once give."""
    centred = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {keys}) AS {n}" for c, n in [("signal", "y"), *((x, f"x{i}") for i, x in enumerate(REGRESSORS))])
    sql = f"SELECT security_id, date, signal_name, {centred} FROM with_factors"
    for i in range(len(REGRESSORS)):
        rest = ["y", *(f"x{j}" for j in range(i + 1, len(REGRESSORS)))]
        less = ", ".join(f"{c} - (sum({c} * x{i}) OVER ({RD})) / nullif(sum(x{i} * x{i}) OVER ({RD}), 0) * x{i} AS {c}" for c in rest)
        sql = f"SELECT security_id, date, signal_name, {less} FROM ({sql})"
    return f"SELECT '{style}' AS resid, security_id, date, round(y, 9) AS signal FROM ({sql})"


add("resid_pipeline", f"resid {KEY} signal:r",
    lambda s, d: regress.residualize(_prepared(s, d, REGRESSORS), ["signal_name", "date"], ["off", "industry", "factor", "all"], REGRESSORS),
    f"""SELECT 'off' AS resid, security_id, date, signal FROM with_factors
        UNION ALL SELECT 'industry', security_id, date, round(signal - avg(signal) OVER ({RD}, industry_id), 9) FROM with_factors
        UNION ALL {many_factors('signal_name, date', 'factor')} UNION ALL {many_factors('signal_name, date, industry_id', 'all')}""",
    f"{Q.prepared()}, with_factors AS (SELECT p.signal_name, p.security_id, p.date, p.signal, p.industry_id, {', '.join('k.' + x for x in REGRESSORS)} "
    "FROM prepared p JOIN risk k ON k.security_id = p.security_id AND k.date = p.date_sig)")
MB = f"SELECT {Q.G}, count(*) AS n, regr_intercept(ret, market_ret) * 252 AS alpha, regr_slope(ret, market_ret) AS beta, regr_r2(ret, market_ret) AS r2, regr_intercept(ret, market_ret) / sqrt(s2 * (1.0e0 / count(*) + pow(avg(market_ret), 2) / regr_sxx(ret, market_ret))) AS t_alpha, regr_slope(ret, market_ret) / sqrt(s2 / regr_sxx(ret, market_ret)) AS t_beta FROM daily JOIN market USING (date) GROUP BY ALL"
MB = MB.replace("s2", "((regr_syy(ret, market_ret) - pow(regr_sxy(ret, market_ret), 2) / regr_sxx(ret, market_ret)) / (count(*) - 2))")
add("market_beta", f"{GK} n alpha:r beta:r r2:r t_alpha:r t_beta:r", lambda s, d: regress.market_beta(_run(s, d, YEARS).daily, P(s, d).market, G), MB, BT_YEARS)


def _factor_model(s, d):
    return regress.factor_model(_run(s, d).daily.select("date", "ret"), _factor_tables(s, d), "ff3")


def three_factors() -> str:
    """Normal equations of ret on three centred factors, solved by cofactors."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    minor = lambda i, j: "({} * {} - {} * {})".format(*(g((i + a) % 3, (j + b) % 3) for a, b in ((1, 1), (2, 2), (1, 2), (2, 1))))
    inverse = lambda i, j: f"({minor(i, j)} / det)"
    beta = [" + ".join(f"{inverse(i, j)} * r{j}" for j in range(3)) for i in range(3)]
    means = " + ".join(f"m{i} * m{j} * {inverse(i, j)}" for i in range(3) for j in range(3))
    return f"""fm_rows AS (
      SELECT date, ret * 252 AS y, "mkt-rf" * 252 AS x0, smb * 252 AS x1, hml * 252 AS x2 FROM daily JOIN ({FACTOR_SQL}) USING (date)
    ), fm_means AS (SELECT count(*) AS n, avg(y) AS my, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2 FROM fm_rows),
    fm_sums AS (
      SELECT any_value(n) AS n, any_value(my) AS my, {', '.join(f'any_value(m{i}) AS m{i}' for i in range(3))},
             {', '.join(f'sum((x{i} - m{i}) * (x{j} - m{j})) AS g{i}{j}' for i, j in pairs)},
             {', '.join(f'sum((x{i} - m{i}) * (y - my)) AS r{i}' for i in range(3))}, sum((y - my) * (y - my)) AS yy
      FROM fm_rows, fm_means
    ), fm_det AS (SELECT *, {' + '.join(f'{g(0, j)} * {minor(0, j)}' for j in range(3))} AS det FROM fm_sums),
    fm_beta AS (SELECT *, {', '.join(f'{b} AS b{i}' for i, b in enumerate(beta))} FROM fm_det),
    fm_fit AS (
      SELECT *, my - b0 * m0 - b1 * m1 - b2 * m2 AS a, (yy - b0 * r0 - b1 * r1 - b2 * r2) / (n - 4) AS s2 FROM fm_beta
    ), fm AS (
      {' UNION ALL '.join(f"SELECT '{name}' AS name, b{i} AS coef, sqrt(s2 * {inverse(i, i)}) AS std_err FROM fm_fit" for i, name in enumerate(("mkt-rf", "smb", "hml")))}
      UNION ALL SELECT 'alpha', a, sqrt(s2 * (1.0e0 / n + {means})) FROM fm_fit
    )"""


FM = f"{BT}, {three_factors()}"
add("factor_model_alpha", "name coef:r std_err:r t:r", lambda s, d: _factor_model(s, d)[0], "SELECT *, coef / std_err AS t FROM fm", FM)
add("factor_model_pvalues", "name p:r", lambda s, d: _factor_model(s, d)[0])


def _factor_models(s, d):
    return regress.factor_models(_run(s, d, YEARS).daily.select(*G, "date", "ret"), _factor_tables(s, d), ["smb", "hml"], G)


#: Normal equations of ret on two centred factors, for each group.
GROUPED = f"""fg_rows AS (
  SELECT {Q.G}, date, ret * 252 AS y, smb * 252 AS x0, hml * 252 AS x1 FROM daily JOIN ({FACTOR_SQL}) USING (date)
), fg_sums AS (
  SELECT {Q.G}, count(*) AS n, avg(y) AS my, avg(x0) AS m0, avg(x1) AS m1, covar_pop(x0, x0) * count(*) AS g00, covar_pop(x0, x1) * count(*) AS g01,
         covar_pop(x1, x1) * count(*) AS g11, covar_pop(x0, y) * count(*) AS r0, covar_pop(x1, y) * count(*) AS r1, covar_pop(y, y) * count(*) AS yy
  FROM fg_rows GROUP BY ALL
), fg_beta AS (
  SELECT *, (g11 * r0 - g01 * r1) / (g00 * g11 - g01 * g01) AS b0, (g00 * r1 - g01 * r0) / (g00 * g11 - g01 * g01) AS b1 FROM fg_sums
), fg_fit AS (
  SELECT *, my - b0 * m0 - b1 * m1 AS a, (yy - b0 * r0 - b1 * r1) / (n - 3) AS s2, g00 * g11 - g01 * g01 AS det FROM fg_beta
), fg AS (
  SELECT {Q.G}, 'smb' AS name, b0 AS coef, sqrt(s2 * g11 / det) AS std_err FROM fg_fit UNION ALL SELECT {Q.G}, 'hml', b1, sqrt(s2 * g00 / det) FROM fg_fit
  UNION ALL SELECT {Q.G}, 'alpha', a, sqrt(s2 * (1.0e0 / n + (m0 * m0 * g11 - 2 * m0 * m1 * g01 + m1 * m1 * g00) / det)) FROM fg_fit
)"""
FG = f"{BT_YEARS}, {GROUPED}"
add("factor_models_grouped", f"{GK} name coef:r std_err:r t:r", lambda s, d: _factor_models(s, d)[0], "SELECT *, coef / std_err AS t FROM fg", FG)
add("daily_alphas_grouped", f"{GK} date alpha:r cum_alpha:r", lambda s, d: _factor_models(s, d)[1],
    f"""SELECT *, sum(alpha) OVER (PARTITION BY {Q.G} ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum_alpha FROM (
        SELECT {Q.G}, date, (y - b0 * x0 - b1 * x1) / 252 AS alpha FROM fg_rows JOIN fg_fit USING ({Q.G}))""", FG)
add("daily_alpha_series", "date alpha:r cum_alpha:r", lambda s, d: _factor_model(s, d)[1],
    """SELECT date, alpha, sum(alpha) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum_alpha FROM (
       SELECT date, (y - b0 * x0 - b1 * x1 - b2 * x2) / 252 AS alpha FROM fm_rows, fm_fit)""", FM)

# --- information coefficients and correlations -------------------------------------------------------------------


def _ic(s, d):
    return performance.information_coefficients(joins.forward_returns(E(s, d).signal, E(s, d).ret), ["date_sig"], "signal", "forward_ret")


IC = f"""SELECT date_sig, {Q.correlation('x', 'y')} AS ic, count(*) AS pairs FROM (
  SELECT *, {Q.average_rank('signal', 'date_sig')} AS x, {Q.average_rank('forward_ret', 'date_sig')} AS y FROM (
  SELECT s.*, r.ret AS forward_ret FROM e_signal s JOIN e_ret r ON r.security_id = s.security_id AND r.date = s.date_avail + 1))
  GROUP BY date_sig HAVING count(*) >= 10"""
add("ic_daily", "date_sig ic:r pairs", _ic, IC)
add("ic_trading_days", "date_sig ic:r pairs",
    lambda s, d: performance.information_coefficients(joins.forward_returns(E(s, d).signal, E(s, d).ret, dates=E(s, d).dates), ["date_sig"], "signal", "forward_ret"),
    IC.replace("JOIN e_ret r ON r.security_id = s.security_id AND r.date = s.date_avail + 1", """JOIN e_dates a ON a.date = s.date_avail
      JOIN e_dates b ON b.n = a.n + 1 JOIN e_ret r ON r.security_id = s.security_id AND r.date = b.date"""))
add("ic_stats", "mean:r std:r t:r hit_rate:r ir:r n", lambda s, d: performance.ic_stats(_ic(s, d)),
    f"""SELECT avg(ic) AS mean, stddev_pop(ic) AS std, coalesce(avg(ic) / nullif(stddev_pop(ic) / sqrt(count(ic)), 0), 0) AS t,
        avg(CAST(ic > 0 AS DOUBLE)) * 100 AS hit_rate, coalesce(avg(ic) / nullif(stddev_pop(ic), 0), 0) AS ir, count(ic) AS n FROM ({IC})""")
add("moving_average", "date_sig ic_ma:r", lambda s, d: performance.moving_average(_ic(s, d).withColumn("series", F.lit(1)), ["series"], "ic", 21, "date_sig"),
    f"SELECT date_sig, avg(ic) OVER (ORDER BY date_sig ROWS 20 PRECEDING) AS ic_ma FROM ({IC})")


def _ic_by_group(s, d):
    df = portfolio.slices(_prepared(s, d), ["cap"])
    daily = performance.several_coefficients(df, ["grp", "date"], "signal", ["ret", "resret"], 10)
    return daily.groupBy("grp").agg(F.avg("ret").alias("retIC"), F.avg("resret").alias("resretIC"))


add("ic_by_group", "grp retIC:r resretIC:r", _ic_by_group,
    f"""SELECT grp, avg(a) AS retIC, avg(b) AS resretIC FROM (SELECT grp, date, {Q.correlation('x', 'y')} AS a, {Q.correlation('x', 'z')} AS b FROM (
        SELECT *, {Q.average_rank('signal', 'grp, date')} AS x, {Q.average_rank('ret', 'grp, date')} AS y, {Q.average_rank('resret', 'grp, date')} AS z
        FROM (SELECT *, {Q.CAP} AS grp FROM prepared)) GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY grp""", Q.prepared())


def _with_baseline(s, d):
    p = P(s, d)
    others = baselines.all_baselines(p.ret, p.risk).select(F.col("signal_name").alias("baseline"), "security_id", "date_sig", F.col("signal").alias("other"))
    return p.signal.join(others, ["security_id", "date_sig"])


def _signal_corr(s, d):
    daily = performance.information_coefficients(_with_baseline(s, d), ["baseline", "date_sig"], "signal", "other")
    return daily.groupBy("baseline").agg(F.avg("ic").alias("signal_corr"))


SIGNAL_CORR = f"""SELECT baseline, avg(ic) AS signal_corr FROM (SELECT baseline, date_sig, {Q.correlation('x', 'y')} AS ic FROM (
  SELECT *, {Q.average_rank('signal', 'baseline, date_sig')} AS x, {Q.average_rank('other', 'baseline, date_sig')} AS y FROM (
  SELECT s.security_id, s.date_sig, s.signal, b.signal_name AS baseline, b.signal AS other FROM signal s
  JOIN ({REVERSAL} UNION ALL {VALUE}) b USING (security_id, date_sig))) GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY baseline"""
add("signal_correlation", "baseline signal_corr:r", _signal_corr, SIGNAL_CORR)


def _both(s, d):
    return _run(s, d, signal=P(s, d).signal.unionByName(P(s, d).price_signal)).daily


BOTH = Q.backtest(signal="(SELECT * FROM signal UNION ALL SELECT * FROM price)")
PNL = f"SELECT count(*) AS days, CASE WHEN count(*) > 10 THEN {Q.correlation('a.ret', 'b.ret')} END AS corr FROM daily a JOIN daily b USING (date) WHERE a.signal_name = 'quantity' AND b.signal_name = 'price'"
add("pnl_correlation", "days corr:r", lambda s, d: (lambda x: suite.pnl_correlation(x.where("signal_name = 'quantity'"), x.where("signal_name = 'price'")))(_both(s, d)), PNL, BOTH)


def _correlations(s, d):
    x = _both(s, d)
    pnl = suite.pnl_correlation(x.where("signal_name = 'quantity'"), x.where("signal_name = 'price'"))
    own = performance.information_coefficients(
        P(s, d).signal.join(P(s, d).price_signal.select("security_id", "date_sig", F.col("signal").alias("other")), ["security_id", "date_sig"]),
        ["date_sig"], "signal", "other",
    ).agg(F.avg("ic").alias("signal_corr"))
    return own.crossJoin(F.broadcast(pnl)).select(F.lit("price").alias("baseline"), "signal_corr", F.col("corr").alias("pnl_corr"))


add("correlation_table", "baseline signal_corr:r pnl_corr:r", _correlations,
    f"""SELECT 'price' AS baseline, (SELECT avg(ic) FROM (SELECT {Q.correlation('x', 'y')} AS ic FROM (
        SELECT s.date_sig, {Q.average_rank('s.signal', 's.date_sig')} AS x, {Q.average_rank('p.signal', 's.date_sig')} AS y
        FROM signal s JOIN price p USING (security_id, date_sig)) GROUP BY date_sig HAVING count(*) >= 10)) AS signal_corr, corr AS pnl_corr FROM ({PNL})""", BOTH)


def _pooled(s, d):
    risk = P(s, d).risk.select("security_id", F.col("date").alias("date_sig"), *FACTORS)
    return P(s, d).signal.join(risk, ["security_id", "date_sig"])


add("factor_correlation", "factor corr:r pairs", lambda s, d: suite.factor_correlation(_pooled(s, d), FACTORS),
    " UNION ALL ".join(f"SELECT '{c}' AS factor, {Q.correlation('signal', c)} AS corr, count(*) AS pairs FROM signal s JOIN risk k ON k.security_id = s.security_id AND k.date = s.date_sig HAVING count(*) >= 100" for c in FACTORS))

# --- baselines ---------------------------------------------------------------------------------------------------

add("reversal_signal", SIG, lambda s, d: baselines.reversal(P(s, d).ret), REVERSAL)
add("momentum_signal", SIG, lambda s, d: baselines.momentum(P(s, d).ret, rows=52, skipped=4),
    """SELECT security_id, date AS date_sig, CAST(date + 1 AS DATE) AS date_avail, a - b AS signal FROM (SELECT security_id, date,
       CASE WHEN count(ret) OVER v = 52 THEN product(1 + ret) OVER v - 1 END AS a, CASE WHEN count(ret) OVER w = 4 THEN product(1 + ret) OVER w - 1 END AS b
       FROM ret WINDOW v AS (PARTITION BY security_id ORDER BY date ROWS 51 PRECEDING), w AS (PARTITION BY security_id ORDER BY date ROWS 3 PRECEDING))
       WHERE a - b IS NOT NULL""")
add("value_signal", SIG, lambda s, d: baselines.value(None, P(s, d).risk), VALUE)
add("all_baselines", f"signal_name {SIG}", lambda s, d: baselines.all_baselines(P(s, d).ret, P(s, d).risk), f"{REVERSAL} UNION ALL {VALUE}")

# --- the suite ---------------------------------------------------------------------------------------------------

GRID = _config(lags=(0, 1, 2), resid=("off", "industry"), byvars=("overall", "year", "cap"))
BT_GRID = Q.backtest(GRID.lags, GRID.resid, GRID.byvars, "(SELECT * FROM signal UNION ALL SELECT * FROM price)")


def _grid(s, d):
    return hold(bt.results(_run(s, d, GRID, P(s, d).signal.unionByName(P(s, d).price_signal)).summary))  # a row a group


def _summary(s, d):
    return suite.suite_summary(_grid(s, d))


HEAD = "sharpe:r ann_ret:r max_dd:r turnover:r"
SUITE = "SELECT * FROM results WHERE byvar = 'overall'"
BEST = f"SELECT * FROM ({SUITE}) QUALIFY row_number() OVER (PARTITION BY signal_name ORDER BY sharpe DESC NULLS LAST, config) = 1"
add("run_backtest", f"{GK} {STATS} turnover:r", lambda s, d: _run(s, d, _config(byvars=("overall", "year", "cap"))).summary, "FROM summary",
    Q.backtest(byvars=("overall", "year", "cap")))
STYLES = _config(resid=("off", "industry", "factor", "all"), byvars=("overall", "cap"), factors=["value"])
add("run_backtest_residuals", f"{GK} {STATS} turnover:r", lambda s, d: _run(s, d, STYLES).summary, "FROM summary", Q.backtest(resid=STYLES.resid, byvars=STYLES.byvars))
add("run_grid", f"{GK} {HEAD}", _grid, "FROM results", BT_GRID)
add("suite_summary", f"signal_name config type {HEAD}", _summary, SUITE, BT_GRID)
add("best_config", f"signal_name config {HEAD}", lambda s, d: suite.best_config(_summary(s, d)), BEST, BT_GRID)
add("headline_metrics", f"signal_name {HEAD}", lambda s, d: suite.best_config(_summary(s, d)), BEST, BT_GRID)
PARSED = f"SELECT *, CAST(regexp_extract(config, '^lag(\\d+)_resid(.*)$', 1) AS INTEGER) AS lag, regexp_extract(config, '^lag(\\d+)_resid(.*)$', 2) AS resid FROM ({SUITE})"
add("lag_sensitivity", "signal_name config lag resid sharpe:r kept:r decays", lambda s, d: suite.lag_sensitivity(_summary(s, d)),
    f"SELECT *, sharpe / nullif(zero, 0) AS kept, sharpe / nullif(zero, 0) < 0.5 AS decays FROM (SELECT *, max(sharpe) FILTER (lag = 0) OVER (PARTITION BY signal_name, resid) AS zero FROM ({PARSED}))", BT_GRID)


def _of_best(kind):
    def of(s, d):
        grid = _grid(s, d)
        best = suite.best_config(suite.suite_summary(grid)).select("signal_name", "config")
        return grid.where(f"byvar = '{kind}'").join(best, ["signal_name", "config"], "left_semi")

    return of


def of_best(kind: str) -> str:
    return f"SELECT r.* FROM results r SEMI JOIN ({BEST}) USING (signal_name, config) WHERE byvar = '{kind}'"


add("cap_breakdown", f"signal_name config grp {HEAD}", _of_best("cap"), of_best("cap"), BT_GRID)
add("year_breakdown", f"signal_name config grp {HEAD}", lambda s, d: clean.year_groups(_of_best("year")(s, d)), f"{of_best('year')} AND try_cast(grp AS INTEGER) BETWEEN 2000 AND 2030", BT_GRID)
add("filter_year_groups", f"{GK} sharpe:r", lambda s, d: clean.year_groups(_grid(s, d)), "SELECT * FROM results WHERE try_cast(grp AS INTEGER) BETWEEN 2000 AND 2030", BT_GRID)
add("resid_impact", "signal_name lag before:r after:r delta:r kept_pct:r", lambda s, d: suite.resid_impact(_summary(s, d), "industry"),
    f"""SELECT a.signal_name, a.lag, a.sharpe AS before, b.sharpe AS after, b.sharpe - a.sharpe AS delta, b.sharpe / nullif(a.sharpe, 0) * 100 AS kept_pct
        FROM ({PARSED}) a JOIN ({PARSED}) b USING (signal_name, lag) WHERE a.resid = 'off' AND b.resid = 'industry'""", BT_GRID)
add("default_config", "signal_name config", lambda s, d: suite.default_config(_summary(s, d)),
    f"SELECT signal_name, min_by(config, (CASE WHEN config = 'lag0_residoff' THEN 'a' WHEN starts_with(config, 'lag0') THEN 'b' ELSE 'c' END) || config) AS config FROM ({SUITE}) GROUP BY 1", BT_GRID)
add("decile_excess", "signal_name fractile excess:r monotonic spread:r", lambda s, d: suite.decile_excess(_profile(s, d)),
    f"""SELECT signal_name, fractile, ret - avg(ret) OVER e AS excess, bool_and(up) OVER e AS monotonic,
        max_by(ret, fractile) OVER e - min_by(ret, fractile) OVER e AS spread
        FROM (SELECT *, coalesce(ret > lag(ret) OVER (PARTITION BY signal_name ORDER BY fractile), true) AS up FROM ({profile_sql()}))
        WINDOW e AS (PARTITION BY signal_name)""", Q.prepared())


def _facts(s, d):
    """Sharpes grow tenfold so that all colours can occur; correlations are those of the pooled factors."""
    grid = _grid(s, d).withColumns({"sharpe": F.col("sharpe") * 3, "turnover": F.col("turnover") * 2})
    summary = suite.suite_summary(grid)
    best = suite.best_config(summary).select("signal_name", "config")
    groups = grid.where("byvar <> 'overall'").join(best, ["signal_name", "config"], "left_semi")
    corr = suite.factor_correlation(_pooled(s, d), ["size", "value"])
    base = corr.where("factor = 'value'").select(F.lit("quantity").alias("signal_name"), "corr")
    fact = corr.select(F.lit("price").alias("signal_name"), "corr")
    return suite.signal_facts(summary, groups, base, fact)


POOLED = "SELECT abs({}) FROM signal s JOIN risk k ON k.security_id = s.security_id AND k.date = s.date_sig"
_at = lambda lag, resid: f"max(sharpe) FILTER (lag = {lag} AND resid = '{resid}')"
FACTS = f"""SELECT f.*, g.* EXCLUDE (signal_name), CASE WHEN signal_name = 'quantity' THEN ({POOLED.format(Q.correlation('signal', 'value'))}) END AS baseline_corr,
  CASE WHEN signal_name = 'price' THEN greatest(({POOLED.format(Q.correlation('signal', 'size'))}), ({POOLED.format(Q.correlation('signal', 'value'))})) END AS factor_corr
  FROM (SELECT signal_name, max(sharpe) AS sharpe, max_by(max_dd, sharpe) AS max_dd, max_by(turnover, sharpe) AS turnover,
        {', '.join(f'{_at(k, "off")} AS lag{k}' for k in (0, 1, 2, 3, 5))}, {_at(0, 'industry')} AS industry
        FROM (SELECT * REPLACE (sharpe * 3 AS sharpe, turnover * 2 AS turnover) FROM ({PARSED})) GROUP BY 1) f
  LEFT JOIN (SELECT signal_name, max(sharpe) FILTER (byvar = 'cap' AND grp = 'LargeCap') AS large, max(sharpe) FILTER (byvar = 'cap' AND grp = 'SmallCap') AS small,
        count(sharpe) FILTER (byvar = 'year') AS years, count(*) FILTER (byvar = 'year' AND sharpe < 0) AS bad_years,
        count(*) FILTER (byvar = 'year' AND sharpe > 0) AS good_years
        FROM (SELECT r.* REPLACE (sharpe * 3 AS sharpe) FROM results r SEMI JOIN ({BEST}) USING (signal_name, config) WHERE byvar <> 'overall') GROUP BY 1) g USING (signal_name)"""
_lag0 = "CASE WHEN lag0 > 0 THEN lag0 END"
VERDICT = f"""SELECT signal_name, CASE WHEN sharpe IS NULL OR sharpe < 0.5 THEN 'red'
    WHEN sharpe >= 1 AND coalesce(decay, industry_bet, alike, caps, years_bad) IS NULL THEN 'green' ELSE 'yellow' END AS verdict,
  concat_ws('; ', CASE WHEN sharpe IS NULL THEN 'no result' WHEN sharpe < 0.5 THEN 'weak sharpe' WHEN sharpe < 1 THEN 'moderate sharpe' END,
    decay, industry_bet, alike, caps, years_bad, CASE WHEN factor_corr > 0.3 THEN 'factor exposure' END,
    CASE WHEN sharpe >= 0.5 AND turnover > 2 THEN 'high turnover' END, CASE WHEN sharpe >= 0.5 AND max_dd < -0.3 THEN 'large drawdown' END) AS reasons
  FROM (SELECT *, CASE {' '.join(f"WHEN lag{k} / ({_lag0}) < {t} THEN 'decays at lag {k}'" for k, t in suite.DECAY)} END AS decay,
    CASE WHEN industry / ({_lag0}) < 0.5 THEN 'industry bet' END AS industry_bet, CASE WHEN baseline_corr > 0.5 THEN 'like a baseline' END AS alike,
    CASE WHEN large > 0 AND small / large > 2 THEN 'small caps dominate' WHEN large <= 0 AND small > 0.5 THEN 'works in small caps only' END AS caps,
    CASE WHEN years >= 2 AND 2 * bad_years >= years THEN 'half the years negative' END AS years_bad FROM ({FACTS}))"""
add("verdict", "signal_name verdict reasons", lambda s, d: suite.verdict(_facts(s, d)), VERDICT, BT_GRID)
_pc = lambda x: f"least(greatest(({x}) * 100, 0), 100)"
SCORE = f"""SELECT *, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT signal_name, round(0.25e0 * coalesce({_pc('sharpe / 2')}, 0) + 0.15e0 * CASE WHEN lag0 > 0 AND lag2 IS NOT NULL THEN {_pc('lag2 / lag0')} ELSE 100 END
    + 0.15e0 * CASE WHEN lag0 > 0 AND industry IS NOT NULL THEN {_pc('industry / lag0')} ELSE 100 END
    + 0.15e0 * CASE WHEN baseline_corr IS NOT NULL THEN {_pc('1 - baseline_corr / 0.5')} ELSE 100 END
    + 0.10e0 * CASE WHEN small > 0 AND large > 0 THEN {_pc('large / small')} WHEN small > 0 AND large <= 0 THEN 0 ELSE 100 END
    + 0.10e0 * CASE WHEN years >= 2 THEN {_pc('good_years / years')} ELSE 100 END
    + 0.10e0 * CASE WHEN factor_corr IS NOT NULL THEN {_pc('1 - factor_corr / 0.3')} ELSE 100 END, 6) AS score FROM ({FACTS}))"""
add("composite_score", "signal_name score:r grade", lambda s, d: suite.composite_score(_facts(s, d)), SCORE, BT_GRID)


def _metrics(s, d, name):
    df = _summary(s, d).where(f"signal_name = '{name}'").where("config <> 'lag1_residoff'" if name == "price" else "true")
    return df.select(F.concat(F.lit("sharpe_"), "config").alias("metric"), F.col("sharpe").alias("value"))


add("compare_runs", "metric a:r b:r diff:r pct_diff:r better", lambda s, d: suite.compare_runs(_metrics(s, d, "quantity"), _metrics(s, d, "price")),
    f"""SELECT *, b - a AS diff, (b - a) / nullif(abs(a), 0) * 100 AS pct_diff,
        CASE WHEN b IS NULL THEN 'A only' WHEN a IS NULL THEN 'B only' WHEN b > a THEN 'B' WHEN b < a THEN 'A' ELSE 'Same' END AS better FROM (
        SELECT 'sharpe_' || x.config AS metric, x.sharpe AS a, y.sharpe AS b FROM (SELECT * FROM ({SUITE}) WHERE signal_name = 'quantity') x
        LEFT JOIN (SELECT * FROM ({SUITE}) WHERE signal_name = 'price' AND config <> 'lag1_residoff') y ON x.config = y.config)""", BT_GRID)


def _two(s, d):
    x = _both(s, d)
    return x.where("signal_name = 'quantity'"), x.where("signal_name = 'price'")


add("overlay_series", "run date cumret:r", lambda s, d: suite.overlay(*_two(s, d)),
    "SELECT CASE signal_name WHEN 'quantity' THEN 'A' ELSE 'B' END AS run, date, cumret FROM daily", BOTH)
add("cumret_diff", "date diff:r", lambda s, d: suite.cumret_diff(*_two(s, d)),
    "SELECT a.date, b.cumret - a.cumret AS diff FROM daily a JOIN daily b USING (date) WHERE a.signal_name = 'quantity' AND b.signal_name = 'price'", BOTH)


def _baselines(s, d):
    """The baselines, available on the next trading day; noise of their products would split ties."""
    p = P(s, d)
    found = baselines.all_baselines(p.ret, p.risk).drop("date_avail")
    return tc.infer_available(found.withColumn("signal", F.floor(F.col("signal") * 1e9 + 0.499) / 1e9), p.dates)


def _combined(s, d):
    """The daily series of all configurations and slices of both signals, and of the baselines by the default one."""
    signals = _run(s, d, GRID, P(s, d).signal.unionByName(P(s, d).price_signal)).daily.withColumn("type", F.lit("signal"))
    others = _run(s, d, _config(byvars=GRID.byvars), _baselines(s, d)).daily.withColumn("type", F.lit("baseline"))
    return signals.unionByName(others)


BASELINES = f"""(SELECT b.signal_name, b.security_id, b.date_sig, o.date AS date_avail, floor(b.signal * 1e9 + 0.499e0) / 1e9 AS signal
  FROM ({REVERSAL} UNION ALL {VALUE}) b JOIN dates c ON c.date = b.date_sig JOIN dates o ON o.n = c.n + 1)"""
add("combined_daily", f"{GK} type date ret:r cumret:r drawdown:r", _combined,
    f"""SELECT *, 'signal' AS type FROM daily
        UNION ALL SELECT *, 'baseline' AS type FROM (WITH {Q.backtest(byvars=GRID.byvars, signal=BASELINES)} SELECT * FROM daily)""", BT_GRID)


def _guarded(s, d):
    """Each column of the panel as a group variable: those that are refused, and the rows that the others group."""
    risk, out = P(s, d).risk, None
    for name in ("sector_id", "industry_id", "mcap", "adv", "value", "size"):
        try:
            part = portfolio.slices(risk, [name], FACTORS).agg(F.lit(name).alias("byvar"), F.lit("taken").alias("status"), F.count("*").alias("rows"))
        except ValueError:
            part = risk.agg(F.lit(name).alias("byvar"), F.lit("refused").alias("status"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


add("byvar_name_guard", "byvar status rows", _guarded,
    """SELECT byvar, status, (SELECT count(*) FROM risk) AS rows FROM (VALUES ('sector_id', 'taken'), ('industry_id', 'taken'),
       ('mcap', 'refused'), ('adv', 'refused'), ('value', 'refused'), ('size', 'refused')) t(byvar, status)""")

# --- fingerprints ------------------------------------------------------------------------------------------------

add("table_fingerprint", "component fingerprint", lambda s, d: audit.fingerprints(ret=P(s, d).ret, risk=P(s, d).risk))
add("partition_fingerprint", "year rows fingerprint", lambda s, d: audit.fingerprint(P(s, d).ret.withColumn("year", F.year("date")), ["year"]))


def _parts(s, d):
    return P(s, d).base.groupBy(F.year("date").cast("string").alias("component")).agg(F.sum("px").cast("string").alias("fingerprint"))


add("snapshot_fingerprint", "fingerprint", lambda s, d: audit.snapshot_fingerprint(_parts(s, d)),
    """SELECT substr(sha256(string_agg(component || ':' || fingerprint, '|' ORDER BY component || ':' || fingerprint)), 1, 12) AS fingerprint
       FROM (SELECT CAST(year(date) AS VARCHAR) AS component, CAST(sum(px) AS VARCHAR) AS fingerprint FROM p_base GROUP BY 1)""")


def _verify(s, d):
    p = P(s, d)
    now = audit.fingerprints(ret=p.ret, risk=p.risk, master=p.signal)
    was = audit.fingerprints(ret=p.ret.orderBy("ret"), risk=p.risk.where("cap = 1"), factors=p.signal)
    return audit.verify(now, was)


add("verify_integrity", "component status", _verify,
    """SELECT * FROM (VALUES ('ret', 'ok'), ('risk', 'changed'), ('master', 'extra'), ('factors', 'missing')) t(component, status)
       WHERE (SELECT count(*) FROM p_base) > 0""")
add("signal_hash", "signal_hash", lambda s, d: audit.signal_hash(P(s, d).signal))
