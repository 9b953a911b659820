"""A backtest moves its rows three times, however many lags, residuals and slices it has, and slices by date share their work."""

import re

import pytest
from pyspark.sql import functions as F

from signalloom.operators import cost
from signalloom.plans import backtest as bt
from test_operators import panels


def moved(df):
    """The keys by which rows are shuffled, sums and broadcasts apart."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Broadcast)Exchange hashpartitioning\(([^)]*)\)", plan)


def over_new_year(spark):
    back = {"date_sig", "date_avail", "date"}
    return [f.withColumns({c: F.date_sub(c, 8) for c in back & set(f.columns)}) for f in panels(spark)]


def test_rows_are_not_shuffled_after_they_are_multiplied(spark):
    config = bt.Config(lags=(0, 1, 2), resid=("off", "industry"), byvars=("overall", "year", "cap", "capyr"), mincos=1)
    frames = panels(spark)
    with_broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = bt.run(*frames, config, keep=lambda x: x)
        keys = [re.sub(r"#\d+", "", x) for x in moved(result.weights)]
        assert sorted(k.rsplit(",", 1)[0] for k in keys) == ["security_id", "signal_name, lag, date"]
        traded = [re.sub(r"#\d+", "", x) for x in moved(result.traded)]
        assert sum(k.startswith("security_id, ") and "grp" in k for k in traded) == 1 and not any("security_id, date" in k for k in traded)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_broadcast)


@pytest.mark.parametrize("rows", [None, 400])
def test_parts_by_date_equal_slices_of_their_own(spark, rows):
    signal, *rest = over_new_year(spark)
    signal = signal.withColumn("own", F.year(F.date_add("date_avail", 2)))  # the year of the return
    result = bt.run(signal, *rest, bt.Config(lags=(1,), byvars=("year", "own", "cap", "capyr"), mincos=1), rows=rows)
    of = lambda b: {
        (r.config, r.grp, r.n): (r.ret, r.turnover, r.tc, r.cumret, r.n_long) for r in result.daily.where(F.col("byvar") == b).collect()
    }
    year, own = of("year"), of("own")
    assert len({g for _, g, _ in year}) == 2 and year.keys() == own.keys()
    assert all(year[k] == pytest.approx(own[k], abs=1e-12) for k in own)
    assert {g for _, g, _ in of("capyr")} == {f"{c}_{y}" for c in ("LargeCap", "MediumCap") for y in (2023, 2024)}
    names = {(r.byvar, r.grp): r["count"] for r in result.weights.groupBy("byvar", "grp").count().collect()}
    assert names["year", "2023"] == names["own", "2023"] and names["year", "2024"] == names["own", "2024"]
    for df in result.kept:
        df.unpersist()


def test_costs_use_the_tier_on_the_day_of_the_trade(spark):
    """A security that leaves is charged by its tier in the period after; one of unknown tier is small."""
    rows = [("k", 1, 1, 1.0, 1, 2), ("k", 2, 1, 1.0, 2, None), ("k", 1, 2, 0.25, 3, 1), ("k", 1, 2, 0.25, 3, 1)]
    w = spark.createDataFrame(rows, "k string, security_id int, n int, weight double, now_cap int, then_cap int")
    got = {(r.security_id, r.n): (r.change, r.held, r.cap) for r in cost.weight_changes(w, ["k"], ["cap"]).collect()}
    assert got == {(1, 1): (0, 1, 1), (2, 1): (0, 1, 2), (1, 2): (0.5, 1, 3), (2, 2): (1.0, 0, None), (1, 3): (0.5, 0, 1)}


def test_profiles_rank_the_rows_once(spark):
    from signalloom.operators import performance, portfolio

    rows = spark.range(60).select((F.col("id") % 3).alias("day"), "id", F.col("id").cast("double").alias("ret"), F.lit(0.0).alias("resret"))
    df = portfolio.fractiles(rows.withColumn("s", F.lit("s")), ["s", "day"], 4, "ret")
    out = performance.fractile_profile(df, ["s", "day"], mincos=1)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {r.fractile: r.numcos for r in out.collect()} == {1: 5, 2: 5, 3: 5, 4: 5}


def test_turnover_sorts_numbers_and_is_dealt_by_rows(spark):
    """Holdings are shuffled with a number for their group, not its names, to as many tasks as their rows need."""
    rows = [(c, g, i, n, 0.5, 1, 1) for c in ("lag0", "lag1") for g in ("x", "y") for i in (1, 2) for n in (1, 2)]
    w = spark.createDataFrame(rows, "config string, grp string, security_id int, n int, weight double, now_cap int, then_cap int")
    changes = cost.weight_changes(w, ["config", "grp"], ["cap"], tasks=7)
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    dealt = re.findall(r"RepartitionByExpression \[([^\]]*)\], (\d+)", plan)
    assert [(re.sub(r"#\d+", "", k), n) for k, n in dealt] == [("security_id, __grp", "7")]
    assert changes.where("change <> 0").count() == 8 and changes.columns[:4] == ["security_id", "config", "grp", "n"]


def test_sides_are_counted_in_the_order_of_the_ranks(spark):
    from signalloom.operators import portfolio

    df = spark.createDataFrame([("d", float(i), -1 if i < 2 else 1 if i > 4 else 0) for i in range(9)], "day string, signal double, position int")
    out = portfolio.weigh(portfolio.percentile(df, ["day"]), ["day"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Sort \[", plan)) == 1
    assert {r.weight for r in out.collect()} == {-0.5, 0.25}


def test_first_periods_are_not_looked_for_in_all_holdings(spark):
    """The first periods of groups come from the sums a day, which are kept."""
    result = bt.run(*panels(spark), bt.Config(mincos=1), keep=lambda x: x.limit(10**9))
    plan = result.traded._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"Aggregate \[[^\]]*\], \[[^\]]*min\(n#\d+\) AS __first", plan) and "AS first#" in plan


def test_correlations_with_several_columns_rank_the_signal_once(spark):
    from signalloom.operators import performance

    rows = [(d, float(i * 7 % 5), None if i % 4 == d else float(i * i % 11), None if i % 3 == 0 else float(i % 6)) for d in (0, 1) for i in range(24)]
    df = spark.createDataFrame([*rows, (2, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0)], "day int, s double, a double, b double")
    out = performance.several_coefficients(df, ["day"], "s", ["a", "b"])
    assert len(re.findall(r"Sort \[", out._jdf.queryExecution().executedPlan().toString())) == 3
    got = {r.day: (r.a, r.b) for r in out.collect()}
    one = lambda c: {r.day: r.ic for r in performance.information_coefficients(df, ["day"], "s", c).collect()}
    a, b = one("a"), one("b")
    assert got.keys() == a.keys() == b.keys() == {0, 1}
    assert all(got[d] == (pytest.approx(a[d], abs=1e-12), pytest.approx(b[d], abs=1e-12)) for d in got)


def test_days_and_summaries_move_rows_twice(spark):
    """The stack by security and cross-sections by blocks of days; holdings are not moved again, and nothing is held but sums."""
    config = bt.Config(lags=(0, 1, 2), resid=("off", "industry"), byvars=("overall", "year", "cap"), mincos=1)
    kept = []
    with_broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = bt.run(*panels(spark), config, keep=lambda x: kept.append(x) or x)
        keys = [re.sub(r"#\d+", "", x).rsplit(",", 1)[0] for x in moved(kept[0])]
        sums = ", ".join([*bt.KEYS, "n"])
        assert sorted(keys) == sorted(["security_id", "signal_name, lag, __block", sums]) and len(kept) == len(result.kept) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_broadcast)


BLOCKS = [(2, {}), (3, {"long_only": True, "mincos": 2}), (16, {"weight": "value", "resid": ("off", "all"), "factors": ["value"]})]


@pytest.mark.parametrize(("days", "how"), BLOCKS)
def test_blocks_of_days_equal_single_holdings(spark, monkeypatch, days, how):
    """Turnover, costs and sums of a day are those of the holdings and trades one by one, in whichever block they are."""
    monkeypatch.setattr(bt, "BLOCK_DAYS", (days, days))
    signal, ret, risk, dates = over_new_year(spark)
    signal = signal.unionByName(signal.where("security_id = 3").withColumn("signal", -F.col("signal")))  # a security twice a day
    signal = signal.where("(security_id + dayofyear(date_sig)) % 5 <> 0")
    risk = risk.withColumns({"mcap": F.col("security_id") * 1.5 + 1, "value": F.col("security_id") * F.col("security_id") % 7 * 1.0})
    result = bt.run(signal, ret, risk, dates, bt.Config(**{"lags": (0, 2), "byvars": ("overall", "cap"), "mincos": 1, "tolerance": None} | how))
    key = lambda r: (r.config, r.byvar, r.grp, r.n)
    day = {key(r): (r.ret, r.resret, r.n_long, r.n_short) for r in result.day.collect()}
    held = result.held.withColumns({c: F.col("weight") * F.col(c) for c in ("ret", "resret")}).groupBy(*bt.KEYS, "n")
    long, short = (F.count(F.when(c, 1)).alias(x) for c, x in ((F.col("weight") > 0, "a"), (F.col("weight") < 0, "b")))
    want = {key(r): (r.ret, r.resret, r.a, r.b) for r in held.agg(F.sum("ret").alias("ret"), F.sum("resret").alias("resret"), long, short).collect()}
    assert len(want) > 10 and day.keys() == want.keys() and all(day[k] == pytest.approx(want[k], abs=1e-11) for k in want)
    trades = cost.daily_trades(result.traded, cost.naive_cost(), [*bt.KEYS]).collect()
    first = {k[:3]: min(x[3] for x in want if x[:3] == k[:3]) for k in want}
    want = {key(r): (r.turnover or 0, r.tc) for r in trades if r.n > first[key(r)[:3]]}
    got = {key(r): (r.turnover, r.tc) for r in result.daily.collect() if key(r) in want}
    assert len(got) > 10 and any(x for x, _ in got.values()) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    for df in result.kept:
        df.unpersist()
