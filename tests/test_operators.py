"""Edge cases of the signal library, worked out by hand."""

import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F

from signalloom.functions.stats import average_rank, correlation, max_rank
from signalloom.operators import audit, clean, cost, joins, performance, portfolio, regress, suite
from signalloom.operators import trading_calendar as tc
from signalloom.plans import backtest as bt
from signalloom.sources import tables

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)  # noqa: E731  2024-01-01 is a Monday


def calendar(spark, days=20):
    rows = [DAY(i) for i in range(days) if DAY(i).weekday() < 5]
    return spark.createDataFrame([(d, n + 1) for n, d in enumerate(rows)], "date date, n int")


def test_ranks_of_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)], "k string, x double")
    got = df.select("k", "x", average_rank("x", ["k"]).alias("r"), max_rank("x", ["k"]).alias("m")).collect()
    assert sorted((r.k, r.x, r.r, r.m) for r in got) == [("a", 1, 1, 1), ("a", 2, 2.5, 3), ("a", 2, 2.5, 3), ("a", 3, 4, 4), ("b", 5, 1, 1)]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert df.agg(correlation("x", "y").alias("c")).first().c is None


def test_keep_last_prefers_values_and_drops_a_null_last_row(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 1, 7.0), (2, None, 8.0)], "id int, part int, x double")
    assert sorted(r.id for r in clean.last_complete(df, ["id"], ["part"]).collect()) == [2]
    assert clean.keep_last(df, ["id"], ["part"]).where("id = 2").first().x == 7.0


def test_normalize_turns_nan_to_null(spark):
    df = spark.createDataFrame([(1, DAY(0), float("nan"))], "security_id long, date date, ret double")
    row = clean.normalize_panel(df).first()
    assert row.ret is None and dict(clean.normalize_panel(df).dtypes)["security_id"] == "int"


def signal(spark, rows):
    return spark.createDataFrame(rows, "security_id int, date_sig date, date_avail date, signal double")


def test_weekend_availability_drops_out_or_is_carried(spark):
    rows = [(1, DAY(3), DAY(4), 1.0), (1, DAY(4), DAY(5), 2.0), (2, DAY(5), DAY(6), 3.0)]  # Friday, Saturday, Sunday
    df, dates = signal(spark, rows), calendar(spark)
    got = tc.align(df, dates).collect()
    assert [(r.signal, r.date_openret, r.date_ret) for r in got] == [(1.0, DAY(4), DAY(7))]
    got = {r.signal: (r.date_openret, r.date_ret) for r in tc.align_calendar_days(df, dates).collect()}
    assert got == {1.0: (DAY(4), DAY(7)), 2.0: (DAY(7), DAY(8))}


@pytest.mark.parametrize(("hour", "opening", "closing"), [(8, 1, 2), (9, 2, 2), (15, 2, 2), (16, 2, 3)])
def test_hours(spark, hour, opening, closing):
    row = tc.align(signal(spark, [(1, DAY(0), DAY(1), 1.0)]), calendar(spark), hour).first()
    assert (row.date_openret, row.date_ret) == (DAY(opening), DAY(closing))


def test_lags_make_a_row_each(spark):
    got = tc.align(signal(spark, [(1, DAY(0), DAY(0), 1.0)]), calendar(spark), 8, (0, 2)).collect()
    assert {(r.lag, r.date_ret) for r in got} == {(0, DAY(1)), (2, DAY(3))}


def test_validation_tells_what_is_wrong(spark):
    rows = [(1, DAY(1), DAY(0), 1.0), (2, DAY(1), DAY(1), float("inf")), (2, DAY(1), DAY(1), float("nan"))]
    good, errors = tc.validate(signal(spark, rows))
    assert not good and errors == ["duplicate_rows: 2", "infinite: 1", "missing: 1", "lookahead: 1"]
    assert tc.validate(signal(spark, []))[1] == ["no rows"]
    assert not tc.validate(spark.createDataFrame([(1,)], "security_id int"))[0]
    with pytest.raises(ValueError, match="lookahead"):
        tc.prepare(signal(spark, [(1, DAY(1), DAY(0), 1.0)]), calendar(spark))


def test_asof_tolerance_and_nulls_inside_the_row(spark):
    left = spark.createDataFrame([(1, DAY(10)), (1, DAY(11)), (2, DAY(0)), (3, DAY(4))], "security_id int, date_sig date")
    right = spark.createDataFrame([(1, DAY(1), 1.0, 9), (1, DAY(5), None, 8), (2, DAY(1), 3.0, 7), (3, DAY(4), 4.0, 6)], "security_id int, day date, x double, c int")
    got = joins.asof_backward(left, right, ["security_id"], "date_sig", "day", ["x", "c"], 5).collect()
    assert {(r.security_id, r.date_sig, r.x, r.c) for r in got} == {(1, DAY(10), None, 8), (1, DAY(11), None, None), (2, DAY(0), None, None), (3, DAY(4), 4.0, 6)}


def weights(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "k string, security_id int, n int, weight double")


def test_turnover_with_entry_exit_and_reentry(spark):
    rows = [(1, 1, 1.0), (2, 1, -1.0), (1, 2, 0.5), (3, 2, 0.5), (1, 4, 1.0)]
    changes = cost.weight_changes(weights(spark, rows), ["k"])
    got = {(r.security_id, r.n): r.change for r in changes.collect()}
    assert got == {(1, 1): 0, (2, 1): 0, (1, 2): 0.5, (2, 2): 1.0, (3, 2): 0.5, (1, 3): 0.5, (3, 3): 0.5, (1, 4): 1.0, (1, 5): 1.0}
    assert {r.n: r.turnover for r in cost.turnover(changes, ["k"]).collect()} == {1: 0, 2: 2.0, 4: 1.0}


def test_turnover_equals_the_outer_join(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(n), float(rng.normal())) for n in range(1, 8) for i in rng.choice(9, 5, replace=False)]
    w = weights(spark, rows)
    both = joins.previous_holdings(w, ["k"]).where("n > 1").selectExpr("n", "abs(coalesce(w, 0) - coalesce(w_before, 0)) d")
    want = {r[0]: r[1] for r in both.groupBy("n").sum("d").collect()}
    for row in cost.turnover(cost.weight_changes(w, ["k"]), ["k"]).where("n > 1").collect():
        assert row.turnover == pytest.approx(want[row.n])


def test_weights_sum_to_one_a_side(spark):
    rng = np.random.default_rng(1)
    rows = [("d", i, float(rng.normal()), float(rng.uniform(1, 9)), float(rng.uniform(1, 9))) for i in range(40)]
    df = spark.createDataFrame(rows, "day string, security_id int, signal double, mcap double, adv double")
    df = portfolio.percentile(df, ["day"]).withColumn("position", portfolio.position())
    for how in ("equal", "value", "volume"):
        got = portfolio.weigh(df, ["day"], how).groupBy("position").sum("weight").collect()
        assert {r[0]: round(r[1], 9) for r in got} == {-1: -1.0, 1: 1.0}


def test_slices_refuse_factor_names(spark):
    df = spark.createDataFrame([(1, DAY(0), 1), (2, DAY(0), None)], "security_id int, date date, cap int")
    with pytest.raises(ValueError, match="mcap"):
        portfolio.slices(df, ["mcap"])
    got = portfolio.slices(df, ["overall", "cap", "capyr"]).collect()
    assert sorted((r.security_id, r.grp) for r in got) == [(1, "LargeCap"), (1, "LargeCap_2024"), (1, "overall"), (2, "overall")]


def test_residuals_agree_with_lstsq_and_are_orthogonal(spark):
    rng = np.random.default_rng(2)
    rows = [("d", i % 3, *map(float, rng.normal(size=3))) for i in range(60)]
    df = spark.createDataFrame(rows, "day string, industry_id int, x1 double, x2 double, signal double")
    a = np.array([r[1:] for r in rows])
    dummies = np.stack([a[:, 0] == g for g in range(3)], axis=1).astype(float)
    for got, design in (
        (regress.resid_factor(df, ["day"], ["x1", "x2"]), np.c_[a[:, 1:3], np.ones(60)]),
        (regress.resid_all(df, ["day"], ["x1", "x2"]), np.c_[a[:, 1:3], dummies]),
    ):
        want = a[:, 3] - design @ np.linalg.lstsq(design, a[:, 3], rcond=None)[0]
        found = {round(r.x1, 9): r.signal for r in got.collect()}
        assert [found[round(x, 9)] for x in a[:, 1]] == pytest.approx(want.tolist(), abs=1e-6)
        assert np.abs(design.T @ want).max() < 1e-9


def test_drawdown_is_never_positive(spark):
    df = spark.createDataFrame([("s", DAY(i), r, r) for i, r in enumerate([0.1, -0.3, 0.1, 0.4])], "k string, date date, ret double, ret_net double")
    got = [round(r.drawdown, 6) for r in performance.cumulate(df, ["k"]).orderBy("date").collect()]
    assert got == [0, -0.3, -0.2, 0]


def test_verdict_thresholds(spark):
    columns = "signal_name string, sharpe double, max_dd double, turnover double, lag0 double, lag1 double, lag2 double, lag3 double, lag5 double, industry double, large double, small double, years long, bad_years long, good_years long, baseline_corr double, factor_corr double"
    good = (1.0, -0.1, 1.0, 1.0, 0.7, 0.6, 0.5, 0.4, 0.5, 1.0, 2.0, 4, 1, 3, 0.5, 0.3)
    change = lambda i, x: (*good[:i], x, *good[i + 1 :])
    rows = {
        "ok": good, "factor": change(15, 0.31), "decay": change(4, 0.69), "small": change(10, 2.1), "years": change(12, 2),
        "base": change(14, 0.51), "weak": change(0, 0.49), "half": change(0, 0.5), "none": change(0, None),
    }
    facts = spark.createDataFrame([(k, *v) for k, v in rows.items()], columns)
    got = {r.signal_name: r.verdict for r in suite.verdict(facts).collect()}
    assert got == {"ok": "green", "factor": "green", "decay": "yellow", "small": "yellow", "years": "yellow", "base": "yellow", "weak": "red", "half": "yellow", "none": "red"}
    scores = {r.signal_name: r for r in suite.composite_score(facts).collect()}
    # 50 * .25 + 60 * .15 + 50 * .15 + 0 + 50 * .1 + 75 * .1 + 0
    assert (scores["ok"].score, scores["ok"].grade) == (41.5, "D") and scores["none"].score == 29.0


def test_fingerprints_ignore_row_order(spark):
    df = spark.createDataFrame([(1, DAY(0), 1.0), (2, DAY(1), 2.0)], "security_id int, date date, ret double")
    one, two = (audit.fingerprint(x).first().fingerprint for x in (df, df.orderBy("ret", ascending=False)))
    assert one == two != audit.fingerprint(df.where("ret < 2")).first().fingerprint


def test_yearly_update_replaces_changed_years_only(spark, tmp_path):
    path = str(tmp_path / "ret")
    old = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.0), (1, dt.date(2021, 1, 1), 2.0)], "security_id int, date date, ret double")
    tables.write_yearly(old, path)
    before = {p.name for p in (tmp_path / "ret" / "year=2020").iterdir()}
    new = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.0), (1, dt.date(2021, 1, 1), 3.0), (1, dt.date(2022, 1, 1), 4.0)], old.schema)
    got = {r.year: r.status for r in tables.update_yearly(new, path).collect()}
    assert got == {2020: "same", 2021: "changed", 2022: "added"}
    assert {p.name for p in (tmp_path / "ret" / "year=2020").iterdir()} == before
    assert sorted(r.ret for r in tables.read_yearly(spark, path).collect()) == [1.0, 3.0, 4.0]


def test_nan_signals_never_get_a_rank(spark):
    rows = [(1, DAY(0), DAY(1), 1.0), (2, DAY(0), DAY(1), float("nan")), (3, DAY(0), DAY(1), None)]
    df, dates = signal(spark, rows), calendar(spark)
    assert [r.security_id for r in tc.prepare(df, dates).collect()] == [1]
    ret = spark.createDataFrame([(i, DAY(2), 0.1, 0.1) for i in (1, 2, 3)], "security_id int, date date, ret double, resret double")
    risk = spark.createDataFrame([(i, DAY(0), 1) for i in (1, 2, 3)], "security_id int, date date, cap int")
    got = bt.prepared(df.withColumn("signal_name", F.lit("s")), ret, risk, dates, bt.Config()).collect()
    assert [(r.security_id, r.cap) for r in got] == [(1, 1)]


def panels(spark, days=14, names=24, seed=5):
    """signal, ret, risk and dates of random securities on all days, with three industries and a factor."""
    rng = np.random.default_rng(seed)
    dates = [(DAY(i), i + 1) for i in range(days + 2)]
    keys = [(s, d) for s in range(names) for d, _ in dates]
    x = {k: tuple(float(v) for v in rng.normal(size=3)) for k in keys}
    signal_ = [("s", s, d, d, x[s, d][0] + 0.5 * x[s, d][1] + s % 3) for s, d in keys]
    ret = [(s, d, x[s, d][2], x[s, d][2] / 2) for s, d in keys]
    risk = [(s, d, s % 3, s % 2 + 1, x[s, d][1]) for s, d in keys]
    return (
        spark.createDataFrame(signal_, "signal_name string, security_id int, date_sig date, date_avail date, signal double"),
        spark.createDataFrame(ret, "security_id int, date date, ret double, resret double"),
        spark.createDataFrame(risk, "security_id int, date date, industry_id int, cap int, value double"),
        spark.createDataFrame(dates, "date date, n int"),
    )


def test_backtests_on_residuals_equal_a_plain_version(spark):
    """Sharpe and mean return of every residualisation, from positions to the daily series, in numpy."""
    frames = panels(spark)
    config = bt.Config(resid=("off", "industry", "factor", "all"), factors=["value"], mincos=1)
    result = bt.run(*frames, config)
    got = {r.config: r for r in result.summary.collect()}
    signal_, ret, risk, dates = (f.toPandas() for f in frames)
    day_of = dict(zip(dates["date"], dates["n"], strict=True))
    at = {n: d for d, n in day_of.items()}
    df = signal_.merge(risk.rename(columns={"date": "date_sig"}), on=["security_id", "date_sig"])
    df["date"] = [at.get(day_of[d] + 1) for d in df["date_avail"]]
    df = df.dropna(subset=["date"]).merge(ret, on=["security_id", "date"])
    for style in config.resid:
        daily = []
        for _, day in df.groupby("date"):
            dummies = np.eye(3)[day["industry_id"]]
            x = {"off": None, "industry": dummies, "factor": np.c_[np.ones(len(day)), day["value"]], "all": np.c_[dummies, day["value"]]}[style]
            y = day["signal"].to_numpy()
            y = y if x is None else y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            p = np.ceil((np.argsort(np.argsort(y)) + 1) * 100 / len(y))
            daily.append(day["ret"][p > 80].mean() - day["ret"][p <= 20].mean())
        mean = np.mean(daily) * 252
        row = got[f"lag0_resid{style}"]
        assert row.ret_ann == pytest.approx(mean) and row.ret_sharpe == pytest.approx(mean / (np.std(daily, ddof=1) * 252**0.5))
        assert row.num_date == len(daily)
    result.weights.unpersist()
    result.daily.unpersist()


def test_residuals_of_incomplete_rows_and_ties(spark):
    rows = [(1, 1, 0.1, 1.0), (2, 1, 0.1, 2.0), (3, 1, 0.3, 4.0), (4, 2, 0.7, None), (5, None, 0.9, 1.0), (6, 2, 0.7, 3.0)]
    df = spark.createDataFrame(rows, "id int, industry_id int, signal double, value double").withColumn("day", F.lit(1))
    got = {(r.resid, r.id): r.signal for r in regress.residualize(df, ["day"], ["off", "industry"], ["value"]).collect()}
    assert {i for s, i in got if s == "off"} == {1, 2, 3, 4, 5, 6} and {i for s, i in got if s == "industry"} == {1, 2, 3, 6}
    assert got["industry", 1] == got["industry", 2] and got["industry", 6] == 0


def test_singular_days_have_no_fit_and_spoil_no_other(spark):
    rows = [(1, float(i), 2.0 * i, 1.0 * i + (i == 2)) for i in range(4)] + [(2, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "day int, x double, unused double, y double")
    got = regress.ols_residual(df, ["day"], "y", ["x"], ridge=0.0).collect()
    assert all(r.y is None for r in got if r.day == 2) and all(r.y is not None for r in got if r.day == 1)


@pytest.mark.parametrize("n", [3, 4, 9, 30])
def test_p_values_equal_those_of_spark_ml(spark, n):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(n)
    rows = [("g", DAY(i), float(a), float(0.3 * a + b)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows, "g string, date date, market_ret double, ret double")
    got = regress.market_beta(df.drop("market_ret"), df.select("date", "market_ret"), ["g"]).first()
    fit = LinearRegression(featuresCol="x", labelCol="ret", solver="normal").fit(VectorAssembler(inputCols=["market_ret"], outputCol="x").transform(df))
    assert [got.t_beta, got.t_alpha] == pytest.approx(list(fit.summary.tValues))
    assert [got.p_beta, got.p_alpha] == pytest.approx(list(fit.summary.pValues), abs=1e-9)


def test_named_factor_models(spark):
    library = spark.createDataFrame([], "date date, `mkt-rf` double, smb double, hml double, rf double, nodur double")
    assert regress.factors_in("ff3", library) == ["mkt-rf", "smb", "hml"] and regress.factors_in(["smb"], library) == ["smb"]
    assert regress.factors_in("ff7_industry", library) == ["smb", "hml", "nodur"]


def test_runs_are_removed_with_all_their_parts(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    metrics = spark.createDataFrame([("c", "signal", "sharpe", 1.0)], "config string, type string, metric string, value double")
    daily = spark.createDataFrame([("c", "signal", DAY(0), 0.1)], "config string, type string, date date, ret double")
    more = spark.createDataFrame([("cap", "LargeCap", "sharpe", 1.0)], "byvar string, grp string, metric string, value double")
    for i in (1, 2, 3):
        tables.write_run(path, f"r{i}", f"2024-01-0{i}", {"signal": "s"}, metrics, daily, breakdowns=more if i < 3 else None)
    got = {r.run_id: r.status for r in tables.delete_runs(spark, path, ["r1", "r9", "r1", ""]).collect()}
    assert got == {"r1": "deleted", "r9": "failed", "": "failed"}
    for part, left in (("runs", {"r2", "r3"}), ("run_metrics", {"r2", "r3"}), ("run_daily", {"r2", "r3"}), ("run_breakdowns", {"r2"})):
        assert {r.run_id for r in spark.read.parquet(f"{path}/{part}").collect()} == left
    assert [r.run_id for r in tables.run_history(tables.published(spark, path), 1).collect()] == ["r3"]


def test_returns_so_many_trading_days_ahead(spark):
    df = signal(spark, [(1, DAY(3), DAY(4), 1.0), (1, DAY(4), DAY(5), 2.0)])  # available on Friday and Saturday
    ret = spark.createDataFrame([(1, DAY(i), float(i)) for i in range(10)], "security_id int, date date, ret double")
    got = joins.forward_returns(df, ret, 1, dates=calendar(spark)).collect()
    assert [(r.signal, r.forward_ret) for r in got] == [(1.0, 7.0)]
    assert sorted(r.forward_ret for r in joins.forward_returns(df, ret, 1).collect()) == [5.0, 6.0]
