"""Sums a day from columns of blocks are those of rows that windows rank, weigh and compare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import sections
from signalloom.plans import backtest as bt
from test_backtest_shuffles import over_new_year

HOWS = [
    {"resid": ("off", "industry"), "byvars": ("overall", "cap", "industry_id"), "lags": (0, 2)},
    {"resid": ("industry",), "byvars": ("cap", "year"), "tc_model": "power_law", "mincos": 2},
    {"byvars": ("overall", "own"), "long_only": True, "tc_model": "power_law", "from_open": True, "factors": ["value"]},
]


def frames(spark):
    """Two signals with ties, a security twice a day, days that are missing, and nulls in what slices, residuals and sums look at."""
    signal, ret, risk, dates = over_new_year(spark)
    more = signal.where("security_id % 3 = 0").withColumn("signal", F.col("signal") * 0)
    signal = signal.unionByName(more).where("(security_id + dayofyear(date_sig)) % 5 <> 0")
    signal = signal.unionByName(signal.withColumns({"signal_name": F.lit("other"), "signal": F.round(F.sin(F.col("signal") * 7), 1)}))
    gone = lambda c, k, of=7: F.when((F.col("security_id") + F.dayofyear("date")) % of != k, F.col(c))
    risk = risk.withColumns({"industry_id": gone("industry_id", 1), "cap": gone("cap", 2), "value": gone("security_id", 3) * 1.5})
    some = {"vol": F.lit(0.02), "adv": gone("security_id", 4) * 1e5, "close_adj": F.lit(20.0), "openret": F.col("ret") / 3, "resopenret": gone("ret", 5, 6)}
    return signal.withColumn("own", F.col("security_id") % 2), ret.withColumns(some), risk, dates


@pytest.mark.parametrize("how", HOWS)
@pytest.mark.parametrize("days", [2, 5])
def test_sums_are_those_of_windows(spark, monkeypatch, how, days):
    monkeypatch.setattr(bt, "BLOCK_DAYS", (days, days))
    config = bt.Config(**{"mincos": 1, "tolerance": None} | how)
    rows = []
    for summed in (bt._summed, lambda *x: False):
        monkeypatch.setattr(bt, "_summed", summed)
        result = bt.run(*frames(spark), config, keep=lambda x: x, rows=200)
        rows.append({tuple(r[k] for k in [*bt.KEYS, "n"]): r for r in result.daily.collect()})
    got, want = rows
    assert len(want) > 20 and got.keys() == want.keys()
    for k, w in want.items():
        assert set(w.asDict()) == set(got[k].asDict())
        for c, x in w.asDict().items():
            assert got[k][c] == (pytest.approx(x, abs=1e-11) if isinstance(x, float) else x), (k, c)


def test_rows_are_not_multiplied_by_residuals_and_slices(spark):
    """Windows are those that look up attributes and returns by security; cross-sections are ranked as columns."""
    config = bt.Config(lags=(0, 1, 2), resid=("off", "industry"), byvars=("overall", "year", "cap"), mincos=1)
    kept = []
    bt.run(*over_new_year(spark), config, keep=lambda x: kept.append(x) or x)
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    rank = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Window") and "signal_name" in x.split("],")[-2]]
    assert not rank and "MapInArrow" in plan


def test_sides_of_ties_and_odd_values():
    value = np.array([np.nan, 1.0, -0.0, 0.0, np.inf, np.nan, 2.0, 2.0, -np.inf, 3.0, 5.0])
    section = np.array([0] * 10 + [2])
    sides = lambda s, v, low, high: sections.sides(s, v, np.argsort(v), 3, low, high).tolist()
    # ranks 9.5, 4, 2.5, 2.5, 8, 9.5, 5.5, 5.5, 1, 7 of 10
    assert sides(section, value, 20, 80) == [1, 0, 0, 0, 0, 1, 0, 0, -1, 0, 1]
    assert sides(section, value, 25, 54) == [1, 0, -1, -1, 1, 1, 1, 1, -1, 1, 1]
    assert sides(section[:0], value[:0], 20, 80) == []


def test_residuals_that_a_sum_would_split_stay_ties():
    value, section = np.array([0.1, 0.2, 0.3, 0.7, 0.8, 1e300]), np.array([0, 0, 0, 1, 1, 2])
    got = sections.less_mean(section, value)
    assert got.tolist() == [-0.1, 0.0, 0.1, -0.05, 0.05, 0.0]


def test_the_limit_of_bytes_comes_back_with_the_next_query(spark):
    """It is checked after every row, which takes longer than the rows do; texts of other queries need it."""
    import __spark_entry__ as entry

    sections.restore_limit(spark)
    before = spark.conf.get(sections.BATCH_BYTES)
    bt.run(*over_new_year(spark), bt.Config(mincos=1), keep=lambda x: x)
    assert spark.conf.get(sections.BATCH_BYTES) == sections.NO_LIMIT != before
    entry.queries()["byvar_name_guard"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(sections.BATCH_BYTES) == before


def test_tasks_without_holdings_give_back_nothing(spark):
    """Also beside slices of the task that have some: too few names, or none."""
    signal, ret, risk, dates = over_new_year(spark)
    risk = risk.withColumn("cap", F.when(F.col("security_id") > 2, 1).otherwise(2))
    one = signal.where("security_id <= 3").withColumn("signal_name", F.lit("few"))
    config = bt.Config(byvars=("overall", "cap"), mincos=2, tolerance=None)
    result = bt.run(signal.unionByName(one), ret, risk, dates, config, keep=lambda x: x, rows=1)
    found = {(r.signal_name, r.grp) for r in result.day.select("signal_name", "grp").distinct().collect()}
    assert found and "few" not in {x for x, _ in found}
