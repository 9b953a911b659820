"""What keeps large inputs apart: bucketed as-of joins, co-partitioned tables, grouped regressions, sketches, one-pass sums."""

import datetime as dt
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import joins, portfolio, regress, suite
from signalloom.sources import tables

DAY = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)Exchange ", plan))


@pytest.mark.parametrize("tolerance", [None, 9])
@pytest.mark.parametrize("days", [1, 7, 5000])
def test_bucketed_asof_equals_the_plain_one(spark, tolerance, days):
    rng = random.Random(days)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), DAY(rng.randrange(-80, 200)), i) for i in range(300)]
    right = list({(k, d): (k, d, rng.choice([None, 1.0, 2.0]), i) for i in range(60) for k, d in [(rng.choice([1, 2, None]), DAY(rng.randrange(-90, 190)))]}.values())
    a = spark.createDataFrame(left, "security_id int, date_sig date, i int")
    b = spark.createDataFrame(right, "security_id int, day date, x double, c int")
    how = ["security_id"], "date_sig", "day", ["x", "c"], tolerance
    known = a.where("security_id is not null"), b.where("security_id is not null")
    want = sorted(map(str, joins.asof_backward(*known, *how).collect()))
    assert sorted(map(str, joins.asof_bucketed(*known, *how, days=days).collect())) == want
    assert joins.asof_bucketed(a.limit(0), b, *how, days=days).count() == 0
    assert joins.asof_bucketed(a, b.limit(0), *how, days=days).where("x is not null").count() == 0


def test_a_key_that_holds_all_rows_is_spread_over_its_buckets(spark):
    left = spark.range(4000).select(F.lit(1).alias("k"), F.date_add(F.lit(DAY(0)), (F.col("id") % 800).cast("int")).alias("d"))
    right = spark.range(800).select(F.lit(1).alias("k"), F.date_add(F.lit(DAY(0)), F.col("id").cast("int")).alias("day"), "id")
    out = joins.asof_bucketed(left, right, ["k"], "d", "day", ["id"], days=20)
    assert out.where(F.datediff("d", F.lit(DAY(0))) != F.col("id")).count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [re.findall(r"\[([^\[\]]*)\], \[[^\[\]]*ASC", x)[0] for x in plan.splitlines() if " Window [" in x or x.startswith("Window [")]
    with_rows = [w for w in windows if "__bucket" in w]
    assert len(with_rows) == 1  # the window over the rows; the other has a row a bucket


def test_copartitioned_tables_are_joined_where_they_lie(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 50).cast("int").alias("security_id"), F.date_add(F.lit(DAY(0)), (F.col("id") / 50).cast("int")).alias("date"), (F.col("id") / 7).alias("ret"), F.lit(0.0).alias("resret"))
    made = [tables.write_bucketed(df, f"t_{uuid.uuid4().hex}", str(tmp_path / n), buckets=8) for n, df in (("ret", rows), ("risk", rows.select("security_id", "date", F.lit(1).alias("cap"))))]
    with_merge = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        master = joins.build_master(*made)
        assert exchanges(master) == 0 and master.count() == 2000
        signal = rows.select("security_id", F.col("date").alias("date_ret"), F.col("ret").alias("signal"))
        assert exchanges(joins.returns_on(signal, made[0])) == 1  # the signal's side alone
        assert exchanges(joins.returns_on(signal, rows)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_merge)


def test_grouped_models_equal_single_fits(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=(60, 3)) / 100
    library = spark.createDataFrame([(DAY(i), *map(float, f[i])) for i in range(60)], "date date, `mkt-rf` double, smb double, hml double")
    rows = []
    for g, (n, b) in {"a": (60, [1, 0.5, -2]), "b": (40, [0, 3, 1]), "short": (4, [1, 1, 1]), "few": (2, [1, 1, 1])}.items():
        y = 0.001 + f[:n] @ b + rng.normal(size=n) / 500
        rows += [(g, DAY(i), float(y[i])) for i in range(n)]
    rows += [("a", DAY(3), None), ("none", DAY(500), 1.0)]
    daily = spark.createDataFrame(rows, "g string, date date, ret double")
    table, alphas = regress.factor_models(daily, library, "ff3", ["g"])
    got = {(r.g, r.name): r for r in table.collect()}
    series = {g: [r.alpha for r in x] for g, x in ((g, alphas.where(F.col("g") == g).orderBy("date").collect()) for g in "ab")}
    for g in ("a", "b"):
        y = np.array([r[2] for r in rows if r[0] == g and r[2] is not None]) * 252
        x = np.c_[f[: len(y)] * 252, np.ones(len(y))]
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        rest = y - x @ beta
        error = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (rest @ rest) / (len(y) - 4))
        for name, b, e in zip(("mkt-rf", "smb", "hml", "alpha"), beta, error, strict=True):
            r = got[g, name]
            assert (r.coef, r.std_err, r.t) == pytest.approx((b, e, b / e), rel=1e-6)
            assert 0 <= r.p <= 1
        assert series[g] == pytest.approx((rest + beta[3]) / 252, abs=1e-9)
    assert got["short", "smb"].coef is not None and got["short", "smb"].std_err is None
    assert got["few", "smb"].coef is None and ("none", "smb") not in got
    one = {r.name: r.coef for r in regress.factor_model(daily.where("g = 'b'"), library, "ff3")[0].collect()}
    assert one == pytest.approx({n: got["b", n].coef for n in ("mkt-rf", "smb", "hml", "alpha")})


def test_collinear_and_constant_factors_have_no_coefficients(spark):
    rows = [(g, DAY(i), float(i % 7), float(i), 2.0 * i if g == "double" else 5.0 if g == "constant" else float(i * i % 11)) for g in ("double", "constant", "good") for i in range(20)]
    fits = {r.g: r for r in regress.ols(spark.createDataFrame(rows, "g string, d date, y double, a double, b double"), ["g"], "y", ["a", "b"]).collect()}
    assert fits["double"].coef == fits["constant"].coef == [None] * 3 and None not in fits["good"].coef
    assert regress.ols(spark.createDataFrame([], "g string, y double, a double"), ["g"], "y", ["a"]).count() == 0


def test_many_factors_are_one_aggregate(spark):
    rng = np.random.default_rng(1)
    names = [f"x{i}" for i in range(19)]
    data = rng.normal(size=(120, 20))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{c} double" for c in ["y", *names]))
    got = regress.ols(df, [], "y", names).first()
    want, *_ = np.linalg.lstsq(np.c_[data[:, 1:], np.ones(120)], data[:, 0], rcond=None)
    assert got.coef == pytest.approx(list(want))


def test_sketched_quantiles_are_as_near_as_stated(spark):
    values = np.random.default_rng(2).lognormal(size=20_000)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(values)] + [(0, None), (2, None)], "g int, x double")
    for accuracy in (100, 2000):
        out = portfolio.winsorize(df, "x", ["g"], 95.0, accuracy).where("x is not null").toPandas()
        for g in (0, 1):
            own = np.sort(values[g::2])
            for end, q in ((out[out.g == g].x.min(), 0.05), (out[out.g == g].x.max(), 0.95)):
                assert abs(np.searchsorted(own, end) / len(own) - q) <= 1 / accuracy + 2 / len(own)
    assert portfolio.winsorize(df, "x", ["g"], 95.0, 100).where("x is null").count() == 2
    exact = portfolio.winsorize(df.where("g = 1"), "x", ["g"]).agg(F.min("x")).first()[0]
    assert exact == pytest.approx(np.quantile(values[1::2], 0.05))


def test_pair_sums_do_not_multiply_the_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(float(s), float(s + e) if i % 9 else None, None) for i, (s, e) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "signal double, a double, b double")
    got = suite.factor_correlation(df, ["a", "b"]).collect()
    pairs = np.array([r[:2] for r in rows if r[1] is not None], float)
    assert [(r.factor, r.pairs) for r in got] == [("a", len(pairs))]
    assert got[0].corr == pytest.approx(np.corrcoef(pairs.T)[0, 1])
    plan = suite.factor_correlation(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
