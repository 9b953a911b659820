"""Residuals and regressions.

Regressions per day go through sums of products, which Spark combines before the shuffle; only a day's small normal
equations are solved in Python, a batch of days at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.stats import two_sided_p
from signalloom.operators.cost import running

#: Residuals are rounded to so many decimals: ties that a subtraction would split by the order of summation stay ties.
DECIMALS = 9


def demean(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def _whole(*columns: str) -> Column:
    """Whether none of the columns is null."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def resid_industry(df: DataFrame, day: Sequence[str], y: str = "signal", industry: str = "industry_id") -> DataFrame:
    """Residual on industry dummies: the distance from the industry's mean of the day; null without an industry."""
    df = df.withColumn(y, F.when(_whole(industry), F.col(y)))
    return demean(df, [*day, industry], [y]).withColumn(y, F.round(y, DECIMALS))


def _fits(df: DataFrame, day: Sequence[str], ys: Sequence[str], xs: Sequence[Sequence[str]], ridge: float) -> DataFrame:
    """(day, __b0, __b1, ...): the coefficients of each y on its own xs within day, in that order, null where it is singular.

    The sums of products of all regressions are one aggregate, and a batch of days is solved at once.
    """
    k = len(xs[0])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = []
    for at, (y, own) in enumerate(zip(ys, xs, strict=True)):
        sums += [F.sum(F.col(own[i]) * F.col(own[j])).alias(f"__g{at}_{i}_{j}") for i, j in pairs]
        sums += [F.sum(F.col(x) * F.col(y)).alias(f"__r{at}_{i}") for i, x in enumerate(own)]
    gram = df.groupBy(*day).agg(*sums)
    betas = [f"__b{at}_{i}" for at in range(len(ys)) for i in range(k)]

    def solve(frames):
        for pdf in frames:
            out = pdf[list(day)].copy()
            for at in range(len(ys)):
                g, r = np.zeros((len(pdf), k, k)), np.zeros((len(pdf), k, 1))
                for i, j in pairs:
                    g[:, i, j] = g[:, j, i] = pdf[f"__g{at}_{i}_{j}"].to_numpy(float)
                for i in range(k):
                    r[:, i, 0] = pdf[f"__r{at}_{i}"].to_numpy(float)
                g += ridge * np.eye(k)
                try:
                    beta = np.linalg.solve(g, r)
                except np.linalg.LinAlgError:  # some day is singular: that one has no fit
                    beta = np.stack([np.linalg.solve(a, b) if np.linalg.det(a) else np.full_like(b, np.nan) for a, b in zip(g, r, strict=True)])
                out = out.assign(**{f"__b{at}_{i}": beta[:, i, 0] for i in range(k)})
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in day), *(f"{b} double" for b in betas)])
    return gram.mapInPandas(solve, schema).select(*day, *(F.when(~F.isnan(b), F.col(b)).alias(b) for b in betas))


def ols_residual(df: DataFrame, day: Sequence[str], y: str, xs: Sequence[str], ridge: float = 1e-10) -> DataFrame:
    """y less its least-squares fit on xs within day; the columns are taken as centred. Null where it is singular."""
    fits = _fits(df, day, [y], [xs], ridge)
    fit = sum((F.col(f"__b0_{i}") * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    return df.join(fits, list(day)).withColumn(y, F.round(F.col(y) - fit, DECIMALS)).drop(*(c for c in fits.columns if c not in day))


def ols_residuals(df: DataFrame, day: Sequence[str], within: dict[str, Sequence[str]], xs: Sequence[str], ridge: float = 1e-10) -> DataFrame:
    """Each column of within less its least-squares fit on xs, by day, column and factors being centred by day and the
    columns that within names for it. Rows with nulls in what a regression needs, and singular days, have null there.

    The regressions share one aggregate and one join, so what df takes to compute is computed twice, however many they are.
    """
    if not within:
        return df
    ys, centred = list(within), {}
    for at, (y, more) in enumerate(within.items()):
        w, whole = Window.partitionBy(*day, *more), _whole(y, *more, *xs)
        for name, c in ((f"__y{at}", y), *((f"__x{at}_{i}", x) for i, x in enumerate(xs))):
            value = F.when(whole, F.col(c))
            centred[name] = value - F.avg(value).over(w)
    df = df.withColumns(centred)
    own = [[f"__x{at}_{i}" for i in range(len(xs))] for at in range(len(ys))]
    fits = _fits(df, day, [f"__y{at}" for at in range(len(ys))], own, ridge)
    df = df.join(fits, list(day))
    for at, y in enumerate(ys):
        fit = sum((F.col(f"__b{at}_{i}") * F.col(f"__x{at}_{i}") for i in range(len(xs))), F.lit(0.0))
        df = df.withColumn(y, F.round(F.col(f"__y{at}") - fit, DECIMALS))
    return df.drop(*centred, *(c for c in fits.columns if c not in day))


def resid_factor(df: DataFrame, day: Sequence[str], xs: Sequence[str], y: str = "signal") -> DataFrame:
    """Residual on factors and an intercept; the factors keep their values. Rows with nulls take no part."""
    return ols_residuals(df, day, {y: []}, xs)


def resid_all(df: DataFrame, day: Sequence[str], xs: Sequence[str], y: str = "signal", industry: str = "industry_id") -> DataFrame:
    """Residual on factors and industry dummies: all are demeaned by industry, then regressed without intercept."""
    return ols_residuals(df, day, {y: [industry]}, xs)


def residualize(df: DataFrame, day: Sequence[str], styles: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """A row for each style (off, industry, factor, all) in column resid; rows with nulls leave all but off.

    The residuals are columns of one pass over df; the rows are multiplied after that.
    """
    value = {style: "signal" if style == "off" else f"__of_{style}" for style in styles}
    whole = _whole("signal", "industry_id", *xs)
    df = df.withColumns({c: F.when(whole, F.col("signal")) for s, c in value.items() if s != "off"})
    if "industry" in value:
        df = resid_industry(df, day, value["industry"])
    within = {"factor": [], "all": ["industry_id"]}
    df = ols_residuals(df, day, {value[s]: how for s, how in within.items() if s in value}, xs)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("resid"), F.col(c).alias("signal")) for s, c in value.items())))
    rest = [c for c in df.columns if c not in ("signal", "resid", *value.values())]
    df = df.select(*rest, each.alias("__each")).select(*rest, "__each.*")
    return df.where((F.col("resid") == "off") | F.col("signal").isNotNull())


def market_beta(daily: DataFrame, market: DataFrame, keys: Sequence[str], days: int = 252) -> DataFrame:
    """alpha (annual), beta, r2, and the t- and p-values of alpha and beta, of ret on market_ret, by keys."""
    df = daily.join(market, "date")
    n, b = F.count("*"), F.regr_slope("ret", "market_ret")
    sxx, syy, sxy = F.regr_sxx("ret", "market_ret"), F.regr_syy("ret", "market_ret"), F.regr_sxy("ret", "market_ret")
    out = df.groupBy(*keys).agg(
        n.alias("n"),
        F.regr_intercept("ret", "market_ret").alias("__a"),
        b.alias("beta"),
        F.regr_r2("ret", "market_ret").alias("r2"),
        sxx.alias("__sxx"),
        (syy - F.try_divide(sxy * sxy, sxx)).alias("__sse"),
        F.avg("market_ret").alias("__mean"),
    )
    s2 = F.try_divide(F.col("__sse"), F.col("n") - 2)
    se_b = F.sqrt(F.greatest(F.try_divide(s2, "__sxx"), F.lit(0.0)))
    se_a = F.sqrt(F.greatest(s2 * (F.try_divide(F.lit(1.0), "n") + F.try_divide(F.col("__mean") * F.col("__mean"), "__sxx")), F.lit(0.0)))
    return out.select(
        *keys,
        "n",
        (F.col("__a") * days).alias("alpha"),
        "beta",
        "r2",
        F.try_divide("__a", se_a).alias("t_alpha"),
        F.try_divide("beta", se_b).alias("t_beta"),
    ).withColumns({f"p_{c}": two_sided_p(F.col(f"t_{c}"), F.col("n") - 2) for c in ("alpha", "beta")})


#: The factors of each model; the last has all columns of the library but the market and the riskless rate.
FACTOR_SETS = {
    "capm": ["mkt-rf"],
    "ff3": ["mkt-rf", "smb", "hml"],
    "ff5": ["mkt-rf", "smb", "hml", "rmw", "cma"],
    "ff7": ["mkt-rf", "smb", "hml", "rmw", "cma", "mom", "st_rev"],
}
ALL_BUT_MARKET = "ff7_industry"


def factors_in(model: str | Sequence[str], library: DataFrame) -> list[str]:
    """The columns of a named model, or the names themselves."""
    if not isinstance(model, str):
        return list(model)
    if model == ALL_BUT_MARKET:
        return [c for c in library.columns if c not in ("date", "mkt-rf", "rf")]
    return FACTOR_SETS[model]


def _normal_equations(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """(keys, n, __m, __r, __g): rows, means of xs and y, and the centred sums of products of xs with y and with each other, one row
    for each pair of xs from the first on. One aggregate, whose parts merge before the shuffle."""
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*(F.avg(c) for c in [*xs, y])).alias("__m"),
        F.array(*(F.covar_pop(x, y) for x in [*xs, y])).alias("__r"),
        F.array(*(F.covar_pop(xs[i], xs[j]) for i, j in pairs)).alias("__g"),
    )


def _least_squares(n: np.ndarray, m: np.ndarray, r: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors, the intercept's last, of many regressions; NaN where the factors are collinear.

    m, r and g are as _normal_equations has them, as averages over the rows.
    """
    k = m.shape[1] - 1
    gram = np.zeros((len(n), k, k))
    i, j = np.triu_indices(k)
    gram[:, i, j] = gram[:, j, i] = g
    scale = np.sqrt(np.einsum("nii->ni", gram))
    with np.errstate(all="ignore"):
        unit = gram / scale[:, :, None] / scale[:, None, :]
        good = np.isfinite(unit).all(axis=(1, 2)) & (n > k)
        unit[~good] = np.eye(k)
        least = np.linalg.eigvalsh(unit)[:, 0] if k else np.ones(len(n))
        good &= least > 1e-12
        unit[~good] = np.eye(k)
        inverse = np.linalg.inv(unit) / scale[:, :, None] / scale[:, None, :]
        beta = np.einsum("nij,nj->ni", inverse, r[:, :k])
        rest = np.maximum(r[:, k] - (beta * r[:, :k]).sum(axis=1), 0)
        s2 = rest * n / np.where(n > k + 1, n - k - 1, np.nan)  # of single rows
        intercept = m[:, k] - (beta * m[:, :k]).sum(axis=1)
        of_mean = 1 / n + np.einsum("ni,nij,nj->n", m[:, :k], inverse, m[:, :k]) / n
        error = np.sqrt(s2[:, None] * np.c_[np.einsum("nii->ni", inverse) / n[:, None], of_mean])
        found = np.c_[beta, intercept]
        found[~good], error[~good] = np.nan, np.nan
    return found, error


def ols(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """(keys, n, coef array, std_err array) of y on xs and an intercept, which comes last, a row for each group.

    Rows with nulls take no part. A group has no coefficients where its factors are collinear or no more than its rows, and no
    errors where no row is left over. All groups are one aggregate and are solved in batches.
    """
    kinds = dict(df.dtypes)

    def solve(frames):
        for pdf in frames:
            n, m, r, g = (pdf["n"].to_numpy(float), *(np.array(pdf[c].tolist(), float).reshape(len(pdf), -1) for c in ("__m", "__r", "__g")))
            coef, error = _least_squares(n, m, r, g)
            yield pdf[[*keys, "n"]].assign(coef=list(coef), std_err=list(error))

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, coef array<double>, std_err array<double>"])
    equations = _normal_equations(df.where(_whole(y, *xs)), keys, y, xs).where("n > 0")
    no_nan = lambda c: F.transform(c, lambda x: F.when(~F.isnan(x), x)).alias(c)
    return equations.mapInPandas(solve, schema).select(*keys, "n", no_nan("coef"), no_nan("std_err"))


def factor_models(
    daily: DataFrame, factors: DataFrame, model: str | Sequence[str], keys: Sequence[str] = (), days: int = 252
) -> tuple[DataFrame, DataFrame]:
    """(coefficient table, daily alphas) of the annualised returns of each group of keys on annualised factors.

    The model is a named one or a list of factors, which are joined by date. The table has (keys, name, coef, std_err, t, p), a
    row a factor and one called alpha; the alphas (keys, date, alpha, cum_alpha). See ols for groups without coefficients:
    they have rows of nulls.
    """
    names, keys = factors_in(model, factors), list(keys)
    inputs = [f"__f{i}" for i in range(len(names))]
    known = factors.select("date", *((F.col(f"`{c}`") * days).alias(f) for c, f in zip(names, inputs, strict=True)))
    rows = daily.join(known, "date").select(*keys, "date", (F.col("ret") * days).alias("__y"), *inputs)
    rows = rows.dropna(subset=["__y", *inputs])
    fits = ols(rows, keys, "__y", inputs)
    each = F.posexplode(F.arrays_zip("coef", "std_err")).alias("at", "x")
    table = fits.select(*keys, "n", each).select(
        *keys,
        "n",
        F.get(F.array(*map(F.lit, [*names, "alpha"])), F.col("at")).alias("name"),
        "x.coef",
        "x.std_err",
        F.try_divide("x.coef", "x.std_err").alias("t"),
    )
    table = table.withColumn("p", two_sided_p(F.col("t"), F.col("n") - len(names) - 1)).drop("n")
    beta = [F.get("coef", F.lit(i)) for i in range(len(names))]
    fit = sum((b * F.col(f) for b, f in zip(beta, inputs, strict=True)), F.lit(0.0))
    fitted = rows.join(fits.select(*keys, "coef"), keys) if keys else rows.crossJoin(F.broadcast(fits.select("coef")))  # one row
    alphas = fitted.select(*keys, "date", ((F.col("__y") - fit) / days).alias("alpha"))
    return table, alphas.withColumn("cum_alpha", F.sum("alpha").over(running(keys or [F.lit(0)])))  # a group's days


def factor_model(daily: DataFrame, factors: DataFrame, model: str | Sequence[str], days: int = 252) -> tuple[DataFrame, DataFrame]:
    """factor_models of one series."""
    return factor_models(daily, factors, model, (), days)
