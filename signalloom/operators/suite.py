"""Comparing configurations, scoring signals and comparing runs, over long tables of metrics.

The long table has (signal_name, config, type, grp, metric, value); configurations are called lag<k>_resid<style>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.stats import correlation, ratio

METRICS = ["sharpe", "ann_ret", "max_dd", "turnover"]


def config_key(lag: str | Column = "lag", resid: str | Column = "resid") -> Column:
    lag, resid = (F.col(x) if isinstance(x, str) else x for x in (lag, resid))
    return F.concat(F.lit("lag"), lag.cast("string"), F.lit("_resid"), resid)


def suite_summary(results: DataFrame) -> DataFrame:
    """One row a configuration or baseline: the overall group's headline metrics."""
    return results.where("byvar = 'overall' and grp = 'overall'").select("signal_name", "config", "type", *METRICS)


def best_config(summary: DataFrame, metric: str = "sharpe") -> DataFrame:
    """The configuration of each signal with the largest metric, nulls last, the first by name among equals."""
    w = Window.partitionBy("signal_name").orderBy(F.col(metric).desc_nulls_last(), "config")
    best = summary.where("type = 'signal'").withColumn("__nth", F.row_number().over(w)).where("__nth = 1")
    return best.drop("__nth")


def parsed(summary: DataFrame) -> DataFrame:
    pattern = r"^lag(\d+)_resid(.*)$"
    return summary.withColumns(
        {
            "lag": F.regexp_extract("config", pattern, 1).cast("int"),
            "resid": F.regexp_extract("config", pattern, 2),
        }
    )


def lag_sensitivity(summary: DataFrame) -> DataFrame:
    """Sharpe by lag, the share kept of lag 0, and whether more than half is lost."""
    df = parsed(summary.where("type = 'signal'"))
    base = Window.partitionBy("signal_name", "resid")
    zero = F.max(F.when(F.col("lag") == 0, F.col("sharpe"))).over(base)
    kept = ratio("sharpe", zero)
    return df.select("signal_name", "config", "lag", "resid", "sharpe", kept.alias("kept"), (kept < 0.5).alias("decays"))


def resid_impact(summary: DataFrame, style: str = "all") -> DataFrame:
    """Sharpe before and after residualisation at each lag, the difference and the percentage kept."""
    df = parsed(summary.where("type = 'signal'")).select("signal_name", "lag", "resid", "sharpe")
    before = df.where("resid = 'off'").select("signal_name", "lag", F.col("sharpe").alias("before"))
    after = df.where(F.col("resid") == style).select("signal_name", "lag", F.col("sharpe").alias("after"))
    both = before.join(after, ["signal_name", "lag"])
    return both.withColumns({"delta": F.col("after") - F.col("before"), "kept_pct": ratio("after", "before") * 100})


def default_config(summary: DataFrame) -> DataFrame:
    """lag0_residoff if there is one, else the first lag0 configuration, else the first."""
    order = F.when(F.col("config") == "lag0_residoff", 0).when(F.col("config").startswith("lag0"), 1).otherwise(2)
    return summary.groupBy("signal_name").agg(F.min_by("config", F.struct(order, "config")).alias("config"))


def signal_facts(
    summary: DataFrame, groups: DataFrame, baseline_corr: DataFrame, factor_corr: DataFrame
) -> DataFrame:
    """One row a signal: what the verdict and the score look at.

    groups: (signal_name, byvar, grp, sharpe) of the best configuration; correlations: (signal_name, corr).
    """
    s = parsed(summary.where("type = 'signal'"))
    at = lambda lag, resid="off": F.max(F.when((F.col("lag") == lag) & (F.col("resid") == resid), F.col("sharpe")))
    facts = s.groupBy("signal_name").agg(
        F.max("sharpe").alias("sharpe"),
        F.max_by("max_dd", "sharpe").alias("max_dd"),
        F.max_by("turnover", "sharpe").alias("turnover"),
        *(at(k).alias(f"lag{k}") for k in (0, 1, 2, 3, 5)),
        at(0, "industry").alias("industry"),
    )
    g = groups.groupBy("signal_name").agg(
        F.max(F.when((F.col("byvar") == "cap") & (F.col("grp") == "LargeCap"), F.col("sharpe"))).alias("large"),
        F.max(F.when((F.col("byvar") == "cap") & (F.col("grp") == "SmallCap"), F.col("sharpe"))).alias("small"),
        F.count(F.when(F.col("byvar") == "year", F.col("sharpe"))).alias("years"),
        F.count(F.when((F.col("byvar") == "year") & (F.col("sharpe") < 0), 1)).alias("bad_years"),
        F.count(F.when((F.col("byvar") == "year") & (F.col("sharpe") > 0), 1)).alias("good_years"),
    )
    top = lambda df, name: df.groupBy("signal_name").agg(F.max(F.abs("corr")).alias(name))
    for part in (g, top(baseline_corr, "baseline_corr"), top(factor_corr, "factor_corr")):
        facts = facts.join(part, "signal_name", "left")
    return facts


#: Lags and the share of the sharpe at lag 0 below which a signal decays.
DECAY = [(1, 0.7), (2, 0.6), (3, 0.5), (5, 0.4)]


def verdict(facts: DataFrame) -> DataFrame:
    """(signal_name, verdict, reasons): green, yellow or red.

    Red: no sharpe or below 0.5. Green: 1 and more and nothing against it; a factor correlation is told but does not
    count. The decay by lag is told once, at the first lag that breaks its threshold.
    """
    lag0 = F.when(F.col("lag0") > 0, F.col("lag0"))
    decay = F.lit(None).cast("string")
    for k, least in reversed(DECAY):
        decay = F.when(ratio(f"lag{k}", lag0) < least, F.lit(f"decays at lag {k}")).otherwise(decay)
    small = F.when((F.col("large") > 0) & (ratio("small", "large") > 2), "small caps dominate").when(
        (F.col("large") <= 0) & (F.col("small") > 0.5), "works in small caps only"
    )
    against = [
        decay,
        F.when(ratio("industry", lag0) < 0.5, "industry bet"),
        F.when(F.col("baseline_corr") > 0.5, "like a baseline"),
        small,
        F.when((F.col("years") >= 2) & (2 * F.col("bad_years") >= F.col("years")), "half the years negative"),
    ]
    told = [
        F.when(F.col("sharpe").isNull(), "no result").when(F.col("sharpe") < 0.5, "weak sharpe").when(F.col("sharpe") < 1, "moderate sharpe"),
        *against,
        F.when(F.col("factor_corr") > 0.3, "factor exposure"),
        F.when((F.col("sharpe") >= 0.5) & (F.col("turnover") > 2), "high turnover"),
        F.when((F.col("sharpe") >= 0.5) & (F.col("max_dd") < -0.3), "large drawdown"),
    ]
    clean = F.size(F.array_compact(F.array(*against))) == 0
    colour = (
        F.when(F.col("sharpe").isNull() | (F.col("sharpe") < 0.5), "red")
        .when((F.col("sharpe") >= 1) & clean, "green")
        .otherwise("yellow")
    )
    reasons = F.array_join(F.array_compact(F.array(*told)), "; ")
    return facts.select("signal_name", colour.alias("verdict"), reasons.alias("reasons"))


#: The weights of the parts of the composite score, each between 0 and 100.
SCORE_WEIGHTS = {
    "sharpe": 0.25,
    "lag_stability": 0.15,
    "resid_stability": 0.15,
    "baseline_uniqueness": 0.15,
    "cap_consistency": 0.10,
    "year_consistency": 0.10,
    "factor_uniqueness": 0.10,
}


def composite_score(facts: DataFrame) -> DataFrame:
    """(signal_name, score 0 to 100, grade A to F); a part that cannot be judged is perfect, a missing sharpe is 0."""
    percent = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x * 100, F.lit(0.0)), F.lit(100.0)))
    lag0 = F.when(F.col("lag0") > 0, F.col("lag0"))
    cap = F.when((F.col("small") > 0) & (F.col("large") > 0), percent(ratio("large", "small"))).when(
        (F.col("small") > 0) & (F.col("large") <= 0), 0.0
    )
    part = {
        "sharpe": F.coalesce(percent(F.col("sharpe") / 2), F.lit(0.0)),
        "lag_stability": percent(ratio("lag2", lag0)),
        "resid_stability": percent(ratio("industry", lag0)),
        "baseline_uniqueness": percent(1 - F.col("baseline_corr") / 0.5),
        "cap_consistency": cap,
        "year_consistency": F.when(F.col("years") >= 2, percent(F.col("good_years") / F.col("years"))),
        "factor_uniqueness": percent(1 - F.col("factor_corr") / 0.3),
    }
    score = sum((w * F.coalesce(part[name], F.lit(100.0)) for name, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    df = facts.select("signal_name", F.round(score, 6).alias("score"))
    s = F.col("score")
    grade = F.when(s >= 80, "A").when(s >= 65, "B").when(s >= 50, "C").when(s >= 35, "D").otherwise("F")
    return df.withColumn("grade", grade)


def decile_excess(profile: DataFrame) -> DataFrame:
    """Each fractile's return over the mean, whether returns rise throughout, and the spread of last over first."""
    every, order = Window.partitionBy("signal_name"), Window.partitionBy("signal_name").orderBy("fractile")
    df = profile.withColumn("__up", F.coalesce(F.col("ret") > F.lag("ret").over(order), F.lit(True)))
    return df.select(
        "signal_name",
        "fractile",
        (F.col("ret") - F.avg("ret").over(every)).alias("excess"),
        F.min("__up").over(every).alias("monotonic"),
        (F.max_by("ret", "fractile").over(every) - F.min_by("ret", "fractile").over(every)).alias("spread"),
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, diff, pct_diff, better) of the metrics of two runs, those of one run only too."""
    a, b = a.select("metric", F.col("value").alias("a")), b.select("metric", F.col("value").alias("b"))
    diff = F.col("b") - F.col("a")
    better = (
        F.when(F.col("b").isNull(), "A only").when(F.col("a").isNull(), "B only").when(diff > 0, "B").when(diff < 0, "A").otherwise("Same")
    )
    return a.join(b, "metric", "full_outer").select(
        "metric", "a", "b", diff.alias("diff"), (ratio(diff, F.abs("a")) * 100).alias("pct_diff"), better.alias("better")
    )


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("date", "cumret", F.lit("A").alias("run")).unionByName(b.select("date", "cumret", F.lit("B").alias("run")))


def cumret_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select("date", F.col("cumret").alias("__b"))
    return a.join(b, "date").select("date", (F.col("__b") - F.col("cumret")).alias("diff"))


def pnl_correlation(a: DataFrame, b: DataFrame, least: int = 10) -> DataFrame:
    """Pearson correlation of two daily series with more than ``least`` common days; null otherwise."""
    both = a.select("date", F.col("ret").alias("x")).join(b.select("date", F.col("ret").alias("y")), "date")
    out = both.agg(F.count("*").alias("days"), correlation("x", "y").alias("corr"))
    return out.select("days", F.when(F.col("days") > least, F.col("corr")).alias("corr"))


def factor_correlation(df: DataFrame, factors: list[str], least: int = 100) -> DataFrame:
    """Pooled correlation of signal with each factor over complete pairs, the strongest first."""
    whole = lambda c: F.count(F.when(F.col("signal").isNotNull() & F.col(c).isNotNull(), 1))
    sums = (F.struct(F.lit(c).alias("factor"), correlation("signal", F.col(c)).alias("corr"), whole(c).alias("pairs")) for c in factors)
    one = df.agg(F.array(*sums).alias("all"))  # one pass, with columns for each factor; the rows are not multiplied
    out = one.select(F.explode("all").alias("x")).select("x.*")
    return out.where(F.col("pairs") >= least).orderBy(F.abs("corr").desc())
