"""The backtest as one plan: lags, residualisations, slices and signals are columns, never loops."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.operators import cost, performance, portfolio, regress, sections, suite
from signalloom.operators import trading_calendar as tc

KEYS = ["signal_name", "config", "byvar", "grp"]
#: A day's cross-section; the lag, which config names too, is what rows are dealt by. Sorts begin with numbers, which tell most
#: rows apart before names are compared.
SECTION = ["date", "lag", *KEYS]


@dataclass
class Config:
    lags: Sequence[int] = (0,)
    resid: Sequence[str] = ("off",)
    byvars: Sequence[str] = ("overall",)
    weight: str = "equal"
    fractile: tuple[int, int] = (20, 80)
    mincos: int = 3
    tc_model: str = "naive"
    from_open: bool = False
    long_only: bool = False
    stretch: bool = False
    tolerance: int = 20
    factors: Sequence[str] = field(default_factory=list)


@dataclass
class Result:
    """Single holdings and trades are planned, and held, when they are asked for: days and summaries do not need them."""

    day: DataFrame
    names: DataFrame
    daily: DataFrame
    summary: DataFrame
    kept: list[DataFrame]
    holdings: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]

    @cached_property
    def _each(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.holdings()

    @property
    def weights(self) -> DataFrame:
        return self._each[0]

    @property
    def held(self) -> DataFrame:
        return self._each[1]

    @property
    def traded(self) -> DataFrame:
        return self._each[2]


#: What a cost model looks up on the day of a trade.
COST_COLUMNS = {"naive": ("cap",), "power_law": ("vol", "adv", "close_adj")}
#: Cross-sections are dealt so that a task has about so many rows, and to so many tasks at most.
TASK_ROWS, TASKS = 500_000, 2_000
#: Where holdings are compared with those of the day before, days are dealt in blocks of about so many rows, and of so many days.
BLOCK_ROWS, BLOCK_DAYS = 3_000_000, (2, 16)
#: The same where residuals and slices are columns, see sections.day_sums: a task has its rows in memory.
SUMMED_TASK_ROWS, SUMMED_BLOCK_ROWS = 250_000, 1_000_000
#: Rows of the stack for each row of the panel: a return, attributes, and signals.
STACKED = 4


def _tasks(df: DataFrame, rows: int, each: int = TASK_ROWS) -> int:
    """To how many tasks so many rows are dealt. Spark itself would go by compressed
    bytes, and rows are many times as large when they are sorted."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(rows // each, TASKS))


def _looked_up(signal: DataFrame, ret: DataFrame, risk: DataFrame, dates: DataFrame, config: Config, wanted: list[str], costs: bool, rows: int | None = None) -> DataFrame:
    """signal with the attributes wanted as of its day, the number __n of the day it is available on, and __at_lag: for each lag the
    returns of its day, or null, with what the cost model looks up on that day (now_...) and on the next one (then_...).

    Signals, attributes and returns are stacked, so one shuffle by security finds everything, before lags multiply the rows.
    A panel has one row a security and day.
    """
    days = F.broadcast(dates.select(F.col("date").alias("__day"), F.col("n").alias("__n")))
    # what the stack has as well is not moved twice, unless a union would change its type
    kinds = lambda name, *others: {dict(signal.dtypes)[name], *(dict(x.dtypes)[c] for c in others for x in (ret, risk))}
    dates_alike = len(kinds("date_sig", "date") | kinds("date_avail", "date")) == 1
    again = {"security_id": "security_id"} if len(kinds("security_id", "security_id")) == 1 else {}
    again |= {"date_sig": "__at", "date_avail": "__day"} if dates_alike else {}
    row = F.struct(*(F.col(c) for c in signal.columns if c not in again))
    names = ("openret", "resopenret") if config.from_open else ("ret", "resret")
    known = COST_COLUMNS[config.tc_model] if costs else ()
    of_ret = [c for c in known if config.tc_model == "power_law"]
    of_risk = list(dict.fromkeys([*wanted, *(c for c in known if c not in of_ret)]))
    gains = [F.col(c).alias(x) for c, x in zip(names, ("ret", "resret"), strict=True)]
    gains += [F.col(c).alias(f"__{c}") for c in of_ret]
    parts = [
        signal.select("security_id", F.col("date_sig").alias("__at"), F.col("date_avail").alias("__day"), F.lit(1).alias("__side"), row.alias("__left")),
        risk.select(
            "security_id",
            F.col("date").alias("__at"),
            F.col("date").alias("__day"),
            F.lit(0).alias("__side"),
            F.struct(F.col("date").alias("__since"), *of_risk).alias("__risk"),
        ),
        ret.select("security_id", F.col("date").alias("__day"), F.lit(2).alias("__side"), F.struct(*gains).alias("__ret")),
    ]
    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).join(days, "__day", "left")
    if rows is not None:
        df = df.repartition(_tasks(df, STACKED * rows), "security_id")
    before = Window.partitionBy("security_id").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__asof", F.last("__risk", ignorenulls=True).over(before)).where("__n is not null")

    ahead = lambda c, k: F.first(c, ignorenulls=True).over(Window.partitionBy("security_id").orderBy("__n").rangeBetween(k, k))
    first = 0 if config.from_open else 1
    offsets = sorted({first + lag + k for lag in config.lags for k in (0, 1)})
    df = df.withColumns(
        {f"__ret{k}": ahead("__ret", k) for k in offsets} | {f"__risk{k}": ahead("__risk", k) for k in offsets if known and not of_ret}
    )
    at = lambda c, k: F.col(f"__ret{k}.__{c}") if of_ret else F.col(f"__risk{k}.{c}")
    each = [
        F.struct(
            F.lit(int(lag)).alias("lag"),
            F.col(f"__ret{first + lag}").isNotNull().alias("known"),
            F.col(f"__ret{first + lag}.ret").alias("ret"),
            F.col(f"__ret{first + lag}.resret").alias("resret"),
            *(at(c, first + lag).alias(f"now_{c}") for c in known),
            *(at(c, first + lag + 1).alias(f"then_{c}") for c in known),
        )
        for lag in config.lags
    ]
    fresh = F.lit(True) if config.tolerance is None else F.datediff("__at", "__asof.__since") <= config.tolerance
    return df.where("__side = 1").select(
        *(F.col(c).alias(name) for name, c in again.items()), "__left.*", *(F.when(fresh, F.col(f"__asof.{c}")).alias(c) for c in wanted),
        F.array(*each).alias("__at_lag"), "__n",
    )


def _wanted(risk: DataFrame, config: Config, keep) -> list[str]:
    wanted = [c for c in dict.fromkeys(["industry_id", "cap", "mcap", "adv", *config.factors]) if c in risk.columns]
    return wanted if keep is None else [c for c in wanted if c in _attributes(config)]


def prepared(
    signal: DataFrame, ret: DataFrame, risk: DataFrame, dates: DataFrame, config: Config, costs: bool = False, keep=None, rows: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """Aligned rows with returns and attributes, one for each lag and residualisation, told apart by config.

    With costs, also what the cost model looks up on the row's day and the next. keep and rows are those of run, which deals the
    rows by day before residualisations multiply them; or by blocks of so many days, see _blocks.
    """
    # attributes are those of the signal's day, whatever the lag
    df = _looked_up(tc.known(signal), ret, risk, dates, config, _wanted(risk, config, keep), costs, rows).drop("__n")
    df = tc.align(df, dates, 8, config.lags)
    nth = F.array_position(F.array(*(F.lit(int(x)) for x in config.lags)), F.col("lag")).cast("int") - 1
    df = df.withColumn("__at_lag", F.get("__at_lag", nth)).where("__at_lag.known")
    df = df.withColumnRenamed("date_openret" if config.from_open else "date_ret", "date")
    found = [c for c in df.schema["__at_lag"].dataType.names if c not in ("lag", "known")]
    df = df.select(*(c for c in df.columns if c != "__at_lag"), *(F.col(f"__at_lag.{c}") for c in found))
    day, late = ["date", "lag", "signal_name"], bool({"factor", "all"} & set(config.resid))
    if block is not None and not late:
        df, day = _blocks(df, dates, config, rows, block), [*day, "__block"]
    elif keep is not None:
        df = _dealt(df, config, rows)
        if late:
            df = keep(df)  # regressions read it twice
    if list(config.resid) == ["off"]:
        df = df.withColumn("resid", F.lit("off"))
    else:
        df = regress.residualize(df, day, config.resid, list(config.factors))
    if block is not None and late:  # their fits are joined by day
        df = _blocks(df, dates, config, rows, block, ["resid"])
    return df.withColumn("config", suite.config_key())


def _summed(signal: DataFrame, config: Config) -> bool:
    """Whether sections.day_sums knows the weights and residuals."""
    exact = dict(signal.dtypes)["signal"] in ("tinyint", "smallint", "int", "float", "double")
    exact = exact and not {"date", "date_ret", "date_openret"} & set(config.byvars)  # days are numbers there
    return exact and config.weight == "equal" and not config.stretch and set(config.resid) <= {"off", "industry"}


def _numbered(signal: DataFrame, ret: DataFrame, risk: DataFrame, dates: DataFrame, config: Config, keep, rows: int | None) -> DataFrame:
    """As prepared with costs, before residuals: a row for each lag, whose day is its number n."""
    df = _looked_up(tc.known(signal), ret, risk, dates, config, _wanted(risk, config, keep), True, rows)
    rest = [c for c in df.columns if c not in ("__at_lag", "__n", "lag")]
    df = df.select(*rest, "__n", F.explode("__at_lag").alias("__x")).where("__x.known")
    first = 0 if config.from_open else 1
    df = df.select(*rest, "__x.*", (F.col("__n") + F.col("__x.lag") + first).alias("n"))
    other = dates.select((F.col("n") + (-1 if config.from_open else 1)).alias("n"))  # tc.align asks for an open and a close
    return df.join(F.broadcast(other), "n", "left_semi")


def _day_sums(df: DataFrame, dates: DataFrame, config: Config, rows: int | None, block: int, columns: list[str]) -> DataFrame:
    """The sums a day of the undivided slices, from rows that have one for each lag."""
    df = _blocks(df, dates, config, rows, block, summed=True)
    grp = portfolio.groups(df, _base(config))
    if config.tc_model == "power_law":
        unit, power = lambda when: cost.power_law_unit(vol=f"{when}_vol", adv=f"{when}_adv", close=f"{when}_close_adj"), 1.4
    else:
        unit, power = lambda when: cost.naive_cost(f"{when}_cap"), 1.0
    own = [F.col("signal").cast("double").alias("signal"), *(g.alias(f"__g_{b}") for b, g in grp.items() if b != "overall")]
    if "industry" in config.resid:
        whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ["industry_id", *config.factors]))
        own.append(F.when(whole, F.col("industry_id")).alias("__industry"))
    own += [F.col(c).cast("double").alias(c) for c in columns]
    own += [F.coalesce(unit(when).cast("double"), F.lit(0.0)).alias(f"__{when}") for when in ("now", "then")]
    df = df.select("signal_name", "lag", "__block", "n", "security_id", *own)
    sums = sections.day_sums(df, block, config.resid, _base(config), columns, config.fractile, config.mincos, config.long_only, power)
    add = lambda c: F.sum(c).alias(c)
    sums = sums.withColumn("config", suite.config_key()).groupBy(*KEYS, "n").agg(
        F.max("held").alias("held"),
        *(add(c) for c in ("n_long", "n_short")),
        *(F.round(F.sum(c), performance.DECIMALS).alias(c) for c in columns),
        *(add(c) for c in ("turnover", "tc")),
    )
    return sums.withColumn("n_min", F.least("n_long", "n_short"))


def _base(config: Config) -> list[str]:
    return list(dict.fromkeys(portfolio.SPLIT_BY_DATE.get(b, b) for b in config.byvars))


def _ranked(rows: int, config: Config) -> int:
    return rows * len(config.lags) * len(config.resid) * len(_base(config))


def _attributes(config: Config) -> list[str]:
    """What slices, weights and residuals look at."""
    own = {"overall": (), "cap": ("cap",)}
    needs = [x for b in _base(config) for x in own.get(b, (b,))]
    needs += [{"value": "mcap", "volume": "adv"}.get(config.weight, "signal")]
    needs += ["industry_id"] if set(config.resid) & {"industry", "factor", "all"} else []
    return [*config.factors, *needs]


def _needed(df: DataFrame, config: Config) -> list[str]:
    """The columns that positions, weights and costs need."""
    taken = ["security_id", "date", "signal_name", "lag", "signal", "ret", "resret", *_attributes(config)]
    taken += [c for c in df.columns if c.startswith(("now_", "then_"))]
    return list(dict.fromkeys(taken))


def _dealt(df: DataFrame, config: Config, rows: int | None) -> DataFrame:
    """The needed columns, dealt by signal, lag and day: by these all cross-sections are apart."""
    day = ["signal_name", "lag", "date"]
    df = df.select(*_needed(df, config))
    if rows is None:
        return df.repartition(*day)
    # what these rows are multiplied by later is known here, but not to Spark, which deals by the size of what it shuffles
    return df.repartition(_tasks(df, _ranked(rows, config)), *day)


def _block_days(dates: DataFrame, config: Config, rows: int | None, summed: bool = False) -> int:
    """Of how many days a block is: of many, so that few rows are copied, and of few, so that a task can sort one."""
    low, high = BLOCK_DAYS
    if rows is None:
        return high
    a_day = rows / max(dates.count(), 1)
    if summed:
        return int(min(max(SUMMED_BLOCK_ROWS / max(a_day, 1), low), high))
    return int(min(max(BLOCK_ROWS / max(a_day * len(config.resid) * len(_base(config)), 1), low), high))


def _blocks(
    df: DataFrame, dates: DataFrame, config: Config, rows: int | None, days: int, more: Sequence[str] = (), summed: bool = False
) -> DataFrame:
    """The needed columns with n and __block, dealt by signal, lag and block of so many days.

    A block has a copy of the day before it, so all cross-sections and all changes from day to day are in one task each.
    """
    if summed:
        df = df.select("n", *(c for c in _needed(df, config) if c != "date"))
    else:
        df = df.select(*_needed(df, config), *more).join(F.broadcast(dates.select("date", "n")), "date")  # a row a day
    of = lambda n: F.floor(n / days).cast("int")
    df = df.withColumn("__block", F.explode(F.array_distinct(F.array(of(F.col("n")), of(F.col("n") + 1)))))
    keys = ["signal_name", "lag", "__block"]
    if rows is None:
        return df.repartition(*keys)
    if summed:
        return df.repartition(_tasks(df, int(rows * len(config.lags) * (1 + 1 / days)), SUMMED_TASK_ROWS), *keys)
    return df.repartition(_tasks(df, int(_ranked(rows, config) * (1 + 1 / days))), *keys)


def positions(df: DataFrame, config: Config, byvars: Sequence[str] | None = None, section: Sequence[str] = SECTION) -> DataFrame:
    df = portfolio.slices(df, byvars or config.byvars)
    df = portfolio.percentile(df, section, stretch=config.stretch)
    return df.withColumn("position", portfolio.position("p", *config.fractile))


def run(
    signal: DataFrame,
    ret: DataFrame,
    risk: DataFrame,
    dates: DataFrame,
    config: Config | None = None,
    keep=DataFrame.persist,
    rows: int | None = None,
) -> Result:
    """Everything of a backtest as lazy frames.

    Several parts read the sums a day and the daily series, so keep holds these, and single holdings if these are asked for: it
    persists them, to memory and disk, until the caller lets go of the frames in result.kept; pass a function that writes and
    rereads to keep them otherwise. rows, about how many rows the panel has, sizes the tasks that rank and weigh.

    Slices that split others by date, such as years, have the same cross-sections as these, so weights, sums a day and trades
    are those of the undivided slices, and are assigned to the parts of these afterwards.
    """
    config, kept = config or Config(), []
    columns = ["ret", "resret", *config.factors]
    known = COST_COLUMNS[config.tc_model]
    spread = lambda x: portfolio.split_by_date(x, config.byvars)

    def held_by(df: DataFrame) -> DataFrame:
        kept.append(keep(df))
        return kept[-1]

    def weighed(df: DataFrame, section: Sequence[str]) -> DataFrame:
        """Weights, and __names, the names on the smaller side of the cross-section."""
        weights = portfolio.weigh(positions(df, config, _base(config), section), section, config.weight)
        if config.long_only:
            weights = portfolio.long_only(weights).where("weight > 0")
        long, _, least = portfolio.side_counts(Window.partitionBy(*section))
        return weights.withColumn("__names", long if config.long_only else least)

    def holdings() -> tuple[DataFrame, DataFrame, DataFrame]:
        weights = weighed(prepared(signal, ret, risk, dates, config, True, held_by, rows), SECTION)
        weights = weights.join(F.broadcast(dates.select("date", "n")), "date")  # a row a day
        looked_up = [c for c in weights.columns if c.startswith(("now_", "then_"))]
        weights = held_by(weights.select("security_id", *KEYS, "date", "n", "position", "weight", *columns, "__names", *looked_up))
        held = weights.where(F.col("__names") >= config.mincos)
        begin = portfolio.names_per_side(weights, [*KEYS, "n"])
        begin = portfolio.enough_names(begin, config.mincos, config.long_only).groupBy(*KEYS).agg(F.min("n").alias("first"))
        changes = cost.weight_changes(held, KEYS, known, None if rows is None else _tasks(held, _ranked(rows, config) // 2), begin)
        return spread(weights), spread(held), changes.join(F.broadcast(dates.select("n", "date")), "n")

    summed = _summed(signal, config)
    block = _block_days(dates, config, rows, summed)
    if summed:
        whole_day = _day_sums(_numbered(signal, ret, risk, dates, config, held_by, rows), dates, config, rows, block, columns)
    else:
        df = prepared(signal, ret, risk, dates, config, True, held_by, rows, block)
        weights = weighed(df, ["date", "lag", "__block", *KEYS]).where(F.col("__names") >= config.mincos)
        rate = cost.power_law_cost() if config.tc_model == "power_law" else cost.naive_cost()
        moves = cost.block_moves(weights, ["lag", "__block", *KEYS], known, columns, block)
        whole_day = moves.groupBy(*KEYS, "n").agg(
            F.max("held").alias("held"),
            *portfolio.side_counts(),
            *performance.weighted_sums(columns),
            F.sum("change").alias("turnover"),
            F.sum(rate * F.col("change")).alias("tc"),
        )
    whole_day = held_by(whole_day.join(F.broadcast(dates.select("n", "date")), "n"))
    held_day = spread(whole_day.where("held = 1").drop("held", "turnover", "tc"))
    day = portfolio.enough_names(held_day, config.mincos, config.long_only)
    names = day.drop(*columns)

    # trades of all days, those before a part's first day as well, which are not the part's
    first = names.groupBy(*KEYS).agg(F.min("n").alias("__first"))
    turnover = F.when(F.col("held") == 1, F.col("turnover")).alias("turnover")  # a period without holdings has costs all the same
    trades = spread(whole_day.select(*KEYS, "n", "date", turnover, "tc")).drop("date")
    trades = trades.join(first, KEYS).where("n > __first").drop("__first")

    bounds = performance.date_bounds(names, KEYS)
    daily = performance.on_panel(bounds, dates, KEYS, day.drop("date"), trades)
    daily = held_by(performance.cumulate(performance.net_returns(daily), KEYS))
    return Result(held_day, names, daily, performance.summary(daily, KEYS, config.factors), kept, holdings)


def results(summary: DataFrame, kind: str = "signal") -> DataFrame:
    """The suite's headline columns of each group."""
    return summary.select(
        *KEYS,
        F.lit(kind).alias("type"),
        F.col("ret_sharpe").alias("sharpe"),
        F.col("ret_ann").alias("ann_ret"),
        F.col("maxdd").alias("max_dd"),
        "turnover",
    )
