"""Panels and signals derived from the given tables: suppliers by week, users by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.plans.held import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(x: Column) -> Column:
    """The nearest whole number, halves away from zero; F.round, which goes by way of decimals, takes four times as long."""
    size = F.abs(x)
    return F.signum(x).cast("long") * (F.floor(size) + F.when(size - F.floor(size) >= 0.5, 1).otherwise(0))


def cents(column: str):
    return F.sum(whole(F.col(column) * 100))


def monday(day: str) -> Column:
    """The first day of the week."""
    return F.date_sub(F.to_date(day), F.weekday(F.to_date(day)))


class WeeklyPanel:
    """Suppliers by week: ret, risk, dates, signal and market, all from integer sums and one division each.

    The panels are written once an application, as a user has them, and read by every query.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.base = stored(spark, (sf_dir, "weekly"), self._base)

    @property
    def suppliers(self) -> DataFrame:
        supplier = table(self.spark, self.dir, "supplier")
        return supplier.select(F.col("s_suppkey").cast("int").alias("security_id"), "s_nationkey", "s_acctbal")

    @property
    def nations(self) -> DataFrame:
        return table(self.spark, self.dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")

    def _base(self) -> DataFrame:
        items = table(self.spark, self.dir, "lineitem")
        return items.groupBy(F.col("l_suppkey").cast("int").alias("security_id"), monday("l_shipdate").alias("date")).agg(
            F.count("*").alias("k"),
            cents("l_discount").alias("dsc"),
            cents("l_tax").alias("tx"),
            F.sum(whole(F.col("l_quantity"))).alias("qty"),
            cents("l_extendedprice").alias("px"),
        )

    @property
    def risk(self) -> DataFrame:
        return stored(self.spark, (self.dir, "risk"), self._risk)

    @property
    def ret(self) -> DataFrame:
        return stored(self.spark, (self.dir, "ret"), self._ret)

    def _risk(self) -> DataFrame:
        kk = F.col("k")
        base = self.base.join(self.suppliers, "security_id").join(F.broadcast(self.nations), "s_nationkey")  # 25 nations
        return base.select(
            "security_id",
            "date",
            F.col("s_nationkey").cast("int").alias("industry_id"),
            F.col("n_regionkey").cast("int").alias("sector_id"),
            F.when(F.col("s_acctbal") > 6000, 1).when(F.col("s_acctbal") > 2000, 2).otherwise(3).alias("cap"),
            (F.col("px") / 100).alias("mcap"),
            (F.col("qty") * 1e6).alias("adv"),
            F.col("qty").cast("double").alias("size"),
            (F.col("tx") / kk).alias("value"),
            kk.cast("double").alias("growth"),
            (F.col("dsc") / kk).alias("leverage"),
            (F.col("px") / (kk * 100)).alias("volatility"),
            (F.col("qty") / kk).alias("momentum"),
            (F.col("px") / F.col("qty")).alias("yield"),
            (F.col("security_id") % 4 != 0).cast("int").alias("universe_flag"),
        )

    def _ret(self) -> DataFrame:
        kk = F.col("k")
        df = self.base.join(self.suppliers, "security_id")
        df = df.withColumns(
            {
                "ret": F.col("dsc") / (kk * 100) - 0.05,
                "openret": F.col("tx") / (kk * 100) - 0.04,
                "vol": F.col("tx") / (kk * 100) + 0.01,
                "adv": F.col("qty") * 1e6,
                "close_adj": F.col("px") / (F.col("qty") * 100),
            }
        )
        means = df.groupBy(F.col("date").alias("__date"), F.col("s_nationkey").alias("__nation"))
        means = means.agg(F.avg("ret").alias("__ret"), F.avg("openret").alias("__open"))
        same = F.col("date").eqNullSafe(F.col("__date")) & F.col("s_nationkey").eqNullSafe(F.col("__nation"))
        df = df.join(F.broadcast(means), same)  # a row a week and nation
        df = df.withColumns(
            {"resret": F.round(F.col("ret") - F.col("__ret"), 9), "resopenret": F.round(F.col("openret") - F.col("__open"), 9)}
        )
        return df.select("security_id", "date", "ret", "resret", "openret", "resopenret", "vol", "adv", "close_adj")

    @property
    def dates(self) -> DataFrame:
        """A row a week; numbering them in one task is bounded by the calendar."""
        weeks = self.base.select("date").distinct()
        df = weeks.withColumn("n", F.row_number().over(Window.orderBy("date")))
        return df.select("date", "n", (F.col("n") <= 178).cast("int").alias("insample"), (F.col("n") % 2).alias("insample2"))

    @property
    def signal(self) -> DataFrame:
        return self._signal("quantity", F.col("qty") / F.col("k"))

    @property
    def price_signal(self) -> DataFrame:
        return self._signal("price", F.col("px") / (F.col("k") * 100))

    def _signal(self, name: str, value) -> DataFrame:
        return self.base.select(
            F.lit(name).alias("signal_name"),
            "security_id",
            F.col("date").alias("date_sig"),
            F.col("date").alias("date_avail"),
            value.alias("signal"),
        )

    @property
    def market(self) -> DataFrame:
        return self.base.groupBy("date").agg((F.sum("dsc") / (F.sum("k") * 100) - 0.05).alias("market_ret"))


class DailyPanel:
    """Users by day, with signals that become available on the next calendar day."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.base = stored(spark, (sf_dir, "daily"), self._base)

    def _base(self) -> DataFrame:
        events = table(self.spark, self.dir, "events")
        click = F.sum((F.col("event_type") == "click").cast("long"))
        return events.groupBy(F.col("user_id").cast("int").alias("security_id"), F.to_date("ts").alias("date")).agg(
            F.count("*").alias("k"), cents("value").alias("cents"), click.alias("clicks"), F.min("ts").alias("first_ts")
        )

    @property
    def ret(self) -> DataFrame:
        return self.base.select("security_id", "date", ((F.col("cents") / F.col("k") - 5000) / 100000).alias("ret"))

    @property
    def risk(self) -> DataFrame:
        return self.base.select(
            "security_id",
            "date",
            (F.col("security_id") % 7).alias("industry_id"),
            (F.col("security_id") % 3 + 1).alias("cap"),
            F.col("k").cast("double").alias("value"),
            F.col("cents").cast("double").alias("size"),
        )

    @property
    def dates(self) -> DataFrame:
        days = self.base.select("date").distinct().where(F.dayofweek("date").between(2, 6))
        return days.withColumn("n", F.row_number().over(Window.orderBy("date")))

    @property
    def signal(self) -> DataFrame:
        return self.base.select(
            F.lit("clicks").alias("signal_name"),
            "security_id",
            F.col("date").alias("date_sig"),
            F.date_add("date", 1).alias("date_avail"),
            (F.col("clicks") / F.col("k")).alias("signal"),
            F.hour("first_ts").alias("hour"),
        )
