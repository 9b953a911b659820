"""Panels take whole numbers and weeks without decimals and clocks, which have the same values."""

import datetime

from pyspark.sql import functions as F

from signalloom.plans import fixtures


def test_whole_numbers_and_weeks_are_those_of_sparks_functions(spark):
    odd = [0.5, 1.5, 2.5, -0.5, -1.5, -2.4, 0.49999999999999994, 1e15 + 0.5, 0.0, -0.0, 28.999999999999996, 7.000000000000001, None]
    df = spark.createDataFrame([(x,) for x in odd], "x double").select(fixtures.whole(F.col("x")).alias("a"), F.round("x").cast("long").alias("b"))
    assert all(r.a == r.b for r in df.collect())
    days = [(datetime.datetime(1996, 12, 20) + datetime.timedelta(hours=17 * i),) for i in range(60)] + [(None,)]
    df = spark.createDataFrame(days, "t timestamp").select(fixtures.monday("t").alias("a"), F.to_date(F.date_trunc("week", "t")).alias("b"))
    assert all(r.a == r.b for r in df.collect())


def test_the_weekly_panel_rounds_no_decimals(spark, monkeypatch, tmp_path):
    rows = [(1, 2.0, 10.5, 0.05, 0.01, datetime.datetime(1997, 1, 1)), (1, 3.0, 1.25, 0.1, 0.02, datetime.datetime(1996, 12, 30, 23))]
    items = spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    panel = fixtures.WeeklyPanel(spark, str(tmp_path))
    plan = panel._base()._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "round(" not in plan and "date_trunc" not in plan
    assert [tuple(r) for r in panel.base.collect()] == [(1, datetime.date(1996, 12, 30), 2, 15, 3, 5, 1175)]
