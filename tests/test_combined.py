"""The combined daily series leave nothing of the suite out."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from test_queries import SMALL, TABLES, plain, pytestmark  # noqa: F401


def test_combined_series_are_those_of_all_signals_slices_and_baselines(spark):
    import __spark_entry__ as entry

    found = entry.queries()["combined_daily"](spark, SMALL)
    names = {(r.type, r.signal_name): (r.lags, r.byvars) for r in found.groupBy("type", "signal_name").agg(
        F.countDistinct(F.substring("config", 1, 4)).alias("lags"), F.countDistinct("byvar").alias("byvars")).collect()}
    assert names == {("signal", "quantity"): (3, 3), ("signal", "price"): (3, 3), ("baseline", "reversal_5d"): (1, 3), ("baseline", "value"): (1, 3)}
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    pd.testing.assert_frame_equal(plain(found.toPandas()), plain(con.sql(entry.oracle_sql()["combined_daily"]).df()), check_dtype=False)
