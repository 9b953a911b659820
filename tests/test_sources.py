"""Signal files by the names of their columns, and runs that are written again or break off."""

import datetime as dt

import pytest

from signalloom.sources import tables


def csv(tmp_path, text, name="s.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


DAY = dt.date(2024, 1, 5)


def test_a_csv_is_read_by_the_names_of_its_columns(spark, tmp_path):
    path = csv(tmp_path, "﻿date_sig, extra ,security_id,signal,date_avail\n2024-01-05,x,7,0.5,2024-01-06\n2024-01-05 00:00:00,,8.0,,2024-01-06\n2024-01-05,,9,inf,2024-01-06\n")
    got = sorted(tuple(r) for r in tables.scan_signal(spark, path).collect())
    assert got == [(7, DAY, dt.date(2024, 1, 6), 0.5), (8, DAY, dt.date(2024, 1, 6), None), (9, DAY, dt.date(2024, 1, 6), float("inf"))]
    assert tables.signal_rejects(spark, path).count() == 0


def test_lines_that_cannot_be_read_are_refused_or_told(spark, tmp_path):
    path = csv(tmp_path, "signal,security_id,date_sig,date_avail\n1,1,2024-01-05,2024-01-06\nlots,2,2024-01-05,2024-01-06\n1,2.5,2024-01-05,2024-13-06\n1,,2024-01-05,2024-01-06\n")
    with pytest.raises(Exception, match="cannot read signal"):
        tables.scan_signal(spark, path).collect()
    assert [r.security_id for r in tables.scan_signal(spark, path, bad_lines="drop").collect()] == [1]
    got = {(r["columns"], r.security_id) for r in tables.signal_rejects(spark, path).collect()}
    assert got == {("signal", "2"), ("security_id,date_avail", "2.5"), ("security_id", None)}


def test_a_csv_without_a_column_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="date_avail"):
        tables.scan_signal(spark, csv(tmp_path, "security_id,date_sig,signal\n1,2024-01-05,1\n"))


def frames(spark, value):
    metrics = spark.createDataFrame([("c", "signal", "sharpe", value)], "config string, type string, metric string, value double")
    return metrics, spark.createDataFrame([("c", "signal", DAY, value)], "config string, type string, date date, ret double")


def values(spark, path, run_id):
    runs, metrics, daily = tables.read_run(spark, path, run_id)
    return [r.start_time for r in runs.collect()], [r.value for r in metrics.collect()], [r.ret for r in daily.collect()]


def test_a_run_written_again_replaces_the_first(spark, tmp_path):
    path = str(tmp_path / "runs")
    for value in (1.0, 2.0, 3.0):
        tables.write_run(path, "007", f"2024-01-0{int(value)}", {"v": str(value)}, *frames(spark, value))
    tables.write_run(path, "8", "2024-01-01", {}, *frames(spark, 9.0))
    assert values(spark, path, "007") == (["2024-01-03"], [3.0], [3.0])
    assert sorted((r.run_id, r.value) for r in tables.run_part(spark, path, "run_metrics").collect()) == [("007", 3.0), ("8", 9.0)]
    assert tables.run_history(tables.published(spark, path)).count() == 2
    assert tables.sweep_runs(spark, path) == 4 and tables.sweep_runs(spark, path) == 0
    assert values(spark, path, "007") == (["2024-01-03"], [3.0], [3.0])
    assert [r.status for r in tables.delete_runs(spark, path, ["007"]).collect()] == ["deleted"]
    assert values(spark, path, "007") == ([], [], [])


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    tables.write_run(path, "a", "2024-01-01", {}, *frames(spark, 1.0))
    metrics, daily = frames(spark, 2.0)
    broken = daily.selectExpr("config", "type", "date", "raise_error('lost') as ret")
    with pytest.raises(Exception, match="lost"):
        tables.write_run(path, "a", "2024-01-02", {}, metrics, broken)
    assert values(spark, path, "a") == (["2024-01-01"], [1.0], [1.0])
    tables.write_run(path, "a", "2024-01-03", {}, *frames(spark, 3.0))
    assert values(spark, path, "a") == (["2024-01-03"], [3.0], [3.0])
