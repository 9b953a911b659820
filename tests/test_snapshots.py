"""Snapshots: updates that touch what has changed and what depends on it, and nothing else."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from signalloom.sources import snapshots


def panels(spark, years=(2020, 2021, 2022)):
    rows = [(i, f"{y}-03-0{d}", i / 100) for y in years for d in (1, 2, 3) for i in range(1, 5)]
    ret = spark.createDataFrame(rows, "security_id int, date string, ret double").withColumn("date", F.to_date("date"))
    risk = ret.select("security_id", "date", (F.col("ret") * 7).alias("size"), (F.col("ret") + 1).alias("value"), F.lit(1).alias("cap"))
    return ret, risk, ret.select("date").distinct().withColumn("n", F.dayofyear("date"))


def status(df):
    return {(r.component, r.year): r.status for r in df.collect()}


def verified(spark, path):
    return {r.component: r.status for r in snapshots.verify(spark, path).collect()}


OK = dict.fromkeys(snapshots.COMPONENTS, "ok")


def test_update_rebuilds_what_depends_on_it(spark, tmp_path):
    path = str(tmp_path / "s")
    ret, risk, dates = panels(spark)
    snapshots.build(ret, risk, dates, path)
    assert verified(spark, path) == OK
    new = ret.withColumn("ret", F.when(F.year("date") == 2021, F.col("ret") + 1).otherwise(F.col("ret")))
    got = status(snapshots.update(spark, path, ret=new))
    assert {y: got["ret", y] for y in (2020, 2021, 2022)} == {2020: "same", 2021: "changed", 2022: "same"}
    assert {y: got["master", y] for y in (2020, 2021, 2022)} == {2020: "kept", 2021: "rebuilt", 2022: "kept"}
    assert {got[c, y] for c in ("risk", "factors") for y in (2020, 2021, 2022)} == {"kept"}
    assert verified(spark, path) == OK
    assert snapshots.component(spark, path, "master").agg(F.max("ret")).first()[0] == pytest.approx(1.04)
    assert status(snapshots.update(spark, path, ret=new))["ret", 2021] == "same"


def test_years_that_have_not_changed_are_not_read(spark, tmp_path):
    path = str(tmp_path / "s")
    ret, risk, dates = panels(spark)
    snapshots.build(ret, risk, dates, path)
    broken = [f for c in snapshots.COMPONENTS for f in glob.glob(f"{path}/{c}/year=2020/*.parquet")]
    for file in broken:
        with open(file, "r+b") as f:
            f.seek(4)  # the first pages; the footer stays, from which Spark may take the schema
            f.write(b"\xff" * 24)
        os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    with pytest.raises(Exception):  # noqa: B017
        snapshots.component(spark, path, "ret", [2020]).collect()
    new = risk.where("year(date) > 2020").withColumn("size", F.col("size") * 2)
    got = status(snapshots.update(spark, path, risk=new))
    assert {k for k, v in got.items() if v in ("changed", "rebuilt")} == {(c, y) for c in ("risk", "master", "factors") for y in (2021, 2022)}
    assert {r.component: r.rows for r in spark.read.parquet(f"{path}/manifest").collect()} == dict.fromkeys(snapshots.COMPONENTS, 36)


def test_an_update_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    ret, risk, dates = panels(spark)
    snapshots.build(ret, risk, dates, path)
    new = ret.withColumn("ret", F.col("ret") * F.year("date") - 2019)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_add_up", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            snapshots.update(spark, path, ret=new)
    assert verified(spark, path)["ret"] == "changed"
    assert status(snapshots.update(spark, path, ret=new))["ret", 2022] == "changed"
    assert verified(spark, path) == OK


def test_years_added_emptied_and_unknown(spark, tmp_path):
    path = str(tmp_path / "s")
    ret, risk, dates = panels(spark, (2020, 2021))
    snapshots.build(ret, risk, dates, path)
    more, _, _ = panels(spark, (2023,))
    gone = ret.where("year(date) = 2021").withColumn("security_id", F.lit(99))  # no risk: master has nothing of that year
    undated = ret.limit(1).withColumn("date", F.lit(None).cast("date"))
    got = status(snapshots.update(spark, path, ret=more.unionByName(gone).unionByName(undated)))
    assert got["ret", 2023] == "added" and got["ret", 2021] == "changed" and got["ret", 2020] == "kept" and got["ret", None] == "added"
    assert ("master", 2021) not in got and ("master", 2023) not in got
    assert snapshots.component(spark, path, "master").select(F.year("date")).distinct().count() == 1
    assert verified(spark, path) == OK
    with pytest.raises(ValueError):
        snapshots.update(spark, path, master=ret)
    with pytest.raises(ValueError):
        snapshots.update(spark, path, ret=ret.withColumn("more", F.lit(1)))


def test_panels_are_written_where_they_lie(spark, tmp_path, monkeypatch):
    """A panel is shuffled once to be normalised or joined, not again for its folders."""
    from signalloom.sources import tables

    plans, make = [], tables.by_year

    def seen(*args):
        out = make(*args)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(tables, "by_year", seen)
    path = str(tmp_path / "s")
    snapshots.build(*panels(spark), path)
    assert len(plans) == 4 and not any("Rebalance" in p for p in plans)
    assert "Rebalance" in make(panels(spark)[0])._jdf.queryExecution().optimizedPlan().toString()
    assert verified(spark, path) == OK
