"""What is left when the corpus operators are gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_entry_imports_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "signalloom"), copy / "signalloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'run_backtest' in q, any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    env = {**os.environ, "PYTHONPATH": str(copy), "PYTHONDONTWRITEBYTECODE": "1"}
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    count, *rest = said.stdout.split()
    assert int(count) > 140 and rest == ["True", "False", "True"]


def test_nothing_else_imports_the_corpus_operators():
    found = []
    for folder, _, names in os.walk(os.path.join(ROOT, "signalloom")):
        if "llm" in folder.split(os.sep):
            continue
        for name in names:
            if name.endswith(".py") and "signalloom.llm" in open(os.path.join(folder, name), encoding="utf-8").read():
                found.append(name)
    assert found == []


def test_results_that_are_in_use_keep_what_they_hold(spark):
    from pyspark.sql import DataFrame

    from signalloom.plans import held

    def query() -> DataFrame:
        held.release()
        return held.owned(held.hold(spark.range(5).selectExpr("id * 2 AS x")).select("x"))

    cached = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    held.release()
    before = cached()
    a, b = query(), query()
    assert (a.count(), b.count()) == (5, 5) and cached() == before + 1  # equal plans share what is persisted
    del a, b
    held.release()
    assert cached() == before
