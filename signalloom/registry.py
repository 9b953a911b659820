"""All queries and their SQL twins.

A query is registered with the columns of its result, the Spark function and the SQL body. A column named with :r is
rounded to 6 decimals, alike on both sides; halves, of which sums in another order may fall short, are rounded down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.plans import sql as Q
from signalloom.plans.held import owned, release

FLAGSHIP = "summary_stats"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _split(columns: str) -> list[tuple[str, bool]]:
    return [(c.removesuffix(":r"), c.endswith(":r")) for c in columns.split()]


def add(name: str, columns: str, of: Callable[[SparkSession, str], DataFrame], body: str | None = None, ctes: str = "") -> None:
    """Register a query; body is a SELECT over the fixtures and ctes."""
    wanted = _split(columns)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        release()  # what queries held whose results are gone
        df = of(spark, sf_dir)
        return owned(df.select(*((F.floor(F.col(f"`{c}`") * 1e6 + 0.499) / 1e6).alias(c) if r else F.col(f"`{c}`") for c, r in wanted)))

    _QUERIES[name] = run
    if body is not None:
        out = ", ".join(f'floor("{c}" * 1e6 + 0.499e0) / 1e6 AS "{c}"' if r else f'"{c}"' for c, r in wanted)
        _SQL[name] = f"WITH {Q.FIXTURES.strip()}{',' + ctes if ctes else ''} SELECT {out} FROM ({body})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import signalloom.plans.queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import signalloom.plans.queries  # noqa: F401

    return dict(_SQL)
