"""Frames that several parts of a query read, persisted while its result is in use; and tables that are written once."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Frames held by the query that is being built, and those of queries that were built, with their results.
_OPEN: list[DataFrame] = []
_HELD: list[tuple[weakref.ref, list[DataFrame]]] = []
_STORED: dict[tuple, tuple[str, StructType]] = {}


def hold(df: DataFrame) -> DataFrame:
    """df, persisted to memory and disk until the result of the query being built is no longer in use."""
    _OPEN.append(df.persist())
    return _OPEN[-1]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; for local sessions without one, below the temporary folder. It goes when
    the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="signalloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/plans-{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a table that was written is still there."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def stored(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under key, written to the scratch folder when this application first asks for it, and read from then on."""
    own = (spark.sparkContext.applicationId, *key)
    if own not in _STORED or not _complete(spark, _STORED[own][0]):
        path, df = scratch(spark, str(key[-1])), make()
        df.write.parquet(path)
        _STORED[own] = path, df.schema
    path, schema = _STORED[own]
    return spark.read.schema(schema).parquet(path)


def owned(result: DataFrame) -> DataFrame:
    """result, which what was held since the last one belongs to."""
    _HELD.append((weakref.ref(result), _OPEN.copy()))
    _OPEN.clear()
    return result


def release() -> None:
    """Let go of what belongs to results that nobody has any more, and of what a broken query has left."""
    gone = _OPEN.copy()
    _OPEN.clear()
    for entry in [x for x in _HELD if x[0]() is None]:
        _HELD.remove(entry)
        gone += entry[1]
    for df in gone:
        if df.sparkSession.sparkContext._jsc is not None:  # a stopped session has let go already
            df.unpersist()
