"""What several operators share: scratch tables, partition counts and word helpers.

Scratch tables go to the folder that the session names in ``spark.checkpoint.dir``; it is shared by all executors,
so a lost executor costs a retry and no data.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the tables lie that were written and are still in use.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this application; the JVM deletes it when it ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="signalloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to scratch and read it back: computed once, lineage cut, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: all that was made of them is written itself."""
    for df in tables:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(df))
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table of narrow rows, to be broadcast if a count shows that it has at most so many."""
    return F.broadcast(df) if df.count() <= most else df


def shards(sizes: Iterable[int], rows: int) -> tuple[list[int], list[int]]:
    """(the shard of each list, the blocks of each shard): neighbours share a shard up to so many rows; a longer list has one
    of its own, in several blocks."""
    shard: list[int] = []
    blocks: list[int] = []
    filled = 0
    for size in map(int, sizes):
        if not shard or filled + size > rows:
            blocks.append(1)
            filled = 0
        filled += size
        shard.append(len(blocks) - 1)
        blocks[-1] = max(1, -(-filled // rows))
    return shard, blocks


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Send texts to Python workers at most so many at a time; ten thousand, as Spark's setting has it, may be a GB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; ASCII texts take the fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, __packed, so that no name that a user has given meets one of ours."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None)).alias("__packed"))


def packed(column: str) -> Column:
    return F.col(column) if column in ("doc_id", "text") else F.col(f"__packed.`{column}`")


def unpack(docs: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that were packed, in their order; some of them anew."""
    return docs.select(*(new.get(c, packed(c)).alias(c) for c in columns))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; other columns, whatever their names, play no part."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def by_size(texts: Iterable[str | None], chars: int) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters at most; a longer text is a run of its own."""
    part: list[str | None] = []
    size = 0
    for text in texts:
        if part and size + len(text or "") > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "") + 1
    if part:
        yield part
