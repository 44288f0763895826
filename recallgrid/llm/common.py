"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def squeezed(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def lean(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows where the session has Spark's default of ten thousand, so that a batch of long texts
    fits a worker. The operators work with any setting."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master has one of its
    own, and any other raises an error, as executors don't share a machine's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/recallgrid-shared"


#: For rows of megabytes: Parquet looks at the size of a row group and of a page after each row, where it would after a hundred. A
#: reader holds a row group's rows at once.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def written(df: DataFrame, name: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write a DataFrame once as Parquet in the shared folder and read it again, which cuts its lineage.

    Later stages and retries after a lost executor read the files instead of computing the plan anew. ``clear`` removes
    what a session wrote, once the results that read it are written or collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)


def clear(spark: SparkSession) -> int:
    """Remove the tables that ``written`` has left so far; how many there were."""
    n = len(_written)
    _remove(spark, _written)
    _written.clear()
    return n


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are removed at the end, but for those given to the function that this yields; no frame that is used
    later may read them. Shuffle files that nothing refers to any more go as well, once the JVM has collected garbage."""
    begin, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_written[-1])
        return df

    try:
        yield keep
    finally:
        mine = _written[begin:]
        _written[begin:] = [path for path in mine if path in kept]
        _remove(spark, [path for path in mine if path not in kept])
        gc.collect()
        spark._jvm.System.gc()


def small_first(df: DataFrame, most_rows: int = 250_000) -> DataFrame:
    """The side of a join, broadcast if its rows were counted and are few; else as it is, for a shuffled join. For narrow,
    written rows, whose count reads no more than file footers."""
    return F.broadcast(df) if len(df.take(1)) and df.count() <= most_rows else df
