"""A folder of documents as a library: texts are taken by an extractor, and only new or changed files are read again.

A library is two append-only tables under a path: `pages`, and `files`, the log of what was taken from which file. A version's
pages are written before its log, and what the log doesn't name is not read, so a run that dies leaves nothing that
counts and its version is written over. One run at a time writes to a library; readers may read as it does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recallgrid.sources import pdf
from recallgrid.sources.files import _stem

FILE = "path string, modificationTime timestamp, length long, content binary"
LOG = "path string, source string, modified timestamp, length long, n_pages long, error string, removed boolean, version long"
PAGES = "path string, source string, page_number int, content string, version long"

#: A longer file isn't read and counts as a failure.
MAX_BYTES = 512 << 20


class Extractor(Protocol):
    """How texts are taken from a file: all of its pages, numbered from 1, or an exception that says why not."""

    def extract(self, content: bytes) -> Iterable[tuple[int, str]]: ...


class PdfText:
    """The texts that PDF files hold themselves; scanned pages have none."""

    def extract(self, content: bytes) -> Iterable[tuple[int, str]]:
        return pdf.page_texts(content)


def named(read: DataFrame) -> DataFrame:
    """Files as Spark reads them, with their source name."""
    return read.select("path", _stem(F.col("path")).alias("source"), F.col("modificationTime").alias("modified"), "length", "content")


def extracted(files: DataFrame, extractor: Extractor | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, source, page_number, content, error) of files (path, source, length, content): a row for each page that isn't blank,
    or one row with the reason for a file that gives none. Whatever an extractor raises is that file's failure alone."""
    import pyarrow as pa

    taker = extractor or PdfText()

    def pages_of(content: bytes | None) -> list[tuple[int | None, str | None, str | None]]:
        if content is None:
            return [(None, None, "too long")]
        try:
            found = [(n, text, None) for n, text in taker.extract(content) if text.strip()]
        except Exception as e:  # noqa: BLE001  a file that can't be read must not end the job
            return [(None, None, str(e) or type(e).__name__)]
        return found or [(None, None, "no text; scanned pages need OCR first")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pages_of(batch.column("content")[i].as_py())
                keys = batch.select(["path", "source"]).take(pa.array([i] * len(rows)))
                told = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*keys.columns, *told], ["path", "source", "page_number", "content", "error"])

    # Lengths are pushed to the scan of files, so that one that is too long is never loaded.
    short = files.where(F.col("length") <= max_bytes).select("path", "source", "content")
    out = short.mapInArrow(read, "path string, source string, page_number int, content string, error string")
    long = files.where(F.col("length") > max_bytes)
    none = F.lit(None)
    return out.unionByName(long.select("path", "source", none.cast("int").alias("page_number"), none.cast("string").alias("content"), F.lit("too long").alias("error")))


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    where, system = _at(spark, f"{root}/{name}")
    return spark.read.schema(schema).parquet(f"{root}/{name}") if system.exists(where) else spark.createDataFrame([], schema)


def log(spark: SparkSession, root: str) -> DataFrame:
    """What is known of each file now: the last row of the log."""
    rows = _table(spark, root, "files", LOG)
    last = rows.groupBy("path").agg(F.max_by(F.struct("source", "modified", "length", "n_pages", "error", "removed", "version"), "version").alias("last"))
    return last.select("path", "last.*").where("not removed")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """(source, page_number, content) of all files that could be read, as `documents.index` takes them. Files of one name in
    several folders are one source each, told by their path."""
    now = log(spark, root).where("error is null")
    same = now.groupBy("source").agg(F.count("*").alias("n"))
    told = now.join(same, "source").select("path", "version", F.when(F.col("n") > 1, F.col("path")).otherwise(F.col("source")).alias("source"))
    return _table(spark, root, "pages", PAGES).drop("source").join(told, ["path", "version"]).select("source", "page_number", "content")


def failures(spark: SparkSession, root: str) -> DataFrame:
    """(source, path, error) of the files that gave nothing."""
    return log(spark, root).where("error is not null").select("source", "path", "error")


def _next(spark: SparkSession, root: str) -> int:
    return (_table(spark, root, "files", LOG).agg(F.max("version").alias("v")).first().v or 0) + 1


def _noted(rows: DataFrame, root: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/files/version={version}")


def take(files: DataFrame, root: str, extractor: Extractor | None = None, gone: DataFrame | None = None) -> int:
    """Take files (path, source, modified, length, content) into a library as its next version, and note the ones that are gone
    (path, source). The version is returned."""
    spark = files.sparkSession
    version = _next(spark, root)
    there = f"{root}/pages/version={version}"
    extracted(files, extractor).write.mode("overwrite").parquet(there)
    told = spark.read.parquet(there).groupBy("path").agg(F.count("page_number").alias("n_pages"), F.max("error").alias("error"))
    rows = files.drop("content").join(told, "path").select("path", "source", "modified", "length", "n_pages", "error", F.lit(False).alias("removed"))
    if gone is not None:
        rows = rows.unionByName(gone.select("path", "source", F.lit(True).alias("removed")), allowMissingColumns=True)
    _noted(rows, root, version)
    return version


def _changed(files: DataFrame, known: DataFrame) -> DataFrame:
    had = known.select("path", F.col("modified").alias("had"), F.col("length").alias("had_length"))
    return files.join(had, "path", "left").where("had is null or had != modified or had_length != length").drop("had", "had_length")


def refresh(spark: SparkSession, folder: str, root: str, extractor: Extractor | None = None) -> dict[str, int]:
    """Bring a library up to a folder: new and changed files are read, files that are gone leave, all others stay unread. Counts of
    the files taken and gone. The paths to read are the driver's, as Spark's listing of a folder is."""
    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True)
    where, system = _at(spark, folder)
    if not system.exists(where):
        return {"taken": 0, "gone": 0}
    listed = named(source.load(folder)).drop("content")
    known = log(spark, root)
    todo = [r.path for r in _changed(listed, known).select("path").toLocalIterator()]
    gone = known.join(listed, "path", "left_anti").select("path", "source")
    n_gone = gone.count()
    if todo or n_gone:
        files = named(source.load(todo)) if todo else named(spark.createDataFrame([], FILE))
        take(files, root, extractor, gone)
    return {"taken": len(todo), "gone": n_gone}


def follow(spark: SparkSession, folder: str, root: str, checkpoint: str, extractor: Extractor | None = None, files_per_batch: int = 1000, **trigger) -> StreamingQuery:
    """Take files into a library as they arrive in a folder. A batch that is run again after a failure takes nothing twice. A
    stream sees each path once: `refresh` takes files that change in place, and notes the ones that go."""

    def batch(rows: DataFrame, _: int) -> None:
        new = _changed(named(rows), log(rows.sparkSession, root))
        if new.drop("content").take(1):
            take(new, root, extractor)

    read = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return read.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compact(spark: SparkSession, root: str) -> None:
    """Write what counts as one version, then remove the versions before it."""
    version = _next(spark, root)
    now = log(spark, root)
    kept = _table(spark, root, "pages", PAGES).join(now.select("path", "version"), ["path", "version"], "left_semi")
    kept.drop("version").write.mode("overwrite").parquet(f"{root}/pages/version={version}")
    _noted(now.drop("version"), root, version)
    for name in ("files", "pages"):
        where, system = _at(spark, f"{root}/{name}")
        for status in system.listStatus(where):
            old = status.getPath().getName()
            if old.startswith("version=") and int(old.removeprefix("version=")) < version:
                system.delete(status.getPath(), True)
