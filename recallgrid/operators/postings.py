"""A keyword index: postings, document lengths and statistics, written once and read by terms.

Postings are one row for each place of a term in a document. Documents are dealt evenly by their id, and each file is
sorted by term, so a query that names its terms reads of each file the row groups of these alone, no term is one
task's, and building takes one shuffle of the texts. The index is found again by the files that it was built from
(paths, lengths and times); other files get an index of their own. It is built where there is none and documents exist.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.functions.text import query_phrases, tokens

#: Bytes of text that a file of postings stands for on average. A task sorts one file, whose rows take some twenty times as much memory.
FILE_BYTES = 16 << 20


@dataclass
class Index:
    """Postings (term, id, pos, len), len the document's length, and a row of statistics (n, avg_len)."""

    postings: DataFrame
    stats: DataFrame


def occurrences(docs: DataFrame, content: str = "content") -> DataFrame:
    """(term, id, pos, len) of each place of each document that isn't null."""
    rows = docs.where(F.col(content).isNotNull()).select("id", tokens(content).alias("toks"))
    # posexplode would have Spark look for texts without tokens first, and so tokenise each text once more, below the exchange of build.
    placed = rows.select("id", F.size("toks").cast("long").alias("len"), F.posexplode_outer("toks").alias("pos", "term"))
    return placed.where("term is not null").select("term", "id", "pos", "len")


def statistics(docs: DataFrame, content: str = "content") -> DataFrame:
    lengths = docs.where(F.col(content).isNotNull()).select(F.size(tokens(content)).cast("long").alias("len"))
    return lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def build(docs: DataFrame, path: str, content: str = "content") -> None:
    """Write the index of documents under a path."""
    spark = docs.sparkSession
    n, size = docs.agg(F.count(content), F.coalesce(F.sum(F.octet_length(content)), F.lit(0))).first()
    files = max(spark.sparkContext.defaultParallelism, 1 + size // FILE_BYTES)
    placed = occurrences(docs.repartition(files, "id"), content).sortWithinPartitions("term", "id", "pos")
    placed.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    # A row for each token: their number and the documents' give the average length, and no text is tokenised for it.
    average = spark.read.schema(placed.schema).parquet(f"{path}/postings").agg(F.lit(n).cast("long").alias("n"), F.when(F.lit(n) > 0, F.count("*") / F.lit(n).cast("double")).alias("avg_len"))
    average.write.parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats").select("n", "avg_len"))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(docs: DataFrame) -> str:
    """A hash of the paths, lengths and times of the files that a frame reads."""
    told = []
    for name in sorted(docs.inputFiles()):
        where, system = _files(docs.sparkSession, name)
        status = system.getFileStatus(where)
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:32]


def shared_root(spark: SparkSession) -> str:
    """Where indexes are kept: under spark.checkpoint.dir, else under the warehouse; both are shared by all executors."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(found or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/keyword-index"


def ensure(docs: DataFrame, root: str | None = None, content: str = "content") -> Index:
    """The index of documents read from files, built if it isn't there. It is written beside and moved into place whole, so a
    build that dies leaves nothing that could be taken for an index, and of two builders the first stays."""
    spark = docs.sparkSession
    path = f"{root or shared_root(spark)}/{fingerprint(docs)}"
    where, system = _files(spark, path)
    if not system.exists(where):
        aside = f"{path}-{uuid.uuid4().hex}"
        build(docs, aside, content)
        source, _ = _files(spark, aside)
        if system.exists(where) or not system.rename(source, where):
            system.delete(source, True)
    return load(spark, path)


def of(docs: DataFrame, content: str = "content") -> Index:
    """The index of documents as a plan, for frames that no files stand behind."""
    return Index(occurrences(docs, content), statistics(docs, content))


def matches(index: Index, asked: list[tuple[int, str]], ids: DataFrame | None = None) -> DataFrame:
    """(query_id, phrase, of, id, len, tf) of each phrase of each query, with how many phrases the query has. Terms are literal
    in the filter of the scan; a phrase of several terms counts the places where they stand side by side."""
    wanted = [(q, i, len(phrases), offset, len(p), term) for q, text in asked for phrases in [query_phrases(text)] for i, p in enumerate(phrases) for offset, term in enumerate(p)]
    spark = index.postings.sparkSession
    terms = spark.createDataFrame(wanted, "query_id long, phrase int, of int, offset int, width int, term string")
    hits = index.postings.where(F.col("term").isin(sorted({w[-1] for w in wanted}))) if wanted else index.postings.where("false")
    if ids is not None:
        hits = hits.join(ids, "id", "left_semi")
    hits = hits.join(F.broadcast(terms), "term")
    key = ["query_id", "phrase", "of", "id", "len"]
    single = hits.where("width = 1").groupBy(*key).agg(F.count("*").alias("tf"))
    if all(w[4] == 1 for w in wanted):
        return single
    starts = hits.where("width > 1").groupBy(*key, "width", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count("*").alias("met"))
    return single.unionByName(starts.where("met = width").groupBy(*key).agg(F.count("*").alias("tf")))


def bm25_many(index: Index, asked: list[tuple[int, str]], k: int | None = None, k1: float = 1.2, b: float = 0.75, places: int | None = None) -> DataFrame:
    """(query_id, id, score) of the documents that hold every phrase of their query; of each query the k best, if k is given.
    With places, scores are rounded before they are ranked."""
    found = matches(index, asked)
    df = found.groupBy("query_id", "phrase").agg(F.count("*").alias("df"))
    both = found.join(F.broadcast(df), ["query_id", "phrase"]).crossJoin(F.broadcast(index.stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = both.groupBy("query_id", "id", "of").agg(F.sum(part).alias("score"), F.count("*").alias("held")).where("held = of").select("query_id", "id", "score")
    if places is not None:
        scored = scored.withColumn("score", F.round("score", places))
    if k is None:
        return scored
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def bm25(index: Index, query: str, k: int | None = None, places: int | None = None) -> DataFrame:
    """(id, score) of the documents that hold every phrase of the query, best first."""
    out = bm25_many(index, [(0, query)], places=places).select("id", "score").orderBy(F.desc("score"), "id")
    return out if k is None else out.limit(k)
