"""File sources: notes, manifests, sidecars, settings and document folders, read through Spark."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, fields
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def lenses(spark: SparkSession, folder: str) -> DataFrame:
    """(name, description, body) of the markdown files in a folder. A first line that starts with # is the description."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select("value", _stem(F.col("_metadata.file_path")).alias("name"))
    headed = F.col("value").startswith("#") & F.col("value").contains("\n")
    first = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "^#+", ""))
    rest = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"^\s+", "")
    return raw.select("name", F.when(headed, first).otherwise("").alias("description"), F.when(headed, rest).otherwise(F.col("value")).alias("body"))


def lens_name(name: str) -> str | None:
    """Letters, digits, hyphens and underscores alone; none if nothing is left."""
    return "".join(c for c in name if c.isalnum() or c in "-_") or None


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, version, instructions) of the TOML manifests that hold all three, none blank; others are left out."""

    @F.udf("struct<name:string,version:string,instructions:string>")
    def parse(text):
        try:
            t = tomllib.loads(text)
            found = t["meta"]["name"], t["meta"]["version"], t["instructions"]["content"]
            return found if all(isinstance(x, str) and x.strip() for x in found) else None
        except (tomllib.TOMLDecodeError, KeyError, TypeError):
            return None

    raw = spark.read.option("pathGlobFilter", "*.toml").option("recursiveFileLookup", True).text(folder, wholetext=True)
    return raw.select(parse("value").alias("m")).where("m is not null").select("m.*")


CITATION = "author string, year string, title string, edition string, doi string, url string, publisher string"


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(source, citation, memories, related_sources) of the .meta.json files; one that can't be read has nulls."""
    schema = f"citation struct<{CITATION.replace(' string', ':string')}>, memories array<string>, related_sources array<string>"
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.meta.json").json(folder)
    return read.select(F.regexp_replace(_stem(F.col("_metadata.file_path")), r"\.meta$", "").alias("source"), "citation", "memories", "related_sources")


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source, path, modified, error) of the .pdf files in a folder; a file without the format's mark carries an error. Text
    extraction is a pluggable step after this."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    bad = F.when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF file")
    return read.select(_stem(F.col("path")).alias("source"), "path", F.col("modificationTime").alias("modified"), bad.alias("error"))


def stale(files: DataFrame, indexes: DataFrame) -> DataFrame:
    """Files whose index is missing or older than they are."""
    have = indexes.select("source", F.col("modified").alias("indexed"))
    return files.join(have, "source", "left").where("indexed is null or indexed < modified").drop("indexed")


@dataclass
class Settings:
    """All settings with their defaults; out-of-range values are brought into range."""

    decay_rate_per_day: float = 0.05
    decay_interval_hours: float = 1.0
    propagation_damping: float = 0.5
    hebbian_learning_rate: float = 0.1
    recall_strength: float = 0.2
    association_decay_rate: float = 1.0
    min_association_weight: float = 0.05
    search_follow_associations: bool = True
    search_association_depth: int = 1
    rerank_mode: str = "llm"
    rerank_candidates: int = 30
    hybrid_search_enabled: bool = True
    query_expansion_enabled: bool = True
    llm_rerank_candidates: int = 20
    search_min_score: float = 0.3
    composite_limit_min: int = 15
    composite_limit_max: int = 30
    association_cap_min: int = 5
    association_cap_max: int = 12
    session_context_weight: float = 0.3
    session_max_queries: int = 50
    session_centroid_smoothing: float = 0.1
    session_expire_days: int = 90
    debug: bool = False

    # Ranges of what may be set.
    RANGES: ClassVar[dict] = {
        "search_association_depth": (0, 5), "rerank_candidates": (5, 200), "llm_rerank_candidates": (1, 100), "search_min_score": (0.0, 1.0),
        "composite_limit_min": (1, 100), "composite_limit_max": (1, 200), "association_cap_min": (1, 50), "association_cap_max": (1, 50),
    }

    def __post_init__(self):
        for name, (low, high) in self.RANGES.items():
            setattr(self, name, min(max(getattr(self, name), low), high))


def settings(text: str) -> Settings:
    """Settings of a TOML text's [brain] table. A value of another type than the setting's counts as not given."""
    try:
        given = tomllib.loads(text).get("brain", {})
    except tomllib.TOMLDecodeError:
        given = {}
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    return Settings(**{k: v for k, v in given.items() if k in kinds and type(v) is kinds[k]})


def with_setting(text: str, key: str, value: bool | int | float | str) -> str:
    """A TOML text with one setting of its [brain] table, which is made if it lacks; comments and everything else stay as they are."""
    if key not in {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown setting {key!r}")
    said = json.dumps(value) if isinstance(value, (bool, str)) else repr(value)
    lines = text.splitlines()
    heads = [i for i, line in enumerate(lines) if re.match(r"\s*\[", line)]
    at = next((i for i in heads if re.match(r"\s*\[\s*brain\s*\]", lines[i])), None)
    if at is None:
        return "\n".join([*lines, *([""] if lines else []), "[brain]", f"{key} = {said}"]) + "\n"
    end = next((i for i in heads if i > at), len(lines))
    for i in range(at + 1, end):
        old = re.match(rf"(\s*{key}\s*=\s*)(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^#]*?)(\s*(?:#.*)?)$", lines[i])
        if old:
            lines[i] = f"{old[1]}{said}{old[3]}"
            break
    else:
        while end > at + 1 and not lines[end - 1].strip():
            end -= 1
        lines.insert(end, f"{key} = {said}")
    return "\n".join(lines) + "\n"


def copy_document(spark: SparkSession, source: str, folder: str) -> str:
    """Copy a .pdf file under its sanitised name into a folder, with _2, _3 and so on if that name is taken; the path it has now.
    A file without the format's mark raises a ValueError."""
    from recallgrid.functions.scalars import sanitized_name

    if document_files(spark, source).where("error is not null").count():
        raise ValueError(f"{source} is not a PDF file")
    name = spark.range(1).select(sanitized_name(F.lit(source.rstrip("/").rsplit("/", 1)[-1]))).first()[0]
    hadoop, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    here, there = path(source), path(folder)
    system = there.getFileSystem(hadoop)
    system.mkdirs(there)
    taken = {status.getPath().getName() for status in system.listStatus(there)}
    out = path(f"{folder.rstrip('/')}/{sanitized_copy_name(name, taken)}")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(here.getFileSystem(hadoop), here, system, out, False, hadoop)
    return out.toString()


def sanitized_copy_name(name: str, taken: set[str]) -> str:
    """A name that is not taken yet: with _2, _3 and so on before the ending."""
    stem, dot, ending = name.rpartition(".")
    stem, ending = (stem, dot + ending) if dot else (name, "")
    out, n = name, 2
    while out in taken:
        out, n = f"{stem}_{n}{ending}", n + 1
    return out


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) of extracted document texts, ready for paging."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return raw.select(_stem(F.col("_metadata.file_path")).alias("source"), F.col("value").alias("text"))
