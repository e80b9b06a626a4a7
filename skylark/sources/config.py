"""Settings from build files, environment files, properties and nested documents, as (path, key, value) rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that hold no modules of their own.
SKIPPED = ("target", "build", "node_modules", ".git")


def leaf_modules(files: DataFrame) -> DataFrame:
    """Build files (path, content) without modules of their own, outside of skipped folders."""
    folders = F.split("path", "/")
    return files.where(F.endswith("path", F.lit("pom.xml")) & ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED])) & ~F.xpath_boolean("content", F.lit("/project/modules/module")))


def artifact(content: Column) -> Column:
    """The artifact that a build file names."""
    return F.nullif(F.trim(F.xpath_string(content, F.lit("/project/artifactId/text()"))), F.lit(""))


def dependencies(files: DataFrame) -> DataFrame:
    """(path, artifact) of every dependency that a build file declares."""
    return files.select("path", F.explode(F.xpath("content", F.lit("//dependency/artifactId/text()"))).alias("artifact")).distinct()


def env_entries(files: DataFrame) -> DataFrame:
    """(path, ord, key, value) of NAME=value files: comments and blank lines aside, ``export`` and quotes taken off."""
    lines = files.select("path", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("ord", "line")).withColumn("line", F.regexp_replace(F.trim("line"), r"^export\s+", ""))
    pair = lines.where("line <> '' AND NOT startswith(line, '#') AND contains(line, '=')")
    value = F.trim(F.substring(F.col("line"), F.instr("line", "=") + 1, F.length("line")))
    bare = F.regexp_replace(value, "^(\"(.*)\"|'(.*)')$", "$2$3")
    return pair.select("path", "ord", F.trim(F.substring_index("line", "=", 1)).alias("key"), bare.alias("value"))


def property_entries(files: DataFrame) -> DataFrame:
    """(path, ord, key, value) of properties files: # and ! begin comments, = or : ends a key, a backslash joins lines."""
    joined = F.regexp_replace("content", r"\\(\r\n|\n|\r)[ \t]*", "")
    lines = files.select("path", F.posexplode(F.split(joined, "\r\n|\n|\r")).alias("ord", "line")).withColumn("line", F.ltrim("line"))
    pair = lines.where("line <> '' AND NOT startswith(line, '#') AND NOT startswith(line, '!')")
    at = r"^([^=:\s]+)\s*[=:\s]\s*(.*)$"
    return pair.where(F.rlike("line", F.lit(at))).select("path", "ord", F.regexp_extract("line", at, 1).alias("key"), F.regexp_extract("line", at, 2).alias("value"))


def _flat(value: object, key: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{key}.{k}" if key else str(k))
    elif isinstance(value, list) and any(isinstance(v, dict | list) for v in value):
        for i, v in enumerate(value):
            yield from _flat(v, f"{key}[{i}]")
    elif isinstance(value, list):
        yield key, ",".join(_text(v) for v in value)
    else:
        yield key, _text(value)


def _text(value: object) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def flattened(documents: DataFrame) -> DataFrame:
    """(path, ord, key, value) of nested JSON documents (path, content): dotted keys, lists joined by commas, lists of objects by number.

    What is no JSON object, or nests too deep, has no entries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = json.loads(content or "")
                    own = list(_flat(found, "")) if isinstance(found, dict) else []
                except (ValueError, RecursionError):
                    continue
                rows += [(path, i, k, v) for i, (k, v) in enumerate(own)]
            yield pd.DataFrame(rows, columns=["path", "ord", "key", "value"])

    return documents.select("path", "content").mapInPandas(run, "path string, ord int, key string, value string")


def _settings(value: dict, key: str) -> Iterator[tuple[str, str]]:
    for k, v in value.items():
        own = f"{key}{k}".strip()
        if isinstance(v, dict):
            yield from _settings(v, f"{own}.")
        elif isinstance(v, list):
            yield own, ",".join(str(x) for x in v)
        elif v is not None:
            yield own, str(v)


def entries_of_json(documents: DataFrame) -> DataFrame:
    """(path, ord, key, value) of settings in JSON documents: dotted keys, every list joined by commas, values as they are written in Python, none for null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = json.loads(content or "")
                    own = list(_settings(found, "")) if isinstance(found, dict) else []
                except (ValueError, RecursionError):
                    continue
                rows += [(path, i, k, v) for i, (k, v) in enumerate(own)]
            yield pd.DataFrame(rows, columns=["path", "ord", "key", "value"])

    return documents.select("path", "content").mapInPandas(run, "path string, ord int, key string, value string")


def profile_files(files: DataFrame, active: DataFrame) -> DataFrame:
    """The application files (service_id, name) that count, with their order: the base first, then those of active profiles (service_id, ord, profile)."""
    own = files.withColumn("_profile", F.nullif(F.regexp_extract("name", r"^application-(.+)\.[a-z]+$", 1), F.lit("")))
    base = own.where(F.rlike("name", F.lit(r"^application\.[a-z]+$"))).withColumn("file_ord", F.lit(0))
    chosen = own.join(active.select("service_id", F.col("profile").alias("_profile"), (F.col("ord") + 1).cast("int").alias("file_ord")), ["service_id", "_profile"])
    return base.unionByName(chosen).drop("_profile")


def merged(entries: DataFrame) -> DataFrame:
    """Of entries (service_id, file_ord, ord, key, value) the value of each key that comes last."""
    return entries.groupBy("service_id", "key").agg(F.max_by("value", F.struct("file_ord", "ord")).alias("value"))


def allowed(key: Column, prefixes: tuple[str, ...], names: tuple[str, ...]) -> Column:
    """Whether a setting may be carried: by its name or a prefix, in either spelling."""
    dotted = F.lower(F.replace(key, F.lit("_"), F.lit(".")))
    out = dotted.isin(*names)
    for p in prefixes:
        out = out | dotted.startswith(p)
    return out
