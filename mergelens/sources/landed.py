"""Landed files of other systems: a raw diff or a JSON list of changed files per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A changed file as it is listed; unknown fields are ignored.
LISTED = "array<struct<filename:string,status:string,additions:int,deletions:int,patch:string,previous_filename:string>>"


def land(texts: DataFrame, key: str, text: str, path: str) -> None:
    """A folder per ``key`` with a text file that holds ``text``; rows without either are left out."""
    texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).repartition(key).write.mode("overwrite").partitionBy(key).text(path, lineSep="\n")


def read_texts(spark: SparkSession, path: str, key: str, kind: str = "string") -> DataFrame:
    """``key`` and ``text`` of all landed files, a row each, read whole; the writer's line feed at the end is taken off."""
    files = spark.read.schema(f"value string, {key} {kind}").text(path, wholetext=True)
    return files.select(key, F.regexp_replace("value", r"\n\z", "").alias("text"))


def file_list(text: Column) -> Column:
    """The changed files of a landed list, null if it is malformed."""
    return F.from_json(text, LISTED)


def changed_files(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row per changed file of landed lists: ``key``, ``file_no`` from 1 and the file's fields."""
    rows = texts.select(key, F.posexplode_outer(file_list(F.col(text))).alias("at", "f")).where("f IS NOT NULL")
    return rows.select(key, (F.col("at") + 1).alias("file_no"), F.col("f.filename").alias("file_path"), "f.status", "f.additions", "f.deletions", "f.patch")
