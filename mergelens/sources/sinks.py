"""Sinks: reviews to post, as JSON folders that a second run overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from mergelens.operators import render


def review_posts(results: DataFrame) -> DataFrame:
    """``repository_full_name``, ``platform_pr_id`` and ``body`` JSON of results that have comments."""
    return results.where(F.size("comments") > 0).select("repository_full_name", "platform_pr_id", render.review_post(F.col("comments")).alias("body"))


def post(results: DataFrame, path: str) -> None:
    review_posts(results).write.mode("overwrite").json(path)


def post_stream(results: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A folder per micro-batch, so that a batch that runs again leaves no repeats."""

    def write(batch: DataFrame, number: int) -> None:
        post(batch, f"{path}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
