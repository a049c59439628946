"""Structured Streaming intake of change events from landed JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mergelens.operators import ingest

LANDED = "event_id bigint, event_type string, signature string, body string, received_at timestamp"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_trigger).json(path)


def drop_repeats(judged: DataFrame, delay: str = "1 day") -> DataFrame:
    """An option: one event per repository, number and head commit within the delay."""
    e = F.col("e")
    keyed = judged.withColumns({"k_name": e["repository"]["full_name"], "k_number": e["pull_request"]["number"], "k_sha": e["pull_request"]["head"]["sha"]})
    if judged.isStreaming:
        return keyed.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["k_name", "k_number", "k_sha"])
    return keyed.dropDuplicates(["k_name", "k_number", "k_sha"])


def run(spark: SparkSession, path: str, repositories: DataFrame, out: str, checkpoint: str, secret: str | None, files_per_trigger: int = 1000) -> StreamingQuery:
    """Judges all events landed at ``path`` and ends.

    Each micro-batch writes its own folder under ``out`` and overwrites it when it is
    run again, so a restart leaves no repeats. Rows: ``event_id``, ``reason`` (null if
    accepted), and the fields of the new request, null if dropped."""
    judged = ingest.judge_events(read_events(spark, path, files_per_trigger), repositories, secret)
    e = F.col("e")
    rows = judged.select("event_id", "reason", "repository_id", e["repository"]["full_name"].alias("repository_full_name"), e["pull_request"]["number"].alias("platform_pr_id"), e["pull_request"]["head"]["sha"].alias("head_sha"), F.col("received_at").alias("created_at"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
