"""The worker: messages of the queue as a stream, processed, and acknowledged only where that succeeded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mergelens.operators import store
from mergelens.sources import queue


def run(spark: SparkSession, path: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_trigger: int = 1) -> StreamingQuery:
    """Works off all messages landed at ``path`` and ends.

    ``process`` gets the distinct request ids of a micro-batch (``review_request_id``)
    and gives results with ``id`` and ``status``. Under ``out`` each micro-batch writes
    folders of its own, which it overwrites when it is run again: ``results``;
    ``acknowledged`` messages, whose request was completed; ``pending`` ones, whose request
    failed or isn't known, to be put into the queue again; and ``dead`` ones without an
    id. A message that comes twice in a batch is processed once and acknowledged twice."""

    def write(batch: DataFrame, number: int) -> None:
        named, unnamed = queue.split_unnamed(batch)
        save = lambda df, kind: df.write.mode("overwrite").json(f"{out}/{kind}/batch={number}")
        save(unnamed.select("message"), "dead")
        keyed = named.select("message", F.col("message")["reviewRequestId"].alias("review_request_id"))
        results = f"{out}/results/batch={number}"
        process(store.read_messages(named).select("review_request_id").distinct()).write.mode("overwrite").parquet(results)
        completed = batch.sparkSession.read.parquet(results).where("status = 'COMPLETED'").select(F.col("id").alias("done"))
        judged = keyed.join(completed, F.col("review_request_id") == F.col("done"), "left").select("message", "done")
        save(judged.where("done IS NOT NULL").select("message"), "acknowledged")
        save(judged.where("done IS NULL").select("message"), "pending")

    stream = queue.consume(spark, path, files_per_trigger)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def retry(spark: SparkSession, out: str, path: str) -> None:
    """Puts all pending messages into the queue again, as a consumer that reads its pending entries would."""
    queue.append(spark.read.schema("message map<string,string>").json(f"{out}/pending/*"), path)
