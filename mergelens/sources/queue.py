"""The message queue as files: appended by a batch or a stream, read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

MESSAGES = "message map<string,string>, enqueued_at timestamp"


def append(messages: DataFrame, path: str, at=None) -> None:
    """Adds messages (a column ``message``) to the queue at ``path``."""
    messages.select("message", (F.current_timestamp() if at is None else at).alias("enqueued_at")).write.mode("append").json(path)


def append_stream(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that adds a stream of messages; its checkpoint makes every row appear once."""
    out = messages.select("message", F.current_timestamp().alias("enqueued_at"))
    return out.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def consume(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The queue as a stream; what was read is remembered by the checkpoint of the query that reads it."""
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def split_unnamed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with a request id, and those without, for a dead-letter sink."""
    named = F.col("message")["reviewRequestId"].isNotNull()
    return messages.where(named), messages.where(~named)
