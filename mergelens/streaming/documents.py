"""Documents upserted by a stream, and progress of streams for export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from mergelens.operators import store


def upsert_stream(stream: DataFrame, base: str, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Upserts each micro-batch of whole documents and ends with the last one that has landed.

    The table at ``base`` stays; batch n writes ``path``/version=n from the version before
    it, so a batch that is run again gives the same. Read the last one with ``current``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(base if number == 0 else f"{path}/version={number - 1}")
        store.upsert(before, batch.select(*before.columns), key).write.mode("overwrite").parquet(f"{path}/version={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last version under ``path``."""
    versions = spark.read.option("basePath", path).parquet(f"{path}/*").select("version").distinct().agg({"version": "max"}).first()[0]
    return spark.read.parquet(f"{path}/version={versions}")


class Progress(StreamingQueryListener):
    """Hands the name, batch, rows and observed counters of each finished micro-batch to ``export``."""

    def __init__(self, export: Callable[[dict], None]) -> None:
        self.export = export

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
        self.export({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "observed": seen})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
