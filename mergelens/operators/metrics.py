"""Tagged counters, timers and gauges as aggregations over metric events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the metric series.
NAMES = ("review.total", "review.duration.ms", "review.tokens.total", "review.cost.usd", "review.fallback.total", "review.comments.total", "model.circuit.state", "webhook.received.total", "queue.depth")
#: Gauge values of the states of a breaker.
BREAKER_VALUES = {"CLOSED": 0, "HALF_OPEN": 1, "OPEN": 2}


def counter(df: DataFrame, name: str, tags: list[str], amount: Column | None = None) -> DataFrame:
    """``metric``, ``tags`` as a map, ``value``: rows, or the sum of ``amount``, per combination of tags."""
    value = F.count(F.lit(1)).cast("double") if amount is None else F.coalesce(F.sum(amount), F.lit(0)).cast("double")
    grouped = df.groupBy(*tags).agg(value.alias("value")) if tags else df.agg(value.alias("value"))
    return grouped.select(F.lit(name).alias("metric"), tag_text(tags), "value")


def tag_text(tags: list[str]) -> Column:
    """Tags as name=value, joined by commas; null as none."""
    parts = [F.concat(F.lit(f"{t}="), F.coalesce(F.col(t).cast("string"), F.lit("none"))) for t in tags]
    return (F.concat_ws(",", *parts) if parts else F.lit("")).alias("tags")


def timer(df: DataFrame, name: str, tags: list[str], duration: Column) -> DataFrame:
    """Count, total and greatest of ``duration``, a row each."""
    base = df.groupBy(*tags).agg(F.count(duration).cast("double").alias("count"), F.sum(duration).cast("double").alias("sum"), F.max(duration).cast("double").alias("max"))
    return base.unpivot(tags, ["count", "sum", "max"], "part", "value").select(F.concat(F.lit(f"{name}."), F.col("part")).alias("metric"), tag_text(tags), "value")


def cost(df: DataFrame, tags: list[str], prices: DataFrame, key: str) -> DataFrame:
    """Sum of tokens times the caller's prices (``key``, ``input_price``, ``output_price``)."""
    priced = df.join(prices, key, "left")
    return counter(priced, "review.cost.usd", tags, F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price"))


def gauge(df: DataFrame, name: str, tags: list[str], value: Column, order: list[str]) -> DataFrame:
    """The last value per combination of tags, by ``order``."""
    return df.groupBy(*tags).agg(F.max_by(value.cast("double"), F.struct(*order)).alias("value")).select(F.lit(name).alias("metric"), tag_text(tags), "value")


def breaker_value(state: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in BREAKER_VALUES.items() for x in p])[state]


def queue_depth(changes: DataFrame, partition: list[str], order: list[str], delta: str = "delta") -> DataFrame:
    """``changes`` with ``depth``: the running sum of ``delta`` per ``partition``."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.withColumn("depth", F.sum(delta).over(w))
