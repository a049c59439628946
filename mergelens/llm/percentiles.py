"""Problem 6: percentiles with bounded rank error from mergeable summaries.

A summary is a list of kept values with three counts each: items up to the value, at
least and at most, and items below it, at most. Fresh summaries are exact; merging adds the
intervals of neighbours, so the rank error stays the same part of the count; only
compression spends from the permitted error, a share on each level of the hierarchy and
one for longer spans. Python tasks build one summary per group and slice of their input;
slices are merged about 64 at a time, on as many levels as their number asks for, so no
task ever gets a whole group, however large. Tasks stream over sorted summaries and
hold those of one bucket at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelens.session import cut_lineage, ship

#: Permitted rank error as a part of the count: of any summary, of one before it is combined, and of a leaf.
EPSILON, PART, LEAF = 0.001, 0.00075, 0.00025
#: Summaries merged at once, on average, and values a leaf buffers.
FAN, BUFFER = 64, 1_000_000
QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}

#: Kept values, items up to each (at least, at most), items below each (at most).
Summary = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
COLUMNS = ("kept", "at_least", "at_most", "below")


def exact(values: np.ndarray) -> Summary:
    kept, counts = np.unique(values, return_counts=True)
    upto = np.cumsum(counts)
    return kept, upto, upto.copy(), upto - counts


def merge_two(a: Summary, b: Summary) -> Summary:
    values = np.union1d(a[0], b[0])
    low, high, below = (np.zeros(len(values), dtype=np.int64) for _ in range(3))
    for kept, at_least, at_most, under in (a, b):
        if not len(kept):
            continue
        at = np.searchsorted(kept, values, side="right") - 1  # the last kept value up to each value
        own, nxt = np.maximum(at, 0), np.minimum(at + 1, len(kept) - 1)
        same = (at >= 0) & (kept[own] == values)
        before_next = np.where(at + 1 < len(kept), under[nxt], at_most[-1])
        low += np.where(at >= 0, at_least[own], 0)
        high += np.where(same, at_most[own], before_next)
        below += np.where(same, under[own], before_next)
    return values, low, high, below


def merge(summaries: list[Summary]) -> Summary:
    while len(summaries) > 1:
        summaries = [merge_two(*summaries[i : i + 2]) if i + 1 < len(summaries) else summaries[i] for i in range(0, len(summaries), 2)]
    return summaries[0]


def compress(s: Summary, permitted: float) -> Summary:
    """Fewest values with at most twice the ``permitted`` ranks between neighbours, ends included.

    A value that more items than that share stays next to its neighbours, so piles cost nothing."""
    values, low, _, below = s
    if permitted < 0.5 or len(values) <= 2:
        return s
    keep, at = [0], 0
    while at < len(values) - 1:
        at = max(at + 1, int(np.searchsorted(below, low[at] + 2 * permitted, side="right")) - 1)
        keep.append(at)
    return tuple(x[keep] for x in s)


def quantile(s: Summary, n: int, q: float) -> tuple[int, int]:
    """(value, bound on the distance in ranks of its items from rank ceil(q n))."""
    values, low, _, below = s
    rank = max(1, int(np.ceil(q * n - 1e-9)))
    error = np.maximum(np.maximum(rank - low, below + 1 - rank), 0)
    at = int(error.argmin())
    return int(values[at]), int(error[at])


def summaries(df: DataFrame, keys: list[str], value: str, epsilon: float = PART, fan: int = FAN, buffer: int = BUFFER) -> DataFrame:
    """One summary per ``keys``: ``n``, ``kept``, ``at_least``, ``at_most``, ``below``.

    Null and negative values don't count; null keys are a group of their own; ties and
    repeated rows count as often as they stand. Groups without a value, and empty
    tables, have no row. The rank error is at most ``epsilon * n``, whatever the
    partitions. Other columns, of any name, are ignored.
    """
    names = [f"key_{i}" for i in range(len(keys))]
    data = df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], F.col(value).cast("bigint").alias("value")).where("value >= 0").withColumn("task", F.spark_partition_id())
    fields = {f.name: f.dataType for f in data.schema}
    schema = T.StructType([T.StructField(a, fields[a]) for a in names] + [T.StructField("slice", T.LongType()), T.StructField("n", T.LongType())] + [T.StructField(c, T.ArrayType(T.LongType())) for c in COLUMNS])
    leaf = epsilon * LEAF / PART
    ship(df.sparkSession)

    def flush(parts: list[pd.DataFrame], slices: list[int]) -> pd.DataFrame:
        whole = pd.concat(parts, ignore_index=True)
        out = []
        for key, own in whole.groupby(names, dropna=False, sort=True):
            key = [None if pd.isna(k) else k for k in key]
            got = own["value"].to_numpy(dtype=np.int64)
            out.append((*key, _mixed(slices[0]), len(got), *compress(exact(got), leaf * len(got))))
        slices[0] += 1
        return pd.DataFrame(out, columns=schema.names)

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, rows, slices = [], 0, None
        for frame in frames:
            if not len(frame):
                continue
            slices = slices or [int(frame["task"].iloc[0]) << 32]
            parts.append(frame)
            rows += len(frame)
            if rows >= buffer:
                yield flush(parts, slices)
                parts, rows = [], 0
        if parts:
            yield flush(parts, slices)

    level = cut_lineage(data.mapInPandas(leaves, schema))
    most = level.groupBy(*names).count().agg(F.max("count")).first()[0] if names else level.count()
    steps = []  # buckets on each level, down to one
    while not steps or steps[-1] > 1:
        steps.append(max(1, math.ceil((steps[-1] if steps else most or 1) / fan)))
    for i, buckets in enumerate(steps):
        level = level.withColumn("slice", F.pmod("slice", F.lit(buckets)) if i == 0 else F.floor(F.col("slice") / fan).cast("bigint"))
        level = _merged(level, [*names, "slice"], schema, leaf + (epsilon - leaf) * (i + 1) / len(steps))
    return level.drop("slice").toDF(*keys, "n", *COLUMNS)


def _mixed(n: int) -> int:
    """A number that spreads tasks and their buffers over buckets alike."""
    return (n * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 33


def _merged(df: DataFrame, names: list[str], schema: T.StructType, permitted: float) -> DataFrame:
    def join(key: tuple, rows: list[tuple]) -> tuple:
        if len(rows) == 1:
            return (*key, *rows[0])
        n = int(sum(r[0] for r in rows))
        s = merge([tuple(np.asarray(x, dtype=np.int64) for x in r[1:]) for r in rows])
        return (*key, n, *(compress(s, permitted * n) if permitted else s))

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, out = None, [], []
        for frame in frames:
            keys = zip(*[[None if pd.isna(v) else v for v in frame[k]] for k in names]) if names else iter([()] * len(frame))
            for key, row in zip(keys, zip(frame["n"], *[frame[c] for c in COLUMNS])):
                if rows and key != now:
                    out.append(join(now, rows))
                    rows = []
                    if len(out) >= 500:
                        yield pd.DataFrame(out, columns=schema.names)
                        out = []
                now = key
                rows.append(row)
        if rows:
            out.append(join(now, rows))
        if out:
            yield pd.DataFrame(out, columns=schema.names)

    return df.select(*schema.names).repartition(*names).sortWithinPartitions(*names).mapInPandas(stream, schema)


def combine(parts: DataFrame, keys: list[str], through: list | None = None, epsilon: float = EPSILON, within: float = PART) -> DataFrame:
    """Summaries of ``keys`` from those of shorter spans with a rank error of ``within`` at most.

    Merging keeps the error the same part of the count, and what ``epsilon`` permits
    beyond it is spent on compression, so a long span's summary doesn't grow with the
    number of its days. ``through`` are expressions of spans in between (months, say)
    that bound how many summaries meet in a task."""
    ship(parts.sparkSession)
    out, spans = parts, ([through, []] if through else [[]])
    for i, own in enumerate(spans):
        named = [e.alias(f"span_{k}") for k, e in enumerate(own)]
        sub = out.select(*keys, *named, "n", *COLUMNS)
        out = _merged(sub, sub.columns[: len(keys) + len(named)], sub.schema, within + (epsilon - within) * (i + 1) / len(spans))
    return out.select(*keys, "n", *COLUMNS)


def percentiles(parts: DataFrame, keys: list[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """``keys``, ``n``, a column per quantile, and ``max_rank_error``: the bound, in ranks, that holds for all of them."""
    ship(parts.sparkSession)
    wanted = quantiles or QUANTILES
    result = T.StructType([T.StructField(k, T.LongType()) for k in (*wanted, "max_rank_error")])

    @F.pandas_udf(result)
    def read(n: pd.Series, kept: pd.Series, low: pd.Series, high: pd.Series, below: pd.Series) -> pd.DataFrame:
        out = []
        for count, *row in zip(n, kept, low, high, below):
            s = tuple(np.asarray(x, dtype=np.int64) for x in row)
            got = [quantile(s, int(count), q) for q in wanted.values()]
            out.append((*[v for v, _ in got], max(e for _, e in got)))
        return pd.DataFrame(out, columns=result.names)

    return parts.withColumn("read", read("n", *COLUMNS)).select(*keys, "n", *[F.col("read")[k].alias(k) for k in result.names])


def call_latencies(results: DataFrame) -> DataFrame:
    """``provider`` (the name before any fallback note), ``day`` and ``latency_ms`` of each call; a result id counts once.

    Rows without an id can't be told to be repeats and all count."""
    row = F.struct(F.regexp_extract(F.col("provider"), r"^\s*(\S+)", 1).alias("provider"), F.to_date("created_at").alias("day"), F.col("latency_ms").alias("latency_ms"))
    once = results.where("result_id IS NOT NULL").groupBy("result_id").agg(F.min(row).alias("call")).select("call.*")
    return once.unionByName(results.where("result_id IS NULL").select(row.alias("call")).select("call.*"))
