import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergelens.llm import percentiles as P


def true_error(values, answer, q):
    rank = max(1, int(np.ceil(q * len(values) - 1e-9)))
    return max((values < answer).sum() + 1 - rank, rank - (values <= answer).sum(), 0)


@pytest.mark.parametrize("seed", range(12))
def test_error_stays_within_the_bound(seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.lognormal(8, 1.5, 20_000).astype(np.int64), np.full(9_000, 60_000), rng.integers(0, 50, 3_000)])
    rng.shuffle(values)
    eps, parts = 0.005, np.array_split(values, 37)
    leaves = [P.compress(P.exact(p), eps / 2 * len(p)) for p in parts]
    whole = P.compress(P.merge(leaves), eps * len(values))
    assert len(whole[0]) < 1_000
    for q in (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 0.999, 1.0):
        answer, bound = P.quantile(whole, len(values), q)
        assert true_error(values, answer, q) <= bound <= eps * len(values) + 1
    for v, low, high, below in zip(*whole):
        assert low <= (values <= v).sum() <= high and (values < v).sum() <= below


def test_exact_when_small():
    values = np.array([5, 1, 5, 9])
    assert [P.quantile(P.exact(values), 4, q) for q in (0.25, 0.5, 0.75, 1.0)] == [(1, 0), (5, 0), (5, 0), (9, 0)]


def test_hierarchy_in_spark(spark):
    rng = np.random.default_rng(1)
    lat = rng.lognormal(8, 1, 30_000).astype(int)
    day = [datetime.date(2025, 1, 1 + int(d)) for d in rng.integers(0, 3, len(lat))]
    rows = list(zip(["hot" if i % 10 else "cold" for i in range(len(lat))], day, lat.tolist()))
    rows += [(None, day[0], 7), ("cold", None, 8), ("cold", day[0], None), ("cold", day[0], -5), ("none", day[0], -1)]
    df = spark.createDataFrame(rows, "provider string, day date, latency_ms bigint").withColumn("value", F.lit("x")).withColumn("n", F.lit(0)).repartition(7)
    daily = P.summaries(df, ["provider", "day"], "latency_ms", epsilon=0.01, fan=3, buffer=500)
    total = P.combine(daily, ["provider"], [F.trunc("day", "month")], epsilon=0.01, within=0.01)
    got = {r.provider: r for r in P.percentiles(total, ["provider"]).collect()}
    assert set(got) == {"hot", "cold", None}
    for name in ("hot", "cold"):
        own = np.array([v for p, _, v in rows if p == name and v is not None and v >= 0])
        assert got[name].n == len(own) and got[name].max_rank_error <= 0.01 * len(own) + 1
        for k, q in P.QUANTILES.items():
            assert true_error(own, got[name][k], q) <= got[name].max_rank_error
    assert got[None].p50 == 7
    assert P.summaries(df.limit(0), ["provider"], "latency_ms").count() == 0


def test_an_id_counts_once(spark):
    ts = datetime.datetime(2025, 1, 1)
    rows = [(1, "a (fallback from b)", ts, 5), (1, "a (fallback from b)", ts, 5), (None, "a", ts, 6), (None, "a", ts, 6), (2, None, ts, None)]
    df = spark.createDataFrame(rows, "result_id bigint, provider string, created_at timestamp, latency_ms bigint")
    assert sorted((r.provider or "", r.latency_ms or 0) for r in P.call_latencies(df).collect()) == [("", 0), ("a", 5), ("a", 6), ("a", 6)]


def test_long_spans_stay_small_and_within_their_bound(spark):
    """Summaries of three hundred days combine into one that has grown little, and whose bound still holds."""
    rng = np.random.default_rng(3)
    lat = rng.lognormal(8, 1, 60_000).astype(int)
    df = spark.createDataFrame([("p", int(d), int(v)) for d, v in zip(rng.integers(0, 300, len(lat)), lat)], "provider string, day int, latency_ms bigint").repartition(5)
    daily = P.summaries(df, ["provider", "day"], "latency_ms", epsilon=0.01, buffer=4_000).cache()
    row = P.combine(daily, ["provider"], [F.floor(F.col("day") / 30)], epsilon=0.012, within=0.01).first()
    assert row.n == len(lat) and len(row.kept) < 1 / (0.012 - 0.01)
    got = P.percentiles(P.combine(daily, ["provider"], epsilon=0.012, within=0.01), ["provider"]).first()
    assert got.max_rank_error <= np.ceil(0.012 * len(lat))
    lat.sort()
    for name, q in P.QUANTILES.items():
        rank, value = int(np.ceil(q * len(lat))), got[name]
        assert np.searchsorted(lat, value) + 1 - got.max_rank_error <= rank <= np.searchsorted(lat, value, "right") + got.max_rank_error
