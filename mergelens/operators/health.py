"""Provider health: rolling rates, the breaker's state machine, and the fallback chain."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergelens.errors import InvalidRequest

#: Settings of the breaker.
WINDOW, LEAST_CALLS, FAILURE_RATE, SLOW_RATE, SLOW_MS, WAIT_MS, TRIALS = 20, 10, 0.5, 0.8, 30_000, 60_000, 5


def rolling_rates(calls: DataFrame, provider: str, order: list[str], failed: Column, slow: Column, chunk: Column | None = None) -> DataFrame:
    """``calls`` with ``window_calls``, ``failure_rate``, ``slow_rate`` over the last 20 calls
    of the provider, null below 10 calls, and ``over_threshold``.

    A provider's calls are sorted within one task unless ``chunk`` cuts them into
    stretches; then each stretch is joined by the 19 calls before it (see ``rolling_chunks``)."""
    keys = [provider] if chunk is None else [provider, chunk]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(WINDOW - 1), Window.currentRow)
    n = F.count(F.lit(1)).over(w)
    rate = lambda c: F.when(n >= LEAST_CALLS, F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(w) / n)
    out = calls.withColumns({"window_calls": n, "failure_rate": rate(failed), "slow_rate": rate(slow)})
    return out.withColumn("over_threshold", F.coalesce((F.col("failure_rate") >= FAILURE_RATE) | (F.col("slow_rate") >= SLOW_RATE), F.lit(False)))


def rolling_chunks(calls: DataFrame, provider: str, order: list[str], failed: Column, slow: Column, bucket: Column) -> DataFrame:
    """``rolling_rates`` for providers with any number of calls.

    ``bucket`` is a coarse, order-preserving integer of the order, a day say. Each bucket
    takes along the last 19 calls of the buckets before it: those of every bucket are
    picked by a window group limit first, and of them the last 19 before each bucket."""
    base = calls.withColumn("bucket", bucket).withColumn("carried", F.lit(False))
    tail = Window.partitionBy(provider, "bucket").orderBy(*[F.desc(c) for c in order])
    tails = base.withColumn("from_end", F.row_number().over(tail)).where(F.col("from_end") < WINDOW).drop("from_end")
    # with tails of 19 calls a bucket, the last 19 before a bucket come from its last 19 filled predecessors
    sizes = base.select(provider, "bucket").distinct()
    back = Window.partitionBy(provider).orderBy("bucket").rowsBetween(1, WINDOW - 1)
    after = sizes.withColumn("next_buckets", F.collect_list("bucket").over(back)).select(F.col(provider).alias("p"), F.col("bucket").alias("b"), F.explode("next_buckets").alias("to_bucket"))
    carried = tails.join(after, F.col(provider).eqNullSafe(F.col("p")) & (F.col("bucket") == F.col("b"))).drop("p", "b")
    last = Window.partitionBy(provider, "to_bucket").orderBy(*[F.desc(c) for c in ["bucket", *order]])
    carried = carried.withColumn("from_end", F.row_number().over(last)).where(F.col("from_end") < WINDOW).drop("from_end").withColumn("bucket", F.col("to_bucket")).withColumn("carried", F.lit(True)).drop("to_bucket")
    both = rolling_rates(base.unionByName(carried), provider, order, failed, slow, F.col("bucket"))
    return both.where(~F.col("carried")).drop("bucket", "carried")


@dataclass
class Breaker:
    """A count-based breaker: CLOSED until a rate of the last calls is too high, OPEN for
    a minute, then HALF_OPEN for five calls that decide."""

    state: str = "CLOSED"
    calls: deque = field(default_factory=lambda: deque(maxlen=WINDOW))
    since: int = 0

    def permit(self, now: int) -> bool:
        if self.state == "OPEN" and now - self.since >= WAIT_MS:
            self._to("HALF_OPEN", now)
        return self.state != "OPEN"

    def record(self, now: int, failed: bool, slow: bool) -> None:
        self.calls.append((failed, slow))
        least = TRIALS if self.state == "HALF_OPEN" else LEAST_CALLS
        if len(self.calls) < least:
            return
        n = len(self.calls)
        bad = sum(f for f, _ in self.calls) >= FAILURE_RATE * n or sum(s for _, s in self.calls) >= SLOW_RATE * n
        if bad:
            self._to("OPEN", now)
        elif self.state == "HALF_OPEN":
            self._to("CLOSED", now)

    def _to(self, state: str, now: int) -> None:
        self.state, self.since = state, now
        self.calls.clear()

    def call(self, now: int, failed: bool, slow: bool) -> tuple[bool, str]:
        """Whether the call was let through, and the state after it."""
        permitted = self.permit(now)
        if permitted:
            self.record(now, failed, slow)
        return permitted, self.state


def _states(calls: DataFrame) -> DataFrame:
    """``breaker_states`` with ``at_ms``."""
    clean = calls.where("at_ms IS NOT NULL").select("provider", F.col("at_ms").cast("bigint").alias("at_ms"), F.col("call_id").cast("bigint").alias("call_id"), F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("slow", F.lit(False)).alias("slow"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker, now = Breaker(), object()
        for frame in frames:
            out = []
            for provider, at, call, failed, slow in frame.itertuples(index=False):
                if provider != now:
                    breaker, now = Breaker(), provider
                out.append((provider, at, call, *breaker.call(at, bool(failed), bool(slow))))
            yield pd.DataFrame(out, columns=["provider", "at_ms", "call_id", "permitted", "state"])

    return clean.repartition("provider").sortWithinPartitions("provider", "at_ms", "call_id").mapInPandas(run, "provider string, at_ms bigint, call_id bigint, permitted boolean, state string")


def breaker_states(calls: DataFrame) -> DataFrame:
    """``provider``, ``call_id``, ``permitted``, ``state`` for ``calls`` (``provider``,
    ``at_ms``, ``call_id``, ``failed``, ``slow``) in order of time.

    The machine is sequential, so each provider's calls run through one task, but as a
    stream of sorted rows: memory is one batch, however many calls there are. Null
    times are left out; null flags are false."""
    return _states(calls).drop("at_ms")


def last_states(calls: DataFrame) -> DataFrame:
    """``provider``, ``at_ms`` and ``state``: the breaker's state after each provider's last call."""
    return _states(calls).groupBy("provider").agg(F.max("at_ms").alias("at_ms"), F.max_by("state", F.struct("at_ms", "call_id")).alias("state"))


def provider_health(providers: DataFrame, states: DataFrame) -> DataFrame:
    """Configured providers with their breaker's state, UNKNOWN without one."""
    return providers.join(states.select(F.col("provider").alias("p"), "state"), F.col("name") == F.col("p"), "left").select("name", "enabled", F.coalesce("state", F.lit("UNKNOWN")).alias("circuit_breaker_state"), "model")


def start_provider(preference: Column, default: str) -> Column:
    """The preferred provider; ``auto`` or null is the default one."""
    return F.coalesce(F.nullif(preference, F.lit("auto")), F.lit(default))


#: Providers that the settings table may have; it is read by the driver.
MOST_PROVIDERS = 10_000


def available(providers: DataFrame) -> DataFrame:
    """Names of the providers that can be called: enabled ones, each once."""
    return providers.where("enabled").select("name").distinct()


def noted(name: Column, through: Column) -> Column:
    """A provider's name with a note for each provider that fell back to it, the last first."""
    return F.concat(name, F.array_join(F.transform(through, lambda p: F.concat(F.lit(" (fallback from "), p, F.lit(")"))), ""))


def fallback_chains(spark: SparkSession, providers: DataFrame) -> DataFrame:
    """``start``, ``step`` from 0, ``name``, ``usable`` and ``through`` (the names before, last first) of each provider's
    chain, to its end, a disabled or unknown provider, or a repeat."""
    rows = providers.select("name", "enabled", "fallback_to").limit(MOST_PROVIDERS + 1).collect()  # a settings table
    if len(rows) > MOST_PROVIDERS:
        raise InvalidRequest(f"more than {MOST_PROVIDERS} providers")
    config = {r.name: r for r in rows}
    chains = []
    for start in config:
        at, path = start, []
        while at is not None and at not in path:
            path.append(at)
            at = config[at].fallback_to if at in config and config[at].enabled else None
        chains += [(start, i, name, bool(name in config and config[name].enabled), path[:i][::-1]) for i, name in enumerate(path)]
    return spark.createDataFrame(chains, "start string, step int, name string, usable boolean, through array<string>")


def resolve_fallback(requests: DataFrame, providers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Which provider answers each request, by following fallbacks until one succeeds.

    ``requests``: ``request_id``, ``start``. ``providers``: ``name``, ``enabled``,
    ``fallback_to``. ``outcomes``: ``request_id``, ``name``, ``ok``; a missing one is a
    success. Gives ``request_id``, ``answered_by`` (null if none did), ``provider`` (with
    its notes) and ``outcome``: OK, or FAILED at a repeat, a disabled or unknown
    provider, or the end of the chain.

    Chains depend on the start alone, so they are unrolled once over the table of
    providers and joined to the requests, one shuffle whatever the length."""
    chain = fallback_chains(requests.sparkSession, providers)
    tried = requests.join(chain, "start").join(outcomes.select("request_id", "name", "ok"), ["request_id", "name"], "left")
    good = F.col("usable") & F.coalesce("ok", F.lit(True))
    first = tried.groupBy("request_id").agg(F.min_by(F.when(good, F.struct("name", noted(F.col("name"), F.col("through")).alias("provider"))), F.when(good, F.col("step"))).alias("a"))
    joined = requests.select("request_id").join(first, "request_id", "left")
    return joined.select("request_id", F.col("a.name").alias("answered_by"), F.col("a.provider").alias("provider"), F.when(F.col("a").isNotNull(), "OK").otherwise("FAILED").alias("outcome"))
