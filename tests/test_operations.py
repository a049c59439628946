import datetime
import random

import pytest
from pyspark.sql import functions as F

from mergelens.operators import health, ingest, metrics
from mergelens.streaming import intake, status


def event(**change):
    import json

    body = {"action": "opened", "number": 1, "pull_request": {"number": 1, "title": "T", "draft": False, "head": {"ref": "f", "sha": "s"}, "base": {"ref": "main"}, "user": {"login": "u"}, "new_field": 1}, "repository": {"full_name": "o/n"}, "installation": {"id": 9}, "sender": {"type": "User"}}
    for path, value in change.items():
        at, keys = body, path.split("__")
        for k in keys[:-1]:
            at = at[k]
        at[keys[-1]] = value
    return json.dumps(body)


EVENTS = {
    "ok": ("pull_request", event(), None),
    "no sender": ("pull_request", event(sender=None), None),
    "push": ("push", event(), "other event"),
    "no type": (None, event(), "other event"),
    "not json": ("pull_request", "{", "malformed"),
    "empty": ("pull_request", "", "malformed"),
    "closed": ("pull_request", event(action="closed"), "other action"),
    "no pull request": ("pull_request", event(pull_request=None), "incomplete"),
    "no installation": ("pull_request", event(installation=None), "incomplete"),
    "bot": ("pull_request", event(sender__type="Bot"), "bot"),
    "unknown": ("pull_request", event(repository__full_name="x/y"), "inactive repository"),
    "inactive": ("pull_request", event(repository__full_name="o/off"), "inactive repository"),
    "draft": ("pull_request", event(pull_request__draft=True), "draft"),
    "draft allowed": ("pull_request", event(pull_request__draft=True, repository__full_name="o/draft"), None),
}


@pytest.fixture(scope="module")
def repositories(spark):
    rows = [("1", "o/n", True, (False,)), ("2", "o/off", False, (True,)), ("3", "o/draft", True, (True,)), ("4", "o/null", None, None)]
    return spark.createDataFrame(rows, "id string, full_name string, is_active boolean, settings struct<review_on_draft:boolean>")


def landed(spark):
    rows = [(i, t, None, b, datetime.datetime(2025, 1, 1)) for i, (t, b, _) in enumerate(EVENTS.values())]
    return spark.createDataFrame(rows, intake.LANDED)


def test_gates(spark, repositories):
    got = {r.event_id: r.reason for r in ingest.judge_events(landed(spark), repositories).collect()}
    assert {k: got[i] for i, k in enumerate(EVENTS)} == {k: v for k, (_, _, v) in EVENTS.items()}
    signed = {r.reason for r in ingest.judge_events(landed(spark), repositories, "k").collect()}
    assert signed == {"bad signature"}


def test_accepted(spark, repositories):
    rows = ingest.accepted_requests(ingest.judge_events(landed(spark), repositories), F.col("received_at")).collect()
    assert len(rows) == 3 and rows[0].status == "PENDING" and rows[0].head_sha == "s"


def test_stream_equals_batch_and_restart_adds_nothing(spark, repositories, tmp_path):
    landed(spark).repartition(3).write.json(str(tmp_path / "in"))
    for _ in range(2):
        intake.run(spark, str(tmp_path / "in"), repositories, str(tmp_path / "out"), str(tmp_path / "state"), None, files_per_trigger=1)
    got = {r.event_id: r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(EVENTS.values())}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(EVENTS)


def test_drop_repeats(spark, repositories):
    judged = ingest.judge_events(landed(spark).where("event_id < 2"), repositories)
    assert intake.drop_repeats(judged).count() == 1


def model(calls):
    """The breaker told again, over plain lists."""
    state, window, since, out = "CLOSED", [], 0, []
    for now, failed, slow in calls:
        if state == "OPEN" and now - since >= 60_000:
            state, window = "HALF_OPEN", []
        if state == "OPEN":
            out.append((False, state))
            continue
        window = [*window, (failed, slow)][-20:]
        if len(window) >= (5 if state == "HALF_OPEN" else 10):
            n = len(window)
            if 2 * sum(f for f, _ in window) >= n or 10 * sum(s for _, s in window) >= 8 * n:
                state, since, window = "OPEN", now, []
            elif state == "HALF_OPEN":
                state, window = "CLOSED", []
        out.append((True, state))
    return out


def sequence(seed):
    rng = random.Random(seed)
    at, out = 0, []
    for _ in range(rng.randint(0, 120)):
        at += rng.choice([10, 1000, 20_000, 61_000])
        out.append((at, rng.random() < rng.choice([0.1, 0.6]), rng.random() < 0.3))
    return out


def test_breaker_equals_the_model():
    for seed in range(1000):
        calls, b = sequence(seed), health.Breaker()
        assert [b.call(*c) for c in calls] == model(calls), seed


def test_breaker_in_spark(spark):
    rows = [(f"p{s}", at, i, f, w) for s in range(6) for i, (at, f, w) in enumerate(sequence(s))]
    df = spark.createDataFrame(rows, "provider string, at_ms bigint, call_id bigint, failed boolean, slow boolean").repartition(4)
    got = {(r.provider, r.call_id): (r.permitted, r.state) for r in health.breaker_states(df).collect()}
    assert got == {(f"p{s}", i): x for s in range(6) for i, x in enumerate(model(sequence(s)))}
    assert health.breaker_states(df.limit(0)).count() == 0


def test_rates_by_chunks_equal_rates_at_once(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 400), i, rng.random() < 0.4, rng.random() < 0.2) for i in range(600)]
    df = spark.createDataFrame(rows, "provider string, at_ms bigint, call_id bigint, failed boolean, slow boolean")
    args = ("provider", ["at_ms", "call_id"], F.col("failed"), F.col("slow"))
    want = sorted(map(tuple, health.rolling_rates(df, *args).select("provider", "call_id", "window_calls", "failure_rate", "slow_rate").collect()), key=repr)
    for width in (1, 7, 50):
        got = health.rolling_chunks(df, *args, F.floor(F.col("at_ms") / width)).select("provider", "call_id", "window_calls", "failure_rate", "slow_rate")
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_fallback(spark):
    providers = spark.createDataFrame([("a", True, "b"), ("b", True, "a"), ("c", True, "d"), ("d", False, "a")], "name string, enabled boolean, fallback_to string")
    asks = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "a"), ("4", "c"), ("5", "gone"), ("6", "d")], "request_id string, start string")
    bad = spark.createDataFrame([("2", "a", False), ("3", "a", False), ("3", "b", False), ("4", "c", False)], "request_id string, name string, ok boolean")
    got = {r.request_id: (r.provider, r.outcome) for r in health.resolve_fallback(asks, providers, bad).collect()}
    assert got == {"1": ("a", "OK"), "2": ("b (fallback from a)", "OK"), "3": (None, "FAILED"), "4": (None, "FAILED"), "5": (None, "FAILED"), "6": (None, "FAILED")}


def test_metrics(spark):
    df = spark.createDataFrame([("a", "x", 5), ("a", "x", 7), ("b", None, None)], "provider string, status string, d int")
    got = {(r.metric, r.tags): r.value for r in metrics.counter(df, "n", ["provider", "status"]).unionByName(metrics.timer(df, "t", ["provider"], F.col("d"))).collect()}
    assert got[("n", "provider=a,status=x")] == 2 and got[("n", "provider=b,status=none")] == 1 and got[("t.max", "provider=a")] == 7 and got[("t.sum", "provider=b")] is None
    assert {r.value for r in metrics.gauge(df.where("d > 0"), "g", ["provider"], F.col("d"), ["d"]).collect()} == {7.0}
    depth = metrics.queue_depth(spark.createDataFrame([("q", 1, 1), ("q", 2, 1), ("q", 3, -1)], "q string, at int, delta int"), ["q"], ["at"])
    assert [r.depth for r in depth.orderBy("at").collect()] == [1, 2, 1]


LOGS = {"a": ["enqueued", "started", "finished", "failed"], "b": ["started", "enqueued"], "c": ["enqueued", "started", "failed", "retried", "started", "empty"], "d": [None]}
WANT = {"a": ("COMPLETED", 3, 1), "b": ("PENDING", 1, 1), "c": ("COMPLETED", 6, 0), "d": (None, 0, 1)}


def log(spark):
    rows = [(k, i, i, e) for k, es in LOGS.items() for i, e in enumerate(es)]
    return spark.createDataFrame([*rows, (None, 0, 0, "enqueued")], "request_id string, at bigint, seq int, event string")


def test_status_in_batch(spark):
    got = {r.request_id: (r.status, r.moves, r.ignored) for r in status.final_status(log(spark).repartition(3)).collect()}
    assert got == WANT
    assert status.final_status(log(spark).limit(0)).count() == 0


def test_status_in_a_stream(spark, tmp_path):
    source = str(tmp_path / "log")
    for at in range(6):  # a file, and so a micro-batch, per moment
        log(spark).where(f"at = {at} AND request_id IS NOT NULL").coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema("request_id string, at bigint, seq int, event string").option("maxFilesPerTrigger", 1).json(source)
    seen = {}

    def keep(batch, number):
        seen.update({r.request_id: (r.status, r.moves, r.ignored) for r in batch.collect()})

    status.status_updates(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == WANT


def test_last_states_are_the_breakers(spark):
    rows = [(f"p{s}", at, i, f, w) for s in range(20) for i, (at, f, w) in enumerate(sequence(s))]
    df = spark.createDataFrame(rows, "provider string, at_ms bigint, call_id bigint, failed boolean, slow boolean").repartition(4)
    got = {r.provider: (r.at_ms, r.state) for r in health.last_states(df).collect()}
    assert got == {f"p{s}": (q[-1][0], model(q)[-1][1]) for s in range(20) if (q := sequence(s))}
    assert len({state for _, state in got.values()}) > 1


def test_fallback_follows_long_chains(spark):
    providers = spark.createDataFrame([(f"p{i}", True, f"p{i + 1}" if i < 19 else "p0") for i in range(20)], "name string, enabled boolean, fallback_to string")
    asks = spark.createDataFrame([("1", "p0"), ("2", "p0")], "request_id string, start string")
    bad = spark.createDataFrame([(r, f"p{i}", False) for r, n in (("1", 19), ("2", 20)) for i in range(n)], "request_id string, name string, ok boolean")
    got = {r.request_id: (r.answered_by, r.outcome) for r in health.resolve_fallback(asks, providers, bad).collect()}
    assert got == {"1": ("p19", "OK"), "2": (None, "FAILED")}
