"""Queries over intake, provider health, the queue, metrics and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mergelens.functions import signature
from mergelens.functions import text as X
from mergelens.operators import health, ingest, metrics
from mergelens.plans.registry import Registry
from mergelens.plans.reviews import REQUESTS, RESULTS, requests, results
from mergelens.session import checkpoint_dir, cut_lineage, scratch
from mergelens.sources import landed
from mergelens.sources.tables import scan
from mergelens.streaming import documents, intake, status

REGISTRY = Registry()
SECRET = "a shared secret of the tests"

#: Events made from requests; the same in Spark and DuckDB.
_N = "CAST(regexp_extract(id, '[0-9]+', 0) AS BIGINT)"
_FLAGS = f"""{_N} AS n, CASE WHEN {_N} % 10 = 0 THEN 'push' ELSE 'pull_request' END AS event_type,
  CASE {_N} % 6 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'reopened' WHEN 3 THEN 'closed' WHEN 4 THEN 'labeled' ELSE 'opened' END AS action,
  CASE WHEN {_N} % 7 = 0 THEN 'Bot' WHEN {_N} % 7 = 1 THEN NULL ELSE 'User' END AS sender_type, {_N} % 3 = 0 AS draft, CASE WHEN {_N} % 97 <> 0 THEN {_N} END AS installation_id"""
_JUDGED = f"""{REQUESTS}, ev AS (SELECT *, {_FLAGS} FROM req), judged AS (
  SELECT n, ev.id, repository_full_name, platform_pr_id, head_sha, ev.created_at, p.id AS repository_id,
    CASE WHEN n % 11 = 0 THEN 'bad signature' WHEN event_type <> 'pull_request' THEN 'other event' WHEN action NOT IN ('opened', 'synchronize', 'reopened') THEN 'other action'
      WHEN ev.installation_id IS NULL THEN 'incomplete' WHEN sender_type = 'Bot' THEN 'bot' WHEN NOT coalesce(p.is_active, false) THEN 'inactive repository'
      WHEN draft AND NOT coalesce(p.settings.review_on_draft, false) THEN 'draft' END AS reason
  FROM ev LEFT JOIN repositories p ON p.full_name = ev.repository_full_name)"""


def events(spark, sf_dir):
    """Signed event bodies as JSON, every eleventh with a signature that doesn't fit."""
    r = requests(spark, sf_dir, "repository_full_name", "platform_pr_id", "title", "author", "head_sha", "base_branch", "head_branch", "created_at").selectExpr("*", *[x.strip() for x in _split(_FLAGS)])
    user = F.struct(F.col("author").alias("login"))
    pull = F.struct(F.col("platform_pr_id").alias("number"), F.col("title"), F.col("draft"), F.struct(F.col("head_branch").alias("ref"), F.col("head_sha").alias("sha")).alias("head"), F.struct(F.col("base_branch").alias("ref")).alias("base"), user.alias("user"), F.lit("unknown fields are ignored").alias("extra"))
    body = F.to_json(
        F.struct(
            F.col("action"),
            F.col("platform_pr_id").alias("number"),
            pull.alias("pull_request"),
            F.struct(F.col("repository_full_name").alias("full_name")).alias("repository"),
            F.when(F.col("installation_id").isNotNull(), F.struct(F.col("installation_id").alias("id"))).alias("installation"),
            F.when(F.col("sender_type").isNotNull(), F.struct(F.col("sender_type").alias("type"))).alias("sender"),
        )
    )
    signed = r.withColumn("body", body)
    good = F.concat(F.lit(signature.PREFIX), signature.hmac_sha256(F.col("body"), SECRET))
    sign = F.when(F.col("n") % 11 == 0, F.concat(F.lit(signature.PREFIX), F.sha2("body", 256))).when(F.col("n") % 2 == 0, F.concat(F.lit(signature.PREFIX), F.upper(F.substr(good, F.lit(len(signature.PREFIX) + 1))))).otherwise(good)
    return signed.select(F.col("n").alias("event_id"), "event_type", sign.alias("signature"), "body", F.col("created_at").alias("received_at"))


def _split(fields: str) -> list[str]:
    """Top-level fields of a select list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth and fields[at:i].count("CASE") == fields[at:i].count("END"):
            out.append(fields[at:i])
            at = i + 1
    return [*out, fields[at:]]


@REGISTRY.query("webhook_accepted", f"WITH {_JUDGED} SELECT repository_id, repository_full_name, platform_pr_id, head_sha, 'PENDING' AS status, created_at FROM judged WHERE reason IS NULL")
def webhook_accepted(spark, sf_dir):
    judged = ingest.judge_events(events(spark, sf_dir), scan(spark, sf_dir, "repositories"), SECRET)
    return ingest.accepted_requests(judged, F.col("received_at")).select("repository_id", "repository_full_name", "platform_pr_id", "head_sha", "status", "created_at")


@REGISTRY.query(
    "webhook_requests",
    f"""WITH {_JUDGED}, damaged AS (SELECT judged.*, req.title, req.author, req.base_branch, req.head_branch, CASE WHEN n % 23 = 0 AND reason IS DISTINCT FROM 'bad signature' AND reason IS DISTINCT FROM 'other event' THEN 'malformed' ELSE reason END AS why FROM judged JOIN req ON req.id = judged.id)
SELECT n AS event_id, why AS reason, CASE WHEN why IS NULL THEN repository_id END AS repository_id, CASE WHEN why IS NULL THEN repository_full_name END AS repository_full_name, CASE WHEN why IS NULL THEN platform_pr_id END AS platform_pr_id, CASE WHEN why IS NULL THEN title END AS title,
  CASE WHEN why IS NULL THEN author END AS author, CASE WHEN why IS NULL THEN head_sha END AS head_sha, CASE WHEN why IS NULL THEN base_branch END AS base_branch, CASE WHEN why IS NULL THEN head_branch END AS head_branch, CASE WHEN why IS NULL THEN 'PENDING' END AS status, CASE WHEN why IS NULL THEN created_at END AS created_at FROM damaged""",
)
def webhook_requests(spark, sf_dir):
    """All ten fields of new requests beside the reasons of the others; every twenty-third body is cut off, and signed as it is."""
    sound = events(spark, sf_dir)
    cut = F.when(F.col("event_id") % 23 == 0, F.left("body", F.lit(20))).otherwise(F.col("body"))
    good = F.concat(F.lit(signature.PREFIX), signature.hmac_sha256(cut, SECRET))
    landed = sound.withColumn("signature", F.when((F.col("event_id") % 23 == 0) & (F.col("event_id") % 11 != 0), good).otherwise(F.col("signature"))).withColumn("body", cut)
    judged = ingest.judge_events(landed, scan(spark, sf_dir, "repositories"), SECRET)
    new = ingest.accepted_requests(judged.withColumn("created", F.col("received_at")), F.col("created"), ["event_id"])
    return judged.select("event_id", "reason").join(new, "event_id", "left")


@REGISTRY.query("webhook_drop_reasons", f"WITH {_JUDGED} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS events FROM judged GROUP BY 1")
def webhook_drop_reasons(spark, sf_dir):
    judged = ingest.judge_events(events(spark, sf_dir), scan(spark, sf_dir, "repositories"), SECRET)
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("events"))


@REGISTRY.query("webhook_signature", f"WITH {REQUESTS} SELECT {_N} AS event_id, {_N} % 11 <> 0 AS fits FROM req")
def webhook_signature(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", signature.verified(F.col("body"), F.col("signature"), SECRET).alias("fits"))


@REGISTRY.query("stream_webhook_counts", f"WITH {_JUDGED} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS events FROM judged GROUP BY 1")
def stream_webhook_counts(spark, sf_dir):
    """The events landed as JSON files and taken in as a stream."""
    with scratch(f"{checkpoint_dir(spark)}/intake-{uuid.uuid4().hex}") as base:
        events(spark, sf_dir).write.json(f"{base}/landed")
        intake.run(spark, f"{base}/landed", scan(spark, sf_dir, "repositories"), f"{base}/out", f"{base}/state", SECRET, files_per_trigger=4)
        counts = spark.read.parquet(f"{base}/out").groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("events"))
        return cut_lineage(counts)


def calls(spark, sf_dir):
    """Calls of providers: failed without a latency, slow above the breaker's limit."""
    r = results(spark, sf_dir, "provider", "created_at", "latency_ms")
    return r.select(
        X.provider_name(F.coalesce("provider", F.lit("unknown"))).alias("provider"),
        F.unix_millis("created_at").alias("at_ms"),
        F.col("result_id").alias("call_id"),
        F.coalesce(F.col("latency_ms") < 0, F.lit(True)).alias("failed"),
        F.coalesce(F.col("latency_ms") > health.SLOW_MS, F.lit(False)).alias("slow"),
    )


_CALLS = f"{RESULTS}, calls AS (SELECT split_part(coalesce(provider, 'unknown'), ' ', 1) AS provider, epoch_ms(created_at) AS at_ms, result_id AS call_id, coalesce(latency_ms < 0, true) AS failed, coalesce(latency_ms > 30000, false) AS slow FROM res)"


@REGISTRY.query(
    "breaker_rates",
    f"""WITH {_CALLS}, w AS (SELECT provider, call_id, count(*) OVER x AS window_calls, sum(CAST(failed AS INTEGER)) OVER x AS f, sum(CAST(slow AS INTEGER)) OVER x AS s FROM calls WINDOW x AS (PARTITION BY provider ORDER BY at_ms, call_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT provider, call_id, window_calls, CASE WHEN window_calls >= 10 THEN CAST(f AS DOUBLE) / window_calls END AS failure_rate, CASE WHEN window_calls >= 10 THEN CAST(s AS DOUBLE) / window_calls END AS slow_rate,
  coalesce(window_calls >= 10 AND (f / window_calls >= 0.5 OR s / window_calls >= 0.8), false) AS over_threshold FROM w""",
)
def breaker_rates(spark, sf_dir):
    day = F.floor(F.col("at_ms") / 86_400_000)
    rates = health.rolling_chunks(calls(spark, sf_dir), "provider", ["at_ms", "call_id"], F.col("failed"), F.col("slow"), day)
    return rates.select("provider", "call_id", "window_calls", "failure_rate", "slow_rate", "over_threshold")


#: The breaker as a walk over the calls in order, one step of all providers at a time.
_STATES = f"""WITH RECURSIVE {_CALLS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY at_ms, call_id) AS rn FROM calls WHERE at_ms IS NOT NULL),
walk(provider, rn, at_ms, call_id, permitted, state, since, win) AS (
  SELECT DISTINCT provider, 0::BIGINT, 0::BIGINT, NULL::BIGINT, true, 'CLOSED', 0::BIGINT, []::STRUCT(f BOOLEAN, s BOOLEAN)[] FROM ordered
  UNION ALL
  SELECT provider, rn, at_ms, call_id, permitted, CASE WHEN trips THEN 'OPEN' WHEN closes THEN 'CLOSED' ELSE st END, CASE WHEN trips OR closes THEN at_ms ELSE since END, CASE WHEN trips OR closes THEN [] ELSE win END
  FROM (
    SELECT *, permitted AND full_ AND bad AS trips, permitted AND full_ AND NOT bad AND st = 'HALF_OPEN' AS closes FROM (
      SELECT *, len(win) >= CASE WHEN st = 'HALF_OPEN' THEN 5 ELSE 10 END AS full_, len(list_filter(win, lambda x: x.f)) >= 0.5 * len(win) OR len(list_filter(win, lambda x: x.s)) >= 0.8 * len(win) AS bad FROM (
        SELECT provider, rn, at_ms, call_id, st, st <> 'OPEN' AS permitted, since, CASE WHEN st = 'OPEN' THEN win ELSE list_slice(list_append(win, {{'f': failed, 's': slow}}), -20, -1) END AS win FROM (
          SELECT o.provider, o.rn, o.at_ms, o.call_id, o.failed, o.slow, CASE WHEN again THEN 'HALF_OPEN' ELSE w.state END AS st, CASE WHEN again THEN o.at_ms ELSE w.since END AS since, CASE WHEN again THEN [] ELSE w.win END AS win
          FROM (SELECT w.*, o.at_ms AS next_at, w.state = 'OPEN' AND o.at_ms - w.since >= 60000 AS again FROM walk w JOIN ordered o ON o.provider = w.provider AND o.rn = w.rn + 1) w JOIN ordered o ON o.provider = w.provider AND o.rn = w.rn + 1)))))
"""
_LAST = f"{_STATES}, last AS (SELECT provider, arg_max(state, rn) AS state FROM walk WHERE rn > 0 GROUP BY 1)"


@REGISTRY.query("breaker_states", f"{_STATES} SELECT provider, call_id, permitted, state FROM walk WHERE rn > 0")
def breaker_states(spark, sf_dir):
    return health.breaker_states(calls(spark, sf_dir))


def _providers(spark):
    rows = [("claude", True, "model-c", "openai"), ("openai", True, "model-o", "gemini"), ("gemini", False, "model-g", None), ("inhouse", True, "model-i", "claude")]
    return spark.createDataFrame(rows, "name string, enabled boolean, model string, fallback_to string")


@REGISTRY.query("provider_health", "SELECT * FROM (VALUES ('claude', true, 'CLOSED', 'model-c'), ('openai', true, 'OPEN', 'model-o'), ('gemini', false, 'UNKNOWN', 'model-g'), ('inhouse', true, 'UNKNOWN', 'model-i')) t(name, enabled, circuit_breaker_state, model)")
def provider_health(spark, sf_dir):
    states = spark.createDataFrame([("claude", "CLOSED"), ("openai", "OPEN")], "provider string, state string")
    return health.provider_health(_providers(spark), states)


@REGISTRY.query("provider_health_measured", f"{_LAST} SELECT name, enabled, coalesce(state, 'UNKNOWN') AS circuit_breaker_state, model FROM (VALUES ('claude', true, 'model-c'), ('openai', true, 'model-o'), ('gemini', false, 'model-g'), ('inhouse', true, 'model-i')) t(name, enabled, model) LEFT JOIN last ON provider = name")
def provider_health_measured(spark, sf_dir):
    """With the breakers' states after all calls."""
    return health.provider_health(_providers(spark), health.last_states(calls(spark, sf_dir)))


@REGISTRY.query(
    "provider_fallback",
    f"""WITH s AS (SELECT id AS request_id, CASE WHEN model_preference IS NULL OR model_preference = 'auto' THEN 'claude' ELSE model_preference END AS start, {_N} % 3 <> 0 AS c, {_N} % 5 <> 0 AS o, {_N} % 2 = 0 AS i FROM repositories)
SELECT request_id,
  CASE start WHEN 'claude' THEN CASE WHEN c THEN 'claude' WHEN o THEN 'openai' END WHEN 'openai' THEN CASE WHEN o THEN 'openai' END WHEN 'inhouse' THEN CASE WHEN i THEN 'inhouse' WHEN c THEN 'claude' WHEN o THEN 'openai' END END AS answered_by,
  CASE start WHEN 'claude' THEN CASE WHEN c THEN 'claude' WHEN o THEN 'openai (fallback from claude)' END WHEN 'openai' THEN CASE WHEN o THEN 'openai' END
    WHEN 'inhouse' THEN CASE WHEN i THEN 'inhouse' WHEN c THEN 'claude (fallback from inhouse)' WHEN o THEN 'openai (fallback from claude) (fallback from inhouse)' END END AS provider,
  CASE WHEN (start IN ('claude', 'inhouse') AND (c OR o)) OR (start = 'openai' AND o) OR (start = 'inhouse' AND i) THEN 'OK' ELSE 'FAILED' END AS outcome FROM s""",
)
def provider_fallback(spark, sf_dir):
    r = scan(spark, sf_dir, "repositories").select(F.col("id").alias("request_id"), health.start_provider(F.col("model_preference"), "claude").alias("start"), F.expr(_N).alias("n"))
    ok = F.map_from_arrays(F.array(F.lit("claude"), F.lit("openai"), F.lit("inhouse")), F.array(F.col("n") % 3 != 0, F.col("n") % 5 != 0, F.col("n") % 2 == 0))
    outcomes = r.select("request_id", F.explode(ok).alias("name", "ok"))
    return health.resolve_fallback(r.select("request_id", "start"), _providers(spark), outcomes)


@REGISTRY.query("available_providers", "SELECT * FROM (VALUES ('claude'), ('openai'), ('inhouse')) t(name)")
def available_providers(spark, sf_dir):
    return health.available(_providers(spark))


@REGISTRY.query(
    "provider_fallback_long",
    f"""WITH s AS (SELECT id AS request_id, {_N} % 13 AS k FROM repositories)
SELECT request_id, CASE WHEN k < 12 THEN 'm' || k END AS answered_by, CASE WHEN k < 12 THEN 'm' || k || coalesce(array_to_string(list_transform(list_reverse(range(0, k)), lambda i: ' (fallback from m' || i || ')'), ''), '') END AS provider, CASE WHEN k < 12 THEN 'OK' ELSE 'FAILED' END AS outcome FROM s""",
)
def provider_fallback_long(spark, sf_dir):
    """A chain of twelve that ends in a repeat: the k-th answers, or none."""
    chain = spark.createDataFrame([(f"m{i}", True, f"m{(i + 1) % 12}") for i in range(12)], "name string, enabled boolean, fallback_to string")
    r = scan(spark, sf_dir, "repositories").select(F.col("id").alias("request_id"), F.lit("m0").alias("start"), (F.expr(_N) % 13).alias("k"))
    outcomes = r.select("request_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"), "k").select("request_id", F.concat(F.lit("m"), F.col("i").cast("string")).alias("name"), (F.col("i") >= F.col("k")).alias("ok"))
    return health.resolve_fallback(r.select("request_id", "start"), chain, outcomes)


@REGISTRY.query(
    "queue_depth",
    """WITH c AS (SELECT date_trunc('hour', enqueued_at) AS hour, 1 AS d FROM review_messages UNION ALL SELECT date_trunc('hour', received_at), -1 FROM review_messages), h AS (SELECT hour, sum(d) AS delta FROM c WHERE hour IS NOT NULL GROUP BY 1)
SELECT hour, CAST(delta AS BIGINT) AS delta, CAST(sum(delta) OVER (ORDER BY hour) AS BIGINT) AS depth FROM h""",
)
def queue_depth(spark, sf_dir):
    """Depth at the end of each hour; the running sum is over hours, a bounded number of rows."""
    m = scan(spark, sf_dir, "review_messages")
    changes = m.select(F.explode(F.array(F.struct(F.col("enqueued_at").alias("at"), F.lit(1).alias("d")), F.struct(F.col("received_at").alias("at"), F.lit(-1).alias("d")))).alias("c"))
    hours = changes.where("c.at IS NOT NULL").groupBy(F.date_trunc("hour", "c.at").alias("hour")).agg(F.sum("c.d").alias("delta")).withColumn("all", F.lit(1))
    return metrics.queue_depth(hours, ["all"], ["hour"]).select("hour", "delta", "depth")


@REGISTRY.query(
    "metrics_counters",
    f"""WITH {REQUESTS}, {RESULTS}, r AS (SELECT split_part(coalesce(provider, 'unknown'), ' ', 1) AS provider, coalesce(status, 'none') AS status, latency_ms, input_tokens, output_tokens, contains(coalesce(provider, ''), 'fallback') AS fell FROM res LEFT JOIN req ON req.id = review_request_id)
SELECT 'review.total' AS metric, 'provider=' || provider || ',status=' || status AS tags, CAST(count(*) AS DOUBLE) AS value FROM r GROUP BY provider, status
UNION ALL SELECT 'review.tokens.total', 'provider=' || provider || ',direction=input', CAST(coalesce(sum(input_tokens), 0) AS DOUBLE) FROM r GROUP BY provider
UNION ALL SELECT 'review.tokens.total', 'provider=' || provider || ',direction=output', CAST(coalesce(sum(output_tokens), 0) AS DOUBLE) FROM r GROUP BY provider
UNION ALL SELECT 'review.fallback.total', '', CAST(count(*) AS DOUBLE) FROM r WHERE fell
UNION ALL SELECT 'review.duration.ms.count', 'provider=' || provider, CAST(count(latency_ms) AS DOUBLE) FROM r GROUP BY provider
UNION ALL SELECT 'review.duration.ms.sum', 'provider=' || provider, CAST(sum(latency_ms) AS DOUBLE) FROM r GROUP BY provider
UNION ALL SELECT 'review.duration.ms.max', 'provider=' || provider, CAST(max(latency_ms) AS DOUBLE) FROM r GROUP BY provider
UNION ALL SELECT 'review.cost.usd', 'provider=' || provider, CAST(coalesce(sum(input_tokens * 2 + output_tokens * 8), 0) AS DOUBLE) FROM r GROUP BY provider
UNION ALL SELECT 'webhook.received.total', '', CAST(count(*) AS DOUBLE) FROM req""",
)
def metrics_counters(spark, sf_dir):
    q = requests(spark, sf_dir, "status").select(F.col("id").alias("review_request_id"), "status")
    r = results(spark, sf_dir, "review_request_id", "provider", "latency_ms", "input_tokens", "output_tokens").withColumn("fell", F.contains(F.coalesce("provider", F.lit("")), F.lit("fallback"))).withColumn("provider", X.provider_name(F.coalesce("provider", F.lit("unknown")))).join(q, "review_request_id", "left")
    tokens = r.select("provider", "input_tokens", "output_tokens").withColumnsRenamed({"input_tokens": "input", "output_tokens": "output"}).unpivot("provider", ["input", "output"], "direction", "tokens")
    prices = r.select("provider").distinct().withColumn("input_price", F.lit(2)).withColumn("output_price", F.lit(8))
    parts = [
        metrics.counter(r, "review.total", ["provider", "status"]),
        metrics.counter(tokens, "review.tokens.total", ["provider", "direction"], F.col("tokens")),
        metrics.counter(r.where("fell"), "review.fallback.total", []),
        metrics.timer(r, "review.duration.ms", ["provider"], F.col("latency_ms")),
        metrics.cost(r, ["provider"], prices, "provider"),
        metrics.counter(q, "webhook.received.total", []),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@REGISTRY.query("breaker_gauge", f"WITH {_CALLS} SELECT 'model.circuit.state' AS metric, 'provider=' || provider AS tags, CAST(arg_max(CASE WHEN failed THEN 2 WHEN slow THEN 1 ELSE 0 END, struct_pack(a := at_ms, b := call_id)) AS DOUBLE) AS value FROM calls GROUP BY provider")
def breaker_gauge(spark, sf_dir):
    """The gauge over states named by the last call's outcome."""
    state = F.when(F.col("failed"), "OPEN").when(F.col("slow"), "HALF_OPEN").otherwise("CLOSED")
    return metrics.gauge(calls(spark, sf_dir), "model.circuit.state", ["provider"], metrics.breaker_value(state), ["at_ms", "call_id"])


@REGISTRY.query("breaker_gauge_measured", f"{_LAST} SELECT 'model.circuit.state' AS metric, 'provider=' || provider AS tags, CAST(CASE state WHEN 'OPEN' THEN 2 WHEN 'HALF_OPEN' THEN 1 ELSE 0 END AS DOUBLE) AS value FROM last")
def breaker_gauge_measured(spark, sf_dir):
    """The gauge over the breakers' states after all calls."""
    return metrics.gauge(health.last_states(calls(spark, sf_dir)), "model.circuit.state", ["provider"], metrics.breaker_value(F.col("state")), ["at_ms"])


@REGISTRY.query("request_final_status", f"WITH {REQUESTS} SELECT id AS request_id, status FROM req WHERE status IS NOT NULL")
def request_final_status(spark, sf_dir):
    """Event logs that lead to each request's status, failed and retried ones among them, through the state machine."""
    names = {
        "PENDING": ["enqueued", "started", "failed", "started", "retried"],
        "REVIEWING": ["enqueued", "started", "enqueued"],
        "COMPLETED": ["enqueued", "retried", "started", "failed", "retried", "started", "finished", "failed"],
        "FAILED": ["enqueued", "finished", "started", "failed"],
    }
    logs = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    log = requests(spark, sf_dir, "status", "created_at").where("status IS NOT NULL").select(F.col("id").alias("request_id"), F.col("created_at").alias("at"), F.posexplode(logs[F.col("status")]).alias("seq", "event"))
    return status.final_status(log).select("request_id", "status")


_EVENTS = "['enqueued', 'started', 'finished', 'empty', 'failed', 'retried']"


@REGISTRY.query(
    "request_status_log",
    f"""WITH RECURSIVE {REQUESTS}, log AS (SELECT id, i AS seq, ({_EVENTS})[1 + (n // (i + 1) + n * i + i) % 6] AS event FROM (SELECT id, {_N} AS n, unnest(range(0, 12)) AS i FROM req)),
walk(id, seq, status, moves, ignored) AS (
  SELECT id, -1::BIGINT, NULL::VARCHAR, 0, 0 FROM req
  UNION ALL
  SELECT id, seq, coalesce(nxt, status), moves + CASE WHEN nxt IS NULL THEN 0 ELSE 1 END, ignored + CASE WHEN nxt IS NULL THEN 1 ELSE 0 END FROM (
    SELECT w.id, l.seq, w.status, w.moves, w.ignored, CASE WHEN w.status IS NULL AND event = 'enqueued' THEN 'PENDING' WHEN w.status = 'PENDING' AND event = 'started' THEN 'REVIEWING' WHEN w.status = 'REVIEWING' AND event IN ('finished', 'empty') THEN 'COMPLETED'
      WHEN w.status = 'REVIEWING' AND event = 'failed' THEN 'FAILED' WHEN w.status = 'FAILED' AND event = 'retried' THEN 'PENDING' END AS nxt FROM walk w JOIN log l ON l.id = w.id AND l.seq = w.seq + 1))
SELECT id AS request_id, status, CAST(moves AS INTEGER) AS moves, CAST(ignored AS INTEGER) AS ignored FROM walk WHERE seq = 11""",
)
def request_status_log(spark, sf_dir):
    """Logs of twelve events each that know nothing of the status, through the state machine."""
    names = F.array(*map(F.lit, ("enqueued", "started", "finished", "empty", "failed", "retried")))
    log = requests(spark, sf_dir, "created_at").select(F.col("id").alias("request_id"), F.col("created_at").alias("at"), F.expr(_N).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("seq"))
    which = F.expr("CAST((n div (seq + 1) + n * seq + seq) % 6 AS INT)")
    return status.final_status(log.withColumn("event", F.get(names, which))).select("request_id", "status", "moves", "ignored")


@REGISTRY.query("landed_diffs", "SELECT prompt_id, md5(diff_content) AS digest FROM review_prompts WHERE diff_content IS NOT NULL")
def landed_diffs(spark, sf_dir):
    """Diffs landed as text files, and read whole."""
    with scratch(f"{checkpoint_dir(spark)}/diffs-{uuid.uuid4().hex}") as base:
        landed.land(scan(spark, sf_dir, "review_prompts"), "prompt_id", "diff_content", base)
        return cut_lineage(landed.read_texts(spark, base, "prompt_id", "bigint").select("prompt_id", F.md5("text").alias("digest")))


@REGISTRY.query(
    "landed_file_lists",
    """SELECT review_request_id, CAST(row_number() OVER (PARTITION BY review_request_id ORDER BY diff_id) AS INTEGER) AS file_no, file_path, status, additions, deletions, md5(patch) AS digest FROM file_diffs WHERE review_request_id IS NOT NULL""",
)
def landed_file_lists(spark, sf_dir):
    """Lists of changed files landed as JSON."""
    f = scan(spark, sf_dir, "file_diffs").where("review_request_id IS NOT NULL")
    one = F.struct("diff_id", F.col("file_path").alias("filename"), "status", "additions", "deletions", "patch")
    lists = f.groupBy("review_request_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("text"))  # one request's files
    with scratch(f"{checkpoint_dir(spark)}/lists-{uuid.uuid4().hex}") as base:
        landed.land(lists, "review_request_id", "text", base)
        rows = landed.changed_files(landed.read_texts(spark, base, "review_request_id"), "review_request_id")
        return cut_lineage(rows.select("review_request_id", "file_no", "file_path", "status", "additions", "deletions", F.md5("patch").alias("digest")))


@REGISTRY.query(
    "stream_repository_upsert",
    f"SELECT id, CASE WHEN {_N} % 10 = 0 THEN upper(full_name) WHEN {_N} % 10 = 1 THEN lower(full_name) ELSE full_name END AS full_name FROM repositories UNION ALL SELECT id || '-b', full_name FROM repositories WHERE {_N} % 50 = 0",
)
def stream_repository_upsert(spark, sf_dir):
    """Whole documents landed in three files, upserted by a stream one after another."""
    base = scan(spark, sf_dir, "repositories").select("id", "full_name")
    n = F.expr(_N)
    batches = (base.where(n % 10 == 0).select("id", F.upper("full_name").alias("full_name")), base.where(n % 50 == 0).select(F.concat("id", F.lit("-b")).alias("id"), "full_name"), base.where(n % 10 == 1).select("id", F.lower("full_name").alias("full_name")))
    with scratch(f"{checkpoint_dir(spark)}/upsert-{uuid.uuid4().hex}") as place:
        for batch in batches:
            batch.coalesce(1).write.mode("append").json(f"{place}/landed")
        base.write.parquet(f"{place}/base")
        stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).json(f"{place}/landed")
        documents.upsert_stream(stream, f"{place}/base", f"{place}/versions", f"{place}/state")
        return cut_lineage(documents.current(spark, f"{place}/versions"))


@REGISTRY.query(
    "request_instants",
    f"WITH {REQUESTS} SELECT id, epoch_us(created_at) AS created_us, coalesce(updated_at <= created_at + INTERVAL 60 SECONDS, true) AS expired FROM req WHERE created_at IS NOT NULL",
)
def request_instants(spark, sf_dir):
    """Times written as ISO text, read back and compared with a margin of a minute."""
    r = requests(spark, sf_dir, "created_at").where("created_at IS NOT NULL")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return r.select("id", F.unix_micros(X.instant(iso("created_at"))).alias("created_us"), X.expired(X.instant(iso("updated_at")), F.col("created_at")).alias("expired"))
