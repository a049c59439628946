"""Queries over the whole processing of requests: prompts, recorded calls with fallback, results, posts and the worker."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mergelens.operators import diff, envelopes, pipeline, render, replies, stats, store
from mergelens.plans.diffs import _EXCLUDED, LINES
from mergelens.plans.operations import _providers
from mergelens.plans.registry import Registry
from mergelens.plans.reviews import _TAG, COMMENTS, REQUESTS, RESULTS, requests, with_results
from mergelens.session import checkpoint_dir, scratch
from mergelens.sources.tables import scan
from mergelens.streaming import worker

REGISTRY = Registry()

REVIEWS = "array<struct<provider:string,model:string,summary:string,latency_ms:bigint,fallback_used:boolean>>"
_NAMES = ("claude", "openai")  # whose calls are recorded; each file's calls are made from replies


def review_requests(spark, sf_dir):
    """Requests with the diff of their last prompt; half in each language, some with rules and an older review."""
    p = store.latest(scan(spark, sf_dir, "review_prompts").select("prompt_id", "review_request_id", "diff_content"), ["prompt_id"], "review_request_id")
    q = requests(spark, sf_dir, "title", "pr_body", "repository_full_name", "platform_pr_id")
    r = scan(spark, sf_dir, "repositories").select("full_name", "name", "model_preference")
    n = F.col("prompt_id")
    old = F.array(F.struct(F.lit("claude").alias("provider"), F.lit("m").alias("model"), F.lit("old").alias("summary"), F.lit(5).cast("bigint").alias("latency_ms"), F.lit(False).alias("fallback_used")))
    return (
        p.join(q, F.col("review_request_id") == F.col("id"))
        .join(r, F.col("repository_full_name") == F.col("full_name"), "left")
        .select(
            "id", "prompt_id", "title", "pr_body", "repository_full_name", "platform_pr_id", "model_preference",
            F.col("diff_content").alias("raw_diff"),
            F.when(n % 2 == 0, "ko").otherwise("en").alias("language"),
            F.when(n % 3 == 0, F.concat(F.lit("Mind the names in "), F.col("name"))).alias("custom_prompt"),
            F.when(n % 4 == 0, old).otherwise(F.array().cast(REVIEWS)).cast(REVIEWS).alias("reviews"),
        )
    )


def recorded_calls(spark, sf_dir, own):
    """A call of either provider for each file; every fifth reply stands for a failed one."""
    recorded = scan(spark, sf_dir, "model_replies").select("reply_id", "content", "model", "input_tokens", "output_tokens")
    n = recorded.count()
    files = diff.diff_files(own.select("id", "prompt_id", "raw_diff"), "raw_diff", ["id", "prompt_id"]).select("id", "prompt_id", "chunk")
    each = files.select("id", "chunk", "prompt_id", F.posexplode(F.array(*map(F.lit, _NAMES))).alias("at", "name"))
    each = each.withColumn("k", F.pmod(F.col("prompt_id") * 7 + F.col("chunk") * 3 + F.col("at"), F.lit(max(1, n))) + 1).withColumn("wanted", F.concat(F.lit("reply-"), F.col("k").cast("string")))
    got = each.join(recorded, F.col("wanted") == F.col("reply_id"), "left")
    return got.select("id", "chunk", "name", F.when(F.col("k") % 5 != 0, F.col("content")).alias("content"), "model", "input_tokens", "output_tokens", (F.coalesce("output_tokens", F.lit(0)) * 20 + 100).alias("latency_ms"))


_SYSTEM = "'" + render.SYSTEM_PROMPT.replace("'", "''").replace("<language>", "' || CASE WHEN prompt_id % 2 = 0 THEN 'Korean' ELSE 'English' END || '") + "'"
_ASKED = f"""{LINES}, {REQUESTS}, kept AS (
  SELECT prompt_id, b, file_path, row_number() OVER (PARTITION BY prompt_id ORDER BY b) AS chunk FROM paths WHERE NOT {_EXCLUDED} QUALIFY chunk <= {diff.DEFAULT_MAX_FILES}
), h AS (
  SELECT prompt_id, b, hunk_no, any_value(header) || chr(10) || string_agg(CASE type WHEN 'ADDED' THEN '+' WHEN 'REMOVED' THEN '-' ELSE ' ' END || content, chr(10) ORDER BY line_no) AS t FROM numbered GROUP BY 1, 2, 3
), hh AS (SELECT prompt_id, b, string_agg(t, chr(10) ORDER BY hunk_no) AS context FROM h GROUP BY 1, 2),
own AS (SELECT prompt_id, review_request_id, diff_content FROM review_prompts WHERE review_request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_request_id ORDER BY prompt_id DESC) = 1),
base AS (SELECT own.prompt_id, diff_content, req.id, req.title, req.pr_body, p.name, CASE WHEN p.model_preference IS NULL OR p.model_preference = 'auto' THEN 'claude' ELSE p.model_preference END AS start
  FROM own JOIN req ON req.id = review_request_id LEFT JOIN repositories p ON p.full_name = req.repository_full_name),
asked AS (SELECT base.*, chunk, file_path, count(*) OVER (PARTITION BY id) AS chunks, coalesce(context, '') AS context,
    {_SYSTEM} || CASE WHEN prompt_id % 3 = 0 AND name IS NOT NULL THEN chr(10) || chr(10) || 'Additional rules:' || chr(10) || 'Mind the names in ' || name ELSE '' END AS system_prompt,
    (prompt_id * 7 + chunk * 3) % m.n + 1 AS kc, (prompt_id * 7 + chunk * 3 + 1) % m.n + 1 AS ko
  FROM base JOIN kept USING (prompt_id) LEFT JOIN hh USING (prompt_id, b), (SELECT greatest(1, count(*)) AS n FROM model_replies) m),
prompted AS (SELECT *, '## Pull Request' || chr(10) || 'Title: ' || title || chr(10) || chr(10) || '## File (' || chunk || '/' || chunks || '): ' || file_path || chr(10) || chr(10) || '```diff' || chr(10) || context || chr(10) || '```' || chr(10) AS user_prompt FROM asked)"""
_RESULTS = f"""{_ASKED}, {COMMENTS.replace("raw AS (", "texts AS (").replace("FROM raw", "FROM texts")}, tried AS (
  SELECT asked.*, coalesce(c.content IS NOT NULL AND kc % 5 <> 0, false) AS c_ok, coalesce(o.content IS NOT NULL AND ko % 5 <> 0, false) AS o_ok, coalesce(c.output_tokens, 0) * 20 + 100 AS lc, coalesce(o.output_tokens, 0) * 20 + 100 AS lo
  FROM asked LEFT JOIN model_replies c ON c.reply_id = 'reply-' || kc LEFT JOIN model_replies o ON o.reply_id = 'reply-' || ko
), walked AS (
  SELECT *, CASE WHEN start = 'claude' AND c_ok THEN kc WHEN start IN ('claude', 'openai') AND o_ok THEN ko END AS k,
    CASE WHEN start = 'claude' AND c_ok THEN 'claude' WHEN start = 'claude' AND o_ok THEN 'openai (fallback from claude)' WHEN start = 'openai' AND o_ok THEN 'openai' END AS by_provider,
    CASE WHEN start = 'claude' AND c_ok THEN lc WHEN start = 'claude' AND o_ok THEN lc + lo WHEN start = 'openai' AND o_ok THEN lo END AS spent FROM tried
), answered AS (SELECT walked.*, r.model AS by_model, r.input_tokens AS t_in, r.output_tokens AS t_out FROM walked LEFT JOIN model_replies r ON r.reply_id = 'reply-' || k
), done AS (
  SELECT id, bool_and(k IS NOT NULL) AS ok, arg_max(struct_pack(v := by_provider), chunk).v AS provider, arg_max(struct_pack(v := by_model), chunk).v AS model, sum(coalesce(t_in, 0)) AS t_in, sum(coalesce(t_out, 0)) AS t_out, sum(spent) AS spent, bool_or(coalesce(contains(by_provider, 'fallback'), false)) AS fell FROM answered GROUP BY 1
), cm AS (
  SELECT answered.id, comments.* EXCLUDE (reply_id, review_request_id, created_at), row_number() OVER (PARTITION BY answered.id ORDER BY chunk, comment_no) AS pos FROM answered JOIN comments ON comments.reply_id = 'reply-' || k
), s AS (
  SELECT id, count(*) AS n, count(*) FILTER (WHERE line_number > 0) AS inline_n, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'WARNING') AS w, count(*) FILTER (WHERE severity = 'SUGGESTION') AS g,
    string_agg({_TAG} || '`' || file_path || ':' || line_number || '` - ' || regexp_split_to_array(content, '\\r\\n|\\n|\\r')[1] || chr(10), '' ORDER BY pos) FILTER (WHERE pos <= 10) AS issues,
    md5(string_agg(file_path || ':' || line_number || ':' || category || ':' || severity || ':' || content, '|' ORDER BY pos)) AS digest FROM cm GROUP BY 1
), summed AS (
  SELECT id, ok, provider, model, t_in, t_out, spent, fell, coalesce(n, 0) AS n, coalesce(inline_n, 0) AS inline_n, digest,
    '**AI Code Review**' || chr(10) || chr(10) || '### Summary' || chr(10) || 'Found **' || coalesce(n, 0) || ' issues** (' || coalesce(c, 0) || ' Critical, ' || coalesce(w, 0) || ' Warning, ' || coalesce(g, 0) || ' Suggestion)' || chr(10) || chr(10)
      || CASE WHEN n > 0 THEN '### Issues' || chr(10) || issues ELSE '' END AS summary FROM done LEFT JOIN s USING (id)
), result AS (
  SELECT base.id, CASE WHEN summed.id IS NULL OR ok THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN ok THEN provider END AS provider, CASE WHEN ok THEN model END AS model, CASE WHEN ok THEN md5(summary) END AS summary,
    CASE WHEN ok THEN CAST(t_in AS INTEGER) END AS input_tokens, CASE WHEN ok THEN CAST(t_out AS INTEGER) END AS output_tokens, CASE WHEN ok THEN CAST(spent AS BIGINT) END AS latency_ms, CASE WHEN ok THEN fell END AS fallback_used,
    CAST(CASE WHEN ok THEN n ELSE 0 END AS INTEGER) AS comments, CASE WHEN ok THEN digest END AS comments_digest, CAST((CASE WHEN prompt_id % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN ok THEN 1 ELSE 0 END) AS INTEGER) AS reviews,
    CAST(CASE WHEN ok AND n > 0 THEN inline_n END AS INTEGER) AS posted
  FROM base LEFT JOIN summed USING (id)
)"""


def processed(spark, sf_dir, own=None):
    own = review_requests(spark, sf_dir) if own is None else own
    return pipeline.reviewed(own, recorded_calls(spark, sf_dir, own), _providers(spark), "claude")


@REGISTRY.query("review_prompts_sent", f"WITH {_ASKED} SELECT id, CAST(chunk AS INTEGER) AS chunk, CAST(chunks AS INTEGER) AS chunks, file_path, md5(system_prompt) AS system_digest, md5(user_prompt) AS user_digest FROM prompted")
def review_prompts_sent(spark, sf_dir):
    sent = pipeline.prompts(review_requests(spark, sf_dir))
    return sent.select("id", "chunk", "chunks", "file_path", F.md5("system_prompt").alias("system_digest"), F.md5("user_prompt").alias("user_digest"))


@REGISTRY.query(
    "review_prompt_whole",
    f"""WITH {_ASKED}, f AS (SELECT id, string_agg('- ' || file_path || chr(10), '' ORDER BY chunk) AS files FROM asked GROUP BY 1)
SELECT id, md5('## Pull Request' || chr(10) || 'Title: ' || title || chr(10) || CASE WHEN pr_body IS NULL OR regexp_matches(pr_body, '^[\\s\\x{{00A0}}]*$') THEN '' ELSE 'Description: ' || substr(pr_body, 1, 500) || chr(10) END || chr(10)
  || '## Changed Files' || chr(10) || files || chr(10) || '## Diff' || chr(10) || '```diff' || chr(10) || diff_content || chr(10) || '```' || chr(10)) AS digest FROM base JOIN f USING (id)""",
)
def review_prompt_whole(spark, sf_dir):
    """All files of a request in one prompt, its description cut at 500 characters."""
    own = review_requests(spark, sf_dir).withColumn("files", F.transform(diff.parse_diff(F.col("raw_diff")), lambda f: f["file_path"]))
    return own.where(F.size("files") > 0).select("id", F.md5(render.user_prompt(F.col("title"), F.col("pr_body"), F.col("files"), F.col("raw_diff"))).alias("digest"))


@REGISTRY.query(
    "request_bodies",
    f"""WITH {_ASKED} SELECT id, CAST(chunk AS INTEGER) AS chunk, kind, CASE WHEN kind = 'generate' THEN NULL ELSE 'model-' || kind END AS model, md5(system_prompt) AS system_digest, md5(user_prompt) AS user_digest, 4096 AS max_tokens, 0.1 AS temperature
FROM prompted, (VALUES ('messages'), ('chat'), ('generate')) k(kind)""",
)
def request_bodies(spark, sf_dir):
    """The three kinds of request bodies as JSON, read back field by field."""
    sent = pipeline.prompts(review_requests(spark, sf_dir)).select("id", "chunk", "system_prompt", "user_prompt")
    turn = "role:string,content:string"
    part = "array<struct<text:string>>"
    asks = {
        "messages": (envelopes.messages_request, f"model string, max_tokens int, system string, messages array<struct<{turn}>>, temperature double"),
        "chat": (envelopes.chat_request, f"model string, max_tokens int, messages array<struct<{turn}>>, temperature double"),
        "generate": (None, f"contents array<struct<role:string,parts:{part}>>, systemInstruction struct<parts:{part}>, generationConfig struct<temperature:double,maxOutputTokens:int>"),
    }
    out = None
    for kind, (make, schema) in asks.items():
        limits = (F.lit(4096), F.lit(0.1))
        body = make(F.lit(f"model-{kind}"), F.col("system_prompt"), F.col("user_prompt"), *limits) if make else envelopes.generate_request(F.col("system_prompt"), F.col("user_prompt"), *limits)
        e = F.from_json(body, schema)
        read = sent.select("id", "chunk", e.alias("e"))
        e = F.col("e")
        if kind == "messages":
            fields = (e["model"], e["system"], e["messages"][0]["content"], e["max_tokens"], e["temperature"])
        elif kind == "chat":
            fields = (e["model"], e["messages"][0]["content"], e["messages"][1]["content"], e["max_tokens"], e["temperature"])
        else:
            fields = (F.lit(None).cast("string"), e["systemInstruction"]["parts"][0]["text"], e["contents"][0]["parts"][0]["text"], e["generationConfig"]["maxOutputTokens"], e["generationConfig"]["temperature"])
        rows = read.select("id", "chunk", F.lit(kind).alias("kind"), fields[0].alias("model"), F.md5(fields[1]).alias("system_digest"), F.md5(fields[2]).alias("user_digest"), fields[3].alias("max_tokens"), fields[4].alias("temperature"))
        out = rows if out is None else out.unionByName(rows)
    return out


@REGISTRY.query("review_pipeline", f"WITH {_RESULTS} SELECT * FROM result")
def review_pipeline(spark, sf_dir):
    """Diffs to prompts, calls with fallback, comments, summary, tokens, elapsed time, status, the review put behind older ones, and what is posted."""
    r = F.col("review")
    posted = F.from_json(render.review_post(F.col("comments")), "comments array<struct<path:string,line:int>>")["comments"]
    each = F.transform("comments", lambda c: F.concat_ws(":", c["file_path"], c["line_number"].cast("string"), c["category"], c["severity"], c["content"]))
    return processed(spark, sf_dir).select(
        "id", "status", r["provider"].alias("provider"), r["model"].alias("model"), F.md5(r["summary"]).alias("summary"), r["token_usage"]["input_tokens"].alias("input_tokens"), r["token_usage"]["output_tokens"].alias("output_tokens"),
        r["latency_ms"].alias("latency_ms"), r["fallback_used"].alias("fallback_used"), F.size("comments").alias("comments"), F.when(F.size("comments") > 0, F.md5(F.array_join(each, "|"))).alias("comments_digest"), F.size("reviews").alias("reviews"),
        F.when(F.size("comments") > 0, F.size(posted)).alias("posted"),
    )


_MESSAGES = "SELECT delivery_id, review_request_id FROM review_messages WHERE review_request_id IS NULL OR review_request_id IN (SELECT review_request_id FROM review_prompts) OR delivery_id % 5 = 0"


@REGISTRY.query(
    "stream_reviews",
    f"""WITH {_RESULTS}, m AS ({_MESSAGES})
SELECT CASE WHEN review_request_id IS NULL THEN 'dead letter' WHEN result.id IS NULL OR status = 'FAILED' THEN 'pending' ELSE 'acknowledged' END AS outcome, count(*) AS messages FROM m LEFT JOIN result ON result.id = review_request_id GROUP BY 1""",
)
def stream_reviews(spark, sf_dir):
    """Messages landed in the queue and worked off as a stream: acknowledged, kept as pending when they failed, or dead letters."""
    m = scan(spark, sf_dir, "review_messages").select("delivery_id", "review_request_id", "repository_full_name", F.col("pull_request_number").alias("platform_pr_id"))
    known = scan(spark, sf_dir, "review_prompts").select(F.col("review_request_id").alias("known")).distinct()
    some = m.join(known, F.col("review_request_id") == F.col("known"), "left").where("review_request_id IS NULL OR known IS NOT NULL OR delivery_id % 5 = 0")
    own = review_requests(spark, sf_dir)
    with scratch(f"{checkpoint_dir(spark)}/worker-{uuid.uuid4().hex}") as base:
        store.queue_messages(some.withColumnRenamed("review_request_id", "id")).select("message", F.current_timestamp().alias("enqueued_at")).repartition(6).write.json(f"{base}/queue")
        worker.run(spark, f"{base}/queue", lambda ids: processed(spark, sf_dir, own.join(ids, own["id"] == ids["review_request_id"], "left_semi")), f"{base}/out", f"{base}/state", files_per_trigger=3)
        counts = [spark.read.schema("message map<string,string>").json(f"{base}/out/{kind}/*").agg(F.count(F.lit(1)).alias("messages")).first()[0] for kind in ("acknowledged", "pending", "dead")]
    return spark.createDataFrame([(k, n) for k, n in zip(("acknowledged", "pending", "dead letter"), counts) if n], "outcome string, messages bigint")


@REGISTRY.query(
    "statistics_row",
    f"""WITH {REQUESTS}, {RESULTS}, {COMMENTS}, p AS (SELECT split_part(provider, ' ', 1) AS k, count(*) AS n FROM res JOIN req ON req.id = res.review_request_id WHERE status = 'COMPLETED' AND provider IS NOT NULL GROUP BY 1),
c AS (SELECT category AS k, count(*) AS n FROM comments JOIN req ON req.id = comments.review_request_id WHERE status = 'COMPLETED' GROUP BY 1)
SELECT (SELECT count(*) FROM req) AS total_reviews, (SELECT count(*) FROM req WHERE status = 'COMPLETED') AS completed_reviews, (SELECT count(*) FROM req WHERE status = 'FAILED') AS failed_reviews,
  (SELECT coalesce(CAST(sum(latency_ms) AS DOUBLE) / nullif(count(latency_ms), 0), 0.0) FROM res JOIN req ON req.id = res.review_request_id WHERE status = 'COMPLETED') AS avg_latency_ms,
  (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM p) AS reviews_by_provider, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM c) AS issues_by_category""",
)
def statistics_row(spark, sf_dir):
    """The statistics row with both maps, as text in the order of their keys."""
    comments = replies.explode_comments(replies.with_comments(stats.of_requests(scan(spark, sf_dir, "model_replies").select("reply_id", "review_request_id", "content"), requests(spark, sf_dir, "status"))), ["reply_id"])
    row = stats.statistics(with_results(spark, sf_dir), comments)
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(m)
    return row.select("total_reviews", "completed_reviews", "failed_reviews", "avg_latency_ms", text("reviews_by_provider"), text("issues_by_category"))
