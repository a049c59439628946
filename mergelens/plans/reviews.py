"""Queries over requests, reviews, comments, repositories and the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergelens.functions import text as X
from mergelens.operators import envelopes, render, replies, stats, store
from mergelens.plans.registry import Registry
from mergelens.sources import tables as S
from mergelens.sources.tables import scan

REGISTRY = Registry()

#: One row per request and per result; repeated ones are whole rows.
REQUESTS = "req AS (SELECT * FROM review_requests QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"
RESULTS = "res AS (SELECT DISTINCT * FROM review_results)"
#: Comments of replies, by JSON functions: a reply counts whole or not at all.
COMMENTS = r"""raw AS (
  SELECT reply_id, review_request_id, created_at,
    coalesce(nullif(regexp_extract(content, '(?s)```(?:json)?\s*\n?(\[.*?\])\s*```', 1), ''), nullif(regexp_extract(content, '(?s)(\[.*\])', 1), '')) AS arr
  FROM model_replies
), parsed AS (
  SELECT reply_id, review_request_id, created_at, CASE WHEN json_valid(arr) AND json_type(arr) = 'ARRAY' THEN json_extract(arr, '$[*]') END AS els FROM raw
), elements AS (
  SELECT reply_id, review_request_id, created_at, unnest(els) AS el, unnest(range(1, len(els) + 1)) AS comment_no FROM parsed
), checked AS (
  SELECT *, json_type(el) = 'OBJECT' AND coalesce(json_type(el, '$.file'), '') <> 'NULL' AND coalesce(json_type(el, '$.severity'), '') <> 'NULL'
    AND coalesce(json_type(el, '$.category'), '') <> 'NULL' AND coalesce(json_type(el, '$.title'), '') <> 'NULL' AND coalesce(json_type(el, '$.body'), '') <> 'NULL'
    AND coalesce(json_type(el, '$.line'), '') <> 'NULL' AND (json_type(el, '$.line') IS NULL OR el->>'$.line' = '' OR try_cast(el->>'$.line' AS DOUBLE) IS NOT NULL) AS ok
  FROM elements
), comments AS (
  SELECT reply_id, review_request_id, created_at, CAST(comment_no AS INTEGER) AS comment_no,
    coalesce(el->>'$.file', '') AS file_path,
    CAST(trunc(coalesce(try_cast(coalesce(nullif(el->>'$.line', ''), '0') AS DOUBLE), 0)) AS INTEGER) AS line_number,
    lower(coalesce(el->>'$.category', 'quality')) AS category,
    CASE WHEN upper(el->>'$.severity') IN ('CRITICAL', 'WARNING', 'SUGGESTION', 'PRAISE') THEN upper(el->>'$.severity') ELSE 'SUGGESTION' END AS severity,
    coalesce(el->>'$.title', '') || chr(10) || chr(10) || coalesce(el->>'$.body', '') AS content,
    el->>'$.suggestion' AS suggestion
  FROM checked WHERE reply_id NOT IN (SELECT reply_id FROM checked WHERE NOT ok)
)"""
_TAG = "CASE WHEN severity IN ('CRITICAL', 'WARNING', 'PRAISE') THEN '[' || severity || ']' ELSE '[SUGGESTION]' END || ' **[' || upper(category) || ']** '"


_NUMBER = "CAST(regexp_extract(id, '[0-9]+', 0) AS BIGINT)"
#: What the request list shows.
LISTED = [c for c in store.REQUEST_VIEW if c not in ("id", "reviews")]


def requests(spark, sf_dir, *columns):
    """One row per request, of the columns named; no others are read."""
    return store.latest(scan(spark, sf_dir, "review_requests").select("id", "updated_at", *columns), ["updated_at"])


def results(spark, sf_dir, *columns):
    """One row per model call: repeats are whole rows, known by their id."""
    return store.latest(scan(spark, sf_dir, "review_results").select("result_id", "ingested_at", *columns), ["ingested_at"], "result_id")


def with_results(spark, sf_dir, *columns):
    children = results(spark, sf_dir, "review_request_id", "created_at", "provider", "model", "latency_ms", "input_tokens", "output_tokens").drop("ingested_at")
    return stats.nest(requests(spark, sf_dir, "status", *columns), children, "id", "review_request_id", "reviews", ["created_at", "result_id"])


def with_replies(spark, sf_dir):
    children = replies.with_comments(scan(spark, sf_dir, "model_replies")).select("review_request_id", "created_at", "reply_id", "provider", "comments")
    return stats.nest(requests(spark, sf_dir, "status"), children, "id", "review_request_id", "reviews", ["created_at", "reply_id"])


@REGISTRY.query(
    "stats_summary",
    f"""WITH {REQUESTS}, {RESULTS}
SELECT (SELECT count(*) FROM req) AS total_reviews, (SELECT count(*) FROM req WHERE status = 'COMPLETED') AS completed_reviews, (SELECT count(*) FROM req WHERE status = 'FAILED') AS failed_reviews,
  (SELECT coalesce(CAST(sum(latency_ms) AS DOUBLE) / nullif(count(latency_ms), 0), 0.0) FROM res JOIN req ON req.id = res.review_request_id WHERE status = 'COMPLETED') AS avg_latency_ms""",
)
def stats_summary(spark, sf_dir):
    return stats.overview(with_results(spark, sf_dir))


@REGISTRY.query("stats_by_provider", f"WITH {REQUESTS}, {RESULTS} SELECT split_part(provider, ' ', 1) AS provider, count(*) AS reviews FROM res JOIN req ON req.id = res.review_request_id WHERE status = 'COMPLETED' GROUP BY 1")
def stats_by_provider(spark, sf_dir):
    return stats.count_providers(stats.of_requests(results(spark, sf_dir, "review_request_id", "provider"), requests(spark, sf_dir, "status")))


@REGISTRY.query("stats_by_category", f"WITH {REQUESTS}, {COMMENTS} SELECT category, count(*) AS comments FROM comments JOIN req ON req.id = comments.review_request_id WHERE status = 'COMPLETED' GROUP BY 1")
def stats_by_category(spark, sf_dir):
    own = stats.of_requests(scan(spark, sf_dir, "model_replies").select("reply_id", "review_request_id", "content"), requests(spark, sf_dir, "status"))
    return stats.count_categories(replies.explode_comments(replies.with_comments(own), ["reply_id"]))


@REGISTRY.query(
    "token_usage_by_provider",
    f"""WITH {REQUESTS}, {RESULTS}, u AS (SELECT split_part(provider, ' ', 1) AS provider, coalesce(sum(input_tokens), 0) AS i, coalesce(sum(output_tokens), 0) AS o FROM res JOIN req ON req.id = res.review_request_id GROUP BY 1)
SELECT provider, 'input' AS direction, CAST(i AS BIGINT) AS tokens FROM u UNION ALL SELECT provider, 'output', CAST(o AS BIGINT) FROM u""",
)
def token_usage_by_provider(spark, sf_dir):
    return stats.count_tokens(stats.of_requests(results(spark, sf_dir, "review_request_id", "provider", "input_tokens", "output_tokens"), requests(spark, sf_dir), done_only=False))


@REGISTRY.query(
    "request_outcomes",
    f"""WITH {REQUESTS}, {RESULTS}
SELECT req.id AS request_id, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  bool_or(coalesce(contains(provider, 'fallback'), false)) AS fallback_used,
  arg_max(struct_pack(v := provider), struct_pack(a := res.created_at, b := result_id)).v AS last_provider, arg_max(struct_pack(v := model), struct_pack(a := res.created_at, b := result_id)).v AS last_model
FROM req JOIN res ON req.id = res.review_request_id GROUP BY 1""",
)
def request_outcomes(spark, sf_dir):
    return stats.request_outcomes(with_results(spark, sf_dir))


@REGISTRY.query("fallback_rate", f"WITH {RESULTS} SELECT split_part(provider, ' ', 1) AS provider, count(*) AS calls, count(*) FILTER (WHERE contains(provider, 'fallback')) AS fallbacks FROM res GROUP BY 1")
def fallback_rate(spark, sf_dir):
    fell = F.coalesce(F.contains("provider", F.lit("fallback")), F.lit(False))
    return results(spark, sf_dir, "provider").groupBy(X.provider_name(F.col("provider")).alias("provider")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(fell).alias("fallbacks"))


@REGISTRY.query(
    "comments_collected",
    f"""WITH {REQUESTS}, {COMMENTS} SELECT req.id, md5(string_agg(file_path || ':' || line_number || ':' || severity || ':' || content, '|' ORDER BY comments.created_at, reply_id, comment_no)) AS digest, count(*) AS comments
FROM req JOIN comments ON req.id = comments.review_request_id GROUP BY 1""",
)
def comments_collected(spark, sf_dir):
    c = F.transform("comments", lambda x: F.concat_ws(":", x["file_path"], x["line_number"].cast("string"), x["severity"], x["content"]))
    return stats.all_comments(with_replies(spark, sf_dir)).where(F.size("comments") > 0).select("id", F.md5(F.array_join(c, "|")).alias("digest"), F.size("comments").cast("bigint").alias("comments"))


@REGISTRY.query(
    "severity_buckets",
    f"""WITH {REQUESTS}, {COMMENTS}
SELECT req.id, CAST(count(*) FILTER (WHERE severity = 'CRITICAL') AS INTEGER) AS critical, CAST(count(*) FILTER (WHERE severity = 'WARNING') AS INTEGER) AS warning, CAST(count(*) FILTER (WHERE severity = 'SUGGESTION') AS INTEGER) AS suggestion,
  CAST(count(*) FILTER (WHERE severity = 'PRAISE') AS INTEGER) AS praise, CAST(count(severity) AS INTEGER) AS total FROM req LEFT JOIN comments ON req.id = comments.review_request_id GROUP BY 1""",
)
def severity_buckets(spark, sf_dir):
    return stats.severity_buckets(stats.all_comments(with_replies(spark, sf_dir)))


@REGISTRY.query("category_severity_counts", f"WITH {COMMENTS} SELECT category, severity, count(*) AS comments FROM comments GROUP BY 1, 2")
def category_severity_counts(spark, sf_dir):
    rows = replies.explode_comments(replies.with_comments(scan(spark, sf_dir, "model_replies")), ["reply_id"])
    return rows.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("comments"))


@REGISTRY.query("reply_comments", f"WITH {COMMENTS} SELECT reply_id, comment_no, file_path, line_number, category, severity, content, suggestion FROM comments")
def reply_comments(spark, sf_dir):
    return replies.explode_comments(replies.with_comments(scan(spark, sf_dir, "model_replies")), ["reply_id"])


@REGISTRY.query(
    "reply_shape_counts",
    f"""WITH {COMMENTS}, n AS (SELECT reply_id, count(*) AS n FROM comments GROUP BY 1)
SELECT CASE WHEN regexp_matches(content, '(?s)```(?:json)?\\s*\\n?(\\[.*?\\])\\s*```') THEN 'fenced' WHEN regexp_matches(content, '(?s)(\\[.*\\])') THEN 'bare' ELSE 'none' END AS shape, count(*) AS replies, CAST(coalesce(sum(n), 0) AS BIGINT) AS comments
FROM model_replies LEFT JOIN n USING (reply_id) GROUP BY 1""",
)
def reply_shape_counts(spark, sf_dir):
    shape = F.when(F.col("content").rlike(replies._FENCED), "fenced").when(F.col("content").rlike(replies._ARRAY), "bare").otherwise("none")
    return replies.with_comments(scan(spark, sf_dir, "model_replies")).groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("replies"), F.sum(F.size("comments")).alias("comments"))


@REGISTRY.query(
    "inline_comments",
    f"""WITH {COMMENTS} SELECT reply_id, file_path AS path, line_number AS line, 'RIGHT' AS side,
  {_TAG} || content || chr(10) || coalesce(chr(10) || '```suggestion' || chr(10) || suggestion || chr(10) || '```' || chr(10), '') AS body FROM comments WHERE line_number > 0""",
)
def inline_comments(spark, sf_dir):
    posted = replies.with_comments(scan(spark, sf_dir, "model_replies")).select("reply_id", F.explode(render.inline_comments(F.col("comments"))).alias("c"))
    return posted.select("reply_id", "c.path", "c.line", "c.body", "c.side")


@REGISTRY.query(
    "summary_text",
    f"""WITH {COMMENTS}, s AS (
  SELECT reply_id, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'WARNING') AS w, count(*) FILTER (WHERE severity = 'SUGGESTION') AS g,
    string_agg({_TAG} || '`' || file_path || ':' || line_number || '` - ' || regexp_split_to_array(content, '\\r\\n|\\n|\\r')[1] || chr(10), '' ORDER BY comment_no) FILTER (WHERE comment_no <= 10) AS issues
  FROM comments GROUP BY 1)
SELECT reply_id, '**AI Code Review**' || chr(10) || chr(10) || '### Summary' || chr(10) || 'Found **' || coalesce(n, 0) || ' issues** (' || coalesce(c, 0) || ' Critical, ' || coalesce(w, 0) || ' Warning, ' || coalesce(g, 0) || ' Suggestion)' || chr(10) || chr(10)
  || CASE WHEN n > 0 THEN '### Issues' || chr(10) || issues ELSE '' END AS summary
FROM model_replies LEFT JOIN s USING (reply_id)""",
)
def summary_text(spark, sf_dir):
    return replies.with_comments(scan(spark, sf_dir, "model_replies")).select("reply_id", render.summary(F.col("comments")).alias("summary"))


@REGISTRY.query("review_posts", f"WITH {COMMENTS} SELECT reply_id, 'COMMENT' AS event, CAST((SELECT count(*) FROM comments c WHERE c.reply_id = r.reply_id AND line_number > 0) AS INTEGER) AS comments FROM model_replies r")
def review_posts(spark, sf_dir):
    body = F.from_json(render.review_post(F.col("comments")), "body string, event string, comments array<struct<path:string,line:int,body:string,side:string>>")
    return replies.with_comments(scan(spark, sf_dir, "model_replies")).select("reply_id", body.alias("p")).select("reply_id", "p.event", F.size("p.comments").alias("comments"))


@REGISTRY.query(
    "review_post_bodies",
    f"""WITH {COMMENTS}, s AS (
  SELECT reply_id, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'WARNING') AS w, count(*) FILTER (WHERE severity = 'SUGGESTION') AS g,
    string_agg({_TAG} || '`' || file_path || ':' || line_number || '` - ' || regexp_split_to_array(content, '\\r\\n|\\n|\\r')[1] || chr(10), '' ORDER BY comment_no) FILTER (WHERE comment_no <= 10) AS issues,
    string_agg(file_path || ':' || line_number || ':RIGHT:' || {_TAG} || content || chr(10) || coalesce(chr(10) || '```suggestion' || chr(10) || suggestion || chr(10) || '```' || chr(10), ''), '|' ORDER BY comment_no) FILTER (WHERE line_number > 0) AS inline
  FROM comments GROUP BY 1)
SELECT reply_id, 'COMMENT' AS event, md5('**AI Code Review**' || chr(10) || chr(10) || '### Summary' || chr(10) || 'Found **' || n || ' issues** (' || c || ' Critical, ' || w || ' Warning, ' || g || ' Suggestion)' || chr(10) || chr(10) || '### Issues' || chr(10) || issues) AS body, md5(coalesce(inline, '')) AS comments FROM s""",
)
def review_post_bodies(spark, sf_dir):
    """What is posted, field by field: the body, and every inline comment with its place, side and text."""
    rows = replies.with_comments(scan(spark, sf_dir, "model_replies")).where(F.size("comments") > 0)
    p = rows.select("reply_id", F.from_json(render.review_post(F.col("comments")), "body string, event string, comments array<struct<path:string,line:int,body:string,side:string>>").alias("p"))
    inline = F.array_join(F.transform("p.comments", lambda c: F.concat_ws(":", c["path"], c["line"].cast("string"), c["side"], c["body"])), "|")
    return p.select("reply_id", "p.event", F.md5("p.body").alias("body"), F.md5(inline).alias("comments"))


@REGISTRY.query(
    "envelope_normalised",
    """SELECT reply_id, content, CASE split_part(provider, ' ', 1) WHEN 'gemini' THEN 'configured' ELSE model END AS model, split_part(provider, ' ', 1) AS provider,
  coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens, coalesce(input_tokens + output_tokens, 0) AS total_tokens
FROM model_replies WHERE content IS NOT NULL AND split_part(provider, ' ', 1) IN ('claude', 'openai', 'gemini')""",
)
def envelope_normalised(spark, sf_dir):
    """Replies put into their service's envelope as JSON, and read back."""
    n_in, n_out, total = F.col("input_tokens"), F.col("output_tokens"), F.col("input_tokens") + F.col("output_tokens")
    text = F.col("content")
    block = lambda kind, t: F.struct(kind.alias("type"), t.alias("text"))
    messages = F.to_json(F.struct(F.col("model"), F.array(block(F.lit("thinking"), F.lit("hm")), block(F.lit("text"), text)).alias("content"), F.struct(n_in, n_out).alias("usage")))
    chat = F.to_json(F.struct(F.col("model"), F.array(F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"))).alias("choices"), F.struct(n_in.alias("prompt_tokens"), n_out.alias("completion_tokens"), total.alias("total_tokens")).alias("usage")))
    usage = F.struct(n_in.alias("promptTokenCount"), n_out.alias("candidatesTokenCount"), total.alias("totalTokenCount"))
    generate = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"), usage.alias("usageMetadata")))
    name = X.provider_name(F.col("provider"))
    kind = F.when(name == "claude", "messages").when(name == "openai", "chat").when(name == "gemini", "generate")
    body = F.when(name == "claude", messages).when(name == "openai", chat).when(name == "gemini", generate)
    read = scan(spark, sf_dir, "model_replies").where(kind.isNotNull()).select("reply_id", envelopes.normalise(kind, body, F.lit("configured")).alias("r"))
    return read.where("r IS NOT NULL").select("reply_id", "r.*")


@REGISTRY.query("reviews_by_status", f"WITH {REQUESTS} SELECT id, repository_full_name, platform_pr_id, title, author, status, created_at FROM req WHERE status = 'FAILED'")
def reviews_by_status(spark, sf_dir):
    return store.view(S.list_requests(requests(spark, sf_dir, *LISTED), status="failed"), store.REQUEST_VIEW)


@REGISTRY.query("reviews_by_repository", f"WITH {REQUESTS} SELECT id, repository_full_name, platform_pr_id, title, author, status, created_at FROM req WHERE repository_full_name = 'brackwater/monolith'")
def reviews_by_repository(spark, sf_dir):
    return store.view(S.list_requests(requests(spark, sf_dir, *LISTED), repository="brackwater/monolith", status="failed"), store.REQUEST_VIEW)


@REGISTRY.query("review_by_id", "SELECT id, repository_full_name, platform_pr_id, title, author, status, created_at FROM review_requests WHERE id = 'review-7' LIMIT 1")
def review_by_id(spark, sf_dir):
    return store.view(S.find_by_id(scan(spark, sf_dir, "review_requests"), "review-7"), store.REQUEST_VIEW)


@REGISTRY.query("reviews_by_pull_request", f"WITH {REQUESTS} SELECT id, status FROM req WHERE repository_full_name = 'brackwater/monolith' AND platform_pr_id = 1")
def reviews_by_pull_request(spark, sf_dir):
    return S.find_by_request_key(requests(spark, sf_dir, "repository_full_name", "platform_pr_id", "status"), "brackwater/monolith", 1).select("id", "status")


@REGISTRY.query("retry_eligible", f"WITH {REQUESTS} SELECT id AS review_request_id, repository_full_name, platform_pr_id AS pull_request_number FROM req WHERE status = 'FAILED'")
def retry_eligible(spark, sf_dir):
    return store.read_messages(store.requeued(requests(spark, sf_dir, "repository_full_name", "platform_pr_id", "status")))


@REGISTRY.query("repository_list", "SELECT id, full_name, is_active, model_preference, created_at FROM repositories")
def repository_list(spark, sf_dir):
    return store.view(scan(spark, sf_dir, "repositories"), store.REPOSITORY_VIEW).drop("settings")


@REGISTRY.query(
    "repository_views",
    f"""SELECT id, full_name, is_active, settings.review_on_draft AS review_on_draft, settings.max_files AS max_files, array_to_string(settings.exclude_patterns, '|') AS exclude_patterns, CASE WHEN {_NUMBER} % 10 = 0 THEN 'naming|size' WHEN {_NUMBER} % 10 = 1 THEN '' ELSE 'style' END AS rules, model_preference, created_at FROM repositories""",
)
def repository_views(spark, sf_dir):
    """The whole view, settings and rules included; every tenth repository's rules are replaced, every next one's emptied."""
    n = F.expr(_NUMBER)
    rules = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    base = scan(spark, sf_dir, "repositories").withColumn("review_rules", rules("style"))
    changed = store.replace_rules(base, base.where(n % 10 < 2).select("id", F.when(n % 10 == 0, rules("naming", "size")).otherwise(rules()).alias("review_rules")))
    seen = store.view(changed, store.REPOSITORY_VIEW)
    return seen.select("id", "full_name", "is_active", "settings.review_on_draft", "settings.max_files", F.array_join("settings.exclude_patterns", "|").alias("exclude_patterns"), F.array_join("review_rules", "|").alias("rules"), "model_preference", "created_at")


@REGISTRY.query(
    "request_views",
    f"""WITH {REQUESTS}, {RESULTS}, r AS (SELECT review_request_id, string_agg(concat_ws(':', coalesce(provider, '-'), coalesce(model, '-'), coalesce(CAST(latency_ms AS VARCHAR), '-')), '|' ORDER BY created_at, result_id) AS reviews FROM res GROUP BY 1)
SELECT id, repository_full_name, platform_pr_id, title, author, status, coalesce(r.reviews, '') AS reviews, created_at FROM req LEFT JOIN r ON r.review_request_id = id""",
)
def request_views(spark, sf_dir):
    """The whole view of requests, with their reviews in order."""
    shown = with_results(spark, sf_dir, *[c for c in LISTED if c != "status"])
    seen = store.view(shown, store.REQUEST_VIEW)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    each = F.transform("reviews", lambda r: F.concat_ws(":", text(r["provider"]), text(r["model"]), text(r["latency_ms"])))
    return seen.withColumn("reviews", F.array_join(each, "|"))


@REGISTRY.query("active_repositories", "SELECT id, full_name FROM repositories WHERE is_active")
def active_repositories(spark, sf_dir):
    return S.find_by_active(scan(spark, sf_dir, "repositories")).select("id", "full_name")


@REGISTRY.query("repository_by_name", "SELECT id, owner, name FROM repositories WHERE full_name = 'brackwater/monolith'")
def repository_by_name(spark, sf_dir):
    return S.find_by_full_name(scan(spark, sf_dir, "repositories"), "brackwater/monolith").select("id", "owner", "name")




@REGISTRY.query("repository_update", f"SELECT id, CASE WHEN {_NUMBER} % 10 = 0 THEN false ELSE is_active END AS is_active, CASE WHEN {_NUMBER} % 20 = 0 THEN 'gemini' ELSE model_preference END AS model_preference FROM repositories")
def repository_update(spark, sf_dir):
    base = scan(spark, sf_dir, "repositories").select("id", "is_active", "model_preference")
    n = F.expr(_NUMBER)
    patches = base.where(n % 10 == 0).select("id", F.lit(False).alias("is_active"), F.when(n % 20 == 0, "gemini").alias("model_preference"))
    return store.patch(base, patches, ["is_active", "model_preference"])


@REGISTRY.query("repository_upsert", f"SELECT id, CASE WHEN {_NUMBER} % 10 = 0 THEN upper(full_name) ELSE full_name END AS full_name FROM repositories UNION ALL SELECT id || '-b', full_name FROM repositories WHERE {_NUMBER} % 50 = 0")
def repository_upsert(spark, sf_dir):
    base = scan(spark, sf_dir, "repositories").select("id", "full_name")
    n = F.expr(_NUMBER)
    patches = base.where(n % 10 == 0).select("id", F.upper("full_name").alias("full_name")).unionByName(base.where(n % 50 == 0).select(F.concat("id", F.lit("-b")).alias("id"), "full_name"))
    return store.upsert(base, patches)


@REGISTRY.query("repository_delete", f"SELECT id FROM repositories WHERE {_NUMBER} % 10 <> 0")
def repository_delete(spark, sf_dir):
    base = scan(spark, sf_dir, "repositories").select("id")
    dead = base.where(F.expr(_NUMBER) % 10 == 0).unionByName(spark.createDataFrame([("absent",)], "id string"))
    return store.delete(base, dead)


@REGISTRY.query("repository_create", "SELECT full_name, owner, name, installation_id, true AS is_active, coalesce(model_preference, 'auto') AS model_preference, created_at FROM repositories")
def repository_create(spark, sf_dir):
    return store.create_repository(scan(spark, sf_dir, "repositories"), F.col("created_at"))


@REGISTRY.query(
    "queue_join",
    f"""WITH {REQUESTS} SELECT m.delivery_id, req.status, p.id AS repository_id, p.is_active,
  CASE WHEN req.id IS NULL THEN 'request not found' WHEN p.full_name IS NULL THEN 'repository not found' END AS problem
FROM review_messages m LEFT JOIN req ON m.review_request_id = req.id LEFT JOIN repositories p ON p.full_name = req.repository_full_name""",
)
def queue_join(spark, sf_dir):
    messages = scan(spark, sf_dir, "review_messages").select("delivery_id", "review_request_id")
    return store.resolve(messages, requests(spark, sf_dir, "repository_full_name", "status"), scan(spark, sf_dir, "repositories")).drop("review_request_id")
