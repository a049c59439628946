"""Review processing from requests with raw diffs to results: prompts out, replies in.

``reviewed`` is the whole of it over recorded calls: a prompt per file, the chain of
providers walked inside the row of the prompt, and one result per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mergelens.config import ReviewOptions
from mergelens.operators import diff, health, render, replies


def prompts(requests: DataFrame, options: ReviewOptions | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per file of each request (``id``, ``title``, ``raw_diff``, ``language``,
    ``custom_prompt``): ``id``, ``chunk``, ``chunks``, ``file_path``, the columns to ``carry``
    and both prompts. The description stays out of the prompt of a single file."""
    options = options or ReviewOptions()
    files = diff.diff_files(requests, "raw_diff", ["id", "title", "language", "custom_prompt", *carry], excludes=options.exclude_patterns, max_files=options.max_files)
    user = render.chunk_prompt(F.col("title"), F.lit(None).cast("string"), F.col("file_path"), diff.diff_context(F.col("hunks")), F.col("chunk"), F.col("chunks"))
    return files.select("id", "chunk", "chunks", "file_path", *carry, render.system_prompt(F.col("language"), F.col("custom_prompt")).alias("system_prompt"), user.alias("user_prompt"))


def answers(asked: DataFrame, calls: DataFrame, providers: DataFrame) -> DataFrame:
    """Which recorded call answers each prompt of ``asked`` (``id``, ``chunk``, ``start``).

    ``calls``: ``id``, ``chunk``, ``name``, ``content`` (null for a failed call), ``model``,
    ``input_tokens``, ``output_tokens``, ``latency_ms``; of several calls of one name the
    least counts. The chain from ``start`` is walked inside the row until a call has
    content. Gives ``id``, ``chunk`` and the reply's fields with ``provider`` and its notes,
    and ``latency_ms`` of all calls on the way; null fields where none answered."""
    chain = health.fallback_chains(asked.sparkSession, providers)
    chains = chain.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("step", "name", "usable", health.noted(F.col("name"), F.col("through")).alias("noted")))).alias("chain"))
    made = calls.groupBy("id", "chunk").agg(F.array_sort(F.collect_list(F.struct("name", "content", "model", "input_tokens", "output_tokens", "latency_ms"))).alias("made"))  # a call per provider
    rows = asked.select("id", "chunk", "start").join(chains, "start", "left").join(made, ["id", "chunk"], "left")

    def tried(c: Column) -> Column:
        return F.struct(c["noted"].alias("noted"), F.when(c["usable"], F.try_element_at(F.filter("made", lambda m: m["name"] == c["name"]), F.lit(1))).alias("call"))

    walked = rows.select("id", "chunk", F.transform("chain", tried).alias("tries"))
    good = lambda t: t["call"]["content"].isNotNull()
    hit = F.array_position(F.transform("tries", good), True)  # from 1; 0 if none
    at = walked.withColumn("hit", F.try_element_at("tries", F.nullif(hit, F.lit(0)).cast("int"))).withColumn("way", F.slice("tries", 1, F.coalesce(hit, F.lit(0)).cast("int")))
    spent = F.aggregate("way", F.lit(0).cast("bigint"), lambda n, t: n + F.coalesce(t["call"]["latency_ms"], F.lit(0)))
    call = F.col("hit")["call"]
    return at.select("id", "chunk", call["content"].alias("content"), call["model"].alias("model"), F.col("hit")["noted"].alias("provider"), call["input_tokens"].alias("input_tokens"), call["output_tokens"].alias("output_tokens"), spent.alias("latency_ms"))


def results(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """One row per request from the replies to its files (``id``, ``chunk`` and the reply's fields).

    Comments are joined in order of the files; tokens are summed, and so is the elapsed
    time where replies have ``latency_ms``; provider and model are those of the last
    file. A request whose diff has no file is completed without a review; one of whose
    files got no reply fails as a whole. A new review is put behind those that a column
    ``reviews`` of the request has, with the fields that these have."""
    latency = F.col("latency_ms").cast("bigint") if "latency_ms" in answered.columns else F.lit(None).cast("bigint")
    parsed = answered.select("id", F.struct("chunk", "provider", "model", "input_tokens", "output_tokens", latency.alias("latency_ms"), F.col("content").isNotNull().alias("answered"), replies.comments(F.col("content")).alias("comments")).alias("r"))
    grouped = parsed.groupBy(F.col("id").alias("answered_id")).agg(F.array_sort(F.collect_list("r")).alias("rs"))  # a request's files, at most max_files
    r, last = F.col("rs"), F.element_at("rs", -1)
    # bound as columns of their own: what follows refers to them many times
    joined = requests.join(grouped, F.col("id") == F.col("answered_id"), "left").withColumn("found", F.flatten(F.transform("rs", lambda x: x["comments"])))
    failed = F.exists(r, lambda x: ~x["answered"])
    total = lambda k, zero=F.lit(0): F.aggregate(r, zero, lambda a, x: a + F.coalesce(x[k], F.lit(0)))
    comments = F.col("found")
    review = F.struct(
        last["provider"].alias("provider"),
        last["model"].alias("model"),
        render.summary(comments).alias("summary"),
        comments.alias("comments"),
        F.struct(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens")).alias("token_usage"),
        F.when(~F.forall(r, lambda x: x["latency_ms"].isNull()), total("latency_ms", F.lit(0).cast("bigint"))).alias("latency_ms"),
        F.exists(r, lambda x: F.coalesce(F.contains(x["provider"], F.lit("fallback")), F.lit(False))).alias("fallback_used"),
    )
    done = r.isNotNull() & ~failed
    out = joined.select(
        *[c for c in requests.columns if c not in ("raw_diff", "status")],
        F.when(r.isNotNull() & failed, "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(done, review).alias("review"),
        F.when(done, comments).otherwise(F.array().cast(comments_type())).alias("comments"),
    )
    if "reviews" not in requests.columns:
        return out
    kind = requests.schema["reviews"].dataType
    new = F.array(F.struct(*[F.col("review")[f.name].alias(f.name) for f in kind.elementType.fields])).cast(kind)
    return out.withColumn("reviews", F.when(F.col("review").isNull(), F.col("reviews")).otherwise(F.concat(F.coalesce("reviews", F.array().cast(kind)), new)))


def reviewed(requests: DataFrame, calls: DataFrame, providers: DataFrame, default: str, options: ReviewOptions | None = None) -> DataFrame:
    """``results`` of ``requests`` (as for ``prompts``, and ``model_preference``) answered by recorded ``calls``.

    Null ids are left out. A preference that is no provider's name fails the request, as does a chain that ends."""
    named = requests.where("id IS NOT NULL")
    asked = prompts(named, options, ("model_preference",)).select("id", "chunk", health.start_provider(F.col("model_preference"), default).alias("start"))
    return results(named, answers(asked, calls, providers))


def comments_type() -> str:
    return "array<struct<file_path:string,line_number:int,category:string,severity:string,content:string,suggestion:string>>"


def observed(processed: DataFrame, name: str = "reviews") -> tuple[DataFrame, Observation]:
    """``processed`` with counters that Spark fills while an action runs, for export by a listener."""
    seen = Observation(name)
    done, bad = F.col("status") == "COMPLETED", F.col("status") == "FAILED"
    return processed.observe(seen, F.count_if(done).alias("completed"), F.count_if(bad).alias("failed"), F.sum(F.size("comments")).alias("comments")), seen
