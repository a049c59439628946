"""Statistics over requests with nested reviews, and reviews with nested comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.functions import text as X
from mergelens.operators.render import severity_count
from mergelens.session import fresh

DONE = "COMPLETED"


def nest(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, into: str, order: list[str]) -> DataFrame:
    """``parents`` with their ``children`` as an ordered array of structs, empty where there are none.

    A parent's children are a document and meet in one row; ``order`` comes first in each struct."""
    (key,) = fresh([*parents.columns, *children.columns], "nest_key")
    fields = [*order, *[c for c in children.columns if c not in order and c != child_key]]
    groups = children.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(into))
    joined = parents.join(groups, F.col(parent_key) == F.col(key), "left").drop(key)
    return joined.withColumn(into, F.coalesce(into, F.array().cast(groups.schema[into].dataType)))


def reviews(requests: DataFrame, done_only: bool = True) -> DataFrame:
    """One row per review of completed requests, its fields flat; other columns are pruned."""
    own = requests.where(F.col("status") == F.lit(DONE)) if done_only else requests
    return own.select(F.col("id").alias("request_id"), F.explode("reviews").alias("review")).select("request_id", "review.*")


def overview(requests: DataFrame) -> DataFrame:
    """One row: totals by state, and the mean latency of reviews of completed requests, 0 without any.

    One pass: each row adds its reviews' sum and count, so latencies aren't weighted by comments."""
    latencies = F.filter(F.transform("reviews", lambda r: r["latency_ms"]), lambda x: x.isNotNull())
    done = F.col("status") == F.lit(DONE)
    total = F.when(done, F.aggregate(latencies, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(0)
    count = F.when(done, F.size(latencies)).otherwise(0)
    return requests.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(done).alias("completed_reviews"),
        F.count_if(F.col("status") == "FAILED").alias("failed_reviews"),
        F.coalesce(F.sum(total).cast("double") / F.nullif(F.sum(count), F.lit(0)), F.lit(0.0)).alias("avg_latency_ms"),
    )


def of_requests(children: DataFrame, requests: DataFrame, key: str = "review_request_id", done_only: bool = True) -> DataFrame:
    """Flat ``children`` (reviews, replies) of ``requests``, completed ones unless told otherwise: a semi-join, nothing is nested."""
    own = requests.where(F.col("status") == F.lit(DONE)) if done_only else requests
    return children.join(own.select(F.col("id").alias(key)), key, "left_semi")


def count_providers(reviews: DataFrame) -> DataFrame:
    """Flat reviews by provider, the name before any note."""
    return reviews.groupBy(X.provider_name(F.col("provider")).alias("provider")).agg(F.count(F.lit(1)).alias("reviews"))


def count_categories(comments: DataFrame) -> DataFrame:
    """Flat comments by category as it stands."""
    return comments.groupBy("category").agg(F.count(F.lit(1)).alias("comments"))


def by_provider(requests: DataFrame) -> DataFrame:
    """Reviews of completed requests by provider, from nested requests."""
    return count_providers(reviews(requests))


def by_category(requests: DataFrame) -> DataFrame:
    """Comments of reviews of completed requests by category, from nested requests."""
    return count_categories(reviews(requests).select(F.explode("comments").alias("c")).select("c.category"))


def statistics(requests: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """The statistics row: totals, mean latency, and counts by provider and category as maps.

    ``comments`` (``category``), those of completed requests, are taken from the reviews unless given. Null providers aren't keys of the map. The maps have an entry per provider and category."""
    as_map = lambda df, k, v, name: df.where(F.col(k).isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias(name)).withColumn("one", F.lit(1))
    providers = as_map(by_provider(requests), "provider", "reviews", "reviews_by_provider")
    found = by_category(requests) if comments is None else count_categories(comments)
    categories = as_map(found, "category", "comments", "issues_by_category")
    return overview(requests).withColumn("one", F.lit(1)).join(providers, "one").join(categories, "one").drop("one")


def count_tokens(reviews: DataFrame) -> DataFrame:
    """Tokens of flat reviews by provider and direction."""
    usage = reviews.groupBy(X.provider_name(F.col("provider")).alias("provider")).agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output"))
    return usage.unpivot("provider", ["input", "output"], "direction", "tokens")


def token_usage(requests: DataFrame) -> DataFrame:
    """Tokens by provider and direction over all reviews, from nested requests."""
    return count_tokens(reviews(requests, done_only=False))


def request_outcomes(requests: DataFrame) -> DataFrame:
    """Per request with reviews: token sums, whether any review fell back, and provider and model of the last one."""
    r = F.col("reviews")
    last = F.element_at(r, -1)
    total = lambda field: F.aggregate(r, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[field], F.lit(0)))
    return requests.where(F.size(r) > 0).select(
        F.col("id").alias("request_id"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        F.exists(r, lambda x: F.coalesce(F.contains(x["provider"], F.lit("fallback")), F.lit(False))).alias("fallback_used"),
        last["provider"].alias("last_provider"),
        last["model"].alias("last_model"),
    )


def all_comments(requests: DataFrame) -> DataFrame:
    """``id`` and all comments of a request's reviews, in order."""
    return requests.select("id", F.flatten(F.transform("reviews", lambda r: r["comments"])).alias("comments"))


def severity_buckets(comments: DataFrame) -> DataFrame:
    """Per request: how many comments of each severity, and in all."""
    c = F.col("comments")
    return comments.select("id", *[severity_count(c, s).alias(s.lower()) for s in X.SEVERITIES], F.size(c).alias("total"))
