"""Documents kept as versions: upsert, delete, patch and the views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.session import fresh

#: Columns of the public views; the others (secrets, tokens, installations) are never read.
REQUEST_VIEW = ("id", "repository_full_name", "platform_pr_id", "title", "author", "status", "reviews", "created_at")
REPOSITORY_VIEW = ("id", "platform", "full_name", "is_active", "settings", "review_rules", "model_preference", "created_at")


def view(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns of a view that ``df`` has."""
    return df.select(*[c for c in columns if c in df.columns])


def latest(df: DataFrame, version: list[str], key: str = "id") -> DataFrame:
    """One row per key: that of the greatest ``version``, null versions least, ties by the whole row's hash.

    A hash aggregation with map-side combine, so a key with many versions isn't gathered.
    Rows with a null key are dropped."""
    (row,) = fresh(df.columns, "row")
    order = F.struct(*[x for c in version for x in (F.col(c).isNotNull(), F.col(c))], F.xxhash64(*df.columns))
    kept = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(fresh(df.columns, "key")[0])).agg(F.max_by(F.struct(*df.columns), order).alias(row))
    return kept.select(f"{row}.*")


def upsert(base: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with whole documents of ``patches`` in place of those with the same key, new keys appended.

    A null key is a new document; its key is made from its content. Of several patches
    of one key the greatest by hash wins; give them a version and use ``latest`` to say which."""
    keyed = patches.withColumn(key, F.coalesce(F.col(key), F.concat(F.lit("new-"), F.hex(F.xxhash64(*patches.columns)))))
    keyed = latest(keyed, [], key)
    return base.join(keyed.select(key), key, "left_anti").unionByName(keyed)


def patch(base: DataFrame, patches: DataFrame, columns: list[str], key: str = "id", now: Column | None = None) -> DataFrame:
    """``base`` with the non-null ``columns`` of ``patches``; null ones keep the old value. Unknown keys are ignored."""
    change = patches.select(F.col(key).alias("patch_key"), F.struct(*columns).alias("change"))
    joined = base.join(change, F.col(key) == F.col("patch_key"), "left")
    out = joined.withColumns({c: F.coalesce(F.col("change")[c], F.col(c)) for c in columns})
    if now is not None:
        out = out.withColumn("updated_at", F.when(F.col("patch_key").isNotNull(), now).otherwise(F.col("updated_at")))
    return out.drop("patch_key", "change")


def replace_rules(base: DataFrame, rules: DataFrame, key: str = "id", column: str = "review_rules") -> DataFrame:
    """``base`` with the whole array of rules swapped where ``rules`` has the key."""
    return patch(base, rules, [column], key)


def delete(base: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """``base`` without the keys of ``tombstones``; absent ones do nothing."""
    return base.join(tombstones.select(key).distinct(), key, "left_anti")


def create_repository(requests: DataFrame, now: Column) -> DataFrame:
    """New repository documents of create requests: ``full_name`` must be owner/name, else an error."""
    parts = F.split("full_name", "/", -1)
    good = F.size(parts) == 2
    need = lambda c: F.when(good, c).otherwise(F.raise_error(F.concat(F.lit("full_name must be owner/name: "), F.col("full_name"))))
    return requests.select(
        "full_name",
        need(F.element_at(parts, 1)).alias("owner"),
        need(F.try_element_at(parts, F.lit(2))).alias("name"),
        "installation_id",
        F.lit(True).alias("is_active"),
        F.coalesce(F.col("model_preference"), F.lit("auto")).alias("model_preference"),
        now.alias("created_at"),
    )


def retryable(requests: DataFrame, strict: bool = False) -> DataFrame:
    """Only failed requests can be tried again; with ``strict`` any other is an error."""
    if strict:
        status = F.when(F.col("status") == "FAILED", F.col("status")).otherwise(F.raise_error(F.concat(F.lit("only failed requests can be retried: "), F.col("id"))))
        return requests.withColumn("status", status)
    return requests.where(F.col("status") == "FAILED")


def requeued(requests: DataFrame) -> DataFrame:
    """Queue messages of requests to try again."""
    return queue_messages(retryable(requests).withColumn("status", F.lit("PENDING")))


def queue_messages(requests: DataFrame) -> DataFrame:
    """Wire form: a flat map of strings per request."""
    pairs = [F.lit("reviewRequestId"), F.col("id"), F.lit("repositoryFullName"), F.col("repository_full_name"), F.lit("pullRequestNumber"), F.col("platform_pr_id").cast("string")]
    return requests.select(F.create_map(*pairs).alias("message"))


def read_messages(messages: DataFrame) -> DataFrame:
    """Typed fields of queue messages."""
    m = F.col("message")
    return messages.select(m["reviewRequestId"].alias("review_request_id"), m["repositoryFullName"].alias("repository_full_name"), m["pullRequestNumber"].try_cast("int").alias("pull_request_number"))


def resolve(messages: DataFrame, requests: DataFrame, repositories: DataFrame, missing: str = "report") -> DataFrame:
    """Messages with their request and repository.

    ``missing``: ``report`` keeps unresolved ones with a ``problem``, ``fail`` raises an error for them."""
    r = requests.select(F.col("id").alias("request_id"), F.col("repository_full_name").alias("request_repository"), "status")
    p = repositories.select(F.col("full_name").alias("repository"), F.col("id").alias("repository_id"), "is_active")
    joined = messages.join(r, F.col("review_request_id") == F.col("request_id"), "left").join(p, F.col("request_repository") == F.col("repository"), "left")
    problem = F.when(F.col("request_id").isNull(), "request not found").when(F.col("repository").isNull(), "repository not found")
    if missing == "fail":
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(": "), F.col("review_request_id")))).otherwise(F.lit(None).cast("string"))
    return joined.select(*messages.columns, "status", "repository_id", "is_active", problem.alias("problem"))
