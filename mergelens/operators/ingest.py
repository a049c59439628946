"""Intake of change events: signature, parse, filter chain, policy and projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions import signature as S

EVENT = """action string, number int,
pull_request struct<id:bigint,number:int,title:string,body:string,state:string,draft:boolean,head:struct<ref:string,sha:string>,base:struct<ref:string,sha:string>,user:struct<login:string,id:bigint,type:string>,html_url:string,diff_url:string>,
repository struct<id:bigint,full_name:string,name:string,owner:struct<login:string,id:bigint>>,
installation struct<id:bigint>, sender struct<login:string,id:bigint,type:string>"""
#: Actions that start a review.
ACTIONS = ("opened", "synchronize", "reopened")


def drop_reason(secret: str | None, active: Column, review_on_draft: Column) -> Column:
    """The first gate that an event with ``body``, ``event_type``, ``signature`` and parsed ``e`` fails, or null.

    The order is that of the gates: signature, event type, parse, action, completeness,
    sender, repository, draft. ``secret`` None leaves the signature gate out; a blank one is
    an error, since it would let every event in."""
    if secret is not None and not secret.strip():
        raise ValueError("a secret is required; None leaves the signature gate out")
    e = F.col("e")
    gate = F.lit(None).cast("string")
    chain = [
        (~S.verified(F.col("body"), F.col("signature"), secret, require_secret=True) if secret is not None else F.lit(False), "bad signature"),
        (~F.col("event_type").eqNullSafe(F.lit("pull_request")), "other event"),
        (e.isNull() | e["action"].isNull(), "malformed"),
        (~e["action"].isin(*ACTIONS), "other action"),
        (e["pull_request"].isNull() | e["repository"]["full_name"].isNull() | e["installation"]["id"].isNull(), "incomplete"),
        (e["sender"]["type"].eqNullSafe(F.lit("Bot")), "bot"),
        (~F.coalesce(active, F.lit(False)), "inactive repository"),
        (F.coalesce(e["pull_request"]["draft"], F.lit(False)) & ~F.coalesce(review_on_draft, F.lit(False)), "draft"),
    ]
    for failed, reason in reversed(chain):
        gate = F.when(failed, reason).otherwise(gate)
    return gate


def judge_events(events: DataFrame, repositories: DataFrame, secret: str | None = None) -> DataFrame:
    """``events`` (``body`` JSON, ``event_type``, ``signature``) with the parsed ``e``, the repository's id and ``reason``.

    Works on a stream as well: the repositories are joined as a static table, which Spark
    broadcasts by its size. Of several repositories of one name the least id counts."""
    settings = repositories.groupBy(F.col("full_name").alias("repo_name")).agg(F.min_by(F.struct(F.col("id").alias("repo_id"), F.coalesce("is_active", F.lit(False)).alias("repo_active"), F.col("settings.review_on_draft").alias("repo_draft")), "id").alias("repo"))
    parsed = events.withColumn("e", F.from_json("body", EVENT))
    joined = parsed.join(settings, F.col("e.repository.full_name") == F.col("repo_name"), "left")
    return joined.withColumn("reason", drop_reason(secret, F.col("repo.repo_active"), F.col("repo.repo_draft"))).withColumn("repository_id", F.col("repo.repo_id")).drop("repo", "repo_name")


def accepted_requests(judged: DataFrame, now: Column, keys: list[str] | None = None) -> DataFrame:
    """New requests of the events that no gate stopped, with ``keys`` of the event in front."""
    e = F.col("e")
    return judged.where(F.col("reason").isNull()).select(
        *(keys or []),
        "repository_id",
        e["repository"]["full_name"].alias("repository_full_name"),
        e["pull_request"]["number"].alias("platform_pr_id"),
        e["pull_request"]["title"].alias("title"),
        e["pull_request"]["user"]["login"].alias("author"),
        e["pull_request"]["head"]["sha"].alias("head_sha"),
        e["pull_request"]["base"]["ref"].alias("base_branch"),
        e["pull_request"]["head"]["ref"].alias("head_branch"),
        F.lit("PENDING").alias("status"),
        now.alias("created_at"),
    )
