"""Queries of problem 5: messages delivered more than once."""

from __future__ import annotations

from mergelens.operators import dedup
from mergelens.plans.registry import Registry
from mergelens.sources.tables import scan

REGISTRY = Registry()

_KEYED = r"""
WITH keyed AS (
  SELECT *, nullif(lower(regexp_replace(review_request_id, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), '') AS mid FROM review_messages
)
"""


@REGISTRY.query(
    "p5_found",
    _KEYED
    + """
SELECT a.delivery_id AS delivery_id_a, b.delivery_id AS delivery_id_b
FROM keyed a JOIN keyed b ON a.mid = b.mid AND a.pull_request_number IS NOT DISTINCT FROM b.pull_request_number AND a.delivery_id < b.delivery_id
""",
)
def p5_found(spark, sf_dir):
    return dedup.delivery_pairs(scan(spark, sf_dir, "review_messages"))


@REGISTRY.query(
    "p5_unique",
    _KEYED
    + """
SELECT delivery_id, review_request_id, repository_full_name, pull_request_number, batch_id, enqueued_at, received_at
FROM (SELECT *, row_number() OVER (PARTITION BY mid, pull_request_number ORDER BY received_at NULLS LAST, delivery_id) AS rn FROM keyed)
WHERE mid IS NULL OR rn = 1
""",
)
def p5_unique(spark, sf_dir):
    return dedup.keep_one(scan(spark, sf_dir, "review_messages"))
