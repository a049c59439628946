"""Problem 8: mixing sources to target shares by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated up to its cap.
The r-th use of a document gets the virtual finish time (tokens of its source up to
and including that use) / (target share); ordering all uses by finish time and cutting
at the token budget gives every source its share for as long as it has tokens.

Running sums never run over a whole source in one task: sums of hash buckets are
summed up first, then added to running sums inside the buckets. The same is done
along the finish time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergelens.session import cut_lineage

#: Documents of one bucket of a running sum, on average.
BUCKET_ROWS = 20_000
#: Rows that the table of targets may have; it is read by the driver as a setting.
MOST_TARGETS = 100_000


def _running(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, into: str) -> DataFrame:
    """``df`` with ``into``: the sum of ``value`` over all rows of the same ``keys`` up to this one,
    by ``bucket`` and ``order``; no task sees more than a bucket of rows, or a row per bucket."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("bucket_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, bucket, F.coalesce(F.sum("bucket_sum").over(before), F.lit(0)).alias("bucket_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("in_bucket", F.sum(value).over(inside)).join(offsets, [*keys, bucket]).withColumn(into, F.col("in_bucket") + F.col("bucket_before")).drop("in_bucket", "bucket_before")


def fill_level(queues: list[tuple[float, float]], budget: float) -> float:
    """Virtual time at which queues of (share, tokens available) have given ``budget`` in all;
    infinite if they can't."""
    at, left = 0.0, budget
    ends = sorted((cap / share, share) for share, cap in queues if share > 0)
    rate = sum(share for _, share in ends)
    for end, share in ends:
        if left <= (end - at) * rate:
            return at + left / rate
        left -= (end - at) * rate
        at, rate = end, rate - share
    return math.inf


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``plan``, ``source``, ``doc_id``, ``repeat_no`` from 1, ``tokens`` and ``mix_end``,
    the tokens of the mix up to and including this use.

    ``sizes`` has ``doc_id``, ``source`` and ``tokens``; ``targets`` has ``plan``,
    ``source``, ``target_share``, ``max_repeats`` and ``size_ratio``, the budget as a
    part of all tokens of ``sizes``. A use that would pass the budget ends the mix.

    Documents with null source or no tokens are in no mix, but count in the corpus;
    rows of ``targets`` with a null plan or source, or a share or cap that is null or
    not above 0, ask for nothing. Sources without documents leave their share to the
    others. Equal rows of ``sizes`` are as many documents; ties of the order are broken
    by ``doc_id``. Empty tables give an empty mix.
    """
    sizes = sizes.select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens"))
    totals = {r.source: r for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"), F.count_if(F.col("tokens") > 0).alias("docs")).join(targets.select("source").distinct(), "source", "left_semi").limit(MOST_TARGETS).collect()}
    corpus = sizes.agg(F.sum("tokens")).first()[0] or 0
    rows = targets.where("plan IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND max_repeats > 0 AND size_ratio > 0").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    settings, uses = [], 0.0
    for plan in sorted({r.plan for r in rows}):
        own = [r for r in rows if r.plan == plan and r.source in totals and totals[r.source].tokens]
        budget = int(corpus * min((r.size_ratio for r in own), default=0))
        slack = sum(totals[r.source].most for r in own)
        level = fill_level([(r.target_share, float(r.max_repeats * totals[r.source].tokens)) for r in own], float(budget + slack))
        for r in own:
            t = totals[r.source]
            reach = min(float(r.max_repeats * t.tokens), level * r.target_share)
            settings.append((plan, r.source, float(r.target_share), int(r.max_repeats), budget, int(t.tokens), math.ceil(reach)))
            uses += reach / t.tokens * t.docs
    spark = sizes.sparkSession
    plans = spark.createDataFrame(settings, "plan string, source string, share double, most int, budget bigint, source_tokens bigint, reach bigint")
    docs = max(1, sum(t.docs for t in totals.values()))
    buckets = max(1, docs // BUCKET_ROWS)
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    queue = sizes.where("source IS NOT NULL AND tokens > 0").withColumn("shuffled", mixed).withColumn("bucket", F.floor((F.col("shuffled") / 2.0**64 + 0.5) * buckets))
    queue = _running(queue, ["source"], "bucket", ["shuffled", "doc_id", "tokens"], "tokens", "upto")
    rounds = F.least(F.col("most").cast("bigint"), F.floor((F.col("reach") - F.col("upto")) / F.col("source_tokens")) + 1)
    used = (
        queue.join(plans, "source")
        .where(rounds > 0)
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(1), rounds.cast("int"))))
        .withColumn("finish", ((F.col("repeat_no") - 1) * F.col("source_tokens") + F.col("upto")) / F.col("share"))
    )
    # uses up to a time, as each source gives them evenly until it ends: buckets of equal share however early a source runs out
    def pace(plan: str) -> list[tuple[float, float]]:
        return [(x[6] / x[2], totals[x[1]].docs * x[2] / x[5]) for x in settings if x[0] == plan]

    paces = spark.createDataFrame([(p, pace(p), sum(end * rate for end, rate in pace(p))) for p in sorted({x[0] for x in settings})], "plan string, paces array<struct<end:double,rate:double>>, all_uses double")
    parts = max(1, int(uses) // BUCKET_ROWS)
    so_far = F.aggregate("paces", F.lit(0.0), lambda n, p: n + F.least(F.col("finish"), p["end"]) * p["rate"])
    used = used.join(paces, "plan").withColumn("time_bucket", F.floor(so_far / F.col("all_uses") * parts)).drop("paces", "all_uses")
    ordered = _running(used, ["plan"], "time_bucket", ["finish", "source", "doc_id", "shuffled", "repeat_no"], "tokens", "mix_end")
    return ordered.where(F.col("mix_end") <= F.col("budget")).select("plan", "source", "doc_id", "repeat_no", "tokens", "mix_end")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per plan and source of ``targets``: the share asked for and reached, tokens, documents and uses."""
    got = mixed.groupBy("plan", "source").agg(F.sum("tokens").alias("mix_tokens"), F.count(F.lit(1)).alias("uses"), F.count_if(F.col("repeat_no") == 1).alias("used_docs"), F.max("repeat_no").alias("repeats"))
    out = targets.select("plan", "source", "target_share", "max_repeats").join(got, ["plan", "source"], "left")
    zero = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("mix_tokens", "uses", "used_docs", "repeats")]
    out = out.select("plan", "source", "target_share", "max_repeats", *zero)
    whole = F.sum("mix_tokens").over(Window.partitionBy("plan"))
    return out.withColumn("reached_share", F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(0.0))


def token_sizes(documents: DataFrame, count) -> DataFrame:
    """``doc_id``, ``source`` and ``tokens`` of all documents, encoded once and kept in the shared folder."""
    return cut_lineage(documents.select("doc_id", "source", count(F.col("text")).alias("tokens")))


def mix_check(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per plan with a mix: whether it keeps to its budget (``budget_kept``), no source goes round more often than it
    may (``caps_kept``), and sources that didn't run out have tokens in proportion to their targets, to within two of
    their largest documents (``shares_kept``)."""
    corpus = sizes.agg(F.sum("tokens").alias("corpus"))
    most = sizes.where("tokens > 0").groupBy("source").agg(F.max("tokens").alias("largest"), F.sum("tokens").alias("own"))
    got = mixed.groupBy("plan", "source").agg(F.sum("tokens").alias("got"), F.max("repeat_no").alias("rounds"), F.max("mix_end").alias("end"))
    rows = targets.where("target_share > 0 AND max_repeats > 0 AND size_ratio > 0").join(most, "source").join(got, ["plan", "source"], "left").crossJoin(corpus)  # one row
    time, slack = F.coalesce("got", F.lit(0)) / F.col("target_share"), 2 * F.col("largest") / F.col("target_share")
    ran_out = F.coalesce("got", F.lit(0)) >= F.col("own") * F.col("max_repeats")
    every = F.max(time).over(Window.partitionBy("plan"))
    loose = F.max(slack).over(Window.partitionBy("plan"))
    rows = rows.withColumn("fair", ran_out | (time >= every - slack - loose)).withColumn("within", F.col("end").isNull() | (F.col("end") <= F.floor(F.col("corpus") * F.col("size_ratio"))))
    return rows.groupBy("plan").agg(F.bool_and("within").alias("budget_kept"), F.bool_and(F.coalesce(F.col("rounds") <= F.col("max_repeats"), F.lit(True))).alias("caps_kept"), F.bool_and("fair").alias("shares_kept"))
