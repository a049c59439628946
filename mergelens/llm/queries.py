"""Queries of the problems on text; registered only where this package can be imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergelens.llm import credentials, generated_files, mixing, percentiles, reading, splitting, tokens, truncation
from mergelens.plans.registry import Registry
from mergelens.session import cut_lineage
from mergelens.sources.tables import scan

REGISTRY = Registry()


@REGISTRY.query("p1_found")
def p1_found(spark, sf_dir):
    files = scan(spark, sf_dir, "file_diffs").select("diff_id", "file_path", "patch")
    return generated_files.classify_files(files).where(F.col("file_class").isin(*generated_files.FOUND)).select("diff_id").distinct()


@REGISTRY.query(
    "p1_counts",
    """SELECT count(*) AS files, count(*) FILTER (WHERE patch IS NULL) AS no_patch, count(*) FILTER (WHERE patch IS NOT NULL AND regexp_matches(lower(trim(file_path)), '(^|/)(package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml|go\\.sum|poetry\\.lock|gemfile\\.lock)$')) AS lockfiles, true AS parted FROM file_diffs""".replace("\\\\", "\\"),
)
def p1_counts(spark, sf_dir):
    """Files in all, without a patch, and lock files of six names that have their class; every file has one class, and found ones are those not written by hand."""
    files = scan(spark, sf_dir, "file_diffs").select("diff_id", "file_path", "patch")
    kind = F.col("file_class")
    lock = F.lower(F.trim("file_path")).rlike(r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|go\.sum|poetry\.lock|gemfile\.lock)$")
    parted = kind.isin(*generated_files.FOUND).cast("int") + (kind == "hand_written").cast("int") + (kind == "no_patch").cast("int") == 1
    return generated_files.classify_files(files).agg(F.count(F.lit(1)).alias("files"), F.count_if(kind == "no_patch").alias("no_patch"), F.count_if(lock & (kind == "lockfile")).alias("lockfiles"), F.bool_and(parted).alias("parted"))


@REGISTRY.query("p1_classes")
def p1_classes(spark, sf_dir):
    files = scan(spark, sf_dir, "file_diffs").select("diff_id", "file_path", "patch")
    return generated_files.classify_files(files).select("diff_id", "file_path", "file_class")


_LONG_ITEMS = """
WITH items AS (
  SELECT 'patch' AS item_kind, diff_id AS row_id, 0 AS hunk_no, patch AS item_text FROM file_diffs
  UNION ALL
  SELECT 'diff_content', prompt_id, 0, diff_content FROM review_prompts
  UNION ALL
  SELECT 'hunk', diff_id, i, array_to_string(list_concat([coalesce(hunks[i].header, '')], list_transform(coalesce(hunks[i].lines, []), lambda x: concat(CASE upper(x.type) WHEN 'ADDED' THEN '+' WHEN 'REMOVED' THEN '-' ELSE ' ' END, x.content))), chr(10))
  FROM (SELECT diff_id, hunks, CAST(unnest(range(1, len(hunks) + 1)) AS INTEGER) AS i FROM file_diffs)
)
SELECT item_kind, row_id, hunk_no FROM items JOIN size_limits USING (item_kind) WHERE length(item_text) > max_chars
"""


@REGISTRY.query("p2_found", _LONG_ITEMS)
def p2_found(spark, sf_dir):
    cut = splitting.split_review_items(*(scan(spark, sf_dir, t) for t in ("file_diffs", "review_prompts", "size_limits")), with_text=False)
    return cut.where(F.col("piece_no") == 2).select("item_kind", "row_id", "hunk_no")


@REGISTRY.query("p2_pieces")
def p2_pieces(spark, sf_dir):
    return splitting.split_review_items(*(scan(spark, sf_dir, t) for t in ("file_diffs", "review_prompts", "size_limits")))


@REGISTRY.query("p2_checked", _LONG_ITEMS.replace("SELECT item_kind, row_id, hunk_no FROM", "SELECT item_kind, row_id, hunk_no, md5(item_text) AS digest, true AS within, true AS lapped FROM"))
def p2_checked(spark, sf_dir):
    """Each cut item's text as its pieces join up to it, and whether they keep to the size and the overlap."""
    limits = scan(spark, sf_dir, "size_limits").select("item_kind", "max_chars", "overlap_chars")
    got = p2_pieces(spark, sf_dir).join(limits, "item_kind")
    back = splitting.rejoined(got, ["item_kind", "row_id", "hunk_no"], F.col("overlap_chars"), F.col("max_chars"))
    return back.select("item_kind", "row_id", "hunk_no", F.md5("joined").alias("digest"), "within", "lapped")


@REGISTRY.query("p4_found")
def p4_found(spark, sf_dir):
    texts = credentials.code_texts(scan(spark, sf_dir, "file_diffs"), scan(spark, sf_dir, "review_prompts"))
    return credentials.credential_lines(texts, "code", ["item_kind", "row_id"])


@REGISTRY.query("p4_redacted")
def p4_redacted(spark, sf_dir):
    texts = credentials.code_texts(scan(spark, sf_dir, "file_diffs"), scan(spark, sf_dir, "review_prompts"))
    return credentials.redact_credentials(texts, "code")


_CODE = """SELECT 'patch' AS item_kind, diff_id AS row_id, patch AS code FROM file_diffs UNION ALL SELECT 'diff_content', prompt_id, diff_content FROM review_prompts"""


@REGISTRY.query("p4_checked", f"SELECT item_kind, row_id, len(string_split(code, chr(10))) AS lines, len(code) - len(replace(code, chr(13), '')) AS returns, true AS kept FROM ({_CODE}) WHERE code IS NOT NULL")
def p4_checked(spark, sf_dir):
    """Lines and line ends of the redacted texts, and whether all that stands between masks is in the text as it was, in order."""
    texts = credentials.code_texts(scan(spark, sf_dir, "file_diffs"), scan(spark, sf_dir, "review_prompts")).where("code IS NOT NULL")
    both = credentials.redact_credentials(texts, "code", "redacted")
    return both.select("item_kind", "row_id", F.size(F.split("redacted", "\n", -1)).cast("bigint").alias("lines"), (F.length("redacted") - F.length(F.replace("redacted", F.lit("\r"), F.lit("")))).cast("bigint").alias("returns"), credentials.kept_outside(F.col("code"), F.col("redacted")).alias("kept"))


def _latency_summaries(spark, sf_dir):
    """Summaries of days, kept, and of all days, with the span they are for."""
    calls = percentiles.call_latencies(scan(spark, sf_dir, "review_results"))
    daily = cut_lineage(percentiles.summaries(calls, ["provider", "day"], "latency_ms"))
    total = percentiles.combine(daily, ["provider"], [F.trunc("day", "month")])
    return calls, daily.withColumn("span", F.lit("day")).unionByName(total.withColumn("span", F.lit("total")).withColumn("day", F.lit(None).cast("date")))


@REGISTRY.query("p6_percentiles")
def p6_percentiles(spark, sf_dir):
    _, parts = _latency_summaries(spark, sf_dir)
    return percentiles.percentiles(parts, ["provider", "span", "day"])


@REGISTRY.query(
    "p6_within_bound",
    """
WITH calls AS (
  SELECT DISTINCT result_id, nullif(split_part(trim(provider), ' ', 1), '') AS provider, CAST(created_at AS DATE) AS day, latency_ms FROM review_results WHERE latency_ms >= 0
)
SELECT provider, 'day' AS span, day, count(*) AS n, true AS within FROM calls GROUP BY ALL
UNION ALL
SELECT provider, 'total', NULL, count(*), true FROM calls GROUP BY ALL
""",
)
def p6_within_bound(spark, sf_dir):
    """Whether each percentile's exact rank is within the stated bound, and that within the permitted part of the count."""
    calls, parts = _latency_summaries(spark, sf_dir)
    got = cut_lineage(percentiles.percentiles(parts, ["provider", "span", "day"]))
    both = calls.where("latency_ms >= 0").withColumn("spans", F.array(F.struct(F.lit("day").alias("span"), F.col("day").alias("day")), F.struct(F.lit("total").alias("span"), F.lit(None).cast("date").alias("day"))))
    both = both.select(F.col("provider").alias("p"), "latency_ms", F.explode("spans").alias("s")).select("p", F.col("s.span").alias("sp"), F.col("s.day").alias("d"), "latency_ms")
    joined = both.join(got, F.col("p").eqNullSafe(F.col("provider")) & (F.col("sp") == F.col("span")) & F.col("d").eqNullSafe(F.col("day")))
    names = list(percentiles.QUANTILES)
    ranks = [F.count_if(F.col("latency_ms") < F.col(k)).alias(f"{k}_below") for k in names] + [F.count_if(F.col("latency_ms") <= F.col(k)).alias(f"{k}_upto") for k in names]
    exact = joined.groupBy("provider", "span", "day", "n", "max_rank_error").agg(F.count(F.lit(1)).alias("rows"), *ranks)
    within = (F.col("rows") == F.col("n")) & (F.col("max_rank_error") <= F.ceil(percentiles.EPSILON * F.col("n")))
    for k, q in percentiles.QUANTILES.items():
        rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n") - 1e-9))
        within &= (F.col(f"{k}_below") + 1 - rank <= F.col("max_rank_error")) & (rank - F.col(f"{k}_upto") <= F.col("max_rank_error"))
    return exact.select("provider", "span", "day", F.col("n").cast("bigint").alias("n"), within.alias("within"))


@REGISTRY.query("p7_ids")
def p7_ids(spark, sf_dir):
    return tokens.encode_corpus(scan(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _mix(spark, sf_dir):
    sizes = mixing.token_sizes(scan(spark, sf_dir, "documents"), tokens.count_column)
    return mixing.mix(sizes, scan(spark, sf_dir, "mix_targets"))


@REGISTRY.query("p8_mix")
def p8_mix(spark, sf_dir):
    return _mix(spark, sf_dir)


@REGISTRY.query("p8_report")
def p8_report(spark, sf_dir):
    return mixing.mix_report(_mix(spark, sf_dir), scan(spark, sf_dir, "mix_targets"))


@REGISTRY.query("p8_checked", "SELECT DISTINCT plan, true AS budget_kept, true AS caps_kept, true AS shares_kept FROM mix_targets JOIN documents USING (source) WHERE target_share > 0 AND max_repeats > 0 AND size_ratio > 0 AND text <> ''")
def p8_checked(spark, sf_dir):
    sizes = mixing.token_sizes(scan(spark, sf_dir, "documents"), tokens.count_column)
    targets = scan(spark, sf_dir, "mix_targets")
    return mixing.mix_check(cut_lineage(mixing.mix(sizes, targets)), sizes, targets)


def _truncation(spark, sf_dir):
    return truncation.detect_truncation(truncation.review_texts(scan(spark, sf_dir, "review_requests"), scan(spark, sf_dir, "model_replies")))


@REGISTRY.query("p3_found")
def p3_found(spark, sf_dir):
    return _truncation(spark, sf_dir).where("truncated").select("field", "row_id").distinct()


@REGISTRY.query("p3_rates")
def p3_rates(spark, sf_dir):
    return truncation.truncation_rates(_truncation(spark, sf_dir))


@REGISTRY.query(
    "p3_sources",
    """WITH t AS (SELECT DISTINCT 'pr_body' AS field, id AS row_id, intake AS source FROM review_requests UNION ALL SELECT DISTINCT 'content', reply_id, nullif(split_part(trim(provider), ' ', 1), '') FROM model_replies)
SELECT field, source, count(*) AS texts, true AS sums FROM t GROUP BY 1, 2""",
)
def p3_sources(spark, sf_dir):
    """Texts of each source in the rates, and whether the rate is that of the found texts counted one by one."""
    judged = cut_lineage(_truncation(spark, sf_dir))
    found = judged.where("truncated").select("field", "row_id", "source").distinct().groupBy("field", "source").agg(F.count(F.lit(1)).alias("found"))
    rates = truncation.truncation_rates(judged)
    same = (F.col("r.field") == F.col("f.field")) & F.col("r.source").eqNullSafe(F.col("f.source"))
    sums = (F.col("cut") == F.coalesce("found", F.lit(0))) & (F.abs(F.col("rate") * F.col("texts") - F.col("cut")) < 0.5)
    return rates.alias("r").join(found.alias("f"), same, "left").select("r.field", "r.source", "texts", sums.alias("sums"))


def _levels(spark, sf_dir):
    return reading.reading_levels(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "reading_samples"))


@REGISTRY.query("p9_found")
def p9_found(spark, sf_dir):
    return _levels(spark, sf_dir).where("band = 'demanding'").select("doc_id").distinct()


@REGISTRY.query("p9_languages", "SELECT lang, count(*) AS documents, count(*) FILTER (WHERE text IS NULL OR NOT regexp_matches(text, '\\p{L}')) AS without, true AS in_band FROM documents GROUP BY 1".replace("\\\\", "\\"))
def p9_languages(spark, sf_dir):
    """Documents per language as written, those without a letter that have no score, and whether all other scores lie in their band."""
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    levels = _levels(spark, sf_dir).join(scan(spark, sf_dir, "documents").select("doc_id", "lang", lettered.alias("lettered")), "doc_id")
    order = F.when(F.col("band") == "basic", 0).when(F.col("band") == "standard", 1).when(F.col("band") == "demanding", 2)
    spans = levels.groupBy("lang", order.alias("o")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("lettered") & F.col("score").isNull()).alias("without"), F.min("score").alias("low"), F.max("score").alias("high"))
    each = spans.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("o", "low", "high", "n", "without"))).alias("b"))  # three bands and none
    ranked = F.filter("b", lambda x: x["o"].isNotNull())
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ranked) - 1)), lambda i: F.coalesce(F.get(ranked, i - 1)["high"] < F.get(ranked, i)["low"], F.lit(True)))
    total = lambda field: F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x[field])
    return each.select("lang", total("n").alias("documents"), total("without").alias("without"), rising.alias("in_band"))


@REGISTRY.query("p9_profile")
def p9_profile(spark, sf_dir):
    """Documents and mean score per language as written and band."""
    levels = _levels(spark, sf_dir).join(scan(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return levels.groupBy("lang", "band").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("score"), 3).alias("mean_score"))
