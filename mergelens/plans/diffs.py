"""Queries over raw diffs of review prompts, and prompts made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergelens.operators import diff, render, store
from mergelens.plans.registry import Registry
from mergelens.sources.tables import scan

REGISTRY = Registry()

_EXCLUDED = "regexp_matches(file_path, '" + "|".join(f"(?:{p.replace('.', chr(92) + '.').replace('*', '.*')})" for p in diff.DEFAULT_EXCLUDES) + "')"
#: Lines of raw diffs by splits, unnests and windows.
LINES = r"""blocks AS (
  SELECT prompt_id, b, arr[b] AS block FROM (SELECT prompt_id, arr, CAST(unnest(range(1, len(arr) + 1)) AS INTEGER) AS b FROM (SELECT prompt_id, string_split(diff_content, 'diff --git ') AS arr FROM review_prompts)) WHERE trim(arr[b]) <> ''
), raw AS (
  SELECT prompt_id, b, pos, ls[pos] AS line FROM (SELECT prompt_id, b, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT prompt_id, b, regexp_split_to_array(block, '\r\n|\n|\r') AS ls FROM blocks))
), paths AS (
  SELECT prompt_id, b, substr(min_by(line, pos), 7) AS file_path FROM raw WHERE starts_with(line, '+++ b/') GROUP BY 1, 2
), seg AS (
  SELECT *, sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END) OVER (PARTITION BY prompt_id, b ORDER BY pos) AS h FROM raw
), typed AS (
  SELECT *, first_value(line) OVER (PARTITION BY prompt_id, b, h ORDER BY pos) AS header,
    CASE WHEN starts_with(line, '+') AND NOT starts_with(line, '+++') THEN 'ADDED' WHEN starts_with(line, '-') AND NOT starts_with(line, '---') THEN 'REMOVED' ELSE 'CONTEXT' END AS type
  FROM seg WHERE h > 0
), numbered AS (
  SELECT prompt_id, b, file_path, CAST(dense_rank() OVER (PARTITION BY prompt_id, b ORDER BY h) AS INTEGER) AS hunk_no, CAST(row_number() OVER (PARTITION BY prompt_id, b, h ORDER BY pos) AS INTEGER) AS line_no, type, header,
    CASE WHEN type <> 'REMOVED' THEN CAST(coalesce(try_cast(regexp_extract(header, '@@ -\d+(?:,\d+)? \+(\d+)', 1) AS INTEGER), 1) + sum(CASE WHEN type <> 'REMOVED' THEN 1 ELSE 0 END) OVER (PARTITION BY prompt_id, b, h ORDER BY pos) - 1 AS INTEGER) END AS line_number,
    CASE WHEN type <> 'CONTEXT' OR starts_with(line, ' ') THEN substr(line, 2) ELSE line END AS content
  FROM typed JOIN paths USING (prompt_id, b) WHERE NOT starts_with(line, '@@')
)"""


def _files(spark, sf_dir, **options):
    return diff.diff_files(scan(spark, sf_dir, "review_prompts"), "diff_content", ["prompt_id"], **options)


@REGISTRY.query("diff_lines", f"WITH {LINES} SELECT prompt_id, file_path, hunk_no, line_no, type, line_number, content FROM numbered")
def diff_lines(spark, sf_dir):
    return diff.diff_lines(_files(spark, sf_dir, excludes=(), max_files=2**31 - 1), ["prompt_id"])


@REGISTRY.query(
    "diff_file_stats",
    f"""WITH {LINES}, n AS (SELECT prompt_id, b, max(hunk_no) AS hunks, count(*) FILTER (WHERE type = 'ADDED') AS a, count(*) FILTER (WHERE type = 'REMOVED') AS d FROM numbered GROUP BY 1, 2)
SELECT prompt_id, file_path, coalesce(hunks, 0) AS hunks, CAST(coalesce(a, 0) AS INTEGER) AS additions, CAST(coalesce(d, 0) AS INTEGER) AS deletions FROM paths LEFT JOIN n USING (prompt_id, b)""",
)
def diff_file_stats(spark, sf_dir):
    return _files(spark, sf_dir, excludes=(), max_files=2**31 - 1).select("prompt_id", "file_path", F.size("hunks").alias("hunks"), "additions", "deletions")


@REGISTRY.query("diff_excluded", f"WITH {LINES} SELECT prompt_id, file_path FROM paths WHERE NOT {_EXCLUDED}")
def diff_excluded(spark, sf_dir):
    return _files(spark, sf_dir, max_files=2**31 - 1).select("prompt_id", "file_path")


@REGISTRY.query(
    "diff_chunks",
    f"""WITH {LINES}, kept AS (SELECT prompt_id, file_path, row_number() OVER (PARTITION BY prompt_id ORDER BY b) AS chunk FROM paths WHERE NOT {_EXCLUDED} QUALIFY chunk <= 2)
SELECT prompt_id, file_path, CAST(chunk AS INTEGER) AS chunk, CAST(count(*) OVER (PARTITION BY prompt_id) AS INTEGER) AS chunks FROM kept""",
)
def diff_chunks(spark, sf_dir):
    """With two files at most, to show the limit at work."""
    return _files(spark, sf_dir, max_files=2).select("prompt_id", "file_path", "chunk", "chunks")


@REGISTRY.query(
    "diff_chunks_default",
    f"""WITH {LINES}, kept AS (SELECT prompt_id, file_path, row_number() OVER (PARTITION BY prompt_id ORDER BY b) AS chunk FROM paths WHERE NOT {_EXCLUDED} QUALIFY chunk <= {diff.DEFAULT_MAX_FILES})
SELECT prompt_id, file_path, CAST(chunk AS INTEGER) AS chunk, CAST(count(*) OVER (PARTITION BY prompt_id) AS INTEGER) AS chunks FROM kept""",
)
def diff_chunks_default(spark, sf_dir):
    """With as many files as the default settings allow."""
    return _files(spark, sf_dir, max_files=diff.DEFAULT_MAX_FILES).select("prompt_id", "file_path", "chunk", "chunks")


@REGISTRY.query(
    "diff_excluded_by_settings",
    r"""WITH p AS (SELECT full_name, settings.exclude_patterns AS patterns FROM repositories), r AS (SELECT DISTINCT id, repository_full_name FROM review_requests)
SELECT diff_id, file_path FROM file_diffs JOIN r ON r.id = review_request_id JOIN p ON p.full_name = repository_full_name
WHERE coalesce(len(list_filter(patterns, lambda x: regexp_matches(file_path, replace(replace(x, '.', '\.'), '*', '.*')))), 0) > 0""",
)
def diff_excluded_by_settings(spark, sf_dir):
    """Files hit by their own repository's patterns."""
    r = store.latest(scan(spark, sf_dir, "review_requests").select("id", "repository_full_name"), [])
    p = scan(spark, sf_dir, "repositories").select("full_name", F.col("settings.exclude_patterns").alias("patterns"))
    files = scan(spark, sf_dir, "file_diffs").select("diff_id", "review_request_id", "file_path")
    joined = files.join(r, F.col("review_request_id") == F.col("id")).join(p, F.col("repository_full_name") == F.col("full_name"))
    return joined.where(diff.X.matches_any(F.col("file_path"), F.col("patterns"))).select("diff_id", "file_path")


@REGISTRY.query(
    "diff_context_roundtrip",
    f"""WITH {LINES}, h AS (SELECT prompt_id, b, hunk_no, any_value(header) || chr(10) || string_agg(CASE type WHEN 'ADDED' THEN '+' WHEN 'REMOVED' THEN '-' ELSE ' ' END || content, chr(10) ORDER BY line_no) AS t FROM numbered GROUP BY 1, 2, 3)
SELECT prompt_id, file_path, md5(coalesce(string_agg(t, chr(10) ORDER BY hunk_no), '')) AS digest FROM paths LEFT JOIN h USING (prompt_id, b) GROUP BY prompt_id, b, file_path""",
)
def diff_context_roundtrip(spark, sf_dir):
    return _files(spark, sf_dir, excludes=(), max_files=2**31 - 1).select("prompt_id", "file_path", F.md5(diff.diff_context(F.col("hunks"))).alias("digest"))


@REGISTRY.query(
    "prompt_text",
    """WITH r AS (SELECT DISTINCT id, title, pr_body FROM review_requests)
SELECT diff_id, md5('## Pull Request' || chr(10) || 'Title: ' || title || chr(10)
  || CASE WHEN pr_body IS NULL OR regexp_matches(pr_body, '^[\\s\\x{00A0}]*$') THEN '' ELSE 'Description: ' || substr(pr_body, 1, 300) || chr(10) END || chr(10)
  || '## File (1/2): ' || file_path || chr(10) || chr(10) || '```diff' || chr(10) || patch || chr(10) || '```' || chr(10)) AS digest
FROM file_diffs JOIN r ON r.id = review_request_id WHERE patch IS NOT NULL""".replace("\\\\", "\\"),
)
def prompt_text(spark, sf_dir):
    r = store.latest(scan(spark, sf_dir, "review_requests").select("id", "title", "pr_body"), [])
    files = scan(spark, sf_dir, "file_diffs").where("patch IS NOT NULL").select("diff_id", "review_request_id", "file_path", "patch")
    text = render.chunk_prompt(F.col("title"), F.col("pr_body"), F.col("file_path"), F.col("patch"), F.lit(1), F.lit(2))
    return files.join(r, F.col("review_request_id") == F.col("id")).select("diff_id", F.md5(text).alias("digest"))
