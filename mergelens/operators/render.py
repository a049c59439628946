"""Texts for people and for models, each one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergelens.functions import text as X

ISSUES_SHOWN = 10
#: Fixed value: the instructions every review starts from; the language goes in at the mark.
SYSTEM_PROMPT = """You are an expert code reviewer. Analyze the provided code diff and generate constructive review comments.

Response format: Return a JSON array of review comments. Each comment must have:
- "file": file path
- "line": line number in the diff (positive integer)
- "severity": one of "CRITICAL", "WARNING", "SUGGESTION", "PRAISE"
- "category": one of "bug", "security", "performance", "quality", "best-practice", "style"
- "title": short summary (1 line)
- "body": detailed explanation
- "suggestion": optional code suggestion

Guidelines:
- Focus on meaningful issues (bugs, security, performance)
- Be specific with line references
- Provide actionable suggestions
- Use <language> for review comments
- Return ONLY the JSON array, no markdown wrapping"""


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def system_prompt(language: Column, rules: Column | None = None) -> Column:
    """Korean for ``ko``, else English; a non-null ``rules`` adds a block. No line feed at the end."""
    head, tail = SYSTEM_PROMPT.split("<language>")
    base = _text(head, F.when(language == "ko", "Korean").otherwise("English"), tail)
    return base if rules is None else _text(base, F.coalesce(_text("\n\nAdditional rules:\n", rules), F.lit("")))


def _heading(title: Column, body: Column, shown: int) -> Column:
    described = F.when(X.is_blank(body), "").otherwise(_text("Description: ", F.left(body, F.lit(shown)), "\n"))
    return _text("## Pull Request\nTitle: ", title, "\n", described, "\n")


def user_prompt(title: Column, body: Column, files: Column, diff: Column) -> Column:
    """All files of a request in one prompt."""
    listed = F.array_join(F.transform(files, lambda f: _text("- ", f, "\n")), "")
    return _text(_heading(title, body, 500), "## Changed Files\n", listed, "\n## Diff\n```diff\n", diff, "\n```\n")


def chunk_prompt(title: Column, body: Column, path: Column, patch: Column, chunk: Column, chunks: Column) -> Column:
    """One file of a request."""
    return _text(_heading(title, body, 300), "## File (", chunk.cast("string"), "/", chunks.cast("string"), "): ", path, "\n\n```diff\n", patch, "\n```\n")


def _label(comment: Column) -> Column:
    return _text(X.severity_tag(comment["severity"]), " **[", F.upper(comment["category"]), "]** ")


def inline_comment(comment: Column) -> Column:
    """Body of a comment at a line; a suggestion gets a fence."""
    fence = F.coalesce(_text("\n```suggestion\n", comment["suggestion"], "\n```\n"), F.lit(""))
    return _text(_label(comment), comment["content"], "\n", fence)


def inline_comments(comments: Column) -> Column:
    """``array<struct<path, line, body, side>>`` of comments with a line above 0."""
    return F.transform(
        F.filter(comments, lambda c: c["line_number"] > 0),
        lambda c: F.struct(c["file_path"].alias("path"), c["line_number"].alias("line"), inline_comment(c).alias("body"), F.lit("RIGHT").alias("side")),
    )


def severity_count(comments: Column, value: str) -> Column:
    return F.size(F.filter(comments, lambda c: c["severity"] == value))


def summary(comments: Column) -> Column:
    """Totals, then the first ten issues in order. Praise counts as an issue but has no bucket."""
    n = lambda value: severity_count(comments, value).cast("string")
    totals = _text("Found **", F.size(comments).cast("string"), " issues** (", n("CRITICAL"), " Critical, ", n("WARNING"), " Warning, ", n("SUGGESTION"), " Suggestion)\n\n")
    shown = F.transform(F.slice(comments, 1, ISSUES_SHOWN), lambda c: _text(_label(c), "`", c["file_path"], ":", c["line_number"].cast("string"), "` - ", X.first_line(c["content"]), "\n"))
    issues = F.when(F.size(comments) > 0, _text("### Issues\n", F.array_join(shown, ""))).otherwise("")
    return _text("**AI Code Review**\n\n### Summary\n", totals, issues)


def review_post(comments: Column) -> Column:
    """JSON of the review to post: body, event and inline comments."""
    return F.to_json(F.struct(summary(comments).alias("body"), F.lit("COMMENT").alias("event"), inline_comments(comments).alias("comments")))
