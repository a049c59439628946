"""Unified diffs as nested rows, parsed by array expressions alone.

A diff never leaves its row: there is no explode, window or shuffle. Hunks come from
one split at line breaks before ``@@``; running line numbers are prefix counts in two
levels, of blocks of lines and inside them, so the work stays near linear in the
number of lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions import text as X

SEPARATOR = "diff --git "
PATH_PREFIX = "+++ b/"
#: Lines of one block of the prefix counts.
BLOCK = 64

#: Paths left out by default.
DEFAULT_EXCLUDES = ("*.lock", "*.min.js", "*.min.css", "*.generated.*", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum")
DEFAULT_MAX_FILES = 50


def _removed(line: Column) -> Column:
    return F.startswith(line, F.lit("-")) & ~F.startswith(line, F.lit("---"))


def _added(line: Column) -> Column:
    return F.startswith(line, F.lit("+")) & ~F.startswith(line, F.lit("+++"))


def _parsed_line(line: Column, number: Column) -> Column:
    kind = F.when(_added(line), "ADDED").when(_removed(line), "REMOVED").otherwise("CONTEXT")
    content = F.when(_added(line) | _removed(line), F.substr(line, F.lit(2))).otherwise(X.remove_prefix(line, " "))
    return F.struct(content.alias("content"), kind.alias("type"), F.when(_removed(line), F.lit(None)).otherwise(number).cast("int").alias("line_number"))


def _numbered(body: Column, start: Column) -> Column:
    """Lines of a hunk with their numbers; what a lambda reads is bound before it."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(body) - 1) / BLOCK).cast("int")), lambda b: F.slice(body, b * BLOCK + 1, BLOCK))
    counted = F.transform(blocks, lambda block, b: F.struct(block.alias("block"), b.alias("b"), F.size(F.filter(block, _removed)).alias("removed")))

    def based(all_blocks: Column) -> Column:
        before = lambda x: F.aggregate(F.slice(all_blocks, 1, x["b"]), F.lit(0), lambda a, y: a + y["removed"])
        return F.transform(all_blocks, lambda x: F.struct(x["block"].alias("block"), (start + x["b"] * BLOCK - before(x)).alias("base")))

    def one(x: Column) -> Column:
        return F.transform(x["block"], lambda line, i: _parsed_line(line, x["base"] + i - F.size(F.filter(F.slice(x["block"], 1, i), _removed))))

    return F.flatten(F.transform(X.let(counted, based), one))


def new_start(header: Column) -> Column:
    """Start of the new side in a hunk header, 1 where there is none."""
    return X.safe_int(F.regexp_extract(header, r"@@ -\d+(?:,\d+)? \+(\d+)", 1), 1)


def parse_hunks(block: Column) -> Column:
    """``array<struct<header, new_start_line, lines>>``; a header without a line after it gives no hunk.

    Lines before the first header don't count. A line that is only a sign repeated
    three times, or starts so, is context with its sign; so is every other line.
    """
    segments = F.slice(F.split(F.concat(F.lit("\n"), block), rf"(?:{X.LINE_BREAK})(?=@@)", -1), 2, 2**31 - 2)
    parts = F.filter(F.transform(segments, lambda s: X.lines(s)), lambda p: F.size(p) > 1)

    def headed(p: Column) -> Column:
        header = F.element_at(p, 1)
        return F.struct(header.alias("header"), new_start(header).alias("start"), F.slice(p, 2, F.size(p)).alias("body"))

    def hunk(h: Column) -> Column:
        return F.struct(h["header"].alias("header"), h["start"].alias("new_start_line"), _numbered(h["body"], h["start"]).alias("lines"))

    return F.transform(F.transform(parts, headed), hunk)


def _count(hunks: Column, kind: str) -> Column:
    return F.aggregate(hunks, F.lit(0), lambda n, h: n + F.size(F.filter(h["lines"], lambda x: x["type"] == kind)))


def parse_diff(raw: Column, excludes: Sequence[str] | Column = DEFAULT_EXCLUDES, max_files: int | Column = DEFAULT_MAX_FILES) -> Column:
    """``array<struct<file_path, hunks, additions, deletions>>`` of a raw diff, in its order.

    Blocks without a new-side path (deleted, binary, renamed only) vanish, so do paths
    that a glob of ``excludes`` is found in; then the first ``max_files`` stay. A null
    diff gives null, an empty or blank one an empty array.
    """
    blocks = F.filter(F.split(raw, SEPARATOR, -1), lambda b: ~X.is_blank(b))
    with_path = F.transform(blocks, lambda b: F.struct(F.try_element_at(F.filter(X.lines(b), lambda x: F.startswith(x, F.lit(PATH_PREFIX))), F.lit(1)).alias("line"), b.alias("block")))
    files = F.filter(F.transform(with_path, lambda x: F.struct(F.substr(x["line"], F.lit(len(PATH_PREFIX) + 1)).alias("file_path"), x["block"].alias("block"))), lambda x: x["file_path"].isNotNull() & ~X.matches_any(x["file_path"], excludes))
    limit = max_files if isinstance(max_files, Column) else F.lit(max_files)

    def parsed(x: Column) -> Column:
        return F.struct(x["file_path"].alias("file_path"), parse_hunks(x["block"]).alias("hunks"))

    def counted(x: Column) -> Column:
        return F.struct(x["file_path"].alias("file_path"), x["hunks"].alias("hunks"), _count(x["hunks"], "ADDED").alias("additions"), _count(x["hunks"], "REMOVED").alias("deletions"))

    return F.transform(F.transform(F.slice(files, F.lit(1), limit), parsed), counted)


def diff_files(df: DataFrame, raw: str, keys: Sequence[str], **options) -> DataFrame:
    """One row per changed file: ``keys``, ``chunk`` from 1, ``chunks``, ``file_path``, ``hunks``, ``additions``, ``deletions``.

    Null, empty and blank diffs give no rows, nor does an empty table; equal rows give equal rows."""
    parsed = df.select(*keys, parse_diff(F.col(raw), **options).alias("files"))
    # the outer form: for the plain one Spark filters by the size of the array, and parses again to get it
    rows = parsed.select(*keys, F.size("files").alias("chunks"), F.posexplode_outer("files").alias("at", "file")).where("at IS NOT NULL")
    return rows.select(*keys, (F.col("at") + 1).alias("chunk"), "chunks", "file.*")


def diff_lines(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per line of ``files``: ``keys``, ``file_path``, ``hunk_no`` and ``line_no`` from 1, ``type``, ``line_number``, ``content``."""
    hunks = files.select(*keys, "file_path", F.posexplode_outer("hunks").alias("h", "hunk")).where("h IS NOT NULL")
    return hunks.select(*keys, "file_path", (F.col("h") + 1).alias("hunk_no"), F.posexplode("hunk.lines").alias("l", "line")).select(*keys, "file_path", "hunk_no", (F.col("l") + 1).alias("line_no"), "line.type", "line.line_number", "line.content")


def diff_context(hunks: Column) -> Column:
    """Hunks as text: the header, then each line after its sign; hunks joined by a line feed."""

    def line(x: Column) -> Column:
        return F.concat(F.when(x["type"] == "ADDED", "+").when(x["type"] == "REMOVED", "-").otherwise(" "), x["content"])

    return F.array_join(F.transform(hunks, lambda h: F.concat(h["header"], F.lit("\n"), F.array_join(F.transform(h["lines"], line), "\n"))), "\n")
