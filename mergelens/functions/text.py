"""Scalar text functions; each is one expression of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|\n|\r"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: inside, it is a lambda variable.

    An expression that a lambda refers to is computed again for each element."""
    return F.transform(F.array(value), body)[0]


def lines(text: Column) -> Column:
    """Lines by CRLF, LF or CR; a trailing empty line is kept."""
    return F.split(text, LINE_BREAK, -1)


def first_line(text: Column) -> Column:
    return F.element_at(lines(text), 1)


def is_blank(text: Column) -> Column:
    """True for null and for nothing but (Unicode) white space."""
    return text.isNull() | text.rlike(r"^(?U)\s*$")


def remove_prefix(text: Column, prefix: str) -> Column:
    """``text`` without one ``prefix`` in front."""
    return F.when(F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def provider_name(provider: Column) -> Column:
    """The name before the first space, that is, before any fallback note."""
    return F.element_at(F.split(provider, " ", -1), 1)


def decorated(inner: Column, outer: Column) -> Column:
    """Name of a provider that answered for another."""
    return F.concat(inner, F.lit(" (fallback from "), outer, F.lit(")"))


def safe_int(text: Column, default: int) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("int"), F.lit(default))


def glob_regex(pattern: str) -> str:
    """The unanchored search a glob stands for: dots are plain, stars match anything, the rest stays live."""
    return pattern.replace(".", r"\.").replace("*", ".*")


def matches_any(path: Column, patterns: Sequence[str] | Column) -> Column:
    """Whether any glob is found in ``path``.

    Constant patterns are folded into one regular expression at plan time; a column of
    patterns is searched pattern by pattern. No patterns, or null ones, match nothing.
    """
    if isinstance(patterns, Column):
        found = F.exists(patterns, lambda p: F.coalesce(F.rlike(path, F.replace(F.replace(p, F.lit("."), F.lit(r"\.")), F.lit("*"), F.lit(".*"))), F.lit(False)))
        return F.coalesce(found, F.lit(False))
    if not patterns:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


#: Severities that stay as they are; any other becomes a suggestion.
SEVERITIES = ("CRITICAL", "WARNING", "SUGGESTION", "PRAISE")


def severity(text: Column) -> Column:
    upper = F.upper(text)
    return F.when(upper.isin(*SEVERITIES), upper).otherwise("SUGGESTION")


def severity_tag(value: Column) -> Column:
    return F.when(value.isin("CRITICAL", "WARNING", "PRAISE"), F.concat(F.lit("["), value, F.lit("]"))).otherwise("[SUGGESTION]")


def instant(text: Column) -> Column:
    """An ISO 8601 instant, with ``Z`` or an offset; null if it is none."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), text.try_cast("timestamp"))


def expired(expires: Column, now: Column, margin_seconds: int = 60) -> Column:
    """Whether an instant is past, or will be within the margin; a null one is."""
    return F.coalesce(expires <= now + F.expr(f"INTERVAL {margin_seconds} SECONDS"), F.lit(True))
