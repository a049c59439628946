"""Free-form model text as typed comments: all of a reply's comments, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions import text as X

_FENCED = r"(?s)```(?:json)?\s*\n?(\[.*?\])\s*```"
_ARRAY = r"(?s)(\[.*\])"
#: Fields of a comment and what stands for an absent one.
DEFAULTS = {"file": "", "line": "0", "severity": "SUGGESTION", "category": "quality", "title": "", "body": "", "suggestion": None}
#: Strict JSON: a reply in another dialect has no comments.
_STRICT = {"allowSingleQuotes": "false", "allowComments": "false", "mode": "PERMISSIVE"}


def json_array(content: Column) -> Column:
    """The fenced array, else from the first bracket to the last, else null."""
    fenced, bare = F.regexp_extract(content, _FENCED, 1), F.regexp_extract(content, _ARRAY, 1)
    return X.let(fenced, lambda f: F.when(f != "", f).otherwise(F.nullif(bare, F.lit(""))))


def _line(field: Column) -> Column:
    """An int, as text or cut off from a number; null if it is neither."""
    return F.when(field == "", F.lit(0)).otherwise(F.when(F.abs(field.try_cast("double")) < 2.0**31, field.try_cast("double").cast("int")))


def _field(element: Column, name: str) -> Column:
    return F.when(F.map_contains_key(element, F.lit(name)), F.element_at(element, F.lit(name))).otherwise(F.lit(DEFAULTS[name]))


def comments(content: Column) -> Column:
    """``array<struct<file_path, line_number, category, severity, content, suggestion>>``.

    Everything between the brackets must be one strict JSON array of objects. Any
    element that isn't an object, any field but ``suggestion`` that is explicitly
    null, and any line that isn't a number empties the whole list, as does text
    without an array; null and empty texts give an empty list.
    """
    # inside another array, anything behind the first array shows as a second element or an error
    outer = F.from_json(F.concat(F.lit("["), json_array(content), F.lit("]")), "array<array<map<string,string>>>", _STRICT)
    required = [k for k in DEFAULTS if k != "suggestion"]

    def sound(e: Column) -> Column:
        ok = e.isNotNull()
        for k in required:
            ok = ok & _field(e, k).isNotNull()
        return F.coalesce(ok & _line(_field(e, "line")).isNotNull(), F.lit(False))

    def typed(e: Column) -> Column:
        return F.struct(
            _field(e, "file").alias("file_path"),
            _line(_field(e, "line")).alias("line_number"),
            F.lower(_field(e, "category")).alias("category"),
            X.severity(_field(e, "severity")).alias("severity"),
            F.concat(_field(e, "title"), F.lit("\n\n"), _field(e, "body")).alias("content"),
            _field(e, "suggestion").alias("suggestion"),
        )

    none = F.array().cast("array<map<string,string>>")
    only = lambda o: F.when(F.size(o) == 1, F.element_at(o, 1))
    sure = lambda e: F.when(F.forall(e, sound), e)
    return F.transform(F.coalesce(X.let(X.let(outer, only), sure), none), typed)


def with_comments(df: DataFrame, content: str = "content", into: str = "comments") -> DataFrame:
    return df.withColumn(into, comments(F.col(content)))


def explode_comments(df: DataFrame, keys: list[str], column: str = "comments") -> DataFrame:
    """One row per comment: ``keys``, ``comment_no`` from 1 and the comment's fields."""
    # the outer form: for the plain one Spark filters by the size of the array, and parses again to get it
    rows = df.select(*keys, F.posexplode_outer(column).alias("at", "comment")).where("at IS NOT NULL")
    return rows.select(*keys, (F.col("at") + 1).alias("comment_no"), "comment.*")
