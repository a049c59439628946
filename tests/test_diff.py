import random

import pytest
from pyspark.sql import functions as F

from mergelens.operators import diff
from mergelens.plans import diffs

ONE = """diff --git a/src/A.kt b/src/A.kt
index 1..2 100644
--- a/src/A.kt
+++ b/src/A.kt
@@ -1,3 +10,4 @@ class A
 context
-old
+new
+more"""


def parse(spark, text, **options):
    rows = spark.createDataFrame([(text,)], "raw string").select(diff.parse_diff(F.col("raw"), **options).alias("f")).first().f
    return None if rows is None else [r.asDict(recursive=True) for r in rows]


def test_one_file(spark):
    (f,) = parse(spark, ONE)
    assert (f["file_path"], f["additions"], f["deletions"]) == ("src/A.kt", 2, 1)
    (h,) = f["hunks"]
    assert h["header"] == "@@ -1,3 +10,4 @@ class A" and h["new_start_line"] == 10
    assert [(x["type"], x["line_number"], x["content"]) for x in h["lines"]] == [("CONTEXT", 10, "context"), ("REMOVED", None, "old"), ("ADDED", 11, "new"), ("ADDED", 12, "more")]


def test_trailing_line_feed_makes_an_empty_context_line(spark):
    (f,) = parse(spark, ONE + "\n")
    assert f["hunks"][0]["lines"][-1] == {"content": "", "type": "CONTEXT", "line_number": 13}


def test_signs_that_look_like_headers_are_context(spark):
    (f,) = parse(spark, ONE + "\n++++ b\n---- c\n\\ No newline at end of file")
    assert [(x["type"], x["content"]) for x in f["hunks"][0]["lines"][4:]] == [("CONTEXT", "++++ b"), ("CONTEXT", "---- c"), ("CONTEXT", "\\ No newline at end of file")]


def test_many_files_limit_and_excludes(spark):
    raw = "\n".join(ONE.replace("src/A.kt", p) for p in ("a.kt", "yarn.lock", "b.min.js", "c.kt", "x.lockfile", "d.kt"))
    assert [f["file_path"] for f in parse(spark, raw)] == ["a.kt", "c.kt", "d.kt"]
    assert [f["file_path"] for f in parse(spark, raw, max_files=2)] == ["a.kt", "c.kt"]
    assert len(parse(spark, raw, excludes=())) == 6
    assert [f["file_path"] for f in parse(spark, raw, excludes=F.array(F.lit("*.kt")), max_files=F.lit(9))] == ["yarn.lock", "b.min.js", "x.lockfile"]


@pytest.mark.parametrize(
    "raw",
    [
        "diff --git a/x.png b/x.png\nBinary files differ\n",
        "diff --git a/x b/y\nsimilarity index 100%\nrename from x\nrename to y\n",
        "diff --git a/x b/x\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n",
        "",
        "   \n",
    ],
)
def test_nothing_to_parse(spark, raw):
    assert parse(spark, raw) == []


def test_null_and_rows(spark):
    assert parse(spark, None) is None
    df = spark.createDataFrame([(1, ONE, "x"), (1, ONE, "x"), (2, None, "y"), (None, ONE, None)], "k int, raw string, files string")
    rows = diff.diff_files(df, "raw", ["k"])
    assert rows.count() == 3 and diff.diff_files(df.limit(0), "raw", ["k"]).count() == 0
    assert diff.diff_lines(rows, ["k"]).count() == 12


def test_header_without_lines_gives_no_hunk_and_bad_headers_start_at_one(spark):
    (f,) = parse(spark, "diff --git a/x b/x\r\n+++ b/x\r\n@@ -1 +5 @@\r\n@@ odd @@\r\n+a\r\n-b")
    assert [(h["new_start_line"], len(h["lines"])) for h in f["hunks"]] == [(1, 2)]


def reference_numbers(lines, start):
    out, at = [], start
    for line in lines:
        removed = line.startswith("-") and not line.startswith("---")
        out.append(None if removed else at)
        at += not removed
    return out


def test_numbers_of_long_hunks(spark):
    rng = random.Random(2)
    body = [rng.choice("+- ") + "x" for _ in range(1000)]
    (f,) = parse(spark, "diff --git a/x b/x\n+++ b/x\n@@ -1 +7 @@\n" + "\n".join(body))
    assert [x["line_number"] for x in f["hunks"][0]["lines"]] == reference_numbers(body, 7)


def test_rendering_gives_the_hunks_back(spark):
    text = spark.createDataFrame([(ONE,)], "raw string").select(diff.diff_context(diff.parse_diff(F.col("raw"))[0]["hunks"]).alias("t")).first().t
    assert text == ONE[ONE.index("@@") :]


def test_plan_has_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, ONE)], "k int, raw string")
    plan = diff.diff_lines(diff.diff_files(df, "raw", ["k"]), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_default_chunks_keep_all_files_up_to_the_default_limit(spark, tmp_path):
    few, many = ("\n".join(ONE.replace("src/A.kt", f"{i}.kt") for i in range(n)) for n in (7, diff.DEFAULT_MAX_FILES + 3))
    spark.createDataFrame([(1, few), (2, many)], "prompt_id bigint, diff_content string").write.parquet(str(tmp_path / "review_prompts.parquet"))
    got = sorted((r.prompt_id, r.chunk, r.chunks, r.file_path) for r in diffs.REGISTRY.queries["diff_chunks_default"](spark, str(tmp_path)).collect())
    assert got == [(p, i + 1, n, f"{i}.kt") for p, n in ((1, 7), (2, diff.DEFAULT_MAX_FILES)) for i in range(n)]
