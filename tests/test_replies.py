import json

import pytest
from pyspark.sql import functions as F

from mergelens.operators import replies

FULL = {"file": "a.kt", "line": 3, "severity": "critical", "category": "BUG", "title": "T", "body": "B", "suggestion": "S", "confidence": 0.9}
WANT = ("a.kt", 3, "bug", "CRITICAL", "T\n\nB", "S")
DEFAULT = ("", 0, "quality", "SUGGESTION", "\n\n", None)
CASES = {
    "bare": (json.dumps([FULL]), [WANT]),
    "fenced": ("```json\n" + json.dumps([FULL, {}]) + "\n```", [WANT, DEFAULT]),
    "fenced without a tag": ("```\n[{}]\n```", [DEFAULT]),
    "in prose": ("Here: " + json.dumps([FULL]) + " done", [WANT]),
    "lifted out of an object": ('{"comments": ' + json.dumps([FULL]) + "}", [WANT]),
    "line as text": ('[{"line": "10"}]', [("", 10, *DEFAULT[2:])]),
    "line as fraction": ('[{"line": 10.7}]', [("", 10, *DEFAULT[2:])]),
    "line as empty text": ('[{"line": ""}]', [DEFAULT]),
    "info": ('[{"severity": "INFO"}]', [DEFAULT]),
    "unknown severity": ('[{"severity": "BLOCKER"}]', [DEFAULT]),
    "praise": ('[{"severity": "Praise"}]', [("", 0, "quality", "PRAISE", "\n\n", None)]),
    "null suggestion": ('[{"suggestion": null}]', [DEFAULT]),
    "bad line": ('[{"line": "x"}, {}]', []),
    "null line": ('[{}, {"line": null}]', []),
    "null text": ('[{"title": null}]', []),
    "scalars": ("[1, 2]", []),
    "a scalar among objects": ("[{}, 1]", []),
    "two arrays": ("[{}] and [{}]", []),
    "two arrays with a comma": ("[{}], [{}]", []),
    "single quotes": ("[{'file': 'a'}]", []),
    "missing comma": ('[{"file": "a" "line": 1}]', []),
    "cut off": ('[{"file": "a"}, {"fi', []),
    "an object": ('{"file": "a"}', []),
    "no json": ("Looks good", []),
    "empty list": ("[]", []),
    "empty": ("", []),
    "blank": (" \n", []),
    "null": (None, []),
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, c) for k, (c, _) in CASES.items()], "k string, content string")
    return {r.k: [tuple(c) for c in r.comments] for r in replies.with_comments(df).collect()}


@pytest.mark.parametrize("case", CASES)
def test_replies(parsed, case):
    assert parsed[case] == CASES[case][1]


def test_rows(spark):
    df = spark.createDataFrame([(1, "[{}, {}]"), (1, "[{}, {}]"), (2, None)], "k int, content string").withColumn("comments", F.lit(1)).withColumn("at", F.lit(1))
    out = replies.explode_comments(replies.with_comments(df), ["k"])
    assert sorted((r.k, r.comment_no) for r in out.collect()) == [(1, 1), (1, 1), (1, 2), (1, 2)]
    assert replies.with_comments(df.limit(0)).count() == 0
