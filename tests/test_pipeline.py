import json

import pytest
from pyspark.sql import functions as F

from mergelens.config import ModelOptions, Provider, ReviewOptions, from_environment
from mergelens.operators import pipeline
from mergelens.sources import models, sinks

BLOCK = "diff --git a/{0} b/{0}\n+++ b/{0}\n@@ -1 +1 @@\n+x\n"


def canned():
    """A client; made in here, its class goes to the workers whole."""

    class Canned:
        """Answers each file's prompt with a comment on it; says nothing about bad.kt."""

        name = "canned"

        def generate(self, system_prompts, user_prompts, max_tokens):
            out = []
            for p in user_prompts:
                path = p.split("): ")[1].split("\n")[0]
                text = json.dumps([{"file": path, "line": 1, "severity": "warning", "title": path}])
                out.append(None if path == "bad.kt" else {"content": text, "model": "m-" + path, "provider": "b (fallback from a)" if path == "b.kt" else "a", "input_tokens": 2, "output_tokens": 1, "total_tokens": 3})
            return out

    return Canned()


@pytest.fixture(scope="module")
def processed(spark):
    rows = [("1", "o/n", 1, "T", BLOCK.format("a.kt") + BLOCK.format("b.kt") + BLOCK.format("yarn.lock"), None, None, "REVIEWING"), ("2", "o/n", 2, "T", "", "ko", None, "REVIEWING"), ("3", "o/n", 3, "T", BLOCK.format("a.kt") + BLOCK.format("bad.kt"), None, None, "REVIEWING"), ("4", "o/n", 4, "T", None, None, None, "REVIEWING")]
    requests = spark.createDataFrame(rows, "id string, repository_full_name string, platform_pr_id int, title string, raw_diff string, language string, custom_prompt string, status string")
    prompts = pipeline.prompts(requests)
    return pipeline.results(requests, models.ask(prompts, canned(), ["id", "chunk"]))


def test_results(processed):
    got = {r.id: r for r in processed.collect()}
    assert {k: r.status for k, r in got.items()} == {"1": "COMPLETED", "2": "COMPLETED", "3": "FAILED", "4": "COMPLETED"}
    one = got["1"].review
    assert [c.file_path for c in one.comments] == ["a.kt", "b.kt"] and one.model == "m-b.kt" and one.fallback_used
    assert tuple(one.token_usage) == (4, 2) and "Found **2 issues**" in one.summary
    assert got["2"].review is None and got["3"].review is None and got["3"].comments == []


def test_post_and_observe(processed, spark, tmp_path):
    watched, seen = pipeline.observed(processed)
    sinks.post(watched, str(tmp_path / "posts"))
    posts = spark.read.json(str(tmp_path / "posts")).collect()
    assert len(posts) == 1 and json.loads(posts[0].body)["event"] == "COMMENT"
    rows = spark.read.json(str(tmp_path / "posts"), schema="repository_full_name string, platform_pr_id int, body string")
    assert rows.first().platform_pr_id == 1
    assert pipeline.observed(processed, "again")[0].count() == 4


def test_recorded(spark):
    prompts = spark.createDataFrame([("1", 1), ("1", 2)], "id string, chunk int")
    replies = spark.createDataFrame([("1", 1, "[]")], "id string, chunk int, content string")
    assert {r.chunk: r.content for r in models.recorded(prompts, replies, ["id", "chunk"]).collect()} == {1: "[]", 2: None}


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("MERGELENS_MAX_FILES", "7")
    monkeypatch.setenv("MERGELENS_EXCLUDE_PATTERNS", "*.x,*.y")
    assert from_environment(ReviewOptions) == ReviewOptions(max_files=7, exclude_patterns=("*.x", "*.y"))
    with pytest.raises(ValueError, match="enabled"):
        ModelOptions(providers=(Provider("a", "chat", "m", enabled=False),))
    table = ModelOptions(providers=(Provider("a", "chat", "m", max_tokens=5), Provider("b", "chat", "m"))).table(spark)
    assert {r.name: r.max_tokens for r in table.collect()} == {"a": 5, "b": 4096}


def test_empty(spark):
    requests = spark.createDataFrame([], "id string, title string, raw_diff string, language string, custom_prompt string, status string")
    assert pipeline.results(requests, models.ask(pipeline.prompts(requests), canned(), ["id", "chunk"])).count() == 0
    assert pipeline.prompts(requests).where(F.col("chunk") > 0).count() == 0
