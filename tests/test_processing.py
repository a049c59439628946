import json
import time

import pytest
from pyspark.sql import functions as F

from mergelens.errors import EngineError, NotFound, report
from mergelens.functions import signature
from mergelens.functions import text as X
from mergelens.operators import health, ingest, pipeline
from mergelens.sources import landed, queue
from mergelens.sources.tables import parse_status
from mergelens.streaming import documents, worker

BLOCK = "diff --git a/{0} b/{0}\n+++ b/{0}\n@@ -1 +1 @@\n+x\n"
REVIEWS = "array<struct<provider:string,summary:string,latency_ms:bigint>>"
PROVIDERS = [("a", True, "b"), ("b", True, "c"), ("c", False, None), ("loop", True, "loop")]


def comment(path):
    return json.dumps([{"file": path, "line": 1, "severity": "warning", "title": path}])


@pytest.fixture(scope="module")
def tables(spark):
    two = BLOCK.format("x.kt") + BLOCK.format("y.kt")
    rows = [("1", two, None, []), ("2", two, "auto", [("a", "old", 1)]), ("3", two, "b", None), ("4", two, "c", []), ("5", two, "nobody", []), ("6", "", "a", [("a", "old", 1)]), ("7", two, "loop", []), (None, two, "a", [])]
    requests = spark.createDataFrame(rows, f"id string, raw_diff string, model_preference string, reviews {REVIEWS}").withColumns({"title": F.lit("T"), "language": F.lit(None).cast("string"), "custom_prompt": F.lit(None).cast("string"), "status": F.lit("REVIEWING")})
    calls = []
    for i in "123457":
        calls += [(i, 1, "a", comment("x.kt"), "m-a", 2, 1, 10), (i, 2, "a", None, "m-a", None, None, 20), (i, 2, "b", comment("y.kt"), "m-b", 3, None, 30), (i, 2, "b", comment("y.kt"), "m-b", 3, None, 30)]
    calls += [("3", 1, "b", "[]", None, 1, 1, 5), ("4", 1, "c", "[]", "m", 1, 1, 5)]
    calls = spark.createDataFrame(calls, "id string, chunk int, name string, content string, model string, input_tokens int, output_tokens int, latency_ms int")
    providers = spark.createDataFrame(PROVIDERS, "name string, enabled boolean, fallback_to string")
    return requests, calls, providers


def test_whole_processing(tables):
    requests, calls, providers = tables
    got = {r.id: r for r in pipeline.reviewed(requests, calls, providers, "a").collect()}
    assert {k: r.status for k, r in got.items()} == {"1": "COMPLETED", "2": "COMPLETED", "3": "COMPLETED", "4": "FAILED", "5": "FAILED", "6": "COMPLETED", "7": "FAILED"}
    one = got["1"].review
    assert (one.provider, one.model, one.latency_ms, one.fallback_used, tuple(one.token_usage)) == ("b (fallback from a)", "m-b", 60, True, (5, 1))
    assert [c.file_path for c in one.comments] == ["x.kt", "y.kt"]
    assert [(r.provider, r.latency_ms) for r in got["2"].reviews] == [("a", 1), ("b (fallback from a)", 60)]
    assert [r.latency_ms for r in got["3"].reviews] == [35] and not got["3"].review.fallback_used
    assert got["4"].reviews == [] and got["4"].comments == [] and len(got["6"].reviews) == 1 and got["6"].review is None


def test_no_calls_and_no_requests(tables):
    requests, calls, providers = tables
    assert {r.status for r in pipeline.reviewed(requests.where("id = '1'"), calls.limit(0), providers, "a").collect()} == {"FAILED"}
    assert pipeline.reviewed(requests.limit(0), calls, providers, "a").count() == 0


def test_chains_end_at_repeats_and_long_ones_are_followed(spark):
    chain = spark.createDataFrame([(f"m{i}", True, f"m{i + 1}") for i in range(30)], "name string, enabled boolean, fallback_to string")
    outcomes = spark.createDataFrame([("r", f"m{i}", i == 28) for i in range(30)], "request_id string, name string, ok boolean")
    row = health.resolve_fallback(spark.createDataFrame([("r", "m0")], "request_id string, start string"), chain, outcomes).first()
    assert row.answered_by == "m28" and row.provider.count("fallback") == 28
    loop = spark.createDataFrame(PROVIDERS, "name string, enabled boolean, fallback_to string")
    assert [r.name for r in health.fallback_chains(spark, loop).where("start = 'loop'").collect()] == ["loop"]
    assert sorted(r.name for r in health.available(loop).collect()) == ["a", "b", "loop"]


def test_worker_acknowledges_what_succeeded(spark, tables, tmp_path):
    requests, calls, providers = tables
    messages = [{"reviewRequestId": i} for i in ("1", "1", "4", "unknown")] + [{"pullRequestNumber": "3"}]
    queue.append(spark.createDataFrame([(m,) for m in messages], "message map<string,string>").repartition(3), str(tmp_path / "queue"))
    process = lambda ids: pipeline.reviewed(requests.join(ids, requests["id"] == ids["review_request_id"], "left_semi"), calls, providers, "a")
    worker.run(spark, str(tmp_path / "queue"), process, str(tmp_path / "out"), str(tmp_path / "state"))
    read = lambda kind: sorted(str(r.message.get("reviewRequestId")) for r in spark.read.schema("message map<string,string>").json(str(tmp_path / "out" / kind / "*")).collect())
    assert read("acknowledged") == ["1", "1"] and read("pending") == ["4", "unknown"] and read("dead") == ["None"]
    worker.retry(spark, str(tmp_path / "out"), str(tmp_path / "queue"))
    again = lambda ids: process(ids).withColumn("status", F.lit("COMPLETED"))
    worker.run(spark, str(tmp_path / "queue"), again, str(tmp_path / "out"), str(tmp_path / "state"))
    assert read("acknowledged") == ["1", "1", "4"]


def test_landed_files(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, None), (None, "x"), (4, '[{"filename": "a", "additions": 2, "other": 1}, {"filename": "b", "patch": "p\\nq"}]'), (5, "no list")], "id bigint, text string")
    landed.land(texts, "id", "text", str(tmp_path / "t"))
    back = landed.read_texts(spark, str(tmp_path / "t"), "id", "bigint")
    assert {r.id: r.text for r in back.collect()} == {r.id: r.text for r in texts.collect() if r.id and r.text is not None}
    files = landed.changed_files(back, "id").orderBy("id", "file_no").collect()
    assert [(r.id, r.file_no, r.file_path, r.additions, r.patch) for r in files] == [(4, 1, "a", 2, None), (4, 2, "b", None, "p\nq")]


def test_streaming_upsert_and_progress(spark, tmp_path):
    spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string").write.parquet(str(tmp_path / "base"))
    for rows in ([("2", "B"), ("3", "c")], [("2", "BB")]):
        spark.createDataFrame(rows, "id string, v string").coalesce(1).write.mode("append").json(str(tmp_path / "landed"))
    seen = []
    listener = documents.Progress(seen.append)
    spark.streams.addListener(listener)
    stream = spark.readStream.schema("id string, v string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "landed"))
    documents.upsert_stream(stream, str(tmp_path / "base"), str(tmp_path / "v"), str(tmp_path / "s"))
    assert sorted(tuple(r) for r in documents.current(spark, str(tmp_path / "v")).select("id", "v").collect()) == [("1", "a"), ("2", "BB"), ("3", "c")]
    for _ in range(50):
        if sum(p["rows"] for p in seen) >= 3:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(p["rows"] for p in seen) == 3


def test_secrets(spark):
    with pytest.raises(ValueError, match="secret"):
        ingest.drop_reason(" ", F.lit(True), F.lit(True))
    df = spark.createDataFrame([("body",), (None,)], "b string").select(signature.hmac_sha256(F.col("b"), "s3cr3t-value").alias("h"))
    plan = df._jdf.queryExecution().toString()
    assert "s3cr3t" not in plan and bytes(b ^ 0x36 for b in b"s3cr3t-value").hex() not in plan.lower()
    assert [r.h is None for r in df.collect()] == [False, True]


def test_instants(spark):
    df = spark.createDataFrame([("2024-05-06T07:08:09Z",), ("2024-05-06T09:08:09.5+02:00",), ("yesterday",), (None,)], "t string")
    got = [r.t for r in df.select(F.unix_millis(X.instant(F.col("t"))).alias("t")).collect()]
    assert got == [1714979289000, 1714979289500, None, None]
    now = F.lit("2024-05-06 07:07:30").cast("timestamp")
    assert [r.e for r in df.select(X.expired(X.instant(F.col("t")), now).alias("e")).collect()] == [True, True, True, True]
    assert df.select(X.expired(X.instant(F.col("t")), now, 10).alias("e")).first().e is False


def test_errors_are_reported_by_class():
    with pytest.raises(ValueError) as e:
        parse_status("lost")
    assert report(e.value)["status"] == 400 and "lost" in report(e.value)["message"]
    assert report(NotFound("no such request", "R1")) == {"status": 404, "error": "Not Found", "message": "no such request", "code": "R1"}
    assert report(KeyError("secret detail")) == report(EngineError("An unexpected error occurred"))
