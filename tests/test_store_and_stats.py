import datetime

import pytest
from pyspark.sql import functions as F

from mergelens.operators import stats, store
from mergelens.sources import queue, tables

T = datetime.datetime(2025, 1, 1)
REVIEW = "array<struct<provider:string,model:string,latency_ms:bigint,input_tokens:int,output_tokens:int,comments:array<struct<category:string,severity:string>>>>"


@pytest.fixture(scope="module")
def nested(spark):
    c = lambda *x: [(k, s) for k, s in x]
    rows = [
        ("1", "COMPLETED", [("a (fallback from b)", "m", 100, 1, 2, c(("bug", "CRITICAL"), ("Bug", "PRAISE"))), ("a", "m2", None, None, 3, c())]),
        ("2", "COMPLETED", []),
        ("3", "FAILED", [("z", "m", 900, 1, 1, c(("style", "WARNING")))]),
        ("4", "PENDING", []),
        ("5", "COMPLETED", [(None, None, 300, 1, 1, c(("bug", "SUGGESTION")))]),
    ]
    return spark.createDataFrame(rows, f"id string, status string, reviews {REVIEW}")


def test_statistics(nested):
    r = stats.statistics(nested).first()
    assert (r.total_reviews, r.completed_reviews, r.failed_reviews, r.avg_latency_ms) == (5, 3, 1, 200.0)
    assert r.reviews_by_provider == {"a": 2} and r.issues_by_category == {"bug": 2, "Bug": 1}


def test_statistics_of_nothing(nested):
    r = stats.statistics(nested.limit(0)).first()
    assert (r.total_reviews, r.avg_latency_ms, r.reviews_by_provider) == (0, 0.0, {})


def test_outcomes_and_buckets(nested):
    o = {r.request_id: r for r in stats.request_outcomes(nested).collect()}
    assert set(o) == {"1", "3", "5"} and o["1"].fallback_used and o["1"].last_model == "m2" and o["1"].output_tokens == 5
    b = {r.id: r for r in stats.severity_buckets(stats.all_comments(nested)).collect()}
    assert (b["1"].critical, b["1"].praise, b["1"].total, b["2"].total) == (1, 1, 2, 0)


def test_nest_keeps_order_and_childless_parents(spark):
    parents = spark.createDataFrame([("a", 1), ("b", 2)], "id string, nest_key int")
    children = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("c", 1, "z")], "parent string, at int, v string")
    got = {r.id: [x.v for x in r.kids] for r in stats.nest(parents, children, "id", "parent", "kids", ["at"]).collect()}
    assert got == {"a": ["x", "y"], "b": []}


def test_versions_and_deletes(spark):
    base = spark.createDataFrame([("a", 1, T), ("a", 2, T + datetime.timedelta(1)), ("b", 3, None), (None, 4, T), ("a", 2, T + datetime.timedelta(1))], "id string, row int, updated_at timestamp")
    assert sorted((r.id, r.row) for r in store.latest(base, ["updated_at"]).collect()) == [("a", 2), ("b", 3)]
    up = store.upsert(store.latest(base, ["updated_at"]), spark.createDataFrame([("b", 9, T), (None, 7, T)], "id string, row int, updated_at timestamp"))
    assert sorted(r.row for r in up.collect()) == [2, 7, 9] and up.where("id IS NULL").count() == 0
    assert store.delete(base.where("id IS NOT NULL"), spark.createDataFrame([("a",), ("q",)], "id string")).count() == 1
    assert store.latest(base.limit(0), ["updated_at"]).count() == 0


def test_patch_keeps_what_is_null(spark):
    base = spark.createDataFrame([("a", True, "x", T), ("b", True, "y", T)], "id string, is_active boolean, model_preference string, updated_at timestamp")
    change = spark.createDataFrame([("a", False, None), ("q", False, None)], "id string, is_active boolean, model_preference string")
    got = {r.id: r for r in store.patch(base, change, ["is_active", "model_preference"], now=F.lit(T + datetime.timedelta(9)).cast("timestamp")).collect()}
    assert (got["a"].is_active, got["a"].model_preference) == (False, "x") and got["a"].updated_at != got["b"].updated_at and len(got) == 2
    rules = spark.createDataFrame([("a", [("*.kt", "skip")])], "id string, review_rules array<struct<pattern:string,action:string>>")
    with_rules = base.withColumn("review_rules", F.array().cast("array<struct<pattern:string,action:string>>"))
    assert {r.id: len(r.review_rules) for r in store.replace_rules(with_rules, rules).collect()} == {"a": 1, "b": 0}


def test_create_and_retry(spark):
    ask = spark.createDataFrame([("o/n", 1, None)], "full_name string, installation_id bigint, model_preference string")
    r = store.create_repository(ask, F.lit(T)).first()
    assert (r.owner, r.name, r.model_preference) == ("o", "n", "auto")
    with pytest.raises(Exception, match="owner/name"):
        store.create_repository(ask.withColumn("full_name", F.lit("a/b/c")), F.lit(T)).collect()
    requests = spark.createDataFrame([("1", "o/n", 5, "FAILED"), ("2", "o/n", 6, "PENDING")], "id string, repository_full_name string, platform_pr_id int, status string")
    assert [tuple(x) for x in store.read_messages(store.requeued(requests)).collect()] == [("1", "o/n", 5)]
    with pytest.raises(Exception, match="only failed"):
        store.retryable(requests, strict=True).collect()
    with pytest.raises(ValueError, match="status"):
        tables.parse_status("gone")
    with pytest.raises(Exception, match="unknown status"):
        spark.createDataFrame([("x",)], "s string").select(tables.status_domain(F.col("s"))).collect()
    assert tables.list_requests(requests, "o/n", "failed").count() == 2 and tables.list_requests(requests, "o/n", "failed", combine=True).count() == 1


def test_resolve(spark):
    m = spark.createDataFrame([("1",), ("9",), ("2",)], "review_request_id string")
    q = spark.createDataFrame([("1", "o/n", "PENDING"), ("2", "x/y", "PENDING")], "id string, repository_full_name string, status string")
    p = spark.createDataFrame([("p", "o/n", True)], "id string, full_name string, is_active boolean")
    assert {r.review_request_id: r.problem for r in store.resolve(m, q, p).collect()} == {"1": None, "9": "request not found", "2": "repository not found"}
    with pytest.raises(Exception, match="not found"):
        store.resolve(m, q, p, missing="fail").collect()


def test_queue_files(spark, tmp_path):
    requests = spark.createDataFrame([("1", "o/n", 5, "PENDING"), (None, "o/n", 6, "PENDING")], "id string, repository_full_name string, platform_pr_id int, status string")
    path, out = str(tmp_path / "q"), str(tmp_path / "copy")
    queue.append(store.queue_messages(requests), path)
    for _ in range(2):  # the second run finds nothing new
        queue.append_stream(queue.consume(spark, path), out, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema(queue.MESSAGES).json(out)
    named, unnamed = queue.split_unnamed(read)
    assert read.count() == 2 and named.count() == 1 and unnamed.count() == 1
    assert store.read_messages(named).first().pull_request_number == 5
