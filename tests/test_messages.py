import datetime
import itertools
import random

from pyspark.sql import functions as F

from mergelens.operators import dedup

DDL = "delivery_id bigint, review_request_id string, pull_request_number int, received_at timestamp, batch_id bigint"


def at(i):
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=i)


def table(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("row", F.lit("x")).withColumn("message_id", F.lit("y")).withColumn("kept", F.lit(1))


def test_earliest_delivery_is_kept(spark):
    rows = [(3, "review-1", 1, at(1), 1), (1, " REVIEW-1\n", 1, at(5), 2), (2, " Review-1\t", 1, at(1), 3), (4, "review-1", 2, at(0), 1), (5, "review-1", None, at(9), 1), (6, "review-1", None, None, 1), (7, None, 1, at(0), 1), (8, "  ", 1, at(0), 1), (9, "", None, None, None)]
    df = table(spark, rows)
    out = dedup.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.delivery_id for r in out.collect()) == [2, 4, 5, 7, 8, 9]
    pairs = sorted((r.delivery_id_a, r.delivery_id_b) for r in dedup.delivery_pairs(df).collect())
    assert pairs == [(1, 2), (1, 3), (2, 3), (5, 6)]


def test_repeated_rows_and_nulls(spark):
    df = table(spark, [(1, "a", 1, at(0), 1), (1, "a", 1, at(0), 1), (None, "a", 1, at(0), 1), (None, "b", None, None, None)])
    assert sorted(str(r.delivery_id) for r in dedup.keep_one(df).collect()) == ["1", "None"]
    assert dedup.delivery_pairs(df).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    assert dedup.keep_one(df).count() == 0 and dedup.delivery_pairs(df).count() == 0


def test_hot_key_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "HOT ", "a", "b", None]), rng.choice([1, None]), at(rng.randint(0, 50)), 0) for i in range(200)]
    df = spark.createDataFrame(rows, DDL).repartition(5)
    key = lambda r: (r[1].strip().lower(), r[2]) if r[1] and r[1].strip() else None
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if key(a) and key(a) == key(b)}
    assert {(r.delivery_id_a, r.delivery_id_b) for r in dedup.delivery_pairs(df).collect()} == want
    for block in (1, 7):  # a hot message in many blocks gives the same pairs, each once
        got = [(r.delivery_id_a, r.delivery_id_b) for r in dedup.delivery_pairs(df, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    kept = {r.delivery_id for r in dedup.keep_one(df).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(key(r) or r[0], []).append(r)
    assert kept == {min(g, key=lambda r: (r[3], r[0]))[0] for g in groups.values()}
    plan = dedup.delivery_groups(df, "review_request_id", "pull_request_number", "received_at", "delivery_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate(") >= 2  # one before the shuffle, one after


def test_pairs_come_through_the_aggregate(spark):
    """The representative of each message is the delivery that ``min_by`` keeps."""
    df = table(spark, [(1, "a", 1, at(3), 1), (2, "A", 1, at(2), 1), (3, "b", 1, at(2), 1), (None, "a", 1, at(0), 1)])
    pairs = dedup.delivery_pairs(df)
    assert "min_by" in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
