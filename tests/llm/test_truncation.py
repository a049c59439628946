import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergelens.llm import truncation as X

WORDS = "order cart ticket route budget panel queue region".split()


def body(rng):
    parts = [f"The {rng.choice(WORDS)} job keeps the {rng.choice(WORDS)} order stable across restarts because the nightly run kept failing on large inputs." for _ in range(rng.randint(1, 8))]
    tail = rng.choice(["", "", "\n\nThanks", "\n\n- cover queue with tests\n- bump the client", "\n\nFixes #12"])
    return " ".join(parts) + tail


def test_fit_recovers_what_censoring_hides():
    rng = np.random.default_rng(3)
    full = rng.lognormal(6.2, 0.7, 40_000).astype(int).clip(1)
    seen = np.minimum(full, 500)
    lengths, counts = np.unique(seen, return_counts=True)
    cut = np.where(lengths == 500, (full >= 500).sum(), 0).astype(float)
    mu, sigma = X.fit_censored(lengths, counts.astype(float), cut, rounds=200)
    assert abs(mu - 6.2) < 0.05 and abs(sigma - 0.7) < 0.05
    naive, _ = X.fit_censored(lengths, counts.astype(float), np.zeros(len(cut)))
    assert naive < mu - 0.1


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    rows, truth = [], set()
    for i in range(1500):
        text, source = body(rng), "mirror" if i % 2 else "hook"
        if source == "mirror" and len(text) > 300:
            text = text[:300]
            truth.add(str(i))
        elif source == "hook" and i % 50 == 0:
            text = text[: rng.randint(20, len(text) - 25)]
            truth.add(str(i))
        rows.append(("pr_body", str(i), source, text))
    for j, (text, cut) in enumerate([("n/a", 0), ("[{\"a\": 1}]", 0), ("[{\"a\": \"b", 1), ("ideas welcome...", 0), ("The order job keeps the (…", 1), ("", 0), ("  \n ", 0), (None, 0)]):
        rows.append(("pr_body", f"x{j}", None if j % 2 else "hook", text))
        truth |= {f"x{j}"} if cut else set()
    df = spark.createDataFrame(rows, "field string, row_id string, source string, text string").withColumn("word", F.lit("a"))
    return X.detect_truncation(df).collect(), truth


def test_cut_texts_are_found(judged):
    got, truth = judged
    found = {r.row_id for r in got if r.truncated}
    assert len(got) == 1508 and len(found & truth) >= 0.97 * len(truth) and len(found - truth) <= 0.02 * len(truth)
    assert 300 in {r.limit_length for r in got if r.truncated}


def test_blank_and_null_are_no_cases(judged):
    got, _ = judged
    assert all(not r.truncated and r.posterior == 0 for r in got if r.row_id in ("x5", "x6", "x7"))


def test_rates(spark, judged):
    rates = {r.source: r for r in X.truncation_rates(spark.createDataFrame(judged[0])).collect()}
    assert rates["mirror"].cut_at_limit >= 0.95 * rates["mirror"].cut > 300 and rates["hook"].cut < 40


def test_empty_table(spark):
    df = spark.createDataFrame([], "field string, row_id string, source string, text string")
    assert X.detect_truncation(df).count() == 0


def test_very_long_strings_and_escapes(spark):
    rows = [("content", "1", "a", '[{"body": "' + "x" * 300_000 + '"}]'), ("content", "2", "a", '[{"body": "' + "\\n" * 200_000 + '"}]'), ("content", "3", "a", '[{"body": "' + '\\"' * 200_000)]
    df = spark.createDataFrame(rows, "field string, row_id string, source string, text string")
    assert {r.row_id: r.truncated for r in X.detect_truncation(df).collect()} == {"1": False, "2": False, "3": True}


def test_ends_are_read_whole(spark):
    rows = [("a b" + " " * 2000, "b", "a"), ("one " + "x" * 3000, "x" * 3000, "one"), ("one\r\n two\n\n", "two", "¶"), ("Only", "only", "¶"), ("n 12 34", "0", "0"), ("", "", "¶"), (" \n ", "", "¶"), ("é 🚀x", "🚀x", "é")]
    df = spark.createDataFrame(rows, "text string, last string, prev string")
    last, prev = X.last_words(F.reverse("text"))
    assert [tuple(r) for r in df.select(last, prev).collect()] == [(r[1], r[2]) for r in rows]
    ends = [("done." + " " * 900, "closed"), ("done" + ")" * 500, None), ("done." + ")" * 500 + " ", "closed"), ("more [ … ]  ", "mark"), ("more (cut off)\n", "mark"), ("well...\n" + " " * 500, "dots"), ("ok :-)", "closed"), ("fine ✅️", "closed"), ("and then", None)]
    df = spark.createDataFrame([(t, k) for t, k in ends], "text string, kind string")
    assert [tuple(r) for r in df.select("kind", X.shape(F.col("text"), F.reverse("text"))).collect() if r[0] != r[1]] == []


def test_fragments_of_any_length(spark):
    rng = random.Random(7)
    whole = [f"The {rng.choice(WORDS)} job waits for the internationalizationbureau of the {rng.choice(WORDS)} team." for _ in range(400)]
    rows = [("pr_body", str(i), "hook", t) for i, t in enumerate(whole)]
    rows += [("pr_body", f"cut{k}", "hook", "The cart job waits for the " + "internationalizationbureau"[:k]) for k in (8, 12, 14, 15, 16, 18, 22)]
    got = {r.row_id: r for r in X.detect_truncation(spark.createDataFrame(rows, "field string, row_id string, source string, text string")).collect()}
    assert all(got[f"cut{k}"].ending == "fragment" and got[f"cut{k}"].truncated for k in (8, 12, 14, 15, 16, 18, 22))


def test_a_likelihood_says_how_many_texts_make_a_limit(spark):
    """Eight texts of one length where hardly any end nearby are a limit; a spike in a crowd isn't."""
    rows = [("f", str(i), "a", 100 + 7 * i, i) for i in range(60)] + [("f", f"s{i}", "a", 750, 1000 + i) for i in range(8)]
    rows += [("f", f"b{i}", "b", 100 + i % 40, i) for i in range(800)] + [("f", f"c{i}", "b", 120, 5000 + i) for i in range(20)]
    facts = spark.createDataFrame(rows, "field string, row_id string, source string, length bigint, h bigint")
    assert {(r.source, r.length) for r in X.censoring_limits(facts).collect()} == {("a", 750)}
