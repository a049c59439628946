import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergelens.llm import reading as R

EASY = "it is good we use it each day my friend has one too the cup is red i like it so much".split()
PLAIN = "after about two weeks of use the handle closes properly although the manual could be a little clearer before i order another one".split()
HARD = "notwithstanding considerable inconsistency prolonged evaluation revealed remarkably consistent performance across heterogeneous environmental conditions".split()


def text(words, rng, length):
    return " ".join(rng.choice(words) for _ in range(length)).capitalize() + "."


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    kinds = (("basic", EASY, 6), ("standard", PLAIN, 18), ("demanding", HARD, 25))
    samples = [(text(w, rng, n), b) for b, w, n in kinds for _ in range(12)]
    truth, docs = {}, []
    for i in range(600):
        band, words, n = kinds[i % 3]
        truth[i] = band
        docs.append((i, text(words, rng, n)))
    docs += [(1000, None), (1001, ""), (1002, " \t"), (1003, "123 !?"), (1004, docs[2][1]), (1004, docs[2][1])]
    return spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("nodes", F.lit(1)).withColumn("score", F.lit("x")), spark.createDataFrame(samples, "text string, band string"), truth


def test_held_out_bands(tables):
    docs, samples, truth = tables
    got = R.reading_levels(docs, samples).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 606
    assert sum(by[i].band == b for i, b in truth.items()) >= 0.97 * len(truth)
    assert all(by[i].score is None and by[i].band is None for i in (1000, 1001, 1002, 1003))
    assert by[1004].score == by[2].score


def packed(spark, rows):
    return R.pack(spark.createDataFrame(list(enumerate(rows)), "doc int, nodes array<int>").coalesce(1), "doc", "nodes").cache()


def off(graph, level, graded, documents, size=R.NODES):
    """How far each reached node's score is from the mean of its documents and samples."""
    (count,) = R._node_sums(graph, [], None, size)
    score = np.nan_to_num(level.score)
    (top,) = R._node_sums(graph, [score], level.weight, size)
    for nodes, grade in graded:
        top[nodes] += documents / len(graded) * grade
        count[nodes] += documents / len(graded)
    at = ~np.isnan(level.score) & (level.weight > 0)
    return np.abs(top[at] / count[at] - score[at]).max(), at


def test_scores_are_harmonic(tables, spark):
    """At the end each word's score is the mean of its documents' and samples', as the query runs it."""
    docs, samples, _ = tables
    graph = R.pack(docs.select("doc_id", R.node_list(F.coalesce("text", F.lit(""))).alias("nodes")), "doc_id", "nodes").cache()
    graded = R._sample_nodes(samples, "text", "band")
    level = R.fit(graph, graded, docs.count())
    change, at = off(graph, level, graded, docs.count())
    assert at.sum() > 100 and change < R.STILL


def test_same_as_plain_averaging(spark):
    """Conjugate gradients end where hundreds of rounds of averaging do."""
    rng = random.Random(5)
    rows = [sorted({rng.randrange(40) for _ in range(4)}) for _ in range(80)]
    graded = [(np.array([0, 1]), 0.0), (np.array([2]), 0.5), (np.array([3, 4]), 1.0)]
    level = R.fit(packed(spark, rows), graded, len(rows), 64)
    score, w, share = np.full(64, 0.5), level.weight, len(rows) / len(graded)
    for _ in range(3000):
        top, count = np.zeros(64), np.zeros(64)
        for r in rows:
            top[r] += (w[r] * score[r]).sum() / w[r].sum()
            count[r] += 1
        for nodes, grade in graded:
            top[nodes] += share * grade
            count[nodes] += share
        score = np.where(count > 0, top / np.maximum(count, 1e-9), 0.5)
    at = ~np.isnan(level.score)
    assert at.sum() >= 38 and np.abs(level.score[at] - score[at]).max() < 20 * R.STILL


def test_number_of_nodes_follows_the_corpus():
    assert R.nodes_for(0) == R.nodes_for(100_000) == R.NODES < R.nodes_for(1_000_000) < R.nodes_for(10**8) == R.nodes_for(10**12) == R.MOST_NODES


def test_long_texts_are_packed_by_size(spark, monkeypatch):
    rows = [list(range(50)), [], [1, 2], list(range(200)), [3]]
    got = R.pack(spark.createDataFrame(list(enumerate(rows)), "doc int, nodes array<int>").coalesce(1), "doc", "nodes").collect()
    assert [d for r in got for d in r.docs] == [0, 1, 2, 3, 4]
    assert np.concatenate([np.frombuffer(r.nodes, dtype=np.int32) for r in got]).tolist() == [x for r in rows for x in r]


def test_edges(tables):
    docs, samples, _ = tables
    assert R.reading_levels(docs.limit(0), samples).count() == 0
    with pytest.raises(ValueError, match="bands"):
        R.reading_levels(docs, samples.where("band != 'basic'"))


def test_scores_of_a_long_chain_stand(spark):
    """Scores that need more than a dozen rounds to cross the graph; what no sample is linked to has none."""
    graph = packed(spark, [[i, i + 1] for i in range(30)] + [[50, 51]])
    graded = [(np.array([0]), 0.0), (np.array([15]), 0.5), (np.array([30]), 1.0)]
    level = R.fit(graph, graded, 31)
    change, _ = off(graph, level, graded, 31)
    assert change < R.STILL
    assert not np.isnan(level.score[:31]).any() and np.isnan(level.score[[50, 51]]).all()
    with pytest.raises(RuntimeError, match="stand"):
        R.fit(graph, graded, 31, rounds=5)
