from collections import defaultdict

from pyspark.sql import functions as F

from mergelens.llm import mixing


def test_fill_level():
    assert mixing.fill_level([(0.5, 100), (0.5, 10)], 20) == 20
    assert mixing.fill_level([(0.5, 100), (0.5, 10)], 60) == 20 + 40 / 0.5
    assert mixing.fill_level([(0.5, 10)], 20) == float("inf")


def brute(sizes, targets, order):
    """Fair queueing over whole queues, in one place."""
    out = {}
    corpus = sum(t or 0 for _, _, t in sizes)
    for plan in {t[0] for t in targets}:
        uses, budget = [], 0
        for _, source, share, most, ratio in (t for t in targets if t[0] == plan):
            docs = sorted(((d, t) for d, s, t in sizes if s == source and t), key=lambda x: (order[x[0]], x[0], x[1]))
            if docs:
                budget = int(corpus * ratio)
            upto = 0
            for r in range(1, most + 1):
                for d, t in docs:
                    upto += t
                    uses.append((upto / share, source, d, order[d], r, t))
        end, got = 0, []
        for _, source, d, _, r, t in sorted(uses):
            end += t
            if end > budget:
                break
            got.append((source, d, r, t, end))
        out[plan] = got
    return out


def test_equals_queueing_in_one_place(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    sizes = [(i, "big" if i % 3 else "mid" if i % 2 else "small", 1 + i * 7 % 13) for i in range(300)] + [(900, None, 5), (901, "big", 0), (902, "big", None)]
    targets = [("a", "big", 0.5, 1, 0.4), ("a", "small", 0.3, 3, 0.4), ("a", "gone", 0.2, 3, 0.4), ("b", "small", 0.5, 2, 0.9), ("b", "mid", 0.5, 2, 0.9)]
    df = spark.createDataFrame(sizes, "doc_id bigint, source string, tokens bigint")
    plans = spark.createDataFrame([*targets, ("c", None, 0.5, 1, 0.5), ("c", "big", None, 1, 0.5), ("c", "big", 0.5, 0, 0.5)], "plan string, source string, target_share double, max_repeats int, size_ratio double")
    order = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("h")).collect()}
    got = defaultdict(list)
    for r in mixing.mix(df, plans).collect():
        got[r.plan].append((r.source, r.doc_id, r.repeat_no, r.tokens, r.mix_end))
    want = brute(sizes, targets, order)
    assert {k: sorted(v, key=lambda x: x[-1]) for k, v in got.items()} == want
    report = {(r.plan, r.source): r for r in mixing.mix_report(mixing.mix(df, plans), plans.where("plan IN ('a', 'b')")).collect()}
    assert abs(report["a", "big"].reached_share - 0.5 / 0.8) < 0.05 and report["a", "gone"].mix_tokens == 0
    assert report["b", "small"].repeats == 2


def test_empty_tables(spark):
    sizes = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")
    plans = spark.createDataFrame([("a", "big", 0.5, 1, 0.4)], "plan string, source string, target_share double, max_repeats int, size_ratio double")
    assert mixing.mix(sizes, plans).count() == 0
    one = spark.createDataFrame([(1, "big", 4)], "doc_id bigint, source string, tokens bigint")
    assert mixing.mix(one, plans.limit(0)).count() == 0
