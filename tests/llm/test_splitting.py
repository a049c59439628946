import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mergelens.llm.splitting import pieces, rejoined, split_items


def stepped(text, size, overlap, fill=0.5):
    """The greedy walk, one step at a time."""
    spaces = lambda p: text[p - 1].isspace() and not (p < len(text) and text[p] == "\n")
    levels = (lambda p: text[p - 1] == "\n" and text.startswith(("@@ ", "diff --git "), p), lambda p: text[p - 1] == "\n", spaces)
    if len(text) <= size:
        return [(0, len(text))]
    at, out = 0, []
    while at < len(text):
        high = size if at == 0 else at + size - overlap
        if high >= len(text):
            nxt = len(text)
        else:
            floor = max(0, overlap - 1) if at == 0 else at
            late = max(floor, at + int((high - at) * (1 - fill)))
            nxt = next((max(found) for low in (late, floor) for level in levels if (found := [p for p in range(low + 1, high + 1) if level(p)])), high)
        out.append((max(0, at - overlap) if at else 0, nxt))
        at = nxt
    return out


@pytest.mark.parametrize("seed", range(40))
def test_doubling_equals_walking(seed):
    rng = random.Random(seed)
    words = ["a", "bb", "ccc" * rng.randint(1, 30), "\n", " ", "\r\n", "\n@@ -1 +1 @@\n", "é🚀", "\ndiff --git x\n"]
    text = "".join(rng.choice(words) for _ in range(rng.randint(0, 300)))
    size = rng.randint(2, 60)
    overlap = rng.randint(0, size - 1)
    got = pieces(text, size, overlap)
    assert got == stepped(text, size, overlap)
    assert all(b - a <= size for a, b in got)
    assert all(y[0] == x[1] - overlap >= x[0] for x, y in zip(got, got[1:]))
    whole = text[: got[0][1]] + "".join(text[x[1] : y[1]] for x, y in zip(got, got[1:]))
    assert whole == text


def test_very_long_word_is_cut_hard():
    got = pieces("x" * 1_000_000, 1000, 1)
    assert len(got) == 1001 and got[-1][1] == 1_000_000


def test_rows(spark):
    rows = [Row(k=1, text="a b c d e f"), Row(k=2, text=""), Row(k=3, text=None), Row(k=4, text="short"), Row(k=4, text="short"), Row(k=None, text="0123456789")]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("piece_no_", F.lit("x"))
    out = split_items(df, "text", F.lit(6), F.lit(2), ["k"]).collect()
    by = {}
    for r in out:
        by.setdefault(r.k, []).append((r.piece_no, r.piece))
    assert sorted(by[1]) == [(1, "a b c "), (2, "c d e "), (3, "e f")]
    assert by[2] == [(1, "")] and 3 not in by and by[4] == [(1, "short")] * 2
    assert sorted(by[None]) == [(1, "012345"), (2, "456789")]
    assert split_items(df.limit(0), "text", F.lit(6), F.lit(2), ["k"]).count() == 0


def test_bad_overlap_raises(spark):
    df = spark.createDataFrame([Row(k=1, text="abc")])
    with pytest.raises(Exception, match="overlap"):
        split_items(df, "text", F.lit(2), F.lit(2), ["k"]).collect()


def test_pieces_join_up(spark):
    text = "".join(f"word{i} " if i % 7 else "\n" for i in range(60_000)) + "é🚀" * 2000
    df = spark.createDataFrame([Row(k=1, p="x", text=text), Row(k=2, p="y", text="0123456789" * 50)])
    got = split_items(df, "text", F.lit(200), F.lit(30), ["k", "p"]).cache()
    back = {r.k: r for r in rejoined(got, ["k", "p"], F.lit(30), F.lit(200)).collect()}
    assert back[1].joined == text and back[2].joined == "0123456789" * 50
    assert all(r.within and r.lapped for r in back.values())
    worse = {r.k: r for r in rejoined(got.withColumn("piece", F.concat(F.lit("!"), "piece")), ["k", "p"], F.lit(30), F.lit(200)).collect()}
    assert not worse[1].within and not worse[2].lapped
