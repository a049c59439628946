import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergelens.llm import tokens


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    path = tokens.vocabulary_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tokens.Encoder(path), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_public_library(pair):
    coder, public = pair
    texts = ["", None, " ", "Hello  world\n\n", "<|endoftext|> is text", "a" * 5000, "ab" * 3000 + "aaa" * 777, "Größe élargi 漢字 🚀 żółw", " x​", "don't we'll I'LL", "1234567890" * 40, "x" * 63, "x" * 64, "x" * 65, "the " * 2000, "=" * 300 + "-" * 99]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == public.encode_ordinary(text or ""), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdeinorst '\n")), max_size=200), max_size=5))
def test_random_texts(pair, texts):
    coder, public = pair
    assert [x.tolist() for x in coder.encode(texts)] == [public.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aeinorst", min_size=1, max_size=60), max_size=30))
def test_matrix_and_single_merges_agree(pair, words):
    coder, _ = pair
    assert [x.tolist() for x in coder.encode_pieces([w.encode() for w in words])] == [coder._long(w.encode()).tolist() for w in words]


def test_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello"), (3, "Hello")], "k int, text string").withColumn("ids", F.lit(1))
    got = sorted((r.k, r.ids, r.n) for r in tokens.encode_corpus(df).withColumn("n", tokens.count_column(F.col("text"))).collect())
    assert got == [(1, [], 0), (2, [], 0), (3, [15496], 1), (3, [15496], 1)]
    assert tokens.encode_corpus(df.limit(0)).count() == 0
