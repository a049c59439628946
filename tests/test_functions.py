import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from mergelens.functions import signature, text
from mergelens.operators import envelopes, render

LONG = "s" * 70


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


@pytest.mark.parametrize("secret", ["key", "", LONG])
@pytest.mark.parametrize("payload", ["", "{}", "größer 🚀" * 50])
def test_hmac(spark, secret, payload):
    want = hmac.new(secret.encode(), payload.encode(), hashlib.sha256).hexdigest()
    assert one(spark, signature.hmac_sha256(F.col("c0"), secret), payload) == want


def test_verified(spark):
    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    check = lambda sig, secret="k", body="body": one(spark, signature.verified(F.col("c0"), F.col("c1"), secret), body, sig)
    assert check(good) and check("sha256=" + good[7:].upper())
    assert not check(good, "other") and not check(good, "k", "Body") and not check(good[7:]) and not check("sha256=zz") and check(None) is False
    assert check(None, " ")
    with pytest.raises(ValueError, match="secret"):
        signature.verified(F.col("c0"), F.col("c1"), "", require_secret=True)


def test_lines_and_blank(spark):
    assert one(spark, text.lines(F.col("c0")), "a\r\nb\rc\n") == ["a", "b", "c", ""]
    assert one(spark, text.is_blank(F.col("c0")), "  \t") and not one(spark, text.is_blank(F.col("c0")), "x")
    assert one(spark, text.safe_int(F.col("c0"), 1), "x") == 1 == one(spark, text.safe_int(F.col("c0"), 1), "")
    assert one(spark, text.provider_name(F.col("c0")), "a (fallback from b)") == "a"


def test_globs(spark):
    hit = lambda path, *p: one(spark, text.matches_any(F.col("c0"), list(p)), path)
    assert hit("a.lockfile", "*.lock") and hit("x/a.min.js", "*.min.js") and not hit("aXmin.js", "*.min.js") and not hit("a", *[])
    assert one(spark, text.matches_any(F.col("c0"), F.array(F.lit("go.sum"), F.lit(None))), "go.sum")
    assert one(spark, text.matches_any(F.col("c0"), F.lit(None).cast("array<string>")), "go.sum") is False


def comments(spark, rows):
    return spark.createDataFrame([(rows,)], "c array<struct<file_path:string,line_number:int,category:string,severity:string,content:string,suggestion:string>>")


def test_texts(spark):
    rows = [("a.kt", i, "bug", s, f"T{i}\n\nB", "fix" if i == 1 else None) for i, s in enumerate(["CRITICAL", "WARNING", "PRAISE", *["SUGGESTION"] * 9])]
    df = comments(spark, rows)
    t = df.select(render.summary(F.col("c")).alias("s"), render.inline_comments(F.col("c")).alias("i")).first()
    assert t.s.startswith("**AI Code Review**\n\n### Summary\nFound **12 issues** (1 Critical, 1 Warning, 9 Suggestion)\n\n### Issues\n[CRITICAL] **[BUG]** `a.kt:0` - T0\n")
    assert t.s.count("a.kt") == 10 and t.s.endswith("\n")
    assert len(t.i) == 11 and t.i[0].body == "[WARNING] **[BUG]** T1\n\nB\n\n```suggestion\nfix\n```\n" and t.i[1].body == "[PRAISE] **[BUG]** T2\n\nB\n"
    assert comments(spark, []).select(render.summary(F.col("c"))).first()[0] == "**AI Code Review**\n\n### Summary\nFound **0 issues** (0 Critical, 0 Warning, 0 Suggestion)\n\n"


def test_prompts(spark):
    assert one(spark, render.chunk_prompt(F.col("c0"), F.col("c1"), F.lit("a.kt"), F.lit("+x"), F.lit(1), F.lit(2)), "T", None) == "## Pull Request\nTitle: T\n\n## File (1/2): a.kt\n\n```diff\n+x\n```\n"
    long = one(spark, render.user_prompt(F.col("c0"), F.col("c1"), F.array(F.lit("a"), F.lit("b")), F.lit("+x")), "T", "d" * 600)
    assert "Description: " + "d" * 500 + "\n\n## Changed Files\n- a\n- b\n\n## Diff\n```diff\n+x\n```\n" in long
    system = one(spark, render.system_prompt(F.col("c0"), F.col("c1")), "ko", "be kind")
    assert "Use Korean for" in system and system.endswith("wrapping\n\nAdditional rules:\nbe kind")


MESSAGES = '{"id":"m","content":[{"type":"thinking","text":"no"},{"type":"text","text":"yes"}],"model":"m1","usage":{"input_tokens":3,"output_tokens":4}}'
CHAT = '{"id":"c","model":"m2","choices":[{"index":0,"message":{"role":"assistant","content":"yes"}}],"usage":{"prompt_tokens":3,"completion_tokens":4,"total_tokens":9}}'
GENERATE = '{"candidates":[{"content":{"role":"model","parts":[{"text":"yes"}]}}],"usageMetadata":{"promptTokenCount":3,"candidatesTokenCount":4,"totalTokenCount":8}}'


def test_envelopes(spark):
    assert tuple(one(spark, envelopes.from_messages(F.col("c0")), MESSAGES)) == ("yes", "m1", "claude", 3, 4, 7)
    assert tuple(one(spark, envelopes.from_chat(F.col("c0")), CHAT)) == ("yes", "m2", "openai", 3, 4, 9)
    assert tuple(one(spark, envelopes.from_generate(F.col("c0"), F.lit("m3")), GENERATE)) == ("yes", "m3", "gemini", 3, 4, 8)
    assert tuple(one(spark, envelopes.from_chat(F.col("c0")), '{"model":"m","choices":[{"message":{"content":"x"}}]}')) == ("x", "m", "openai", 0, 0, 0)
    for make, bad in ((envelopes.from_messages, '{"content":[{"type":"image"}],"model":"m"}'), (envelopes.from_chat, '{"choices":[]}'), (envelopes.from_messages, "nonsense"), (envelopes.from_chat, "")):
        assert one(spark, make(F.col("c0")), bad) is None
    assert one(spark, envelopes.from_generate(F.col("c0"), F.lit("m")), '{"candidates":[]}') is None


def test_requests(spark):
    import json

    args = (F.lit("m"), F.col("c0"), F.col("c1"), F.lit(10), F.lit(0.1))
    assert json.loads(one(spark, envelopes.messages_request(*args), "sys", "usr")) == {"model": "m", "max_tokens": 10, "system": "sys", "messages": [{"role": "user", "content": "usr"}], "temperature": 0.1, "stream": False}
    assert [m["role"] for m in json.loads(one(spark, envelopes.chat_request(*args), "sys", "usr"))["messages"]] == ["system", "user"]
    assert json.loads(one(spark, envelopes.generate_request(*args[1:]), "sys", "usr"))["generationConfig"] == {"temperature": 0.1, "maxOutputTokens": 10}
