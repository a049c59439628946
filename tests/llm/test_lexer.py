import random

from mergelens.llm.lexer import COMMENT, NAME, STRING, Lines, tokens


def kinds(line, state=None):
    return [(t.kind, t.text) for t in tokens(line, 0, state)[0]]


def test_strings_comments_names():
    assert kinds("x = b'a\\'b' # it's") == [(NAME, "x"), ("operator", "="), (STRING, "a\\'b"), (COMMENT, " it's")]
    assert kinds('url := "http://h" // c "d"') == [(NAME, "url"), ("operator", ":="), (STRING, "http://h"), (COMMENT, ' c "d"')]
    assert kinds("don't stop; it's 5\"")[0] == (NAME, "don") and not [k for k, _ in kinds("don't stop; it's 5\"") if k == STRING]
    assert kinds("my.api-key: `v w`") == [(NAME, "my.api-key"), ("operator", ":"), (STRING, "v w")]
    assert kinds(r'{\"a\": \"b c\"}')[1] == (STRING, "a")
    assert kinds("--secret 5 -- rest") == [("operator", "-"), ("operator", "-"), (NAME, "secret"), ("number", "5"), (COMMENT, " rest")]
    assert kinds("") == [] and kinds("   ") == []


def test_strings_over_lines():
    found, state = tokens('s = """first', 10)
    assert state == '"""' and found[-1].text == "first" and found[-1].high == 10 + len('s = """first')
    found, state = tokens('a "b" c', 0, state)
    assert state == '"""' and [(t.kind, t.text) for t in found] == [(STRING, 'a "b" c')]
    found, state = tokens('end""" + x', 0, state)
    assert state is None and [t.text for t in found] == ["end", "+", "x"]
    assert tokens("/* open", 0)[1] == "/*" and tokens("/* shut */ y", 0)[0][-1].text == "y" and tokens("```js", 0)[1] is None


def test_sides_of_a_diff_have_states_of_their_own():
    text = '@@ -1 +1 @@\n-old = """\n+new = 1\n+more = "x"\n-"in" old\n-"""\n both = "y"\n@@ -9 +9 @@\n+/* note\n z = "w"\n@@ -20 +20 @@\n v = "u"'
    lines, at, got = Lines(text), 0, {}
    for row in text.split("\n"):
        got[row] = [(t.kind, t.text) for t in lines.tokens(at)]
        at += len(row) + 1
    assert (STRING, "x") in got['+more = "x"'] and got['-"in" old'] == [(STRING, '"in" old')]
    assert got[' both = "y"'][0] == (NAME, "both") and got[' z = "w"'] == [(COMMENT, 'z = "w"')] and (STRING, "u") in got[' v = "u"']


def test_any_text_is_lexed_and_lines_may_be_asked_for_in_any_order():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(['"', "'", "`", "\\", "/*", "*/", '"""', "a", "é", " ", "\n", "\n+", "\n-", "\n@@", "#", "//", "=", "9", "\r\n"]) for _ in range(rng.randint(0, 80)))
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        once = Lines(text)
        forward = {b: once.tokens(b) for b in starts}
        again = Lines(text)
        assert {b: again.tokens(b) for b in reversed(starts)} == forward
        for b, found in forward.items():
            low, end, _ = once.body(b)
            assert all(low <= t.start <= t.low <= t.high <= t.end <= end for t in found)
            assert all(x.end <= y.start for x, y in zip(found, found[1:]))
