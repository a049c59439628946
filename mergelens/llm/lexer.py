"""A lexer of source code in many languages, for texts that may be diffs.

Lines are cut into strings, comments, names, numbers and operators. Strings and
comments over several lines are followed from line to line, in a diff on either side
by itself: removed lines belong to the old side, added ones to the new side, context
to both. Only lines that the caller asks for, and those where such a string or comment
may begin or end, are looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

STRING, COMMENT, NAME, NUMBER, OPERATOR = "string", "comment", "name", "number", "operator"


class Token(NamedTuple):
    """``start`` and ``end`` in the whole text; ``low`` and ``high`` bound what stands between a string's or comment's marks."""

    kind: str
    start: int
    end: int
    low: int
    high: int
    text: str


#: What ends a string or comment that may go over several lines, by its start.
CLOSERS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''", "`": "`"}
_LEX = re.compile(
    r"""\s++
    |(?P<block>/\*|<!--|\"\"\"|''')
    |(?P<comment>(?<![:\w])//|(?:^|(?<=\s))(?:\#|--(?=\s|$))|^\s*;)
    |(?P<string>(?:(?<!\w)[A-Za-z]{1,2})?"(?P<a>(?:\\.|[^"\\])*+)"
        |(?<!\w)[bBrRuUfFlLN]{0,2}'(?P<b>(?:\\.|[^'\\])*+)'
        |\\"(?P<c>(?:[^"\\]|\\(?!"))*+)\\"
        |\\'(?P<d>(?:[^'\\]|\\(?!'))*+)\\'
        |`(?P<e>(?:\\.|[^`\\])*+)`(?!`))
    |(?P<fence>```+|~~~+)
    |(?P<raw>`)
    |(?P<name>[^\W\d][\w$]*+(?:[-.][^\W\d][\w$]*+)*+|[$@][\w$]++(?:[-.][^\W\d][\w$]*+)*+)
    |(?P<number>\d[\w.]*+)
    |(?P<operator>:=|=>|->|===?|!==?|<=|>=|\?\?=?|\|\|=?|&&|::|\+=|=~|\S)""",
    re.VERBOSE,
)
#: Where the state may change: marks of strings and comments over lines, and heads of hunks and files.
_EVENTS = re.compile(r"/\*|\*/|<!--|-->|\"\"\"|'''|`|^@@|^diff --git ", re.MULTILINE)


def tokens(line: str, base: int, state: str | None = None) -> tuple[list[Token], str | None]:
    """Tokens of one line that begins at ``base`` of the text, within ``state`` (an open mark or None), and the state after it."""
    out: list[Token] = []
    at = 0
    if state:
        closer = CLOSERS[state]
        stop = line.find(closer)
        inner = len(line) if stop < 0 else stop
        out.append(Token(COMMENT if state in ("/*", "<!--") else STRING, base, base + (inner if stop < 0 else stop + len(closer)), base, base + inner, line[:inner]))
        if stop < 0:
            return out, state
        at = stop + len(closer)
    while m := _LEX.match(line, at):
        kind, at = m.lastgroup, m.end()
        if m["string"] is not None:
            group = next(g for g in "abcde" if m[g] is not None)
            out.append(Token(STRING, base + m.start(), base + at, base + m.start(group), base + m.end(group), m[group]))
        elif kind == "comment":
            out.append(Token(COMMENT, base + m.start(), base + len(line), base + at, base + len(line), line[at:]))
            return out, None
        elif kind == "block" or kind == "raw":
            closer = CLOSERS[m[0]]
            stop = line.find(closer, at)
            inner = len(line) if stop < 0 else stop
            end = len(line) if stop < 0 else stop + len(closer)
            out.append(Token(COMMENT if m[0] in ("/*", "<!--") else STRING, base + m.start(), base + end, base + at, base + inner, line[at:inner]))
            if stop < 0:
                return out, m[0]
            at = end
        elif kind in (NAME, NUMBER, OPERATOR):
            out.append(Token(kind, base + m.start(), base + at, base + m.start(), base + at, m[0]))
    return out, None


class Lines:
    """The lines of a text, each with the state in which it begins."""

    def __init__(self, text: str, diff: bool = True) -> None:
        self.text, self.diff = text, diff
        self.events = _line_starts(text)
        self.next_event = next(self.events, None)
        self.begins: list[int] = []
        self.after: list[tuple[str | None, str | None]] = []  # the states of the new and the old side behind each event

    def body(self, begin: int) -> tuple[int, int, str]:
        """(start, end, sign) of the line that begins at ``begin``, without its sign and line end."""
        stop = self.text.find("\n", begin)
        stop = len(self.text) if stop < 0 else stop
        end = stop - 1 if stop > begin and self.text[stop - 1] == "\r" else stop
        signed = self.diff and end > begin and self.text[begin] in "+- " and not self.text.startswith("-----", begin)
        return (begin + 1, end, self.text[begin]) if signed else (begin, end, " ")

    def states(self, begin: int) -> tuple[str | None, str | None]:
        while self.next_event is not None and self.next_event < begin:
            self._advance(self.next_event)
        at = bisect_left(self.begins, begin) - 1
        return self.after[at] if at >= 0 else (None, None)

    def tokens(self, begin: int) -> list[Token]:
        """Tokens of the line that begins at ``begin``."""
        low, end, sign = self.body(begin)
        new, old = self.states(begin)
        return tokens(self.text[low:end], low, old if sign == "-" else new)[0]

    def _advance(self, begin: int) -> None:
        self.next_event = next(self.events, None)
        new, old = self.after[-1] if self.after else (None, None)
        if self.diff and self.text.startswith(("@@", "diff --git "), begin):
            new = old = None
        low, end, sign = self.body(begin)
        line = self.text[low:end]
        if sign == "-":
            old = tokens(line, low, old)[1]
        elif sign == "+":
            new = tokens(line, low, new)[1]
        else:
            same = new == old
            new = tokens(line, low, new)[1]
            old = new if same else tokens(line, low, old)[1]
        self.begins.append(begin)
        self.after.append((new, old))

    def following(self, begin: int) -> Iterator[int]:
        """Beginnings of the lines after that at ``begin`` on its side, up to the end of the hunk, blank ones left out."""
        sign = self.body(begin)[2]
        while (begin := self.text.find("\n", begin) + 1) > 0 and begin < len(self.text):
            if self.diff and self.text.startswith(("@@", "diff --git "), begin):
                return
            low, end, own = self.body(begin)
            if {sign, own} != {"+", "-"} and end > low and not self.text[low:end].isspace():
                yield begin


def _line_starts(text: str) -> Iterator[int]:
    """Beginnings of the lines with a mark, ascending, each once."""
    stop = -1
    for m in _EVENTS.finditer(text):
        if m.start() > stop:
            yield text.rfind("\n", 0, m.start()) + 1
            stop = text.find("\n", m.start())
            stop = len(text) if stop < 0 else stop
