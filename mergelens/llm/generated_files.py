"""Problem 1: generated, minified, vendored and data files among changed source files.

Path rules are one code-generated expression in the JVM. Only files that no path
rule decides go to Python, where a multi-pattern automaton looks for generation
notices in the comments at the head of the file and the shape of all lines tells
minified code and data blobs from hand-written code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelens.session import fresh, ship

#: Names of lock files, compared in lower case.
LOCK_FILES = (
    "package-lock.json",
    "npm-shrinkwrap.json",
    "yarn.lock",
    "pnpm-lock.yaml",
    "bun.lockb",
    "deno.lock",
    "gemfile.lock",
    "cargo.lock",
    "poetry.lock",
    "pdm.lock",
    "uv.lock",
    "pipfile.lock",
    "composer.lock",
    "podfile.lock",
    "pubspec.lock",
    "mix.lock",
    "flake.lock",
    "go.sum",
    "go.work.sum",
    "gradle.lockfile",
    "packages.lock.json",
    "paket.lock",
)

#: Folders that hold copies of other projects wherever they stand.
VENDOR_FOLDERS = ("node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "3rdparty", "pods", "carthage", "site-packages", "godeps", "web_modules", ".yarn")

#: Folders that only tools write to.
GENERATED_FOLDERS = ("generated-sources", "generated-src", "generated-test-sources", "__generated__", "__snapshots__", "build/generated", "target/generated")

#: A ``vendor`` folder counts unless it lies below a source root, where it is a package of the project.
_SOURCE_ROOT = r"(^|/)(src|lib|app|internal|pkg|main|modules|packages)/(.*/)?vendor/"

#: (class, regular expression) over the normal path, in order of precedence.
PATH_RULES = (
    ("lockfile", r"(^|/)(" + "|".join(re.escape(x) for x in LOCK_FILES) + r")$"),
    ("lockfile", r"(^|/)[^/]+\.lock$"),
    ("vendored", r"(^|/)(" + "|".join(re.escape(x) for x in VENDOR_FOLDERS) + r")/"),
    ("vendored", r"(^|/)(external|extern|deps)/[^/]+-v?\d+(\.\d+)+/"),
    ("generated", r"(^|/)(" + "|".join(re.escape(x) for x in GENERATED_FOLDERS) + r")(-[a-z]+)*/"),
    ("minified", r"[.-]min\.(js|mjs|cjs|css|html?)$"),
    ("minified", r"\.(bundle|chunk)\.(js|mjs|css)$"),
    ("minified", r"\.(js|mjs|css)\.map$"),
    ("minified", r"(^|/)(dist|build|assets|static|public|out)/(.*/)?[^/]*[.-](?=[a-f]*\d)[0-9a-f]{6,}\.(js|mjs|css)$"),
    ("generated", r"(^|/)zz_generated[._][^/]*$"),
    ("generated", r"\.(generated|designer|freezed)\.[a-z]+$"),
    ("generated", r"(_generated|\.gen|_gen|\.g)\.(go|kt|kts|java|dart|cs|ts|tsx|js|rs|swift|py)$"),
    ("generated", r"\.pb(\.gw|\.validate)?\.(go|cc|h|c|swift|dart)$|_pb2(_grpc)?\.pyi?$|_grpc\.pb\.go$"),
    ("generated", r"\.snap$"),
)

#: Phrases of generation notices in five languages, lower case.
NOTICES = (
    "@generated",
    "auto-generated",
    "autogenerated",
    "automatically generated",
    "code generated by",
    "generated by",
    "generated from",
    "generated using",
    "generated with",
    "generated file",
    "generated code",
    "machine generated",
    "machine made",
    "machine-generated",
    "changes will be lost",
    "changes will be overwritten",
    "signedsource<<",
    "do not edit this file",
    "do not edit manually",
    "do not modify this file",
    "automatisch erzeugt",
    "automatisch generiert",
    "maschinell erzeugt",
    "erzeugt mit",
    "generiert von",
    "généré par",
    "générée par",
    "généré automatiquement",
    "fichier généré",
    "généré avec",
    "archivo generado",
    "generado por",
    "generado con",
    "generado automáticamente",
    "código generado",
    "gerado por",
    "gerado automaticamente",
)

#: Phrases of them that speak of anything, unless the file is their subject.
OF_ANYTHING = frozenset(("generated by", "generated from", "generated using", "generated with", "erzeugt mit", "generiert von", "généré par", "générée par", "généré avec", "generado por", "generado con", "gerado por", "machine made"))
#: Words that may stand before such a phrase in its clause when the file is the subject, lower case.
SUBJECTS = frozenset(
    "this these the a an it all file files code source sources class classes module modules document script output content contents header bindings stub stubs client types test tests "
    "is was were are been being has have had auto automatically machine partially fully originally please note notice warning attention caution do not edit modify manually by hand and or "
    "diese dieser dieses die der das datei quelltext code ist wurde wird automatisch maschinell "
    "ce cette ces le la les fichier source est a été automatiquement este esta estos el los archivo código fuente fue es ha sido está automáticamente o arquivo foi é automaticamente".split()
)
_CLAUSE = re.compile(r"[.!?;:|–—(\[]+(?:\s|$)")
_WORD = re.compile(r"[^\W\d_]+")

#: Phrases that mark a copy of another project's file, lower case.
COPIES = ("@preserve", "@license", "copied unchanged", "copied verbatim", "vendored from", "imported from upstream", "do not patch, upstream", "/*!", "/**")

#: Phrases that take a notice back.
VETOES = ("rewritten by hand", "written by hand", "not generated", "no longer generated", "not auto", "maintained by hand")

#: A library banner: a name and a version number, mostly with a licence or an address.
_BANNER = re.compile(r"^/\*[*!]\s*(?:@license\s+)?[@\w./-]+[\s,-]*(?:v|version\s*)\d+(?:\.\d+)+", re.IGNORECASE)
_COMMENT = re.compile(r"^(?://|#|/\*|\*|--|<!--|;|%|\"\"\"|'''|@|\(\*|\{-|'|REM\b)")
_REMARK = re.compile(r"^\s*(?://|#|--|;)\s")
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)")

#: Extensions of files whose content can be code that is minified or data that is saved as code.
_CODE = re.compile(r"\.(js|mjs|cjs|jsx|ts|tsx|css|py|java|kt|kts|go|rb|rs|c|cc|cpp|h|hpp|cs|swift|php|scala|dart|lua|pl|sql)$")
_NUMBERS = re.compile(r"^[\s\[\](){},;+-]*(?:-?(?:0x[0-9a-f]+|\d+(?:\.\d+)?(?:e[+-]?\d+)?)[\s\])}]*[,;][\s\[({]*){6,}(?:-?(?:0x[0-9a-f]+|\d+(?:\.\d+)?))?[\s\])},;+]*$", re.IGNORECASE)
_BLOB = re.compile(r"^[\s+(,\[]*[bru]?([\"'`])(?:[A-Za-z0-9+/=_-]{40,}|(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}){6,})\1[\s+,;)\]]*$")

#: Literals of data behind other code, and runs of numbers there.
_LITERAL = re.compile(r"([\"'`])(?:(?P<text>[A-Za-z0-9+/=_-]{40,}+)|(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}){6,}+)\1")
_RUN = re.compile(r"(?:(?<![\w.])-?(?:0x[0-9a-f]++|\d++(?:\.\d++)?(?:e[+-]?\d++)?)[\s\])}]*+[,;][\s\[({]*+){16,}+", re.IGNORECASE)
#: Comments over several lines: start, end, and the files that have them (null for any).
_BLOCKS = (
    (re.compile(r"/\*"), "*/", None),
    (re.compile(r"<!--"), "-->", None),
    (re.compile(r"[rRuU]?\"\"\""), '"""', None),
    (re.compile(r"[rRuU]?'''"), "'''", None),
    (re.compile(r"\(\*"), "*)", re.compile(r"\.(mli?|fsi?|pas|v|thy|sml)$")),
    (re.compile(r"\{-"), "-}", re.compile(r"\.(l?hs|elm|purs|agda)$")),
    (re.compile(r"--\[\["), "]]", re.compile(r"\.lua$")),
    (re.compile(r"=begin\b"), "=end", re.compile(r"\.rb$")),
)
#: Lines that may stand above or within the comments at the head of a file.
_PREAMBLE = re.compile(r"<\?(?:php|xml)\b|<!doctype|[\"']use strict[\"'];?$|package\s+[\w.]+;?$|---$", re.IGNORECASE)

#: Where a first hunk may start, and the lines whose comments count although code stands above them.
HEADER_LINES = 12
MINIFIED_LINE = 160
SHARE = 0.5
#: Data counts in so many lines of its own, or so many characters anywhere (longer than hashes and keys).
DATA_LINES, DATA_CHARACTERS = 4, 256


def normal_path(path: Column) -> Column:
    """Lower case, forward slashes, without ``./`` in front."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(path)), r"\\", "/"), r"^(\./)+", "")


def path_class(path: Column) -> Column:
    """Class by path rules alone, or null."""
    normal = normal_path(path)
    out = F.lit(None).cast("string")
    rules = [("vendored", (normal.rlike(r"(^|/)vendor/")) & ~normal.rlike(_SOURCE_ROOT)), *((k, normal.rlike(rule)) for k, rule in PATH_RULES)]
    for kind, hit in reversed(rules):
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for kind, phrases in (("generated", NOTICES), ("vendored", COPIES), ("veto", VETOES)):
        for phrase in phrases:
            auto.add_word(phrase, (kind, phrase))
    auto.make_automaton()
    return auto


def _deleted(lines: list[str]) -> bool:
    """Whether nothing is left on the new side."""
    return not any(x and x[0] not in "-\\" and not x.startswith("@@") for x in lines)


def _header(lines: list[str], path: str = "") -> Iterator[str]:
    """The comment lines at the head of the new file (the old one of a deleted file), in a
    first hunk that starts near the top: all of the leading comments, and those among the
    first lines."""
    gone = _deleted(lines)
    seen, leading, until, no = False, True, "", 0
    for line in lines:
        if line.startswith("@@"):
            m = _HUNK.match(line)
            if seen or (m and int(m[1]) > HEADER_LINES):
                return
            seen = True
            continue
        if line.startswith("\\") or line.startswith("-") != gone:
            continue
        no += 1
        text = line[1:].strip()
        if not leading and no > HEADER_LINES:
            return
        if until:
            yield text
            until = "" if until in text else until
            continue
        for start, stop, kinds in _BLOCKS:
            if (m := start.match(text)) and (kinds is None or kinds.search(path)):
                until = "" if stop in text[m.end() :] else stop
                yield text
                break
        else:
            if _COMMENT.match(text):
                yield text
            elif text and not _PREAMBLE.match(text):
                leading = False


def _of_file(before: str) -> bool:
    """Whether the clause that ends with ``before`` can have the file as its subject."""
    return all(w in SUBJECTS for w in _WORD.findall(_CLAUSE.split(before)[-1]))


def notice_class(lines: list[str], path: str = "") -> str | None:
    """Class by the notices in comments of the file's head, or null."""
    auto = _automaton()
    for line in _header(lines, path):
        low = line.lower()
        hits = [v for at, v in auto.iter(low) if v[1] not in OF_ANYTHING or _of_file(low[: at + 1 - len(v[1])])]
        if any(kind == "veto" for kind, _ in hits):
            continue
        if any(kind == "generated" for kind, _ in hits):
            return "generated"
        if any(kind == "vendored" and phrase not in ("/*!", "/**") for kind, phrase in hits) or (hits and _BANNER.match(line)):
            return "vendored"
    return None


def _random(literal: str | None) -> bool:
    """Letters of both cases and digits, or hexadecimal digits alone; not paths and names. Escapes always are."""
    if literal is None:
        return True
    digits = any(c.isdigit() for c in literal)
    return digits and ((literal.lower() != literal and literal.upper() != literal) or not literal.lower().strip("0123456789abcdef"))


def _inner_data(line: str) -> int:
    """Characters of data literals and runs of numbers within a line."""
    n = sum(len(m[0]) for m in _LITERAL.finditer(line) if _random(m["text"]))
    return n + (sum(len(m[0]) for m in _RUN.finditer(line)) if line.count(",") + line.count(";") >= 16 else 0)


def shape_class(path: str, lines: list[str]) -> str | None:
    """Class by the shape of all lines but remarks, of the new side (the old one of a deleted file), or null."""
    if not _CODE.search(path):
        return None
    gone = _deleted(lines)
    code = [x[1:] for x in lines if not x.startswith(("@@", "\\")) and x.startswith("-") == gone]
    total = dense = data = rows = 0
    for line in code:
        if _REMARK.match(line):
            continue
        n = len(line)
        total += n
        inner = _inner_data(line) if n >= 24 else 0
        if inner >= SHARE * n:
            data += inner
            rows += bool(_NUMBERS.match(line) or _BLOB.match(line))
        elif n >= MINIFIED_LINE and sum(map(line.count, " \t")) < 0.12 * n and sum(map(line.count, "{};(),=:")) > 0.08 * n:
            dense += n
        elif n >= 16 and (_NUMBERS.match(line) or _BLOB.match(line)):
            data += n
            rows += 1
    if total and dense >= SHARE * total:
        return "minified"
    if (rows >= DATA_LINES or data >= DATA_CHARACTERS) and data >= SHARE * total:
        return "data"
    return None


def content_class(path: str, patch: str) -> str | None:
    lines = patch.replace("\r\n", "\n").split("\n")
    return notice_class(lines, path) or shape_class(path, lines)


@F.pandas_udf(T.StringType())
def _content_class(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for paths, patches in batches:
        yield pd.Series([None if patch is None else content_class(path or "", patch) for path, patch in zip(paths, patches)], dtype=object)


def classify_files(df: DataFrame, path: str = "file_path", patch: str = "patch", into: str = "file_class") -> DataFrame:
    """``df`` with a column ``into``: ``generated``, ``lockfile``, ``minified``,
    ``vendored``, ``data``, ``hand_written``, or ``no_patch``.

    A null patch is ``no_patch`` whatever the path says; an empty one is judged by
    its path. A null path leaves only the content to judge by. Repeated rows get the
    same class; an empty table stays empty; a column named ``into`` is replaced.
    Texts of any length are read whole.
    """
    ship(df.sparkSession)
    by_path, rest = fresh(df.columns, "by_path", "by_content")
    kinds = df.withColumn(by_path, path_class(F.col(path)))
    undecided = F.when(F.col(by_path).isNull(), F.col(patch))
    kinds = kinds.withColumn(rest, _content_class(F.coalesce(normal_path(F.col(path)), F.lit("")), undecided))
    label = F.when(F.col(patch).isNull(), "no_patch").otherwise(F.coalesce(by_path, rest, F.lit("hand_written")))
    return kinds.withColumn(into, label).drop(by_path, rest)


def hand_written(df: DataFrame, **columns: str) -> DataFrame:
    """The rows of hand-written files, columns as they are."""
    (kind,) = fresh(df.columns, "file_class")
    return classify_files(df, into=kind, **columns).where(F.col(kind) == "hand_written").drop(kind)


#: Classes that count as not written by hand.
FOUND = ("generated", "lockfile", "minified", "vendored", "data")
