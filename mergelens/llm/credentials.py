"""Problem 4: credentials in source code and diffs, found by lexing and redacted in place.

An automaton names the lines with a trigger word or token prefix. Such a line is cut
into strings, comments, names, numbers and operators (``lexer``); a literal counts when
it is assigned to an identifier named like a credential, stands beside one in a map, or
is passed to it or under its name in a call, on this line or the ones that go on with
it; inside comments and strings the same is looked for again. Besides, a literal counts
when it has the form of a known kind of token, or stands as the secret part of a URL, a
header, a command or a remark. Placeholders, references to a value kept elsewhere,
hashes, ids and public keys never count. Only the characters of the value are replaced,
so quotes, escapes, signs and line ends around it stay.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelens.llm.lexer import COMMENT, NAME, NUMBER, OPERATOR, STRING, Lines, Token, tokens
from mergelens.session import fresh, ship

MASK = "REDACTED"

#: Forms of tokens that name their own kind.
TOKEN_FORMS = (
    r"gh[opsur]_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"glpat-[A-Za-z0-9_-]{16,}",
    r"[a-z]{2,10}[-_]pat[._-][A-Za-z0-9]{16,}",
    r"[srp]k_(?:live|test|prod)_[A-Za-z0-9]{12,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{12,}",
    r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"ya29\.[A-Za-z0-9_-]{20,}",
    r"npm_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_-]{30,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"dop_v1_[0-9a-f]{40,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(TOKEN_FORMS) + r")(?![A-Za-z0-9_])")
_TOKEN_HEAD = re.compile(r"(?:gh[opsur]_|github_pat_|glpat-|[a-z]{2,10}[-_]pat[._-]|[srp]k_(?:live|test|prod)_|xox[abeoprs]-|AKIA|ASIA|AIza|npm_|hf_|eyJ)[A-Za-z0-9_.-]*$")

#: Words in identifiers that name a credential.
NAME_WORDS = ("password", "passwd", "passw", "passphrase", "passcode", "pwd", "secret", "token", "credential")
#: Kinds of keys, and of passes, that name a credential together with that word.
KEY_KINDS = ("api", "access", "secret", "private", "signing", "encryption", "master", "auth", "account", "shared", "service", "deploy", "client", "storage", "hmac", "jwt")
PASS_KINDS = ("db", "user", "admin", "root", "smtp", "ftp", "redis", "mysql", "ssh", "my")
#: Remarks in which a key is named in prose.
KEY_AGES = ("old", "new", "current", "temp", "test", "live", "prod", "staging", "spare", "backup")
_NAME_PART = (
    "(?:"
    + "|".join(NAME_WORDS)
    + r"|(?:"
    + "|".join(KEY_KINDS)
    + r")[_.-]?key|(?:"
    + "|".join(PASS_KINDS)
    + r")[_.-]?pass(?![a-z])|(?<![a-z])creds?(?![a-z])|(?<![a-z])pass(?![a-z])|(?<![a-z])pw(?![a-z])|(?<![a-z])auth(?![a-z]))"
)
_NAMED = re.compile(_NAME_PART, re.IGNORECASE)
#: Ends of identifiers that only speak about a credential.
_ABOUT = re.compile(
    r"(?:name|names|file|path|dir|url|uri|endpoint|field|input|label|hint|prompt|placeholder|pattern|regex|format|length|len|min|max|size|count|limit|ttl|expiry|expires|expiration|timeout|age|type|kind|class|provider|manager|service|store|policy|rules?|repeat|confirm|confirmation|ref|reference|arn|id|ids|hash|hashed|digest|fingerprint|header|enabled|required|version|source|parser|tokenizer|tokenizers|index|column|param|parameter|error|message|strength|rotation|reset|alias)$",
    re.IGNORECASE,
)
#: A value without quotes behind ``=`` or ``:``, up to white space or a separator.
_BARE = re.compile(r"\s*(?P<val>[^\s\"'`;,&]+)")
#: The rest of a remark, or of a setting of an image, that is one name and its value.
_LAST = re.compile(r"\s+(?P<val>[^\s\"'`;,]+)\s*$")
#: An element named like a credential, in markup.
_ELEMENT = re.compile(r">\s*(?P<val>[^<>\s]+)\s*</")
_NAME_KEY = re.compile(r"[A-Za-z0-9_$.:/ -]+")
_HEADER_NAMES = frozenset(("x-auth", "x-api-key", "private-token", "authorization", "proxy-authorization"))
#: Operators that give a value to what stands before them.
_ASSIGNS = frozenset(("=", ":=", "=>", ":", "?=", "||=", "??="))
_PAIRS = {")": "(", "]": "[", "}": "{"}
_READS = re.compile(r"(?:get|read|fetch|load|find|lookup|resolve|decode|parse|check|is|has|validate|verify|show|print|log|warn|error|env|render|describe|expect|test)", re.IGNORECASE)
_HEADER = re.compile(r"(?:authorization|x-auth|x-api-key|private-token|x-auth-token)[\"']?\s*[:,=]\s*[\"']?(?:(?P<kind>bearer|basic|token|digest|apikey)\s+)(?P<val>[A-Za-z0-9._~+/=-]{8,})", re.IGNORECASE)
_BEARER = re.compile(r"(?<=[\"'])(?P<kind>bearer|basic)\s+(?P<val>[A-Za-z0-9._~+/=-]{8,})[\"']", re.IGNORECASE)
_URL = re.compile(r"://(?P<user>[^\s/:@\"'<>]*):(?P<val>[^\s/@\"'<>]+)@[A-Za-z0-9\[]")
#: Commands by their first words; each option is searched for once, up to the end of the line.
_PROGRAMS = (
    (("docker", "podman", "helm", "oc", "az", "npm", "buildah", "skopeo"), re.compile(r"\blogin\b"), re.compile(r"\s(?:-p|--password)[\s=]+[\"']?(?P<val>[^\s\"']+)")),
    (("mysql", "mysqldump", "mysqladmin", "mariadb"), None, re.compile(r"\s(?:-p|--password=)[\"']?(?P<val>[^\s\"']{4,})")),
    (("curl", "wget"), None, re.compile(r"\s(?:-u|--user|--auth)[\s=]++[\"']?[^\s:\"']++:(?P<val>[^\s\"']+)")),
    (("login", "log in", "log\tin"), None, re.compile(r"(?<=\s)[^\s/]++\s*+/\s*+(?P<val>\S+)")),
)
#: The last of them is a remark of a name and a password.
_LOGIN = len(_PROGRAMS) - 1
_OPTIONS = ("--password", "--token", "--secret", "--api-key", "--access-token", "--client-secret")
#: Commands by their first words, matched from there on.
_COMMANDS = (
    (("sshpass",), re.compile(r"sshpass\s+-p\s*[\"']?(?P<val>[^\s\"']+)")),
    (_OPTIONS, re.compile(r"(?:" + "|".join(_OPTIONS) + r")(?:=|\s+)[\"']?(?P<val>[^\s\"']+)")),
    (("machine",), re.compile(r"machine\s+\S+\s+login\s+\S+\s+password\s+(?P<val>\S+)")),
    (("identified",), re.compile(r"identified\s+(?:with\s+\S+\s+)?by\s+(?P<q>[\"'])(?P<val>(?:\\.|(?!(?P=q))[^\\])*+)(?P=q)", re.IGNORECASE)),
    (("password",), re.compile(r"password\s+'(?P<val>[^']+)'", re.IGNORECASE)),
)
#: First words of remarks.
REMARK_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "pw", "secret", "token", "credentials", "credential")
REMARK_KINDS = (*KEY_AGES, "api", "access", "secret", "shared", "master")
#: Remarks by their first words, matched from there on.
_REMARKS = (
    (REMARK_WORDS, re.compile(r"\b(?:" + "|".join(REMARK_WORDS) + r")\b(?:\s+(?:for|of|on)\s+\S+)?\s*(?:(?:is|was|are|->|=>|=|:)\s*)+[\"'`]?(?P<val>[^\s\"'`,;]+)", re.IGNORECASE)),
    (REMARK_KINDS, re.compile(r"\b(?:" + "|".join(REMARK_KINDS) + r")\s+(?:key|token|secret|password|pw|pass)\b\s*(?:is|was|:|=)?\s*[\"'`]?(?P<val>[^\s\"'`,;]+)", re.IGNORECASE)),
)
_REMARK_LINE = re.compile(r"\s*(?:--|#|//|;|/?\*|%|>|<!--|[-*] |\d+\. |[A-Z])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/=]{12,}|[A-Za-z-]+: .*|")
_LITERAL = re.compile(r"(?P<q>\"\"\"|[\"'`])(?P<val>(?:\\.|(?!(?P=q))[^\\])*+)(?P=q)")
_JOINED = re.compile(r"\s*(?:\+|\.\.|\.concat\(|\.plus\(|&|\|\||\.)\s*")

_PLACE = re.compile(
    r"^(?:[x*.?#_-]{3,}|(.)\1{5,}|.*(?:\$\{|\{\{|\$\(|#\{|%\(|@\{|<%|%[sdv]\b).*|<.*>|\[.*\]|\$\w+|%\w+%|\{\w+\})$",
    re.IGNORECASE,
)
#: Words of placeholders; those of LOOSE may also be glued to further words by a change of case.
LOOSE = ("your", "insert", "replace", "change", "enter", "dummy", "sample", "example", "test", "fake", "redacted", "hidden", "masked", "removed", "undefined", "placeholder", "default", "secret", "password", "passwd", "token")
TIGHT = ("todo", "the", "any", "an", "a", "my", "put", "add", "set", "some", "fixme", "tbd", "none", "null", "nil", "true", "false", "key", "value", "here", "me", "it", "this", "into", "in", "to", "by", "with", "from", "api", "access", "auth")
#: A placeholder's word up to its end and any letters after it, or nothing but such words.
_WORDS = re.compile(
    rf"^(?:(?i:{'|'.join((*LOOSE, *TIGHT))}|xxx+)(?:[\s_.-][A-Za-z\s_.-]*)?|(?i:{'|'.join(LOOSE)})(?<=[a-z])(?=[A-Z])[A-Za-z\s_.-]*|(?i:(?:(?:{'|'.join((*LOOSE, *TIGHT))}|xxx+)[\s_.-]*)++))$"
)
_REFER = re.compile(r"^(?:file|vault|kms|arn|env|ssm|asm|secretsmanager|secretmanager|op|gcp|gcpkms|aws|awskms|azure|keyvault|akv|sops|keyring|keychain|secret|secrets|ref|refs|k8s|kubernetes|config|configmap|projects|parameter|consul|doppler|infisical|bitwarden|pass)[:/]|^(?:https?|ftp)://[^@]*$|^(?:process\.env|os\.environ|System\.getenv|ENV\b|env\.|config\.|settings\.|secrets?\.|vars?\.|params?\.|args?\.|self\.|this\.)", re.IGNORECASE)
_PATH = re.compile(r"^(?:~|\.{1,2})?/?(?:[\w.-]+/)+[\w.-]*$")
_UUID = re.compile(r"^[{(]?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}[)}]?$", re.IGNORECASE)
_HASHED = re.compile(r"^(?:(?:sha\d*|md5|blake\w*|bcrypt|argon2\w*|pbkdf2\w*|scrypt)[-:$]|\$(?:2[aby]|argon2\w*|[156]|y|pbkdf2\S*)\$|\{(?:s?sha\d*|ssha|bcrypt|noop)\})", re.IGNORECASE)
_CODE = re.compile(r"^(?:[A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*\s*[(\[].*|[A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)+[;,)]*|(?:function|lambda|new|await|async|return|str|string|int|bool|any|bytes|Optional|List|Dict)\b.*)$")
_PUBLIC = re.compile(r"^(?:ssh-(?:rsa|ed25519|dss)|ecdsa-|pk_(?:live|test)_|AAAA[BCE])")


def _mixed(v: str) -> bool:
    """Letters whose case jumps about as in random text, not as in identifiers."""
    pairs = [(a, b) for a, b in zip(v, v[1:]) if a.isalpha() and b.isalpha()]
    return len(pairs) >= 7 and sum(a.islower() != b.islower() for a, b in pairs) > 0.4 * len(pairs)


def given(value: str, shortest: int = 6) -> bool:
    """Whether a value that stands where only a credential can isn't a placeholder, reference, hash, id or public key."""
    v = value.strip().rstrip("\r")
    if len(v) < shortest or any(c.isspace() for c in v):
        return False
    if _PLACE.match(v) or _WORDS.match(v) or _REFER.search(v) or _UUID.match(v) or _HASHED.match(v) or _PUBLIC.match(v):
        return False
    return any(c.isalpha() for c in v) and len(set(v)) >= 4


def live(value: str, shortest: int = 6) -> bool:
    """Whether a literal can be a credential's value: ``given``, and neither a word nor a path."""
    v = value.strip().rstrip("\r")
    if not given(v, shortest):
        return False
    digits, marks = any(c.isdigit() for c in v), any(c in "!@#$%^&*+?~=|" for c in v)
    if _PATH.match(v) and "/" in v and not (marks or (digits and _mixed(v))):
        return False
    return digits or marks or _mixed(v)


#: Identifiers of what people choose, which can be any text. Tokens and keys are made by machines.
_CHOSEN = re.compile(r"passw|passphrase|passcode|pwd|secret(?![a-z_.-]*key)|(?:" + "|".join(PASS_KINDS) + r")[_.-]?pass(?![a-z])|(?<![a-z])pw(?![a-z])", re.IGNORECASE)
#: Numbers of tokens.
_AMOUNT = re.compile(r"tokens$|^(?:max|min|num|total|count|limit)", re.IGNORECASE)
#: Words of names, labels and messages about a credential, and types of a field.
_SPEAKS = re.compile(r"passwor[dt]|passwd|passphrase|secret|token|credential|kennwort|(?<![a-z])key(?![a-z])", re.IGNORECASE)
_TYPES = re.compile(r"(?:string|str|text|varchar|char|number|integer|int|boolean|bool|object|required|optional|include|omit|same-origin|basic|bearer|digest)", re.IGNORECASE)
#: Words that sentences have and passphrases of random words don't.
_SENTENCE = re.compile(r"(?<!\w)(?:the|an?|is|are|was|be|must|should|can|cannot|not|no|please|enter|with|without|for|from|of|or|and|to|your|you|we|this|that|at|least|invalid|wrong|missing|required|failed|der|die|das|ist|bitte|oder|und|le|la|les|est|el|los|es|por|favor)(?!\w)", re.IGNORECASE)
_SETS = re.compile(r"(?:put|set|add|append|with|header|param|parameter|property|option|config|env|define|field|entry|pair)", re.IGNORECASE)


def assigned(value: str, name: str) -> bool:
    """Whether a quoted literal given to an identifier named like a credential is its value.

    What people choose may be any text that isn't a placeholder, reference, hash, id,
    path, or words about a credential. Tokens and keys must look made by a machine, as
    in ``live``, since words are also given to tokens of languages and keys of tables;
    but they may be all digits."""
    v = value.strip()
    if live(value):
        return True
    if not any(c.isalnum() for c in v) or _PLACE.match(v) or _WORDS.match(v) or _REFER.search(v) or _UUID.match(v) or _HASHED.match(v) or _PUBLIC.match(v):
        return False
    if not _CHOSEN.search(name):
        return len(v) >= 6 and v.isdigit() and not _AMOUNT.search(name)
    if any(c.isspace() for c in v) and _SENTENCE.search(v):
        return False
    if _TYPES.fullmatch(v) or (_SPEAKS.search(v) and not any(c.isdigit() for c in v)):
        return False
    return not (_PATH.match(v) and "/" in v)


def _decoded(value: str) -> str | None:
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None


def _basic(value: str) -> bool:
    """Base64 of user:password with a live password."""
    plain = _decoded(value)
    if plain is None or ":" not in plain:
        return False
    secret = plain.split(":", 1)[1]
    return len(secret) >= 4 and not _PLACE.match(secret) and not _WORDS.match(secret)


def _chain(text: str, at: int, end: int) -> list[tuple[int, int, str]]:
    """The literal at ``at`` and those joined to it: (start, end, text) of the contents."""
    out: list[tuple[int, int, str]] = []
    while m := _LITERAL.match(text, at, end):
        out.append((m.start("val"), m.end("val"), m["val"]))
        join = _JOINED.match(text, m.end(), end)
        if not join:
            break
        at = join.end()
    return out


#: Words that start a lexing, by what is tried there.
_STARTS = {
    "name": [*NAME_WORDS, *(f"{k}{sep}key" for k in KEY_KINDS for sep in ("", "_", "-", ".")), *(f"{k}{sep}pass" for k in PASS_KINDS for sep in ("", "_", "-", ".")), "cred", "pass", "pw", "auth"],
    "form": [
        *(f"gh{c}_" for c in "opsur"), "github_pat_", "glpat-", *(f"{a}pat{b}" for a in "-_" for b in "._-"), *(f"{c}k_{k}_" for c in "sr" for k in ("live", "test", "prod")), *(f"xox{c}-" for c in "abeoprs"),
        "akia", "asia", "aroa", "aida", "aiza", "ya29.", "npm_", "pypi-", "hf_", "dop_v1_", "sg.", "eyj",
    ],
    "url": ["://"],
    "pem": ["-----begin "],
    "header": ["authorization", "proxy-authorization", "x-auth", "x-api-key", "private-token", "bearer", "basic"],
    "program": [w for words, _, _ in _PROGRAMS for w in words],
    "command": [w for words, _ in _COMMANDS for w in words],
    "remark": [w for words, _ in _REMARKS for w in words],
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    kinds: dict[str, list[str]] = {}
    for kind, words in _STARTS.items():
        for word in words:
            kinds.setdefault(word, []).append(kind)
    auto = ahocorasick.Automaton()
    for word, own in kinds.items():
        auto.add_word(word, (len(word), tuple(own)))
    auto.make_automaton()
    return auto


def _name_start(text: str, at: int, low: int) -> int:
    while at > low and (text[at - 1].isalnum() or text[at - 1] in "_.$-"):
        at -= 1
    return at


def _token_at(text: str, at: int, begin: int, end: int) -> list[tuple[int, int]]:
    """A token of a known form that starts at ``at`` (or has it in its head), in one or several literals."""
    first = _name_start(text, at, max(begin, at - 16))
    for start in dict.fromkeys((at, first)):
        m = _TOKEN.match(text, start, end)
        if m and len(set(m[0][6:])) > 4 and not _PLACE.match(m[0]):
            return [m.span()]
    if first > begin and text[first - 1] in "\"'`":
        parts = _chain(text, first - 1, end)
        if len(parts) > 1 and _TOKEN_HEAD.match(parts[0][2]) and _TOKEN.match("".join(p[2] for p in parts)):
            return [p[:2] for p in parts]
    return []


@lru_cache(maxsize=65536)
def _credential(name: str) -> bool:
    """Whether an identifier names a credential by its last part, and not something about one."""
    last = name.rfind(".")
    return any(m.end() > last + 1 for m in _NAMED.finditer(name)) and not _ABOUT.search(name)


class _Open:
    """An open bracket: what is called or assigned by it, and the argument before the current one if it is one word or literal."""

    __slots__ = ("callee", "target", "key", "first", "count")

    def __init__(self, callee: str, target: tuple[str, int] | None) -> None:
        self.callee, self.target = callee, target
        self.key, self.first, self.count = None, None, 0


class _Reader:
    """Reads the tokens of one line, and of those that go on with it, for literals given to identifiers named like credentials."""

    def __init__(self, text: str, found: list[Token], end: int, more: Iterator[list[Token]] = iter(()), hits: list[int] = (), within: str | None = None) -> None:
        self.text, self.found, self.end, self.more, self.hits, self.within = text, found, end, more, hits, within
        self.own = len(found)  # tokens of the line itself
        self.spans: list[tuple[int, int]] = []
        self.stack: list[_Open] = []

    def pull(self) -> bool:
        """Adds the tokens of the next line."""
        for new in self.more:
            self.found = [*self.found, *new]
            return True
        return False

    def at(self, i: int) -> Token | None:
        return self.found[i] if 0 <= i < len(self.found) else None

    def left(self, i: int) -> tuple[str, int] | None:
        """The identifier or key that the operator at ``i`` gives a value to, and where it starts."""
        op, j = self.found[i].text, i - 1
        t = self.at(j)
        if t is None:
            return None
        if t.kind == STRING:
            return (t.text, t.low) if _NAME_KEY.fullmatch(t.text) else None
        if op == ":" and t.text == "?":
            j, t = j - 1, self.at(j - 1)
        if t is not None and t.text == "]" and op != ":":
            if (key := self.at(j - 1)) and key.kind == STRING and (o := self.at(j - 2)) and o.text == "[":
                return key.text, key.low
            if key and key.text == "[" and (t := self.at(j - 2)):
                j -= 2
        if t is None or (t.kind == NAME and (op == ":" or _credential(t.text))):
            return (t.text, t.start) if t else None
        while (t := self.at(j)) and (t.kind == NAME or t.text in "<>[]?|,.*&"):
            j -= 1
        if t and t.text == ":" and (t := self.at(j - 1)) and t.kind in (NAME, STRING):
            return t.text, t.low
        return None

    def chain(self, i: int, grouped: bool) -> tuple[list[Token], int]:
        """The literal at ``i`` with those joined to it, and the index behind them."""
        parts, k = [self.found[i]], i + 1
        while True:
            if k >= len(self.found) and grouped and not self.pull():
                break
            t = self.at(k)
            if t is None:
                break
            if t.kind == STRING and grouped:
                parts, k = [*parts, t], k + 1
                continue
            if t.kind != OPERATOR or t.text not in ("+", ".", "&", "||", "\\"):
                break
            n, called = k + 1, False
            while (x := self.at(n)) and x.text in (".", "concat", "plus", "("):
                called |= x.text == "("
                n += 1
            if n >= len(self.found) and t.text != "." and not self.pull():
                break
            x = self.at(n)
            if x is None or x.kind != STRING:
                break
            parts, k = [*parts, x], n + 1
            if called and (x := self.at(k)) and x.text == ")":
                k += 1
        return parts, k

    def bare(self, target: tuple[str, int], i: int) -> int:
        """Looks at a value without quotes behind the operator at ``i``; gives the index behind it."""
        name, start = target
        m = _BARE.match(self.text, self.found[i].end, self.end)
        if not m:
            return i + 1
        v = m["val"]
        sure = start > 0 and self.text[start - 1] in "?&;"  # a field of an address or connection string
        fits = given(v) if sure else live(v, 4 if _CHOSEN.search(name) and not v.isdigit() else 8)
        if fits and not _CODE.match(v) and not v.startswith(("http://", "https://", "//")):
            self.spans.append(m.span("val"))
            i += 1
            while (t := self.at(i)) and t.start < m.end("val"):
                i += 1
            return i
        return i + 1

    def passed(self, i: int) -> str | None:
        """The name under which the literal at ``i`` is passed, by the callee or the argument before it; an empty one for headers."""
        if not self.stack or i == 0 or self.found[i - 1].text not in "([{,":
            return None
        own = self.stack[-1]
        last = own.callee.rpartition(".")[2]
        if own.callee and _credential(own.callee) and not _READS.match(last):
            return own.callee
        if self.found[i - 1].text == "," and own.key is not None:
            if own.key.lower() in _HEADER_NAMES:
                return ""
            if _NAME_KEY.fullmatch(own.key) and _credential(own.key):
                return own.key
        return None

    def fits(self, whole: str, name: str, first: bool) -> bool:
        own = self.stack[-1]
        if not name:
            return live(whole, 8)
        last = own.callee.rpartition(".")[2]
        # a call may look a value up by its name, and a second text may be one more name of a list
        free = ("secret" not in name.lower() and (first or _SETS.search(last))) if name == own.callee else bool(_SETS.search(last))
        return assigned(whole, name) if free else live(whole)

    def read(self) -> list[tuple[int, int]]:
        i, target, asked = 0, None, False
        while True:
            if i >= len(self.found):
                last = self.found[-1].text if self.found else ""
                goes_on = target is not None or (last in ("(", ",") and any(o.target or (o.callee and _credential(o.callee)) or (o.key and _credential(o.key)) for o in self.stack))
                if not (goes_on and self.pull()):
                    return self.spans
                continue
            t = self.found[i]
            if self.stack and t.text not in (")", "]", "}", ","):
                own = self.stack[-1]
                own.count += 1
                own.first = t if own.count == 1 else own.first
            if t.kind == STRING:
                i, target = self.string(i, target), None
            elif t.kind == COMMENT:
                self.inner(t)
                i += 1
            elif t.kind == NAME:
                i, target = self.name(i), None
            elif t.kind == NUMBER:
                i, target = i + 1, None
            elif t.text in _ASSIGNS:
                target = None if asked and t.text == ":" else self.left(i)
                target = target if target and _credential(target[0]) else None
                i = self.value(i, target) if target else i + 1
                if target and self.at(i - 1) is not t:
                    target = None
            elif t.text in "([{":
                before = self.at(i - 1)
                callee = before.text if t.text == "(" and target is None and before and before.kind == NAME and before.end == t.start else ""
                self.stack.append(_Open(callee, target if t.text == "(" else None))
                target, asked, i = target if t.text == "(" else None, False, i + 1
            elif t.text in _PAIRS:
                if self.stack:
                    self.stack.pop()
                target, asked, i = None, False, i + 1
            else:
                if t.text in (",", ";"):
                    asked = False
                    if self.stack:
                        own = self.stack[-1]
                        own.key, own.count = (own.first.text if own.count == 1 and own.first.kind in (NAME, STRING) else None), 0
                asked |= t.text == "?"
                target = target if t.text == "\\" else None
                i += 1

    def value(self, i: int, target: tuple[str, int]) -> int:
        """What stands behind an assignment at ``i``: a bare value is read at once, literals and brackets later."""
        nxt = self.at(i + 1)
        if nxt is None or nxt.start >= self.end:
            return i + 1
        if nxt.text in ("|", ">") and self.found[i].text == ":" and self.text[nxt.end : self.end].strip(" -+0123456789") == "":
            self.found = self.found[: i + 1]
            if self.pull() and self.found[i + 1].kind == STRING:
                return self.string(i + 1, target)
            if len(self.found) > i + 1:
                low = self.found[i + 1].start
                stop = self.text.find("\n", low)
                m = _BARE.match(self.text, low, len(self.text) if stop < 0 else stop)
                if m and live(m["val"], 8):
                    self.spans.append((m.start("val"), m.end("val") - m["val"].endswith("\r")))
            return len(self.found)
        if nxt.kind in (STRING, COMMENT) or nxt.text in "([{\\":
            return i + 1
        return self.bare(target, i)

    def string(self, i: int, target: tuple[str, int] | None) -> int:
        t = self.found[i]
        grouped = bool(self.stack and self.stack[-1].target)
        name = target[0] if target else self.passed(i)
        if name is None:
            self.inner(t)
            return i + 1
        parts, k = self.chain(i, grouped)
        whole = "".join(p.text for p in parts)
        ok = assigned(whole, name) or (name == "auth" and _basic(whole)) if target else self.fits(whole, name, self.found[i - 1].text == "(")
        if ok:
            self.spans += [(p.low, p.high) for p in parts]
        else:
            for p in parts:
                self.inner(p)
        return k

    def name(self, i: int) -> int:
        t = self.found[i]
        if not _credential(t.text):
            return i + 1
        before = self.at(i - 1)
        if before and before.text == "<" and (m := _ELEMENT.match(self.text, t.end, self.end)) and live(m["val"]):
            self.spans.append(m.span("val"))
        elif (i == 0 and self.within == COMMENT) or (i == 1 and before.text in ("ENV", "ARG")):
            if (m := _LAST.match(self.text, t.end, self.end)) and live(m["val"], 8) and not _CODE.match(m["val"]):
                self.spans.append(m.span("val"))
        return i + 1

    def inner(self, t: Token) -> None:
        """The same within a comment or string of the line itself."""
        at = bisect_left(self.hits, t.low)
        if at < len(self.hits) and self.hits[at] < t.high:
            inside = tokens(self.text[t.low : t.high], t.low)[0]
            if len(inside) > 1:
                self.spans += _Reader(self.text, inside, t.high, iter(()), self.hits, t.kind).read()


def _program_at(text: str, at: int, end: int, options: dict, remark: bool) -> list[tuple[int, int]]:
    """The first value of an option behind the command at ``at``. ``options`` keeps what the line has, read once."""
    spans = []
    for no, (words, through, option) in enumerate(_PROGRAMS):
        word = next((w for w in words if text.startswith(w, at) and not (text[at + len(w) : at + len(w) + 1].isalnum() or text.startswith("_", at + len(w)))), None)
        if word is None or (no == _LOGIN and not remark) or (len(word) < 3 and at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            continue
        if no not in options:
            good = (lambda v: live(v, 8) and not _PATH.match(v)) if no == _LOGIN else given
            fit = [m for m in option.finditer(text, at, end) if good(m["val"]) and not _CODE.match(m["val"])]
            options[no] = ([m.end() for m in through.finditer(text, at, end)] if through else [], [m.start() for m in fit], [m.span("val") for m in fit])
        marks, starts, values = options[no]
        low = at + len(word)
        if through:
            k = bisect_right(marks, low)
            if k == len(marks):
                continue
            low = marks[k]
        if (k := bisect_left(starts, low)) < len(starts):
            spans.append(values[k])
    return spans


def find(text: str, diff: bool = True) -> list[tuple[int, int, int]]:
    """(line number from 1, start, end) of the value of each credential, ascending.

    With ``diff`` the first character of a line may be a sign. A value over several
    lines, a private key or joined literals, has one entry for each of its parts, all
    with the number of its first line.
    """
    low = text.lower()
    if len(low) != len(text):  # some letters change length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: list[tuple[int, int, int]] = []
    lines = Lines(text, diff)
    no, seen, begin, stop = 0, 0, 0, -1  # of the current line
    hits: list[tuple[int, tuple[str, ...]]] = []
    for last, (width, kinds) in _automaton().iter(low):
        at = last - width + 1
        if at > stop:
            if hits:
                out += _line(text, lines, begin, no, hits)
                hits = []
            begin = text.rfind("\n", 0, at) + 1
            no += text.count("\n", seen, begin)
            seen = begin
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
        hits.append((at, kinds))
    if hits:
        out += _line(text, lines, begin, no, hits)
    return _merged(out)


def _line(text: str, lines: Lines, begin: int, no: int, hits: list[tuple[int, tuple[str, ...]]]) -> list[tuple[int, int, int]]:
    """Credentials that start from the line at ``begin``, the ``no``-th from 0, with triggers at ``hits``."""
    body, end, _ = lines.body(begin)
    out: list[tuple[int, int, int]] = []
    named = sorted(at for at, kinds in hits if "name" in kinds)
    if named:
        more = (lines.tokens(b) for b in lines.following(begin))
        spans = _Reader(text, lines.tokens(begin), end, more, named).read()
        spans.sort()
        first, row = 0, no
        for a, b in spans:
            if a > end and (not first or text[first:a].strip("\n\r\t +-\"'`().\\&|")):  # not joined to the part before
                row = no + text.count("\n", begin, a)
            out.append((row + 1, a, b))
            first = b
    spans, options = [], {}
    remark = bool(_REMARK_LINE.match(text, body, end))
    for at, kinds in hits:
        if at < body:
            continue
        for kind in kinds:
            if kind == "form":
                spans += _token_at(text, at, body, end)
            elif kind == "url":
                m = _URL.match(text, at, end)
                if m and not _PLACE.match(m["val"]) and not _WORDS.match(m["val"]) and "$" not in m["user"] and len(m["val"]) >= 4:
                    spans.append(m.span("val"))
            elif kind == "pem":
                if m := _PEM.match(text, at, end):
                    spans += _pem_spans(text, body, end, m.end())
            elif kind == "header":
                for pattern in (_HEADER, _BEARER):
                    m = pattern.match(text, at, end)
                    if m and (_basic(m["val"]) if m["kind"].lower() == "basic" else live(m["val"], 12)):
                        spans.append(m.span("val"))
            elif kind == "program":
                spans += _program_at(text, at, end, options, remark)
            elif kind == "command":
                for _, pattern in _COMMANDS:
                    if (m := pattern.match(text, at, end)) and given(m["val"]) and not _CODE.match(m["val"]):
                        spans.append(m.span("val"))
            elif kind == "remark" and remark:
                for _, pattern in _REMARKS:
                    if (m := pattern.match(text, at, end)) and live(m["val"], 8) and not _CODE.match(m["val"]) and not _PATH.match(m["val"]):
                        spans.append(m.span("val"))
    return out + [(no + 1, a, b) for a, b in spans]


_ONE_LINE = re.compile(r"(?:(?:\\r)?\\n|\s)+(?P<body>[A-Za-z0-9+/=](?:[A-Za-z0-9+/=]|\\[nr]|\s){14,}?)(?=(?:\\r|\\n|\s)*(?:-----END|[\"'`]|$))")


def _pem_spans(text: str, body: int, end: int, at: int) -> list[tuple[int, int]]:
    """The key material behind a BEGIN mark that ends at ``at``: within the line, or the lines that follow."""
    if m := _ONE_LINE.match(text, at, end):
        return [m.span("body")]
    if text[at:end].strip(" \"'`+,;\\nr"):
        return []
    spans = []
    while (begin := text.find("\n", end) + 1) > 0:
        end = text.find("\n", begin)
        end = len(text) if end < 0 else end
        line = text[begin:end].rstrip("\r")
        inner = line[1:] if line[:1] in ("+", "-", " ") and not line.startswith("-----") else line
        if _PEM_END.search(line) or line.startswith("@@"):
            break
        core = inner.strip().strip("\"'`+,;").replace("\\n", "").strip().strip("\"'`")
        if not _BODY.fullmatch(core):
            break
        if core:
            start = begin + line.index(core)
            spans.append((start, start + len(core)))
    return spans if sum(b - a for a, b in spans) >= 16 else []


def _merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for no, a, b in sorted(set(found), key=lambda x: (x[1], -x[2])):
        if out and a < out[-1][2]:
            if b > out[-1][2]:
                out[-1] = (out[-1][0], out[-1][1], b)
        elif a < b:
            out.append((no, a, b))
    return out


def redact(text: str, found: list[tuple[int, int, int]], mask: str = MASK) -> str:
    parts, at = [], 0
    for _, a, b in found:
        parts += [text[at:a], mask]
        at = b
    return "".join([*parts, text[at:]])


_LINES = T.ArrayType(T.IntegerType())


@F.pandas_udf(_LINES)
def _found_lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else sorted({no for no, _, _ in find(t)}) for t in texts], dtype=object)


#: A deterministic function would be run once more, in a filter on the size of its result.
_found_lines = _found_lines.asNondeterministic()


@F.pandas_udf(T.StringType())
def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else redact(t, find(t)) for t in texts], dtype=object)


def credential_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` and ``line_no``: each line, from 1, in which a credential's value starts.

    Null and empty texts give no rows; texts of any length are read whole; equal rows
    give equal rows; an empty table none.
    """
    ship(df.sparkSession)
    (lines,) = fresh(keys, "lines_")
    return df.where(F.col(text).isNotNull()).select(*keys, _found_lines(F.col(text)).alias(lines)).select(*keys, F.explode(lines).alias("line_no"))


def redact_credentials(df: DataFrame, text: str, into: str | None = None) -> DataFrame:
    """``df`` with the values of credentials in ``text`` replaced by a mask; all else
    stays, so does the number of lines. Null stays null, empty stays empty."""
    ship(df.sparkSession)
    return df.withColumn(into or text, _redacted(F.col(text)))


def kept_outside(text: Column, redacted: Column, mask: str = MASK) -> Column:
    """Whether the parts of ``redacted`` between masks stand in ``text``, in order, from its start to its end."""
    parts = F.split(redacted, mask, -1)
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"))

    def step(state: Column, part: Column) -> Column:
        found = F.call_function("locate", part, text, state["at"])
        return F.struct((found + F.length(part)).cast("int").alias("at"), (state["ok"] & (found > 0)).alias("ok"))

    inner = F.aggregate(parts, start, step)["ok"]
    return inner & F.startswith(text, F.get(parts, F.lit(0))) & F.endswith(text, F.element_at(parts, -1))


def code_texts(files: DataFrame, prompts: DataFrame) -> DataFrame:
    """``item_kind``, ``row_id`` and ``code`` of patches and prompts' diffs."""
    patch = files.select(F.lit("patch").alias("item_kind"), F.col("diff_id").alias("row_id"), F.col("patch").alias("code"))
    return patch.unionByName(prompts.select(F.lit("diff_content").alias("item_kind"), F.col("prompt_id").alias("row_id"), F.col("diff_content").alias("code")))
