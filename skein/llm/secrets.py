"""Credentials embedded in source code: found lexically, redacted without touching the code around them.

A text is read as tokens: names, string literals (triple-quoted ones, neighbours joined by + and those that stand side by
side in brackets count as one), the branches of conditional values, bare values of configuration lines, flags of command
lines, URLs and key blocks. A credential is (a) a value that is assigned or passed to a
credential-named identifier, (b) the password of a URL or of a command line's user:password, (c) a value of a provider's
own format or (d) a private key block, unless it is a placeholder or a reference. Only the contents of these literals are
masked; quotes, delimiters, line ends and escape sequences stay, so the code parses as before, and masks are placeholders,
so redacting twice changes nothing.

Rows are read one by one; nothing is grouped or gathered. Defined cases: null and empty texts have no credentials and stay
as they are; rows with a null key are read like others; copies give one row; several credentials that begin on a line give
one row; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.tables import spread

Span = tuple[int, int]

# Formats by which providers mark their own keys and tokens.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[\w-]{20,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|sk-[A-Za-z0-9_-]{32,}|ya29\.[\w-]{20,}|pypi-[\w-]{40,})"
)
# Words of names that hold credentials, words that a key needs beside it, and last words of names that do not.
_NAMES = {"password", "passwd", "pwd", "passphrase", "passcode", "secret", "secrets", "token", "credential", "credentials", "authorization", "bearer", "jwt", "auth", "apikey", "pass", "accesskey", "secretkey", "privatekey", "authtoken"}
_KEYS = {"api", "access", "secret", "private", "master", "signing", "encryption", "pay", "payment", "storage", "account", "auth", "ssh", "crypt", "crypto", "client", "service", "app", "license", "admin", "shared", "deploy", "hmac"}
_OTHER = {
    "name", "names", "url", "uri", "field", "fields", "path", "file", "host", "mode", "ttl", "size", "limit", "count", "type", "length", "input", "label", "hint", "policy", "id", "ids", "status", "error", "sum", "left", "out", "next", "seen", "data",
    "image", "kind", "format", "prefix", "suffix", "hash", "checksum", "digest", "endpoint", "provider", "store", "class", "service", "version", "expiry", "expires", "env", "var", "ref", "arn", "placeholder", "regex", "pattern", "column", "table", "role", "user", "username", "index", "text", "title", "message", "bytes", "blob", "buffer", "array", "list", "map", "set", "icon",
}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[*xX.•#?_~-]+|<.*>|\$\{.*|\$\(.*|\$\w+|\{\{.*|\{%.*|%\(?\w+\)?s?%?|\[.*\]|#\{.*|@\w+@|__\w+__|(?:your|my|the|our|some)[-_ .]?.*|.*(?:change|replace|fill|insert|put|enter|add)[-_ ]?(?:me|this|it|in|here|your).*|(?:todo|fixme|tbd|none|null|nil|undefined|true|false|yes|no|n/?a|empty|unset|redacted|masked|hidden|removed|omitted|secret|password|passwd|token|changeit|example|sample|dummy|placeholder|default|string|value|foo|bar|test|testing)[\w.-]{0,4}"
    r"|.*(?:placeholder|redacted|example_?(?:key|token|secret|password)|dummy|not[-_]?a[-_]?real|fake).*|(?:process\.env|os\.environ|os\.getenv|env|secrets?|vault|ssm|config|settings|var|local|data|params?|args?|options?|self|this|ctx|req|request|props)[.:\[(/].*|(?:vault|ssm|arn|secretsmanager|op|keyring|file|env|ref|k8s|gcp|azurekv):.*|.*(.)\1{7,}.*)$"
)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STRING = r"""(?:\b[rRbBuUfFcC]{1,2})?(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)"""
_JOINED = re.compile(rf"(?P<first>{_STRING})(?P<more>(?:[ \t]*\\?\r?\n?[ \t]*[+.]?[ \t]*\r?\n?[ \t]*\+[ \t]*\r?\n?[ \t]*{_STRING})*)")
_PIECE = re.compile(_STRING)
_BIND = re.compile(
    r"(?P<id>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)(?P<close>[\"']?\]?)"
    r"(?P<bind>[ \t]*:[ \t]*(?!(?:Basic|Bearer|Token|Digest)[ \t])&?(?:'static[ \t]+)?(?:mut[ \t]+)?[A-Za-z][\w.<>\[\]?| ]*=[ \t]*\r?\n?[ \t]*|[ \t]+(?:string|\*string|\[\]byte)[ \t]*=[ \t]*|[ \t]*(?::=|=>|=|:|,)[ \t]*\r?\n?[ \t]*|>|\([ \t]*|[ \t]+)(?=\S)"
)
_HINT = re.compile(r"(?i)pass|pwd|secret|token|cred|auth|bearer|jwt|key")
_BARE = re.compile(r"(?:(?:Basic|Bearer|Token|token|basic|bearer)[ \t]+)?[^\s\"'`<>(){}\[\],;]+")
_URL = re.compile(r"[a-z][a-z0-9+.-]*://[^\s:/@\"'`<>]*:(?P<pw>[^\s/@\"'`<>]+|[^\s@\"'`<>]+)@[\w\[]")
_USER = re.compile(r"(?:^|[\s\"'`(\[])(?:-u|--user|--proxy-user|-U)(?:[ \t]+|=)(?P<q>[\"']?)[^\s:\"']+:(?P<pw>[^\s\"'`]+)")
_FLAG = re.compile(r"(?:^|[\s\"'`(\[,])--?(?P<id>[A-Za-z][\w-]*)(?:=|[ \t]+)(?P<q>[\"']?)(?P<pw>[^\s\"'`]+)")
_BLOCK = re.compile(r"-----BEGIN (?P<kind>[A-Z0-9 ]*?)PRIVATE KEY(?: BLOCK)?-----(?P<body>(?:(?!-----)[\s\S])*)(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?")
_BLOCK_TEXT = re.compile(r"(?:\\[nrt])*(?P<t>[A-Za-z0-9+/=]{16,})")
# Words before a bracket that call nothing.
_NO_CALL = {"if", "elif", "in", "return", "not", "and", "or", "for", "while", "switch", "match", "case", "yield", "assert", "print"}
_SCHEME = re.compile(r"^(?P<s>Basic|Bearer|Token|Digest|ApiKey)[ \t]+", re.I)
# Names of folders and files, in contrast to keys of 64 letters of which one may be a slash.
_PATH = re.compile(r"\.{0,2}/(?:[a-z0-9_.-]*/?){1,64}$|\.{1,2}/|/[\w.-]*\.[a-z]{1,5}$")
# What stands before the other branch of a value, on the same line.
_ELSE = re.compile(r"[ \t]*(?::|\bif\b[^\n\"'`;]*?\belse\b)[ \t]*")
_CONDITION = re.compile(r"[^\n;{}\"'`,]{1,80}?(?:\?|\|\||\?\?|\bor\b|\belse\b)[ \t]*(?=[\"'`])")
_BESIDE = re.compile(r"(?:[ \t]|\\?\r?\n)*")
_ESCAPE = re.compile(r"\\(?:u\{?[\da-fA-F]+\}?|x[\da-fA-F]{2}|[\s\S])")


@lru_cache(maxsize=65536)
def credential_name(name: str) -> bool:
    """Does a name of this kind hold a credential?"""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in _OTHER or "public" in words:
        return False
    if any(w in _NAMES for w in words):
        return not (words[-1] == "pass" and len(words) == 1) and not any(w in ("max", "num", "count", "total") for w in words)
    return words[-1] == "key" and any(w in _KEYS for w in words)


def placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.match(value)) or "EXAMPLE" in value


def usable(value: str, strict: bool = False, password: bool = False) -> bool:
    """Could this value be used as it stands? strict: for values whose only sign is the name before them."""
    v = value.strip()
    m = _SCHEME.match(v)
    if m:
        v = v[m.end() :].strip()
        if m["s"].lower() == "basic":
            try:
                user, colon, pw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8").partition(":")
                return bool(colon and pw) and not placeholder(pw)
            except (binascii.Error, ValueError):
                return False
    if placeholder(v) or re.search(r"\s", v) or (re.match(r"(?i)[a-z][a-z0-9+.-]*://|data:|sha\d+-", v) or _PATH.match(v)) and not FORMATS.match(v):
        return False
    if len(v) < (6 if password else 8) or v.isdigit():
        return False
    digits, upper, lower = any(c.isdigit() for c in v), any(c.isupper() for c in v), any(c.islower() for c in v)
    marks = any(not c.isalnum() for c in v)
    if strict and re.fullmatch(r"[A-Za-z_$][A-Za-z_$.]*\d{0,3}|[\w$]+(?:\.[A-Za-z_$][\w$]*)+|[-+]?[\d.,:%]+[a-z]{0,3}", v):
        return False
    if digits and (upper or lower or marks) or upper and lower and len(v) >= 16:
        return True
    if not password or re.fullmatch(r"[a-z]+(?:[_ .:-][a-z]+)*", v):
        return False
    return (marks or upper and lower) if not strict else upper and lower and bool(re.search(r"[^\w.$:/-]", v))


def _strings(text: str, at: int = 0) -> tuple[str, list[Span]] | None:
    """The literal at a place, with those that + joins to it: its whole content and the spans of the contents."""
    m = _JOINED.match(text, at)
    if not m:
        return None
    spans = []
    for p in _PIECE.finditer(text, m.start(), m.end()):
        quote = re.search(r"\"{3}(?:\\\r?\n)?(?=[\s\S]*\"{3})|'{3}(?:\\\r?\n)?(?=[\s\S]*'{3})|[\"'`]", p[0])
        spans.append((p.start() + quote.end(), p.end() - (3 if quote[0][:3] in ('"""', "'''") else 1)))
    return "".join(text[a:b] for a, b in spans), spans


def _values(text: str, at: int) -> list[tuple[str, list[Span]]]:
    """The literals that a value at a place may be: one, literals side by side in brackets, or those of its branches."""
    if text.startswith("(", at):
        value, spans, i = "", [], _BESIDE.match(text, at + 1).end()
        while one := _strings(text, i):
            value, spans = value + one[0], spans + one[1]
            i = _BESIDE.match(text, _JOINED.match(text, i).end()).end()
        if len(spans) > 1 and text.startswith(")", i) or len(spans) == 1 and re.match(r",?[ \t\r\n]*\)", text[i : i + 40]):
            return [(value, spans)]
    first = _strings(text, at)
    if not first:
        m = _CONDITION.match(text, at)
        if not m:
            return []
        at = m.end()
        first = _strings(text, at)
        if not first:
            return []
    out = [first]
    m = _ELSE.match(text, _JOINED.match(text, at).end())
    if m and (second := _strings(text, m.end())) and ("else" in m[0] or "?" in text[text.rfind("\n", 0, at) + 1 : at]):
        out.append(second)
    return out


def _cut_spans(spans: list[Span], a: int, b: int) -> list[Span]:
    """The parts of the spans that hold the characters a to b of their joined content."""
    out, seen = [], 0
    for s, e in spans:
        lo, hi = max(a - seen, 0), min(b - seen, e - s)
        if lo < hi:
            out.append((s + lo, s + hi))
        seen += e - s
    return out


def _argument(text: str, m: re.Match) -> bool:
    """Is the name a whole literal among the arguments of a call, so that the next argument is what it is bound to?"""
    quote = text[m.start() - 1 : m.start()]
    if m["close"] != quote or quote not in ("\"", "'"):
        return False
    depth = 0
    for i in range(m.start() - 2, -1, -1):
        c = text[i]
        if c in ")]}":
            depth += 1
        elif c in "([{" and depth:
            depth -= 1
        elif c in "([{":
            name = re.search(r"[\w$]+[ \t]*\Z", text[max(0, i - 80) : i])
            return c == "(" and bool(name) and name[0].strip() not in _NO_CALL
        elif c == ";" and not depth:
            break
    return False


def _after_scheme(value: str) -> int:
    m = _SCHEME.match(value)
    return m.end() if m else 0


def find(text: str | None) -> list[list[Span]]:
    """The credentials of a text, each as the spans of its literal contents, in the order of their beginnings."""
    if not text:
        return []
    found: list[list[Span]] = []
    blocked: list[Span] = []
    for m in _BLOCK.finditer(text):
        body = [(m.start("body") + x.start("t"), m.start("body") + x.end("t")) for x in _BLOCK_TEXT.finditer(m["body"])]
        if body and not all(placeholder(text[a:b]) for a, b in body):
            found.append([(m.start(), m.start()), *body])
        blocked.append(m.span())
    for m in re.finditer(r"-----BEGIN [A-Z0-9 ]*(?:PUBLIC KEY|CERTIFICATE)[A-Z ]*-----(?:(?!-----)[\s\S])*", text):
        blocked.append(m.span())
    # Literals that + joins: formats and URLs may go across the pieces.
    for m in _JOINED.finditer(text):
        if m["more"]:
            value, spans = _strings(text, m.start())
            for x in FORMATS.finditer(value):
                if not placeholder(x[0]):
                    found.append(_cut_spans(spans, x.start(), x.end()))
            for x in _URL.finditer(value):
                if not placeholder(x["pw"]):
                    found.append(_cut_spans(spans, x.start("pw"), x.end("pw")))
    for m in FORMATS.finditer(text):
        if not placeholder(m[0]):
            found.append([m.span()])
    for m in _URL.finditer(text):
        if not placeholder(m["pw"]):
            found.append([m.span("pw")])
    for m in _USER.finditer(text):
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if re.search(r"\b(?:curl|wget|http|https|xh|docker|svn|ldap\w*|smbclient)\b", line) and not placeholder(m["pw"]):
            found.append([m.span("pw")])
    for m in _FLAG.finditer(text):
        # On a command line a bare word is a value, not a name.
        if credential_name(m["id"]) and usable(m["pw"], strict=not m[0].lstrip().startswith("--"), password=True):
            found.append([m.span("pw")])
    pos = 0
    for hint in _HINT.finditer(text):
        begin = hint.start()
        if begin < pos:
            continue
        while begin > pos and (text[begin - 1].isalnum() or text[begin - 1] in "_$.-"):
            begin -= 1
        while text[begin] in ".-" or text[begin].isdigit():
            begin += 1
        m = _BIND.match(text, begin)
        if not m:
            continue
        pos = m.end("id")
        if text[m.end() : m.end() + 1] == ":" or text[begin - 1 : begin] == ":" and text[begin - 2 : begin - 1] == ":":
            continue
        if not credential_name(m["id"].rpartition(".")[2] or m["id"]):
            continue
        bind, at = m["bind"], m.end()
        last = _WORDS.findall(m["id"])[-1:]
        password = bool(last) and last[0].lower() in ("password", "passwd", "pwd", "passphrase", "pass")
        literals = _values(text, at)
        if literals:
            if bind.strip() in ("", ">") or bind.strip() == "," and not _argument(text, m):
                continue
            for value, spans in literals:
                if usable(value, password=password):
                    lead = len(value) - len(value.lstrip())
                    found.append(_cut_spans(spans, lead + _after_scheme(value[lead:]), len(value.rstrip())))
            continue
        if "\n" in bind or bind.strip() in ("(", ",", "=>") or bind.strip().startswith(":") and len(bind.strip()) > 2:
            continue
        b = _BARE.match(text, at)
        if not b or m["close"]:
            continue
        if bind == ">" and text[m.start() - 1 : m.start()] != "<":
            continue
        value, end = b[0], b.end()
        if text[end : end + 1] in ("(", "[", "{") or bind != ">" and text[end : end + 1] == "<":
            continue
        if not bind.strip() and not (_SCHEME.match(value) or len(value) >= 12 and re.search(r"\d", value)):
            continue
        value = value.rstrip(".") if not bind.strip() else value
        if usable(value, strict=True, password=password):
            found.append([(at + _after_scheme(value), at + len(value))])
    return _merge(found, blocked)


def _merge(found: list[list[Span]], blocked: list[Span]) -> list[list[Span]]:
    """Overlapping finds once, the one that begins first and reaches furthest; none within a key block but the block."""
    out: list[list[Span]] = []
    blocks = {x[0][0] for x in found if x and x[0][0] == x[0][1]}
    for spans in sorted((x for x in found if x), key=lambda s: (s[0][0], -s[-1][1])):
        a, b = spans[0][0], spans[-1][1]
        if spans[0][0] != spans[0][1] and any(x <= a < y for x, y in blocked):
            continue
        if out and a < out[-1][-1][1] and out[-1][0][0] not in blocks:
            if b > out[-1][-1][1]:
                out[-1].append((max(a, out[-1][-1][1]), b))
            continue
        out.append(spans)
    return out


def lines(text: str, found: list[list[Span]]) -> list[int]:
    """The lines, from 1, on which the credentials begin."""
    starts = [m.end() for m in re.finditer("\n", text)]
    return sorted({bisect_right(starts, x[0][0]) + 1 for x in found})


def _mask(content: str) -> str:
    """x for every character but escape sequences and line ends, which the code around may need."""
    out, done = [], 0
    for m in _ESCAPE.finditer(content):
        out += [re.sub(r"[^\r\n]", "x", content[done : m.start()]), m[0]]
        done = m.end()
    return "".join(out) + re.sub(r"[^\r\n]", "x", content[done:])


def redact(text: str | None) -> str | None:
    """The text with the contents of its credentials masked; lengths and everything else stay."""
    if not text:
        return text
    out, done = [], 0
    for a, b in sorted(span for spans in find(text) for span in spans):
        if a >= done and b > a:
            out += [text[done:a], _mask(text[a:b])]
            done = b
    return "".join(out) + text[done:]


@lru_cache(maxsize=1024)
def _lines_of(text: str) -> tuple[int, ...]:
    return tuple(lines(text, find(text)))


def credential_lines(texts: DataFrame) -> DataFrame:
    """(source_table, record_key, line_no), distinct. texts: source_table, record_key, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, k, n) for t, k, text in zip(pdf["source_table"], pdf["record_key"], pdf["text"]) for n in _lines_of(text)]
            yield pd.DataFrame(rows, columns=["source_table", "record_key", "line_no"])

    some = texts.where(F.length("text") > 0).select("source_table", "record_key", "text")
    return spread(some, "record_key", "text").mapInPandas(run, "source_table string, record_key string, line_no int").distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """(source_table, record_key, text, n_found) of every row, masked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["n_found"] = [len(find(x)) for x in pdf["text"]]
            pdf["text"] = [redact(x) if n else x for x, n in zip(pdf["text"], pdf["n_found"])]
            yield pdf

    return spread(texts.select("source_table", "record_key", "text"), "record_key", "text").mapInPandas(run, "source_table string, record_key string, text string, n_found int")
