"""Scanners of six languages: source text to token kinds for the grammars in `grammars/`.

A scanner returns (kinds, lines, may_insert) or raises `Bad` with the line of a character that begins no token or of a
literal, comment or bracket mode that does not end. `may_insert` says before which tokens a semicolon may be put in.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Set


class Bad(Exception):
    def __init__(self, pos: int, what: str):
        self.pos, self.what = pos, what


def _numbers(*more: str) -> str:
    return "|".join((r"0[xX][\da-fA-F_]+", r"0[bB][01_]+", r"0[oO][0-7_]+", *more))


def _longest(ops: str) -> str:
    return "|".join(re.escape(x) for x in sorted(ops.split(), key=len, reverse=True))


def _lines(text: str, ends: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer(ends, text))]


# Operators that are alike for a grammar share one kind.
_ECMA_OPS = "=== !== == != <= << && || ?? ** / % ^"
_ECMA_ASSIGN = "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??="
_ECMA_PUNCT = "... => ?. ++ -- >= { } ( ) [ ] ; , < > + - * & | ! ~ ? : = . @"
_ECMA = re.compile(
    r"(?P<nl>[\n\r\u2028\u2029])|(?P<ws>[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+)|(?P<line>//[^\n\r\u2028\u2029]*)|(?P<block>/\*[\s\S]*?\*/)"
    rf"|(?P<num>(?:{_numbers(r'\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d[\d_]*)?', r'\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?')})n?)(?![\w$])"
    r"|(?P<name>(?:[^\W\d]|[$]|\\u(?:[\da-fA-F]{4}|\{[\da-fA-F]+\}))(?:[\w$\u200c\u200d]|\\u(?:[\da-fA-F]{4}|\{[\da-fA-F]+\}))*)|(?P<private>#[^\W\d][\w$]*)"
    r"""|(?P<str>'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*")|(?P<tick>`)"""
    rf"|(?P<assign>{_longest(_ECMA_ASSIGN)})|(?P<dot>\?(?=\.\d))|(?P<op>{_longest(_ECMA_OPS + ' ' + _ECMA_PUNCT)})"
)
_REGEX = re.compile(r"/(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_ENDS_OPERAND = {"NAME", "NUMBER", "STRING", "REGEX", "TEMPLATE", "TEMPLATE_TAIL", "PRIVATE", "JSX_CLOSE", "]", "this", "super", "null", "true", "false", "++", "--", "of", "get", "set", "from", "as", "async", "type", "any"}
_OPS = set(_ECMA_OPS.split())


def ecma(text: str, words: Set[str], jsx: bool = False) -> tuple[list[str], list[int], list[bool]]:
    kinds: list[str] = []
    starts: list[int] = []
    insert: list[bool] = []
    stack: list[tuple[str, bool]] = []  # open brackets and whether an operand ends with them
    pos, newline, end = 0, False, len(text)
    if text.startswith("#!"):
        pos = re.match(r"[^\n\r]*", text).end()

    def put(kind: str, at: int) -> None:
        nonlocal newline
        if newline and kinds and (kinds[-1] in ("return", "break", "continue", "throw") or kind in ("++", "--") and operand()):
            kinds.append(";")
            starts.append(at)
            insert.append(False)
        kinds.append(kind)
        starts.append(at)
        insert.append(newline or kind == "}")
        newline = False

    def operand() -> bool:
        if not kinds:
            return False
        last = kinds[-1]
        return closed if last in (")", "}") else last in _ENDS_OPERAND

    def template(at: int, first: bool) -> int:
        m = _TEMPLATE.match(text, at)
        if m.end() >= end:
            raise Bad(at, "template without end")
        if text[m.end()] == "`":
            put("TEMPLATE" if first else "TEMPLATE_TAIL", at)
            return m.end() + 1
        put("TEMPLATE_HEAD" if first else "TEMPLATE_MID", at)
        stack.append(("T", False))
        return m.end() + 2

    closed = False
    while pos < end:
        if jsx and text[pos] == "<" and not operand() and (m := re.match(r"<(?!\s*\w+\s*(?:,|extends\b))\s*[\w>$]", text[pos : pos + 60])):
            put("JSX_OPEN", pos)
            tags: list[str] = []
            while True:  # one round per tag
                m = re.compile(r"<\s*(/?)\s*([\w$.:-]*)\s*").match(text, pos)
                if not m:
                    raise Bad(pos, "tag")
                pos, closing, name, single = m.end(), bool(m[1]), m[2], False
                while pos < end and text[pos] != ">":
                    if text.startswith("/>", pos):
                        single, pos = True, pos + 1
                    elif text[pos] == "{":
                        pos = _jsx_expr(text, pos, words, put)
                    elif m := re.compile(r"\s+|[\w$:-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|(?=\{)))?").match(text, pos):
                        pos = m.end()
                    else:
                        raise Bad(pos, "tag attribute")
                if pos >= end:
                    raise Bad(pos, "tag without end")
                pos += 1
                if closing:
                    if not tags or tags.pop() != name:
                        raise Bad(pos, "tag closes another")
                elif not single:
                    tags.append(name)
                if not tags:
                    break
                while pos < end and text[pos] != "<":
                    if text[pos] == "{":
                        pos = _jsx_expr(text, pos, words, put)
                    elif text[pos] in ">}":
                        raise Bad(pos, "text between tags")
                    else:
                        pos += 1
                if pos >= end:
                    raise Bad(pos, "element without end")
            put("JSX_CLOSE", pos)
            continue
        if text[pos] == "/" and text[pos + 1 : pos + 2] not in ("/", "*") and not operand():
            m = _REGEX.match(text, pos)
            if not m:
                raise Bad(pos, "regular expression without end")
            put("REGEX", pos)
            pos = m.end()
            continue
        m = _ECMA.match(text, pos)
        if not m:
            raise Bad(pos, f"character {text[pos]!r}")
        group, at = m.lastgroup, pos
        pos = m.end()
        if group == "nl":
            newline = True
        elif group == "block":
            newline |= "\n" in m[0] or "\r" in m[0]
        elif group in ("ws", "line"):
            pass
        elif group == "name":
            put(m[0] if m[0] in words else "NAME", at)
        elif group == "num":
            put("NUMBER", at)
        elif group == "str":
            put("STRING", at)
        elif group == "private":
            put("PRIVATE", at)
        elif group == "tick":
            pos = template(pos, True)
        elif group == "assign":
            put("ASSIGN", at)
        else:
            op = m[0]
            if op in ("{", "(", "["):
                before = kinds[-1] if kinds else ""
                ends = before not in ("if", "while", "for", "with") if op == "(" else before in ("(", ",", "=", ":", "[", "?", "return", "OP", "ASSIGN", "+", "typeof")
                stack.append((op, ends))
                put(op, at)
            elif op in ("}", ")", "]"):
                if stack and stack[-1][0] == "T" and op == "}":
                    stack.pop()
                    pos = template(pos, False)
                    continue
                # A bracket that closes nothing is left to the parser, which finds the first error.
                closed = stack.pop()[1] if stack and stack[-1][0] + op in ("{}", "()", "[]") else True
                put(op, at)
            else:
                put("OP" if op in _OPS else op, at)
    return kinds, starts, [*insert, True]


def _jsx_expr(text: str, pos: int, words: Set[str], put) -> int:
    """The tokens of an expression in braces within a tag or between tags; where it ends."""
    depth, at = 0, pos
    while at < len(text):
        m = re.compile(r"[^{}\"'`/]+|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|/\*[\s\S]*?\*/|.", re.S).match(text, at)
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        at = m.end()
        if not depth:
            break
    else:
        raise Bad(pos, "{ is not closed")
    kinds, starts, _ = ecma(text[pos + 1 : at - 1], words, True)
    put("JSX_EXPR", pos)
    for k, s in zip(kinds, starts):
        put(k, pos + 1 + s)
    put("JSX_END", at)
    return at


_PY_OPS = "// << >> % & ^"
_PY_AUG = "+= -= *= /= //= %= @= &= |= ^= >>= <<= **="
_PY_PUNCT = "... -> := ** == != <= >= < > ( ) [ ] { } , : ; . = + - * / @ ~ |"
_PY = re.compile(
    r"(?P<ws>[ \t\f]+)|(?P<nl>\r\n|\n|\r)|(?P<join>\\(?:\r\n|\n|\r))|(?P<comment>\#[^\n\r]*)"
    r"""|(?P<fmt>(?:[fFtT][rR]?|[rR][fFtT])(?:\"\"\"|'''|["']))"""
    r"""|(?P<long>(?:[bB][rR]?|[rR][bB]?|[uU])?(?P<q>\"\"\"|'''))"""
    r"""|(?P<str>(?:[bB][rR]?|[rR][bB]?|[uU])?(?:'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"))"""
    rf"|(?P<num>(?:{_numbers(r'(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?')})[jJ]?)(?![^\W\d])|(?P<name>[^\W\d]\w*)"
    rf"|(?P<aug>{_longest(_PY_AUG)})|(?P<op>{_longest(_PY_OPS + ' ' + _PY_PUNCT)})"
)
_PY_OPSET = set(_PY_OPS.split())
_PY_CLOSE = {")": "(", "]": "[", "}": "{"}


def python(text: str, words: Set[str], jsx: bool = False) -> tuple[list[str], list[int], None]:
    kinds: list[str] = []
    starts: list[int] = []
    indents, stack = [0], []
    pos, end, fresh = 1 if text.startswith("\ufeff") else 0, len(text), True
    while pos < end:
        if fresh and not stack:
            m = re.compile(r"[ \t\f]*").match(text, pos)
            rest = text[m.end() : m.end() + 1]
            if rest not in ("", "\n", "\r", "#"):
                width = len(m[0].replace("\f", "").expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    kinds.append("INDENT")
                    starts.append(m.end())
                while width < indents[-1]:
                    indents.pop()
                    kinds.append("DEDENT")
                    starts.append(m.end())
                if width != indents[-1]:
                    raise Bad(m.end(), "indent fits no block")
            pos, fresh = m.end(), False
            continue
        m = _PY.match(text, pos)
        if not m:
            raise Bad(pos, f"character {text[pos]!r}")
        if m.lastgroup == "nl":
            pos = m.end()
            if not stack:
                if kinds and kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    kinds.append("NEWLINE")
                    starts.append(m.start())
                fresh = True
            continue
        pos = _python_token(text, m, words, stack, kinds, starts)
    if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
        kinds.append("NEWLINE")
        starts.append(end)
    kinds += ["DEDENT"] * (len(indents) - 1)
    starts += [end] * (len(indents) - 1)
    return kinds, starts, None


_FMT_TEXT = {True: re.compile(r"[^\\{}\"'\n\r]+"), False: re.compile(r"[^\\{}\"'\n\r]+|\\N\{[^{}\n\r]*\}")}
_FMT_END = re.compile(r"(?:=(?!=)\s*)?(?:!(?P<c>[^\W\d]\w*)\s*)?(?=[:}])")


def _python_token(text: str, m: re.Match, words: Set[str], stack: list[str], kinds: list[str], starts: list[int]) -> int:
    """The token, if any, that a match begins; where it ends."""
    group, at, pos = m.lastgroup, m.start(), m.end()
    if m["name"]:
        kinds.append(m[0] if m[0] in words else "NAME")
    elif group == "fmt":
        return _formatted(text, at, words, kinds, starts)
    elif m["long"] and m["q"]:
        close = re.compile(rf"(?:[^\\]|\\[\s\S])*?{m['q']}").match(text, pos)
        if not close:
            raise Bad(at, "string without end")
        pos = close.end()
        kinds.append("STRING")
    elif m["str"]:
        kinds.append("STRING")
    elif m["num"]:
        if re.fullmatch(r"0[\d_]*[1-9][\d_]*", m[0]):
            raise Bad(at, "number with leading zero")
        kinds.append("NUMBER")
    elif m["aug"]:
        kinds.append("AUG")
    elif m["op"]:
        op = m[0]
        if op in ("(", "[", "{"):
            stack.append(op)
        elif op in _PY_CLOSE:
            if stack and stack[-1] == _PY_CLOSE[op]:
                stack.pop()
        kinds.append("OP" if op in _PY_OPSET else op)
    else:
        return pos
    starts.append(at)
    return pos


def _formatted(text: str, at: int, words: Set[str], kinds: list[str], starts: list[int]) -> int:
    """The tokens of a formatted string: its fields are tokens like others, between a head, middles and a tail. One
    without fields is a plain string. Where it ends."""
    m = re.compile(r"(\w+)(\"{3}|'{3}|[\"'])").match(text, at)
    raw, quote = "r" in m[1].lower(), m[2]
    pos, kind = m.end(), "FSTRING_HEAD"
    while True:
        pos, mark = _fmt_text(text, pos, at, quote, raw, False)
        if mark != "{":
            kinds.append("STRING" if kind == "FSTRING_HEAD" else "FSTRING_TAIL")
            starts.append(at)
            return pos
        kinds.append(kind)
        starts.append(pos - 1 if kind == "FSTRING_MID" else at)
        kind = "FSTRING_MID"
        pos = _fmt_field(text, pos, at, quote, raw, words, kinds, starts)


def _fmt_text(text: str, pos: int, at: int, quote: str, raw: bool, spec: bool) -> tuple[int, str]:
    """Past the literal part: (where it goes on, "{", "}" or the closing quote)."""
    end = len(text)
    while pos < end:
        m = _FMT_TEXT[raw].match(text, pos)
        c = text[pos]
        if m:
            pos = m.end()
        elif text.startswith(quote, pos):
            if spec:
                raise Bad(pos, "field in formatted string is not closed")
            return pos + len(quote), quote
        elif c in "{}" and not spec and text.startswith(c * 2, pos):
            pos += 2
        elif c == "{" or c == "}" and spec:
            return pos + 1, c
        elif c == "}":
            raise Bad(pos, "brace in formatted string")
        elif c in "\n\r" and len(quote) == 1:
            break
        elif c == "\\" and text[pos + 1 : pos + 2] not in ("{", "}"):
            pos += 3 if text.startswith("\r\n", pos + 1) else 2
        else:
            pos += 1
    raise Bad(at, "string without end")


def _fmt_field(text: str, pos: int, at: int, quote: str, raw: bool, words: Set[str], kinds: list[str], starts: list[int]) -> int:
    """The tokens of a field after its brace, with those of the fields in its format; where the text goes on."""
    stack: list[str] = []
    while pos < len(text):
        if not stack:
            m = _FMT_END.match(text, pos)
            if m:
                if m["c"] and m["c"] not in ("s", "r", "a"):
                    raise Bad(pos, "conversion in formatted string")
                pos = m.end()
                break
            if text[pos] == "!" and text[pos + 1 : pos + 2] != "=":
                raise Bad(pos, "conversion in formatted string")
        m = _PY.match(text, pos)
        if not m:
            raise Bad(pos, f"character {text[pos]!r}")
        pos = _python_token(text, m, words, stack, kinds, starts)
    else:
        raise Bad(at, "field in formatted string is not closed")
    if text[pos] == "}":
        return pos + 1
    pos += 1
    while True:
        pos, mark = _fmt_text(text, pos, at, quote, raw, True)
        if mark == "}":
            return pos
        kinds.append("FSTRING_SPEC")
        starts.append(pos - 1)
        pos = _fmt_field(text, pos, at, quote, raw, words, kinds, starts)
        kinds.append("FSTRING_SPEC_END")
        starts.append(pos - 1)


_GO_OPS = "== != < <= > >= && || / % << >> &^"
_GO_ASSIGN = "+= -= *= /= %= &= |= ^= <<= >>= &^="
_GO_PUNCT = "... := <- ++ -- ( ) [ ] { } , ; : . = + - * & | ^ ! ~"
_GO = re.compile(
    r"(?P<nl>\n)|(?P<ws>[ \t\r]+)|(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)"
    rf"|(?P<num>(?:{_numbers(r'0[xX][\da-fA-F_]*\.[\da-fA-F_]*[pP][+-]?\d+', r'(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?')})i?)(?!\w)|(?P<name>[^\W\d]\w*)"
    r"""|(?P<str>"(?:[^"\\\n]|\\[^\n])*"|`[^`]*`)|(?P<char>'(?:[^'\\\n]|\\(?:[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[abfnrtv\\'"]))')"""
    rf"|(?P<assign>{_longest(_GO_ASSIGN)})|(?P<op>{_longest(_GO_OPS + ' ' + _GO_PUNCT)})"
)
_GO_OPSET = set(_GO_OPS.split())
_GO_ENDS = {"NAME", "NUMBER", "STRING", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def go(text: str, words: Set[str], jsx: bool = False) -> tuple[list[str], list[int], None]:
    kinds: list[str] = []
    starts: list[int] = []
    pos, end = 1 if text.startswith("\ufeff") else 0, len(text)
    while pos < end:
        m = _GO.match(text, pos)
        if not m:
            raise Bad(pos, f"character {text[pos]!r}")
        group, at = m.lastgroup, pos
        pos = m.end()
        if group in ("ws", "line") or group == "block" and "\n" not in m[0]:
            continue
        if group in ("nl", "block"):
            if not kinds or kinds[-1] not in _GO_ENDS:
                continue
            kind = ";"
        elif group == "name":
            kind = m[0] if m[0] in words else "NAME"
        elif group == "op":
            kind = "OP" if m[0] in _GO_OPSET else m[0]
        else:
            kind = {"num": "NUMBER", "str": "STRING", "char": "CHAR", "assign": "ASSIGN"}[group]
        kinds.append(kind)
        starts.append(at)
    if kinds and kinds[-1] in _GO_ENDS:
        kinds.append(";")
        starts.append(end)
    # A semicolon may be left out before a closing bracket.
    keep = [i for i, k in enumerate(kinds) if not (k == ";" and kinds[i + 1 : i + 2] == [")"])]
    return [kinds[i] for i in keep], [starts[i] for i in keep], None


_RUST_OPS = "== != <= / % ^"
_RUST_ASSIGN = "+= -= *= /= %= &= |= ^= <<= >>="
_RUST_PUNCT = "... ..= .. :: -> => && || >= ( ) [ ] { } , ; : . = + - * & | ! ? @ # < > ~ $"
_RUST = re.compile(
    r"(?P<ws>\s+)|(?P<line>//[^\n]*)|(?P<nest>/\*)|(?P<raw>(?:b|c)?r(?P<h>#*)\")|(?P<str>[bc]?\"(?:[^\"\\]|\\[\s\S])*\")"
    r"|(?P<char>b?'(?:[^'\\\n\r\t]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|[nrt\\0'\"]))')|(?P<life>'(?:r\#)?[^\W\d]\w*)"
    rf"|(?P<num>(?:{_numbers(r'\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?', )})(?:[iuf](?:8|16|32|64|128|size))?(?!\w))|(?P<fdot>\d[\d_]*\.(?![.\w]))|(?P<name>(?:r\#)?[^\W\d]\w*)"
    rf"|(?P<assign>{_longest(_RUST_ASSIGN)})|(?P<op>{_longest(_RUST_OPS + ' ' + _RUST_PUNCT)})"
)
_RUST_OPSET = set(_RUST_OPS.split())
_RUST_RESERVED = {"abstract", "become", "do", "final", "macro", "override", "priv", "typeof", "unsized", "virtual", "try"}
_RUST_CONTEXT = {k: re.compile(v) for k, v in {"union": r"union\s+[^\W\d]\w*\s*[<{w]", "auto": r"auto\s+trait\b", "raw": r"raw\s+(?:const|mut)\b", "macro_rules": r"macro_rules\s*!", "box": r"(?!)", "yield": r"(?!)"}.items()}


def rust(text: str, words: Set[str], jsx: bool = False) -> tuple[list[str], list[int], None]:
    kinds: list[str] = []
    starts: list[int] = []
    pos, end = 1 if text.startswith("\ufeff") else 0, len(text)
    if text.startswith("#!", pos) and not re.match(r"#!\s*\[", text[pos:]):
        pos = re.compile(r"[^\n]*").match(text, pos).end()
    while pos < end:
        m = _RUST.match(text, pos)
        if not m:
            raise Bad(pos, f"character {text[pos]!r}")
        group, at = m.lastgroup, pos
        pos = m.end()
        if group in ("ws", "line"):
            continue
        if group == "nest":
            depth = 1
            while depth:
                x = re.compile(r"/\*|\*/").search(text, pos)
                if not x:
                    raise Bad(at, "comment without end")
                depth += 1 if x[0] == "/*" else -1
                pos = x.end()
            continue
        if m["raw"]:
            close = text.find('"' + m["h"], pos)
            if close < 0:
                raise Bad(at, "string without end")
            pos, kind = close + 1 + len(m["h"]), "STRING"
        elif group == "name":
            w = m[0]
            context = _RUST_CONTEXT.get(w)
            kind = "RESERVED" if w in _RUST_RESERVED else w if w in words and (not context or context.match(text, at)) else "NAME"
        elif group == "op":
            kind = "OP" if m[0] in _RUST_OPSET else m[0]
        else:
            kind = {"num": "NUMBER", "fdot": "NUMBER", "str": "STRING", "char": "CHAR", "life": "LIFETIME", "assign": "ASSIGN"}[group]
        kinds.append(kind)
        starts.append(at)
    return kinds, starts, None


_JAVA_OPS = "== != <= >= && || / % ^ <<"
_JAVA_ASSIGN = "+= -= *= /= %= &= |= ^= <<= >>= >>>="
_JAVA_PUNCT = "... -> :: ++ -- ( ) [ ] { } , ; : . = + - * & | ! ~ ? @ < >"
_JAVA = re.compile(
    r"(?P<ws>[ \t\f\n\r\x1a]+)|(?P<line>//[^\n\r]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<text>\"\"\"[ \t\f]*[\r\n](?:[^\\]|\\[\s\S])*?\"\"\")"
    r"""|(?P<str>"(?:[^"\\\n\r]|\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[\da-fA-F]{4}))*")|(?P<char>'(?:[^'\\\n\r]|\\(?:[btnfrs"'\\]|[0-7]{1,3}|u+[\da-fA-F]{4}))')"""
    rf"|(?P<num>(?:{_numbers(r'0[xX][\da-fA-F_]*\.?[\da-fA-F_]*[pP][+-]?\d+', r'(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?')})[lLfFdD]?)(?![\w$])|(?P<name>non-sealed\b|(?:[^\W\d]|\$)[\w$]*)"
    rf"|(?P<assign>{_longest(_JAVA_ASSIGN)})|(?P<op>{_longest(_JAVA_OPS + ' ' + _JAVA_PUNCT)})"
)
_JAVA_OPSET = set(_JAVA_OPS.split())
_JAVA_PRIMITIVE = {"boolean", "byte", "short", "int", "long", "char", "float", "double"}


def java(text: str, words: Set[str], jsx: bool = False) -> tuple[list[str], list[int], None]:
    kinds: list[str] = []
    starts: list[int] = []
    pos, end = 0, len(text)
    while pos < end:
        m = _JAVA.match(text, pos)
        if not m:
            raise Bad(pos, f"character {text[pos]!r}")
        group, at = m.lastgroup, pos
        pos = m.end()
        if group in ("ws", "line", "block"):
            continue
        if group == "name":
            w = m[0]
            kind = "PRIMITIVE" if w in _JAVA_PRIMITIVE else "RESERVED" if w in ("goto", "const", "_") else w if w in words else "NAME"
        elif group == "op":
            kind = "OP" if m[0] in _JAVA_OPSET else m[0]
        else:
            kind = {"num": "NUMBER", "str": "STRING", "text": "STRING", "char": "CHAR", "assign": "ASSIGN"}[group]
        kinds.append(kind)
        starts.append(at)
    return kinds, starts, None


SCANNERS = {"typescript": ecma, "javascript": ecma, "python": python, "go": go, "rust": rust, "java": java}
LINE_ENDS = {"typescript": r"\r\n|[\n\r\u2028\u2029]", "javascript": r"\r\n|[\n\r\u2028\u2029]", "python": r"\r\n|\n|\r", "go": r"\n", "rust": r"\n", "java": r"\r\n|\n|\r"}


def line_of(text: str, pos: int, language: str) -> int:
    """The line, from 1, on which the character at pos stands."""
    return bisect_right(_lines(text, LINE_ENDS[language]), pos)
