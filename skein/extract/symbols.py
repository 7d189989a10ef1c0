"""Symbols of source files: imports, exports, classes, functions and types of six languages, tolerant of errors.

Comments and literals are blanked first (lengths and lines stay), so brackets and keywords found afterwards are code.
Declarations are found by patterns; a class's body is what its brackets (or its indentation) enclose. A file that no rule
fits gives empty lists; a failing file gives a null record, not a failing job.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.schemas import SYMBOLS

_BLANK = {
    "python": re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|#[^\n]*'),
    "rust": re.compile(r'r(#*)"[\s\S]*?"\1|"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\.[^\'\n]*)\'|//[^\n]*|/\*[\s\S]*?\*/'),
    "go": re.compile(r'`[^`]*`|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*[\s\S]*?\*/'),
}
_BLANK_C = re.compile(r'"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\[\s\S])*`|//[^\n]*|/\*[\s\S]*?\*/')
_ID = r"[A-Za-z_$][\w$]*"


def blank(text: str, language: str) -> str:
    """The text with spaces for what stands in comments and literals."""
    return _BLANK.get(language, _BLANK_C).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def close_of(code: str, at: int) -> int:
    """The place after the bracket that closes the one at a place; the end if none does."""
    depth = 0
    for m in re.compile(r"[{}()\[\]]").finditer(code, at):
        depth += 1 if m[0] in "{([" else -1
        if not depth:
            return m.end()
    return len(code)


def _squeeze(x: str) -> str:
    return re.sub(r"\s+", " ", x).strip()


class _Reader:
    def __init__(self, text: str, language: str):
        self.text, self.code = text, blank(text, language)
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1

    def raw(self, m: re.Match, group: str) -> str:
        return _squeeze(self.text[m.start(group) : m.end(group)]) if m[group] is not None else ""

    def params(self, at: int) -> tuple[str, int]:
        end = close_of(self.code, at)
        return _squeeze(self.text[at:end]), end

    def function(self, m: re.Match, returns: str, visibility: str, is_async: bool) -> dict:
        return {"name": m["name"], "params": self.params(m.end() - 1)[0], "return_type": returns, "visibility": visibility, "is_async": is_async, "line_number": self.line(m.start("name"))}


def _empty() -> dict:
    return {"exports": [], "imports": [], "classes": [], "functions": [], "types": []}


def _names(clause: str) -> list[str]:
    inner = re.search(r"\{([^}]*)\}", clause)
    out = [x.split(" as ")[-1].strip() for x in (inner[1].split(",") if inner else []) if x.strip()]
    rest = re.sub(r"\{[^}]*\}", "", clause)
    return [re.sub(r"^\*\s*as\s+", "", x.strip()) for x in rest.split(",") if x.strip() and x.strip() != "type"] + out


def _ecma(text: str, typed: bool) -> dict:
    r, out = _Reader(text, "javascript"), _empty()
    for m in re.finditer(r"(?m)^[ \t]*import\s+(?:(?P<clause>[^;'\"]*?)\s*from\s*)?(?=\s*[\"'])", text):
        if r.code[m.start() : m.start() + len(m[0])].strip()[:6] != "import":
            continue
        s = re.compile(r"\s*[\"']([^\"'\n]*)").match(text, m.end())
        clause = m["clause"] or ""
        out["imports"].append({"names": _names(clause), "source": s[1] if s else "", "resolved_path": None, "is_default": bool(re.match(r"(?:type\s+)?[A-Za-z_$]", clause)), "is_namespace": "*" in clause})
    listed = {x for m in re.finditer(r"\bexport\s*(?:type\s*)?\{([^}]*)\}", r.code) for x in (p.split(" as ")[0].strip() for p in m[1].split(",")) if x}
    seen: set[str] = set()
    spans = [(m.start(), close_of(r.code, m.end() - 1)) for m in re.finditer(r"\bexport\b[^;{}\n]*\{", r.code)]
    public = lambda m: bool(m["export"]) or m["name"] in listed or any(a <= m.start() < b for a, b in spans)
    head = r"(?P<export>\bexport\s+(?:default\s+)?)?(?:declare\s+)?"
    found = [*re.finditer(head + rf"(?P<async>async\s+)?\bfunction\b\s*\*?\s*(?P<name>{_ID})\s*(?:<[^(){{}}]*>)?\(", r.code), *re.finditer(head + rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=;\n]*)?=\s*(?P<async>async\s+)?(?:function\b\s*\*?\s*(?:{_ID})?\s*)?(?:<[^(){{}}]*>)?\(", r.code)]
    for m in sorted(found, key=lambda m: m.start()):
        end = close_of(r.code, m.end() - 1)
        arrow = "function" not in m[0]
        after = re.compile(r"\s*(?::\s*(?P<t>[^={;]+?|\{[^}]*\}))?\s*(?P<go>=>|\{|;)").match(r.code, end)
        if m["name"] in seen or arrow and not (after and after["go"] == "=>"):
            continue
        seen.add(m["name"])
        out["functions"].append(r.function(m, r.raw(after, "t") if after and after["t"] else "unknown" if arrow else "void", "public" if public(m) else "private", bool(m["async"])))
    for m in re.finditer(head + rf"(?:abstract\s+)?\bclass\s+(?P<name>{_ID})(?P<head>[^{{]*)\{{", r.code):
        end = close_of(r.code, m.end() - 1)
        methods = []
        for x in re.compile(rf"(?m)^[ \t]*(?P<mods>(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*)\*?#?(?P<name>{_ID})\s*(?:<[^()]*>)?\(").finditer(r.code, m.end(), end):
            after = re.compile(r"\s*(?::\s*(?P<t>[^{;]+?))?\s*[{;]").match(r.code, close_of(r.code, x.end() - 1))
            if x["name"] in ("if", "for", "while", "switch", "catch", "return", "super") or not after:
                continue
            vis = next((v for v in ("private", "protected") if v in x["mods"]), "public")
            methods.append(r.function(x, r.raw(after, "t") if after["t"] else "void", vis, "async" in x["mods"]))
        base = re.search(r"\bextends\s+([\w$.<>, ]+?)(?:\s+implements\b|\s*$)", m["head"])
        out["classes"].append({"name": m["name"], "methods": methods, "properties": [], "extends": base[1].strip() if base else None, "line_number": r.line(m.start("name")), "__public": public(m)})
    if typed:
        known: set[str] = set()
        for m in re.finditer(head + rf"(?:const\s+)?\b(?P<kind>interface|type|enum)\s+(?P<name>{_ID})\s*(?P<rest>[^{{=\n]*)(?=[{{=])", r.code):
            if m["name"] not in known:
                known.add(m["name"])
                out["types"].append({"name": m["name"], "kind": m["kind"], "definition": f"{m['kind']} {m['name']}", "line_number": r.line(m.start("name")), "__public": public(m)})
    out["exports"] = [{"name": f["name"], "kind": "function", "signature": f["name"] + f["params"]} for f in out["functions"] if f["visibility"] == "public"]
    out["exports"] += [{"name": c["name"], "kind": "class", "signature": None} for c in out["classes"] if c.pop("__public")]
    out["exports"] += [{"name": t["name"], "kind": "type", "signature": None} for t in out["types"] if t.pop("__public")]
    return out


def _python(text: str) -> dict:
    r, out = _Reader(text, "python"), _empty()
    for m in re.finditer(r"(?m)^[ \t]*(?:from\s+(?P<from>[.\w]+)\s+import\s+(?P<names>\([^)]*\)|[^\n]+)|import\s+(?P<mods>[^\n]+))", r.code):
        if m["from"]:
            names = [x.split(" as ")[-1].strip() for x in m["names"].strip("() \t").replace("\n", " ").split(",") if x.strip()]
            out["imports"].append({"names": names, "source": m["from"], "resolved_path": None, "is_default": False, "is_namespace": names == ["*"]})
        else:
            for x in m["mods"].split(","):
                name, _, alias = x.strip().partition(" as ")
                out["imports"].append({"names": [alias.strip() or name], "source": name, "resolved_path": None, "is_default": False, "is_namespace": True})
    for m in re.finditer(rf"(?m)^[ \t]*(?P<async>async\s+)?def\s+(?P<name>{_ID})\s*\(", r.code):
        after = re.compile(r"\s*(?:->\s*(?P<t>[^:\n]+(?:\[[^\]]*\])?))?\s*:").match(r.code, close_of(r.code, m.end() - 1))
        out["functions"].append(r.function(m, r.raw(after, "t") if after and after["t"] else "None", "private" if m["name"].startswith("_") else "public", bool(m["async"])))
    for m in re.finditer(rf"(?m)^[ \t]*class\s+(?P<name>{_ID})\s*(?:\((?P<base>[^)]*)\))?\s*:", r.code):
        out["classes"].append({"name": m["name"], "methods": [], "properties": [], "extends": _squeeze(m["base"]) if m["base"] else None, "line_number": r.line(m.start("name"))})
    out["exports"] = [{"name": f["name"], "kind": "function", "signature": f"def {f['name']}{f['params']}"} for f in out["functions"] if f["visibility"] == "public"]
    return out


def _go(text: str) -> dict:
    r, out = _Reader(text, "go"), _empty()
    upper = lambda n: n[0].isupper()
    for m in re.finditer(r"(?m)^import\s+(?:\((?P<many>[^)]*)\)|(?P<one>[^\n]+))", r.code):
        group = "many" if m["many"] is not None else "one"
        for x in re.finditer(r"(?m)(?P<alias>[\w.]+\s+)?\"(?P<path>[^\"]+)\"", text[m.start(group) : m.end(group)]):
            out["imports"].append({"names": [x["alias"].strip()] if x["alias"] else [], "source": x["path"], "resolved_path": None, "is_default": False, "is_namespace": False})
    for m in re.finditer(rf"(?m)^func\s+(?:\([^)]*\)\s*)?(?P<name>{_ID})\s*(?:\[[^\]]*\])?\(", r.code):
        after = re.compile(r"[ \t]*(?P<t>[^{\n]*)").match(r.code, close_of(r.code, m.end() - 1))
        out["functions"].append(r.function(m, r.raw(after, "t") or "void", "public" if upper(m["name"]) else "private", False))
    for m in re.finditer(rf"(?m)^type\s+(?:\(\s*)?(?P<name>{_ID})\s*(?:\[[^\]]*\]\s*)?(?P<kind>[^\s{{]+)", r.code):
        out["types"].append({"name": m["name"], "kind": "interface" if m["kind"] == "struct" else "type", "definition": f"type {m['name']} {m['kind']}", "line_number": r.line(m.start("name"))})
    out["exports"] = [{"name": f["name"], "kind": "function", "signature": f"func {f['name']}{f['params']}"} for f in out["functions"] if f["visibility"] == "public"]
    out["exports"] += [{"name": t["name"], "kind": "type", "signature": None} for t in out["types"] if upper(t["name"])]
    return out


def _rust(text: str) -> dict:
    r, out = _Reader(text, "rust"), _empty()
    for m in re.finditer(r"\b(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<path>[^;]+);", r.code):
        path = r.raw(m, "path")
        out["imports"].append({"names": [re.split(r"::| as ", path)[-1].strip()] if "{" not in path else _names(path[path.index("{") :]), "source": path, "resolved_path": None, "is_default": False, "is_namespace": path.endswith("*")})
    public = lambda m: "public" if m["pub"] else "private"
    for m in re.finditer(rf"(?P<pub>\bpub(?:\([^)]*\))?\s+)?(?:const\s+)?(?P<async>async\s+)?(?:unsafe\s+)?\bfn\s+(?P<name>{_ID})\s*(?:<[^({{]*>)?\(", r.code):
        after = re.compile(r"\s*(?:->\s*(?P<t>[^{;]+?))?\s*(?:where\b|[{;])").match(r.code, close_of(r.code, m.end() - 1))
        out["functions"].append(r.function(m, r.raw(after, "t") if after and after["t"] else "()", public(m), bool(m["async"])))
    for m in re.finditer(rf"(?P<pub>\bpub(?:\([^)]*\))?\s+)?\b(?P<kind>struct|trait|enum)\s+(?P<name>{_ID})", r.code):
        out["types"].append({"name": m["name"], "kind": "enum" if m["kind"] == "enum" else "interface", "definition": f"{m['kind']} {m['name']}", "line_number": r.line(m.start("name")), "__public": bool(m["pub"])})
    out["exports"] = [{"name": f["name"], "kind": "function", "signature": f"pub fn {f['name']}{f['params']}"} for f in out["functions"] if f["visibility"] == "public"]
    out["exports"] += [{"name": t["name"], "kind": "type", "signature": None} for t in out["types"] if t.pop("__public")]
    return out


def _java(text: str) -> dict:
    r, out = _Reader(text, "java"), _empty()
    for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;", r.code):
        out["imports"].append({"names": [m["path"].rpartition(".")[2]], "source": m["path"], "resolved_path": None, "is_default": False, "is_namespace": m["path"].endswith("*")})
    mods = r"(?P<mods>(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|synchronized|native|default|strictfp)\s+)*)"
    for m in re.finditer(mods + rf"\b(?P<kind>class|interface|enum|record)\s+(?P<name>{_ID})(?P<head>[^{{;]*)\{{", r.code):
        end, methods = close_of(r.code, m.end() - 1), []
        for x in re.compile(mods + rf"(?:<[^>]*>\s*)?(?P<ret>[A-Za-z_][\w.<>\[\], ?]*?)\s+(?P<name>{_ID})\s*\(").finditer(r.code, m.end(), end):
            after = re.compile(r"\s*(?:throws\s+[\w., ]+)?\s*[{;]").match(r.code, close_of(r.code, x.end() - 1))
            if not after or x["ret"].split()[-1] in ("new", "return", "throw", "else") or after[0].endswith(";") and not x["mods"] and m["kind"] != "interface":
                continue
            vis = next((v for v in ("private", "protected") if v in x["mods"]), "public")
            methods.append(r.function(x, _squeeze(x["ret"]), vis, False))
        base = re.search(r"\bextends\s+([\w.<>, ]+?)(?:\s+(?:implements|permits)\b|\s*$)", m["head"])
        out["classes"].append({"name": m["name"], "methods": methods, "properties": [], "extends": base[1].strip() if base else None, "line_number": r.line(m.start("name"))})
        out["types"].append({"name": m["name"], "kind": "enum" if m["kind"] == "enum" else "interface", "definition": f"{m['kind']} {m['name']}", "line_number": r.line(m.start("name"))})
        out["functions"] += methods
    out["functions"] = list({(f["name"], f["line_number"]): f for f in out["functions"]}.values())
    out["exports"] = [{"name": c["name"], "kind": "class", "signature": None} for c in out["classes"]]
    return out


_READERS = {"typescript": lambda t: _ecma(t, True), "javascript": lambda t: _ecma(t, False), "python": _python, "go": _go, "rust": _rust, "java": _java}


def extract(text: str | None, language: str | None) -> dict | None:
    """The symbol record of a source; null for a null source or an unknown language."""
    if text is None or language not in _READERS:
        return None
    try:
        return _READERS[language](text.replace("\r\n", "\n").replace("\r", "\n"))
    except (ValueError, IndexError, RecursionError):
        return None


def symbols_udf():
    """Arrow function (source, language) -> symbol record."""

    @F.pandas_udf(SYMBOLS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in SYMBOLS.fields]
        for text, language in batches:
            rows = [extract(t, lang) for t, lang in zip(text, language)]
            yield pd.DataFrame({n: [x[n] if x else None for x in rows] for n in names}, columns=names)

    return run


def with_symbols(sources, source: str = "source", language: str = "language"):
    """sources with the columns exports, imports, classes, functions and types."""
    s: Column = symbols_udf()(F.col(source), F.col(language))
    return sources.withColumn("__s", s).select("*", "__s.*").drop("__s")
