"""Ignore patterns, compiled on the driver to one regular expression that runs in the scan."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is ignored by default.
DEFAULTS = ("node_modules/", ".git/", "dist/", "build/", "coverage/", ".next/", "__pycache__/", "target/", "vendor/", "*.min.js", "*.map", "*.lock")


def to_regex(pattern: str) -> str:
    """A glob as a regular expression: ** crosses directories, * stays in one, a closing slash means all below.

    A question mark keeps its meaning as a quantifier, as in the engine that this one stands in for; negation and a leading
    slash have no special meaning.
    """
    p = pattern[:-1] + "/**" if pattern.endswith("/") else pattern
    if p.startswith("**/"):
        p = p[3:]
    out = ""
    for part in re.split(r"(\*\*|\*)", p):
        out += {"**": ".*", "*": "[^/]*"}.get(part) or re.sub(r"[.+^${}()|\[\]\\]", r"\\\g<0>", part)
    return out


def combined(patterns: Iterable[str]) -> str:
    """One expression for all patterns, matching a path from any segment on to its end; never matching without patterns."""
    parts = [to_regex(p) for p in patterns]
    return rf"^(?:.*/)?(?:{'|'.join(parts)})$" if parts else r"(?!)"


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    return path.rlike(combined(patterns))


def parse(text: str) -> list[str]:
    """The patterns of an ignore file: trimmed lines that are neither blank nor comments."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def write_template(root: str | Path, name: str = ".skeinignore") -> bool:
    """An ignore file with the usual patterns, if the folder has none; whether it was written."""
    f = Path(root, name)
    if f.exists():
        return False
    f.write_text("# Files that the index leaves out, one pattern a line.\n" + "".join(f"{p}\n" for p in (*DEFAULTS, "*.generated.ts", "*.generated.js", ".skein/")))
    return True


def load(root: str | Path, names: Iterable[str] = (".gitignore", ".skeinignore")) -> list[str]:
    """Defaults and the patterns of the ignore files of a folder; each once, in order."""
    out = list(DEFAULTS)
    for name in names:
        f = Path(root, name)
        if f.is_file():
            out += parse(f.read_text())
    return list(dict.fromkeys(out))
