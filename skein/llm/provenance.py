"""Generated, minified, vendored and data files: what was not written by hand here.

1. `declared`: attribute files (`.gitattributes`) mark paths as generated or vendored. Their globs become regular
   expressions; of the rules that match a file the one of the deepest directory, and there the last line, decides, either
   way. A file meets only the rules of the directories above it.
2. `content_label`: header comments of generators and upstream copies, minified code, mostly data literals. Together with
   1 these are the labels that patterns are mined from; files that only they speak of are cases too.
3. `mined_patterns`: what attribute files would say of repositories that have none. Directory names, inner suffixes and
   last words of names are patterns if the labelled files among theirs are so many that even the lower end of the rate's
   interval (Wilson, CONFIDENCE) is LIFT times the rate of all files, with labelled files in at least two repositories.
   They cover the files of all repositories that no attribute file speaks of.

Pattern counts are partial sums, so a directory that holds most files is no bottleneck; the patterns found are broadcast
while they are few (BROADCAST_PATTERNS, checked) and joined by a salted shuffle beyond. Patterns that next to no labelled
file has are not learnt, so on very few files (hundreds) some undeclared files stay.

Defined cases: null paths are no files; files without a source (or a null or empty one) are judged by attribute files and
mined patterns alone; null token counts say nothing; copies and versions give one row; a file is a case if any of its
sources is; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import salted_join
from skein.session import cut
from skein.sources.tables import spread

LIFT, CONFIDENCE = 2.0, 1.64
LONG = 160
BROADCAST_PATTERNS = 50_000

_GENERATED = re.compile(
    r"(?i)^(?:code|file)? ?\(?(?:code )?generated by\b.*|^auto[- ]?generated\b|^@generated\b|^(?:this|the) (?:file|code|class|source) (?:is|was|has been) (?:auto[- ]?)?(?:automatically )?(?:created|generated)\b"
    r"|^<auto-generated|^automatically (?:generated|created)\b|^generated (?:from|automatically|with|on)\b|\bdo not (?:edit|modify)\b.*\b(?:generated|hand)\b|\b(?:generated)\b.*\bdo not (?:edit|modify)\b"
)
_VENDORED = re.compile(r"(?i)^@preserve\b|^copied (?:verbatim )?from\b|^vendored (?:from|copy)\b|^(?:imported|taken|adapted) from (?:upstream|https?:)|^upstream:")
# A package's banner: its name and version, with a licence, a page or its project named in the same header.
_PACKAGE = re.compile(r"(?i)^(?:@license\s+)?@?[a-z][\w./-]*[ @]v?\d+\.\d+(?:\.\d+)?(?:[-+][\w.]+)?\b")
_ORIGIN = re.compile(r"(?i)\blicen[sc]ed?\b|^spdx-license-identifier:|https?://|\(c\) |\b(?:MIT|BSD|Apache|ISC|MPL)\b")
_COMMENT = re.compile(r"^\s*(?:///?!?|#+!?|/?\*+!?|<!--|--|;+|\"\"\")\s?(.*?)\s*(?:\*/|-->)?\s*$")
_STRIP = re.compile(r"/\*[\s\S]*?\*/|(?m:^\s*(?://|#).*$)")
_DATA = re.compile(
    r"(?:b|r|u)?(?P<q>[\"'`])(?:data:[\w/+.-]+;base64,)?[A-Za-z0-9+/=_\\-]{120,}(?P=q)"
    r"|(?:[-+]?(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*,\s*){24,}(?:[-+]?(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?))?"
    r"|(?:(?P<r>[\"'])[A-Za-z0-9+/=]{32,}(?P=r)\s*[,+\\]?\s*){4,}"
)


def header(source: str) -> list[str]:
    """The comment lines before the first line of code."""
    out, inside = [], False
    for line in source.lstrip("\ufeff").splitlines():
        text = line.strip()
        if not text:
            continue
        if text.startswith("/*"):
            inside = True
        if not inside and not _COMMENT.match(line):
            break
        m = _COMMENT.match(line)
        first = text.split("*/", 1)[0].lstrip("/*! ").strip() if text.startswith("/*") else m[1] if m else text
        out.append(first.lstrip("*! ").strip())
        if inside and "*/" in text:
            inside = False
            if text.split("*/", 1)[1].strip():
                break
    return out


def _dense(line: str) -> bool:
    """A line of LONG characters or more with the marks of code and next to no white space."""
    if len(line) < LONG:
        return False
    spaces = sum(c.isspace() for c in line)
    marks = sum(line.count(c) for c in "{};(),")
    return spaces < 0.12 * len(line) and marks > 0.04 * len(line)


def content_label(source: str | None) -> str | None:
    """generated, vendored, minified or data, by the source itself; None if nothing speaks against a hand."""
    if not source:
        return None
    head = header(source)
    for line in head:
        if _GENERATED.search(line):
            return "generated"
        if _VENDORED.search(line):
            return "vendored"
    if any(_PACKAGE.match(line) for line in head) and any(_ORIGIN.search(line) for line in head):
        return "vendored"
    code = _STRIP.sub("", source).strip()
    if not code:
        return None
    data = sum(m.end() - m.start() for m in _DATA.finditer(code))
    if data >= 0.5 * len(code) and len(code) >= 300:
        return "data"
    lines = [x for x in code.splitlines() if x.strip()]
    longest = max(map(len, lines))
    # All lines count, not only the longest: minifiers wrap their output, or write one line per module.
    dense = sum(len(x) for x in lines if _dense(x))
    if dense >= 250 and dense >= 0.6 * sum(map(len, lines)):
        return "minified"
    return "minified" if re.search(r"(?m)^(?://|/\*)[#@] sourceMappingURL=", source) and longest >= 250 else None


def glob_regex(pattern: str) -> str:
    """The regular expression, over paths relative to the attribute file's directory, of one of its globs.

    A pattern without an inner slash matches names at any depth; * and ? stay within a segment, ** crosses segments.
    """
    anchored = "/" in pattern.rstrip("/")[1:] or pattern.startswith("/")
    body, i, p = "", 0, pattern.lstrip("/")
    if p.endswith("/"):
        p += "**"
    while i < len(p):
        if p.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            body, i = body + ".*", i + 2
        elif p[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif p[i] == "?":
            body, i = body + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            body, i = body + "[" + p[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
        else:
            body, i = body + re.escape(p[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{body}$"


def attribute_rules(content: str) -> list[tuple[int, str, bool]]:
    """(line number, regular expression, marked) of the lines that mark paths as generated or vendored, or take it back."""
    out = []
    for n, line in enumerate(content.splitlines(), 1):
        m = re.match(r'\s*(?:"((?:[^"\\]|\\.)+)"|([^\s#"]\S*))\s+(.+)$', line)
        if not m or (m[2] or "").startswith("["):
            continue
        for word in m[3].split():
            x = re.fullmatch(r"([-!]?)(?:linguist|gitlab)-(?:generated|vendored)(?:=(\w+))?", word)
            if x:
                out.append((n, glob_regex(m[1] or m[2]), not x[1] and (x[2] or "true").lower() in ("true", "set", "1", "yes")))
    return out


def _above(path: Column) -> Column:
    """The directories above a path, the empty name of the top included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def declared(files: DataFrame, attribute_files: DataFrame) -> DataFrame:
    """(path, declared) of the files that an attribute file speaks of. attribute_files: path, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path.rpartition("/")[0], n, pattern, marked) for path, content in zip(pdf["path"], pdf["content"]) for n, pattern, marked in attribute_rules(content or "")]
            yield pd.DataFrame(rows, columns=["folder", "n", "pattern", "marked"])

    named = attribute_files.where(F.col("path").rlike(r"(^|/)\.gitattributes$")).select("path", "content")
    rules = named.mapInPandas(run, "folder string, n int, pattern string, marked boolean").distinct()
    below = files.select("path", F.explode(_above(F.col("path"))).alias("folder"))
    inside = salted_join(below.join(rules.select("folder").distinct(), "folder", "left_semi"), rules, "folder", [F.col("path")], "inner")
    met = inside.where(F.expr("substring(path, if(folder = '', 1, length(folder) + 2)) rlike pattern"))
    return met.groupBy("path").agg(F.max_by("marked", F.struct(F.length("folder"), "n")).alias("declared"))


def path_patterns(path: Column) -> Column:
    """The patterns of a path: its directory names (but the repository's), the inner suffix and the last word of its name."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    inner = F.regexp_extract(path, r"[^/.]((?:\.[A-Za-z0-9_]+)+)\.[A-Za-z0-9]+$", 1)
    last = F.regexp_extract(path, r"([-_][A-Za-z0-9]+)(?:\.[^/]*)?$", 1)
    one = lambda c, shown: F.when(c != "", F.array(shown)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.transform(folders, lambda x: F.concat(x, F.lit("/"))), one(inner, F.concat(inner, F.lit("."))), one(last, F.concat(F.lit("*"), last))))


def mined_patterns(labelled: DataFrame) -> DataFrame:
    """(pattern, n, hits) of the paths whose files are labelled far more often than others. labelled: path, is_case."""
    total = labelled.agg(F.sum(F.col("is_case").cast("int")) / F.count(F.lit(1))).scalar()
    repository = F.when(F.col("is_case"), F.split("path", "/")[0])
    counted = labelled.select(F.explode(path_patterns(F.col("path"))).alias("pattern"), "is_case", repository.alias("r")).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_case").cast("int")).alias("hits"), F.min("r").alias("a"), F.max("r").alias("b")
    )
    n, z = F.col("n"), CONFIDENCE
    rate = F.col("hits") / n
    least = (rate + z * z / 2 / n - z * F.sqrt(rate * (1 - rate) / n + z * z / 4 / n / n)) / (1 + z * z / n)
    return counted.where((F.col("a") != F.col("b")) & (least >= LIFT * total)).select("pattern", "n", "hits")


def evidence(files: DataFrame, sources: DataFrame, attribute_files: DataFrame) -> DataFrame:
    """(path, declared, content): what attribute files and the sources say of every indexed file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "content": [content_label(s) for s in pdf["source"]]})

    texts = spread(sources.where(F.col("path").isNotNull() & (F.length("source") > 0)).select("path", "source"), "path", "source")
    labels = texts.mapInPandas(run, "path string, content string").where("content is not null").groupBy("path").agg(F.max("content").alias("content"))
    one = files.where(F.col("path").isNotNull()).select("path").distinct()
    return one.join(labels, "path", "left").join(declared(one, attribute_files), "path", "left").select("path", "declared", "content")


def not_by_hand(files: DataFrame, sources: DataFrame, attribute_files: DataFrame) -> DataFrame:
    """(path, route, reason) of the files that were not written by hand here. route: declared (an attribute file), mined
    (an equivalent pattern; reason is the one with the most labelled files) or content (its source alone)."""
    e = cut(evidence(files, sources, attribute_files))
    patterns = cut(mined_patterns(e.select("path", F.coalesce("declared", F.col("content").isNotNull()).alias("is_case"))))
    open_ = e.where("declared is null").select("path", F.explode(path_patterns(F.col("path"))).alias("pattern"))
    few = patterns.count() <= BROADCAST_PATTERNS
    met = open_.join(F.broadcast(patterns), "pattern") if few else salted_join(open_, patterns, "pattern", [F.col("path")], "inner")
    alike = met.groupBy("path").agg(F.max(F.struct("hits", "pattern")).alias("best")).select("path", F.col("best.pattern").alias("pattern"))
    route = F.when(F.col("declared"), "declared").when(F.col("pattern").isNotNull(), "mined").otherwise("content")
    return (
        e.join(alike, "path", "left").where("declared or (declared is null and (pattern is not null or content is not null))")
        .select("path", route.alias("route"), F.when(F.col("declared"), F.lit("attributes")).otherwise(F.coalesce("pattern", "content")).alias("reason"))
    )
