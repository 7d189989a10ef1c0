"""Source files that do not parse: every source is parsed in full by a table-driven parser from a bundled grammar.

Sources go through a scanner (`scan`) and a recogniser (`glr`) whose tables are built from the grammar files when first
needed and kept by each Python worker. The first error that no repair known to the language (an automatic semicolon)
removes is reported with its line. Each row is parsed by itself, so nothing is grouped or gathered; workers keep the
results of the texts that they met last, so runs of copies cost one parse.

Defined cases: a null source is no case, an empty one or one of white space and comments is valid (of Go, which needs a
package clause, only the blank one); a language without a grammar (or null) is no case; copies give one row; files with
several rows are a case if any row is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import glr, scan
from skein.sources.tables import spread

GRAMMARS = {"typescript": ("ecma", ("ts",)), "javascript": ("ecma", ("js",)), "python": ("python", ()), "go": ("go", ()), "rust": ("rust", ()), "java": ("java", ())}
_PARSERS: dict[str, tuple[glr.Parser, frozenset]] = {}


def _parser(language: str) -> tuple[glr.Parser, frozenset]:
    if language not in _PARSERS:
        g = glr.load(*GRAMMARS[language])
        _PARSERS[language] = glr.Parser(g, "ASI"), frozenset(t for t in g.terminals if (t[0].isalpha() and not t.isupper()) or t in ("_", "None", "True", "False", "Self", "non-sealed"))
    return _PARSERS[language]


def first_error(source: str, language: str, jsx: bool = False) -> tuple[int, str] | None:
    """(line, what) of the first error that the parse cannot go past; None if the source is valid."""
    if not source or not source.strip():
        return None
    parser, words = _parser(language)
    try:
        kinds, starts, insert = scan.SCANNERS[language](source, words, jsx)
    except scan.Bad as bad:
        return scan.line_of(source, min(bad.pos, len(source)), language), bad.what
    at = parser.parse(kinds, insert)
    if at < 0:
        return None
    if at >= len(kinds):
        return scan.line_of(source, len(source), language), "unexpected end"
    return scan.line_of(source, starts[at], language), f"unexpected {kinds[at]}"


@lru_cache(maxsize=2048)
def _remembered(source: str, language: str, jsx: bool) -> tuple[int, str] | None:
    return first_error(source, language, jsx)


def syntax_errors(sources: DataFrame) -> DataFrame:
    """(path, language, line, error) of the rows whose source does not parse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, source in zip(pdf["path"], pdf["language"], pdf["source"]):
                bad = _remembered(source, language, str(path or "").lower().endswith((".tsx", ".jsx")))
                if bad:
                    rows.append((path, language, *bad))
            yield pd.DataFrame(rows, columns=["path", "language", "line", "error"])

    known = sources.select("path", "language", "source").where(F.col("language").isin(*GRAMMARS) & (F.length("source") > 0))
    return spread(known, "path", "source").mapInPandas(run, "path string, language string, line int, error string")


def syntax_rates(sources: DataFrame, errors: DataFrame, files: DataFrame) -> DataFrame:
    """Files, files that do not parse and their rate per repository (of the indexed path) and language."""
    bad = errors.select("path", "language").distinct().withColumn("bad", F.lit(1))
    rows = sources.where(F.col("source").isNotNull()).select("path", "language").distinct().join(files.select("path").distinct(), "path", "left_semi")
    return (
        rows.join(bad, ["path", "language"], "left")
        .groupBy(F.split("path", "/")[0].alias("repository"), "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))
        .withColumn("rate", F.round(F.col("n_bad") / F.col("n_files"), 6))
    )
