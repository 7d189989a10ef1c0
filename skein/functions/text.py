"""Column builders for paths, token estimates, rendering and rounding; all of them native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the languages that they stand for.
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java"}
WALK_EXTENSIONS = tuple(LANGUAGES)
WATCH_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")
GIT_EXTENSIONS = (*WALK_EXTENSIONS, ".mjs", ".cjs")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: two for characters beyond the basic plane."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up; 0 for empty and null texts."""
    return F.coalesce(F.ceil(utf16_length(text) / 4), F.lit(0)).cast("int")


def round_half_up(x: Column) -> Column:
    """Rounding to the next whole number, halves upwards also below zero."""
    return F.floor(x + 0.5)


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


def has_extension(path: Column, extensions: tuple[str, ...] = WALK_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_to(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 2**31 - 1)).otherwise(path)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def directories(path: Column) -> Column:
    """All directory prefixes of a path, outermost first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def _section(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(lines, "\n")))


def symbol_text(path: Column, exports: Column, imports: Column, types: Column) -> Column:
    """The symbols of a file as text: the file, then what it exports, imports and defines, as far as there is any."""
    e = F.transform(exports, lambda x: F.concat(F.lit("  "), F.coalesce(x["signature"], x["name"], F.lit(""))))
    i = F.transform(imports, lambda x: F.concat(F.lit("  "), F.array_join(F.coalesce(x["names"], F.array().cast("array<string>")), ", "), F.lit(" ← "), F.coalesce(x["resolved_path"], x["source"], F.lit(""))))
    t = F.transform(types, lambda x: F.concat(F.lit("  "), F.coalesce(x["definition"], x["name"], F.lit(""))))
    return F.concat_ws("\n", F.concat(F.lit("FILE: "), path), _section("EXPORTS", e), _section("IMPORTS", i), _section("TYPES", t))


def summary_line(path: Column, exports: Column, imports: Column, classes: Column, types: Column) -> Column:
    """One line: base name, up to four exports, up to three imported modules, classes, up to three types.

    Of the imports the first three count, without type packages; equal ones are named once.
    """
    names = F.transform(exports, lambda x: x["name"])
    more = F.size(names) - 4
    e = F.when(F.size(names) > 0, F.concat(F.lit("exports: "), F.array_join(F.slice(names, 1, 4), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise("")))
    used = F.transform(F.filter(imports, lambda x: ~F.contains(x["source"], F.lit("@types"))), lambda x: F.element_at(F.split(x["source"], "/"), -1))
    u = F.when(F.size(used) > 0, F.concat(F.lit("uses: "), F.array_join(F.array_distinct(F.slice(used, 1, 3)), ", ")))
    c = F.when(F.size(classes) > 0, F.concat(F.lit("classes: "), F.array_join(F.transform(classes, lambda x: x["name"]), ", ")))
    t = F.when(F.size(types) > 0, F.concat(F.lit("types: "), F.array_join(F.slice(F.transform(types, lambda x: x["name"]), 1, 3), ", ")))
    rest = F.concat_ws(" · ", e, u, c, t)
    return F.when(rest == "", base_name(path)).otherwise(F.concat(base_name(path), F.lit(" - "), rest))


def embedding_text(path: Column, summary: Column, symbols: Column) -> Column:
    """What a file is embedded by: its parts that are not empty."""
    some = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", some("file", path), some("description", summary), some("symbols", symbols))


def age_label(then: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(f"{u} ago"))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def bar(value: Column, top: Column, width: int = 20) -> Column:
    filled = F.when(top > 0, round_half_up(value / top * width)).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def node_label(path: Column) -> Column:
    return F.when(F.length(path) > 28, F.concat(F.lit("..."), F.right(path, F.lit(25)))).otherwise(path)
