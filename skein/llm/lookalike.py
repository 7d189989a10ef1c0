"""Visually identical text with different characters: one canonical form per text, and the documents that look the same.

Most text is stable. A text of ASCII characters only never leaves the JVM. In the others the Unicode quick-check property
isolates the unstable segments: runs of characters that may change (or that may combine with what stands before them),
each with the one character before it as boundary context. Only those segments are normalised (decomposed, unseen
characters dropped, spaces and look-alike letters replaced, composed again) and spliced between the unchanged parts.

Case, accents, digits, punctuation, line structure and the number of spaces stay as they are.

Defined cases: a null text stays null and is in no class; the empty text is its own form; exact copies have the same form;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.skew import salted_join
from skein.session import cut
from skein.sources.tables import spread

# Letters of the Cyrillic and Greek scripts with the Latin letters that they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ԁ": "D", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ϲ": "c", "ϳ": "j", "ρ": "p",
    "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ǀ": "l",
}

#: Kinds of compatibility decompositions that make no visible difference.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
ASCII = r"^[\x00-\x7F]*$"
_JOINER = "\u200d"


def _ignorable(c: str) -> bool:
    """Characters that are not seen: formats, variation selectors and fillers."""
    o = ord(c)
    return unicodedata.category(c) == "Cf" and o not in range(0x600, 0x606) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F


def _same_look(c: str) -> str | None:
    """What c stands for if its compatibility form looks the same: full-width, half-width, contextual forms, and letters
    joined in one character (ligatures, digraphs, numerals of letters)."""
    kind = unicodedata.decomposition(c)
    if not kind.startswith("<"):
        return None
    tag, *codes = kind.split()
    form = "".join(chr(int(x, 16)) for x in codes)
    joined = tag == "<compat>" and (len(form) > 1 or 0x2160 <= ord(c) <= 0x217F) and unicodedata.category(c) in ("Ll", "Lu", "Lt", "Nl") and form.isalpha()
    return form if joined or tag in SAME_LOOK and (len(form) == 1 or " " not in form) else None


@cache
def _tables() -> tuple[dict[int, str], "re.Pattern"]:
    """The replacements, and the pattern of unstable segments; derived from the character database."""
    change: dict[int, str] = {}
    unstable: set[int] = set()
    for o in range(0x80, sys.maxunicode + 1):
        if 0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0xD800 <= o <= 0xF8FF or 0x20000 <= o <= 0x2F7FF or 0x30000 <= o <= 0xE00FF or o > 0xE01EF:
            continue
        c = chr(o)
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        if _ignorable(c):
            change[o] = ""
        elif kind == "Zs":
            change[o] = " "
        elif kind in ("Zl", "Zp") or o == 0x85:
            change[o] = "\n"
        elif (same := _same_look(c)) is not None:
            change[o] = "".join(LOOKALIKES.get(x, x) for x in same)
        elif c in LOOKALIKES:
            change[o] = LOOKALIKES[c]
        base = unicodedata.normalize("NFD", c)
        if o in change or kind == "Mn" or unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c or base[0] in LOOKALIKES:
            unstable.add(o)
        if len(base) == 2 and unicodedata.normalize("NFC", base) == c:
            unstable.add(ord(base[1]))  # quick check "maybe": it may combine with the character before it
    unstable |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)}
    spans, run = [], None
    for o in sorted(unstable):
        if run and o == run[1] + 1:
            run[1] = o
        else:
            run = [o, o]
            spans.append(run)
    chars = "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in spans)
    return change, re.compile(f"[{chars}]+")


_PICTURES = regex.compile(r"(\p{Extended_Pictographic}[\ufe0f\U0001F3FB-\U0001F3FF]*)\u200d(?=\p{Extended_Pictographic})")


def canonical(text: str) -> str:
    """The one form of all texts that look like this one. A joiner between two pictures is seen, so it stays."""
    change, unstable = _tables()
    joined = _JOINER in text
    if joined:
        text = _PICTURES.sub("\\1\ue000", text)
    parts, done = [], 0
    for m in unstable.finditer(text):
        start = max(m.start() - 1, done)  # one character of context: what the segment may combine with
        parts += text[done:start], unicodedata.normalize("NFC", unicodedata.normalize("NFD", text[start : m.end()]).translate(change))
        done = m.end()
    if parts:
        text = "".join(parts) + text[done:]
    return text.replace("\ue000", _JOINER) if joined else text


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def canonical_text(text: Column) -> Column:
    """Column form of `canonical`: ASCII texts stay in the JVM."""
    ascii_only = text.rlike(ASCII)
    return F.when(ascii_only, text).otherwise(_canonical(F.when(~ascii_only, text)))


def look_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, look, text_id): the class of the texts that look like a document's text, and an id of the text itself.
    Written once, so that no text is brought to its form again by what follows."""
    some = spread(docs.where(F.col(text).isNotNull()).select(key, text), key)
    return cut(some.select(F.col(key).alias("doc_id"), F.sha2(canonical_text(F.col(text)), 256).alias("look"), F.sha2(F.col(text), 256).alias("text_id")))


def mixed(classes: DataFrame) -> DataFrame:
    """The rows of the classes that hold unequal texts, with the class's number of texts and documents and its least doc
    id. Counted over (look, text_id) first, so copies of one text, however many, are gone before anything is compared; a
    look that very many documents share is salted."""
    texts = classes.groupBy("look", "text_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    looks = texts.groupBy("look").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_docs"), F.min("least").alias("class_id")).where("n_texts > 1")
    return salted_join(classes, looks, "look", [F.col("doc_id")], "inner")


def look_pairs(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents with unequal texts of the same look; each pair once. The documents of a look
    that very many share are dealt over slices, each of which meets all others of the look."""
    rows = cut(mixed(look_classes(docs)).select("doc_id", "look", "text_id"))
    a = rows.select(F.col("doc_id").alias("doc_a"), "look", F.col("text_id").alias("text_a"))
    b = rows.select(F.col("doc_id").alias("doc_b"), "look", F.col("text_id").alias("text_b"))
    return salted_join(a, b, "look", [F.col("doc_a")], "inner").where("doc_a < doc_b and text_a <> text_b").select("doc_a", "doc_b")


def look_report(docs: DataFrame) -> DataFrame:
    """One row per document of a class with unequal texts: class id (least doc id), texts and documents in the class."""
    return mixed(look_classes(docs)).select("doc_id", "class_id", "n_texts", "n_docs")


def canonical_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, changed): the canonical text of every document."""
    form = canonical_text(F.col("text"))
    return spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", form.alias("canonical"), "text").select("doc_id", F.col("canonical").alias("text"), (F.col("canonical") != F.col("text")).alias("changed"))
