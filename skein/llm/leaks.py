"""Evaluation texts leaking into training text: pigeonhole edit matching.

A document leaks an item if it holds at least `min_words` successive words of it with at most `budget` edits: words that
are changed, left out or put in between. Words are runs of letters and digits after canonicalisation, so case, look-alike
and unseen characters and everything between words make no difference. The exact leaks are those of distance 0.

The item's words are cut into pieces of q words, q = (min_words + 1) // (budget + 2): any min_words successive words hold
budget + 1 whole pieces, and an edit spoils at most one of them, so one is free of edits. Exact piece hits are found by a
join on the piece's hash. A hit carries the words around it on both sides (as 64-bit hashes, a fixed number of them), so
no text is read a second time and no document is gathered. Myers' bit-parallel distance then holds every window of
min_words words of the item that includes the piece against the document's words at that place, many hits at once.

Items are joined by broadcast while their pieces are few (BROADCAST_PIECES, checked), by a salted shuffle beyond.

Defined cases: null and empty texts have no words and leak nothing; items shorter than min_words cannot leak; copies of a
document leak alike; items with equal texts are all reported; min_words may be at most 63 (the bits of a word) and must
be greater than the budget; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.lookalike import ASCII, LOOKALIKES, canonical
from skein.operators.skew import salted_join
from skein.session import cut
from skein.sources.tables import spread

MIN_WORDS = 12
#: Piece tables up to this number of rows (of some 200 bytes each) are broadcast.
BROADCAST_PIECES = 200_000
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")


def _letter_classes() -> dict[int, str]:
    """Letters that case and look join, in any number of steps, with one of them in the place of all."""
    up: dict[str, str] = {}

    def top(c: str) -> str:
        while up.setdefault(c, c) != c:
            c = up[c]
        return c

    for a, b in LOOKALIKES.items():
        for x, y in ((a, b), (a, a.lower()), (b, b.lower())):
            if len(y) == 1 and top(x) != top(y):
                up[max(top(x), top(y), key=lambda c: (ord(c) > 127, c.isupper(), c))] = min(top(x), top(y), key=lambda c: (ord(c) > 127, c.isupper(), c))
    return {ord(c): top(c).lower() for c in up}


_CLASSES = _letter_classes()


def reader_words(text: str) -> list[str]:
    """The words as a reader sees them, in lower case."""
    form = unicodedata.normalize("NFD", canonical(text)).translate(_CLASSES)
    form = unicodedata.normalize("NFC", unicodedata.normalize("NFC", form).casefold())
    return _WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFD", form).translate(_CLASSES)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _reader_words(texts: pd.Series) -> pd.Series:
    return texts.map(reader_words, na_action="ignore")


def word_list(text: Column) -> Column:
    """Column form of `reader_words`: ASCII texts stay in the JVM."""
    ascii_only = text.rlike(ASCII)
    return F.when(ascii_only, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).otherwise(_reader_words(F.when(~ascii_only, text)))


def word_hashes(text: Column, pad: int) -> Column:
    """The words as 64-bit hashes, with `pad` zeros, which stand for no word, on both sides."""
    zeros = F.array_repeat(F.lit(0).cast("long"), pad)
    return F.concat(zeros, F.transform(word_list(text), lambda w: F.xxhash64(w)), zeros)


def pieces(hashes: Column, pad: int, q: int, step: int) -> Column:
    """The hash of the q words from every step-th place on; none for fewer than q words."""
    last = F.size(hashes) - 2 * pad - q
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.xxhash64(F.slice(hashes, i + pad + 1, q))))


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The least edit distance between each pattern and any substring of its text: one bit of a machine word per place of
    the pattern, a row per pair. A zero in a text equals nothing."""
    n, m = patterns.shape
    one, high = np.uint64(1), np.uint64(1 << (m - 1))
    bits = one << np.arange(m, dtype=np.uint64)
    vp, vn = np.full(n, (1 << m) - 1, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    ones = vp.copy()
    score = np.full(n, m, dtype=np.int32)
    best = score.copy()
    for j in range(texts.shape[1]):
        c = texts[:, j : j + 1]
        eq = np.where((patterns == c) & (c != 0), bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        x = eq | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & ones
        hn, hp = vp & d0, (vn | ~(vp | d0)) & ones
        score += ((hp & high) != 0).astype(np.int32) - ((hn & high) != 0).astype(np.int32)
        np.minimum(best, score, out=best)
        hp, hn = hp << one, hn << one
        vn = hp & d0 & ones
        vp = (hn | ~(hp | d0)) & ones
    return best


def verify(docs: np.ndarray, items: np.ndarray, min_words: int, q: int, budget: int) -> np.ndarray:
    """The least distance of any window of an item that includes the piece hit, per hit; budget + 1 where all are greater.

    items: the piece with min_words - q words on both sides; docs: the same place with `budget` words more on both sides.
    """
    best = np.full(len(docs), budget + 1, dtype=np.int32)
    for j in range(min_words - q + 1):
        # Of a window within the budget all words but as many as the budget are found at their place or that near to it.
        part = items[:, j : j + min_words]
        todo = np.flatnonzero((best > 0) & (part != 0).all(axis=1))
        near = np.zeros((len(todo), min_words), dtype=bool)
        for k in range(2 * budget + 1):
            near |= docs[todo, j + k : j + k + min_words] == part[todo]
        todo = todo[near.sum(axis=1) >= min_words - budget]
        if len(todo):
            best[todo] = np.minimum(best[todo], myers(part[todo], docs[todo, j : j + min_words + 2 * budget]))
    return best


def leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, budget: int = 1) -> DataFrame:
    """(doc_id, item_id, distance) of every document and item within the budget."""
    if not budget < min_words <= 63:
        raise ValueError("min_words must be greater than the budget and at most 63")
    q = (min_words + 1) // (budget + 2)
    side = min_words - q
    wanted = items.where(F.col("text").isNotNull()).select("item_id", word_hashes(F.col("text"), side).alias("w"))
    parts = wanted.select("item_id", "w", F.posexplode(pieces(F.col("w"), side, q, q)).alias("n", "piece")).where(F.size("w") - 2 * side >= min_words)
    parts = cut(parts.select("piece", "item_id", F.slice("w", F.col("n") * q + 1, 2 * side + q).alias("item")))
    pad = side + budget
    texts = spread(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id").select("doc_id", word_hashes(F.col("text"), pad).alias("w"))
    # The outer form lets no filter on the words slip below the shuffle, where they would be made a second time.
    windows = texts.select("doc_id", "w", F.posexplode_outer(pieces(F.col("w"), pad, q, 1)).alias("pos", "piece"))
    hits = windows.join(F.broadcast(parts), "piece") if parts.count() <= BROADCAST_PIECES else salted_join(windows, parts, "piece", [F.col("doc_id")], "inner")
    hits = hits.select("doc_id", "item_id", F.slice("w", F.col("pos") + 1, 2 * pad + q).alias("doc"), "item")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = lambda c, n: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        for b in batches:
            if not b.num_rows:
                continue
            d = verify(wide(b.column("doc"), 2 * pad + q), wide(b.column("item"), 2 * side + q), min_words, q, budget)
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), pa.array(d, pa.int32())], names=["doc_id", "item_id", "distance"])
            yield out.filter(pa.array(d <= budget))

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, distance int"
    return hits.mapInArrow(check, kinds).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def leaked(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id): the leaks without an edit."""
    return leaks(docs, items, min_words).where("distance = 0").select("doc_id", "item_id")
