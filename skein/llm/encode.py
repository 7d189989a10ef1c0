"""Encoding of a whole corpus with a public byte-level BPE, by a table of its distinct words.

Byte-level BPE never merges across the pieces that its split pattern makes, so the ids of a text are the ids of its pieces
in order. The split runs in the JVM; every distinct piece is encoded once; the ids are joined back by position.

Words that make up at least 1 / HOT_WORDS of all words are at most HOT_WORDS many; those of bounded length are broadcast
(at most HOT_WORDS rows of HOT_CHARS characters) and looked up a batch of documents at a time, so frequent words are never
shuffled. A document is then a row of segments of ids with a rare word between each two. Only rare words are joined by a
shuffle, in which each has less than 1 / HOT_WORDS of the rows, and put back between their segments.

Defined cases: empty and null texts have an empty list; text that looks like a special token is ordinary text; copies are
encoded alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import cut
from skein.sources.tables import spread

TOKENIZERS = "/opt/tokenizers"
#: The split of byte-level BPE; (?U) gives \s its Unicode meaning.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HOT_WORDS, HOT_CHARS = 65536, 64


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: bytes of each piece and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(path: str):
    """An encoder of single words, built once per Python worker."""
    import tiktoken

    if path not in _ENCODERS:
        # The words are split already; this pattern takes each as a whole.
        _ENCODERS[path] = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks(path), special_tokens={})
    return _ENCODERS[path]


_ENCODERS: dict = {}


def words(texts: DataFrame) -> DataFrame:
    """(doc_id, pos, word) of the texts that have any."""
    return texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(SPLIT), F.lit(0))).alias("pos", "word"))


def word_table(found: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n, ids): every distinct word, encoded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary).encode_ordinary
        for pdf in batches:
            yield pdf.assign(ids=[encode(w) for w in pdf["word"]])

    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return cut(counted.mapInPandas(run, "word string, n long, ids array<int>"))


def segmented(words: pa.ListArray, hot: pa.Array, hot_ids: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """(the ids of each document's frequent words, cut where a rare one stands; its rare words in order)."""
    flat = words.flatten()
    found = pc.index_in(flat, value_set=hot)
    is_rare = pc.is_null(found)
    ids = hot_ids.take(found.drop_null()).flatten()
    where, rare_at = found.fill_null(-1).to_numpy(zero_copy_only=False), np.flatnonzero(is_rare.to_numpy(zero_copy_only=False))
    # How many ids stand before each word; the last entry is the number of all.
    before = np.concatenate([[0], np.cumsum(np.where(where < 0, 0, pc.list_value_length(hot_ids).to_numpy(zero_copy_only=False)[where] if len(hot) else 0))])
    begin = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
    # A segment begins with each document and after each rare word.
    order = np.argsort(np.concatenate([begin[:-1] * 2, rare_at * 2 + 1]), kind="stable")
    starts = before[np.concatenate([begin[:-1], rare_at])[order]]
    n_rare = np.searchsorted(rare_at, begin)
    inner = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), ids.cast(pa.int32()))
    segments = pa.ListArray.from_arrays(pa.array(n_rare + np.arange(len(begin)), pa.int32()), inner)
    return segments, pa.ListArray.from_arrays(pa.array(n_rare, pa.int32()), flat.filter(is_rare))


def encode_corpus(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document."""
    texts = docs.where(F.length("text") > 0).select("doc_id", "text")
    table = word_table(words(texts), os.path.join(folder, f"{tokenizer}.tiktoken"))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = (F.col("n") * HOT_WORDS >= total) & (F.length("word") <= HOT_CHARS)
    hot = table.where(is_hot).select("word", "ids").toArrow()  # at most HOT_WORDS rows
    shared = docs.sparkSession.sparkContext.broadcast((hot.column("word").combine_chunks(), hot.column("ids").combine_chunks()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segments, rare = segmented(b.column("words"), *shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), segments, rare], names=["doc_id", "segments", "rare"])

    split = spread(texts, "doc_id").select("doc_id", F.regexp_extract_all("text", F.lit(SPLIT), F.lit(0)).alias("words"))
    placed = cut(split.mapInArrow(place, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, segments array<array<int>>, rare array<string>"))
    rare = placed.select("doc_id", F.posexplode("rare").alias("pos", "word")).join(table.where(~is_hot).select("word", "ids").hint("shuffle_hash"), "word")
    rare = rare.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("between")).select("doc_id", F.transform("between", lambda x: x["ids"]).alias("between"))
    whole = F.flatten(F.transform("segments", lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.get("between", i - 1), s))))
    lists = placed.join(rare, "doc_id", "left").select("doc_id", whole.alias("ids"))
    empty = docs.where(F.coalesce(F.length("text"), F.lit(0)) == 0).select("doc_id", F.array().cast("array<int>").alias("ids"))
    return lists.unionByName(empty)


def pieces(spark: SparkSession, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, piece): the bytes of every id, as hexadecimal digits. The size is that of the vocabulary, whatever the corpus."""
    rows = [(i, b.hex()) for b, i in ranks(os.path.join(folder, f"{tokenizer}.tiktoken")).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


def decode_corpus(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text): the texts of lists of ids, by a join with the pieces; an empty list gives the empty text."""
    one = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    named = one.join(F.broadcast(pieces(encoded.sparkSession, tokenizer, folder)), "id", "left")
    parts = named.groupBy("doc_id").agg(F.collect_list(F.struct("pos", F.coalesce("piece", F.lit("")).alias("piece"))).alias("parts"))
    return parts.select("doc_id", F.decode(F.unhex(F.array_join(F.transform(F.array_sort("parts"), lambda p: p["piece"]), "")), "UTF-8").alias("text"))
