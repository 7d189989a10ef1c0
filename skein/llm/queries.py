"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import encode, leaks, lookalike, neighbours, provenance, secrets, syntax
from skein.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", ["doc_id", "text"])


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parse_results", ["path", "language", "source"])


def p2_errors(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_errors(_sources(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_errors(spark, d).where(F.col("path").isNotNull()).select("path").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_rates(_sources(spark, d), p2_errors(spark, d), table(spark, d, "indexed_files", ["path"]))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key, text in (("compressed_files", "path", "content"), ("context_payloads", "payload_id", "formatted"), ("indexed_files", "path", "summary")):
        one = table(spark, d, name, [key, text]).select(F.lit(name).alias("source_table"), F.col(key).alias("record_key"), F.col(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credential_lines(_texts(spark, d))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(_texts(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_embeddings", ["file_path", "vector", "dimensions", "model", "created_at"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.near_pairs(_vectors(spark, d))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(_vectors(spark, d)).withColumn("cosine", F.round("cosine", 5))


def p7_reasons(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "parse_results", ["path", "source"])
    texts = table(spark, d, "compressed_files", ["path", "content"]).unionByName(sources.withColumnRenamed("source", "content"))
    return provenance.not_by_hand(table(spark, d, "indexed_files", ["path"]), sources, texts)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_reasons(spark, d).select("path")


def p7_routes(spark: SparkSession, d: str) -> DataFrame:
    """How many files each route found: attribute files, mined patterns, content alone."""
    return p7_reasons(spark, d).groupBy("route", "reason").agg(F.count(F.lit(1)).alias("n"))


def p7_by_hand(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "indexed_files", ["path"]).where(F.col("path").isNotNull()).distinct()
    return files.join(p7_found(spark, d), "path", "left_anti")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(_docs(spark, d))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode_corpus(encode.encode_corpus(_docs(spark, d)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(_docs(spark, d), table(spark, d, "eval_items", ["item_id", "text"]))


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_docs(spark, d), table(spark, d, "eval_items", ["item_id", "text"]))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items", ["item_id", "suite"])
    return p9_found(spark, d).join(items, "item_id").groupBy("suite", "item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_pairs(_docs(spark, d))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_report(_docs(spark, d))


def p10_text(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_documents(_docs(spark, d))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found, "p2_errors": p2_errors, "p2_rates": p2_rates, "p3_found": p3_found, "p3_redacted": p3_redacted, "p5_found": p5_found, "p5_neighbours": p5_neighbours,
    "p7_found": p7_found, "p7_reasons": p7_reasons, "p7_by_hand": p7_by_hand, "p7_routes": p7_routes,
    "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p9_near": p9_near, "p9_report": p9_report,
    "p10_found": p10_found, "p10_classes": p10_classes, "p10_text": p10_text,
}

SQL: dict[str, str] = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
