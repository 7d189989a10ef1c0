"""Schemas of the engine's tables and nested records."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FUNCTION = _struct(name=S, params=S, return_type=S, visibility=S, is_async=B, line_number=I)
CLASS = _struct(name=S, methods=T.ArrayType(FUNCTION), properties=T.ArrayType(S), extends=S, line_number=I)
IMPORT = _struct(names=T.ArrayType(S), source=S, resolved_path=S, is_default=B, is_namespace=B)
EXPORT = _struct(name=S, kind=S, signature=S)
TYPE = _struct(name=S, kind=S, definition=S, line_number=I)
SYMBOLS = _struct(exports=T.ArrayType(EXPORT), imports=T.ArrayType(IMPORT), classes=T.ArrayType(CLASS), functions=T.ArrayType(FUNCTION), types=T.ArrayType(TYPE))

CORPUS = _struct(path=S, content=T.BinaryType(), length=L, modification_time=TS)
INDEXED_FILES = _struct(path=S, hash=S, state=S, token_count=I, symbol_token_count=I, summary=S, last_indexed=TS, last_changed=TS)
SYMBOL_MAPS = T.StructType([T.StructField("file_path", S), T.StructField("language", S), *SYMBOLS.fields, T.StructField("token_count", I), T.StructField("raw_token_count", I), T.StructField("recorded_at", TS)])
GRAPH_EDGES = _struct(from_path=S, to_path=S, recorded_at=TS)
EMBEDDINGS = _struct(file_path=S, vector=T.ArrayType(T.FloatType()), dimensions=I, model=S, created_at=TS)
SESSIONS = _struct(session_id=S, started_at=TS)
TASK_RECORDS = _struct(task_id=S, session_id=S, instruction=S, raw_tokens=L, optimized_tokens=L, saved_tokens=L, reduction_percent=I, completed_at=TS)
WATCH_EVENTS = _struct(type=S, path=S, ts=TS, duration_ms=L, embedding_updated=B, error=S)
WATCH_STATE = _struct(path=S, type=S, ts=TS)
TABLES = {
    "indexed_files": (INDEXED_FILES, ["path"]), "symbol_maps": (SYMBOL_MAPS, ["file_path"]), "graph_edges": (GRAPH_EDGES, ["from_path", "to_path"]),
    "embeddings": (EMBEDDINGS, ["file_path"]), "sessions": (SESSIONS, ["session_id"]), "task_records": (TASK_RECORDS, ["task_id"]), "watch_state": (WATCH_STATE, ["path"]),
}
SCHEMA_VERSION = 2
STATES = ("CHANGED", "TOUCHED", "ANCESTOR", "UNRELATED")
#: The depth of files that no walk reaches.
FAR = 999
