"""Relations of the index as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

#: Kinds of symbol that a chunk may have.
SYMBOL_TYPES = ("class", "constant", "enum", "file_summary", "function", "interface", "method", "namespace", "route", "section", "trait")

#: A chunk without its id, as chunkers make it; `ordinal` is its place in its file.
CHUNK = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("symbol_name", T.StringType(), False),
        T.StructField("symbol_type", T.StringType(), False),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("source_code", T.StringType(), False),
        T.StructField("docstring", T.StringType()),
        T.StructField("decorators", T.ArrayType(T.StringType())),
        T.StructField("parent_class", T.StringType()),
        T.StructField("route_path", T.StringType()),
        T.StructField("search_text", T.StringType(), False),
        T.StructField("file_mtime", T.DoubleType(), False),
    ]
)
CHUNKS = T.StructType([T.StructField("id", T.LongType(), False), *CHUNK.fields])
VECTORS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()))])
#: Positions of a term in a column of a chunk; n_tokens is the chunk's whole length, so that ranking needs no join.
POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType(), False),
        T.StructField("id", T.LongType(), False),
        T.StructField("col", T.IntegerType(), False),
        T.StructField("positions", T.ArrayType(T.IntegerType()), False),
        T.StructField("n_tokens", T.IntegerType(), False),
    ]
)
TRACKING = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_mtime", T.DoubleType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("skipped", T.BooleanType()),
        T.StructField("skip_reason", T.StringType()),
    ]
)
META = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType())])
CACHE = T.StructType([T.StructField("text_hash", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()))])
#: A tracked file and its bytes.
FILE = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_mtime", T.DoubleType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
