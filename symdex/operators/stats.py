"""Aggregates over the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex.functions import names as N
from symdex.functions.paths import suffix


def by_type(chunks: DataFrame, kind: str = "symbol_type") -> DataFrame:
    return chunks.groupBy(kind).agg(F.count("*").alias("n"))


def index_stats(chunks: DataFrame, tracking: DataFrame, path: str = "file_path", kind: str = "symbol_type") -> DataFrame:
    """One row: total_chunks, total_files (that have chunks), by_type, tracked_files, skipped_files.

    The map has one entry for each kind of symbol, of which there are eleven.
    """
    totals = chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct(path).alias("total_files"), F.lit(1).alias("one"))
    kinds = by_type(chunks, kind).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("by_type"), F.lit(1).alias("one"))
    tracked = tracking.agg(F.count("*").alias("tracked_files"), F.count_if("skipped").alias("skipped_files"), F.lit(1).alias("one"))
    return totals.join(kinds, "one").join(tracked, "one").select("total_chunks", "total_files", "by_type", "tracked_files", "skipped_files")


def latest_mtime(chunks: DataFrame, path: str = "file_path", mtime: str = "file_mtime") -> DataFrame:
    return chunks.groupBy(path).agg(F.max(mtime).alias("latest"))


def language(ext: Column) -> Column:
    """The label of a suffix (with its dot, lower case)."""
    bare = F.ltrim(ext, F.lit("."))
    pairs = [F.lit(x) for item in sorted(N.LANGUAGES.items()) for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), bare), F.upper(bare))


def languages(tracking: DataFrame, limit: int = 8, path: str = "file_path") -> DataFrame:
    """The most frequent suffixes of files that aren't skipped: (ext, language, n), ties by suffix."""
    ext = F.lower(suffix(F.col(path)))
    counted = tracking.where(~F.coalesce(F.col("skipped"), F.lit(False))).select(ext.alias("ext")).where("ext <> ''").groupBy("ext").agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "ext").limit(limit).select("ext", language(F.col("ext")).alias("language"), "n")


def content_hash(content: Column) -> Column:
    """MD5 of the bytes, '' for an unreadable file."""
    return F.coalesce(F.md5(content), F.lit(""))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)
