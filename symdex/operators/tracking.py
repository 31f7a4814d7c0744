"""Incremental maintenance: the diff of two snapshots of the files, and upserts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ACTIONS = ("new", "unchanged", "touched", "changed", "deleted")


def diff(current: DataFrame, tracked: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Rows (file_path, action, ...) that put every path of either side under exactly one of ACTIONS.

    `current` has file_path, file_mtime, file_size; `tracked` also content_hash. Without `hashes`
    (file_path, content_hash) the files that fail the test of time and size are `suspect`: only their
    bytes need reading. With them a suspect is touched if its hash is the tracked one, else changed.
    """
    t = tracked.select("file_path", F.col("file_mtime").alias("old_mtime"), F.col("file_size").alias("old_size"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    both = current.select("file_path", "file_mtime", "file_size", F.lit(True).alias("present")).join(t, "file_path", "full_outer")
    same = F.col("file_mtime").eqNullSafe(F.col("old_mtime")) & F.col("file_size").eqNullSafe(F.col("old_size"))
    action = F.when(F.col("present").isNull(), "deleted").when(F.col("known").isNull(), "new").when(same, "unchanged")
    if hashes is None:
        return both.withColumn("action", action.otherwise("suspect")).drop("present", "known")
    both = both.join(hashes.select("file_path", "content_hash"), "file_path", "left")
    return both.withColumn("action", action.when(F.col("content_hash").eqNullSafe(F.col("old_hash")), "touched").otherwise("changed")).drop("present", "known")


def diff_counts(changes: DataFrame) -> DataFrame:
    """One row: how many files are to be indexed again and how many are gone."""
    return changes.agg(F.count_if(F.col("action").isin("new", "changed")).alias("files_reindexed"), F.count_if(F.col("action") == "deleted").alias("files_deleted"))


def last_by(df: DataFrame, key: str, *order) -> DataFrame:
    """Of each key the row that is last by `order`."""
    by = W.partitionBy(key).orderBy(*[F.col(o).desc() if isinstance(o, str) else o for o in order])
    return df.withColumn("__rank", F.row_number().over(by)).where("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` (unique by key) in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`df` without the rows of these keys."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def split_by_cache(chunks: DataFrame, cache: DataFrame, text: str = "search_text") -> tuple[DataFrame, DataFrame]:
    """(chunks with text_hash and the cached embedding or null, distinct (text_hash, text) that the cache lacks)."""
    hashed = chunks.withColumn("text_hash", F.sha2(text, 256))
    joined = hashed.join(cache, "text_hash", "left")
    missing = hashed.join(cache.select("text_hash"), "text_hash", "left_anti").groupBy("text_hash").agg(F.first(text).alias(text))
    return joined, missing


def cache_counts(chunks: DataFrame, cache: DataFrame, text: str = "search_text") -> DataFrame:
    """One row (hits, misses): chunks whose text is or isn't in the cache."""
    known = cache.select("text_hash", F.lit(True).alias("known"))
    joined = chunks.select(F.sha2(text, 256).alias("text_hash")).join(known, "text_hash", "left")
    return joined.agg(F.count_if(F.col("known").isNotNull()).alias("hits"), F.count_if(F.col("known").isNull()).alias("misses"))
