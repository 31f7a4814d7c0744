"""Building and refreshing the index.

Full build: list, classify, chunk, embed what the cache lacks, write one layer. What costs much is
written once and read again rather than made again: texts with their reasons, chunks, postings. Refresh: the diff of
listing and tracking decides; bytes are read only of files whose time or size differ, and only
new and changed files are chunked. Both end in one published version.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex import schema
from symdex.functions import names as N
from symdex.functions.paths import has_indexed_size, is_indexed_name, prune
from symdex.functions.skip import skip_reason
from symdex.functions.vectors import embed
from symdex.operators.chunks import chunk_files
from symdex.operators.fulltext import postings
from symdex.operators.stats import content_hash
from symdex.operators.tracking import diff, split_by_cache, upsert
from symdex.plans.summary import project_summary
from symdex.sources.corpus import corpus, listing, with_content, with_text
from symdex.sources.store import Manifest, Store, dense_ids

#: What an index of a table has for a root.
TABLE_ROOT = "table://files"
Progress = Callable[[str, int, int, str], None]


def quiet(phase: str, current: int, total: int, detail: str) -> None:
    """No progress."""


class Indexer:
    """The writer of one store."""

    def __init__(self, spark: SparkSession, root: str, store: Store, embedder, progress: Progress = quiet, custom: tuple[str, str] = ("", "")):
        self.spark, self.root, self.store, self.embedder, self.progress, self.custom = spark, root, store, embedder, progress, custom

    # ---- reading the corpus

    def is_local(self) -> bool:
        return "://" not in self.root and not self.root.startswith("file:")

    def listed(self) -> DataFrame:
        """(file_path, file_mtime, file_size): a pruning walk for a local folder, else Spark's own listing."""
        if self.is_local():
            return listing(self.spark, self.root)
        return corpus(self.spark, self.root).select("file_path", "file_mtime", "file_size")

    def contents(self, files: DataFrame | None = None) -> DataFrame:
        """`files` with their bytes; without `files` all of the corpus."""
        if files is None and not self.is_local():
            return corpus(self.spark, self.root)
        return with_content(self.spark, self.root, self.listed() if files is None else files)

    def classified(self, files: DataFrame | None = None) -> DataFrame:
        """The same with content_hash and skip_reason."""
        return self.contents(files).withColumns({"content_hash": content_hash(F.col("content")), "skip_reason": skip_reason(F.col("file_path"), F.col("content"))})

    # ---- writing

    def add_layer(self, m: Manifest, files: DataFrame) -> tuple[int, int]:
        """Chunk, embed and index (file_path, text, file_mtime); returns (chunks, tokens) that were added."""
        layer = self.store.new_folder("layer")
        self.progress("parse", 0, 0, "")
        made = chunk_files(files.select("file_path", "text", "file_mtime"))
        chunks = dense_ids(self.store, made, ["file_path", "ordinal"], m.next_id).select(*schema.CHUNKS.fieldNames())
        chunks = self.store.save(chunks, f"{layer}/chunks")
        n = chunks.count()
        self.progress("embed", 0, n, "")
        with ThreadPoolExecutor(1) as pool:  # postings and vectors side by side: neither's last tasks leave the cores idle
            indexed = pool.submit(inheritable_thread_target(self.spark)(self.save_postings), chunks, layer)
            _, missing = split_by_cache(chunks.select("id", "search_text"), self.store.cache(m))
            fresh = embed(missing, self.embedder, "search_text").where(F.col("embedding").isNotNull()).select("text_hash", "embedding")
            folder = self.store.new_folder("cache")
            self.store.save(fresh, folder)
            m.caches.append(folder)
            hashed, _ = split_by_cache(chunks.select("id", "search_text"), self.store.cache(m))
            vectors = self.store.save(hashed.select("id", "embedding"), f"{layer}/vectors")
            m.meta["chunks_without_vector"] = str(n - vectors.count())
            self.progress("store", 0, n, "")
            tokens = indexed.result()
        self.progress("store", 1, n, "")
        m.layers.append(layer)
        m.next_id += n
        m.n_chunks += n
        m.n_tokens += tokens
        return n, tokens

    def save_postings(self, chunks: DataFrame, layer: str) -> int:
        """Write the postings of a layer's chunks; returns their tokens."""
        # written as they come first: finding the ranges would make all postings once more
        made = self.store.save(postings(chunks, "id", ["symbol_name", "search_text"]), came := self.store.new_folder("staged"))
        index = self.store.save(made.repartitionByRange("term", "id").sortWithinPartitions("term", "id", "col"), f"{layer}/postings")
        self.store.drop(came)
        return index.agg(F.coalesce(F.sum(F.size("positions")), F.lit(0))).first()[0]  # each token has one position

    def remove(self, m: Manifest, paths: DataFrame) -> None:
        """Take the chunks of these files out of the version."""
        if not m.layers:
            return
        folder = self.store.new_folder("gone")
        gone = self.store.save(self.store.table(m, "chunks").select("id", "file_path").join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id"), folder)
        n = gone.count()
        if n:
            lost = self.store.table(m, "postings").join(gone, "id", "left_semi").agg(F.coalesce(F.sum(F.size("positions")), F.lit(0))).first()[0]
            m.n_chunks -= n
            m.n_tokens -= lost
            m.gone.append(folder)

    def save_tracking(self, m: Manifest, rows: DataFrame) -> None:
        m.tracking = self.store.new_folder("tracking")
        self.store.save(rows.select(*schema.TRACKING.fieldNames()), m.tracking)

    def save_summary(self, m: Manifest) -> None:
        if self.is_local() or self.root.startswith("file:"):
            self.store._write("PROJECT_SUMMARY.md", project_summary(unquote(urlparse(self.root).path) if self.root.startswith("file:") else self.root, self.store.tracking(m), custom=self.custom))

    def build(self) -> Manifest:
        """A new version from all files; embeddings of texts that were seen before are kept."""
        began = time.time()
        with self.store.lock() as lock:
            old = self.store.manifest() or Manifest()
            m = Manifest(version=old.version, caches=list(old.caches), next_id=old.next_id)
            self.progress("discover", 0, 0, "")
            files = self.classified()
            looked = self.store.save(with_text(files).select(*schema.TRACKING.fieldNames()[:4], F.col("skip_reason").isNotNull().alias("skipped"), "skip_reason", F.when(F.col("skip_reason").isNull(), F.col("text")).alias("text")), work := self.store.new_folder("looked"))
            self.save_tracking(m, looked)
            counts = self.store.tracking(m).agg(F.count("*").alias("n"), F.count_if("skipped").alias("s")).first()
            self.progress("discover", counts["n"], counts["n"], "")
            self.add_layer(m, looked.where(F.col("skip_reason").isNull()))
            self.store.drop(work)
            m.meta |= {
                "last_full_build": datetime.now(UTC).isoformat(), "build_time_seconds": f"{time.time() - began:.1f}", "total_files": str(counts["n"] - counts["s"]), "skipped_files": str(counts["s"]), "project_root": self.root,
            }
            self.save_summary(m)
            lock.check()
            self.store.publish(m)
            self.store.vacuum()
        return m

    def refresh(self, full: bool = False) -> Manifest:
        """Bring the index up to date; without a change nothing is written. `full` builds anew."""
        m = None if full else self.store.manifest()
        if m is None:
            return self.build()
        began = time.time()
        with self.store.lock() as lock:
            tracked = self.store.tracking(m)
            self.progress("discover", 0, 0, "")
            first = self.store.save(diff(self.listed(), tracked), listed := self.store.new_folder("diff"))
            if first.where("action <> 'unchanged'").isEmpty():  # no contents are looked for
                self.store.drop(listed)
                return m
            open_ = first.where(F.col("action").isin("new", "suspect"))
            read = self.classified(open_.select("file_path", "file_mtime", "file_size", "old_hash", "action"))
            action = F.when((F.col("action") == "suspect") & (F.col("content_hash") == F.col("old_hash")), "touched").when(F.col("action") == "suspect", "changed").otherwise(F.col("action"))
            read = with_text(read).withColumn("action", action)
            kept = F.col("action").isin("new", "changed") & F.col("skip_reason").isNull()
            looked = self.store.save(read.select("file_path", "file_mtime", "file_size", "content_hash", "skip_reason", "action", F.when(kept, F.col("text")).alias("text")), work := self.store.new_folder("looked"))
            deleted = first.where("action = 'deleted'").select("file_path")
            n = looked.agg(F.count("*").alias("seen"), F.count_if(F.col("action").isin("new", "changed")).alias("work"), F.count_if(F.col("action").isin("new", "changed") & F.col("skip_reason").isNull()).alias("index")).first()
            n_deleted = deleted.count()
            if not n["seen"] and not n_deleted:
                self.store.drop(listed)
                self.store.drop(work)
                return m
            m.layers, m.gone, m.caches, m.meta = list(m.layers), list(m.gone), list(m.caches), dict(m.meta)
            changed = looked.where(F.col("action").isin("new", "changed"))
            self.progress("cleanup", 0, n_deleted, "")
            if n["work"] or n_deleted:
                self.remove(m, looked.where("action = 'changed'").select("file_path").unionByName(deleted))
            if n["index"]:
                self.add_layer(m, changed.where(F.col("skip_reason").isNull()))
            known = tracked.select("file_path", "skipped", F.col("skip_reason").alias("old_reason"))
            rows = looked.join(known, "file_path", "left")
            touched = F.col("action") == "touched"
            reason = F.when(touched, F.col("old_reason")).otherwise(F.col("skip_reason"))
            rows = rows.select("file_path", "file_mtime", "content_hash", "file_size", F.when(touched, F.col("skipped")).otherwise(F.col("skip_reason").isNotNull()).alias("skipped"), reason.alias("skip_reason"))
            self.save_tracking(m, upsert(tracked.join(deleted, "file_path", "left_anti"), rows, "file_path"))
            self.store.drop(listed)
            self.store.drop(work)
            m.meta = m.meta | {"last_incremental_update": datetime.now(UTC).isoformat(), "incremental_time_seconds": f"{time.time() - began:.1f}", "files_reindexed": str(n["work"]), "files_deleted": str(n_deleted)}
            if n["work"] or n_deleted:
                self.save_summary(m)
            merged = self.store.compact(m)
            lock.check()
            self.store.publish(m)
            if merged:
                self.store.vacuum()
        return m


class TableIndexer(Indexer):
    """The writer of a store whose files are the rows of a table (schema.FILE, each path once) under the rules of a folder.

    A refresh compares the table as it is then with the tracking; bytes are read of differing rows only.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, store: Store, embedder, progress: Progress = quiet):
        super().__init__(spark, TABLE_ROOT, store, embedder, progress)
        self.files = prune(files).where(is_indexed_name(F.col("file_path")) & has_indexed_size(F.col("file_size")))

    def listed(self) -> DataFrame:
        return self.files.select("file_path", "file_mtime", "file_size")

    def contents(self, files: DataFrame | None = None) -> DataFrame:
        if files is None:
            return self.files
        return files.join(self.files.select("file_path", "content"), "file_path").select(*files.columns, "content")


def project_folder(root: str) -> str:
    """Where the index of a project is kept by default: its own folder, which scans pass over."""
    return str(Path(root) / N.OWN_DIR)
