"""The engine: search, symbols, overviews, status, summary and refresh over one project's index."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from symdex.functions import render
from symdex.functions.text import phrases
from symdex.functions.vectors import HashEmbedder, QueryVectors, nearest
from symdex.operators import fulltext, search, stats
from symdex.plans.index import TABLE_ROOT, Indexer, Progress, TableIndexer, project_folder, quiet
from symdex.sources.corpus import resolve_root
from symdex.sources.store import Manifest, Store

HIT_COLUMNS = ("distance", "rank", "score")


def rounded(x: float) -> float:
    """Four decimals, halves up, as the column function does it."""
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


class Engine:
    """Reads are snapshots of the version that is published when they begin; `refresh` is the single writer.

    With `files` (schema.FILE) the rows of that table are indexed rather than a folder; `index` must be given then.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, index: str | None = None, embedder=None, progress: Progress = quiet, files: DataFrame | None = None):
        if files is not None and not index:
            raise ValueError("an index of a table needs a folder")
        self.spark = spark
        self.root = TABLE_ROOT if files is not None else root if root and "://" in root else resolve_root(root)
        self.embedder = embedder or HashEmbedder()
        self.store = Store(spark, index or project_folder(self.root))
        self.vectors = QueryVectors(self.embedder)
        self.pinned: tuple[int, dict[str, DataFrame]] = (0, {})
        custom = (os.environ.get("SYMDEX_CUSTOM_PLATFORM", "").strip(), os.environ.get("SYMDEX_CUSTOM_MARKER", "").strip())
        self.indexer = Indexer(spark, self.root, self.store, self.embedder, progress, custom) if files is None else TableIndexer(spark, files, self.store, self.embedder, progress)

    # ---- queries

    def table(self, m: Manifest | None, name: str) -> DataFrame:
        """Chunks, vectors or postings of a version, from memory if that version is pinned."""
        version, tables = self.pinned
        return tables[name] if m is not None and version == m.version and name in tables else self.store.table(m, name)

    def pin(self) -> None:
        """Keep the published version in the executors' memory (and on their disks beyond it) for many searches in a row."""
        self.unpin()
        m = self.store.manifest()
        if m is not None:
            self.pinned = (m.version, {name: self.store.table(m, name).persist() for name in ("chunks", "vectors", "postings")})

    def unpin(self) -> None:
        for df in self.pinned[1].values():
            df.unpersist()
        self.pinned = (0, {})

    def chunks(self, m: Manifest | None = None) -> DataFrame:
        return self.table(m or self.store.manifest(), "chunks")

    def _plain(self, df: DataFrame) -> DataFrame:
        """Hits of one leg in the columns of all hits."""
        for c in HIT_COLUMNS:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("double"))
        return df

    def search_similar(self, vector: list[float], limit: int = 10) -> DataFrame:
        m = self.store.manifest()
        hits = nearest(self.table(m, "vectors"), vector, limit)
        return self.chunks(m).join(F.broadcast(hits), "id").orderBy("distance", "id")

    def text_hits(self, m: Manifest | None, query: str, limit: int) -> DataFrame:
        found = phrases(query)
        return fulltext.rank(self.table(m, "postings"), found, m.n_chunks if m else 0, m.n_tokens if m else 0).orderBy("rank", "id").limit(limit)

    def search_text(self, query: str, limit: int = 10) -> DataFrame:
        m = self.store.manifest()
        return self.chunks(m).join(F.broadcast(self.text_hits(m, query, limit)), "id").orderBy("rank", "id")

    def search_code(self, query: str, limit: int = 10) -> DataFrame:
        """The best chunks by meaning and words: both legs fused; the text leg alone without a query vector; substrings if neither finds any.

        Without an index the result is empty.
        """
        if limit < 1:
            raise ValueError("limit must be at least 1")
        m = self.store.manifest()
        chunks = self.chunks(m)
        if m is None:
            return self._plain(chunks)
        vector = self.vectors(query)
        if vector is None:
            hits = self.text_hits(m, query, limit)
            if hits.isEmpty():
                return self._plain(search.by_like(chunks, query, limit))
            return self._plain(chunks.join(F.broadcast(hits), "id").orderBy("rank", "id"))
        # both legs run side by side and are at most 3 * limit rows each; the chunks of those are one more job
        wide = search.OVERFETCH * limit
        with ThreadPoolExecutor(1) as pool:
            words = pool.submit(inheritable_thread_target(self.spark)(self._rows), lambda: self.text_hits(m, query, wide))
            near = self._rows(lambda: nearest(self.table(m, "vectors"), vector, wide))
            text = words.result()
        if not near and not text:
            return self._plain(search.by_like(chunks, query, limit))
        found = {r["id"]: r for r in chunks.where(F.col("id").isin(*{x[0] for x in (*near, *text)})).collect()}
        best = search.fused_ids(near, text, {i: r["symbol_type"] for i, r in found.items()})[:limit]
        names = ["id", *(c for c in chunks.columns if c != "id")]
        fields = [*(chunks.schema[n] for n in names), *(T.StructField(c, T.DoubleType()) for c in HIT_COLUMNS)]
        rows = [(*(found[i][n] for n in names), distance, rank, rounded(score)) for i, distance, rank, score in best]
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields]
        kinds = to_arrow_schema(T.StructType(fields))
        # a local relation: collecting it takes no job
        return self.spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds), T.StructType(fields))

    @staticmethod
    def _rows(made: Callable[[], DataFrame]) -> list[tuple]:
        return [tuple(r) for r in made().collect()]

    def search_symbol(self, name: str, symbol_type: str | None = None) -> DataFrame:
        return search.by_symbol(self.chunks(), name, symbol_type).orderBy("file_path", "line_start", "id")

    def file_overview(self, path: str) -> DataFrame:
        return search.file_listing(self.chunks(), path)

    def status(self) -> dict:
        m = self.store.manifest()
        if m is None:
            return {"indexed": False, "project_root": self.root, "message": "There is no index. A refresh builds it."}
        row = stats.index_stats(self.chunks(m), self.store.tracking(m)).first()
        return {"indexed": True, "project_root": self.root, **row.asDict(), "last_full_build": m.meta.get("last_full_build"), "build_time_seconds": m.meta.get("build_time_seconds"), "meta": m.meta}

    def project_summary(self) -> str:
        if not self.store._exists("PROJECT_SUMMARY.md"):
            return "There is no summary. A refresh writes it."
        return self.store._read("PROJECT_SUMMARY.md")

    # ---- maintenance

    def refresh(self, full: bool = False) -> dict:
        self.indexer.refresh(full)
        return self.status()

    # ---- text

    def render_search(self, query: str, limit: int = 10) -> str:
        return render.hits([r.asDict() for r in self.search_code(query, limit).collect()])

    def render_symbols(self, name: str, symbol_type: str | None = None) -> str:
        return render.symbols(name, [r.asDict() for r in self.search_symbol(name, symbol_type).collect()])

    def render_overview(self, path: str) -> str:
        return render.overview(path, [r.asDict() for r in self.file_overview(path).collect()])

    def render_status(self) -> str:
        return render.status(self.status())
