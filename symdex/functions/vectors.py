"""Vectors: distances and the embedders that turn texts into them."""

from __future__ import annotations

import queue
import sys
import threading
import types
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symdex.functions.text import tokens

DIMENSION = 384
BATCH = 256
#: Batches in a row on which an embedder fails before a task gives it up.
FAILURES = 3


class EmbeddingError(RuntimeError):
    """The embedder failed or gave vectors of a wrong shape."""


def l2(vector: Column, query: list[float]) -> Column:
    """Euclidean distance to a fixed query, in double precision; null for a null or another length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.when(F.size(vector) == len(query), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def as_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the vectors of that length without nulls."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.zeros((0, dim))
    flat = column.take(pa.array(at)).flatten()
    rows = np.array(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(at), dim)
    good = np.isfinite(rows).all(axis=1)
    return at[good], rows[good]


def nearest(df: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """The k rows (key, distance) nearest to the query, ties by key.

    Each Arrow batch is one matrix operation that hands on its k best (and ties of the last), so
    the scan sends k rows a batch to the final top-k whatever the table holds. Null vectors and
    those of another length are never near.
    """
    q = np.asarray(query, np.float64)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = as_matrix(batch.column(1), len(q))
            d = np.sqrt(((rows - q) ** 2).sum(axis=1))
            if len(d) > k:
                best = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                at, d = at[best], d[best]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(d)], names=[key, "distance"])

    return df.select(key, vector).mapInArrow(run, f"{key} {kind}, distance double").orderBy("distance", key).limit(k)


# ---- embedders ------------------------------------------------------------------------------


@dataclass(frozen=True)
class HashEmbedder:
    """Unit vectors of hashed stems and pairs of stems: texts that share words are near.

    It needs no weights. It does not have the meaning of a trained sentence model: pass another
    object with `dimension` and `encode` for that.
    """

    dimension: int = DIMENSION

    def encode(self, texts: list[str]) -> np.ndarray:
        import xxhash

        hashes, sizes = [], []
        for text in texts:
            words = tokens(text)
            features = [*words, *map(" ".join, zip(words, words[1:], strict=False))]
            hashes += map(xxhash.xxh3_64_intdigest, features)
            sizes.append(len(features))
        h = np.array(hashes, np.uint64)
        cells = np.repeat(np.arange(len(texts)), sizes) * self.dimension + (h % np.uint64(self.dimension)).astype(np.int64)
        signs = np.where(h >> np.uint64(63), 1.0, -1.0)
        out = np.bincount(cells, signs, len(texts) * self.dimension).reshape(len(texts), self.dimension)
        out = np.sign(out) * np.sqrt(np.abs(out))  # a repeated word weighs less than its count
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


class EmbedderGone(EmbeddingError):
    """The embedder can't be loaded or doesn't answer; it isn't asked again in this process."""


def loaded() -> dict:
    """What lazy embedders have loaded in this process, by name. Functions travel by value, so their own globals don't outlive a task."""
    home = sys.modules.setdefault("symdex_loaded", types.ModuleType("symdex_loaded"))
    return home.__dict__.setdefault("embedders", {})


@dataclass(frozen=True)
class LazyEmbedder:
    """An embedder that each process loads when it is first needed, under `name`.

    `load()` returns an object with `encode(texts)`. A failed load, and a call or load that takes
    longer than `timeout` seconds, are remembered: all later calls in that process fail at once,
    until `reset`.
    """

    name: str
    load: Callable[[], object]
    dimension: int
    timeout: float = 120.0

    def encode(self, texts: list[str]) -> np.ndarray:
        held = loaded()
        if isinstance(held.get(self.name), EmbedderGone):
            raise held[self.name]
        if self.name not in held:
            held[self.name] = self._within("loading", self.load, latch=True)
        return self._within("encoding", lambda: held[self.name].encode(texts), latch=False)

    def _within(self, what: str, call: Callable[[], object], latch: bool) -> object:
        """`call` in a thread of its own, which is left behind if it takes too long."""
        done: queue.Queue = queue.Queue(1)

        def run() -> None:
            try:
                done.put((True, call()))
            except Exception as e:
                done.put((False, e))

        threading.Thread(target=run, daemon=True).start()
        try:
            good, out = done.get(timeout=self.timeout)
        except queue.Empty:
            gone = loaded()[self.name] = EmbedderGone(f"{what} {self.name} takes more than {self.timeout} s")
            raise gone from None
        if not good and latch:
            loaded()[self.name] = EmbedderGone(f"{what} {self.name} failed: {out}")
            raise loaded()[self.name] from out
        if not good:
            raise out
        return out

    def reset(self) -> None:
        """Forget what this process has loaded, or that it failed."""
        loaded().pop(self.name, None)


def checked(embedder, texts: list[str]) -> np.ndarray:
    try:
        found = np.asarray(embedder.encode(texts), np.float32)
    except EmbeddingError:
        raise
    except Exception as e:
        raise EmbeddingError(str(e)) from e
    if found.shape != (len(texts), embedder.dimension):
        raise EmbeddingError(f"vectors of shape {found.shape}")
    return found


def embed(df: DataFrame, embedder, text: str, column: str = "embedding", batch: int = BATCH) -> DataFrame:
    """`df` with the vector of each text, null where the embedder failed on its batch. After FAILURES batches in a row that failed a task asks no more."""
    names = [*df.columns, column]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                own = whole.slice(lo, batch)
                vectors = pa.nulls(own.num_rows, pa.list_(pa.float32()))
                if failed < FAILURES:
                    try:
                        found, failed = checked(embedder, [t or "" for t in own.column(at).to_pylist()]), 0
                        vectors = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), embedder.dimension).cast(pa.list_(pa.float32()))
                    except EmbedderGone:
                        failed = FAILURES
                    except EmbeddingError:
                        failed += 1
                yield pa.RecordBatch.from_arrays([*own.columns, vectors], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.FloatType()))]))


class QueryVectors:
    """Vectors of the last queries; a failure is None and not kept."""

    def __init__(self, embedder, most: int = 128):
        self.embedder, self.most = embedder, most
        self.held: OrderedDict[str, list[float]] = OrderedDict()
        self.lock = threading.Lock()

    def __call__(self, query: str) -> list[float] | None:
        with self.lock:
            if query in self.held:
                self.held.move_to_end(query)
                return self.held[query]
            try:
                found = checked(self.embedder, [query])[0].tolist()
            except EmbeddingError:
                return None
            self.held[query] = found
            while len(self.held) > self.most:
                self.held.popitem(last=False)
            return found
