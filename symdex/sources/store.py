"""The index as immutable layers of Parquet below one folder, published by a swapped pointer.

A refresh adds a layer of new rows and a list of the ids that are gone; nothing that a reader may
hold is rewritten, so readers keep a consistent snapshot. Files are touched through Spark's own
file system API, so a store may be anything that Spark writes to.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from symdex import schema
from symdex.operators.tracking import last_by

TABLES = {"chunks": schema.CHUNKS, "vectors": schema.VECTORS, "postings": schema.POSTINGS}
GONE = T.StructType([T.StructField("id", T.LongType(), False)])


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for its stores below spark.checkpoint.dir; only a local session without it takes a temporary one."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", "") or _LOCAL.get(app)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="symdex-store-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = _LOCAL[app] = Path(folder).as_uri()
    return f"{base.rstrip('/')}/symdex-store/{app}"


class StoreLocked(RuntimeError):
    """Another writer is at work."""


class StoreMoved(RuntimeError):
    """Another writer has published since this one began, or has taken its mark over."""


@dataclass
class Manifest:
    """What a version consists of: layers in order, lists of gone ids, tables that are whole, and totals."""

    version: int = 0
    layers: list[str] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)
    tracking: str | None = None
    caches: list[str] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)
    next_id: int = 1
    n_chunks: int = 0
    n_tokens: int = 0


class Store:
    #: Seconds without a sign of life after which a writer's mark counts as left behind.
    STALE = 300
    #: Layers from which on a refresh merges the later ones, and the share of gone rows from which on it merges all.
    LAYERS, GONE_SHARE = 16, 0.25
    #: Seconds for which what an older version uses is kept for its readers.
    RETAIN = 24 * 3600

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- files

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool = True) -> None:
        out = self._fs.create(self._at(name), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    # ---- versions

    def manifest(self) -> Manifest | None:
        """That of the published version; None without one."""
        if not self._exists("CURRENT"):
            return None
        version = int(self._read("CURRENT"))
        return Manifest(**json.loads(self._read(f"manifest-{version:08d}.json")))

    def publish(self, m: Manifest) -> None:
        """Make `m` the next version: its manifest first, then the pointer, replaced by a rename.

        A version can be written once only: whoever comes second, or began before the pointer moved, fails.
        """
        if (int(self._read("CURRENT")) if self._exists("CURRENT") else 0) != m.version:
            raise StoreMoved(f"{self.path} has another version than {m.version}")
        try:
            self._write(f"manifest-{m.version + 1:08d}.json", json.dumps(asdict(m) | {"version": m.version + 1}), overwrite=False)
        except Exception as e:
            if self._exists(f"manifest-{m.version + 1:08d}.json"):
                raise StoreMoved(f"{self.path} has a version {m.version + 1}") from e
            raise
        m.version += 1
        self._write("CURRENT.next", str(m.version))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._at("CURRENT.next"), self._at("CURRENT"), options)

    def lock(self) -> Lock:
        return Lock(self)

    # ---- tables

    def new_folder(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.load(name, df.schema)

    def drop(self, name: str) -> None:
        """Delete a folder that no version uses."""
        self._fs.delete(self._at(name), True)

    def load(self, name: str, of: T.StructType) -> DataFrame:
        return self.spark.read.schema(of).parquet(f"{self.path}/{name}")

    def empty(self, of: T.StructType) -> DataFrame:
        return self.spark.createDataFrame(to_arrow_schema(of).empty_table(), of)  # a local relation: no worker starts for it

    def gone_ids(self, m: Manifest) -> DataFrame | None:
        if not m.gone:
            return None
        return self.spark.read.schema(GONE).parquet(*[f"{self.path}/{g}" for g in m.gone])

    def table(self, m: Manifest | None, name: str) -> DataFrame:
        """All living rows of chunks, vectors or postings."""
        of = TABLES[name]
        if m is None or not m.layers:
            return self.empty(of)
        df = self.spark.read.schema(of).parquet(*[f"{self.path}/{layer}/{name}" for layer in m.layers])
        gone = self.gone_ids(m)
        return df if gone is None else df.join(gone, "id", "left_anti")

    def tracking(self, m: Manifest | None) -> DataFrame:
        return self.load(m.tracking, schema.TRACKING) if m and m.tracking else self.empty(schema.TRACKING)

    def cache(self, m: Manifest | None) -> DataFrame:
        """text_hash -> embedding; the latest of a hash."""
        if not m or not m.caches:
            return self.empty(schema.CACHE)
        if len(m.caches) == 1:
            return self.load(m.caches[0], schema.CACHE)
        parts = [self.load(c, schema.CACHE).withColumn("turn", F.lit(i)) for i, c in enumerate(m.caches)]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return last_by(whole, "text_hash", "turn").drop("turn")

    def meta(self, m: Manifest | None) -> DataFrame:
        rows = sorted(m.meta.items()) if m else []
        return self.spark.createDataFrame(rows, schema.META)

    def clear(self) -> None:
        """Empty everything but the embedding cache."""
        m = self.manifest() or Manifest()
        self.publish(Manifest(version=m.version, caches=m.caches, next_id=m.next_id))

    def compact(self, m: Manifest) -> bool:
        """Merge layers of `m` that have become many, and caches; ids stay. Returns whether anything was merged.

        The first layer, by far the largest, is left alone until many of its rows are gone.
        """
        gone = self.gone_ids(m)
        n_gone = gone.distinct().count() if gone is not None else 0
        whole = n_gone > self.GONE_SHARE * (m.n_chunks + n_gone)
        if len(m.layers) < self.LAYERS and len(m.gone) < self.LAYERS and not whole:
            return False
        rest = Manifest(layers=m.layers if whole else m.layers[1:], gone=m.gone)
        if rest.layers:
            folder = self.new_folder("layer")
            for name, order in (("chunks", ["id"]), ("vectors", ["id"]), ("postings", ["term", "id"])):
                self.save(self.table(rest, name).repartitionByRange(*order).sortWithinPartitions(*order), f"{folder}/{name}")
            m.layers = [*([] if whole else m.layers[:1]), folder]
        if whole:
            m.gone = []
        elif gone is not None:
            self.save(gone.distinct(), folder := self.new_folder("gone"))
            m.gone = [folder]
        if len(m.caches) > 1:
            self.save(self.cache(m), folder := self.new_folder("cache"))
            m.caches = [folder]
        return True

    def vacuum(self, retain: float | None = None) -> int:
        """Delete what no version uses that was published within `retain` seconds (RETAIN) or was the last before; returns how many.

        Only for the writer: what a running one has not yet published would go too.
        """
        m = self.manifest()
        if m is None:
            return 0
        since = time.time() - (self.RETAIN if retain is None else retain)
        there = {x.getPath().getName(): x.getModificationTime() / 1000 for x in self._fs.listStatus(self._path(self.path))}
        versions = sorted((n for n in there if n.startswith("manifest-")), reverse=True)
        recent = [n for n, later in zip(versions, [None, *versions], strict=False) if later is None or there[later] >= since]
        used = {"CURRENT", "LOCK", "PROJECT_SUMMARY.md", *recent}
        for name in recent:
            old = Manifest(**json.loads(self._read(name)))
            used |= {*old.layers, *old.gone, old.tracking, *old.caches}
        n = 0
        for name in there.keys() - used:
            if not name.startswith("."):
                n += bool(self._fs.delete(self._at(name), True))
        return n


class Lock:
    """The single writer's mark: a file with its owner's token, created only where none is, and renewed while the writer lives.

    One without a sign of life for STALE seconds is replaced; an owner whose mark is gone learns it by
    `check`, and never deletes another's.
    """

    def __init__(self, store: Store):
        self.store, self.token, self.done = store, uuid.uuid4().hex, threading.Event()

    def _owner(self) -> str | None:
        try:
            return self.store._read("LOCK")
        except Exception:
            if self.store._exists("LOCK"):
                raise
            return None

    def __enter__(self) -> Lock:
        s = self.store
        if s._exists("LOCK") and time.time() - s._fs.getFileStatus(s._at("LOCK")).getModificationTime() / 1000 > s.STALE:
            s._fs.delete(s._at("LOCK"), False)
        try:
            s._write("LOCK", self.token, overwrite=False)
        except Exception as e:
            if s._exists("LOCK"):
                raise StoreLocked(f"{s.path} has a writer") from e
            raise
        threading.Thread(target=self._renew, daemon=True).start()
        return self

    def _renew(self) -> None:
        while not self.done.wait(self.store.STALE / 5):
            if self._owner() != self.token:
                return
            now = int(time.time() * 1000)
            self.store._fs.setTimes(self.store._at("LOCK"), now, now)

    def check(self) -> None:
        if self._owner() != self.token:
            raise StoreMoved(f"{self.store.path} has another writer")

    def __exit__(self, *_) -> None:
        self.done.set()
        if self._owner() == self.token:
            self.store._fs.delete(self.store._at("LOCK"), False)


def dense_ids(store: Store, df: DataFrame, order: list[str], first: int) -> DataFrame:
    """`df` with dense ids from `first` in the order of these columns.

    Rows are written as they come, so that finding the ranges makes none of them again. Range partitions are written sorted; the row counts of the partitions, one number for each, give
    the offsets. No partition but its own ever holds a row.
    """
    made = store.save(df, came := store.new_folder("staged"))
    staged = store.save(made.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), store.new_folder("staged"))
    store.drop(came)
    part = F.shiftright("__at", 33)
    counts = sorted((r["p"], r["n"]) for r in staged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], first
    for p, n in counts:
        offsets.append((p, total))
        total += n
    columns = [pa.array(list(c), pa.int64()) for c in zip(*offsets, strict=True)] or [pa.array([], pa.int64())] * 2
    before = df.sparkSession.createDataFrame(pa.Table.from_arrays(columns, names=["p", "before"]))  # a local relation, no job
    joined = staged.withColumn("p", part).join(F.broadcast(before), "p")
    return joined.withColumn("id", F.col("before") + (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))).drop("__at", "p", "before")
