"""Helpers that the corpus operators share: tables, work folders, hashing, components."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the shingle, mixing and language-model operators: runs without ASCII white space.
BLANK = r"[^\x20\x09-\x0D]+"
#: Rows an Arrow batch holds at most while whole texts travel to Python.
TEXT_BATCH_ROWS = 2000
#: Bytes after which an Arrow batch ends; a larger row travels alone.
TEXT_BATCH_BYTES = 4_000_000
#: Characters of text that a Python worker takes apart at a time.
TEXT_BLOCK_CHARS = 1_000_000
#: Bytes of text whose words are hashed at a time; each takes some 40 bytes while it is.
HASH_BYTES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder, opened by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """This application's folder for work tables in the folder that driver and executors share, spark.checkpoint.dir of the session.

    Only in a local session where that is unset, as in tests, a temporary folder takes its place.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", "") or _LOCAL.get(app)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = _LOCAL[app] = Path(tempfile.mkdtemp(prefix="symdex-")).as_uri()
    return f"{base.rstrip('/')}/symdex/{app}"


def drop_work(spark: SparkSession) -> None:
    """Delete this application's work tables; results that haven't been read or written yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs no more than the stage at hand, and it lets
    several consumers read one result. The writers of zstd hold native memory for each column and
    file, so that codec is only for few large files.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}/{label}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_paths = [path]
    return out


def resting_on(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """`df`, noted to need these work tables until it has been read for good."""
    df.work_paths = [p for t in (df, *tables) for p in getattr(t, "work_paths", [])]
    return df


def drop(*tables: DataFrame | None) -> None:
    """Delete work tables (or those that a frame rests on) that nothing reads any more, so that disks hold no spent ones."""
    for t in tables:
        for path in getattr(t, "work_paths", []):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if t is not None:
            t.work_paths = []


def bound_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS, size: int = TEXT_BATCH_BYTES) -> None:
    """Keep Arrow batches of whole texts small, in rows and bytes; lower settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else, as the contracts ask."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_text(c: Column) -> Column:
    """A record key as text; a null key has a text of its own."""
    return F.coalesce(c.cast("string"), F.lit("\\N"))


def hash52(text: Column) -> Column:
    """52 bits of MD5 as a long: the same number in any engine that has MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def text_blocks(texts: list, limit: int = TEXT_BLOCK_CHARS):
    """(start, end) ranges over `texts` of about `limit` characters each; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def mix64(h: np.ndarray) -> np.ndarray:
    """A finalizer of 64 bits: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_SOLID = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE_VALUES = (np.random.default_rng(20240117).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _SOLID
_BASE = np.uint64(0xD1342543DE82EF95)


@dataclass
class Words:
    """The words of some texts in ASCII lower case: their hashes, where they begin and end in `raw`, and the words of text i as bounds[i]:bounds[i + 1]."""

    raw: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def split_words(texts: list[str | None]) -> Words:
    """The words (runs without ASCII white space) of all texts at once; none of a null.

    A word's hash is a polynomial of random values of its bytes, finished by `mix64`. No object is
    made for a word, and a text of any length is hashed HASH_BYTES at a time.
    """
    parts = [t.encode().lower() if t else b"" for t in texts]
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    solid = _SOLID[raw]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1  # begins and ends by turns
    first, last = edge[::2], edge[1::2]
    begins = np.cumsum([1, *(len(p) + 1 for p in parts)])
    hashes = np.empty(len(first), np.uint64)
    power = np.ones(1, np.uint64)
    cuts = np.unique(np.searchsorted(first, np.arange(0, len(raw) + HASH_BYTES, HASH_BYTES)))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        start, end = first[lo], last[hi - 1]
        at = first[lo:hi] - start
        reach = np.diff(np.append(at, end - start))
        longest = int(reach.max())
        if longest > len(power):
            power = np.cumprod(np.full(longest, _BASE, np.uint64))
        place = np.arange(end - start) - np.repeat(at, reach)
        hashes[lo:hi] = np.add.reduceat(_BYTE_VALUES[raw[start:end]] * power[place], at)
    return Words(raw, first, last, mix64(hashes), np.searchsorted(first, begins))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; when it ends, the worker, which Spark keeps for later tasks, hands its free memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges` as rows (node, component), component the least node.

    Alternates large-star and small-star steps: every step points nodes to smaller ones and the
    number of edges never grows, so a hub of any degree is only ever grouped by partial
    aggregates. Nodes without an edge are not in the result. Each round is written to the
    shared folder; the run ends when a round changes nothing.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    cur = materialize(one.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("g")).first()
        return r["n"], r["h"], r["g"]

    def hub(df: DataFrame) -> DataFrame:
        """a with the least of itself and all its neighbours b."""
        return df.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))

    seen = mark(cur)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        spent = cur
        large = materialize(both.join(hub(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = hub(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")).where("a <> b"))
        cur = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")
        drop(spent, large)
        now = mark(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components haven't settled in {rounds} rounds")
    # at the fixed point every edge leads to the least node of its component
    leaf = cur.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return resting_on(leaf.unionByName(leaf.select(F.col("component").alias("node"), "component").distinct()), cur)


def settled(df: DataFrame, label: str) -> DataFrame:
    """`df` written; the work tables that it rested on are dropped."""
    out = materialize(df, label)
    drop(df)
    return out


#: Parts over which the rows of one group are dealt.
SALTS = 64


def attach_group(df: DataFrame, key: str, salt_by: str, aggs: dict[str, tuple[str, str]], salts: int = SALTS) -> DataFrame:
    """`df` with aggregates {name: (max, min, sum or count, column)} of each row's group by a non-null `key`.

    Groups are aggregated by (key, salt) and then by key; the outcome goes back to the salts in
    which the group has rows, so a hot group is spread over `salts` tasks and is never gathered.
    """
    merge = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    part = salted.groupBy(key, "__salt").agg(*[getattr(F, how)(c).alias(name) for name, (how, c) in aggs.items()])
    whole = part.groupBy(key).agg(*[merge[how](name).alias(name) for name, (how, _) in aggs.items()], F.collect_set("__salt").alias("__salts"))
    back = whole.withColumn("__salt", F.explode("__salts")).drop("__salts")
    return salted.join(back, [key, "__salt"]).drop("__salt")
