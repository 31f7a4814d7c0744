"""The corpus as a source: a listing that prunes directories, file statistics, bytes and text."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.functions import names as N
from symdex.functions.paths import content_shape, forward, has_indexed_size, is_indexed_name, prune


#: Files that are opened by name, and files whose names (about 100 bytes each) are broadcast, at most.
OPENED_FILES, BROADCAST_FILES = 2_000, 300_000
#: Characters that a path pattern would read as its own.
GLOB = r"[\[\]{}*?\\]"


class UnsafeRoot(ValueError):
    """A folder that must not be indexed as a whole."""


def resolve_root(root: str | None = None, variable: str = "SYMDEX_ROOT") -> str:
    """The folder to index: given, else of the environment, else the working folder; never the home folder or the file system's root."""
    found = Path(root or os.environ.get(variable) or os.getcwd()).resolve()
    if found in (Path.home().resolve(), Path(found.anchor)):
        raise UnsafeRoot(f"{found} is a home or root folder")
    return str(found)


def walk(root: str) -> Iterator[tuple[str, float, int]]:
    """(path from the root, time of change, size) of each file that is worth looking at; pruned folders are never listed.

    Statistics come from the listing itself. A file that can't be looked at is left out.
    """
    todo: list[tuple[str, str]] = [("", "")]  # (path from the root, name whose rules hold below)
    while todo:
        at, rules = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, at)), key=lambda e: e.name)
        except OSError:
            continue
        dirs, files = [], []
        for e in entries:
            try:
                (dirs if e.is_dir(follow_symlinks=False) else files).append(e)
            except OSError:
                continue
        name = at.rpartition("/")[2]
        if at and not rules and content_shape([d.name for d in dirs], [f.name for f in files]):
            rules = "wp-content"
        below = N.SKIPPED_BELOW.get(rules, frozenset()) if name else frozenset()
        for d in dirs:
            if d.name in N.SKIPPED_DIRS or d.name == N.OWN_DIR or d.name in below or d.name.endswith(N.SKIPPED_DIR_SUFFIXES) or not at and d.name in N.SKIPPED_ROOT_DIRS:
                continue
            todo.append((f"{at}/{d.name}" if at else d.name, d.name if d.name in N.SKIPPED_BELOW else ""))
        for f in files:
            path = f"{at}/{f.name}" if at else f.name
            dot = f.name.rfind(".")
            if f.name not in N.INDEXED_NAMES and (f.name[dot:].lower() if 0 < dot < len(f.name) - 1 else "") not in N.INDEXED_EXTENSIONS:
                continue
            try:
                stat = f.stat()
            except OSError:
                continue
            if N.LEAST_BYTES <= stat.st_size <= N.MOST_BYTES:
                yield path.replace("\\", "/"), stat.st_mtime, stat.st_size


def relative(path, root: str):
    """A column of file URIs as paths from the root, with forward slashes."""
    base = root.rstrip("/") + "/"
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "^[a-z][a-z0-9+.-]*:/*(?=/)", "")), "^/+", "/")
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(forward(plain))


def scan(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """All files below a folder of any store, or only those of `paths`: file_path, file_mtime, file_size, content (schema FILE).

    The reader opens files only if `content` is used.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    df = read.load(root) if paths is None else read.load([f"{root.rstrip('/')}/{re.sub(GLOB, _escaped, p)}" for p in paths])
    local = unquote(urlparse(root).path) if "://" in root or root.startswith("file:") else root
    return df.select(relative(F.col("path"), local).alias("file_path"), (F.unix_micros("modificationTime") / 1e6).alias("file_mtime"), F.col("length").alias("file_size"), "content")


def _escaped(m: re.Match) -> str:
    return "\\" + m[0]


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """The files that are worth looking at, with their bytes: a scan by name, size and pruned folders.

    Rules are filters of the scan; only the files below folders that are told by their shape, a few
    if any, meet it by a join.
    """
    return prune(scan(spark, root)).where(is_indexed_name(F.col("file_path")) & has_indexed_size(F.col("file_size")))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, file_mtime, file_size) by a walk on the driver, for a local folder of a moderate number of files."""
    return spark.createDataFrame(list(walk(root)), "file_path string, file_mtime double, file_size bigint")


def with_content(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """The listed files with their bytes.

    A few files are opened by their paths and no others are read. Of more, all files below the root
    are scanned; up to BROADCAST_FILES names go to the executors, so the bytes stay where they
    are read, and beyond that they are shuffled once.
    """
    few = files.select("file_path").limit(OPENED_FILES + 1).collect()
    if len(few) <= OPENED_FILES:
        if not few:
            return files.withColumn("content", F.lit(None).cast("binary"))
        found = scan(spark, root, sorted(r[0] for r in few)).select("file_path", "content")
        return found.join(F.broadcast(files), "file_path").select(*files.columns, "content")
    found = scan(spark, root).select("file_path", "content")
    small = files.select("file_path").limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    return found.join(F.broadcast(files) if small else files, "file_path").select(*files.columns, "content")


def with_text(files: DataFrame) -> DataFrame:
    """`files` with their bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
