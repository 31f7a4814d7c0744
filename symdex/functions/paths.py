"""Path predicates: which directories a scan enters and which files it keeps, as columns and for a lister on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex.functions import names as N


def forward(path: Column) -> Column:
    """A path with forward slashes."""
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The suffix with its dot: what follows the last dot of the name. A name that begins with its last dot or ends with it has none."""
    name = file_name(path)
    behind = F.substring_index(name, ".", -1)
    before = F.substring(name, F.lit(1), F.length(name) - F.length(behind) - 1)
    return F.when(F.contains(name, F.lit(".")) & (behind != "") & (F.ltrim(before, F.lit(".")) != ""), F.concat(F.lit("."), behind)).otherwise("")


def is_indexed_name(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*sorted(N.INDEXED_EXTENSIONS)) | file_name(path).isin(*sorted(N.INDEXED_NAMES))


def has_indexed_size(size: Column) -> Column:
    return size.between(N.LEAST_BYTES, N.MOST_BYTES)


def looks_like_content(dirs: Column, files: Column) -> Column:
    """Whether child names (arrays) are those of a content directory: three markers, and must-use plugins or an index page."""
    markers = F.array(*[F.lit(x) for x in sorted(N.CONTENT_MARKERS)])
    return (F.size(F.array_intersect(dirs, markers)) >= 3) & (F.array_contains(dirs, "mu-plugins") | F.array_contains(files, "index.php"))


def content_shape(dirs: Iterable[str], files: Iterable[str]) -> bool:
    """The same test on the driver."""
    dirs = set(dirs)
    return len(dirs & N.CONTENT_MARKERS) >= 3 and ("mu-plugins" in dirs or "index.php" in set(files))


def skipped_by_name(segments: Column) -> Column:
    """Whether a path's directories (array, root first) are skipped for their own names."""
    suffixes = lambda x: F.endswith(x, F.lit(N.SKIPPED_DIR_SUFFIXES[0])) | F.endswith(x, F.lit(N.SKIPPED_DIR_SUFFIXES[1]))
    at_root = F.coalesce(F.get(segments, F.lit(0)).isin(*sorted(N.SKIPPED_ROOT_DIRS)), F.lit(False))
    return F.arrays_overlap(segments, F.array(*[F.lit(x) for x in sorted(N.SKIPPED_DIRS | {N.OWN_DIR})])) | F.exists(segments, suffixes) | at_root


def skipped_by_parent(segments: Column) -> Column:
    """Whether a directory stands below a parent, itself not at the root of the scan, where its name is skipped."""
    pairs = F.zip_with(segments, F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def bad(p: Column) -> Column:
        found = F.lit(False)
        for parent, children in N.SKIPPED_BELOW.items():
            found = found | ((p["a"] == parent) & p["b"].isin(*sorted(children)))
        return F.coalesce(found, F.lit(False))

    return F.exists(pairs, bad)


def prune(files: DataFrame, path: str = "file_path") -> DataFrame:
    """The rows of a listing that a pruning scan would reach.

    Name rules are tests of one path. A content directory is told by its children: one row of
    distinct child names for each directory (bounded by the directory's own entries), and its
    descendants meet it by a join on the path of each of their ancestors.
    """
    parts = F.split(path, "/")
    df = files.withColumn("__dirs", F.slice(parts, F.lit(1), F.size(parts) - 1))
    df = df.where(~skipped_by_name(F.col("__dirs")) & ~skipped_by_parent(F.col("__dirs")))
    # children of each directory among the rows that are left; "" is the root
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("dir"), F.get(parts, i - 1).alias("child"), (i < F.size(parts)).alias("is_dir"))))
    wanted = sorted(N.CONTENT_MARKERS | {"index.php"})
    children = df.where(F.arrays_overlap(parts, F.array(*map(F.lit, wanted)))).select(steps.alias("x")).select("x.*").where(F.col("child").isin(*wanted) & (F.col("dir") != "")).groupBy("dir")
    shapes = children.agg(F.collect_set(F.when(F.col("is_dir"), F.col("child"))).alias("dirs"), F.collect_set(F.when(~F.col("is_dir"), F.col("child"))).alias("files"))
    own_rule = F.element_at(F.split("dir", "/"), -1).isin(*sorted(N.SKIPPED_BELOW))
    shapes = shapes.where(looks_like_content(F.col("dirs"), F.col("files")) & ~own_rule).select("dir")
    below = df.where(F.exists("__dirs", lambda x: x.isin(*sorted(N.SKIPPED_BELOW["wp-content"])))).select(path, F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size("__dirs")), lambda i: F.struct(F.array_join(F.slice("__dirs", F.lit(1), i - 1), "/").alias("dir"), F.get("__dirs", i - 1).alias("child"))), lambda x: x["child"].isin(*sorted(N.SKIPPED_BELOW["wp-content"])))).alias("x"))
    gone = below.select(path, "x.dir").join(shapes, "dir", "left_semi").select(path).distinct()
    # only rows with such a name among their directories meet the join, so no others are shuffled
    may_go = F.exists("__dirs", lambda x: x.isin(*sorted(N.SKIPPED_BELOW["wp-content"])))
    return df.where(~may_go).unionByName(df.where(may_go).join(gone, path, "left_anti").select(*df.columns)).drop("__dirs")
