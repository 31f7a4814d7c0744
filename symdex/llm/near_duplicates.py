"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, star edges.

A document's set is its distinct word shingles, hashed to 64 bits. The top bits of a hash name its
bin, the least hash of a bin is the bin's value, and an empty bin takes the value of the first
non-empty bin of a random sequence of its own. Documents of equal sets are one class from the
start. Classes meet in the buckets of their bands; in a bucket each is compared with the least
class only, a star, so the pairs of a bucket grow with its size and not with its square. A hub's
members are dealt over parts, each of which gets the hub's set once.

A star may miss a link between two classes of which neither is its centre. Where a bucket still
holds several components after the stars, its members are compared exactly, block against
block, leaving out pairs that are connected already and yielding only edges that connect. So
every link whose two sets share a bucket takes effect, and no list of pairs ever grows with the
square of a group. Comparisons are of whole sets, by counting what members share over the
block's own inverted lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.shared import SALTS, bound_batches, components, drop, lean, materialize, mix64, resting_on, settled, split_words, table, text_blocks

SHINGLE = 5
BINS = 256
ROWS = 5
#: Chance at most that a pair just at the threshold shares no bucket.
MISS = 1e-6
#: Characters of text whose shingles are in memory at a time.
BLOCK_CHARS = 1_000_000
#: Members of a star that meet its centre in one part.
STAR = 512
#: Shingles of a bucket's members that are compared in one piece.
BLOCK_SHINGLES = 500_000

_RANDOM = np.random.default_rng(20240229)
_MULTIPLIERS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PROBES = np.stack([_RANDOM.permutation(BINS) for _ in range(BINS)])
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(56)).astype(np.uint64)


def n_bands(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands enough that a pair of this similarity is missed with a chance of `miss` at most."""
    bands = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
    if bands * rows > BINS:
        raise ValueError("the threshold is too low for the bins")
    return bands


def combined(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes."""
    h = np.full(max(0, len(words) - k + 1), np.uint64(k), np.uint64)
    for j in range(k):
        h += words[j : j + len(h)] * _MULTIPLIERS[j]
    return mix64(h)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than a shingle are one, none are none."""
    words = split_words(texts)
    whole = combined(words.hashes, shingle)
    out = []
    for lo, hi in zip(words.bounds.tolist(), words.bounds[1:].tolist(), strict=False):
        out.append(distinct(whole[lo : hi - shingle + 1]) if hi - lo >= shingle else combined(words.hashes[lo:hi], hi - lo) if hi > lo else whole[:0])
    return out


def bin_values(h: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The first `bins` densified bin values of a sorted non-empty set."""
    first = np.searchsorted(h, _EDGES)
    value = h[np.minimum(first, len(h) - 1)]
    filled = (first < len(h)) & (value >> np.uint64(56) == np.arange(BINS, dtype=np.uint64))
    out = value[:bins].copy()
    empty = np.flatnonzero(~filled[:bins])
    if len(empty):
        probe = _PROBES[empty, :24]
        usable = filled[probe]
        source = probe[np.arange(len(empty)), usable.argmax(axis=1)]
        for i in np.flatnonzero(~usable.any(axis=1)):
            source[i] = _PROBES[empty[i]][filled[_PROBES[empty[i]]].argmax()]
        out[empty] = value[source]
    return out


def fingerprints(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs; those of no set are 0."""
    two = np.array([h.sum(dtype=np.uint64), mix64(h ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)], np.uint64)
    return tuple(mix64(two).view(np.int64).tolist())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on whole sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


SIGNED = "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>"
SETS = "cid bigint, f1 bigint, shingles binary"


def signatures(docs: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, n, f1, f2, bands) for (doc_id, text); no bands for empty sets."""
    bands = n_bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in text_blocks(texts, BLOCK_CHARS):
                sets = shingle_sets(texts[lo:hi], shingle)
                live = [i for i, h in enumerate(sets) if len(h)]
                marks = np.zeros((len(sets), 2), np.int64)
                size = np.zeros(len(sets) + 1, np.int32)
                hashed = np.zeros((0, bands), np.int64)
                if live:
                    values = np.stack([bin_values(sets[i], bands * ROWS) for i in live]).reshape(len(live), bands, ROWS)
                    hashed = mix64((values * _MULTIPLIERS[:ROWS]).sum(axis=2, dtype=np.uint64) ^ salt).view(np.int64)
                    marks[live] = [fingerprints(sets[i]) for i in live]
                    size[np.array(live) + 1] = bands
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(hashed.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([len(h) for h in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), keys], names=["doc_id", "n", "f1", "f2", "bands"])

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), SIGNED)


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows SETS: the set of each class of `wanted` (cid, f1), once, from any of its rows in `docs` (cid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, marks, texts = (batch.column(i).to_pylist() for i in range(3))
            once = list({(c, f, t): None for c, f, t in zip(cids, marks, texts, strict=True)})  # repeated rows stand together
            for lo, hi in text_blocks([t for _, _, t in once], BLOCK_CHARS):
                sets = shingle_sets([t for _, _, t in once[lo:hi]], shingle)
                good = [(c, f, h) for (c, f, _), h in zip(once[lo:hi], sets, strict=True) if len(h) and fingerprints(h)[0] == f]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64()), pa.array([g[2].tobytes() for g in good], pa.binary())], names=["cid", "f1", "shingles"])

    # a text that shares its key with others meets each of their classes; only its own one passes
    rows = docs.join(wanted, "cid").select("cid", "f1", "text")
    return rows.mapInArrow(lean(run), SETS).groupBy("cid", "f1").agg(F.first("shingles").alias("shingles"))


def stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of the pairs (u, fu, v, fv) whose sets are similar.

    A centre's members are dealt over parts of about STAR; a part is read as the centre's set and
    then its members', so no row holds two sets and no task has all of a hub.
    """
    parts = pairs.groupBy("u", "fu").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    centre = sets.select(F.col("cid").alias("u"), F.col("f1").alias("fu"), "shingles").join(parts, ["u", "fu"])
    centre = centre.select("u", "fu", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("v"), "shingles")
    member = pairs.join(parts, ["u", "fu"]).select("u", "fu", F.pmod(F.xxhash64("v", "fv"), F.col("parts")).cast("int").alias("part"), "v", "fv")
    member = member.join(sets.select(F.col("cid").alias("v"), F.col("f1").alias("fv"), "shingles"), ["v", "fv"]).select("u", "fu", "part", "v", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            a, b = [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for (u, fu, part, v), packed in zip(keys, batch.column(4), strict=True):
                h = np.frombuffer(packed.as_buffer(), np.uint64)
                if v is None:
                    at, own = (u, fu, part), h.copy()
                elif at == (u, fu, part) and similar(own, h, percent):
                    a.append(u)
                    b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    bound_batches(pairs.sparkSession)
    by = ["u", "fu", "part"]
    return centre.unionByName(member).repartition(*by).sortWithinPartitions(*by, F.col("v").asc_nulls_first()).mapInArrow(lean(run), "a bigint, b bigint")


def connect(sets: list[np.ndarray], comp: np.ndarray, bands: np.ndarray, key: int, side: np.ndarray, crossed: bool, percent: int) -> list[tuple[int, int]]:
    """Edges (places) that connect the members of a block or, if `crossed`, of two; every open pair is compared.

    A pair is compared only in the first bucket that it shares and only while it isn't connected.
    """
    size = np.array([len(h) for h in sets])
    comp = comp.copy()
    column = (bands == key).argmax(axis=1)
    member = np.repeat(np.arange(len(sets)), size)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    listed = member[np.argsort(shingle, kind="stable")]
    ends = np.cumsum(np.bincount(shingle))
    start = np.cumsum(size) - size
    found = []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        open_ = (comp[rest] != comp[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
        if crossed:
            open_ &= side[rest] != side[i]
        rest = rest[open_]
        if len(rest):
            rest = rest[(bands[rest] == bands[i]).argmax(axis=1) == column[i]]
        if not len(rest):
            continue
        own = shingle[start[i] : start[i] + size[i]]
        common = np.zeros(len(sets), np.int64)
        for lists in np.array_split(own, 1 + len(own) // 4096):
            n = ends[lists] - np.where(lists > 0, ends[lists - 1], 0)
            first = np.repeat(ends[lists] - np.cumsum(n), n)
            common += np.bincount(listed[first + np.arange(len(first))], minlength=len(sets))
        near = rest[100 * common[rest] >= percent * (size[rest] + size[i] - common[rest])]
        for j in near.tolist():
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                found.append((i, j))
    return found


def connect_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) among rows (key, i, j, block, cid, comp, bands, shingles), grouped by (key, i, j) in sorted partitions."""
    columns = ["key", "i", "j", "block", "cid", "comp", "bands", "shingles"]

    def done(group: list[tuple]) -> pa.RecordBatch:
        key, i, j = group[0][:3]
        sets = [np.frombuffer(g[7], np.uint64) for g in group]
        edges = connect(sets, np.array([g[5] for g in group]), np.array([g[6] for g in group]), key, np.array([g[3] for g in group]), i != j, percent) if len(group) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([group[x][4] for x, _ in edges], pa.int64()), pa.array([group[y][4] for _, y in edges], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(columns))), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    bound_batches(rows.sparkSession)
    groups = columns[:3]
    return rows.select(*columns).repartition(*groups).sortWithinPartitions(*groups).mapInArrow(lean(run), "a bigint, b bigint")


def torn_blocks(labelled: DataFrame, sets: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows for `connect_buckets`: the members (key, cid, f1, n, comp) of buckets that hold several components, block by block.

    A block holds about BLOCK_SHINGLES, so the copies of a set grow with the shingles of its bucket
    and not with its members.
    """
    torn = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum("n").alias("n")).where("x <> y")
    torn = torn.select("key", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    rest = labelled.drop("n").join(torn, "key").withColumn("block", F.pmod(F.xxhash64("cid", "f1"), F.col("blocks")).cast("int"))
    rest = rest.join(bands, ["cid", "f1"]).join(sets, ["cid", "f1"])
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rest.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) of `found`, joined where an edge (a, b) of `more` leads from one to another."""
    if more.isEmpty():
        return found
    name = lambda c: found.withColumnRenamed("node", c).withColumnRenamed("component", f"c{c}")
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left")
    between = materialize(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "between")
    upper = settled(components(between), "upper")
    step = found.join(upper.withColumnRenamed("component", "top").withColumnRenamed("node", "component"), "component", "left")
    return step.select("node", F.coalesce("top", "component").alias("component")).unionByName(upper.join(found, "node", "left_anti"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; a
    component is all that links reach, named by its least doc_id, which is kept. Null, empty and
    blank texts have no set, are linked with nothing and kept. Rows of one doc_id are one
    document: they share its component. A row of a null doc_id links nothing; it takes the
    component of an equal set if there is one, else none, and is then kept. Other columns are ignored.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(signatures(docs, percent, shingle).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "signed")
    some = signed.where("n > 0").groupBy("f1", "f2", "salt").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = some.groupBy("f1", "f2").agg(F.min("cid").alias("cid"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.collect_set("salt").alias("salts"))
    classes = materialize(classes.where("cid is not null"), "classes")
    buckets = classes.select("cid", "f1", "n", F.explode("bands").alias("key"))
    centres = buckets.groupBy("key").agg(F.min(F.struct("cid", "f1", "n")).alias("centre"), F.count("*").alias("members")).where("members > 1")
    centres = materialize(centres.select("key", F.col("centre.cid").alias("u"), F.col("centre.f1").alias("fu"), F.col("centre.n").alias("nu")), "centres")
    multi = materialize(buckets.join(centres, "key"), "multi")
    drop(centres)

    wanted = multi.select("cid", "f1").distinct()
    sets = materialize(sets_of(docs.where("doc_id is not null").withColumnRenamed("doc_id", "cid"), wanted, shingle), "sets")
    pairs = multi.where("cid <> u").where(100 * F.least("nu", "n") >= percent * F.greatest("nu", "n"))
    pairs = materialize(pairs.select("u", "fu", F.col("cid").alias("v"), F.col("f1").alias("fv")).distinct(), "pairs")
    linked = materialize(stars(pairs, sets, percent), "stars")
    found = settled(components(linked), "components")
    drop(pairs, linked)

    labelled = multi.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    labelled = materialize(labelled.select("key", "cid", "f1", "n", "comp"), "labelled")
    drop(multi)
    more = materialize(connect_buckets(torn_blocks(labelled, sets, classes.select("cid", "f1", "bands")), percent), "more")
    drop(sets, labelled)
    found = merged(found, more)
    named = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("f1", "f2", F.coalesce("component", "cid").alias("component"), F.explode("salts").alias("salt"))
    named = materialize(named, "named")
    drop(classes, more)
    # a set's rows are spread over the salts they have; empty sets, which have no name, go by salt alone
    out = signed.select("doc_id", "n", "f1", "f2", "salt").join(named, ["f1", "f2", "salt"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return resting_on(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), signed, named)


def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component at a similarity of 0.85 (cases: see `near_duplicates`)."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document of the least doc_id stays (null last; of repeated rows, one)."""
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, key="__row")
    groups = found.where("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id")
    ranked = materialize(groups.join(numbered.select("__row", "doc_id"), "__row").select("component_id", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row").alias("x")), "ranked")
    drop(found)
    first = ranked.groupBy("component_id").agg(F.min("x").alias("x")).select("x.__row")
    gone = ranked.select("x.__row").join(first, "__row", "left_anti")
    return numbered.join(gone, "__row", "left_anti").select(*docs.columns)
