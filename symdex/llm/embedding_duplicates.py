"""Embedding near-duplicates: NN-descent over a neighbour graph, threshold edges, exact counts inside components.

Equal vectors are one node from the start. Lists of neighbours begin from blocks of vectors that
stand together in the order of random hyperplane codes; each round joins neighbours of neighbours:
the members of a node's list, and of the lists that hold it, are compared with each other, and
what beats the end of a list enters it. A list whose every entry is a link is saturated and
becomes twice as long. An audit compares a sample with all vectors in blocks, a sample that grows
until enough of its vectors have links; rounds go on until the mean share of a vector's links that they
connect reaches the target, and, where links are so rare that the audit sees few, until lists hardly
change. Whatever the lists keep, every pair that is measured at the threshold
counts: a run or a round hands on a spanning forest of its links.

Edges at the threshold make components. The rounds only save work: at the end all pairs of vectors
of a label that are in different components are compared, tile against tile, and what links joins
components, so no link is lost, however rare. That takes time with the square of a label. Inside a component every pair is compared, block against
block, which yields counts and no pairs, so a group of any size costs rows in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from symdex.llm.shared import SALTS, bound_batches, components, drop, materialize, settled, table

THRESHOLD = 0.93
#: Length of a neighbour list at first, and of one that has been saturated again and again until the audit asks for more.
LIST, LONGEST = 10, 40
#: Orders by hyperplane codes, hyperplanes of each, and vectors compared with each other in one.
ORDERS, PLANES, RUN = 6, 32, 128
#: Members of a node that one round compares.
SAMPLE = 20
#: Rounds at least and at most; the audit may end them in between.
ROUNDS = (1, 12)
#: Vectors of the audit's sample at first and at most, those of them that should have links, and the recall that ends the rounds (never the comparison after them).
AUDIT, LARGEST_AUDIT, LINKED, RECALL = 256, 16_384, 100, 0.99
#: Share of new entries in lists below which the rounds have converged.
STILL = 0.01
#: Vectors of a component that are compared in one piece.
BLOCK = 1024
#: Bytes of vectors in a tile, and rows of one that are multiplied at a time.
TILE, STRIP = 4_000_000, 256
SEED = 20240311


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if pa.types.is_fixed_size_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def groups(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[pa.Table]:
    """Runs of rows of equal first `keys` columns in sorted batches, cut at `most` rows if it is given."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            now = tuple(c[lo] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            while most and sum(b.num_rows for b in held) + hi - lo >= most:
                cut = lo + most - sum(b.num_rows for b in held)
                yield pa.Table.from_batches([*held, batch.slice(lo, cut - lo)])
                held, lo = [], cut
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def column(t: pa.Table, i: int) -> np.ndarray:
    return t.column(i).to_numpy()


def vectors_of(t: pa.Table, i: int) -> np.ndarray:
    whole = t.column(i).combine_chunks()
    return unit(matrix(whole, len(whole[0])))


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that connect what the links of a symmetric boolean matrix connect, fewer than it has rows."""
    i, j = [], []
    left = near.any(axis=1)
    while left.any():
        edge = np.flatnonzero(left)[:1]
        left[edge] = False
        while len(edge):
            reach = near[edge]
            new = np.flatnonzero(reach.any(axis=0) & left)
            i.append(edge[reach[:, new].argmax(axis=0)] if len(new) else new)
            j.append(new)
            left[new] = False
            edge = new
    return (np.concatenate(i), np.concatenate(j)) if i else (np.array([], np.int64),) * 2


#: What is measured: candidates for lists, and links that count whether or not lists keep them.
MEASURED = "u bigint, v bigint, sim double, cap int, link boolean"


class Measured:
    """Rows of MEASURED, handed on in batches."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, u: np.ndarray, v: np.ndarray, sim: np.ndarray, cap, link: bool) -> None:
        self.parts.append((u, v, sim, np.broadcast_to(np.asarray(cap, np.int32), len(u)), np.full(len(u), link)))
        self.rows += len(u)

    def links(self, node: np.ndarray, s: np.ndarray, threshold: float) -> None:
        near = s >= threshold
        np.fill_diagonal(near, False)
        i, j = forest(near)
        self.add(node[i], node[j], s[i, j], 0, True)

    def out(self) -> pa.RecordBatch:
        kinds = (np.int64, np.int64, np.float64, np.int32, bool)
        made = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array([], k), *(p[c] for p in self.parts)])) for c, k in enumerate(kinds)], names=["u", "v", "sim", "cap", "link"])
        self.__init__()
        return made


def first_lists(nodes: DataFrame, longest: int = LIST, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of MEASURED: the best neighbours of each node in its runs of all orders, and connecting links of the runs."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(PLANES, dtype=np.int64)[::-1]
        for batch in batches:
            dims = batch.column(2).to_numpy()
            out = np.zeros((ORDERS, batch.num_rows), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED + dim).standard_normal((dim, ORDERS * PLANES))
                signs = (unit(matrix(batch.column(3).take(pa.array(at)), dim)) @ planes[dim] > 0).reshape(len(at), ORDERS, PLANES)
                out[:, at] = (signs @ powers).T
            for k in range(ORDERS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, k, np.int32)), *(batch.column(i) for i in (1, 2)), pa.array(out[k]), batch.column(0), batch.column(3)], names=["k", "label", "dim", "code", "node", "vec"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Measured()
        for t in groups(batches, 3, RUN):
            if t.num_rows < 2:
                continue
            node, x = column(t, 4), vectors_of(t, 5)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            k = min(longest, len(node) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            found.add(np.repeat(node, k), node[best].ravel(), np.take_along_axis(s, best, 1).ravel(), longest, False)
            found.links(node, s, threshold)
            if found.rows > 100_000:
                yield found.out()
        yield found.out()

    kind = nodes.schema["vec"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()
    coded = nodes.select("node", "label", "dim", "vec").mapInArrow(codes, f"k int, label {label}, dim int, code bigint, node bigint, vec {kind}")
    order = ["k", "label", "dim", "code"]
    # the node is in the range key, as a dense group may have one code
    return coded.repartitionByRange(*order, "node").sortWithinPartitions(*order, "node").mapInArrow(runs, MEASURED)


def top(lists: DataFrame) -> DataFrame:
    """The best `cap` of each u, from rows (u, v, sim, cap, fresh); an entry that was there isn't fresh."""
    once = lists.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("cap").alias("cap"), F.min("fresh").alias("fresh"))
    by = W.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= F.col("cap")).drop("rank")


def refine(graph: DataFrame, nodes: DataFrame, seed: int, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One round: rows of MEASURED that may enter lists, from neighbours of neighbours, and connecting links among these."""
    both = graph.select(F.col("u").alias("pivot"), F.col("v").alias("m"), "fresh").unionByName(graph.select(F.col("v").alias("pivot"), F.col("u").alias("m"), "fresh"))
    both = both.groupBy("pivot", "m").agg(F.max("fresh").alias("fresh"))
    by = W.partitionBy("pivot").orderBy(F.col("fresh").desc(), F.xxhash64("m", F.lit(seed)))
    members = both.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= sample).drop("rank")  # a limit by group goes before the shuffle
    ends = graph.groupBy("u").agg(F.min("sim").alias("end"), F.count("*").alias("n"), F.max("cap").alias("cap"))
    own = nodes.join(ends.withColumnRenamed("u", "node"), "node").select(F.col("node").alias("m"), "vec", F.when(F.col("n") >= F.col("cap"), F.col("end")).otherwise(-2.0).alias("end"), "cap")
    rows = members.join(own, "m").select("pivot", "m", "fresh", "end", "cap", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Measured()
        for t in groups(batches, 1):
            if t.num_rows < 2:
                continue
            m, fresh, end, cap, x = column(t, 1), column(t, 2), column(t, 3), column(t, 4), vectors_of(t, 5)
            s = x @ x.T
            open_ = (fresh[:, None] | fresh[None, :]) & (s > end[:, None])
            np.fill_diagonal(open_, False)
            i, j = np.nonzero(open_)
            found.add(m[i], m[j], s[i, j], cap[i], False)
            found.links(m, s, threshold)
            if found.rows > 100_000:
                yield found.out()
        yield found.out()

    return rows.repartition("pivot").sortWithinPartitions("pivot").mapInArrow(compare, MEASURED)


def audit(nodes: DataFrame, sample: int = AUDIT, threshold: float = THRESHOLD) -> DataFrame:
    """All links (a, b) of a sample of nodes, those of the least hashes: the sample (of a fixed size) goes to all blocks."""
    picked = nodes.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(sample).select("node", "label", "dim", "vec").collect()
    by: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r.label, r.dim) for r in picked}:
        own = [r for r in picked if (r.label, r.dim) == key]
        by[key] = np.array([r.node for r in own]), unit(np.array([r.vec for r in own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, dim = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
            u, v = [], []
            for (k, d), (names, x) in by.items():
                at = np.flatnonzero((label == k) & (dim == d))
                if len(at):
                    i, j = np.nonzero(x @ unit(matrix(batch.column(3).take(pa.array(at)), d)).T >= threshold)
                    u.append(names[i])
                    v.append(node[at[j]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u) if u else np.array([], np.int64)), pa.array(np.concatenate(v) if v else np.array([], np.int64))], names=["a", "b"])

    return nodes.select("node", "label", "dim", "vec").mapInArrow(run, "a bigint, b bigint").where("a <> b")


def audited(nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, int, int]:
    """Links (a, b) of a sample, the sample's nodes that have any, and the sample's size: it grows until LINKED have, up to LARGEST_AUDIT or all nodes."""
    size, every = AUDIT, nodes.count()
    while True:
        true = materialize(audit(nodes, size, threshold), "audit")
        linked = true.select("a").distinct().count()
        if linked >= LINKED or size >= min(every, LARGEST_AUDIT):
            return true, linked, size
        drop(true)
        size = min(size * 8, LARGEST_AUDIT)


def recall_of(true: DataFrame, joined: DataFrame) -> float | None:
    """Mean share, by linked node of the audit, of its links whose ends are in one component; None without any."""
    name = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    met = true.join(name("a"), "a", "left").join(name("b"), "b", "left").withColumn("met", F.coalesce((F.col("ca") == F.col("cb")).cast("double"), F.lit(0.0)))
    return met.groupBy("a").agg(F.avg("met").alias("r")).agg(F.avg("r")).first()[0]


def descend(nodes: DataFrame, threshold: float = THRESHOLD, longest: int = LIST, least_recall: float = RECALL) -> tuple[DataFrame, float | None]:
    """Components (node, component) of all links that were measured, and their recall by the audit (None if it saw no link)."""
    entries = lambda df: df.where(~F.col("link")).drop("link").withColumn("fresh", F.lit(True))
    ends = lambda df: df.where("link").select(F.col("u").alias("a"), F.col("v").alias("b"))
    start = materialize(first_lists(nodes, longest, threshold), "measured")
    links = materialize(ends(start).distinct(), "links")
    graph = materialize(top(entries(start)), "lists")
    drop(start)
    true, linked, _ = audited(nodes, threshold)
    most = LONGEST
    for turn in range(1, ROUNDS[1] + 1):
        size = graph.groupBy("u").agg(F.count("*").alias("n"), F.max("cap").alias("c"), F.min("sim").alias("end"))
        full = (F.col("n") >= F.col("c")) & (F.col("end") >= threshold)
        caps = size.select("u", F.when(full, F.least(F.col("c") * 2, F.lit(most))).otherwise(F.col("c")).cast("int").alias("cap"))
        graph = graph.drop("cap").join(caps, "u").select("u", "v", "sim", "cap", "fresh")
        graph = materialize(graph, "capped")
        found = materialize(refine(graph, nodes, turn, threshold=threshold), "measured")
        spent = links
        links = materialize(links.unionByName(ends(found)).distinct(), "links")
        graph = materialize(top(graph.withColumn("fresh", F.lit(False)).unionByName(entries(found))), "lists")
        drop(found, spent)
        if turn < ROUNDS[0]:
            continue
        moved = graph.agg(F.avg(F.col("fresh").cast("double"))).first()[0] or 0.0
        joined = settled(components(links), "components")
        recall = recall_of(true, joined)
        if (recall is None or recall >= least_recall) and (linked >= LINKED or moved <= STILL):
            break
        most *= 2
    return joined, recall


def across(nodes: DataFrame, joined: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All links between components as rows (a, b) of their names; a node without a component is its own.

    A label's vectors are dealt over tiles, each one row, and every two tiles meet once, so rows
    grow with the square of a label's tiles and not of its vectors.
    """
    bound_batches(nodes.sparkSession)
    wide = 4 if nodes.schema["vec"].dataType.elementType.simpleString() == "float" else 8
    label = nodes.schema["label"].dataType.simpleString()
    named = nodes.select("node", "label", "dim", "vec").join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") * F.col("dim") * wide / TILE).cast("int").alias("tiles"))
    rows = named.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            raw = matrix(t.column(5).combine_chunks(), t.column(1)[0].as_py())
            yield pa.RecordBatch.from_arrays([*(t.column(i)[:1].combine_chunks() for i in range(4)), pa.array([column(t, 4).astype(np.int64).tobytes()], pa.binary()), pa.array([raw.astype(f"f{wide}").tobytes()], pa.binary())], names=["label", "dim", "tile", "tiles", "c", "x"])

    parts = ["label", "dim", "tile"]
    packed = rows.select(*parts, "tiles", "c", "vec").repartition(*parts).sortWithinPartitions(*parts).mapInArrow(pack, f"label {label}, dim int, tile int, tiles int, c binary, x binary")
    packed = materialize(packed, "tiles")
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("label", "dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "c", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 4):
            dim = t.column(1)[0].as_py()
            sides = [(np.frombuffer(t.column(4)[k].as_py(), np.int64), unit(np.frombuffer(t.column(5)[k].as_py(), f"f{wide}").reshape(-1, dim))) for k in range(t.num_rows)]
            (c, x), (d, y) = sides[0], sides[-1]
            seen = set()
            for lo in range(0, len(c), STRIP):
                here = c[lo : lo + STRIP]
                i, j = np.nonzero((x[lo : lo + STRIP] @ y.T >= threshold) & (here[:, None] != d))
                seen.update(zip(np.minimum(here[i], d[j]).tolist(), np.maximum(here[i], d[j]).tolist(), strict=True))
            a, b = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts = ["label", "dim", "i", "j"]
    return pairs.repartition(*parts).sortWithinPartitions(*parts).mapInArrow(compare, "a bigint, b bigint").distinct()


def closed(nodes: DataFrame, joined: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Components (node, component) of all links: those of `joined`, merged where any link leads from one to another."""
    found = materialize(across(nodes, joined, threshold), "across")
    if found.isEmpty():
        return joined
    whole = settled(components(found), "merged").select(F.col("node").alias("c"), F.col("component").alias("into"))
    named = nodes.select("node").join(joined, "node", "left").withColumn("c", F.coalesce("component", "node")).join(whole, "c", "left")
    return materialize(named.where("component is not null or into is not null").select("node", F.coalesce("into", "component").alias("component")), "closed")


def count_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (node, links): linked vectors of other nodes of its component; members has component, node, members, vec."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "members", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            block, node, weight, x = column(t, 3), column(t, 4), column(t, 5), vectors_of(t, 6)
            if i == j:
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(near @ weight)], names=["node", "links"])
                continue
            a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
            near = x[a] @ x[b].T >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[a], node[b]])), pa.array(np.concatenate([near @ weight[b], near.T @ weight[a]]))], names=["node", "links"])

    parts = ["component", "i", "j"]
    found = rows.repartition(*parts).sortWithinPartitions(*parts).mapInArrow(run, "node bigint, links bigint")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def embedding_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of `df`: key, n_links, component_id, kept, descent_recall.

    descent_recall, the same in all rows, is what share of the audited links the rounds alone connect
    (null if the audit saw none); n_links and component_id are whole whatever it is.

    Vectors of equal non-null labels and equal length link from a cosine of `threshold` on. Null, empty
    and zero vectors, those with null or non-finite components, and rows of a null label or a null
    key link with nothing and are their own component (a null key's is null) and kept. Rows of
    equal vectors are linked with each other; repeated keys are vectors of their own. An empty
    table gives an empty result; other columns are ignored.
    """
    vec = F.col(vector)
    fine = F.coalesce((F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), vec.alias("vec"), fine.alias("fine"))
    rows = rows.withColumn("fine", F.col("fine") & F.col("label").isNotNull() & F.col("id").isNotNull())
    rows = rows.withColumns({"h1": F.when(F.col("fine"), F.xxhash64("label", "vec")), "h2": F.when(F.col("fine"), F.xxhash64(F.lit(SEED), "vec", "label")), "salt": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")})
    first = rows.where("fine").groupBy("h1", "h2", "salt").agg(F.min("id").alias("id"), F.count("*").alias("members"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    nodes = first.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.sum("members").alias("members"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.collect_set("salt").alias("salts"))
    nodes = nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vec")})
    nodes = materialize(nodes, "nodes")
    found, recall = descend(nodes, threshold)
    joined = closed(nodes, found, threshold)
    members = joined.join(nodes.select("node", "id", "members", "vec"), "node")
    least = members.groupBy("component").agg(F.min("id").alias("least"))
    links = count_links(members, threshold)
    told = joined.join(least, "component").join(links, "node", "left").select("node", "least", "links")
    info = nodes.select("node", "h1", "h2", "id", "members", F.explode("salts").alias("salt")).join(told, "node", "left")
    info = info.select("h1", "h2", "salt", F.least("least", "id").alias("component_id"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("id", "h1", "h2", "salt").join(info, ["h1", "h2", "salt"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))).withColumn("descent_recall", F.lit(recall).cast("double"))


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their links and components at a cosine of 0.93 (cases: see `embedding_duplicates`)."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))
