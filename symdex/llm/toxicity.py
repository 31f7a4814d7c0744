"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts become bytes in which A-Z are lower case and other ASCII than letters and digits is a
space. The 3- to 6-grams of those bytes are hashed into 2**18 features, present or not. A
feature's value is its naive Bayes log-count ratio between labels 1 and 0; logistic regression
weighs the scaled features. Features whose share doesn't differ clearly between the labels have
the value 0, so that a long text of ordinary words gathers no score by its length.

The classifier is fitted to a bounded sample of labelled rows (SAMPLE for each label), each by the
features of its whole text; every document is then scored whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.near_duplicates import shingle_sets
from symdex.llm.shared import bound_batches, drop, lean, materialize, mix64, table, text_blocks

BITS = 18
GRAMS = (3, 4, 5, 6)
#: Labelled rows of each label that the classifier is fitted to, at most.
SAMPLE = 4000
#: Bytes of text that are taken apart at a time; each takes about 40 bytes while it is.
PIECE = 250_000
#: Standard errors by which a feature's share must differ between the labels.
CLEAR = 4.0
THRESHOLD = 0.7
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_GAP = b" " * max(GRAMS)


def features(raw: np.ndarray) -> Iterator[np.ndarray]:
    """For each n: the feature of every n-gram of some bytes, by its place."""
    raw = raw.astype(np.uint32)
    for n in GRAMS:
        h = np.full(max(0, len(raw) - n + 1), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ raw[k : k + len(h)] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        yield h >> np.uint32(32 - BITS)


def present(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, of the features that `wanted` marks if it is given.

    No n-gram spans two texts. PIECE bytes are taken apart at a time, overlapping by the longest
    n-gram, so a text of any length needs little more than its own bytes.
    """
    parts = [t.encode().translate(_BYTES) if t else b"" for t in texts]
    raw = np.frombuffer(_GAP + _GAP.join(parts) + _GAP, np.uint8)
    starts = np.cumsum([0] + [len(p) + len(_GAP) for p in parts])
    found: list[np.ndarray] = [np.array([], np.int64)]
    for lo in range(0, len(raw), PIECE):
        own = []
        for f in features(raw[lo : lo + PIECE + max(GRAMS) - 1]):
            f = f[:PIECE]  # longer n-grams end earlier, so shorter ones reach into the next piece
            at = np.arange(len(f)) if wanted is None else np.flatnonzero(wanted[f])
            doc = np.minimum(np.searchsorted(starts, at + lo, side="right") - 1, len(texts) - 1)
            own.append(doc.astype(np.int64) << BITS | f[at])
        found.append(np.unique(np.concatenate(own)))
        if sum(map(len, found[1:])) > 4 * max(PIECE, len(found[0])):
            found = [np.unique(np.concatenate(found))]
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of weights of the features that are present)))."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        doc, f = present(texts, self.weights != 0)
        z = self.bias + np.bincount(doc, self.weights[f], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def distinct_rows(marks: list[tuple[int, ...]]) -> list[int]:
    """Places of rows that share no mark with an earlier one: copies and near copies count once."""
    seen: set[int] = set()
    out = []
    for i, own in enumerate(marks):
        if not seen & set(own):
            out.append(i)
        seen |= set(own)
    return out


def ratios(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Naive Bayes log-count ratio of each feature, 0 for those whose share doesn't differ clearly."""
    every = ones + zeros
    both = every / (n1 + n0)
    clear = np.abs(ones / n1 - zeros / n0) > CLEAR * np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
    return np.where(clear & (every >= 3), np.log((ones + 1) / (ones + 1).sum()) - np.log((zeros + 1) / (zeros + 1).sum()), 0.0)


def fit(features_of: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> Model:
    """Logistic regression on the scaled features of the rows (their features with a ratio other than 0)."""
    if not y.sum() or y.all():  # one label only: its share is the score everywhere
        return Model(np.zeros(1 << BITS), 30.0 if len(y) and y.all() else -30.0)
    doc = np.repeat(np.arange(len(y)), [len(f) for f in features_of])
    names, feat = np.unique(np.concatenate(features_of), return_inverse=True)
    x, weight, bias = ratio[names][feat], np.zeros(len(names)), 0.0
    balance = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both labels weigh the same
    m = v = np.zeros(len(names) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(doc, weight[feat] * x, len(y))
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * balance
        grad = np.append(np.bincount(feat, err[doc] * x, len(names)) + ridge * weight, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    full = np.zeros(1 << BITS)
    full[names] = weight * ratio[names]
    return Model(full, float(bias))


def remainder(key: Column, of: int) -> Column:
    """crc32(key as text) mod `of`; null for a null key."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % of


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit to labelled rows whose remainder mod 3 isn't 1.

    The sample is the rows of each label with the least key hashes, `sample` of them; the chosen
    keys are few enough to broadcast. Keys with both labels, null keys and null labels teach
    nothing. The texts stay on the executors: they make each row's features and count them; the
    driver gets two counts for each of the 2**18 features and then, of the sample, the features
    that tell the labels apart.
    """
    own = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    own = own.where(remainder(F.col(key), 3) != 1).select(key, "y")
    picked = [own.where(f"y = {y}").orderBy(F.xxhash64(key), key).limit(sample) for y in (0, 1)]
    rows = docs.join(F.broadcast(picked[0].unionByName(picked[1])), key).select(F.col(key).cast("string").alias("k"), F.col("y").cast("long").alias("y"), F.col(text).alias("t"))

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, y, texts = (batch.column(i) for i in range(3))
            texts = texts.to_pylist()
            for lo, hi in text_blocks(texts):
                doc, f = present(texts[lo:hi])
                cut = np.searchsorted(doc, np.arange(1, hi - lo))
                marks = [[int(h.min()), int(mix64(h + np.uint64(7)).min())] if len(h) else [0, 0] for h in shingle_sets(texts[lo:hi])]
                marks = np.array(marks, np.uint64).view(np.int64)
                packed = [x.astype(np.int32).tobytes() for x in np.split(f, cut)]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), y.slice(lo, hi - lo), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(packed, pa.binary())], names=["k", "y", "m1", "m2", "f"])

    bound_batches(docs.sparkSession)
    parts = materialize(rows.mapInArrow(lean(take_apart), "k string, y bigint, m1 bigint, m2 bigint, f binary"), "features")
    first = sorted(map(tuple, parts.select("k", "y", "m1", "m2").toArrow().to_pandas().to_numpy().tolist()))
    keep = {first[i][0]: first[i][1] for i in distinct_rows([x[2:] for x in first])}
    n1 = sum(keep.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for k, y, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k in keep:
                    both[y, np.frombuffer(f, np.int32)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["c"])

    counts = np.zeros((2, 1 << BITS), np.int64)
    once = parts.dropDuplicates(["k"])
    for row in once.select("k", "y", "f").coalesce(4).mapInArrow(lean(count), "c binary").toLocalIterator():
        counts += np.frombuffer(row[0], np.int32).reshape(2, -1)
    ratio = ratios(counts[1], counts[0], n1, len(keep) - n1) if 0 < n1 < len(keep) else np.zeros(1 << BITS)

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, f = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            f = [(x := np.frombuffer(b, np.int32))[ratio[x] != 0].tobytes() for b in f]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(f, pa.binary())], names=["k", "f"])

    got = once.select("k", "f").mapInArrow(lean(telling), "k string, f binary").toArrow()
    drop(parts)
    rows = sorted((k, f) for k, f in zip(got["k"].to_pylist(), got["f"].to_pylist(), strict=True) if k in keep)
    return fit([np.frombuffer(f, np.int32) for _, f in rows], np.array([keep[k] for k, _ in rows], float), ratio)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """`docs` with the score (double) of each whole text; an empty or null text has the score of no feature."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # 2 MB whatever the input; plain values need no class on the executors
    bound_batches(spark)
    at = docs.columns.index(text)
    schema = docs.drop(column).schema.add(column, "double")
    keep = [i for i, c in enumerate(docs.columns) if c != column]
    names = [*(docs.columns[i] for i in keep), column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = Model(*shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for lo, hi in text_blocks(texts):
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in keep), pa.array(own_model.scores(texts[lo:hi]))], names=names)

    return docs.mapInArrow(lean(run), schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the score of the classifier that `labels.toxic` trains.

    Nulls: a null doc_id isn't held out; a null text scores as an empty one. Repeated rows score
    alike. Without labels every score is near 0. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    # the text has done its work in Python and needn't come back
    scored = score(docs, model).select("doc_id", held.alias("held_out"), "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without those of a score of 0.7 or more.

    Null and empty texts have the score of no feature and repeated rows score alike, so they stay or
    go as others do; an empty table stays empty.
    """
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score(docs, model, column="__score").where(f"__score < {THRESHOLD}").drop("__score")
