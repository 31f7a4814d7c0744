"""LM scoring: a hidden Markov language model.

Tokens are counted over all training documents. The VOCAB most frequent ones are symbols of their
own; each other token is a symbol of its class (its ending and shape), and its probability within
the class comes from its count. So the model has a fixed size and yet gives every text a
probability: forward recursion over symbols times the class terms.

Baum-Welch: every task runs scaled forward-backward over its share of all training documents, each
from its first token to its end, and sends expected counts, whose size is fixed, to be summed by
slice of the symbols; the driver divides them. A very long document is worked through in pieces
that hand on the exact forward and backward messages. A score is the exact likelihood of the whole
text: the scaled forward recursion runs from its first token to its end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.shared import Words, bound_batches, lean, materialize, split_words, table, text_blocks
from symdex.llm.toxicity import remainder

#: Symbols of single tokens, classes of all other tokens, and latent states.
VOCAB, CLASSES, STATES = 60_000, 128, 8
ROUNDS = 6
#: Tokens that are worked on together, and those of a document from which on it is worked through piece by piece.
BLOCK_TOKENS = 200_000
PIECE = 200_000
#: Steps after which a recursion is scaled.
SCALE = 8
#: Distinct tokens of blocks that a task holds before it adds them up, and then sends on if they are still half as many.
COUNT_AT = 400_000
#: Symbols of a slice of expected counts.
SLICE = 2_000
END = VOCAB + CLASSES
SYMBOLS = END + 1
SEED = 20240421


def class_of(words: Words, at: np.ndarray) -> np.ndarray:
    """The class of each of these tokens: its last two bytes, and whether it has digits or is long."""
    first, last = words.first[at], words.last[at]
    final = words.raw[last - 1].astype(np.int64)
    other = np.where(last - first > 1, words.raw[np.maximum(last - 2, 0)], 0).astype(np.int64)
    digits = np.concatenate([[0], np.cumsum((words.raw >= 48) & (words.raw <= 57), dtype=np.int32)])
    return (final * 31 + other * 7 + (last - first > 8) * 3 + (digits[last] > digits[first]) * 5) % CLASSES


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token counts (hash, class, count) of several parts as one, each hash once."""
    h, k, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    once, at, where = np.unique(h, return_index=True, return_inverse=True)
    return once, k[at], np.bincount(where, c, len(once)).astype(np.int64)


def count_tokens(docs: DataFrame) -> DataFrame:
    """Rows (h, class, c): 64-bit hash, class and count of each distinct token of `docs` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.array([], np.uint64), np.array([], np.int64), np.array([], np.int64))
        held = [none]

        def out(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(x[0])), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names=["h", "class", "c"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in text_blocks(texts):
                words = split_words(texts[lo:hi])
                h, at, c = np.unique(words.hashes, return_index=True, return_counts=True)
                held.append((h, class_of(words, at), c))
                if sum(len(x[0]) for x in held) >= COUNT_AT:
                    held = [added(held)]
                    if len(held[0][0]) >= COUNT_AT // 2:
                        yield out(held[0])
                        held = [none]
        yield out(added(held))

    bound_batches(docs.sparkSession)
    part = docs.select("text").mapInArrow(lean(run), "h bigint, class int, c bigint")
    return part.groupBy("h").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


@dataclass
class Counts:
    """What of the token counts has a fixed size."""

    hashes: np.ndarray  # of the tokens that are symbols, ascending, as unsigned
    counts: np.ndarray  # theirs
    class_tokens: np.ndarray  # of the other tokens: sum of counts, and distinct ones, by class
    class_words: np.ndarray
    ends: int  # training documents

    @property
    def total(self) -> int:
        return int(self.counts.sum() + self.class_tokens.sum()) + self.ends

    @property
    def distinct(self) -> int:
        return len(self.hashes) + int(self.class_words.sum()) + (self.ends > 0)

    @property
    def log_whole(self) -> float:
        """log10 of N + 0.5 (V + 1)."""
        return math.log10(self.total + 0.5 * (self.distinct + 1))

    @property
    def class_log(self) -> np.ndarray:
        """log10 of the whole within each class, made like the one above."""
        return np.log10(self.class_tokens + 0.5 * (self.class_words + 1))

    def shares(self) -> np.ndarray:
        """Smoothed share of each symbol."""
        p = np.full(SYMBOLS, 0.5)
        p[: len(self.counts)] += self.counts
        p[VOCAB:END] += self.class_tokens
        p[END] += self.ends
        p[len(self.counts) : VOCAB] = 0.0
        return p / p.sum()


def gather(counts: DataFrame, ends: int) -> Counts:
    top = counts.orderBy(F.col("c").desc(), "h").limit(VOCAB)
    got = top.select("h", "class", "c").toArrow()
    h, k, c = (got[x].to_numpy() for x in ("h", "class", "c"))
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    rest = {r["class"]: (r["n"], r["v"]) for r in counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tokens = np.array([rest.get(i, (0, 0))[0] for i in range(CLASSES)]) - np.bincount(k, c, CLASSES).astype(np.int64)
    words = np.array([rest.get(i, (0, 0))[1] for i in range(CLASSES)]) - np.bincount(k, minlength=CLASSES)
    return Counts(h[order], c[order].astype(np.int64), tokens, words, ends)


ENCODED = "doc_id bigint, held_out boolean, n_tokens bigint, symbols binary, sure double, known bigint, class_log double, rare array<bigint>"


def encode(docs: DataFrame, counts: Counts) -> DataFrame:
    """Rows ENCODED of (doc_id, held_out, text).

    `symbols` are uint16; `sure` sums log10(c + 0.5) over the tokens that are symbols and the end,
    `known` counts those with c > 0; `rare` are the hashes of the others and `class_log` sums what
    their classes' wholes take away.
    """
    shared = docs.sparkSession.sparkContext.broadcast((counts.hashes, np.log10(counts.counts + 0.5), counts.class_log, counts.ends))  # 1 MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, logs, class_log, ends = shared.value
        names = [x.split()[0] for x in ENCODED.split(", ")]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in text_blocks(texts):
                words = split_words(texts[lo:hi])
                size, h = np.diff(words.bounds), words.hashes
                at = np.searchsorted(hashes, h)
                known = (at < len(hashes)) & (hashes[np.minimum(at, max(len(hashes) - 1, 0))] == h) if len(hashes) else np.zeros(len(h), bool)
                rare = np.flatnonzero(~known)
                symbols = at.astype(np.uint16)
                kinds = class_of(words, rare)
                symbols[rare] = VOCAB + kinds
                doc = np.repeat(np.arange(len(size)), size)
                start = np.concatenate([[0], np.cumsum(size)])
                sure = np.bincount(doc[known], logs[at[known]], len(size)).astype(float) + math.log10(ends + 0.5)
                away = np.bincount(doc[rare], class_log[kinds], len(size)).astype(float)
                n_known = np.bincount(doc[known], minlength=len(size)) + (ends > 0)
                first = np.searchsorted(rare, start)
                end = np.array([END], np.uint16)
                packed = [np.concatenate([symbols[a:b], end]).tobytes() for a, b in zip(start, start[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(h[rare])))
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(size + 1), pa.array(packed, pa.binary()), pa.array(sure), pa.array(n_known), pa.array(away), lists], names=names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(lean(run), ENCODED)


@dataclass
class Model:
    """start (K), moves (K, K) and emissions (symbol, K) of the chain."""

    start: np.ndarray
    moves: np.ndarray
    emissions: np.ndarray

    def log10_likelihood(self, symbols: list[np.ndarray]) -> np.ndarray:
        """The exact log10 probability of each non-empty sequence: forward recursion, scaled every few steps."""
        size = np.array([len(s) for s in symbols])
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([symbols[i] for i in order]).astype(np.int64)
        size = size[order]
        at = np.cumsum(size) - size
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # sequences of more than t symbols
        a = self.start * self.emissions[flat[at]]
        log = np.zeros(len(size))
        for t in range(1, int(size[0])):
            n = live[t]
            if n < len(a):
                log[n : len(a)] += np.log(a[n:].sum(axis=1))
                a = a[:n]
            a = (a @ self.moves) * self.emissions[flat[at[:n] + t]]
            if t % 8 == 0:
                s = a.sum(axis=1)
                log[:n] += np.log(s)
                a /= s[:, None]
        log[: len(a)] += np.log(a.sum(axis=1))
        out = np.empty(len(size))
        out[order] = log / math.log(10)
        return out


@dataclass
class Block:
    """Sequences laid out step by step, the longest first: the tokens of step t are rows at[t]:at[t] + live[t]."""

    order: np.ndarray  # of the sequences, from long to short
    live: np.ndarray
    at: np.ndarray
    symbols: np.ndarray

    @classmethod
    def of(cls, seqs: list[np.ndarray]) -> Block:
        size = np.array([len(s) for s in seqs])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        at = np.cumsum(live) - live
        flat = np.concatenate([seqs[i] for i in order]).astype(np.int64)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        symbols = np.empty(len(flat), np.int64)
        symbols[at[step] + np.repeat(np.arange(len(size)), size)] = flat
        return cls(order, live, at, symbols)

    @property
    def ends(self) -> np.ndarray:
        """The row of each sequence's last token, from long to short."""
        size = np.searchsorted(-self.live, -np.arange(1, self.live[0] + 1), side="right")
        return self.at[size - 1] + np.arange(self.live[0])


def forward_messages(model: Model, block: Block, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions and forward messages (up to a factor) of all tokens; `enter` has the state shares before each first token."""
    seen = model.emissions[block.symbols]
    alpha = np.empty_like(seen)
    np.multiply(enter, seen[: len(enter)], out=alpha[: len(enter)])
    live, at = block.live.tolist(), block.at.tolist()
    for t in range(1, len(live)):
        own = alpha[at[t] : at[t] + live[t]]
        np.matmul(alpha[at[t - 1] : at[t - 1] + live[t]], model.moves, out=own)
        own *= seen[at[t] : at[t] + live[t]]
        if t % SCALE == 0:
            own /= own.sum(axis=1, keepdims=True)
    return seen, alpha


def expected(model: Model, block: Block, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, moves and emissions of a block, and the backward messages to its first tokens.

    `leave` has the backward message that reaches each sequence's last token, ones at the end of a
    document. Messages are known up to a factor, which falls out as every token's shares, and those of
    every pair of tokens, sum to 1.
    """
    seen, alpha = forward_messages(model, block, enter)
    beta = np.empty_like(alpha)
    beta[block.ends] = leave
    live, at, back = block.live.tolist(), block.at.tolist(), np.ascontiguousarray(model.moves.T)
    for t in range(len(live) - 1, -1, -1):
        own = slice(at[t], at[t] + live[t])
        if t % SCALE == 0:
            beta[own] /= beta[own].sum(axis=1, keepdims=True)
        seen[own] *= beta[own]  # from here on what a token tells its predecessor
        if t:
            np.matmul(seen[own], back, out=beta[at[t - 1] : at[t - 1] + live[t]])
    n = len(alpha) - block.live[0]  # pairs of neighbours: the tokens that aren't first ones, and those before them
    before = np.arange(block.live[0], len(alpha)) - np.repeat(block.live[:-1], block.live[1:])
    left, right = alpha[before], seen[block.live[0] :]
    left /= ((left @ model.moves) * right).sum(axis=1)[:, None] if n else 1
    moves = (left.T @ right) * model.moves
    alpha *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    emissions = np.stack([np.bincount(block.symbols, alpha[:, k], SYMBOLS) for k in range(alpha.shape[1])], axis=1)
    return alpha[: block.live[0]].sum(axis=0), moves, emissions, seen[: block.live[0]]


def expected_of_long(model: Model, seq: np.ndarray, piece: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`expected` of one long document: forward once for the messages at the borders, then backward piece by piece."""
    piece = piece or PIECE
    blocks = [Block.of([seq[i : i + piece]]) for i in range(0, len(seq), piece)]
    enters = [model.start[None, :]]
    for b in blocks[:-1]:
        last = forward_messages(model, b, enters[-1])[1][-1:]
        enters.append(last @ model.moves / last.sum())
    leave, moves, emissions = np.ones((1, len(model.start))), np.zeros_like(model.moves), np.zeros((SYMBOLS, len(model.start)))
    for b, enter in zip(blocks[::-1], enters[::-1], strict=True):
        start, inner, own, told = expected(model, b, enter, leave)
        moves += inner
        emissions += own
        if enter is not enters[0]:
            # the pair across the border: the state before it, weighed by what it says of the one behind it
            earlier = forward_messages(model, blocks[len(enters) - 2], enters[-2])[1][-1]
            pair = earlier[:, None] * model.moves * told
            moves += pair / pair.sum()
            leave = told @ model.moves.T
            leave /= leave.sum()
            enters.pop()
    return start, moves, emissions


def sequences(batches: Iterator[pa.RecordBatch], index: int, limit: int = BLOCK_TOKENS) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of batches, about `limit` symbols of similar lengths at a time, with their sequences."""
    for batch in batches:
        found = [np.frombuffer(x, np.uint16) for x in batch.column(index).to_pylist()]
        size = np.array([len(s) for s in found], np.int64)
        order = np.argsort(-size, kind="stable")
        cut = np.unique(np.append(np.searchsorted(np.cumsum(size[order]), np.arange(limit, size.sum() + limit, limit), side="right"), len(order)))
        for rows in np.split(order, cut):
            if len(rows):
                yield batch.take(pa.array(rows)), [found[i] for i in rows.tolist()]


def baum_welch(encoded: DataFrame, model: Model) -> Model:
    """One round over all training documents: expected counts by task, summed by slice, divided on the driver."""
    shared = encoded.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emissions))  # 4 MB whatever the input

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        states = len(own.start)
        total = np.zeros((SYMBOLS + states + 1, states))
        seen = False
        for _, found in sequences(batches, 0):
            seen = True
            short = [s for s in found if len(s) <= PIECE]
            sums = [expected_of_long(own, s) for s in found if len(s) > PIECE]
            if short:
                whole = np.ones((len(short), states))
                sums.append(expected(own, Block.of(short), whole * own.start, whole)[:3])
            for start, moves, emissions in sums:
                total[:SYMBOLS] += emissions
                total[SYMBOLS:-1] += moves
                total[-1] += start
        if seen:
            parts = range(0, len(total), SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([p // SLICE for p in parts], pa.int32()), pa.array([total[p : p + SLICE].tobytes() for p in parts], pa.binary())], names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "sums"])

    parts = encoded.where("not held_out").select("symbols").mapInArrow(lean(count), "slice int, sums binary")
    whole = {r[0]: np.frombuffer(r[1]) for r in parts.repartition("slice").mapInArrow(add, "slice int, sums binary").collect()}
    shared.unpersist()
    if not whole:
        return model
    states = len(model.start)
    total = np.concatenate([whole[k] for k in sorted(whole)]).reshape(-1, states)
    return estimate(total[-1], total[SYMBOLS:-1], total[:SYMBOLS], model.emissions.sum(axis=1) > 0)


def estimate(start: np.ndarray, moves: np.ndarray, emissions: np.ndarray, used: np.ndarray) -> Model:
    """Counts to probabilities, lightly smoothed towards the shares that all states have together."""
    shares = (emissions.sum(axis=1) + 0.5) * used
    emissions = emissions + (shares / shares.sum() * 10.0)[:, None]
    return Model((start + 0.5) / (start + 0.5).sum(), (moves + 0.5) / (moves + 0.5).sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


def first_model(counts: Counts, states: int = STATES) -> Model:
    """States that like to stay, each with its own distortion of the symbols' shares."""
    rng = np.random.default_rng(SEED)
    emissions = counts.shares()[:, None] * rng.uniform(0.25, 1.75, (SYMBOLS, states))
    moves = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    return Model(np.full(states, 1 / states), moves, emissions / emissions.sum(axis=0))


def train(encoded: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    model = first_model(counts)
    for _ in range(rounds):
        model = baum_welch(encoded, model)
    return model


def forward(encoded: DataFrame, model: Model) -> DataFrame:
    """Rows (row, log): log10 likelihood of the symbols of each row."""
    shared = encoded.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emissions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch, found in sequences(batches, 1):
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != 1), pa.array(own.log10_likelihood(found))], names=[*(x for x in batch.schema.names if x != "symbols"), "log"])

    kept = encoded.select("row", "symbols", "doc_id", "held_out", "n_tokens", "sure", "known", "class_log")
    schema = kept.drop("symbols").schema.add("log", "double")
    return kept.mapInArrow(lean(run), schema)


def rare_sums(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (row, rare_log, rare_known): over the tokens that aren't symbols, sums of log10(c + 0.5) and of c > 0.

    The joined keys are never hot in a large corpus: its frequent tokens are symbols.
    """
    one = encoded.select("row", F.explode("rare").alias("h"))
    joined = one.join(counts.select("h", "c"), "h", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    return joined.groupBy("row").agg(F.sum(F.log10(c + 0.5)).alias("rare_log"), F.sum((c > 0).cast("long")).alias("rare_known"))


def lm_scores(docs: DataFrame, rounds: int | None = ROUNDS) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): the columns of the contract, without `score` if `rounds` is None.

    A null doc_id isn't held out; null and empty texts have the end alone. Repeated rows count and
    score as often as they stand. Without training documents all tokens are unknown. An empty
    table gives an empty result; other columns are ignored.
    """
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    training = docs.where(~F.col("held_out"))
    counted = materialize(count_tokens(training), "counts")
    counts = gather(counted, training.count())
    encoded = materialize(encode(docs, counts).withColumn("row", F.monotonically_increasing_id()), "encoded")
    rest = rare_sums(encoded, counted)
    whole = encoded.drop("symbols", "rare") if rounds is None else forward(encoded, train(encoded, counts, rounds))
    out = whole.join(rest, "row", "left")
    rare = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("sure") + rare - F.col("n_tokens") * F.lit(counts.log_whole)
    cols = ["doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"), base.alias("base_score")]
    return out.select(*cols, *([] if rounds is None else [(F.col("log") + rare - F.col("class_log")).alias("score")]))


def op8_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the unigram base and by the hidden Markov model (cases: see `lm_scores`)."""
    return lm_scores(table(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return lm_scores(table(spark, sf_dir, "documents"), None)


ORACLE_BASE = """
with recursive bits as (select i::bigint as i, 0 as k, i::bigint as v from range(256) r(i)
         union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as materialized (select list(v order by i) as l from bits where k = 8),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w,
        coalesce(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda x: ('0x' || x)::bigint),
          lambda s, b: xor(s >> 8, crc.l[(xor(s, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 5 = 1, false) as held_out from documents, crc),
t as (select rid, held_out, unnest(w) as token from d),
c as (select token, count(*) as c from t where not held_out group by token),
e as (select count(*) as ends from d where not held_out),
n as (select (coalesce(sum(c), 0) + any_value(ends))::bigint as total, count(c) + any_value((ends > 0)::int) as distinct_, any_value(ends) as ends from e left join c on true),
p as (select rid, count(*) as k, count(c.c) as known, sum(log10(coalesce(c.c, 0) + 0.5)) as s from t left join c using (token) group by rid)
select doc_id, held_out, (coalesce(k, 0) + 1)::bigint as n_tokens, (coalesce(known, 0) + (ends > 0)::int)::bigint as n_known, total as train_tokens,
  coalesce(s, 0) + log10(ends + 0.5) - (coalesce(k, 0) + 1) * log10(total + 0.5 * (distinct_ + 1)) as base_score
from d left join p using (rid), n
"""
