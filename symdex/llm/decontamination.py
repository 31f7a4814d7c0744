"""Benchmark decontamination over a distributed positional inverted index.

Documents are indexed in segments, each a row that stands alone: the dictionary of its terms,
one posting list of positions for each term, and where its documents begin. Segments are stored
as a table and can be searched for any test set later. A search takes the test windows to every
segment, starts from each window's rarest term there, shifts that term's list by the term's
offset and intersects it with the shifted lists of the other terms from rare to frequent. Nothing
is shuffled: a segment yields the result rows of its own documents.

Matches are exact (the words of a window in a row) and by proximity (all words of a window, in any
order, within NEAR words of one document).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.shared import bound_batches, lean, materialize, resting_on, settled, table, text_blocks

#: Bytes of words stay, A-Z in lower case; all other ASCII parts words. Bytes from 0x80 on belong to letters beyond ASCII.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WINDOW = 8
LEAST_ITEMS = 2
#: Words within which all words of a window stand for a match by proximity.
NEAR = 12
#: Bytes of test text that one search takes to the executors (their windows are some 20 MB of numbers there); a larger test set is searched in several passes.
BLOCK_BYTES = 2_000_000
#: Candidate positions looked at together.
CANDIDATES = 500_000

SEGMENT = "doc_ids array<bigint>, starts binary, terms array<binary>, offsets binary, positions binary"
HITS = "doc_id bigint, n_words bigint, spans array<int>, items array<string>, near array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words (UTF-8) after A-Z became a-z; none for a null."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of (doc_id, text) rows: positions run through a segment, documents being one apart."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in text_blocks(texts):
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            flat, starts = [], [0]
            for text in texts[lo:hi]:
                found = words_of(text)
                flat.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                starts.append(starts[-1] + len(found) + 1)  # the gap keeps windows inside a document
            where = np.concatenate([np.arange(s, s + len(x), dtype=np.int32) for s, x in zip(starts, flat, strict=False)])
            term = np.concatenate(flat)
            order = np.argsort(term, kind="stable")
            offsets = np.zeros(len(number) + 1, np.int64)
            np.cumsum(np.bincount(term, minlength=len(number)), out=offsets[1:])
            row = [[ids[lo:hi]], [np.asarray(starts, np.int64).tobytes()], [list(number)], [offsets.tobytes()], [where[order].astype(np.int32).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.list_(pa.int64())), pa.array(row[1], pa.binary()), pa.array(row[2], pa.list_(pa.binary())), pa.array(row[3], pa.binary()), pa.array(row[4], pa.binary())], names=["doc_ids", "starts", "terms", "offsets", "positions"])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The segments of `docs`, not yet stored. Null and empty texts are documents without postings."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(index_batches), SEGMENT)


class Segment:
    """A segment with its posting lists.

    `keys` holds all lists one after another, each position raised by its term's number times
    `span`. It ascends, so shifted positions meet a term's list by one search for all of them.
    """

    def __init__(self, row: dict):
        self.ids, self.starts = row["doc_ids"], np.frombuffer(row["starts"], np.int64)
        self.number = {t: i for i, t in enumerate(row["terms"])}
        self.offsets, self.positions = np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["positions"], np.int32)
        self.n_words = np.diff(self.starts) - 1
        self.span = int(self.starts[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.number), dtype=np.int64) * self.span, np.diff(self.offsets)) + self.positions

    def numbers(self, terms: list[bytes]) -> np.ndarray:
        """The segment's numbers of these terms, -1 for those that it lacks."""
        return np.array([self.number.get(t, -1) for t in terms], np.int64)

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the terms, one list after another, and whose each is."""
        size = self.offsets[term + 1] - self.offsets[term]
        owner = np.repeat(np.arange(len(term)), size)
        first = np.repeat(self.offsets[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.positions[first + np.arange(len(owner))].astype(np.int64), owner

    def following(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first place of each term at or behind a position, or one out of reach."""
        at = np.searchsorted(self.keys, term * self.span + position)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] - term * self.span
        return np.where((at < len(self.keys)) & (found < self.span), found, 2 * self.span)

    def rarest_first(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of each window from the rarest term to the most frequent, and the list length of the rarest."""
        size = self.offsets[windows + 1] - self.offsets[windows]
        order = np.argsort(size, axis=1, kind="stable")
        return order, np.take_along_axis(size, order[:, :1], 1)[:, 0]

    def candidates(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(columns from rare to frequent, positions of the rarest term, window numbers) in groups of about CANDIDATES."""
        order, size = self.rarest_first(windows)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // CANDIDATES)) + 1
        for rows in np.split(np.arange(len(windows)), cut):
            at, owner = self.spread(windows[rows, order[rows, 0]])
            yield order, at, rows[owner]

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start positions, window numbers) of exact occurrences of equally long windows of term numbers."""
        for order, at, owner in self.candidates(windows):
            start = at - order[owner, 0]
            keep = (start >= 0) & (start + windows.shape[1] < self.span)
            start, owner = start[keep], owner[keep]
            for k in range(1, windows.shape[1]):
                column = order[owner, k]
                keep = self.following(windows[owner, column], start + column) == start + column
                start, owner = start[keep], owner[keep]
            yield start, owner

    def near(self, windows: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a position, window numbers) in documents where all terms of a window stand within so many words."""
        for order, at, owner in self.candidates(windows):
            doc = np.searchsorted(self.starts, at, side="right")
            low, end = self.starts[doc - 1], self.starts[doc] - 1
            for k in range(1, windows.shape[1]):  # first each term by itself: is it near the rarest one at all?
                keep = self.following(windows[owner, order[owner, k]], np.maximum(at - within + 1, low)) < np.minimum(at + within, end)
                at, owner, low, end = at[keep], owner[keep], low[keep], end[keep]
            for back in range(within):  # then all of them in the run of words that begins so far before it
                begin = at - back
                keep = begin >= low
                start, own, stop = begin[keep], owner[keep], np.minimum(begin + within, end)[keep]
                for k in range(1, windows.shape[1]):
                    keep = self.following(windows[own, order[own, k]], start) < stop
                    start, own, stop = start[keep], own[keep], stop[keep]
                yield start, own


#: The windows of one length: term numbers (into a list of terms), and the items (into a list of ids) of each as first:last of a flat list.
Windows = tuple[np.ndarray, np.ndarray, np.ndarray]


def windows_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[list[bytes], list[str], list[Windows]]:
    """Terms, item ids (as text, ascending) and the distinct windows of the items by length, all as arrays of numbers."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = sorted({str(i) for i, _ in items})
    id_of = {x: k for k, x in enumerate(ids)}
    by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    for item, text in items:
        terms = np.array([number[w] for w in words_of(text)], np.int32)
        n = min(window, len(terms))
        if n:
            own = np.lib.stride_tricks.sliding_window_view(terms, n)
            by[n].append((own, np.full(len(own), id_of[str(item)], np.int32)))
    out = []
    for _, parts in sorted(by.items()):
        rows = np.concatenate([np.column_stack([own, item]) for own, item in parts])
        rows = np.unique(rows, axis=0)  # by window, then item
        edge = np.concatenate([[True], (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)])
        out.append((rows[edge, :-1], np.append(np.flatnonzero(edge), len(rows)), rows[:, -1]))
    return list(number), ids, out


def search(index: DataFrame, items: list[tuple[object, str | None]], window: int = WINDOW, within: int = NEAR) -> DataFrame:
    """Rows (doc_id, n_words, spans, items, near) for every indexed document.

    `spans` holds the hit words as start, end, start, end (in words, end exclusive, merged and
    ascending), `items` the ids of items with a window in the document, `near` those of items with a
    window all whose words stand within `within` words there, in any order. `items` is one block of the
    test set, of at most BLOCK_BYTES.
    """
    spark = index.sparkSession
    tests = spark.sparkContext.broadcast(windows_of(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, lengths = tests.value
        for batch in batches:
            for at in range(batch.num_rows):  # one segment in memory at a time
                seg = Segment({name: batch.column(name)[at].as_py() for name in batch.schema.names})
                edge = np.zeros(seg.span, np.int32)
                own = seg.numbers(terms)
                found: tuple[list[set[int]], list[set[int]]] = [set() for _ in seg.ids], [set() for _ in seg.ids]

                def note(kind: int, start: np.ndarray, window: np.ndarray, first: np.ndarray, owners: np.ndarray, seg=seg, found=found) -> None:
                    doc = np.searchsorted(seg.starts, start, side="right") - 1
                    for both in np.unique(doc * len(first) + window).tolist():
                        d, w = divmod(both, len(first))
                        found[kind][d].update(owners[first[w] : first[w + 1]].tolist())

                for windows, first, owners in lengths:
                    numbers = own[windows]
                    known = np.flatnonzero((numbers >= 0).all(axis=1))
                    if not len(known):
                        continue
                    for start, owner in seg.phrases(numbers[known]):
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + windows.shape[1], -1)
                        note(0, start, known[owner], first, owners)
                    for start, owner in seg.near(numbers[known], within):
                        note(1, start, known[owner], first, owners)
                hit = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))  # starts and ends by turns; gaps part documents
                cut = np.searchsorted(turn, seg.starts)
                spans = [(turn[a:b] - s).tolist() for a, b, s in zip(cut, cut[1:], seg.starts, strict=False)]
                names = [pa.array([[ids[i] for i in sorted(x)] for x in kind], pa.list_(pa.string())) for kind in found]
                yield pa.RecordBatch.from_arrays([pa.array(seg.ids, pa.int64()), pa.array(seg.n_words), pa.array(spans, pa.list_(pa.int32())), *names], names=["doc_id", "n_words", "spans", "items", "near"])

    return index.mapInArrow(lean(run), HITS)


def blocks(tests: DataFrame, key: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The test set in blocks of about `limit` bytes, one at a time on the driver. Rows of null texts have no window."""
    held, size = [], 0
    for row in tests.select(F.col(key), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_ITEMS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_near counts the items with a match by proximity, which leave `contaminated` as it is.

    The index is written to the shared folder and searched once for each block of the test set; for
    several blocks the results of a document meet by its place in the index. Null or wordless
    texts have no words and no hits; repeated rows are rows of their own; an empty test set
    hits nothing; other columns are ignored; a null item_id counts as the text "None".
    """
    index = materialize(build_index(docs, key, text), "index")
    parts = blocks(tests)
    first, second = next(parts, []), next(parts, None)
    hits = search(index, first) if second is None else merge_passes(index, chain([first, second], parts))
    spans = F.col("spans")
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    sha = F.sha2(F.array_join("items", ","), 256)
    out = hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.size("items") >= least).alias("contaminated"), F.size("near").cast("long").alias("n_near"))
    return resting_on(out, index)


def merge_passes(index: DataFrame, test_blocks: Iterator[list[tuple[object, str | None]]]) -> DataFrame:
    """The union of several searches: documents keep their place (segment, row), by which the passes are joined."""
    at = F.monotonically_increasing_id()
    dense = F.shiftleft(F.shiftright(at, 33), 20) + at.bitwiseAND(F.lit((1 << 20) - 1))  # leaves 16 bits for the place in a segment
    keyed = materialize(index.withColumn("segment", dense), "segments")

    def placed(items: list[tuple[object, str | None]]) -> DataFrame:
        one = keyed.select(F.expr("transform(doc_ids, (x, i) -> segment * 65536 + i)").alias("doc_ids"), "starts", "terms", "offsets", "positions")
        return search(one, items).withColumnRenamed("doc_id", "place")

    names = keyed.select(F.posexplode("doc_ids").alias("i", "doc_id"), "segment").select((F.col("segment") * 65536 + F.col("i")).alias("place"), "doc_id")
    every = reduce(DataFrame.unionByName, (materialize(placed(items), "pass") for items in test_blocks))
    bits = F.explode(F.when(F.size("spans") > 0, F.expr("transform(sequence(0, size(spans) - 2, 2), i -> struct(spans[i] as s, spans[i + 1] as e))")))
    one = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    item_sets = every.groupBy("place").agg(F.max("n_words").alias("n_words"), one("items"), one("near"))
    ranges = every.select("place", bits.alias("x")).groupBy("place").agg(F.array_sort(F.collect_list("x")).alias("x"))
    zero = F.array().cast("array<int>")
    joined = F.aggregate(
        "x", zero, lambda a, r: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) >= r["s"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.greatest(F.try_element_at(a, F.lit(-1)), r["e"])))).otherwise(F.concat(a, F.array(r["s"], r["e"])))
    )
    ranges = ranges.select("place", joined.alias("spans"))
    out = names.join(item_sets, "place").join(ranges, "place", "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", zero).alias("spans"), "items", "near")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items (cases: see `contaminated`)."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without those that hold windows of two or more benchmark items.

    Null and empty texts hold none and stay; of repeated rows each is a row of its own, so all go or
    all stay; an empty table or test set drops nothing.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = contaminated(numbered, table(spark, sf_dir, "benchmark"), key="__row")
    bad = settled(resting_on(found.where("contaminated").select(F.col("doc_id").alias("__row")), found), "bad")
    return numbered.join(bad, "__row", "left_anti").select(*docs.columns)


ORACLE_OP2 = """
with words as (select rid, doc_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x) as w
  from (select row_number() over () as rid, doc_id, text from documents)),
tests as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
windows as (select distinct item_id, list_slice(w, i, i + least(8, len(w)) - 1) as win, least(8, len(w)) as n
  from tests, unnest(range(1, len(w) - least(8, len(w)) + 2)) u(i) where len(w) > 0),
lengths as (select distinct n from windows),
grams as (select rid, i, n, list_slice(w, i, i + n - 1) as win from words, lengths, unnest(range(1, len(w) - n + 2)) u(i) where len(w) >= n),
hits as (select g.rid, g.i, g.n, t.item_id from grams g join windows t on g.n = t.n and g.win = t.win),
n_hit as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + n)) as p from hits) group by rid),
ids as (select rid, list(distinct item_id::varchar order by item_id::varchar) as l from hits group by rid),
sets as (select win, list_distinct(win) as terms, row_number() over () as k from (select distinct win from windows)),
places as (select rid, p, w[p] as term from words, unnest(range(1, len(w) + 1)) u(p)),
freq as (select term, count(*) as c from places group by term),
rarest as (select k, any_value(terms) as terms, arg_min(t, (coalesce(c, 0), t)) as term from (select k, terms, unnest(terms) as t from sets) left join freq on term = t group by k),
rough as (select p.rid, p.p, r.k, r.terms, w.w from places p join rarest r on p.term = r.term join words w on w.rid = p.rid where list_has_all(list_slice(w.w, greatest(1, p.p - 11), p.p + 11), r.terms)),
close as (select distinct rid, k from rough where list_bool_or(list_transform(range(greatest(1, p - 11), p + 1), lambda i: list_has_all(list_slice(w, i, i + 11), terms)))),
n_near as (select rid, count(distinct item_id::varchar) as n from close join sets using (k) join windows on windows.win = sets.win group by rid)
select w.doc_id, coalesce(nn.n, 0)::bigint as n_near, len(w.w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(len(l), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(l, ','), '')) as items_sha256, coalesce(len(l), 0) >= 2 as contaminated
from words w left join n_hit h using (rid) left join ids using (rid) left join n_near nn using (rid)
"""
