"""Search operators: symbol substrings, per-file listings, and the fusion of vector and text hits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from symdex.functions import names as N

#: Constant of reciprocal rank fusion, and how many times the limit each leg fetches.
RRF, OVERFETCH = 60, 3


def ascii_fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_like(column: Column, needle: str) -> Column:
    """LIKE '%needle%' with ASCII folding, `%` and `_` as wildcards and no escape."""
    folded = "".join(c.lower() if c.isascii() else c for c in needle)
    if "%" not in folded and "_" not in folded:
        return F.contains(ascii_fold(column), F.lit(folded))
    return F.like(ascii_fold(column), F.lit(f"%{folded}%"), F.lit("\x01"))


def by_symbol(chunks: DataFrame, name: str, symbol_type: str | None = None, column: str = "symbol_name", kind: str = "symbol_type") -> DataFrame:
    """The chunks whose symbol has `name` in it, of one kind if it is given; no limit."""
    found = chunks.where(contains_like(F.col(column), name))
    return found if symbol_type is None else found.where(F.col(kind) == symbol_type)


def longest_word(query: str) -> str | None:
    """The longest word, the first of several."""
    words = re.findall(r"\w+", query)
    return max(words, key=len) if words else None


def by_like(chunks: DataFrame, query: str, limit: int, columns: tuple[str, ...] = ("search_text", "symbol_name"), order: tuple[str, ...] = ("file_path", "line_start")) -> DataFrame:
    """The fallback: chunks with the query's longest word as a substring, in file order."""
    word = longest_word(query)
    if word is None:
        return chunks.limit(0)
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_like(F.col(c), word)
    return chunks.where(hit).orderBy(*order).limit(limit)


def boost(kind: Column) -> Column:
    """The factor of a kind of symbol."""
    pairs = [F.lit(x) for item in sorted(N.BOOSTS.items()) for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(N.OTHER_BOOST))


def ranked(hits: DataFrame, by: str, name: str) -> DataFrame:
    """`hits` (already limited) numbered from 1 by (by, id): a window over a handful of rows."""
    return hits.withColumn(name, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(by, "id")))


def fuse(vector_hits: DataFrame, text_hits: DataFrame, limit: int, kinds: DataFrame | None = None) -> DataFrame:
    """Rows (id, distance, rank, score) of reciprocal rank fusion, best first.

    `vector_hits` (id, distance) and `text_hits` (id, rank) are at most OVERFETCH * limit rows each.
    `kinds` (id, symbol_type) brings the boosts: it is filtered by the hits' ids. Ties stand in the
    order of the legs: vector hits by rank, then text hits by rank.
    """
    v, t = ranked(vector_hits, "distance", "vr"), ranked(text_hits, "rank", "tr")
    both = v.join(t, "id", "full_outer")
    share = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", share("vr") + share("tr"))
    if kinds is not None:
        both = kinds.select("id", "symbol_type").join(F.broadcast(both), "id")
        both = both.withColumn("score", F.col("score") * boost(F.col("symbol_type"))).drop("symbol_type")
    order = [F.col("score").desc(), F.col("vr").asc_nulls_last(), F.col("tr").asc_nulls_last(), F.col("id")]
    return both.orderBy(*order).limit(limit).select("id", "distance", "rank", "score", "vr", "tr")


def fused_ids(near: list[tuple[int, float]], text: list[tuple[int, float]], kind_of: dict[int, str]) -> list[tuple[int, float | None, float | None, float]]:
    """`fuse` over the collected hits of a search, best first: (id, distance, rank, score) of those whose kind is known.

    Both legs are limited and in order, so this is a handful of numbers on the driver.
    """
    place = [{id_: (n, x) for n, (id_, x) in enumerate(leg, 1)} for leg in (near, text)]
    out = []
    for id_ in dict.fromkeys([*place[0], *place[1]]):
        if id_ in kind_of:
            share = sum(1.0 / (RRF + leg[id_][0]) for leg in place if id_ in leg)
            order = tuple(leg[id_][0] if id_ in leg else float("inf") for leg in place)
            score = share * N.BOOSTS.get(kind_of[id_], N.OTHER_BOOST)
            out.append((-score, *order, id_, place[0].get(id_, (0, None))[1], place[1].get(id_, (0, None))[1]))
    return [(id_, distance, rank, -score) for score, _, _, id_, distance, rank in sorted(out, key=lambda x: x[:4])]


def with_payload(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits (a few rows) with their chunks, in the hits' order, the score rounded last."""
    joined = chunks.join(F.broadcast(hits), "id")
    order = [F.col("score").desc(), F.col("vr").asc_nulls_last(), F.col("tr").asc_nulls_last(), F.col("id")]
    return joined.orderBy(*order).withColumn("score", F.round("score", 4)).drop("vr", "tr")


def file_listing(chunks: DataFrame, path: str) -> DataFrame:
    """The chunks of one file by line."""
    return chunks.where(F.col("file_path") == path.replace("\\", "/")).orderBy("line_start", "id")
