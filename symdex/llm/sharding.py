"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every shard bids `weight / -ln(u)` for a key, u drawn from a hash of key and shard; the highest
bid takes the record. A bid depends on nothing but the key and its own shard, so one more shard
takes records only into itself, and a changed weight moves records only to or from that shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from symdex.llm.shared import hash52, key_text, table

N_SHARDS = 24
#: Parts of a shard for numbering its rows; shards times parts bounds the table of counts that is broadcast.
SLOT_PARTS = 512


def bid(key: Column, shard: int, weight: float = 1.0) -> Column:
    """What `shard` bids for `key`: weight / -ln(u), u in (0, 1)."""
    u = (hash52(F.concat(key_text(key), F.lit(f":{shard}"))).cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.lit(float(weight)) / -F.log(u)


def winner(bids: Sequence[Column]) -> Column:
    """Index of the highest bid (on a tie the lower index)."""
    return -F.array_max(F.array(*[F.struct(b.alias("bid"), F.lit(-i).alias("i")) for i, b in enumerate(bids)]))["i"]


def assign(df: DataFrame, key: str, n_shards: int = N_SHARDS, weights: Sequence[float] | None = None, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """`df` with the column `shard` (int) and, on request, `grown`: the shard with one more of weight 1.

    A null key is a key like others. Weights must be positive, one for each shard. Existing
    columns of these names are replaced. No shuffle.
    """
    if n_shards < 1 or weights is not None and (len(weights) != n_shards or min(weights) <= 0):
        raise ValueError("one positive weight for each shard is needed")
    bids = [bid(df[key], i, 1.0 if weights is None else weights[i]) for i in range(n_shards)]
    new = {shard: winner(bids).cast("int")}
    if grown:
        new[grown] = winner([*bids, bid(df[key], n_shards)]).cast("int")
    return df.withColumns(new)


def number(df: DataFrame, shard: str, key: str, ties: Sequence[str] = (), slot: str = "slot", parts: int = SLOT_PARTS) -> DataFrame:
    """Gapless numbers from 0 within each shard, in the order (hash part of the key, key, ties).

    Rows of a shard are numbered in `parts` independent parts, each by a task of its own; the
    counts of all parts (one small row for each shard and part) give the offsets.
    """
    part = "__part"
    df = df.withColumn(part, F.pmod(hash52(key_text(df[key])), F.lit(parts)).cast("int"))
    counts = df.groupBy(shard, part).agg(F.count("*").alias("__n"))
    before = counts.select(shard, part, (F.sum("__n").over(W.partitionBy(shard).orderBy(part)) - F.col("__n")).alias("__before"))
    own = F.row_number().over(W.partitionBy(shard, part).orderBy(key, *ties))
    # at most shards * parts rows of 16 bytes: safe to broadcast whatever the input
    return df.withColumn("__own", own).join(F.broadcast(before), [shard, part]).withColumn(slot, F.col("__before") + F.col("__own") - 1).drop(part, "__own", "__before")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 23 by the law `key`.

    Nulls: a null text counts 8 bytes and has the CRC of no bytes (0); a null doc_id is a key of
    its own. Repeated rows go to the same shard with slots of their own. An empty table gives
    an empty result. Other columns are ignored.
    """
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"))
    out = number(assign(docs, "doc_id", grown="grown_shard"), "shard", "doc_id", ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with shard and slot, in place of columns of these names.

    Every row stays, repeated ones too, each with a slot of its own; null and empty texts are dealt by
    their doc_id as others are, null doc_ids all to one shard; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    return number(assign(docs.select(*kept), "doc_id"), "shard", "doc_id", ["n_chars"]).select(*kept, "shard", "slot")


_BIDS = """
bids as (select d.rid, s.i as shard, ('0x' || substr(md5(coalesce(d.doc_id::varchar, '\\N') || ':' || s.i), 1, 13))::bigint as h
         from docs d, range(25) s(i)),
won as (select rid, arg_max(shard, (h, -shard)) filter (shard < 24) as shard, arg_max(shard, (h, -shard)) as grown from bids group by rid)
"""

#: CRC-32 byte by byte over the table of its 256 remainders.
_CRC = """
bits as (select i::bigint as i, 0 as k, i::bigint as v from range(256) r(i)
         union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as materialized (select list(v order by i) as l from bits where k = 8)
"""

ORACLE_OP1 = f"""
with recursive {_CRC.strip()},
docs as materialized (select row_number() over () as rid, doc_id, text from documents),
{_BIDS.strip()},
sized as (select d.rid, d.doc_id, coalesce(strlen(d.text), 0) + 8 as size,
          xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(d.text, ''))), '..'), lambda x: ('0x' || x)::bigint),
              lambda s, b: xor(s >> 8, crc.l[(xor(s, b) & 255) + 1]), 4294967295::bigint), 4294967295) as text_crc32 from docs d, crc)
select s.doc_id, s.size::bigint as size, s.text_crc32::bigint as text_crc32, 'key' as law, w.shard::int as shard,
  (row_number() over (partition by w.shard order by ('0x' || substr(md5(coalesce(s.doc_id::varchar, '\\N')), 1, 13))::bigint % {SLOT_PARTS}, s.doc_id nulls first, s.text_crc32, s.size) - 1)::bigint as slot,
  w.grown::int as grown_shard
from sized s join won w using (rid)
"""
