"""Mixing sources to target weights: exact block quotas and a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a hash of their key, and the blocks are permuted. A
source whose target is f full passes and a remainder gives every block f times and then a prefix
of the permuted blocks; the block in which the remainder ends is cut, and there one document may
be cut, so the words taken from a source equal its rounded target.

The drawn blocks go to output shards: a binary tree over the shards splits the sources' block
quotas, at every node by a multivariate-hypergeometric draw, so that each shard gets its exact
number of blocks and a fair share of each source. A shard then takes its quota of consecutive
permuted blocks from each source, disjoint from those of other shards, and orders its documents
by a hash; `emit` writes them so. All of it is DataFrame functions; the tree works on counts, never on documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from symdex.llm.shared import BLANK, hash52, key_text, materialize, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Blocks of a source. A block is the unit of quotas and of windows, so it grows with the source, and hot sources have as many as others.
BLOCKS = 1024
N_SHARDS = 24
#: Parts of an output shard, each in an order of its own.
SHARD_PARTS = 16
#: Blocks of all sources up to which their plan (about 150 bytes each) goes to all executors; beyond that it is joined by shuffle.
BROADCAST_BLOCKS = 200_000


def words(text: Column) -> Column:
    """Number of words of a text; none for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANK)), F.lit(0)).cast("long")


def log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series, exact below 2."""
    x = k.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(x < 2, F.lit(0.0)).otherwise(series)


def hypergeometric(u: Column, total: Column, good: Column, draws: Column) -> Column:
    """The u-quantile of the number of `good` among `draws` from `total` without replacement."""
    low, high = F.greatest(F.lit(0).cast("long"), draws - (total - good)), F.least(good, draws)
    norm = log_factorial(total) - log_factorial(draws) - log_factorial(total - draws)

    def p(k: Column) -> Column:
        inside = log_factorial(good) - log_factorial(k) - log_factorial(good - k)
        outside = log_factorial(total - good) - log_factorial(draws - k) - log_factorial(total - good - draws + k)
        return F.exp(inside + outside - norm)

    def step(acc: Column, k: Column) -> Column:
        below = acc["sum"] + p(k)
        return F.struct(below.alias("sum"), (acc["x"] + F.when(below < u, 1).otherwise(0)).alias("x"))

    return F.least(high, F.aggregate(F.sequence(low, high), F.struct(F.lit(0.0).alias("sum"), low.alias("x")), step, lambda acc: acc["x"]))


def split_quotas(quotas: DataFrame, n_shards: int = N_SHARDS, seed: int = 0) -> DataFrame:
    """From one row (quotas array<long>: blocks of each source) rows (shard int, quotas array<long>).

    Shard j of n gets floor(N(j+1)/n) - floor(Nj/n) of the N blocks. Every level of the tree
    splits all its nodes in one projection; a node's row holds one count for each source.
    """
    zero = F.lit(0).cast("long")
    total = F.aggregate("quotas", zero, lambda a, x: a + x)
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), total.alias("all"), "quotas")
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    cut = lambda c: F.floor(F.col("all") * c / F.lit(n_shards)).cast("long")
    start = F.struct(total.alias("total"), (cut(F.col("mid")) - cut(F.col("lo"))).alias("draws"), F.array().cast("array<bigint>").alias("left"))

    def draw(acc: Column, n: Column) -> Column:
        seedling = F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), F.size(acc["left"]))
        u = (F.shiftrightunsigned(seedling, 12).cast("double") + 0.5) / F.lit(float(1 << 52))
        x = hypergeometric(u, acc["total"], n, acc["draws"])
        # the quantile is worked out once, in an array of one, and used three times
        return F.element_at(F.transform(F.array(x), lambda v: F.struct((acc["total"] - n).alias("total"), (acc["draws"] - v).alias("draws"), F.concat(acc["left"], F.array(v)).alias("left"))), 1)

    inner = F.col("hi") - F.col("lo") > 1
    split = F.when(inner, F.aggregate("quotas", start, draw, lambda acc: acc["left"]))
    two = F.array(
        F.struct("lo", F.col("mid").alias("hi"), "all", F.col("left").alias("quotas")),
        F.struct(F.col("mid").alias("lo"), "hi", "all", F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas")),
    )
    children = F.explode(F.when(inner, two).otherwise(F.array(F.struct("lo", "hi", "all", "quotas")))).alias("n")
    for _ in range(max(0, math.ceil(math.log2(n_shards)))):
        nodes = nodes.withColumn("mid", mid).withColumn("left", split).select(children).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add rank and target to rows (source key `sk`, source, source_size): a few bytes for each source.

    Sources by code point, null last, take the weights in turn. Shares of the whole go by weight;
    a target above `most` times its source stops there and the excess is shared again by weight.
    Filling in the order of most * size / weight reaches that fixed point in one pass.
    """
    every = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("rank", rank)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(every))
    by = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "rank")
    prior = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("full", F.col("cap").cast("double") / F.col("w") <= (F.col("total") - prior).cast("double") / rest)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
    share = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * left.cast("double") / share)
    return ranked.withColumn("target", target).select("sk", "rank", "source_size", "target")


def permuted_blocks(docs: DataFrame, weights: Sequence[int], most: int, seed: int) -> DataFrame:
    """Rows (sk, block, rank, source_size, target, passes, rest, before, words, place, blocks, draws): the blocks of each source in permuted order.

    `rest` is what the last, partial pass over the source takes, `before` the words of the blocks
    ahead, `draws` how often a block is drawn.
    """
    per_block = docs.groupBy("sk", "block").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    per_block = materialize(per_block, "blocks")
    goal = targets(per_block.groupBy("sk").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights, most)
    place = hash52(F.concat("sk", F.lit(":"), "block", F.lit(f":block:{seed}")))
    in_source = W.partitionBy("sk").orderBy("place", "block")
    plan = per_block.select("sk", "block", "words", place.alias("place")).join(goal, "sk")
    whole = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumns({"passes": passes, "rest": whole}).withColumn("rest", F.col("rest") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumns({"before": F.sum("words").over(in_source) - F.col("words"), "place": F.row_number().over(in_source) - 1, "blocks": F.count("*").over(W.partitionBy("sk"))})
    return plan.withColumn("draws", F.col("passes") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0))


def dealt(plan: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """`plan` with `shards`: the shard of each draw of a block, by the leaves of the splitting tree."""
    quotas = plan.groupBy("rank").agg(F.sum("draws").alias("q")).agg(F.array_sort(F.collect_list(F.struct("rank", "q"))).alias("s")).select(F.col("s.q").alias("quotas"))
    leaves = split_quotas(quotas.where(F.size("quotas") > 0), n_shards, seed).select("shard", F.posexplode("quotas").alias("rank", "q"))
    ends = leaves.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", "q"))).alias("s"))
    ends = ends.select("rank", F.aggregate("s.q", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x))).alias("ends"))
    none = F.array().cast("array<bigint>")
    draw = F.transform(F.when(F.col("draws") > 0, F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)).otherwise(none), lambda e: e * F.col("blocks") + F.col("place"))
    return plan.join(ends, "rank").withColumn("shards", F.transform(draw, lambda i: F.size(F.filter("ends", lambda x: x <= i))))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, n_shards: int = N_SHARDS, seed: int = 0, blocks: int = BLOCKS, with_shards: bool = True, carry: bool = False) -> DataFrame:
    """One row for each row of `df`: key, size, source_size, target, taken, shards, order.

    `taken` is the words the mix takes, repeats counted: whole passes and then, for one document
    of a source at most, a part. `shards` (array<int>) has the output shard of each copy in turn,
    `order` the place of each copy by a hash in its shard's local shuffle; both are empty where
    nothing is taken; without shards, `copies` has their number. Null sources are one source; null and
    blank texts have size 0 and are taken with their block; with `carry` all columns of `df` are in the
    struct `row`. Repeated rows are documents of their own. An empty table gives an empty result.

    Documents meet the plan of the blocks, which is small, where they are read. Only those of the one
    block in which a source's last pass ends are put in order.
    """
    h = hash52(F.concat(key_text(df[key]), F.lit(f":mix:{seed}")))
    row = [F.struct(*[df[c] for c in df.columns]).alias("row")] if carry else []
    docs = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("sk"), F.col(text).alias("text"), h.alias("h"), *row)
    docs = docs.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    sized = lambda d: d.withColumn("size", words(F.col("text"))).drop("text")
    narrow = materialize(sized(docs.drop("row")), "sized")
    plan = permuted_blocks(narrow, weights, most, seed)
    plan = dealt(materialize(plan, "plan"), n_shards, seed) if with_shards else plan.withColumn("shards", F.lit(None).cast("array<int>"))
    plan = plan.withColumn("ends_here", (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    plan = materialize(plan.select("sk", "block", "source_size", "target", "passes", "rest", "before", "shards", "ends_here"), "dealt")
    small = plan.count() <= BROADCAST_BLOCKS
    joined = (docs if carry else narrow).join(F.broadcast(plan) if small else plan, ["sk", "block"])
    # blocks are drawn whole or not at all, but for those where a source's last pass ends
    inside = F.when(F.col("before") < F.col("rest"), 1).otherwise(0)
    sized = sized if carry else lambda d: d  # where the texts come along, they are counted again and not shuffled
    whole = sized(joined.where(~F.col("ends_here"))).withColumns({"part": inside * F.col("size"), "last": inside})
    in_block = W.partitionBy("sk", "block").orderBy("h", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    cut = sized(joined.where("ends_here")).withColumn("ahead", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    left = F.col("rest") - F.col("before") - F.col("ahead")
    cut = cut.withColumns({"part": F.greatest(F.lit(0), F.least(F.col("size"), left)), "last": F.when(left > 0, 1).otherwise(0)}).drop("ahead")
    out = whole.unionByName(cut)
    out = out.withColumns({"taken": (F.col("passes") * F.col("size") + F.col("part")).cast("long"), "copies": (F.col("passes") + F.col("last")).cast("int")})
    kept = [F.col("key").alias(key), "size", "source_size", "target", "taken", *(["row"] if carry else [])]
    if not with_shards:
        return out.select(*kept, "copies")
    shards = F.slice("shards", F.lit(1), F.col("copies"))
    order = F.transform(shards, lambda s, i: F.xxhash64(F.lit(seed), F.col("h"), s, i))
    return out.select(*kept, shards.alias("shards"), order.alias("order"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of each and the shards that its copies go to (cases: see `mix`)."""
    return mix(table(spark, sf_dir, "documents"))


def mix_source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return mix(table(spark, sf_dir, "documents"), with_shards=False).drop("copies")


def emit(df: DataFrame, parts: int = SHARD_PARTS, **options) -> DataFrame:
    """The mix itself: the columns of `df`, one row for each copy, dealt to the output shards and in each part of a shard in its local order.

    The last copy of one document of a source is cut where its source's target ends; documents behind
    it go; null and blank ones are taken as often as their block is drawn.
    """
    text = options.get("text", "text")
    mixed = mix(df, carry=True, **options)
    copies = mixed.select("row", "size", "taken", F.posexplode(F.arrays_zip("shards", "order")).alias("copy", "x")).select("row.*", F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.col("copy").alias("__copy"), F.col("x.shards").alias("__shard"), F.col("x.order").alias("__order"))
    left = F.least(F.col("__size"), F.col("__taken") - F.col("__copy") * F.col("__size"))
    tokens = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(left < F.col("__size"), F.array_join(F.slice(tokens, F.lit(1), left.cast("int")), "")).otherwise(F.col(text))
    copies = copies.withColumn(text, cut).withColumn("__part", F.pmod("__order", F.lit(parts)).cast("int"))
    return copies.repartition("__shard", "__part").sortWithinPartitions("__shard", "__part", "__order").select(*df.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix takes them, shard by shard in the order of its local shuffle (cases: see `emit`).

    Keeps the columns of documents; n_chars is that of the text that stays.
    """
    return emit(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


ORACLE_MIX = f"""
with d as (select doc_id, source, coalesce('=' || source, '') as sk, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
             ('0x' || substr(md5(coalesce(doc_id::varchar, '\\N') || ':mix:0'), 1, 13))::bigint as h from documents),
docs as (select *, h % {BLOCKS} as block from d),
s as (select sk, any_value(source) as source, sum(size)::bigint as source_size from docs group by sk),
r as (select *, row_number() over (order by source nulls last) - 1 as rank from s),
w as (select *, [5, 2, 1][rank % 3 + 1]::bigint as w, source_size * {MOST_COPIES} as cap, sum(source_size) over () as total from r),
c as (select *, cap::double / w <= (total - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0))::double
        / sum(w) over (order by cap / w, rank rows between current row and unbounded following) as is_full from w),
t as (select sk, source_size, case when is_full then cap::double
        else w::double * (total - coalesce(sum(cap) filter (is_full) over (), 0))::double / sum(w) filter (not is_full) over () end as target from c),
g as (select *, floor(target + 0.5)::bigint as whole from t),
b as (select sk, block, sum(size)::bigint as words, ('0x' || substr(md5(sk || ':' || block || ':block:0'), 1, 13))::bigint as place from docs group by all),
p as (select b.sk, block, source_size, target, case when source_size > 0 then whole // source_size else 0 end as passes, whole,
        sum(words) over (partition by b.sk order by place, block) - words as before from b join g on b.sk = g.sk),
o as (select *, coalesce(sum(size) over (partition by sk, block order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead from docs)
select doc_id, size, source_size, target,
  (passes * size + greatest(0, least(size, whole - passes * source_size - before - ahead)))::bigint as taken
from o join p using (sk, block)
"""
