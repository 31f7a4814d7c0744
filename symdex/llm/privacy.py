"""Personal data: patterns find the protected entities, corpus statistics find the terms that reveal them.

Base spans (e-mail, IP, card, phone) come from patterns. Each distinct value is a protected entity e
of information -log2 p(e). A term t of a document that mentions e reveals log2(p(t,e) / (p(t) p(e))) of it,
p estimated over all documents, each taken whole. A term that reveals REMOVE of the information is removed, one that
reveals GENERALISE of it is generalised to the shape of its letters.

All of it is DataFrame functions. Of the terms of a document only those meet its entities that can
reveal enough: c <= df_e and a share of GENERALISE bound df_t from above (see `most_of_term`), which
leaves rare terms alone, so a document's pairs are few though its whole text counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.shared import ascii_lower, materialize, table

# Patterns match what the plain ones of the contract match: the look-behinds only keep a search from
# starting again inside a run that has failed, and possessive repeats give nothing back that could help.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Letters that a term has at least.
TERM_LETTERS = 4
#: Documents in which a term must stand with an entity before it counts as evidence.
SUPPORT = 2
#: Shares of an entity's information from which a term is generalised or removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Parts over which an (entity, term) group is dealt.
SALTS = 16
TERMS = "array<struct<s:int,e:int,remove:boolean>>"
SPANS = "array<struct<kind:int,s:int,e:int,value:string>>"
_TERM = rf"[\p{{L}}\p{{M}}]{{{TERM_LETTERS},}}"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substr(digits, n - i + 1, F.lit(1)).cast("int").alias("d"), (i % 2 == 0).alias("twice")))
    one = lambda x: F.when(x["twice"], x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"])
    return F.aggregate(at, F.lit(0), lambda a, x: a + one(x)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda p: ~F.regexp_like(p, F.lit("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$")))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def detect(docs: DataFrame, text: str) -> DataFrame:
    """`docs` (without the text) with the number of each kind and the valid base matches `spans`, by kind and start.

    A span has kind (its place in KINDS), s and e (code points, e exclusive) and value; `body` is
    the text of a document that has spans. Positions follow from the pieces between matches, so a text is searched a second
    time only where a kind has matches.
    """
    out = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    columns = list(enumerate(KINDS))
    for k, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        found = F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))
        out = out.withColumn(f"__m{k}", found)
        out = out.withColumn(f"__p{k}", F.when(F.size(f"__m{k}") > 0, F.split("__t", pattern, -1)))
    out = out.drop(text)
    for k, kind in columns:
        out = out.withColumn(f"__s{k}", placed(k, kind, F.col(f"__m{k}"), F.col(f"__p{k}")))
        out = out.drop(f"__m{k}", f"__p{k}").withColumn(f"n_{kind}", F.size(f"__s{k}").cast("long"))
    out = out.withColumn("spans", F.concat(*[F.col(f"__s{k}") for k, _ in columns]))
    return out.withColumn("body", F.when(F.size("spans") > 0, F.col("__t"))).drop("__t", *[f"__s{k}" for k, _ in columns])


def placed(k: int, kind: str, matches: Column, pieces: Column) -> Column:
    """The valid matches of a kind as spans; an empty array where there is none."""
    zipped = F.transform(matches, lambda x, i: F.struct(x.alias("m"), F.get(pieces, i).alias("g")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        row = F.struct(F.lit(k).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("value"))
        return F.struct(e.alias("at"), F.when(valid(kind, x["m"]), F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))


def entity(span: Column) -> Column:
    """What a mention stands for: kind and value without writing variants."""
    value = F.when(span["kind"] == 0, ascii_lower(span["value"])).when(span["kind"] >= 2, F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(span["value"])
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def terms_in(text: Column, told: Column) -> Column:
    """array<struct<s, e, remove>> of all places of the terms (in lower case) that the map `told` leads to remove or not."""
    found = F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
    zipped = F.arrays_zip(found.alias("m"), F.slice(F.split(text, _TERM, -1), F.lit(1), F.size(found)).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(TERMS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        remove = F.try_element_at(told, F.lower(x["m"]))
        more = F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), remove.alias("remove"))))
        return F.struct(e.alias("at"), F.when(remove.isNotNull(), more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def entities(found: DataFrame) -> DataFrame:
    """Rows (rid, entity), each once."""
    return found.select("rid", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))


def most_of_term(df_e: Column, n_docs: int) -> Column:
    """Documents that a term may have at most and reveal GENERALISE of an entity of df_e documents.

    c n / (df_t df_e) >= (n / df_e) ** GENERALISE with c <= df_e; a little more, for rounding.
    """
    return df_e * F.pow(F.lit(float(n_docs)) / df_e, F.lit(1 - GENERALISE)) * (1 + 1e-9)


def near_terms(found: DataFrame) -> DataFrame:
    """Rows (rid, entity, term): entities of SUPPORT documents or more and the terms of the whole texts that mention them.

    Left out are terms of so many of these texts that they can't reveal GENERALISE of the entity,
    and those of fewer than SUPPORT.
    """
    n_docs = found.count()
    mentions = entities(found)
    known = mentions.groupBy("entity").agg(F.count("*").alias("df_e")).where(F.col("df_e") >= SUPPORT).withColumn("most", most_of_term(F.col("df_e"), n_docs))
    mentions = mentions.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(spread(known), ["entity", "salt"])
    own = materialize(mentions.groupBy("rid").agg(F.collect_list(F.struct("entity", "most")).alias("own"), F.max("most").alias("most")), "mentions")
    words = found.select("rid", "body").join(own.select("rid", "most"), "rid").select("rid", "most", F.explode(distinct_terms(F.col("body"))).alias("term"))
    words = materialize(words, "words")
    rare = words.groupBy("term").agg(F.count("*").alias("n"), F.max("most").alias("top")).where((F.col("n") >= SUPPORT) & (F.col("n") <= F.col("top"))).select("term", "n")
    words = words.drop("most").withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(spread(rare), ["term", "salt"])
    both = words.join(own.select("rid", "own"), "rid")
    return both.select("rid", "term", F.explode(F.filter("own", lambda x: F.col("n") <= x["most"])).alias("x")).select("rid", "x.entity", "term")


def spread(df: DataFrame) -> DataFrame:
    """Every row once for each salt: the small side of a salted join."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def disclosing(docs: DataFrame, found: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """Rows (entity, term, share): pairs that stand together in SUPPORT documents or more and reveal GENERALISE or more.

    p(e), p(t) and p(t,e) are shares of all documents: that mention e, have t, have both.
    """
    n_docs = found.count()
    of_entity = entities(found).groupBy("entity").agg(F.count("*").alias("df_e"))
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("c")).where(F.col("c") >= SUPPORT)
    together = together.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(spread(of_entity), ["entity", "salt"]).drop("salt")
    together = materialize(together, "together")
    terms = materialize(together.select("term").distinct(), "terms")
    # terms are counted before they meet the candidates: what is joined is a vocabulary, not its occurrences
    words = docs.select(F.explode(distinct_terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    of_term = words.groupBy("term").agg(F.count("*").alias("df_t")).join(terms, "term")
    info = F.log2(F.lit(float(n_docs)) / F.col("df_e"))
    pmi = F.log2(F.col("c") * F.lit(float(n_docs)) / (F.col("df_t").cast("double") * F.col("df_e")))
    both = together.withColumn("salt", F.pmod(F.xxhash64("entity"), F.lit(SALTS)).cast("int")).join(spread(of_term), ["term", "salt"])
    return both.where(info > 0).select("entity", "term", (pmi / info).alias("share")).where(F.col("share") >= GENERALISE)


def analyse(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` (with a column `rid` that tells its rows apart, without the text) with n_email, n_ip, n_card, n_phone, base and terms.

    `base` is array<struct<kind, s, e>>, by kind and start; `terms` array<struct<s, e, remove>> by
    start, none of them touching a base span.
    """
    found = materialize(detect(docs, text), "found")
    pairs = materialize(near_terms(found), "pairs")
    told = materialize(disclosing(docs, found, pairs, text), "told")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(spread(told), ["entity", "term", "salt"])
    hits = salted.groupBy("rid", "term").agg((F.max("share") >= REMOVE).alias("remove")).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias("told"))
    spans = found.select("rid", "body").join(hits, "rid").select("rid", terms_in(F.col("body"), F.col("told")).alias("terms"))
    out = found.drop("body").withColumn("base", F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))).drop("spans").join(spans, "rid", "left")
    free = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return out.withColumn("terms", F.coalesce(free, F.array().cast(TERMS)))


def names(spans: Column, kind) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda x: F.concat(kind(x), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def kind_name(span: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in KINDS]), span["kind"])


def sanitise(docs: DataFrame, text: str = "text", column: str = "sanitized") -> DataFrame:
    """`docs` with the sanitised text: base spans and removed terms become [kind], generalised ones keep length and case.

    Of overlapping base spans the first ends where it does and the next takes the rest. Null texts
    stay null; repeated rows are rows of their own; a column of that name is replaced.
    """
    numbered = materialize(docs.drop(column).withColumn("rid", F.monotonically_increasing_id()), "numbered")
    found = analyse(numbered.select("rid", text), text).select("rid", "base", "terms")
    every = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), kind_name(x).alias("as"))), F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["remove"], "term").alias("as")))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda a, b: F.substr(F.col(text), a + 1, F.greatest(F.lit(0), b - a))

    def step(acc: Column, x: Column) -> Column:
        general = F.regexp_replace(F.regexp_replace(piece(x["s"], x["e"]), r"\p{Lu}", "X"), r"[\p{L}&&[^X]]", "x")
        with_span = F.concat(acc["out"], F.array(piece(acc["at"], x["s"]), F.coalesce(F.concat(F.lit("["), x["as"], F.lit("]")), general)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["e"] > acc["at"], with_span).otherwise(acc["out"]).alias("out"))

    joined = numbered.join(found.withColumn("__spans", every).select("rid", "__spans"), "rid")
    done = F.aggregate("__spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), piece(acc["at"], F.length(F.col(text)))))
    return joined.withColumn(column, F.when(F.size("__spans") > 0, done).otherwise(F.col(text))).drop("rid", "__spans")


def op6_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their base spans and the spans of the terms that reveal protected entities.

    A null or empty text has no spans; repeated rows are rows of their own; an empty table gives an
    empty result; other columns are ignored. n_removed and n_generalised count the added spans.
    """
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    out = analyse(docs)
    base = names(F.col("base"), kind_name)
    added = names(F.col("terms"), lambda x: F.lit("term"))
    removed = F.size(F.filter("terms", lambda t: t["remove"])).cast("long")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, added), ",").alias("spans"), removed.alias("n_removed"), (F.size("terms") - removed).cast("long").alias("n_generalised"))
