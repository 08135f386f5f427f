"""Knowledge graph on two tables: entities and relationships.

Names are compared in folded form; null or blank names, sources and targets name nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import fold


def by_merge(df: DataFrame) -> DataFrame:
    """A side that grows with the data: its join sorts and spills, and never sends it through the driver as a broadcast."""
    return df.hint("merge")


def canonical_key(kind: Column, ticker: Column, name: Column) -> Column:
    return F.concat_ws("::", kind, F.coalesce(ticker, F.lit("")), fold(name))


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row a key: scalars of the first row, unions of chunk_ids and aliases."""
    first = F.struct(F.col("entity_id"))
    named = entities.where(fold(F.col("name")) != "").select(
        canonical_key(F.col("entity_type"), F.col("ticker"), F.col("name")).alias("entity_key"), "entity_id", "entity_type", "ticker", "fiscal_period", fold(F.col("name")).alias("name"), "chunk_ids", "aliases"
    )
    heads = named.groupBy("entity_key").agg(F.min("entity_id").alias("entity_id"), F.min_by("name", first).alias("name"), F.min_by("entity_type", first).alias("entity_type"), F.min_by("ticker", first).alias("ticker"), F.min_by("fiscal_period", first).alias("fiscal_period"), F.count("*").alias("n_rows"))
    # sets are distinct (key, item) pairs first, so that a hot key is combined map-side
    union = lambda c: named.select("entity_key", F.explode(c).alias("x")).where(F.col("x").isNotNull()).select("entity_key", (fold(F.col("x")) if c == "aliases" else F.col("x")).alias("x")).distinct().groupBy("entity_key").agg(F.sort_array(F.collect_list("x")).alias(c))
    empty = F.array().cast("array<string>")
    return heads.join(by_merge(union("chunk_ids")), "entity_key", "left").join(by_merge(union("aliases")), "entity_key", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", empty)).withColumn("aliases", F.coalesce("aliases", empty))


def edges(relationships: DataFrame) -> DataFrame:
    ends = relationships.select("rel_id", fold(F.col("source")).alias("source"), fold(F.col("target")).alias("target"), "relation", "ticker", "fiscal_period", "chunk_id")
    return ends.where((F.col("source") != "") & (F.col("target") != "")).withColumn("edge_key", F.concat(F.col("source"), F.lit("--"), F.col("relation"), F.lit("-->"), F.col("target")))


def dedup_edges(relationships: DataFrame) -> DataFrame:
    """The first relationship of each edge key."""
    e = edges(relationships)
    cols = [c for c in e.columns if c != "edge_key"]
    return e.groupBy("edge_key").agg(F.min_by(F.struct(*cols), "rel_id").alias("r")).select("edge_key", "r.*")


def cross_company(merged: DataFrame) -> DataFrame:
    """Names that more than one ticker has."""
    return merged.select("name", "ticker").distinct().groupBy("name").agg(F.sort_array(F.collect_list("ticker")).alias("tickers")).where(F.size("tickers") > 1)


def related(names: DataFrame, relationships: DataFrame) -> DataFrame:
    """(name, edge_key, other, direction) one hop out or in; a loop counts as outgoing only."""
    e = dedup_edges(relationships)
    out = e.join(by_merge(names), e["source"] == names["name"]).select("name", "edge_key", F.col("target").alias("other"), F.lit("out").alias("direction"))
    back = e.where(F.col("source") != F.col("target")).join(by_merge(names), F.col("target") == names["name"]).select("name", "edge_key", F.col("source").alias("other"), F.lit("in").alias("direction"))
    return out.unionByName(back)


#: The longest run of words of a question that is looked up; of a longer name it is the first words, and the rest is compared then.
NAME_WORDS = 8


def match_questions(questions: DataFrame, merged: DataFrame) -> DataFrame:
    """(qid, name) of names and aliases that a question holds as whole words.

    Runs of up to ``NAME_WORDS`` words of the question are looked up by equality, so
    it needs no nested loop over questions and names; a longer name is looked up by
    its first ``NAME_WORDS`` words and then compared as a whole.
    """
    toks = F.regexp_extract_all(fold(F.col("question")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    n = F.size("t")
    runs = F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(NAME_WORDS), n - i + 1)), lambda k: F.array_join(F.slice("t", i, k), " "))))
    grams = questions.select("qid", toks.alias("t")).select("qid", F.explode(F.array_distinct(runs)).alias("gram"))
    called = merged.select("name", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("said"))
    words = F.regexp_extract_all("said", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    heads = called.select("name", words.alias("w")).where(F.size("w") > 0).select("name", F.array_join(F.slice("w", 1, NAME_WORDS), " ").alias("gram"), F.when(F.size("w") > NAME_WORDS, F.array_join("w", " ")).alias("long")).distinct()
    text = questions.select("qid", F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")).alias("asked"))
    whole = F.col("long").isNull() | F.col("asked").contains(F.concat(F.lit(" "), F.col("long"), F.lit(" ")))
    return grams.join(by_merge(heads), "gram").join(by_merge(text), "qid", "left").where(whole).select("qid", "name").distinct()


def expand(matches: DataFrame, merged: DataFrame, relationships: DataFrame, existing: DataFrame, most: int | None = None, skip: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, hop, pos): chunks of matched names, then of their neighbours, without those already there.

    ``skip``: chunk_ids that never count.  With ``most`` only the first so many of a
    question come out, and then a name gives the questions its first chunks only:
    what is among the first of a question is among the first of the name it came by.
    """
    owned = merged.select("name", F.explode("chunk_ids").alias("chunk_id")).distinct()
    if skip is not None:
        owned = owned.join(by_merge(skip.select("chunk_id").distinct()), "chunk_id", "left_anti")
    known = existing.select("qid", "chunk_id").distinct()
    need = None
    if most is not None:
        # a chunk that is there already takes up a place of a name
        taken = known.groupBy("qid").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        need = most + (taken or 0)
    first = lambda df, key: df if need is None else df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("chunk_id"))).where(F.col("_n") <= need).drop("_n")
    owned = first(owned, "name")
    direct = matches.join(by_merge(owned), "name").select("qid", "chunk_id", F.lit(0).alias("hop"))
    near = related(matches.select("name").distinct(), relationships).select("name", "other").distinct()
    around = first(near.join(by_merge(owned.withColumnRenamed("name", "other")), "other").select("name", "chunk_id").distinct(), "name")
    hop = matches.join(by_merge(around), "name").select("qid", "chunk_id", F.lit(1).alias("hop"))
    found = direct.unionByName(hop).groupBy("qid", "chunk_id").agg(F.min("hop").alias("hop")).join(by_merge(known), ["qid", "chunk_id"], "left_anti")
    out = found.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("hop", "chunk_id")))
    return out if most is None else out.where(F.col("pos") <= most)


#: What may be a ticker: a word of capitals and figures.
TICKER = r"\b([A-Z][A-Z0-9]*)\b"


def mentions(chunks: DataFrame, companies: DataFrame) -> DataFrame:
    """(chunk_id, ticker, fiscal_period, mentioned): tickers of other companies that a text names in capitals."""
    said = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TICKER), F.lit(1))))
    known = companies.select(F.col("ticker").alias("mentioned")).distinct()
    return chunks.select("chunk_id", "ticker", "fiscal_period", said.alias("mentioned")).join(known, "mentioned").where(F.col("mentioned") != F.col("ticker")).select("chunk_id", "ticker", "fiscal_period", "mentioned").distinct()


def extract(chunks: DataFrame, companies: DataFrame, outputs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of texts: competitors by the tickers they name, and what a model said of them.

    ``outputs``: (chunk_id, ticker, output), a model's JSON for each text, if there is one.
    Entities: chunk_id, ticker, name, entity_type; relationships: chunk_id, ticker, source, target, relation.
    """
    said = mentions(chunks, companies)
    e = said.select("chunk_id", "ticker", fold(F.col("mentioned")).alias("name"), F.lit("COMPETITOR").alias("entity_type"))
    r = said.select("chunk_id", "ticker", fold(F.col("ticker")).alias("source"), fold(F.col("mentioned")).alias("target"), F.lit("COMPETES_WITH").alias("relation"))
    if outputs is not None:
        more_e, more_r = parse_extraction(outputs)
        e, r = e.unionByName(more_e), r.unionByName(more_r)
    return e.distinct(), r.distinct()


_EXTRACTED = "entities ARRAY<STRUCT<name: STRING, entity_type: STRING>>, relationships ARRAY<STRUCT<source: STRING, target: STRING, relation: STRING>>"


def parse_extraction(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of a model's JSON (chunk_id, ticker, output); what does not parse gives none."""
    d = raw.select("chunk_id", "ticker", F.from_json("output", _EXTRACTED).alias("j"))
    e = d.select("chunk_id", "ticker", F.inline("j.entities")).where(fold(F.col("name")) != "")
    r = d.select("chunk_id", "ticker", F.inline("j.relationships")).where((fold(F.col("source")) != "") & (fold(F.col("target")) != ""))
    return (
        e.select("chunk_id", "ticker", fold(F.col("name")).alias("name"), F.coalesce("entity_type", F.lit("METRIC")).alias("entity_type")),
        r.select("chunk_id", "ticker", fold(F.col("source")).alias("source"), fold(F.col("target")).alias("target"), F.coalesce("relation", F.lit("MENTIONED_WITH")).alias("relation")),
    )
