"""Context packing, citations and grounding of answers.

Frame: hits (qid, pos, chunk_id, parent_id, text, ...), ``pos`` counted from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import token_count, token_head

# Phrases of an answer that is not grounded in its context.
UNGROUNDED = (
    "do not contain sufficient information",
    "cannot determine",
    "not mentioned in",
    "not provided in",
    "no information",
    "unable to find",
    "context does not",
    "documents do not",
    "not available in",
    "insufficient information",
    "not present in",
    "no relevant",
    "cannot be answered",
)


def one_per_parent(hits: DataFrame) -> DataFrame:
    """The first hit of each parent (of itself, where it has none)."""
    w = Window.partitionBy("qid", F.coalesce("parent_id", "chunk_id")).orderBy("pos")
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def valley(hits: DataFrame) -> DataFrame:
    """Best hits at both ends, the weakest in the middle: ``slot`` counted from 1."""
    i = F.row_number().over(Window.partitionBy("qid").orderBy("pos")) - 1
    n = F.count("*").over(Window.partitionBy("qid"))
    spread = hits.withColumn("_i", i).withColumn("_n", n)
    slot = F.when(F.col("_i") % 2 == 0, F.col("_i") / 2).otherwise(F.col("_n") - 1 - (F.col("_i") - 1) / 2)
    return spread.withColumn("slot", slot.cast("int") + 1).drop("_i", "_n")


def block(slot: Column, ticker: Column, period: Column, title: Column, body: Column) -> Column:
    shown = F.when(F.coalesce(title, F.lit("")) == "", "—").otherwise(F.substring(title, 1, 60))
    return F.concat(F.lit("--- ["), slot.cast("string"), F.lit("] "), F.coalesce(ticker, F.lit("")), F.lit(" | "), F.coalesce(period, F.lit("")), F.lit(" | "), shown, F.lit(" ---\n"), F.coalesce(body, F.lit("")))


def within_budget(blocks: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of blocks within the budget; a first block above it is cut at the end of its last piece within it."""
    w = Window.partitionBy("qid").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    run = blocks.withColumn("tokens", token_count(F.col("block"))).withColumn("upto", F.sum("tokens").over(w))
    first = (F.col("slot") == 1) & (F.col("tokens") > budget)
    kept = run.where((F.col("upto") <= budget) | first).withColumn("block", F.when(first, token_head(F.col("block"), budget)).otherwise(F.col("block")))
    return kept.withColumn("tokens", F.least("tokens", F.lit(budget))).drop("upto")


def pack(hits: DataFrame, budget: int) -> DataFrame:
    """(qid, context, n_blocks, tokens)."""
    slots = valley(one_per_parent(hits))
    blocks = slots.select("qid", "slot", block(F.col("slot"), F.col("ticker"), F.col("fiscal_period"), F.col("section_title"), F.col("text")).alias("block"))
    kept = within_budget(blocks, budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "block"))), lambda x: x["block"]), "\n\n")
    return kept.groupBy("qid").agg(text.alias("context"), F.count("*").alias("n_blocks"), F.sum("tokens").alias("tokens"))


def citation_numbers(answer: Column) -> Column:
    found = F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.cast("int"))))


def citations(answers: DataFrame) -> DataFrame:
    """(id, n, chunk, known): numbers cited by an answer with the context chunk they stand for."""
    cited = answers.select("id", "chunks", F.explode(citation_numbers(F.col("answer"))).alias("n"))
    there = F.col("n").between(1, F.coalesce(F.size("chunks"), F.lit(0)))
    return cited.select("id", "n", F.when(there, F.try_element_at("chunks", F.when(there, F.col("n")).otherwise(1))).alias("chunk"), F.coalesce(there, F.lit(False)).alias("known"))


def grounded(answer: Column) -> Column:
    low = F.lower(answer)
    hit = F.lit(False)
    for p in UNGROUNDED:
        hit = hit | F.contains(low, F.lit(p))
    return ~hit
