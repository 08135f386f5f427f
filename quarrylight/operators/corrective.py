"""Grading of retrieved chunks and correction of the result set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

HIGH, LOW = 0.6, 0.2
_GRADE = T.StructType([T.StructField("relevant", T.StringType()), T.StructField("score", T.StringType()), T.StructField("reasoning", T.StringType())])


def parse_grade(raw: Column) -> Column:
    """struct(relevant, score, reasoning): JSON, else the first braces in it, else relevant at 0.5."""
    whole = F.from_json(F.trim(raw), _GRADE)
    inner = F.from_json(F.regexp_extract(raw, r"\{[^}]+\}", 0), _GRADE)
    usable = lambda g: F.coalesce(g["relevant"], g["score"], g["reasoning"]).isNotNull()
    g = F.when(usable(whole), whole).when(usable(inner), inner)
    score = F.coalesce(g["score"].try_cast("double"), F.lit(0.5))
    return F.struct(
        F.coalesce(F.lower(g["relevant"]) != "false", F.lit(True)).alias("relevant"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"),
        F.substring(F.coalesce(g["reasoning"], F.lit("")), 1, 250).alias("reasoning"),
    )


def grade_lexical(question: Column, text: Column, least: float = 0.3) -> Column:
    """Default judge: enough of the question's terms are in the text."""
    q = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(r"(\w+)"), F.lit(1)))
    t = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1)))
    return F.coalesce(F.size(F.array_intersect(q, t)) / F.nullif(F.size(q), F.lit(0)) >= least, F.lit(False))


def actions(questions: DataFrame, grades: DataFrame) -> DataFrame:
    """(qid, n_chunks, n_relevant, relevance_ratio, action); a question without chunks is INCORRECT."""
    per = grades.groupBy("qid").agg(F.count("*").alias("n_chunks"), F.sum(F.col("relevant").cast("bigint")).alias("n_relevant"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    out = questions.select("qid").distinct().join(per, "qid", "left").select("qid", zero("n_chunks"), zero("n_relevant"))
    ratio = F.when(F.col("n_chunks") > 0, F.round(F.col("n_relevant") / F.col("n_chunks"), 6)).otherwise(F.lit(0.0))
    out = out.withColumn("relevance_ratio", ratio)
    action = F.when(F.col("n_chunks") == 0, "INCORRECT").when(F.col("relevance_ratio") >= HIGH, "CORRECT").when(F.col("relevance_ratio") <= LOW, "INCORRECT").otherwise("AMBIGUOUS")
    return out.withColumn("action", action)


def web_id(url: Column) -> Column:
    return F.concat(F.lit("web:"), F.substring(F.md5(url), 1, 8))


def corrected(local: DataFrame, web: DataFrame, acts: DataFrame) -> DataFrame:
    """CORRECT keeps the local hits, AMBIGUOUS the relevant ones and the web's, INCORRECT the web's only."""
    mine = local.join(acts.select("qid", "action"), "qid").where((F.col("action") == "CORRECT") | ((F.col("action") == "AMBIGUOUS") & F.col("relevant"))).select("qid", "chunk_id", F.lit(0).alias("part"), "pos")
    other = web.join(acts.select("qid", "action"), "qid").where(F.col("action") != "CORRECT").select("qid", "chunk_id", F.lit(1).alias("part"), "pos")
    return mine.unionByName(other).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("part", "pos", "chunk_id"))).select("qid", "chunk_id", "place")


def web_search(questions: DataFrame, pages: DataFrame, most: int = 4) -> DataFrame:
    """Default web provider: a table of pages (url, title, snippet, score) matched to each question's ``topic``.

    ``most`` is held within 1 and 10; blank snippets are dropped, long ones cut; the best score comes first.
    """
    k = max(1, min(10, most))
    found = questions.join(pages, "topic").where(F.trim(F.coalesce("snippet", F.lit(""))) != "")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.coalesce("score", F.lit(0.5))), "url"))
    shown = F.concat(F.lit("[WEB] "), F.substring(F.coalesce("title", F.lit("")), 1, 200), F.lit("\n\n"), F.substring("snippet", 1, 1500))
    return found.withColumn("pos", best).where(F.col("pos") <= k).select("qid", "pos", web_id(F.col("url")).alias("chunk_id"), shown.alias("text"), F.coalesce("score", F.lit(0.5)).alias("score"))
