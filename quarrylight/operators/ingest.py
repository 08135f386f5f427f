"""Incremental ingestion and inspection of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet; write ``done`` after everything else, or a crash loses files."""
    return files.join(done.select(key), key, "left_anti")


def keep_latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the last in order; combines map-side, a hot key is no hot task.  Null keys are one key."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")


def zipped(rows: DataFrame, key: str, *arrays: str) -> DataFrame:
    """Parallel arrays to rows, in order."""
    return rows.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("ord", "z")).select(key, "ord", "z.*")


def best_document(docs: DataFrame) -> DataFrame:
    """Of each filing the first exhibit, else the first main document; (filing, name)."""
    low, desc = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    exhibit = F.col("type").isin("EX-99.1", "EX-99.2", "EX-99") | F.contains(low, F.lit("ex99")) | F.contains(low, F.lit("ex-99")) | desc.rlike("earnings|press release|financial results|exhibit 99")
    rank = F.when(exhibit, 0).when((F.col("type") == "8-K") & (F.col("name") != ""), 1)
    return docs.withColumn("_p", rank).where(F.col("_p").isNotNull()).groupBy("filing").agg(F.min_by("name", F.struct("_p", "ord")).alias("name"))


def inspect(rows: DataFrame, text: str, *dims: str) -> DataFrame:
    """Counts and lengths of the whole and by each dimension, in one pass."""
    sets = [[d] for d in dims] + [[]]
    agg = [F.count("*").alias("n"), F.round(F.avg(F.length(text)), 6).alias("avg_chars"), F.min(F.length(text)).alias("min_chars"), F.max(F.length(text)).alias("max_chars")]
    return rows.groupingSets(sets, *dims).agg(*agg, F.grouping_id().cast("int").alias("gid"))


def valid_question(question: Column) -> Column:
    n = F.length(F.trim(question))
    return F.when(question.isNull() | (n < 3), "too short").when(n > 2000, "too long").otherwise("ok")


def sse(line: Column) -> Column:
    """Payload of a server-sent line: null for other lines, '[DONE]' at the end."""
    return F.when(line.startswith("data: "), F.trim(F.substring(line, 7, 2**31 - 1)))


def latency_label(seconds: Column) -> Column:
    return F.when(seconds.isNull(), F.lit(None)).when(seconds < 1, F.concat(F.round(seconds * 1000, 0).cast("int").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.2f", F.round(seconds, 2)), F.lit("s")))


def count_label(n: Column) -> Column:
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.format_string("%.1f", F.round(n / 1000, 1)), F.lit("K")))
