"""Readers and writers of the file formats around the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.text import word_count
from quarrylight.operators.chunking import html_text
from quarrylight.session import exists

SUBMISSIONS = "cik STRING, filings STRUCT<recent: STRUCT<form: ARRAY<STRING>, filingDate: ARRAY<STRING>, accessionNumber: ARRAY<STRING>>>"
GRAPH = "entities ARRAY<STRUCT<name: STRING, entity_type: STRING, ticker: STRING, fiscal_period: STRING, chunk_ids: ARRAY<STRING>, aliases: ARRAY<STRING>>>, relationships ARRAY<STRUCT<source: STRING, target: STRING, relation: STRING, ticker: STRING, chunk_id: STRING>>"


def read_submissions(spark: SparkSession, path: str, start: str, end: str, form: str = "8-K") -> DataFrame:
    """Filings of one form and period from JSON objects of parallel arrays."""
    raw = spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path)
    z = F.inline(F.arrays_zip(F.col("filings.recent.form").alias("form"), F.col("filings.recent.filingDate").alias("date"), F.col("filings.recent.accessionNumber").alias("accession")))
    return raw.select("cik", z).where((F.col("form") == form) & F.col("date").between(start, end))


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.htm") -> DataFrame:
    """(name, ticker, date, html) of pages called TICKER_DATE_...; a name without a date has 'unknown'."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("html"))
    parts = F.split(F.regexp_replace("name", r"\.[^.]*$", ""), "_")
    return raw.select("name", parts[0].alias("ticker"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("unknown")).alias("date"), "html")


def parsed(pages: DataFrame, least_words: int = 100) -> DataFrame:
    """Text of pages that pass the word floor."""
    return pages.withColumn("text", html_text(F.col("html"))).drop("html").where(word_count(F.col("text")) >= least_words)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of graph files; broken files count as empty."""
    raw = spark.read.schema(GRAPH).option("mode", "PERMISSIVE").json(path)
    return raw.select(F.inline("entities")), raw.select(F.inline("relationships"))


def write_traces(traces: DataFrame, path: str) -> None:
    """JSON lines partitioned by the day of ``ts``."""
    traces.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def read_traces(spark: SparkSession, path: str, schema: str | T.StructType, limit: int = 50) -> DataFrame:
    """The latest traces; lines that do not parse are skipped and do not count."""
    full = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    full = T.StructType([*full.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record").orderBy(F.desc("ts")).limit(limit)


def report(scores: DataFrame) -> DataFrame:
    """Rows of the evaluation report: scores to four places, long texts cut."""
    return scores.select("run", "sample_id", "metric", F.round("score", 4).alias("score"), "failed", F.substring("question", 1, 80).alias("question"))


def write_report(scores: DataFrame, path: str) -> None:
    report(scores).write.mode("overwrite").option("header", True).csv(path)


def filing_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, description, name, type) of the rows of filing index tables that have four cells or more."""
    cell = lambda row, i: F.trim(F.regexp_replace(F.try_element_at(F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), F.lit(i)), r"(?s)<[^>]*>", ""))
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("ord", "row"))
    out = rows.where(F.regexp_count("row", F.lit(r"(?i)<td")) >= 4).select(key, "ord", F.lower(cell(F.col("row"), 2)).alias("description"), cell(F.col("row"), 3).alias("name"), cell(F.col("row"), 4).alias("type"))
    return out.where(F.col("name") != "")


def filing_name(ticker: Column, date: Column, accession: Column) -> Column:
    """File name of a filing: ticker, date and ten characters of its accession number."""
    return F.concat_ws("_", ticker, date, F.concat(F.substring(F.regexp_replace(accession, "-", ""), 1, 10), F.lit(".htm")))


def write_graph(entities: DataFrame, relationships: DataFrame, path: str) -> None:
    """One JSON object a line: all rows of an entity type or of a relation together would not fit, so each row is its own small graph."""
    e = entities.select(F.array(F.struct("name", "entity_type", "ticker", "fiscal_period", "chunk_ids", "aliases")).alias("entities"), F.array().cast("array<struct<source:string,target:string,relation:string,ticker:string,chunk_id:string>>").alias("relationships"))
    r = relationships.select(F.array().cast("array<struct<name:string,entity_type:string,ticker:string,fiscal_period:string,chunk_ids:array<string>,aliases:array<string>>>").alias("entities"), F.array(F.struct("source", "target", "relation", "ticker", "chunk_id")).alias("relationships"))
    e.unionByName(r).write.mode("overwrite").json(path)


def write_experiment(averages: DataFrame, path: str) -> None:
    """One JSON object a run: {run, metrics: [{metric, mean, n}]}, means to four places."""
    each = averages.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("metric", F.round("mean", 4).alias("mean"), "n"))).alias("metrics"))
    each.write.mode("overwrite").json(path)


def read_experiment(spark: SparkSession, path: str) -> DataFrame:
    """(run, metric, mean, n) of such reports."""
    return spark.read.schema("run STRING, metrics ARRAY<STRUCT<metric: STRING, mean: DOUBLE, n: BIGINT>>").json(path).select("run", F.inline("metrics"))


RESULT = "id STRING, answer STRING, chunks ARRAY<STRING>, latency_seconds DOUBLE, failed BOOLEAN, error STRING"


def result_json(**fields: Column) -> Column:
    """A result as JSON: its latency to three places, nulls left out."""
    return F.to_json(F.struct(*[(F.round(c, 3) if k == "latency_seconds" else c).alias(k) for k, c in fields.items()]))


def result_from_json(text: Column) -> Column:
    """The result again; what is missing is null, a text that does not parse gives none."""
    return F.from_json(text, RESULT)


def mark_done(spark: SparkSession, names: DataFrame, path: str) -> None:
    """Append the names (name) that are done; written after all else, so a crash repeats work and loses none."""
    names.select("name").write.mode("append").parquet(path)


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """(name) of what is done; nothing is, where nothing was marked."""
    return spark.read.schema("name STRING").parquet(path) if exists(spark, path) else spark.createDataFrame([], "name STRING")
