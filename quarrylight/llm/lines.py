"""Lines repeated across the documents of one source.

Texts are read once, into the hashes of their lines.  Equal documents of a ticker
are collapsed first; a line is then counted over the collapsed documents, each with
the number of chunk_ids it stands for, and over clusters of equal texts and filing
dates, which tell a republished article from boilerplate.  Two documents are equal
if their lines are, after folding case and blanks; a chunk_id that was ingested
with different texts is a document of its own, with the lines of all of them.
``boilerplate`` keeps lines by clusters and dates, ``repeated_line_numbers`` by
chunk_ids.

Defined results: rows with a null chunk_id, ticker or text have no lines; a line
without a letter never repeats; an empty table gives no rows; other columns are
ignored; in the cleaned texts a re-ingested chunk comes out once, with its
latest text, and null texts stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import fold
from quarrylight.session import cut

MIN_CHUNKS = 5
#: What makes a repeated line boilerplate: so many different texts, on so many dates.
MIN_CLUSTERS, MIN_DATES = 5, 2
#: Up to so many repeated lines, as counted, are broadcast (24 bytes each); more of them meet the lines in a shuffle.
MOST_BROADCAST = 500_000
DOCUMENT = ("ticker", "t1", "t2")


def _usable(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("chunk_id").isNotNull() & F.col("ticker").isNotNull() & F.col("text").isNotNull())


def _folded(text):
    return F.transform(F.split(text, "\n", -1), fold)


def _told(line):
    """A folded line, or null where it holds no letter."""
    return F.when(line.rlike(r"\p{L}"), line)


def _h1(line):
    return F.xxhash64("ticker", line)


def _h2(line):
    return F.xxhash64(F.lit(1), line, "ticker")


def _documents(chunks: DataFrame) -> DataFrame:
    """One row a row of the table: chunk_id, ticker, date, document (t1, t2), cluster, and the numbers and hashes of its lines."""
    # lines without a letter tell documents apart, too
    rows = _usable(chunks).select("chunk_id", "ticker", "date", _folded(F.col("text")).alias("whole"))
    rows = rows.withColumn("lines", F.transform("whole", _told))
    nos = F.filter(F.transform("lines", lambda x, i: F.when(x.isNotNull(), i + 1)), lambda i: i.isNotNull())
    text = F.array_join(F.filter("whole", lambda x: x != ""), " ")
    rows = rows.select("chunk_id", "ticker", "date", F.xxhash64(text).alias("cluster"), F.xxhash64("whole").alias("t1"), F.xxhash64(F.lit(1), "whole").alias("t2"), nos.alias("nos"), F.filter("lines", lambda x: x.isNotNull()).alias("there"))
    return cut(rows.select("chunk_id", "ticker", "date", "cluster", "t1", "t2", "nos", F.transform("there", _h1).alias("h1s"), F.transform("there", _h2).alias("h2s")))


def _each(docs: DataFrame, *cols: str) -> DataFrame:
    """One row a different line of a document."""
    pairs = F.array_distinct(F.arrays_zip(F.col("h1s").alias("h1"), F.col("h2s").alias("h2")))
    return docs.select(*cols, F.inline(pairs))


def _of_chunk(rows: DataFrame) -> DataFrame:
    """One row a chunk_id of a ticker: its document, and whether it has one only."""
    one = (F.min("t1") == F.max("t1")) & (F.min("t2") == F.max("t2"))
    return rows.groupBy("ticker", "chunk_id").agg(F.min("t1").alias("t1"), F.min("t2").alias("t2"), one.alias("one"))


def _collapsed(rows: DataFrame) -> DataFrame:
    """One row a document: its lines, its cluster and the number of chunk_ids that have this text and no other."""
    weight = _of_chunk(rows).where("one").groupBy(*DOCUMENT).agg(F.count("*").alias("weight"))
    return rows.groupBy(*DOCUMENT).agg(F.first("h1s").alias("h1s"), F.first("h2s").alias("h2s"), F.first("cluster").alias("cluster")).join(weight, [*DOCUMENT], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def _repeated(rows: DataFrame, docs: DataFrame, least: int) -> tuple[DataFrame, bool]:
    """(h1, h2, n_chunks) of the lines in ``least`` chunk_ids or more, and whether they are few enough to broadcast."""
    several = _of_chunk(rows).where("not one").select("ticker", "chunk_id")
    apart = _each(rows.join(several, ["ticker", "chunk_id"], "left_semi"), "chunk_id").distinct().select("h1", "h2", F.lit(1).cast("bigint").alias("weight"))
    counted = _each(docs.where("weight > 0"), "weight").select("h1", "h2", "weight").unionByName(apart)
    hit = cut(counted.groupBy("h1", "h2").agg(F.sum("weight").alias("n_chunks")).where(F.col("n_chunks") >= least))
    return hit, hit.count() <= MOST_BROADCAST


def repeated_line_numbers(chunks: DataFrame, least: int = MIN_CHUNKS) -> DataFrame:
    """(chunk_id, line_no) of every line found in ``least`` chunk_ids of its ticker or more.

    A line that fills a third of all rows is counted by sums that combine before the shuffle.
    """
    rows = _documents(chunks)
    hit, few = _repeated(rows, _collapsed(rows), least)
    lines = rows.select("chunk_id", F.inline(F.arrays_zip(F.col("nos").alias("line_no"), F.col("h1s").alias("h1"), F.col("h2s").alias("h2"))))
    keys = hit.select("h1", "h2")
    found = lines.join(F.broadcast(keys) if few else keys, ["h1", "h2"], "left_semi")
    return found.select("chunk_id", F.col("line_no").cast("bigint").alias("line_no")).distinct()


def repeated_lines(chunks: DataFrame, least: int = MIN_CHUNKS) -> DataFrame:
    """The repeated lines of each ticker with the chunk_ids, clusters of equal texts and filing dates they occur in."""
    rows = _documents(chunks)
    docs = cut(_collapsed(rows))
    hit, few = _repeated(rows, docs, least)
    keys = hit.select("h1", "h2")
    near = F.broadcast(keys) if few else keys
    held = cut(_each(docs, *DOCUMENT, "cluster").join(near, ["h1", "h2"], "left_semi"))
    # distinct counts in two steps, so that no task holds the set of a hot line
    cluster_n = held.select("h1", "h2", "cluster").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_clusters"))
    dates = rows.where(F.col("date").isNotNull()).select(*DOCUMENT, "date").distinct()
    date_n = held.join(dates, [*DOCUMENT]).select("h1", "h2", "date").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_dates"))
    # the words of a line are looked up last, and for repeated lines only
    said = _usable(chunks).select("ticker", F.explode(_folded(F.col("text"))).alias("line")).where(_told(F.col("line")).isNotNull())
    said = said.select("ticker", "line", _h1(F.col("line")).alias("h1"), _h2(F.col("line")).alias("h2")).join(near, ["h1", "h2"], "left_semi")
    words = said.groupBy("h1", "h2").agg(F.min("ticker").alias("ticker"), F.min("line").alias("line"))
    out = hit.join(words, ["h1", "h2"]).join(cluster_n, ["h1", "h2"], "left").join(date_n, ["h1", "h2"], "left")
    return out.select("ticker", "line", "n_chunks", "n_clusters", F.coalesce("n_dates", F.lit(0).cast("bigint")).alias("n_dates"))


def boilerplate(chunks: DataFrame, clusters: int = MIN_CLUSTERS, dates: int = MIN_DATES) -> DataFrame:
    """Lines of so many different texts on so many dates: the lines of a text that is republished are none, however often it is."""
    return repeated_lines(chunks, clusters).where((F.col("n_clusters") >= clusters) & (F.col("n_dates") >= dates))


def without_repeated_lines(chunks: DataFrame, least: int = MIN_CHUNKS) -> DataFrame:
    """Each chunk's latest text without the repeated lines, and how many went."""
    latest = chunks.groupBy("chunk_id").agg(F.max_by(F.struct("ticker", "text"), F.struct("ingested_at", "text")).alias("r")).select("chunk_id", "r.*")
    gone = repeated_line_numbers(chunks, least).groupBy("chunk_id").agg(F.collect_list("line_no").alias("nos"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("nos"), (i + 1).cast("bigint")))
    return latest.join(gone, "chunk_id", "left").select(
        "chunk_id",
        "ticker",
        F.when(F.col("nos").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"),
        F.when(F.col("text").isNull() | F.col("nos").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).alias("n_removed"),
    )
