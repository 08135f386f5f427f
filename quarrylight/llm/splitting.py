"""Splitting oversized texts at natural boundaries.

Breaks are ends of lines and of sentences.  Lexical cohesion at a break is the
cosine of the word counts of the blocks on its two sides, without common words
where a table of them is given; the depth of a valley is how far cohesion rises
again on either side.  Each piece ends at the deepest valley of its whole size
window, the last of equal ones; a window without a break falls back to blanks,
then to the limit itself.

Defined results: null texts, unknown or null chunk types and limits below one
have nothing to split; a text of exactly the limit is not oversized; exact
copies of a row (re-ingestions) give one set of pieces; an overlap above half
the limit counts as half the limit; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A break lies after a line end, or after a sentence end with its closing marks and blanks.
_BREAK = re.compile(r"\n+|[.!?…]+[\"'”’»)\]]*[ \t ]+(?=\S)")
_WORD = re.compile(r"[^\W\d_]{3,}")
_BLANK = re.compile(r"\s")


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


def valleys(text: str, block: int = 3, common: frozenset[str] = frozenset()) -> list[tuple[int, float]]:
    """(offset, depth) of each natural break; ``block`` units are compared on each side."""
    at = [m.end() for m in _BREAK.finditer(text) if 0 < m.end() < len(text)]
    if not at:
        return []
    units = [Counter(w for w in _WORD.findall(text[a:b].lower()) if w not in common) for a, b in zip([0, *at], [*at, len(text)], strict=True)]
    cohesion = []
    left, right = Counter(), Counter()
    for u in units[1 : 1 + block]:
        right.update(u)
    for i in range(len(at)):
        left.update(units[i])
        if i >= block:
            left = +(left - units[i - block])
        cohesion.append(_cosine(left, right))
        right = +(right - units[i + 1])
        if i + 1 + block < len(units):
            right.update(units[i + 1 + block])
    n = len(cohesion)
    rise_l, rise_r = cohesion[:], cohesion[:]
    for i in range(1, n):
        if cohesion[i - 1] >= cohesion[i]:
            rise_l[i] = rise_l[i - 1]
    for i in range(n - 2, -1, -1):
        if cohesion[i + 1] >= cohesion[i]:
            rise_r[i] = rise_r[i + 1]
    return [(at[i], rise_l[i] + rise_r[i] - 2 * cohesion[i]) for i in range(n)]


def cut_points(text: str, limit: int, overlap: int, block: int = 3, common: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """(start, end) of the pieces; neighbours share exactly the overlap."""
    overlap = max(0, min(overlap, limit // 2))
    breaks = valleys(text, block, common)
    out, start, k = [], 0, 0
    while len(text) - start > limit:
        end = start + limit
        least = start + overlap  # a cut must lie beyond it, or the next piece makes no way
        while k < len(breaks) and breaks[k][0] <= least:
            k += 1
        j = k
        best = None
        while j < len(breaks) and breaks[j][0] <= end:
            if best is None or breaks[j][1] >= best[1]:
                best = breaks[j]
            j += 1
        if best:
            cut = best[0]
        else:
            cut = next((i + 1 for i in range(end - 1, least, -1) if _BLANK.match(text[i])), 0)
            if not cut:
                cut = end
                while cut > least + 1 and (unicodedata.combining(text[cut]) or text[cut] in "‍️" or text[cut - 1] == "‍"):
                    cut -= 1
        out.append((start, cut))
        start = cut - overlap
    out.append((start, len(text)))
    return out


PIECES = pa.schema(
    [("chunk_id", pa.string()), ("parent_id", pa.string()), ("section_title", pa.string()), ("chunk_type", pa.string()), ("piece_no", pa.int32()), ("start_char", pa.int64()), ("n_chars", pa.int32()), ("piece", pa.large_string())]
)
PIECES_DDL = "chunk_id string, parent_id string, section_title string, chunk_type string, piece_no int, start_char bigint, n_chars int, piece string"


def _pieces(common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for no, (a, b) in enumerate(cut_points(r["text"], r["max_chars"], r["overlap_chars"], common=common), 1):
                    rows.append((r["chunk_id"], r["parent_id"], r["section_title"], r["chunk_type"], no, a, b - a, r["text"][a:b]))
            cols = list(zip(*rows, strict=True)) or [()] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.int32(), pa.int64(), pa.int32(), pa.string()], strict=True)], names=PIECES.names)

    return run


#: The most rows of common words that are read to the driver.
MOST_WORDS = 50_000


def _common(common_words: DataFrame | None) -> frozenset[str]:
    if common_words is None:
        return frozenset()
    rows = common_words.where(F.col("word").isNotNull()).select(F.lower("word")).distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return frozenset(r[0] for r in rows)


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    lim = limits.where(F.col("max_chars") > 0).groupBy("chunk_type").agg(F.min("max_chars").alias("max_chars"), F.coalesce(F.min("overlap_chars"), F.lit(0)).alias("overlap_chars"))
    return (
        chunks.select("chunk_id", "parent_id", "section_title", "chunk_type", "text")
        .join(lim, "chunk_type")
        .where(F.length("text") > F.col("max_chars"))
        .distinct()
    )


def split_chunks(chunks: DataFrame, limits: DataFrame, common_words: DataFrame | None = None) -> DataFrame:
    """The pieces of every oversized chunk, numbered from 1; ``common_words`` (word) tell no topic."""
    cols = ["chunk_id", "parent_id", "section_title", "chunk_type", "text", F.col("max_chars").cast("int").alias("max_chars"), F.col("overlap_chars").cast("int").alias("overlap_chars")]
    return oversized(chunks, limits).select(*cols).mapInArrow(_pieces(_common(common_words)), PIECES_DDL)


def split_ids(chunks: DataFrame, limits: DataFrame, common_words: DataFrame | None = None) -> DataFrame:
    """chunk_id of every chunk that came out in pieces."""
    return split_chunks(chunks, limits, common_words).where(F.col("piece_no") == 1).select("chunk_id").distinct()


def reassembled(chunks: DataFrame, limits: DataFrame, common_words: DataFrame | None = None) -> DataFrame:
    """(chunk_id, text_md5, n_chars, within_limit, overlap_kept) of the texts as their pieces give them back."""
    lim = limits.groupBy("chunk_type").agg(F.min("max_chars").alias("most"), F.coalesce(F.min("overlap_chars"), F.lit(0)).alias("shared"))
    shared = F.least("shared", F.floor(F.col("most") / 2)).cast("int")
    parts = split_chunks(chunks, limits, common_words).join(lim, "chunk_type").select("chunk_id", "most", shared.alias("shared"), F.struct("piece_no", "start_char", "n_chars", "piece").alias("p"))
    whole = parts.groupBy("chunk_id", "most", "shared").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p, i: F.when(i == 0, p["piece"]).otherwise(p["piece"].substr(F.col("shared") + 1, p["n_chars"]))), "")
    pairs = F.arrays_zip(F.slice("ps", F.lit(1), F.size("ps") - 1).alias("a"), F.slice("ps", F.lit(2), F.size("ps") - 1).alias("b"))
    kept = F.forall(pairs, lambda x: (x["b"]["start_char"] == x["a"]["start_char"] + x["a"]["n_chars"] - F.col("shared")) & (x["a"]["piece"].substr(x["a"]["n_chars"] - F.col("shared") + 1, F.col("shared")) == x["b"]["piece"].substr(F.lit(1), F.col("shared"))))
    fits = F.forall("ps", lambda p: (p["n_chars"] <= F.col("most")) & (F.length(p["piece"]) == p["n_chars"]))
    return whole.select("chunk_id", text.alias("text"), fits.alias("within_limit"), kept.alias("overlap_kept")).select("chunk_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"), "within_limit", "overlap_kept")
