"""Parsing and chunking of filings.

Line and section rules are window arithmetic; only the two packing folds, whose
overlap feeds back into the next pack, run in Python, one document at a time.
Null texts give no sections and no chunks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import token_count, uuid5, word_count

PARENT_TOKENS, CHILD_TOKENS, PARENT_OVERLAP_WORDS, CHILD_OVERLAP_TOKENS = 512, 128, 64, 32
# Beginnings of a section header of at most eight words.
HEADERS = (
    r"^(financial highlights?|financial results?)",
    r"^(revenue|net (revenue|sales))",
    r"^(earnings per share|eps|diluted)",
    r"^(segment (results?|performance|revenue))",
    r"^(products?|services?|iphone|mac|ipad|wearables)",
    r"^(outlook|guidance|forward.looking)",
    r"^(balance sheet|cash flow|liquidity)",
    r"^(operating (income|expenses?|margin))",
    r"^(gross (margin|profit))",
    r"^(quarterly|annual|fiscal (year|quarter))",
    r"^(management|ceo|cfo).{0,30}(comment|remark|statement)",
    r"^(about|conference call|webcast|investor)",
    r"^(cautionary|forward.looking|safe harbor)",
    r"^#{1,4}\s+\S",
)
HEADER = "(?i)" + "|".join(HEADERS)
# Short forms after which a sentence goes on.
ABBREVIATION = r"\b(U\.S|No|vs|approx|est|Corp|Inc|Ltd|Dr|Mr|Mrs|e\.g|i\.e|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.$"
# What names a quarter, in order of precedence.
QUARTERS = (("first quarter", "Q1"), ("second quarter", "Q2"), ("third quarter", "Q3"), ("fourth quarter", "Q4"), ("Q1", "Q1"), ("Q2", "Q2"), ("Q3", "Q3"), ("Q4", "Q4"))
DROPPED_TAGS = ("script", "style", "nav", "header", "footer", "meta", "link")


def quarter(text: Column, month: Column) -> Column:
    """The first pattern in order of precedence in the head of the text, else the month's quarter, else Q1."""
    head = F.substring(text, 1, 3000)
    out = None
    for phrase, q in QUARTERS:
        hit = head.rlike(rf"(?i)\b{phrase}\b")
        out = F.when(hit, q) if out is None else out.when(hit, q)
    by_month = F.concat(F.lit("Q"), F.ceil(month / 3).cast("string"))
    return out.when(month.between(1, 12), by_month).otherwise("Q1")


def html_text(html: Column) -> Column:
    """Text of well-formed HTML: dropped subtrees and tags become line ends, lines are trimmed."""
    out = html
    for tag in DROPPED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def is_row(line: Column) -> Column:
    return F.trim(line).rlike(r"^\|.*\|$")


def is_header(line: Column) -> Column:
    s = F.trim(line)
    return (s != "") & (word_count(s) <= 8) & s.rlike(HEADER)


def is_table(text: Column) -> Column:
    """Two rows between bars, and four tenths of the lines that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    rows = F.filter(lines, is_row)
    return F.coalesce((F.size(rows) >= 2) & (F.size(rows) >= 0.4 * F.size(lines)), F.lit(False))


def sections(docs: DataFrame) -> DataFrame:
    """(id, seq, title, body) by gaps and islands over the lines of each text.

    A run of two rows or more is a table of its own; a header ends a section and
    names the next ones; other text counts if it has more than ten pieces, and
    any section if it has ten words.
    """
    w = Window.partitionBy("id").orderBy("pos")
    lines = docs.where(F.col("text").isNotNull()).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("row", is_row(F.col("line"))).withColumn("run", F.sum(F.when(F.col("row") == F.coalesce(F.lag("row").over(w), F.lit(False)), 0).otherwise(1)).over(w))
    in_table = F.col("row") & (F.count("*").over(Window.partitionBy("id", "run")) >= 2)
    lines = lines.withColumn("tab", in_table).withColumn("head", ~F.col("tab") & is_header(F.col("line")))
    before = F.lag("tab").over(w)
    starts = F.col("head") | (F.col("tab") != F.coalesce(before, F.lit(False)))
    lines = lines.withColumn("grp", F.sum(starts.cast("int")).over(w))
    title = F.last(F.when(F.col("head"), F.trim(F.regexp_replace(F.trim("line"), r"^#+", ""))), ignorenulls=True).over(w)
    lines = lines.withColumn("title", title)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("id", "grp").agg(F.max("tab").alias("tab"), F.min("title").alias("t"), F.trim(body).alias("body"), F.min("pos").alias("seq"))
    kept = F.when(F.col("tab"), True).otherwise(token_count(F.col("body")) > 10) & (word_count(F.col("body")) >= 10)
    return out.where(kept).select("id", "seq", F.when(F.col("tab"), "__TABLE__").otherwise(F.coalesce("t", F.lit(""))).alias("title"), "body")


def sentences(text: Column) -> Column:
    """Split before a capital after a stop, then joined again after a short form."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")
    out = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & F.element_at(acc, -1).rlike("(?i)" + ABBREVIATION),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(" "), p))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.filter(F.transform(out, lambda s: F.trim(s)), lambda s: s != "")


def prefix(ticker: Column, date: Column, doc_type: Column, title: Column) -> Column:
    plain = F.coalesce(title, F.lit("")).isin("", "__TABLE__", "Financial Table")
    return F.concat(F.lit("[Context: "), ticker, F.lit(" | "), doc_type, F.lit(" | "), date, F.when(plain, "").otherwise(F.concat(F.lit(" | Section: "), title)), F.lit("]\n\n"))


def chunk_id(ticker: Column, date: Column, index: Column) -> Column:
    return F.concat_ws("_", ticker, date, F.substring(uuid5(F.concat_ws(":", ticker, date)), 1, 8), index.cast("string"))


#: ASCII, as the JVM and SQL engines count.
_PIECE = re.compile(r"\w+|[^\w\s]", re.A)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_SHORT = re.compile(ABBREVIATION, re.I)


def _pieces(text: str) -> int:
    return len(_PIECE.findall(text))


def split_sentences(text: str) -> list[str]:
    out: list[str] = []
    for part in _SENTENCE.split(text):
        if out and _SHORT.search(out[-1]):
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return [s.strip() for s in out if s.strip()]


def pages(body: str, budget: int) -> list[str]:
    """The body, or its parts of at most ``budget`` pieces as they stand in it."""
    at = [m.span() for m in _PIECE.finditer(body)]
    return [body] if len(at) <= budget else [body[at[i][0] : at[min(i + budget, len(at)) - 1][1]] for i in range(0, len(at), budget)]


def pack_parents(parts: list[tuple[str, str]]) -> list[dict]:
    """Greedy packing of (title, body) into parents; a table stands alone and drops the overlap."""
    out: list[dict] = []
    held: list[str] = []
    size, title, tail = 0, "", ""

    def close() -> None:
        nonlocal held, size, tail
        if held:
            body = "\n\n".join(held)
            out.append({"kind": "parent", "title": title, "body": body, "overlap": bool(tail)})
            tail = " ".join(body.split()[-PARENT_OVERLAP_WORDS:])
        held, size = [], 0

    for name, body in parts:
        if name == "__TABLE__":
            close()
            out.append({"kind": "table", "title": "Financial Table", "body": body, "overlap": False})
            tail = ""
            continue
        for page in pages(body, PARENT_TOKENS):
            n = _pieces(page)
            if held and size + n > PARENT_TOKENS:
                close()
            if not held and tail:
                held, size = [tail], _pieces(tail)
            title = name or title
            held.append(page)
            size += n
    close()
    return out


def pack_children(body: str) -> list[str]:
    """Greedy packing of sentences; the next child starts with the longest tail that fits the overlap."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for s in split_sentences(body):
        n = _pieces(s)
        if held and size + n > CHILD_TOKENS:
            out.append(" ".join(held))
            keep, room = [], CHILD_OVERLAP_TOKENS
            for x in reversed(held):
                room -= _pieces(x)
                if room < 0:
                    break
                keep.insert(0, x)
            held, size = keep, sum(map(_pieces, keep))
        held.append(s)
        size += n
    if held:
        out.append(" ".join(held))
    return out


CHUNKS_DDL = "id string, chunk_id string, parent_id string, chunk_type string, chunk_index int, child_index int, section_title string, text string"


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            base = f"{r.ticker}_{r.date}_{str(uuid.uuid5(uuid.NAMESPACE_DNS, f'{r.ticker}:{r.date}'))[:8]}"
            for i, p in enumerate(pack_parents([(x["title"], x["body"]) for x in r.parts])):
                head = f"[Context: {r.ticker} | {r.doc_type} | {r.date}" + (f" | Section: {p['title']}" if p["title"] not in ("", "Financial Table") else "") + "]\n\n"
                pid = f"{base}_{i}" + ("_tbl" if p["kind"] == "table" else "")
                rows.append((r.id, pid, None, p["kind"], i, None, p["title"], (head + p["body"]).strip()))
                kids = [p["body"]] if p["kind"] == "table" else pack_children(p["body"])
                rows += [(r.id, f"{pid}_c{j}", pid, "child", i, j, p["title"], (head + k).strip()) for j, k in enumerate(kids)]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNKS_DDL.split(", ")]).astype({"chunk_index": "Int32", "child_index": "Int32"})


def build_chunks(docs: DataFrame) -> DataFrame:
    """Parents, tables and children of documents (id, ticker, date, doc_type, text)."""
    parts = sections(docs).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "title", "body"))).alias("parts"))
    return docs.select("id", "ticker", "date", "doc_type").join(parts, "id").mapInPandas(_chunks, CHUNKS_DDL)
