"""Text statistics of documents, and the type of text they tell.

Thresholds on the statistics are noisy labelling functions: each votes for one
type of text or says nothing.  How reliable each is for each type is learned by
expectation-maximization from how the functions agree over all documents, and a
document gets the type with the largest posterior.  Only counts of vote patterns
reach the driver: there are at most 2 ** len(FUNCTIONS) of them, whatever the
corpus, and in practice a few hundred.

Defined results: null, empty and blank texts have zero words, null ratios and no
type; ties go to the earlier of prose, list, table, junk; copies get equal rows;
an empty table gives none; a doc_id that occurs twice gives two rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.session import cut

TYPES = ("prose", "list", "table", "junk")
#: The most rows of common_words that are read to the driver.
MOST_WORDS = 50_000

_LETTERS = re.compile(r"[^\W\d_]+")
_MARKER = re.compile(r"\s*(?:[-*+•▪◦·‣–—>]+|\(?(?:\d{1,4}|[A-Za-z]|[ivxlcIVXLC]{1,6})[.)])\s+")
#: A cell that holds a figure, a period or a mark for none.
_CELL = re.compile(r"\(?[-−+$€£]?\d[\d.,' ]*\)?\s?%?|[QqHh][1-4] \d{4}|\d{4}|n/[ma]|[-–—]")
_TAG = re.compile(r"</?(?:table|t[rdh]|tbody|thead)\b", re.I)
_TAGS = re.compile(r"<[^<>]+>")
_CODE = re.compile(r"function\s*\(|\breturn\b.*;|=>|\bvar\s+\w+\s*=|\bimport\s+\w+;|[{}];?\s*$|</?(?:div|span|script)|\);\s*$")
_GARBLED = "�□■Ã©¢â€Â¤¦¬"
_VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ")
#: Marks that end a line, and what may close after them.
_ENDS, _CLOSING = frozenset(".!?…:;"), "\"'”’»)]"
_STOP = re.compile(r"[.!?][\"'”’»)\]]*(?:\s+|$)")
_INLINE = re.compile(r" [|•·/–—] |[,;] |  +")
_RUN = re.compile(r"(\S)\1{19,}")

# Each function: its name, the type it votes for, how it is read off the measures.
FUNCTIONS: tuple[tuple[str, str, object], ...] = (
    ("common_words", "prose", lambda m: m["common"] >= 0.14 and m["words"] >= 5),
    ("in_sentences", "prose", lambda m: m["sentence_chars"] >= 0.5 and m["garbled"] < 0.06 and m["symbols"] < 0.5 and m["tiny"] < 0.7),
    ("long_lines", "prose", lambda m: m["prose_chars"] >= 0.5 and m["garbled"] < 0.06 and m["inline"] < 0.6),
    ("marked_items", "list", lambda m: m["marked_chars"] >= 0.5),
    ("short_lines", "list", lambda m: m["short_chars"] >= 0.6 and m["lines"] >= 3 and m["code_lines"] < 0.5 and m["figures"] < 0.6 and m["tiny"] < 0.7),
    ("inline_items", "list", lambda m: m["inline"] >= 0.6 and m["tiny"] < 0.7),
    ("leaders", "list", lambda m: m["leader_lines"] >= 0.5 and m["code_lines"] < 0.5 and m["run_chars"] < 0.9),
    ("cell_lines", "table", lambda m: m["cell_lines"] >= 0.5),
    ("even_cells", "table", lambda m: m["even_cells"] >= 0.6),
    ("table_tags", "table", lambda m: m["tag_lines"] >= 0.4),
    ("figure_cells", "table", lambda m: m["figure_cells"] >= 0.4 and m["cell_lines"] >= 0.3),
    ("symbols", "junk", lambda m: m["symbols"] >= 0.5 and m["cell_lines"] < 0.3),
    ("one_word", "junk", lambda m: m["same_word"] >= 0.5 and m["words"] >= 6),
    ("repeated_text", "junk", lambda m: m["distinct"] <= 0.08 and m["words"] >= 30),
    ("no_vowels", "junk", lambda m: m["no_vowel"] >= 0.5),
    ("tiny_words", "junk", lambda m: m["tiny"] >= 0.7),
    ("long_tokens", "junk", lambda m: m["long_chars"] >= 0.5 and m["cell_lines"] < 0.3),
    ("garbled", "junk", lambda m: m["garbled"] >= 0.06),
    ("code", "junk", lambda m: m["code_lines"] >= 0.5),
    ("figures_only", "junk", lambda m: m["figures"] >= 0.6),
    ("runs", "junk", lambda m: m["run_chars"] >= 0.5),
)


def _cells(line: str) -> list[str]:
    """The cells of a line in any of the usual layouts."""
    for mark in ("\t", "|", '","', ";"):
        if mark in line:
            return line.strip('|"').split(mark)
    return [c for c in line.split("   ") if c and not c.isspace()] if "   " in line else [line]


def statistics(text: str, common: frozenset[str]) -> dict:
    """The reported figures: words, mean word length, shares of symbols, of ended lines, of common words."""
    words = text.split()
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = _LETTERS.findall(text.lower())
    digits = sum(map(text.count, "0123456789"))
    return {
        "words": len(words),
        "mean_word": chars / len(words) if words else 0.0,
        "symbols": max(0.0, 1 - (sum(map(len, letters)) + digits) / chars) if chars else 0.0,
        "ended": sum(1 for x in lines if x.rstrip().rstrip(_CLOSING)[-1:] in _ENDS) / len(lines) if lines else 0.0,
        "common": sum(map(common.__contains__, letters)) / len(letters) if letters else 0.0,
        "split": (words, lines, letters, chars, digits),
    }


def measures(text: str, common: frozenset[str]) -> dict:
    m = statistics(text, common)
    words, lines, letters, chars, digits = m.pop("split")
    chars, n, nl = chars or 1, len(words) or 1, len(lines) or 1
    size = sum(map(len, lines)) or 1
    varied = len(set(lines)) >= 0.2 * nl
    prose = marked = short = leader = tags = cells = code = n_cells = n_figures = 0
    widths: dict[int, int] = {}
    for x in lines:
        w = x.count(" ") + 1
        is_row = False
        if "\t" in x or "|" in x or ";" in x or '","' in x or "   " in x or "<" in x or x.startswith(("+-", "---", "===")):
            tagged = "<" in x and bool(_TAG.search(x))
            row = [c for c in _TAGS.sub("\t", x).split("\t") if c and not c.isspace()] if tagged else _cells(x)
            ruled = len(x) >= 3 and not x.strip("+-=|: \t") and ("|" in x or "+" in x)
            filled = [c for c in (c.strip(' "') for c in row) if c]
            figures = sum(1 for c in filled if _CELL.fullmatch(c))
            # a row of a table has several cells, of which some hold no phrase
            is_row = ruled or tagged or (len(row) >= 2 and figures >= 1 and figures >= 0.3 * len(filled))
            tags += tagged
            if is_row:
                cells += 1
                if not ruled and filled:
                    widths[len(row)] = widths.get(len(row), 0) + 1
                    n_cells += len(filled)
                    n_figures += figures
        if "..." in x or ". . ." in x or "…" in x or "____" in x:
            leader += len(x) > 8 and bool(x.strip("._ …-"))
        if (";" in x or "{" in x or "}" in x or "<" in x) and _CODE.search(x):
            code += 1
        if is_row:
            continue
        ended = x.rstrip()[-1] in ".!?:;\"”»)]…"
        if w >= 7 and (ended or w >= 9):
            prose += len(x) if not common.isdisjoint(x.lower().split()) else 0
        elif varied and _MARKER.match(x):
            marked += len(x)
            short += len(x)
        elif varied and w <= 8 and not (ended and w >= 4):
            short += len(x)
    stops = _STOP.split(text)
    sentence = sum(len(s) for s in stops[:-1] if s.count(" ") >= 4)
    inline = 0.0
    if len(stops) <= 2 + n / 25:
        parts = [p for p in _INLINE.split(text.replace("\n", " ")) if p]
        if len(parts) >= 5 and nl <= max(3, len(parts) / 4) and len(set(parts)) >= 0.1 * len(parts):
            inline = sum(1 for p in parts if p.count(" ") <= 5) / len(parts)
    counts: dict[str, int] = {}
    for w in letters:
        counts[w] = counts.get(w, 0) + 1
    m |= {
        "lines": len(lines),
        "sentence_chars": sentence / size,
        "prose_chars": prose / size,
        "marked_chars": marked / size,
        "short_chars": short / size,
        "inline": inline,
        "leader_lines": leader / nl,
        "cell_lines": cells / nl,
        "even_cells": max(widths.values(), default=0) / nl if max(widths, default=0) >= 2 and n_figures else 0.0,
        "tag_lines": tags / nl,
        "figure_cells": n_figures / n_cells if n_cells else 0.0,
        "same_word": max(counts.values(), default=0) / (len(letters) or 1),
        "distinct": len(set(words)) / n,
        "no_vowel": sum(1 * k for w, k in counts.items() if len(w) >= 3 and _VOWELS.isdisjoint(w)) / (sum(k for w, k in counts.items() if len(w) >= 3) or 1),
        "tiny": sum(1 for w in words if len(w) <= 2) / n,
        "long_chars": sum(len(w) for w in words if len(w) >= 40) / chars,
        "garbled": (sum(map(text.count, _GARBLED)) + 4 * (text.count("\\u") + text.count("\\x") + text.count("&#")) + 2 * text.count("%2") + 2 * text.count("%C")) / chars,
        "code_lines": code / nl,
        "run_chars": sum(len(r.group()) for r in _RUN.finditer(text)) / chars if m["mean_word"] >= 10 else 0.0,
        "figures": digits / chars if len(letters) <= 0.1 * n else 0.0,
    }
    return m


def votes(m: dict) -> int:
    bits = 0
    for k, (_, _, rule) in enumerate(FUNCTIONS):
        if rule(m):
            bits |= 1 << k
    return bits


_DDL = "doc_id bigint, n_words bigint, mean_word_length double, symbol_share double, ended_line_share double, common_word_share double, votes bigint"


def _stats(common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                if text is None or not text.strip():
                    row = (0, None, None, None, None, None)
                else:
                    m = measures(text, common)
                    row = (m["words"], m["mean_word"], m["symbols"], m["ended"], m["common"], votes(m))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), *[pa.float64()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in _DDL.split(", ")])

    return run


def learn(patterns: dict[int, int], rounds: int = 60) -> dict[int, tuple[float, ...]]:
    """Posterior of the types for each vote pattern, by expectation-maximization.

    A function fires in its own type with a probability that starts at a half, in
    the others with one that starts low; the counts are smoothed by a prior in
    favour of that, so that a type keeps its meaning where data are few.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    fired = np.array([[k >> j & 1 for j in range(len(FUNCTIONS))] for k in keys], float)
    own = np.array([[t == kind for t in TYPES] for _, kind, _ in FUNCTIONS], float)  # function x type
    prior_p = np.where(own > 0, 0.5, 0.01)
    strength = 0.02 * n.sum() + 4
    p, share = prior_p.copy(), np.array([0.7, 0.1, 0.1, 0.1])
    for _ in range(rounds):
        log = fired @ np.log(p) + (1 - fired) @ np.log1p(-p) + np.log(share)
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        weight = post * n[:, None]
        share = (weight.sum(0) + 1) / (n.sum() + len(TYPES))
        p = np.clip((fired.T @ weight + strength * prior_p) / (weight.sum(0) + strength), 1e-4, 1 - 1e-4)
    return {k: tuple(float(x) for x in row) for k, row in zip(keys, post, strict=True)}


def typed(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """The figures of every document with its type and the posterior of it."""
    spark = documents.sparkSession
    words = [r[0] for r in common_words.where(F.col("word").isNotNull()).select(F.lower("word")).distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    stats = cut(documents.select("doc_id", "text").mapInArrow(_stats(frozenset(words)), _DDL))
    counted = stats.where(F.col("votes").isNotNull()).groupBy("votes").count().collect()
    posterior = learn({r["votes"]: r["count"] for r in counted})
    schema = T.StructType([T.StructField("votes", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("posterior", T.DoubleType())])
    best = [(k, TYPES[max(range(len(TYPES)), key=lambda i: p[i])], max(p)) for k, p in posterior.items()]
    return stats.join(F.broadcast(spark.createDataFrame(best, schema)), "votes", "left").select(
        "doc_id", "n_words", "mean_word_length", "symbol_share", "ended_line_share", "common_word_share", "kind", "posterior"
    )


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    return typed(documents, common_words).where(F.col("kind") != "prose").select("doc_id", "kind")
