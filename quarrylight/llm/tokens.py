"""Encoding of texts with a public byte-level BPE vocabulary.

A segment tree over the byte positions of a piece holds, at each node, the
leftmost least rank of a pair that may merge; a merge changes the leaves of the
pair and of its live neighbours, in logarithmic time, so one endless piece stays
within n log n.  Pieces recur, so each worker keeps what it has encoded, within
a bound.

Defined results: null and empty texts give an empty list; strings of special
tokens are ordinary text; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("QUARRYLIGHT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 200_000
_FAR = 1 << 62


class ByteBpe:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._split = regex.compile(PATTERN).findall
        self._cut = _cutter()
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._known = _Kept(self._encode_word)

    def merge(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        if n < 2:
            return [ranks[piece]] if n else []
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_FAR] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 2)), list(range(-1, n))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
                k >>= 1

        def pair(i: int) -> int:
            j = after[i]
            if j >= n:
                return _FAR
            r = ranks.get(piece[i : after[j]])
            return _FAR if r is None else r * size + i

        while tree[1] < _FAR:
            i = tree[1] % size
            j = after[i]
            after[i] = after[j]
            if after[j] <= n:
                before[after[j]] = i
            if j < n - 1:
                put(j, _FAR)
            put(i, pair(i)) if i < n - 1 else None
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merge(piece.encode("utf-8", "replace")))
        if len(piece) <= 64:
            if len(self._pieces) >= KEPT:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def _encode_word(self, word: str) -> tuple[int, ...]:
        known, out = self._pieces, []
        for p in self._split(word):
            ids = known.get(p)
            out += self._encode_piece(p) if ids is None else ids
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self._known.__getitem__, self._cut(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self._known.__getitem__, self._cut(text)))) if text else 0


@lru_cache(maxsize=1)
def _cutter():
    """A quick first cut of a text, at places where the split pattern always starts a token.

    These are each blank before a non-blank, and the ends of a run of figures that
    no white space precedes, other than one blank of its own.
    """
    figure = regex.compile(r"\p{N}")
    points = [i for i in range(0x10000) if figure.match(chr(i))]
    spans, at = [], 0
    while at < len(points):
        to = at
        while to + 1 < len(points) and points[to + 1] == points[to] + 1:
            to += 1
        spans.append(f"{re.escape(chr(points[at]))}-{re.escape(chr(points[to]))}")
        at = to + 1
    n = "".join(spans)
    # the figures beyond the basic plane would slow the pattern down; texts with such characters are split at once
    far = re.compile("[\U00010000-\U0010ffff]").search
    quick, whole = _quick(n), regex.compile(PATTERN).findall
    return lambda text: whole(text) if far(text) else quick(text)


def _quick(n: str):
    return re.compile(rf" ?[{n}]+|(?: (?=\S))?(?:[^ {n}]+| (?!\S)|(?<=\s)[{n}]+)+").findall


class _Kept(dict):
    """What was encoded before; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self._make(word)
        if len(word) <= 40:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def _shipped(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary along with the tasks, so that a worker needs no copy of its own; gives its name there."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _there(name: str, path: str) -> str:
    sent = SparkFiles.get(name)
    return sent if os.path.exists(sent) else path


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    name = _shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(_there(name, path))
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                if text:
                    ids.extend(bpe.encode(text))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def _counts(name: str, path: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(_there(name, path))
        for texts in batches:
            yield pd.Series([bpe.count(t) for t in texts], dtype="int64")

    return run


def count_tokens(documents: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """The columns ``keep`` and n_tokens of every row."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)

    n_tokens = F.pandas_udf(_counts(_shipped(documents.sparkSession, path), path), T.LongType())
    return documents.select(*keep, F.coalesce(n_tokens("text"), F.lit(0)).alias("n_tokens"))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); null ids give a null text, bytes that are no UTF-8 the replacement mark."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    name = _shipped(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: b for b, i in encoder(_there(name, path)).ranks.items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(bytes_of.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
