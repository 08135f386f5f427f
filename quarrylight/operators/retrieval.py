"""Lexical and vector retrieval, fusion, reranking and parent lookup as joins and aggregates.

Frames: corpus (id, text, ...), questions (qid, question), ranked (qid, id, rank, score, ...).
Null texts have no terms; null questions match nothing; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylight.functions.text import words
from quarrylight.session import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def postings(corpus: DataFrame, keep: Column | None = None) -> DataFrame:
    """(term, id, tf, dl, kept), partitioned by id: what is grouped by id and more needs no further shuffle."""
    flag = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    # the terms are a column of their own below the explode, or they would be split again for each of them
    each = corpus.select("id", flag.alias("kept"), words(F.col("text")).alias("ts")).select("id", "kept", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    # a stated number, or the small postings are coalesced to a task or two that then do all the scoring
    parts = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), corpus.sparkSession.sparkContext.defaultParallelism)
    return each.repartition(parts, "id").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("kept").alias("kept"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: number of texts and their mean length, over the whole corpus whatever is filtered later."""
    return corpus.agg(F.count("*").alias("n"), F.avg(F.size(words(F.col("text")))).alias("avgdl"))


def idf(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """Inverse document frequency with a floor for terms in more than half of the texts."""
    df = posts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    raw = df.select("term", "df", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    return raw.crossJoin(F.broadcast(floor)).select("term", "df", "avgdl", F.when(F.col("raw") >= 0, F.col("raw")).otherwise(F.col("floor")).alias("idf"))


#: Weighted question terms that are broadcast at once; further ones are answered in further blocks.
TERM_BLOCK = 200_000


def bm25(questions: DataFrame, corpus: DataFrame, keep: Column | None = None) -> DataFrame:
    """(qid, id, score) of texts that share a term with the question; ``keep`` filters after scoring statistics.

    The terms of a block of questions are broadcast past the postings, which stay
    partitioned by id, so the scores add up without a shuffle.
    """
    posts = postings(corpus, keep)
    asked = questions.select("qid", F.explode(words(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("m"))
    blocks = max(1, -(-asked.count() // TERM_BLOCK))
    weighted = asked.join(idf(posts, corpus_stats(corpus)), "term").select("qid", "term", "m", "idf", "avgdl")
    wanted = posts.where("kept")
    tf = F.col("tf")
    part = F.col("m") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = []
    for i in range(blocks):
        block = weighted if blocks == 1 else weighted.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        out.append(wanted.join(F.broadcast(block), "term").groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score")))
    return reduce(DataFrame.unionByName, out)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each question, ranked from 1 (the planner limits each window group early)."""
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def normalize(v: Column) -> Column:
    """Unit length in double precision; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


#: The most query vectors that go to every task at once; further ones are answered in further blocks.
QUERY_BLOCK = 32_768
#: Cells of the table of vectors by queries that a task fills at once.
CELLS = 4_000_000
#: Scores are rounded to six places: what lies so near the k-th best may tie with it.
NEAR = 2e-6
#: More than single precision is wrong by in a product of unit vectors.
SINGLE = 1e-4


def dense(queries: DataFrame, vectors: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """Exact cosine top-k of a stated query set against all rows, in blocks of queries.

    ``queries``: (qid, q); ``vectors``: (id, v).  The unit vectors of a block, of counted
    size, go to every task; the vectors stream past them in Arrow batches, one matrix
    product each, of which the best k a query leave the task.  Null, empty, zero and
    not finite vectors, and vectors of another length than the query's, have no score.
    """
    rows = (vectors if keep is None else vectors.where(keep)).select("id", "v")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    if blocks > 1:  # each block reads both again
        queries, rows = cut(queries), cut(rows)
    shape = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("s", T.DoubleType())])
    parts = []
    for i in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        asked = block.select("qid", "q").toArrow()
        if asked.num_rows:
            scored = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(_product(asked, k), shape).select("qid", "id", F.round("s", 6).alias("score"))
            parts.append(top_k(scored, k))
    if not parts:
        return top_k(rows.sparkSession.createDataFrame([], shape).select("qid", "id", F.col("s").alias("score")), k)
    return reduce(DataFrame.unionByName, parts)


def _units(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the lists of this size that have a direction."""
    there = pc.fill_null(pc.equal(pc.list_value_length(lists), size), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(there)
    flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(at), size)
    norm = np.sqrt((flat * flat).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], flat[good] / norm[good, None]


def _product(asked: pa.Table, k: int):
    qids, lists = asked["qid"].combine_chunks(), asked["q"].combine_chunks()
    sizes = sorted({n for n in pc.list_value_length(lists).to_pylist() if n})
    sides = [(n, *_units(lists, n)) for n in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task keeps the best k a query of all its rows; single precision only sorts out what is far from them
        least = [np.full(len(of), -np.inf) for _, of, _ in sides]
        held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in sides]
        ids: list[pa.Array] = []
        base = 0
        singles = [q.T.astype("float32") for _, _, q in sides]
        for whole in batches:
            for no, (size, of, q) in enumerate(sides):
                if not len(of):
                    continue
                places, v = _units(whole["v"], size)
                step = max(k, CELLS // len(of), 1)
                for at in range(0, len(v), step):
                    part = v[at : at + step]
                    if len(part) >= k and not np.isfinite(least[no]).all():
                        s = part @ q.T
                        least[no] = np.maximum(least[no], np.partition(s, len(part) - k, axis=0)[len(part) - k])
                    near = part.astype("float32") @ singles[no] >= (least[no] - NEAR - SINGLE).astype("float32")
                    r, c = np.nonzero(near)
                    for b in range(0, len(r), CELLS):
                        x, y = r[b : b + CELLS], c[b : b + CELLS]
                        held[no].append((y.astype("int32"), places[at + x] + base, np.einsum("ij,ij->i", part[x], q[y])))
                if sum(len(h[0]) for h in held[no]) > max(CELLS, 2 * k * len(of)):
                    held[no] = [_best_of(held[no], k, least[no])]
            ids.append(whole["id"])
            base += whole.num_rows
            if base > CELLS:  # the ids that are no longer held go
                used = np.unique(np.concatenate([np.zeros(0, "int64"), *[i for h in held for _, i, _ in h]]))
                ids, base = [pa.chunked_array(ids).combine_chunks().take(pa.array(used))], len(used)
                held = [[(j, np.searchsorted(used, i), s) for j, i, s in h] for h in held]
        every = pa.chunked_array(ids).combine_chunks() if ids else None
        for no, (_, of, _) in enumerate(sides):
            if held[no]:
                j, i, s = _best_of(held[no], k, least[no])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(of[j])), every.take(pa.array(i)), pa.array(s)], names=["qid", "id", "s"])

    return run


def _best_of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the best k and what may tie with the last of them; raises ``least``, what the k-th best has at least."""
    j, i, s = map(np.concatenate, zip(*parts))
    order = np.lexsort((-s, j))
    j, i, s = j[order], i[order], s[order]
    start = np.flatnonzero(np.diff(j, prepend=-1))
    size = np.diff(start, append=len(j))
    full = size >= k
    last = np.where(full, s[np.minimum(start + k - 1, max(0, len(s) - 1))], -np.inf)
    least[j[start]] = np.maximum(least[j[start]], last)
    kept = s >= np.repeat(last, size) - NEAR
    return j[kept], i[kept], s[kept]


def fuse(lists: list[tuple[str, DataFrame]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; a list's name is its source, two names make 'both'."""
    parts = [df.select("qid", "id", F.lit(src).alias("src"), F.col("rank"), (F.lit(i * 1_000_000) + F.col("rank")).alias("seen")) for i, (src, df) in enumerate(lists)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("qid", "id").agg(
        F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 6).alias("rrf_score"),
        F.when(F.min("src") == F.max("src"), F.min("src")).otherwise("both").alias("source"),
        F.min("seen").alias("first_seen"),
    )


def best_fused(fused: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), "first_seen", "id")
    return fused.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def metadata_filter(**wanted: object) -> Column:
    """Conjunction of equalities on the fields that are set; Parquet takes it as pushed filters."""
    conds = [F.col(c) == v for c, v in wanted.items() if v]
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def rerank_lexical(candidates: DataFrame, k: int) -> DataFrame:
    """Default reranker: share of the question's distinct terms that the text holds."""
    q, t = F.array_distinct(words(F.col("question"))), F.array_distinct(words(F.col("text")))
    cover = F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))
    return top_k(candidates.withColumn("score", F.round(F.coalesce(cover, F.col("rrf_score")), 6)), k)


def with_parents(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Left join of the (few) results with the texts of their parents; a missing parent leaves the child's text."""
    parents = chunks.groupBy(F.col("chunk_id").alias("parent_id")).agg(F.max_by("text", F.struct("ingested_at", "text")).alias("p_text"))
    return results.join(parents, "parent_id", "left").withColumn("parent_text", F.coalesce("p_text", "text")).drop("p_text")


def hashed_vectors(corpus: DataFrame, size: int = 64) -> DataFrame:
    """(id, v): default embedder: counts of terms in hashed buckets, unit length; no terms give zeros."""
    terms = words(F.col("text"))
    return vectors_of_terms(corpus.select("id", terms.alias("terms")).withColumn("tfs", F.transform("terms", lambda t: F.lit(1))), size)


def vectors_of_terms(texts: DataFrame, size: int = 64) -> DataFrame:
    """The same of texts that are already split into ``terms`` and their counts ``tfs``; row by row, without a shuffle."""
    cells = F.zip_with("terms", "tfs", lambda t, n: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).alias("b"), n.alias("n")))
    each = texts.select("id", cells.alias("cells"))
    total = lambda b: F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.when(c["b"] == b, c["n"]).otherwise(0))
    return each.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), total).alias("m")).select("id", normalize(F.col("m")).alias("v"))
