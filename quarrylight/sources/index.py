"""A lexical index as tables: written once, read by the buckets of the terms that are asked.

An index is a folder of segments and a manifest.  A segment holds ``texts``
(id, dl, terms and counts of each text, payload columns), ``postings`` (term, id,
tf, dl, payload, by bucket of the term's hash, sorted by term) and ``terms`` (df and
the bounds of tf and dl of each term, by bucket).  The manifest names the segments
that count and the corpus statistics; it is written last, so a crash leaves an
unnamed segment and no wrong result.

A search tokenises the questions only.  There are three ways to the same rows:
few postings are scored at once; for few questions of frequent words the terms
of a question are taken by falling bound until the remaining ones together
cannot lift a text into the best k, and only texts that hold one of the former
are completed; many questions are scored in tasks over the texts, of which each
keeps its best k a question: what the common terms give is summed once for all
questions that share them, and the rare terms are added to the texts that hold them.

Defined results: null and empty texts have no postings but count as texts;
a null id is an id like any other; a text whose id is written again replaces the
former one; within one write the longest, then greatest text of an id stays;
null questions match nothing; an empty index answers nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylight.functions.text import words
from quarrylight.operators.retrieval import B, EPSILON, K1, TERM_BLOCK, top_k
from quarrylight.session import cut, delete, exists, read_small, write_small

#: Changes when the tables do, so that an index of another make is not read.
FORMAT = 1
#: Folders of postings and of terms; what a search lists and prunes by.
BUCKETS = 32
#: Up to so many pairs of posting and question term are scored at once, without pruning.
AT_ONCE = 2_000_000
#: Up to so many questions are scored with pruning by bounds, more of them text by text.
FEW = 16
#: Terms of texts that a task of the latter holds at once.
CELLS = 4_000_000
#: Weighted question terms that such a task gets at once; further ones are answered in further passes over the texts.
TEXT_BLOCK = 1_000_000
#: A term that more than one in so many of the texts at hand has is added up for all of them.
COMMON = 16
#: Texts a question looks at before it knows its bound, as a multiple of k.
PROBES = 50
#: Of those, so many times k are completed: the k-th best of them is the bound.
DEPTH = 3
#: Up to so many asked terms are pushed into the scan by name.
PUSHED = 64
#: Scores are rounded to six places, so a bound must be missed by more than this.
SLACK = 2e-6


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def factor(tf: Column, dl: Column, avgdl: float) -> Column:
    """What a posting contributes for one of its idf; grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


@dataclass(frozen=True)
class LexicalIndex:
    """A stored index; ``LexicalIndex.create`` makes one, ``upsert`` adds to it."""

    spark: SparkSession
    path: str

    # ---- writing ----

    @classmethod
    def create(cls, corpus: DataFrame, path: str, payload: tuple[str, ...] = ()) -> LexicalIndex:
        """A new index of (id, text, payload columns); an index at that path is replaced."""
        index = cls(corpus.sparkSession, path)
        delete(index.spark, path)
        index._publish([index._segment(corpus, payload)], payload)
        return index

    def exists(self) -> bool:
        return exists(self.spark, os.path.join(self.path, "manifest.json"))

    def manifest(self) -> dict:
        if not self.exists():
            raise FileNotFoundError(f"no index at {self.path}")
        return json.loads(read_small(self.spark, os.path.join(self.path, "manifest.json")))

    def upsert(self, corpus: DataFrame) -> LexicalIndex:
        """Add texts; segments that hold one of their ids are written again without it."""
        old = self.manifest()
        payload = tuple(old["payload"])
        new = self._segment(corpus, payload)
        ids = self._read("texts", [new]).select("id").distinct()
        kept = []
        for s in old["segments"]:
            held = self._read("texts", [s])
            if held.join(ids, held["id"].eqNullSafe(ids["id"]), "left_semi").limit(1).count():
                kept.append(self._without(s, ids, payload))
            else:
                kept.append(s)
        self._publish([*kept, new], payload)
        for s in set(old["segments"]) - set(kept):
            delete(self.spark, os.path.join(self.path, s))
        return self

    def _segment(self, corpus: DataFrame, payload: tuple[str, ...]) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        at = os.path.join(self.path, name)
        one = corpus.groupBy("id").agg(F.max_by(F.struct("text", *payload), F.struct(F.coalesce(F.length("text"), F.lit(-1)), "text")).alias("r")).select("id", "r.*")
        sorted_ = one.select("id", *payload, F.array_sort(words(F.col("text"))).alias("ts"))
        # the counts of a text are runs of its sorted terms: no shuffle
        n = F.size("ts")
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 1) | (F.element_at("ts", i) != F.element_at("ts", F.greatest(i - 1, F.lit(1)))))
        runs = sorted_.select("id", *payload, n.alias("dl"), "ts", starts.alias("at"))
        ends = lambda j: F.coalesce(F.try_element_at("at", j + 2), F.col("dl") + 1)
        texts = runs.select("id", *payload, "dl", F.transform("at", lambda i: F.element_at("ts", i)).alias("terms"), F.transform("at", lambda i, j: ends(j) - i).alias("tfs"))
        texts.write.parquet(os.path.join(at, "texts"))
        self._write_postings(at, payload)
        return name

    def _write_postings(self, at: str, payload: tuple[str, ...]) -> None:
        where = os.path.join(at, "postings")
        each = self.spark.read.parquet(os.path.join(at, "texts")).select("id", "dl", *payload, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
        # rebalanced, so that the bucket of a term that is everywhere is split between tasks
        placed = each.withColumn("bucket", bucket(F.col("term"))).hint("rebalance", "bucket")
        placed.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(where)
        if exists(self.spark, where, "bucket="):
            terms = self.spark.read.parquet(where).groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))
            terms.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(os.path.join(at, "terms"))

    def _without(self, segment: str, ids: DataFrame, payload: tuple[str, ...]) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        at = os.path.join(self.path, name)
        held = self._read("texts", [segment])
        held.join(ids, held["id"].eqNullSafe(ids["id"]), "left_anti").write.parquet(os.path.join(at, "texts"))
        self._write_postings(at, payload)
        return name

    def _publish(self, segments: list[str], payload: tuple[str, ...]) -> None:
        s = self._read("texts", segments).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        about = {"segments": segments, "payload": list(payload), "n": s["n"], "avgdl": s["avgdl"] or 0.0}
        mean = self._vocabulary(segments, about["n"]).agg(F.avg("raw")).first()[0]
        about["floor"] = (mean or 0.0) * EPSILON
        write_small(self.spark, os.path.join(self.path, "manifest.json"), json.dumps(about))

    # ---- reading ----

    def _read(self, table: str, segments: list[str]) -> DataFrame:
        # a segment without terms has no buckets and no schema: it is left out
        paths = [p for p in (os.path.join(self.path, s, table) for s in segments) if table == "texts" or exists(self.spark, p, "bucket=")]
        if not paths:
            fields = {"postings": "term string, id string, tf int, dl int, bucket int", "terms": "term string, df bigint, tf bigint, most_tf int, least_dl int, bucket int", "texts": "id string, dl int, terms array<string>, tfs array<int>"}
            return self.spark.createDataFrame([], fields[table])
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in paths])

    def _vocabulary(self, segments: list[str], n: int, only: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """(term, df, tf, most_tf, least_dl, raw) of all terms or of those asked for."""
        t = self._read("terms", segments)
        if buckets is not None:
            t = t.where(F.col("bucket").isin(buckets))
        if only is not None:
            t = t.join(only, "term", "left_semi")
        if len(segments) > 1:
            t = t.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl"))
        return t.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))

    def terms(self) -> DataFrame:
        """(term, df, tf, idf) of every term, with a floor for terms in more than half of the texts."""
        m = self.manifest()
        return self._vocabulary(m["segments"], m["n"]).select("term", "df", "tf", self._idf(m).alias("idf"))

    def texts(self) -> DataFrame:
        """(id, dl, terms, tfs, payload) of every text."""
        return self._read("texts", self.manifest()["segments"])

    @staticmethod
    def _idf(m: dict) -> Column:
        return F.when(F.col("raw") >= 0, F.col("raw")).otherwise(F.lit(m["floor"]))

    # ---- searching ----

    def search(self, questions: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
        """(qid, id, score, rank): the k best texts of each question; ``keep`` is a condition on payload columns.

        Corpus statistics are those of the whole index whatever ``keep`` says.  Questions
        are answered in blocks of at most ``TERM_BLOCK`` weighted terms, counted before,
        or ``TEXT_BLOCK`` where many are scored over the texts.
        """
        m = self.manifest()
        asked = cut(questions.select("qid", F.explode(words(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("m")))
        return reduce(DataFrame.unionByName, [self._search(part, rows, m, k, keep) for part, rows in _blocks(asked)])

    def _search(self, asked: DataFrame, rows: int, m: dict, k: int, keep: Column | None) -> DataFrame:
        side = F.broadcast if rows <= TERM_BLOCK else lambda df: df
        only = asked.select("term").distinct()
        some = only.select("term", bucket(F.col("term")).alias("b")).limit(PUSHED + 1).collect()
        # the terms themselves only if they are few, of the buckets BUCKETS at most
        buckets = sorted({r["b"] for r in (some if len(some) <= PUSHED else only.select(bucket(F.col("term")).alias("b")).distinct().collect())})
        names = [r["term"] for r in some]
        weights = asked.join(self._vocabulary(m["segments"], m["n"], only, buckets), "term")
        w = F.col("m") * self._idf(m)
        weights = weights.select("qid", "term", "df", w.alias("w"), (w * factor(F.col("most_tf"), F.col("least_dl"), m["avgdl"] or 1.0)).alias("most"))
        weights = cut(weights)
        size = weights.agg(F.sum("df").alias("rows"), F.min("w").alias("least"), F.approx_count_distinct("qid").alias("questions")).first()
        posts = self._read("postings", m["segments"]).where(F.col("bucket").isin(buckets))
        if 0 < len(names) <= PUSHED:
            posts = posts.where(F.col("term").isin(names))
        if keep is not None:
            posts = posts.where(keep)
        part = F.col("w") * factor(F.col("tf"), F.col("dl"), m["avgdl"] or 1.0)
        # sums only grow, and bounds only hold, where every weight is above zero
        if (size["rows"] or 0) <= AT_ONCE or size["least"] <= 0:
            scored = posts.join(side(weights), "term").groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))
            return top_k(scored, k)
        if rows <= max(TERM_BLOCK, TEXT_BLOCK) and size["questions"] > FEW:
            texts = self._read("texts", m["segments"])
            return self._by_text(texts if keep is None else texts.where(keep), weights, m["avgdl"], k)
        return self._pruned(posts, weights, part, k, side)

    def _by_text(self, texts: DataFrame, weights: DataFrame, avgdl: float, k: int) -> DataFrame:
        """Every text against all questions of a block, whose weights go to each task: ``TEXT_BLOCK`` rows at most."""
        rows = weights.select("qid", "term", "w").toArrow()
        shape = T.StructType([T.StructField("qid", weights.schema["qid"].dataType), T.StructField("id", texts.schema["id"].dataType), T.StructField("s", T.DoubleType())])
        # a task gives k rows a question however many texts it has: no more tasks than run at once
        some = texts.select("id", "dl", "terms", "tfs").coalesce(self.spark.sparkContext.defaultParallelism)
        scored = some.mapInArrow(_scorer(rows, avgdl, k), shape)
        return top_k(scored.select("qid", "id", F.round("s", 6).alias("score")), k)

    def _pruned(self, posts: DataFrame, weights: DataFrame, part: Column, k: int, side) -> DataFrame:
        by_bound = Window.partitionBy("qid").orderBy(F.desc("most"), "term")
        # reach: what a text can score by this term and those after it
        ranked = cut(
            weights.withColumn("before", F.coalesce(F.sum("df").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("reach", F.sum("most").over(by_bound.rowsBetween(0, Window.unboundedFollowing)))
        )
        probes, unseen = ranked.where(F.col("before") < PROBES * k), ranked.where(F.col("before") >= PROBES * k)
        hopeful = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "id"))
        probed = posts.join(side(probes), "term").groupBy("qid", "id").agg(F.sum(part).alias("s")).withColumn("r", hopeful).where(F.col("r") <= DEPTH * k)
        bound = _kth(_completed(cut(probed.select("qid", "id", "s")), unseen, posts, part, side), k)
        split = cut(ranked.join(bound, "qid", "left").select("qid", "term", "w", "reach", F.coalesce("bound", F.lit(0.0)).alias("bound")))
        needed, other = split.where(F.col("reach") >= F.col("bound")), split.where(F.col("reach") < F.col("bound"))
        rest = other.groupBy("qid").agg(F.max("reach").alias("rest"), F.max("bound").alias("bound"))
        found = posts.join(side(needed), "term").groupBy("qid", "id").agg(F.sum(part).alias("s"))
        likely = cut(found.join(side(rest), "qid", "left").where(F.coalesce(F.col("s") + F.col("rest") >= F.col("bound"), F.lit(True))).select("qid", "id", "s"))
        scored = _completed(likely, other, posts, part, side)
        return top_k(scored.select("qid", "id", F.round("s", 6).alias("score")), k)


def _completed(sums: DataFrame, terms: DataFrame, posts: DataFrame, part: Column, side) -> DataFrame:
    """(qid, id, s): sums with what ``terms`` of the same question add to them."""
    asked = sums.select("qid", "id").join(side(terms.select("qid", "term", "w")), "qid")
    more = asked.join(posts.select("term", "id", "tf", "dl"), ["term", "id"]).groupBy("qid", "id").agg(F.sum(part).alias("t"))
    return sums.join(more, ["qid", "id"], "left").select("qid", "id", (F.col("s") + F.coalesce("t", F.lit(0.0))).alias("s"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in tables of some ``CELLS`` terms."""
    held, terms = [], 0
    for whole in batches:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(whole["terms"]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < whole.num_rows:
            before = upto[at - 1] if at else 0
            end = min(whole.num_rows, max(at + 1, int(np.searchsorted(upto, before + CELLS - terms, side="right"))))
            held.append(whole.slice(at, end - at))
            terms += int(upto[end - 1] - before)
            at = end
            if terms >= CELLS or at < whole.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, terms = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _scorer(rows: pa.Table, avgdl: float, k: int):
    """The best k sums a question of all texts of a task, and what ties with them; every weight is above zero.

    A question's sum over a text is what its common terms give, one vector for all
    questions with the same ones, and what its rare terms add at the texts that
    hold them.  Other texts can only be among the best by the common terms alone.
    """
    asked = rows["term"].combine_chunks().dictionary_encode()
    qids = rows["qid"].combine_chunks().dictionary_encode(null_encoding="encode")
    term_no, q_no, w = asked.indices.to_numpy(), qids.indices.to_numpy(), rows["w"].to_numpy()
    order = np.lexsort((term_no, q_no))
    term_no, w = term_no[order].astype("int32"), w[order]
    ends = np.searchsorted(q_no[order], np.arange(len(qids.dictionary) + 1))
    # questions of the same words are one
    alike: dict[bytes, list[int]] = {}
    for q in range(len(qids.dictionary)):
        at = slice(ends[q], ends[q + 1])
        alike.setdefault(term_no[at].tobytes() + w[at].tobytes(), []).append(q)
    members = list(alike.values())
    spans = [(int(ends[m[0]]), int(ends[m[0] + 1])) for m in members]
    names, questions = asked.dictionary, qids.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(len(spans))  # what the k-th best of a question has at least
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids: list[pa.Array] = []
        base = held = 0
        for piece in _pieces(batches):
            who, where, sums = _best(piece, names, term_no, w, spans, avgdl, k, least)
            kept, at = np.unique(where, return_inverse=True)
            ids.append(piece["id"].combine_chunks().take(pa.array(kept)))
            found.append((who, at + base, sums))
            base, held = base + len(kept), held + len(who)
            if held > 2 * CELLS:
                found = [_first(*map(np.concatenate, zip(*found)), k)]
                used, at = np.unique(found[0][1], return_inverse=True)
                ids, base, held = [pa.concat_arrays(ids).take(pa.array(used))], len(used), len(at)
                found = [(found[0][0], at, found[0][2])]
        if not held:
            return
        who, where, sums = _first(*map(np.concatenate, zip(*found)), k)
        every = pa.concat_arrays(ids)
        sizes = np.array([len(m) for m in members])
        flat, firsts = np.concatenate(members), np.cumsum(sizes) - sizes
        step = 100_000
        for i in range(0, len(who), step):
            g, n = who[i : i + step], sizes[who[i : i + step]]
            row = np.repeat(np.arange(len(g)), n)
            q = flat[firsts[g][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
            yield pa.RecordBatch.from_arrays([questions.take(pa.array(q)), every.take(pa.array(where[i : i + step][row])), pa.array(sums[i : i + step][row])], names=["qid", "id", "s"])

    return run


def _first(who: np.ndarray, where: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each question the best k, and what ties with the last of them."""
    order = np.lexsort((-sums, who))
    who, where, sums = who[order], where[order], sums[order]
    start = np.flatnonzero(np.diff(who, prepend=-1))
    size = np.diff(start, append=len(who))
    last = np.repeat(np.where(size > k, sums[np.minimum(start + k - 1, len(who) - 1)], -np.inf), size)
    kept = sums >= last - SLACK
    return who[kept], where[kept], sums[kept]


def _best(piece: pa.Table, names: pa.Array, term_no: np.ndarray, w: np.ndarray, spans: list[tuple[int, int]], avgdl: float, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, place of the text, sum) of what may be among the best k; raises ``least``."""
    lists = piece["terms"].combine_chunks()
    n = piece.num_rows
    no = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(n, dtype="int32"), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    known = no >= 0
    no, text, tf = no[known], text[known], piece["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[known]
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * piece["dl"].to_numpy()[text] / avgdl))
    by_term = np.argsort(no, kind="stable")
    text, gain = text[by_term], gain[by_term]
    first = np.searchsorted(no[by_term], np.arange(len(names) + 1))
    count = np.diff(first)
    posts = [(text[a:b], gain[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    common = (count * COMMON > n)[term_no]
    rare = (count > 0)[term_no] & ~common
    patterns: dict[bytes, list[int]] = {}
    for g, (a, b) in enumerate(spans):
        c = common[a:b]
        patterns.setdefault(term_no[a:b][c].tobytes() + w[a:b][c].tobytes(), []).append(g)
    who, where, sums = [], [], []
    extra, none = np.zeros(n), np.zeros(0, "int32")
    for groups in patterns.values():
        a, b = spans[groups[0]]
        c = common[a:b]
        shared = np.zeros(n)
        for t, weight in zip(term_no[a:b][c].tolist(), w[a:b][c].tolist()):
            shared[posts[t][0]] += posts[t][1] * weight
        by_shared, top = 0.0, none
        if c.any():
            by_shared = np.partition(shared, n - k)[n - k] if n > k else 0.0
            top = np.flatnonzero((shared >= by_shared - SLACK) & (shared > 0)).astype("int32")
        for g in groups:
            a, b = spans[g]
            r = rare[a:b]
            # one place for each text and rare term; a text comes once for each of them, with its whole sum
            at = [(posts[t], weight) for t, weight in zip(term_no[a:b][r].tolist(), w[a:b][r].tolist())]
            for (place, part), weight in at:
                extra[place] += part * weight
            place = np.concatenate([top, *[p[0] for p, _ in at]])
            total = shared[place] + extra[place]
            for (p, _), _ in at:
                extra[p] = 0.0
            kept = total >= max(by_shared, least[g]) - SLACK
            place, once = np.unique(place[kept], return_index=True)
            total = total[kept][once]
            if len(total) >= k:
                last = np.partition(total, len(total) - k)[len(total) - k]
                least[g] = max(least[g], last)
                kept = total >= last - SLACK
                place, total = place[kept], total[kept]
            if len(place):
                who.append(np.full(len(place), g, "int32"))
                where.append(place)
                sums.append(total)
    if not who:
        return none, none, np.zeros(0)
    return np.concatenate(who), np.concatenate(where), np.concatenate(sums)


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(qid, bound): what the k-th best text of a question scores at least; no row if there are fewer."""
    best = sums.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s")))).where(F.col("r") <= k)
    return best.groupBy("qid").agg(F.min("s").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).select("qid", (F.col("s") - SLACK).alias("bound"))


def _blocks(asked: DataFrame) -> list[tuple[DataFrame, int]]:
    """Parts of whole questions, each with its number of rows, as counted."""
    n, most = asked.count(), max(TERM_BLOCK, TEXT_BLOCK)
    if n <= most:
        return [(asked, n)]
    bands = -(-5 * n // (4 * most))
    band = F.pmod(F.xxhash64("qid"), F.lit(bands))
    sizes = {r["b"]: r["count"] for r in asked.groupBy(band.alias("b")).count().collect()}
    return [(asked.where(band == b), size) for b, size in sorted(sizes.items())]
