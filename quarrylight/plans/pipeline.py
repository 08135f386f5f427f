"""Answering batches of questions: the stages of retrieval put together as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators import context, corrective, graph, retrieval
from quarrylight.plans.providers import extract
from quarrylight.session import cut
from quarrylight.sources.index import LexicalIndex


@dataclass(frozen=True)
class Settings:
    """Passed to every plan; nothing reads a module-wide singleton."""

    lexical_k: int = 10
    #: Length of the vector lists; none without it, and then a question that shares no word with a text has no hit.
    dense_k: int = 0
    final_k: int = 5
    pool: int = 20
    rrf_k: int = 60
    context_tokens: int = 4096
    graph_chunks: int = 3
    correct: bool = True


def retrieve(questions: DataFrame, variants: list[DataFrame], corpus: DataFrame, index: LexicalIndex, cfg: Settings = Settings()) -> DataFrame:
    """(qid, pos, chunk_id, ...): a lexical and a vector list of each variant fused, pooled and reranked."""
    lists = []
    for v in (questions, *variants):
        if cfg.dense_k:
            asked = retrieval.hashed_vectors(v.select(F.col("qid").alias("id"), F.col("question").alias("text"))).select(F.col("id").alias("qid"), F.col("v").alias("q"))
            lists.append(("dense", retrieval.dense(asked, retrieval.vectors_of_terms(index.texts()), cfg.dense_k)))
        lists.append(("bm25", index.search(v, cfg.lexical_k)))
    pool = retrieval.best_fused(retrieval.fuse(lists, cfg.rrf_k), cfg.pool).select("qid", "id", "rrf_score", "source")
    shown = pool.join(corpus, "id").join(questions, "qid")
    ranked = retrieval.rerank_lexical(shown, cfg.final_k)
    return ranked.select("qid", F.col("rank").alias("pos"), F.col("id").alias("chunk_id"), "parent_id", "ticker", "fiscal_period", "section_title", "text", "source", "score")


def hypothetical(questions: DataFrame, corpus: DataFrame, index: LexicalIndex) -> DataFrame:
    """(qid, id, question): for each question the text of its best lexical hit, a variant to search vectors with."""
    return index.search(questions, 1).join(corpus.select("id", "text"), "id").select("qid", "id", F.col("text").alias("question"))


def with_graph(hits: DataFrame, questions: DataFrame, entities: DataFrame, relationships: DataFrame, corpus: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Chunks of the graph appended after the ranked ones, without a rerank score."""
    merged = graph.merge_entities(entities)
    found = graph.expand(graph.match_questions(questions, merged), merged, relationships, hits, cfg.graph_chunks)
    extra = found.join(corpus.withColumnRenamed("id", "chunk_id"), "chunk_id").withColumn("pos", F.col("pos") + cfg.final_k).withColumn("source", F.lit("graph")).withColumn("score", F.lit(None).cast("double"))
    return hits.unionByName(extra.select(*hits.columns))


def answer(hits: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(qid, answer, chunks, grounded, n_tokens); the answer's numbers are the slots of its context."""
    slots = context.valley(context.one_per_parent(hits))
    blocks = slots.withColumn("block", context.block(F.col("slot"), F.col("ticker"), F.col("fiscal_period"), F.col("section_title"), F.col("text")))
    kept = context.within_budget(blocks, cfg.context_tokens)
    per = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("slot", "text", "chunk_id"))).alias("b"), F.sum("tokens").alias("n_tokens"))
    out = per.select("qid", extract(F.transform("b", lambda x: x["text"])).alias("answer"), F.transform("b", lambda x: x["chunk_id"]).alias("chunks"), "n_tokens")
    return out.withColumn("grounded", context.grounded(F.col("answer")))


def ask(questions: DataFrame, corpus: DataFrame, chunks: DataFrame, index: LexicalIndex, entities: DataFrame | None = None, relationships: DataFrame | None = None, cfg: Settings = Settings()) -> DataFrame:
    """Answers of a batch of questions (qid, question); a question without hits gets the canned answer."""
    hits = cut(retrieve(questions, [], corpus, index, cfg))
    if entities is not None and relationships is not None:
        hits = with_graph(hits, questions, entities, relationships, corpus, cfg)
    hits = retrieval.with_parents(hits, chunks).withColumn("text", F.col("parent_text"))
    got = answer(hits, cfg)
    none = F.array().cast("array<string>")
    return questions.select("qid").distinct().join(got, "qid", "left").select(
        "qid",
        F.coalesce("answer", extract(none)).alias("answer"),
        F.coalesce("chunks", none).alias("chunks"),
        F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
        F.coalesce("grounded", F.lit(False)).alias("grounded"),
        F.col("answer").isNull().alias("retrieval_failed"),
    )


def ask_corrected(questions: DataFrame, corpus: DataFrame, web: DataFrame, index: LexicalIndex, cfg: Settings = Settings()) -> DataFrame:
    """(qid, action, chunk_id, place): the set that the corrective loop would answer from."""
    hits = retrieve(questions, [], corpus, index, cfg).join(questions, "qid")
    graded = cut(hits.select("qid", "chunk_id", "pos", corrective.grade_lexical(F.col("question"), F.col("text")).alias("relevant")))
    acts = corrective.actions(questions, graded)
    return corrective.corrected(graded, web, acts).join(acts.select("qid", "action"), "qid")
