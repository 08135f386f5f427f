"""The queries of the core and the SQL that they are held against.

Roles of the tables: chunks is the corpus (children are searched, parents are
looked up), eval_samples holds the questions, entities and relationships are the
knowledge graph, eval_results the answers, events the traces; documents and
embeddings share their ids for hybrid search.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import text as X
from quarrylight.operators import chunking, context, corrective, evaluation, graph, ingest, observe, orphans, render, retrieval, router, units
from quarrylight.plans import pipeline
from quarrylight.session import cut, rename, shared_folder, stamp
from quarrylight.session import table as T
from quarrylight.sources import files
from quarrylight.sources.index import FORMAT, LexicalIndex
from quarrylight.streaming import windows

QUESTION = "net revenue of the payments segment and the outlook for inventory"
FLAGSHIP = "hybrid_search"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
_WORDS = r"regexp_extract_all(lower({0}), '\S+')"
_TOKENS = r"regexp_extract_all({0}, '\w+|[^\w\s]')"


def fold_sql(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_WHITE}', ' ', 'g')))"


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL it must agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- frames ----------------------------------------------------------------


def _children(s: SparkSession, d: str) -> DataFrame:
    """The latest ingestion of each child chunk."""
    rows = T(s, d, "chunks").where((F.col("chunk_type") == "child") & F.col("text").isNotNull()).select("chunk_id", "parent_id", "ticker", "fiscal_period", "section_title", "text", "ingested_at")
    return ingest.keep_latest(rows, "chunk_id", "ingested_at", "text").withColumnRenamed("chunk_id", "id").drop("ingested_at")


def _questions(s: SparkSession, d: str) -> DataFrame:
    rows = T(s, d, "eval_samples").where(F.col("question").isNotNull())
    return rows.groupBy(F.col("sample_id").alias("qid")).agg(F.min("question").alias("question"))


def _one(s: SparkSession) -> DataFrame:
    return s.range(1).select(F.lit("q").alias("qid"), F.lit(QUESTION).alias("question"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang", "ticker", "doc_type", F.col("filed_on").alias("date"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _index(s: SparkSession, d: str, name: str) -> LexicalIndex:
    """The stored index of the children or of the documents: made when it is first asked for, and anew when the table changes."""
    source = os.path.abspath(os.path.join(d, "chunks.parquet" if name == "children" else "documents.parquet"))
    key = hashlib.md5(f"{FORMAT} {source} {stamp(s, source)}".encode()).hexdigest()
    index = LexicalIndex(s, os.path.join(shared_folder(s), "lexical", f"{name}-{key}"))
    if not index.exists():
        corpus, payload = (_children(s, d), ("ticker",)) if name == "children" else (_docs(s, d), ())
        # made beside its place, so that two sessions do not write over each other
        made = LexicalIndex.create(corpus.select("id", "text", *payload), f"{index.path}.{uuid.uuid4().hex}", payload)
        rename(s, made.path, index.path)
    return index


_CHILDREN = "children AS (SELECT chunk_id AS id, arg_max(parent_id, coalesce(epoch_us(ingested_at), 0)) AS parent_id, any_value(ticker) AS ticker, any_value(fiscal_period) AS fiscal_period, any_value(section_title) AS section_title, any_value(text) AS text FROM chunks WHERE chunk_type = 'child' AND text IS NOT NULL GROUP BY chunk_id)"
_QUESTIONS = "questions AS (SELECT sample_id AS qid, min(question) AS question FROM eval_samples WHERE question IS NOT NULL GROUP BY sample_id)"
_ONE = f"questions AS (SELECT 'q' AS qid, '{QUESTION}' AS question)"


def _bm25_sql(corpus: str, questions: str = "questions", name: str = "scored", keep: str = "TRUE") -> str:
    return f"""{name}_terms AS (SELECT id, unnest({_WORDS.format("text")}) AS term, len({_WORDS.format("text")}) AS dl FROM {corpus}),
    {name}_posts AS (SELECT term, id, count(*) AS tf, any_value(dl) AS dl FROM {name}_terms GROUP BY term, id),
    {name}_stats AS (SELECT count(*) AS n, avg(coalesce(len({_WORDS.format("text")}), 0)) AS avgdl FROM {corpus}),
    {name}_raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, any_value(avgdl) AS avgdl FROM {name}_posts, {name}_stats GROUP BY term),
    {name}_idf AS (SELECT term, df, avgdl, CASE WHEN raw >= 0 THEN raw ELSE (SELECT avg(raw) * 0.25 FROM {name}_raw) END AS idf FROM {name}_raw),
    {name}_asked AS (SELECT qid, term, count(*) AS m FROM (SELECT qid, unnest({_WORDS.format("question")}) AS term FROM {questions}) GROUP BY ALL),
    {name} AS (SELECT qid, id, round(sum(m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM {name}_posts JOIN {name}_idf USING (term) JOIN {name}_asked USING (term) WHERE id IN (SELECT id FROM {corpus} WHERE {keep}) GROUP BY qid, id)"""


def _top_sql(scored: str, k: int, name: str = "top") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, id) AS rank FROM {scored}) WHERE rank <= {k})"


def _cos_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))"


# ---- lexical and vector search ----------------------------------------------


@query(f"WITH {_CHILDREN}, {_ONE}, {_bm25_sql('children')} SELECT term, df, round(idf, 6) AS idf FROM scored_idf")
def bm25_stats(s, d):
    return _index(s, d, "children").terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_CHILDREN}, {_ONE}, {_bm25_sql('children')}, {_top_sql('scored', 10)} SELECT id, rank, score FROM top")
def bm25_topk(s, d):
    return _index(s, d, "children").search(_one(s), 10).select("id", "rank", "score")


@query(f"WITH {_CHILDREN}, {_ONE}, {_bm25_sql('children', keep='''ticker = 'QVRN' ''')}, {_top_sql('scored', 10)} SELECT id, rank, score FROM top")
def bm25_filtered_topk(s, d):
    return _index(s, d, "children").search(_one(s), 10, retrieval.metadata_filter(ticker="QVRN", year=None)).select("id", "rank", "score")


@query(f"WITH {_CHILDREN}, {_QUESTIONS}, {_bm25_sql('children')}, {_top_sql('scored', 5)} SELECT qid, id, rank, score FROM top")
def bm25_batch_topk(s, d):
    return _index(s, d, "children").search(_questions(s, d), 5).select("qid", "id", "rank", "score")


def _one_vector(s, d):
    return _vectors(s, d).where("id = 0").select(F.lit("q").alias("qid"), F.col("v").alias("q"))


_DENSE = f"scored AS (SELECT 'q' AS qid, e.vec_id AS id, e.label, round({_cos_sql('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"WITH {_DENSE}, {_top_sql('scored', 10)} SELECT id, rank, score FROM top")
def dense_topk(s, d):
    return retrieval.dense(_one_vector(s, d), _vectors(s, d), 10).select("id", "rank", "score")


@query(f"WITH {_DENSE}, kept AS (SELECT * FROM scored WHERE label = 3), {_top_sql('kept', 10)} SELECT id, rank, score FROM top")
def dense_filtered_topk(s, d):
    return retrieval.dense(_one_vector(s, d), _vectors(s, d), 10, F.col("label") == 3).select("id", "rank", "score")


@query(
    f"WITH scored AS (SELECT q.vec_id AS qid, e.vec_id AS id, round({_cos_sql('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), {_top_sql('scored', 10)} SELECT qid, id, rank, score FROM top"
)
def dense_batch_topk(s, d):
    """The stated query set: rows whose id is divisible by 100, against all rows."""
    asked = _vectors(s, d).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return retrieval.dense(asked, _vectors(s, d), 10).select("qid", "id", "rank", "score")


@query(
    "WITH n AS (SELECT vec_id AS id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm, embedding::DOUBLE[] AS v FROM embeddings) SELECT id, round(norm, 6) AS norm, list_transform(v, lambda x: round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 6)) AS unit FROM n"
)
def l2_normalize(s, d):
    v = _vectors(s, d)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("id", F.round(norm, 6).alias("norm"), F.transform(retrieval.normalize(F.col("v")), lambda x: F.round(x, 6)).alias("unit"))


_HYBRID = f"""{_ONE}, docs AS (SELECT doc_id AS id, text FROM documents), {_bm25_sql('docs', name='lex')}, {_top_sql('lex', 50, 'lexical')},
    vec AS (SELECT 'q' AS qid, e.vec_id AS id, round({_cos_sql('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), {_top_sql('vec', 50, 'semantic')},
    every AS (SELECT qid, id, 'dense' AS src, rank, rank AS seen FROM semantic UNION ALL SELECT qid, id, 'bm25', rank, 1000000 + rank FROM lexical),
    fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, CASE WHEN min(src) = max(src) THEN min(src) ELSE 'both' END AS source, min(seen) AS first_seen FROM every GROUP BY qid, id),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, first_seen, id) AS pos FROM fused) WHERE pos <= 20)"""


def _hybrid(s, d):
    lexical = _index(s, d, "documents").search(_one(s), 50)
    semantic = retrieval.dense(_one_vector(s, d), _vectors(s, d), 50)
    return retrieval.fuse([("dense", semantic), ("bm25", lexical)])


@query(f"WITH {_HYBRID} SELECT id, rrf_score, source, first_seen FROM fused")
def rrf_fusion(s, d):
    return _hybrid(s, d).select("id", "rrf_score", "source", F.col("first_seen").cast("bigint").alias("first_seen"))


@query(f"WITH {_HYBRID} SELECT pos, b.id, rrf_score, b.source, d.lang, d.ticker, substr(d.text, 1, 60) AS head FROM best b LEFT JOIN documents d ON d.doc_id = b.id")
def hybrid_search(s, d):
    """Lexical and vector lists fused, texts joined last and only for the result."""
    best = retrieval.best_fused(_hybrid(s, d), 20)
    payload = _docs(s, d).select("id", "lang", "ticker", F.substring("text", 1, 60).alias("head"))
    return best.join(payload, "id", "left").select("pos", "id", "rrf_score", "source", "lang", "ticker", "head")


_VARIANTS = f"""{_CHILDREN}, questions AS (SELECT sample_id AS qid, min(question) AS question FROM eval_samples WHERE question IS NOT NULL GROUP BY sample_id),
    back AS (SELECT qid, regexp_replace(question, 'Q[1-4] \\d{{4}}', 'recent quarters', 'g') AS question FROM questions), {_bm25_sql('children', name='a')}, {_bm25_sql('children', 'back', name='b')},
    {_top_sql('a', 10, 'ta')}, {_top_sql('b', 10, 'tb')}, every AS (SELECT qid, id, rank, rank AS seen FROM ta UNION ALL SELECT qid, id, rank, 1000000 + rank FROM tb),
    fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, min(seen) AS first_seen FROM every GROUP BY qid, id)"""


@query(f"WITH {_CHILDREN}, {_QUESTIONS}, {_bm25_sql('children')}, {_top_sql('scored', 1)} SELECT qid, t.id, md5(text) AS text_md5 FROM top t JOIN children USING (id)")
def hyde_texts(s, d):
    """The default stand-in for a hypothetical answer: the text that fits the question's words best."""
    return pipeline.hypothetical(_questions(s, d), _children(s, d), _index(s, d, "children")).select("qid", "id", F.md5("question").alias("text_md5"))


@query(f"WITH {_VARIANTS} SELECT qid, id, rrf_score, pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, first_seen, id) AS pos FROM fused) WHERE pos <= 5")
def hybrid_multi_variant(s, d):
    """Each question with a stepped-back variant: two lists of one source, fused."""
    q = _questions(s, d)
    back = q.select("qid", router.stepback(F.col("question")).alias("question"))
    lists = [("bm25", _index(s, d, "children").search(x, 10)) for x in (q, back)]
    return retrieval.best_fused(retrieval.fuse(lists), 5).select("qid", "id", "rrf_score", "pos")


@query("SELECT chunk_id, ticker, fiscal_period FROM chunks WHERE ticker = 'QVRN' AND fiscal_period = 'Q4 2024'")
def metadata_filter_eq(s, d):
    return T(s, d, "chunks").where(retrieval.metadata_filter(ticker="QVRN", fiscal_period="Q4 2024", doc_type=None)).select("chunk_id", "ticker", "fiscal_period")


_PARENTS = "parents AS (SELECT chunk_id, arg_max(text, coalesce(epoch_us(ingested_at), 0)) AS p_text FROM chunks GROUP BY chunk_id)"


@query(f"WITH {_CHILDREN}, {_PARENTS} SELECT c.id, c.parent_id, md5(coalesce(p_text, c.text)) AS parent_md5 FROM children c LEFT JOIN parents p ON p.chunk_id = c.parent_id")
def parent_fetch(s, d):
    return retrieval.with_parents(_children(s, d), T(s, d, "chunks")).select("id", "parent_id", F.md5("parent_text").alias("parent_md5"))


@query("SELECT doc_id, coalesce(ticker, '') AS ticker, coalesce(lang, 'und') AS lang, coalesce(doc_type, '') AS doc_type, coalesce(TRY_CAST(substr(filed_on, 1, 4) AS INTEGER), 0) AS year FROM documents")
def payload_defaults(s, d):
    return T(s, d, "documents").select("doc_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("ticker", ""), ("lang", "und"), ("doc_type", ""))], F.coalesce(F.substring("filed_on", 1, 4).try_cast("int"), F.lit(0)).alias("year"))


_RERANK = f"""WITH {_CHILDREN}, {_ONE}, {_bm25_sql('children')}, {_top_sql('scored', 20, 'cand')},
    cov AS (SELECT c.qid, c.id, round(len(list_intersect(list_distinct({_WORDS.format('question')}), list_distinct({_WORDS.format('text')}))) / len(list_distinct({_WORDS.format('question')})), 6) AS score FROM cand c JOIN children USING (id) JOIN questions USING (qid)),
    {_top_sql('cov', 5)} SELECT id, rank, score FROM top"""


@query(_RERANK)
def rerank_lexical_topk(s, d):
    cand = _index(s, d, "children").search(_one(s), 20).select("qid", "id", F.col("score").alias("rrf_score"))
    return retrieval.rerank_lexical(cand.join(_children(s, d), "id").withColumn("question", F.lit(QUESTION)), 5).select("id", "rank", "score")


@query(f"WITH {_CHILDREN}, {_ONE}, {_bm25_sql('children')}, {_top_sql('scored', 5)} SELECT id, rank, score, FALSE AS reranked FROM top")
def rerank_fallback(s, d):
    """Without a reranker the fused order stands, and the result says so."""
    return _index(s, d, "children").search(_one(s), 5).select("id", "rank", "score", F.lit(False).alias("reranked"))


# ---- ingestion ---------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM mix_targets WHERE source IS NOT NULL)")
def incremental_anti_join(s, d):
    return ingest.pending(T(s, d, "documents").select("doc_id", "source"), T(s, d, "mix_targets"), "source").select("doc_id")


@query("SELECT chunk_id, max(ingested_at) AS ingested_at, count(*) AS n FROM chunks GROUP BY chunk_id")
def upsert_keep_latest(s, d):
    rows = T(s, d, "chunks").select("chunk_id", "ingested_at", F.lit(1).alias("one"))
    n = rows.groupBy("chunk_id").agg(F.count("*").alias("n"))
    return ingest.keep_latest(rows, "chunk_id", "ingested_at").join(n, "chunk_id").select("chunk_id", "ingested_at", "n")


@query(
    "SELECT ticker, fiscal_period, count(*) AS n, round(avg(length(text)), 6) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, CAST(grouping(ticker) * 2 + grouping(fiscal_period) AS INTEGER) AS gid FROM chunks GROUP BY GROUPING SETS ((ticker), (fiscal_period), ())"
)
def index_inspect(s, d):
    return ingest.inspect(T(s, d, "chunks"), "text", "ticker", "fiscal_period").select("ticker", "fiscal_period", "n", "avg_chars", F.col("min_chars").cast("bigint"), F.col("max_chars").cast("bigint"), "gid")


@query("SELECT section_title, count(*) AS n FROM chunks WHERE section_title IS NOT NULL GROUP BY ALL ORDER BY n DESC, section_title LIMIT 10")
def index_top_sections(s, d):
    return T(s, d, "chunks").where(F.col("section_title").isNotNull()).groupBy("section_title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section_title").limit(10)


@query(f"SELECT count(*) AS n_postings, count(DISTINCT term) AS vocabulary, round(sum(tf) / count(DISTINCT id), 6) AS avg_tokens FROM (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY ALL)")
def index_vocabulary(s, d):
    index = _index(s, d, "documents")
    terms = index.terms().agg(F.sum("df").alias("n_postings"), F.count("*").alias("vocabulary"), F.sum("tf").alias("tf"))
    ids = index.texts().where("dl > 0").agg(F.count("*").alias("ids"))
    return terms.crossJoin(ids).select("n_postings", "vocabulary", F.round(F.col("tf") / F.col("ids"), 6).alias("avg_tokens"))  # one row each


@query(f"WITH {_CHILDREN} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_WORDS.format('text')}) AS term FROM children) GROUP BY ALL) GROUP BY term")
def index_upsert(s, d):
    """An index of the children without the first ticker, all of other texts; the true ones come in two further writes."""
    c = _children(s, d).select("id", "text", "ticker")
    first = c.agg(F.min("ticker")).first()[0]
    at = os.path.join(shared_folder(s), "lexical", f"upsert-{uuid.uuid4().hex}")
    index = LexicalIndex.create(c.where(F.col("ticker") != first).withColumn("text", F.concat(F.lit("former "), F.col("text"))), at, ("ticker",))
    index.upsert(c.where(F.coalesce(F.col("ticker") == first, F.lit(True)))).upsert(c.where(F.col("ticker") != first))
    return index.terms().select("term", "df", "tf")


@query("SELECT entity_id, unnest(range(0, len(chunk_ids))) AS ord, unnest(chunk_ids) AS chunk_id FROM entities WHERE chunk_ids IS NOT NULL")
def filings_zip_arrays(s, d):
    return ingest.zipped(T(s, d, "entities").select("entity_id", F.col("chunk_ids").alias("chunk_id"), F.transform("chunk_ids", lambda x, i: i).alias("place")), "entity_id", "chunk_id", "place").select("entity_id", F.col("ord").cast("bigint").alias("ord"), "chunk_id")


@query(
    "WITH docs AS (SELECT ticker AS filing, chunk_id AS name, coalesce(lower(section_title), '') AS descr, doc_type, row_number() OVER (PARTITION BY ticker ORDER BY chunk_id, ingested_at) AS ord FROM chunks), p AS (SELECT *, CASE WHEN doc_type IN ('EX-99.1', 'EX-99.2', 'EX-99') OR contains(lower(name), 'ex99') OR contains(lower(name), 'ex-99') OR regexp_matches(descr, 'earnings|press release|financial results|exhibit 99') THEN 0 WHEN doc_type = '8-K' AND name <> '' THEN 1 END AS p FROM docs) SELECT filing, arg_min(name, p * 1000000000 + ord) AS name FROM p WHERE p IS NOT NULL GROUP BY filing"
)
def pick_best_document(s, d):
    ord_ = F.row_number().over(Window.partitionBy("ticker").orderBy("chunk_id", "ingested_at"))
    docs = T(s, d, "chunks").select(F.col("ticker").alias("filing"), F.col("chunk_id").alias("name"), F.col("section_title").alias("description"), F.col("doc_type").alias("type"), ord_.alias("ord"))
    return ingest.best_document(docs)


@query("SELECT 'entity' AS kind, entity_type AS name, count(*) AS n, coalesce(sum(len(chunk_ids)), 0)::BIGINT AS n_chunks FROM entities GROUP BY ALL UNION ALL SELECT 'edge', relation, count(*), count(chunk_id) FROM relationships GROUP BY ALL")
def graph_round_trip(s, d):
    """Entities and relationships written as JSON graphs and read again."""
    at = os.path.join(shared_folder(s), "graphs", uuid.uuid4().hex)
    files.write_graph(T(s, d, "entities"), T(s, d, "relationships"), at)
    e, r = files.read_graph(s, at)
    n = e.groupBy(F.lit("entity").alias("kind"), F.col("entity_type").alias("name")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).alias("n_chunks"))
    return n.unionByName(r.groupBy(F.lit("edge").alias("kind"), F.col("relation").alias("name")).agg(F.count("*").alias("n"), F.count("chunk_id").alias("n_chunks")))


@query("SELECT DISTINCT result_id, generated_answer AS answer, len(context_chunks)::INTEGER AS n_chunks, round(latency_seconds, 3) AS latency_seconds, coalesce(pipeline_failed, FALSE) AS failed, error_message AS error FROM eval_results")
def result_round_trip(s, d):
    r = T(s, d, "eval_results")
    text = files.result_json(id=F.col("result_id"), answer=F.col("generated_answer"), chunks=F.col("context_chunks"), latency_seconds=F.col("latency_seconds"), failed=F.coalesce("pipeline_failed", F.lit(False)), error=F.col("error_message"))
    back = r.select(files.result_from_json(text).alias("x"))
    return back.select(F.col("x.id").alias("result_id"), "x.answer", F.when(F.col("x.chunks").isNotNull(), F.size("x.chunks")).alias("n_chunks"), "x.latency_seconds", "x.failed", "x.error").distinct()


@query("SELECT chunk_id AS name FROM (SELECT DISTINCT chunk_id FROM chunks WHERE ticker IS NULL OR ticker <> 'QVRN') WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE ticker = 'QVRN' AND chunk_id IS NOT NULL)")
def checkpoint_pending(s, d):
    """What is left after the chunks of one ticker were marked as done, half by half."""
    at = os.path.join(shared_folder(s), "done", uuid.uuid4().hex)
    names = T(s, d, "chunks").select(F.col("chunk_id").alias("name"), "ticker").distinct()
    half = F.pmod(F.hash("name"), F.lit(2))
    for i in (0, 1):
        files.mark_done(s, ingest.pending(names.where((F.col("ticker") == "QVRN") & (half == i)), files.read_done(s, at), "name"), at)
    return ingest.pending(names, files.read_done(s, at), "name").select("name").distinct()


@query("SELECT doc_id, ticker || '_' || filed_on || '_' || substr(replace(md5(source), '-', ''), 1, 10) || '.htm' AS name FROM documents WHERE ticker IS NOT NULL AND filed_on IS NOT NULL AND source IS NOT NULL")
def filing_names(s, d):
    """The hash of the source stands in for an accession number."""
    docs = T(s, d, "documents").where(F.col("ticker").isNotNull() & F.col("filed_on").isNotNull() & F.col("source").isNotNull())
    return docs.select("doc_id", files.filing_name(F.col("ticker"), F.col("filed_on"), F.md5("source")).alias("name"))


@query("SELECT result_id, CASE WHEN latency_seconds < 1 THEN CAST(CAST(round(latency_seconds * 1000) AS INTEGER) AS VARCHAR) || 'ms' ELSE CAST(CAST(round(CAST(latency_seconds AS DECIMAL(18, 9)), 2) AS DECIMAL(18, 2)) AS VARCHAR) || 's' END AS shown FROM (SELECT DISTINCT result_id, latency_seconds FROM eval_results)")
def latency_format(s, d):
    return T(s, d, "eval_results").select("result_id", "latency_seconds").distinct().select("result_id", ingest.latency_label(F.col("latency_seconds")).alias("shown"))


# ---- parsing and chunking ------------------------------------------------------


_QUARTER = "CASE " + " ".join(f"WHEN regexp_matches(substr(text, 1, 3000), '(?i)\\b{p}\\b') THEN '{q}'" for p, q in chunking.QUARTERS) + " WHEN m BETWEEN 1 AND 12 THEN 'Q' || CAST(ceil(m / 3) AS INTEGER) ELSE 'Q1' END"


@query(f"SELECT doc_id, {_QUARTER} AS quarter, {_QUARTER} || ' ' || substr(filed_on, 1, 4) AS fiscal_period FROM (SELECT doc_id, text, filed_on, TRY_CAST(substr(filed_on, 6, 2) AS INTEGER) AS m FROM documents)")
def quarter_detect(s, d):
    q = chunking.quarter(F.col("text"), F.substring("filed_on", 6, 2).try_cast("int"))
    return T(s, d, "documents").select("doc_id", q.alias("quarter"), "filed_on").select("doc_id", "quarter", F.concat(F.col("quarter"), F.lit(" "), F.substring("filed_on", 1, 4)).alias("fiscal_period"))


@query(f"SELECT doc_id, coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS words, coalesce(len({_TOKENS.format('text')}), 0) AS tokens, coalesce(len(regexp_extract_all(text, '\\S+')) >= 100, FALSE) AS passes FROM documents")
def text_counts(s, d):
    """Word and token counts with the word floor of the quality gate."""
    n = X.word_count(F.col("text"))
    return T(s, d, "documents").select("doc_id", n.cast("bigint").alias("words"), X.token_count(F.col("text")).cast("bigint").alias("tokens"), (n >= 100).alias("passes"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\s*(?:\\w+|[^\\w\\s])') AS tok FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, tok, unnest(range(0, len(tok), 128)) AS off FROM t) SELECT doc_id, off // 128 AS page, md5(regexp_replace(array_to_string(tok[off + 1 : off + 128], ''), '^\\s+', '')) AS body FROM p")
def token_pages(s, d):
    docs = T(s, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.posexplode(X.token_pages(F.col("text"), 128)).alias("page", "body")).select("doc_id", F.col("page").cast("bigint").alias("page"), F.md5("body").alias("body"))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents) SELECT doc_id, coalesce(array_to_string(w[greatest(len(w) - 63, 1):], ' '), '') AS tail FROM w")
def overlap_tail(s, d):
    return T(s, d, "documents").select("doc_id", X.overlap_tail(F.col("text"), 64).alias("tail"))


def _html_sql(c: str) -> str:
    for tag in chunking.DROPPED_TAGS:
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(10), 'g')"
    c = f"regexp_replace({c}, '(?s)<[^>]*>', chr(10), 'g')"
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


@query(f"SELECT doc_id, md5({_html_sql('text')}) AS plain FROM documents WHERE text LIKE '%<%>%'")
def html_to_text(s, d):
    return T(s, d, "documents").where(F.col("text").like("%<%>%")).select("doc_id", F.md5(chunking.html_text(F.col("text"))).alias("plain"))


@query(
    "WITH l AS (SELECT chunk_id, ingested_at, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM chunks) SELECT chunk_id, ingested_at, coalesce(len(list_filter(ls, lambda x: regexp_matches(trim(x), '^\\|.*\\|$'))) >= 2 AND len(list_filter(ls, lambda x: regexp_matches(trim(x), '^\\|.*\\|$'))) >= 0.4 * len(ls), FALSE) AS is_table FROM l"
)
def table_block_detect(s, d):
    return T(s, d, "chunks").select("chunk_id", "ingested_at", chunking.is_table(F.col("text")).alias("is_table"))


def _header_sql(c: str) -> str:
    return f"regexp_matches(trim({c}), '(?i)" + "|".join(chunking.HEADERS) + f"') AND trim({c}) <> '' AND len(regexp_extract_all({c}, '\\S+')) <= 8"



@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS n_headers FROM l WHERE {_header_sql('line')} GROUP BY doc_id")
def header_detect(s, d):
    lines = T(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(chunking.is_header(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n_headers"))


_SECTIONS = f"""l AS (SELECT chunk_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE text IS NOT NULL AND chunk_type <> 'child' GROUP BY chunk_id)),
    r AS (SELECT *, regexp_matches(trim(line), '^\\|.*\\|$') AS is_row FROM l),
    u AS (SELECT *, pos - row_number() OVER (PARTITION BY id, is_row ORDER BY pos) AS run FROM r),
    t AS (SELECT *, is_row AND count(*) OVER (PARTITION BY id, is_row, run) >= 2 AS tab FROM u),
    h AS (SELECT *, NOT tab AND {_header_sql('line')} AS head FROM t),
    g AS (SELECT *, sum(CASE WHEN head OR tab <> coalesce(prev, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS grp,
        last_value(CASE WHEN head THEN trim(regexp_replace(trim(line), '^#+', '')) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS title FROM (SELECT *, lag(tab) OVER (PARTITION BY id ORDER BY pos) AS prev FROM h)),
    s AS (SELECT id, grp, bool_or(tab) AS tab, min(title) AS t, trim(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head)) AS body, min(pos) AS seq FROM g GROUP BY id, grp)"""


@query(f"WITH {_SECTIONS} SELECT id, seq, CASE WHEN tab THEN '__TABLE__' ELSE coalesce(t, '') END AS title, md5(body) AS body FROM s WHERE (tab OR len({_TOKENS.format('body')}) > 10) AND len(regexp_extract_all(body, '\\S+')) >= 10")
def semantic_sections(s, d):
    docs = ingest.keep_latest(T(s, d, "chunks").where("text is not null and chunk_type <> 'child'").select("chunk_id", "text", "ingested_at"), "chunk_id", "ingested_at").withColumnRenamed("chunk_id", "id")
    return chunking.sections(docs).select("id", F.col("seq").cast("bigint").alias("seq"), "title", F.md5("body").alias("body"))


@query(
    "WITH p AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(CASE WHEN trim(text) = '' THEN 0 ELSE 1 + len(list_filter(ps[:-2], lambda x: NOT regexp_matches(x, '(?i)" + chunking.ABBREVIATION + "'))) END AS INTEGER) AS n_sentences FROM p"
)
def sentence_split(s, d):
    return T(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.size(chunking.sentences(F.col("text"))).alias("n_sentences"))


@query("SELECT chunk_id, ingested_at, '[Context: ' || ticker || ' | ' || doc_type || ' | ' || \"date\" || CASE WHEN coalesce(section_title, '') IN ('', '__TABLE__', 'Financial Table') THEN '' ELSE ' | Section: ' || section_title END || ']' || chr(10) || chr(10) AS prefix FROM chunks")
def contextual_prefix(s, d):
    return T(s, d, "chunks").select("chunk_id", "ingested_at", chunking.prefix(F.col("ticker"), F.col("date"), F.col("doc_type"), F.col("section_title")).alias("prefix"))


@query(
    "WITH h AS (SELECT doc_id, ticker, filed_on, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(ticker || ':' || filed_on)) AS h FROM documents WHERE ticker IS NOT NULL AND filed_on IS NOT NULL) SELECT doc_id, ticker || '_' || filed_on || '_' || substr(h, 1, 8) || '_' || doc_id AS chunk_id FROM h"
)
def chunk_id_uuid5(s, d):
    docs = T(s, d, "documents").where(F.col("ticker").isNotNull() & F.col("filed_on").isNotNull())
    return docs.select("doc_id", chunking.chunk_id(F.col("ticker"), F.col("filed_on"), F.col("doc_id")).alias("chunk_id"))


def _filings(s, d):
    return _docs(s, d).select(F.col("id").cast("string").alias("id"), F.coalesce("ticker", F.lit("unknown")).alias("ticker"), F.coalesce("date", F.lit("unknown")).alias("date"), F.coalesce("doc_type", F.lit("8-K")).alias("doc_type"), "text")


@query()
def parent_chunks(s, d):
    """Rows only: an order-dependent fold, held against its invariants in the tests."""
    return chunking.build_chunks(_filings(s, d)).where("chunk_type <> 'child'").select("id", "chunk_id", "chunk_type", "chunk_index", "section_title", F.md5("text").alias("text_md5"))


@query()
def child_chunks(s, d):
    return chunking.build_chunks(_filings(s, d)).where("chunk_type = 'child'").select("id", "chunk_id", "parent_id", "chunk_index", "child_index", F.md5("text").alias("text_md5"))


_COVERED = f"""{_SECTIONS.replace("SELECT chunk_id, any_value(text) AS text FROM chunks WHERE text IS NOT NULL AND chunk_type <> 'child' GROUP BY chunk_id", "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents WHERE text IS NOT NULL")},
    b AS (SELECT id, body, len({_TOKENS.format('body')}) AS n, tab FROM s WHERE (tab OR len({_TOKENS.format('body')}) > 10) AND len(regexp_extract_all(body, '\\S+')) >= 10)"""


@query(f"WITH {_COVERED} SELECT id, CAST(sum(CASE WHEN tab THEN 1 ELSE ceil(n / {chunking.PARENT_TOKENS}) END) AS BIGINT) AS n_pages, CAST(sum(CASE WHEN tab THEN 1 ELSE ceil(n / {chunking.PARENT_TOKENS}) END) AS BIGINT) AS n_kept FROM b GROUP BY id")
def chunk_coverage(s, d):
    """Every page of every section of a document stands in one of its chunks as it stood in its text."""
    docs = _filings(s, d)
    parts = chunking.sections(docs)
    whole = (F.col("title") == "__TABLE__") | (X.token_count(F.col("body")) <= chunking.PARENT_TOKENS)
    pages = parts.select("id", "seq", F.explode(F.when(whole, F.array("body")).otherwise(X.token_pages(F.col("body"), chunking.PARENT_TOKENS))).alias("page"))
    texts = chunking.build_chunks(docs).where("chunk_type <> 'child'").groupBy("id").agg(F.collect_list("text").alias("texts"))
    kept = F.exists("texts", lambda t: F.contains(t, F.regexp_replace("page", f"^{X.BLANKS}|{X.BLANKS}$", "")))
    return pages.join(texts, "id", "left").groupBy("id").agg(F.count("*").alias("n_pages"), F.count(F.when(kept, 1)).alias("n_kept"))


# ---- questions -------------------------------------------------------------------


_KW = "list_bool_or(list_transform([" + ", ".join(f"'{k}'" for k in router.KEYWORDS) + "], lambda k: contains(lower(question), k)))"
_HELLO = "(" + " OR ".join(f"starts_with(lower(question), '{g}')" for g in router.GREETINGS) + ")"
_ROUTE = f"""{_QUESTIONS}, called AS (SELECT lower(ticker) AS w, ticker FROM companies UNION ALL SELECT lower(string_split(company, ' ')[1]), ticker FROM companies),
    said AS (SELECT qid, min(ticker) AS ticker FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '\\w+')) AS w FROM questions) JOIN called USING (w) GROUP BY qid),
    q AS (SELECT qid, question, ticker, len(regexp_extract_all(question, '\\S+')) AS n, {_KW} AS kw, {_HELLO} AS hello FROM questions LEFT JOIN said USING (qid)),
    routed AS (SELECT qid, CASE WHEN n <= 2 AND NOT kw THEN 'OUT_OF_SCOPE' WHEN hello AND n < 6 THEN 'OUT_OF_SCOPE' WHEN ticker IS NOT NULL AND kw THEN 'FINANCIAL_SPECIFIC' END AS intent,
      CAST(CASE WHEN n <= 2 AND NOT kw THEN 0.9 WHEN hello AND n < 6 THEN 0.95 WHEN ticker IS NOT NULL AND kw THEN 0.92 END AS DOUBLE) AS confidence,
      CASE WHEN (n <= 2 AND NOT kw) OR (hello AND n < 6) THEN NULL WHEN kw THEN ticker END AS ticker FROM q)"""


@query(f"WITH {_ROUTE} SELECT * FROM routed")
def route_heuristic(s, d):
    return router.route(_questions(s, d), T(s, d, "companies"))


@query(f"WITH {_ROUTE} SELECT qid, coalesce(intent, 'AMBIGUOUS') AS intent, coalesce(intent, 'AMBIGUOUS') <> 'FINANCIAL_SPECIFIC' AS skip_hyde, coalesce(intent, 'AMBIGUOUS') IN ('OUT_OF_SCOPE', 'GENERAL') AS skip_transform, coalesce(intent, 'AMBIGUOUS') = 'OUT_OF_SCOPE' AS refuse FROM routed")
def route_flags(s, d):
    return router.flags(router.route(_questions(s, d), T(s, d, "companies")))


@query(f"WITH {_ROUTE} SELECT coalesce(intent, 'AMBIGUOUS') AS intent, count(*) AS n, round(avg(CASE WHEN intent IS NULL THEN 0.0 ELSE 1.0 END), 6) AS rule_rate FROM routed GROUP BY ALL")
def router_stats(s, d):
    r = router.route(_questions(s, d), T(s, d, "companies"))
    return r.groupBy(F.coalesce("intent", F.lit("AMBIGUOUS")).alias("intent")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("intent").isNull(), 0.0).otherwise(1.0)), 6).alias("rule_rate"))


_GENERATED = "gen AS (SELECT result_id AS qid, any_value(question) AS question, any_value(generated_answer) AS generated FROM eval_results WHERE question IS NOT NULL GROUP BY result_id)"
_CLEAN = f"""{_GENERATED}, l AS (SELECT qid, question, unnest(string_split(coalesce(generated, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(generated, ''), chr(10))))) AS off FROM gen),
    c AS (SELECT qid, question, off, trim(regexp_replace(line, '^[0-9.\\-) •*]+', '')) AS variant FROM l WHERE len(regexp_extract_all(line, '\\S+')) >= 3),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, lower(variant) ORDER BY off) AS rn FROM c WHERE lower(variant) <> lower(question)) WHERE rn = 1),
    v AS (SELECT qid, 0 AS pos, question AS variant FROM gen UNION ALL SELECT qid, pos, variant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY off) AS pos FROM f) WHERE pos <= 3)"""


def _generated(s, d):
    return T(s, d, "eval_results").where(F.col("question").isNotNull()).groupBy(F.col("result_id").alias("qid")).agg(F.first("question").alias("question"), F.first("generated_answer").alias("generated"))


@query(f"WITH {_CLEAN} SELECT qid, CAST(pos AS INTEGER) AS pos, variant FROM v")
def variant_cleanup(s, d):
    return router.variants(_generated(s, d))


@query(f"WITH {_CLEAN} SELECT qid, CAST(pos AS INTEGER) AS pos, variant FROM (SELECT *, row_number() OVER (PARTITION BY qid, lower(trim(variant)) ORDER BY pos) AS rn FROM v) WHERE rn = 1")
def variant_dedup(s, d):
    return router.first_occurrences(router.variants(_generated(s, d)))


@query("SELECT sha256(lower(trim(question))) AS cache_key, count(*) AS n FROM eval_results WHERE question IS NOT NULL GROUP BY ALL")
def cache_key_dedup(s, d):
    return T(s, d, "eval_results").where(F.col("question").isNotNull()).groupBy(router.cache_key(F.col("question")).alias("cache_key")).agg(F.count("*").alias("n"))


# ---- knowledge graph ----------------------------------------------------------------


@query("WITH m AS (SELECT DISTINCT chunk_id, ticker, unnest(regexp_extract_all(text, '\\b([A-Z][A-Z0-9]*)\\b')) AS mentioned FROM chunks) SELECT DISTINCT m.chunk_id, m.ticker, mentioned FROM m JOIN companies c ON c.ticker = mentioned WHERE m.ticker <> mentioned")
def kg_regex_entities(s, d):
    return graph.mentions(T(s, d, "chunks"), T(s, d, "companies")).select("chunk_id", "ticker", "mentioned").distinct()


def _extracted(s, d):
    """Parents are read for tickers; each named entity stands in for what a model said of its chunks."""
    parents = T(s, d, "chunks").where("chunk_type = 'parent'")
    said = F.to_json(F.struct(F.array(F.struct("name", "entity_type")).alias("entities")))
    outputs = T(s, d, "entities").select(F.explode("chunk_ids").alias("chunk_id"), "ticker", said.alias("output"))
    return graph.extract(parents, T(s, d, "companies"), outputs)


_COMPETING = "said AS (SELECT DISTINCT m.chunk_id, m.ticker, mentioned FROM (SELECT chunk_id, ticker, unnest(regexp_extract_all(text, '\\b([A-Z][A-Z0-9]*)\\b')) AS mentioned FROM chunks WHERE chunk_type = 'parent') m JOIN companies c ON c.ticker = mentioned WHERE m.ticker <> mentioned)"


@query(f"WITH {_COMPETING} SELECT chunk_id, ticker, lower(mentioned) AS name, 'COMPETITOR' AS entity_type FROM said UNION SELECT unnest(chunk_ids), ticker, {fold_sql('name')}, coalesce(entity_type, 'METRIC') FROM entities WHERE {fold_sql('name')} <> ''")
def kg_extract_entities(s, d):
    return _extracted(s, d)[0]


@query(f"WITH {_COMPETING} SELECT DISTINCT chunk_id, ticker, lower(ticker) AS source, lower(mentioned) AS target, 'COMPETES_WITH' AS relation FROM said")
def kg_extract_edges(s, d):
    return _extracted(s, d)[1]


_MONEY, _SHARE = r"(?i)\$[\d,]+\.?\d*\s*(?:billion|million|bn|mn|trillion|[BMT])", r"(?i)[\d.]+\s*(?:percent|%)"


@query(f"SELECT chunk_id, ingested_at, coalesce(len(regexp_extract_all(text, '{_MONEY}')), 0) AS n_money, coalesce(len(regexp_extract_all(text, '{_SHARE}')), 0) AS n_percent FROM chunks")
def kg_numbers(s, d):
    n = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("bigint")
    return T(s, d, "chunks").select("chunk_id", "ingested_at", n(_MONEY).alias("n_money"), n(_SHARE).alias("n_percent"))


_MERGED = f"""named AS (SELECT concat_ws('::', entity_type, coalesce(ticker, ''), {fold_sql('name')}) AS entity_key, entity_id, {fold_sql('name')} AS name, entity_type, ticker, fiscal_period, chunk_ids, aliases FROM entities WHERE {fold_sql('name')} <> ''),
    merged AS (SELECT entity_key, min(entity_id) AS entity_id, arg_min(name, entity_id) AS name, arg_min(entity_type, entity_id) AS entity_type, arg_min(ticker, entity_id) AS ticker, count(*) AS n_rows,
      coalesce(list_sort(list_distinct(flatten(list(coalesce(chunk_ids, []))))), []) AS chunk_ids, coalesce(list_sort(list_distinct(list_filter(list_transform(flatten(list(coalesce(aliases, []))), lambda x: {fold_sql('x')}), lambda x: x IS NOT NULL))), []) AS aliases FROM named GROUP BY entity_key)"""


def _merged(s, d):
    return graph.merge_entities(T(s, d, "entities"))


@query(f"WITH {_MERGED} SELECT entity_key, entity_id, name, entity_type, ticker, n_rows, chunk_ids, aliases FROM merged")
def kg_entity_merge(s, d):
    return _merged(s, d).select("entity_key", "entity_id", "name", "entity_type", "ticker", "n_rows", "chunk_ids", "aliases")


_EDGES = f"""e AS (SELECT rel_id, {fold_sql('source')} AS source, {fold_sql('target')} AS target, relation, ticker FROM relationships),
    edges AS (SELECT source || '--' || relation || '-->' || target AS edge_key, min(rel_id) AS rel_id, any_value(source) AS source, any_value(target) AS target, arg_min(ticker, rel_id) AS ticker FROM e WHERE source <> '' AND target <> '' GROUP BY 1)"""


@query(f"WITH {_EDGES} SELECT edge_key, rel_id, ticker FROM edges WHERE edge_key IS NOT NULL")
def kg_edge_dedup(s, d):
    return graph.dedup_edges(T(s, d, "relationships")).where(F.col("edge_key").isNotNull()).select("edge_key", "rel_id", "ticker")


@query(f"WITH {_MERGED} SELECT entity_key, name FROM merged WHERE entity_type = 'PRODUCT' AND ticker = 'QVRN'")
def kg_find_by_type(s, d):
    return _merged(s, d).where(retrieval.metadata_filter(entity_type="PRODUCT", ticker="QVRN")).select("entity_key", "name")


@query(f"WITH {_MERGED} SELECT entity_key, unnest(chunk_ids) AS chunk_id FROM merged WHERE name = 'tamquil' OR list_contains(aliases, 'tamquil')")
def kg_find_entity(s, d):
    return _merged(s, d).where((F.col("name") == "tamquil") | F.array_contains("aliases", "tamquil")).select("entity_key", F.explode("chunk_ids").alias("chunk_id"))


@query(f"WITH {_MERGED} SELECT name, list_sort(list(DISTINCT ticker)) AS tickers FROM merged GROUP BY name HAVING count(DISTINCT ticker) > 1")
def kg_cross_company(s, d):
    return graph.cross_company(_merged(s, d))


_RELATED = f"{_MERGED}, {_EDGES}, names AS (SELECT DISTINCT name FROM merged WHERE entity_type = 'PRODUCT'), rel AS (SELECT name, edge_key, target AS other, 'out' AS direction FROM edges JOIN names ON source = name UNION ALL SELECT name, edge_key, source, 'in' FROM edges JOIN names ON target = name WHERE source <> target)"


@query(f"WITH {_RELATED} SELECT * FROM rel")
def kg_related(s, d):
    return graph.related(_merged(s, d).where("entity_type = 'PRODUCT'").select("name").distinct(), T(s, d, "relationships"))


@query(f"WITH {_MERGED} SELECT entity_type, count(*) AS n FROM merged GROUP BY ALL")
def kg_type_counts(s, d):
    return _merged(s, d).groupBy("entity_type").agg(F.count("*").alias("n"))


_PLAIN = r"array_to_string(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), ' ')"
_MATCH = f"""{_MERGED}, {_QUESTIONS}, called AS (SELECT DISTINCT name, {_PLAIN.format('said')} AS gram FROM (SELECT name, unnest(list_concat([name], aliases)) AS said FROM merged)),
    plain AS (SELECT qid, ' ' || {_PLAIN.format(fold_sql('question'))} || ' ' AS q FROM questions),
    matched AS (SELECT DISTINCT qid, name FROM plain JOIN called ON contains(q, ' ' || gram || ' ') WHERE gram <> '')"""


def _matches(s, d):
    return graph.match_questions(_questions(s, d), _merged(s, d))


@query(f"WITH {_MATCH} SELECT qid, name FROM matched")
def kg_match_question(s, d):
    return _matches(s, d)


_EXPAND = f"""{_MATCH}, {_EDGES}, owned AS (SELECT name, unnest(chunk_ids) AS chunk_id FROM merged), near AS (SELECT source AS name, target AS other FROM edges UNION SELECT target, source FROM edges),
    found AS (SELECT qid, chunk_id, min(hop) AS hop FROM (SELECT qid, chunk_id, 0 AS hop FROM matched JOIN owned USING (name) UNION ALL SELECT DISTINCT qid, o.chunk_id, 1 FROM matched m JOIN near n ON n.name = m.name JOIN owned o ON o.name = n.other) GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hop, chunk_id) AS pos FROM found WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_type = 'table' AND chunk_id IS NOT NULL))"""


def _expanded(s, d, most):
    tables = T(s, d, "chunks").where("chunk_type = 'table'").select("chunk_id")
    return graph.expand(_matches(s, d), _merged(s, d), T(s, d, "relationships"), s.createDataFrame([], "qid string, chunk_id string"), most, tables)


@query(f"WITH {_EXPAND} SELECT qid, chunk_id, CAST(hop AS INTEGER) AS hop, CAST(pos AS INTEGER) AS pos FROM placed WHERE pos <= 10")
def kg_graph_expand(s, d):
    return _expanded(s, d, 10).select("qid", "chunk_id", "hop", "pos")


@query(f"WITH {_EXPAND} SELECT qid, p.chunk_id, CAST(pos AS INTEGER) AS pos, 'graph' AS source, CAST(0.0 AS DOUBLE) AS rrf_score FROM placed p JOIN (SELECT DISTINCT chunk_id FROM chunks) USING (chunk_id) WHERE pos <= 3")
def kg_inject(s, d):
    have = T(s, d, "chunks").select("chunk_id").distinct()
    return _expanded(s, d, 3).join(graph.by_merge(have), "chunk_id", "left_semi").select("qid", "chunk_id", "pos", F.lit("graph").alias("source"), F.lit(0.0).alias("rrf_score"))


# ---- context and citations ------------------------------------------------------------


def _hits(s, d):
    top = _index(s, d, "children").search(_questions(s, d), 10).select("qid", "id", F.col("rank").alias("pos"))
    return top.join(_children(s, d), "id").withColumnRenamed("id", "chunk_id")


_HITS = f"{_CHILDREN}, {_QUESTIONS}, {_bm25_sql('children')}, {_top_sql('scored', 10)}, hits AS (SELECT qid, t.id AS chunk_id, rank AS pos, parent_id, ticker, fiscal_period, section_title, text FROM top t JOIN children USING (id)), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, coalesce(parent_id, chunk_id) ORDER BY pos) AS rn FROM hits) WHERE rn = 1)"
_SLOTS = "numbered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY qid) AS n FROM firsts), slots AS (SELECT *, CAST(CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS INTEGER) + 1 AS slot FROM numbered)"
_BLOCK = "'--- [' || slot || '] ' || coalesce(ticker, '') || ' | ' || coalesce(fiscal_period, '') || ' | ' || CASE WHEN coalesce(section_title, '') = '' THEN '—' ELSE substr(section_title, 1, 60) END || ' ---' || chr(10) || coalesce(text, '')"


@query(f"WITH {_HITS} SELECT qid, chunk_id, CAST(pos AS INTEGER) AS pos FROM firsts")
def ctx_parent_dedup(s, d):
    return context.one_per_parent(_hits(s, d)).select("qid", "chunk_id", "pos")


@query(f"WITH {_HITS}, {_SLOTS} SELECT qid, chunk_id, slot FROM slots")
def ctx_valley(s, d):
    return context.valley(context.one_per_parent(_hits(s, d))).select("qid", "chunk_id", "slot")


@query(f"WITH {_HITS}, {_SLOTS} SELECT qid, slot, {_BLOCK} AS block FROM slots")
def ctx_block(s, d):
    slots = context.valley(context.one_per_parent(_hits(s, d)))
    return slots.select("qid", "slot", context.block(F.col("slot"), F.col("ticker"), F.col("fiscal_period"), F.col("section_title"), F.col("text")).alias("block"))


@query(
    f"WITH {_HITS}, {_SLOTS}, w AS (SELECT qid, slot, {_BLOCK} AS block FROM slots), b AS (SELECT qid, slot, len({_TOKENS.format('block')}) AS tokens, CASE WHEN slot = 1 AND len({_TOKENS.format('block')}) > 512 THEN array_to_string(regexp_extract_all(block, '\\s*(?:\\w+|[^\\w\\s])')[1:512], '') ELSE block END AS block FROM w), r AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY slot) AS upto FROM b) SELECT qid, md5(string_agg(block, chr(10) || chr(10) ORDER BY slot)) AS context_md5, count(*) AS n_blocks, CAST(sum(least(tokens, 512)) AS BIGINT) AS tokens FROM r WHERE upto <= 512 OR (slot = 1 AND tokens > 512) GROUP BY qid"
)
def ctx_budget(s, d):
    return context.pack(_hits(s, d), 512).select("qid", F.md5("context").alias("context_md5"), "n_blocks", F.col("tokens").cast("bigint").alias("tokens"))


def _answers(s, d):
    return T(s, d, "eval_results").groupBy(F.col("result_id").alias("id")).agg(F.first("generated_answer").alias("answer"), F.first("context_chunks").alias("chunks"))


_CITED = "answers AS (SELECT result_id AS id, any_value(generated_answer) AS answer, any_value(context_chunks) AS chunks FROM eval_results GROUP BY result_id), cited AS (SELECT DISTINCT id, chunks, CAST(unnest(regexp_extract_all(answer, '\\[(\\d{1,9})\\]', 1)) AS INTEGER) AS n FROM answers), c AS (SELECT id, n, CASE WHEN n BETWEEN 1 AND coalesce(len(chunks), 0) THEN chunks[n] END AS chunk, n BETWEEN 1 AND coalesce(len(chunks), 0) AS known FROM cited)"


@query(f"WITH {_CITED} SELECT id, n, chunk, known FROM c")
def citations(s, d):
    return context.citations(_answers(s, d))


@query(f"WITH {_CITED} SELECT id, n FROM c WHERE NOT known")
def hallucinated_citations(s, d):
    return context.citations(_answers(s, d)).where(~F.col("known")).select("id", "n")


@query("SELECT result_id, NOT (" + " OR ".join(f"contains(lower(generated_answer), '{p}')" for p in context.UNGROUNDED) + ") AS grounded FROM (SELECT DISTINCT result_id, generated_answer FROM eval_results)")
def grounded_flag(s, d):
    return T(s, d, "eval_results").select("result_id", "generated_answer").distinct().select("result_id", context.grounded(F.col("generated_answer")).alias("grounded"))


@query(f"WITH {_CITED} SELECT id, count(DISTINCT chunk) AS n_sources, list_sort(list(DISTINCT chunk)) AS sources FROM c WHERE known AND chunk IS NOT NULL GROUP BY id")
def unique_sources(s, d):
    c = context.citations(_answers(s, d)).where(F.col("known") & F.col("chunk").isNotNull())
    return c.groupBy("id").agg(F.sort_array(F.collect_set("chunk")).alias("sources")).select("id", F.size("sources").cast("bigint").alias("n_sources"), "sources")


# ---- corrective loop ---------------------------------------------------------------------


@query("SELECT event_id, TRUE AS relevant, CAST(greatest(0.0, least(1.0, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10)) AS DOUBLE) AS score FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL")
def crag_parse_grade(s, d):
    raw = F.concat(F.lit('grade: {"score": '), (F.get_json_object("props", "$.k").try_cast("double") / 10).cast("string"), F.lit("}"))
    g = corrective.parse_grade(raw)
    return T(s, d, "events").where(F.get_json_object("props", "$.k").try_cast("double").isNotNull()).select("event_id", g.alias("g")).select("event_id", "g.relevant", "g.score")


def _grades(s, d):
    hits = _hits(s, d).join(_questions(s, d), "qid")
    return hits.select("qid", "chunk_id", "pos", corrective.grade_lexical(F.col("question"), F.col("text")).alias("relevant"))


_WORDSET = r"list_distinct(regexp_extract_all(lower({0}), '\w+'))"
_GRADES = f"{_HITS}, grades AS (SELECT qid, chunk_id, pos, coalesce(len(list_intersect({_WORDSET.format('question')}, {_WORDSET.format('text')})) / nullif(len({_WORDSET.format('question')}), 0) >= 0.3, FALSE) AS relevant FROM hits JOIN questions USING (qid))"
_ACTIONS = f"{_GRADES}, acts AS (SELECT *, CASE WHEN n_chunks = 0 THEN 'INCORRECT' WHEN relevance_ratio >= 0.6 THEN 'CORRECT' WHEN relevance_ratio <= 0.2 THEN 'INCORRECT' ELSE 'AMBIGUOUS' END AS action FROM (SELECT q.qid, count(g.chunk_id) AS n_chunks, count(*) FILTER (relevant) AS n_relevant, coalesce(round(count(*) FILTER (relevant) / nullif(count(g.chunk_id), 0), 6), 0.0) AS relevance_ratio FROM questions q LEFT JOIN grades g USING (qid) GROUP BY q.qid))"


@query(f"WITH {_ACTIONS} SELECT * FROM acts")
def crag_action(s, d):
    return corrective.actions(_questions(s, d), _grades(s, d))


@query(
    f"WITH {_ACTIONS}, web AS (SELECT q.qid, 'web:' || substr(md5('https://example.org/' || company), 1, 8) AS chunk_id, row_number() OVER (PARTITION BY q.qid ORDER BY c.ticker) AS pos FROM questions q JOIN companies c ON contains(question, company)), parts AS (SELECT g.qid, chunk_id, 0 AS part, pos FROM grades g JOIN acts USING (qid) WHERE action = 'CORRECT' OR (action = 'AMBIGUOUS' AND relevant) UNION ALL SELECT w.qid, chunk_id, 1, pos FROM web w JOIN acts USING (qid) WHERE action <> 'CORRECT') SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY part, pos, chunk_id) AS INTEGER) AS place FROM parts"
)
def crag_corrected_set(s, d):
    """The web provider stands in as a page of each company that the question names."""
    names = T(s, d, "companies").select(F.col("ticker").alias("t"), "company", F.lower(F.substring_index("company", " ", 1)).alias("w"))
    said = _questions(s, d).select("qid", "question", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"(\w+)"), F.lit(1)))).alias("w"))
    web = said.join(names, "w").where(F.contains("question", F.col("company"))).select("qid", corrective.web_id(F.concat(F.lit("https://example.org/"), "company")).alias("chunk_id"), F.row_number().over(Window.partitionBy("qid").orderBy("t")).alias("pos"))
    g = cut(_grades(s, d))  # asked for twice, searched once
    return corrective.corrected(g, web, corrective.actions(_questions(s, d), g))


@query("SELECT ticker, 'web:' || substr(md5('https://example.org/' || company), 1, 8) AS chunk_id FROM companies")
def web_chunk_id(s, d):
    return T(s, d, "companies").select("ticker", corrective.web_id(F.concat(F.lit("https://example.org/"), "company")).alias("chunk_id"))


# ---- evaluation --------------------------------------------------------------------------


def _scores(s, d):
    r = T(s, d, "eval_results").dropDuplicates(["result_id"])
    one = lambda m, c: F.struct(F.lit(m).alias("metric"), c.alias("score"))
    recall = evaluation.overlap(F.col("ground_truth"), F.col("generated_answer"))
    relevance = evaluation.overlap(F.col("question"), F.col("generated_answer"))
    return r.select("run", "result_id", "sample_id", F.coalesce("pipeline_failed", F.lit(False)).alias("failed"), F.inline(F.array(one("recall", recall), one("relevance", relevance), one("latency", F.round("latency_seconds", 6)))))


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN round(len(list_intersect({_WORDSET.format(a)}, {_WORDSET.format(b)})) / nullif(len({_WORDSET.format(a)}), 0), 6) END"


_SCORES = f"""r AS (SELECT DISTINCT ON (result_id) * FROM eval_results), scores AS (
    SELECT run, result_id, sample_id, coalesce(pipeline_failed, FALSE) AS failed, 'recall' AS metric, {_share('ground_truth', 'generated_answer')} AS score FROM r
    UNION ALL SELECT run, result_id, sample_id, coalesce(pipeline_failed, FALSE), 'relevance', {_share('question', 'generated_answer')} FROM r
    UNION ALL SELECT run, result_id, sample_id, coalesce(pipeline_failed, FALSE), 'latency', round(latency_seconds, 6) FROM r)"""


@query(f"WITH {_SCORES} SELECT run, result_id, sample_id, failed, metric, score FROM scores")
def eval_long(s, d):
    return _scores(s, d)


@query(f"WITH {_SCORES} SELECT run, metric, round(coalesce(avg(score) FILTER (NOT failed), 0.0), 6) AS mean, count(score) FILTER (NOT failed) AS n FROM scores GROUP BY run, metric")
def eval_metric_avg(s, d):
    return evaluation.metric_averages(_scores(s, d))


@query("WITH r AS (SELECT DISTINCT ON (result_id) * FROM eval_results) SELECT run, count(*) AS n, count(*) FILTER (coalesce(pipeline_failed, FALSE)) AS n_failed, round(count(*) FILTER (NOT coalesce(pipeline_failed, FALSE)) / count(*), 6) AS pass_rate FROM r GROUP BY run")
def eval_pass_rate(s, d):
    return evaluation.pass_rate(T(s, d, "eval_results").dropDuplicates(["result_id"]))


@query()
def bootstrap_ci(s, d):
    """Rows only: random draws; the tests check bounds and coverage."""
    return evaluation.bootstrap(_scores(s, d).withColumn("sample_id", F.col("result_id")))


def _runs(s, d):
    return T(s, d, "eval_results").agg(F.min("run"), F.max("run")).first()


_PAIRS = f"{_SCORES}, ends AS (SELECT min(run) AS a, max(run) AS b FROM eval_results), side AS (SELECT run, metric, sample_id, avg(score) AS x FROM scores WHERE score IS NOT NULL AND sample_id IS NOT NULL GROUP BY ALL), pairs AS (SELECT p.metric, p.sample_id, p.x, q.x AS y FROM side p JOIN side q USING (metric, sample_id), ends WHERE p.run = a AND q.run = b)"


@query(f"WITH {_PAIRS} SELECT metric, count(*) AS n, round(avg(x - y), 6) AS mean_diff, round(CASE WHEN stddev_samp(x - y) > 1e-12 THEN avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))) END, 6) AS t_stat FROM pairs GROUP BY metric HAVING count(*) >= 2")
def paired_ttest(s, d):
    a, b = _runs(s, d)
    return evaluation.paired_t(_scores(s, d), a, b).drop("p_value")


@query(
    f"WITH {_PAIRS}, df AS (SELECT metric, round(x - y, 9) AS d FROM pairs WHERE round(x - y, 9) <> 0), rk AS (SELECT metric, d, avg(rn) OVER (PARTITION BY metric, abs(d)) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(d)) AS rn FROM df)) SELECT metric, count(*) AS n, round(coalesce(sum(rank) FILTER (d > 0), 0), 6) AS w_plus, round(coalesce(sum(rank) FILTER (d < 0), 0), 6) AS w_minus FROM rk GROUP BY metric"
)
def wilcoxon_ranks(s, d):
    a, b = _runs(s, d)
    return evaluation.signed_ranks(_scores(s, d), a, b).withColumn("n", F.col("n").cast("bigint")).drop("ties")


_STEPS = "range(0, 20001)"
# p of t: the integral of cos(x) ** (df - 1) beyond atan(t / sqrt(df)); of Wilcoxon: ways to each rank sum, or the integral of the normal density
_COMPARED = f"""t AS (SELECT metric, count(*) AS n, avg(x - y) AS m, CASE WHEN stddev_samp(x - y) > 1e-12 THEN avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))) END AS t FROM pairs GROUP BY metric HAVING count(*) >= 2),
    tp AS (SELECT *, CASE WHEN t IS NULL THEN 1.0 ELSE simpson(atan(abs(t) / sqrt(n - 1)), pi() / 2, n - 2) / simpson(0.0, pi() / 2, n - 2) END AS p FROM t),
    df AS (SELECT metric, round(x - y, 9) AS d FROM pairs WHERE round(x - y, 9) <> 0),
    rk AS (SELECT metric, d, avg(rn) OVER (PARTITION BY metric, abs(d)) AS rank, count(*) OVER (PARTITION BY metric, abs(d)) AS c FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(d)) AS rn FROM df)),
    w AS (SELECT metric, count(*) AS n, round(coalesce(sum(rank) FILTER (d > 0), 0), 6) AS w_plus, round(coalesce(sum(rank) FILTER (d < 0), 0), 6) AS w_minus, sum(c * c - 1) AS ties FROM rk GROUP BY metric),
    ways(metric, n, r, counts) AS (SELECT metric, n, 0, list_transform(range(0, n * (n + 1) // 2 + 1), lambda s: CASE WHEN s = 0 THEN 1::BIGINT ELSE 0::BIGINT END) FROM w WHERE n <= {evaluation.EXACT} AND ties = 0
      UNION ALL SELECT metric, n, r + 1, list_transform(counts, lambda x, s: x + CASE WHEN s > r + 1 THEN counts[s - r - 1] ELSE 0 END) FROM ways WHERE r < n),
    wp AS (SELECT w.*, CASE WHEN counts IS NOT NULL THEN least(1.0, 2 * list_sum(counts[1 : CAST(floor(least(w_plus, w_minus)) AS BIGINT) + 1]) / pow(2, w.n))
      ELSE 1 - 2 * normal(abs(least(w_plus, w_minus) - w.n * (w.n + 1) / 4) / sqrt((w.n * (w.n + 1) * (2 * w.n + 1) - ties / 2) / 24)) END AS p FROM w LEFT JOIN ways ON ways.metric = w.metric AND ways.r = ways.n)"""


def _macros(sql: str) -> str:
    """Simpson sums spelled out: the SQL is one statement."""
    import re

    weight = "CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    simpson = r"(list_sum(list_transform(range(0, 20001), lambda i: " + weight + r" * pow(cos(least(\1 + (\2 - (\1)) * i / 20000, pi() / 2)), \3))) * (\2 - (\1)) / 60000)"
    sql = re.sub(r"simpson\(((?:[^(),]|\((?:[^()]|\([^()]*\))*\))*), ((?:[^(),]|\([^()]*\))*), ([^(),]*)\)", simpson, sql)
    at = sql.index("normal(")
    depth, end = 1, at + len("normal(")
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    z = sql[at + len("normal(") : end - 1]
    return sql[:at] + f"(list_sum(list_transform(range(0, 20001), lambda i: {weight} * exp(-pow(({z}) * i / 20000, 2) / 2))) * ({z}) / 60000 / sqrt(2 * pi()))" + sql[end:]


@query(_macros(f"WITH RECURSIVE {_PAIRS}, {_COMPARED} SELECT metric, tp.n, round(m, 6) AS mean_diff, round(t, 6) AS t_stat, round(tp.p, 6) AS t_p, coalesce(w_plus, 0.0) AS w_plus, coalesce(w_minus, 0.0) AS w_minus, round(coalesce(wp.p, 1.0), 6) AS wilcoxon_p FROM tp LEFT JOIN wp USING (metric)"))
def compare_models(s, d):
    """Both tests with their p-values; the SQL integrates the distributions."""
    a, b = _runs(s, d)
    return evaluation.compare_models(_scores(s, d), a, b)


@query(f"WITH {_SCORES}, m AS (SELECT run, metric, round(coalesce(avg(score) FILTER (NOT failed), 0.0), 6) AS mean, count(score) FILTER (NOT failed) AS n FROM scores GROUP BY run, metric) SELECT metric, string_agg(run || '=' || printf('%.4f', mean), ' ' ORDER BY run) AS arms, arg_max(run, mean) AS winner FROM m GROUP BY metric")
def ablation_table(s, d):
    return evaluation.best_arm(evaluation.metric_averages(_scores(s, d)))


@query(f"WITH {_SCORES} SELECT run, metric, round(round(coalesce(avg(score) FILTER (NOT failed), 0.0), 6), 4) AS mean, count(score) FILTER (NOT failed) AS n FROM scores GROUP BY run, metric")
def experiment_report(s, d):
    """Written as JSON and read again."""
    at = os.path.join(shared_folder(s), "reports", uuid.uuid4().hex)
    files.write_experiment(evaluation.metric_averages(_scores(s, d)), at)
    return files.read_experiment(s, at)


@query(f"WITH {_SCORES}, g AS (SELECT run, metric, avg(score) AS m, stddev_samp(score) AS sd, count(*) AS n FROM scores WHERE NOT failed AND score IS NOT NULL GROUP BY run, metric) SELECT run, metric, TRUE AS holds_mean, TRUE AS as_wide FROM g WHERE n >= 30 AND sd > 0")
def bootstrap_bounds(s, d):
    """Intervals hold the mean, and are as wide as the spread lets expect, give or take a quarter."""
    scores = _scores(s, d).withColumn("sample_id", F.col("result_id"))
    ok = scores.where(~F.col("failed") & F.col("score").isNotNull()).groupBy("run", "metric").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"), F.count("*").alias("n")).where((F.col("n") >= 30) & (F.col("sd") > 0))
    wide = (F.col("hi") - F.col("lo")) / (2 * 1.96 * F.col("sd") / F.sqrt("n"))
    return evaluation.bootstrap(scores).join(ok, ["run", "metric"]).select("run", "metric", F.col("m").between(F.col("lo"), F.col("hi")).alias("holds_mean"), wide.between(0.75, 1.25).alias("as_wide"))


@query(f"WITH {_SCORES}, ends AS (SELECT min(run) AS a, max(run) AS b FROM eval_results) SELECT metric, round(avg(score) FILTER (run = a), 6) AS first_arm, round(avg(score) FILTER (run = b), 6) AS last_arm FROM scores, ends WHERE NOT failed AND score IS NOT NULL GROUP BY metric")
def experiment_pivot(s, d):
    a, b = _runs(s, d)
    return evaluation.by_arm(_scores(s, d), [a, b]).select("metric", F.col(f"`{a}`").alias("first_arm"), F.col(f"`{b}`").alias("last_arm"))


@query(f"WITH {_SCORES}, ends AS (SELECT min(run) AS a, max(run) AS b FROM eval_results), p AS (SELECT metric, round(avg(score) FILTER (run = a), 6) AS x, round(avg(score) FILTER (run = b), 6) AS y FROM scores, ends WHERE NOT failed AND score IS NOT NULL GROUP BY metric) SELECT metric, round(y - x, 6) AS delta, CASE WHEN abs(round(y - x, 6)) < 0.01 THEN 'tie' WHEN y > x THEN b ELSE a END AS winner FROM p, ends")
def experiment_winner(s, d):
    a, b = _runs(s, d)
    return evaluation.winner(evaluation.by_arm(_scores(s, d), [a, b]), a, b)


@query("SELECT a.sample_id, a.ticker IS DISTINCT FROM b.ticker AS ticker_differs, a.year IS DISTINCT FROM b.year AS year_differs FROM (SELECT DISTINCT * FROM eval_samples) a JOIN (SELECT DISTINCT * FROM eval_samples) b ON a.sample_id = b.sample_id AND a.created_at <= b.created_at")
def config_diff(s, d):
    """Null-safe difference of the fields of two versions of one key."""
    x = T(s, d, "eval_samples").distinct()
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("a.created_at") <= F.col("b.created_at"))).select(F.col("a.sample_id").alias("sample_id"), *[(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_differs") for c in ("ticker", "year")])


@query("SELECT DISTINCT question, substr(sha256(question), 1, 12) AS sample_key FROM eval_samples WHERE ticker = 'QVRN'")
def sample_id_hash(s, d):
    return T(s, d, "eval_samples").where("ticker = 'QVRN'").select("question", F.substring(F.sha2("question", 256), 1, 12).alias("sample_key")).distinct()


# ---- observability -------------------------------------------------------------------------


def _calls(s, d):
    return T(s, d, "events").select(F.col("user_id").alias("trace_id"), F.col("user_id").alias("session"), F.col("event_type").alias("layer"), "event_type", "value", (F.col("value") / 100).alias("cost"), "ts", "event_id")


@query("SELECT user_id AS trace_id, count(*) AS n_calls, round(sum(value), 6) AS total, round(max(value), 6) AS largest, CASE WHEN bool_or(event_type = 'error') THEN 'DEGRADED' ELSE 'OK' END AS status FROM events GROUP BY user_id")
def trace_totals(s, d):
    return observe.totals(_calls(s, d), F.col("layer") == "error")


@query("SELECT user_id AS trace_id, coalesce(event_type, 'unknown') AS layer, round(sum(value), 6) AS latency FROM events GROUP BY ALL")
def latency_breakdown(s, d):
    return observe.breakdown(_calls(s, d)).select("trace_id", F.explode("parts").alias("layer", "latency"))


@query("SELECT coalesce(event_type, 'unknown') AS layer, count(*) AS n, round(sum(value) / 100, 6) AS cost, count(DISTINCT user_id) AS sessions FROM events GROUP BY ALL")
def cost_breakdown(s, d):
    return _calls(s, d).groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("n"), F.round(F.sum("value") / 100, 6).alias("cost"), F.countDistinct("session").alias("sessions"))


@query("SELECT run, coalesce(lang_hint, 'unknown') AS source, count(*) AS n, greatest(coalesce(max(latency_seconds), 0.0), 0.0) AS most FROM eval_results GROUP BY ALL")
def source_distribution(s, d):
    return T(s, d, "eval_results").groupBy("run", F.coalesce("lang_hint", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.max("latency_seconds"), F.lit(0.0)), F.lit(0.0)).alias("most"))


_SESSION = "SELECT user_id AS session, event_id, value / 100 AS cost, sum(value / 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events"


@query(f"SELECT session, event_id, cost, round(run, 6) AS running FROM ({_SESSION})")
def session_cost_running(s, d):
    return observe.session_costs(_calls(s, d), 5.0).drop("alert")


@query(f"SELECT session, event_id FROM ({_SESSION}) WHERE run > 5.0 AND run - cost <= 5.0")
def session_alert_once(s, d):
    return observe.session_costs(_calls(s, d), 5.0).where("alert").select("session", "event_id")


@query("SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def prom_counter(s, d):
    return T(s, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '/other' END AS label, count(*) AS n FROM events GROUP BY ALL")
def prom_labels(s, d):
    """Event types stand in for paths."""
    return T(s, d, "events").groupBy(observe.route_label(F.col("event_type"), ["click", "view"]).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS session, event_id FROM events WHERE value / 100 > 1.0")
def call_alerts(s, d):
    return observe.over_limit(_calls(s, d), 1.0).select("session", "event_id")


_BOUNDS = (5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0)


@query(
    "WITH e AS (SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, " + ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(_BOUNDS)) + " FROM events GROUP BY event_type) " + " UNION ALL ".join(f"SELECT event_type, n, total, '{b}' AS le, b{i} AS cumulative FROM e" for i, b in enumerate(_BOUNDS)) + " UNION ALL SELECT event_type, n, total, '+Inf', n FROM e"
)
def prom_histogram(s, d):
    return observe.histogram(T(s, d, "events").select("event_type", "value"), ["event_type"], _BOUNDS)


def _quantile_sql(q: float) -> str:
    cases = []
    for i, b in enumerate(_BOUNDS):
        low, below = (_BOUNDS[i - 1], f"b{i - 1}") if i else (0.0, "0")
        cases.append(f"WHEN b{i} >= n * {q}::DOUBLE THEN coalesce({low}::DOUBLE + ({b}::DOUBLE - {low}::DOUBLE) * (n * {q}::DOUBLE - {below}) / nullif(b{i} - {below}, 0), {low}::DOUBLE)")
    return f"SELECT event_type, round(CASE {' '.join(cases)} ELSE {_BOUNDS[-1]}::DOUBLE END, 6) AS quantile FROM (SELECT event_type, count(value) AS n, " + ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(_BOUNDS)) + " FROM events GROUP BY event_type) WHERE n > 0"


@query(_quantile_sql(0.95))
def histogram_quantile(s, d):
    return observe.quantile(T(s, d, "events").select("event_type", "value"), ["event_type"], 0.95, _BOUNDS)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.05 AS alert FROM events GROUP BY 1")
def alert_ratio(s, d):
    bad = F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    return T(s, d, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.round(bad, 6).alias("error_rate"), (bad > 0.05).alias("alert"))


@query("SELECT doc_id, filed_on, ticker FROM documents WHERE filed_on IS NOT NULL ORDER BY filed_on DESC, doc_id LIMIT 50")
def trace_source_latest(s, d):
    return T(s, d, "documents").where(F.col("filed_on").isNotNull()).select("doc_id", "filed_on", "ticker").orderBy(F.desc("filed_on"), "doc_id").limit(50)


# ---- validation and display ------------------------------------------------------------------


@query("SELECT DISTINCT sample_id, upper(trim(ticker)) IN (SELECT ticker FROM companies) AS known_ticker, coalesce(year BETWEEN 2020 AND 2030, FALSE) AS valid_year, coalesce(upper(trim(quarter)) IN ('Q1', 'Q2', 'Q3', 'Q4'), FALSE) AS valid_quarter, CASE WHEN question IS NULL OR length(trim(question)) < 3 THEN 'too short' WHEN length(trim(question)) > 2000 THEN 'too long' ELSE 'ok' END AS question_check FROM eval_samples WHERE ticker IS NOT NULL")
def request_validation(s, d):
    known = T(s, d, "companies").select(F.col("ticker").alias("k")).distinct()
    x = T(s, d, "eval_samples").where(F.col("ticker").isNotNull()).join(known, F.upper(F.trim("ticker")) == F.col("k"), "left")
    return x.select("sample_id", F.col("k").isNotNull().alias("known_ticker"), F.coalesce(F.col("year").between(2020, 2030), F.lit(False)).alias("valid_year"), F.coalesce(F.upper(F.trim("quarter")).isin("Q1", "Q2", "Q3", "Q4"), F.lit(False)).alias("valid_quarter"), ingest.valid_question(F.col("question")).alias("question_check")).distinct()


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def sse_parse(s, d):
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("data: "), "props")).otherwise(F.concat(F.lit(": "), "props"))
    return T(s, d, "events").select("event_id", F.get_json_object(ingest.sse(line), "$.k").try_cast("bigint").alias("k"))


@query("SELECT event_id, CASE WHEN event_id < 1000 THEN CAST(event_id AS VARCHAR) ELSE printf('%.1f', round(event_id / 1000, 1)) || 'K' END AS shown FROM events")
def display_format(s, d):
    return T(s, d, "events").select("event_id", ingest.count_label(F.col("event_id")).alias("shown"))


@query("SELECT chunk_id, ingested_at, ticker || ' ' || fiscal_period || ' — ' || CASE WHEN coalesce(section_title, '') = '' THEN 'General' ELSE substr(section_title, 1, 50) END AS label FROM chunks")
def citation_label(s, d):
    label = render.citation_label(F.col("ticker"), F.col("fiscal_period"), F.col("section_title"))
    return T(s, d, "chunks").select("chunk_id", "ingested_at", label.alias("label"))


# ---- event time ----------------------------------------------------------------------------------


def _events(s, d):
    return T(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def window_tumbling(s, d):
    return windows.windowed(_events(s, d), "1 hour")


@query("WITH e AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS start FROM events, range(0, 2) t(i)) SELECT start, start + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY ALL")
def window_sliding(s, d):
    return windows.windowed(_events(s, d), "1 hour", "30 minutes")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), v AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM v GROUP BY user_id, visit")
def window_session(s, d):
    return windows.sessions(_events(s, d), "2 hours")


@query("WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL) SELECT * FROM w WHERE epoch_ms(\"end\") <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)")
def stream_available_now(s, d):
    """The tumbling windows from a file stream that is run to its end into files: those that the watermark has closed."""
    at = os.path.join(shared_folder(s), "streams", uuid.uuid4().hex)
    stream = windows.read_events(s, os.path.join(os.path.abspath(d), "events.parquet"), 1000)
    windows.run_once(windows.windowed(stream, "1 hour"), os.path.join(at, "out"), os.path.join(at, "checkpoint"))
    return s.read.parquet(os.path.join(at, "out"))


# ---- providers' outputs and rendering ------------------------------------------------------------


@query("SELECT DISTINCT result_id, coalesce(generated_answer, '') || CASE WHEN coalesce(len(context_chunks), 0) > 0 THEN chr(10) || chr(10) || 'Sources:' || chr(10) || array_to_string(list_transform(context_chunks, lambda x, i: '[' || i || '] ' || x), chr(10)) ELSE '' END AS shown FROM eval_results WHERE context_chunks IS NULL OR NOT list_contains(list_transform(context_chunks, lambda x: x IS NULL), TRUE)")
def answer_with_sources(s, d):
    r = T(s, d, "eval_results").where(F.col("context_chunks").isNull() | ~F.exists("context_chunks", lambda x: x.isNull()))
    return r.select("result_id", render.answer_with_sources(F.col("generated_answer"), F.col("context_chunks")).alias("shown")).distinct()


@query("SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"n\":' || event_id || '}' AS body FROM events WHERE event_type IS NOT NULL")
def response_json(s, d):
    return T(s, d, "events").where(F.col("event_type").isNotNull()).select("event_id", render.response_json(event_type=F.col("event_type"), n=F.col("event_id")).alias("body"))


@query("SELECT user_id, CASE WHEN max(CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'error' THEN 2 ELSE 1 END) = 2 THEN 'unhealthy' WHEN max(CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'error' THEN 2 ELSE 1 END) = 1 THEN 'degraded' ELSE 'healthy' END AS state FROM events GROUP BY user_id")
def health_fold(s, d):
    state = F.when(F.col("event_type") == "view", "healthy").when(F.col("event_type") == "error", "unhealthy").otherwise("degraded")
    return render.worst_state(T(s, d, "events").select("user_id", state.alias("state")), "user_id")


@query("SELECT run, repeat('█', CAST(floor(rate * 20 + 0.5) AS INTEGER)) AS bar FROM (SELECT run, count(*) FILTER (NOT coalesce(pipeline_failed, FALSE)) / count(*) AS rate FROM (SELECT DISTINCT ON (result_id) * FROM eval_results) GROUP BY run)")
def summary_bars(s, d):
    r = evaluation.pass_rate(T(s, d, "eval_results").dropDuplicates(["result_id"]))
    return r.select("run", render.bar((F.col("n") - F.col("n_failed")) / F.col("n")).alias("bar"))


@query("SELECT DISTINCT result_id, nullif(substr(trim(error_message), 1, 64), '') AS request_id FROM eval_results")
def request_id(s, d):
    return T(s, d, "eval_results").select("result_id", render.request_id(F.col("error_message")).alias("request_id")).distinct()


@query("SELECT event_id, 'AMBIGUOUS' AS intent, CAST(0.5 AS DOUBLE) AS confidence FROM events")
def router_parse_fallback(s, d):
    """The props of events are JSON, but no decision: every row falls back."""
    return T(s, d, "events").select("event_id", router.parse_decision(F.col("props")).alias("x")).select("event_id", "x.intent", "x.confidence")


@query(f"WITH {_QUESTIONS}, outs AS (SELECT sample_id AS qid, 'hyde' AS kind, min(ground_truth) AS output FROM eval_samples GROUP BY sample_id), k AS (SELECT unnest(['hyde', 'multi', 'stepback']) AS kind) SELECT q.qid, k.kind, coalesce(output, question) AS variant, output IS NULL AS failed FROM questions q CROSS JOIN k LEFT JOIN outs o ON o.qid = q.qid AND o.kind = k.kind WHERE trim(question) <> ''")
def transform_fallback(s, d):
    outs = T(s, d, "eval_samples").groupBy(F.col("sample_id").alias("qid")).agg(F.min("ground_truth").alias("output")).withColumn("kind", F.lit("hyde"))
    return router.transformed(_questions(s, d), outs)


@query(f"WITH {_QUESTIONS}, pages AS (SELECT ticker AS topic, chunk_id AS url, any_value(section_title) AS title, max(text) AS snippet FROM chunks WHERE chunk_type = 'table' GROUP BY ticker, chunk_id), asked AS (SELECT sample_id AS qid, min(ticker) AS topic FROM eval_samples WHERE ticker IS NOT NULL GROUP BY sample_id), b AS (SELECT qid, url, row_number() OVER (PARTITION BY qid ORDER BY url) AS pos FROM asked JOIN pages USING (topic) WHERE trim(coalesce(snippet, '')) <> '') SELECT qid, CAST(pos AS INTEGER) AS pos, 'web:' || substr(md5(url), 1, 8) AS chunk_id FROM b WHERE pos <= 4")
def web_search_table(s, d):
    pages = T(s, d, "chunks").where("chunk_type = 'table'").groupBy(F.col("ticker").alias("topic"), F.col("chunk_id").alias("url")).agg(F.max("section_title").alias("title"), F.max("text").alias("snippet")).withColumn("score", F.lit(None).cast("double"))
    asked = T(s, d, "eval_samples").where(F.col("ticker").isNotNull()).groupBy(F.col("sample_id").alias("qid")).agg(F.min("ticker").alias("topic"))
    return corrective.web_search(asked, pages).select("qid", "pos", "chunk_id")


@query("SELECT DISTINCT sample_id, question FROM eval_samples WHERE ticker = 'QVRN'")
def dataset_slice(s, d):
    return T(s, d, "eval_samples").where(retrieval.metadata_filter(ticker="QVRN")).select("sample_id", "question").distinct()


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\\S+')) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def hashed_embedding(s, d):
    """The norms only: the engines hash differently."""
    v = retrieval.hashed_vectors(_docs(s, d).select("id", "text"))
    return v.select(F.col("id").alias("doc_id"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query(f"WITH {_QUESTIONS} SELECT qid, len(regexp_extract_all(question, '\\S+')) = 0 AS retrieval_failed, len(regexp_extract_all(question, '\\S+')) > 0 AS has_chunks FROM questions")
def ask_outcome(s, d):
    """Of the whole chain: a question with a word has hits."""
    return ask_batch(s, d).select("qid", "retrieval_failed", (F.size("chunks") > 0).alias("has_chunks"))


@query()
def ask_batch(s, d):
    """Rows only: the whole chain with the default providers."""
    return pipeline.ask(_questions(s, d), _children(s, d), T(s, d, "chunks"), _index(s, d, "children"), T(s, d, "entities"), T(s, d, "relationships"), pipeline.Settings(dense_k=10))


@query(f"WITH {_SCORES} SELECT run, sample_id, metric, round(score, 4) AS score, failed FROM scores")
def report_rows(s, d):
    return files.report(_scores(s, d).withColumn("question", F.lit(None).cast("string"))).drop("question")


@query("SELECT e.event_id, e.event_type, o.o_orderkey AS last_order FROM events e ASOF LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def asof_join(s, d):
    """Extension: the latest order of a customer at each event, by one union and one window."""
    ev = T(s, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(1).alias("side"), "event_id", "event_type", F.lit(None).cast("bigint").alias("o"))
    od = T(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("t", "side", "o").rowsBetween(Window.unboundedPreceding, 0)
    return ev.unionByName(od).withColumn("last_order", F.last("o", ignorenulls=True).over(w)).where("side = 1").select("event_id", "event_type", "last_order")


# ---- references and units -------------------------------------------------------------------------


def _references(s, d):
    return orphans.probe(T(s, d, "relationships"), T(s, d, "entities"), T(s, d, "chunks"))


_ORPHANS = f"""refs AS (
  SELECT rel_id, 'source' AS ref_field, 'entities' AS ref_table, ticker AS scope, {fold_sql("source")} AS key, extracted_at, fiscal_period FROM relationships
  UNION ALL SELECT rel_id, 'target', 'entities', ticker, {fold_sql("target")}, extracted_at, fiscal_period FROM relationships
  UNION ALL SELECT rel_id, 'chunk_id', 'chunks', '', chunk_id, extracted_at, fiscal_period FROM relationships
), parents AS (
  SELECT 'entities' AS ref_table, ticker AS scope, {fold_sql("name")} AS key, extracted_at AS seen_at, deleted_at FROM entities
  UNION ALL SELECT 'chunks', '', chunk_id, ingested_at, deleted_at FROM chunks
), facts AS (
  SELECT ref_table, scope, key, bool_or(deleted_at IS NULL) AS any_live, bool_or(deleted_at IS NULL AND seen_at IS NULL) AS timeless,
    min(CASE WHEN deleted_at IS NULL THEN seen_at END) AS first_live
  FROM parents GROUP BY ALL
), orphans AS (
  SELECT rel_id, ref_field, refs.ref_table, fiscal_period,
    CASE WHEN any_live IS NULL THEN 'missing' WHEN NOT any_live THEN 'deleted' WHEN NOT timeless AND first_live > extracted_at THEN 'late' END AS state
  FROM refs LEFT JOIN facts ON refs.ref_table = facts.ref_table AND refs.scope = facts.scope AND refs.key = facts.key
  WHERE refs.key IS NOT NULL AND trim(refs.key) <> ''
)"""


@query(f"WITH {_ORPHANS} SELECT rel_id, ref_field, state FROM orphans WHERE state IS NOT NULL")
def p2_found(s, d):
    """The stored state after three deltas, which resolve and reopen what came before."""
    store = orphans.OrphanStore(s, os.path.join(shared_folder(s), "orphans", uuid.uuid4().hex), once=False)
    known = orphans.found(T(s, d, "relationships"), T(s, d, "entities"), T(s, d, "chunks"), store)
    return orphans.orphans(known).select("rel_id", "ref_field", "state")


@query(f"WITH {_ORPHANS} SELECT ref_table, fiscal_period, state, count(*) AS n_orphans FROM orphans WHERE state IS NOT NULL GROUP BY ALL")
def p2_counts(s, d):
    return orphans.counts(_references(s, d))


_STEP = "greatest(1, ((epoch_us({0}) - lo) * 10 + (hi - lo - 1)) // (hi - lo))"
_REPLAY = f"""r AS (
  SELECT rel_id, unnest([{{'f': 'source', 't': 'entities', 's': coalesce(ticker, ''), 'k': {fold_sql("source")}}}, {{'f': 'target', 't': 'entities', 's': coalesce(ticker, ''), 'k': {fold_sql("target")}}}, {{'f': 'chunk_id', 't': 'chunks', 's': '', 'k': chunk_id}}]) AS x, extracted_at, fiscal_period FROM relationships
), p AS (
  SELECT 'entities' AS t, ticker AS s, {fold_sql("name")} AS k, extracted_at AS seen_at, deleted_at FROM entities WHERE name IS NOT NULL AND ticker IS NOT NULL
  UNION ALL SELECT 'chunks', '', chunk_id, ingested_at, deleted_at FROM chunks WHERE chunk_id IS NOT NULL
), ends AS (
  SELECT min(epoch_us(x)) AS lo, max(epoch_us(x)) AS hi FROM (SELECT extracted_at AS x FROM r WHERE x.k IS NOT NULL AND trim(x.k) <> '' UNION ALL SELECT seen_at FROM p UNION ALL SELECT deleted_at FROM p WHERE deleted_at > seen_at OR seen_at IS NULL)
), steps AS (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS step
), rs AS (SELECT r.*, coalesce({_STEP.format("extracted_at")}, 1) AS came FROM r, ends WHERE x.k IS NOT NULL AND trim(x.k) <> ''
), ps AS (SELECT p.*, coalesce({_STEP.format("seen_at")}, 1) AS came, CASE WHEN deleted_at IS NOT NULL THEN {_STEP.format("deleted_at")} END AS went FROM p, ends
), facts AS (
  SELECT step, t, s, k, bool_or(went IS NULL OR went > step) AS any_live, bool_or((went IS NULL OR went > step) AND seen_at IS NULL) AS timeless, min(CASE WHEN went IS NULL OR went > step THEN seen_at END) AS first_live
  FROM ps JOIN steps ON came <= step GROUP BY ALL
), known AS (
  SELECT steps.step, rs.x.t AS ref_table, fiscal_period, CASE WHEN any_live IS NULL THEN 'missing' WHEN NOT any_live THEN 'deleted' WHEN NOT timeless AND first_live > extracted_at THEN 'late' END AS state
  FROM rs JOIN steps ON came <= step LEFT JOIN facts ON facts.step = steps.step AND facts.t = rs.x.t AND facts.s = rs.x.s AND facts.k = rs.x.k
)"""


@query(f"WITH {_REPLAY} SELECT step, ref_table, fiscal_period, state, count(*) AS n_orphans FROM known WHERE state IS NOT NULL GROUP BY ALL")
def p2_incremental(s, d):
    """The tables in ten deltas of equal time through a store, with withdrawals, and the counts after each."""
    store = orphans.OrphanStore(s, os.path.join(shared_folder(s), "orphans", uuid.uuid4().hex))
    return orphans.replay(T(s, d, "relationships"), T(s, d, "entities"), T(s, d, "chunks"), store)


@query()
def p5_found(s, d):
    """Rows only: a grammar; the tests hold it against amounts written by hand."""
    return units.amounts(T(s, d, "entities"), T(s, d, "relationships"), T(s, d, "chunks"), T(s, d, "common_units"))
