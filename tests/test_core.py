"""Small expected values and invariants of the core operators."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as X
from quarrylight.operators import chunking, context, corrective, evaluation, graph, ingest, observe, retrieval, router


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_uuid5(spark):
    assert one(spark, X.uuid5(F.lit("AAPL:2024-10-31"))) == "edf33449-fd16-5072-933f-dbd6f2ac17ec"


def test_rrf(spark):
    rows = lambda ids: spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(ids)], "qid string, id string, rank int")
    out = {r.id: (r.rrf_score, r.source) for r in retrieval.fuse([("dense", rows("ab")), ("bm25", rows("ac"))]).collect()}
    assert out == {"a": (0.032787, "both"), "b": (0.016129, "dense"), "c": (0.016129, "bm25")}


def test_bm25_nulls_and_filter(spark):
    corpus = spark.createDataFrame([(1, "alpha beta", "A"), (2, "alpha gamma gamma", "B"), (3, None, "A"), (4, "", "A"), (5, "delta", "A")], "id int, text string, ticker string")
    q = spark.createDataFrame([("q", "gamma alpha"), ("z", None)], "qid string, question string")
    got = [(r.qid, r.id) for r in retrieval.top_k(retrieval.bm25(q, corpus), 5).orderBy("rank").collect()]
    assert got == [("q", 2), ("q", 1)]
    assert [r.id for r in retrieval.bm25(q, corpus, F.col("ticker") == "A").collect()] == [1]


@pytest.mark.parametrize("n", range(1, 8))
def test_valley(spark, n):
    hits = spark.createDataFrame([("q", i + 1) for i in range(n)], "qid string, pos int")
    got = [r.pos for r in context.valley(hits).orderBy("slot").collect()]
    assert got == [*range(1, n + 1, 2), *reversed(range(2, n + 1, 2))]


def test_budget_cuts_first_block(spark):
    b = spark.createDataFrame([("q", 1, "a b c d e"), ("q", 2, "f")], "qid string, slot int, block string")
    assert [(r.slot, r.tokens) for r in context.within_budget(b, 3).collect()] == [(1, 3)]
    assert context.within_budget(b, 6).count() == 2


@pytest.mark.parametrize("n,hit,action", [(5, 3, "CORRECT"), (5, 1, "INCORRECT"), (5, 2, "AMBIGUOUS"), (0, 0, "INCORRECT")])
def test_actions(spark, n, hit, action):
    q = spark.createDataFrame([("q",)], "qid string")
    g = spark.createDataFrame([("q", i < hit) for i in range(n)], "qid string, relevant boolean")
    assert corrective.actions(q, g).first()["action"] == action


def test_parse_grade(spark):
    raw = spark.createDataFrame([('{"relevant": false, "score": 7, "reasoning": "x"}',), ('so: {"score": 0.3}',), ("nothing",), (None,)], "raw string")
    assert [(r.g.relevant, r.g.score) for r in raw.select(corrective.parse_grade(F.col("raw")).alias("g")).collect()] == [(False, 1.0), (True, 0.3), (True, 0.5), (True, 0.5)]


def test_statistics(spark):
    a, b = [0.9, 0.8, 0.95, 0.85, 0.9], [0.5, 0.4, 0.6, 0.45, 0.55]
    rows = [(run, str(i), "m", x, False) for run, xs in (("a", a), ("b", b)) for i, x in enumerate(xs)]
    s = spark.createDataFrame(rows, "run string, sample_id string, metric string, score double, failed boolean")
    assert evaluation.paired_t(s, "a", "b").first()["p_value"] < 0.01
    r = evaluation.signed_ranks(s, "a", "b").first()
    assert (r.w_plus, r.w_minus) == (15.0, 0.0)
    assert evaluation.wilcoxon_exact(5, 0) == 0.0625
    assert evaluation.t_pvalue(None, 5) == 1.0 and abs(evaluation.t_pvalue(2.776445, 5) - 0.05) < 1e-6
    assert evaluation.small_bootstrap([]) == (0.0, 0.0) and evaluation.small_bootstrap([0.5]) == (0.5, 0.5)
    lo, hi = evaluation.small_bootstrap([i / 10 for i in range(1, 11)])
    assert 0.3 < lo < 0.55 < hi < 0.8
    got = {x.run: (x.lo, x.hi) for x in evaluation.bootstrap(s).collect()}
    assert got["a"][0] <= 0.88 <= got["a"][1] and got["a"][0] > 0.75


def test_sections_against_a_loop(spark):
    """The windows against the rules restated line by line."""
    import re

    head = re.compile("|".join(chunking.HEADERS), re.I)
    rnd = random.Random(3)
    lines = ["| a | b |", "| c | d | e | f | g | h | i | j |", "Revenue", "## Outlook here", "plain words " * 8, "", "short", "  | x | y | z | w | v | u | t | s | r |  "]
    docs = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 12))) for _ in range(60)]

    def rules(text):
        ls, out, title, cur = text.split("\n"), [], "", []
        row = [bool(re.match(r"^\|.*\|$", x.strip())) for x in ls]

        def flush():
            body = "\n".join(cur).strip(" ")
            if len(re.findall(r"\w+|[^\w\s]", body)) > 10 and len(body.split()) >= 10:
                out.append((title, " ".join(body.split())))
            cur.clear()

        i = 0
        while i < len(ls):
            j = i
            while j < len(ls) and row[j]:
                j += 1
            if j - i >= 2:
                flush()
                body = "\n".join(ls[i:j]).strip(" ")
                if len(body.split()) >= 10:
                    out.append(("__TABLE__", " ".join(body.split())))
                i = j
            elif ls[i].strip() and len(ls[i].split()) <= 8 and head.search(ls[i].strip()):
                flush()
                title = re.sub("^#+", "", ls[i].strip()).strip(" ")
                i += 1
            else:
                cur.append(ls[i])
                i += 1
        flush()
        return out

    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    got: dict = {}
    for r in chunking.sections(df).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append((r.title, " ".join(r.body.split())))
    for i, text in enumerate(docs):
        assert got.get(i, []) == rules(text), text


def test_sentences(spark):
    texts = ["It rose. We sold. No. 4 was U.S. Steel. Then", "", "One", "a b c. d e. F"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(chunking.sentences(F.col("t")).alias("x")).collect()] == [chunking.split_sentences(t) for t in texts]


def test_chunk_invariants(spark):
    body = " ".join(f"Sentence number {i} says something new about revenue." for i in range(300))
    docs = spark.createDataFrame([("1", "AAPL", "2024-01-01", "8-K", f"Revenue\n{body}\n| a | b | c | d | e | f |\n| 1 | 2 | 3 | 4 | 5 | 6 |"), ("2", "X", "d", "8-K", None)], "id string, ticker string, date string, doc_type string, text string")
    rows = chunking.build_chunks(docs).collect()
    ids = [r.chunk_id for r in rows]
    assert len(set(ids)) == len(ids) and {r.id for r in rows} == {"1"}
    parents = {r.chunk_id: i for i, r in enumerate(rows) if r.chunk_type != "child"}
    assert all(parents[r.parent_id] < i for i, r in enumerate(rows) if r.chunk_type == "child")
    table = [r for r in rows if r.chunk_type == "table"]
    assert len(table) == 1 and sum(r.parent_id == table[0].chunk_id for r in rows) == 1
    assert max(len(chunking._PIECE.findall(c)) for c in chunking.pack_children(body)) <= chunking.CHILD_TOKENS


def test_graph(spark):
    ents = spark.createDataFrame(
        [(1, "Revenue", "METRIC", "A", "Q1", ["c1"], None), (2, " revenue", "METRIC", "A", "Q2", ["c2", "c1"], ["Sales", None]), (3, "ai", "PRODUCT", "A", None, None, []), (4, "AI", "PRODUCT", "B", None, ["c3"], ["mr. cook"]), (5, None, "PRODUCT", "B", None, None, None)],
        "entity_id int, name string, entity_type string, ticker string, fiscal_period string, chunk_ids array<string>, aliases array<string>",
    )
    m = graph.merge_entities(ents)
    rows = {r.entity_key: r for r in m.collect()}
    assert rows["METRIC::A::revenue"].chunk_ids == ["c1", "c2"] and rows["METRIC::A::revenue"].aliases == ["sales"] and len(rows) == 3
    assert [(r.name, r.tickers) for r in graph.cross_company(m).collect()] == [("ai", ["A", "B"])]
    q = spark.createDataFrame([("1", "Who said Mr. Cook left?"), ("2", "nothing said"), ("3", None)], "qid string, question string")
    assert {(r.qid, r.name) for r in graph.match_questions(q, m).collect()} == {("1", "ai")}
    rels = spark.createDataFrame([(1, "AI", "Revenue", "HAS", "A", None, None), (2, "ai ", "revenue", "HAS", "B", None, None), (3, "", "x", "HAS", "A", None, None)], "rel_id int, source string, target string, relation string, ticker string, fiscal_period string, chunk_id string")
    assert graph.dedup_edges(rels).count() == 1
    found = graph.expand(graph.match_questions(q, m), m, rels, spark.createDataFrame([("1", "c1")], "qid string, chunk_id string"))
    assert [(r.chunk_id, r.hop) for r in found.orderBy("pos").collect()] == [("c3", 0), ("c2", 1)]


def test_observe_and_ingest(spark):
    e = spark.createDataFrame([("s", i, 1.0, i) for i in range(4)], "session string, event_id int, cost double, ts int")
    assert [r.event_id for r in observe.session_costs(e, 2.5).where("alert").collect()] == [2]
    v = spark.createDataFrame([("a", x / 100) for x in range(100)], "k string, value double")
    assert abs(observe.quantile(v, ["k"], 0.5).first()["quantile"] - 0.5) < 0.02
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "n")], "k string, t int, v string")
    assert {(r.k, r.v) for r in ingest.keep_latest(rows, "k", "t").collect()} == {("a", "y"), (None, "n")}


def test_router(spark):
    c = spark.createDataFrame([("AAPL", "Apple Inc")], "ticker string, company string")
    q = spark.createDataFrame([("1", "hi there"), ("2", "hello my good friend"), ("3", "What was Apple revenue in 2024?"), ("4", "Tell me something about the weather")], "qid string, question string")
    assert {r.qid: (r.intent, r.ticker) for r in router.route(q, c).collect()} == {"1": ("OUT_OF_SCOPE", None), "2": ("OUT_OF_SCOPE", None), "3": ("FINANCIAL_SPECIFIC", "AAPL"), "4": (None, None)}


def test_dense_in_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    v = spark.createDataFrame([(i, [rnd.random() for _ in range(4)]) for i in range(30)], "id int, v array<float>")
    q = v.selectExpr("id as qid", "v as q").where("qid % 3 = 0")
    want = {tuple(r) for r in retrieval.dense(q, v, 3).select("qid", "id", "rank").collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert {tuple(r) for r in retrieval.dense(q, v, 3).select("qid", "id", "rank").collect()} == want and len(want) == 30


def test_dense_gives_k_rows_a_query_of_a_task(monkeypatch):
    rnd = np.random.default_rng(3)
    v, q = rnd.normal(size=(300, 6)), rnd.normal(size=(20, 6))
    v[150:] = v[:150]  # every vector twice
    asked = pa.table({"qid": list(range(20)), "q": [list(x) for x in q]})
    whole = pa.RecordBatch.from_pydict({"id": list(range(300)), "v": [list(x) for x in v]})
    cos = (q / np.linalg.norm(q, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T
    for cells in (100, 10**6):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        out = [r for b in retrieval._product(asked, 4)(whole.slice(at, 50) for at in range(0, 300, 50)) for r in b.to_pylist()]
        for j in range(20):
            best = sorted(range(300), key=lambda i: (-round(cos[j, i], 9), i))[:4]
            assert {r["id"] for r in out if r["qid"] == j} == set(best)
    assert len(out) == 80


def test_budget_cut_is_the_head_of_the_block(spark):
    b = spark.createDataFrame([("q", 1, "--- [1] T ---\n$1,250.5 million (U.S. GAAP); see\nthe  rest"), ("q", 2, "f")], "qid string, slot int, block string")
    r = context.within_budget(b, 17).collect()
    assert [(x.slot, x.tokens, x.block) for x in r] == [(1, 17, "--- [1] T ---\n$1,250.5 million")]


def test_pages_are_parts_of_the_text(spark):
    text = "$1,250.5 million (U.S. GAAP); see\nthe  table é " * 40
    pages = spark.createDataFrame([(text,)], "t string").select(X.token_pages(F.col("t"), 7).alias("p")).first().p
    assert pages == chunking.pages(text, 7)
    at = 0
    for p in pages:
        at = text.index(p, at) + len(p)
    docs = spark.createDataFrame([("1", "A", "d", "8-K", "## Outlook\n" + text)], "id string, ticker string, date string, doc_type string, text string")
    parents = [r.text.split("]\n\n", 1)[1] for r in chunking.build_chunks(docs).where("chunk_type = 'parent'").collect()]
    assert len(parents) > 1 and all(part in text for p in parents for part in p.split("\n\n")[-1:])


def test_expand_with_a_limit_is_the_head_of_all(spark):
    rnd = random.Random(8)
    ents = spark.createDataFrame([(i, f"n{i}", "PRODUCT", "A", None, [f"c{rnd.randrange(25):02}" for _ in range(rnd.randint(0, 9))], None) for i in range(12)], "entity_id int, name string, entity_type string, ticker string, fiscal_period string, chunk_ids array<string>, aliases array<string>")
    rels = spark.createDataFrame([(i, f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}", "HAS", "A", None, None) for i in range(20)], "rel_id int, source string, target string, relation string, ticker string, fiscal_period string, chunk_id string")
    m = graph.merge_entities(ents)
    matches = spark.createDataFrame([(q, f"n{rnd.randrange(12)}") for q in range(8) for _ in range(2)], "qid int, name string").distinct()
    have = spark.createDataFrame([(q, f"c{rnd.randrange(25):02}") for q in range(8) for _ in range(q % 4)], "qid int, chunk_id string")
    skip = spark.createDataFrame([("c03",), ("c11",)], "chunk_id string")
    whole = {tuple(r) for r in graph.expand(matches, m, rels, have, skip=skip).where("pos <= 4").collect()}
    assert whole == {tuple(r) for r in graph.expand(matches, m, rels, have, 4, skip).collect()} and len(whole) > 20


def test_dense_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [0.0, 3.0])], "id int, v array<float>")
    q = spark.createDataFrame([("a", [3.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "qid string, q array<float>")
    assert [tuple(r) for r in retrieval.dense(q, v, 2).orderBy("rank").collect()] == [("a", 1, 1.0, 1), ("a", 2, 1.0, 2)]
    assert retrieval.dense(q.limit(0), v, 2).count() == 0 and retrieval.dense(q, v.limit(0), 2).count() == 0


def test_names_of_any_length(spark):
    long = "the very long name of a fund with twelve words in it"
    merged = spark.createDataFrame([(long, []), ("fund", [long + " more"]), ("acme", ["x, y & z"])], "name string, aliases array<string>")
    questions = spark.createDataFrame([(1, f"What is {long.title()}?"), (2, "What is the very long name of a fund with twelve letters?"), (3, f"Is {long} more, or X Y Z?"), (4, f"{long}s")], "qid int, question string")
    from quarrylight.operators import graph

    assert {tuple(r) for r in graph.match_questions(questions, merged).collect()} == {(1, long), (1, "fund"), (2, "fund"), (3, long), (3, "fund"), (3, "acme"), (4, "fund")}
