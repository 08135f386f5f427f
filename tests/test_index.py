"""The stored index: three ways of scoring against a plain loop, writes and rewrites, what a search reads."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight import catalog
from quarrylight.sources import index as I

SCHEMA = "id int, text string, tag string, term string"


def texts(n=200, seed=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    return [(i, " ".join(rnd.choices(vocabulary, [1 / (j + 1) for j in range(40)], k=rnd.randint(0, 30))), rnd.choice("ab"), "clash") for i in range(n)]


def plain(rows, questions, k, keep=lambda r: True):
    """BM25 restated: global statistics, a floor for frequent terms, ties to the smaller id."""
    docs = {r[0]: Counter((r[1] or "").lower().split()) for r in rows}
    n = len(docs)
    mean = sum(sum(c.values()) for c in docs.values()) / n
    df = Counter(t for c in docs.values() for t in c)
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    floor = sum(raw.values()) / len(raw) / 4
    out = set()
    for qid, q in questions:
        scores = []
        for r in rows:
            c = docs[r[0]]
            hit = [t for t in (q or "").lower().split() if t in c]
            if hit and keep(r):
                s = sum((raw[t] if raw[t] >= 0 else floor) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in hit)
                scores.append((-round(s, 6), r[0]))
        out |= {(qid, i, place, round(-s, 5)) for place, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def got(df):
    return {(r.qid, r.id, r.rank, round(r.score, 5)) for r in df.collect()}


@pytest.mark.parametrize("at_once,few", [(10**9, 0), (0, 10**6), (0, 0)])
def test_three_ways(spark, tmp_path, monkeypatch, at_once, few):
    monkeypatch.setattr(I, "AT_ONCE", at_once)
    monkeypatch.setattr(I, "FEW", few)
    monkeypatch.setattr(I, "CELLS", 50)
    monkeypatch.setattr(I, "PROBES", 1)
    rows = texts()
    rnd = random.Random(5)
    questions = [(i, " ".join(rnd.choices([f"w{j}" for j in range(45)], k=rnd.randint(1, 6)))) for i in range(30)] + [(98, None), (99, "unknown words"), (97, "w0 w0 W0")]
    index = I.LexicalIndex.create(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "x"), ("tag",))
    q = spark.createDataFrame(questions, "qid int, question string")
    assert got(index.search(q, 4)) == plain(rows, questions, 4)
    assert got(index.search(q, 3, F.col("tag") == "a")) == plain(rows, questions, 3, lambda r: r[2] == "a")
    monkeypatch.setattr(I, "TERM_BLOCK", 20)
    assert got(index.search(q, 4)) == plain(rows, questions, 4)


def test_upsert(spark, tmp_path):
    rows = texts(60)
    index = I.LexicalIndex.create(spark.createDataFrame([(i, "old " + t, g, c) for i, t, g, c in rows[:40]], SCHEMA), str(tmp_path / "x"), ("tag",))
    index.upsert(spark.createDataFrame(rows[20:], SCHEMA)).upsert(spark.createDataFrame(rows[:20], SCHEMA))
    questions = [(1, "w0 w3 old"), (2, "w7")]
    assert got(index.search(spark.createDataFrame(questions, "qid int, question string"), 5)) == plain(rows, questions, 5)
    assert index.manifest()["n"] == 60 and index.terms().where("term = 'old'").count() == 0
    # what is no longer named is gone
    assert len([p for p in (tmp_path / "x").iterdir() if p.name.startswith("segment")]) == len(index.manifest()["segments"])


def test_edges(spark, tmp_path):
    q = spark.createDataFrame([(1, "alpha beta")], "qid int, question string")
    for rows in ([], [(1, None, None, ""), (2, "", None, ""), (3, " \n ", None, "")]):
        index = I.LexicalIndex.create(spark.createDataFrame(rows, SCHEMA), str(tmp_path / f"x{len(rows)}"))
        assert index.search(q, 3).count() == 0 and index.terms().count() == 0 and index.manifest()["n"] == len(rows)
    index.upsert(spark.createDataFrame([(None, "alpha", None, ""), (5, "alpha " * 5000, None, ""), (5, "alpha", None, ""), (6, "Alpha x", None, "")], SCHEMA))
    assert index.texts().where("id = 5").first()["dl"] == 5000 and index.manifest()["n"] == 6
    assert {r.id for r in index.search(q, 3).collect()} == {None, 5}
    with pytest.raises(FileNotFoundError):
        I.LexicalIndex(spark, str(tmp_path / "none")).search(q, 3)


def test_a_search_reads_only_what_is_asked(spark, data):
    index = catalog._index(spark, data, "children")
    made = index.manifest()
    text = index.search(catalog._one(spark), 5)._jdf.queryExecution().toString().replace("\n", "")
    assert "regexp_extract_all" not in text and "chunks.parquet" not in text
    assert "PartitionFilters: [bucket#" in text and "PushedFilters: [In(term" in text
    assert catalog._index(spark, data, "children").manifest() == made


def test_many_questions_in_blocks(spark, tmp_path, monkeypatch):
    for name, value in (("AT_ONCE", 0), ("FEW", 0), ("CELLS", 60), ("TERM_BLOCK", 20), ("TEXT_BLOCK", 30)):
        monkeypatch.setattr(I, name, value)
    rnd = random.Random(6)
    rows = texts(120) + [(i + 500, t, g, c) for i, t, g, c in texts(120)]  # every text twice: ties everywhere
    words = [" ".join(rnd.choices([f"w{j}" for j in range(45)], k=rnd.randint(1, 6))) for _ in range(15)]
    questions = list(enumerate(words + words))  # and every question
    index = I.LexicalIndex.create(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "x"), ("tag",))
    assert got(index.search(spark.createDataFrame(questions, "qid int, question string"), 5)) == plain(rows, questions, 5)


def test_a_task_gives_k_rows_a_question(monkeypatch):
    monkeypatch.setattr(I, "CELLS", 60)
    rows = texts(300)
    asked = [(q, f"w{t}", 1.0 + t / 7) for q in range(20) for t in (q, q + 1, 0) if (q, t) != (0, 0) or t]
    ask = pa.table({"qid": [a[0] for a in asked], "term": [a[1] for a in asked], "w": [a[2] for a in asked]})
    counts = [Counter(r[1].split()) for r in rows]
    whole = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "dl": [sum(c.values()) for c in counts], "terms": [list(c) for c in counts], "tfs": [list(c.values()) for c in counts]})
    out = [r for b in I._scorer(ask, 15.0, 4)(whole.slice(at, 50) for at in range(0, 300, 50)) for r in b.to_pylist()]
    per = Counter(r["qid"] for r in out)
    assert set(per) == set(range(20)) and max(per.values()) <= 6  # four and what ties
