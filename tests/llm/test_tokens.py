"""Ids against the public encoder, on odd texts and on the documents."""

import base64
import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import mixing, tokens

PATH = os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def public():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t\r  abé19.,!'²½\x1c", max_size=30)))
def test_texts(public, text):
    bpe = tokens.encoder(PATH)
    assert bpe.encode(text) == public.encode_ordinary(text)
    assert bpe.count(text) == len(bpe.encode(text))


@pytest.mark.parametrize("text", ["x" * 20_000, "=" * 3000, "1" * 999, "<|endoftext|>", "𝟙𝟚 5𝟛", "a" * 200 + " " * 200 + "b", "don't I'LL we'll"])
def test_long_and_odd(public, text):
    assert tokens.encoder(PATH).encode(text) == public.encode_ordinary(text)


def test_cache_limits(public, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3)
    bpe = tokens.ByteBpe(PATH)
    text = "one two three four five six seven one two"
    assert bpe.encode(text) == public.encode_ordinary(text) and len(bpe._known) <= 3


def test_operator(spark, data, public):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumnRenamed("lang", "ids")
    got = {r.doc_id: r.ids for r in tokens.encode_documents(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (public.encode_ordinary(r.text) if r.text else [])
    assert tokens.encode_documents(docs.limit(0)).count() == 0


def docs_of(spark, rows):
    return spark.createDataFrame([(i, s, t, 1) for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string, n_tokens int")


def test_mix(spark):
    rows = [("a", "word " * 10)] * 300 + [("b", "word " * 10)] * 20 + [("c", "")] * 5 + [(None, "x")] * 3 + [("z", "x")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 4), ("c", 0.05, 3), ("gone", 0.05, 1), ("b", 0.0, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats bigint")
    used, shares = mixing.mix(docs_of(spark, rows), targets)
    u, s = used.collect(), {r.source: r for r in shares.collect()}
    assert len({r.doc_id for r in u}) == len(u) and all(1 <= r.repeats <= {"a": 1, "b": 4}[r.source] for r in u)
    assert sum(r.reached_share for r in s.values()) == pytest.approx(1)
    assert s["b"].reached_share == pytest.approx(0.4 / 0.9, abs=0.02) and s["a"].reached_share == pytest.approx(0.5 / 0.9, abs=0.02)
    assert s["b"].most_repeats == 4 and s["gone"].reached_share == 0 and s["c"].tokens_used == 0
    assert {r.doc_id: r.repeats for r in mixing.mix(docs_of(spark, rows).repartition(7), targets)[0].collect()} == {r.doc_id: r.repeats for r in u}


def test_mix_with_a_budget(spark):
    sizes, targets, caps = {"a": 1000, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 3}
    draws, a = mixing.plan(sizes, targets, caps, 400)
    assert 0 < a < 1 and draws["b"] <= 30 and sum(draws.values()) >= 398
    assert mixing.plan(sizes, targets, caps)[1] == 1.0
    assert mixing.plan({}, targets, caps) == ({}, 1.0)
    e = mixing.exponent_for_entropy({"a": 90, "b": 10}, 0.5)
    assert 0 < e < 1 and mixing.temperature({"a": 90, "b": 10}, 0) == {"a": 0.5, "b": 0.5}


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats bigint")
    used, shares = mixing.mix(docs_of(spark, [("a", None)]), targets)
    assert used.count() == 0 and shares.first()["reached_share"] == 0


def test_limits_bend_the_exponent(spark):
    rows = [("a", "word " * 10)] * 300 + [("b", "word " * 10)] * 20
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats bigint")
    shares = {r.source: r for r in mixing.mix(docs_of(spark, rows), targets, of_all=1.0)[1].collect()}
    assert 0 < shares["b"].exponent < 1 and shares["b"].most_repeats == 2 and shares["a"].most_repeats == 1
    # the scarce source is used up to its limit, and the whole is what the sources hold
    have = sum(r.tokens_available for r in shares.values())
    assert abs(shares["b"].tokens_used - 2 * shares["b"].tokens_available) <= 11 and abs(sum(r.tokens_used for r in shares.values()) - have) <= 22
    assert all(r.within_repeats and r.near_target for r in mixing.balance(docs_of(spark, rows), targets).collect())


def test_decoding(spark):
    df = spark.createDataFrame([(1, [], "x"), (2, None, "x")], "doc_id bigint, ids array<int>, text string")
    assert {r.doc_id: r.text for r in tokens.decode_documents(df).collect()} == {1: "", 2: None}
    texts = ["", "a b  c\n", "é 𝟙 王小明 \x00 x", None]
    back = tokens.decode_documents(tokens.encode_documents(docs_of(spark, [("s", t) for t in texts])))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
