"""Figures of texts by hand; types of clear cases; the learned posteriors."""

from collections import Counter

import pytest

from quarrylight.llm import quality

COMMON = frozenset("the of and to in a is that for it was as on with by be this are from at or an".split())
PROSE = "The board met in the spring and approved the plan for the year. It was a good quarter for the company, and sales rose in all of the regions. "
TEXTS = {
    "prose": [PROSE, PROSE * 20, "Heading\n\n" + PROSE * 4 + "\n- one\n- two\n" + PROSE * 3, PROSE * 6 + "\n| a | 1 |\n| b | 2 |\n" + PROSE * 6],
    "list": ["- item one\n- item two\n- thing three\n- item four", "Home | About Us | Contact | News | Careers | Legal Notice", "1. alpha\n2. beta\n3. gamma\n4. delta", "alpha beta\ngamma\ndelta one\nepsilon\nzeta", "Intro ........ 2\nResults ........ 5\nNotes .......... 9"],
    "table": ["\tQ1 2024\tQ2 2024\nSales\t1,200\t1,300\nCosts\t900\t(40)", "| x | 1 | 2 |\n|---|---|---|\n| y | 3 | 4 |\n| z | 5 | 6 |", '"Sales","1,200","3"\n"Costs","900","4"\n"Rest","12","n/m"', "<table>\n<tr><td>Sales</td><td>12</td></tr>\n<tr><td>Costs</td><td>13</td></tr>\n</table>"],
    "junk": ["=" * 400, "click\n" * 80, "ee 65 0c a9 64 ad e8 a8\n" * 9, "dkjgq dqq rfqp grqw zffjkpp qjcjjgb jvdkgv vmwlz tnnxxm", "T h e  b o a r d  m e t  i n  t h e  s p r i n g", "pMu1UuNvnUiEN2TF5ZZTuh9yAsb8CGzXrX4n0aPeA1Ni8ZW87Jrf" * 4, "var a=function(f){return f.id(1);};\n" * 9, "�©�c�Ãne�©Ãe€Ão€ma□ÃesÃ¢âÃ□□¢div©�io€�loâist�q□� " * 4],
}


def test_figures():
    m = quality.statistics("One two.\nThree, the end\n\n!", COMMON)
    assert (m["words"], m["ended"]) == (6, 2 / 3)
    assert m["mean_word"] == pytest.approx(20 / 6) and m["common"] == pytest.approx(1 / 5) and m["symbols"] == pytest.approx(3 / 20)


def test_types():
    rows = [(k, t) for k, ts in TEXTS.items() for t in ts]
    v = [quality.votes(quality.measures(t, COMMON)) for _, t in rows]
    # the types are met in the proportions of a corpus
    post = quality.learn(Counter(v * 20 + v[:4] * 300))
    for (k, t), x in zip(rows, v, strict=True):
        assert quality.TYPES[max(range(4), key=lambda i: post[x][i])] == k, (t[:60], post[x])


def test_learning():
    assert quality.learn({}) == {}
    post = quality.learn({0b111: 1000, 0b11000: 50, 0: 1})
    assert all(sum(p) == pytest.approx(1) for p in post.values())
    assert post[0b111][0] > 0.99 and post[0b11000][1] > 0.99


def test_operator(spark):
    rows = [(1, PROSE * 3), (2, None), (3, ""), (4, " \n"), (5, "- item one\n- item two\n- thing three"), (6, "=" * 200), (7, PROSE * 3), (8, PROSE * 4000), (None, "x" * 10)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, kind string")
    common = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    got = {r.doc_id: r for r in quality.typed(docs, common).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kind is None and got[i].n_words == 0 and got[i].mean_word_length is None for i in (2, 3, 4))
    assert [got[i].kind for i in (1, 5, 6, 7, 8)] == ["prose", "list", "junk", "prose", "prose"]
    assert {r.doc_id for r in quality.not_prose(docs, common).collect()} >= {5, 6}
    assert quality.typed(docs.limit(0), common).count() == 0


def test_speed_on_long_text():
    import time

    began = time.time()
    for t in ("a" * 500_000, "ab " * 200_000, "x\n" * 200_000, ". " * 200_000, "| 1 " * 100_000):
        quality.measures(t, COMMON)
    assert time.time() - began < 60


def test_ends_of_long_and_blank_tails():
    assert quality.statistics("One two." + " " * 50 + "\nThree" + ")" * 40 + "\nFour.” )" + "”" * 30, COMMON)["ended"] == 1 / 3
