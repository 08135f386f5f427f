"""Spellings that are one name and spellings that are not; the operator on small tables and against all pairs."""

import random

import pytest

from quarrylight.llm import names

SCHEMA = "entity_id bigint, name string, entity_type string, ticker string, aliases array<string>, cluster string"


def pairs_of(spark, rows):
    df = spark.createDataFrame([(i, n, k, t, a, "x") for i, (n, k, t, a) in enumerate(rows)], SCHEMA)
    return {tuple(r) for r in names.same_pairs(df).collect()}


P, F = "PERSON", "COMPETITOR"


@pytest.mark.parametrize(
    "kind,a,b,same",
    [
        (P, "richard fletavetész", "Fletavetesz, Richard", True),
        (P, "richard fletavetész", "dick fletavetész", True),
        (P, "richard fletavetész", "dr. richard q. fletavetész, phd", True),
        (P, "richard fletavetész", "richard fletavtész", True),
        (P, "richard fletavetész", "ricahrd fletavetész", True),
        (P, "richard fletavetész", "richardfletavetész", True),
        (P, "richard fletavetész", "richard-fletavetész", True),
        (P, "anthony hosovigård", "anth0ny hosovigard", True),
        (P, "richard fletavetész", "rebecca fletavetész", False),
        (P, "richard fletavetész", "richard stondosewald", False),
        (F, "hurogagen services corp.", "the hurogagen services company", True),
        (F, "hurogagen services corp.", "HUROGAGEN SVCS", True),
        (F, "hurogagen services corp.", "services, hurogagen", True),
        (F, "hurogagen services corp.", "hurogagenservices", True),
        (F, "hurogagen services corp.", "hurogagen servces inc", True),
        (F, "maleru metal services", "malerumetal services plc", True),
        (F, "hurogagen services corp.", "hurogagen foods corp.", False),
        (F, "hurogagen services corp.", "tuskenimar services corp.", False),
    ],
)
def test_pairs(spark, kind, a, b, same):
    assert (pairs_of(spark, [(a, kind, "T", []), (b, kind, "T", None)]) == {(0, 1)}) is same


@pytest.mark.parametrize(
    "kind,a,b,same",
    [
        (P, "chuck zutvereyoung", "charles zuvrereyoung", True),  # two slips
        (F, "alpha beta systems", "beta alpha systems", True),
        (F, "alpha beta systems", "betta alpha sys", True),
        (P, "richard fletavetész", "richard fletovatisz", False),  # three in ten letters
    ],
)
def test_more_than_one_slip(spark, kind, a, b, same):
    assert (pairs_of(spark, [(a, kind, "T", []), (b, kind, "T", None)]) == {(0, 1)}) is same


def test_rarity_decides():
    # one slip in four letters, two in eight: enough beside a rare qualifier, not beside a common one
    for a, b in [("kova", "kovi"), ("hosirial", "hosiridsl")]:
        assert names.similar(a, b, "systems", "systems", 0.7, 0.7) and not names.similar(a, b, "systems", "systems", 0.4, 0.4)
    assert not names.similar("kov", "kob", "systems", "systems", 1.0, 1.0)


def test_slips_in_general():
    rnd = random.Random(3)

    def plain(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(500):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(2))
        for most in (2, 3):
            assert names.slips(a, b, most) == min(plain(a, b), most + 1)


def test_join_finds_all_that_may_be_alike(spark):
    rnd = random.Random(6)
    ws = {"".join(rnd.choice("bcdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randint(4, 7))) for _ in range(40)}
    for w in sorted(ws):
        for _ in range(3):
            x = w
            for _ in range(rnd.randint(1, len(w) // 4)):
                i = rnd.randrange(len(x) - 1)
                x = rnd.choice([x[:i] + x[i + 1 :], x[:i] + x[i + 1] + x[i] + x[i + 2 :], x[:i] + "x" + x[i + 1 :], x[:i] + "y" + x[i:]])
            ws.add(x)
    df = spark.createDataFrame([("T", P, w) for w in ws], "ticker string, kind string, anchor string")
    got = {(r.anchor, r.other) for r in names._gram_pairs(df).collect()}
    want = {(a, b) for a in ws for b in ws if a < b and names.similar(a, b, "", "", 1.0, 1.0)}
    assert want <= got and any(names.slips(a, b) > 1 for a, b in want)


def test_weak_spellings(spark):
    rows = [("richard krerawilund", P, "T", []), ("r. krerawilund", P, "T", []), ("krerawilund, r. g.", P, "T", None)]
    assert pairs_of(spark, rows) == {(0, 1), (0, 2), (1, 2)}
    # with a relative of the same initial nobody can tell: only the equal readings stay together
    assert pairs_of(spark, [*rows, ("rebecca krerawilund", P, "T", [])]) == {(1, 2)}
    # an alias can
    rows = [("ms. krerawilund", P, "T", ["rebecca krerawilund"]), ("rebecca krerawilund", P, "T", []), ("richard krerawilund", P, "T", [])]
    assert pairs_of(spark, rows) == {(0, 1)}
    assert pairs_of(spark, [("fl corp.", F, "T", []), ("flebowunex logistics corp.", F, "T", [])]) == {(0, 1)}


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("fennroq", F, "T", []), ("fenroq ltd", F, "T", []), ("fennorq group", F, "T", None), ("fennroq", F, "U", [])], {(0, 1), (0, 2), (1, 2)}),
        ([("j. kelikkefeld", P, "T", []), ("j. kelikefeld", P, "T", []), ("m. kelikefeld", P, "T", [])], {(0, 1)}),
        ([("kelikkefeld", P, "T", []), ("j. kelikefeld", P, "T", [])], {(0, 1)}),
        ([("kelikkefeld", P, "T", []), ("j. kelikefeld", P, "T", []), ("m. kelikkefeld", P, "T", [])], set()),
        # aliases of weak rows, and weak aliases of rows with a full spelling
        ([("fennroq", F, "T", ["tolvaxi"]), ("tolvaxi plc", F, "T", []), ("fennroq inc", F, "T", [])], {(0, 1), (0, 2), (1, 2)}),
        ([("hurogagen services corp.", F, "T", ["fennroq"]), ("fennroq", F, "T", []), ("fennorq", F, "T", [])], {(0, 1), (0, 2), (1, 2)}),
        # a weak spelling near two families belongs to neither, one in each to its own
        ([("richard kebezalund", P, "T", []), ("ralph kebezolund", P, "T", []), ("r. kebezalund", P, "T", []), ("r. kebezolund", P, "T", [])], {(0, 2), (1, 3)}),
    ],
)
def test_weak_spellings_among_themselves(spark, rows, want):
    assert pairs_of(spark, rows) == want


def test_edges_of_the_input(spark):
    rows = [(None, P, "T", None), ("", P, "T", [None, ""]), ("  ", P, "T", []), ("richard fletavetész", P, None, []), ("richard fletavetész", P, "A", []), ("richard fletavetész", P, "B", []), ("richard fletavetész", F, "A", []), ("richard fletavetész", "RISK", "A", []), ("richard fletavetész", P, "A", []), ("x" * 5000 + " y" * 3000, P, "A", []), ("王小明", P, "A", []), ("王小明", P, "A", []), (None, P, "A", ["richard fletavetész"])]
    assert pairs_of(spark, rows) == {(4, 8), (4, 12), (8, 12), (10, 11)}
    df = spark.createDataFrame([], SCHEMA)
    assert names.same_pairs(df).count() == 0 and names.classes(df).count() == 0


def test_join_finds_every_slip(spark):
    """The prefix-filtered join against all pairs of anchors."""
    rnd = random.Random(5)
    words = {"".join(rnd.choice(["ka", "vo", "stu", "re", "mi"]) for _ in range(rnd.randint(2, 5))) for _ in range(120)}
    for w in list(words)[:60]:
        i = rnd.randrange(len(w) - 1)
        words |= {w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "x" + w[i + 1 :], w[:i] + "y" + w[i:]}
    ws = sorted(words)
    df = spark.createDataFrame([("T", P, w) for w in ws], "ticker string, kind string, anchor string")
    got = {(r.anchor, r.other) for r in names._gram_pairs(df).collect()}
    want = {(a, b) for a in ws for b in ws if a < b and names.slips(a, b) == 1}
    assert want <= got


def test_slips():
    assert [names.slips(a, b) for a, b in [("abc", "abc"), ("abc", "acb"), ("abc", "abd"), ("abc", "ab"), ("abc", "xabc"), ("abcd", "badc"), ("abc", "cab")]] == [0, 1, 1, 1, 1, 2, 2]


def test_long_chain_closes(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "a string, b string")
    assert {r.label for r in names._close(edges).collect()} == {"n000"}


def test_short_forms_are_learned_from_aliases(spark):
    """Names that no list holds: two families tell the short form, and the third is linked by it."""
    rows = [("borislava kerenatov", P, "T", ["slava kerenatov"]), ("slava dimotrev", P, "U", ["borislava dimotrev"]), ("borislava penkulov", P, "T", []), ("slava penkulov", P, "T", None), ("gorana penkulov", P, "T", [])]
    assert pairs_of(spark, rows) == {(2, 3)}
    assert pairs_of(spark, [rows[0], *rows[2:]]) == set()  # one family is not enough
    df = spark.createDataFrame([(1, "richard kerenatov", P, "T", [], ""), (2, "dick kerenatov", P, "T", [], "")], SCHEMA)
    assert names.same_pairs(df).count() == 1 and names.same_pairs(df, nicknames={}).count() == 0
    df = spark.createDataFrame([(1, "borislava kerenatov", P, "T", [], ""), (2, "slava kerenatov", P, "T", [], "")], SCHEMA)
    assert names.same_pairs(df, nicknames={"borislava": "slava boba"}).count() == 1
