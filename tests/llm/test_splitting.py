"""Pieces: limits, overlaps, order, round trip, breaks, odd texts."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import splitting


def check(text, limit, overlap):
    cuts = splitting.cut_points(text, limit, overlap)
    o = max(0, min(overlap, limit // 2))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b), (c, e) in zip(cuts, cuts[1:]):
        assert b - a <= limit and c == b - o and e > b
    assert cuts[-1][1] - cuts[-1][0] <= limit
    assert "".join(text[(b0 if i else 0) : b1] for i, (b0, b1) in enumerate([(0, cuts[0][1])] + [(p[1], q[1]) for p, q in zip(cuts, cuts[1:])])) == text
    return cuts


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n\t!é‍́", max_size=300), st.integers(1, 60), st.integers(0, 80))
def test_any_text(text, limit, overlap):
    if len(text) > limit:
        check(text, limit, overlap)


def test_cuts_at_breaks():
    text = "One two three. " * 30
    for a, b in check(text, 100, 10)[:-1]:
        assert text[:b].endswith(". ")


def test_deepest_valley():
    cats, ships = "the cat chased another cat and purring kittens. ", "the ship sailed with another ship and loaded cargo. "
    text = cats * 6 + ships * 6
    cut = splitting.cut_points(text, int(len(cats) * 8.5), 0)[0][1]
    assert cut == len(cats) * 6


def test_no_break_and_long():
    check("x" * 5000, 100, 10)
    words = " ".join("w%d" % i for i in range(400))
    for a, b in check(words, 50, 5)[:-1]:
        assert words[b - 1] == " "
    check("\n".join(random.Random(1).choices(["alpha beta gamma.", "delta", ""], k=40_000)), 600, 60)


def test_operator(spark):
    rows = [("a", None, "t", "child", "x. " * 40), ("a", None, "t", "child", "x. " * 40), ("b", "p", None, "child", "y" * 100), ("c", "p", None, "child", "y" * 101), ("d", "p", None, "other", "z" * 500), ("e", None, None, "child", None), (None, None, None, "child", "n" * 150), ("f", None, None, None, "n" * 150), ("g", None, None, "child", "")]
    chunks = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id string, parent_id string, section_title string, chunk_type string, text string, max_chars int")
    limits = spark.createDataFrame([("child", 100, 10), ("table", None, 5), ("zero", 0, 5)], "chunk_type string, max_chars bigint, overlap_chars bigint")
    out = splitting.split_chunks(chunks, limits).collect()
    by = {}
    for r in out:
        by.setdefault(r.chunk_id, []).append(r)
    assert set(by) == {"a", "c", None}
    for k, ps in by.items():
        ps.sort(key=lambda r: r.piece_no)
        assert [p.piece_no for p in ps] == list(range(1, len(ps) + 1)) and all(p.n_chars == len(p.piece) <= 100 for p in ps)
        assert all(p.piece[-10:] == q.piece[:10] for p, q in zip(ps, ps[1:]))
    assert by["c"][0].parent_id == "p" and by["a"][0].section_title == "t"
    assert {r.chunk_id for r in splitting.split_ids(chunks, limits).collect()} == {"a", "c", None}
    assert splitting.split_chunks(chunks.limit(0), limits).count() == 0


def test_the_whole_window_is_searched():
    cats, ships = "the cat chased another cat and purring kittens. ", "the ship sailed with another ship and loaded cargo. "
    # the change of topic lies in the first third of the window
    text = cats * 3 + ships * 12
    assert splitting.cut_points(text, len(ships) * 10, 0, common=frozenset("the with and another".split()))[0][1] == len(cats) * 3


def test_reassembled(spark):
    rows = [("a", "One two three. " * 40, "child"), ("b", "y" * 101, "child"), ("c", "short", "child"), ("d", None, "child")]
    chunks = spark.createDataFrame([(c, None, None, k, t) for c, t, k in rows], "chunk_id string, parent_id string, section_title string, chunk_type string, text string")
    limits = spark.createDataFrame([("child", 100, 10)], "chunk_type string, max_chars bigint, overlap_chars bigint")
    import hashlib

    got = {tuple(r) for r in splitting.reassembled(chunks, limits).collect()}
    assert got == {(c, hashlib.md5(t.encode()).hexdigest(), len(t), True, True) for c, t, _ in rows[:2]}
