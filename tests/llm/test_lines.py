"""Repeated lines against a plain count."""

import random

from quarrylight.llm import lines

SCHEMA = "chunk_id string, ticker string, text string, date string, ingested_at timestamp_ntz, line string"


def frame(spark, rows):
    return spark.createDataFrame([(c, t, x, "2024-01-01", None, "clash") for c, t, x in rows], SCHEMA)


def brute(rows, least=5):
    seen = {}
    for c, t, x in rows:
        if c is not None and t is not None and x is not None:
            for i, line in enumerate(x.split("\n"), 1):
                key = " ".join(line.split()).lower()
                if any(ch.isalpha() for ch in key):
                    seen.setdefault((t, key), {}).setdefault(c, set()).add(i)
    return {(c, i) for held in seen.values() if len(held) >= least for c, nos in held.items() for i in nos}


def test_against_brute_force(spark):
    rnd = random.Random(4)
    pool = ["See notes", "SEE  NOTES", "see notes\r", "***", "", "  ", "unique %d", "12 34", "Página", "página "]
    rows = []
    for i in range(80):
        x = "\n".join((p % rnd.randint(0, 400)) if "%" in p else p for p in rnd.choices(pool, k=rnd.randint(0, 6)))
        rows.append((f"c{rnd.randint(0, 40)}" if i % 9 else None, rnd.choice(["A", "B", None]), x if i % 11 else None))
    rows += rows[:20]
    got = {tuple(r) for r in lines.repeated_line_numbers(frame(spark, rows)).collect()}
    assert got == brute(rows) and got


def test_copies_do_not_count(spark):
    rows = [("c1", "A", "Notice here")] * 9 + [(f"c{i}", "A", "Notice here") for i in range(2, 5)]
    assert lines.repeated_line_numbers(frame(spark, rows)).count() == 0
    rows.append(("c9", "A", "notice   HERE\nx\nNotice here"))
    assert lines.repeated_line_numbers(frame(spark, rows)).count() == 6
    r = lines.repeated_lines(frame(spark, rows)).collect()
    assert [(x.line, x.n_chunks, x.n_clusters, x.n_dates) for x in r] == [("notice here", 5, 2, 1)]
    clean = {x.chunk_id: (x.clean_text, x.n_removed) for x in lines.without_repeated_lines(frame(spark, rows)).collect()}
    assert clean["c9"] == ("x", 2) and clean["c1"] == ("", 1)


def test_a_republished_text_is_no_boilerplate(spark):
    rows = [(f"c{i}", "A", "Our story\nSee notes" + ("\n" * (i % 3)), f"2024-01-{i:02}") for i in range(1, 8)]
    rows += [(f"d{i}", "A", f"Story {'abcdefg'[i]}\nSEE notes", f"2024-02-{i + 1:02}") for i in range(6)]
    df = spark.createDataFrame([(c, t, x, d, None, "clash") for c, t, x, d in rows], SCHEMA)
    found = {r.line: (r.n_chunks, r.n_clusters, r.n_dates) for r in lines.repeated_lines(df).collect()}
    assert found == {"our story": (7, 1, 7), "see notes": (13, 7, 13)}
    assert [r.line for r in lines.boilerplate(df).collect()] == ["see notes"]
    assert lines.repeated_line_numbers(df).count() == 20


def test_more_lines_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "MOST_BROADCAST", 0)
    rows = [(f"c{i}", "A", "Notice here\nmore") for i in range(6)]
    assert lines.repeated_line_numbers(frame(spark, rows)).count() == 12 and lines.repeated_lines(frame(spark, rows)).count() == 2


def test_empty(spark):
    df = frame(spark, [("a", "A", None)])
    assert lines.repeated_line_numbers(df).count() == 0
    assert [(r.clean_text, r.n_removed) for r in lines.without_repeated_lines(df).collect()] == [(None, 0)]
    assert lines.without_repeated_lines(df.limit(0)).count() == 0
