"""The registered queries run at the smallest scale; those with SQL agree with it."""

import glob
import os

import duckdb
import pytest

from quarrylight.llm import queries

COLUMNS = {"p1_found": ["chunk_id"], "p3_found": ["entity_id_a", "entity_id_b"], "p4_found": ["pair_field", "pair_id", "defect"], "p6_found": ["chunk_id", "line_no"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "kind"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    rows = df.collect()
    if name in queries.ORACLES:
        c = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        res = c.execute(queries.ORACLES[name])
        at = [[x[0] for x in res.description].index(k) for k in df.columns]
        assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(r[i] for i in at)) for r in res.fetchall())
