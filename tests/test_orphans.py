"""Orphan references: every state, the incremental form against one load, nulls and empty tables."""

from datetime import datetime as D

from quarrylight.operators import orphans
from quarrylight.streaming import windows

REL = "rel_id bigint, source string, target string, relation string, ticker string, fiscal_period string, chunk_id string, extracted_at timestamp_ntz"
ENT = "entity_id bigint, name string, ticker string, extracted_at timestamp_ntz, deleted_at timestamp_ntz, state string"
CHU = "chunk_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, key string"
EARLY, MID, LATE = D(2025, 1, 1), D(2025, 2, 1), D(2025, 3, 1)


def frames(spark):
    # columns called state and key clash with the operator's own names
    rels = spark.createDataFrame(
        [
            (1, "  Net  Revenue ", "gone", "REPORTS", "A", "Q1", "c1", MID),
            (2, "net revenue", "late one", "REPORTS", "B", "Q1", "c2", MID),
            (3, None, "", "REPORTS", "A", None, "  ", MID),
            (4, "NET REVENUE", "back again", "REPORTS", "A", "Q2", "c9", MID),
            (5, "timeless", "net revenue", "REPORTS", None, "Q2", None, None),
        ],
        REL,
    )
    ents = spark.createDataFrame(
        [
            (1, "Net Revenue", "A", EARLY, None, "x"),
            (2, "gone", "A", EARLY, LATE, "x"),
            (3, "late one", "B", LATE, None, "x"),
            (4, "back again", "A", EARLY, MID, "x"),
            (5, "back again", "A", EARLY, None, "x"),
            (6, None, "A", EARLY, None, "x"),
            (7, "gone", "A", EARLY, LATE, "x"),
        ],
        ENT,
    )
    chunks = spark.createDataFrame([("c1", EARLY, None, "k"), ("c1", LATE, None, "k"), ("c2", LATE, None, "k"), (None, EARLY, None, "k")], CHU)
    return rels, ents, chunks


def got(refs):
    return {(r.rel_id, r.ref_field, r.state) for r in orphans.orphans(refs).collect()}


WANT = {(1, "target", "deleted"), (2, "source", "missing"), (2, "target", "late"), (2, "chunk_id", "late"), (4, "chunk_id", "missing"), (5, "source", "missing"), (5, "target", "missing")}


def test_states(spark):
    assert got(orphans.probe(*frames(spark))) == WANT


def test_snapshot_and_empty(spark):
    rels, ents, chunks = frames(spark)
    counts = {(r.ref_table, r.fiscal_period, r.state): r.n_orphans for r in orphans.counts(orphans.probe(rels, ents, chunks)).collect()}
    assert counts[("entities", "Q1", "deleted")] == 1 and sum(counts.values()) == len(WANT)
    assert orphans.orphans(orphans.probe(rels.limit(0), ents, chunks)).count() == 0
    assert {r.state for r in orphans.orphans(orphans.probe(rels, ents.limit(0), chunks.limit(0))).collect()} == {"missing"}


def test_the_stored_state_gives_what_the_tables_say(spark, tmp_path):
    """Also where ids that should be keys come twice."""
    rels, ents, chunks = frames(spark)
    rels, ents = rels.unionByName(rels.where("rel_id < 3")), ents.unionByName(ents.where("entity_id = 4").selectExpr("1L as entity_id", "name", "ticker", "extracted_at", "deleted_at", "state"))
    chunks = chunks.unionByName(chunks.where("chunk_id = 'c2'").selectExpr("chunk_id", "ingested_at", "timestamp_ntz'2025-04-01 00:00:00' as deleted_at", "key"))
    for steps in (1, 3):
        store = orphans.OrphanStore(spark, str(tmp_path / f"o{steps}"), once=False)
        rows = lambda df: sorted((r.rel_id, r.ref_field, r.key, r.state) for r in df.collect())
        assert rows(orphans.found(rels, ents, chunks, store, steps)) == rows(orphans.probe(rels, ents, chunks))
        assert store._manifest()["version"] == steps


def agree(store):
    """The snapshot says what the references say."""
    want = {tuple(r) for r in orphans.counts(store.references()).collect()}
    assert {tuple(r) for r in store.snapshot().collect()} == want


def test_steps_equal_one_load(spark, tmp_path):
    rels, ents, chunks = frames(spark)
    store = orphans.OrphanStore(spark, str(tmp_path / "o"))
    assert store.snapshot().count() == 0 and store.references().count() == 0
    store.apply(parents=orphans.entity_parents(ents.where("entity_id < 4")))  # parents before any reference
    store.apply(refs=orphans.references(rels.where("rel_id <= 2")))
    assert (1, "chunk_id", "missing") in got(store.references())
    store.apply(parents=orphans.entity_parents(ents), batch="e-0")
    store.apply(refs=orphans.references(rels), parents=orphans.chunk_parents(chunks))  # two references again
    assert got(store.references()) == WANT and store.references().count() == 11
    agree(store)
    before = store._manifest()
    store.apply(parents=orphans.entity_parents(ents.limit(0)), batch="e-0").apply(refs=orphans.references(rels.limit(0)))
    assert store._manifest()["refs"] == before["refs"]
    # a withdrawal reopens what was resolved, also beside the row itself in one delta, in any order
    went = ents.where("entity_id = 1").selectExpr("entity_id", "name", "ticker", "extracted_at", "timestamp_ntz'2025-02-03 00:00:00' as deleted_at")
    both = orphans.entity_parents(went).unionByName(orphans.entity_parents(ents.where("entity_id = 1")))
    store.apply(parents=both)
    assert {(1, "source", "deleted"), (4, "source", "deleted")} <= got(store.references())
    agree(store)
    # and a row that comes again resolves it again
    store.apply(parents=orphans.entity_parents(ents.where("entity_id = 1")))
    assert got(store.references()) == WANT


def test_a_delta_touches_its_buckets_only(spark, tmp_path):
    rels, ents, chunks = frames(spark)
    store = orphans.OrphanStore(spark, str(tmp_path / "o"))
    store.apply(orphans.references(rels), orphans.entity_parents(ents).unionByName(orphans.chunk_parents(chunks)))
    before = store._manifest()
    scans = lambda: store.references()._jdf.queryExecution().toString().count("FileScan")
    first = scans()
    for i in range(5):
        store.apply(parents=orphans.entity_parents(ents.where("entity_id = 3")))
    after = store._manifest()
    moved = [b for b in after["refs"] if after["refs"][b] != before["refs"][b]]
    assert len(moved) == 1 and scans() == first
    # folders that no bucket names go
    assert len(list((tmp_path / "o").iterdir())) <= 5


def test_streams(spark, tmp_path):
    rels, ents, chunks = frames(spark)
    store = orphans.OrphanStore(spark, str(tmp_path / "o"))
    for name, df, rows in (("c", chunks, orphans.chunk_parents), ("r", rels, orphans.references), ("e", ents, orphans.entity_parents)):
        df.repartition(2).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        for _ in range(2):  # the second run finds nothing new
            windows.orphan_stream(store, stream, rows, str(tmp_path / f"{name}-at"))
    assert got(store.references()) == WANT
    agree(store)
