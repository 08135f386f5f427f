"""References to records that do not exist, kept up to date incrementally.

A store holds two keyed tables by bucket of the key's hash: the parent rows seen so
far and the references with their present state, which wait there for their
parents.  A delta reads and writes the buckets of the keys it names and no other:
new references probe the parents of their keys, arriving parents resolve the
references that wait for them, withdrawals reopen references that were resolved.
Each bucket keeps its counts of orphans, so a snapshot adds up counts only.

Defined results: a null or blank reference is no reference; a null ticker, like
an unknown one, has no parents, so a name under it is ``missing``; a parent row
with a null key is ignored; a live parent without a time is never ``late``, nor
is a reference without one; empty tables give empty results (or only
``missing``); columns that are not named below are ignored.  In a store a
reference or a parent that is delivered again counts once; of several versions
of a parent (one pid) the last delivered stands, within a delta the one with the
latest change, the withdrawn one of two at the same time; a delta whose batch
number was applied before changes nothing.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.text import fold
from quarrylight.session import cut, delete, exists, read_small, write_small

NAMES, CHUNKS = "entities", "chunks"
KEYS = ("space", "scope", "key")
#: Numbers of applied batches that a store remembers.
REMEMBERED = 1000


def entity_parents(entities: DataFrame, pid: Column | None = None) -> DataFrame:
    """``pid``: what tells versions of one parent from other parents; the entity_id without it."""
    return entities.where(F.col("name").isNotNull() & F.col("ticker").isNotNull()).select(
        F.lit(NAMES).alias("space"),
        F.col("ticker").alias("scope"),
        fold(F.col("name")).alias("key"),
        F.concat(F.lit("e"), F.col("entity_id").cast("string") if pid is None else pid).alias("pid"),
        F.col("extracted_at").alias("seen_at"),
        F.col("deleted_at").isNotNull().alias("gone"),
        F.coalesce("deleted_at", "extracted_at").alias("changed_at"),
    )


def chunk_parents(chunks: DataFrame, pid: Column | None = None) -> DataFrame:
    """One parent per ingestion: a re-ingested chunk_id is two rows of one key; ``pid`` as for entities."""
    return chunks.where(F.col("chunk_id").isNotNull()).select(
        F.lit(CHUNKS).alias("space"),
        F.lit("").alias("scope"),
        F.col("chunk_id").alias("key"),
        F.concat(F.lit("c"), F.concat(F.col("chunk_id"), F.lit("@"), F.coalesce(F.col("ingested_at").cast("string"), F.lit(""))) if pid is None else pid).alias("pid"),
        F.col("ingested_at").alias("seen_at"),
        F.col("deleted_at").isNotNull().alias("gone"),
        F.coalesce("deleted_at", "ingested_at").alias("changed_at"),
    )


def references(relationships: DataFrame) -> DataFrame:
    """One row for each non-blank source, target and chunk_id."""
    name = lambda f: F.struct(F.lit(f).alias("ref_field"), F.lit(NAMES).alias("space"), F.coalesce("ticker", F.lit("")).alias("scope"), fold(F.col(f)).alias("key"))
    chunk = F.struct(F.lit("chunk_id").alias("ref_field"), F.lit(CHUNKS).alias("space"), F.lit("").alias("scope"), F.col("chunk_id").alias("key"))
    return (
        relationships.select("rel_id", "source", "target", "chunk_id", "ticker", "fiscal_period", "extracted_at")
        .select("rel_id", "fiscal_period", F.col("extracted_at").alias("ref_at"), F.inline(F.array(name("source"), name("target"), chunk)))
        .where(F.col("key").isNotNull() & (fold(F.col("key")) != ""))
    )


def _facts(parents: DataFrame) -> DataFrame:
    """What decides a key's state; combines map-side, so a hot key costs one row per task."""
    live = ~F.col("gone")
    return parents.groupBy(*KEYS).agg(
        F.max(live).alias("any_live"),
        F.max(live & F.col("seen_at").isNull()).alias("timeless"),
        F.min(F.when(live, F.col("seen_at"))).alias("first_live"),
    )


def _state() -> Column:
    return (
        F.when(F.col("any_live").isNull(), "missing")
        .when(~F.col("any_live"), "deleted")
        .when(~F.col("timeless") & (F.col("first_live") > F.col("ref_at")), "late")
        .otherwise("found")
    )


def _probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    # the parent side holds one row a key, so a hot key is skew of the reference
    # side alone, which AQE splits for a left outer sort-merge join
    return refs.join(_facts(parents), [*KEYS], "left").select(*refs.columns, _state().alias("state"))


def probe(relationships: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """All references of whole tables with their state, in one join; every row is a version of its own."""
    return _probe(references(relationships), entity_parents(entities).unionByName(chunk_parents(chunks)))


def orphans(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("state") != "found")


def counts(refs: DataFrame) -> DataFrame:
    """Orphans per referenced table, fiscal period and state."""
    return orphans(refs).groupBy(F.col("space").alias("ref_table"), "fiscal_period", "state").agg(F.count("*").alias("n_orphans"))


_LOCK = RLock()
PARENT = "space string, scope string, key string, pid string, seen_at timestamp_ntz, gone boolean, changed_at timestamp_ntz"
REFERENCE = "rel_id bigint, fiscal_period string, ref_at timestamp_ntz, ref_field string, space string, scope string, key string, state string"
COUNT = "ref_table string, fiscal_period string, state string, n_orphans bigint"


@dataclass(frozen=True)
class OrphanStore:
    """The stored state after the deltas so far; the manifest is written last and names the folder of each bucket."""

    spark: SparkSession
    path: str
    #: Folders of a store, the most that a delta writes; fixed when it is made: some thousand for a large one.
    buckets: int = 16
    #: Whether a reference that comes again counts once; where nothing is delivered twice, each row stands for itself.
    once: bool = True

    def _manifest(self) -> dict:
        at = os.path.join(self.path, "manifest.json")
        if not exists(self.spark, at):
            return {"version": 0, "buckets": self.buckets, "batches": [], "parents": {}, "refs": {}, "counts": {}, "old": []}
        return json.loads(read_small(self.spark, at))

    def _read(self, m: dict, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        wanted = m[table] if buckets is None else {str(b): m[table][str(b)] for b in buckets if str(b) in m[table]}
        paths = [os.path.join(self.path, folder, table, f"bucket={b}") for b, folder in sorted(wanted.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, refs: DataFrame | None = None, parents: DataFrame | None = None, batch: str | None = None) -> OrphanStore:
        """Apply a delta: rows of ``references`` and of ``*_parents`` (a withdrawal repeats its row with gone = true)."""
        with _LOCK:
            m = self._manifest()
            if batch is not None and batch in m["batches"]:
                return self
            place = F.pmod(F.xxhash64(*KEYS), F.lit(m["buckets"])).cast("int").alias("bucket")
            deltas = {n: cut(d.select(*[c.split()[0] for c in schema.split(", ") if c != "state string"], place)) for n, d, schema in (("parents", parents, PARENT), ("refs", refs, REFERENCE)) if d is not None}
            touched = sorted({r["bucket"] for d in deltas.values() for r in d.select("bucket").distinct().collect()})
            folder = f"delta-{m['version'] + 1}"
            at = os.path.join(self.path, folder)
            delete(self.spark, at)  # what a delta that was not finished has left
            if touched:
                self._write_parents(m, deltas.get("parents"), place, touched, at)
                m = self._moved(m, "parents", touched, folder)
                self._write_refs(m, deltas.get("refs"), place, touched, at)
                for table in ("refs", "counts"):
                    m = self._moved(m, table, touched, folder)
            live = {f for t in ("parents", "refs", "counts") for f in m[t].values()}
            gone = sorted({f"delta-{v}" for v in range(max(1, m["version"] - 2 * m["buckets"]), m["version"] + 1)} - live)
            before = m["old"]
            m |= {"version": m["version"] + 1, "old": gone, "batches": [*m["batches"], *([batch] if batch is not None else [])][-REMEMBERED:]}
            write_small(self.spark, os.path.join(self.path, "manifest.json"), json.dumps(m))
            # folders go a delta after they were last named, so that a reader of the former state can end
            for f in before:
                delete(self.spark, os.path.join(self.path, f))
            return self

    def _moved(self, m: dict, table: str, touched: list[int], folder: str) -> dict:
        now = dict(m[table])
        for b in touched:
            now.pop(str(b), None)
            if exists(self.spark, os.path.join(self.path, folder, table, f"bucket={b}")):
                now[str(b)] = folder
        return {**m, table: now}

    def _write_parents(self, m: dict, new: DataFrame | None, place: Column, touched: list[int], at: str) -> None:
        rows = self._read(m, "parents", PARENT, touched).withColumn("turn", F.lit(0)).withColumn("bucket", place)
        if new is not None:
            rows = rows.unionByName(new.withColumn("turn", F.lit(1)))
        cols = [c.split()[0] for c in PARENT.split(", ") if not c.startswith("pid")]
        last = rows.groupBy("bucket", "pid").agg(F.max_by(F.struct(*cols), F.struct("turn", "changed_at", "gone")).alias("r"))
        last.select("bucket", "pid", "r.*").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(os.path.join(at, "parents"))

    def _write_refs(self, m: dict, new: DataFrame | None, place: Column, touched: list[int], at: str) -> None:
        rows = self._read(m, "refs", REFERENCE, touched).drop("state").withColumn("bucket", place)
        if new is not None:
            rows = rows.unionByName(new)
        known = _probe(rows, self._read(m, "parents", PARENT, touched))
        # after the join rows of a key are in one place, so that what came again goes without a shuffle
        if self.once:
            known = known.dropDuplicates(["rel_id", "ref_field", *KEYS])
        known.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(os.path.join(at, "refs"))
        if exists(self.spark, os.path.join(at, "refs"), "bucket="):
            each = self.spark.read.schema(f"{REFERENCE}, bucket int").parquet(os.path.join(at, "refs"))
            n = orphans(each).groupBy("bucket", F.col("space").alias("ref_table"), "fiscal_period", "state").agg(F.count("*").alias("n_orphans"))
            n.coalesce(1).write.partitionBy("bucket").parquet(os.path.join(at, "counts"))

    def references(self) -> DataFrame:
        """Every reference with its present state."""
        return self._read(self._manifest(), "refs", REFERENCE)

    def snapshot(self) -> DataFrame:
        """Orphans per referenced table, fiscal period and state, from the counts of the buckets."""
        n = self._read(self._manifest(), "counts", COUNT)
        return n.groupBy("ref_table", "fiscal_period", "state").agg(F.sum("n_orphans").alias("n_orphans"))


def _versions(table: DataFrame, parents, time: str) -> DataFrame:
    """Each row as it came, and once more as it was withdrawn later."""
    late = F.col("deleted_at").isNotNull() & F.coalesce(F.col("deleted_at") > F.col(time), F.lit(True))
    came = parents(table.withColumn("deleted_at", F.when(~late, F.col("deleted_at")))).withColumn("changed_at", F.col("seen_at"))
    return came.unionByName(parents(table.where(late)))


def replay(relationships: DataFrame, entities: DataFrame, chunks: DataFrame, store: OrphanStore, steps: int = 10) -> DataFrame:
    """(step, ref_table, fiscal_period, state, n_orphans): the tables in deltas of equal time, a snapshot after each.

    Rows come in the step of their time and are withdrawn in that of their deleted_at;
    what has no time comes first.
    """
    parents = _versions(entities, entity_parents, "extracted_at").unionByName(_versions(chunks, chunk_parents, "ingested_at"))
    out = None
    for i in _deltas(references(relationships), parents, store, steps):
        seen = cut(store.snapshot().select(F.lit(i).alias("step"), "ref_table", "fiscal_period", "state", "n_orphans"))
        out = seen if out is None else out.unionByName(seen)
    return out


def found(relationships: DataFrame, entities: DataFrame, chunks: DataFrame, store: OrphanStore, steps: int = 3) -> DataFrame:
    """All references with the state that they have after the tables came in deltas of equal time.

    Every row of the tables is a version of its own: one that agrees with another in
    all that decides is no other parent, whatever ids they have.
    """
    same = lambda df, *cols: df.withColumn("_row", F.to_json(F.struct(*cols)))
    e = _versions(same(entities, "name", "ticker", "extracted_at", "deleted_at"), lambda t: entity_parents(t, F.col("_row")), "extracted_at")
    c = _versions(same(chunks, "chunk_id", "ingested_at", "deleted_at"), lambda t: chunk_parents(t, F.col("_row")), "ingested_at")
    for _ in _deltas(references(relationships), e.unionByName(c), store, steps):
        pass
    return store.references()


def _deltas(refs: DataFrame, parents: DataFrame, store: OrphanStore, steps: int) -> Iterator[int]:
    """Apply what comes and goes in each of so many steps of equal time; gives the step when it is applied."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ends = refs.agg(F.min(us("ref_at")), F.max(us("ref_at"))).first(), parents.agg(F.min(us("changed_at")), F.max(us("changed_at"))).first()
    lo, hi = min((e[0] for e in ends if e[0] is not None), default=0), max((e[1] for e in ends if e[1] is not None), default=0)
    span = max(1, hi - lo)
    step = lambda c: F.coalesce(F.greatest(F.lit(1), F.floor(((us(c) - lo) * steps + (span - 1)) / span).cast("int")), F.lit(1))
    # what comes in a step is laid out once, so that a delta reads its own rows only
    at = os.path.join(store.path, "arrivals")
    for name, rows, time in (("refs", refs, "ref_at"), ("parents", parents, "changed_at")):
        rows.withColumn("step", step(time)).hint("rebalance", "step").write.partitionBy("step").parquet(os.path.join(at, name))
    for i in range(1, steps + 1):
        came = [os.path.join(at, name, f"step={i}") for name in ("refs", "parents")]
        store.apply(*(refs.sparkSession.read.parquet(p) if exists(refs.sparkSession, p) else None for p in came))
        yield i
    delete(refs.sparkSession, at)
