"""Mixing sources to target shares of all tokens.

Weights start from the natural token shares p of the sources; each source's
up-weighting target / p is raised to an exponent, which is one if the budget
lets every source reach its target within its repetition limit, and is bisected
down otherwise.  ``temperature`` and ``exponent_for_entropy`` give the plain
form, in which p itself is exponentiated.  With ``of_all`` the budget is that share
of all tokens that the sources have, and then limits bind and the exponent is bisected.  A weight is realised in blocks: whole
passes over the source, then the head of a pass in hashed order that ends next to the
budget, so that a source misses its weight by half a document at most.

Defined results: a target of a source without tokens is reported with a reached
share of zero, and the other shares keep their proportions; documents without
tokens, or of other or null sources, are not used; null, negative or repeated
targets count as zero, zero and their sum; empty tables give an empty mix; the
result holds a document once, with the number of its uses; other columns are
ignored.
"""

from __future__ import annotations

from math import floor, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylight.llm.tokens import count_tokens
from quarrylight.session import cut

#: Buckets of a source's hashed order; prefix sums run over sources x BUCKETS rows.
BUCKETS = 1024
#: The most rows of targets that are read to the driver.
MOST_SOURCES = 10_000


def temperature(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares proportional to size ** exponent."""
    total = sum(sizes.values())
    raised = {s: (n / total) ** exponent for s, n in sizes.items() if n > 0}
    norm = sum(raised.values())
    return {s: x / norm for s, x in raised.items()}


def _bisect(holds, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The largest exponent in [low, high] for which ``holds``, which holds at low and is monotone."""
    if holds(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def exponent_for_entropy(sizes: dict[str, float], entropy: float) -> float:
    """The exponent whose shares have at least this entropy (in nats); one if the natural shares do."""
    return _bisect(lambda a: -sum(w * log(w) for w in temperature(sizes, a).values() if w > 0) >= entropy)


def plan(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, int], budget: int | None = None) -> tuple[dict[str, int], float]:
    """(tokens to draw of each source, exponent).  Without a budget: the largest one at which all targets hold."""
    live = {s: n for s, n in sizes.items() if n > 0 and targets.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not live:
        return {}, 1.0
    total, want = sum(live.values()), sum(targets[s] for s in live)
    natural = {s: n / total for s, n in live.items()}
    goal = {s: targets[s] / want for s in live}
    caps = {s: live[s] * repeats[s] for s in live}
    if budget is None:
        budget = floor(min(caps[s] / goal[s] for s in live))

    def weights(a: float) -> dict[str, float]:
        raised = {s: natural[s] * (goal[s] / natural[s]) ** a for s in live}
        norm = sum(raised.values())
        return {s: x / norm for s, x in raised.items()}

    a = _bisect(lambda e: all(weights(e)[s] * budget <= caps[s] * (1 + 1e-12) for s in live))
    return {s: min(floor(w * budget + 1e-6), caps[s]) for s, w in weights(a).items()}, a


def _targets(targets: DataFrame) -> DataFrame:
    return targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(0)).alias("max_repeats"))


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 42, path: str | None = None, of_all: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(used documents with tokens and uses, shares that were reached).

    Without ``budget`` and ``of_all`` the targets are met exactly, and the scarcest source sets the size.
    """
    spark = documents.sparkSession
    goals = _targets(targets)
    rows = goals.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    wanted = [r["source"] for r in rows if r["target_share"] > 0 and r["max_repeats"] > 0]
    order = F.xxhash64(F.lit(seed), "doc_id")
    sized = cut(
        count_tokens(documents.where(F.col("source").isin(wanted)), "doc_id", "source", path=path)
        .where(F.col("n_tokens") > 0)
        .withColumn("ord", order)
        .withColumn("bucket", F.shiftrightunsigned("ord", 64 - BUCKETS.bit_length() + 1).cast("int"))
    )
    # at most sources x BUCKETS rows, whatever the corpus
    buckets = cut(sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest")))
    have = {r["source"]: r["tokens"] for r in buckets.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    if of_all is not None:
        budget = floor(of_all * sum(have.values()))
    draws, exponent = plan(have, {r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}, budget)
    passes = [(s, n // have[s], n % have[s]) for s, n in draws.items()]
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("full", T.LongType()), T.StructField("rest", T.LongType())])
    passes = F.broadcast(spark.createDataFrame(passes, schema))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
    edges = buckets.withColumn("upto", upto).join(passes, "source").select("source", "bucket", "full", "rest", (F.col("upto") - F.col("tokens")).alias("start"), "upto")
    placed = sized.join(F.broadcast(edges), ["source", "bucket"])
    # only the one bucket in which a source's last pass ends is ordered
    ends = (F.col("start") < F.col("rest")) & (F.col("rest") < F.col("upto"))
    whole = placed.where(~ends).withColumn("extra", (F.col("upto") <= F.col("rest")).cast("bigint"))
    run = F.col("start") + F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    last = placed.where(ends).withColumn("extra", (run - F.col("n_tokens") / 2 <= F.col("rest")).cast("bigint"))
    used = (
        whole.unionByName(last)
        .select("doc_id", "source", "n_tokens", (F.col("full") + F.col("extra")).alias("repeats"))
        .where(F.col("repeats") > 0)
    )
    drawn = used.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    found = buckets.groupBy("source").agg(F.sum("tokens").alias("tokens_available"), F.max("longest").alias("longest_document"))
    shares = goals.join(drawn, "source", "left").join(found, "source", "left").select("source", "target_share", "max_repeats", zero("n_documents"), zero("tokens_available"), zero("longest_document"), zero("tokens_used"), zero("most_repeats"))
    all_used = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))  # one row a target source
    shares = shares.withColumn("reached_share", F.when(all_used > 0, F.col("tokens_used") / all_used).otherwise(F.lit(0.0))).withColumn("exponent", F.lit(exponent))
    return used, shares


def balance(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, within_repeats, near_target) of the sources that have tokens, counted again from the used documents.

    A source misses what it is to give by half its longest document at most; a share is
    near its target if that explains the miss, its own and that of all sources together.
    """
    used, shares = mix(documents, targets)
    n = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("repeats"))
    there = shares.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens_available") > 0))
    met = there.select("source", "target_share", "max_repeats", "longest_document").join(n, "source", "left").fillna(0, ["tokens", "repeats"])
    every = Window.partitionBy(F.lit(1))  # one row a target source
    total = F.greatest(F.sum("tokens").over(every), F.lit(1))
    share, goal = F.col("tokens") / total, F.col("target_share") / F.sum("target_share").over(every)
    slack = (F.col("longest_document") + goal * F.sum("longest_document").over(every)) / 2 / total
    return met.select("source", (F.col("repeats") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(share - goal) <= slack + 1 / total).alias("near_target"))
