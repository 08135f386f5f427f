"""Aggregates over traces, costs and metrics.

Frame: calls (trace_id, layer, latency, cost, ts, ...) made from the events table in tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LATENCY_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)


def totals(calls: DataFrame, error: Column) -> DataFrame:
    """One row a trace: calls, summed value, the largest one, and DEGRADED if any call failed."""
    return calls.groupBy("trace_id").agg(
        F.count("*").alias("n_calls"),
        F.round(F.sum("value"), 6).alias("total"),
        F.round(F.max("value"), 6).alias("largest"),
        F.when(F.max(error), "DEGRADED").otherwise("OK").alias("status"),
    )


def breakdown(calls: DataFrame) -> DataFrame:
    """(trace_id, parts): map from layer to summed value."""
    each = calls.groupBy("trace_id", F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.round(F.sum("value"), 6).alias("v"))
    return each.groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "v")))).alias("parts"))


def session_costs(calls: DataFrame, limit: float) -> DataFrame:
    """Running cost of each session; ``alert`` is true at the one call that takes it over the limit."""
    w = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("cost").over(w)
    out = calls.withColumn("_run", run)
    return out.select("session", "event_id", "cost", F.round("_run", 6).alias("running"), ((F.col("_run") > limit) & (F.col("_run") - F.col("cost") <= limit)).alias("alert"))


def histogram(values: DataFrame, by: list[str], bounds: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative buckets (le as text, '+Inf' last) with count and sum; one pass, no explosion of rows."""
    per = values.groupBy(*by).agg(*[F.count(F.when(F.col("value") <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("value").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    entry = lambda le, c: F.struct(F.lit(le).alias("le"), F.col(c).alias("cumulative"))
    rows = F.inline(F.array(*[entry(str(b), f"b{i}") for i, b in enumerate(bounds)], entry("+Inf", "n")))
    return per.select(*by, "n", "total", rows)


def quantile(values: DataFrame, by: list[str], q: float, bounds: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """Quantile interpolated within the bucket it falls in; the last bound if it lies beyond."""
    per = values.groupBy(*by).agg(*[F.count(F.when(F.col("value") <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("value").alias("n"))
    goal = F.col("n") * q
    out = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        low, below = (F.lit(float(bounds[i - 1])), F.col(f"b{i - 1}")) if i else (F.lit(0.0), F.lit(0))
        width = F.col(f"b{i}") - below
        at = low + (F.lit(float(bounds[i])) - low) * (goal - below) / F.nullif(width, F.lit(0))
        out = F.when(F.col(f"b{i}") >= goal, F.coalesce(at, low)).otherwise(out)
    return per.where(F.col("n") > 0).select(*by, F.round(out, 6).alias("quantile"))


def route_label(path: Column, known: list[str]) -> Column:
    """A path as the label of a counter: itself if it is a known one, else '/other', so that labels stay few."""
    return F.when(path.isin(*known), path).otherwise("/other")


def over_limit(calls: DataFrame, limit: float) -> DataFrame:
    """The calls that cost more than ``limit`` by themselves."""
    return calls.where(F.col("cost") > limit)
