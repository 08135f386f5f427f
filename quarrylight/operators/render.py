"""Labels, lines and JSON of results; every function is an expression on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def citation_label(ticker: Column, period: Column, title: Column) -> Column:
    shown = F.when(F.coalesce(title, F.lit("")) == "", "General").otherwise(F.substring(title, 1, 50))
    return F.concat(F.coalesce(ticker, F.lit("")), F.lit(" "), F.coalesce(period, F.lit("")), F.lit(" — "), shown)


def answer_with_sources(answer: Column, labels: Column) -> Column:
    """The answer, then one numbered line a source."""
    lines = F.transform(labels, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    body = F.coalesce(answer, F.lit(""))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.concat(body, F.lit("\n\nSources:\n"), F.array_join(lines, "\n"))).otherwise(body)


def response_json(**fields: Column) -> Column:
    """One JSON object; figures are rounded by the caller, nulls are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def bar(share: Column, width: int = 20) -> Column:
    return F.repeat(F.lit("█"), F.greatest(F.lit(0), F.least(F.lit(width), F.floor(share * width + 0.5))).cast("int"))


# States of a component from good to bad.
STATES = ("healthy", "degraded", "unhealthy")


def worst_state(parts: DataFrame, by: str) -> DataFrame:
    """The worst state of the components of each group; unknown states count as unhealthy."""
    rank = F.when(F.col("state") == STATES[0], 0).when(F.col("state") == STATES[1], 1).otherwise(2)
    return parts.groupBy(by).agg(F.element_at(F.array(*map(F.lit, STATES)), F.max(rank) + 1).alias("state"))


def request_id(given: Column) -> Column:
    """At most 64 characters of what was sent; null if it was blank."""
    return F.nullif(F.substring(F.trim(given), 1, 64), F.lit(""))
