"""Calls of models outside Spark, and the local defaults that stand in for them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.operators.chunking import sentences


def called(fn: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """A batch function as a column function; nondeterministic, so it is not run twice."""

    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(fn(prompts.fillna("").tolist()), dtype=object)

    return F.pandas_udf(run, T.StringType(), 200).asNondeterministic()


def answered(prompts: DataFrame, known: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """(prompt_key, output) of prompts that ``known`` lacks, one call for equal prompts.

    Write the result to ``known`` before using it: a retried task then bills nothing twice.
    """
    keyed = prompts.select(F.sha2("prompt", 256).alias("prompt_key"), "prompt").dropDuplicates(["prompt_key"])
    return keyed.join(known.select("prompt_key"), "prompt_key", "left_anti").select("prompt_key", called(fn)(F.col("prompt")).alias("output"))


def extract(blocks: Column) -> Column:
    """Default generator: the first sentence of each block with its number."""
    first = F.transform(blocks, lambda b, i: F.concat(F.coalesce(F.try_element_at(sentences(b), F.lit(1)), F.lit("")), F.lit(" ["), (i + 1).cast("string"), F.lit("]")))
    return F.when(F.size(blocks) > 0, F.array_join(first, " ")).otherwise("The documents do not contain sufficient information.")
