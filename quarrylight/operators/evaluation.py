"""Evaluation statistics over a long table scores (run, sample_id, metric, score, failed)."""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that ``b`` has; null if ``a`` has none."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\w+)"), F.lit(1)))
    return F.round(F.size(F.array_intersect(words(a), words(b))) / F.nullif(F.size(words(a)), F.lit(0)), 6)


def metric_averages(scores: DataFrame) -> DataFrame:
    ok = ~F.coalesce(F.col("failed"), F.lit(False)) & F.col("score").isNotNull()
    return scores.groupBy("run", "metric").agg(F.round(F.coalesce(F.avg(F.when(ok, F.col("score"))), F.lit(0.0)), 6).alias("mean"), F.count(F.when(ok, 1)).alias("n"))


def pass_rate(results: DataFrame) -> DataFrame:
    failed = F.coalesce(F.col("pipeline_failed"), F.lit(False))
    return results.groupBy("run").agg(F.count("*").alias("n"), F.count(F.when(failed, 1)).alias("n_failed"), F.round(F.count(F.when(~failed, 1)) / F.count("*"), 6).alias("pass_rate"))


_CI = "run string, metric string, lo double, hi double"


def bootstrap(scores: DataFrame, draws: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean of each run and metric.

    Every row draws how often it is in each resample (Poisson weights, block by block),
    so rows never meet in one task: only sums of ``draws`` weights do.  Groups of one
    row give its score, empty groups nothing; with few rows the resample of fixed size
    is used instead, by ``small_bootstrap``.
    """
    ok = scores.where(F.col("score").isNotNull() & ~F.coalesce(F.col("failed"), F.lit(False)))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (run, metric), g in pdf.groupby(["run", "metric"], dropna=False):
                total, weight = np.zeros(draws), np.zeros(draws)
                for key, x in zip(g["key"].to_numpy("uint64"), g["score"].to_numpy("float64"), strict=True):
                    w = np.random.default_rng([int(key), seed]).poisson(1.0, draws)
                    total += w * x
                    weight += w
                yield pd.DataFrame({"run": run, "metric": metric, "draw": np.arange(draws, dtype="int32"), "total": total, "weight": weight})

    parts = ok.select("run", "metric", "score", F.abs(F.xxhash64("run", "metric", "sample_id")).alias("key")).mapInPandas(weigh, "run string, metric string, draw int, total double, weight double")
    means = parts.groupBy("run", "metric", "draw").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("m"))
    return means.groupBy("run", "metric").agg(F.round(F.percentile("m", F.lit(alpha / 2)), 6).alias("lo"), F.round(F.percentile("m", F.lit(1 - alpha / 2)), 6).alias("hi"))


def small_bootstrap(values: list[float], draws: int = 1000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """The interval of a list in memory: (0, 0) for none, the value itself for one."""
    if not values:
        return 0.0, 0.0
    x = np.asarray(values, float)
    if len(x) == 1:
        return float(x[0]), float(x[0])
    means = np.random.default_rng(seed).choice(x, (draws, len(x))).mean(1)
    lo, hi = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(lo), float(hi)


def pairs(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, sample_id, x, y) of samples that both runs have."""
    side = lambda run, c: scores.where((F.col("run") == run) & F.col("score").isNotNull()).groupBy("metric", "sample_id").agg(F.avg("score").alias(c))
    return side(a, "x").join(side(b, "y"), ["metric", "sample_id"])


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_pvalue(t: float | None, n: int) -> float:
    """Two-sided p of a paired t statistic; no spread at all counts as no difference."""
    if t is None or t != t:
        return 1.0
    return _beta((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def paired_t(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, n, mean_diff, t_stat, p_value) for metrics with two pairs or more."""
    d = F.col("x") - F.col("y")
    out = pairs(scores, a, b).groupBy("metric").agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).where(F.col("n") >= 2)
    t = F.when(F.col("s") > 1e-12, F.col("m") / (F.col("s") / F.sqrt("n")))
    p = F.pandas_udf(lambda ts, ns: pd.Series([t_pvalue(None if pd.isna(x) else x, int(n)) for x, n in zip(ts, ns, strict=True)]), T.DoubleType(), 200)
    return out.select("metric", "n", F.round("m", 6).alias("mean_diff"), F.round(t, 6).alias("t_stat"), F.round(p(t, F.col("n")), 6).alias("p_value"))


def signed_ranks(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, n, w_plus, w_minus, ties) of the Wilcoxon test, tied differences sharing their mean rank.

    Ranks come from counts of distinct differences, so a metric with many pairs is not
    sorted in one task unless its differences are all distinct.
    """
    d = F.round(F.col("x") - F.col("y"), 9)
    diff = pairs(scores, a, b).select("metric", d.alias("d")).where(F.col("d") != 0)
    sizes = diff.groupBy("metric", F.abs("d").alias("a")).agg(F.count("*").alias("c"), F.count(F.when(F.col("d") > 0, 1)).alias("plus"))
    upto = F.sum("c").over(Window.partitionBy("metric").orderBy("a"))
    ranked = sizes.withColumn("rank", upto - (F.col("c") - 1) / 2)
    return ranked.groupBy("metric").agg(F.sum("c").alias("n"), F.round(F.sum(F.col("rank") * F.col("plus")), 6).alias("w_plus"), F.round(F.sum(F.col("rank") * (F.col("c") - F.col("plus"))), 6).alias("w_minus"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))


def wilcoxon_exact(n: int, w: float) -> float:
    """Two-sided exact p of the smaller rank sum, for up to some hundred pairs without ties."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)


def wilcoxon_normal(n: int, w: float, ties: float = 0.0) -> float:
    """Two-sided p by the normal approximation; ``ties``: the sum of c ** 3 - c over groups of equal differences."""
    mean, sd = n * (n + 1) / 4, sqrt(max(0.0, (n * (n + 1) * (2 * n + 1) - ties / 2) / 24))
    return erfc(abs(w - mean) / sd / sqrt(2)) if sd else 1.0


#: Up to so many pairs without ties the exact distribution is used.
EXACT = 50


def wilcoxon_pvalue(n: int, w_plus: float, w_minus: float, ties: float) -> float:
    """Exact for few pairs without ties, else the normal approximation; no difference at all counts as none."""
    if not n:
        return 1.0
    w = min(w_plus, w_minus)
    return wilcoxon_exact(n, w) if n <= EXACT and not ties else wilcoxon_normal(n, w, ties)


def compare_models(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, n, mean_diff, t_stat, t_p, w_plus, w_minus, wilcoxon_p) of two runs, for metrics with two pairs or more."""
    p = F.pandas_udf(lambda n, x, y, t: pd.Series([wilcoxon_pvalue(*r) for r in zip(n, x, y, t, strict=True)], dtype=float), T.DoubleType(), 200)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    t = paired_t(scores, a, b).withColumnRenamed("p_value", "t_p")
    ranks = signed_ranks(scores, a, b).withColumnRenamed("n", "n_signed")
    both = t.join(ranks, "metric", "left").select("metric", "n", "mean_diff", "t_stat", "t_p", zero("n_signed"), zero("w_plus"), zero("w_minus"), zero("ties"))
    return both.select("metric", "n", "mean_diff", "t_stat", "t_p", "w_plus", "w_minus", F.round(p("n_signed", "w_plus", "w_minus", "ties"), 6).alias("wilcoxon_p"))


def best_arm(averages: DataFrame) -> DataFrame:
    """(metric, arms, winner) over every run: ``arms`` is its table in order of the runs, the winner has the best mean."""
    shown = F.concat(F.col("run"), F.lit("="), F.format_string("%.4f", "mean"))
    rows = averages.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("run", shown.alias("s")))).alias("r"), F.max_by("run", F.struct("mean", F.col("n"))).alias("winner"))
    return rows.select("metric", F.array_join(F.transform("r", lambda x: x["s"]), " ").alias("arms"), "winner")


def by_arm(scores: DataFrame, arms: list[str]) -> DataFrame:
    return scores.where(F.col("score").isNotNull() & ~F.coalesce(F.col("failed"), F.lit(False))).groupBy("metric").pivot("run", arms).agg(F.round(F.avg("score"), 6))


def winner(table: DataFrame, a: str, b: str, least: float = 0.01) -> DataFrame:
    d = F.round(F.col(b) - F.col(a), 6)
    return table.select("metric", d.alias("delta"), F.when(F.abs(d) < least, "tie").when(d > 0, b).otherwise(a).alias("winner"))
