"""Medians, paired tests, multiplicity, correlations and bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def nth(values: str, at: Column) -> Column:
    return F.element_at(F.array_sort(F.collect_list(values)), at + 1)


def upper_median(value: str) -> Column:
    """The element at n // 2 of the sorted values."""
    return nth(value, F.floor(F.count(value) / 2).cast("int"))


def index_quartiles(value: str) -> list[Column]:
    n = F.count(value)
    return [nth(value, F.floor(n / 4).cast("int")).alias("q1"), nth(value, F.floor(3 * n / 4).cast("int")).alias("q3")]


def index_p95(value: str) -> Column:
    return nth(value, F.floor(0.95 * (F.count(value) - 1)).cast("int"))


def mean_then_median(df: DataFrame, groups: list[str], case: str, value: str) -> DataFrame:
    """Mean over repetitions of a case, then the interpolated median over cases."""
    means = df.groupBy(*groups, case).agg(F.avg(value).alias("m"))
    return medians(means, groups, "m").withColumnRenamed("n", "n_cases")


def average_rank(order: str, partition: list[str]) -> Column:
    """Rank from 1, ties get the mean of the ranks they span."""
    return F.rank().over(W.partitionBy(*partition).orderBy(order)) + (F.count("*").over(W.partitionBy(*partition, order)) - 1) / 2.0


def correlation(df: DataFrame, groups: list[str], x: str, y: str, name: str) -> DataFrame:
    """Pearson's r per group; null below 3 rows or where a side does not vary."""
    vary = (F.count("*") >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    n = F.count("*")
    cov = F.sum(F.col(x) * F.col(y)) / n - F.avg(x) * F.avg(y)
    return df.groupBy(*groups).agg(F.when(vary, F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y))).alias(name), n.alias("n"))


def spearman(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    ranked = mid_ranks(mid_ranks(df.select(*groups, x, y), groups, x, "rx"), groups, y, "ry")
    return correlation(ranked, groups, "rx", "ry", "rho")


def holm(df: DataFrame, family: list[str], p: str, ident: str, alpha: float = 0.05) -> DataFrame:
    """Adjusted p values (running maximum) and the step-down rejections per family."""
    order = W.partitionBy(*family).orderBy(p, ident)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    left = F.count("*").over(W.partitionBy(*family)) - F.row_number().over(order) + 1
    steps = df.withColumn("_left", left)
    return steps.withColumns({
        "p_holm": F.max(F.least(F.lit(1.0), F.col("_left") * F.col(p))).over(upto),
        "reject": F.bool_and(F.col(p) <= F.lit(alpha) / F.col("_left")).over(upto),
    }).drop("_left")


def signed_ranks(df: DataFrame, groups: list[str], delta: str) -> DataFrame:
    """Wilcoxon's W+ and W- over non-zero differences with mid-ranks, n, and the tie term sum(t^3 - t)."""
    nz = df.where(F.col(delta) != 0).withColumn("_a", F.abs(delta))
    signs = nz.groupBy(*groups, F.col("_a").alias("_v")).agg(F.count_if(F.col(delta) > 0).alias("_up"), F.count_if(F.col(delta) < 0).alias("_down"))
    ranked = _counted(nz, groups, "_a").join(signs, [*groups, "_v"]).withColumn("_r", F.col("_end") - (F.col("_c") - 1) / 2.0)
    return ranked.groupBy(*groups).agg(
        F.sum(F.col("_r") * F.col("_up")).alias("w_plus"), F.sum(F.col("_r") * F.col("_down")).alias("w_minus"),
        F.sum("_c").alias("n"), F.sum(F.col("_c") * (F.col("_c") * F.col("_c") - 1)).alias("ties"),
    )


def _two_sided(w_plus: float, n: int, ties: float, exact_up_to: int = 50) -> float:
    """Exact by counting subsets of ranks where there are no ties, else the normal approximation."""
    if n == 0:
        return 1.0
    low = min(w_plus, n * (n + 1) / 2 - w_plus)
    if n <= exact_up_to and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(low - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


def wilcoxon(df: DataFrame, groups: list[str], delta: str) -> DataFrame:
    """Paired signed-rank test per group; all differences zero gives p = 1."""

    @F.pandas_udf("double")
    def p_value(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([_two_sided(a, int(b), c) for a, b, c in zip(w, n, ties, strict=True)])

    all_groups = df.select(*groups).distinct()
    got = all_groups.join(signed_ranks(df, groups, delta), groups, "left").fillna(0, ["w_plus", "w_minus", "n", "ties"])
    return got.withColumn("p", p_value("w_plus", "n", F.col("ties").cast("double")))


def bootstrap_tost(df: DataFrame, groups: list[str], delta: str, margin: float = 0.2, rounds: int = 10_000, seed: int = 42, case: str | None = None, alpha: float = 0.05, block_bytes: int = 16 << 20) -> DataFrame:
    """Bootstrap equivalence test of the median difference: percentile intervals and one-sided p values.

    ``equivalent`` asks for p below ``alpha`` and the 90 % interval within the
    margin, its ends included.  A group's values are put in the order of
    ``case`` (else of their size), so a seed always gives the same draws.  A
    group is one sample of an experiment, a number a case; rounds run in blocks
    of ``block_bytes``.
    """
    names = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.dropna(subset=[delta]).sort_values(case or delta, kind="stable")[delta].to_numpy(dtype=float)
        rng, step = np.random.default_rng(seed), max(1, block_bytes // (16 * max(1, len(x))))
        medians = np.concatenate([np.median(x[rng.integers(0, len(x), size=(min(step, rounds - k), len(x)))], axis=1) for k in range(0, rounds, step)]) if len(x) else np.array([np.nan])
        lo95, lo90, hi90, hi95 = np.percentile(medians, [2.5, 100 * alpha, 100 * (1 - alpha), 97.5])
        p = max((medians <= -margin).mean(), (medians >= margin).mean())
        same = bool(len(x)) and p < alpha and lo90 >= -margin and hi90 <= margin
        return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in groups}, "n": len(x), "median": float(np.median(x)) if len(x) else None, "ci90_low": lo90, "ci90_high": hi90, "ci95_low": lo95, "ci95_high": hi95, "p_tost": float(p), "equivalent": bool(same)}])

    return df.groupBy(*groups).applyInPandas(one, f"{names}, n long, median double, ci90_low double, ci90_high double, ci95_low double, ci95_high double, p_tost double, equivalent boolean")


def _counted(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Per group and value ``_v``: ``_c`` rows have it, and ``_end`` rows of the group are no greater; ``n`` rows in the group.

    Nothing is sorted by group: equal values are counted, ranges of the value are
    sorted in tasks of their own, and a task adds what the ranges before it hold,
    so a group of any share of the rows is spread over all tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = counts.agg(F.percentile_approx(F.col("_v").cast("double"), [k / (tasks + 1) for k in range(1, tasks + 1)], 1000).alias("edges"))
    part = F.size(F.filter(F.coalesce("edges", F.expr("CAST(array() AS array<double>)")), lambda e: e < F.col("_v").cast("double")))
    ranged = counts.crossJoin(F.broadcast(edges)).select(*groups, "_v", "_c", part.alias("_part"))  # one row of edges
    sizes = ranged.groupBy(*groups, "_part").agg(F.sum("_c").alias("_s"))  # a row a group and task
    of_group = W.partitionBy(*groups)
    offsets = sizes.select(*groups, "_part", (F.sum("_s").over(of_group.orderBy("_part")) - F.col("_s")).alias("_before"), F.sum("_s").over(of_group).alias("n"))
    ends = F.sum("_c").over(W.partitionBy(*groups, "_part").orderBy("_v"))
    return ranged.withColumn("_end", ends).join(offsets, [*groups, "_part"]).withColumn("_end", F.col("_end") + F.col("_before"))


def values_at(df: DataFrame, groups: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Per group the count ``n`` and the values at ``places``: indexes from 0 in sorted order, as functions of ``n``."""
    at = lambda k: (F.col("_end") - F.col("_c") <= k) & (k < F.col("_end"))
    return _counted(df, groups, value).groupBy(*groups).agg(F.max("n").alias("n"), *[F.max(F.when(at(k), F.col("_v"))).alias(name) for name, k in places.items()])


def medians(df: DataFrame, groups: list[str], value: str, name: str = "median") -> DataFrame:
    """Interpolated medians: the mean of the two middle values, and n."""
    n = F.col("n")
    found = values_at(df, groups, value, {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)})
    return found.select(*groups, ((F.col("_low") + F.col("_high")) / 2).alias(name), "n")


def mid_ranks(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the rank from 1 of ``value`` in its group, ties at the mean of theirs, as average_rank() but spread over tasks."""
    ranks = _counted(df, groups, value).select(*groups, "_v", (F.col("_end") - (F.col("_c") - 1) / 2.0).alias(name))
    return df.withColumn("_v", F.col(value)).join(ranks, [*groups, "_v"]).drop("_v")
