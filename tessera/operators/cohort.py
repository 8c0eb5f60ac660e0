"""Greedy stratified cohorts by marginal targets."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def greedy_cohort(df: DataFrame, ident: str, axes: dict[str, dict[str, int]], size: int, salt: str = "42") -> DataFrame:
    """``size`` rows whose axis values come nearest to the marginal targets.

    Every round takes a row with the largest sum of unmet targets over its
    values, of several the first in hash order, and goes on at score 0 until
    ``size`` is reached.  Values without a target are "other".  Rows with equal
    values are alike to that rule, so of each vector of values (no more than the
    targets make) only the first ``size`` rows in hash order can be taken: those
    the driver gets, and it walks through them.
    """
    names = sorted(axes)
    order = F.sha2(F.concat_ws("::", F.lit(salt), F.col("_id").cast("string")), 256)
    binned = [F.when(F.col(a).cast("string").isin(*axes[a]), F.col(a).cast("string")).otherwise("other").alias(a) for a in names]
    keyed = df.select(F.col(ident).alias("_id"), *binned).withColumn("_h", order)
    first = keyed.withColumn("_k", F.row_number().over(W.partitionBy(*names).orderBy("_h", "_id"))).where(F.col("_k") <= size)
    queues: dict[tuple, list] = defaultdict(list)
    for r in first.orderBy("_h", "_id").collect():
        queues[tuple(r[a] for a in names)].append((r["_h"], r["_id"]))
    unmet = {a: defaultdict(int, axes[a]) for a in names}
    at, taken = dict.fromkeys(queues, 0), []
    while len(taken) < size and (left := [v for v in queues if at[v] < len(queues[v])]):
        score = {v: sum(max(0, unmet[a][x]) for a, x in zip(names, v, strict=True)) for v in left}
        best = min(left, key=lambda v: (-score[v], queues[v][at[v]][0]))
        taken.append((queues[best][at[best]][1], *best))
        at[best] += 1
        for a, x in zip(names, best, strict=True):
            unmet[a][x] -= 1
    kind = df.schema[ident].dataType.simpleString()
    return df.sparkSession.createDataFrame(taken, f"{ident} {kind}, " + ", ".join(f"{a} string" for a in names))
