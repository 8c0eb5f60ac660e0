"""Joins, rankings, crosstabs and sampling as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import hash_bucket


def diff_sides(pre: DataFrame, post: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer diff: kept, modified, new or cancelled per key, with both values."""
    a, b = pre.select(*keys, F.col(value).alias("pre"), F.lit(1).alias("in_pre")), post.select(*keys, F.col(value).alias("post"), F.lit(1).alias("in_post"))
    status = F.when(F.col("in_pre").isNull(), "new").when(F.col("in_post").isNull(), "cancelled").when(F.col("pre").eqNullSafe(F.col("post")), "kept").otherwise("modified")
    return a.join(b, keys, "full").select(*keys, status.alias("status"), "pre", "post")


def around(pivots: DataFrame, facts: DataFrame, key: str, at: str, when: str, ident: str) -> DataFrame:
    """Per pivot the last fact not after it and the first fact after it (as-of both ways), ties by ``ident``.

    One equi join on the key and one aggregation; nothing is ordered globally.
    """
    both = pivots.select(key, F.col(at).alias("_at")).join(facts.select(key, F.col(when).alias("_t"), F.col(ident).alias("_id")), key, "left")
    rank = F.struct("_t", "_id")
    return both.groupBy(key, F.col("_at").alias(at)).agg(
        F.max(F.when(F.col("_t") <= F.col("_at"), rank)).getField("_id").alias("before_id"),
        F.min(F.when(F.col("_t") > F.col("_at"), rank)).getField("_id").alias("after_id"),
    )


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group, with their rank from 1; ``order`` must break ties."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def top_k_distinct(df: DataFrame, groups: list[str], dedup: str, order: list[Column], k: int) -> DataFrame:
    """Greedy top k that takes each ``dedup`` value once: its best row first, then the best k."""
    return top_k(top_k(df, [*groups, dedup], order, 1).drop("rank"), groups, order, k)


def hash_k(df: DataFrame, group: str, ident: str, salt: str, k: int) -> DataFrame:
    """k rows of every group without replacement, in the order of a salted SHA-256."""
    key = F.sha2(F.concat_ws("::", F.col(group).cast("string"), F.lit(salt), F.col(ident).cast("string")), 256)
    return top_k(df.withColumn("_key", key), [group], [F.col("_key"), F.col(ident)], k).drop("_key")


def bucket_split(df: DataFrame, ident: str, n: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Cohort (ids whose hash falls into the bucket) and pool (all other rows), disjoint by id."""
    cohort = df.where(hash_bucket(F.col(ident).cast("string"), n) == bucket)
    return cohort, df.join(cohort.select(ident), ident, "left_anti")


def pending(grid: DataFrame, done: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """What of a planned grid is neither completed nor known to fail."""
    return grid.join(done.select(*keys), keys, "left_anti").join(failed.select(*keys), keys, "left_anti")


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts with row, column and grand totals; totals are named ``(all)``."""
    total = lambda c: F.when(F.grouping(c) == 1, F.lit("(all)")).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("(null)")))
    return df.cube(row, column).agg(F.count("*").alias("n"), total(row).alias("row_value"), total(column).alias("column_value")).select("row_value", "column_value", "n")


def shares(df: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Counts and percent of the total."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.round(100 * F.col("n") / F.col("total"), digits).alias("pct"))


def against_targets(df: DataFrame, key: str, targets: dict[str, int]) -> DataFrame:
    counts = df.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
    table = df.sparkSession.createDataFrame(sorted(targets.items()), "value string, target long")
    return table.join(counts, "value", "left").select("value", "target", F.coalesce("n", F.lit(0)).alias("achieved"), (F.coalesce("n", F.lit(0)) - F.col("target")).alias("delta"))


def histogram(df: DataFrame, value: str, edges: list[int]) -> DataFrame:
    """Counts of ``value`` up to each edge, and beyond the last; nulls are a bucket of their own."""
    label, low = F.when(F.col(value).isNull(), "(null)"), None
    for e in edges:
        name = f"<={e}" if low is None else f"{low + 1}-{e}"
        label = label.when(F.col(value) <= e, name)
        low = e
    return df.groupBy(label.otherwise(f">{low}").alias("bucket")).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def phrase_counts(df: DataFrame, tokens: Column, ident: str, n: int, artifacts: list[str] = ()) -> DataFrame:
    """Every n-gram with its count and document frequency, without those that hold an artifact token.

    Positions are exploded before their words are joined, so the whole scan is
    one generated loop; counts are partial in every task.
    """
    words = df.select(ident, tokens.alias("_w")).where(F.size("_w") >= n)
    places = words.select(ident, "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - n)).alias("_i"))
    grams = places.select(ident, F.concat_ws(" ", *[F.get("_w", F.col("_i") + k) for k in range(n)]).alias("phrase"))
    counts = grams.groupBy("phrase", ident).agg(F.count("*").alias("c")).groupBy("phrase").agg(F.sum("c").alias("pool_count"), F.count("*").alias("pool_docs"))
    return counts if not artifacts else counts.where(~F.arrays_overlap(F.split("phrase", " "), F.array(*[F.lit(a) for a in artifacts])))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a number from 0 in the order of ``order``, which has to be unique; ranges are numbered in tasks of their own."""
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    placed = ranged.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1)
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a task
    starts = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_before") + F.col("_k")).cast("long")).drop("_p", "_k", "_before")
