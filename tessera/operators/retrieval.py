"""Retrieval of exemplars: by structure, at random, by embedding; references that mislead or agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import jaccard
from tessera.operators import relational as R

#: Queries that are sent to the workers at once.
QUERY_BLOCK = 4_096


def structural_top_k(queries: DataFrame, pool: DataFrame, features: list[str], score: Column, k: int, ident: str = "c", name: Column | None = None) -> DataFrame:
    """q, ident, score, rank: the k best of ``pool`` for every query by a score of their features alone, ties by ``name``, then ident.

    Rows with equal features score alike, so distinct features meet, not rows:
    of every class of the pool only its first k + 1 rows can be picked.
    ``score`` names the query's features with the suffix _q.  A row is no
    candidate of the query of its own id.
    """
    name = F.col(ident).cast("string") if name is None else name
    first = R.top_k(pool.select(ident, *features).withColumn("_n", name), features, [F.col("_n"), F.col(ident)], k + 1).drop("rank")
    classes = queries.select(*features).distinct().select(*[F.col(f).alias(f"{f}_q") for f in features])
    scored = classes.crossJoin(pool.select(*features).distinct()).withColumn("score", score)  # distinct features on either side
    near = W.partitionBy(*[f"{f}_q" for f in features]).orderBy(F.desc("score"))
    # k + 1 rows are enough even if one is the query's own, and so are the classes of the k + 1 best scores.
    best = scored.withColumn("_d", F.dense_rank().over(near)).where(F.col("_d") <= k + 1)
    candidates = best.join(first, features)
    mine = queries.select("q", *[F.col(f).alias(f"{f}_q") for f in features]).join(R.top_k(candidates, [f"{f}_q" for f in features], [F.desc("score"), F.col("_n"), F.col(ident)], k + 1).drop("rank"), [f"{f}_q" for f in features])
    return R.top_k(mine.where(F.col("q") != F.col(ident)), ["q"], [F.desc("score"), F.col("_n"), F.col(ident)], k).select("q", ident, "score", "rank")


def random_k(cases: DataFrame, pool: DataFrame, ident: str, order: list[str], k: int, tag: str = "F") -> DataFrame:
    """case_id, ident, rank: k of ``pool`` for every case without replacement, drawn by a salted hash.

    The pool is numbered and a draw is a number, so a case costs a few rows
    whatever the pool's size; drawing goes on far enough that k distinct numbers
    are there, and a pool of no more than k rows is taken whole.
    """
    n = pool.count()
    draws = 8 * k + 24
    numbers = R.numbered(pool.select(*{ident: 0, **dict.fromkeys(order)}), order, "_number").select(ident, "_number")
    key = lambda j: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("::", F.col("case_id").cast("string"), F.lit(tag), j.cast("string")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(max(1, n)))
    drawn = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), key)) if n > k else F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, n - 1)).cast("bigint"))
    picks = cases.select("case_id", F.posexplode(F.slice(drawn, 1, k)).alias("rank", "_number"))
    return picks.join(numbers, "_number").select("case_id", ident, (F.col("rank") + 1).cast("long").alias("rank"))


def dense_top_k(queries: DataFrame, pool: DataFrame, k: int, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """q, c, label, cosine, rank: the k nearest of ``pool`` (c, label, v) for every query (q, v) by cosine, each label once, ties by c; a row is not its own neighbour.

    Queries go to the workers in counted blocks; a batch of the pool is one
    matrix product, and only its best rows of k labels a query are shuffled.
    """
    spark = pool.sparkSession
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "v").orderBy("q").collect()
        if not rows:
            continue
        m = np.array([r.v for r in rows], dtype=np.float64)
        sent = spark.sparkContext.broadcast((np.array([r.q for r in rows]), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)))

        def near(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, m = sent.value
            for batch in batches:
                c, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                if not len(c):
                    continue
                p = np.stack(batch.column(2).to_numpy(zero_copy_only=False)).astype(np.float64)
                cosine = np.round(m @ (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)).T, digits)
                cosine[ids[:, None] == c[None, :]] = -np.inf
                _, kind = np.unique(labels, return_inverse=True)
                q, at = [], []
                for i, row in enumerate(cosine):
                    order = np.lexsort((c, -row))
                    order = order[np.sort(np.unique(kind[order], return_index=True)[1])[:k]]  # the first of each label
                    order = order[row[order] > -np.inf]
                    q.append(np.full(len(order), i))
                    at.append(order)
                q, at = np.concatenate(q), np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(c[at]), batch.column(1).take(pa.array(at)), pa.array(cosine[q, at])], ["q", "c", "label", "cosine"])

        label = pool.schema["label"].dataType.simpleString()
        found = pool.select(F.col("c").cast("long").alias("c"), "label", "v").mapInArrow(near, f"q long, c long, label {label}, cosine double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"q long, c long, label {pool.schema['label'].dataType.simpleString()}, cosine double, rank int")
    return R.top_k_distinct(out, ["q"], "label", [F.desc("cosine"), F.col("c")], k)


def _classes(df: DataFrame, ident: str) -> DataFrame:
    """Distinct (statute, tokens) with the first id as a text, and their number."""
    return df.groupBy("statute", "tokens").agg(F.min(F.col(ident).cast("string")).alias("first"), F.count("*").alias("rows"))


def _best(cases: DataFrame, scored: DataFrame, order: list[Column]) -> DataFrame:
    best = R.top_k(scored, ["statute", "tokens"], order, 1)
    return cases.join(best.select("statute", "tokens", F.col("first").alias("source"), F.round("similarity", 4).alias("similarity"), F.col("other").alias("source_statute")), ["statute", "tokens"])


def mechanism_true(cases: DataFrame, pool: DataFrame, ident: str) -> DataFrame:
    """For every case (case_id, statute, tokens, a sorted array) the pool's row of the same statute whose tokens are least alike; ties by the lowest id as a text."""
    p = _classes(pool, ident).select(F.col("statute"), F.col("tokens").alias("t"), "first", F.col("statute").alias("other"))
    scored = cases.select("statute", "tokens").distinct().join(p, "statute").withColumn("similarity", jaccard(F.col("tokens"), F.col("t")))
    return _best(cases, scored, [F.col("similarity"), F.col("first")])


def decoy(cases: DataFrame, pool: DataFrame, ident: str) -> DataFrame:
    """For every case the pool's row of another statute whose tokens are most alike; ties by the lowest id as a text.

    Only rows that share a token are compared, through an index of tokens; a
    case that shares none with any gets the first id of another statute.
    """
    p = _classes(pool, ident).select(F.col("statute").alias("other"), F.col("tokens").alias("t"), "first")
    mine = cases.select("statute", "tokens").distinct()
    met = mine.select("*", F.explode("tokens").alias("token")).join(p.select("*", F.explode("t").alias("token")), "token").where(F.col("statute") != F.col("other")).select("statute", "tokens", "other", "t", "first").distinct()
    scored = met.withColumn("similarity", jaccard(F.col("tokens"), F.col("t")))
    least = p.groupBy("other").agg(F.min("first").alias("first"))  # a row a statute
    two = least.orderBy("first").limit(2)
    far = mine.join(F.broadcast(two), F.col("statute") != F.col("other")).select("statute", "tokens", "other", F.expr("CAST(array() AS array<string>)").alias("t"), "first", F.lit(0.0).alias("similarity"))
    return _best(cases, scored.unionByName(far), [F.desc("similarity"), F.col("first")])


def quality_log(picks: DataFrame, cases: DataFrame, pool: DataFrame, score: Column) -> DataFrame:
    """case_id, cond, rank, cosine, score and whether the statute matches, of picks looked up in the pool; nulls where it has no such row."""
    a = cases.select("case_id", F.col("v").alias("v_q"), F.col("statute").alias("statute_q"))
    b = pool.select("c", "v", "statute")
    dot = F.aggregate(F.zip_with("v_q", "v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return picks.join(a, "case_id").join(b, "c", "left").select("case_id", "cond", "rank", "c", F.when(F.col("v").isNotNull(), dot).alias("cosine"), F.when(F.col("statute").isNotNull(), score).alias("score"), (F.col("statute") == F.col("statute_q")).alias("same_statute"))


def quality_summary(log: DataFrame) -> DataFrame:
    """Picks, mean cosine, mean score and share of equal statutes by condition."""
    return log.groupBy("cond").agg(F.count("*").alias("n"), F.round(F.avg("cosine"), 5).alias("mean_cosine"), F.round(F.avg("score"), 5).alias("mean_score"), F.round(F.avg(F.col("same_statute").cast("int")), 5).alias("statute_rate"))


def semantic_scores(pairs: DataFrame, case: str, before: str, after: str, embed) -> DataFrame:
    """C1 by meaning: cosine of what ``embed`` (texts to vectors) makes of two texts' trigrams, averaged over a case's rows and rounded once.

    The embedder is the caller's: any function from a list of texts to a matrix.
    """
    from tessera.functions.text import trigram_set

    bag = lambda c: F.array_join(F.array_sort(trigram_set(F.col(c))), " ")
    kind = pairs.schema[case].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                a, b = (np.asarray(embed(part.column(k).to_pylist()), dtype=np.float64) for k in (1, 2))
                unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((unit(a) * unit(b)).sum(axis=1))], [case, "cosine"])

    got = pairs.select(case, bag(before).alias("a"), bag(after).alias("b")).where("a <> '' AND b <> ''").mapInArrow(run, f"{case} {kind}, cosine double")
    return got.groupBy(case).agg(F.round(F.avg("cosine"), 4).alias("c1_semantic"), F.count("*").alias("n_claims"))
