"""Cases: axes, eligibility with reasons, the retrieval pool's skips, censuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text as T

#: What placeholders of cancelled claims begin with.
PLACEHOLDERS = ("(implicit,", "(range ")


def linked(cases: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``cases`` with ``linked``: whether ``links`` has their key."""
    return cases.join(links.select(key).distinct().withColumn("_l", F.lit(True)), key, "left").withColumn("linked", F.coalesce("_l", F.lit(False))).drop("_l")


def with_axes(cases: DataFrame) -> DataFrame:
    """The axes of every case, and ``reasons``: all that exclude it, none for eligible ones.

    Needs subdecision, issues, tech_center, decision_date, n_rejections,
    n_references and n_pre_claims; nulls count as missing.  With kept, modified,
    new and cancelled, format or linked there are those axes and reasons too.
    """
    has = lambda *c: set(c) <= set(cases.columns)
    axes = {"outcome": T.outcome_bin(F.col("subdecision")), "statute": T.statute_bin(F.col("issues")), "tech": T.tech_bin(F.col("tech_center")), "year": T.year_bin(F.col("decision_date"))}
    if has("kept", "modified", "new", "cancelled"):
        axes["pattern"] = T.amendment_bin(*[F.coalesce(c, F.lit(0)) for c in ("kept", "modified", "new", "cancelled")])
    if has("format"):
        axes["format"] = T.format_bin(F.col("format"))
    told = cases.select("*", *[c.alias(k) for k, c in axes.items()]) if not has("format") else cases.withColumnsRenamed({"format": "_f"}).select("*", *[(T.format_bin(F.col("_f")) if k == "format" else c).alias(k) for k, c in axes.items()]).drop("_f")
    few = lambda c: F.coalesce(F.col(c), F.lit(0)) < 1
    rules = [(F.col("outcome") == "other", "rare_outcome"), (F.col("year") == "unknown", "unknown_year"), (few("n_rejections"), "no_structured_rejection"), (few("n_references"), "no_structured_prior_art"), (few("n_pre_claims"), "no_pre_claim")]
    if has("linked"):
        rules.insert(0, (~F.col("linked"), "no_link"))
    return told.withColumn("reasons", F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules])))


def reason_counts(told: DataFrame) -> DataFrame:
    return told.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def pool(facts: DataFrame, pre: DataFrame, post: DataFrame, cohort: DataFrame) -> DataFrame:
    """Cases outside the cohort with the attacked claim's texts, or the first reason why they are no exemplar.

    ``facts`` has case_id, n_rejections and attacked; ``pre`` and ``post`` have
    case_id, num and text, one row a number.
    """
    side = lambda d, name: d.select("case_id", F.col("num").alias("attacked"), F.col("text").alias(name), F.lit(True).alias(f"in_{name}")).dropDuplicates(["case_id", "attacked"])
    both = facts.join(cohort, "case_id", "left_anti").join(side(pre, "pre_text"), ["case_id", "attacked"], "left").join(side(post, "post_text"), ["case_id", "attacked"], "left")
    placeholder = F.lit(False)
    for p in PLACEHOLDERS:
        placeholder = placeholder | F.coalesce(F.col("post_text").startswith(p), F.lit(False))
    reason = (
        F.when(F.coalesce("n_rejections", F.lit(0)) == 0, "no_rejection").when(F.col("attacked").isNull(), "no_attacked_num").when(F.col("in_pre_text").isNull(), "attacked_not_in_pre")
        .when(F.col("in_post_text").isNull(), "attacked_not_in_post").when(placeholder, "implicit_placeholder")
    )
    return both.withColumn("reason", reason).drop("in_pre_text", "in_post_text")


def with_baseline(rows: DataFrame, base: DataFrame, key: str, value: str, reason: str) -> DataFrame:
    """``rows`` with a looked-up value, or the reason why it has none."""
    return rows.join(base.select(key, value), key, "left").withColumn("reason", F.when(F.col(value).isNull(), reason))


def combinations(df: DataFrame, case: str, value: str) -> DataFrame:
    """How many cases have each set of values, written sorted with + between."""
    per = df.where(F.col(value).isNotNull()).groupBy(case).agg(F.array_join(F.array_sort(F.collect_set(value)), "+").alias("combo"))
    return per.groupBy("combo").agg(F.count("*").alias("n"))


def two_level(df: DataFrame, outer: str, inner: str, digits: int = 2) -> DataFrame:
    """Counts of inner values within outer ones, and their share there."""
    counts = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(outer)), digits))


def meeting(a: Column, b: Column) -> Column:
    """hit if two sets meet, miss if they do not, na if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "na").when(F.arrays_overlap(a, b), "hit").otherwise("miss")


def hit_rates(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    n = {v: F.count_if(F.col(verdict) == v) for v in ("hit", "miss", "na")}
    return df.agg(*[c.alias(k) for k, c in n.items()], F.round(100.0 * n["hit"] / F.greatest(n["hit"] + n["miss"], F.lit(1)), 1).alias("hit_rate"))


def flags(df: DataFrame, names: list[str], digits: int = 2) -> DataFrame:
    """How many cases have each flag, and their share in percent."""
    n = F.count("*")
    counts = [c for f in names for c in (F.count_if(F.col(f)).alias(f), F.round(100.0 * F.count_if(F.col(f)) / F.greatest(n, F.lit(1)), digits).alias(f"{f}_pct"))]
    return df.agg(n.alias("cases"), *counts)


def first_complete(manifest: DataFrame, ident: str, n: int, status: str = "complete_3_of_3") -> DataFrame:
    return manifest.where(F.col("status") == status).orderBy(ident).limit(n)


def picks(df: DataFrame, group: str, size: str, ident: str) -> DataFrame:
    """group, pick, the row's id and size: the shortest, the one in the middle (upper), and the longest; ties by id.

    Ranks are spread over tasks: rows are ordered by size and id as one value.
    """
    from tessera.operators.stats import values_at

    n = F.col("n")
    key = F.col(size).cast("decimal(17,0)") * F.expr("CAST(10000000000000000000BD AS DECIMAL(20,0))") + F.col(ident).cast("decimal(19,0)")
    places = values_at(df.select(group, key.cast("decimal(38,0)").alias("_key")), [group], "_key", {"shortest": F.lit(0), "median": F.floor(n / 2), "longest": n - 1})
    named = F.inline(F.array(*[F.struct(F.lit(p).alias("pick"), F.col(p).alias("_key")) for p in ("shortest", "median", "longest")]))
    back = F.col("_key").cast("string")
    one = places.select(group, named)
    ends = F.length(back)
    return one.select(group, "pick", F.substring(back, F.greatest(ends - 18, F.lit(1)), F.lit(19)).cast("long").alias(ident), F.when(ends > 19, F.substring(back, F.lit(1), ends - 19).cast("long")).otherwise(0).alias(size))
