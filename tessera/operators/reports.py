"""Reports over scores (metric, model, case, cond, rep, value): aggregates, deltas, verdicts, correlations, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import direction_hit
from tessera.operators import stats as S

BASELINE = "baseline"
#: Directions expected of a probe's effect on a channel.
DIRECTIONS = [("D", "c5", "UP"), ("F", "c5", "UP"), ("G", "c5", "UP"), ("B", "c1", "FLAT"), ("B", "c3", "FLAT"), ("C_decoy", "c1", "DOWN"), ("C_mechtrue", "c1", "UP")]
#: Fixed value: below it a difference counts as none.
FLAT = 0.05
#: The least difference that counts in the scorecard.
C1_LEAST, C2_SHARE, C3_LEAST, C5_LEAST = 0.005, 0.20, 0.02, 0.20
#: Dollars a million tokens, in and out.
PRICES = [
    ("claude-sonnet-4-20250514", 3.0, 15.0), ("claude-haiku-4-5-20251001", 0.8, 4.0), ("claude-opus-4-6", 15.0, 75.0), ("gpt-5.4", 1.25, 10.0), ("gpt-5-mini", 0.25, 2.0), ("gpt-4o-mini", 0.15, 0.6),
    ("anthropic/claude-sonnet-latest", 3.0, 15.0), ("anthropic/claude-haiku-latest", 0.8, 4.0), ("openai/gpt-5.4", 1.25, 10.0), ("openai/gpt-mini-latest", 0.25, 2.0),
]


def case_means(scores: DataFrame) -> DataFrame:
    """Mean over repetitions of every case."""
    return scores.where(F.col("value").isNotNull()).groupBy("metric", "model", "cond", "case").agg(F.avg("value").alias("value"))


def aggregate(scores: DataFrame) -> DataFrame:
    """Median over cases of the means over repetitions, by metric, model and condition."""
    return S.medians(case_means(scores), ["metric", "model", "cond"], "value").withColumnRenamed("n", "n_cases")


def deltas(medians: DataFrame) -> DataFrame:
    """Every condition's median less the baseline's; n is the smaller count over the metrics of a condition."""
    base = medians.where(F.col("cond") == BASELINE).select("metric", "model", F.col("median").alias("base"))
    least = F.min("n_cases").over(W.partitionBy("model", "cond"))  # a row a metric
    return medians.withColumn("min_n", least).where(F.col("cond") != BASELINE).join(base, ["metric", "model"]).select("metric", "model", "cond", "base", (F.col("median") - F.col("base")).alias("delta"), "min_n")


def _by_condition(found: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("cond") == c, F.col(value))).alias(f"_{c}") for c in names])


def verdicts(medians: DataFrame) -> DataFrame:
    """The three hypotheses on retrieval's effect on templates, by model."""
    d = _by_condition(deltas(medians.where(F.col("metric") == "c5")), ["model"], "delta", ["F", "G"])
    f, g = F.col("_F"), F.col("_G")
    same = ((f > 0) & (g > 0)) | ((f < 0) & (g < 0))
    return d.select(
        "model", f.alias("delta_f"), g.alias("delta_g"),
        F.when((f > 0.2) | (g > 0.2), "supported").when(F.greatest(f, g) >= 0.2, "boundary").otherwise("not supported").alias("h1"),
        F.when((F.abs(f - g) < 0.1) & same, "SUPPORTED").otherwise("not supported").alias("h2"), F.when((f >= 0) & (g >= 0), "SUPPORTED").otherwise("not supported").alias("h3"),
    )


def _mark(gain: Column, least: float) -> Column:
    return F.when(gain >= least, "Y").when(gain <= -least, "N").otherwise("-")


def scorecard(medians: DataFrame) -> DataFrame:
    """Per model and channel whether retrieval (F and G, averaged) moved the median the right way by enough: Y, N or -."""
    m = _by_condition(medians, ["metric", "model"], "median", [BASELINE, "F", "G"])
    base, both = F.col(f"_{BASELINE}"), (F.col("_F") + F.col("_G")) / 2
    before, after = F.abs(base - 1.0), F.abs(both - 1.0)
    share = F.when(before > 0, (before - after) / before).otherwise(0.0)
    gain = F.when(F.col("metric") == "c2", share).when(F.col("metric") == "c5", base - both).otherwise(both - base)
    mark = F.lit("-")
    for metric, least in (("c1", C1_LEAST), ("c2", C2_SHARE), ("c3", C3_LEAST), ("c5", C5_LEAST)):
        mark = F.when(F.col("metric") == metric, _mark(gain, least)).otherwise(mark)
    return m.where(base.isNotNull() & both.isNotNull()).select("metric", "model", F.round(gain, 6).alias("gain"), mark.alias("mark"))


def marks_total(card: DataFrame) -> DataFrame:
    return card.agg(*[F.count_if(F.col("mark") == m).alias(n) for m, n in (("Y", "yes"), ("N", "no"), ("-", "none"))])


def _ordered_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``again``: means by ``keys`` whose sums are taken one value after the other in the order of ``rep``, so they come out the same on any partitions."""
    order = W.partitionBy(*keys).orderBy("rep", "value")
    summed = rows.where(F.col("value").isNotNull()).select(*keys, F.sum("value").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_s"), F.row_number().over(order).alias("_k"))
    return summed.groupBy(*keys).agg((F.max_by("_s", "_k") / F.max("_k")).alias("again"))


def direction_rates(scores: DataFrame, subconditions: DataFrame | None = None) -> DataFrame:
    """C4: how often a probe moved a channel as expected, over cases that have the baseline too; by probe and channel, by probe (channel null) and in all (both null).

    ``subconditions`` (case, rep, sub) rename condition C; C rows without one are left out.  Cases without a value on a side count in n alone.
    A sum of doubles depends on its order, and by its last bits a difference may fall on either side of a limit: means of pairs
    that lie so near to theirs are taken again in the order of ``rep``.
    """
    rows = scores
    if subconditions is not None:
        told = scores.where(F.col("cond") == "C").join(subconditions, ["case", "rep"]).drop("cond").withColumnRenamed("sub", "cond")
        rows = scores.where(F.col("cond") != "C").unionByName(told.select(scores.columns))
    expected = F.broadcast(scores.sparkSession.createDataFrame(DIRECTIONS, "cond string, metric string, direction string"))
    asked = F.col("metric").isin(*sorted({m for _, m, _ in DIRECTIONS})) & F.col("cond").isin(BASELINE, *sorted({c for c, _, _ in DIRECTIONS}))
    rows = rows.where(asked).withColumn("value", F.col("value").cast("double"))
    of_case, value, total = ["metric", "model", "case"], F.col("value"), F.sum(F.abs("value"))
    # whole numbers below 2 ** 53 add up exactly; else a mean is off by no more than the total of its values times 2 ** -53
    noise = F.when(F.bool_and(value == F.rint("value")) & (total < 2.0**53), 0.0).otherwise(total * 2.0**-50)
    m = rows.groupBy(*of_case, "cond").agg(F.avg("value").alias("value"), noise.alias("noise"))
    base = m.where(F.col("cond") == BASELINE).select(*of_case, F.col("value").alias("base"), F.col("noise").alias("base_noise"))
    delta, noise = F.col("value") - F.col("base"), F.col("noise") + F.col("base_noise")
    apart = F.when(F.col("direction") == "FLAT", F.abs(F.abs(delta) - FLAT)).otherwise(F.abs(delta))
    paired = m.join(expected, ["cond", "metric"]).join(base, of_case).select(*of_case, "cond", "direction", delta.alias("delta"), ((noise > 0) & (apart <= noise)).alias("near"))
    sides = paired.where("near").select(*of_case, F.col("cond").alias("probe"), F.explode(F.array("cond", F.lit(BASELINE))).alias("cond"))
    again = _ordered_means(rows.join(sides, [*of_case, "cond"]), [*of_case, "probe", "cond"])
    is_base = F.col("cond") == BASELINE
    anew = (F.max(F.when(~is_base, F.col("again"))) - F.max(F.when(is_base, F.col("again")))).alias("anew")
    settled = paired.join(again.groupBy(*of_case, F.col("probe").alias("cond")).agg(anew), [*of_case, "cond"], "left")
    delta = F.when(F.col("near"), F.col("anew")).otherwise(F.col("delta"))
    hits = settled.withColumn("hit", F.when(delta.isNotNull(), direction_hit(delta, F.col("direction"), FLAT)))
    return hits.rollup("cond", "metric").agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("hits"), F.round(F.avg("hit"), 6).alias("hit_rate"))


def channel_matrix(scores: DataFrame, metrics: list[str], rank: bool, flag: float = 0.7) -> DataFrame:
    """Correlations of every pair of channels over keys that have all of them, pooled ("(all)") and by model; strong ones are flagged."""
    wide = case_means(scores).groupBy("model", "cond", "case").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]).dropna(subset=metrics)
    both = wide.withColumn("scope", F.explode(F.array(F.col("model"), F.lit("(all)"))))
    if rank:  # all channels in one go, a row a value
        values = both.select("scope", "model", "cond", "case", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))
        ranked = S.mid_ranks(values, ["scope", "metric"], "value", "r")
        both = ranked.groupBy("scope", "model", "cond", "case").agg(*[F.max(F.when(F.col("metric") == m, F.col("r"))).alias(m) for m in metrics])
    column = F.col
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i:]]
    long = both.select("scope", F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), column(a).alias("vx"), column(b).alias("vy")) for a, b in pairs])))
    got = S.correlation(long, ["scope", "x", "y"], "vx", "vy", "r")
    return got.withColumn("strong", F.coalesce(F.abs("r") > flag, F.lit(False)))


def costed(calls: DataFrame, prices: list[tuple] = PRICES) -> DataFrame:
    """``calls`` (model, input_tokens, output_tokens) with ``cost`` in dollars to 5 digits, 0 for models without a price."""
    table = calls.sparkSession.createDataFrame(prices, "model string, _in double, _out double")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = n("input_tokens") / 1e6 * n("_in") + n("output_tokens") / 1e6 * n("_out")
    return calls.join(F.broadcast(table), "model", "left").withColumn("cost", F.round(cost, 5)).drop("_in", "_out")


def usage(calls: DataFrame, groups: list[str]) -> DataFrame:
    """Calls, tokens and cost by the groups and their totals (nulls), with the coverage of an expected number of calls."""
    return calls.rollup(*groups).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 5).alias("cost"))


def coverage(calls: DataFrame, key: str, expected: int) -> DataFrame:
    return calls.groupBy(key).agg(F.count("*").alias("n")).withColumns({"expected": F.lit(expected).cast("long"), "complete": F.col("n") == expected})


def sweep(values: DataFrame, groups: list[str], order: str, value: str) -> DataFrame:
    """Over the settings of a group, in order: values, largest less smallest, and whether they only rise or only fall; groups of one setting are left out."""
    series = values.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_s"))  # a row a setting
    v = F.transform("_s", lambda x: x[value])
    steps = F.zip_with(F.slice("_v", 1, F.size("_v") - 1), F.slice("_v", 2, F.size("_v") - 1), lambda a, b: b - a)
    found = series.where(F.size("_s") > 1).withColumn("_v", v).withColumn("_d", steps)
    rises, falls = F.forall("_d", lambda d: d >= 0), F.forall("_d", lambda d: d <= 0)
    flat = F.element_at("_v", 1) == F.element_at("_v", -1)
    tag = F.when(rises & ~flat, "monotonic-up").when(falls & ~flat, "monotonic-down").when(rises & falls, "flat").otherwise("non-monotonic")
    return found.select(*groups, F.size("_v").cast("long").alias("n"), F.round(F.array_max("_v") - F.array_min("_v"), 6).alias("swing"), (rises | falls).alias("monotonic"), tag.alias("tag"))


def largest_spread(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` the case, model and condition whose mean is farthest from its baseline's; ties to the first case, model, condition."""
    m = case_means(scores)
    base = m.where(F.col("cond") == BASELINE).select("metric", "model", "case", F.col("value").alias("base"))
    apart = m.where(F.col("cond") != BASELINE).join(base, ["metric", "model", "case"]).withColumn("spread", F.round(F.abs(F.col("value") - F.col("base")), 9))
    best = apart.groupBy(*keys).agg(F.min_by(F.struct("case", "model", "cond", "value", "base", "spread"), F.struct(-F.col("spread"), "case", "model", "cond")).alias("b")).select(*keys, "b.*")
    up = F.col("value") > F.col("base")
    return best.select(*keys, "case", "model", F.when(up, F.col("cond")).otherwise(BASELINE).alias("high_cond"), F.when(up, BASELINE).otherwise(F.col("cond")).alias("low_cond"), "spread")


def extremes(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` the case, condition and model with the greatest and with the least mean."""
    m = case_means(scores).withColumn("value", F.round("value", 9))
    who = F.struct("case", "cond", "model", "value")
    top, low = F.min_by(who, F.struct(-F.col("value"), "case", "cond", "model")), F.min_by(who, F.struct("value", "case", "cond", "model"))
    return m.groupBy(*keys).agg(top.alias("t"), low.alias("l")).select(*keys, *[F.col(f"{a}.{c}").alias(f"{b}_{c}") for a, b in (("t", "top"), ("l", "low")) for c in ("case", "cond", "model", "value")])


def distribution(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """n, least, upper median, index quartiles, index 95th percentile, greatest and mean, without sorting a group in one task."""
    n = F.col("n")
    places = {"q1": F.floor(n / 4), "upper_median": F.floor(n / 2), "q3": F.floor(3 * n / 4), "p95": F.floor(0.95 * (n - 1))}
    plain = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))
    return S.values_at(df, groups, value, places).join(plain, groups)
