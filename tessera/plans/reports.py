"""Reports and censuses on the event, order and part tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import cases as C
from tessera.operators import relational as R
from tessera.operators import reports as P
from tessera.operators import stats as S
from tessera.plans.registry import query, table

#: The kinds of events stand for conditions, the first for the baseline; four channels are made of their numbers.
_CONDS = ["baseline", "F", "G", "B", "D"]
_SCORES = f"""kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT event_id, user_id, value, [{", ".join(f"'{c}'" for c in _CONDS)}][least(k, 5)] AS cond FROM events JOIN kinds USING (event_type)),
scores AS (SELECT m.metric, 'm' || (event_id % 2) AS model, cond, user_id AS "case", event_id AS rep,
  CASE m.metric WHEN 'c1' THEN value WHEN 'c2' THEN (event_id % 13) / 8.0 WHEN 'c3' THEN (event_id * 7919 % 101)::DOUBLE ELSE (user_id * 31 + event_id % 17)::DOUBLE END AS value
  FROM e, (VALUES ('c1'), ('c2'), ('c3'), ('c5')) m(metric)),
means AS (SELECT metric, model, cond, "case", avg(value) AS value FROM scores GROUP BY ALL),
agg AS (SELECT metric, model, cond, median(value) AS median, count(*) AS n_cases FROM means GROUP BY ALL)"""


def _scores(spark, sf):
    e = table(spark, sf, "events")
    kinds = R.numbered(e.select("event_type").dropna().distinct(), ["event_type"], "k")
    cond = F.element_at(F.array(*[F.lit(c) for c in _CONDS]), F.least(F.col("k") + 1, F.lit(5)).cast("int"))
    values = {"c1": F.col("value"), "c2": (F.col("event_id") % 13) / 8.0, "c3": (F.col("event_id") * 7919 % 101).cast("double"), "c5": (F.col("user_id") * 31 + F.col("event_id") % 17).cast("double")}
    channels = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()]))
    rows = e.join(F.broadcast(kinds), "event_type").withColumn("cond", cond)
    return rows.select(F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model"), "cond", F.col("user_id").alias("case"), F.col("event_id").alias("rep"), channels)


@query(f"WITH {_SCORES} SELECT metric, model, cond, round(median, 6) AS median, n_cases FROM agg")
def main_aggregate(spark, sf):
    return P.aggregate(_scores(spark, sf)).select("metric", "model", "cond", F.round("median", 6).alias("median"), "n_cases")


_BASE = "b AS (SELECT metric, model, median AS base FROM agg WHERE cond = 'baseline')"


@query(f"""WITH {_SCORES}, {_BASE}, l AS (SELECT *, min(n_cases) OVER (PARTITION BY model, cond) AS min_n FROM agg)
SELECT metric, model, cond, round(base, 6) AS base, round(median - base, 6) AS delta, min_n FROM l JOIN b USING (metric, model) WHERE cond <> 'baseline'""")
def appendix_deltas(spark, sf):
    return P.deltas(P.aggregate(_scores(spark, sf))).withColumns({c: F.round(c, 6) for c in ("base", "delta")})


@query(f"""WITH {_SCORES}, {_BASE}, d AS (SELECT model, max(median - base) FILTER (WHERE cond = 'F') AS f, max(median - base) FILTER (WHERE cond = 'G') AS g FROM agg JOIN b USING (metric, model) WHERE metric = 'c5' GROUP BY model)
SELECT model, round(f, 6) AS delta_f, round(g, 6) AS delta_g, CASE WHEN greatest(abs(f), abs(g)) > 0.2 AND (f > 0.2 OR g > 0.2) THEN 'supported' WHEN greatest(f, g) >= 0.2 THEN 'boundary' ELSE 'not supported' END AS h1,
  CASE WHEN abs(f - g) < 0.1 AND f * g > 0 THEN 'SUPPORTED' ELSE 'not supported' END AS h2, CASE WHEN f >= 0 AND g >= 0 THEN 'SUPPORTED' ELSE 'not supported' END AS h3 FROM d""")
def hypothesis_verdicts(spark, sf):
    return P.verdicts(P.aggregate(_scores(spark, sf))).withColumns({c: F.round(c, 6) for c in ("delta_f", "delta_g")})


@query(f"""WITH {_SCORES}, w AS (SELECT metric, model, max(median) FILTER (WHERE cond = 'baseline') AS b, max(median) FILTER (WHERE cond = 'F') AS f, max(median) FILTER (WHERE cond = 'G') AS g FROM agg GROUP BY ALL),
x AS (SELECT metric, model, CASE metric WHEN 'c2' THEN CASE WHEN abs(b - 1) > 0 THEN (abs(b - 1) - abs((f + g) / 2 - 1)) / abs(b - 1) ELSE 0 END WHEN 'c5' THEN -((f - b) + (g - b)) / 2 ELSE ((f - b) + (g - b)) / 2 END AS gain,
  CASE metric WHEN 'c1' THEN 0.005 WHEN 'c2' THEN 0.2 WHEN 'c3' THEN 0.02 ELSE 0.2 END AS least FROM w)
SELECT metric, model, round(gain, 6) AS gain, CASE WHEN gain >= least THEN 'Y' WHEN gain <= -least THEN 'N' ELSE '-' END AS mark FROM x""")
def scorecard(spark, sf):
    return P.scorecard(P.aggregate(_scores(spark, sf)))


@query(f"""WITH {_SCORES}, x(cond, metric, dir) AS (VALUES ('D', 'c5', 1), ('F', 'c5', 1), ('G', 'c5', 1), ('B', 'c1', 0), ('B', 'c3', 0)),
p AS (SELECT p.cond, p.metric, CASE WHEN dir = 1 THEN p.value - b.value > 0 ELSE abs(p.value - b.value) < 0.05 END::INT AS hit FROM means p JOIN x ON x.cond = p.cond AND x.metric = p.metric JOIN means b ON b.cond = 'baseline' AND b.metric = p.metric AND b.model = p.model AND b."case" = p."case")
SELECT cond, metric, count(*) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS hit_rate FROM p GROUP BY ROLLUP (cond, metric)""")
def direction_rates(spark, sf):
    """C4 over all channels: hit rates by probe and channel, by probe, in all."""
    return P.direction_rates(_scores(spark, sf))


def _matrix(rank: bool) -> str:
    v = lambda c: f"rank() OVER (PARTITION BY scope ORDER BY {c}) + (count(*) OVER (PARTITION BY scope, {c}) - 1) / 2.0" if rank else c
    return f"""WITH {_SCORES}, w AS (SELECT model, cond, "case", max(value) FILTER (WHERE metric = 'c1') AS c1, max(value) FILTER (WHERE metric = 'c2') AS c2, max(value) FILTER (WHERE metric = 'c3') AS c3, max(value) FILTER (WHERE metric = 'c5') AS c5 FROM means GROUP BY ALL),
s AS (SELECT model AS scope, c1, c2, c3, c5 FROM w UNION ALL SELECT '(all)', c1, c2, c3, c5 FROM w), r AS (SELECT scope, {", ".join(f"{v(c)} AS {c}" for c in ("c1", "c2", "c3", "c5"))} FROM s),
l AS ({" UNION ALL ".join(f"SELECT scope, '{a}' AS x, '{b}' AS y, {a} AS vx, {b} AS vy FROM r" for i, a in enumerate(("c1", "c2", "c3", "c5")) for b in ("c1", "c2", "c3", "c5")[i:])})
SELECT scope, x, y, round(corr(vx, vy), 5) AS r, count(*) AS n, abs(corr(vx, vy)) > 0.7 AS strong FROM l GROUP BY scope, x, y"""


@query(_matrix(False))
def channel_pearson_matrix(spark, sf):
    return P.channel_matrix(_scores(spark, sf), ["c1", "c2", "c3", "c5"], rank=False).withColumn("r", F.round("r", 5))


@query(_matrix(True))
def channel_spearman_matrix(spark, sf):
    return P.channel_matrix(_scores(spark, sf), ["c1", "c2", "c3", "c5"], rank=True).withColumn("r", F.round("r", 5))


@query(f"""WITH {_SCORES}, a AS (SELECT metric, m.model, m."case", m.cond, m.value, b.value AS base, round(abs(m.value - b.value), 9) AS spread FROM means m JOIN means b USING (metric) WHERE b.cond = 'baseline' AND m.cond <> 'baseline' AND b.model = m.model AND b."case" = m."case"),
k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY spread DESC, "case", model, cond) AS k FROM a)
SELECT metric, "case", model, CASE WHEN value > base THEN cond ELSE 'baseline' END AS high_cond, CASE WHEN value > base THEN 'baseline' ELSE cond END AS low_cond, spread FROM k WHERE k = 1""")
def largest_spread(spark, sf):
    return P.largest_spread(_scores(spark, sf), ["metric"])


@query(f"""WITH {_SCORES}, r AS (SELECT metric, "case", cond, model, round(value, 9) AS value FROM means),
t AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, "case", cond, model) AS a, row_number() OVER (PARTITION BY metric ORDER BY value, "case", cond, model) AS b FROM r)
SELECT x.metric, x."case" AS top_case, x.cond AS top_cond, x.model AS top_model, x.value AS top_value, y."case" AS low_case, y.cond AS low_cond, y.model AS low_model, y.value AS low_value FROM t x JOIN t y USING (metric) WHERE x.a = 1 AND y.b = 1""")
def cross_case_extremes(spark, sf):
    return P.extremes(_scores(spark, sf), ["metric"])


_CALLS = """calls AS (SELECT 1 + 2 * (user_id % 3) AS k, CASE event_type WHEN 'view' THEN 'gpt-5.4' WHEN 'click' THEN 'gpt-4o-mini' ELSE 'other' END AS model, event_id % 1000 * 8 AS input_tokens, event_id % 300 * 50 AS output_tokens FROM events),
c AS (SELECT k, model, input_tokens, output_tokens, round(input_tokens / 1e6 * i + output_tokens / 1e6 * o, 5) AS cost FROM calls JOIN (VALUES ('gpt-5.4', 1.25, 10.0), ('gpt-4o-mini', 0.15, 0.6), ('other', 0, 0)) p(model, i, o) USING (model))"""


def _calls(spark, sf):
    model = F.when(F.col("event_type") == "view", "gpt-5.4").when(F.col("event_type") == "click", "gpt-4o-mini").otherwise("other")
    return table(spark, sf, "events").select((1 + 2 * (F.col("user_id") % 3)).alias("k"), model.alias("model"), (F.col("event_id") % 1000 * 8).alias("input_tokens"), (F.col("event_id") % 300 * 50).alias("output_tokens"))


@query(f"WITH {_CALLS} SELECT k, model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 5) AS cost FROM c GROUP BY ROLLUP (k, model)")
def usage_rollup(spark, sf):
    """Calls, tokens and cost by setting and model, with totals."""
    return P.usage(P.costed(_calls(spark, sf)), ["k", "model"])


@query(f"WITH {_CALLS} SELECT k, count(*) AS n, 2400::BIGINT AS expected, count(*) = 2400 AS complete FROM calls GROUP BY k")
def sweep_coverage(spark, sf):
    return P.coverage(_calls(spark, sf), "k", 2400)


@query(f"""WITH {_CALLS}, m AS (SELECT model, k, round(avg(input_tokens), 6) AS v FROM calls GROUP BY ALL), s AS (SELECT model, list(v ORDER BY k) AS v FROM m GROUP BY model HAVING count(*) > 1),
d AS (SELECT *, list_transform(generate_series(1, len(v) - 1), lambda i: v[i + 1] - v[i]) AS d FROM s), f AS (SELECT *, list_min(d) >= 0 AS up, list_max(d) <= 0 AS down, v[1] = v[-1] AS flat FROM d)
SELECT model, len(v) AS n, round(list_max(v) - list_min(v), 6) AS swing, up OR down AS monotonic, CASE WHEN up AND NOT flat THEN 'monotonic-up' WHEN down AND NOT flat THEN 'monotonic-down' WHEN up AND down THEN 'flat' ELSE 'non-monotonic' END AS tag FROM f""")
def sweep_swing(spark, sf):
    """Swing and monotonicity of a mean over settings."""
    means = _calls(spark, sf).groupBy("model", "k").agg(F.round(F.avg("input_tokens"), 6).alias("v"))
    return P.sweep(means, ["model"], "k", "v")


@query("""WITH e AS (SELECT event_type, value AS v FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM e)
SELECT event_type, max(n) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, max(CASE WHEN k = n // 4 THEN v END) AS q1, max(CASE WHEN k = n // 2 THEN v END) AS upper_median,
  max(CASE WHEN k = 3 * n // 4 THEN v END) AS q3, max(CASE WHEN k = floor(0.95 * (n - 1))::BIGINT THEN v END) AS p95 FROM r GROUP BY event_type""")
def value_distribution(spark, sf):
    return P.distribution(table(spark, sf, "events"), ["event_type"], "value")


@query("""WITH t AS (SELECT conv_id, length(coalesce(text, '')) AS n FROM conversations), k AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM t)
SELECT count(*) AS prompts, min(n) AS least, (SELECT max(n) FROM k WHERE k = c // 2) AS upper_median, round(avg(n), 6) AS mean, max(n) AS most, round(avg((n > 300)::INT), 6) AS truncated FROM t""")
def prompt_lengths(spark, sf):
    """Lengths of prompts and the share that a limit of 300 would cut."""
    t = table(spark, sf, "conversations").select(F.length(F.coalesce("text", F.lit(""))).alias("n"), F.lit(1).alias("g"))
    rest = t.groupBy("g").agg(F.count("*").alias("prompts"), F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.round(F.avg((F.col("n") > 300).cast("int")), 6).alias("truncated"))
    return S.values_at(t, ["g"], "n", {"upper_median": F.floor(F.col("n") / 2)}).join(rest, "g").drop("g", "n")


_AXES = """a AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'Affirmed' WHEN 'O' THEN 'Reversed' ELSE 'Dismissed' END AS sub, strftime(o_orderdate, '%m-%d-') || CASE WHEN o_orderkey % 11 = 0 THEN '20x1' ELSE (extract(year FROM o_orderdate) + 18)::VARCHAR END AS d,
  CASE o_orderkey % 5 WHEN 0 THEN ['103'] WHEN 1 THEN ['103', '102', '103'] WHEN 2 THEN ['112', '103'] WHEN 3 THEN ['101', '102'] ELSE ['112'] END AS issues, ['3600', '9999', '2100'][o_orderkey % 3 + 1] AS tech, o_orderkey % 4 AS n_rejections, o_orderkey % 7 AS n_references FROM orders),
x AS (SELECT o_orderkey, o_custkey, CASE WHEN sub IN ('Affirmed', 'Reversed') THEN sub ELSE 'other' END AS outcome, CASE o_orderkey % 5 WHEN 0 THEN '103' WHEN 1 THEN '102+103' WHEN 2 THEN '103+112' WHEN 3 THEN '101-rel' ELSE '112' END AS statute,
  CASE WHEN NOT regexp_full_match(right(d, 4), '\\d{4}') THEN 'unknown' WHEN right(d, 4)::INT <= 2014 THEN '2010-14' WHEN right(d, 4)::INT <= 2019 THEN '2015-19' ELSE '2020-25' END AS year, CASE WHEN tech = '9999' THEN 'other' ELSE tech END AS tech, n_rejections, n_references FROM a)"""


def _cases(spark, sf):
    """Orders as cases: a decision, its date, issues, and how many rejections and references there are."""
    o, n = table(spark, sf, "orders"), F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*v), (n % len(v) + 1).cast("int"))
    texts = lambda *v: F.array(*[F.lit(x) for x in v])
    year = F.when(n % 11 == 0, "20x1").otherwise((F.year("o_orderdate") + 18).cast("string"))
    return o.select(
        n.alias("case_id"), F.col("o_custkey").alias("proceeding"), F.when(F.col("o_orderstatus") == "F", "Affirmed").when(F.col("o_orderstatus") == "O", "Reversed").otherwise("Dismissed").alias("subdecision"),
        F.concat(F.date_format("o_orderdate", "MM-dd-"), year).alias("decision_date"), pick(texts("103"), texts("103", "102", "103"), texts("112", "103"), texts("101", "102"), texts("112")).alias("issues"),
        pick(F.lit("3600"), F.lit("9999"), F.lit("2100")).alias("tech_center"), (n % 4).alias("n_rejections"), (n % 7).alias("n_references"), F.lit(1).alias("n_pre_claims"),
    )


@query(f"""WITH {_AXES} SELECT outcome, statute, tech, year, count(*) AS n FROM x WHERE outcome <> 'other' AND year <> 'unknown' AND n_rejections > 0 AND n_references > 0 GROUP BY ALL""")
def eligible_axes(spark, sf):
    """Axes of the eligible cases, counted."""
    return C.with_axes(_cases(spark, sf)).where(F.size("reasons") == 0).groupBy("outcome", "statute", "tech", "year").agg(F.count("*").alias("n"))


@query(f"""WITH {_AXES}, r AS (SELECT unnest(list_filter([CASE WHEN c_custkey IS NULL THEN 'no_link' END, CASE WHEN outcome = 'other' THEN 'rare_outcome' END, CASE WHEN year = 'unknown' THEN 'unknown_year' END, CASE WHEN n_rejections < 1 THEN 'no_structured_rejection' END, CASE WHEN n_references < 1 THEN 'no_structured_prior_art' END], lambda v: v IS NOT NULL)) AS reason
  FROM x LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) ON c_custkey = o_custkey)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def exclusion_reasons(spark, sf):
    """How often each reason excludes; a case may count in several, and cases without a link in that one too."""
    links = table(spark, sf, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("proceeding"))
    return C.reason_counts(C.with_axes(C.linked(_cases(spark, sf), links, "proceeding")))


@query("""WITH c AS (SELECT l_orderkey AS case_id, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem), f AS (SELECT case_id, count(*) FILTER (WHERE l_returnflag = 'R') AS rejections, min(l_linenumber) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 5) AS attacked FROM c GROUP BY 1),
p AS (SELECT DISTINCT case_id, l_linenumber AS num FROM c WHERE l_quantity > 10), q AS (SELECT case_id, l_linenumber AS num, max(l_partkey) AS part FROM c WHERE l_quantity > 20 GROUP BY ALL),
s AS (SELECT f.case_id, CASE WHEN rejections = 0 THEN 'no_rejection' WHEN attacked IS NULL THEN 'no_attacked_num' WHEN p.num IS NULL THEN 'attacked_not_in_pre' WHEN q.num IS NULL THEN 'attacked_not_in_post' WHEN q.part % 5 = 0 THEN 'implicit_placeholder' END AS reason
  FROM f LEFT JOIN p ON p.case_id = f.case_id AND p.num = attacked LEFT JOIN q ON q.case_id = f.case_id AND q.num = attacked WHERE f.case_id % 10 <> 3)
SELECT coalesce(reason, '(kept)') AS reason, count(*) AS n FROM s GROUP BY 1""")
def pool_skips(spark, sf):
    """The retrieval pool's skips, first reason only, of cases outside a cohort: lines of orders as claims."""
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("num"), "l_partkey", "l_quantity", "l_returnflag")
    returned = F.col("l_returnflag") == "R"
    facts = c.groupBy("case_id").agg(F.count_if(returned).alias("n_rejections"), F.min(F.when(returned & (F.col("l_quantity") > 5), F.col("num"))).alias("attacked"))
    pre = c.where("l_quantity > 10").select("case_id", "num", F.lit("text").alias("text"))
    post = c.where("l_quantity > 20").groupBy("case_id", "num").agg(F.max("l_partkey").alias("p")).select("case_id", "num", F.when(F.col("p") % 5 == 0, "(implicit, x) claim").otherwise("text").alias("text"))
    cohort = c.where("case_id % 10 = 3").select("case_id").distinct()
    return C.pool(facts, pre, post, cohort).groupBy(F.coalesce("reason", F.lit("(kept)")).alias("reason")).agg(F.count("*").alias("n"))


_DIFFS = """d AS (SELECT l_suppkey AS s, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS kept, count(*) FILTER (WHERE l_returnflag = 'A') AS modified, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS new, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS cancelled FROM lineitem WHERE l_quantity > 40 GROUP BY 1),
t AS (SELECT *, kept + modified + new + cancelled AS total FROM d), p AS (SELECT *, kept / nullif(total, 0) AS k, modified / nullif(total, 0) AS m, new / nullif(total, 0) AS n, cancelled / nullif(total, 0) AS c FROM t),
q AS (SELECT *, CASE WHEN total = 0 THEN 'empty' WHEN c > 0.5 AND n > 0.3 THEN 'cancel_and_replace' WHEN c > 0.5 THEN 'cancel_heavy' WHEN m > 0.5 AND n < 0.15 AND c < 0.15 THEN 'modify_only' WHEN n > 0.3 AND m > 0.3 THEN 'modify_and_add' WHEN n > 0.5 THEN 'new_heavy' WHEN k > 0.5 THEN 'mostly_kept' ELSE 'mixed' END AS pattern,
  CASE WHEN total = 0 THEN 'other' WHEN c > 0.5 THEN 'cancel_heavy' WHEN m > 0.5 AND n < 0.15 AND c < 0.15 THEN 'modify_only' WHEN n > 0.3 THEN 'new_or_add' WHEN m BETWEEN 0.15 AND 0.5 AND c BETWEEN 0.15 AND 0.5 THEN 'mixed' WHEN m >= 0.3 AND n >= 0.15 THEN 'new_or_add' ELSE 'other' END AS bin FROM p)"""


def _diffs(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity > 40")  # noqa: E741
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return l.groupBy(F.col("l_suppkey").alias("s")).agg(F.count_if((flag == "N") & (status == "O")).alias("kept"), F.count_if(flag == "A").alias("modified"), F.count_if((flag == "R") & (status == "F")).alias("new"), F.count_if((flag == "R") & (status == "O")).alias("cancelled"))


@query(f"WITH {_DIFFS} SELECT pattern, bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM q GROUP BY pattern, bin")
def amendment_census(spark, sf):
    """Two labels of amendments by their shares, counted together."""
    args = [F.col(c) for c in ("kept", "modified", "new", "cancelled")]
    both = _diffs(spark, sf).select(T.amendment_pattern(*args).alias("pattern"), T.amendment_bin(*args).alias("bin"))
    return R.shares(both.select(F.struct("pattern", "bin").alias("b")), "b", 1).select("b.*", "n", "pct")


@query("""WITH r AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY 1) SELECT array_to_string(p, '+') AS combo, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, combo LIMIT 15""")
def top_combinations(spark, sf):
    """The most frequent sets of priorities a customer has; ties by name."""
    return C.combinations(table(spark, sf, "orders"), "o_custkey", "o_orderpriority").orderBy(F.desc("n"), "combo").limit(15)


@query("""SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 2) AS pct FROM orders GROUP BY 1, 2""")
def two_level_counts(spark, sf):
    return C.two_level(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").withColumnsRenamed({"o_orderstatus": "a", "o_orderpriority": "b"})


@query("""WITH c AS (SELECT l_orderkey, list(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS rejected, list(l_linenumber) FILTER (WHERE l_quantity > 25) AS changed FROM lineitem GROUP BY 1),
v AS (SELECT CASE WHEN rejected IS NULL OR changed IS NULL THEN 'na' WHEN list_has_any(rejected, changed) THEN 'hit' ELSE 'miss' END AS verdict FROM c)
SELECT count(*) FILTER (WHERE verdict = 'hit') AS hit, count(*) FILTER (WHERE verdict = 'miss') AS miss, count(*) FILTER (WHERE verdict = 'na') AS na, round(100.0 * count(*) FILTER (WHERE verdict = 'hit') / greatest(count(*) FILTER (WHERE verdict <> 'na'), 1), 1) AS hit_rate FROM v""")
def decisive_limitation(spark, sf):
    """Whether changed numbers meet rejected ones, with cases that lack a side apart."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    per = l.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("rejected"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_linenumber"))).alias("changed"))
    return C.hit_rates(per.select(C.meeting(F.col("rejected"), F.col("changed")).alias("verdict")))


@query("""SELECT count(*) AS cases, count(*) FILTER (WHERE o_totalprice > 100000) AS large, round(100.0 * count(*) FILTER (WHERE o_totalprice > 100000) / greatest(count(*), 1), 2) AS large_pct,
  count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS both, count(*) FILTER (WHERE o_orderpriority IS NULL) AS without FROM orders""")
def flag_summary(spark, sf):
    """Flags of cases and their shares."""
    o = table(spark, sf, "orders").select((F.col("o_totalprice") > 100000).alias("large"), ((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).alias("both"), F.col("o_orderpriority").isNull().alias("without"))
    return C.flags(o, ["large", "both", "without"]).select("cases", "large", "large_pct", "both", "without")


@query("""WITH m AS (SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'error' WHEN count(*) >= 3 THEN 'complete_3_of_3' ELSE 'partial' END AS status, min(o_orderstatus) AS label FROM orders GROUP BY 1)
SELECT status, label, count(*) AS n FROM m GROUP BY GROUPING SETS ((status), (status, label))""")
def fetch_stats(spark, sf):
    """Statuses of a fetch manifest, in all and by label."""
    o = table(spark, sf, "orders")
    status = F.when(F.count_if(F.col("o_orderstatus") == "P") > 0, "error").when(F.count("*") >= 3, "complete_3_of_3").otherwise("partial")
    m = o.groupBy("o_custkey").agg(status.alias("status"), F.min("o_orderstatus").alias("label"))
    return m.groupBy("status").agg(F.count("*").alias("n")).select("status", F.lit(None).cast("string").alias("label"), "n").unionByName(m.groupBy("status", "label").agg(F.count("*").alias("n")))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 3) SELECT o_custkey, n FROM c ORDER BY o_custkey LIMIT 100""")
def complete_first(spark, sf):
    """The first hundred complete cases in the order of their ids."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return C.first_complete(per.withColumn("status", F.when(F.col("n") >= 3, "complete_3_of_3").otherwise("partial")), "o_custkey", 100).select("o_custkey", "n")


@query("""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, lang FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS c FROM t)
SELECT lang, pick, doc_id, n FROM (SELECT lang, doc_id, n, unnest(list_filter([CASE WHEN k = 0 THEN 'shortest' END, CASE WHEN k = c // 2 THEN 'median' END, CASE WHEN k = c - 1 THEN 'longest' END], lambda v: v IS NOT NULL)) AS pick FROM r)""")
def length_picks(spark, sf):
    """The shortest, median and longest document of every language."""
    return C.picks(table(spark, sf, "documents").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("n")), "lang", "n", "doc_id")


@query("""WITH b AS (SELECT o_custkey, round(avg(o_totalprice), 6) AS v FROM orders GROUP BY 1), g AS (SELECT c_mktsegment, count(*) AS cases, count(v) AS with_orders, count(*) FILTER (WHERE v IS NULL) AS missing, coalesce(min(v), 0) AS least FROM customer LEFT JOIN b ON o_custkey = c_custkey GROUP BY 1)
SELECT * FROM g""")
def health_metrics(spark, sf):
    """Cases with and without a baseline by segment: a left join with its misses counted."""
    base = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.avg("o_totalprice"), 6).alias("v"))
    joined = C.with_baseline(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), base, "c_custkey", "v", "no_baseline")
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("cases"), F.count("v").alias("with_orders"), F.count_if(F.col("reason") == "no_baseline").alias("missing"), F.coalesce(F.min("v"), F.lit(0.0)).alias("least"))
