"""The reference workloads on the star-schema, event and text tables, each with SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import claims, cohort
from tessera.operators import relational as R
from tessera.operators import stats as S
from tessera.plans.registry import QUERIES, SQL, query, table

_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z][a-z\-'']+')"
_GRAMS = "list_transform(generate_series(1, len({0}) - {1}), lambda i: array_to_string({0}[i : i + {1}], ' '))"


def _grams(tokens: str, n: int) -> str:
    return f"CASE WHEN len({tokens}) >= {n} THEN {_GRAMS.format(tokens, n - 1)} ELSE [] END"


_PHRASES = f"""
tok AS (SELECT doc_id, {_TOK.format("text")} AS w FROM documents),
grams AS (SELECT doc_id, unnest({_grams("w", 4)}) AS phrase FROM tok),
mined AS (SELECT phrase, count(*) AS pool_count, count(DISTINCT doc_id) AS pool_docs FROM grams
  WHERE NOT list_has_any(string_split(phrase, ' '), ['svg', 'clm', 'chemistryblack', 'chemistrywhite', 'xmlns', 'xsi', 'xlink', 'href', 'inkscape', 'sodipodi', 'rdf', 'cdata']) GROUP BY phrase HAVING count(*) >= 20),
top AS (SELECT * FROM mined ORDER BY pool_count DESC, phrase LIMIT 50)"""


def _top_phrases(spark: SparkSession, sf: str) -> DataFrame:
    counts = R.phrase_counts(table(spark, sf, "documents"), T.word_tokens(F.col("text")), "doc_id", 4, T.ARTIFACTS)
    return counts.where("pool_count >= 20").orderBy(F.desc("pool_count"), "phrase").limit(50)


@query(f"WITH {_PHRASES} SELECT phrase, pool_count, pool_docs FROM top")
def phrase_mining_top50(spark, sf):
    return _top_phrases(spark, sf)


@query(f"""WITH {_PHRASES},
turns AS (SELECT role, coalesce(text, '') AS text, {_grams("w", 4)} AS g FROM (SELECT role, text, {_TOK.format("text")} AS w FROM conversations)),
hit AS (SELECT role, length(text) AS c, len(list_filter(g, lambda x: list_contains(phrases, x))) AS h FROM turns, (SELECT list(phrase) AS phrases FROM top))
SELECT role, sum(h)::BIGINT AS hits, sum(c)::BIGINT AS chars, round(1000.0 * sum(h) / sum(c), 6) AS per_1000 FROM hit GROUP BY role""")
def template_rate_by_role(spark, sf):
    """C5 by role: hits of the 50 mined phrases per 1000 characters."""
    phrases = _top_phrases(spark, sf).agg(F.collect_list("phrase").alias("phrases"))  # fifty at most
    turns = table(spark, sf, "conversations").crossJoin(F.broadcast(phrases))
    hits = T.phrase_hits(T.word_tokens(F.col("text")), F.col("phrases"), 4)
    rows = turns.select("role", hits.cast("long").alias("h"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("c"))
    return rows.groupBy("role").agg(F.sum("h").alias("hits"), F.sum("c").alias("chars")).withColumn("per_1000", F.round(1000.0 * F.col("hits") / F.col("chars"), 6))


@query(f"""WITH d AS (SELECT doc_id, unnest(list_distinct({_grams("w", 3)})) AS g FROM (SELECT doc_id, {_TOK.format("text")} AS w FROM documents)),
b AS (SELECT item_id, unnest(list_distinct({_grams("w", 3)})) AS g FROM (SELECT item_id, {_TOK.format("text")} AS w FROM benchmark)),
nd AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), nb AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS met FROM d JOIN b USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, met, round(met / (nd.n + nb.n - met), 4) AS jaccard FROM m JOIN nd USING (doc_id) JOIN nb USING (item_id)""")
def trigram_jaccard_doc_benchmark(spark, sf):
    """Documents against benchmark items that share trigrams, by an inverted index instead of a cross join."""
    side = lambda t, k: table(spark, sf, t).select(k, T.trigram_set(F.col("text")).alias("s")).withColumn("n", F.size("s"))
    d, b = side("documents", "doc_id"), side("benchmark", "item_id")
    items = b.select("item_id", F.col("n").alias("nb"), F.explode("s").alias("g"))
    met = d.select("doc_id", F.col("n").alias("nd"), F.explode("s").alias("g")).join(items, "g").groupBy("doc_id", "item_id", "nd", "nb").agg(F.count("*").alias("met"))
    return met.select("doc_id", "item_id", "met", F.round(F.col("met") / (F.col("nd") + F.col("nb") - F.col("met")), 4).alias("jaccard"))


_STOP = ", ".join(f"'{w}'" for w in sorted({*T.GENERAL_STOP, *T.CLAIM_STOP}))


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(list_distinct({_TOK.format("text")}), lambda x: length(x) >= 4 AND NOT list_contains([{_STOP}], x)) AS s FROM conversations)
SELECT a.conv_id, a.turn, len(list_intersect(a.s, b.s)) AS met, len(list_distinct(list_concat(a.s, b.s))) AS united,
       round(coalesce(len(list_intersect(a.s, b.s)) / nullif(len(list_distinct(list_concat(a.s, b.s))), 0), 0), 4) AS c3
FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def content_token_overlap(spark, sf):
    """C3 between a turn and the one before it."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", T.content_tokens(F.col("text")).alias("s"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("s").alias("p"))
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect("s", "p")).cast("long").alias("met"), F.size(F.array_union("s", "p")).cast("long").alias("united"), F.round(T.jaccard(F.col("s"), F.col("p")), 4).alias("c3"))


@query()
def turn_edit_ratio(spark, sf):
    """The edit ratio of whole turns by code points; without SQL, as DuckDB's levenshtein counts bytes."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("x"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("x").alias("p"))
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.levenshtein("x", "p").cast("long").alias("distance"), F.round(T.edit_similarity(F.col("x"), F.col("p")), 4).alias("similarity"))


@query("""WITH y AS (SELECT o_custkey, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INT) AS y, max(o_orderstatus) AS s FROM orders GROUP BY 1, 2),
lim AS (SELECT max(y) - 1 AS late, max(y) - 2 AS early FROM y), a AS (SELECT o_custkey, s FROM y, lim WHERE y = early), b AS (SELECT o_custkey, s FROM y, lim WHERE y = late)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN b.o_custkey IS NULL THEN 'cancelled' WHEN a.s IS NOT DISTINCT FROM b.s THEN 'kept' ELSE 'modified' END AS status, a.s AS pre, b.s AS post
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def turn_diff_full_outer(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.substring(F.col("o_orderdate").cast("string"), 1, 4).cast("int").alias("y"))
    per = o.groupBy("o_custkey", "y").agg(F.max("o_orderstatus").alias("s"))
    last = o.agg(F.max("y").alias("last"))
    marked = per.crossJoin(F.broadcast(last))
    return R.diff_sides(marked.where("y = last - 2"), marked.where("y = last - 1"), ["o_custkey"], "s")


@query("""WITH e AS (SELECT * FROM events), p AS (SELECT user_id, min(ts) AS at FROM e WHERE event_type = (SELECT min(event_type) FROM e) GROUP BY 1)
SELECT p.user_id, p.at, arg_max(e.event_id, (e.ts, e.event_id)) FILTER (WHERE e.ts <= p.at) AS before_id, arg_min(e.event_id, (e.ts, e.event_id)) FILTER (WHERE e.ts > p.at) AS after_id
FROM p LEFT JOIN e USING (user_id) GROUP BY 1, 2""")
def asof_before_after(spark, sf):
    """The last event up to and the first after each user's first event of the first kind."""
    e = table(spark, sf, "events")
    kind = e.agg(F.min("event_type").alias("event_type"))
    pivots = e.join(F.broadcast(kind), "event_type").groupBy("user_id").agg(F.min("ts").alias("at"))
    return R.around(pivots, e, "user_id", "at", "ts", "event_id")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, sha256(concat(o_custkey, '::F::', o_orderkey)) AS h FROM orders)
SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY h, o_orderkey) AS rank FROM b) WHERE rank <= 3""")
def hash_random_k(spark, sf):
    return R.hash_k(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "F", 3)


@query("""SELECT doc_id, lang FROM documents WHERE CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 <> 3""")
def pool_minus_cohort(spark, sf):
    return R.bucket_split(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 10, 3)[1]


@query("""SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn AND d.role = 'user')
AND NOT EXISTS (SELECT 1 FROM conversations f WHERE f.conv_id = c.conv_id AND f.turn = c.turn AND f.text IS NULL)""")
def resume_anti_join(spark, sf):
    c = table(spark, sf, "conversations")
    return R.pending(c.select("conv_id", "turn"), c.where("role = 'user'"), c.where("text IS NULL"), ["conv_id", "turn"])


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN '(all)' ELSE o_orderstatus END AS row_value, CASE WHEN grouping(o_orderpriority) = 1 THEN '(all)' ELSE o_orderpriority END AS column_value, count(*) AS n
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def crosstab_cube(spark, sf):
    return R.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


_TARGETS = {"en": 600, "fr": 150, "de": 150, "es": 90, "it": 10}


@query(f"""WITH t(value, target) AS (VALUES {", ".join(f"('{k}', CAST({v} AS BIGINT))" for k, v in _TARGETS.items())})
SELECT value, target, coalesce(n, 0) AS achieved, coalesce(n, 0) - target AS delta FROM t LEFT JOIN (SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1) USING (value)""")
def target_vs_achieved(spark, sf):
    return R.against_targets(table(spark, sf, "documents"), "lang", _TARGETS)


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, sf):
    return R.duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@query("""SELECT CASE WHEN n <= 0 THEN '<=0' WHEN n <= 10 THEN '1-10' WHEN n <= 20 THEN '11-20' WHEN n <= 40 THEN '21-40' ELSE '>40' END AS bucket, count(*) AS n
FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1""")
def bucket_hist(spark, sf):
    per = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("k"))
    return R.histogram(per, "k", [0, 10, 20, 40])


@query("SELECT lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM documents GROUP BY lang")
def pct_of_total(spark, sf):
    return R.shares(table(spark, sf, "documents"), "lang")


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(CASE WHEN k = n // 2 THEN v END) AS upper_median, max(CASE WHEN k = n // 4 THEN v END) AS q1, max(CASE WHEN k = 3 * n // 4 THEN v END) AS q3 FROM r GROUP BY 1""")
def index_medians(spark, sf):
    """Upper median and quartiles by index; no group is sorted in one task."""
    n = F.col("n")
    return S.values_at(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"upper_median": F.floor(n / 2), "q1": F.floor(n / 4), "q3": F.floor(3 * n / 4)}).drop("n")


@query("""SELECT event_type, round(median(m), 6) AS median, count(*) AS n_cases FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1""")
def rep_mean_then_median(spark, sf):
    return S.mean_then_median(table(spark, sf, "events"), ["event_type"], "user_id", "value").withColumn("median", F.round("median", 6))


_DELTAS = """k AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS x FROM events), m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2),
d AS (SELECT a.user_id, b.event_type AS probe, round(b.v - a.v, 6) AS delta FROM m a JOIN m b USING (user_id), k WHERE a.event_type = x[1] AND b.event_type <> x[1])"""


def _deltas(spark, sf):
    """Per user: mean of every kind of event less that of the first kind, the baseline."""
    e = table(spark, sf, "events")
    m = e.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    base = m.join(F.broadcast(e.agg(F.min("event_type").alias("event_type"))), "event_type").select("user_id", F.col("v").alias("b"), F.col("event_type").alias("base"))
    return m.join(base, "user_id").where("event_type <> base").select("user_id", F.col("event_type").alias("probe"), F.round(F.col("v") - F.col("b"), 6).alias("delta"))


@query(f"WITH {_DELTAS} SELECT probe, count(*) AS n, sum((delta > 0)::INT) AS hits, round(avg((delta > 0)::INT), 6) AS hit_rate, round(median(delta), 6) AS median_delta FROM d GROUP BY 1")
def paired_delta_direction(spark, sf):
    hit = T.direction_hit(F.col("delta"), F.lit("UP"))
    d = _deltas(spark, sf)
    rates = d.groupBy("probe").agg(F.sum(hit).alias("hits"), F.round(F.avg(hit), 6).alias("hit_rate"))
    return S.medians(d, ["probe"], "delta").join(rates, "probe").select("probe", "n", "hits", "hit_rate", F.round("median", 6).alias("median_delta"))


@query(f"""WITH {_DELTAS}, z AS (SELECT *, rank() OVER (PARTITION BY probe ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY probe, abs(delta)) - 1) / 2.0 AS r FROM d WHERE delta <> 0)
SELECT probe, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN delta < 0 THEN r ELSE 0 END) AS w_minus, count(*) AS n FROM z GROUP BY 1""")
def wilcoxon_signed_rank_w(spark, sf):
    return S.signed_ranks(_deltas(spark, sf), ["probe"], "delta").drop("ties")


@query()
def wilcoxon_holm(spark, sf):
    """Paired tests with p values, Holm-adjusted as one family."""
    tests = S.wilcoxon(_deltas(spark, sf), ["probe"], "delta").withColumn("family", F.lit("all"))
    return S.holm(tests, ["family"], "p", "probe")


@query()
def bootstrap_tost(spark, sf):
    return S.bootstrap_tost(_deltas(spark, sf), ["probe"], "delta", case="user_id")


@query("""WITH p AS (SELECT l_returnflag AS family, l_linenumber AS id, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1 AS m FROM p)
SELECT family, id, round(max(least(1.0, m * p)) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING), 9) AS p_holm,
       bool_and(p <= 0.05 / m) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS reject FROM o""")
def holm_family(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    total = l.agg(F.count("*").alias("total"))
    p = l.groupBy(F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("id")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("family", "id", (F.col("n") / F.col("total")).alias("p"))
    return S.holm(p, ["family"], "p", "id").select("family", "id", F.round("p_holm", 9).alias("p_holm"), "reject")


@query("""WITH r AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS ry FROM orders)
SELECT o_orderpriority, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def channel_spearman(spark, sf):
    return S.spearman(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "o_custkey").withColumn("rho", F.round("rho", 6))


@query()
def parse_claims(spark, sf):
    """The claims in every whole text of documents."""
    return claims.claims(table(spark, sf, "documents"), "doc_id")


@query()
def greedy_cohort(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 1500, "long").otherwise("short").alias("size"))
    return cohort.greedy_cohort(docs, "doc_id", {"lang": {"en": 40, "fr": 30, "de": 20, "es": 10}, "size": {"long": 50, "short": 50}}, 100)


from tessera.plans import parsing, probes, reports, structure  # noqa: E402, F401  they register theirs
