"""Prompts, probes and retrieval over the text, part and embedding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import prompts as P
from tessera.operators import relational as R
from tessera.operators import retrieval as V
from tessera.plans.parsing import _TURNS, _turns
from tessera.plans.registry import query, table

_TASK = P.USER[P.USER.index(P.TASK) :].replace("'", "''")
_CASES = f"""{_TURNS}, c AS (SELECT conv_id AS case_id, string_agg('Claim ' || (turn + 1) || ' (' || role || '): A thing comprising: ' || replace(x, ';', ',') || '; a part', chr(10) || chr(10) ORDER BY turn) AS claims,
  'Rejection 1: Claim(s) claims ' || (min(turn) + 1) || ' rejected under 35 U.S.C. §10' || (conv_id % 3 + 1) || '(a) as anticipated over Smith; Jones ' || conv_id || '.' AS ground, string_agg('On turn ' || turn || ' it holds. And of ' || role || ' there is more to say here.', ' ' ORDER BY turn) AS full_text FROM t GROUP BY conv_id),
p AS (SELECT *, '## Application' || chr(10) || chr(10) || 'Title: Case ' || case_id || chr(10) || 'Application Number: ' || (case_id + 1000) || chr(10) || 'Technology Center: (unknown)' || chr(10) || chr(10) || '## Current claims (pre-amendment)' || chr(10) || chr(10) || claims || chr(10) || chr(10) || '## Office Action — rejection rationale' || chr(10) || chr(10)
  || ground || chr(10) || chr(10) || '---' || chr(10) || 'Examiner body (verbatim):' || chr(10) || full_text || chr(10) || chr(10) || '## Cited prior art references' || chr(10) || chr(10) AS head, '- Smith' || chr(10) || '- Jones ' || case_id AS refs, '{_TASK}' AS task FROM c),
u AS (SELECT *, head || refs || chr(10) || chr(10) || task AS "user" FROM p)"""


def _cases(spark, sf):
    """Conversations as cases: a claim a turn, one ground that attacks the first, two references, a body of short sentences."""
    text = F.concat(F.lit("A thing comprising: "), F.replace("x", F.lit(";"), F.lit(",")), F.lit("; a part"))
    said = F.concat(F.lit("On turn "), F.col("turn").cast("string"), F.lit(" it holds. And of "), "role", F.lit(" there is more to say here."))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", text.alias("text"), said.alias("said"))))
    per = _turns(spark, sf).groupBy(F.col("conv_id").alias("case_id")).agg(rows.alias("r"))
    texts = lambda *v: F.array(*v)
    refs = texts(F.lit("Smith"), F.concat(F.lit("Jones "), F.col("case_id").cast("string")))
    statute = F.concat(F.lit("10"), (F.col("case_id") % 3 + 1).cast("string"))
    ground = F.struct(texts(F.concat(F.lit("claims "), (F.get("r", F.lit(0))["turn"] + 1).cast("string"))).alias("claims_raw"), statute.alias("statute"), texts(F.lit("a")).alias("subsection"), texts(F.lit("anticipated")).alias("types"), refs.alias("references"))
    return per.select(
        "case_id", F.concat(F.lit("Case "), F.col("case_id").cast("string")).alias("title"), (F.col("case_id") + 1000).cast("string").alias("app_num"), F.lit("").alias("tech_center"),
        F.transform("r", lambda x: F.struct((x["turn"] + 1).cast("string").alias("num"), x["role"].alias("status"), x["text"].alias("text"))).alias("claims"),
        F.array(ground).alias("grounds"), refs.alias("references"), F.array_join(F.transform("r", lambda x: x["said"]), " ").alias("full_text"),
    )


def _out(df, *more):
    return df.select("case_id", "user", *more)


@query(f"""WITH {_CASES} SELECT case_id, "user", length("user") AS user_chars FROM u""")
def prompt_base(spark, sf):
    return _out(P.base(_cases(spark, sf)), "user_chars")


@query(f"""WITH {_CASES}, d AS (SELECT u.*, f.turn, f.role, replace(f.x, ';', ',') AS x FROM u JOIN (SELECT conv_id, turn, role, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t) f ON f.conv_id = u.case_id AND k = 1),
l AS (SELECT *, regexp_replace(regexp_replace(x, '\\s+and\\s*$', ''), '\\.+$', '') AS first FROM d)
SELECT case_id, replace("user", 'Claim ' || (turn + 1) || ' (' || role || '): A thing comprising: ' || x || '; a part', 'Claim ' || (turn + 1) || ' (' || role || '): A thing comprising: ' || CASE WHEN length(trim(first)) >= 6 THEN 'a part' ELSE trim(first) END || '.') AS "user", 'delete_longest_limitation' AS mode FROM l""")
def probe_a(spark, sf):
    return _out(P.probe_a(_cases(spark, sf)), "mode")


@query()
def probe_b(spark, sf):
    """Permuted sentences; held against a plain version, as the order follows a hash of every sentence's place."""
    return _out(P.probe_b(P.base(_cases(spark, sf))), "mode", "reason")


@query(f"""WITH {_CASES} SELECT case_id, head || '- Ref ' || (case_id % 7) || chr(10) || refs || chr(10) || chr(10) || task AS "user", CASE WHEN CAST('0x' || substr(sha256(case_id::VARCHAR), 1, 8) AS BIGINT) % 2 = 0 THEN 'C_decoy' ELSE 'C_mechtrue' END AS mode, CAST(NULL AS VARCHAR) AS reason FROM u WHERE case_id % 5 <> 0
UNION ALL SELECT case_id, "user", 'skipped', CASE WHEN case_id % 10 = 0 THEN 'case_not_in_c_index' ELSE 'no_test_pa' END FROM u WHERE case_id % 5 = 0""")
def probe_c(spark, sf):
    prompts = P.base(_cases(spark, sf))
    n = F.col("case_id")
    index = prompts.where(n % 10 != 0).select("case_id", P.subcondition(n).alias("subcondition"), F.when(n % 5 != 0, F.concat(F.lit("Ref "), (n % 7).cast("string"))).alias("injected_ref"), F.when(n % 5 == 0, "no_test_pa").alias("reason"))
    return _out(P.probe_c(prompts, index), "mode", "reason")


_BLOCK = P.BOILERPLATE.replace("'", "''")


@query(f"""WITH {_CASES} SELECT case_id, head || refs || chr(10) || chr(10) || '{_BLOCK}' || chr(10) || chr(10) || task AS "user" FROM u""")
def probe_d(spark, sf):
    return _out(P.probe_d(P.base(_cases(spark, sf))))


@query(f"""WITH {_CASES}, h AS (SELECT *, CAST('0x' || substr(sha256(case_id::VARCHAR), 1, 8) AS BIGINT) % 4 AS n FROM u)
SELECT case_id, replace("user", '## Task' || chr(10) || chr(10), '## Task' || chr(10) || chr(10) || 'Drafter guidance: ' || [{", ".join("'" + h + "'" for h in P.HINTS)}][n + 1] || chr(10) || chr(10)) AS "user", 'E' || (n + 1) AS hint_id FROM h""")
def probe_e(spark, sf):
    return _out(P.probe_e(P.base(_cases(spark, sf))), "hint_id")


_POOL = """pool AS (SELECT p_partkey AS pid, p_partkey + 5000 AS app_num, p_name AS pre_text, p_name || ' ' || p_type AS post_text, p_type AS statute, p_size % 3 AS subsection, p_brand AS kind FROM part),
blocks AS (SELECT case_id, '## Analogous past amendments' || chr(10) || chr(10) || 'The following ' || count(*) || ' past amendments retrieved from historical prosecution practice may inform the present drafting:' || chr(10) || chr(10)
  || string_agg('---' || chr(10) || 'Example ' || rank || ': Application ' || app_num || chr(10) || chr(10) || 'Rejected claim (pre-amendment):' || chr(10) || pre_text || chr(10) || chr(10) || 'Amended claim (as filed):' || chr(10) || post_text || chr(10) || chr(10), '' ORDER BY rank) || '---' || chr(10) || chr(10) AS block, string_agg(pid::VARCHAR, ',' ORDER BY rank) AS retrieved FROM picks JOIN pool USING (pid) GROUP BY case_id)
SELECT case_id, head || refs || chr(10) || chr(10) || block || chr(10) || task AS "user", retrieved FROM u JOIN blocks USING (case_id)"""


def _pool(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("pid"), (F.col("p_partkey") + 5000).alias("app_num"), F.col("p_name").alias("pre_text"), F.concat_ws(" ", "p_name", "p_type").alias("post_text"), F.col("p_type").alias("statute"), (F.col("p_size") % 3).alias("subsection"), F.col("p_brand").alias("kind"))


def _random(k: int) -> str:
    return f"""WITH {_CASES}, n AS (SELECT p_partkey AS pid, row_number() OVER (ORDER BY p_partkey) - 1 AS number, count(*) OVER () AS total FROM part),
d AS (SELECT case_id, j, CAST('0x' || substr(sha256(case_id || '::F::' || j), 1, 8) AS BIGINT) % (SELECT max(total) FROM n) AS number FROM u, generate_series(0, {8 * k + 23}) g(j)), f AS (SELECT case_id, number, min(j) AS j FROM d GROUP BY 1, 2),
picks AS (SELECT case_id, pid, row_number() OVER (PARTITION BY case_id ORDER BY j) AS rank FROM f JOIN n USING (number) QUALIFY rank <= {k}), {_POOL}"""


def _by_random(spark, sf, k):
    prompts, pool = P.base(_cases(spark, sf)), _pool(spark, sf)
    picks = V.random_k(prompts.select("case_id"), pool, "pid", ["pid"], k)
    told = P.with_exemplars(prompts, P.exemplars(picks, pool, "pid"), "F", "random_retrieval")
    return _out(told, F.array_join(F.transform("retrieved", lambda x: x.cast("string")), ",").alias("retrieved"))


@query(_random(3))
def probe_f(spark, sf):
    return _by_random(spark, sf, 3)


@query(_random(1))
def probe_f_k1(spark, sf):
    return _by_random(spark, sf, 1)


@query(_random(5))
def probe_f_k5(spark, sf):
    return _by_random(spark, sf, 5)


_FEATURES = """q AS (SELECT case_id, (SELECT list(DISTINCT p_type ORDER BY p_type) FROM part)[case_id % 3 + 1] AS statute, case_id % 3 AS subsection, 'Brand#' || (case_id % 25 + 1) AS kind FROM u)"""


def _structural(k: int) -> str:
    return f"""WITH {_CASES}, {_FEATURES}, s AS (SELECT case_id, p_partkey AS pid, (statute = p_type)::INT + (subsection = p_size % 3)::INT + (kind = p_brand)::INT AS score FROM q, part),
picks AS (SELECT case_id, pid, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, CAST(pid AS VARCHAR), pid) AS rank FROM s QUALIFY rank <= {k}), {_POOL}"""


def _by_structure(spark, sf, k):
    prompts, pool = P.base(_cases(spark, sf)), _pool(spark, sf)
    types = pool.agg(F.array_sort(F.collect_set("statute")).alias("types"))
    n = F.col("case_id")
    queries = prompts.crossJoin(F.broadcast(types)).select(n.alias("q"), F.get("types", (n % 3).cast("int")).alias("statute"), (n % 3).cast("int").alias("subsection"), F.concat(F.lit("Brand#"), (n % 25 + 1).cast("string")).alias("kind"))  # one row of types
    score = sum((F.col(f) == F.col(f"{f}_q")).cast("int") for f in ("statute", "subsection", "kind"))
    # Ids of cases and of the pool are of different things: none is its own candidate.
    found = V.structural_top_k(queries.withColumn("q", -1 - F.col("q")), pool, ["statute", "subsection", "kind"], score, k, "pid")
    picks = found.select((-1 - F.col("q")).alias("case_id"), "pid", "rank")
    told = P.with_exemplars(prompts, P.exemplars(picks, pool, "pid"), "G", "structural_retrieval")
    return _out(told, F.array_join(F.transform("retrieved", lambda x: x.cast("string")), ",").alias("retrieved"))


@query(_structural(3))
def probe_g(spark, sf):
    return _by_structure(spark, sf, 3)


@query(_structural(1))
def probe_g_k1(spark, sf):
    return _by_structure(spark, sf, 1)


@query(_structural(5))
def probe_g_k5(spark, sf):
    return _by_structure(spark, sf, 5)


_COSINE = "round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6)"
_VECTORS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _dense(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("c"), "label", F.col("embedding").alias("v"))
    return V.dense_top_k(e.where("c % 20 = 0").select(F.col("c").alias("q"), "v"), e, 3)


@query(f"""WITH {_VECTORS}, s AS (SELECT a.vec_id AS q, b.vec_id AS c, b.label, {_COSINE} AS cosine FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY cosine DESC, c) AS k FROM s)
SELECT q, c, label, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, c) AS rank FROM o WHERE k = 1) WHERE rank <= 3""")
def dense_topk_dedup(spark, sf):
    """Cosine top 3 with each label once, for the queries whose id is divisible by 20, against all rows."""
    return _dense(spark, sf)


@query(f"""WITH {_CASES}, {_VECTORS}, s AS (SELECT a.vec_id AS q, b.vec_id AS c, b.label, {_COSINE} AS cosine FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY cosine DESC, c) AS k FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, c) AS rank FROM o WHERE k = 1),
picks AS (SELECT q // 20 AS case_id, c AS pid, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM r JOIN part ON p_partkey = c WHERE rank <= 3), {_POOL}""")
def probe_h(spark, sf):
    """Exemplars by embedding; vectors stand for cases and for the pool's rows."""
    prompts, pool = P.base(_cases(spark, sf)), _pool(spark, sf)
    picks = _dense(spark, sf).select(F.floor(F.col("q") / 20).alias("case_id"), F.col("c").alias("pid"), "rank")
    told = P.with_exemplars(prompts, P.exemplars(picks, pool, "pid"), "H", "dense_retrieval").where("reason IS NULL")
    return _out(told, F.array_join(F.transform("retrieved", lambda x: x.cast("string")), ",").alias("retrieved"))


@query("""WITH s AS (SELECT a.p_partkey AS q, b.p_partkey AS c, (a.p_brand = b.p_brand)::INT + (a.p_type = b.p_type)::INT + (a.p_size = b.p_size)::INT * 0.5 AS score FROM part a JOIN part b ON a.p_partkey <> b.p_partkey WHERE a.p_partkey % 20 = 0)
SELECT q, c, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, CAST(c AS VARCHAR), c) AS rank FROM s) WHERE rank <= 3""")
def structural_topk(spark, sf):
    """Three candidates by structural score out of all parts, ties by the id as a text, for the queries whose id is divisible by 20."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("c"), "p_brand", "p_type", "p_size")
    same = lambda f: (F.col(f) == F.col(f"{f}_q")).cast("int")
    score = (same("p_brand") + same("p_type") + same("p_size") * 0.5).cast("double")
    return V.structural_top_k(p.where("c % 20 = 0").withColumnRenamed("c", "q"), p, ["p_brand", "p_type", "p_size"], score, 3)


_PARTS = "p AS (SELECT p_partkey, p_brand, list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z][a-z\\-'']+'))) AS s FROM part)"
_JACCARD = "len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))"


def _tokens(spark, sf):
    p = table(spark, sf, "part")
    tokens = F.array_sort(F.array_distinct(T.word_tokens(F.concat_ws(" ", "p_name", "p_type"))))
    p = p.select("p_partkey", F.col("p_brand").alias("statute"), tokens.alias("tokens"))
    return p.where("p_partkey % 20 = 0").withColumnRenamed("p_partkey", "case_id"), p.where("p_partkey % 20 <> 0")


def _reference(compare: str, order: str) -> str:
    return f"""WITH {_PARTS}, m AS (SELECT a.p_partkey AS case_id, CAST(b.p_partkey AS VARCHAR) AS source, {_JACCARD} AS j FROM p a JOIN p b ON a.p_brand {compare} b.p_brand WHERE a.p_partkey % 20 = 0 AND b.p_partkey % 20 <> 0)
SELECT case_id, source, round(j, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY j {order}, source) AS k FROM m) WHERE k = 1"""


@query(_reference("<>", "DESC"))
def decoy_argmax(spark, sf):
    """For every twentieth part the part of another brand whose name is most alike."""
    return V.decoy(*_tokens(spark, sf), "p_partkey").select("case_id", "source", "similarity")


@query(_reference("=", ""))
def mechtrue_argmin(spark, sf):
    """For every twentieth part the part of its brand whose name is least alike."""
    return V.mechanism_true(*_tokens(spark, sf), "p_partkey").select("case_id", "source", "similarity")


@query(f"""WITH {_VECTORS}, s AS (SELECT a.vec_id AS q, b.vec_id AS c, b.label, {_COSINE} AS cosine FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY q, label ORDER BY cosine DESC, c) AS k FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, c) AS rank FROM o WHERE k = 1),
picks AS (SELECT q AS case_id, 'H' AS cond, c, rank FROM r WHERE rank <= 3 UNION ALL SELECT vec_id, 'X', vec_id + 7, 1 FROM e WHERE vec_id % 20 = 0),
l AS (SELECT p.cond, list_dot_product(a.v, b.v) AS cosine, CASE WHEN b.label IS NOT NULL THEN (a.label = b.label)::INT * 2.0 END AS score, a.label = b.label AS same FROM picks p JOIN e a ON a.vec_id = p.case_id LEFT JOIN e b ON b.vec_id = p.c)
SELECT cond, count(*) AS n, round(avg(cosine), 5) AS mean_cosine, round(avg(score), 5) AS mean_score, round(avg(same::INT), 5) AS statute_rate FROM l GROUP BY cond""")
def retrieval_quality(spark, sf):
    """Mean cosine, score and statute match of picks by two policies; a pick may lie outside the pool."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("c"), F.col("label").alias("statute"), F.col("embedding").alias("v"))
    near = _dense(spark, sf).select(F.col("q").alias("case_id"), F.lit("H").alias("cond"), "c", "rank")
    picks = near.unionByName(e.where("c % 20 = 0").select(F.col("c").alias("case_id"), F.lit("X").alias("cond"), (F.col("c") + 7).alias("c"), F.lit(1).alias("rank")))
    log = V.quality_log(picks, e.withColumnRenamed("c", "case_id"), e, (F.col("statute") == F.col("statute_q")).cast("int") * 2.0)
    return V.quality_summary(log)


@query("""WITH g AS (SELECT DISTINCT conv_id AS case_id FROM conversations), p AS (SELECT case_id, r AS rep, c AS cond, sha256(case_id || '__rep' || r || '__seed42__' || c) AS h FROM g, generate_series(0, 2) a(r), (VALUES ('baseline'), ('A'), ('B'), ('F')) b(c))
SELECT case_id, rep, cond, row_number() OVER (PARTITION BY case_id, rep ORDER BY h) - 1 AS place FROM p""")
def planned_grid(spark, sf):
    """Cases by repetitions by conditions, the conditions in hash order."""
    return P.condition_order(table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id")).distinct(), ["baseline", "A", "B", "F"], 3)


@query("""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z\\-'']+')) AS s, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 4) AS jaccard, round(len(list_intersect(a.s, b.s)) / len(a.s), 4) AS "precision", round(len(list_intersect(a.s, b.s)) / len(b.s), 4) AS recall
FROM w a JOIN w b ON a.lang = b.lang AND a.source = b.source AND b.k = a.k + 1 WHERE len(a.s) > 0 AND len(b.s) > 0""")
def neighbour_overlap(spark, sf):
    """Word overlap of each document with the next of its language and source: Jaccard, precision and recall."""
    d = table(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", "lang", "source", F.array_distinct(T.word_tokens(F.col("text"))).alias("s"))
    from pyspark.sql.window import Window as W

    following = W.partitionBy("lang", "source").orderBy("doc_id")
    both = d.withColumns({"b": F.lead("doc_id").over(following), "t": F.lead("s").over(following)}).where("b IS NOT NULL AND size(s) > 0 AND size(t) > 0")
    return both.select(F.col("doc_id").alias("a"), "b", T.precision_recall(F.col("s"), F.col("t")).alias("m")).select("a", "b", "m.jaccard", "m.precision", "m.recall")
