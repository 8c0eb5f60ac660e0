"""Structure of texts: counters, shapes, repetition, markup census, quotations, application numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import shape
from tessera.functions import text as T
from tessera.operators import quotes as Q
from tessera.operators import relational as R
from tessera.plans.registry import query, table

_RE2 = [k for k in shape.COUNTERS if k != "markup_single_underscore"]  # looks behind, which the oracle's patterns cannot


def _counted(k: str) -> str:
    flags = "(?m)" if k.startswith("markup") else "(?im)"
    return f"len(regexp_extract_all(t, '{flags}{shape.COUNTERS[k]}')) AS {k}"


# Lines that the prose of conversations does not have: one a turn, by its place and role.
_MARKED = """m AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 5 WHEN 0 THEN chr(10) || 'Claim ' || turn || ' (' || role || '): comprising [[old]] __new__'
  WHEN 1 THEN chr(10) || turn || '. (Original) said device, wherein' WHEN 2 THEN chr(10) || '# Note: (NEW) (canceled)' ELSE '' END AS t FROM conversations)"""


def _marked(spark, sf):
    n, line = F.col("turn"), lambda *parts: F.concat(F.lit("\n"), *parts)
    more = (
        F.when(n % 5 == 0, line(F.lit("Claim "), n.cast("string"), F.lit(" ("), F.col("role"), F.lit("): comprising [[old]] __new__")))
        .when(n % 5 == 1, line(n.cast("string"), F.lit(". (Original) said device, wherein"))).when(n % 5 == 2, line(F.lit("# Note: (NEW) (canceled)"))).otherwise("")
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), more).alias("t"))


@query(rf"""WITH {_MARKED}, l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM m)
SELECT conv_id, turn, {", ".join(_counted(k) for k in _RE2)}, len(l) AS n_nonblank_lines, length(t) AS total_chars,
  regexp_matches(coalesce(l[1], ''), '(?i){shape.COUNTERS["hdr_claim_N_paren_status"]}')::BIGINT AS first_line_is_claim_hdr,
  regexp_matches(coalesce(l[-1], ''), '(?i){shape.COUNTERS["hdr_claim_N_paren_status"]}')::BIGINT AS last_line_is_claim_hdr,
  regexp_matches(coalesce(l[1], ''), '(?i)\b(comprising|wherein|said|configured)\b')::BIGINT AS first_line_has_body FROM l""")
def markup_counters(spark, sf):
    """All counters but one, and the shape of the first and last line, of conversations with claim lines added."""
    cols = {**shape.counters(F.col("t"), _RE2), **shape.ends_shape(F.col("t"))}
    return _marked(spark, sf).select("conv_id", "turn", *[c.alias(k) for k, c in cols.items()])


@query(f"""WITH {_MARKED}, c AS (SELECT {", ".join(_counted(k) for k in _RE2)} FROM m),
u AS (UNPIVOT c ON COLUMNS(*) INTO NAME pattern VALUE n)
SELECT pattern, sum(n)::BIGINT AS hits, count(*) FILTER (WHERE n > 0) AS texts FROM u GROUP BY pattern""")
def pattern_totals(spark, sf):
    """Hits of every counter, and in how many texts there is any."""
    counts = _marked(spark, sf).select(F.explode(F.create_map(*[x for k, c in shape.counters(F.col("t"), _RE2).items() for x in (F.lit(k), c)])).alias("pattern", "n"))
    return counts.groupBy("pattern").agg(F.sum("n").alias("hits"), F.count_if(F.col("n") > 0).alias("texts"))


_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x{0B}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"



@query(rf"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT doc_id, l, list_transform(l, lambda x: {_strip("x")}) AS s FROM l),
f AS (SELECT *, list_sort(list_transform(list_filter(l, lambda x: {_strip("x")} <> ''), lambda x: length(x))) AS z FROM s), g AS (SELECT *, CASE WHEN len(z) > 0 THEN z ELSE [0] END AS n FROM f)
SELECT doc_id, len(l) AS n_lines, len(z) AS non_blank, len(l) - len(z) AS n_blank, len(list_filter(l, lambda x: regexp_matches(x, '^{_WS}*\d+[.)\]]{_WS}'))) AS n_numbered,
  len(list_filter(l, lambda x: regexp_matches(x, '^{_WS}*[-*\x{{2022}}]{_WS}'))) AS n_bullet,
  len(list_filter(s, lambda x: x <> '' AND (suffix(x, ':') OR (upper(x) = x AND lower(x) <> x AND length(x) > 3)))) AS n_header_like,
  round(list_sum(n) / len(n), 1) AS len_mean, list_max(n) AS len_max, n[floor(0.95 * (len(n) - 1))::INT + 1] AS len_p95 FROM g""")
def line_shape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", shape.line_shape(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n{_WS}*\n'), lambda x: {_strip("x")}), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, len(p) AS paragraphs, round(coalesce(list_avg(list_transform(p, lambda x: length(x))), 0), 1) AS para_chars_mean, coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS para_chars_max FROM p""")
def paragraph_shape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", shape.paragraph_shape(F.col("text")).alias("s")).select("doc_id", "s.*")


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z\-'']+')"


@query(rf"""WITH t AS (SELECT doc_id, {_TOK} AS w, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS l FROM documents),
g AS (SELECT *, CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) ELSE [] END AS g FROM t),
e AS (SELECT doc_id, unnest(g) AS x FROM g), c AS (SELECT doc_id, x, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT doc_id, array_to_string(list_slice(list_reverse_sort(list(n)), 1, 5), ',') AS top_grams FROM c GROUP BY 1),
f AS (SELECT doc_id, unnest(l) AS x FROM g), d AS (SELECT doc_id, x, count(*) AS n FROM f GROUP BY ALL), j AS (SELECT doc_id, array_to_string(list_slice(list_reverse_sort(list(n)), 1, 5), ',') AS top_lines FROM d GROUP BY 1)
SELECT doc_id, len(w) AS word_count, round(coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0), 3) AS unique_word_ratio, round(coalesce(1.0 - len(list_distinct(l)) / nullif(len(l), 0), 0), 3) AS line_dup_ratio,
  coalesce(top_lines, '') AS top_lines, round(coalesce(len(list_distinct(g)) / nullif(len(g), 0), 1), 3) AS fivegram_diversity, coalesce(top_grams, '') AS top_grams
FROM g LEFT JOIN k USING (doc_id) LEFT JOIN j USING (doc_id)""")
def repetition(spark, sf):
    """Repetition within every document; counts are over hashes of 5-grams."""
    d = table(spark, sf, "documents").select("doc_id", shape.repetition(F.col("text"), T.word_tokens(F.col("text"))).alias("s")).select("doc_id", "s.*")
    return d.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("top_lines", "top_grams")})


_KEYWORDS = ["the", "and", "license", "tion", "note"]


@query("SELECT doc_id, " + ", ".join(f"(length(t) - length(replace(t, '{k}', ''))) // {len(k)} AS kw_{k}" for k in _KEYWORDS) + " FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def keyword_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", *[T.keyword_count(F.col("t"), k).alias(f"kw_{k}") for k in _KEYWORDS])


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<([A-Za-z][A-Za-z0-9:]*)', 1)) AS tag FROM pages), c AS (SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, tag) AS k FROM c)
SELECT tag, sum(n)::BIGINT AS n, count(*) AS files FROM r WHERE k <= 15 GROUP BY tag""")
def tag_census(spark, sf):
    """Tags of every page, its fifteen most frequent ones, summed over pages."""
    tags = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<([A-Za-z][A-Za-z0-9:]*)"), F.lit(1))).alias("tag"))
    top = R.top_k(tags.groupBy("page_id", "tag").agg(F.count("*").alias("n")), ["page_id"], [F.desc("n"), F.col("tag")], 15)
    return top.groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


@query(r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT len(regexp_extract_all(h, '<li>')) AS items, len(regexp_extract_all(h, '<li>[^<]*</li>')) AS plain, len(regexp_extract_all(h, '\[\[[^\[\]]{1,200}\]\]')) AS brackets, length(h) AS chars FROM p)
SELECT count(*) AS files, count(*) FILTER (WHERE items > 0) AS with_items, sum(items)::BIGINT AS items, sum(plain)::BIGINT AS plain_items, sum(brackets)::BIGINT AS brackets, round(1000.0 * sum(items) / sum(chars), 6) AS items_per_1000 FROM f""")
def page_diagnostics(spark, sf):
    """Totals of markup over pages, and its density."""
    h, n = F.coalesce("html", F.lit("")), lambda p: F.regexp_count(F.col("h"), F.lit(p)).cast("long")
    f = table(spark, sf, "pages").select(h.alias("h")).select(n("<li>").alias("items"), n("<li>[^<]*</li>").alias("plain"), n(r"\[\[[^\[\]]{1,200}\]\]").alias("brackets"), F.length("h").alias("chars"))
    return f.agg(F.count("*").alias("files"), F.count_if(F.col("items") > 0).alias("with_items"), F.sum("items").alias("items"), F.sum("plain").alias("plain_items"), F.sum("brackets").alias("brackets"), F.round(1000.0 * F.sum("items") / F.sum("chars"), 6).alias("items_per_1000"))


_OPINION = """'Claim ' || (turn + 1) || ' recites ' || replace(coalesce(text, ''), '.', ',') || '. As to "' || replace(coalesce(text, ''), '"', '') || '" see 12/345,' || lpad((turn + 100)::VARCHAR, 3, '0') || ' and the claimed thing stands here. '"""


def _opinions(spark, sf):
    t = F.coalesce("text", F.lit(""))
    said = F.concat(
        F.lit("Claim "), (F.col("turn") + 1).cast("string"), F.lit(" recites "), F.replace(t, F.lit("."), F.lit(",")), F.lit('. As to "'), F.replace(t, F.lit('"'), F.lit("")),
        F.lit('" see 12/345,'), F.lpad((F.col("turn") + 100).cast("string"), 3, "0"), F.lit(" and the claimed thing stands here. "),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", said.alias("text"))


@query(rf"""WITH o AS (SELECT conv_id, turn, {_OPINION} AS t FROM conversations), p(pattern) AS (VALUES {", ".join(f"('{k}')" for k in shape.QUOTES)}),
q AS (SELECT conv_id, turn, pattern, unnest(CASE pattern WHEN 'long_dq' THEN regexp_extract_all(t, '"[^"]{{60,1000}}[^"]{{0,200}}"') WHEN 'claim_recites' THEN regexp_extract_all(t, '{shape.QUOTES["claim_recites"]}') ELSE regexp_extract_all(t, '{shape.QUOTES["as_claimed"]}') END) AS m, t FROM o, p)
SELECT conv_id, turn, pattern, instr(t, m) - 1 AS first, instr(t, m) - 1 + length(m) AS behind, substr(m, 1, 800) AS quote FROM q""")
def quotes_in_opinions(spark, sf):
    """Quotations of claims with their places, in opinions made of turns."""
    key = F.struct("conv_id", "turn")
    return Q.quotes(_opinions(spark, sf).select(F.to_json(key).alias("key"), "text"), "key").select(F.from_json("key", "conv_id long, turn long").alias("k"), "*").select("k.*", "pattern", "first", "behind", "quote")


@query(r"""WITH a AS (SELECT DISTINCT conv_id, '12345' || lpad((turn + 100)::VARCHAR, 3, '0') AS app FROM conversations), known AS (SELECT '12345' || (100 + k) AS app FROM generate_series(0, 6, 2) t(k))
SELECT conv_id, array_to_string(list_sort(list(app)), ',') AS apps, count(*) AS n, count(*) > 1 AS multiple FROM a JOIN known USING (app) GROUP BY conv_id""")
def application_matches(spark, sf):
    """Application numbers that opinions mention and a list knows, by conversation."""
    apps = _opinions(spark, sf).select("conv_id", F.explode(shape.application_numbers(F.col("text"))).alias("app")).distinct()
    known = spark.range(0, 7, 2).select(F.concat(F.lit("12345"), (F.col("id") + 100).cast("string")).alias("app"))
    met = apps.join(known, "app", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list("app")).alias("apps"))
    return met.select("conv_id", F.array_join("apps", ",").alias("apps"), F.size("apps").cast("long").alias("n"), (F.size("apps") > 1).alias("multiple"))


@query(r"""WITH r AS (SELECT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) WHEN 2 THEN 'Smith (5,295,' || (100 + p_size) || ')' ELSE p_brand END AS ref FROM part),
k AS (SELECT CASE WHEN regexp_matches(ref, '\(?\s*([\d,]{5,10})\s*\)?') AND regexp_matches(ref, '\d') THEN 'with_number' WHEN regexp_matches(trim(ref), '^[A-Z][a-zA-Z\-. ]{1,50}$') THEN 'name_only' ELSE 'suspicious' END AS kind FROM r)
SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM k GROUP BY kind""")
def reference_kinds(spark, sf):
    """Cited references by form, with shares to one digit."""
    n, name = F.col("p_partkey") % 4, F.col("p_name")
    ref = F.when(n == 0, name).when(n == 1, F.concat(F.upper(F.substring(name, 1, 1)), F.expr("substring(p_name, 2)"))).when(n == 2, F.concat(F.lit("Smith (5,295,"), (F.col("p_size") + 100).cast("string"), F.lit(")"))).otherwise(F.col("p_brand"))
    return R.shares(table(spark, sf, "part").select(shape.reference_kind(ref).alias("kind")), "kind", 1)
