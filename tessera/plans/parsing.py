"""Parsing: claims and office actions made of the text tables, taken apart again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import patent as X
from tessera.operators import claims as K
from tessera.plans.registry import query, table
from tessera.sources import xml

_CLEAN = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9.,; ]+', ' ', 'g'), ' +', ' ', 'g'))"
_TURNS = f"t AS (SELECT conv_id, turn, role, {_CLEAN} AS x FROM conversations WHERE {_CLEAN} <> '')"


def _turns(spark, sf):
    """Turns whose text is letters, digits and plain punctuation."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9.,; ]+", " "), " +", " "))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", clean.alias("x")).where("x <> ''")


def _joined(turns, one):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "x")))
    return turns.groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", "rows", F.array_join(F.transform("rows", one), "").alias("body"))


def claim_xml(turns):
    """Conversations as claims documents: by conv_id mod 3 with numbers in name spaces, in the legacy form, or all texts in one claim."""
    c, n = F.concat, lambda r: (r["turn"] + 1).cast("string")
    lit = F.lit
    of = lambda one: _joined(turns, one)
    a = of(lambda r: c(lit("<u:Claim><u:ClaimNumber>"), n(r), lit("</u:ClaimNumber><u:ClaimStatusCategory>"), r["role"], lit("</u:ClaimStatusCategory><u:ClaimText>"), r["x"], lit(" <u:U>more</u:U></u:ClaimText></u:Claim>"))).where("conv_id % 3 = 0")
    b = of(lambda r: c(lit('<claim num="'), n(r), lit('" claim-type="'), r["role"], lit('"><claim-text><confidence value="1">'), r["x"], lit("</confidence></claim-text></claim>"))).where("conv_id % 3 = 1")
    d = of(lambda r: c(lit("<u:ClaimText>"), n(r), lit(". ("), r["role"], lit(") "), r["x"], lit("</u:ClaimText><u:ClaimText>and on</u:ClaimText>"))).where("conv_id % 3 = 2")
    wrap = lambda rows, head, tail: rows.select("conv_id", F.encode(c(lit(head), "body", lit(tail)), "UTF-8").alias("content"))
    space = '<u:ClaimsDocument xmlns:u="urn:us:gov:doc:uspto:patent">'
    return wrap(a, space, "</u:ClaimsDocument>").union(wrap(b, "<us-patent-application><claims>", "</claims></us-patent-application>")).union(wrap(d, space + "<u:Claim>", "</u:Claim></u:ClaimsDocument>"))


@query(f"""WITH {_TURNS} SELECT conv_id, CAST(turn + 1 AS VARCHAR) AS num, role AS status, CASE conv_id % 3 WHEN 0 THEN x || ' more' WHEN 1 THEN x ELSE (turn + 1) || '. (' || role || ') ' || x || ' and on' END AS text, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_additions FROM t""")
def xml_claims(spark, sf):
    """Claims of XML documents in three layouts."""
    parsed = xml.claim_documents(claim_xml(_turns(spark, sf)), "conv_id")
    return xml.claims(parsed, "conv_id").select("conv_id", "num", "status", "text", F.size("additions").cast("long").alias("n_additions"))


def action_xml(turns):
    """Conversations as office actions: a heading, a paragraph with fields a turn, a closing one, and one more behind it."""
    c, lit = F.concat, F.lit
    field = lambda k, v: c(lit(f'<c:DataField c:dataFieldNumber="{k}">'), v, lit("</c:DataField>"))
    paragraph = lambda number, body, *fields: c(lit("<c:FormParagraph><c:FormParagraphNumber>"), number, lit("</c:FormParagraphNumber><c:P>"), body, lit("</c:P>"), *fields, lit("</c:FormParagraph>"))
    ground = lambda role: F.when(role == "user", "Anticipated").otherwise("see note")
    one = lambda r: paragraph(c(lit("fp"), r["turn"].cast("string")), r["x"], field(1, c(lit("claims "), (r["turn"] + 1).cast("string"))), field(2, lit("a")), field(3, ground(r["role"])), field(4, c(lit("Smith "), r["role"])), field(4, lit("571-272-1000 fax")))
    rows = _joined(turns, one)
    head = paragraph(c(lit("USC_10"), (F.col("conv_id") % 3 + 1).cast("string"), lit("_heading")), lit("Heading"))
    tail = c(paragraph(lit("conclusion_heading"), lit("End")), paragraph(lit("late"), lit("Late"), field(1, lit("9")), field(3, lit("rejected")), field(4, lit("Late Reference"))))
    whole = c(lit('<c:OutgoingDocument xmlns:c="urn:us:gov:doc:uspto:common">'), head, "body", tail, lit("</c:OutgoingDocument>"))
    return rows.select("conv_id", F.encode(whole, "UTF-8").alias("content"))


@query(f"""WITH {_TURNS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM t)
SELECT conv_id, pos, '10' || (conv_id % 3 + 1) AS statute, 'claims ' || (turn + 1) AS claims_raw, 'a' AS subsection, 'Smith user' AS "references", false AS fallback FROM o WHERE role = 'user'""")
def xml_rejections(spark, sf):
    """Grounds of rejection in office actions: statutes carried on, nothing behind the closing paragraph."""
    found = xml.rejections(xml.office_actions(action_xml(_turns(spark, sf)), "conv_id"), "conv_id").where("NOT fallback")
    joined = lambda k: F.array_join(k, "|").alias(k)
    return found.select("conv_id", "pos", "statute", joined("claims_raw"), joined("subsection"), joined("references"), "fallback")


@query(f"""WITH {_TURNS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM t), s AS (SELECT conv_id, pos, x AS body, '' AS heading, false AS closed FROM o
UNION ALL SELECT DISTINCT conv_id, 0, 'Heading', '35 USC § 10' || (conv_id % 3 + 1), false FROM t UNION ALL SELECT conv_id, max(pos) + 1, 'End', 'Conclusion', true FROM o GROUP BY 1 UNION ALL SELECT conv_id, max(pos) + 2, 'Late', '', true FROM o GROUP BY 1)
SELECT conv_id, pos, heading, body, closed, '10' || (conv_id % 3 + 1) AS statute FROM s""")
def xml_sections(spark, sf):
    return xml.sections(xml.office_actions(action_xml(_turns(spark, sf)), "conv_id"), "conv_id").select("conv_id", "pos", "heading", "body", "closed", "statute")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, ['Smith', 'Jones et al.', 'Brown (5,295,698)'][o_orderkey % 3 + 1] AS name FROM orders WHERE o_orderkey % 5 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, name ORDER BY pos) = 1 AS new FROM o)
SELECT o_custkey, pos, '1-' || (o_orderkey % 9 + 2) AS claims, '103' AS statute, 'a' AS subsection, 'unpatentable over ' || regexp_replace(name, '\\.$', '') AS clause, CASE WHEN new THEN regexp_replace(name, '\\.$', '') ELSE '' END AS "references" FROM f""")
def rejection_sentences(spark, sf):
    """Rejections read from sentences; a reference counts where it stands first in the text."""
    o = table(spark, sf, "orders").where("o_orderkey % 5 = 0")
    name = F.element_at(F.array(F.lit("Smith"), F.lit("Jones et al."), F.lit("Brown (5,295,698)")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    said = F.concat(F.lit("Claims 1-"), (F.col("o_orderkey") % 9 + 2).cast("string"), F.lit(" are rejected under 35 U.S.C. § 103(a) as being unpatentable over "), name, F.lit(". "))
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", said.alias("s"))))
    text = o.groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda r: r["s"]), "").alias("text"))
    found = text.select("o_custkey", F.posexplode(X.rejection_sentences(F.col("text"))).alias("pos", "r")).select("o_custkey", "pos", "r.*")
    return found.withColumn("references", F.array_join("references", "|"))


_STATUS = ["original", "currently amended", "previously presented", "cancelled", "new", "withdrawn", "unheard of"]
_NORMAL = ["original", "currently_amended", "previously_presented", "cancelled", "new", "withdrawn", "unknown"]


def _responses(spark, sf):
    """Conversations as responses: a claim a turn, with marks, statuses in turn."""
    status = lambda r: F.element_at(F.array(*[F.lit(s) for s in _STATUS]), (r["turn"] % 7 + 1).cast("int"))
    one = lambda r: F.concat((r["turn"] + 1).cast("string"), F.lit(". ("), status(r), F.lit("): "), r["x"], F.lit(" [[gone]] __come__\n\n"))
    return _joined(_turns(spark, sf), one).select("conv_id", F.col("body").alias("text"))


@query(f"""WITH {_TURNS}, s AS (SELECT *, [{", ".join(f"'{s}'" for s in _NORMAL)}][turn % 7 + 1] AS s FROM t)
SELECT conv_id, count(*) AS n_claims, {", ".join(f"count(*) FILTER (WHERE s = '{s}') AS n_{s}" for s in _NORMAL)}, count(*) FILTER (WHERE s IN ('currently_amended', 'new')) AS amended_or_new,
  count(*) AS n_added, count(*) AS n_deleted, 4 * count(*) AS addition_chars, 4 * count(*) AS deletion_chars, sum(length(x) + 5) // count(*) AS plain_chars_mean FROM s GROUP BY conv_id""")
def response_digest(spark, sf):
    """Claims of responses by status, with additions and deletions."""
    return K.status_digest(K.claims(_responses(spark, sf), "conv_id"), "conv_id")


@query(f"""WITH {_TURNS} SELECT conv_id, turn + 1 AS num, x || ' come' AS plain, 'come' AS added, 'gone' AS deleted FROM t""")
def response_claims(spark, sf):
    """Every claim of every response with its plain body, additions and deletions."""
    return K.claims(_responses(spark, sf), "conv_id").select("conv_id", "num", "plain", F.array_join("added", "|").alias("added"), F.array_join("deleted", "|").alias("deleted"))


_TOK = r"regexp_extract_all(lower({}), '[a-z][a-z\-'']+')"


def _tri(c: str) -> str:
    return f"list_distinct(CASE WHEN len({c}) >= 3 THEN list_transform(generate_series(1, len({c}) - 2), lambda i: array_to_string({c}[i : i + 2], ' ')) ELSE [] END)"


_PAIRS = f"""{_TURNS}, p AS (SELECT conv_id, turn AS num, x AS pre, x || ' alpha beta gamma delta' AS gen, x || ' alpha beta' AS post FROM t WHERE length(x) >= 10), f AS (SELECT conv_id, string_agg(x, ' ' ORDER BY turn) AS full_text FROM t WHERE turn % 2 = 0 GROUP BY 1)"""


def _pairs(spark, sf):
    t = _turns(spark, sf)
    pre = t.where("length(x) >= 10").select("conv_id", F.col("turn").alias("num"), F.col("x").alias("text"))
    gen, post = pre.withColumn("text", F.concat("text", F.lit(" alpha beta gamma delta"))), pre.withColumn("text", F.concat("text", F.lit(" alpha beta")))
    rows = F.array_sort(F.collect_list(F.struct("turn", "x")))
    full = t.where("turn % 2 = 0").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), " ").alias("full_text"))
    return pre, gen, post, full


@query(rf"""WITH {_PAIRS}, w AS (SELECT p.*, {_TOK.format("pre")} AS wp, {_TOK.format("gen")} AS wg, {_TOK.format("full_text")} AS wf FROM p JOIN f USING (conv_id) WHERE num % 3 <> 1),
s AS (SELECT conv_id, num, {_tri("wp")} AS a, {_tri("wg")} AS b, {_tri("wf")} AS f FROM w), r AS (SELECT *, list_intersect(a, f) AS rejected, list_concat(list_filter(a, lambda v: NOT list_contains(b, v)), list_filter(b, lambda v: NOT list_contains(a, v))) AS changed FROM s),
j AS (SELECT conv_id, round(coalesce(len(list_intersect(changed, rejected)) / nullif(len(list_distinct(list_concat(changed, rejected))), 0), 0), 4) AS j FROM r WHERE len(rejected) > 0)
SELECT conv_id, round(avg(j), 4) AS c1, count(*) AS n_claims FROM j GROUP BY conv_id""")
def claim_overlap(spark, sf):
    """C1: changed trigrams against rejected ones, joined by claim number."""
    pre, gen, _, full = _pairs(spark, sf)
    nums = pre.groupBy("conv_id").agg(F.collect_set(F.when(F.col("num") % 3 != 1, F.col("num").cast("bigint"))).alias("rejected_nums"))
    return K.overlap_by_number(pre, gen, full.join(nums, "conv_id"), "conv_id").select("conv_id", "c1", "n_claims")


@query(rf"""WITH {_PAIRS}, j AS (SELECT conv_id, string_agg(pre, chr(10) ORDER BY num) AS pre, string_agg(gen, chr(10) ORDER BY num) AS gen, string_agg(post, chr(10) ORDER BY num) AS post FROM p WHERE conv_id % 4 = 0 GROUP BY 1)
SELECT conv_id, round(levenshtein(pre, gen) / greatest(levenshtein(pre, post), 1), 4) AS c2, CAST(NULL AS VARCHAR) AS reason FROM j""")
def claim_edit(spark, sf):
    """C2 over all claims of a case joined in the order of their numbers, for every fourth conversation as the cohort."""
    pre, gen, post, _ = _pairs(spark, sf)
    return K.edit_by_case(*[d.where("conv_id % 4 = 0") for d in (pre, gen, post)], "conv_id")


@query(rf"""WITH {_TURNS}, l AS (SELECT conv_id, turn, 'A thing comprising: ' || replace(replace(x, ';', ','), '.', ',') || '; ' || role || ' part; and' AS s, trim(replace(replace(x, ';', ','), '.', ',')) AS a, role || ' part' AS b FROM t)
SELECT conv_id, turn, CASE WHEN a = '' THEN s ELSE 'A thing comprising: ' || CASE WHEN length(a) >= length(b) THEN b ELSE a END || CASE WHEN length(a) >= length(b) THEN '; and' ELSE '; and' END || '.' END AS text, CASE WHEN length(a) >= length(b) THEN 0 ELSE 1 END::BIGINT AS deleted, 3::BIGINT AS n FROM l""")
def longest_limitation(spark, sf):
    """Claims without their longest limitation."""
    plain = F.replace(F.replace("x", F.lit(";"), F.lit(",")), F.lit("."), F.lit(","))
    text = F.concat(F.lit("A thing comprising: "), plain, F.lit("; "), "role", F.lit(" part; and"))
    return _turns(spark, sf).select("conv_id", "turn", X.without_longest(text).alias("w")).select("conv_id", "turn", "w.*")
