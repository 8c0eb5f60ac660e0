"""Column functions over claims and office actions: headers, ranges, limitations, sentences, rejections.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound

#: Headers of claims inside a text, with number or range and status.
INLINE_HEADERS = [
    r"(?s)^\s*(\d+(?:\s*-\s*\d+)?)\s*[.\s]\s*\(\s*([^)\n]+?)\s*\)\s*",
    r"(?is)^\s*\[\s*Claim\s+(\d+(?:\s*-\s*\d+)?)\s*\]\s*(?:\(\s*([^)\n]+?)\s*\))?\s*",
    r"(?is)^\s*(?:\d+\s+)?(?:LISTING\s+OF\s+THE\s+CLAIMS[:\s]+)?Claim\s+(\d+(?:\s*-\s*\d+)?)\s*\(\s*([^)\n]+?)\s*\)\s*:?\s*",
]
BRACKETED = r"\[\[[^\[\]]{1,200}\]\]"
PREAMBLE = r"(?i)\b(comprising|including|having|consisting of|consisting essentially of)\b[:\s]+"
ABBREVIATIONS = r"(?i)\b(U\.S\.C|U\.S|Fed|Dr|Mr|Mrs|Ms|Prof|col|cols|Fig|Figs|No|Nos|pp|p|vs|e\.g|i\.e)\."
REJECTION_VERB = r"(?i)\brejected\b|\bunpatentable\b|\banticipated\b|\bobvious(ness)?\b"
REJECTION_SENTENCE = (
    r"(?i)Claim(?:s)?\s+([0-9][0-9,\s\-–and]{0,80})\s+(?:is|are)\s+rejected\s+under\s+35\s*U\.?\s*S\.?\s*C\.?\s*(?:§)?\s*(\d+)\s*(?:\(([a-z0-9]+)\))?\s*(?:as\s+(?:being\s+)?([^.]{3,400}))?"
)
PRIOR_ART = r"(?:over|by)\s+([A-Z][a-zA-Z][a-zA-Z\-\.]{1,40}(?:\s+et\s+al\.?)?(?:\s*\([0-9,]{5,20}\))?)"
FOOTERS = [
    r"Any inquiry concerning (?:this|the) communication", r"The prior art made of record and not relied upon", r"\bConclusion\b", r"Information regarding the status of an application", r"Commissioner of Patents and Trademarks",
]
REJECTION_TYPES = ("anticipated", "rejected", "obvious", "being", "unpatentable", "indefinite", "ineligible", "rendered", "lack", "fail", "taught", "disclos")
NO_REFERENCE = [r"\d{3}[-.\s]\d{3}[-.\s]\d{4}", r"(?i)\bfax\b", r"\bPAIR\b", r"(?i)Information\s+regarding\s+the\s+status", r"^\s*\d+[-.\s]"]
CUT = "\n[... truncated ...]"


def _text(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def strip(t: Column) -> Column:
    """Without white space around it, of any kind."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def plain_ocr(raw: Column) -> Column:
    """XML without the wrappers that give a recognition's confidence; what they hold stays."""
    legacy = F.regexp_replace(_text(raw), r"<confidence[^>]*>([^<]*)</confidence>", "$1")
    return F.regexp_replace(legacy, r"<pat:OCRConfidenceData[^>]*>([^<]*)</pat:OCRConfidenceData>", "$1")


def inline_header(text: Column) -> Column:
    """num (a number or range, null without a header), status (null if it has none) and rest: by the first form that fits."""
    t = _text(text)
    form = lambda p: F.struct(F.regexp_replace(F.regexp_extract(t, p, 1), " ", "").alias("num"), F.nullif(F.regexp_extract(t, p, 2), F.lit("")).alias("status"), strip(F.regexp_replace(t, p, "")).alias("rest"))
    none = F.struct(F.lit(None).cast("string").alias("num"), F.lit(None).cast("string").alias("status"), t.alias("rest"))
    out = none
    for p in reversed(INLINE_HEADERS):
        p = p.replace("(?", "(?U", 1)
        out = F.when(t.rlike(p), form(p)).otherwise(out)
    return out


def expand_range(num: Column, most: int = 200) -> Column:
    """'1-10' as its numbers, '5' as itself; none for falling ranges, ranges wider than ``most`` and what is no number."""
    a, b = F.split(num, "-").getItem(0).try_cast("bigint"), F.get(F.split(num, "-"), F.lit(1)).try_cast("bigint")
    wide, good = num.contains("-"), (b >= a) & (b - a <= most)
    none = F.expr("CAST(array() AS array<bigint>)")
    return F.when(wide & good, F.sequence(a, F.when(good, b).otherwise(a))).when(~wide & a.isNotNull(), F.array(a)).otherwise(none)


def bracket_deletions(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(BRACKETED), F.lit(0))


def first_number(raws: Column) -> Column:
    """The first whole number in any of the texts."""
    found = F.filter(F.transform(raws, lambda r: F.regexp_extract(_text(r), r"(?U)\b(\d+)\b", 1)), lambda x: x != "")
    return F.get(found, F.lit(0)).try_cast("bigint")


def without_own_number(text: Column, num: Column) -> Column:
    """A claim's text without its own number before it, once."""
    return strip(F.regexp_replace(_text(text), F.concat(F.lit(r"(?U)^\s*"), num, F.lit(r"\s*[.\s]+")), F.lit("")))


def limitations(text: Column) -> Column:
    """preamble, up to the word that opens the list, and the list's parts without their last "and" or full stop; no parts without such a word."""
    t = strip(_text(text))
    at = F.regexp_instr(t, F.lit("(?U)" + PREAMBLE))
    word = F.regexp_extract(t, "(?U)" + PREAMBLE, 0)
    body = F.substring(t, at + F.length(word), F.length(t))
    parts = F.filter(F.transform(F.split(body, r"(?U);\s*"), strip), lambda p: p != "")
    parts = F.transform(parts, lambda p: strip(F.regexp_replace(F.regexp_replace(p, r"(?U)\s+and\s*$", ""), r"\.+$", "")))
    none = F.expr("CAST(array() AS array<string>)")
    return F.struct(F.when(at > 0, F.regexp_replace(F.substring(t, F.lit(1), at + F.length(word) - 1), r"(?U)\s+$", "")).otherwise(t).alias("preamble"), F.when(at > 0, F.filter(parts, lambda p: p != "")).otherwise(none).alias("parts"))


def without_longest(text: Column) -> Column:
    """text without its longest limitation (the first of several), deleted (its place, -1 if there are fewer than two) and n."""

    def cut(s: Column) -> Column:
        sizes = F.transform(s["parts"], lambda p: F.length(p))
        at = F.array_position(sizes, F.array_max(sizes)) - 1
        left = F.array_join(F.filter(s["parts"], lambda p, i: i != at), "; ")
        return F.when(F.size(s["parts"]) >= 2, F.struct(F.concat(s["preamble"], F.lit(" "), left, F.lit(".")).alias("text"), at.cast("long").alias("deleted"), F.size(s["parts"]).cast("long").alias("n"))).otherwise(
            F.struct(_text(text).alias("text"), F.lit(-1).cast("long").alias("deleted"), F.size(s["parts"]).cast("long").alias("n"))
        )

    return bound(limitations(text), cut)


def sentences(text: Column, least: int = 15) -> Column:
    """Sentences of ``least`` characters or more; full stops of abbreviations end none."""
    mark = "\u0001"
    safe = F.regexp_replace(strip(_text(text)), "(?U)" + ABBREVIATIONS, f"$1{mark}")
    for _ in range(2):  # full stops inside an abbreviation, as in U.S.C
        safe = F.regexp_replace(safe, rf"(?i)\b(U|U{mark}S|e|i)\.(?=[A-Za-z]+{mark})", f"$1{mark}")
    parts = F.transform(F.split(safe, r"(?U)(?<=[.!?])\s+"), lambda s: strip(F.replace(s, F.lit(mark), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s) >= least)


def permuted(parts: Column, case: Column, tag: str) -> Column:
    """The first part, and the others in the order of a salted hash."""
    keyed = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s, i: F.struct(F.sha2(F.concat_ws("::", case, F.lit(tag), i.cast("string")), 256).alias("h"), i.alias("i"), s.alias("s")))
    return F.concat(F.slice(parts, 1, 1), F.transform(F.array_sort(keyed), lambda x: x["s"]))


def rejection_paragraphs(text: Column, claim: Column, most: int = 1500) -> Column:
    """Paragraphs that reject and mention the claim, else that reject, else the text's beginning; ``most`` characters of it."""
    t = _text(text)
    verbs = F.filter(F.split(t, r"(?U)\n\s*\n"), lambda p: p.rlike("(?U)" + REJECTION_VERB))
    mention = F.concat(F.lit(r"(?iU)\bclaims?\b[^.\n]{0,40}\b"), claim.cast("string"), F.lit(r"\b"))
    both = F.when(claim.isNull(), verbs).otherwise(F.filter(verbs, lambda p: F.coalesce(F.regexp_like(p, mention), F.lit(False))))
    joined = lambda a: F.array_join(F.transform(a, strip), "\n")
    return F.substring(F.when(F.size(both) > 0, joined(both)).when(F.size(verbs) > 0, joined(verbs)).otherwise(t), 1, most)


def examiner_body(text: Column, most: int = 8000, least: int = 400) -> Column:
    """The text up to the earliest footer, of which each counts by its first hit, if that is behind ``least`` characters; then cut at ``most``."""
    t = F.regexp_replace(strip(_text(text)), r"\n{3,}", "\n\n")
    hits = [F.regexp_instr(t, F.lit("(?U)" + p)) for p in FOOTERS]
    end = F.least(F.length(t), *[F.when(h > least + 1, h - 1).otherwise(F.length(t)) for h in hits])
    body = F.when(end < F.length(t), F.regexp_replace(F.substring(t, F.lit(1), end), r"(?U)\s+$", "")).otherwise(t)
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit(CUT))).otherwise(body)


def rejection_sentences(text: Column) -> Column:
    """claims, statute, subsection, clause (300 characters) and references of every rejection sentence; a reference counts where it stands first."""
    t, p = _text(text), F.lit("(?U)" + REJECTION_SENTENCE)
    group = lambda k: F.regexp_extract_all(t, p, F.lit(k))
    found = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"), group(4).alias("d"))

    def told(rows: Column) -> Column:
        refs = F.transform(rows, lambda r: F.array_distinct(F.transform(F.regexp_extract_all(strip(_text(r["d"])), F.lit("(?U)" + PRIOR_ART), F.lit(1)), strip)))
        return bound(refs, lambda own: F.transform(rows, lambda r, i: F.struct(strip(r["a"]).alias("claims"), r["b"].alias("statute"), _text(r["c"]).alias("subsection"), F.substring(strip(_text(r["d"])), 1, 300).alias("clause"), F.array_except(F.get(own, i), F.flatten(F.slice(own, F.lit(1), i))).alias("references"))))

    return bound(found, told)


def allowed_type(types: Column) -> Column:
    """Whether any text names a ground of rejection."""
    return F.coalesce(F.exists(types, lambda t: F.lower(t).rlike("|".join(REJECTION_TYPES))), F.lit(False))


def clean_references(refs: Column, most: int = 200) -> Column:
    """References with a name in them, without telephone numbers, notices and overlong texts."""
    good = lambda r: (F.length(r) <= most) & (r != "") & ~r.startswith("Re:") & ~r.startswith("[") & r.rlike("[A-Z][a-z]{2,}")
    out = F.filter(F.transform(F.coalesce(refs, F.expr("CAST(array() AS array<string>)")), strip), good)
    for p in NO_REFERENCE:
        out = F.filter(out, lambda r: ~r.rlike("(?U)" + p))  # noqa: B023
    return out
