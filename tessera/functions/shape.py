"""Counters and shapes of texts as columns: lines, paragraphs, repetition, markup, quotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound, ngrams

#: What is counted in a response; the markup counters alone mind the case.
COUNTERS = {
    "hdr_claim_N_paren_status": r"^\s*Claim\s+\d+\s*\([^)]+\)\s*[:.]?",
    "hdr_N_dot": r"^\s*\d+\s*\.\s",
    "hdr_N_paren_status": r"^\s*\d+\s*\([^)]+\)\s*[:.]?",
    "hdr_claim_N_only": r"^\s*Claim\s+\d+\s*[:.]?\s",
    "status_currently_amended": r"\(currently amended\)",
    "status_original": r"\(original\)",
    "status_cancelled": r"\(cancel?led\)",
    "status_new": r"\(new\)",
    "status_previously": r"\(previously presented\)",
    "status_withdrawn": r"\(withdrawn\)",
    "markup_bracket_delete": r"\[\[[^\]]+\]\]",
    "markup_underline": r"__[^_]+__",
    "markup_strikethrough_alt": r"~~[^~]+~~",
    "markup_single_underscore": r"(?<!_)_[A-Za-z][^_]*_(?!_)",
    "preamble_here_are": r"^\s*(here are|below are|the following)",
    "preamble_md_heading": r"^#+\s",
    "preamble_backtick_fence": r"^```",
    "commentary_explanation": r"(explanation|reasoning|note:|comment:)",
    "body_comprising": r"\bcomprising\b",
    "body_wherein": r"\bwherein\b",
    "body_said": r"\bsaid\b",
    "body_configured_to": r"\bconfigured to\b",
}
#: Quotations of claims in an opinion, and application numbers.
QUOTES = {
    "long_dq": r'"[^"]{60,1200}"',
    "claim_recites": r"[Cc]laim\s+\d+[a-z]?\s*(?:recites?|states?|provides?|reads?|requires?)[^.]{20,500}\.",
    "as_claimed": r"(?:as\s+claimed|the\s+claimed)[^.]{10,300}\.",
}
APPLICATION = r"\b(\d{2})[\s/,]?(\d{3})[\s/,]?(\d{3})\b"


def _text(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def _long(c: Column) -> Column:
    return c.cast("long")


def _strip(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def _round(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def counters(text: Column, names: list[str] | None = None) -> dict[str, Column]:
    """How often each pattern stands in the text; ``^`` is the start of a line."""
    flags = lambda k: "(?mdU)" if k.startswith("markup") else "(?mdiuU)"
    return {k: _long(F.regexp_count(_text(text), F.lit(flags(k) + COUNTERS[k]))) for k in names or COUNTERS}


def ends_shape(text: Column) -> dict[str, Column]:
    """Lines that are not blank, characters, and what the first and last of those lines look like."""
    lines = F.filter(F.split(_text(text), "\n"), lambda x: _strip(x) != "")
    head = "(?diuU)" + COUNTERS["hdr_claim_N_paren_status"]
    first, last = F.get(lines, F.lit(0)), F.element_at(F.concat(F.array(F.lit("")), lines), -1)
    is_head = lambda x: _long(F.coalesce(x, F.lit("")).rlike(head).cast("int"))
    body = F.coalesce(first, F.lit("")).rlike(r"(?iuU)\b(comprising|wherein|said|configured)\b")
    return {"n_nonblank_lines": _long(F.size(lines)), "total_chars": _long(F.length(_text(text))), "first_line_is_claim_hdr": is_head(first), "last_line_is_claim_hdr": is_head(last), "first_line_has_body": _long(body.cast("int"))}


def line_shape(text: Column) -> Column:
    """Lines, blank, numbered, bulleted and header-like ones; mean, greatest and 95th percentile length of those not blank."""

    def shape(lines: Column) -> Column:
        n = lambda f: _long(F.size(F.filter(lines, f)))
        full = F.filter(lines, lambda x: _strip(x) != "")
        sizes = F.array_sort(F.transform(full, lambda x: F.length(x)))
        sizes = F.when(F.size(sizes) > 0, sizes).otherwise(F.array(F.lit(0)))
        header = lambda x: (_strip(x) != "") & (_strip(x).endswith(":") | ((F.upper(x) == x) & (F.lower(x) != x) & (F.length(_strip(x)) > 3)))
        return F.struct(
            _long(F.size(lines)).alias("n_lines"), _long(F.size(full)).alias("non_blank"), n(lambda x: _strip(x) == "").alias("n_blank"),
            n(lambda x: x.rlike(r"(?U)^\s*\d+[.)\]]\s")).alias("n_numbered"), n(lambda x: x.rlike(r"(?U)^\s*[-*\u2022]\s")).alias("n_bullet"), n(header).alias("n_header_like"),
            _round(F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(sizes), 1).alias("len_mean"), _long(F.array_max(sizes)).alias("len_max"),
            _long(F.element_at(sizes, F.floor(F.lit(0.95) * (F.size(sizes) - 1)).cast("int") + 1)).alias("len_p95"),
        )

    return bound(F.split(_text(text), "\n"), shape)


def paragraph_shape(text: Column) -> Column:
    """Paragraphs between blank lines, their mean and greatest length; zeros if there is none."""

    def shape(sizes: Column) -> Column:
        mean = F.try_divide(F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x), F.size(sizes))
        return F.struct(_long(F.size(sizes)).alias("paragraphs"), _round(F.coalesce(mean, F.lit(0.0)), 1).alias("para_chars_mean"), _long(F.coalesce(F.array_max(sizes), F.lit(0))).alias("para_chars_max"))

    parts = F.filter(F.transform(F.split(_text(text), r"(?U)\n\s*\n"), _strip), lambda x: x != "")
    return bound(F.transform(parts, lambda x: F.length(x)), shape)


def _top_counts(values: Column, k: int) -> Column:
    """The k greatest counts of equal values, from where runs of equal values end in sorted order."""

    def counts(v: Column) -> Column:
        n = F.size(v)
        ends = F.filter(F.transform(v, lambda x, i: F.when((i == n - 1) | ~x.eqNullSafe(F.get(v, i + 1)), i + 1)), lambda x: x.isNotNull())
        return bound(ends, lambda e: F.slice(F.sort_array(F.zip_with(e, F.slice(F.concat(F.array(F.lit(0)), e), 1, F.size(e)), lambda x, y: _long(x - y)), asc=False), 1, k))

    return bound(F.sort_array(values), counts)


def repetition(text: Column, words: Column, k: int = 5) -> Column:
    """Shares of distinct words, repeated lines and distinct 5-grams (1 for fewer than five words), and how often the most frequent lines and 5-grams stand."""
    lines = F.filter(F.transform(F.split(_text(text), "\n"), _strip), lambda x: x != "")
    share = lambda v: F.try_divide(F.size(F.array_distinct(v)), F.size(v))

    def all_of(s: Column) -> Column:
        return F.struct(
            _long(F.size(s["w"])).alias("word_count"), _round(F.coalesce(share(s["w"]), F.lit(0.0)), 3).alias("unique_word_ratio"),
            _round(F.coalesce(1.0 - share(s["l"]), F.lit(0.0)), 3).alias("line_dup_ratio"), _top_counts(s["l"], k).alias("top_lines"),
            _round(F.coalesce(share(s["g"]), F.lit(1.0)), 3).alias("fivegram_diversity"), _top_counts(s["g"], k).alias("top_grams"),
        )

    return bound(bound(F.struct(words.alias("w"), lines.alias("l")), lambda s: F.struct(s["w"].alias("w"), s["l"].alias("l"), F.transform(ngrams(s["w"], 5), lambda g: F.xxhash64(g)).alias("g"))), all_of)


def application_numbers(text: Column) -> Column:
    """Eight-digit application numbers that a text mentions, as a sorted set of digits."""
    found = F.regexp_extract_all(_text(text), F.lit("(?U)" + APPLICATION), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.right(F.regexp_replace(x, r"\D", ""), F.lit(8)))))


def reference_kind(ref: Column) -> Column:
    """with_number, name_only or suspicious."""
    numbered = ref.rlike(r"\(?\s*([\d,]{5,10})\s*\)?") & ref.rlike(r"\d")
    return F.when(numbered, "with_number").when(_strip(ref).rlike(r"^[A-Z][a-zA-Z\-. ]{1,50}$"), "name_only").otherwise("suspicious")
