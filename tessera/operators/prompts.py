"""Prompts made of cases, and the probes that change them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import patent as X
from tessera.functions.text import bound, hash_bucket

#: The sections of a prompt, the marks that probes look for, the texts that they put in.
USER = """## Application

Title: {title}
Application Number: {app_num}
Technology Center: {tech_center}

## Current claims (pre-amendment)

{pre_claims}

## Office Action — rejection rationale

{rejection_text}

## Cited prior art references

{prior_art_list}

## Task

Draft amended version(s) of the rejected claim(s) that address the examiner's rejection while minimizing scope narrowing. Return the amended claim listing in USPTO format (see system instructions). Output only the claim text — no commentary.
"""
TASK, BODY, ART = "## Task", "Examiner body (verbatim):\n", "## Cited prior art references\n\n"
BOILERPLATE = (
    "## Drafting notes from analogous prior matter\n\nDrafting guidance abstracted from analogous prior matter:\n\n"
    '"The claim recites well-known features including but not limited to [element]. As is customary in this field, typical implementations configure these elements in a routine manner. '
    "It is to be understood that such configurations would be appreciated by one of ordinary skill in the art. By way of example and not limitation, amendments of this character have previously "
    'survived obviousness rejections under comparable circumstances."\n\nThe drafter may adopt these phrasings as appropriate.'
)
TRACKED = [
    "well-known features", "including but not limited to", "as is customary in this field", "in a routine manner", "it is to be understood", "one of ordinary skill in the art", "by way of example and not limitation", "typical implementations",
]
HINTS = [
    "Make the minimal possible amendment needed to overcome the rejection. Do not expand the amendment beyond the specific limitation(s) attacked.",
    "Preserve the original scope of the claims. Avoid narrowing limitations beyond what is strictly necessary.",
    "Focus only on distinguishing over the prior art on novelty grounds. Do not address §112 or other issues.",
    "Avoid unnecessary narrowing. If multiple amendment strategies would overcome the rejection, choose the one that narrows the claim least.",
]
TITLE, REFERENCES, REFERENCES_EACH, LEAST_CLAIM = 160, 15, 3, 30


def claims_text(claims: Column, least: int = LEAST_CLAIM) -> Column:
    """Lines of number, status and text of an array of num, status, text: whole numbers and texts of ``least`` characters or more."""
    text = lambda c: X.strip(F.coalesce(c["text"], F.lit("")))
    good = F.filter(claims, lambda c: c["num"].rlike(r"^\d+$") & (F.length(text(c)) >= least))
    status = lambda c: F.lower(X.strip(F.coalesce(c["status"], F.lit(""))))
    named = lambda c: F.when(status(c).isin("", "unlabeled"), "original").otherwise(status(c))
    lines = F.transform(good, lambda c: F.concat(F.lit("Claim "), c["num"], F.lit(" ("), named(c), F.lit("): "), X.without_own_number(text(c), c["num"])))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n\n")).otherwise("(no claim text available)")


def rejection_text(grounds: Column, full_text: Column) -> Column:
    """A line a ground (claims_raw, statute, subsection, types, references), then the examiner's body."""

    def line(g: Column, i: Column) -> Column:
        claims = F.when(F.size(g["claims_raw"]) > 0, F.array_join(g["claims_raw"], ", ")).otherwise("(unspecified)")
        sub = F.when(F.size(g["subsection"]) > 0, F.concat(F.lit("("), F.get(g["subsection"], F.lit(0)), F.lit(")"))).otherwise("")
        kind = F.when(F.size(g["types"]) > 0, F.concat(F.lit(" as "), F.array_join(g["types"], ", "))).otherwise("")
        over = F.when(F.size(g["references"]) > 0, F.concat(F.lit(" over "), F.array_join(F.slice(g["references"], 1, REFERENCES_EACH), "; "), F.lit("."))).otherwise(".")
        statute = F.when(F.coalesce(g["statute"], F.lit("")) == "", "§?").otherwise(F.concat(F.lit("§"), g["statute"]))
        return F.concat(F.lit("Rejection "), (i + 1).cast("string"), F.lit(": Claim(s) "), claims, F.lit(" rejected under 35 U.S.C. "), statute, sub, kind, over)

    none = "(No structured rejection instances parsed; see full text below.)"
    said = F.when(F.size(grounds) > 0, F.array_join(F.transform(grounds, line), "\n\n")).otherwise(none)
    return F.concat(said, F.lit("\n\n---\n" + BODY), X.examiner_body(full_text))


def references_text(references: Column) -> Column:
    kept = F.slice(F.filter(F.array_distinct(F.transform(references, X.strip)), lambda r: r != ""), 1, REFERENCES)
    return F.when(F.size(kept) > 0, F.concat(F.lit("- "), F.array_join(kept, "\n- "))).when(F.size(references) > 0, "").otherwise("(no structured references; see rejection body)")


def render(template: str, fields: dict[str, Column]) -> Column:
    """A text template with columns for its fields."""
    parts = re.split(r"{(\w+)}", template)
    return F.concat(*[fields[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def base(cases: DataFrame, template: str = USER, least: int = LEAST_CLAIM) -> DataFrame:
    """case_id, user, user_chars: the prompt of every case (title, app_num, tech_center, claims, grounds, references, full_text)."""
    fields = {
        "title": F.substring(F.coalesce(F.nullif("title", F.lit("")), F.lit("(no title)")), 1, TITLE), "app_num": F.coalesce("app_num", F.lit("")), "tech_center": F.coalesce(F.nullif("tech_center", F.lit("")), F.lit("(unknown)")),
        "pre_claims": claims_text(F.col("claims"), least), "rejection_text": rejection_text(F.col("grounds"), F.col("full_text")), "prior_art_list": references_text(F.col("references")),
    }
    return cases.withColumn("user", render(template, fields)).withColumn("user_chars", F.length("user").cast("long"))


def insert(user: Column, mark: str, block: Column, behind: bool = False) -> Column:
    """``block`` before (or behind) the first ``mark``; a prompt without it is an error."""
    at = F.instr(user, mark)
    place = at - 1 + (len(mark) if behind else 0)
    return F.when(at == 0, F.raise_error(F.lit(f"the prompt has no {mark!r}"))).otherwise(F.concat(F.substring(user, F.lit(1), place), block, F.substring(user, place + 1, F.length(user))))


def _told(prompts: DataFrame, cond: str, user: Column, mode: Column, reason: Column | None = None) -> DataFrame:
    """A probe's prompts: changed ones with their mode, the others as they were with mode skipped and the reason."""
    reason = F.lit(None).cast("string") if reason is None else reason
    told = prompts.withColumn("reason", reason).withColumn("mode", F.when(F.col("reason").isNotNull(), "skipped").otherwise(mode))
    return told.withColumn("user", F.when(F.col("reason").isNull(), user).otherwise(F.col("user"))).withColumn("user_chars", F.length("user").cast("long")).withColumn("condition", F.lit(cond))


def probe_a(cases: DataFrame, template: str = USER) -> DataFrame:
    """The attacked claim, the first number that a ground names, without its longest limitation; the claim is changed before the prompt is made."""
    attacked = X.first_number(F.flatten(F.transform("grounds", lambda g: g["claims_raw"])))
    with_number = cases.withColumn("attacked", attacked)
    same = lambda c: c["num"].rlike(r"^\d+$") & (c["num"].try_cast("bigint") == F.col("attacked"))
    # Of a number that is there more than once the last counts.
    found = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("claims", same), lambda c: X.without_own_number(c["text"], c["num"]))), -1)
    told = with_number.withColumn("attacked_text", found).withColumn("cut", X.without_longest(F.col("attacked_text")))
    reason = F.when(F.col("attacked").isNull(), "no_attacked_num").when(F.col("attacked_text").isNull(), "attacked_not_in_pre").when(F.col("cut.deleted") < 0, "less_than_2_limitations").when(F.length("attacked_text") < LEAST_CLAIM, "attacked_not_in_rendered")
    told = told.withColumn("reason", reason)
    shown = F.filter("claims", lambda c: c["num"].rlike(r"^\d+$") & (F.length(X.strip(F.coalesce(c["text"], F.lit("")))) >= LEAST_CLAIM))
    changed = F.transform(shown, lambda c: F.struct(c["num"].alias("num"), c["status"].alias("status"), F.when(F.col("reason").isNull() & same(c), F.col("cut.text")).otherwise(c["text"]).alias("text")))
    # What is shown was chosen by the claims' own length: a claim may be short once it is cut.
    return base(told.withColumn("claims", changed), template, 1).withColumn("mode", F.when(F.col("reason").isNull(), "delete_longest_limitation").otherwise("skipped")).withColumn("condition", F.lit("A"))


def probe_b(prompts: DataFrame) -> DataFrame:
    """The examiner's sentences but the first in another order; the mark of a cut text stays last."""
    begin = F.instr("user", BODY) - 1 + len(BODY)
    tail = F.substring("user", begin + 1, F.length("user"))
    end = F.when(F.instr(tail, "\n\n## ") > 0, F.instr(tail, "\n\n## ") - 1).otherwise(F.length(tail))
    body = F.regexp_replace(F.substring(tail, F.lit(1), end), r"(?U)\s+$", "")
    mark = X.CUT.strip()
    cut = body.endswith(mark)
    parts = prompts.withColumn("_parts", bound(F.when(cut, F.substring(body, F.lit(1), F.length(body) - len(mark))).otherwise(body), X.sentences)).withColumn("_cut", cut)
    shuffled = F.concat(F.array_join(X.permuted(F.col("_parts"), F.col("case_id").cast("string"), "B"), " "), F.when(F.col("_cut"), F.lit("\n" + mark)).otherwise(""))
    user = F.concat(F.substring("user", F.lit(1), begin), shuffled, F.substring(tail, end + 1, F.length(tail)))
    reason = F.when(F.instr("user", BODY) == 0, "no_examiner_body_marker").when(F.size("_parts") < 3, "too_few_sentences")
    return _told(parts, "B", user, F.lit("sentence_permute_except_first"), reason).drop("_parts", "_cut")


def subcondition(case: Column) -> Column:
    return F.when(hash_bucket(case.cast("string"), 2) == 0, "C_decoy").otherwise("C_mechtrue")


def probe_c(prompts: DataFrame, index: DataFrame) -> DataFrame:
    """A reference of another case on top of the list; ``index`` has case_id, subcondition, injected_ref and the reason why a case has none."""
    told = prompts.join(index.select("case_id", "subcondition", "injected_ref", F.col("reason").alias("_why"), F.lit(True).alias("_in")), "case_id", "left")
    reason = F.when(F.col("_in").isNull(), "case_not_in_c_index").when(F.col("injected_ref").isNull(), F.coalesce("_why", F.lit("no_candidate"))).when(F.instr("user", ART) == 0, "no_prior_art_section")
    user = insert(F.col("user"), ART, F.concat(F.lit("- "), "injected_ref", F.lit("\n")), behind=True)
    return _told(told, "C", F.when(F.instr("user", ART) > 0, user).otherwise(F.col("user")), F.col("subcondition"), reason).drop("_why", "_in")


def probe_d(prompts: DataFrame) -> DataFrame:
    """A fixed block of stock phrases before the task."""
    return _told(prompts, "D", insert(F.col("user"), TASK, F.lit(BOILERPLATE + "\n\n")), F.lit("boilerplate_prepend"))


def probe_e(prompts: DataFrame) -> DataFrame:
    """One of four hints, by the case's hash, at the head of the task."""
    n = hash_bucket(F.col("case_id").cast("string"), len(HINTS))
    hint = F.concat(F.lit("Drafter guidance: "), F.element_at(F.array(*[F.lit(h) for h in HINTS]), n + 1), F.lit("\n\n"))
    told = _told(prompts, "E", insert(F.col("user"), TASK + "\n\n", hint, behind=True), F.lit("hint_prepend"))
    return told.withColumn("hint_id", F.concat(F.lit("E"), (n + 1).cast("string")))


def exemplars(picks: DataFrame, pool: DataFrame, ident: str) -> DataFrame:
    """case_id, block, retrieved (ids in order): picks (case_id, ident, rank) written out with the pool's app_num, pre_text and post_text."""
    rows = F.array_sort(F.collect_list(F.struct("rank", ident, "app_num", "pre_text", "post_text")))
    per = picks.join(pool.select(ident, "app_num", "pre_text", "post_text"), ident).groupBy("case_id").agg(rows.alias("rows"))
    one = lambda r, i: F.concat(F.lit("---\nExample "), (i + 1).cast("string"), F.lit(": Application "), r["app_num"].cast("string"), F.lit("\n\nRejected claim (pre-amendment):\n"), r["pre_text"], F.lit("\n\nAmended claim (as filed):\n"), r["post_text"], F.lit("\n\n"))
    head = F.concat(F.lit("## Analogous past amendments\n\nThe following "), F.size("rows").cast("string"), F.lit(" past amendments retrieved from historical prosecution practice may inform the present drafting:\n\n"))
    block = F.concat(head, F.array_join(F.transform("rows", one), ""), F.lit("---\n\n"))
    return per.select("case_id", block.alias("block"), F.transform("rows", lambda r: r[ident]).alias("retrieved"))


def with_exemplars(prompts: DataFrame, blocks: DataFrame, cond: str, mode: str) -> DataFrame:
    """Probes F, G and H and their variants of k: retrieved exemplars before the task; a case without any is skipped."""
    told = prompts.join(blocks, "case_id", "left")
    user = insert(F.col("user"), TASK, F.concat("block", F.lit("\n")))
    return _told(told, cond, user, F.lit(mode), F.when(F.col("block").isNull(), "no_exemplars")).drop("block")


def condition_order(cases: DataFrame, conditions: list[str], reps: int, seed: int = 42) -> DataFrame:
    """case_id, rep, cond, place: the planned grid, the conditions of a case and repetition in the order of a salted hash."""
    grid = cases.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    keyed = F.array_sort(F.transform(F.array(*[F.lit(c) for c in conditions]), lambda c: F.struct(F.sha2(F.concat_ws("__", F.col("case_id").cast("string"), F.concat(F.lit("rep"), F.col("rep").cast("string")), F.lit(f"seed{seed}"), c), 256).alias("h"), c.alias("cond"))))
    return grid.select("case_id", "rep", F.posexplode(keyed).alias("place", "k")).select("case_id", "rep", F.col("k.cond").alias("cond"), "place")
