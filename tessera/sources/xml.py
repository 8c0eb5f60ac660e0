"""Claims and office actions in XML, alone or in archives.

A worker turns a document into flat records (a text of a claim, a paragraph of
an action), as mixed content in document order is nothing that the JVM's XML
functions give.  Headers, folding, ranges and filters are column functions and
windows over those records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import patent as X
from tessera.sources.readers import document_kind

#: Name spaces in the order in which they are searched, closing paragraphs, headings.
SPACES = ["urn:us:gov:doc:uspto:patent", "http://www.wipo.int/standards/XMLSchema/ST96/Patent", "http://www.wipo.int/standards/XMLSchema/ST96/Common"]
COMMON = "urn:us:gov:doc:uspto:common"
CLOSING = ["conclusion_heading", "OacsClose", "examiner_contact", "conclusion", "signature", "signature_block"]
HEADINGS = {"detailed_action": "DETAILED ACTION", "USC_101_heading": "35 USC § 101", "USC_102_heading": "35 USC § 102", "USC_103_heading": "35 USC § 103", "USC_112_heading": "35 USC § 112", "conclusion_heading": "Conclusion"}
_PART = "struct<claim: int, part: int, num: string, status: string, text: string, deletions: array<string>, additions: array<string>, first: bigint, last: bigint>"
_PARAGRAPH = "struct<pos: int, number: string, body: string, fields: map<string, array<string>>>"


def text_of(element: ElementTree.Element) -> str:
    """All text below an element, white space single.

    An element's own text is put in order before its parent's, so that borders
    between elements are no spaces.
    """
    own = [element.text or "", *(s for child in element for s in (text_of(child), child.tail or ""))]
    return re.sub(r"\s+", " ", "".join(own)).strip()


def _named(element: ElementTree.Element, name: str, below) -> list[ElementTree.Element]:
    return [x for space in SPACES for x in below(element, f"{{{space}}}{name}")]


def _all(element: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    return list(element.iter(tag))


def _value(element: ElementTree.Element, name: str, missing: str) -> str:
    found = _named(element, name, ElementTree.Element.findall)
    return (found[0].text or "").strip() if found else missing


def claim_parts(root: ElementTree.Element, kind: str) -> list[dict]:
    """A record a text of a claim, and one a range of claims that are only counted."""
    rows: list[dict] = []

    def add(claim: int, part: int, **more) -> None:
        rows.append({"claim": claim, "part": part, "num": "", "status": "", "text": "", "deletions": [], "additions": [], "first": None, "last": None} | more)

    if kind == "dtd_legacy":
        for k, claim in enumerate(root.iter("claim")):
            for j, text in enumerate(map(text_of, claim.findall("claim-text"))):
                add(k, j, num=(claim.get("num") or "").replace("UNKNOWN", ""), status=claim.get("claim-type") or "", text=text)
        return rows
    claims = _named(root, "Claim", _all)
    for k, claim in enumerate(claims):
        for j, part in enumerate(_named(claim, "ClaimText", _all)):
            marks = {c: [text_of(x) for tag in tags for x in _named(part, tag, _all)] for c, tags in (("deletions", ["DeletedText"]), ("additions", ["Ins", "U"]))}
            add(k, j, num=_value(claim, "ClaimNumber", ""), status=_value(claim, "ClaimStatusCategory", ""), text=text_of(part), **marks)
    for k, implicit in enumerate(_named(root, "ImplicitClaim", _all), len(claims)):
        for numbers in _named(implicit, "ClaimNumberRange", ElementTree.Element.findall)[:1]:
            ends = [_value(numbers, name, "") for name in ("BeginRangeNumber", "EndRangeNumber")]
            if all(e.isdigit() for e in ends) and int(ends[0]) <= int(ends[1]):
                add(k, 0, status=_value(implicit, "ClaimStatusCategory", "") or "unlabeled", first=int(ends[0]), last=int(ends[1]))
    return rows


def _parsed(documents: DataFrame, key: str, schema: str, read) -> DataFrame:
    """key, kind, and of every document what ``read`` makes of its root, or the error."""
    kind_of_key = documents.schema[key].dataType.simpleString()
    text = X.plain_ocr(F.decode("content", "UTF-8"))
    rows = documents.where("content IS NOT NULL").select(key, text.alias("xml")).withColumn("kind", document_kind(F.encode("xml", "UTF-8")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for xml, kind in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    out.append((read(ElementTree.fromstring(xml), kind), None))
                except ElementTree.ParseError as broken:
                    out.append((None, f"{type(broken).__name__}: {broken}"))
            kinds = pa.RecordBatch.from_pylist([], schema=_arrow(schema)).schema
            cols = [pa.array([None if o[0] is None else o[0][f.name] for o in out], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols, pa.array([o[1] for o in out], pa.string())], [key, "kind", *kinds.names, "error"])

    return rows.mapInArrow(run, f"{key} {kind_of_key}, kind string, {schema}, error string")


def _arrow(schema: str) -> pa.Schema:
    texts, number = pa.list_(pa.string()), pa.int64()
    part = pa.list_(pa.struct([("claim", pa.int32()), ("part", pa.int32()), ("num", pa.string()), ("status", pa.string()), ("text", pa.string()), ("deletions", texts), ("additions", texts), ("first", number), ("last", number)]))
    paragraph = pa.list_(pa.struct([("pos", pa.int32()), ("number", pa.string()), ("body", pa.string()), ("fields", pa.map_(pa.string(), texts))]))
    return pa.schema([("parts", part)]) if schema.startswith("parts") else pa.schema([("paragraphs", paragraph), ("full_text", pa.string())])


def claim_documents(documents: DataFrame, key: str) -> DataFrame:
    """key, kind, parts, error of XML ``documents`` (key, content); other kinds have no parts."""
    return _parsed(documents, key, f"parts array<{_PART}>", lambda root, kind: {"parts": claim_parts(root, kind) if kind in ("dtd_legacy", "ns_claims") else []})


def claims(parsed: DataFrame, key: str) -> DataFrame:
    """key, pos, num, status, text, deletions, additions, bracket_deletions: a row a claim of claim_documents().

    A claim without a number whose texts open with several headers is several
    claims: a text without a header goes to the claim before it.  One without a
    number and with one header takes number and status from it.  Ranges are a
    claim a number, without their text.
    """
    parts = parsed.select(key, "kind", F.inline("parts"))
    ranges = parts.where("first IS NOT NULL").select(key, "claim", "part", F.explode(F.sequence("first", "last")).alias("n"), "status")
    ranges = ranges.select(key, "claim", "part", F.col("n").cast("string").alias("num"), "status", F.concat(F.lit("(implicit, "), "status", F.lit(") claim "), F.col("n").cast("string")).alias("text"), *[F.expr("CAST(array() AS array<string>)").alias(c) for c in ("deletions", "additions")])
    own, order = W.partitionBy(key, "claim"), W.partitionBy(key, "claim").orderBy("part")
    texts = parts.where("first IS NULL AND (text <> '' OR size(deletions) > 0)").withColumn("head", F.when(F.col("num") == "", X.inline_header(F.col("text"))))
    headed = F.col("head.num").isNotNull().cast("int")
    texts = texts.withColumn("heads", F.sum(headed).over(own)).withColumn("several", (F.col("num") == "") & (F.col("heads") > 1))
    # Texts up to the next header are one record: the running number of headers names it.
    texts = texts.withColumn("record", F.when(F.col("several"), F.sum(headed).over(order.rowsBetween(W.unboundedPreceding, 0))).otherwise(1)).where("record > 0")
    rows = F.array_sort(F.collect_list(F.struct("part", "text", "deletions", "additions")))
    whole = texts.groupBy(key, "kind", "claim", "num", "status", "several", "record").agg(rows.alias("rows"))
    whole = whole.select(key, "kind", "claim", "num", "status", "several", F.get("rows", F.lit(0))["part"].alias("part"), X.strip(F.array_join(F.transform(F.filter("rows", lambda r: r["text"] != ""), lambda r: r["text"]), " ")).alias("text"), *[F.flatten(F.transform("rows", lambda r: r[c])).alias(c) for c in ("deletions", "additions")])  # noqa: B023
    whole = whole.withColumn("head", F.when(F.col("num") == "", X.inline_header(F.col("text")))).withColumn("nums", F.when(F.col("head.num").isNotNull(), X.expand_range(F.col("head.num"))))
    whole = whole.where("NOT several OR size(nums) > 0")
    spread = whole.withColumn("n", F.explode_outer("nums")).withColumn("wide", F.coalesce(F.size("nums") > 1, F.lit(False)))
    status = F.coalesce(F.col("head.status"), F.when(F.col("several") & (F.col("kind") == "ns_claims"), F.lit(None)).otherwise(F.nullif("status", F.lit(""))), F.lit("unlabeled"))
    empty = F.expr("CAST(array() AS array<string>)")
    plain = spread.withColumn("said", status).select(
        key, "claim", "part", F.coalesce(F.col("n").cast("string"), "num").alias("num"), F.col("said").alias("status"),
        F.when(F.col("wide"), F.concat(F.lit("(range "), F.col("head.num"), F.lit(", "), "said", F.lit(") claim "), F.col("n").cast("string"))).otherwise(F.col("text")).alias("text"),
        *[F.when(F.col("wide"), empty).otherwise(F.col(c)).alias(c) for c in ("deletions", "additions")],
    )
    both = plain.unionByName(ranges)
    place = F.row_number().over(W.partitionBy(key).orderBy("claim", "part", F.length("num"), "num")) - 1
    return both.select(key, place.alias("pos"), "num", "status", "text", "deletions", "additions", X.bracket_deletions(F.col("text")).alias("bracket_deletions"))


def office_actions(documents: DataFrame, key: str) -> DataFrame:
    """key, paragraphs, full_text, error of office actions in XML (key, content)."""
    tag = lambda name: f"{{{COMMON}}}{name}"

    def read(root: ElementTree.Element, kind: str) -> dict:
        paragraphs = []
        for pos, p in enumerate(root.iter(tag("FormParagraph"))):
            fields: dict[str, list[str]] = {}
            for f in p.iter(tag("DataField")):
                if (number := f.get(tag("dataFieldNumber")) or f.get("dataFieldNumber")) and (said := text_of(f)):
                    fields.setdefault(number, []).append(said)
            number = p.find(tag("FormParagraphNumber"))
            body = " ".join(t for t in map(text_of, p.iter(tag("P"))) if t)
            paragraphs.append({"pos": pos, "number": "" if number is None else (number.text or "").strip(), "body": body, "fields": list(fields.items())})
        return {"paragraphs": paragraphs, "full_text": "\n".join(t for t in map(text_of, root.iter(tag("P"))) if t)}

    return _parsed(documents, key, f"paragraphs array<{_PARAGRAPH}>, full_text string", read)


def sections(actions: DataFrame, key: str) -> DataFrame:
    """key, pos, number, heading, body, fields, statute (of the heading before), closed (a closing paragraph came)."""
    p = actions.select(key, F.inline("paragraphs"))
    order = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    closing = F.col("number").isin(CLOSING) | F.col("number").startswith("conclusion")
    headed = F.when(F.col("number").rlike("^USC_.*_heading$"), F.nullif(F.regexp_extract("number", r"USC_(\d+)", 1), F.lit("")))
    names = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    return p.select(key, "pos", "number", F.coalesce(F.element_at(names, F.col("number")), F.lit("")).alias("heading"), "body", "fields", F.coalesce(F.last(headed, ignorenulls=True).over(order), F.lit("")).alias("statute"), F.max(closing).over(order).alias("closed"))


def rejections(actions: DataFrame, key: str) -> DataFrame:
    """key, pos, statute, claims_raw, subsection, types, references, fallback: grounds of rejection.

    They come from paragraphs before the closing ones whose fields name claims,
    references and a ground; an action without any gives what its sentences say.
    """
    field = lambda k: F.element_at("fields", F.lit(k))
    s = sections(actions, key).where(~F.col("closed") & field("1").isNotNull() & field("4").isNotNull() & X.allowed_type(field("3")))
    none = F.expr("CAST(array() AS array<string>)")
    found = s.select(key, "pos", "statute", field("1").alias("claims_raw"), F.coalesce(field("2"), none).alias("subsection"), field("3").alias("types"), X.clean_references(field("4")).alias("references"), F.lit(False).alias("fallback"))
    said = actions.join(found.select(key).distinct(), key, "left_anti").select(key, F.posexplode(X.rejection_sentences(F.col("full_text"))).alias("pos", "r"))
    texts = lambda c: F.when(c != "", F.array(c)).otherwise(none)
    more = said.select(key, "pos", F.col("r.statute").alias("statute"), texts(F.col("r.claims")).alias("claims_raw"), texts(F.substring("r.subsection", 1, 1)).alias("subsection"), texts(F.col("r.clause")).alias("types"), F.col("r.references").alias("references"), F.lit(True).alias("fallback"))
    return found.unionByName(more)


def prior_art(grounds: DataFrame, key: str) -> DataFrame:
    """key, references: all references of an action's grounds in order, each once."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "references")))
    return grounds.groupBy(key).agg(F.array_distinct(F.flatten(F.transform(rows, lambda r: r["references"]))).alias("references"))


def claims_of_archives(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per archive path: format, n_xmls, errors; and the claims of the last member that is a claims document."""
    parsed = claim_documents(members.select(F.struct("path", "pos").alias("key"), "content"), "key").select(F.col("key.path").alias("path"), F.col("key.pos").alias("pos"), "kind", "parts", "error")
    known = F.col("kind").isin("dtd_legacy", "ns_claims") & F.col("error").isNull()
    broken = members.groupBy("path").agg(F.count("content").alias("n_xmls"), F.array_compact(F.collect_list("error")).alias("broken"))
    per = parsed.groupBy("path").agg(F.max_by("kind", F.when(F.col("error").isNull(), F.col("pos"))).alias("format"), F.array_compact(F.array_sort(F.collect_list("error"))).alias("errors"))
    last = parsed.where(known).groupBy("path").agg(F.max_by(F.struct("kind", "parts"), "pos").alias("l")).select("path", "l.*")
    return broken.join(per, "path", "left").select("path", "format", "n_xmls", F.concat("broken", F.coalesce("errors", F.expr("CAST(array() AS array<string>)"))).alias("errors")), claims(last, "path")


def actions_of_archives(members: DataFrame) -> DataFrame:
    """The first member of every archive as an office action; ``error`` is no_xml_in_tar for archives without one."""
    first = members.groupBy("path").agg(F.min_by("content", F.when(F.col("content").isNotNull(), F.col("pos"))).alias("content"))
    read = office_actions(first, "path").select("path", "paragraphs", "full_text", "error")
    none = first.where("content IS NULL").select("path").withColumns({"paragraphs": F.lit(None).cast(read.schema["paragraphs"].dataType), "full_text": F.lit(None).cast("string"), "error": F.lit("no_xml_in_tar")})
    return read.unionByName(none)
