"""Readers, sinks, archives and the manifest stream over files that the tests write."""

import io
import json
import random
import re
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import patent as X
from tessera.functions import shape
from tessera.operators import claims, cohort, prompts, quotes, retrieval, stats
from tessera.sources import readers, sinks, xml
from tessera.streaming import manifest


def archive(path, members):
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


NS = '<u:ClaimsDocument xmlns:u="urn:us:gov:doc:uspto:patent">{}</u:ClaimsDocument>'


def test_claims_of_archives(spark, tmp_path):
    first = NS.format("<u:Claim><u:ClaimNumber>1</u:ClaimNumber><u:ClaimText>old</u:ClaimText></u:Claim>")
    second = NS.format(
        "<u:Claim><u:ClaimText>1. (Currently Amended) A  <u:DeletedText>x</u:DeletedText>[[y]] <u:Ins>z</u:Ins></u:ClaimText><u:ClaimText>goes on</u:ClaimText><u:ClaimText>2-4 (Canceled)</u:ClaimText></u:Claim>"
        "<u:Claim><u:ClaimText>9. (New) alone</u:ClaimText></u:Claim>"
        "<u:ImplicitClaim><u:ClaimStatusCategory>Canceled</u:ClaimStatusCategory><u:ClaimNumberRange><u:BeginRangeNumber>6</u:BeginRangeNumber><u:EndRangeNumber>7</u:EndRangeNumber></u:ClaimNumberRange></u:ImplicitClaim>"
    )
    archive(tmp_path / "a.tar", [("1.xml", first.encode()), ("x.txt", b"no"), ("2.XML", second.encode()), ("3.xml", b"<broken")])
    archive(tmp_path / "b.tar", [("only.txt", b"nothing")])
    (tmp_path / "c.tar").write_bytes(b"not an archive at all" * 100)
    members = readers.archive_members(spark, f"{tmp_path}/*.tar")
    info, found = xml.claims_of_archives(members)
    info = {r.path[-5:]: r for r in info.collect()}
    assert info["a.tar"].format == "ns_claims" and info["a.tar"].n_xmls == 3 and len(info["a.tar"].errors) == 1
    assert len(info["c.tar"].errors) == 1 and info["c.tar"].n_xmls == 0 and "b.tar" not in info
    got = [(r.num, r.status, r.text, r.deletions, r.additions, r.bracket_deletions) for r in found.orderBy("pos").collect()]
    assert got[0] == ("1", "Currently Amended", "1. (Currently Amended) A x[[y]] z goes on", ["x"], ["z"], ["[[y]]"])
    assert [(g[0], g[1]) for g in got[1:]] == [("2", "Canceled"), ("3", "Canceled"), ("4", "Canceled"), ("9", "New"), ("6", "Canceled"), ("7", "Canceled")]
    assert got[1][2] == "(range 2-4, Canceled) claim 2" and got[-1][2] == "(implicit, Canceled) claim 7"


def test_actions_of_archives(spark, tmp_path):
    body = "<c:P>Claims 1-3 are rejected under 35 U.S.C. § 103(a) as being unpatentable over Smith.</c:P>"
    archive(tmp_path / "a.tar", [("1.xml", f'<c:OutgoingDocument xmlns:c="urn:us:gov:doc:uspto:common">{body}</c:OutgoingDocument>'.encode()), ("2.xml", b"<other/>")])
    archive(tmp_path / "b.tar", [("1.xml", b"<broken")])
    actions = xml.actions_of_archives(readers.archive_members(spark, f"{tmp_path}/*.tar"))
    assert {r.path[-5:]: r.error is None for r in actions.collect()} == {"a.tar": True, "b.tar": False}
    (g,) = xml.rejections(actions.where("error IS NULL"), "path").collect()
    assert (g.statute, g.claims_raw, g.subsection, g.references, g.fallback) == ("103", ["1-3"], ["a"], ["Smith"], True)
    assert xml.prior_art(xml.rejections(actions.where("error IS NULL"), "path"), "path").first().references == ["Smith"]


def test_document_kinds_and_ids(spark):
    texts = {"<u:ClaimsDocument x='1'>": "ns_claims", "<?xml?><us-patent-application>": "dtd_legacy", "<uspat:OutgoingDocument>": "outgoing", "<a:IncomingDocument/>": "incoming", "<ClaimsDocuments>": "unknown"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(readers.document_kind(F.encode("t", "UTF-8"))).collect()] == list(texts.values())
    names = spark.createDataFrame([("US-2010/12.xml",), ("us2010.xml",), ("EP1.xml",)], "t string")
    assert [r[0] for r in names.select(readers.publication_id(F.col("t"))).collect()] == ["US201012", None, None]


def test_readers(spark, tmp_path):
    (tmp_path / "bench.json").write_text(json.dumps({"cases": [{"id": "a"}, {"id": "b"}, {"id": "c"}]}))
    assert [r.id for r in readers.nested(spark, f"{tmp_path}/bench.json", "id: string", limit=2).orderBy("pos").collect()] == ["a", "b"]
    (tmp_path / "log.jsonl").write_text('{"k": 1, "v": "x"}\n{"k": 2, "v": "y"}\n{"k": 1, "v": "z"}\n')
    assert {r.k: r.v for r in readers.last_by_key(spark, f"{tmp_path}/log.jsonl", "k int, v string", "k").collect()} == {1: "z", 2: "y"}
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "1.json").write_text('{"a": 1}')
    (docs / "2.json").write_text("{broken")
    good, skipped = readers.readable(readers.json_documents(spark, str(docs), "a int").cache())
    assert [r.a for r in good.collect()] == [1] and skipped.first().n_skipped == 1
    (tmp_path / "s.tsv").write_text("file\tcase\tcond\trep\tc1\nP__F__m1__rep0.json\tP\tF\t0\t0.5\nP__F__m1__rep1.json\tP\tF\t1\tNone\nP__F__zz__rep1.json\tP\tF\t1\t1\nP__F__m1__rep2.json\tP\tF\t2\tinf\nsmoke.json\tP\tF\t2\t1\n")
    assert [(r.model, r.value) for r in readers.finite_scores(spark, f"{tmp_path}/s.tsv", "c1", ["m1"]).collect()] == [("m1", 0.5)]
    assert readers.scores(spark, f"{tmp_path}/s.tsv", ["case"], "c1").count() == 3
    for name, size in (("x/a.json", 1), ("x/b.json", 50), ("y/c.json", 2)):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(json.dumps({"t": "q" * size}))
    assert {r.folder: (r.n_files, len(r.t)) for r in readers.largest_json(spark, f"{tmp_path}/tree", "t string").collect()} == {"x": (2, 50), "y": (1, 2)}
    assert {r.case: r.n_chars > 60 for r in readers.case_texts(spark, f"{tmp_path}/tree").collect()} == {"x": True, "y": False}
    files = spark.createDataFrame([("r/p/1_a.txt",), ("r/p/1_b.txt",), ("r/q/z.txt",)], "path string")
    assert {r.case: r.path for r in readers.preferred(files, F.split("path", "/")[1], ["_b.txt", "_a.txt"]).collect()} == {"p": "r/p/1_b.txt", "q": "r/q/z.txt"}
    (tmp_path / "P__C__m__rep0.json").write_text(json.dumps({"case_id": "P", "rep": 0, "probe_meta": {"subcondition": "C_decoy"}}))
    assert [tuple(r) for r in readers.subconditions(spark, str(tmp_path)).collect()] == [("P", 0, "C_decoy")]
    (tmp_path / "t.txt").write_text("a {x} b {y}")
    assert readers.template(spark, f"{tmp_path}/t.txt") == ("a {x} b {y}", ["x", "y"])
    forms = spark.createDataFrame([('{"claim_text": {"text": "a"}}',), ('{"claim_text": "b"}',), ('{"text": "c"}',), ('"d"',), ("e" * 5000,)], "v string")
    assert [r[0] for r in forms.select(readers.claim_text(F.col("v"))).collect()] == ["a", "b", "c", "d", "e" * 4000]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None, [1.0, 2.0]), ("b", 2, "x\ty", [3.0, 4.0])], "case string, n int, t string, v array<double>")
    sinks.case_json(df, f"{tmp_path}/json", "case")
    assert (tmp_path / "json" / "_case=a").is_dir() and spark.read.json(f"{tmp_path}/json").count() == 2
    for _ in range(2):
        sinks.append_lines(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    sinks.tsv(df, f"{tmp_path}/tsv")
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/tsv").orderBy("case").collect()
    assert [(r["case"], r["t"], r["v"]) for r in back] == [("a", "None", "[1.0,2.0]"), ("b", "x\ty", "[3.0,4.0]")]
    sinks.texts(df, f"{tmp_path}/texts", "case", "case")
    sinks.vectors(df, f"{tmp_path}/vectors", "case", "v")
    assert spark.read.parquet(f"{tmp_path}/vectors").schema["v"].dataType.simpleString() == "array<float>"
    assert sinks.markdown(df.select("case", "n"), "T", 1).endswith("| a | 1 |\n\n1 more rows.\n")
    assert sinks.heat_table(df, "case", "n", "t", ["1", "2"]).count() == 2
    for name, doc in (("r1", {"case": "a", "text": "x", "stop": "end"}), ("r2", {"case": "b", "text": None})):
        (tmp_path / "run" / name).mkdir(parents=True)
        (tmp_path / "run" / name / "1.json").write_text(json.dumps(doc))
    done = sinks.completed(spark, [f"{tmp_path}/run/r1", f"{tmp_path}/run/r2"], "case string, text string, stop string", ["text", "stop"])
    assert [r.case for r in done.collect()] == ["a"]


def test_manifest_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda h, c, s: json.dumps({"ts": f"2024-01-01T{h:02d}:00:00Z", "case": "x", "cond": c, "rep": 0, "status": s, "cost": 0.5, "lat": 1.0})
    (folder / "1.json").write_text("\n".join([line(0, "F", "ok"), line(0, "F", "ok"), line(0, "G", "fail"), line(9, "F", "ok")]))
    args = (spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/state")
    manifest.run(*args).awaitTermination()
    (folder / "2.json").write_text(line(20, "F", "ok"))
    manifest.run(*args).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.window.start.hour, r.cond, r.status): r.n for r in got} == {(0, "F", "ok"): 2, (0, "G", "fail"): 1, (9, "F", "ok"): 1}


def test_counters_equal_plain_patterns(spark):
    text = "Claim 1 (Original): _Abc_ __new__ ~~x~~ [[y]]\n 2. said __a_b__\n# Note: Wherein\n```\n_x_ _Yz_ (Cancelled) (canceled)\n3 (NEW) configured to comprising"
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in shape.counters(F.col("t")).items()]).first().asDict()
    want = {k: len(re.findall(p, text, re.M if k.startswith("markup") else re.M | re.I)) for k, p in shape.COUNTERS.items()}
    assert got == want and len(got) == 22 and got["markup_single_underscore"] > 0


def test_quotes_have_their_places(spark):
    text = 'x "' + "q" * 70 + '" and claim 3 recites a thing that is rather long here. As claimed it is, as claimed things are said.'
    for r in quotes.quotes(spark.createDataFrame([(1, text), (2, None), (3, text * 20)], "k long, text string"), "k").collect():
        whole = text if r.k == 1 else text * 20
        assert whole[r.first : r.behind][:800] == r.quote


def test_ranges_headers_sentences(spark):
    one = lambda kind, rows, f: [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"t {kind}").select(f(F.col("t"))).collect()]
    assert one("string", ["3-5", "5-3", "1-300", "7", "x"], X.expand_range) == [[3, 4, 5], [], [], [7], []]
    heads = one("string", ["1. (New) a b", "[Claim 2] c", "LISTING OF THE CLAIMS: Claim 3 (Original): d", "no head", "4 - 6 (Canceled)"], X.inline_header)
    assert [(h.num, h.status, h.rest) for h in heads] == [("1", "New", "a b"), ("2", None, "c"), ("3", "Original", "d"), (None, None, "no head"), ("4-6", "Canceled", "")]
    assert one("array<string>", [["none", "claims 4 and 5"], [], ["x12"]], X.first_number) == [4, None, None]
    said = one("string", ["The U.S.C. rule of Dr. Smith holds here. Short one. See Fig. 3 for what is shown! It is e.g. plain to see.", None], X.sentences)
    assert said == [["The U.S.C. rule of Dr. Smith holds here.", "See Fig. 3 for what is shown!", "It is e.g. plain to see."], []]
    long = "word " * 100 + "Conclusion here. " + "more " * 3000
    assert one("string", [long, "a\n\n\n\nb", "c " * 9000], X.examiner_body) == [("word " * 100).rstrip(), "a\n\nb", ("c " * 9000).strip()[:8000] + "\n[... truncated ...]"]
    para = "Intro text.\n\nClaim 7 is rejected as obvious.\n\nClaim 8 is anticipated by X."
    both = spark.createDataFrame([(para, 8), (para, 9), ("nothing", 1)], "t string, n int").select(X.rejection_paragraphs(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in both] == ["Claim 8 is anticipated by X.", "Claim 7 is rejected as obvious.\nClaim 8 is anticipated by X.", "nothing"]
    refs = one("array<string>", [["Smith et al.", "Re: x", "[Abc]", "fax Smith", "571-272-1000 Jones", "12- Abc", "PAIR System", "ab", "B" + "b" * 300], None], X.clean_references)
    assert refs == [["Smith et al."], []]


def test_permuted_sentences_keep_first_and_all(spark):
    user = "x\n" + prompts.BODY + "First sentence stands here. " + " ".join(f"Sentence number {i} is this." for i in range(9)) + "\n[... truncated ...]\n\n## Task\n\ndo"
    rows = spark.createDataFrame([(1, user), (2, "no marker"), (3, prompts.BODY + "Only one sentence.\n\n## Task\n\n")], "case_id long, user string")
    got = {r.case_id: r for r in prompts.probe_b(rows).collect()}
    body = got[1].user.split(prompts.BODY)[1].split("\n[...")[0]
    assert body.startswith("First sentence stands here. ") and sorted(body.split(". ")) != body.split(". ")
    assert sorted(re.findall(r"number (\d)", body)) == [str(i) for i in range(9)] and got[1].user.endswith("\n[... truncated ...]\n\n## Task\n\ndo")
    assert [(got[i].mode, got[i].reason, got[i].user == rows.collect()[i - 1].user) for i in (2, 3)] == [("skipped", "no_examiner_body_marker", True), ("skipped", "too_few_sentences", True)]
    with pytest.raises(Exception, match="the prompt has no"):
        prompts.probe_d(rows.where("case_id = 2")).collect()


def test_greedy_cohort_equals_row_by_row_rule(spark):
    import hashlib

    rnd = random.Random(3)
    rows = [(i, rnd.choice("abc"), rnd.choice("xyz")) for i in range(60)]
    axes = {"p": {"a": 6, "b": 5}, "q": {"x": 4, "y": 7}}
    left = sorted(rows, key=lambda r: hashlib.sha256(f"42::{r[0]}".encode()).hexdigest())
    unmet, want = {k: dict(v) for k, v in axes.items()}, []
    for _ in range(20):
        need = lambda r: max(0, unmet["p"].get(r[1], 0)) + max(0, unmet["q"].get(r[2], 0))
        best = max(left, key=need)  # the first of equals
        left.remove(best)
        want.append(best[0])
        for k, v in (("p", best[1]), ("q", best[2])):
            if v in unmet[k]:
                unmet[k][v] -= 1
    got = cohort.greedy_cohort(spark.createDataFrame(rows, "id long, p string, q string"), "id", axes, 20)
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_equivalence_and_signed_ranks(spark):
    x = [((i * 37) % 11 - 5) / 100 for i in range(50)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(x)] + [("h", i, v + 0.19) for i, v in enumerate(x)], "k string, case int, d double")
    got = {r.k: r for r in stats.bootstrap_tost(df, ["k"], "d", case="case").collect()}
    again = {r.k: r for r in stats.bootstrap_tost(df.repartition(7), ["k"], "d", case="case").collect()}
    assert got == again and got["g"].equivalent and got["g"].p_tost == 0.0
    rng = np.random.default_rng(42)
    boot = np.median(np.array(x)[rng.integers(0, 50, size=(10_000, 50))], axis=1)
    assert (got["g"].ci90_low, got["g"].ci95_high) == pytest.approx((np.percentile(boot, 5), np.percentile(boot, 97.5)))
    far = stats.bootstrap_tost(df.withColumn("d", F.col("d") + 1), ["k"], "d").first()
    assert not far.equivalent and far.p_tost == 1.0
    ranks = stats.signed_ranks(spark.createDataFrame([("a", v) for v in (1.0, -1.0, 2.0, 0.0, 3.0, -4.0)], "k string, d double"), ["k"], "d").first()
    assert (ranks.w_plus, ranks.w_minus, ranks.n, ranks.ties) == (1.5 + 3 + 4, 1.5 + 5, 5, 6)


def test_claim_diff_and_edit_scores(spark):
    pre = spark.createDataFrame([(1, "abc def"), (2, " same "), (3, "gone")], "num long, text string")
    post = spark.createDataFrame([(1, "abc xyz def"), (2, "same"), (4, "new one")], "num long, text string")
    got = {r.num: (r.status, r.ratio, r.added_spans, r.removed_spans) for r in claims.claim_diff(pre, post, ["num"]).collect()}
    assert got == {1: ("modified", 0.778, ["xyz "], []), 2: ("kept", 1.0, [], []), 3: ("cancelled", 0.0, [], ["gone"]), 4: ("new", 0.0, ["new one"], [])}
    rows = spark.createDataFrame([(1, "abc", "abd", "xyz"), (2, "abc", "abd", None), (3, None, "a", "b"), (4, "a", "", "b"), (5, "a", "b", "a")], "k int, a string, b string, c string")
    assert [(r.c2, r.reason) for r in claims.edit_scores(rows, "k", "a", "b", "c").orderBy("k").collect()] == [(round(1 / 3, 4), None), (None, "no_post"), (None, "no_pre"), (None, "no_gen"), (1.0, None)]


def test_semantic_scores_use_the_given_embedder(spark):
    rows = spark.createDataFrame([("x", "one two three four", "one two three four"), ("x", "one two three", "five six seven"), ("y", "a", "b")], "k string, a string, b string")

    def embed(texts):
        return [[t.count("one two three"), t.count("five six seven"), 0.0] for t in texts]

    assert [tuple(r) for r in retrieval.semantic_scores(rows, "k", "a", "b", embed).collect()] == [("x", 0.5, 2)]


def test_random_picks_are_distinct_and_nested(spark):
    pool = spark.range(500).select(F.col("id").alias("c"))
    cases = spark.range(40).select(F.col("id").alias("case_id"))
    found = {k: {} for k in (1, 3, 5)}
    for k in found:
        for r in retrieval.random_k(cases, pool, "c", ["c"], k).orderBy("rank").collect():
            found[k].setdefault(r.case_id, []).append(r.c)
    assert all(len(set(v)) == k for k, f in found.items() for v in f.values()) and all(found[5][i][:3] == found[3][i] and found[3][i][:1] == found[1][i] for i in range(40))
    small = retrieval.random_k(cases, pool.limit(2), "c", ["c"], 3)
    assert small.groupBy("case_id").count().where("count = 2").count() == 40
