import base64
import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, exact_dedup, langid, license_scan, ngram_join, packing, quality, suffix_dedup, toxicity, warc
from tessera.llm.common import new_path, release

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def dice(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 4)):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append(rnd.choice([" ", "\n", "  "]).join(t))
    return [*out, None, "", "   ", "one two", out[0], "é" * 130, "a" * 300]


def test_best_fit_plan_is_best_fit_decreasing():
    for seed in range(60):
        rnd = random.Random(seed)
        window = rnd.choice([8, 16, 50])
        lengths = [rnd.randint(1, window - 1) for _ in range(rnd.randint(0, 150))]
        rooms = []
        for x in sorted(lengths, reverse=True):
            fit = [(r, i) for i, r in enumerate(rooms) if r >= x]
            if fit:
                rooms[min(fit)[1]] -= x
            else:
                rooms.append(window - x)
        plan, n = packing.best_fit_plan(Counter(lengths), window)
        used = Counter()
        for length, _, ranks, first, share, _ in plan:
            for j in range(ranks):
                used[first + j // share] += length
        assert sorted(window - v for v in used.values()) == sorted(rooms) and len(used) == n


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [*dice(1, 20), "Don't <|endoftext|> É́ x\x1cy", "word " * 3000]
    rows = packing.pack(docs(spark, texts), packing.default_tokenizer(), window=64).collect()
    t = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids, end = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = b"".join(x.to_bytes(4, "little") for x in ids[end : end + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (end, len(ids), zlib.crc32(part))
            end += r.length
        assert end == len(ids)
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 64
    assert packing.pack(docs(spark, []), packing.default_tokenizer()).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.full_digest, lambda t: F.substring(exact_dedup.full_digest(t), 1, 0)])
def test_exact_dedup(spark, digest):
    """Also under a digest that every text shares: the bytes tell them apart."""
    texts = dice(2, 25)
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs(spark, texts), digest).collect()}
    norm = ["".join(c for c in t or "" if c not in " \t\n\v\f\r") for t in texts]
    for i, n in enumerate(norm):
        group = [k for k, m in enumerate(norm) if m == n]
        keep = min(group, key=lambda k: (-len(texts[k] or ""), k))
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(group), keep == i, hashlib.sha256(n.encode()).hexdigest())
    assert exact_dedup.drop_duplicates(docs(spark, texts)).count() == len(set(norm))


def test_decontamination(spark):
    texts = [*dice(3, 20), "x W1 w2 w3! y"]
    items = [(1, "w1 w2 w3"), (2, None), (3, " ".join(texts[0].split()[:14])), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = [(k, tuple(w[i : i + min(10, len(w))])) for k, t in items if (w := decontamination.words_of(t)) for i in range(len(w) - min(10, len(w)) + 1)]
    for block in (1_000_000, 4):  # one block, and several
        for r in decontamination.annotate(docs(spark, texts), bench, block_words=block).collect():
            w = decontamination.words_of(texts[r.doc_id])
            hit, found = set(), set()
            for k, g in wins:
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit.update(range(i, i + len(g)))
                        found.add(str(k))
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_suffix_dedup(spark):
    texts = dice(4, 30)
    got = {r.doc_id: r for r in suffix_dedup.cut(docs(spark, texts)).collect()}
    data, first = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(data):
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    for i, b in enumerate(data):
        gone = {x for s in range(len(b) - 49) if first[b[s : s + 50]] < i for x in range(s, s + 50)}
        kept = bytes(c for x, c in enumerate(b) if x not in gone)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), len(gone), hashlib.sha256(kept).hexdigest())
        assert got[i].n_spans == sum(x - 1 not in gone for x in gone)


def shingle_components(texts):
    """Shingle sets and the smallest index linked to each, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sets, label


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_ngram_join(spark, seed):
    texts = dice(seed, 60)
    sets, label = shingle_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs(spark, texts)).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert ngram_join.linked(docs(spark, [])).count() == 0


def test_signatures_bound_the_difference():
    """Signatures differ in no more places than the sets have shingles of one side, also of texts without any."""
    import numpy as np

    texts = [t or "" for t in dice(9, 40)]
    data = [t.encode() for t in texts]
    row, s = ngram_join.shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    n = np.bincount(row, minlength=len(texts))
    sig = ngram_join.signatures(s, n)
    sets = [set(s[row == i].tolist()) for i in range(len(texts))]
    for i, x in enumerate(sets):
        assert sig[i].tolist() == ngram_join.signatures(np.array(sorted(x), dtype=np.uint64), np.array([len(x)]))[0].tolist()
        for j, y in enumerate(sets):
            apart = sum(int(a).bit_count() for a in sig[i] ^ sig[j])
            assert apart <= len(x ^ y) and (len(x ^ y) - apart) % 2 == 0
    assert not ngram_join.signatures(np.zeros(0, np.uint64), np.zeros(3, np.int64)).any()


def test_warc_round_trip(spark):
    pages = [(3, "http://a", "same"), (1, "http://b\r\nx", "same"), (2, None, None), (4, "u", ""), (5, "v", "é\r\n\r\nb")]
    folder = new_path(spark, "warc-test")
    index = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), folder)
    got = {r.page_id: r for r in warc.read(index, folder).collect()}
    for i, _, html in pages:
        data = (html or "").encode()
        first = min(k for k, _, h in pages if (h or "") == (html or ""))
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and got[i].payload_bytes == len(data)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first == i else ("revisit", first))
        assert got[i].payload == (bytearray(data) if first == i else None)


def test_license_scan_equals_plain_form(spark):
    model = license_scan.fit(["the and of thing", "some words in a line"])
    texts = ["Released under the MIT License.\nother", "Licensed under CC BY-NC 4.0.", None, "", "license license", "the work is under terms", "hello"]
    for r in license_scan.scan(docs(spark, texts), model).collect():
        plain = [v[0] for p in (texts[r.doc_id] or "").split("\n") if p and (v := license_scan.classify(p, model))[0] != "none"]
        assert r.families == ",".join(sorted({f for f in plain if f != "unknown"})) and r.n_license + r.n_unknown == len(plain)


def test_models_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in langid.op1_language_id(spark, sf).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.97 * len(rows)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, column in ((quality.op9_quality, "quality"), (toxicity.op6_toxicity, "toxic")):
        rows = [r for r in query(spark, sf).collect() if r.held_out and r.doc_id in labels]
        assert sum(r.predicted == labels[r.doc_id][column] for r in rows) >= 0.9 * len(rows)


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r.doc_id for r in toxicity.op6_toxicity(spark, sf).collect() if r.predicted}  # the model is held against labels elsewhere
    best = {}
    for i, t in sorted(texts.items()):
        n = "".join(c for c in t if c not in " \t\n\v\f\r")
        if i not in toxic and (n not in best or len(t) > len(texts[best[n]])):
            best[n] = i
    left = sorted(best.values())
    label = shingle_components([texts[i] for i in left])[1]
    left = [i for k, i in enumerate(left) if label[k] == k]
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        if w := decontamination.words_of(r.text):
            k = min(10, len(w))
            windows.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    sizes = {len(g) for g in windows}
    clean = [i for i in left if (w := decontamination.words_of(texts[i])) is not None and not any(tuple(w[j : j + k]) in windows for k in sizes for j in range(len(w) - k + 1))]
    t, got = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(t.encode(texts[i], add_special_tokens=False).ids) + 1 for i in clean} and len(clean) < len(left) < len(best)


def test_stages_begin_by_collecting_garbage(spark):
    """Here tasks run in the driver's JVM, so its own full collections are set against those that a stage's tasks add."""
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory
    full = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if any(x in b.getName() for x in ("Old", "MarkSweep")))
    rows, before = docs(spark, ["a b c"] * 5), full()
    release(spark)
    assert full() - before == 1
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, rows, "/root/testdata/sf0.001")
        assert full() - before > 1, name  # calls that come while another's collection waits share it


def test_packing_starts_no_workers_for_its_plan(spark):
    """Rows of Python are scanned by workers of their own kind, which stay beside those of the texts."""
    plan = packing.pack(docs(spark, ["a b c", None]).repartition(2), packing.default_tokenizer())._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" in plan


def test_models_without_rows_or_letters(spark):
    empty = docs(spark, [])
    model = langid.fit(empty.select("doc_id", "text", "lang"))
    assert [r.lang_pred for r in langid.predict(docs(spark, ["abc", None, "12"]), model, F.lit(False)).collect()] == ["und"] * 3
    none = toxicity.Model({}, [], 0.0, -4.0)
    assert [r.predicted for r in toxicity.score(docs(spark, [None, "x"]), none).collect()] == [0, 0]
    assert toxicity.fold("IDI0T Сlown 2024!") == " idiot clown "


def test_toxicity_is_normalised_by_length(spark):
    """Clean texts joined to long ones stay clean; toxic ones, alone or joined, do not."""
    found = toxicity.automaton(toxicity.Model({"bad": 3.0}, [], 1.0, 0.0))
    page = "bad " + "word " * 999
    assert toxicity.strength(page * 50, found)[0] == pytest.approx(toxicity.strength(page, found)[0], rel=0.1)
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit_from(documents, labels, held_out)
    texts = {}
    for r in documents.join(labels, "doc_id").where("text IS NOT NULL").orderBy("doc_id").select("lang", "toxic", "text").collect():
        texts.setdefault((r.lang, r.toxic), []).append(r.text)
    long = {k: ["\n".join(t[i : i + 50]) for i in range(0, len(t), 50)] for k, t in texts.items()}
    called = lambda t: [r.predicted for r in toxicity.score(docs(spark, t), model).collect()]
    assert sum(sum(called(t)) for (_, toxic), t in long.items() if not toxic) == 0
    assert all(all(called(t)) for (_, toxic), t in long.items() if toxic)


def test_language_of_long_letter_runs(spark):
    """All letters of a run count, in training and in scoring, wherever they stand."""
    rnd = random.Random(8)
    run = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    start = run("pqr", 64)  # the same in all texts of the training
    labelled = [(i, start + run(letters, 900), lang) for i, (lang, letters) in enumerate([("a", "bcdf"), ("z", "wxyv")] * 20)]
    model = langid.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    assert not model.words and sum(model.languages.index(x) for x in "az") == 1
    texts = [run("wxyv", 64) + run("bcdf", 3000), run("bcdf", 64) + run("wxyv", 3000), run("wxyv", 70) + run("bcdf", 200_000), run("bcdf", 2000) + " wxyv wyxv vxwy"]
    assert [r.lang_pred for r in langid.predict(docs(spark, texts), model, F.lit(False)).orderBy("doc_id").collect()] == ["a", "z", "a", "a"]
    for n in (1, 63, 64, 65, 66, 127, 128, 129, 130, 1000):
        w = run("bcdf", n)
        pieces, whole = langid.bordered_of(w), f"^{w}$"
        for k in range(1, langid.LONGEST + 1):
            got = [p[i : i + k] for j, p in enumerate(pieces) for i in range(len(p) - k + 1) if i < langid.SHORT or j == len(pieces) - 1]
            assert got == [whole[i : i + k] for i in range(len(whole) - k + 1)]


def test_license_of_another_version_is_unknown(spark):
    """Licences outside the training are not confirmed as their neighbours; those in it are."""
    model = license_scan.fit(license_scan.negatives_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    opening = license_scan.TEMPLATES["bsd-3-clause"][1]
    texts = [*license_scan.OUTSIDE, "Distributed under the GNU Lesser General Public License, version 3.", "Released under the BSD 4-Clause License.", "Licensed under CC BY-SA 3.0.", "Licensed under CC BY-NC-ND 4.0.", opening]
    own = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts if t != opening] + [("bsd-3-clause", f"{opening}\n3. Neither the name of the holder")]
    got = [r.families for r in license_scan.scan(docs(spark, texts + [t for _, t in own]), model).orderBy("doc_id").collect()]
    assert got == [""] * len(texts) + [f for f, _ in own]
    assert license_scan.classify(own[-1][1].split("\n")[0], model, own[-1][1])[0] == "bsd-3-clause"


def test_wrapped_license_notices(spark):
    """A notice over several lines is found whole, one on a line of its own as before."""
    model = license_scan.fit(license_scan.negatives_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    third = "3. Neither the name of the holder nor the names of its\ncontributors may be used"
    hashed = "#\n# " + gpl.replace("\n", "\n# ") + "\n#\n# Other"
    texts = [gpl, mit, f"{bsd}\n\n{third}", bsd, hashed, f"Title\n\n{mit}\n\n{gpl}\n\nReleased under the MIT License.\nAll rights reserved.", gpl.replace("version 3", "version 2"), "\n" * 50_000 + mit, "All rights reserved.\n" * 3000]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts), model).collect()}
    assert [got[i].families for i in range(9)] == ["gpl-3.0", "mit", "bsd-3-clause", "", "gpl-3.0", "gpl-3.0,mit,proprietary", "", "mit", "proprietary"]
    assert [got[i].n_license for i in (0, 1, 2, 5, 8)] == [1, 1, 1, 4, 3000] and got[3].license == got[6].license == "unknown"
