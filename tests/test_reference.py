import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import claims, relational as R, stats as S
from tessera.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


def rows(df, columns):
    clean = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, float) or "Decimal" in type(x).__name__ else x
    return sorted((tuple(clean(x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_parse_claims():
    got = claims.parse_claims("1. (Original) A [[b]] __c__.\nClaim 2 (Currently Amended): D\n(New) Claim 3: E")
    assert [(c["num"], c["status"]) for c in got] == [(1, "original"), (2, "currently_amended"), (3, "new")]
    assert got[0]["plain"] == "A c." and got[0]["added"] == ["c"] and got[0]["deleted"] == ["b"]
    assert claims.parse_claims(None) == [] == claims.parse_claims("none")


def test_claim_numbers(spark):
    df = spark.createDataFrame([("1-3, 5",), ("9-2",), (None,), ("7–9",)], "t string")
    assert [r[0] for r in df.select(T.claim_numbers(F.col("t"))).collect()] == [[1, 2, 3, 5], [], [], [7, 9]]
    assert [r[0] for r in df.select(T.claim_numbers_loose(F.col("t"))).collect()] == [[1, 2, 3, 5], [9], [], [7, 8, 9]]
    odd = spark.createDataFrame([("9" * 30 + ", 4",), ("x7 8y 9",), ("1-500",)], "t string")
    assert [r[0] for r in odd.select(T.claim_numbers(F.col("t"))).collect()] == [[4], [9], []]
    assert [r[0] for r in odd.select(T.claim_numbers_loose(F.col("t"))).collect()] == [[4], [9], [1]]


def test_short_ngrams_are_none(spark):
    df = spark.createDataFrame([("one two",), (None,), ("ab cd ef gh",)], "t string")
    assert [r[0] for r in df.select(T.ngrams(T.word_tokens(F.col("t")), 3)).collect()] == [[], [], ["ab cd ef", "cd ef gh"]]


def test_wilcoxon_small():
    # All 2^3 sign patterns of ranks 1..3: W+ = 6 has probability 1/8 on either side.
    assert S._two_sided(6, 3, 0) == pytest.approx(0.25)
    assert S._two_sided(0, 0, 0) == 1.0


def test_diff_and_disjoint_pool(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert sorted((r.k, r.status) for r in R.diff_sides(a, b, ["k"], "v").collect()) == [(1, "cancelled"), (2, "modified"), (3, "new")]
    cohort, pool = R.bucket_split(spark.range(200), "id", 5, 1)
    assert cohort.join(pool, "id", "left_semi").isEmpty() and cohort.count() + pool.count() == 200


def test_entry_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    shutil.copytree("tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy("__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')] and 'dup_keys' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_edit_ratio_of_whole_turns(spark, tmp_path):
    """Against brute force over code points, with turns that differ only outside ASCII."""
    turns = ["añb😀", "anb😁", "日本語の文", "日本の文章", None, "", "été", "ete", "e\u0301te", "plain", "plaîn😀😀"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for i, (p, x) in enumerate(zip(turns, turns[1:], strict=False), 1):
        p, x = p or "", x or ""
        row = list(range(len(p) + 1))
        for k, c in enumerate(x, 1):
            old, row = row, [k]
            for j, d in enumerate(p, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        want[i] = (row[-1], round(1 - row[-1] / max(len(p), len(x)), 4) if p and x else 0.0)
    got = {r.turn: (r.distance, r.similarity) for r in QUERIES["turn_edit_ratio"](spark, str(tmp_path)).collect()}
    assert got == want and want[1] == (2, 0.5)


def test_parse_claims_reads_every_whole_text(spark, tmp_path):
    long = "\n".join(f"{i}. (Original) " + "word " * 50 for i in range(1, 3001))
    texts = ["1. (Original) A [[b]] __c__.\nClaim 2 (Currently Amended): D\n(New) Claim 3: E", None, "no claims", long, "9" * 30 + ". (New) F", "9" * 5000 + ". (New) G"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["parse_claims"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {k: [(r.pos, r.num) for r in sorted(v, key=lambda r: r.pos)] for k, v in got.items()} == {0: [(0, 1), (1, 2), (2, 3)], 3: [(i, i + 1) for i in range(3000)], 4: [(0, None)], 5: [(0, None)]}
    assert {r.body for r in got[3]} == {("word " * 50).strip()} and got[4][0].status == "new"


def test_direction_rates_at_the_limit(spark, tmp_path):
    """Pairs whose means are 0.05 apart, so the order of a sum decides; rows of many files in any order, nulls among them."""
    import random

    r, events = random.Random(7), []
    for user in range(400):
        n, m = r.randint(3, 9), r.choice([2, 4, 5, 8])
        base = [r.randint(1, 20_000) for _ in range(n * m)]
        probe = [r.randint(1, 9_000) for _ in range(n - 1)]
        base[-1] += -sum(base) % (n * m)
        probe.append(sum(base) // m - sum(probe) + 5 * n)
        events += [(user, "a", c / 100) for c in base] + [(user, "d", c / 100) for c in probe]
    events += [(500, "a", None), (500, "d", 1.0), (501, "a", 1.0), (501, "d", None), (501, "d", None), (502, "a", 2.0), (502, "a", None), (502, "d", 2.01)]
    events += [(u, t, 1.0) for u in range(500, 503) for t in ("b", "c", "e", None)]
    r.shuffle(events)
    events = pd.DataFrame([(2 * i, *e) for i, e in enumerate(events)], columns=["event_id", "user_id", "event_type", "value"])
    events["event_type"] = events["event_type"].where(events["event_type"].notna(), None)
    spark.createDataFrame([tuple(None if pd.isna(x) else x for x in e) for e in events.sample(frac=1, random_state=7).itertuples(index=False)], "event_id long, user_id long, event_type string, value double").repartition(16).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"create table events as select * from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    got, want = QUERIES["direction_rates"](spark, str(tmp_path)).toPandas(), con.sql(SQL["direction_rates"]).df()
    columns = ["cond", "metric", "n", "hits", "hit_rate"]
    assert rows(got, columns) == rows(want, columns)
    c1 = want[(want["metric"] == "c1") & (want["cond"] == "B")].iloc[0]
    assert c1["n"] == 403 and 1 < c1["hits"] < 401 and c1["hit_rate"] != round(c1["hits"] / 403, 6)
