"""Exact near-duplicate join: Jaccard similarity of word shingles under several global token orders.

Texts with the same shingle set form a class, so copies cost nothing.  Under any
total order of all shingles, two sets with similarity >= t share a shingle
among the first n - ceil(t n) + 1 of each, their prefix.  Two different orders
are used, both with shingles of many documents last and a hash of their own
before that.  The pairs of a class with the first and the most central class of
its groups must share a prefix shingle under the first order alone, all other
candidates under both; every pair is verified on the full sets.

Groups of a prefix shingle are not expanded into pairs.  A class leaves a group
if so much of its prefix is its own that it can be similar to no set of the
sizes there: an edited copy's own shingles come first in its prefix, so copies
too far from all others go before they meet them.  Then every class is
held against two classes of its groups, the first and the most central, which
joins large groups of near copies by few pairs.  Only classes of one group that are in
different components after that are paired, by the rarest of their shingles,
and those pairs must survive the intersection of the orders.  As they are
paired, each set brings a signature, the parity of its shingles in BITS places.
Two signatures differ in no more places than the sets have shingles that are
not shared, so a pair with too many of those goes where it is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cleared, joined, only, returned, rows_by_bytes, stored, texts_of

SIZE, PERCENT = 5, 75
#: Shingles are ordered last if they are in OFTEN documents of a scan batch and in IN_ALL that way; so many are kept at most.
OFTEN, IN_ALL, COMMON = 3, 12, 1_000_000
#: Places of a signature: longs of 64 bits.
BITS = 8 * 64
#: Bytes of text that are shingled at once (a longer text alone).
BLOCK = 1 << 18
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


@lru_cache(maxsize=2)
def _block_powers(base: int) -> np.ndarray:
    return _powers(base, 2 * BLOCK)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingles of texts that lie one behind the other in ``data``, from ``at`` on: row and shingle, sorted.

    A-Z are lowered and words stand between ASCII white space.  A word's hash is
    a polynomial of its bytes, taken from running sums, so a whole block of
    texts is hashed in a few passes.
    """
    data, at = _LOWER[data[at[0] : at[-1]]], at - at[0]
    n = len(at) - 1
    letter = ~_SPACE[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[at] = True
    begin, stop = letter.copy(), letter.copy()
    if len(data):
        begin[1:] &= ~letter[:-1] | border[1:-1]
        stop[:-1] &= ~letter[1:] | border[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    up, down = (_block_powers(int(b)) if len(data) <= 2 * BLOCK else _powers(int(b), len(data)) for b in (_BASE, _INVERSE))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[data] * up[: len(data)])))
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, dtype=np.uint64)
    row = np.searchsorted(at[1:], starts, "right")
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    rows, values = [], []
    for k in range(1, size + 1):  # texts of fewer words are one shingle
        if k < size:
            places = first[count == k]
        else:
            places = np.flatnonzero(np.arange(len(row)) - first[row] <= count[row] - size)
        value = np.full(len(places), k, dtype=np.uint64)
        for j in range(k):
            value = value * _BASE + words[places + j]
        rows.append(row[places])
        values.append(mixed(value))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct shingles of one text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), size)[1]


def _blocks(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of a column's texts in blocks: first row, row behind, and row within the block and shingle, sorted."""
    data, at = texts_of(column)
    for first, last in rows_by_bytes(at, BLOCK):
        yield first, last, *shingle_sets(data, at[first : last + 1], size)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def signatures(shingle: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of sets of ``n`` shingles that lie one behind the other, the parity of the shingles in each place, as a row of longs; an empty set has zeros."""
    out = np.zeros((len(n), BITS // 64), dtype=np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        begin = (np.cumsum(n) - n)[some]
        bit, word = np.uint64(1) << (shingle & np.uint64(63)), (shingle >> np.uint64(6)) % np.uint64(BITS // 64)
        for k in range(BITS // 64):
            out[some, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), begin)
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of many documents, sorted: the most frequent ones of a scan of all of them.

    Batches are counted where they are and send what is frequent there.  Which
    shingles are found changes the order, and so the work, never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("n-gram join")
        borders = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
        for batch in batches:
            found = [(values, n.astype(np.int32), [0, *np.searchsorted(values, borders), len(values)]) for _, _, _, s in _blocks(batch.column(0), size) for values, n in [np.unique(s, return_counts=True)]]
            for k in range(16 if found else 0):  # a sixteenth of all shingles at a time
                values = np.concatenate([v[e[k] : e[k + 1]] for v, _, e in found])
                order = np.argsort(values, kind="stable")
                values, n = values[order], np.concatenate([m[e[k] : e[k + 1]] for _, m, e in found])[order]
                if not len(values):
                    continue
                at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
                n = np.add.reduceat(n, at)
                values, often = values[at], n >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])
            del found
        returned()  # the worker idles while the JVM's stages take their memory

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") >= IN_ALL).orderBy(F.desc("n"), "token").limit(COMMON).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, common: np.ndarray, size: int, percent: int, order: int) -> DataFrame:
    """doc_id, n, print and sig (of the set) and p: the prefix under the first or the second order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("n-gram join")
        common = shared.value
        for batch in batches:
            for first, last, row, s in _blocks(batch.column(1), size):
                n = np.bincount(row, minlength=last - first)
                begin = np.cumsum(n) - n
                prints = [xxhash.xxh3_128_digest(s[a : a + k].tobytes()) for a, k in zip(begin.tolist(), n.tolist(), strict=True)]
                late = among(s, common)
                # The first order is that of the numbers themselves.
                ordered = np.lexsort((s if order == 1 else mixed(s ^ _M2), late, row))
                k = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
                p = s[ordered][np.arange(len(s)) - np.repeat(begin, n) < np.repeat(k, n)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(k))), pa.int32()), pa.array(p.view(np.int64)))
                places = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BITS // 64 + 1, BITS // 64), pa.int32()), pa.array(signatures(s, n).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), places, lists], ["doc_id", "n", "print", "sig", "p"])
        returned()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print binary, sig array<long>, p array<long>")


def _may_be_similar(met, x: str, y: str, percent: int):
    """Whether sets of x and y shingles that share ``met`` of their prefixes can be similar enough.

    Shared shingles that are not in both prefixes all come after the prefix that
    ends first, so there are no more of them than that set has left.
    """
    return met >= _must_share(x, y, percent)


def _must_share(x: str, y: str, percent: int):
    left = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    return F.ceil((F.col(x) + F.col(y)) * percent / (100 + percent)) - F.greatest(left(x), left(y))


def _few_apart(x: str, y: str, sx: str, sy: str, percent: int):
    """Whether sets of x and y shingles may be similar enough by their signatures: those that differ in so many places differ in as many shingles."""
    apart = sum((F.bit_count(F.col(sx)[k].bitwiseXOR(F.col(sy)[k])) for k in range(BITS // 64)), F.lit(0))
    both = F.col(x) + F.col(y)
    return apart <= both - 2 * F.ceil(both * percent / (100 + percent))


def _sharing(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b, na, nb) those whose ``parts`` (x, p) share enough."""
    a, b = (parts.select(F.col("x").alias(k), F.col("p").alias("p" + k)) for k in "ab")
    both = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b")
    return both.where(_may_be_similar(F.size(F.array_intersect("pa", "pb")), "na", "nb", percent)).select("a", "b", "na", "nb")


def _across(rows: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb: pairs of a group of ``rows`` (token, x, n, c) in different components that may share enough; ``signed`` has the classes' signatures (x, sig).

    The rows of a class are ordered by the sizes of their groups, small first,
    which is one more global order.  If a pair must share t of its rows, the
    first that it shares has t - 1 behind it in either class; so of k rows only
    the first k - t + 1 are looked at, on both sides, and no pair is missed.
    """
    sizes = rows.groupBy("token").agg(F.count("*").alias("g"), F.min("n").alias("least"), F.max("n").alias("most"))
    of_x = Window.partitionBy("x")  # at most a prefix
    ranked = rows.join(sizes, "token").withColumn("rest", F.count("*").over(of_x) - F.row_number().over(of_x.orderBy("g", "token")) + 1)
    ranked = stored(ranked.where(_enough_for_any("rest", percent)).select("token", "x", "n", "c", "rest").hint("merge").join(signed, "x"), "ranked")
    u, v = (ranked.select("token", *[F.col(c).alias(c + k) for c in ("x", "n", "c", "rest", "sig")]) for k in "ab")
    apart = (F.col("xa") < F.col("xb")) & (F.col("ca") != F.col("cb")) & _near("na", "nb", percent)
    enough = F.least("resta", "restb") >= _must_share("na", "nb", percent)
    return u.join(v, "token").where(apart & enough & _few_apart("na", "nb", "siga", "sigb", percent)).select(F.col("xa").alias("a"), F.col("xb").alias("b"), "na", "nb").distinct()


def _able(rows: DataFrame, percent: int) -> DataFrame:
    """Of ``rows`` (token, x, n, c), those that can take part in a link, and held: how much of x's prefix can.

    Groups of one component c go.  Then a class leaves a group if it can be
    similar to no set of the sizes there: the bound of ``_may_be_similar``
    without rounding, which is loosest for the smallest or the largest set that
    is near enough in size.
    """
    groups = rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")).where("lo < hi").drop("lo", "hi")
    met = rows.join(groups, "token").withColumn("held", F.count("*").over(Window.partitionBy("x")))  # at most a prefix
    return met.where(_enough_for_any("held", percent)).select("token", "x", "n", "c", "held")


def _enough_for_any(have: str, percent: int):
    """Whether ``have`` shared shingles are enough for a set of n with some set from least to most."""

    def bound(y):
        return 100 * (100 + percent) * F.col(have) + (100 + percent) * percent * F.greatest(F.col("n"), y) >= 100 * percent * (F.col("n") + y)

    small = F.greatest(F.col("least"), F.floor(F.col("n") * percent / 100))
    large = F.least(F.col("most"), F.ceil(F.col("n") * 100 / percent))
    return bound(small) | bound(large)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of the nodes of ``edges`` (a, b).

    Every round each node takes the smallest label around it and then its
    label's label; labels are written each round and the rounds end when none
    changes.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, "a").select("a", F.least("label", "near").alias("label"))
        jump = step.alias("s").join(labels.alias("l"), F.col("s.label") == F.col("l.a"), "left")
        new = stored(jump.select(F.col("s.a").alias("a"), F.least(F.col("s.label"), F.coalesce(F.col("l.label"), F.col("s.label"))).alias("label")), "labels")
        changed = not new.join(labels, ["a", "label"], "left_anti").isEmpty()
        labels = new
        if not changed:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def _similar(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), stored, those whose full sets are similar enough."""
    nodes = stored(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id"), "nodes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("n-gram join")
        for batch in batches:
            for first, last, row, s in _blocks(batch.column(1), size):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=last - first)))), pa.int32()), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], ["doc_id", "s"])
        returned()

    full = stored(joined(docs.select("doc_id", "text"), nodes, "doc_id", "left_semi", row_bytes=48).mapInArrow(sets, "doc_id long, s array<long>").dropDuplicates(["doc_id"]), "sets")
    a, b = full.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), full.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").hint("merge").join(a, "a").hint("merge").join(b, "b")
    met = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", met.alias("met"), (F.size("sa") + F.size("sb") - met).alias("all")).where(100 * F.col("met") >= percent * F.col("all")).select("a", "b")


def _near(x: str, y: str, percent: int):
    """Sets so different in size cannot be similar enough."""
    return (100 * F.least(x, y)) >= (percent * F.greatest(x, y))


def linked(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    ``docs`` needs doc_id and text; other columns are not read.  doc_id names a
    text: rows that repeat an id and its text come out alike.  Null and
    empty texts and those of white space have no shingle, link with nothing and
    are components of their own; a null doc_id keeps a null component.  Texts of
    fewer than ``size`` words are one shingle.  Similarity is compared in whole
    numbers, so a pair exactly at the threshold links.  No rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = _common(docs, size)
    rows = stored(_prefixes(docs, common, size, percent, 1), "prefixes")
    # Classes of equal sets; their smallest document stands for them.
    classes = stored(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("print", "n").agg(F.min("doc_id").alias("cls"), F.count("*").alias("members")), "classes")
    many = stored(classes.where("members > 1").select("print", "cls"), "copies")
    marked = joined(rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "print", "sig", "p"), many, "print", "left", row_bytes=80)
    heads = marked.where("cls IS NULL OR cls = doc_id")
    signed = heads.select(F.col("doc_id").alias("x"), "sig").dropDuplicates(["x"])
    tokens = heads.select(F.explode("p").alias("token"), F.col("doc_id").alias("x"), "n", F.col("doc_id").alias("c"))
    able = stored(_able(tokens, percent).select("token", "x", "n"), "able")
    groups = able.groupBy("token").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("cnt")).where("lo < hi").drop("hi")
    members = stored(able.join(groups, "token"), "members")
    cleared(spark)

    def sized(pairs: DataFrame) -> DataFrame:
        one = members.select("x", "n").distinct()
        return pairs.join(one.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(one.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b").where(_near("na", "nb", percent))

    # Each class against two of each of its groups: the first, and the one that shares most of its prefix with most others.
    # Edited copies of one text may be similar to that text alone, and it shares more than any of them.
    shares = members.groupBy("x").agg((F.sum("cnt") / F.first("n")).alias("share"))
    best = members.select("token", "x").join(shares, "x").groupBy("token").agg(F.max(F.struct("share", F.col("x").alias("y"))).getField("y").alias("y"))
    stars = members.select("x", F.col("lo").alias("y")).union(members.select("token", "x").join(best, "token").select("x", "y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    stars = stored(sized(stars), "stars")
    parts = members.groupBy("x").agg(F.collect_set("token").alias("p"))  # the shared part of a prefix
    likely = stored(_sharing(stars, parts, percent).select("a", "b"), "likely")
    edges = stored(_similar(likely, docs, size, percent), "links")
    cleared(spark)
    label = components(edges).select(F.col("node").alias("x"), F.col("component").alias("c"))
    now = members.select("token", "x", "n").join(label, "x", "left").withColumn("c", F.coalesce("c", "x"))
    left = stored(_able(now, percent), "open")  # what a class shares with its own component alone no longer counts for it
    left = _able(left.drop("held"), percent).drop("held")
    first = stored(_across(left, signed, percent).join(stars, ["a", "b"], "left_anti"), "pairs")
    first = stored(_sharing(first, parts, percent), "pairs")
    if not first.isEmpty():
        some = stored(first.select(F.col("a").alias("doc_id")).union(first.select("b")).distinct(), "open-nodes")
        texts = joined(docs, some, "doc_id", "left_semi", row_bytes=48)
        again = _prefixes(texts, common, size, percent, 2).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("x"), "p")
        met = stored(_sharing(first, stored(again, "second-prefixes"), percent).select("a", "b"), "met")
        edges = edges.union(_similar(met, docs, size, percent))
        label = components(edges).select(F.col("node").alias("x"), F.col("component").alias("c"))
    label = stored(label, "components")
    of_class = classes.join(label.withColumnRenamed("x", "cls"), "cls", "left").select("print", "n", F.coalesce("c", "cls").alias("component_id"))
    found = rows.select("doc_id", "n", "print").join(of_class, ["print", "n"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; rows without a doc_id stay."""
    found = linked(docs, size, percent)
    gone = stored(found.where("component_id < doc_id").select(F.col("doc_id").alias("near_copy")).distinct(), "near-copies")
    names = docs.columns
    inner = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).withColumn("near_copy", F.col(f"c{names.index('doc_id')}").cast("long"))
    left = joined(inner, gone, "near_copy", "left_anti", row_bytes=48)
    return left.select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
