"""Benchmark decontamination by word windows.

The windows (n-grams) of all benchmark items become a hash set that is sent to
every worker; training texts are scanned window by window, a hash that hits is
verified word by word, and hit spans or whole documents are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import only, sliced, stored

WINDOW = 10
#: Words of benchmark items that are sent to the workers at once; a larger benchmark is scanned for in blocks of items.
BLOCK_WORDS = 1_500_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered, as UTF-8: bytes from 0x80 on are never borders."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive ids."""
    out = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out * _BASE + ids[j : j + len(out)].astype(np.uint64)
    return out


@dataclass
class Index:
    """Windows of the items, by length k: sorted hashes, their words' ids, and the items that have them (CSR)."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    items: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, str | None]], n: int) -> Index:
        vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[tuple, set[int]]] = {}
        items = sorted({i for i, _ in rows})
        at = {x: k for k, x in enumerate(items)}
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            if k := min(n, len(ids)):
                for i in range(len(ids) - k + 1):
                    windows.setdefault(k, {}).setdefault(tuple(ids[i : i + k]), set()).add(at[item])
        by_length = {}
        for k, found in windows.items():
            ids = np.array(list(found), dtype=np.int64).reshape(-1, k)
            hashes = np.zeros(len(ids), dtype=np.uint64)
            for j in range(k):
                hashes = hashes * _BASE + ids[:, j].astype(np.uint64)
            order = np.argsort(hashes, kind="stable")
            owners = [sorted(x) for x in found.values()]
            flat = np.array([x for i in order for x in owners[i]], dtype=np.int64)
            ends = np.cumsum([len(owners[i]) for i in order])
            by_length[k] = (hashes[order], ids[order], flat, ends)
        return cls(vocabulary, by_length, items)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Which words lie in an occurrence of a window (None: none does), and the items found."""
        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, n)
        hit, items = None, set()
        foreign = np.concatenate(([0], np.cumsum(ids == 0)))
        for k, (hashes, windows, flat, ends) in self.by_length.items():
            if n < k:
                continue
            starts = np.flatnonzero(foreign[k:] == foreign[:-k])  # windows of benchmark words alone
            if not len(starts):
                continue
            own = rolling(ids, k)[starts]
            first, last = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for s, a, b in zip(*(x[first < last] for x in (starts, first, last)), strict=True):
                for c in range(a, b):
                    if (ids[s : s + k] == windows[c]).all():
                        if hit is None:
                            hit = np.zeros(n, dtype=bool)
                        hit[s : s + k] = True
                        items.update(flat[ends[c - 1] if c else 0 : ends[c]].tolist())
        return hit, items


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between words of one span."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(data.lower())]
    out, end = [], 0
    for a, b in spans:
        out.append(data[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, data[end:]]).decode("utf-8", "surrogatepass")


_SCANNED = "n_words long, spans array<struct<first: int, behind: int>>, items array<string>"


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` (doc_id, text, and spans and items of earlier blocks) with this block's added."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("behind", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text, old_spans, old_items in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = words_of(text.as_py())
                hit, found = index.scan(words) if words else (None, set())
                if old := old_spans.as_py():
                    hit = np.zeros(len(words), dtype=bool) if hit is None else hit
                    for x in old:
                        hit[x["first"] : x["behind"]] = True
                n_words.append(len(words))
                spans.append([] if hit is None else [{"first": a, "behind": b} for a, b in spans_of(hit)])
                items.append(sorted({*(old_items.as_py() or []), *(index.items[i] for i in found)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

    return docs.select("doc_id", "text", "spans", "items").mapInArrow(run, f"doc_id long, text string, {_SCANNED}")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, n_words, spans of hit words (from, behind), items found, of every row.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; no other
    column is read.  A null text has no words.  The benchmark is measured first:
    up to ``block_words`` words go to the workers at once, a larger one in
    blocks of items, one scan each.  Items of fewer than ``n`` words are one
    window; of none, no window.  Repeated rows and items change nothing, and
    long texts are scanned whole.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))  # at six bytes a word
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns({"spans": F.expr("CAST(array() AS array<struct<first: int, behind: int>>)"), "items": F.expr("CAST(array() AS array<string>)")})
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        out = _scan(out if k == 0 else stored(out, "scanned"), Index.of([(r.item_id, r.text) for r in rows], n))
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    See scan() for nulls, ties and the like; an empty table gives no rows, and
    an empty benchmark hits nothing.
    """
    found = scan(docs, benchmark, n, block_words)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["behind"] - x["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id and text of every row, the hit words cut out; a null text stays null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_words(t, [(x["first"], x["behind"]) for x in s]) if s else t for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return scan(docs, benchmark, n).select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, text string")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window, all columns kept."""
    names, kind = docs.columns, docs.schema
    spark = docs.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).where("text IS NOT NULL")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * BLOCK_WORDS)))
    at = names.index("text")
    out = docs
    for k in range(blocks):
        part = [tuple(r) for r in rows.where(F.pmod(F.xxhash64(rows.columns[0]), F.lit(blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(Index.of(part, n))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            only("decontamination")
            index = shared.value
            for batch in (part for whole in batches for part in sliced(whole, at)):
                yield batch.filter(pa.array([index.scan(words_of(t.as_py()))[0] is None for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(clean, kind)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


OP4_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bench AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM bench WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT k FROM windows), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM lowered, lengths WHERE len(w) >= k)
), hits AS (SELECT doc_id, k, i, item_id FROM grams JOIN windows USING (k, gram)
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT l.doc_id, len(l.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN words USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
