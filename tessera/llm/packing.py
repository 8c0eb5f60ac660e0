"""Best-fit-decreasing packing of token sequences.

Overlong documents are cut into full windows first.  What is left of every
document, its tail, is shorter than a window; tails are packed best fit
decreasing: longest first, each into the open window with the least room that
still holds it.

Which window a tail goes to depends on its length alone, so the packing is
planned over the *histogram* of tail lengths (at most ``window - 1`` numbers,
whatever the size of the corpus).  The plan runs the algorithm for all tails
of one length at once and keeps windows of equal room as ranges of ids; a
segment tree indexed by remaining room finds the tightest open window.  Tails
then find their window by their rank among the tails of their length, which
is counted in hash buckets, so no task holds all tails of a frequent length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import joined, kept, sliced, stored

WINDOW = 2048
#: Entries of each of a worker's two caches; the first half of them stays when one is full.
CACHE = 260_000
#: What str.split takes for white space and the tokenizer does not.
_ODD_SPACE = frozenset("\x1c\x1d\x1e\x1f")
#: A run of letters that lower-case one to one, then punctuation other than the apostrophe: two tokens before merging.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The letters above ASCII as the vocabulary writes their UTF-8 bytes: 0xC3 as Ã, 0x80-0xA0 and 0xAD from Ģ (U+0122) on.
_SHIFTED = [*range(0x80, 0xA1), 0xAD]
_BYTES = {c: "".join(chr(0x122 + _SHIFTED.index(b)) if b in _SHIFTED else chr(b) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    The vocabulary's rules never reach across white space, so the ids of a text
    are the ids of its white-space chunks in order.  Chunks recur; their ids
    are looked up.  New chunks of the plain form are looked up again as word and
    punctuation, and only what is still new goes through the tokenizer.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.chunks, self.words = Tokenizer.from_file(path), cache, {}, {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, runs: list[str]) -> list[bytes]:
        """Ids of single runs of lower-case letters or of punctuation: only the merges are left to do."""
        merge = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in merge(x if x.isascii() else x.translate(_BYTES))]).tobytes() for x in runs]

    def _known(self, kept: dict, keys: set[str], find) -> dict:
        """``kept`` with all of ``keys``; full, it keeps its oldest entries, which frequent keys are among."""
        if new := list(keys.difference(kept)):
            if len(kept) + len(new) > self.cache:
                kept = dict(islice(kept.items(), self.cache // 2))
                new = list(keys.difference(kept))
            kept.update(zip(new, find(new), strict=True))
        return kept

    def _chunks(self, new: list[str]) -> list[bytes]:
        parts = [(m[1].lower(), m[2]) if (m := _PLAIN.fullmatch(c)) else None for c in new]
        self.words = at = self._known(self.words, {x for p in parts if p for x in p if x}, self._merged)
        return [self._ids(c) if p is None else at[p[0]] + at[p[1]] if p[1] else at[p[0]] for c, p in zip(new, parts, strict=True)]

    def encode(self, text: str) -> bytes:
        if not _ODD_SPACE.isdisjoint(text):
            return self._ids(text)
        out, chunks = [], text.split()
        for at in range(0, len(chunks), 50_000):
            part = chunks[at : at + 50_000]
            self.chunks = self._known(self.chunks, set(part), self._chunks)
            out.append(b"".join(map(self.chunks.__getitem__, part)))
        return b"".join(out)


def encoder_of(path: str) -> Encoder:
    """A worker's encoder: the next task it runs finds the caches warm."""
    return kept(f"encoder of {path}", lambda: Encoder(path))


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Each document's ids, with ``end_id`` behind them, cut into full windows and a tail."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), end_id.to_bytes(4, "little")
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        for batch in (part for whole in batches for part in sliced(whole, 1)):
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                n, doc_id = len(ids) // 4, doc_id.as_py()
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
                if len(rows) >= 50_000:
                    yield flush()
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class RoomTree:
    """Segment tree over 0..window: where a leaf counts the open windows with that room."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.sums[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open window has."""
        at = need + self.size
        if self.sums[at]:
            return need
        while at > 1:
            if not at & 1 and self.sums[at + 1]:  # a left child whose right sibling has some
                at += 1
                while at < self.size:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit decreasing over a histogram of lengths below ``window``.

    Returns rows (length, first rank, ranks, first window, a window's share,
    offset there) and the number of windows.  The item of rank r, of n = ranks
    from first rank, lies in window ``first window + (r - first rank) // share``
    at ``offset + (r - first rank) % share * length``.
    """
    tree, rooms, plan, opened = RoomTree(window), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, share = window, window // length
                first, there = opened, -(-left // share)
                opened += there
            else:
                first, there = rooms[room].pop()
                tree.add(room, -there)
            share = room // length
            used = min(there, left // share)  # windows that get their full share
            taken = used * share
            rest = 0
            if used < there and left > taken:  # one more gets what is left
                rest = left - taken
            for at, n, each in ((first, used, share), (first + used, int(rest > 0), rest)):
                if n:
                    plan.append((length, rank, n * each, at, each, window - room))
                    rank += n * each
                    if kept := room - each * length:
                        rooms.setdefault(kept, []).append((at, n))
                        tree.add(kept, n)
            left -= taken + rest
            unused = there - used - (rest > 0)
            if unused:
                rooms.setdefault(room, []).append((first + used + (rest > 0), unused))
                tree.add(room, unused)
    return plan, opened


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """Pieces of all documents with the sequence and the offset they are packed to.

    ``docs`` needs doc_id and text; other columns are not read.  A null text is
    empty, and an empty document is the single id ``end_id``.  Long texts are
    cut, never dropped.  Repeated rows are packed as often as they come; equal
    lengths are ranked by bucket, doc_id, start and checksum.  No documents, no
    rows.  A tail of a full window (exactly ``window`` ids) is a sequence alone.
    """
    spark = docs.sparkSession
    pieces = stored(pieces_of(docs, tokenizer, end_id, window), "pieces")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = stored(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    full = lengths.pop(window, 0)
    plan, _ = best_fit_plan(lengths, window)
    plan.append((window, 0, full, -full, 1, 0))  # full windows come before the others
    # Tails of one length are one run of ranks per plan row: split at bucket borders by a range join on a few rows a length.
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked"))
    # As an Arrow table: rows of Python would start Python workers of another kind on every executor.
    names = ["length", "first_rank", "ranks", "first_sequence", "share", "at"]
    table = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*plan, strict=True)], names=names))
    runs = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "ranks", "first_sequence", "share", "at"))).alias("runs"))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = joined(dealt.withColumn("k", F.row_number().over(within) - 1), stored(starts, "starts"), ["length", "bucket"], "inner", row_bytes=64)
    ranked = (
        ranked.withColumn("rank", F.col("ranked") + F.col("k"))
        .join(F.broadcast(runs), "length")  # at most `window` rows with few runs each
    )
    run = F.element_at(F.filter("runs", lambda r: (r["first_rank"] <= F.col("rank")) & (F.col("rank") < r["first_rank"] + r["ranks"])), 1)
    placed = ranked.withColumn("run", run).withColumn("j", F.col("rank") - F.col("run.first_rank"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("run.first_sequence") + F.floor(F.col("j") / F.col("run.share")) + full).cast("long").alias("sequence_id"),
        (F.col("run.at") + F.pmod("j", F.col("run.share")) * F.col("length")).cast("long").alias("offset"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
