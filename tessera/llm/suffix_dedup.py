"""Removal of repeated byte strings by distributed prefix doubling.

Positions get *names* for the string of k bytes that starts there.  Names of 2k
bytes come from pairs of names of k bytes at offset k, as in prefix doubling.
Texts lie whole in a row, so the first rounds (1, 2, 4, 8, 16 and 24 bytes) are
named where the text is.  Then names are sorted across documents, and positions
whose names are of one document alone go; only the rest go on to the round of
the threshold.

Sorting all positions of a corpus costs a row a byte.  Instead, one position
stands for a run of neighbours: of every window of the threshold's length, the
least of its 24-byte names.  That depends on the window's bytes alone, so equal
windows anywhere choose equal names, and a run of windows that choose the same
is one row: about one in fourteen bytes.  A row also names the whole stretch its
windows cover.  Per name, over all documents:

* of one document only: no window of the run is repeated;
* the same stretch in a smaller document: all windows are repeated;
* else, if the name has other stretches too: its windows go on to the last
  round, which names them one by one by 128 bits and sorts them.

A task thins its rows before they are sent: of equal stretches only those of
the smallest document go out, so the sorted groups shrink with the tasks.

Equal names only say where to look: every byte that goes is compared with the
bytes of the smaller document, within the task that thinned it or, when names
met across tasks, by sending the smaller document's passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chosen, joined, only, release, rows_by_bytes, sliced, stored, texts_of

LENGTH, NAME = 50, 24
#: Rows that a task gathers before it thins and sends them; bytes of text that are named at once (longer texts in slices).
ROWS, BLOCK = 250_000, 1 << 18
#: Bytes of text whose rows are sorted together.
PART_BYTES = 8 << 20
#: Passages that are asked of one document are dealt to so many rows at most.
SALT = 16
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _letters(seed: int) -> np.ndarray:
    return _mixed(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=np.uint64) * _BASE)


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    """For all places of a block."""
    out = np.full(2 * BLOCK, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def paired(names: np.ndarray, offset: int) -> np.ndarray:
    """The next round: a name for every pair of names at the offset."""
    return _mixed(names[: len(names) - offset] * _BASE + names[offset:])


def names_of(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Names of all strings of ``length`` bytes, by doubling; the last offset fills up to the length."""
    out, k = _letters(seed)[data], 1
    while 2 * k <= length:
        out, k = paired(out, k), 2 * k
    return paired(out, length - k) if k < length else out


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    out, k = values, 1
    while 2 * k <= width:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    return np.minimum(out[: len(out) - (width - k)], out[width - k :]) if k < width else out


def runs_of(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, name: int = NAME, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Runs of windows of a block's segments that choose the same name: segment, names, names of the stretches, first and last window."""
    names = names_of(data, name, seed)
    chosen = least_in_window(names, length - name + 1)
    behind = np.concatenate((starts[1:], [len(data)])) - length + 1  # each segment's last window; what comes next crosses into another
    edge = np.ones(len(chosen) + 1, dtype=bool)
    edge[1:-1] = chosen[1:] != chosen[:-1]
    edge[starts] = edge[behind] = True
    edges = np.flatnonzero(edge)
    first, last = edges[:-1], edges[1:] - 1
    segment = np.searchsorted(starts, first, "right") - 1
    own = first < behind[segment]
    segment, first, last = segment[own], first[own], last[own]
    up, down = _powers(int(_BASE)), _powers(int(_INVERSE))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(names * up[: len(names)])))
    stretch = (sums[last + length - name + 1] - sums[first]) * down[first] + (last - first).astype(np.uint64)
    return segment, chosen[first], _mixed(stretch), first, last


def blocks_of(at: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Neighbouring texts of ``block`` bytes together, or slices of a longer one that share no window: bytes from and to, the segments' places in them and rows, and the slice's place in its text."""
    for first, last in rows_by_bytes(at, block):
        low, high = int(at[first]), int(at[last])
        if high - low > block:  # of one text
            for base in range(0, high - low - length + 1, block):
                yield low + base, min(high, low + base + block + length - 1), np.zeros(1, np.int64), np.array([first]), base
        else:
            yield low, high, at[first:last] - low, np.arange(first, last), 0


def _packed(columns: list[np.ndarray]) -> bytes:
    """Rows as bytes: keys as they are (they do not shrink), documents and windows as compressed differences."""
    name, stretch, doc, first, last = columns
    places = np.concatenate([np.diff(doc, prepend=0), first.astype(np.int64), (last - first).astype(np.int64)]).astype("<i8")
    # Byte planes: the high bytes are nearly all zero.
    small = zstandard.ZstdCompressor(level=1).compress(places.view(np.uint8).reshape(-1, 8).T.tobytes())
    keys = b"" if not name.any() else name.astype("<u8").tobytes() + stretch.astype("<u8").tobytes()
    return np.array([len(doc), len(keys)], dtype="<i8").tobytes() + keys + small


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    parts = []
    for blob in blobs:
        n, size = (int(x) for x in np.frombuffer(blob, "<i8", 2))
        keys = np.frombuffer(blob, "<u8", 2 * n, 16) if size else np.zeros(2 * n, dtype=np.uint64)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16 + size :], max_output_size=24 * n), np.uint8)
        doc, first, length = np.split(np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel(), 3)
        parts.append((keys[:n], keys[n:], np.cumsum(doc), first, first + length))
    return [np.concatenate([p[i] for p in parts]) for i in range(5)]


def _sorted(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows by (first key, second key, document); which start a first key; which start both."""
    order = np.lexsort((cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    one = np.concatenate(([True], cols[0][1:] != cols[0][:-1]))
    return cols, one, one | np.concatenate(([True], cols[1][1:] != cols[1][:-1]))


def _group_first(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each row's group's first value."""
    return values[np.flatnonzero(starts)[np.cumsum(starts) - 1]]


_SENT = "part int, known boolean, blob binary"


def _alike(data: bytes, at: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each pair of places whether the bytes there are the same; neighbours are compared together."""
    if not len(at):
        return np.zeros(0, dtype=bool)
    order = np.argsort(at, kind="stable")
    a, b, n = at[order], other[order], size[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] > a[:-1] + n[:-1]) | (b[1:] - a[1:] != b[:-1] - a[:-1]))))
    end = np.concatenate((new[1:], [len(a)])) - 1
    width = np.maximum.reduceat(a + n, new) - a[new]
    view = memoryview(data)
    same = np.fromiter((view[x : x + k] == view[y : y + k] for x, y, k in zip(a[new].tolist(), b[new].tolist(), width.tolist(), strict=True)), bool, len(new))
    out = np.empty(len(a), dtype=bool)
    out[order] = np.repeat(same, end - new + 1)
    return out


def _send(cols: list[np.ndarray], parts: int, at: np.ndarray, data: bytes, length: int) -> Iterator[pa.RecordBatch]:
    """Rows thinned and dealt to ``parts``: of equal keys the smallest document's; the others, if their bytes (at ``at``) are the same, are known to repeat."""
    order = np.lexsort((cols[2], cols[1], cols[0]))
    ordered = [c[order] for c in cols[:3]]
    both = np.concatenate(([True], (ordered[0][1:] != ordered[0][:-1]) | (ordered[1][1:] != ordered[1][:-1])))
    later = np.flatnonzero(_group_first(both, ordered[2]) != ordered[2])  # of a larger document than the group's first
    size = (cols[4] - cols[3] + length)[order]
    leader = _group_first(both, np.arange(len(order)))[later]
    later = later[_alike(data, at[order][later], at[order][leader], size[later]) & (size[later] == size[leader])]
    lead = np.ones(len(order), dtype=bool)
    lead[order[later]] = False
    for known in (False, True):  # in the order of the texts, in which places shrink well
        rows = [c[lead != known] for c in cols]
        if known:  # nothing but their place is needed, and any task will do
            part = (rows[2] % parts).astype(np.int64)
            rows = [np.zeros(len(part), np.uint64), np.zeros(len(part), np.uint64), *rows[2:]]
        else:
            part = (_mixed(rows[0].copy()) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [c[order] for c in rows]
        for k in np.flatnonzero(np.diff(bounds)):
            blob = _packed([c[bounds[k] : bounds[k + 1]] for c in rows])
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([known]), pa.array([blob], pa.binary())], ["part", "known", "blob"])


def _gather(batches: Iterator[pa.RecordBatch], rows_of, parts: int, length: int) -> Iterator[pa.RecordBatch]:
    """Rows of the blocks of texts, sent when there are ROWS of them; ``rows_of`` gives segment, two names, first and last window in the block."""
    only("suffix dedup")
    rows: list[tuple[np.ndarray, ...]] = []
    held: list[bytes] = []
    n = size = 0

    def send() -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate([r[i] for r in rows]) for i in range(6)]
        return _send(cols[:5], parts, cols[5], b"".join(held), length)

    for batch in batches:
        data, at = texts_of(batch.column(1))
        docs = batch.column(0).to_numpy()
        for low, high, starts, which, base in blocks_of(at, length):
            block = data[low:high]
            segment, name, stretch, first, last = rows_of(batch, block, starts, which, base)
            if not len(name):
                continue
            shift = base - starts[segment]
            rows.append((name, stretch, docs[which[segment]], first + shift, last + shift, first + size))
            held.append(block.tobytes())
            n, size = n + len(name), size + len(block)
            if n >= ROWS:
                yield from send()
                rows, held, n, size = [], [], 0, 0
    if rows:
        yield from send()


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its open runs in order, as compressed steps and window counts."""
    for batch in batches:
        out = []
        for first, last in zip(batch.column(1), batch.column(2), strict=True):
            a, b = first.values.to_numpy().astype(np.int64), last.values.to_numpy().astype(np.int64)
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))  # rows that repeat a document repeat its runs
            a, b = a[new], b[new]
            out.append(zstandard.ZstdCompressor(level=3).compress(np.concatenate([np.diff(a, prepend=0), b - a + 1]).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "open"])


_FOUND = "doc_id long, first int, last int, repeated boolean, source long, at int"


def _found(doc: np.ndarray, first: np.ndarray, last: np.ndarray, repeated: bool, source: np.ndarray | None = None, at: np.ndarray | None = None) -> pa.RecordBatch:
    """``at`` is where the smaller document ``source`` has the same, or -1 where nothing is left to compare."""
    source, at = (np.zeros(len(doc), np.int64), np.full(len(doc), -1)) if source is None else (source, at)
    longs = [pa.array(doc.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(np.full(len(doc), repeated)), pa.array(source.astype(np.int64)), pa.array(at.astype(np.int32))]
    return pa.RecordBatch.from_arrays(longs, ["doc_id", "first", "last", "repeated", "source", "at"])


def _settle(open_rows: bool):
    """A task's parts, which come sorted, one after the other: which runs repeat and, with ``open_rows``, which are left open."""

    def settled(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        cols, one, both = _sorted(_unpacked(blobs))
        least = _group_first(both, cols[2])
        lead = least == cols[2]
        yield _found(cols[2][~lead], cols[3][~lead], cols[4][~lead], True, least[~lead], _group_first(both, cols[3])[~lead])
        if open_rows:
            at = np.flatnonzero(one)
            group = np.cumsum(one) - 1
            shared = np.minimum.reduceat(cols[2], at) != np.maximum.reduceat(cols[2], at)
            several = np.add.reduceat(both.astype(np.int64), at) > 1
            left = lead & (shared & several)[group]
            yield _found(cols[2][left], cols[3][left], cols[4][left], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for part, known, blob in zip(*batch.columns, strict=True):
                if known.as_py():
                    cols = _unpacked([blob.as_py()])
                    yield _found(cols[2], cols[3], cols[4], True)
                    continue
                if part.as_py() != now and blobs:
                    yield from settled(blobs)
                    blobs = []
                now = part.as_py()
                blobs.append(blob.as_py())
        if blobs:
            yield from settled(blobs)

    return run


def _places(first: np.ndarray, n: np.ndarray, low: int, high: int) -> np.ndarray:
    """All of the ranges that start at ``first`` and have ``n`` places, within low and high."""
    a, b = np.maximum(first, low), np.minimum(first + n, high)
    a, n = a[b > a], (b - a)[b > a]
    return np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(a) else np.zeros(0, np.int64)


_SPANS = "doc_id long, starts array<int>, ends array<int>, claims array<struct<source: long, at: int, first: int, n: int>>"


def _spans(length: int):
    """Runs of each document, in one list, as maximal spans of bytes, and what of them is still to be compared with which bytes of a smaller document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy())
            first, last, source, at = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in ("first", "last", "source", "at"))
            order = np.lexsort((first, row))
            row, first, last, source, at = (x[order] for x in (row, first, last, source, at))
            # Places of all rows on one line, a row's behind those of the row before.
            low, high = (row << 33) + first, np.maximum.accumulate((row << 33) + last + length)
            new = np.concatenate(([True], low[1:] > high[:-1]))
            ends = high[np.concatenate((np.flatnonzero(new)[1:], [len(low)])) - 1] - (row[new] << 33)
            counts = lambda r: pa.array(np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(lists))))), pa.int32())
            offsets = counts(row[new])
            open_ = at >= 0
            row, first, last, source, at = (x[open_] for x in (row, first, last, source, at))
            joint = np.ones(len(row), dtype=bool)
            joint[1:] = (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (first[1:] > last[:-1] + 1) | (at[1:] - first[1:] != at[:-1] - first[:-1])
            begin = np.flatnonzero(joint)
            n = np.maximum.reduceat(last, begin) - first[begin] + length if len(begin) else np.zeros(0, np.int64)
            parts = [pa.array(source[begin], pa.int64()), pa.array(at[begin], pa.int32()), pa.array(first[begin], pa.int32()), pa.array(n, pa.int32())]
            claims = pa.ListArray.from_arrays(counts(row[begin]), pa.StructArray.from_arrays(parts, ["source", "at", "first", "n"]))
            lists_of = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of(low[new] - (np.repeat(np.arange(len(lists)), np.diff(offsets.to_numpy())) << 33)), lists_of(ends), claims], ["doc_id", "starts", "ends", "claims"])

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that are asked of each document."""
    for batch in batches:
        for doc, text, asked in zip(*batch.columns, strict=True):
            text, asked = text.as_py(), asked.as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc.as_py()] * len(asked), pa.int64()), pa.array([x["at"] for x in asked], pa.int32()), pa.array([x["n"] for x in asked], pa.int32()), pa.array([text[x["at"] : x["at"] + x["n"]] for x in asked], pa.binary())],
                ["source", "at", "n", "passage"],
            )


def repeats(docs: DataFrame, length: int = LENGTH, parts: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, starts, ends: the maximal byte runs of each document that strings of ``length`` bytes of smaller documents cover; claims: passages (first, bytes) that have to be there for it."""
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    short = min(NAME, length)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gather(batches, lambda batch, block, starts, which, base: runs_of(block, starts, length, short, seed), parts, length)

    def dealt(sent: DataFrame) -> DataFrame:
        return sent.repartition(parts, "part").sortWithinPartitions("part")

    settled = stored(dealt(texts.mapInArrow(runs, _SENT)).mapInArrow(_settle(True), _FOUND), "runs")
    release(spark)
    left = stored(settled.where("NOT repeated").groupBy("doc_id").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last")).mapInArrow(_ranges, "doc_id long, open binary"), "open")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(batch: pa.RecordBatch, block: np.ndarray, starts: np.ndarray, which: np.ndarray, base: int):
            behind = np.concatenate((starts[1:], [len(block)])) - length + 1 - starts
            at, segment = [], []
            for k, row in enumerate(which):
                first, n = np.split(np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(2)[row].as_py()), "<u4").astype(np.int64), 2)
                own = _places(np.cumsum(first), n, base, base + int(behind[k])) - base + starts[k]
                at.append(own)
                segment.append(np.full(len(own), k))
            at, segment = np.concatenate(at), np.concatenate(segment)
            return segment, names_of(block, length, 2 * seed)[at], names_of(block, length, 2 * seed + 1)[at], at, at

        return _gather(batches, rows_of, parts, length)

    row = 64 + int((left.agg(F.avg(F.octet_length("open"))).first()[0] or 0) + 1)
    last = joined(texts, left, "doc_id", "inner", row_bytes=row).select("doc_id", "text", "open").mapInArrow(windows, _SENT)
    ends = stored(dealt(last).mapInArrow(_settle(False), _FOUND), "windows")
    del last
    release(spark)
    covered = settled.where("repeated").unionByName(ends).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "source", "at")).alias("runs"))
    spans = stored(covered.mapInArrow(_spans(length), _SPANS), "spans")
    release(spark)
    # The same passage may be asked of a document by many others, and many passages of one document: each goes once, in several lists.
    claims = spans.select("doc_id", F.inline("claims"))
    wanted = claims.groupBy("source", "at", "n").agg(F.lit(1)).groupBy("source", F.pmod(F.xxhash64("at", "n"), F.lit(SALT)).alias("salt")).agg(F.collect_list(F.struct("at", "n")).alias("asked"))
    wanted = stored(wanted.select(F.col("source").alias("doc_id"), "asked"), "asked")
    # What is asked grows with the texts, so the two meet by a shuffle at every size.
    once = texts.dropDuplicates(["doc_id"]) if _repeated(texts) else texts
    passages = stored(once.hint("merge").join(wanted, "doc_id").select("doc_id", "text", "asked").mapInArrow(_passages, "source long, at int, n int, passage binary"), "passages")
    there = claims.hint("merge").join(passages, ["source", "at", "n"]).groupBy("doc_id").agg(F.collect_list(F.struct("first", "passage")).alias("claims"), F.count("*").alias("found"))
    out = spans.select("doc_id", "starts", "ends", F.size("claims").alias("asked")).join(there, "doc_id", "left")
    out = stored(out.select("doc_id", "starts", "ends", "asked", F.coalesce("found", F.lit(0)).alias("found"), "claims"), "checked")
    release(spark)
    return out


def _repeated(texts: DataFrame) -> bool:
    """Whether a doc_id comes twice."""
    return not texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def cut(docs: DataFrame, length: int = LENGTH, texts: bool = False, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept (bytes).

    ``docs`` needs doc_id and text; other columns are not read.  A null text is
    empty; texts shorter than ``length`` bytes and rows without a doc_id stay
    whole, and take part in no match.  doc_id names a text: rows that repeat an
    id and its text are cut alike and do not match each other.  Strings are
    judged on the input, whole, so of equal passages the one of the smallest
    doc_id stays, also when what surrounds it goes.  No rows give no rows.
    What goes is compared byte by byte; a clash of names (``seed`` chooses them)
    is an error, never a wrong result.
    """
    docs = chosen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = repeats(docs, length, seed=seed)
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).hint("merge").join(spans, "doc_id", "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, 1)):
            out = []
            for text, starts, ends, claims, asked, found in zip(*batch.columns[1:], strict=True):
                text, a, b = text.as_py(), starts.as_py() or [], ends.as_py() or []
                claims = claims.as_py() or []
                if (asked.as_py() or 0) != (found.as_py() or 0) or any(text[c["first"] : c["first"] + len(c["passage"])] != c["passage"] for c in claims):
                    raise ValueError("two different strings have one name; cut() has to be called with another seed")
                kept = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)) if a else text
                out.append((len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), *[kept] * texts))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            cols = list(zip(*out, strict=True)) or [()] * (4 + texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts])

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return marked.select("doc_id", "text", "starts", "ends", "claims", "asked", "found").mapInArrow(keep, kind)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(spark.read.parquet(f"{sf_dir}/documents.parquet"))
