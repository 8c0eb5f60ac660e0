"""Document quality: random-indexing word vectors, pooled, under a two-layer network.

Every word has a sparse random index vector, made from a hash of it; a word's
vector sums the index vectors of its neighbours.  A document is the mean of its
words' vectors, of their shapes' vectors, and how concentrated its words are.  A
two-layer network on numpy scores that, and a temperature fitted on labels the
network has not seen makes its probabilities honest.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hash_sample, id_hash

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Bounds of the model: labelled documents it is fitted on, words with a vector; sizes of vectors and of the hidden layer.
FIT_DOCUMENTS, VOCABULARY, WIDTH, SHAPES, HIDDEN, REACH = 10_000, 15_000, 48, 24, 24, 2
#: Tokens whose row a worker remembers; emptied when full.
CACHE = 200_000


def index_vector(word: str, width: int = WIDTH) -> np.ndarray:
    """Four entries of +1 or -1 at places given by a hash."""
    out = np.zeros(width, dtype=np.float32)
    for k in range(4):
        h = zlib.crc32(f"{k}{word}".encode("utf-8", "surrogatepass"))
        out[(h >> 1) % width] += 1 if h & 1 else -1
    return out


def shape(token: str) -> str:
    if not token[0].isalnum():
        return f"p{min(len(token), 4)}"
    kind = "d" if token.isdigit() else "U" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "l"
    return f"{kind}{min(len(token), 15) // 3}"


@dataclass
class Model:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return 1 / (1 + np.exp(-np.clip((np.tanh((x - self.mean) / self.scale @ a + b) @ c + d) / self.temperature, -30, 30)))


class Pooler:
    """Documents as vectors; rows of words it has seen are remembered."""

    def __init__(self, vocabulary: dict[str, int], vectors: np.ndarray):
        self.vocabulary, self.vectors, self.rows, self.shapes = vocabulary, vectors, {}, {}
        self.shape_vectors = np.zeros((0, SHAPES), dtype=np.float32)

    def _row(self, token: str) -> int:
        """The word's row plus one (0: unknown) and the shape's, in one number."""
        s = shape(token)
        if s not in self.shapes:
            self.shapes[s] = len(self.shapes)
            self.shape_vectors = np.vstack([self.shape_vectors, index_vector(s, SHAPES)])
        return (self.vocabulary.get(token.lower(), -1) + 1) * 64 + self.shapes[s]

    def pool(self, text: str) -> np.ndarray:
        counts = Counter(TOKEN.findall(text))
        n = sum(counts.values())
        if not n:
            return np.zeros(WIDTH + SHAPES + 4, dtype=np.float64)
        if len(self.rows) + len(counts) > CACHE:
            self.rows = {}
        rows = self.rows
        for t in [t for t in counts if t not in rows]:
            rows[t] = self._row(t)
        at = np.fromiter(map(rows.__getitem__, counts), np.int64, len(counts))
        c = np.fromiter(counts.values(), np.float32, len(counts))
        known = at >= 64
        words = c[known] @ self.vectors[(at[known] >> 6) - 1] / n
        shapes = np.bincount(at & 63, c, len(self.shape_vectors)) @ self.shape_vectors / n
        return np.concatenate([words, shapes, [math.log1p(n), len(counts) / n, math.sqrt(float(c @ c)) / n, float(c.max()) / n]])


def _columns(features: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tolist() for x in features], pa.list_(pa.float64()))


def fit(labelled: DataFrame, vocabulary: int = VOCABULARY) -> Model:
    """A model of ``labelled`` (text, label 0 or 1), a bounded table whose texts are not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(t for x in batch.column(0) for t in {w.lower()[:64] for w in TOKEN.findall(x.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    texts = labelled.select("text")
    top = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    words = {r.word: i for i, r in enumerate(top)}
    index = np.stack([index_vector(w) for w in words]) if words else np.zeros((0, WIDTH), dtype=np.float32)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros_like(index)
        for batch in batches:
            for x in batch.column(0):
                ids = np.array([words.get(w.lower(), -1) for w in TOKEN.findall(x.as_py())], dtype=np.int64)
                for k in range(1, REACH + 1):
                    a, b = ids[:-k], ids[k:]
                    both = (a >= 0) & (b >= 0)
                    np.add.at(sums, a[both], index[b[both]])
                    np.add.at(sums, b[both], index[a[both]])
        rows = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sums[rows].tolist(), pa.list_(pa.float32()))], ["word", "v"])

    vectors = index.copy()
    if words:
        got = texts.mapInArrow(neighbours, "word long, v array<float>").groupBy("word").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(WIDTH)]).alias("v")).collect()
        for r in got:
            v = np.array(r.v, dtype=np.float32)
            vectors[r.word] += 2 * v / max(1e-6, float(np.linalg.norm(v)))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(words, vectors)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_columns([pooler.pool(x.as_py()) for x in batch.column(0)]), batch.column(1), batch.column(2)], ["x", "label", "doc_id"])

    rows = labelled.select("text", F.col("label").cast("int").alias("label"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(pooled, "x array<double>, label int, doc_id long").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.x))  # the same order whichever task came first
    x, y = np.array([r.x for r in rows]).reshape(len(rows), WIDTH + SHAPES + 4), np.array([r.label for r in rows], dtype=np.float64)
    return _train(words, vectors, x, y)


def _train(words: dict[str, int], vectors: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 300) -> Model:
    n, width = x.shape
    if not n or y.min() == y.max():  # one label or none: its share is all there is to know
        share = (y.sum() + 0.5) / (n + 1)
        return Model(words, vectors, np.zeros(width), np.ones(width), (np.zeros((width, 1)), np.zeros(1), np.zeros(1), math.log(share / (1 - share))), 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    fitted = np.arange(n) % 5 != 0  # the rest sets the temperature
    draw = np.random.default_rng(7)
    params = [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.array(math.log(y.mean() / (1 - y.mean())))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    a, t = z[fitted], y[fitted]
    for k in range(1, rounds + 1):
        h = np.tanh(a @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        g = (p - t) / len(t)
        back = np.outer(g, params[2]) * (1 - h * h)
        grads = [a.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ g + 1e-4 * params[2], g.sum()]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            params[i] = params[i] - 0.02 * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.999**k)) + 1e-8)
    logits = np.tanh(z[~fitted] @ params[0] + params[1]) @ params[2] + params[3]
    loss = lambda s: np.logaddexp(0, np.where(y[~fitted] > 0, -logits, logits) / s).mean()
    temperature = min(np.geomspace(0.5, 8, 49), key=loss)
    return Model(words, vectors, mean, scale, (params[0], params[1], params[2], float(params[3])), float(temperature))


def score(docs: DataFrame, model: Model, held_out: Column, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens of every row, over whole texts.

    ``docs`` needs doc_id and text; other columns are not read.  A null text
    counts as empty, and an empty one has the vector 0 and a score like any
    other.  Repeated rows are scored each; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pooler = Pooler(model.vocabulary, model.vectors)
        for batch in batches:
            x = np.array([pooler.pool(t.as_py() or "") for t in batch.column(2)]).reshape(len(batch), -1)
            p = model.probability(x) if len(x) else np.zeros(0)
            tokens = np.rint(np.expm1(x[:, WIDTH + SHAPES])).astype(np.int64) if len(x) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32()), pa.array(tokens, pa.int64())], ["doc_id", "held_out", "score", "predicted", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_tokens long")


def fit_from(docs: DataFrame, labels: DataFrame, held_out: Column, max_documents: int = FIT_DOCUMENTS) -> Model:
    """A model of at most about ``max_documents`` labelled rows that are not held out."""
    chosen = hash_sample(labels.where(F.col("quality").isNotNull() & ~held_out), "doc_id", max_documents).select("doc_id", F.col("quality").cast("int").alias("label"))
    return fit(docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id"))  # bounded by max_documents


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = id_hash() % 3 == 1
    return score(docs, fit_from(docs, labels, held_out), held_out)
