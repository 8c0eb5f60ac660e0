"""Toxicity by a weighted lexicon.

Texts are folded first: case, homoglyphs of other scripts, accents and digits
or signs that stand for letters.  An Aho-Corasick automaton over the folded
text finds lexicon words and exception phrases in one pass; a lexicon word
inside an exception phrase does not count.  The weights found are summed and
divided by the words of the text, and a logistic curve makes a probability of it.

Lexicon, weights, exceptions and curve are all learned from labelled texts.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chosen, hash_sample, id_hash, only, sliced

#: Signs read as letters, and letters of other scripts that look like Latin ones.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
}
#: Bounds of the model: labelled documents it is fitted on, lexicon words, exception phrases.
FIT_DOCUMENTS, LEXICON, EXCEPTIONS = 20_000, 2_000, 2_000
#: Lengths of the word beginnings that may be lexicon entries too, written with a star.
BEGINNINGS = (5, 7)
#: Words without a match that every text is taken to have besides its own, so that one match in a few words is no high density.
EASE = 50


class _Fold(dict):
    """A table for str.translate that works out characters as they come: a letter's folded form, else a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        out = "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        out = "".join(HOMOGLYPHS.get(x, x) for x in out if x.isalpha()) or ("" if unicodedata.category(chr(code)) in ("Cf", "Mn", "Me") else " ")
        if len(self) < 70_000:
            self[code] = out
        return out


FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words between single spaces, one space before and one behind.

    Signs count as letters only inside a word, next to a letter on both sides
    or at a border of a chunk that has letters; plain numbers and punctuation
    stay out.
    """
    words = []
    for chunk in text.split():
        if not chunk.isalpha():
            core = chunk.strip(".,;:!?\"'()[]{}*#&%|-_+=<>/\\~`^")
            if any(c.isalpha() for c in core):
                core = "".join(SIGNS.get(c, c) for c in core)
            chunk = core
        words.append(chunk)
    return f" {' '.join(' '.join(words).translate(FOLD).split())} "


@dataclass
class Model:
    """weights by lexicon word, or by beginning of words with a star behind; exceptions: phrases of two words; score = 1 / (1 + exp(-(slope * strength + level)))."""

    weights: dict[str, float]
    exceptions: list[str]
    slope: float
    level: float


def automaton(model: Model):
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, weight in model.weights.items():
        found.add_word(f" {word[:-1]}" if word[-1] == "*" else f" {word} ", (len(word) - (word[-1] == "*"), weight))
    for phrase in model.exceptions:
        found.add_word(f" {phrase} ", (len(phrase), None))
    if len(found):
        found.make_automaton()
    return found if len(found) else None


def entries(text: str) -> set[str]:
    """What of a text may be in a lexicon: its folded words and their beginnings."""
    words = {*fold(text).split()}
    return words.union(*({f"{w[:k]}*" for w in words if len(w) >= k} for k in BEGINNINGS))


def strength(text: str, found) -> tuple[float, int, int]:
    """Weight in a hundred words of the text on a log scale, lexicon words found, words in all."""
    folded = fold(text)
    n = folded.count(" ") - 1
    if found is None or n < 1:
        return 0.0, 0, max(0, n)
    # A word is matched with its spaces, and the next may share one: iter reports overlapping matches.
    spans, words = [], []
    for end, (length, weight) in found.iter(folded):
        (spans.append((end - length, end)) if weight is None else words.append((end - length + (folded[end] != " "), end, weight)))
    if spans:
        words = [w for w in words if not any(a <= w[0] and w[1] <= b for a, b in spans)]
    total = sum(w for _, _, w in words)
    return math.log1p(100 * total / (n + EASE)), len(words), n


def fit(labelled: DataFrame, lexicon: int = LEXICON, exceptions: int = EXCEPTIONS) -> Model:
    """A model of ``labelled`` (text, label 0 or 1), a bounded table.

    Spark counts in how many texts of either label each folded word and each
    pair of words stands; the driver gets the words that lean to label 1.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                seen[label.as_py()].update(entries(text.as_py()))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[0][k] for k in keys], pa.int64()), pa.array([seen[1][k] for k in keys], pa.int64())], ["word", "clean", "toxic"])

    labelled = labelled.where(F.col("text").isNotNull())
    n = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n1:
        return Model({}, [], 0.0, -4.0)
    if not n0:
        return Model({}, [], 0.0, 4.0)
    counts = labelled.select("text", "label").mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lean = F.log((F.col("toxic") + 0.25) / (n1 + 0.5)) - F.log((F.col("clean") + 0.25) / (n0 + 0.5))
    # Evidence: the log odds less two standard errors, so words seen once or twice stay out.
    sure = lean - 2 * F.sqrt(1 / (F.col("toxic") + 0.25) + 1 / (F.col("clean") + 0.25) * (F.col("clean") > 0).cast("int"))
    top = counts.where(F.col("toxic") >= max(2, n1 // 500)).withColumn("lean", lean).withColumn("sure", sure).where("sure > 0.7").orderBy(F.desc("sure"), "word").limit(lexicon).collect()
    weights = {r.word: float(r.lean) for r in top}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[w for w in entries(t.as_py()) if w in weights] for t in batch.column(0)], pa.list_(pa.string()))], ["words"])

    # A word that only keeps company with surer words (all in copies of one text, say) explains nothing of its own.
    texts = [set(r.words) for r in labelled.where("label = 1").select("text").mapInArrow(held, "words array<string>").collect()] if weights else []
    for word in list(weights):
        own = [t for t in texts if word in t]
        if len(own) < max(2, n1 // 500):
            del weights[word]
        else:
            texts = [t for t in texts if word not in t]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                words = fold(text.as_py()).split()
                seen[label.as_py()].update({f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in weights or b in weights})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[0][k] for k in keys], pa.int64()), pa.array([seen[1][k] for k in keys], pa.int64())], ["phrase", "clean", "toxic"])

    by_phrase = labelled.select("text", "label").mapInArrow(pairs, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    spared = by_phrase.where((F.col("clean") >= 3) & (F.col("clean") * n1 > 2 * F.col("toxic") * n0)).orderBy(F.desc("clean"), "phrase").limit(exceptions).collect() if weights else []
    model = Model(weights, [r.phrase for r in spared], 0.0, 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([strength(t.as_py(), found)[0] for t in batch.column(0)], pa.float64()), batch.column(1)], ["x", "label"])

    got = labelled.select("text", F.col("label").cast("int")).mapInArrow(measure, "x double, label int").toPandas()
    model.slope, model.level = _logistic(got["x"].to_numpy(), got["label"].to_numpy())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Newton's method on the logistic loss with a small ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), a.T @ (p - y) + 0.05 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, extra: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, the ``extra`` columns, score, predicted (1 from ``threshold`` on), n_matches, n_words.

    ``docs`` needs doc_id and text; a null text counts as empty and gets the
    score of a text without a lexicon word, as does an empty one.  Long texts
    are scanned whole, repeated rows are scored each, and no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}
    head = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c.alias(k) for k, c in extra.items()])
    names = list(extra)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        model = shared.value
        found = automaton(model)
        for batch in (part for whole in batches for part in sliced(whole, 1)):
            got = [strength(t.as_py() or "", found) for t in batch.column(1)]
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.level)))) for x, _, _ in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array([m for _, m, _ in got], pa.int64()), pa.array([n for _, _, n in got], pa.int64())],
                ["doc_id", *names, "score", "predicted", "n_matches", "n_words"],
            )

    return head.mapInArrow(run, f"doc_id long, {kinds + ', ' if kinds else ''}score double, predicted int, n_matches long, n_words long")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns kept.

    ``docs`` needs text; its other columns are passed on as they are, whatever
    their names.  Nulls and empty texts count as in score(); no rows, no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")  # by place: another column may differ from it in case alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        model = shared.value
        found = automaton(model)
        for batch in (part for whole in batches for part in sliced(whole, at)):
            z = [model.slope * strength(t.as_py() or "", found)[0] + model.level for t in batch.column(at)]
            yield batch.filter(pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) < threshold for x in z], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit_from(docs: DataFrame, labels: DataFrame, held_out: Column, max_documents: int = FIT_DOCUMENTS) -> Model:
    """A model of at most about ``max_documents`` labelled rows that are not held out."""
    chosen = hash_sample(labels.where(F.col("toxic").isNotNull() & ~held_out), "doc_id", max_documents).select("doc_id", F.col("toxic").cast("int").alias("label"))
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # bounded by max_documents


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = id_hash() % 5 == 0
    return score(docs, fit_from(docs, labels, held_out), {"held_out": held_out})
