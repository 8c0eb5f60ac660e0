"""Language identification by words first, then ever shorter character n-grams.

A word that the model knows is scored by its log frequency in each language.
An unseen word backs off to its character n-grams (with word borders): to the
longest length of which the model knows any, down to single characters.  A run
of more letters than a word has, as of a script without spaces, is scored whole:
by its n-grams in blocks, each of which counts as a word does.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import hash_sample, id_hash

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Bounds of the model: labelled documents it is fitted on, words it keeps of each language, n-grams in all.
FIT_DOCUMENTS, FIT_WORDS, FIT_GRAMS, LONGEST = 20_000, 40_000, 150_000, 5
#: Letters that a word has at most; longer runs are no words of the model, and their n-grams are taken in blocks of about so many.
SHORT = 64
#: Unseen words whose scores a worker remembers; emptied when full.
CACHE = 150_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bordered_of(word: str) -> list[str]:
    """The word between its borders; of a longer run, pieces that overlap so that each n-gram starts in the first SHORT letters of one, or in the last piece."""
    run = f"^{word}$"
    if len(word) <= SHORT:
        return [run]
    starts = range(0, len(run) - LONGEST + 1, SHORT)
    return [*(run[a : a + SHORT + LONGEST - 1] for a in starts[:-1]), run[starts[-1] :]]


@dataclass
class Model:
    """languages; words and grams: row in the table of log frequencies by language."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: list[dict[str, int]]
    gram_logs: list[np.ndarray]

    def unseen(self, word: str) -> np.ndarray:
        bordered = f"^{word}$"
        size = -(-len(bordered) // max(1, len(word) // SHORT))
        return sum((self._block(bordered, a, a + size) for a in range(0, len(bordered), size)), np.zeros(len(self.languages), dtype=np.float64))

    def _block(self, bordered: str, begin: int, end: int) -> np.ndarray:
        """The mean over the known n-grams that start in a block."""
        for n in range(LONGEST, 0, -1):
            known = self.grams[n]
            rows = [r for i in range(begin, min(end, len(bordered) - n + 1)) if (r := known.get(bordered[i : i + n])) is not None]
            if rows:
                return self.gram_logs[n][rows].mean(axis=0)
        return np.zeros(len(self.languages), dtype=np.float32)


def _logs(counts: dict, n_languages: int, totals: np.ndarray) -> tuple[dict, np.ndarray]:
    rows = {key: i for i, key in enumerate(sorted(counts))}
    table = np.full((max(1, len(rows)), n_languages), 0.5)
    for key, i in rows.items():
        for k, n in counts[key].items():
            table[i, k] += n
    return rows, np.log(table / (totals + 0.5 * max(1, len(rows)))).astype(np.float32)


def fit(labelled: DataFrame, max_documents: int = FIT_DOCUMENTS, max_words: int = FIT_WORDS, max_grams: int = FIT_GRAMS) -> Model:
    """A model of ``labelled`` (doc_id, text, lang without nulls).

    Words are counted by Spark over at most about ``max_documents`` whole texts,
    chosen by a hash of doc_id; the driver gets ``max_words`` rows a language,
    words or pieces of longer runs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for w, n in Counter(words_of(text.as_py())).items():
                    for piece in bordered_of(w):
                        seen[lang, piece] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    sample = hash_sample(labelled, "doc_id", max_documents).select("text", "lang")
    counts = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= max_words).select("lang", "word", "n").toPandas()
    languages = sorted(top["lang"].unique())
    at = {x: i for i, x in enumerate(languages)}
    words: dict = defaultdict(dict)
    grams: list[dict] = [defaultdict(Counter) for _ in range(LONGEST + 1)]
    totals, gram_totals = np.zeros(len(languages)), np.zeros((LONGEST + 1, len(languages)))
    for lang, bordered, n in zip(top["lang"], top["word"], top["n"], strict=True):
        k = at[lang]
        if bordered[0] == "^" and bordered[-1] == "$" and len(bordered) <= SHORT + 2:
            words[bordered[1:-1]][k] = n
            totals[k] += n
        share = 1 + math.log(n)  # frequent words do not drown their n-grams
        last = len(bordered) if bordered[-1] == "$" else SHORT  # n-grams that start behind it are in the next piece
        for size in range(1, LONGEST + 1):
            for i in range(min(last, len(bordered) - size + 1)):
                grams[size][bordered[i : i + size]][k] += share
                gram_totals[size, k] += share
    kept = [{}, *(dict(sorted(g.items(), key=lambda x: (-sum(x[1].values()), x[0]))[: max_grams // LONGEST]) for g in grams[1:])]
    rows, logs = _logs(words, len(languages), totals)
    tables = [_logs(g, len(languages), t) for g, t in zip(kept, gram_totals, strict=True)]
    return Model(languages, rows, logs, [t[0] for t in tables], [t[1] for t in tables])


def predict(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """The language of every whole text, with its posterior as score.

    ``docs`` needs doc_id and text; other columns are not read, so clashing
    names do no harm.  A null text, an empty one, one without a letter, and any
    text under a model of no language is ``und`` with score 0.  Ties go to the
    language that sorts first.  Rows are scored one by one: repeated rows come
    out as often as they come in, an empty table gives an empty table, and long
    texts are counted whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n_known, width = len(model.words), len(model.languages)
        known, logs = model.words, model.word_logs
        cache: dict[str, int] = {}
        scores = np.zeros((CACHE, max(1, width)), dtype=np.float32)

        def rows_of(words: list[str]) -> np.ndarray:
            nonlocal cache
            new = [w for w in set(words).difference(cache) if w not in known]
            if len(cache) + len(new) > CACHE:
                cache = {}
                new = [w for w in set(words) if w not in known]
            for w in new:
                cache[w] = k = len(cache)
                scores[k] = model.unseen(w)
            return np.fromiter((known[w] if w in known else n_known + cache[w] for w in words), np.int64, len(words))

        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(2):
                text = text.as_py() or ""
                words = words_of(text)
                if not width or not any(c.isalpha() for w in words for c in w):
                    out.append((UNKNOWN, 0.0, len(words)))
                    continue
                total = np.zeros(width)
                runs = [w for w in words if len(w) > SHORT]
                for w in runs:
                    total += model.unseen(w)
                short = [w for w in words if len(w) <= SHORT] if runs else words
                for a in range(0, len(short), CACHE // 2):
                    rows = rows_of(short[a : a + CACHE // 2])
                    old = rows < n_known
                    total += logs[rows[old]].sum(axis=0, dtype=np.float64) + scores[rows[~old] - n_known].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                out.append((model.languages[best], float(1 / np.exp(total - total[best]).sum()), len(words)))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], ["doc_id", "held_out", "lang_pred", "score", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, n_words long")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = id_hash() % 3 == 1
    model = fit(docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"))
    return predict(docs, model, held_out)
