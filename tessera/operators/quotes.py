"""Quotations with their places in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shape import QUOTES


def quotes(df: DataFrame, key: str, text: str = "text", most: int = 800) -> DataFrame:
    """key, pattern, first, behind, quote (up to ``most`` characters) of every match of every pattern.

    Places of matches are no column function, so texts go to Arrow batches.
    """
    patterns = [(k, re.compile(p)) for k, p in QUOTES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, k, m.start(), m.end(), m[0][:most]) for r, t in enumerate(batch.column(1).to_pylist()) for k, p in patterns for m in p.finditer(t or "")]
            cols = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], [key, "pattern", "first", "behind", "quote"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, pattern string, first long, behind long, quote string")
