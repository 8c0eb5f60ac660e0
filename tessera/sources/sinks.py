"""Sinks: JSON by case, appended logs, TSV, texts, vectors, Markdown; and what of a grid is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def case_json(df: DataFrame, path: str, case: str) -> None:
    """JSON in a folder a case; Spark's committer puts a file in place whole or not at all."""
    df.withColumn("_case", F.col(case)).repartition(case).write.mode("overwrite").partitionBy("_case").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """JSON lines added to a log."""
    df.write.mode("append").json(path)


def tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; nulls are written None, and arrays and structs as JSON."""
    nested = [f.name for f in df.schema if f.dataType.simpleString().startswith(("array", "struct", "map"))]
    flat = [F.to_json(c).alias(c) if c in nested else F.col(c).cast("string").alias(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "None").option("emptyValue", "").csv(path)


def texts(df: DataFrame, path: str, case: str, text: str) -> None:
    """A folder a case with its text."""
    df.select(F.col(case).alias("_case"), F.col(text).cast("string").alias("value")).write.mode("overwrite").partitionBy("_case").text(path)


def vectors(df: DataFrame, path: str, ident: str, vector: str) -> None:
    """An embedding index: ids and float vectors, sorted by id within files."""
    df.select(ident, F.col(vector).cast("array<float>").alias(vector)).sortWithinPartitions(ident).write.mode("overwrite").parquet(path)


def markdown(df: DataFrame, title: str, most: int = 1_000) -> str:
    """A report's table, which is small: ``most`` rows and a line that says how many were left out."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows[:most])]
    return "\n".join(lines + [f"\n{df.count() - most} more rows."] * (len(rows) > most)) + "\n"


def heat_table(medians: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """A row a value of ``rows``, a column a name: what a heat map shows."""
    return medians.groupBy(rows).pivot(columns, names).agg(F.first(value))


def completed(spark: SparkSession, path: str | list[str], schema: str, needed: list[str]) -> DataFrame:
    """Responses of one or several folders that have all that a finished call has; unreadable files are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    return rows.where(whole)
