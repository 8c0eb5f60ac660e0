"""Readers with explicit schemas, and members of tar archives."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W


def json_documents(spark: SparkSession, paths: str | list[str], schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """A JSON document a file; unreadable ones have only ``_corrupt_record``; see readable()."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(schema.add("_corrupt_record", "string")).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(paths)


def readable(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that could be read, in the order of nothing, and a row with the number of those that were skipped."""
    names = [c for c in documents.columns if c != "_corrupt_record"]
    return documents.where("_corrupt_record IS NULL").select(*names), documents.agg(F.count("_corrupt_record").alias("n_skipped"))


def nested(spark: SparkSession, path: str, schema: str, field: str = "cases", limit: int | None = None) -> DataFrame:
    """The elements of a list inside one JSON document, as rows with their place ``pos``; with ``limit`` the first ones."""
    rows = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).json(path).select(F.posexplode(field).alias("pos", "row")).select("pos", "row.*")
    return rows if limit is None else rows.where(F.col("pos") < limit)


def last_by_key(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines by key; the last line of a key wins."""
    lines = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    return lines.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_f"), F.desc("_i")))).where("_k = 1").drop("_f", "_i", "_k")


def scores(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """A TSV column as finite doubles; empty, ``None`` and broken values are dropped."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    number = F.col(value).try_cast("double")
    return rows.select(*keys, number.alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _member(path: str, pos: int, name: str | None, content: bytes | None, error: str | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([pos], pa.int32()), pa.array([name], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["path", "pos", "name", "content", "error"])


def archive_members(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """path, position, name and bytes of the matching members of tar archives; a broken archive ends in a row with its ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                k = 0
                try:
                    with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                        for member in tar:
                            if member.isfile() and member.name.lower().endswith(suffix):
                                yield _member(where.as_py(), k, member.name, tar.extractfile(member).read(), None)
                                k += 1
                except (tarfile.TarError, EOFError, OSError) as broken:
                    yield _member(where.as_py(), k, None, None, f"{type(broken).__name__}: {broken}")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos int, name string, content binary, error string")


def document_kind(content: Column) -> Column:
    """What the first 3000 bytes of an XML document say it is; the first that fits."""
    head = F.decode(F.substring(content, 1, 3000), "UTF-8")
    kind = F.lit("unknown")
    # Root elements, the last first.
    for name, mark in (("incoming", r"<[A-Za-z]+:?IncomingDocument\b"), ("outgoing", r"<[A-Za-z]+:?OutgoingDocument\b"), ("dtd_legacy", "<us-patent-application"), ("ns_claims", r"<[A-Za-z]+:?ClaimsDocument\b")):
        kind = F.when(head.rlike(mark), name).otherwise(kind)
    return kind


def publication_id(name: Column) -> Column:
    """A file name as a publication id: no extension, letters and digits only; null unless it begins with US."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[^A-Za-z0-9]", "")
    return F.when(bare.startswith("US"), bare)


def template(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """A text template, read through Spark, and the names of the fields that it asks for."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    return text, re.findall(r"{(\w+)}", text)


def case_texts(spark: SparkSession, root: str) -> DataFrame:
    """case, text, n_chars: the files below each folder of ``root`` in one text, in the order of their paths."""
    files = whole_texts(spark, root).withColumn("rest", F.expr(f"substring(path, instr(path, '{root.rstrip('/').removeprefix('file://')}') + {len(root.rstrip('/').removeprefix('file://')) + 1})"))
    rows = F.array_sort(F.collect_list(F.struct("path", "text")))
    return files.withColumn("case", F.split("rest", "/").getItem(0)).groupBy("case").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text")).withColumn("n_chars", F.length("text"))


def preferred(files: DataFrame, case: Column, suffixes: list[str]) -> DataFrame:
    """Per case the file (path) whose name ends with the first of the suffixes that any has, else its first file."""
    rank = F.lit(len(suffixes))
    for k, s in reversed(list(enumerate(suffixes))):
        rank = F.when(F.col("path").endswith(s), k).otherwise(rank)
    return files.withColumn("case", case).groupBy("case").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def largest_json(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Per folder below ``root`` the document of its largest JSON file, and how many there are; ties to the first path."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    named = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"))
    folder = F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)
    fields = F.struct(*rows.columns)
    return named.groupBy(folder.alias("folder")).agg(F.max_by(fields, F.struct("_size", F.col("_path"))).alias("d"), F.count_distinct("_path").alias("n_files")).select("folder", "n_files", "d.*")


def claim_text(value: Column, most: int = 4000) -> Column:
    """A claim's text written as JSON in one of its forms, a text, or an object with claim_text or text; cut at ``most``."""
    inner = F.coalesce(F.get_json_object(value, "$.claim_text.text"), F.get_json_object(value, "$.claim_text"), F.get_json_object(value, "$.text"))
    return F.substring(F.coalesce(inner, F.when(value.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]), F.when(~value.startswith("{"), value)), 1, most)


def subconditions(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """case, rep, sub of the responses to condition C that say which of its forms they are."""
    rows = spark.read.schema("case_id string, rep int, probe_meta struct<subcondition: string>").option("multiLine", True).option("pathGlobFilter", "*__C__*.json").option("recursiveFileLookup", True).json(roots)
    return rows.select(F.col("case_id").alias("case"), F.coalesce("rep", F.lit(0)).alias("rep"), F.col("probe_meta.subcondition").alias("sub")).where("sub <> ''")


def finite_scores(spark: SparkSession, path: str, value: str, models: list[str]) -> DataFrame:
    """case, cond, model, rep, value of a TSV whose file column names the model; other models and values that are no finite number are left out."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    parts = F.split("file", "__")
    model = F.when(F.size(parts) >= 4, F.get(parts, F.size(parts) - 2)).otherwise("")
    number = F.col(value).try_cast("double")
    named = rows.select("case", "cond", model.alias("model"), F.col("rep").try_cast("int").alias("rep"), number.alias("value"))
    return named.where(F.col("model").isin(models) & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
