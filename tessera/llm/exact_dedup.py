"""Exact deduplication as a stateful stream over a log of content digests.

A first pass writes the *content log*: per document its digest, id, length and
content locator (file and row in the file).  A stream reads the log; its state,
kept per digest in RocksDB on disk and never expired, holds the locator and id
of the row that stays and the size of the group.  Digests that were hit more
than once are then checked byte by byte: the locators select the texts to read
again, and all texts of a digest must be the same bytes.  Texts that only share
a digest are told apart by their bytes.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, joined, new_path, stored

_STORE = "spark.sql.streaming.stateStore"
#: State on disk, bounded in memory over all partitions of an executor; no space set aside ahead, as there may be many small stores.
STATE_STORE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "64",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def full_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text, file, row: rows of files by their place, others stored first to have one."""
    keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column hides the file's metadata")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *place)
    except AnalysisException:
        return stored(keep, "located").select("doc_id", "text", *place)


@contextmanager
def _settings(spark: SparkSession, names: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_groups(spark: SparkSession, log_path: str, log_schema, work: str, files_per_batch: int = 1_000) -> DataFrame:
    """Per digest: ``keep`` (of the row that stays) and ``group_size``, over all files of the log.

    ``work`` keeps the stream's checkpoint: called again after files were added
    to the log, only those are read, against the state of all before them.
    """
    rank = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    groups = (
        spark.readStream.schema(log_schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
        .groupBy("digest").agg(F.min(rank).alias("keep"), F.count("*").alias("group_size"))
    )

    def emit(batch: DataFrame, number: int) -> None:
        # Written under the batch's number: a batch that is run again replaces its own output.
        batch.write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    with _settings(spark, STATE_STORE):
        query = groups.writeStream.outputMode("update").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(emit).start()
        query.awaitTermination()
    schema = groups.withColumn("batch", F.lit(0)).schema
    try:
        out = spark.read.schema(schema).parquet(f"{work}/out")
    except AnalysisException:  # no batch ran: the log is empty
        out = spark.createDataFrame([], schema)
    last = out.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s"))
    return last.select("digest", "s.keep", "s.group_size")


def groups_of(docs: DataFrame, digest=full_digest) -> DataFrame:
    """doc_id, file, row, keep_id, group_size, kept, text_sha256 (binary) of every row of located ``docs``."""
    spark = docs.sparkSession
    text = normalised(F.col("text"))
    path, work = new_path(spark, "content-log"), new_path(spark, "dedup-state")
    log = docs.select("doc_id", "file", "row", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), text.alias("t")).select(
        "doc_id", "file", "row", "n_points", digest(F.col("t")).alias("digest"), F.unhex(F.sha2("t", 256)).alias("sha")
    )
    log.write.option("compression", "zstd").parquet(path)
    log = spark.read.schema(log.schema).parquet(path)
    state = stored(stream_groups(spark, path, log.schema, work), "groups")
    drop_path(spark, work)
    # Hits: check the full bytes of every digest that came more than once.
    hits = stored(log.join(state.where("group_size > 1").select("digest"), "digest", "left_semi").select("file", "row", "digest"), "hits")
    again = joined(docs.select("file", "row", "text"), hits, ["file", "row"], "inner", row_bytes=240)
    bytes_of = again.select("digest", "file", "row", normalised(F.col("text")).alias("t"))
    # Smallest and largest text of a digest are equal only if all are; groups shrink to one row a task before the shuffle.
    mixed = stored(bytes_of.groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("digest"), "mixed")
    known = log.join(state, "digest").select("doc_id", "file", "row", "n_points", "digest", "sha", "keep", "group_size")
    if mixed.isEmpty():
        rows = known
    else:
        apart = log.join(F.broadcast(mixed) if mixed.count() < 10_000 else mixed, "digest", "left_semi").join(bytes_of.select("file", "row", "t"), ["file", "row"])
        rank = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
        by_text = apart.groupBy("t").agg(F.min(rank).alias("keep"), F.count("*").alias("group_size"))
        told = apart.join(by_text, "t").select("doc_id", "file", "row", "n_points", "digest", "sha", "keep", "group_size")
        rows = known.join(mixed, "digest", "left_anti").unionByName(told)
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return rows.select("doc_id", "file", "row", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_duplicates(docs: DataFrame, digest=full_digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs doc_id and text; other columns are not read.  Null texts are
    empty and equal to each other and to texts of white space alone.  Of equal
    texts the longest original stays, then the smallest doc_id (a null id last),
    then the first place.  Rows that repeat an id and a text are told apart by
    place: exactly one of a group is ``kept``.  No rows give no rows.
    """
    got = groups_of(located(docs), digest)
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_sha256")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat another's text, all columns kept."""
    clash = {"file", "row", "_metadata"} & set(docs.columns)
    names = docs.columns
    if clash or not _has_place(docs):
        docs = stored(docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), "documents")
    else:
        docs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], "_metadata")
    ids, texts = names.index("doc_id"), names.index("text")
    placed = docs.select([f"c{i}" for i in range(len(names))] + [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")])
    found = groups_of(placed.select(F.col(f"c{ids}").cast("long").alias("doc_id"), F.col(f"c{texts}").cast("string").alias("text"), "file", "row"))
    gone = stored(found.where(~F.col("kept")).select("file", "row"), "repeats")
    left = joined(placed, gone, ["file", "row"], "left_anti", row_bytes=200)
    return left.select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _has_place(docs: DataFrame) -> bool:
    try:
        docs.select("_metadata.row_index")
        return True
    except AnalysisException:
        return False


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
