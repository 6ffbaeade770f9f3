"""Files that cannot be read are set apart one by one; the rest of their source stays.

One distributed pass opens every file of a source (footers only: no column is read) with Spark's
``ignoreCorruptFiles``; files it saw no row of are suspects. A suspect may be empty, broken, or not
have been reached because of a passing storage error. Its bytes are therefore fetched again, without
that setting: a storage error fails the read, and bytes that arrive but are no file of the format
put the file into quarantine. A suspect that turns out well stays in the source.

Files of no bytes hold nothing and are passed over, as Spark does. Pages inside a file are not tested: a file that opens and breaks later fails the job that reads it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorekit.errors import SourceError

#: Formats whose files have a footer to open. Lines of text files are judged one by one instead.
TESTED_FORMATS = ("parquet", "orc")
#: Suspects are few files among many; a source with more of them is not worth reading in part.
MAX_SUSPECTS = 1000
BAD_FILES = "source int, path string, bytes bigint, reason string"
LISTING_OPTIONS = ("pathglobfilter", "recursivefilelookup", "modifiedbefore", "modifiedafter", "basepath")
_SEEN, _LISTED = 2, 1


def literal_path(path: str) -> str:
    """A path as Spark's readers take it literally, with glob characters escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def listing(spark: SparkSession, path, options: dict) -> DataFrame:
    """``file, path, bytes`` of every file of a source; contents are not read."""
    known = {k: v for k, v in options.items() if k.lower() in LISTING_OPTIONS}
    files = spark.read.format("binaryFile").options(**known).load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("bytes"))


def footer_schema(spark: SparkSession, path, fmt: str, options: dict):
    """The schema in the files' footers; ``None`` if no file has one. Spark asks a single file; if
    that one is broken, all are asked."""
    reader = spark.read.format(fmt).options(**options).option("ignoreCorruptFiles", "true")
    for merge in (None, "true"):
        try:
            return (reader.option("mergeSchema", merge) if merge else reader).load(path).schema
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
    return None


def _suspects(spark: SparkSession, path, fmt: str, options: dict, schema) -> list:
    """Listed files of which a pass over the footers saw no row (at most ``MAX_SUSPECTS``)."""
    listed = listing(spark, path, options).withColumn("tag", F.lit(_LISTED))
    schema = footer_schema(spark, path, fmt, options) if schema is None else schema
    if schema is not None:
        rows = spark.read.format(fmt).options(**options).option("ignoreCorruptFiles", "true").schema(schema).load(path)
        listed = listed.unionByName(rows.select(
            F.col("_metadata.file_path").alias("file"), F.lit(None).cast("string").alias("path"),
            F.lit(None).cast("bigint").alias("bytes"), F.lit(_SEEN).alias("tag")))
    unseen = (listed.groupBy("file").agg(F.max("tag").alias("tag"), F.max("path").alias("path"), F.max("bytes").alias("bytes"))
              .where(F.col("tag") == _LISTED))
    found = unseen.select("path", "bytes").limit(MAX_SUSPECTS + 1).collect()
    if len(found) > MAX_SUSPECTS:
        raise SourceError(f"more than {MAX_SUSPECTS} files of {path!r} cannot be read")
    return found


def _opened(fmt: str):
    """Whether bytes are a file of the format: null, or why not."""
    def task(batches):
        import pyarrow.orc as orc
        import pyarrow.parquet as parquet

        for batch in batches:
            reasons = []
            for content in batch.column("content"):
                try:
                    source = pa.BufferReader(content.as_buffer())
                    parquet.ParquetFile(source).metadata if fmt == "parquet" else orc.ORCFile(source).nrows  # noqa: B018
                    reasons.append(None)
                except Exception as e:  # noqa: BLE001 - whatever the parser says is the reason
                    reasons.append(f"{type(e).__name__}: {e}".splitlines()[0])
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(reasons, pa.string())],
                                             names=["path", "bytes", "reason"])
    return task


def bad_files(spark: SparkSession, path, fmt: str, options: dict, schema=None) -> list[tuple]:
    """``path, bytes, reason`` of the files of a source that are no files of its format."""
    if fmt not in TESTED_FORMATS:
        return []
    suspects = _suspects(spark, path, fmt, options, schema)
    if not suspects:
        return []
    # One file to an Arrow batch, so a task holds one content at a time.
    again = (spark.read.format("binaryFile").load([literal_path(r["path"]) for r in suspects])
             .select("path", "length", "content"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        judged = again.mapInArrow(_opened(fmt), "path string, bytes bigint, reason string").where("reason is not null")
        return sorted(tuple(r) for r in judged.collect())
    finally:
        spark.conf.set(key, before)


def good_paths(spark: SparkSession, path, options: dict, bad: list[tuple]) -> list[str]:
    """The other files of the source. Only a source with bad files is read by a list of its files."""
    broken = {b[0] for b in bad}
    return [literal_path(r["path"]) for r in listing(spark, path, options).select("path").toLocalIterator()
            if r["path"] not in broken]
