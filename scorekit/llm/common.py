"""Helpers shared by the corpus operators.

Every operator first selects the columns it needs under internal names, so extra columns of
the input (whatever they are called) never clash with its own. Python functions sent to the
workers travel by value (see ``scorekit.operators.scoring``); anything costly that they build
from a shipped file is kept in :func:`worker_state` for the life of the worker process.
"""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.session import materialize

SLICE_ROWS = 512  # rows of an Arrow batch turned into Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state() -> dict:
    """A dict that lives as long as the Python worker process."""
    name = "_scorekit_llm_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` only; a null text becomes the empty text."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def held_out(id_column, modulus: int, remainder: int = 2):
    """The contract's fold rule: CRC-32 of the id printed as text, modulo ``modulus``.

    A null id counts as the empty text (remainder 0: in the learning fold).
    """
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % modulus == remainder


PLACE = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` as files whose rows have a place: itself if it is a plain read of Parquet files,
    else a written copy (a frame's rows could move between two reads)."""
    plan = docs._jdf.queryExecution().analyzed()
    files = plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().lower()
    return docs if files else materialize(docs, "placed")


def place() -> Column:
    """Where a row of :func:`placed` documents stands: its file, and its number there."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so (in upper or lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_places(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of :func:`placed` documents that are not at a place of ``dropped`` (a written table of
    :func:`place` values, column ``place``), with all their columns. The places are narrow: the
    planner broadcasts them if they are few, else the rows move once."""
    name = fresh(docs.columns, "place")
    gone = dropped.select(F.col("place").alias(name))
    return docs.withColumn(name, place()).join(gone, name, "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])


def schema_like(docs: DataFrame, id_col: str, fields: str) -> T.StructType:
    """``doc_id`` with the type it has in ``docs``, then ``fields`` (a DDL string)."""
    rest = T._parse_datatype_string(fields)
    return T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *rest.fields])


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches cut into pieces of ``rows`` rows (Python objects stay few at a time)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
