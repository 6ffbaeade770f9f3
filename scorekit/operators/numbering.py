"""Contiguous row ids and dense ranks without pulling rows into one task.

Spark's global ``row_number()``/``dense_rank()`` windows with no partition key run in a
single task. Instead:

1. range-partition by the order key into ``n`` partitions, sort inside each, and write that table
   under the checkpoint folder: its files, in the order of their numbers, hold the rows in order
   (two separate range shuffles may sample different bounds, so nothing is numbered before it is
   written; AQE may coalesce the range partitions, but only adjacent ones);
2. the files' row counts stand in their Parquet footers; their running sums, one number per file,
   are the offsets (held by the driver and broadcast: bounded by the number of partitions);
3. a row's id is its file's offset, plus its place in the file (``_metadata.row_index``), plus 1.

The table is read once, for its rows. A dense rank numbers the *distinct* values this way and joins
them back on the value; the distinct step pre-aggregates before its shuffle, so a value held by a
third of the rows costs one row per map task. Up to ``BROADCAST_LEVELS`` distinct values are broadcast;
above that, values of more than ``SPREAD_ROWS`` rows each are broadcast and only the rest is joined by a
shuffle: no task gathers the rows of a frequent value. ``session.delete_tables`` removes the written table
when the numbered frame is no longer read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scorekit.operators._cols import order_columns, q
from scorekit.operators._joins import SPREAD_ROWS, join_frequent
from scorekit.operators.projection import valid_scores
from scorekit.session import materialize

_FILE = "_ids_file"
_OFF = "_ids_off"
_LEVEL = "_rank_level"
_ROWS = "_rank_rows"
BROADCAST_LEVELS = 100_000        # two numbers each


def _file_number():
    """Number of a written file: its partition's, and its place among the files of a partition."""
    name = F.col("_metadata.file_name")
    part, piece = F.regexp_extract(name, r"^part-(\d+)", 1), F.regexp_extract(name, r"-c(\d+)", 1)
    return F.concat(part, F.lpad(piece, 8, "0")).cast("bigint")


def assign_ids(df: DataFrame, order_by, out: str = "unique_id",
               partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1..n following ``order_by`` (names or sort Columns, e.g. ``F.desc``).

    An existing ``out`` column is overwritten in place. Materialises once (see module doc).
    The order key should be unique; ties get distinct ids in an unspecified order.
    """
    return _numbered(df, order_by, out, partitions)[0]


def _numbered(df: DataFrame, order_by, out: str, partitions: int | None) -> tuple[DataFrame, int]:
    """The numbered frame and its row count, which is known from the footers."""
    order = order_columns(order_by)
    columns = df.columns if out in df.columns else [*df.columns, out]
    base = df.drop(out)
    # Without an explicit count AQE may coalesce the range partitions. It merges adjacent
    # ranges in order, so the order of the files is still key order.
    by_range = (base.repartitionByRange(int(partitions), *order) if partitions
                else base.repartitionByRange(*order))
    ranged = materialize(by_range.sortWithinPartitions(*order), "ids")
    rows = ranged.select(_file_number().alias(_FILE)).groupBy(_FILE).count().collect()  # from the footers
    offsets, total = [], 0
    for file, n in sorted(map(tuple, rows)):
        offsets.append((file, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, f"{_FILE} bigint, {_OFF} bigint")
    numbered = (ranged.withColumns({_FILE: _file_number(), out: F.col("_metadata.row_index") + F.lit(1)})
                .join(F.broadcast(table), _FILE).withColumn(out, F.col(_OFF) + q(out)))
    return numbered.select(*[q(c) for c in columns]), total


def dense_rank_scores(df: DataFrame, score: str = "score", out: str = "rank",
                      partitions: int | None = None) -> DataFrame:
    """Dense rank, highest score first (1 = best). Scores become numbers first: rows with a
    missing or NaN score, or text that is no number, are dropped. Infinity ranks first. All
    rows take part, whatever their id."""
    valid = valid_scores(df.drop(out), score)
    seen = Observation()  # a maximum: the sampling of the range partitions may look at the rows once more
    levels = valid.groupBy(q(score).alias(_LEVEL)).agg(F.count(F.lit(1)).alias(_ROWS)).observe(seen, F.max(_ROWS).alias("most"))
    numbered, n = _numbered(levels, [F.desc(_LEVEL)], out, partitions)
    table = numbered.select(_LEVEL, q(out))
    if n <= BROADCAST_LEVELS:
        return valid.join(F.broadcast(table), q(score) == q(_LEVEL)).drop(_LEVEL)
    if (seen.get.get("most") or 0) > SPREAD_ROWS:
        frequent = numbered.where(F.col(_ROWS) > SPREAD_ROWS).select(q(_LEVEL).alias("_frequent"))
        return join_frequent(valid, table, score, _LEVEL, frequent).drop(_LEVEL)
    return valid.join(table.hint("merge"), q(score) == q(_LEVEL)).drop(_LEVEL)
