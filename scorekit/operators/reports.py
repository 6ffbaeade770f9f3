"""Summaries computed as small DataFrames (no driver-side counting)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.functions.constants import ORDER_COL, WIDTH_CAP, WIDTH_PADDING
from scorekit.functions.text import or_null
from scorekit.operators._cols import order_columns, q


def _count(df: DataFrame):
    return df.agg(F.count(F.lit(1))).scalar()


def consolidation_report(source: DataFrame, merged: DataFrame | None = None,
                         kept: DataFrame | None = None, key: str | None = None, intake=None) -> DataFrame:
    """One row: ``rows_in, merged, null_key, removed, rows_out``; with the sources' ``intake`` also
    ``bad_files, bad_rows``, which were set apart when reading and are not part of ``rows_in``.

    ``merged`` counts rows that vanished in the merge, rows with a missing key included;
    ``null_key`` is that missing-key part; ``removed`` are rows the status table removed.
    """
    after_merge = _count(merged) if merged is not None else None
    after_status = _count(kept) if kept is not None else None
    if key is not None and key in source.columns:
        k = or_null(q(key), source.schema[key].dataType)
        null_key = F.count(F.lit(1)) - F.count(k)
    else:
        null_key = F.lit(0).cast("bigint")
    rows_in = F.count(F.lit(1))
    mid = after_merge if after_merge is not None else rows_in
    out = after_status if after_status is not None else mid
    apart = [] if intake is None else [_count(intake.bad_files).alias("bad_files"), _count(intake.bad_rows).alias("bad_rows")]
    return source.agg(rows_in.alias("rows_in"), (rows_in - mid).alias("merged"),
                      null_key.alias("null_key"), (mid - out).alias("removed"),
                      out.alias("rows_out"), *apart)


def outcome_report(scored: DataFrame) -> DataFrame:
    """Batches per outcome: ``outcome, n``."""
    return scored.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def analyzed_count(final: DataFrame, results: DataFrame) -> DataFrame:
    """One row: final rows whose rank is at most the number of result rows."""
    n = _count(results)
    return final.agg(F.count_if(F.col("rank") <= n).alias("analyzed"))


def selection_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """One row: ``n, min_score, max_score, range_text``; missing scores (NaN too) count in ``n``
    only. ``range_text`` is the range with one decimal, as ``'85.0 - 400.0'``."""
    s = or_null(q(score), df.schema[score].dataType)
    text = F.concat(F.format_string("%.1f", F.min(s).cast("double")), F.lit(" - "),
                    F.format_string("%.1f", F.max(s).cast("double")))
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(s).alias("min_score"),
                  F.max(s).alias("max_score"),
                  F.when(F.count(s) > 0, text).alias("range_text"))


def column_widths(df: DataFrame) -> DataFrame:
    """Export width per column: ``min(max(longest text, header length) + 2, 50)``.

    One aggregate pass over all columns, then unpivoted to ``column_name, width``. Missing
    cells count as length 0; an empty table gives 2 for every column.
    """
    cols = [c for c in df.columns if c != ORDER_COL]
    lens = [F.max(F.length(or_null(q(c), df.schema[c].dataType).cast("string"))).alias(f"_w{i}")
            for i, c in enumerate(cols)]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *lens)
    widths = []
    for i, c in enumerate(cols):
        longest = F.greatest(F.coalesce(F.col(f"_w{i}"), F.lit(0)), F.lit(len(c)))
        longest = F.when(F.col("_rows") > 0, longest).otherwise(F.lit(0))
        width = F.least(longest + F.lit(WIDTH_PADDING), F.lit(WIDTH_CAP))
        widths.append(width.cast("bigint").alias(c))
    wide = one.select(*widths)
    return wide.unpivot([], [q(c) for c in cols], "column_name", "width")


def preview(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    """First ``n`` rows in ``order_by`` order (a top-n, never a full sort)."""
    if order_by is None:
        return df.limit(n)
    return df.orderBy(*order_columns(order_by)).limit(n)
