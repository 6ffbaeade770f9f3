"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.errors import SensitiveColumnError
from scorekit.functions.constants import (
    DISPLAY_FIRST,
    DISPLAY_HIDDEN,
    ID_COLUMN,
    RESULT_COLUMNS,
)
from scorekit.functions.rules import sensitive_columns
from scorekit.functions.text import present, score_number
from scorekit.operators._cols import as_list, q


def select_valid(df: DataFrame, columns, always=()) -> DataFrame:
    """Requested columns that exist, in requested order; unknown names are skipped.
    Names in ``always`` are appended when absent from the request."""
    wanted = list(as_list(columns))
    for a in as_list(always):
        if a not in wanted:
            wanted.append(a)
    return df.select(*[q(c) for c in wanted if c in df.columns])


def scoring_projection(df: DataFrame, columns, id_col: str = ID_COLUMN) -> DataFrame:
    """The columns sent to the scorer: the id is always included, and any requested name
    that looks like personal data rejects the whole request (``SensitiveColumnError``)."""
    wanted = list(as_list(columns))
    if id_col not in wanted:
        wanted.append(id_col)
    refuse_sensitive(wanted)
    return select_valid(df, wanted)


def refuse_sensitive(names) -> None:
    """Raise ``SensitiveColumnError`` when a name looks like personal data."""
    bad = sensitive_columns(names)
    if bad:
        raise SensitiveColumnError(bad)


def drop_result_columns(df: DataFrame) -> DataFrame:
    """Drop ``score``, ``remarks``, ``rank`` from an earlier run, if present."""
    return df.drop(*RESULT_COLUMNS)


def filter_score_range(df: DataFrame, lo=None, hi=None, score: str = "score") -> DataFrame:
    """Inclusive score range; either bound may be omitted. A missing score (NaN too) is in no
    range."""
    if lo is not None or hi is not None:
        df = df.where(present(q(score), df.schema[score].dataType))
    if lo is not None:
        df = df.where(q(score) >= F.lit(lo))
    if hi is not None:
        df = df.where(q(score) <= F.lit(hi))
    return df


def ranked_only(df: DataFrame, rank: str = "rank") -> DataFrame:
    """Rows that have a rank, with the rank as a whole number."""
    return df.where(q(rank).isNotNull()).withColumn(rank, q(rank).cast("bigint"))


def valid_scores(df: DataFrame, score: str = "score") -> DataFrame:
    """Rows with a score that is a number, as a number: text that is none (``'85d'``), null and
    NaN rows are dropped (they take no part in ranking)."""
    as_number = score_number(q(score), df.schema[score].dataType)
    return df.withColumn(score, as_number).where(q(score).isNotNull())


def display_columns(df: DataFrame) -> DataFrame:
    """``rank, score, unique_id, remarks`` first, then the rest, without ``data_source``."""
    first = [c for c in DISPLAY_FIRST if c in df.columns]
    rest = [c for c in df.columns if c not in DISPLAY_FIRST and c not in DISPLAY_HIDDEN]
    return df.select(*[q(c) for c in first + rest])
