"""Merge ranked scores back into the base table."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.functions.constants import (
    FAILED_REMARKS,
    ID_COLUMN,
    UNSCORED_REMARKS,
    UNSCORED_SCORE,
)
from scorekit.functions.text import key_text, score_number
from scorekit.operators._cols import as_list, q
from scorekit.operators._joins import SPREAD_ROWS, join_frequent
from scorekit.operators.numbering import dense_rank_scores
from scorekit.operators.projection import drop_result_columns
from scorekit.session import delete_tables, materialize

_BK = "_base_key"
_SK = "_score_key"
_MATCHED = "_matched"
_PLACE = "_merged_place"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _keys(base: DataFrame, id_col: str, scores: DataFrame, score_id: str) -> tuple[Column, Column]:
    """Join keys with *text* equality semantics.

    When the base id is integral, both sides become bigint: a score id text matches only if
    it is the canonical spelling of that integer (``'7'`` matches 7, ``'07'`` does not),
    exactly as comparing texts would, but the join hashes 8-byte longs instead of strings.
    """
    btype = base.schema[id_col].dataType
    stype = scores.schema[score_id].dataType
    if isinstance(btype, _INTEGRAL):
        bkey = q(id_col).cast("bigint")
        if isinstance(stype, _INTEGRAL):
            return bkey, q(score_id).cast("bigint")
        txt = key_text(q(score_id), stype)
        as_long = txt.try_cast("bigint")
        return bkey, F.when(as_long.cast("string") == txt, as_long)
    return key_text(q(id_col), btype), key_text(q(score_id), stype)


def _score_rows(scores: DataFrame, score_id: str) -> DataFrame:
    """id, score (double; null if it is no number), remarks (text)."""
    number = score_number(q("score"), scores.schema["score"].dataType)
    return scores.select(q(score_id), number.cast("double").alias("score"),
                         q("remarks").cast("string").alias("remarks"))


def unscored(base: DataFrame) -> DataFrame:
    """Failure fallback: rank and score missing, remarks say the merge failed."""
    return drop_result_columns(base).select(
        "*", F.lit(None).cast("double").alias("score"),
        F.lit(FAILED_REMARKS).alias("remarks"), F.lit(None).cast("bigint").alias("rank"))


def merge_results(base: DataFrame, scores: DataFrame | None, id_col: str = ID_COLUMN,
                  score_id: str = ID_COLUMN) -> DataFrame:
    """Base rows left-joined with dense-ranked scores, with defaults for the unscored, in rank
    order (ties by id).

    Scores are ranked over *all* score rows (ids unknown to the base included), then joined
    on the id compared as text. A repeated score id repeats its base row. Unscored rows get
    score 0, remarks ``'Not analyzed by AI'`` (also when a scored row's remarks are null)
    and rank = rows of the merged table + 1. The id keeps its type. No scores -> the base
    unchanged; scores lacking a needed column, or none of which is a number -> ``unscored``.

    If no scored id is in the base, a warning says so (the merge would score nothing).

    Plan: the numeric scores are written once (they are read for the ranks, the join and the
    anti-join), and so is the merged table, which everything after the merge reads. Both are counted
    while they are written: no scan counts rows, and the default rank is a number by then. The left
    join is an inner join plus the base rows that an anti-join with the distinct scored ids leaves.
    Scores of an id with more than ``SPREAD_ROWS`` of them are not gathered by id (``join_frequent``),
    and the final sort breaks ties by the rows' places in the written table, so that range partitioning
    can part the rows of one id and rank.
    """
    if scores is None:
        return base
    if not {score_id, "score", "remarks"} <= set(scores.columns) or id_col not in base.columns:
        return unscored(base)
    spark = base.sparkSession
    given = Observation()
    valid = materialize(
        _score_rows(scores, score_id).observe(given, F.count(F.lit(1)).alias("rows"), F.count("score").alias("numbers"))
        .where(F.col("score").isNotNull()), "scores")
    counts = given.get
    if not counts.get("numbers"):
        delete_tables(spark, valid)
        return unscored(base) if counts.get("rows") else base
    ranked = dense_rank_scores(valid, "score", "rank")
    b = drop_result_columns(base)
    bkey, skey = _keys(b, id_col, ranked, score_id)
    left = b.withColumn(_BK, bkey)
    right = ranked.select(skey.alias(_SK), "score", "remarks", "rank")
    own = [q(c) for c in b.columns]
    frequent = (valid.groupBy(skey.alias(_SK)).agg(F.count(F.lit(1)).alias("n"))
                .where(F.col(_SK).isNotNull() & (F.col("n") > SPREAD_ROWS)).select(q(_SK).alias("_frequent")))
    hot = frequent.collect()  # at most one for SPREAD_ROWS scores
    if hot:
        both = join_frequent(right, left, _SK, _BK, spark.createDataFrame(hot, frequent.schema))
    else:
        both = left.join(right, F.col(_BK) == F.col(_SK))
    scored = both.select(
        *own, "score", "remarks", "rank", F.lit(True).alias(_MATCHED))
    keys = valid.select(skey.alias(_SK)).where(F.col(_SK).isNotNull()).distinct()
    rest = left.join(keys, F.col(_BK) == F.col(_SK), "left_anti").select(
        *own, F.lit(UNSCORED_SCORE).alias("score"), F.lit(None).cast("string").alias("remarks"),
        F.lit(None).cast("bigint").alias("rank"), F.lit(False).alias(_MATCHED))
    written = Observation()
    merged = materialize(scored.unionByName(rest).observe(
        written, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(_MATCHED)).alias("matched")).drop(_MATCHED), "merged")
    counts = written.get
    if counts.get("rows") and not counts.get("matched"):
        warnings.warn(f"no {score_id!r} of the scores is among the base's {id_col!r}: nothing is scored", stacklevel=2)
    delete_tables(spark, ranked)  # the written scores, and the table of their ranks
    final = merged.select(
        *own, "score", F.coalesce("remarks", F.lit(UNSCORED_REMARKS)).alias("remarks"),
        F.coalesce("rank", F.lit((counts.get("rows") or 0) + 1).cast("bigint")).alias("rank"),
        F.col("_metadata.row_index").alias(_PLACE))
    return sort_final(final, id_col, ties=_PLACE).drop(_PLACE)


def reconcile_ids(base: DataFrame, scores: DataFrame, id_col: str = ID_COLUMN,
                  score_id: str = ID_COLUMN) -> DataFrame:
    """One row: ``matched, base_only, scores_only`` over the distinct ids (text semantics).
    ``matched = 0`` is the reference's "no matching ids" warning condition.

    One aggregation over both tables' ids: each id carries a bit for its side, map tasks reduce an
    id that holds many rows to one, and the bits that meet tell where the id stands.
    """
    bkey = key_text(q(id_col), base.schema[id_col].dataType)
    skey = key_text(q(score_id), scores.schema[score_id].dataType)
    tagged = base.select(bkey.alias(_BK), F.lit(1).alias("_side")).unionByName(
        scores.select(skey.alias(_BK), F.lit(2).alias("_side")))
    sides = tagged.where(F.col(_BK).isNotNull()).groupBy(_BK).agg(F.bit_or("_side").alias("_sides"))
    return sides.agg(*[F.count_if(F.col("_sides") == n).alias(name)
                       for n, name in ((3, "matched"), (1, "base_only"), (2, "scores_only"))])


def sort_results(ranked: DataFrame, id_col: str = ID_COLUMN) -> DataFrame:
    """Rank ascending, score descending (id as final tie-breaker)."""
    return ranked.orderBy(F.asc("rank"), F.desc("score"), F.asc(id_col))


def sort_final(df: DataFrame, id_col: str = ID_COLUMN, ties=None) -> DataFrame:
    """Final table by rank; ties by id (the reference leaves tie order unspecified), then by the
    columns ``ties``. Without any, all rows of one rank and id are sorted by one task."""
    return df.orderBy(F.asc("rank"), F.asc(id_col), *[F.asc(c) for c in as_list(ties)])
