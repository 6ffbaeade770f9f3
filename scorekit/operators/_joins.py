"""Inner joins in which some keys hold very many rows of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.operators._cols import q

SPREAD_ROWS = 100_000             # rows of one key that a task may gather


def join_frequent(many: DataFrame, one: DataFrame, many_key: str, one_key: str, frequent: DataFrame) -> DataFrame:
    """``many`` inner-joined with ``one``; ``frequent`` (one column) holds the keys with more than
    ``SPREAD_ROWS`` rows in ``many``.

    Rows of frequent keys stay where they are and meet a broadcast of their partners; the rest is
    shuffled. AQE alone does not do: it measures a partition by its compressed bytes, and equal rows
    compress to nearly nothing. There are at most ``rows / SPREAD_ROWS`` frequent keys, and each
    partner broadcast makes over ``SPREAD_ROWS`` rows of output.
    """
    (name,) = frequent.columns
    keys, on = F.broadcast(frequent), q(many_key) == q(one_key)
    partners = one.join(keys, q(one_key) == q(name), "left_semi")
    held = many.join(F.broadcast(partners), on)
    rest = many.join(keys, q(many_key) == q(name), "left_anti").join(one.hint("merge"), on)
    return held.unionByName(rest)
