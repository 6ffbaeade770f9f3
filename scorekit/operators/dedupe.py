"""A1, A2: merge duplicate records by key; drop full-row duplicates."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.functions.constants import ORDER_COL
from scorekit.functions.text import or_null, present
from scorekit.operators._cols import order_struct, q, without


def _default_order(df: DataFrame, order_by):
    if order_by is not None:
        return order_by
    if ORDER_COL in df.columns:
        return ORDER_COL
    raise ValueError("an order key is needed (order_by=...) when the rows carry no _row_order")


def merge_by_key(df: DataFrame, key: str, order_by=None) -> DataFrame:
    """One row per key; each column takes its first non-missing value in ``order_by`` order.

    Rows with a missing key are dropped. The key comes first. The hidden ``_row_order`` is
    not carried over: after a merge the key itself is the row order. A key that is not a
    column leaves the table unchanged with a warning.

    Plan: filter, then one aggregate whose partial step runs before the shuffle, so a key
    holding a third of all rows leaves every map task as one row. Text columns and the order
    struct cannot live in a hash aggregate's buffer, so Spark sorts on both sides of the
    shuffle (SortAggregate).
    """
    if key not in df.columns:
        warnings.warn(f"merge_by_key: no column {key!r}; rows are left as they are", stacklevel=2)
        return df
    order_by = _default_order(df, order_by)
    o = order_struct(order_by)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    data = without(df.columns, [key, ORDER_COL])
    k = q(key)
    aggs = [F.min_by(q(c), F.when(present(q(c), dtypes[c]), o)).alias(c) for c in data]
    return df.where(present(k, dtypes[key])).groupBy(k.alias(key)).agg(*aggs)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct: all columns but the hidden ``_row_order`` are compared, and missing
    equals missing (NaN and null alike; the surviving row shows null).

    With ``_row_order`` the survivor carries the least one, so later numbering follows source
    order. Rows are reduced inside each map task before the shuffle; ``_row_order`` is a
    struct, whose minimum Spark computes by sorting each task's rows (SortAggregate).
    """
    data = without(df.columns, [ORDER_COL])
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(*[or_null(q(c), dtypes[c]).alias(c) for c in data],
                     *[q(c) for c in df.columns if c == ORDER_COL])
    if ORDER_COL not in df.columns:
        return rows.distinct()
    return rows.groupBy(*[q(c) for c in data]).agg(F.min(q(ORDER_COL)).alias(ORDER_COL))
