"""Remove records whose id occurs in a status table (null-safe anti-join on key text)."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.functions.text import key_text
from scorekit.operators._cols import q

_SK = "_status_key"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def exclude_by_status(df: DataFrame, status: DataFrame | None, key: str | None,
                      status_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key text does not occur in ``status[status_key]``.

    Presence alone removes a row; status values are not examined. A missing key matches a
    missing key. The key column of the result is text (integral floats without ``.0``).
    If either column is absent the table is returned unchanged with a warning.

    Plan: the status keys are de-duplicated first (partial aggregate before the shuffle),
    so the build side holds one row per key however often a key repeats. The anti-join is
    an equi-join on text; AQE broadcasts the status keys when their measured size allows,
    otherwise sort-merges and splits a skewed probe partition. Rows with a missing key match
    no status key, so they bypass the join (``UNION ALL``); whether they are excluded is decided
    once, by a one-value EXISTS subquery.
    """
    if status is None or key is None:
        return df
    status_key = status_key or key
    if key not in df.columns or status_key not in status.columns:
        warnings.warn(f"exclude_by_status: {key!r} or {status_key!r} is no column; nothing is excluded",
                      stacklevel=2)
        return df
    btype, stype = df.schema[key].dataType, status.schema[status_key].dataType
    if isinstance(btype, _INTEGRAL) and isinstance(stype, _INTEGRAL):
        # Integer texts are equal exactly when the integers are: join on 8-byte longs.
        base, st_key = df.withColumn(key, q(key).cast("bigint")), q(status_key).cast("bigint")
    else:
        base, st_key = df.withColumn(key, key_text(q(key), btype)), key_text(q(status_key), stype)
    st = status.select(st_key.alias(_SK))
    keys = st.where(F.col(_SK).isNotNull()).distinct()
    null_in_status = st.where(F.col(_SK).isNull()).exists()
    known = base.where(q(key).isNotNull()).join(keys, q(key) == keys[_SK], "left_anti")
    missing = base.where(q(key).isNull() & ~null_in_status)
    return known.unionByName(missing).withColumn(key, q(key).cast("string"))
