"""Export the final table under a timestamped name."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame

from scorekit.functions.constants import EXPORT_PREFIX, EXPORT_TIMESTAMP, ID_COLUMN, ORDER_COL


def write_results(df: DataFrame, path: str, fmt: str = "parquet", now: datetime | None = None,
                  options: dict | None = None, prefix: str = EXPORT_PREFIX) -> str:
    """Write ``df`` to ``path/<prefix><YYYYmmdd_HHMMSS>`` and return that path. A table with ranks
    is written in rank order (by id among equals): the files in name order hold it so.

    Refuses to overwrite. Each task writes its own file, so nothing passes through the driver.
    """
    stamp = (now or datetime.now()).strftime(EXPORT_TIMESTAMP)
    target = os.path.join(path, f"{prefix}{stamp}")
    out = df.drop(ORDER_COL)
    if "rank" in out.columns:
        out = out.orderBy("rank", *[c for c in (ID_COLUMN,) if c in out.columns])
    writer = out.write.mode("errorifexists").format(fmt).options(**(options or {}))
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(target)
    return target
