"""Stringify records, pack them into batches, build payload and prompt text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.functions.constants import BATCH_SIZE, ID_COLUMN, ORDER_COL
from scorekit.functions.text import stringify
from scorekit.operators._cols import q
from scorekit.operators.projection import refuse_sensitive

BATCH_COLUMNS = ("batch_id", "batch_size", "unique_identifier_column")

# Prompt sent with every batch. Slots: {role} {batch_id} {total} {payload} {id_col}. It states
# the task's frame and the answer's form; how to judge is the caller's business (``template``).
PROMPT_TEMPLATE = """role: {role}
batch: {batch_id} of {total}
records (JSON):
{payload}

Reply with one JSON array. Give each record one object with the keys "{id_col}" (copied from
the record), "score" (a number) and "remarks" (text).
"""

_SLOT = re.compile(r"\{(role|batch_id|total|payload|id_col)\}")


def stringify_records(df: DataFrame, columns=None) -> DataFrame:
    """Every cell as text; missing cells (null, NaN) read ``'Not specified'``."""
    cols = list(columns) if columns else [c for c in df.columns if c != ORDER_COL]
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[stringify(q(c), types[c]).alias(c) for c in cols])


def pack_batches(df: DataFrame, id_col: str = ID_COLUMN, batch_size: int = BATCH_SIZE,
                 columns=None) -> DataFrame:
    """Batches of ``batch_size`` records in id order: ``batch_id = (id - 1) div size + 1``.

    Output: ``batch_id, batch_size, unique_identifier_column, candidates`` where candidates
    is an array of text-only records in column order. ``id_col`` must hold the contiguous ids
    ``1..n`` that ``assign_ids`` produces; then every group holds at most ``batch_size`` rows
    and no task ever gathers an unbounded group. A column name that looks like personal data
    raises ``SensitiveColumnError``, however the frame was made.
    """
    cols = list(columns) if columns else [c for c in df.columns if c != ORDER_COL]
    refuse_sensitive(cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    record = F.struct(*[stringify(q(c), types[c]).alias(c) for c in cols])
    bid = F.floor((q(id_col).cast("bigint") - F.lit(1)) / F.lit(batch_size)) + F.lit(1)
    items = F.sort_array(F.collect_list(F.struct(q(id_col).alias("_o"), record.alias("_r"))))
    return (df.groupBy(bid.cast("bigint").alias("batch_id"))
              .agg(F.count(F.lit(1)).alias("batch_size"), items.alias("_items"))
              .select("batch_id", "batch_size",
                      F.lit(id_col).alias("unique_identifier_column"),
                      F.transform("_items", lambda x: x["_r"]).alias("candidates")))


def batch_payload(batches: DataFrame) -> DataFrame:
    """Add ``payload``: the batch as JSON text (UTF-8, records in order)."""
    if "payload" in batches.columns:
        return batches
    body = F.struct(*[F.col(c) for c in (*BATCH_COLUMNS, "candidates")])
    return batches.withColumn("payload", F.to_json(body))


def render_prompts(batches: DataFrame, role: str, template: str | None = None,
                   total=None) -> DataFrame:
    """Add ``payload`` and ``prompt``. ``total`` (batches in this run) defaults to a
    one-value count subquery over the batch ids."""
    total_col = F.lit(total) if total is not None else batches.agg(F.count("batch_id")).scalar()
    batches = batch_payload(batches)
    slots = {
        "role": F.lit(role),
        "batch_id": F.col("batch_id").cast("string"),
        "total": total_col.cast("string"),
        "payload": F.col("payload"),
        "id_col": F.col("unique_identifier_column"),
    }
    parts, pos = [], 0
    text = template or PROMPT_TEMPLATE
    for m in _SLOT.finditer(text):
        parts.append(F.lit(text[pos:m.start()]))
        parts.append(slots[m.group(1)])
        pos = m.end()
    parts.append(F.lit(text[pos:]))
    return batches.withColumn("prompt", F.concat(*parts))
