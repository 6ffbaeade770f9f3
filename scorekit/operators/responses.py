"""Clean, parse, classify and validate scorer answers, natively (variant JSON).

Strictness. ``try_parse_json`` reads the first JSON value and ignores what follows
(``'[] extra'`` parses as ``[]``). The answer is therefore parsed inside a two-element array
``[<answer>, "<sentinel>"]``: it is one complete JSON value exactly when that array comes
back with two elements and the sentinel last. Duplicate keys keep the last value.

Known difference: bare ``NaN``/``Infinity`` tokens are not JSON for Spark, so an answer
using them fails as ``invalid_json`` where Python's ``json`` would accept it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorekit.functions.constants import (
    OUTCOME_INVALID_JSON,
    OUTCOME_NOT_LIST,
    OUTCOME_OK,
)
from scorekit.functions.text import clean_response, python_float_text

PARSED = "_parsed"
_WRAPPED = "_wrapped"
_SENTINEL = "#scorekit:end-of-answer#"
_NUMERIC_TYPES = ("BOOLEAN", "TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def parse_responses(df: DataFrame, text: str = "response", outcome: str = "outcome") -> DataFrame:
    """Add ``_parsed`` (the JSON list, as variant) and set ``outcome``.

    An existing non-``ok`` outcome (a failed call) is kept. Otherwise: not one complete
    JSON value -> ``invalid_json``; JSON but not a list -> ``not_list``; else ``ok``.
    Each answer is parsed once: the parse is a named column consumed by later projections,
    which the optimizer keeps instead of inlining (and re-running) it per use.
    """
    spark = df.sparkSession
    key = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # read when the expression is built, then restored
    try:
        cleaned = clean_response(F.col(text))
        wrapped = F.try_parse_json(F.concat(F.lit("["), cleaned, F.lit(f',"{_SENTINEL}"]')))
        step = df.withColumn(_WRAPPED, wrapped.try_cast("array<variant>"))
        step.schema  # force analysis while the setting is on
    finally:
        spark.conf.set(key, before)
    arr = F.col(_WRAPPED)
    complete = F.coalesce(
        (F.size(arr) == F.lit(2))
        & (F.try_variant_get(F.try_element_at(arr, F.lit(2)), "$", "string") == F.lit(_SENTINEL)),
        F.lit(False))
    value = F.try_element_at(arr, F.lit(1))
    is_list = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))
    verdict = (F.when(~complete, F.lit(OUTCOME_INVALID_JSON))
                .when(~is_list, F.lit(OUTCOME_NOT_LIST))
                .otherwise(F.lit(OUTCOME_OK)))
    prior = F.col(outcome) if outcome in df.columns else F.lit(OUTCOME_OK)
    final = F.when(prior != F.lit(OUTCOME_OK), prior).otherwise(verdict)
    others = [c for c in df.columns if c != outcome]
    return step.select(*[F.col(f"`{c}`") for c in others], final.alias(outcome),
                       F.when(final == F.lit(OUTCOME_OK), value).alias(PARSED))


def score_value(v: Column, t: Column | None = None) -> Column:
    """Python ``float(x)`` on a JSON value: numbers and booleans convert; text converts when
    it is float syntax (``' 85 '``, ``'inf'``, ``'1e3'``); null, lists, objects and other text
    give null. ``t`` is ``schema_of_variant(v)`` when the caller has it already."""
    t = F.schema_of_variant(v) if t is None else t
    numeric = t.isin(*_NUMERIC_TYPES) | t.startswith("DECIMAL")
    return (F.when(t == F.lit("STRING"), python_float_text(F.try_variant_get(v, "$", "string")))
             .when(numeric, F.try_variant_get(v, "$", "double")))


def batch_results(parsed: DataFrame, id_field: str | None = None) -> DataFrame:
    """One row per valid answer element of the ``ok`` batches.

    An element is kept when it is an object holding the id key, ``score`` and ``remarks``
    (null values allowed) and its score converts to a number; others are dropped silently
    and the batch stays ``ok``. Output: ``batch_id, item_pos, unique_id (text), score
    (double), remarks (text)``; integral numeric ids print without a fraction.
    """
    id_key = F.lit(id_field) if id_field else F.col("unique_identifier_column")
    # _parsed is null unless the batch is ok, so exploding it needs no outcome filter. The
    # generator yields each element already cast to a map: filters on it stay above the
    # Generate instead of being pushed down and re-casting the element once per use.
    as_maps = F.transform(F.col(PARSED).try_cast("array<variant>"),
                          lambda x: x.try_cast("map<string,variant>"))
    objects = parsed.select("batch_id", id_key.alias("_id_key"),
                            F.posexplode(as_maps).alias("item_pos", "_m"))
    m = F.col("_m")
    keys = F.map_keys(m)
    has_all = F.coalesce(F.array_contains(keys, F.col("_id_key"))
                         & F.array_contains(keys, F.lit("score"))
                         & F.array_contains(keys, F.lit("remarks")), F.lit(False))
    fields = objects.where(has_all).select(
        "batch_id", "item_pos",
        F.try_variant_get(F.try_element_at(m, F.col("_id_key")), "$", "string").alias("unique_id"),
        F.try_element_at(m, F.lit("score")).alias("_score"),
        F.try_variant_get(F.try_element_at(m, F.lit("remarks")), "$", "string").alias("remarks"))
    typed = fields.withColumn("_type", F.schema_of_variant("_score"))
    # Keep the row only when the score converts: explode a zero-or-one element array, so the
    # conversion runs once per element (a filter would be pushed down and run it twice).
    score = score_value(F.col("_score"), F.col("_type"))
    return typed.select("batch_id", "item_pos", "unique_id",
                        F.explode(F.array_compact(F.array(score))).alias("score"), "remarks")
