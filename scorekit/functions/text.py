"""Scalar rules on names and column expressions (all data work stays in the JVM)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.functions.constants import MISSING_TEXT

_NON_WORD = re.compile(r"[^\w\s]")

# --- fixed value: the text forms Python's float() accepts (underscores excluded on purpose) --
PYTHON_FLOAT_PATTERN = (
    r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"
)
# ---------------------------------------------------------------------------------------------


def normalize_header(name) -> str:
    """Header rule: text, strip blanks, then delete every character that is not a word
    character or blank. ``' Emp-ID '`` -> ``'EmpID'``; ``'Name !'`` -> ``'Name '``."""
    return _NON_WORD.sub("", str(name).strip())


def _is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def present(c: Column, dtype: T.DataType) -> Column:
    """The one rule for missing cells: null is missing, and so is NaN in a float column."""
    return c.isNotNull() & ~F.isnan(c) if _is_fractional(dtype) else c.isNotNull()


def or_null(c: Column, dtype: T.DataType) -> Column:
    """The cell, with every missing value as null."""
    return F.when(~F.isnan(c), c) if _is_fractional(dtype) else c


def stringify(c: Column, dtype: T.DataType) -> Column:
    """Cell as text, missing (null, or NaN for floats) as ``'Not specified'``."""
    return F.coalesce(or_null(c, dtype).cast("string"), F.lit(MISSING_TEXT))


def key_text(c: Column, dtype: T.DataType) -> Column:
    """Text form of a key used for matching across tables.

    Integral floating and decimal values print without a fraction (``101.0`` and ``101.00`` ->
    ``'101'``), so a key that arrived as float because of gaps still matches its integer
    spelling. Missing (NaN included) is null.
    """
    if isinstance(dtype, T.StringType):
        return c
    if _is_fractional(dtype):
        as_long = c.try_cast("bigint")
        integral = (F.abs(c) < F.lit(9.0e18)) & (c == F.floor(c))
        return F.when(integral, as_long.cast("string")).when(~F.isnan(c), c.cast("string"))
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        whole = F.floor(c)
        return F.when(c == whole, whole.cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


# Leading blanks + one ```json or ``` fence + blanks; and (read from the end) blanks + one
# ``` fence + blanks. Both patterns are anchored at the start of the text they scan, so the
# regex engine stops after the prefix instead of trying every position of a long answer.
_LEAD = r"(?U)^\s*(?:```(?:json)?)?\s*"
_TAIL_REVERSED = r"(?U)^\s*(?:```)?\s*"


def clean_response(c: Column) -> Column:
    """Strip blanks, then one leading ```json or ``` fence, then one trailing ``` fence.
    The tail is stripped on the reversed text (``reverse`` works on characters, so reversing
    twice gives the text back)."""
    head_done = F.regexp_replace(c, _LEAD, "")
    return F.reverse(F.regexp_replace(F.reverse(head_done), _TAIL_REVERSED, ""))


def python_float_text(c: Column) -> Column:
    """Double from text with Python ``float()`` acceptance: ``' 85 '``, ``'inf'``, ``'1e3'``
    pass; ``'85d'``, ``'85%'``, ``'1_000'`` give null."""
    return F.when(c.rlike(PYTHON_FLOAT_PATTERN), c.try_cast("double"))


def score_number(c: Column, dtype: T.DataType) -> Column:
    """A score as a number: text by :func:`python_float_text` (else missing), NaN as missing."""
    if isinstance(dtype, T.StringType):
        c, dtype = python_float_text(c), T.DoubleType()
    return or_null(c, dtype)
