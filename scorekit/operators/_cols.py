"""Small helpers on column lists (driver-side metadata only)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(name: str) -> Column:
    """Column by exact name, safe for names with dots or blanks."""
    return F.col(f"`{name}`")


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def order_columns(order_by) -> list[Column]:
    return [q(o) if isinstance(o, str) else o for o in as_list(order_by)]


def order_struct(order_by) -> Column:
    """One comparable value for a (possibly multi-column) ascending order key."""
    cols = order_columns(order_by)
    if len(cols) == 1:
        return cols[0]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])


def names_of(order_by) -> list[str]:
    return [o for o in as_list(order_by) if isinstance(o, str)]


def without(columns: Iterable[str], drop: Iterable[str]) -> list[str]:
    d = set(drop)
    return [c for c in columns if c not in d]
