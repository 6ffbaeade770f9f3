"""Rules on column *names*: on the driver for a schema, as an expression for names in a table."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: sensitive column-name patterns, matched case-insensitively anywhere ----
SENSITIVE_PATTERNS = (
    r"(phone|mobile|contact)\s*number",
    r"phone|mobile|contact",
    r"(employee)\s*(id|number)",
    r"(employeeid|employeenumber)",
)
# -------------------------------------------------------------------------------------------

_COMPILED = tuple(re.compile(p, re.IGNORECASE) for p in SENSITIVE_PATTERNS)


def is_sensitive(name: str) -> bool:
    """True when a column name looks like personal contact or employee-id data."""
    return any(p.search(name) for p in _COMPILED)


def sensitive_columns(names) -> list[str]:
    return [n for n in names if is_sensitive(n)]


def sensitive_name(name: Column) -> Column:
    """:func:`is_sensitive` for a column of names; false for a missing one."""
    hits = [name.rlike(f"(?iU){p}") for p in SENSITIVE_PATTERNS]
    any_hit = hits[0]
    for hit in hits[1:]:
        any_hit = any_hit | hit
    return F.coalesce(any_hit, F.lit(False))
