"""Column-level helpers (JVM-side expressions) and the fixed values the reference defines."""

from scorekit.functions.text import (
    clean_response,
    key_text,
    normalize_header,
    python_float_text,
    stringify,
)
from scorekit.functions.rules import is_sensitive, sensitive_columns

__all__ = [
    "clean_response",
    "is_sensitive",
    "key_text",
    "normalize_header",
    "python_float_text",
    "sensitive_columns",
    "stringify",
]
