"""Exceptions raised by scorekit operators."""


class DuplicateColumnError(ValueError):
    """Two column names collide (after header normalisation, or by case only)."""


class SensitiveColumnError(ValueError):
    """A scoring projection asked for columns whose names look like personal data."""

    def __init__(self, columns):
        self.columns = list(columns)
        super().__init__(
            f"these column names look like personal data and may not be scored: {self.columns}"
        )


class ScorerUnavailableError(RuntimeError):
    """Raised by a scorer for a transient service failure (rate limit, API error).

    Batches failing this way get outcome ``api_error``; any other exception gives ``error``.
    """


class SourceError(RuntimeError):
    """A source has more unreadable files than can be set apart one by one."""
