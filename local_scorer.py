"""A deterministic local scorer: the stand-in for the external model in tests and benchmarks.

``field_scorer`` answers every candidate of a batch with
``score = int(candidate[field]) * factor % modulus`` in the requested JSON shape, wrapped in a
code fence like a chat model would. A simulated outage raises ``ScorerUnavailableError`` for
batches matching ``fail_when(batch)`` (a predicate on the parsed batch) or whose id is a
multiple of ``fail_every``; such a batch is kept, reported and retried, never skipped. The
scorer parses only its own payload: one batch of at most ``batch_size`` records.
"""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle

from scorekit.errors import ScorerUnavailableError

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this file


def field_scorer(field: str, factor: int = 37, modulus: int = 501, fail_every: int | None = None,
                 fail_when=None, remarks: str = "scored", fence: bool = True):
    def scorer(batch_id: int, payload: str, prompt: str) -> str:
        batch = json.loads(payload)
        if (fail_every and batch_id % fail_every == 0) or (fail_when and fail_when(batch)):
            raise ScorerUnavailableError(f"batch {batch_id}: service unavailable")
        id_col = batch["unique_identifier_column"]
        answer = [{id_col: c[id_col], "score": int(c[field]) * factor % modulus,
                   "remarks": remarks} for c in batch["candidates"]]
        text = json.dumps(answer)
        return f"```json\n{text}\n```" if fence else text
    return scorer


def first_candidate_is(field: str, value: str, also_last: bool = False):
    """Outage rule for ``fail_when``: the batch's first candidate (and, with ``also_last``, its
    last one too) has ``field == value``. Defined here so it travels to workers by value."""
    def rule(batch) -> bool:
        c = batch["candidates"]
        hit = c[0].get(field) == value
        return hit and (not also_last or c[-1].get(field) == value)
    return rule
