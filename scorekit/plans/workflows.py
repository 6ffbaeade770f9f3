"""L1-L4: the reference's four flows as compositions of operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.functions.constants import BATCH_SIZE, DEFAULT_PARALLELISM, ID_COLUMN, ORDER_COL
from scorekit.operators._cols import q
from scorekit.operators.batches import pack_batches
from scorekit.operators.dedupe import drop_duplicate_rows, merge_by_key
from scorekit.operators.numbering import assign_ids
from scorekit.operators.projection import (
    display_columns,
    filter_score_range,
    ranked_only,
    scoring_projection,
)
from scorekit.operators.reports import consolidation_report, selection_summary
from scorekit.operators.responses import batch_results
from scorekit.operators.results import merge_results, sort_final
from scorekit.operators.scoring import failed_batches, retry_failed, score_batches
from scorekit.operators.status import exclude_by_status
from scorekit.operators.union import union_sources
from scorekit.session import materialize
from scorekit.sources.readers import Intake


@dataclass
class Consolidation:
    base: DataFrame          # every column, plus unique_id 1..n
    scoring_view: DataFrame  # chosen, non-sensitive columns + unique_id
    report: DataFrame        # rows_in, merged, null_key, removed, rows_out


@dataclass
class Analysis:
    final: DataFrame                 # base + score, remarks, rank
    results: DataFrame               # all valid score rows so far
    failed: DataFrame                # dead-letter batches of the latest run
    runs: list = field(default_factory=list)  # scored table of every run


def consolidate(sources: list[DataFrame] | Intake, dedupe: str | None = "key", key: str | None = None,
                status: DataFrame | None = None, status_key: str | None = None,
                status_column: str | None = None, columns=None, order_by=None,
                id_col: str = ID_COLUMN, partitions: int | None = None) -> Consolidation:
    """Union -> merge by key (``dedupe="key"``) or full-row distinct (``"rows"``) -> status
    exclusion -> ids 1..n in source order (key order after a merge) -> scoring view.

    ``columns`` of the scoring view default to all; a name that looks like personal data raises.
    ``order_by`` defaults to the ``_row_order`` that ``read_sources`` attaches. Given the
    ``Intake`` of ``read_intake``, the report also counts what was set apart when reading.
    """
    intake, sources = (sources, sources.sources) if isinstance(sources, Intake) else (None, sources)
    if dedupe not in ("key", "rows", None):
        raise ValueError(f"dedupe must be 'key', 'rows' or None, not {dedupe!r}")
    union = union_sources(sources)
    order = order_by if order_by is not None else ORDER_COL
    if order_by is None and ORDER_COL not in union.columns:
        raise ValueError("sources carry no _row_order (read them with read_sources) "
                         "and no order_by was given")
    merged = None
    if dedupe == "key" and key is not None:
        merged = merge_by_key(union, key, order)  # warns if the key is no column
        if key in union.columns:
            merged = merged.withColumn(ORDER_COL, q(key))
            order = ORDER_COL
        step = merged
    elif dedupe == "rows":
        merged = drop_duplicate_rows(union)
        step = merged
    else:
        step = union
    kept = exclude_by_status(step, status, status_key, status_column)
    base = assign_ids(kept, order, out=id_col, partitions=partitions).drop(ORDER_COL)
    view = scoring_projection(base, columns if columns else base.columns, id_col)
    # The numbered base is a written table with the rows of ``kept``: counting it is a scan.
    report = consolidation_report(union, merged, base if status is not None else None,
                                  key if dedupe == "key" else None, intake)
    return Consolidation(base, view, report)


def analyze(base: DataFrame, scoring_view: DataFrame, scorer, role: str,
            id_col: str = ID_COLUMN, batch_size: int = BATCH_SIZE,
            parallelism: int = DEFAULT_PARALLELISM, template: str | None = None,
            run: str | None = None) -> Analysis:
    """Pack -> score -> parse -> rank -> merge. Without any valid score the final table is
    the base unchanged. Writes the scored batches, the parsed results and the merged rows; the
    selection, its summary and the export all read that one merged table. ``run`` names the
    scoring's ledger (see ``score_batches``): an interrupted analysis goes on where it stopped."""
    batches = pack_batches(scoring_view, id_col, batch_size)
    scored = score_batches(batches, scorer, role, parallelism, template, run=run)
    results = materialize(batch_results(scored), "results")  # parsed once; retries append to it
    final = merge_results(base, results, id_col)
    return Analysis(final, results, failed_batches(scored), [scored])


def retry(analysis: Analysis, base: DataFrame, scorer, role: str, id_col: str = ID_COLUMN,
          parallelism: int = DEFAULT_PARALLELISM, template: str | None = None,
          run: str | None = None) -> Analysis:
    """Re-score only the failed batches, append their results, rank and merge again."""
    rescored = retry_failed(analysis.failed, scorer, role, parallelism, template, run)
    new = materialize(batch_results(rescored), "results")
    results = analysis.results.unionByName(new)
    final = merge_results(base, results, id_col)
    return Analysis(final, results, failed_batches(rescored), [*analysis.runs, rescored])


def select_and_report(final: DataFrame, lo=None, hi=None) -> tuple[DataFrame, DataFrame]:
    """Ranked rows within an inclusive score range, in rank order with display columns, and
    their summary.
    A final table without ranks (nothing was scored) selects nothing."""
    if "rank" not in final.columns or "score" not in final.columns:
        chosen = final.where(F.lit(False))
        summary = chosen.agg(F.count(F.lit(1)).alias("n"),
                             F.lit(None).cast("double").alias("min_score"),
                             F.lit(None).cast("double").alias("max_score"),
                             F.lit(None).cast("string").alias("range_text"))
        return display_columns(chosen), summary
    chosen = filter_score_range(ranked_only(final), lo, hi)
    in_order = sort_final(chosen) if ID_COLUMN in chosen.columns else chosen.orderBy("rank")
    return display_columns(in_order), selection_summary(chosen)

