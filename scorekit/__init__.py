"""scorekit: record consolidation, batch scoring and ranking as Spark DataFrame operators.

Every public function takes and returns DataFrames and stays lazy, except where a step
must be materialised to stay correct (numbering, the scoring stage); those write a table
under the session's ``spark.checkpoint.dir`` and read it back.
"""

from scorekit.errors import DuplicateColumnError, SensitiveColumnError, SourceError
from scorekit.functions.constants import (
    BATCH_SIZE,
    DEFAULT_PARALLELISM,
    ORDER_COL,
)
from scorekit.operators.batches import pack_batches, render_prompts, stringify_records
from scorekit.operators.dedupe import drop_duplicate_rows, merge_by_key
from scorekit.operators.numbering import assign_ids, dense_rank_scores
from scorekit.operators.projection import (
    display_columns,
    drop_result_columns,
    filter_score_range,
    ranked_only,
    scoring_projection,
    select_valid,
)
from scorekit.operators.reports import (
    analyzed_count,
    column_widths,
    consolidation_report,
    outcome_report,
    preview,
    selection_summary,
)
from scorekit.operators.responses import batch_results, parse_responses
from scorekit.operators.results import (
    merge_results,
    reconcile_ids,
    sort_final,
    sort_results,
    unscored,
)
from scorekit.operators.scoring import failed_batches, retry_failed, score_batches
from scorekit.operators.status import exclude_by_status
from scorekit.operators.union import column_universe, common_type, schema_profile, union_sources
from scorekit.plans.workflows import analyze, consolidate, retry, select_and_report
from scorekit.sources.readers import Intake, normalize_headers, read_intake, read_sources, read_status
from scorekit.sources.writers import write_results

__all__ = [
    "BATCH_SIZE",
    "DEFAULT_PARALLELISM",
    "ORDER_COL",
    "DuplicateColumnError",
    "Intake",
    "SensitiveColumnError",
    "SourceError",
    "analyze",
    "analyzed_count",
    "assign_ids",
    "batch_results",
    "column_universe",
    "column_widths",
    "common_type",
    "consolidate",
    "consolidation_report",
    "dense_rank_scores",
    "display_columns",
    "drop_duplicate_rows",
    "drop_result_columns",
    "exclude_by_status",
    "failed_batches",
    "filter_score_range",
    "merge_by_key",
    "merge_results",
    "normalize_headers",
    "outcome_report",
    "pack_batches",
    "parse_responses",
    "preview",
    "ranked_only",
    "read_intake",
    "read_sources",
    "read_status",
    "reconcile_ids",
    "render_prompts",
    "retry",
    "retry_failed",
    "schema_profile",
    "score_batches",
    "scoring_projection",
    "select_and_report",
    "select_valid",
    "selection_summary",
    "sort_final",
    "sort_results",
    "stringify_records",
    "union_sources",
    "unscored",
    "write_results",
]
