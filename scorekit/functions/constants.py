"""Fixed values. These must equal the reference application's values for equal results."""

# --- fixed values (taken as-is from the reference behaviour) -------------------------------
BATCH_SIZE = 50                                  # rows per scoring call
DEFAULT_PARALLELISM = 5                          # scoring calls in flight
MISSING_TEXT = "Not specified"                   # stand-in for a missing cell in a payload
UNSCORED_REMARKS = "Not analyzed by AI"          # remarks of a base row without a score
FAILED_REMARKS = "Error in analysis or merge"    # remarks when results cannot be merged
UNSCORED_SCORE = 0.0                             # score of a base row without a score
WIDTH_PADDING = 2                                # added to the longest text of a column
WIDTH_CAP = 50                                   # widest column in an export
RESULT_COLUMNS = ("score", "remarks", "rank")    # dropped from the base before a merge
DISPLAY_FIRST = ("rank", "score", "unique_id", "remarks")
DISPLAY_HIDDEN = ("data_source",)
EXPORT_PREFIX = "complete_candidate_analysis_"
EXPORT_TIMESTAMP = "%Y%m%d_%H%M%S"
ID_COLUMN = "unique_id"
# --------------------------------------------------------------------------------------------

# Our own names.
ORDER_COL = "_row_order"          # struct(source_no, file, row) giving source order
OUTCOME_OK = "ok"
OUTCOME_NOT_LIST = "not_list"
OUTCOME_INVALID_JSON = "invalid_json"
OUTCOME_API_ERROR = "api_error"
OUTCOME_ERROR = "error"
