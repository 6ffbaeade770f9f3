"""Sources and sinks: multi-source read with header rule, status source, result export."""

from scorekit.sources.readers import Intake, normalize_headers, read_intake, read_sources, read_status
from scorekit.sources.writers import write_results

__all__ = ["Intake", "normalize_headers", "read_intake", "read_sources", "read_status", "write_results"]
