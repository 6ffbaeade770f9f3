"""End-to-end flows built from the operators: consolidate, analyze, retry, select."""

from scorekit.plans.workflows import (
    Analysis,
    Consolidation,
    analyze,
    consolidate,
    retry,
    select_and_report,
)

__all__ = ["Analysis", "Consolidation", "analyze", "consolidate", "retry", "select_and_report"]
