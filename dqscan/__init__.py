"""A data-quality engine on Spark. What is listed here loads when it is first asked for."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"

_HOME = {
    "dqscan.plans.api": ("audit_file", "audit_table", "AuditResult", "Finding", "FixSuggestion", "Duplicate", "FuzzyDuplicate", "ColumnProfile", "FieldResult", "SchemaViolation", "SheetResult", "TrendData"),
    "dqscan.plans.audit": ("run_audit", "run_multi_audit", "audit_dataframe", "count_issues", "WHY_IT_MATTERS"),
    "dqscan.plans.single": ("infer_field_type", "analyze_nulls", "analyze_mixed_formats", "analyze_wrong_purpose", "analyze_placeholders", "analyze_fuzzy_duplicates", "analyze_phantom_duplicates"),
    "dqscan.sources.files": ("SUPPORTED_EXTENSIONS", "load_sheets"),
    "dqscan.sources.reports": ("generate_html", "generate_excel", "generate_pdf", "generate_json", "generate_sarif", "export_fixes"),
    "dqscan.operators.scoring": ("rate_severity",),
    "dqscan.operators.schema": ("load_schema", "generate_schema", "validate_schema"),
    "dqscan.operators.trend": ("load_baseline", "compute_trend"),
    "dqscan.operators.rules": ("load_rules", "evaluate_rule", "Rule"),
}
_OF = {name: module for module, names in _HOME.items() for name in names}
__all__ = ["__version__", *_OF]


def __getattr__(name: str):
    if name in _OF:
        return getattr(import_module(_OF[name]), name)
    raise AttributeError(f"module 'dqscan' has no attribute {name!r}")


def __dir__() -> list[str]:
    return sorted(__all__)
