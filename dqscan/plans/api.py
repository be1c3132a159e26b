"""Typed results: `audit_file` and `audit_table`, and the classes they return."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from dqscan.operators.scoring import overall
from dqscan.plans.audit import audit_dataframe, run_audit


@dataclass
class FixSuggestion:
    strategy: str
    description: str
    code: str


@dataclass
class Finding:
    sheet: str
    column: str
    issue_type: str
    severity: str
    description: str
    detail: dict
    why: str = ""
    fix: FixSuggestion | None = None
    rule_name: str | None = None


@dataclass
class Duplicate:
    rows: list[int]
    group_size: int
    exact_match: bool
    severity: str
    matched_on: list[str]
    sample_data: list[dict]
    fix: FixSuggestion | None = None


@dataclass
class FuzzyDuplicate:
    rows: list[int]
    group_size: int
    severity: str
    match_method: str
    similarity_threshold: float
    matched_on: list[str]
    sample_data: list[dict]
    field_differences: dict = field(default_factory=dict)
    fix: FixSuggestion | None = None


@dataclass
class ColumnProfile:
    cardinality: int = 0
    uniqueness_pct: float = 0
    total_values: int = 0
    non_empty_values: int = 0
    min_length: int = 0
    max_length: int = 0
    avg_length: float = 0
    numeric_min: float | None = None
    numeric_max: float | None = None
    numeric_mean: float | None = None
    numeric_median: float | None = None


@dataclass
class SchemaViolation:
    type: str
    severity: str
    column: str
    detail: dict
    why: str = ""


@dataclass
class FieldResult:
    name: str
    inferred_type: str
    missing_pct: float
    findings: list[Finding]
    profile: ColumnProfile


@dataclass
class SheetResult:
    name: str
    row_count: int
    col_count: int
    health_score: int
    fields: list[FieldResult]
    duplicates: list[Duplicate]
    fuzzy_duplicates: list[FuzzyDuplicate]
    schema_violations: list[SchemaViolation]
    severity_counts: dict[str, int] = field(default_factory=dict)
    full_tables: dict[str, str] = field(default_factory=dict)


@dataclass
class TrendData:
    previous_score: int
    current_score: int
    score_delta: int
    previous_issues: int
    current_issues: int
    issues_delta: int
    severity_deltas: dict
    sheets: dict


@dataclass
class AuditResult:
    input_file: str
    timestamp: str
    overall_score: int
    sheets: list[SheetResult]
    warnings: list[str] = field(default_factory=list)
    trend: TrendData | None = None
    raw: dict = field(default_factory=dict, repr=False)

    @property
    def findings(self) -> list[Finding]:
        return [x for s in self.sheets for f in s.fields for x in f.findings]

    def _of(self, severity: str | None = None) -> int:
        return sum(n for s in self.sheets for k, n in s.severity_counts.items() if severity in (None, k))

    @property
    def total_issues(self) -> int:
        return self._of()

    @property
    def high_issues(self) -> int:
        return self._of("High")

    @property
    def medium_issues(self) -> int:
        return self._of("Medium")

    @property
    def low_issues(self) -> int:
        return self._of("Low")

    def to_dict(self) -> dict:
        return self.raw or asdict(self)

    def generate_html(self, path: str) -> str:
        from dqscan.sources.reports import generate_html

        return generate_html(self.raw, path)

    def generate_excel(self, path: str) -> str:
        from dqscan.sources.reports import generate_excel

        return generate_excel(self.raw, path)

    def generate_pdf(self, path: str) -> str:
        from dqscan.sources.reports import generate_pdf

        return generate_pdf(self.raw, path)


def describe(issue: dict) -> str:
    """One line about a finding."""
    d = issue.get("detail", {})
    match issue["type"]:
        case "null_analysis":
            return f"{d['missing_pct']}% missing ({d['total_missing']} of {d['total_rows']})"
        case "mixed_format":
            return f"{d['inconsistent_pct']}% not in the dominant format {d['dominant_format']}"
        case "wrong_purpose":
            return f"{d['issue']}: {d['example']}"
        case "placeholder_value" | "suspicious_repetition":
            return f"{d['value']!r} {d['count']} times ({d['pct']}%)"
    return d.get("message", issue["type"]) if isinstance(d, dict) else issue["type"]


def _fix(x: dict) -> FixSuggestion | None:
    return FixSuggestion(**x["fix"]) if x.get("fix") else None


def typed(results: dict) -> AuditResult:
    sheets = []
    for name, s in results["sheets"].items():
        fields = [
            FieldResult(c, f["inferred_type"], f["null_analysis"]["missing_pct"], [Finding(name, c, i["type"], i["severity"], describe(i), i["detail"], i.get("why", ""), _fix(i), i.get("rule_name")) for i in f["issues"]], ColumnProfile(**f["profile"]))
            for c, f in s["fields"].items()
        ]
        dups = [Duplicate(d["rows"], d["group_size"], d["exact_match"], d["severity"], d["matched_on"], d["sample_data"], _fix(d)) for d in s["phantom_duplicates"]]
        fuzzy = [FuzzyDuplicate(d["rows"], d["group_size"], d["severity"], d["match_method"], d["similarity_threshold"], d["matched_on"], d["sample_data"], d.get("field_differences", {}), _fix(d)) for d in s["fuzzy_duplicates"]]
        sheets.append(SheetResult(name, s["row_count"], s["col_count"], s["health_score"], fields, dups, fuzzy, [SchemaViolation(**v) for v in s["schema_violations"]], s["severity_counts"], s["full_tables"]))
    t = results.get("trend")
    trend = TrendData(**{k: t[k] for k in TrendData.__dataclass_fields__}) if t else None
    return AuditResult(results["input_file"], results["audit_timestamp"], results["overall_score"], sheets, results.get("warnings", []), trend, results)


def audit_file(spark: SparkSession, path: str, fuzzy_threshold: float = 0.85, schema_path: str | None = None, baseline_path: str | None = None, rules_path: str | None = None, **options) -> AuditResult:
    return typed(run_audit(spark, path, fuzzy_threshold, schema_path, baseline_path, rules_path, **options))


def audit_table(df: DataFrame, name: str = "table", **options) -> AuditResult:
    """The same for any frame, whatever it was read from."""
    from datetime import datetime

    sheet = audit_dataframe(df, name, **options)
    return typed({"input_file": name, "audit_timestamp": datetime.now().strftime("%Y-%m-%d %H:%M:%S"), "sheets": {name: sheet}, "overall_score": overall([sheet["health_score"]])})
