"""Severities, issue counts and health scores: arithmetic on counts, on the driver or as columns."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Percentages above which a finding is of a severity, the highest first (fixed values).
LIMITS = {
    "mixed_format": ((30, "High"), (10, "Medium"), (None, "Low")),
    "placeholder_value": ((20, "High"), (5, "Medium"), (None, "Low")),
    "suspicious_repetition": ((20, "High"), (5, "Medium"), (None, "Low")),
    "null_analysis": ((50, "High"), (20, "Medium"), (5, "Low")),
}
#: Points that a finding, and further a duplicate group, takes off a score of 100 (fixed values).
POINTS = {"High": 3.0, "Medium": 1.5, "Low": 0.5}
GROUP_POINTS = {"phantom_duplicate": 3.0, "exact_duplicate": 5.0, "fuzzy_duplicate": 1.5}
MISSING_POINTS = 0.2


def percent(part: int, whole: int) -> float:
    return round(part / whole * 100, 1) if whole else 0


def rate(kind: str, pct: float) -> str | None:
    """Severity of a percentage, which has to be rounded to one digit before."""
    return next((s for limit, s in LIMITS[kind] if limit is None or pct > limit), None)


def rate_column(kind: str, part: Column, whole: Column) -> Column:
    """`rate` over counts. A rounded percentage is over a whole limit just when the true one is over it by half a tenth or more."""
    out = F.lit(None).cast("string")
    for limit, s in reversed(LIMITS[kind]):
        out = F.lit(s) if limit is None else F.when(part.cast("long") * 2000 > whole.cast("long") * (20 * limit + 1), s).otherwise(out)
    return F.when(whole > 0, out)


def rate_severity(kind: str, detail: dict) -> str | None:
    if kind == "fuzzy_duplicate":
        return "Medium" if detail.get("match_method") == "fingerprint" else "Low"
    if kind == "exact_duplicate" or (kind == "phantom_duplicate" and detail.get("exact_match")):
        return "High"
    if kind == "phantom_duplicate":
        return "High" if detail.get("group_size", 0) > 3 else "Medium"
    if kind == "wrong_purpose":
        return "High"
    name = {"mixed_format": "inconsistent_pct", "null_analysis": "missing_pct"}.get(kind, "pct")
    return rate(kind, detail.get(name, 0)) if kind in LIMITS else "Medium"


def health_score(severities: Counter, missing: list[float], groups: Counter) -> int:
    """0 to 100. severities: of every finding, group and violation; missing: rounded percentages of the columns; groups: by kind."""
    score = 100.0
    score -= sum(POINTS[s] * n for s, n in severities.items())
    score -= MISSING_POINTS * (sum(missing) / len(missing)) if missing else 0
    score -= sum(GROUP_POINTS[k] * n for k, n in groups.items())
    return max(0, round(score))


def overall(scores: list[int]) -> int:
    return round(sum(scores) / len(scores)) if scores else 100
