"""Comparison of an audit with an earlier one."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_baseline(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def severities(sheet: dict) -> Counter:
    """Findings by severity. The lists may be cut, so they are counted only in results without counts."""
    if "severity_counts" in sheet:
        return Counter({s: n for s, n in sheet["severity_counts"].items() if n})
    out = Counter(i.get("severity", "Medium") for f in sheet.get("fields", {}).values() for i in f.get("issues", []))
    for part in ("phantom_duplicates", "fuzzy_duplicates", "schema_violations"):
        out.update(x.get("severity", "Medium") for x in sheet.get(part, []))
    return out


def compute_trend(current: dict, baseline: dict) -> dict:
    now, then = (sum((severities(s) for s in r.get("sheets", {}).values()), Counter()) for r in (current, baseline))
    a, b = current.get("sheets", {}), baseline.get("sheets", {})
    sheets = {}
    for name in sorted({*a, *b}):
        if name in a and name in b:
            old, new = b[name].get("health_score", 0), a[name].get("health_score", 0)
            x, y = severities(b[name]).total(), severities(a[name]).total()
            sheets[name] = {"status": "compared", "previous_score": old, "current_score": new, "score_delta": new - old, "previous_issues": x, "current_issues": y, "issues_delta": y - x}
        else:
            sheets[name] = {"status": "new" if name in a else "removed"}
    old, new = baseline.get("overall_score", 0), current.get("overall_score", 0)
    return {
        "previous_score": old, "current_score": new, "score_delta": new - old, "previous_issues": then.total(), "current_issues": now.total(), "issues_delta": now.total() - then.total(),
        "previous_severities": dict(then), "severity_deltas": {s: now[s] - then[s] for s in ("High", "Medium", "Low")}, "previous_timestamp": baseline.get("audit_timestamp", ""), "sheets": sheets,
    }


def compare_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """The same for findings kept as tables (sheet, severity): a full outer join of counts by sheet."""
    count = lambda d, name: d.groupBy("sheet").agg(F.count("*").alias(name))
    both = count(current, "now").join(count(baseline, "then"), "sheet", "full")
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "removed").otherwise("compared")
    return both.select("sheet", status.alias("status"), F.coalesce("then", F.lit(0)).alias("previous_issues"), F.coalesce("now", F.lit(0)).alias("current_issues"), (F.coalesce("now", F.lit(0)) - F.coalesce("then", F.lit(0))).alias("issues_delta"))
