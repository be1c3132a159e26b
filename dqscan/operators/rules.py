"""User rules over columns: read from JSON, checked, and evaluated as column expressions."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqscan.functions import text as X
from dqscan.functions.patterns import spread
from dqscan.operators.columns import ROW

CONDITIONS = ("regex_match", "not_regex_match", "min_length", "max_length", "allowed_values", "disallowed_values", "max_missing_pct")


@dataclass
class Rule:
    name: str
    description: str
    severity: str
    condition: str
    threshold: object
    columns: list[str] | None = None
    column_pattern: str | None = None
    extra: dict = field(default_factory=dict)

    def applies_to(self, column: str) -> bool:
        if self.columns:
            return column in self.columns
        if not self.column_pattern or self.column_pattern == "*":
            return self.column_pattern == "*"
        return re.search(self.column_pattern, column, re.IGNORECASE) is not None


def parse(spec: object, at: int = 0) -> Rule:
    if not isinstance(spec, dict):
        raise ValueError(f"rule {at}: not an object")
    missing = [k for k in ("name", "description", "severity", "condition", "threshold") if k not in spec]
    if missing:
        raise ValueError(f"rule {at}: missing {', '.join(missing)}")
    condition, limit = spec["condition"], spec["threshold"]
    if condition not in CONDITIONS:
        raise ValueError(f"rule {at}: unknown condition {condition!r}; known are {', '.join(CONDITIONS)}")
    if spec["severity"] not in ("High", "Medium", "Low"):
        raise ValueError(f"rule {at}: severity must be High, Medium or Low")
    number = isinstance(limit, int | float) and not isinstance(limit, bool)
    if "regex" in condition:
        if not isinstance(limit, str):
            raise ValueError(f"rule {at}: threshold must be a pattern")
        try:
            re.compile(limit)
        except re.error as e:
            raise ValueError(f"rule {at}: invalid pattern: {e}") from e
    elif condition.endswith("length") and not (number and limit >= 0):
        raise ValueError(f"rule {at}: threshold must be a number of 0 or more")
    elif condition.endswith("values") and not isinstance(limit, list):
        raise ValueError(f"rule {at}: threshold must be an array")
    elif condition == "max_missing_pct" and not (number and 0 <= limit <= 100):
        raise ValueError(f"rule {at}: threshold must be from 0 to 100")
    return Rule(spec["name"], spec["description"], spec["severity"], condition, limit, spec.get("columns"), spec.get("column_pattern", None if spec.get("columns") else "*"))


def load_rules(path: str) -> list[Rule]:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no rules file at {path}")
    with open(path, encoding="utf-8") as f:
        try:
            data = json.load(f)
        except json.JSONDecodeError as e:
            raise ValueError(f"rules file isn't JSON: {e}") from e
    if not isinstance(data, dict) or "rules" not in data:
        raise ValueError("rules file needs a top-level `rules`")
    if not isinstance(data["rules"], list):
        raise ValueError("`rules` must be an array")
    return [parse(r, i) for i, r in enumerate(data["rules"])]


def java_pattern(pattern: str) -> str:
    """A Python pattern for whole cells in Java's syntax."""
    if re.search(r"\(\?P[=>]|\(\?\(", pattern):
        raise ValueError(f"pattern {pattern!r} has a construct that Spark's engine lacks")
    p = re.sub(r"\(\?P<(\w+)>", lambda m: "(?<" + m[1].replace("_", "") + ">", pattern).replace(r"\Z", r"\z")
    return rf"^(?:{spread(p)})\z"


def broken(rule: Rule, v: Column) -> Column:
    """True where a stripped, non-empty cell breaks the rule."""
    limit = rule.threshold
    match rule.condition:
        case "regex_match":
            return ~v.rlike(java_pattern(limit))
        case "not_regex_match":
            return v.rlike(java_pattern(limit))
        case "min_length":
            return F.length(v) < limit
        case "max_length":
            return F.length(v) > limit
        case "allowed_values" | "disallowed_values":
            known = F.lower(v).isin(*[str(x).lower() for x in limit]) if limit else F.lit(False)
            return ~known if rule.condition == "allowed_values" else known
    return F.lit(False)


def evaluate(df: DataFrame, rules: list[Rule], columns: list[str] | None = None) -> DataFrame:
    """(rule, field, violations, checked, total) of every rule and column it is aimed at, in one scan and one aggregation."""
    columns = columns or [c for c in df.columns if c != ROW]
    aims = [(i, r, c) for i, r in enumerate(rules) for c in columns if r.applies_to(c)]
    if not aims:
        return df.select(F.lit(0).alias("rule"), F.lit("").alias("field"), F.lit(0).cast("long").alias("violations"), F.lit(0).cast("long").alias("checked"), F.lit(0).cast("long").alias("total")).where("false")
    cells = df.select(*[X.clean(F.col(f"`{c}`")).alias(c) for c in columns])
    sums = [F.count("*").alias("n")] + [F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(columns)]
    sums += [F.coalesce(F.sum(broken(r, F.col(f"`{c}`")).cast("long")), F.lit(0)).alias(f"v{k}") for k, (_, r, c) in enumerate(aims)]
    rows = [
        F.struct(F.lit(i).alias("rule"), F.lit(c).alias("field"), (F.col("n") - F.col(f"c{columns.index(c)}") if r.condition == "max_missing_pct" else F.col(f"v{k}")).alias("violations"), F.col(f"c{columns.index(c)}").alias("checked"), F.col("n").alias("total"))
        for k, (i, r, c) in enumerate(aims)
    ]
    return cells.agg(*sums).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def fires(rule: Rule, violations: int, checked: int, total: int) -> bool:
    if rule.condition == "max_missing_pct":
        return total > 0 and violations / total * 100 > rule.threshold
    return checked > 0 and violations > 0


def examples(df: DataFrame, rule: Rule, column: str, most: int = 5) -> list[str]:
    v = X.clean(F.col(f"`{column}`"))
    return [r["v"] for r in df.select(ROW, v.alias("v")).where(F.col("v").isNotNull() & broken(rule, F.col("v"))).orderBy(ROW).limit(most).collect()]


def evaluate_rule(rule: Rule, df: DataFrame, column: str) -> dict | None:
    """The finding of one rule on one column, or None."""
    r = evaluate(df, [Rule(rule.name, rule.description, rule.severity, rule.condition, rule.threshold, [column])], [column]).first()
    return finding(rule, r, [] if rule.condition == "max_missing_pct" else examples(df, rule, column)) if fires(rule, r["violations"], r["checked"], r["total"]) else None


def finding(rule: Rule, counts, found: list[str]) -> dict:
    n, checked = counts["violations"], counts["checked"]
    detail = {"condition": rule.condition, "threshold": rule.threshold, "violations": n, "total_checked": checked if rule.condition != "max_missing_pct" else counts["total"], "examples": found}
    if rule.condition == "max_missing_pct":
        detail["actual"] = round(n / counts["total"] * 100, 1)
        detail["message"] = f"{detail['actual']}% missing, {rule.threshold}% allowed"
    else:
        detail["message"] = f"{n} of {checked} values break {rule.condition}"
    return {"type": "custom_rule", "rule_name": rule.name, "severity": rule.severity, "detail": detail, "why": rule.description}
