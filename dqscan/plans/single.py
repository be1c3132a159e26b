"""Checks of one column, or of one table's duplicates, as plain results."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqscan.functions import patterns as P
from dqscan.functions import text as X
from dqscan.operators import columns as C
from dqscan.operators import scoring as S
from dqscan.plans.audit import audit_dataframe, duplicate_groups
from dqscan.plans.spool import spool


def _one(df: DataFrame, column: str) -> DataFrame:
    return C.with_row_idx(C.as_text(df.select(f"`{column}`")))


def _missing(df: DataFrame, column: str) -> dict:
    found = C.null_analysis(df, [column]).first()
    return {k: found[k] if found else 0 for k in ("null_count", "blank_count", "whitespace_only", "total_missing", "total_rows")}


def analyze_nulls(df: DataFrame, column: str) -> dict:
    """Counts of the kinds of missing cells of a column, and their share."""
    n = _missing(C.as_text(df.select(f"`{column}`")), column)
    return n | {"missing_pct": S.percent(n["total_missing"], n["total_rows"])}


def infer_field_type(df: DataFrame, column: str) -> str:
    """The semantic type of a column, by its name or by its first cells."""
    own = _one(df, column)
    n = _missing(own, column)
    return C.infer_types(own, {column: n["total_missing"] < n["total_rows"]})[column]


def analyze_mixed_formats(df: DataFrame, column: str, field_type: str | None = None) -> dict | None:
    """The formats of a column of dates, phones or amounts, where it has more than one."""
    kind = field_type or infer_field_type(df, column)
    if kind not in P.FORMATS:
        return None
    own = _one(df, column)
    spread = spool(C.format_distribution(C.values(C.frequencies(own)), {column: kind}))
    found = C.mixed_formats(spread).first()
    if found is None:
        return None
    v = X.clean(F.col(f"`{column}`"))
    odd = own.select(C.ROW, v.alias("v")).where(F.col("v").isNotNull() & (P.format_label(F.col("v"), kind) == P.NON_STANDARD)).orderBy(C.ROW).limit(5)
    return {k: found[k] for k in ("dominant_format", "dominant_count", "inconsistent_count")} | {
        "field_type": kind, "format_distribution": {r["label"]: r["n"] for r in spread.orderBy(F.desc("n"), "first_row").collect()}, "inconsistent_pct": S.percent(found["inconsistent_count"], found["total"]), "sample_nonstandard": [r["v"] for r in odd.collect()],
    }


def _issues(df: DataFrame, column: str, kinds: tuple[str, ...]) -> list[dict]:
    sheet = audit_dataframe(df.select(f"`{column}`"), column, max_pairwise=-1)
    return [i["detail"] for f in sheet["fields"].values() for i in f["issues"] if i["type"] in kinds]


def analyze_wrong_purpose(df: DataFrame, column: str) -> list[dict]:
    """Cells of a column that belong elsewhere: issue, example and row of each."""
    return _issues(df, column, ("wrong_purpose",))


def analyze_placeholders(df: DataFrame, column: str) -> list[dict]:
    """Placeholders and suspicious repetitions of a column: type, value, count and share of each."""
    return _issues(df, column, ("placeholder_value", "suspicious_repetition"))


def _groups(df: DataFrame, name: str, threshold: float, fuzzy: bool) -> dict:
    own = C.with_row_idx(C.as_text(df))
    freq = spool(C.frequencies(own))
    sheet: dict = {"phantom_duplicates": [], "fuzzy_duplicates": []}
    columns = [c for c in own.columns if c != C.ROW]
    filled = {r["field"]: r["total_missing"] < r["total_rows"] for r in C.null_analysis(own).collect()} if columns else {}
    duplicate_groups(own, freq, C.infer_types(own, filled), own.count(), threshold, sheet, Counter(), 1000, 50_000 if fuzzy else -1, [])
    return sheet


def analyze_phantom_duplicates(df: DataFrame, name: str = "table") -> list[dict]:
    """Groups of rows that are equal, or equal but for spelling."""
    return _groups(df, name, 0.85, False)["phantom_duplicates"]


def analyze_fuzzy_duplicates(df: DataFrame, name: str = "table", threshold: float = 0.85) -> list[dict]:
    """Groups of rows of the same tokens, or close in edit distance, beyond the phantom duplicates."""
    return _groups(df, name, threshold, True)["fuzzy_duplicates"]
