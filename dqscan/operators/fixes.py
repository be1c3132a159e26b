"""Repairs: a strategy, its description and PySpark code for a finding, and the transform itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqscan.functions import patterns as P
from dqscan.functions import text as X

DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "d-MMM-yyyy", "yyyy/MM/dd", "yyyy.MM.dd", "MM-dd-yyyy")


def dates(c: Column) -> Column:
    """yyyy-MM-dd wherever one of the known formats fits, else the cell as it is."""
    found = F.coalesce(*[F.try_to_timestamp(X.strip(c), F.lit(f)) for f in DATE_FORMATS])
    return F.coalesce(F.date_format(found, "yyyy-MM-dd"), c)


def phones(c: Column) -> Column:
    """(ddd) ddd-dddd of the last ten digits; a cell of fewer digits stays as it is."""
    digits = F.regexp_replace(c, r"\D", "")
    d = F.right(digits, F.lit(10))
    return F.when(F.length(digits) >= 10, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))).otherwise(c)


def amounts(c: Column) -> Column:
    """A number; the sign is kept, and brackets around an amount are one."""
    digits = F.nullif(F.regexp_replace(c, r"[^\d.\-]", ""), F.lit(""))
    return F.when(c.rlike(r"^\s*\([^()]*\)\s*$"), -F.abs(digits.try_cast("double"))).otherwise(digits.try_cast("double"))


def without_placeholders(c: Column) -> Column:
    return F.when(~F.coalesce(P.is_placeholder(X.strip(c)), F.lit(False)), c)


def _q(name: str) -> str:
    return repr(name) if '"' in name else f'"{name}"'


def _fix(strategy: str, description: str, code: str) -> dict:
    return {"strategy": strategy, "description": description, "code": code}


def generate_fix(kind: str, detail: dict, column: str = "", field_type: str = "") -> dict | None:
    c = _q(column)
    if kind == "mixed_format":
        ftype = detail.get("field_type", field_type)
        strategy = {"date": "normalize_dates", "phone": "normalize_phones", "currency": "normalize_currency"}.get(ftype)
        call = {"date": "dates", "phone": "phones", "currency": "amounts"}.get(ftype)
        return strategy and _fix(strategy, f"Bring all values of {column} into one {ftype} format", f"from dqscan.operators import fixes\ndf = df.withColumn({c}, fixes.{call}(F.col({c})))")
    if kind in ("placeholder_value", "placeholder"):
        return _fix("replace_placeholders", f"Turn the placeholder {detail.get('value', '')!r} in {column} into null", f"df = df.withColumn({c}, F.when(F.trim(F.col({c})) != {_q(str(detail.get('value', '')))}, F.col({c})))")
    if kind == "suspicious_repetition":
        return _fix("flag_repetitions", f"Mark the rows where {column} is {detail.get('value', '')!r}", f"df = df.withColumn({_q(column + '_suspect')}, F.trim(F.col({c})) == {_q(str(detail.get('value', '')))})")
    if kind == "wrong_purpose":
        issue = detail.get("issue", "")
        if "email" in issue.lower():
            return _fix("flag_invalid_emails", f"Mark invalid addresses in {column}", f"df = df.withColumn({_q(column + '_valid')}, F.col({c}).rlike(r'{P.EMAIL}'))")
        if "ID" in issue and "Mixed" in issue:
            return _fix("standardize_ids", f"Give all of {column} one id format", f"df = df.withColumn({c}, F.when(F.col({c}).rlike(r'^\\d+$'), F.concat(F.lit('ID-'), F.col({c}))).otherwise(F.col({c})))")
        if "currency" in issue:
            return _fix("flag_non_numeric", f"Mark text among the amounts of {column}", f"df = df.withColumn({_q(column + '_numeric')}, F.expr('try_cast(regexp_replace(`{column}`, \"[^0-9.-]\", \"\") as double)').isNotNull())")
        return _fix("flag_misuse", f"Mark values in {column} that belong elsewhere", f"df = df.withColumn({_q(column + '_review')}, F.col({c}) == {_q(str(detail.get('example', '')))})")
    if kind == "null_analysis":
        pct = detail.get("missing_pct", 0)
        if pct > 50:
            return _fix("evaluate_column", f"{pct}% of {column} is missing; see whether the column is of use", f"df = df.drop({c})  # or find the missing source")
        if pct > 20:
            return _fix("impute_or_flag", f"Mark or fill the {pct}% missing of {column}", f"df = df.withColumn({_q(column + '_missing')}, F.col({c}).isNull())")
        return _fix("fill_missing", f"Fill the {pct}% missing of {column}", f"df = df.fillna({{{c}: df.agg(F.mode({c})).first()[0]}})")
    return None


def generate_dup_fix(kind: str, detail: dict, sheet: str = "") -> dict | None:
    rows, n = detail.get("rows", []), detail.get("group_size", 0)
    shown = ", ".join(map(str, rows[:10]))
    if kind == "exact_duplicate":
        return _fix("drop_exact_duplicates", f"Remove {n} equal rows (rows {shown})", "df = df.dropDuplicates()")
    if kind == "phantom_duplicate":
        return _fix("normalize_and_dedup", f"Normalise and deduplicate {n} rows (rows {shown})", "for c, t in df.dtypes:\n    if t == 'string':\n        df = df.withColumn(c, F.lower(F.trim(c)))\ndf = df.dropDuplicates()")
    if kind == "fuzzy_duplicate":
        return _fix("review_fuzzy_matches", f"Review {n} similar rows (rows {shown}), found by {detail.get('match_method', 'fingerprint')}", f"df = df.withColumn('fuzzy_review', F.col('row_idx').isin({', '.join(str(r - 2) for r in rows)}))  # from 0")
    return None


def apply_fix(df: DataFrame, fix: dict, column: str, detail: dict | None = None) -> DataFrame:
    """The transform that a fix describes."""
    c, detail = F.col(f"`{column}`") if column else None, detail or {}
    match fix["strategy"]:
        case "normalize_dates":
            return df.withColumn(column, dates(c))
        case "normalize_phones":
            return df.withColumn(column, phones(c))
        case "normalize_currency":
            return df.withColumn(column, amounts(c))
        case "replace_placeholders":
            return df.withColumn(column, without_placeholders(c))
        case "flag_repetitions":
            return df.withColumn(f"{column}_suspect", X.strip(c) == F.lit(detail.get("value")))
        case "flag_invalid_emails":
            return df.withColumn(f"{column}_valid", P.matches(X.strip(c), P.EMAIL))
        case "standardize_ids":
            return df.withColumn(column, F.when(P.matches(c, P.BARE_ID), F.concat(F.lit("ID-"), c)).otherwise(c))
        case "flag_non_numeric":
            return df.withColumn(f"{column}_numeric", amounts(c).isNotNull())
        case "impute_or_flag":
            return df.withColumn(f"{column}_missing", X.clean(c).isNull())
        case "fill_missing":
            return df.fillna({column: df.agg(F.mode(c)).first()[0] or ""})
        case "flag_misuse":
            return df.withColumn(f"{column}_review", X.strip(c) == F.lit(detail.get("example")))
        case "review_fuzzy_matches":
            return df.withColumn("fuzzy_review", F.col("row_idx").isin(*[r - 2 for r in detail.get("rows", [])]))
        case "evaluate_column":
            return df.drop(column)
        case "drop_exact_duplicates":
            return df.dropDuplicates([x for x in df.columns if x != "row_idx"])
        case "normalize_and_dedup":
            texts = {k: F.lower(X.strip(F.col(f"`{k}`"))) for k, t in df.dtypes if t == "string"}
            return df.withColumns(texts).dropDuplicates([x for x in df.columns if x != "row_idx"])
    raise ValueError(f"no transform for {fix['strategy']!r}")
