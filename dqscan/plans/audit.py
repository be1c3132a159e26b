"""The audit of a table: which jobs run, and how their small results become findings."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqscan.functions import patterns as P
from dqscan.functions import text as X
from dqscan.operators import columns as C
from dqscan.operators import duplicates as D
from dqscan.operators import rules as R
from dqscan.operators import scoring as S
from dqscan.operators.fixes import generate_dup_fix, generate_fix
from dqscan.operators.schema import load_schema, validate_schema
from dqscan.operators.trend import compute_trend, load_baseline, severities
from dqscan.plans.spool import keep, spool
from dqscan.sources.files import load_sheets

WHY_IT_MATTERS = {
    "null_analysis": "Missing cells bias counts and averages, and break joins on the column.",
    "mixed_format_date": "Dates in several formats sort and compare wrongly, and day and month get swapped.",
    "mixed_format_phone": "Phone numbers in several formats can't be matched or dialled automatically.",
    "mixed_format_currency": "Amounts in several formats fail to parse, and sums come out short.",
    "wrong_purpose": "Values that belong elsewhere make every use of the column unreliable.",
    "placeholder_value": "Placeholders count as data although nothing is known.",
    "suspicious_repetition": "A value that fills much of a column is often a default that nobody changed.",
    "phantom_duplicate": "Rows that differ in spelling alone count one thing several times.",
    "exact_duplicate": "Equal rows inflate every total.",
    "fuzzy_duplicate": "Similar rows may be one record that was typed twice.",
}


def audit_dataframe(df: DataFrame, name: str = "table", fuzzy_threshold: float = 0.85, rules: list[R.Rule] | None = None, schema: dict | None = None, max_listed: int = 1000, max_pairwise: int | None = 50_000, tables: str | None = None) -> dict:
    """Results of one sheet. Long lists are cut at `max_listed`; counts and scores are of everything.

    All findings and all rows of all duplicate groups are Parquet tables under `tables` (the shared
    folder by default), whose paths are in `full_tables`.
    """
    df = C.with_row_idx(C.as_text(df))
    columns = [c for c in df.columns if c != C.ROW]
    nulls = {r["field"]: r.asDict() for r in C.null_analysis(df).collect()} if columns else {}
    freq = spool(C.frequencies(df))
    total = next(iter(nulls.values()))["total_rows"] if nulls else 0
    vals = spool(C.values(freq))
    nulls = nulls or {c: dict.fromkeys(("null_count", "blank_count", "whitespace_only", "total_missing", "total_rows"), 0) for c in columns}
    types = C.infer_types(df, {c: nulls[c]["total_missing"] < total for c in columns})
    profile = {r["field"]: r.asDict() for r in C.profiles(vals, types).collect()}
    issues: dict[str, list[dict]] = {c: [] for c in columns}
    counts: Counter[str] = Counter()

    def add(column: str, kind: str, detail: dict, severity: str | None = None, why: str | None = None, times: int = 1):
        severity = severity or S.rate_severity(kind, detail)
        if severity is None:
            return
        issue = {"type": kind, "severity": severity, "detail": detail, "why": why or WHY_IT_MATTERS.get(kind, WHY_IT_MATTERS["wrong_purpose"])}
        if fix := generate_fix(kind, detail, column, types[column]):
            issue["fix"] = fix
        issues[column].append(issue)
        counts[severity] += times

    null_info = {}
    for c in columns:
        n = nulls[c]
        null_info[c] = {k: n[k] for k in ("null_count", "blank_count", "whitespace_only", "total_missing", "total_rows")} | {"missing_pct": S.percent(n["total_missing"], total)}
        add(c, "null_analysis", null_info[c])

    spread = spool(C.format_distribution(vals, types))
    by_label = defaultdict(list)
    for r in spread.orderBy(F.desc("n"), "first_row").collect():
        by_label[r["field"]].append((r["label"], r["n"]))
    for r in C.mixed_formats(spread).collect():
        c = r["field"]
        v = X.clean(F.col(f"`{c}`"))
        odd = df.select(C.ROW, v.alias("v")).where(F.col("v").isNotNull() & (P.format_label(F.col("v"), types[c]) == P.NON_STANDARD)).orderBy(C.ROW).limit(5)
        detail = {k: r[k] for k in ("dominant_format", "dominant_count", "inconsistent_count")}
        detail |= {"field_type": types[c], "format_distribution": dict(by_label[c]), "inconsistent_pct": S.percent(r["inconsistent_count"], r["total"]), "sample_nonstandard": [x["v"] for x in odd.collect()]}
        add(c, "mixed_format", detail, why=WHY_IT_MATTERS[f"mixed_format_{types[c]}"])

    wrong = spool(C.misused_cells(df, types))
    kinds = {(r["field"], r["issue"]): r["n"] for r in wrong.groupBy("field", "issue").agg(F.count("*").alias("n")).collect()}
    for (c, issue), n in sorted(kinds.items(), key=lambda x: (columns.index(x[0][0]), x[0][1])):
        listed = wrong.where((F.col("field") == c) & (F.col("issue") == issue)).orderBy(C.ROW).limit(max_listed).collect()
        for r in listed:
            add(c, "wrong_purpose", {"issue": issue, "example": r["example"], "row": r[C.ROW]})
        counts["High"] += n - len(listed)  # those beyond the list count all the same
    shown = {"coded": "coded (e.g. CUST-001)", "bare": "bare numbers", "other": "other"}
    for r in C.id_formats(vals, types).collect():
        parts = sorted(((r[k], k) for k in shown if r[k]), key=lambda x: -x[0])
        add(r["field"], "wrong_purpose", {"issue": "Mixed ID formats", "example": " vs ".join(f"{n} {shown[k]}" for n, k in parts), "row": None})
    for r in C.mixed_booleans(vals, types).collect():
        add(r["field"], "wrong_purpose", {"issue": "Mixed boolean representations", "example": r["spellings"], "row": None})
    casing = spool(C.mixed_casing(vals, types))
    n_casing = {r["field"]: r["n"] for r in casing.groupBy("field").agg(F.count("*").alias("n")).collect()}
    for c, n in n_casing.items():
        listed = casing.where(F.col("field") == c).orderBy("first_row").limit(max_listed).collect()
        for r in listed:
            add(c, "wrong_purpose", {"issue": CASING, "example": r["spellings"], "row": None})
        counts["High"] += n - len(listed)
    for kind, found in (("placeholder_value", C.placeholder_values(vals)), ("suspicious_repetition", C.repeated_values(vals))):
        for r in found.orderBy("field", "rank").collect():
            add(r["field"], kind, {"type": kind, "value": r["v"], "count": r["n"], "pct": S.percent(r["n"], profile[r["field"]]["non_empty_values"])})
    if rules:
        for r in R.evaluate(df, rules, columns).collect():
            rule = rules[r["rule"]]
            if R.fires(rule, r["violations"], r["checked"], r["total"]):
                found = R.finding(rule, r, [] if rule.condition == "max_missing_pct" else R.examples(df, rule, r["field"]))
                issues[r["field"]].append(found)
                counts[rule.severity] += 1

    sheet: dict = {"row_count": total, "col_count": len(columns), "fields": {}, "phantom_duplicates": [], "fuzzy_duplicates": [], "full_tables": {}}
    for c in columns:
        sheet["fields"][c] = {"inferred_type": types[c], "null_analysis": null_info[c], "issues": issues[c], "profile": C.finished_profile(profile.get(c), total)}
    whole: list[DataFrame] = []
    groups = duplicate_groups(df, freq, types, total, fuzzy_threshold, sheet, counts, max_listed, max_pairwise, whole)
    if whole:
        sheet["full_tables"]["groups"] = keep(reduce(DataFrame.unionByName, whole), f"{_file_name(name)}-groups", tables)
    sheet["full_tables"]["findings"] = keep(_all_findings(wrong, casing, issues), f"{_file_name(name)}-findings", tables)
    sheet["schema_violations"] = validate_schema(sheet, schema, name) if schema else []
    counts.update(v["severity"] for v in sheet["schema_violations"])
    sheet["severity_counts"] = {s: counts[s] for s in ("High", "Medium", "Low")}
    sheet["health_score"] = S.health_score(counts, [null_info[c]["missing_pct"] for c in columns], groups)
    return sheet


def _file_name(sheet: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", sheet)


CASING = "Inconsistent casing in categorical values"


def _all_findings(wrong: DataFrame, casing: DataFrame, issues: dict[str, list[dict]]) -> DataFrame:
    """field, type, severity, issue, example, row_idx of every finding on a column, listed or not."""
    from dqscan.plans.api import describe

    schema = "field string, type string, severity string, issue string, example string, row_idx bigint"
    long = {CASING, *(r["issue"] for r in wrong.select("issue").distinct().collect())}
    few = [(c, i.get("rule_name", i["type"]), i["severity"], describe(i), None, None) for c, found in issues.items() for i in found if not (i["type"] == "wrong_purpose" and i["detail"]["issue"] in long)]
    row = lambda d, issue, example, at: d.select("field", F.lit("wrong_purpose").alias("type"), F.lit("High").alias("severity"), issue.alias("issue"), F.col(example).alias("example"), at.cast("long").alias("row_idx"))
    cells = row(wrong, F.col("issue"), "example", F.col(C.ROW)).unionByName(row(casing, F.lit(CASING), "spellings", F.lit(None)))
    return cells.unionByName(wrong.sparkSession.createDataFrame(few, schema))


def duplicate_groups(df: DataFrame, freq: DataFrame, types: dict, total: int, threshold: float, sheet: dict, counts: Counter, listed: int, max_pairwise: int | None, whole: list[DataFrame]) -> Counter:
    """Enters the duplicate groups of a table into `sheet`, their severities into `counts` and all their rows into `whole`; gives the groups by kind."""
    kinds: Counter[str] = Counter()
    if total < 2:
        return kinds
    ids, content, signature = D.content_columns(df, types, freq)
    first_six = [c for c in df.columns if c != C.ROW][:6]

    def describe(groups: DataFrame, member: DataFrame, matched_on: list[str], differences: str | None = None) -> list[dict]:
        """The first groups with their first rows; `differences`: how their columns differ, by values or with similarities."""
        top = groups.orderBy("first_row").limit(listed)
        keep = spool(member.join(F.broadcast(top.select("first_row")), "first_row"))  # `listed` groups at most
        rows = {r["first_row"]: r["rows"] for r in D.first_rows(keep, listed).collect()}
        wanted = sorted({x for r in rows.values() for x in r[:3]})
        cells = {r[C.ROW]: r for r in df.where(F.col(C.ROW).isin(*wanted)).collect()} if wanted else {}
        differ: dict[int, dict] = defaultdict(dict)
        if differences:
            for r in D.field_differences(df, keep, content, differences == "levenshtein").collect():
                differ[r["first_row"]][r["field"]] = {"values": r["values"], "similarity": r["similarity"]} if differences == "levenshtein" else r["values"]
        out = []
        for g in top.collect():
            own = rows[g["first_row"]]
            out.append({"rows": [r + 2 for r in own], "group_size": g["group_size"], "sample_data": [{c: cells[r][c] for c in first_six} for r in own[:3]], "matched_on": matched_on, "excluded_id_cols": ids})
            if differences:
                out[-1]["field_differences"] = {c: differ[g["first_row"]][c] for c in content if c in differ[g["first_row"]]}
        return out

    def record(kind, groups: DataFrame, member: DataFrame):
        """All rows of all groups: kind, first_row, group_size, row_idx."""
        whole.append(member.join(groups.select("first_row", "group_size", kind.alias("kind")), "first_row").select("kind", "first_row", "group_size", F.col(C.ROW).alias("row_idx")))

    def enter(found: list[dict], part: str, kind_of):
        for d in found:
            kind = kind_of(d)
            d |= {"type": kind, "severity": S.rate_severity(kind, d), "why": WHY_IT_MATTERS[kind]}
            if fix := generate_dup_fix(kind, d):
                d["fix"] = fix
            sheet[part].append(d)

    matched = None
    if signature:
        phantom = spool(D.phantom_groups(df, content, signature))
        level = F.when(F.col("exact_match") | (F.col("group_size") > 3), "High").otherwise("Medium")
        for r in phantom.groupBy("exact_match", level.alias("s")).agg(F.count("*").alias("n")).collect():
            kinds["exact_duplicate" if r["exact_match"] else "phantom_duplicate"] += r["n"]
            counts[r["s"]] += r["n"]
        matched = spool(D.members(df, phantom, signature, X.collapsed))
        record(F.when(F.col("exact_match"), "exact_duplicate").otherwise("phantom_duplicate"), phantom, matched)
        found = describe(phantom, matched, signature)
        for d, r in zip(found, phantom.orderBy("first_row").limit(listed).collect(), strict=True):
            d["exact_match"] = r["exact_match"]
        enter(found, "phantom_duplicates", lambda d: "exact_duplicate" if d["exact_match"] else "phantom_duplicate")

    prints = spool(D.fingerprint_groups(df, content, matched))
    by_print = spool(D.members(df, prints, content, X.token_print))
    record(F.lit("fingerprint"), prints, by_print)
    found = describe(prints, by_print, content, "fingerprint")
    n = prints.count()
    kinds["fuzzy_duplicate"] += n
    counts["Medium"] += n
    for d in found:
        d |= {"match_method": "fingerprint", "similarity_threshold": threshold}
    enter(found, "fuzzy_duplicates", lambda d: "fuzzy_duplicate")

    rest = df.join(by_print.select(C.ROW), C.ROW, "left_anti")
    if matched is not None:
        rest = rest.join(matched.select(C.ROW), C.ROW, "left_anti")
    rest = spool(rest.select(C.ROW, D.row_text(content).alias("s")))
    n = rest.count()
    if max_pairwise is not None and n > max_pairwise:
        sheet["fuzzy_skipped"] = {"unmatched_rows": n, "limit": max_pairwise}
        return kinds
    grouped = spool(D.edit_groups(rest, threshold, n=n).withColumnRenamed("seed", "first_row"))
    sizes = grouped.groupBy("first_row").agg((F.count("*") + 1).alias("group_size"))
    everyone = grouped.unionByName(sizes.select("first_row", F.col("first_row").alias(C.ROW)))
    record(F.lit("levenshtein"), sizes, everyone)
    found = describe(sizes, everyone, content, "levenshtein")
    n = sizes.count()
    kinds["fuzzy_duplicate"] += n
    counts["Low"] += n
    for d in found:
        d |= {"match_method": "levenshtein", "similarity_threshold": threshold}
    enter(found, "fuzzy_duplicates", lambda d: "fuzzy_duplicate")
    return kinds


def run_audit(spark: SparkSession, path: str, fuzzy_threshold: float = 0.85, schema_path: str | None = None, baseline_path: str | None = None, rules_path: str | None = None, sheets: dict[str, DataFrame] | None = None, **options) -> dict:
    """Results of all sheets of a file, which may be loaded already."""
    schema = load_schema(schema_path) if schema_path else None
    rules = R.load_rules(rules_path) if rules_path else None
    results: dict = {"input_file": os.path.basename(path), "audit_timestamp": datetime.now().strftime("%Y-%m-%d %H:%M:%S"), "sheets": {}}
    for name, df in (load_sheets(spark, path) if sheets is None else sheets).items():
        if not df.columns or not df.limit(1).count():
            continue
        sheet = results["sheets"][name] = audit_dataframe(df, name, fuzzy_threshold, rules, schema, **options)
        if skipped := sheet.get("fuzzy_skipped"):
            results.setdefault("warnings", []).append(f"{name}: no edit distances for {skipped['unmatched_rows']} unmatched rows, over the limit of {skipped['limit']}")
    results["overall_score"] = S.overall([s["health_score"] for s in results["sheets"].values()])
    if schema:
        results["schema"] = schema
    if rules:
        results["rules"] = [r.name for r in rules]
    if baseline_path:
        results["trend"] = compute_trend(results, load_baseline(baseline_path))
    return results


def run_multi_audit(spark: SparkSession, paths: list[str], **options) -> dict:
    """Results of several files by path, with a score weighted by rows."""
    files = {p: run_audit(spark, p, **options) for p in paths}
    rows = [(s["row_count"], s["health_score"]) for r in files.values() for s in r["sheets"].values()]
    total = sum(n for n, _ in rows)
    return {"files": files, "overall_score": round(sum(n * s for n, s in rows) / total) if total else 100, "total_files": len(files), "total_rows": total}


def count_issues(results: dict) -> dict[str, int]:
    """Issues in all, by severity, and schema violations: of everything, listed or not."""
    out: Counter[str] = Counter()
    for sheet in results["sheets"].values():
        every = severities(sheet)
        out.update(every)
        out["total"] += every.total()
        out["schema"] += len(sheet.get("schema_violations", []))
    return dict(out)
