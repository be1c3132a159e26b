"""Command line: python -m dqscan.cli --input FILE_OR_FOLDER [...]."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections import Counter
from pathlib import Path

from dqscan import __version__


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dqscan", description="Data quality checks for tables of any size.")
    p.add_argument("--input", "-i", required=True, help="file, folder or pattern")
    p.add_argument("--output", "-o", required=True, help="folder of the reports")
    p.add_argument("--json", action="store_true", help="results as JSON as well")
    p.add_argument("--threshold", "-t", type=float, default=0.85, help="similarity of fuzzy duplicates, 0 to 1")
    p.add_argument("--schema", "-s", help="JSON of expected types and completeness")
    p.add_argument("--generate-schema", metavar="PATH", help="write the inferred types as a schema")
    p.add_argument("--baseline", "-b", help="JSON of an earlier audit to compare with")
    p.add_argument("--rules", "-r", help="JSON of further rules")
    p.add_argument("--sarif", metavar="PATH", help="write the findings as SARIF")
    p.add_argument("--export-fixes", metavar="PATH", help="write the remediation plan as CSV")
    p.add_argument("--tables", help="folder of the Parquet tables of all findings and duplicate groups; the shared folder by default")
    p.add_argument("--quiet", "-q", action="store_true")
    p.add_argument("--fail-under", type=int, default=0, help="exit with 1 if the score is below")
    p.add_argument("--max-rows", type=int, help="refuse larger tables unless --force; none by default")
    p.add_argument("--force", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


#: Rows from which a table is called large.
LARGE = 500_000
TINTS = {"High": 31, "Medium": 33, "Low": 36, "bold": 1, "good": 32}


def tinted(text: object, tint: str) -> str:
    """Text in colour, on a terminal that wants some."""
    plain = not sys.stdout.isatty() or "NO_COLOR" in os.environ
    return str(text) if plain else f"\033[{TINTS[tint]}m{text}\033[0m"


def stems(paths: list[str]) -> list[str]:
    """Names of reports: those of the files, with their folders or a number where two would be the same."""
    out: list[str] = []
    names = Counter(Path(p).stem for p in paths)
    for p in map(Path, paths):
        name = p.stem if names[p.stem] == 1 else f"{p.parent.name or 'here'}_{p.stem}_{p.suffix[1:]}"
        while name in out:
            name += "_"
        out.append(name)
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = build_parser().parse_args(argv)
    from dqscan.operators.schema import generate_schema
    from dqscan.plans.audit import count_issues, run_audit
    from dqscan.sources import reports
    from dqscan.sources.files import load_sheets, resolve_inputs, skipped_inputs

    paths = resolve_inputs(args.input)
    say = (lambda *a: None) if args.quiet else print
    for p in skipped_inputs(args.input):
        print(f"skipped {p}: save it as .xlsx", file=sys.stderr)
    if not paths:
        print(f"no supported file at {args.input}", file=sys.stderr)
        return 1
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("dqscan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = Path(args.output)
    out.mkdir(parents=True, exist_ok=True)
    every = []
    for k, (p, stem) in enumerate(zip(paths, stems(paths), strict=True)):
        sheets = load_sheets(spark, p)
        rows = sum(df.count() for df in sheets.values())
        if args.max_rows and rows > args.max_rows and not args.force:
            print(f"{p} has {rows:,} rows, over {args.max_rows:,}; --force audits it all the same", file=sys.stderr)
            return 1
        say(f"[{k + 1}/{len(paths)}] {tinted(p, 'bold')}: {rows:,} rows")
        if rows > LARGE:
            say(tinted(f"warning: over {LARGE:,} rows; this may take a while", "Medium"))
        r = run_audit(spark, p, args.threshold, args.schema, args.baseline, args.rules, sheets=sheets, tables=args.tables)
        every.append(r)
        reports.generate_html(r, str(out / f"{stem}_audit_report.html"))
        reports.generate_excel(r, str(out / f"{stem}_audit_findings.xlsx"))
        reports.generate_pdf(r, str(out / f"{stem}_audit_report.pdf"))
        if args.json:
            reports.generate_json(r, str(out / f"{stem}_audit_results.json"))
        for name, s in r["sheets"].items():
            say(f"  {name}: score {tinted(s['health_score'], 'good' if s['health_score'] >= 90 else 'Medium' if s['health_score'] >= 70 else 'High')}")
            for kind, at in s["full_tables"].items():
                say(f"  {name}: all {kind} in {at}")
        if t := r.get("trend"):
            say(f"  trend: score {t['score_delta']:+}, issues {t['issues_delta']:+}")
        for w in r.get("warnings", []):
            say(tinted(f"  warning: {w}", "Medium"))
    if args.generate_schema:
        Path(args.generate_schema).write_text(json.dumps(generate_schema({"sheets": {f"{k}/{n}": s for k, r in enumerate(every) for n, s in r["sheets"].items()}}), indent=2), encoding="utf-8")
    if args.sarif:
        reports.generate_sarif(every, args.sarif)
    if args.export_fixes:
        reports.export_fixes(every, args.export_fixes)
    total = sum((Counter(count_issues(r)) for r in every), Counter())
    score = round(sum(r["overall_score"] for r in every) / len(every))
    say(f"score {score}; {total['total']} issues: " + ", ".join(tinted(f"{total[s]} {s.lower()}", s) for s in ("High", "Medium", "Low")))
    return int(score < args.fail_under)


if __name__ == "__main__":
    sys.exit(main())
