"""Reports of an audit: HTML, XLSX, PDF, JSON, SARIF and a remediation CSV, written by the standard library alone."""

from __future__ import annotations

import csv
import json
import re
import zipfile
from html import escape
from pathlib import Path
from xml.sax.saxutils import escape as xml

from dqscan import __version__
from dqscan.operators.schema import expected

ORDER = {"High": 0, "Medium": 1, "Low": 2}
COLOURS = {"High": "#c0392b", "Medium": "#d68910", "Low": "#2e86c1"}


def status(score: int) -> str:
    return "Clean" if score >= 90 else "Needs Attention" if score >= 70 else "Critical"


def rows_of(results: dict) -> list[dict]:
    """Every finding as one flat row."""
    from dqscan.plans.api import describe

    out = []
    for sheet, s in results["sheets"].items():
        for column, f in s["fields"].items():
            for i in f["issues"]:
                out.append({"sheet": sheet, "field": column, "type": i.get("rule_name", i["type"]), "kind": i["type"], "severity": i["severity"], "text": describe(i), "why": i.get("why", ""), "fix": i.get("fix") or {}, "inferred": f["inferred_type"], "profile": f["profile"]})
        for part in ("phantom_duplicates", "fuzzy_duplicates"):
            for d in s.get(part, []):
                text = f"{d['group_size']} rows: {', '.join(map(str, d['rows'][:5]))}" + differing(d)
                out.append({"sheet": sheet, "field": "(row-level)", "type": d["type"], "kind": d["type"], "severity": d["severity"], "text": text, "why": d.get("why", ""), "fix": d.get("fix") or {}, "inferred": "", "profile": {}, "sample": d.get("sample_data") or []})
        for v in s.get("schema_violations", []):
            out.append({"sheet": sheet, "field": v["column"], "type": v["type"], "kind": v["type"], "severity": v["severity"], "text": json.dumps(v["detail"]), "why": v.get("why", ""), "fix": {}, "inferred": "", "profile": {}})
    return out


def differing(group: dict) -> str:
    """How the rows of a fuzzy group differ, as text."""
    parts = []
    for c, x in group.get("field_differences", {}).items():
        values, alike = (x["values"], f" ({x['similarity']})") if isinstance(x, dict) else (x, "")
        parts.append(f"{c}: {' / '.join(values)}{alike}")
    return "; " + "; ".join(parts) if parts else ""


def counts_of(results: dict) -> dict[str, int]:
    """Findings by severity, those beyond the lists too."""
    from dqscan.plans.audit import count_issues

    every = count_issues(results)
    return {s: every.get(s, 0) for s in ORDER}


def trend_rows(results: dict) -> list[list]:
    """Sheet, status, score and issues before and now, for every sheet of either run."""
    return [[n, t["status"], t.get("previous_score", ""), t.get("current_score", ""), t.get("previous_issues", ""), t.get("current_issues", "")] for n, t in results.get("trend", {}).get("sheets", {}).items()]


def expected_rows(results: dict) -> list[list]:
    """Sheet, column, expected type, type found and whether it may be missing, for all columns of the schema."""
    out = []
    if schema := results.get("schema"):
        for name, sheet in results["sheets"].items():
            for column, spec in expected(schema, name).items():
                have = sheet["fields"].get(column)
                broken = [v["type"] for v in sheet["schema_violations"] if v["column"] == column]
                out.append([name, column, spec.get("type", ""), have["inferred_type"] if have else "(missing)", "required" if spec.get("required") else "", ", ".join(broken) or "met"])
    return out


def full_tables(results: dict) -> list[list[str]]:
    """Sheet, kind and path of the tables that hold what the lists may leave out."""
    return [[n, kind, at] for n, s in results["sheets"].items() for kind, at in s.get("full_tables", {}).items()]


def generate_json(results: dict, path: str) -> str:
    Path(path).write_text(json.dumps(results, indent=2, default=str), encoding="utf-8")
    return path


def generate_html(results: dict, path: str) -> str:
    e = lambda x: escape(str(x))
    score = results["overall_score"]
    rows, parts = rows_of(results), []
    counts = counts_of(results)
    parts.append(
        f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Data quality: {e(results['input_file'])}</title><style>"
        "body{font:15px system-ui,sans-serif;max-width:70em;margin:2em auto;color:#222}details{border:1px solid #ccc;border-radius:6px;margin:.6em 0;padding:.5em 1em}"
        ".ring{width:110px;height:110px;border-radius:50%;display:grid;place-items:center;font-size:2em;background:conic-gradient(#27ae60 calc(var(--s)*1%),#ddd 0)}.ring b{background:#fff;border-radius:50%;width:84px;height:84px;display:grid;place-items:center}"
        "pre{background:#f4f4f4;padding:.6em;overflow:auto}.tag{color:#fff;border-radius:4px;padding:0 .5em}td,th{text-align:left;padding:.1em .8em}" + "".join(f".{s}{{background:{c}}}" for s, c in COLOURS.items()) + "</style></head><body>"
        f"<h1>{e(results['input_file'])}</h1><div class='ring' style='--s:{score}'><b>{score}</b></div><p>{status(score)}, {e(results['audit_timestamp'])}</p>"
        "<p><input id='q' placeholder='Search' oninput='show()'> " + " ".join(f"<button onclick=\"only('{s}')\">{s} ({counts[s]})</button>" for s in ORDER) + " <button onclick=\"only('')\">All</button></p>"
    )
    parts.extend(f"<p>{e(n)}: all {e(kind)} in {e(at)}</p>" for n, kind, at in full_tables(results))
    if t := results.get("trend"):
        parts.append(f"<p class='trend'>Score {t['previous_score']} to {t['current_score']} ({t['score_delta']:+}), issues {t['previous_issues']} to {t['current_issues']} ({t['issues_delta']:+})</p>")
    table = lambda head, body: "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(x)}</td>" for x in r) + "</tr>" for r in body) + "</table>"
    if found := trend_rows(results):
        parts.append("<h2>Trend</h2>" + table(TREND_HEAD, found))
    if found := expected_rows(results):
        parts.append("<h2>Schema</h2>" + table(SCHEMA_HEAD, found))
    parts.append("<nav><ul>" + "".join(f"<li><a href='#s{k}'>{e(n)}</a></li>" for k, n in enumerate(results["sheets"])) + "</ul></nav>")
    for k, (name, s) in enumerate(results["sheets"].items()):
        parts.append(f"<details open id='s{k}'><summary><b>{e(name)}</b> {s['row_count']} rows, {s['col_count']} columns, score {s['health_score']}</summary>")
        for column, f in s["fields"].items():
            p = f["profile"]
            shown = ", ".join(f"{a.replace('_', ' ')} {b}" for a, b in p.items())
            parts.append(f"<h3>{e(column)} <small>{e(f['inferred_type'])}</small></h3><p><small>{e(shown)}</small></p>")
            parts += [_card(r, e) for r in rows if r["sheet"] == name and r["field"] == column]
        parts += [_card(r, e) for r in rows if r["sheet"] == name and (r["field"] == "(row-level)" or r["field"] not in s["fields"])]
        parts.append("</details>")
    parts.append("<script>let sev='';function only(s){sev=s;show()}function show(){let q=document.getElementById('q').value.toLowerCase();document.querySelectorAll('.card').forEach(c=>c.hidden=(sev&&c.dataset.s!==sev)||(q&&!c.textContent.toLowerCase().includes(q)))}function copy(b){navigator.clipboard.writeText(b.nextElementSibling.textContent)}</script></body></html>")
    Path(path).write_text("".join(parts), encoding="utf-8")
    return path


def _card(r: dict, e) -> str:
    fix = f"<p>{e(r['fix']['description'])}</p><button onclick='copy(this)'>Copy</button><pre>{e(r['fix']['code'])}</pre>" if r["fix"] else ""
    if sample := r.get("sample"):
        fix = "<table><tr>" + "".join(f"<th>{e(c)}</th>" for c in sample[0]) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e('' if x is None else x)}</td>" for x in row.values()) + "</tr>" for row in sample) + "</table>" + fix
    return f"<div class='card' data-s='{r['severity']}'><span class='tag {r['severity']}'>{r['severity']}</span> <b>{e(r['type'])}</b> {e(r['text'])}<br><small>{e(r['why'])}</small>{fix}</div>"


# ---------------------------------------------------------------- XLSX

SCHEMA_HEAD = ("Sheet", "Column", "Expected", "Found", "Required", "State")
TREND_HEAD = ("Sheet", "Status", "Score before", "Score now", "Issues before", "Issues now")
HEADERS = ("Sheet", "Field", "Inferred Type", "Issue Type", "Severity", "Description", "Why It Matters", "Fix Strategy", "Fix Code", "Cardinality", "Uniqueness %")


def write_xlsx(path: str, sheets: dict[str, list[list]], frozen: bool = True) -> str:
    """A workbook of inline texts and numbers."""

    def letters(i: int) -> str:
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    def cell(r: int, c: int, v: object) -> str:
        ref = f"{letters(c)}{r + 1}"
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        style = {"High": ' s="1"', "Medium": ' s="2"', "Low": ' s="3"'}.get(v, "") if isinstance(v, str) else ""
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", "" if v is None else str(v))
        return f'<c r="{ref}" t="inlineStr"{style}><is><t xml:space="preserve">{xml(text)}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c[1:].upper()}"/></patternFill></fill>' for c in COLOURS.values())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{xml(n[:31])}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pkg}/relationships">' + "".join(f'<Relationship Id="r{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + f'<Relationship Id="r0" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font><sz val="11"/></font></fonts><fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/>' + "".join(f'<xf fillId="{k}" applyFill="1"/>' for k in (2, 3, 4)) + "</cellXfs></styleSheet>")
        for i, rows in enumerate(sheets.values()):
            view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>' if frozen and i else ""
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
            filters = f'<autoFilter ref="A1:I{max(len(rows), 1)}"/>' if i else ""
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'{head}<worksheet xmlns="{main}">{view}<sheetData>{body}</sheetData>{filters}</worksheet>')
    return path


def generate_excel(results: dict, path: str) -> str:
    rows = rows_of(results)
    summary = [["File", results["input_file"]], ["Audited", results["audit_timestamp"]], ["Score", results["overall_score"]], ["Status", status(results["overall_score"])], *map(list, counts_of(results).items())]
    summary += [["Sheet", "Rows", "Columns", "Score"], *[[n, s["row_count"], s["col_count"], s["health_score"]] for n, s in results["sheets"].items()]]
    summary += [[f"{n}: all {kind}", at] for n, kind, at in full_tables(results)]
    if t := results.get("trend"):
        summary += [["Previous score", t["previous_score"]], ["Score change", t["score_delta"]], ["Issue change", t["issues_delta"]]]
    found = [[r["sheet"], r["field"], r["inferred"], r["type"], r["severity"], r["text"], r["why"], r["fix"].get("strategy", ""), r["fix"].get("code", ""), r["profile"].get("cardinality", ""), r["profile"].get("uniqueness_pct", "")] for r in rows]
    sheets = {"Summary": summary, "Findings": [list(HEADERS), *found]}
    groups = [[r["sheet"], r["type"], r["severity"], r["text"], *(f"{c}: {x}" for c, x in row.items())] for r in rows for row in r.get("sample", [])]
    for name, head, body in (("Duplicates", ["Sheet", "Kind", "Severity", "Rows", "Sample"], groups), ("Schema", SCHEMA_HEAD, expected_rows(results)), ("Trend", TREND_HEAD, trend_rows(results))):
        if body:
            sheets[name] = [list(head), *body]
    return write_xlsx(path, sheets)


# ---------------------------------------------------------------- PDF


def generate_pdf(results: dict, path: str) -> str:
    """A plain document, a page or more a sheet; columns without issues are left out."""
    rows = rows_of(results)
    pages: list[list[str]] = [[f"Data quality: {results['input_file']}", results["audit_timestamp"], f"Score {results['overall_score']} ({status(results['overall_score'])})", "", *[f"{s}: {n}" for s, n in counts_of(results).items()]]]
    for head, body in ((SCHEMA_HEAD, expected_rows(results)), (TREND_HEAD, trend_rows(results))):
        lines = [" | ".join(head), "", *(" | ".join(map(str, r))[:100] for r in body)]
        pages += [lines[i : i + 52] for i in range(0, len(lines), 52)] if body else []
    for name, s in results["sheets"].items():
        lines = [f"{name}: {s['row_count']} rows, {s['col_count']} columns, score {s['health_score']}", ""]
        for r in (r for r in rows if r["sheet"] == name):
            lines.append(f"[{r['severity']}] {r['field']}: {r['type']}")
            lines += ["    " + r["text"][i : i + 90] for i in range(0, min(len(r["text"]), 360), 90)]
            lines += ["      " + " | ".join("" if x is None else str(x) for x in row.values())[:90] for row in r.get("sample", [])]
        pages += [lines[i : i + 52] for i in range(0, len(lines), 52)]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for lines in pages:
        safe = [x.encode("cp1252", "replace").decode("cp1252").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") for x in lines]
        stream = "BT /F1 10 Tf 14 TL 50 790 Td " + " ".join(f"({x}) Tj T*" for x in safe) + " ET"
        objects.append(f"<< /Length {len(stream.encode('cp1252'))} >>\nstream\n{stream}\nendstream")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents {len(objects)} 0 R /Resources << /Font << /F1 3 0 R >> >> >>")
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>"
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects):
        places.append(len(out))
        out += f"{i + 1} 0 obj\n{o}\nendobj\n".encode("cp1252")
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    out += f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    Path(path).write_bytes(out)
    return path


# ---------------------------------------------------------------- SARIF and CSV


def sarif(all_results: list[dict]) -> dict:
    """SARIF 2.1.0 of the findings on columns."""
    level = {"High": "error", "Medium": "warning", "Low": "note"}
    rules, found = {}, []
    for results in all_results:
        for r in rows_of(results):
            if r["field"] == "(row-level)" or r["kind"].startswith("schema_"):
                continue
            rule = f"custom/{r['type']}" if r["kind"] == "custom_rule" else r["kind"]
            rules.setdefault(rule, {"id": rule, "shortDescription": {"text": r["why"] or rule}})
            found.append({"ruleId": rule, "level": level[r["severity"]], "message": {"text": f"{r['sheet']}.{r['field']}: {r['text']}"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": results["input_file"]}}, "logicalLocations": [{"name": r["field"], "fullyQualifiedName": f"{r['sheet']}.{r['field']}"}]}]})
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "dqscan", "version": __version__, "rules": list(rules.values())}}, "results": found, "properties": {"allFindings": [{"sheet": n, "kind": kind, "path": at} for r in all_results for n, kind, at in full_tables(r)]}}]}


def generate_sarif(all_results: list[dict], path: str) -> str:
    Path(path).write_text(json.dumps(sarif(all_results), indent=2, default=str), encoding="utf-8")
    return path


CSV_COLUMNS = ("File", "Sheet", "Field", "Issue Type", "Severity", "Description", "Fix Strategy", "Fix Code", "Assigned To", "Status")


def export_fixes(all_results: list[dict], path: str) -> str:
    """A remediation plan: a line a finding, the severest first; schema violations have no fix and aren't listed."""
    lines = [(r["severity"], [res["input_file"], r["sheet"], r["field"], r["type"], r["severity"], r["text"], r["fix"].get("strategy", ""), r["fix"].get("code", ""), "", "Open"]) for res in all_results for r in rows_of(res) if not r["kind"].startswith("schema_")]
    lines.sort(key=lambda x: ORDER.get(x[0], 3))
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([CSV_COLUMNS, *(x for _, x in lines)])
    return path
