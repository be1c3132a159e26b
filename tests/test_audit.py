"""Whole audits, files, reports, the command line and the registered queries."""

import glob
import importlib.util
import json
import os
import xml.dom.minidom
import zipfile

import pytest

from dqscan import cli
from dqscan.operators.trend import compute_trend
from dqscan.plans import catalogue
from dqscan.plans.api import audit_file, audit_table
from dqscan.plans.audit import count_issues, run_audit, run_multi_audit
from dqscan.sources import reports
from dqscan.sources.files import load_sheets, resolve_inputs, skipped_inputs, unique_names

DATA = "/root/testdata/sf0.001"
MESSY = [
    ["Customer ID", "Name", "Phone", "Join Date", "Balance", "Status", "Note"],
    ["C-1", "Ann Lee", "(555) 123-4567", "2023-01-15", "$1,250.00", "Active", 'said "hi"'],
    ["C-2", "ann lee ", "(555) 123-4567", "2023-01-15", "$1,250.00", "active", 'said "hi"'],
    ["C-3", "REF-77", "555.123.9999", "01/16/2023", "five", "ACTIVE", ""],
    ["4", "Test", "N/A", "", "$0.00", "Closed", "NA"],
    ["C-5", "Bob Ray", "5551239999", "Jan 5, 2023", "$0.00", "Closed", "two\nlines"],
    ["C-6", "Bob Ray", "5551239999", "Jan 5, 2023", "$0.00", "Closed", "two\nlines"],
    ["C-7", "Johnathan Smithson", "555-123-0001", "2023-02-01", "$10.00", "Open", "z"],
    ["C-8", "Johnathon Smithson", "555-123-0001", "2023-02-01", "$10.00", "Open", "z"],
]


@pytest.fixture(scope="module")
def messy(tmp_path_factory):
    import csv

    d = tmp_path_factory.mktemp("in")
    with open(d / "messy.csv", "w", newline="") as f:
        csv.writer(f).writerows(MESSY)
    with open(d / "messy.tsv", "w", newline="") as f:
        csv.writer(f, delimiter="\t").writerows(MESSY)
    reports.write_xlsx(str(d / "messy.xlsx"), {"One": MESSY, "Two": [["A", "A"], ["1", "2"]]})
    (d / "note.txt").write_text("no table")
    return d


@pytest.fixture(scope="module")
def results(spark, messy):
    return run_audit(spark, str(messy / "messy.csv"))


def test_findings(results):
    sheet = results["sheets"]["messy"]
    kinds = {c: [(i["type"], i["detail"].get("issue") or i["detail"].get("value")) for i in f["issues"]] for c, f in sheet["fields"].items()}
    assert sheet["row_count"] == 8
    assert ("wrong_purpose", "Mixed ID formats") in kinds["Customer ID"]
    assert ("wrong_purpose", "Code/ID stuffed in name field") in kinds["Name"] and ("placeholder_value", "Test") in kinds["Name"]
    assert ("wrong_purpose", "Text in currency field") in kinds["Balance"]
    assert ("wrong_purpose", "Inconsistent casing in categorical values") in kinds["Status"]
    assert [i["type"] for i in sheet["fields"]["Phone"]["issues"]][:2] == ["null_analysis", "mixed_format"]
    assert sheet["fields"]["Note"]["null_analysis"]["null_count"] == 2
    assert [(d["type"], d["rows"]) for d in sheet["phantom_duplicates"]] == [("phantom_duplicate", [2, 3]), ("exact_duplicate", [6, 7])]
    assert [(d["match_method"], d["rows"]) for d in sheet["fuzzy_duplicates"]] == [("levenshtein", [8, 9])]
    assert sum(count_issues(results)[s] for s in ("High", "Medium", "Low")) == count_issues(results)["total"]


def test_all_formats_of_files_agree(spark, messy, results):
    want = results["sheets"]["messy"]["health_score"]
    for name, sheet in (("messy.tsv", "messy"), ("messy.xlsx", "One")):
        s = run_audit(spark, str(messy / name))["sheets"][sheet]
        assert (s["health_score"], s["row_count"]) == (want, 8)
    assert load_sheets(spark, str(messy / "messy.xlsx"))["Two"].columns == ["row_idx", "A", "A.1"]
    with pytest.raises(ValueError):
        load_sheets(spark, "x.xls")


def test_inputs(messy):
    assert [os.path.basename(p) for p in resolve_inputs(str(messy))] == ["messy.csv", "messy.tsv", "messy.xlsx"]
    assert resolve_inputs(str(messy / "note.txt")) == [] and len(resolve_inputs(str(messy / "*.csv"))) == 1
    assert unique_names(["a", "a", ""]) == ["a", "a.1", "Unnamed: 2"]


def test_reports(results, tmp_path):
    html = open(reports.generate_html(results, str(tmp_path / "r.html"))).read()
    assert "Mixed ID formats" in html and "<script>" in html and "said <" not in html
    path = reports.generate_excel(results, str(tmp_path / "r.xlsx"))
    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            xml.dom.minidom.parseString(z.read(n))
    assert open(reports.generate_pdf(results, str(tmp_path / "r.pdf")), "rb").read().startswith(b"%PDF")
    s = reports.sarif([results])["runs"][0]
    assert {r["level"] for r in s["results"]} <= {"error", "warning", "note"} and s["results"]
    lines = open(reports.export_fixes([results], str(tmp_path / "f.csv"))).read()
    assert lines.startswith("File,Sheet,Field") and "drop_exact_duplicates" in lines


def test_reports_show_samples_schema_and_trend(spark, messy, tmp_path):
    spec, then = tmp_path / "s.json", tmp_path / "b.json"
    spec.write_text(json.dumps({"columns": {"Name": {"type": "name"}, "Region": {"type": "name", "required": True}}}))
    then.write_text(json.dumps({"overall_score": 90, "sheets": {"messy": {"health_score": 90, "fields": {}}, "gone": {"health_score": 1, "fields": {}}}}))
    r = run_audit(spark, str(messy / "messy.csv"), schema_path=str(spec), baseline_path=str(then))
    assert reports.expected_rows(r) == [["messy", "Name", "name", "name", "", "met"], ["messy", "Region", "name", "(missing)", "required", "schema_missing_column"]]
    assert [x[:3] for x in reports.trend_rows(r)] == [["gone", "removed", ""], ["messy", "compared", 90]]
    html = open(reports.generate_html(r, str(tmp_path / "r.html"))).read()
    assert all(x in html for x in ("<h2>Trend</h2>", "<h2>Schema</h2>", "<td>ann lee </td>", "schema_missing_column"))
    with zipfile.ZipFile(reports.generate_excel(r, str(tmp_path / "r.xlsx"))) as z:
        book = z.read("xl/workbook.xml").decode()
        for n in z.namelist():
            xml.dom.minidom.parseString(z.read(n))
    assert all(f'name="{x}"' in book for x in ("Summary", "Findings", "Duplicates", "Schema", "Trend"))
    assert b"schema_missing_column" in open(reports.generate_pdf(r, str(tmp_path / "r.pdf")), "rb").read()


def test_command_line(spark, messy, tmp_path):
    paths = ["--sarif", str(tmp_path / "audit_results.sarif"), "--export-fixes", str(tmp_path / "remediation_plan.csv"), "--generate-schema", str(tmp_path / "generated_schema.json")]
    args = ["-i", str(messy / "messy.csv"), "-o", str(tmp_path), "--json", *paths, "-q"]
    assert cli.main(args, spark) == 0
    assert {p.name for p in tmp_path.iterdir()} == {"messy_audit_report.html", "messy_audit_findings.xlsx", "messy_audit_report.pdf", "messy_audit_results.json", "audit_results.sarif", "remediation_plan.csv", "generated_schema.json"}
    again = ["--input", str(messy / "messy.csv"), "--output", str(tmp_path), "--quiet", "-b", str(tmp_path / "messy_audit_results.json"), "-s", str(tmp_path / "generated_schema.json"), "--fail-under", "101"]
    assert cli.main(again, spark) == 1
    assert cli.main(["--input", str(tmp_path / "none"), "-o", str(tmp_path)], spark) == 1
    assert cli.main(["--input", str(messy / "messy.csv"), "-o", str(tmp_path), "--max-rows", "3", "--quiet"], spark) == 1


def test_reports_of_one_name_stay_apart(tmp_path):
    assert cli.stems(["a/x.csv", "b/x.csv", "b/x.tsv", "b/y.csv"]) == ["a_x_csv", "b_x_csv", "b_x_tsv", "y"]
    (tmp_path / "old.xls").write_text("")
    assert resolve_inputs(str(tmp_path)) == [] and skipped_inputs(str(tmp_path)) == [str(tmp_path / "old.xls")]


def test_dates_and_numbers_of_workbooks(spark, tmp_path):
    """Serial numbers in date formats read as dates, whole numbers without a point."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    path = str(tmp_path / "d.xlsx")
    reports.write_xlsx(path, {"S": [["When", "N"]]})
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;x&quot;"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'.encode()
    cells = [("44941", 1), ("44941.5", 2), ("0.25", 1), ("7.50", 3), ("12", 0), ("0.1", 0)]
    rows = "".join(f'<row r="{k + 2}"><c r="A{k + 2}" s="{s}"><v>{v}</v></c></row>' for k, (v, s) in enumerate(cells))
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>When</t></is></c></row>{rows}</sheetData></worksheet>'.encode()
    with zipfile.ZipFile(path, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    got = [r["When"] for r in load_sheets(spark, path)["S"].orderBy("row_idx").collect()]
    assert got == ["2023-01-15 00:00:00", "2023-01-15 12:00:00", "06:00:00", "7.5", "12", "0.1"]


def test_headers_over_several_lines_and_names_of_our_own(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"first\nname",row_idx\nAnn,7\nBob,9\n')
    df = load_sheets(spark, str(tmp_path / "h.csv"))["h"]
    assert df.columns == ["row_idx", "first\nname", "row_idx (own)"]
    assert [tuple(r) for r in df.orderBy("row_idx").collect()] == [(0, "Ann", "7"), (1, "Bob", "9")]
    own = spark.createDataFrame([("a", "x"), ("b", "y")], "row_idx string, n string")
    assert set(audit_table(own).raw["sheets"]["table"]["fields"]) == {"row_idx (own)", "n"}


def test_differences_of_fuzzy_groups(spark):
    df = spark.createDataFrame([("1", "Smith, John", "Portland"), ("2", "John Smith", "Portland"), ("3", "Smith, John", "Seattle"), ("4", "Johnathan Smithson", "Austin"), ("5", "Johnathon Smithson", "Austin")], "ID string, Name string, City string")
    prints, edits = audit_table(df).sheets[0].fuzzy_duplicates
    assert prints.field_differences == {"Name": ["Smith, John", "John Smith"]}
    assert edits.field_differences == {"Name": {"values": ["Johnathan Smithson", "Johnathon Smithson"], "similarity": 0.94}}
    assert "Name: Smith, John / John Smith" in reports.rows_of(audit_table(df).raw)[-2]["text"]


def test_public_names(spark):
    import dqscan

    assert all(getattr(dqscan, n) is not None for n in dqscan.__all__)
    df = spark.createDataFrame([("C-1", "2023-01-02", "REF-1"), ("2", "01/02/2023", "N/A"), ("C-1", "x", " ")], "Customer_ID string, Join_Date string, Name string")
    assert dqscan.infer_field_type(df, "Join_Date") == "date"
    assert dqscan.analyze_nulls(df, "Name")["whitespace_only"] == 1
    assert dqscan.analyze_mixed_formats(df, "Join_Date")["sample_nonstandard"] == ["x"] and dqscan.analyze_mixed_formats(df, "Name") is None
    assert [d["issue"] for d in dqscan.analyze_wrong_purpose(df, "Customer_ID")] == ["Mixed ID formats"]
    assert [d["value"] for d in dqscan.analyze_placeholders(df, "Name")] == ["N/A"]
    twice = df.unionByName(df)
    assert [d["rows"] for d in dqscan.analyze_phantom_duplicates(twice)] == [[2, 5], [3, 6], [4, 7]]
    assert dqscan.analyze_fuzzy_duplicates(df.select("Name")) == []


def test_typed_results(spark, messy):
    r = audit_file(spark, str(messy / "messy.csv"))
    assert r.total_issues == r.high_issues + r.medium_issues + r.low_issues
    assert r.sheets[0].duplicates[1].exact_match and r.findings[0].fix.code


def test_clean_and_single_row(spark):
    df = spark.createDataFrame([("Ann", "ann@x.org")], "Name string, Email string")
    r = audit_table(df)
    assert r.sheets[0].row_count == 1 and r.overall_score == 100 and not r.sheets[0].duplicates


def test_totals_and_tables_hold_what_the_lists_leave_out(spark, tmp_path):
    rows = [(f"REF-{i}", f"a{i % 3} same" if i < 60 else f"b{i * i}", f"k{i:04}") for i in range(90)]
    df = spark.createDataFrame(rows, "Name string, Note string, Customer_ID string")
    short, whole = (audit_table(df, max_listed=n, tables=str(tmp_path)) for n in (7, 1000))
    assert len(short.findings) < 90 <= len(whole.findings)
    assert (short.total_issues, short.high_issues, short.low_issues) == (whole.total_issues, whole.high_issues, whole.low_issues)
    assert whole.total_issues == len(whole.findings) + len(whole.sheets[0].duplicates) + len(whole.sheets[0].fuzzy_duplicates)
    assert count_issues(short.raw) == count_issues(whole.raw)
    trend = compute_trend(short.raw, whole.raw)
    assert trend["issues_delta"] == 0 and trend["current_issues"] == whole.total_issues
    tables = {k: spark.read.parquet(p) for k, p in short.sheets[0].full_tables.items()}
    assert tables["findings"].count() == len(whole.findings)
    assert tables["findings"].where("issue like 'Code/ID%'").select("row_idx").distinct().count() == 90
    wanted = sorted(x for d in [*whole.sheets[0].duplicates, *whole.sheets[0].fuzzy_duplicates] for x in d.rows)
    assert wanted and sorted(r["row_idx"] + 2 for r in tables["groups"].collect()) == wanted


def test_scores_are_weighted_by_rows(spark, messy):
    m = run_multi_audit(spark, [str(messy / "messy.csv"), str(messy / "messy.xlsx")])
    assert m["total_files"] == 2 and m["total_rows"] == 17


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from dqscan.streaming import counts

    t = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(mins=(F.col("id") / 10).cast("int"))
    spark.range(100).select(t.alias("ts"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, " ").otherwise("2024-01-01").alias("x")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, x string").parquet(str(tmp_path / "in"))
    for name, df in (("missing", counts.missing_by_window(stream, "ts", ["x"])), ("formats", counts.formats_by_window(stream, "ts", "x", "date"))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select sum(null_count), sum(blank_count), sum(total_rows) from missing").first()[:] == (34, 33, 100)
    assert spark.sql("select sum(n) from formats where label = 'YYYY-MM-DD'").first()[0] == 33


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    if name not in catalogue.ORACLE:
        assert rows
        return
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(f"select {', '.join(columns)} from ({catalogue.ORACLE[name]})").fetchall()
    assert rows == sorted(map(repr, want)) and rows


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert bool([q for q in e.queries() if q.startswith("op")]) == (importlib.util.find_spec("dqscan.llm.queries") is not None if importlib.util.find_spec("dqscan.llm") else False)
    if os.path.isdir(DATA):
        assert e.entry(spark).count() == 9


def test_json_round_trip(results):
    assert json.loads(json.dumps(results, default=str))["overall_score"] == results["overall_score"]


def test_planted_faults_are_found(spark, tmp_path):
    """Every fault of the sample workbook, counted off its rows."""
    from dqscan.sources import sample

    sheets = run_audit(spark, sample.write_sample(str(tmp_path / "sample.xlsx"), 120))["sheets"]
    rows = sample.customers(120)[1:]
    fields = sheets["Customers"]["fields"]
    found = lambda c, kind: [i["detail"] for i in fields[c]["issues"] if i["type"] == kind]
    assert sheets["Customers"]["row_count"] == len(rows) == 126 and sheets["Orders"]["row_count"] == 135
    assert found("JoinDate", "mixed_format")[0]["inconsistent_count"] == sum("/" in r[4] for r in rows)
    assert found("Phone", "mixed_format")[0]["inconsistent_count"] == sum("." in r[3] for r in rows)
    issues = lambda c, start: sum(d["issue"].startswith(start) for d in found(c, "wrong_purpose"))
    assert issues("Name", "Code/ID") == sum("REF-" in r[1] for r in rows)
    assert issues("Balance", "Text") == sum("known" in r[5] for r in rows)
    assert issues("Email", "Invalid") == sum(r[2] == "no address" for r in rows)
    assert issues("Status", "Inconsistent casing") == 1
    assert found("Notes", "placeholder_value")[0]["count"] == sum(r[7] == "TBD" for r in rows)
    assert fields["Notes"]["null_analysis"]["null_count"] == sum(r[7] is None for r in rows)
    assert [d["type"] for d in sheets["Customers"]["phantom_duplicates"]] == ["phantom_duplicate"] * 6
    assert [d["type"] for d in sheets["Orders"]["phantom_duplicates"]] == ["exact_duplicate"] * 15
    assert sheets["Orders"]["fields"]["ShipDate"]["null_analysis"]["null_count"] == sum(r[4] is None for r in sample.orders(120))
