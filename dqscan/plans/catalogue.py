"""The registered queries over the driver's tables, each with its SQL twin.

The tables are clean, so that the queries make a mess of them first, by expressions over their keys
that read the same in Spark and in DuckDB.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqscan.functions import patterns as P
from dqscan.functions import text as X
from dqscan.operators import columns as C
from dqscan.operators import duplicates as D
from dqscan.operators import fixes
from dqscan.operators import rules as R
from dqscan.operators import scoring as S
from dqscan.operators import trend
from dqscan.operators.schema import validate_schema
from dqscan.plans.audit import audit_dataframe, count_issues

K = "c_custkey"
CUSTOMER = {
    "cust_id": f"CASE WHEN {K} % 10 = 0 THEN cast({K} as string) WHEN {K} % 23 = 0 THEN 'x' ELSE 'CUST-' || cast({K} as string) END",
    "full_name": f"CASE {K} % 11 WHEN 0 THEN 'REF-' || cast({K} as string) WHEN 1 THEN upper(c_name) WHEN 2 THEN ' ' || c_name || '  ' WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN '   ' WHEN 6 THEN cast({K} as string) WHEN 7 THEN 'TBD' ELSE c_name END",
    "phone": f"CASE {K} % 8 WHEN 0 THEN '(' || lpad(cast({K} % 900 + 100 as string), 3, '0') || ') 555-0' || lpad(cast({K} % 1000 as string), 3, '0') WHEN 1 THEN '555-123-' || lpad(cast({K} % 10000 as string), 4, '0') WHEN 2 THEN '555123' || lpad(cast({K} % 10000 as string), 4, '0') WHEN 3 THEN '555.123.' || lpad(cast({K} % 10000 as string), 4, '0') WHEN 4 THEN '+1-555-123-' || lpad(cast({K} % 10000 as string), 4, '0') WHEN 5 THEN '12' WHEN 6 THEN NULL ELSE '(555) 123-4567' END",
    "join_date": f"CASE {K} % 6 WHEN 0 THEN '2023-0' || cast({K} % 9 + 1 as string) || '-11' WHEN 1 THEN '01/1' || cast({K} % 9 as string) || '/2022' WHEN 2 THEN 'Mar 5, 202' || cast({K} % 4 as string) WHEN 3 THEN '5-Jan-2021' WHEN 4 THEN 'soon' ELSE '2023-01-01' END",
    "balance": f"CASE {K} % 7 WHEN 0 THEN '$1,2' || cast({K} % 90 + 10 as string) || '.50' WHEN 1 THEN '$' || cast({K} as string) WHEN 2 THEN cast({K} as string) || '.00' WHEN 3 THEN cast({K} as string) WHEN 4 THEN 'none given' WHEN 5 THEN '$-12.00' ELSE NULL END",
    "email": f"CASE {K} % 5 WHEN 0 THEN 'u' || cast({K} as string) || '@example.com' WHEN 1 THEN 'no at sign' WHEN 2 THEN 'N/A' WHEN 3 THEN 'a@b' ELSE 'test@test.com' END",
    "status": f"CASE {K} % 5 WHEN 0 THEN 'Active' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'closed' WHEN 3 THEN lower(c_mktsegment) ELSE c_mktsegment END",
    "flag": f"CASE {K} % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'true' ELSE '1' END",
    "notes": f"CASE {K} % 9 WHEN 0 THEN 'TEST' WHEN 1 THEN 'test' WHEN 2 THEN '----' WHEN 3 THEN 'unknown' WHEN 4 THEN 'called back' WHEN 5 THEN 'called back' ELSE NULL END",
}
PART = {
    "p_id": "cast(p_partkey as string)",
    "title": "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name || '!' WHEN 2 THEN p_name ELSE p_name END",
    "brand": "CASE p_partkey % 3 WHEN 0 THEN lower(p_brand) ELSE p_brand END",
    "made_of": "p_type",
}
#: A few hundred short names with planted typing errors.
NAMES = "lower(p_brand) || ' ' || CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN replace(p_type, 'E', 'F') WHEN 2 THEN p_type || 'S' ELSE substr(p_type, 2, 100) END || ' ' || cast(p_partkey % 7 as string)"
TYPES = {"cust_id": "id", "full_name": "name", "phone": "phone", "join_date": "date", "balance": "currency", "email": "email", "status": "categorical", "flag": "categorical", "notes": "freetext"}

RULES = [
    R.Rule("phone form", "Phones have one form", "High", "regex_match", r"\(\d{3}\) \d{3}-\d{4}", ["phone"]),
    R.Rule("no test mail", "No test addresses", "Medium", "not_regex_match", r"test@.*", ["email"]),
    R.Rule("long names", "Names have five letters", "Low", "min_length", 5, ["full_name"]),
    R.Rule("short notes", "Notes are short", "Low", "max_length", 7, ["notes"]),
    R.Rule("known states", "Known states alone", "High", "allowed_values", ["active", "closed"], ["status"]),
    R.Rule("no placeholders", "No placeholders", "Medium", "disallowed_values", ["tbd", "test"], None, "name|note"),
    R.Rule("filled", "Names are filled", "High", "max_missing_pct", 20, ["full_name"]),
]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr(f"{K} AS row_idx", *[f"{e} AS {c}" for c, e in CUSTOMER.items()])


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS row_idx", *[f"{e} AS {c}" for c, e in PART.items()])


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS row_idx", f"{NAMES} AS s")


# ---------------------------------------------------------------- SQL parts

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_M = "m AS (SELECT {key} AS row_idx, {cols} FROM {table})"
SQL_CUSTOMER = _M.format(key=K, cols=", ".join(f"{e} AS {c}" for c, e in CUSTOMER.items()), table="customer")
SQL_PART = _M.format(key="p_partkey", cols=", ".join(f"{e} AS {c}" for c, e in PART.items()), table="part")
SQL_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS raw, row_idx FROM m" for c in CUSTOMER) + ")"
SQL_VALS = f"vals AS (SELECT field, v, count(*) AS n, min(row_idx) AS first_row FROM (SELECT field, row_idx, {_STRIP.format('raw')} AS v FROM long) WHERE v <> '' GROUP BY field, v)"
WITH_VALS = f"WITH {SQL_CUSTOMER}, {SQL_LONG}, {SQL_VALS}"


def _match(c: str, p: str) -> str:
    return f"regexp_matches({c}, '{p}')"


def _label_sql(kind: str, c: str) -> str:
    return "CASE " + " ".join(f"WHEN {_match(c, p)} THEN '{label}'" for p, label in P.FORMATS[kind]) + f" ELSE '{P.NON_STANDARD}' END"


_LABELS = "CASE field " + " ".join(f"WHEN '{f}' THEN {_label_sql(k, 'v')}" for f, k in TYPES.items() if k in P.FORMATS) + " END"
SQL_FORMATS = f"formats AS (SELECT field, label, sum(n)::BIGINT AS n, min(first_row) AS first_row FROM (SELECT *, {_LABELS} AS label FROM vals) WHERE label IS NOT NULL GROUP BY field, label)"
_PLACEHOLDER = f"regexp_matches(v, '{P.PLACEHOLDER}', 'i')"
_COLLAPSED = r"regexp_replace(regexp_replace(lower(" + _STRIP.format("coalesce({0}, '')") + r"), '\s+', ' ', 'g'), '[^\w\s@.]', '', 'g')"
_TOKENS = r"array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower(" + _STRIP.format("coalesce({0}, '')") + r"), '[^\w\s]', '', 'g'), '\s+'), lambda x: x <> '')), ' ')"
SQL_NULLS = f"nulls AS (SELECT field, count(*) FILTER (raw IS NULL) AS null_count, count(*) FILTER (raw = '') AS blank_count, count(*) FILTER (length(raw) > 0 AND {_STRIP.format('raw')} = '') AS whitespace_only, count(*) FILTER (raw IS NULL OR {_STRIP.format('raw')} = '') AS total_missing, count(*) AS total_rows FROM long GROUP BY field)"


def _rate_sql(kind: str, part_: str, whole: str) -> str:
    return "CASE " + " ".join(f"WHEN {part_} * 2000 > {whole} * {20 * limit + 1} THEN '{s}'" if limit is not None else f"ELSE '{s}'" for limit, s in S.LIMITS[kind]) + " END"


def _pairs_sql(threshold: str, rare: str = ">= 2") -> str:
    return f"""t AS (SELECT p_partkey AS row_idx, {NAMES} AS s FROM part),
grams AS (SELECT DISTINCT row_idx, length(s) AS size, substring(s, i::INT, 3) AS gram FROM (SELECT row_idx, s, unnest(range(1, greatest(length(s) - 2, 1) + 1)) AS i FROM t)),
rare AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) {rare}),
g AS (SELECT * FROM grams JOIN rare USING (gram)),
shared AS (SELECT a.row_idx AS a, b.row_idx AS b, count(*) AS shared, min(least(a.size, b.size)) AS shorter FROM g a JOIN g b ON a.gram = b.gram AND a.row_idx < b.row_idx GROUP BY 1, 2),
cand AS (SELECT a, b, shared FROM shared WHERE shared >= CASE WHEN shorter < 9 THEN 1 ELSE 2 END),
close AS (SELECT a, b, levenshtein(x.s, y.s)::BIGINT AS distance, greatest(length(x.s), length(y.s))::BIGINT AS size FROM cand JOIN t x ON x.row_idx = a JOIN t y ON y.row_idx = b),
pairs AS (SELECT * FROM close WHERE distance <= floor({threshold} * size + 1e-9))"""


# ---------------------------------------------------------------- queries


def _vals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.values(C.frequencies(customer(spark, sf_dir)))


def null_analysis(spark, sf_dir):
    return C.null_analysis(customer(spark, sf_dir))


def null_severity(spark, sf_dir):
    n = null_analysis(spark, sf_dir)
    return n.select("field", S.rate_column("null_analysis", F.col("total_missing"), F.col("total_rows")).alias("severity"))


def content_votes(spark, sf_dir):
    return C.content_votes(customer(spark, sf_dir), ["phone", "join_date", "balance", "email"])


def infer_types(spark, sf_dir):
    df = C.as_text(C.numbered_by(_table(spark, sf_dir, "events"), "event_id"))
    types = C.infer_types(df, {c: True for c in df.columns if c != "row_idx"})
    return _rows(spark, list(types.items()), "field string, inferred_type string")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Results of an operator that works on the few counts of a table."""
    return spark.createDataFrame(rows, schema)


def format_distribution(spark, sf_dir):
    return C.format_distribution(_vals(spark, sf_dir), TYPES)


def mixed_formats(spark, sf_dir):
    m = C.mixed_formats(format_distribution(spark, sf_dir))
    return m.withColumn("severity", S.rate_column("mixed_format", F.col("inconsistent_count"), F.col("total")))


def misused_cells(spark, sf_dir):
    return C.misused_cells(customer(spark, sf_dir), TYPES)


def id_formats(spark, sf_dir):
    return C.id_formats(_vals(spark, sf_dir), TYPES)


def mixed_booleans(spark, sf_dir):
    return C.mixed_booleans(_vals(spark, sf_dir), TYPES)


def mixed_casing(spark, sf_dir):
    return C.mixed_casing(_vals(spark, sf_dir), TYPES)


def placeholder_values(spark, sf_dir):
    return C.placeholder_values(_vals(spark, sf_dir)).select("field", "v", "n", "first_row", "rank")


def repeated_values(spark, sf_dir):
    r = C.repeated_values(_vals(spark, sf_dir))
    return r.select("field", "v", "n", "first_row", "rank", "total", S.rate_column("suspicious_repetition", F.col("n"), F.col("total")).alias("severity"))


def profile_values(spark, sf_dir):
    hundredths = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
    p = C.profiles(_vals(spark, sf_dir), TYPES)
    return p.select("field", "cardinality", "non_empty_values", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), "total_length", hundredths("numeric_min"), hundredths("numeric_max"), hundredths("numeric_mean"), hundredths("numeric_median"))


def profile_shares(spark, sf_dir):
    """Uniqueness and mean length of the audit's profiles, in tenths."""
    rows = C.profiles(_vals(spark, sf_dir), TYPES).collect()
    made = {r["field"]: C.finished_profile(r.asDict(), 0) for r in rows}
    return _rows(spark, [(c, round(p["uniqueness_pct"] * 10), round(p["avg_length"] * 10)) for c, p in made.items()], "field string, uniqueness long, avg_length long")


def signature_columns(spark, sf_dir):
    ids, content, signature = D.content_columns(part(spark, sf_dir), {"p_id": "id"})
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(c in content).alias("content"), F.lit(c in signature).alias("signature")) for c in [*ids, *content]])
    return spark.range(1).select(F.explode(rows).alias("x")).select("x.*")


def phantom_groups(spark, sf_dir):
    return D.phantom_groups(part(spark, sf_dir), ["brand", "made_of"], ["brand", "made_of"]).select("first_row", "group_size", "exact_match")


def exact_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text", "lang")
    g = D.phantom_groups(docs, ["text", "lang"], ["text", "lang"])
    return g.where("exact_match").select("first_row", "group_size")


def phantom_members(spark, sf_dir):
    df = part(spark, sf_dir)
    return D.members(df, D.phantom_groups(df, ["brand", "made_of"], ["brand", "made_of"]), ["brand", "made_of"], X.collapsed)


def fingerprint_groups(spark, sf_dir):
    df = part(spark, sf_dir).withColumn("made_of", F.expr("CASE row_idx % 2 WHEN 0 THEN made_of ELSE array_join(reverse(split(lower(made_of), ' ')), ' . ') END"))
    return D.fingerprint_groups(df, ["brand", "made_of"]).select("first_row", "group_size")


def field_differences(spark, sf_dir):
    df = part(spark, sf_dir)
    groups = D.fingerprint_groups(df, ["brand", "made_of"])
    found = D.field_differences(df, D.members(df, groups, ["brand", "made_of"], X.token_print), ["title", "brand", "made_of"])
    return found.select("first_row", "field", F.array_join("values", " | ").alias("vals"), F.round(F.col("similarity") * 100).cast("long").alias("similarity"))


def row_texts(spark, sf_dir):
    return customer(spark, sf_dir).select("row_idx", D.row_text(["full_name", "email", "notes"]).alias("s"))


def gram_candidates(spark, sf_dir):
    return D.gram_candidates(names(spark, sf_dir))


def close_pairs(spark, sf_dir):
    p = D.close_pairs(names(spark, sf_dir), 0.9, n=10**6)
    return p.select("a", "b", F.col("distance").cast("long").alias("distance"), F.col("size").cast("long").alias("size"))


def brute_pairs(spark, sf_dir):
    """All pairs of a table of 25 rows, as small tables are compared."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_idx"), F.lower("n_name").alias("s"))
    return D.close_pairs(rows, 0.88).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("distance").cast("long").alias("distance"), F.col("size").cast("long").alias("size"))


def edit_groups(spark, sf_dir):
    return D.edit_groups(names(spark, sf_dir), 0.9, n=10**6)


def rule_violations(spark, sf_dir):
    found = R.evaluate(customer(spark, sf_dir), RULES)
    label = F.element_at(F.array(*[F.lit(r.name) for r in RULES]), F.col("rule") + 1)
    return found.select(label.alias("rule_name"), "field", "violations", "checked", "total")


SCHEMA = {"columns": {**{c: {"type": k, "max_missing_pct": 15} for c, k in TYPES.items()}, "notes": {"type": "name", "max_missing_pct": 5}, "region": {"type": "name", "required": True}, "segment": {"type": "name"}}}


def schema_violations(spark, sf_dir):
    """validate_schema over the types and missing shares of the customer table."""
    fields = {r["field"]: {"inferred_type": TYPES[r["field"]], "null_analysis": {"missing_pct": S.percent(r["total_missing"], r["total_rows"])}} for r in null_analysis(spark, sf_dir).collect()}
    found = validate_schema({"fields": fields}, SCHEMA)
    return _rows(spark, [(v["column"], v["type"], v["severity"]) for v in found], "field string, violation string, severity string")


def severity_counts(spark, sf_dir):
    parts = [null_severity(spark, sf_dir).select("severity"), mixed_formats(spark, sf_dir).select("severity"), repeated_values(spark, sf_dir).select("severity"), misused_cells(spark, sf_dir).select(F.lit("High").alias("severity"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("severity is not null")
    return every.groupBy("severity").agg(F.count("*").alias("n"))


def health_scores(spark, sf_dir):
    """health_score for 25 mixes of findings, missing shares and groups, made of the nations' numbers."""
    rows = _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as long) k", "cast(n_regionkey as long) r").collect()
    mix = lambda k, r: (Counter(High=k % 7, Medium=k % 5, Low=k % 4), [k * 0.5, r * 2.0, 10.0], Counter(phantom_duplicate=k % 3, exact_duplicate=r % 2, fuzzy_duplicate=k % 2))
    return _rows(spark, [(x["k"], S.health_score(*mix(x["k"], x["r"]))) for x in rows], "nation long, score long")


def audit_totals(spark, sf_dir):
    """count_issues of a whole audit of the customer table; edit distances are left out."""
    sheet = audit_dataframe(C.numbered_by(customer(spark, sf_dir), "row_idx"), "customer", max_pairwise=-1)
    found = count_issues({"sheets": {"customer": sheet}})
    return _rows(spark, [(s, found.get(s, 0)) for s in ("High", "Medium", "Low", "total")], "severity string, n long")


def trend_sheets(spark, sf_dir):
    """Misused cells by field as the earlier run, cells of no known format as the current one."""
    df = customer(spark, sf_dir)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("sheet"), F.col(c).alias("v"), P.format_label(X.clean(F.col(c)), TYPES[c]).alias("label")) for c in ("phone", "join_date", "balance")]))
    odd = df.select(cells.alias("x")).select("x.*").where(X.clean(F.col("v")).isNotNull() & (F.col("label") == P.NON_STANDARD))
    return trend.compare_findings(odd.select("sheet"), C.misused_cells(df, TYPES).select(F.col("field").alias("sheet")))


def order_duplicates(spark, sf_dir):
    """Id, content and signature columns of the orders, and their duplicate groups by date, status and priority."""
    df = C.as_text(C.numbered_by(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), "o_orderkey"))
    _, content, signature = D.content_columns(df, {"o_custkey": "id"})
    return D.phantom_groups(df, content, signature).select("first_row", "group_size", "exact_match")


def lineitem_duplicates(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS row_idx", "cast(l_partkey as string) AS part", "cast(l_suppkey as string) AS supplier", "cast(cast(l_quantity as int) as string) AS quantity")
    columns = ["part", "supplier", "quantity"]
    return D.phantom_groups(df, columns, columns).select("first_row", "group_size", "exact_match")


def fix_phones(spark, sf_dir):
    return customer(spark, sf_dir).select("row_idx", fixes.phones(F.col("phone")).alias("fixed"))


def fix_amounts(spark, sf_dir):
    return customer(spark, sf_dir).select("row_idx", F.round(fixes.amounts(F.col("balance")) * 100).cast("long").alias("cents"))


def fix_dates(spark, sf_dir):
    return customer(spark, sf_dir).select("row_idx", fixes.dates(F.col("join_date")).alias("fixed"))


def fix_placeholders(spark, sf_dir):
    return customer(spark, sf_dir).select("row_idx", fixes.without_placeholders(F.col("notes")).alias("fixed"))


def fix_duplicates(spark, sf_dir):
    df = part(spark, sf_dir).select("brand", "made_of")
    return fixes.apply_fix(df, {"strategy": "normalize_and_dedup"}, "brand")


def lineitem_nulls(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").selectExpr("nullif(l_returnflag, 'A') AS l_returnflag", "CASE WHEN l_linenumber = 2 THEN '' WHEN l_linenumber = 3 THEN '  ' ELSE l_linestatus END AS l_linestatus", "cast(l_quantity as string) AS l_quantity")
    return C.null_analysis(df)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    null_analysis, null_severity, content_votes, infer_types, format_distribution, mixed_formats, misused_cells, id_formats, mixed_booleans, mixed_casing, placeholder_values, repeated_values, profile_values, profile_shares, signature_columns, phantom_groups,
    exact_documents, phantom_members, fingerprint_groups, field_differences, row_texts, gram_candidates, close_pairs, brute_pairs, edit_groups, rule_violations, schema_violations, severity_counts, health_scores, audit_totals, trend_sheets, order_duplicates,
    lineitem_duplicates, fix_phones, fix_amounts, fix_dates, fix_placeholders, fix_duplicates, lineitem_nulls,
)}


def _rule_sql(r: R.Rule, c: str) -> str:
    v = "v"
    broken = {
        "regex_match": f"NOT regexp_full_match({v}, '{r.threshold}')",
        "not_regex_match": f"regexp_full_match({v}, '{r.threshold}')",
        "min_length": f"length({v}) < {r.threshold}",
        "max_length": f"length({v}) > {r.threshold}",
        "allowed_values": f"lower({v}) NOT IN ({', '.join(repr(x) for x in r.threshold) if isinstance(r.threshold, list) else 0})",
        "disallowed_values": f"lower({v}) IN ({', '.join(repr(x) for x in r.threshold) if isinstance(r.threshold, list) else 0})",
        "max_missing_pct": "v IS NULL",
    }[r.condition]
    return f"SELECT '{r.name}' AS rule_name, '{c}' AS field, count(*) FILTER ({broken}) AS violations, count(v) AS checked, count(*) AS total FROM (SELECT nullif({_STRIP.format(c)}, '') AS v FROM m)"


_MIXED = "mixed AS (SELECT field, arg_min(label, (-n, first_row)) AS dominant_format, max(n) AS dominant_count, (sum(n) - max(n))::BIGINT AS inconsistent_count, sum(n)::BIGINT AS total FROM formats GROUP BY field HAVING count(*) > 1)"
_MIXED_SEVERITY = f"SELECT *, {_rate_sql('mixed_format', 'inconsistent_count', 'total')} AS severity FROM mixed"
_MISUSED = f"""
SELECT 'full_name' AS field, CASE WHEN regexp_matches(v, '^[A-Z]{{2,}}-\\d+|^REF-') THEN 'Code/ID stuffed in name field' ELSE 'Numeric value in name field' END AS issue, v AS example, row_idx FROM (SELECT row_idx, {_STRIP.format("full_name")} AS v FROM m) WHERE regexp_matches(v, '^[A-Z]{{2,}}-\\d+|^REF-|^\\d+$')
UNION ALL SELECT 'balance', 'Text in currency field', v, row_idx FROM (SELECT row_idx, {_STRIP.format("balance")} AS v FROM m) WHERE regexp_matches(v, '^[a-zA-Z]')
UNION ALL SELECT 'email', 'Invalid email format', v, row_idx FROM (SELECT row_idx, {_STRIP.format("email")} AS v FROM m) WHERE v <> '' AND NOT regexp_matches(v, '{P.EMAIL}') AND NOT {_PLACEHOLDER}"""
_TOP = "row_number() OVER (PARTITION BY field ORDER BY n DESC, first_row) AS rank"
_REPEATED = f"SELECT field, v, n, first_row, rank, total, {_rate_sql('suspicious_repetition', 'n', 'total')} AS severity FROM (SELECT *, {_TOP}, (sum(n) OVER (PARTITION BY field))::BIGINT AS total FROM vals) WHERE rank <= 5 AND n >= 3 AND n / total >= 0.1 AND NOT {_PLACEHOLDER}"
_NULL_SEVERITY = f"SELECT field, {_rate_sql('null_analysis', 'total_missing', 'total_rows')} AS severity FROM nulls"
_SEVERITIES = f"sev AS (SELECT severity, count(*) AS n FROM (SELECT severity FROM ({_NULL_SEVERITY}) UNION ALL SELECT severity FROM ({_MIXED_SEVERITY}) UNION ALL SELECT severity FROM ({_REPEATED}) UNION ALL SELECT 'High' FROM ({_MISUSED})) WHERE severity IS NOT NULL GROUP BY severity)"
_GROUP = f"SELECT min(row_idx) AS first_row, count(*) AS group_size, count(DISTINCT (coalesce(brand, 'nan'), coalesce(made_of, 'nan'))) = 1 AS exact_match, {_COLLAPSED.format('brand')} AS k0, {_COLLAPSED.format('made_of')} AS k1 FROM m GROUP BY k0, k1 HAVING count(*) > 1"
_FINGERPRINTED = f"q AS (SELECT row_idx, title, brand, CASE row_idx % 2 WHEN 0 THEN made_of ELSE array_to_string(list_reverse(string_split(lower(made_of), ' ')), ' . ') END AS made_of FROM m)"
_NUM = f"try_cast(CASE WHEN regexp_matches(b, '{C.NUMBER}') THEN b END AS DOUBLE)"



def _vote_sql(c: str) -> str:
    """A type by name, else by the vote of the first 200 cells, of an events column."""
    hints = ", ".join(f"({k}, '{kind}', '{h}')" for k, (kind, found) in enumerate(P.NAME_HINTS) for h in found)
    name = f"(SELECT kind FROM (VALUES {hints}) h(k, kind, hint) WHERE contains(replace(replace(lower('{c}'), '_', ''), ' ', ''), hint) ORDER BY k LIMIT 1)"
    votes = " ".join(f"WHEN count(*) FILTER ({_label_sql(k, 'v')} <> '{P.NON_STANDARD}') > count(*) * 0.5 THEN '{k}'" for k in P.FORMATS)
    return f"SELECT '{c}' AS field, coalesce({name}, CASE {votes} WHEN count(*) FILTER ({_match('v', P.EMAIL)}) > count(*) * 0.5 THEN 'email' ELSE 'freetext' END) AS inferred_type FROM (SELECT cast({c} AS VARCHAR) AS v FROM events WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 200)"


def _votes_sql(c: str) -> str:
    counts = ", ".join(f"count(*) FILTER ({_label_sql(k, 'v')} <> '{P.NON_STANDARD}') AS {k}" for k in P.FORMATS)
    return f"SELECT '{c}' AS field, count(*) AS n, {counts}, count(*) FILTER ({_match('v', P.EMAIL)}) AS email FROM (SELECT {_STRIP.format(c)} AS v, row_number() OVER (ORDER BY row_idx) AS k FROM m WHERE {_STRIP.format(c)} <> '') WHERE k <= 200"


def _signature_sql() -> str:
    """Which of the part columns are content, and which of those repeat after normalisation; ids by type or by different values throughout."""
    each = "SELECT '{0}' AS field, {1} OR count(DISTINCT {0}) = count(*) AS id, count(DISTINCT {2}) < count(*) AS repeats FROM m"
    rows = " UNION ALL ".join(each.format(c, str(c == "p_id").lower(), _COLLAPSED.format(c)) for c in PART)
    return f"WITH {SQL_PART}, c AS ({rows}) SELECT field, NOT id OR (SELECT bool_and(id) FROM c) AS content, (NOT id OR (SELECT bool_and(id) FROM c)) AND repeats AS signature FROM c"


_FAMILY = "CASE " + " ".join(f"WHEN lower(v) IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in C.BOOLEANS.items()) + " END"
_BOOLEANS = f"SELECT field, count(DISTINCT {_FAMILY}) AS families, string_agg(v, ', ' ORDER BY v) AS spellings FROM vals WHERE field IN ('status', 'flag') GROUP BY field HAVING bool_and({_FAMILY} IS NOT NULL) AND count(DISTINCT {_FAMILY}) > 1"
_CASING = "SELECT field, lower(v) AS key, count(*) AS n_spellings, string_agg(v, ' / ' ORDER BY v) AS spellings, min(first_row) AS first_row FROM vals WHERE field IN ('status', 'flag') GROUP BY field, lower(v) HAVING count(*) > 1"
_IDS = f"SELECT field, coalesce(sum(n) FILTER ({_match('v', P.CODED_ID)}), 0)::BIGINT AS coded, coalesce(sum(n) FILTER ({_match('v', P.BARE_ID)}), 0)::BIGINT AS bare, coalesce(sum(n) FILTER (NOT {_match('v', P.CODED_ID)} AND NOT {_match('v', P.BARE_ID)}), 0)::BIGINT AS other FROM vals WHERE field = 'cust_id' GROUP BY field HAVING (coded > 0)::INT + (bare > 0)::INT + (other > 0)::INT > 1"
_PLACED = f"SELECT field, v, n, first_row, rank, total FROM (SELECT *, {_TOP} FROM (SELECT *, (sum(n) OVER (PARTITION BY field))::BIGINT AS total FROM vals) WHERE {_PLACEHOLDER}) WHERE rank <= 5"
_CONTENT = [c for c in CUSTOMER if c != "cust_id"]


def _audit_sql() -> str:
    """Severities of everything that an audit of the customer table finds, but for edit distances."""
    cells = lambda form: ", ".join(form.format(c) for c in _CONTENT)
    raw = ", ".join(f"coalesce({c}, 'nan')" for c in _CONTENT)
    groups = f"phantom AS (SELECT list(row_idx) AS rows, count(*) AS n, count(DISTINCT ({raw})) = 1 AS exact FROM m GROUP BY {cells(_COLLAPSED)} HAVING count(*) > 1), matched AS (SELECT unnest(rows) AS row_idx FROM phantom)"
    prints = f"prints AS (SELECT count(*) AS n FROM m LEFT JOIN matched USING (row_idx) GROUP BY {cells(_TOKENS)} HAVING count(*) > 1 AND count(*) FILTER (row_idx IN (SELECT row_idx FROM matched)) < count(*))"
    placed = f"SELECT {_rate_sql('placeholder_value', 'n', 'total')} AS severity FROM ({_PLACED})"
    every = " UNION ALL ".join([
        f"SELECT severity FROM ({_NULL_SEVERITY})", f"SELECT severity FROM ({_MIXED_SEVERITY})", f"SELECT severity FROM ({_REPEATED})", placed, f"SELECT 'High' FROM ({_MISUSED})", f"SELECT 'High' FROM ({_IDS})", f"SELECT 'High' FROM ({_BOOLEANS})",
        f"SELECT 'High' FROM ({_CASING})", "SELECT CASE WHEN exact OR n > 3 THEN 'High' ELSE 'Medium' END FROM phantom", "SELECT 'Medium' FROM prints",
    ])
    return f"{WITH_VALS}, {SQL_NULLS}, {SQL_FORMATS}, {_MIXED}, {groups}, {prints}, every AS ({every}) SELECT s.severity, count(e.severity) AS n FROM (VALUES ('High'), ('Medium'), ('Low')) s(severity) LEFT JOIN every e USING (severity) GROUP BY s.severity UNION ALL SELECT 'total', count(severity) FROM every"


def _schema_sql() -> str:
    spec = ", ".join(f"('{c}', '{x.get('type')}', {str(bool(x.get('required'))).lower()}, {x.get('max_missing_pct', 'NULL')}, '{TYPES.get(c, '')}')" for c, x in SCHEMA["columns"].items())
    return f"""WITH {SQL_CUSTOMER}, {SQL_LONG}, {SQL_NULLS}, spec(field, want, required, most, kind) AS (VALUES {spec}),
s AS (SELECT spec.*, total_rows IS NOT NULL AS there, round(total_missing * 100.0 / total_rows, 1) AS pct FROM spec LEFT JOIN nulls USING (field))
SELECT field, 'schema_missing_column' AS violation, 'High' AS severity FROM s WHERE required AND NOT there
UNION ALL SELECT field, 'schema_type_mismatch', 'High' FROM s WHERE there AND want <> kind
UNION ALL SELECT field, 'schema_completeness_violation', CASE WHEN pct > 2 * most THEN 'High' ELSE 'Medium' END FROM s WHERE there AND pct > most"""


_WALK = """RECURSIVE {0}, node AS (SELECT list(DISTINCT a ORDER BY a) AS l FROM pairs), beside AS (SELECT a, list(b) AS bs FROM pairs GROUP BY a),
walk AS (SELECT 0 AS k, []::BIGINT[] AS taken, []::BIGINT[] AS seeds
  UNION ALL SELECT k + 1, CASE WHEN list_contains(taken, l[k + 1]) THEN taken ELSE list_concat(taken, bs) END, CASE WHEN list_contains(taken, l[k + 1]) THEN seeds ELSE list_append(seeds, l[k + 1]) END FROM walk, node, beside WHERE k < len(l) AND beside.a = l[k + 1]),
last AS (SELECT unnest(seeds) AS a FROM walk, node WHERE k = len(l))"""


ORACLE: dict[str, str] = {
    "null_analysis": f"WITH {SQL_CUSTOMER}, {SQL_LONG}, {SQL_NULLS} SELECT * FROM nulls",
    "null_severity": f"WITH {SQL_CUSTOMER}, {SQL_LONG}, {SQL_NULLS} {_NULL_SEVERITY}",
    "content_votes": f"WITH {SQL_CUSTOMER} " + " UNION ALL ".join(map(_votes_sql, ("phone", "join_date", "balance", "email"))),
    "infer_types": " UNION ALL ".join(map(_vote_sql, ("user_id", "event_type", "ts", "value", "props"))),
    "format_distribution": f"{WITH_VALS}, {SQL_FORMATS} SELECT * FROM formats",
    "mixed_formats": f"{WITH_VALS}, {SQL_FORMATS}, {_MIXED} {_MIXED_SEVERITY}",
    "misused_cells": f"WITH {SQL_CUSTOMER} {_MISUSED}",
    "id_formats": f"{WITH_VALS} {_IDS}",
    "mixed_booleans": f"{WITH_VALS} {_BOOLEANS}",
    "mixed_casing": f"{WITH_VALS} {_CASING}",
    "placeholder_values": f"{WITH_VALS} SELECT field, v, n, first_row, rank FROM ({_PLACED})",
    "repeated_values": f"{WITH_VALS} {_REPEATED}",
    "profile_values": f"{WITH_VALS}, x AS (SELECT *, CASE field WHEN 'balance' THEN regexp_replace(v, '[$,£€]', '', 'g') WHEN 'cust_id' THEN v END AS b FROM vals), y AS (SELECT *, {_NUM} AS x FROM x), e AS (SELECT field, median(x) AS med FROM (SELECT field, x, unnest(range(n)) FROM y WHERE x IS NOT NULL) GROUP BY field) "
    "SELECT y.field, count(*) AS cardinality, sum(n)::BIGINT AS non_empty_values, min(length(v)) AS min_length, max(length(v)) AS max_length, sum(length(v) * n)::BIGINT AS total_length, round(min(x) * 100)::BIGINT AS numeric_min, round(max(x) * 100)::BIGINT AS numeric_max, round(sum(x * n) * 100 / sum(n) FILTER (x IS NOT NULL))::BIGINT AS numeric_mean, round(any_value(med) * 100)::BIGINT AS numeric_median FROM y LEFT JOIN e USING (field) GROUP BY y.field",
    "signature_columns": _signature_sql(),
    "phantom_groups": f"WITH {SQL_PART} SELECT first_row, group_size, exact_match FROM ({_GROUP})",
    "exact_documents": f"SELECT min(doc_id) AS first_row, count(*) AS group_size FROM documents GROUP BY {_COLLAPSED.format('text').replace('[^' + chr(92) + 'w', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_')}, lang HAVING count(*) > 1 AND count(DISTINCT text) = 1",
    "phantom_members": f"WITH {SQL_PART}, g AS ({_GROUP}) SELECT row_idx, first_row FROM m JOIN g ON k0 = {_COLLAPSED.format('brand')} AND k1 = {_COLLAPSED.format('made_of')}",
    "fingerprint_groups": f"WITH {SQL_PART}, {_FINGERPRINTED} SELECT min(row_idx) AS first_row, count(*) AS group_size FROM q GROUP BY {_TOKENS.format('brand')}, {_TOKENS.format('made_of')} HAVING count(*) > 1",
    "gram_candidates": f"WITH {_pairs_sql('0.1', 'BETWEEN 2 AND 500')} SELECT a, b, shared FROM cand",
    "close_pairs": f"WITH {_pairs_sql('0.1')} SELECT a, b, distance, size FROM pairs",
    "rule_violations": f"WITH {SQL_CUSTOMER} " + " UNION ALL ".join(_rule_sql(r, c) for r in RULES for c in CUSTOMER if r.applies_to(c)),
    "severity_counts": f"{WITH_VALS}, {SQL_NULLS}, {SQL_FORMATS}, {_MIXED}, {_SEVERITIES} SELECT * FROM sev",
    "trend_sheets": f"WITH {SQL_CUSTOMER}, {SQL_LONG}, b AS (SELECT field AS sheet, count(*) AS n FROM ({_MISUSED}) GROUP BY 1), a AS (SELECT field AS sheet, count(*) AS n FROM (SELECT *, {_LABELS} AS label FROM (SELECT field, {_STRIP.format('raw')} AS v FROM long)) WHERE v <> '' AND label = '{P.NON_STANDARD}' GROUP BY 1) SELECT sheet, CASE WHEN b.n IS NULL THEN 'new' WHEN a.n IS NULL THEN 'removed' ELSE 'compared' END AS status, coalesce(b.n, 0) AS previous_issues, coalesce(a.n, 0) AS current_issues, coalesce(a.n, 0) - coalesce(b.n, 0) AS issues_delta FROM a FULL JOIN b USING (sheet)",
    "fix_phones": f"WITH {SQL_CUSTOMER}, d AS (SELECT row_idx, phone, regexp_replace(phone, '\\D', '', 'g') AS r, right(regexp_replace(phone, '\\D', '', 'g'), 10) AS d FROM m) SELECT row_idx, CASE WHEN length(r) >= 10 THEN '(' || substring(d, 1, 3) || ') ' || substring(d, 4, 3) || '-' || substring(d, 7, 4) ELSE phone END AS fixed FROM d",
    "fix_amounts": f"WITH {SQL_CUSTOMER} SELECT row_idx, round(try_cast(nullif(regexp_replace(balance, '[^\\d.\\-]', '', 'g'), '') AS DOUBLE) * 100)::BIGINT AS cents FROM m",
    "fix_dates": f"WITH {SQL_CUSTOMER} SELECT row_idx, coalesce(strftime(coalesce(try_strptime(join_date, '%Y-%m-%d'), try_strptime(join_date, '%m/%d/%Y'), try_strptime(join_date, '%b %d, %Y'), try_strptime(join_date, '%d-%b-%Y')), '%Y-%m-%d'), join_date) AS fixed FROM m",
    "fix_placeholders": f"WITH {SQL_CUSTOMER} SELECT row_idx, CASE WHEN NOT regexp_matches({_STRIP.format('notes')}, '{P.PLACEHOLDER}', 'i') THEN notes END AS fixed FROM m",
    "fix_duplicates": f"WITH {SQL_PART} SELECT DISTINCT lower({_STRIP.format('brand')}) AS brand, lower({_STRIP.format('made_of')}) AS made_of FROM m",
    "lineitem_nulls": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS null_count, count(*) FILTER ({c} = '') AS blank_count, count(*) FILTER ({c} = '  ') AS whitespace_only, count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS total_missing, count(*) AS total_rows FROM (SELECT nullif(l_returnflag, 'A') AS l_returnflag, CASE WHEN l_linenumber = 2 THEN '' WHEN l_linenumber = 3 THEN '  ' ELSE l_linestatus END AS l_linestatus, cast(l_quantity AS VARCHAR) AS l_quantity FROM lineitem)" for c in ("l_returnflag", "l_linestatus", "l_quantity")),
    "profile_shares": f"{WITH_VALS} SELECT field, round(round(count(*) * 100.0 / sum(n), 1) * 10)::BIGINT AS uniqueness, round(round(sum(length(v) * n) / sum(n), 1) * 10)::BIGINT AS avg_length FROM vals GROUP BY field",
    "field_differences": f"WITH {SQL_PART}, g AS (SELECT min(row_idx) AS first_row, list(row_idx) AS rows FROM m GROUP BY {_TOKENS.format('brand')}, {_TOKENS.format('made_of')} HAVING count(*) > 1), r AS (SELECT first_row, unnest(rows) AS row_idx FROM g), "
    "x AS (" + " UNION ALL ".join(f"SELECT first_row, '{c}' AS field, coalesce({c}, 'nan') AS v, min(row_idx) AS place FROM r JOIN m USING (row_idx) GROUP BY ALL" for c in ("title", "brand", "made_of")) + "), "
    "y AS (SELECT first_row, field, list(v ORDER BY place) AS l FROM x GROUP BY 1, 2 HAVING count(*) > 1) SELECT first_row, field, array_to_string(l[1:5], ' | ') AS vals, round(round(1 - levenshtein(lower(l[1]), lower(l[2])) / greatest(length(l[1]), length(l[2])), 2) * 100)::BIGINT AS similarity FROM y",
    "row_texts": f"WITH {SQL_CUSTOMER} SELECT row_idx, " + " || '||' || ".join(f"coalesce(lower({_STRIP.format(c)}), 'nan')" for c in ("full_name", "email", "notes")) + " AS s FROM m",
    "brute_pairs": "WITH t AS (SELECT n_nationkey::BIGINT AS k, lower(n_name) AS s FROM nation), p AS (SELECT x.k AS a, y.k AS b, levenshtein(x.s, y.s)::BIGINT AS distance, greatest(length(x.s), length(y.s))::BIGINT AS size FROM t x JOIN t y ON x.k < y.k) SELECT * FROM p WHERE distance <= floor(0.12 * size + 1e-9)",
    "edit_groups": f"WITH {_WALK.format(_pairs_sql('0.1'))} SELECT min(pairs.a) AS seed, b AS row_idx FROM pairs JOIN last USING (a) GROUP BY b",
    "schema_violations": _schema_sql(),
    "health_scores": "SELECT k AS nation, greatest(0, round_even(100 - 3 * (k % 7) - 1.5 * (k % 5) - 0.5 * (k % 4) - 0.2 * (k * 0.5 + r * 2 + 10) / 3 - 3 * (k % 3) - 5 * (r % 2) - 1.5 * (k % 2), 0))::BIGINT AS score FROM (SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS r FROM nation)",
    "audit_totals": _audit_sql(),
    "order_duplicates": "SELECT min(o_orderkey) AS first_row, count(*) AS group_size, true AS exact_match FROM orders GROUP BY o_orderstatus, o_orderdate, o_orderpriority HAVING count(*) > 1",
    "lineitem_duplicates": "SELECT min(l_orderkey * 10 + l_linenumber) AS first_row, count(*) AS group_size, true AS exact_match FROM lineitem GROUP BY l_partkey, l_suppkey, l_quantity::INT HAVING count(*) > 1",
}
