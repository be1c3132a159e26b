"""Column checks, duplicates, rules, schemas, scores and trends on small tables."""

import itertools
import json
import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dqscan.functions import patterns as P
from dqscan.functions import text as X
from dqscan.operators import columns as C
from dqscan.operators import duplicates as D
from dqscan.operators import fixes, schema, scoring, trend
from dqscan.operators import rules as R


def frame(spark, rows, columns):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx long, " + ", ".join(f"`{c}` string" for c in columns))


@pytest.mark.parametrize("s", ["a", " a ", "\ta\n", "\xa0a　", "\x1fa\x85", "", "   ", "a - b"])
def test_strip_is_pythons(spark, s):
    assert spark.range(1).select(X.strip(F.lit(s))).first()[0] == s.strip()


@pytest.mark.parametrize(("s", "want"), [("a - b", "a  b"), ("  Über, Co. ", "über co."), (None, ""), ("A@b.C", "a@b.c")])
def test_punctuation_goes_after_blanks_collapse(spark, s, want):
    assert spark.range(1).select(X.collapsed(F.lit(s).cast("string"))).first()[0] == want


def test_token_print(spark):
    rows = spark.createDataFrame([("Smith, John",), ("john  SMITH",), (None,)], "s string").select(X.token_print(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["john smith", "john smith", ""]


@pytest.mark.parametrize(("name", "kind"), [("hotel", "phone"), ("paid", "id"), ("Join Date", "date"), ("shipping_fee", "date"), ("total", "currency"), ("statement", "categorical"), ("remark", "freetext"), ("x", None), ("E-mail", "email")])
def test_first_hint_wins(name, kind):
    assert P.type_by_name(name) == kind


def test_missing_kinds_are_disjoint(spark):
    n = C.null_analysis(frame(spark, [("a",), ("",), ("  ",), (None,), ("b",)], ["x"])).first()
    assert (n["null_count"], n["blank_count"], n["whitespace_only"], n["total_missing"], n["total_rows"]) == (1, 1, 1, 3, 5)


def test_empty_table(spark):
    df = frame(spark, [], ["x", "y"])
    assert C.null_analysis(df).count() == 0
    assert C.values(C.frequencies(df)).count() == 0
    assert D.phantom_groups(df, ["x", "y"], ["x"]).count() == 0


def test_content_vote(spark):
    df = frame(spark, [(f"2023-01-{i:02}", "555-123-4567", "12", "a@b.co", "w") for i in range(10, 20)], ["q", "w", "e", "r", "y"])
    assert C.infer_types(df, dict.fromkeys("qwery", True)) == {"q": "date", "w": "phone", "e": "currency", "r": "email", "y": "freetext"}
    assert C.infer_types(df, {}) == dict.fromkeys("qwery", "empty")


def test_dominant_format_ties_go_to_the_first(spark):
    v = C.values(C.frequencies(frame(spark, [("01/02/2023",), ("2023-01-02",), ("x",)], ["d"])))
    m = C.mixed_formats(C.format_distribution(v, {"d": "date"})).first()
    assert (m["dominant_format"], m["dominant_count"], m["inconsistent_count"]) == ("MM/DD/YYYY", 1, 2)


def test_placeholders_take_slots_of_repetition(spark):
    rows = [("n/a",)] * 5 + [("tbd",)] * 5 + [("test",)] * 5 + [("null",)] * 5 + [("temp",)] * 5 + [("real",)] * 4
    v = C.values(C.frequencies(frame(spark, rows, ["x"])))
    assert C.repeated_values(v).count() == 0
    assert [r["v"] for r in C.placeholder_values(v).orderBy("rank").collect()] == ["n/a", "tbd", "test", "null", "temp"]


def test_profile(spark):
    v = C.values(C.frequencies(frame(spark, [("$100",), ("$200",), ("$300",), ("$400",), ("1d",), (None,)], ["a"])))
    p = C.profiles(v, {"a": "currency"}).first()
    assert (p["cardinality"], p["numeric_min"], p["numeric_max"], p["numeric_mean"], p["numeric_median"]) == (5, 100, 400, 250, 250)


@pytest.mark.parametrize("seed", range(4))
def test_medians_are_exact(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"f{k}", float(rnd.choice([rnd.randint(0, 9), rnd.gauss(0, 1000), 7]))) for k in range(5) for _ in range(rnd.randint(1, 900))]
    df = spark.createDataFrame([(f, x, n) for (f, x), n in Counter(rows).items()], "field string, x double, n long").repartition(3)
    want = {f: statistics.median(x for g, x in rows if g == f) for f in {f for f, _ in rows}}
    assert {r["field"]: r["numeric_median"] for r in C.medians(df, 16).collect()} == want


def test_votes_of_all_columns_in_one_pass(spark):
    df = frame(spark, [(f"2023-01-{k % 28 + 1:02}" if k < 200 else "x", None if k % 2 else "12") for k in range(500)], ["a", "b"])
    got = {r["field"]: (r["n"], r["date"], r["currency"]) for r in C.content_votes(df, ["a", "b"]).collect()}
    assert got == {"a": (200, 200, 0), "b": (200, 0, 200)}


def test_missing_cells_are_counted_without_shuffling_them(spark):
    plan = C.null_analysis(frame(spark, [("a", "b")], ["x", "y"]))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_short_numbers_and_bracketed_amounts(spark):
    df = frame(spark, [("12", "(5.00)"), ("call me", "$7"), ("555.123.4567", "(x)")], ["p", "a"])
    got = df.orderBy("row_idx").select(fixes.phones(F.col("p")), fixes.amounts(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("12", -5.0), ("call me", 7.0), ("(555) 123-4567", None)]
    marked = fixes.apply_fix(df, {"strategy": "review_fuzzy_matches"}, "", {"rows": [2, 4]})
    assert [r["fuzzy_review"] for r in marked.orderBy("row_idx").collect()] == [True, False, True]
    assert fixes.apply_fix(df, {"strategy": "flag_misuse"}, "p", {"example": "12"}).where("p_review").count() == 1


def test_misuse(spark):
    df = frame(spark, [("REF-1", "abc", "a@b.co"), ("123", "$5", "N/A"), ("ref-x", "5", "bad"), ("Ann", None, None)], ["name", "amount", "email"])
    got = {(r["field"], r["issue"].split()[0], r["row_idx"]) for r in C.misused_cells(df, {"name": "name", "amount": "currency", "email": "email"}).collect()}
    assert got == {("name", "Code/ID", 0), ("name", "Code/ID", 2), ("name", "Numeric", 1), ("amount", "Text", 0), ("email", "Invalid", 2)}


def test_spooled_tables_go_with_the_driver(tmp_path):
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession; from dqscan.plans.spool import keep, spool\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
        f"d = s.range(5); assert spool(d).count() == 5; keep(d, 'kept'); import os; print(*os.listdir('{tmp_path}'))"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)
    own = lambda names: sorted(n.split("-")[0] for n in names if n.startswith(("dqscan", "kept")))
    assert own(done.stdout.split()) == ["dqscan", "kept"] and own(p.name for p in tmp_path.iterdir()) == ["kept"]


def test_row_numbers_follow_the_partitions(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "x")
    assert [(r[0], r[1]) for r in C.with_row_idx(df).orderBy("x").collect()] == [(i, i) for i in range(1000)]


def test_phantom_and_exact(spark):
    df = frame(spark, [("1", "Alice", "x"), ("2", " alice ", "x"), ("3", "Bob", "y"), ("4", "Bob", "y"), ("5", None, "z")], ["ID", "name", "city"])
    ids, content, sig = D.content_columns(df, {"ID": "id"})
    assert (ids, content, sig) == (["ID"], ["name", "city"], ["name", "city"])
    got = {(r["first_row"], r["group_size"], r["exact_match"]) for r in D.phantom_groups(df, content, sig).collect()}
    assert got == {(0, 2, False), (2, 2, True)}


def greedy(texts, threshold):
    """The sequential walk, by definition."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    close = lambda a, b: 1.0 if not a and not b else 1 - distance(a, b) / max(len(a), len(b))
    used, out = set(), {}
    for i in range(len(texts)):
        if i in used:
            continue
        for j in range(i + 1, len(texts)):
            if j not in used and close(texts[i], texts[j]) >= threshold:
                used.add(j)
                out[j] = i
    return out


@pytest.mark.parametrize("seed", range(3))
def test_edit_groups_equal_the_sequential_walk(spark, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice("abé") for _ in range(rnd.randint(3, 6))) for _ in range(35)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_idx long, s string")
    for most in (10**6, 5):  # walked, or in rounds where a component has more pairs
        got = {r["row_idx"]: r["seed"] for r in D.seed_groups(D.close_pairs(rows, 0.7), most).collect()}
        assert got == greedy(texts, 0.7)


def test_grams_find_close_rows(spark):
    texts = [f"person number {i:03} of street {i * 7 % 100}" for i in range(60)] + ["person numbr 005 of street 35"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_idx long, s string")
    pairs = {(r["a"], r["b"]) for r in D.close_pairs(rows, 0.95, brute_force=0).collect()}
    assert (5, 60) in pairs
    every = {(a, b) for a, b in itertools.combinations(range(61), 2)}
    assert pairs <= every


def test_large_families_keep_all_their_pairs(spark):
    texts = [f"warehouse item {'abcdefghijklmnopqrst'[i % 20]}{'0123456789'[i // 20]}" for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_idx long, s string")
    pairs = {(r["a"], r["b"]) for r in D.close_pairs(rows, 0.85, brute_force=0).collect()}
    assert pairs == set(itertools.combinations(range(200), 2))
    groups = D.seed_groups(D.close_pairs(rows, 0.85, brute_force=0)).collect()
    assert {r["row_idx"] for r in groups} == set(range(1, 200)) and {r["seed"] for r in groups} == {0}


def shared_grams(texts, most):
    """Candidates by definition, rows of equal texts included."""
    grams = [{t[i : i + 3] for i in range(max(len(t) - 2, 1))} if t is not None else set() for t in texts]
    n = Counter(g for own in grams for g in own)
    out = {}
    for a, b in itertools.combinations(range(len(texts)), 2):
        shared = sum(2 <= n[g] <= most for g in grams[a] & grams[b])
        if shared and shared >= (1 if min(len(texts[a]), len(texts[b])) < 9 else 2):
            out[a, b] = shared
    return out


@pytest.mark.parametrize("most", [3, 12, 500])
def test_rows_of_one_text_keep_all_their_candidates(spark, most):
    rnd = random.Random(most)
    texts = ["".join(rnd.choice("abé ") for _ in range(rnd.choice((0, 1, 2, 3, 5, 8, 9, 12)))) for _ in range(25)]
    texts = [rnd.choice(texts) for _ in range(50)] + ["same again"] * 13 + ["qqqqqqqqqq"] * 2 + ["qqqx", None, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_idx long, s string")
    got = [(r["a"], r["b"], r["shared"]) for r in D.gram_candidates(rows, most_postings=most).collect()]
    want = shared_grams(texts, most)
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def broadcasts(df) -> bool:
    df.collect()
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def filed_names(spark, tmp_path):
    """A small file, which the planner would broadcast by its size."""
    spark.createDataFrame([(i, f"person number {i // 3:03}") for i in range(90)], "row_idx long, s string").write.parquet(str(tmp_path / "names"))
    return spark.read.parquet(str(tmp_path / "names"))


def test_candidates_send_no_table_through_the_driver(filed_names):
    assert not broadcasts(D.gram_candidates(filed_names))


def test_postings_of_a_stop_word_are_split(spark, tmp_path):
    rnd = random.Random(5)
    texts = ["aaa" + "".join(rnd.choice("bcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6000)]
    spark.createDataFrame(list(enumerate(texts)), "row_idx long, s string").write.parquet(str(tmp_path / "names"))
    small = {"advisoryPartitionSizeInBytes": "8k", "skewJoin.skewedPartitionThresholdInBytes": "8k", "skewJoin.skewedPartitionFactor": "1.2", "coalescePartitions.enabled": "false"}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    for k, v in small.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        df = D.gram_candidates(spark.read.parquet(str(tmp_path / "names")), most_postings=60)
        df.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k in small:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
    assert re.search(r"SortMergeJoin\(skew=true\) \[gram#\d+\], \[gram#\d+\]", df._jdf.queryExecution().executedPlan().toString())


def test_close_pairs_send_no_table_through_the_driver(filed_names):
    assert not broadcasts(D.close_pairs(filed_names, 0.9, n=10**6))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_rows_of_one_text_keep_all_their_close_pairs(spark, threshold):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abé") for _ in range(rnd.choice((0, 2, 3, 6, 9, 11)))) for _ in range(20)]
    texts = [rnd.choice(texts) for _ in range(60)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_idx long, s string")
    got = [(r["a"], r["b"], r["distance"], r["size"]) for r in D.close_pairs(rows, threshold, brute_force=0).collect()]
    want = set()
    for a, b in shared_grams(texts, 500):
        size, d = max(len(texts[a]), len(texts[b])), edits(texts[a], texts[b])
        if d <= (1 - threshold) * size + 1e-9:
            want.add((a, b, d, size))
    assert len(got) == len(want) and set(got) == want


def common_names(n=620):
    """Rows whose grams are all in over 500 rows, close to each other or not."""
    ends = ["warehouse", "warehouze", "warehousewarehouse", "warehouzewarehouse", "warewarehouse"]
    return [f"{e} of warehouze warehouse" for e in ends * (n // len(ends))]


def near(texts, threshold):
    """(a, b): (distance, size) of the candidates that are close, by definition."""
    known = {}
    for a, b in shared_grams(texts, len(texts)):
        x, y = texts[a], texts[b]
        if (x, y) not in known:
            known[x, y] = (edits(x, y), max(len(x), len(y)))
        d, size = known[x, y]
        if d <= (1 - threshold) * size + 1e-9:
            yield (a, b), (d, size)


@pytest.mark.parametrize("threshold", [0.7, 0.9])
def test_texts_of_common_grams_keep_all_their_close_pairs(spark, threshold):
    texts = common_names()
    rows = spark.createDataFrame(list(enumerate(texts)), "row_idx long, s string")
    assert min(Counter(g for s in texts for g in {s[i : i + 3] for i in range(len(s) - 2)}).values()) > 120
    got = [(r["a"], r["b"], r["distance"], r["size"]) for r in D.close_pairs(rows, threshold).collect()]
    want = dict(near(texts, threshold))
    assert len(got) == len(want) > 10**4 and {(a, b): (d, n) for a, b, d, n in got} == want


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.9])
def test_blocks_and_prefixes_of_grams_lose_no_close_pair(spark, threshold):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 30))) for _ in range(12)]
    texts = list({s[:i] + rnd.choice(("", "a", "ba")) + s[i + rnd.randint(0, 1) :] for s in base * 8 for i in [rnd.randint(0, len(s))]} | {"a" * 12, "a" * 13, "ab" * 8, "ba" * 8})
    table = spark.createDataFrame(list(enumerate(texts)), "class long, s string")
    got = [(r["x"], r["y"]) for r in D._prefix_pairs(table, threshold, block=7).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert {p for p, _ in near(texts, threshold)} <= set(got)


def test_long_lists_of_rows_meet_in_pieces(spark):
    texts = ["one long text"] * 9 + ["one long texts"] * 4
    rows = spark.createDataFrame(list(enumerate(texts)), "row_idx long, s string")
    pairs = spark.createDataFrame([(0, 0, 9, 9, 13, 0), (0, 9, 9, 4, 14, 1)], "x long, y long, copies_x long, copies_y long, size int, distance int")
    got = [(r["a"], r["b"], r["distance"]) for r in D._listed(pairs, rows, D._texts(rows), most=2, a_task=5).collect()]
    assert sorted(got) == [(a, b, int(b > 8)) for a, b in itertools.combinations(range(13), 2) if a < 9]


@pytest.mark.parametrize("texts", [common_names(), ["a" * 12, "b" * 12, "a" * 13, "a" * 12, "warehouse", "b" * 12, "warehouse", "xy", "xy", "", "", None, None]])
def test_edit_groups_of_texts_equal_the_walk_over_rows(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "row_idx long, s string")
    want = {}
    for a, b in sorted(p for p, _ in near(texts, 0.9)):
        if a not in want:
            want.setdefault(b, a)
    got = [(r["row_idx"], r["seed"]) for r in D.edit_groups(rows, 0.9, brute_force=0).collect()]
    assert len(got) == len(want) and dict(got) == want


@pytest.mark.parametrize("most", [10**6, 2])
def test_edit_groups_send_no_table_of_pairs_through_the_driver(filed_names, monkeypatch, most):
    seen = {}

    def written(df, name, spool=D.spool):
        seen[name] = df._jdf.queryExecution().executedPlan().toString()
        return spool(df, name)

    monkeypatch.setattr(D, "spool", written)
    groups = {r["row_idx"]: r["seed"] for r in D.seed_groups(D.close_pairs(filed_names, 0.97, n=10**6), most).collect()}
    assert groups == {i: i // 3 * 3 for i in range(90) if i % 3}
    assert {"pairs", "parted"} <= set(seen) and (most > 2 or {"free", "rest"} <= set(seen))
    assert not [n for n in ("pairs", "parted", "free", "rest") if "Broadcast" in seen.get(n, "")]


def test_fingerprints_skip_groups_that_are_known(spark):
    df = frame(spark, [("John Smith",), ("Smith John",), ("Jane Doe",), ("O'Brien & Co.",), ("OBrien Co",)], ["n"])
    assert {r["first_row"] for r in D.fingerprint_groups(df, ["n"]).collect()} == {0, 3}
    known = spark.createDataFrame([(0,), (1,)], "row_idx long")
    assert {r["first_row"] for r in D.fingerprint_groups(df, ["n"], known).collect()} == {3}


BAD_RULES = [
    "x", {}, {"name": "n", "description": "d", "severity": "High", "condition": "huh", "threshold": 1}, {"name": "n", "description": "d", "severity": "Bad", "condition": "min_length", "threshold": 1},
    {"name": "n", "description": "d", "severity": "Low", "condition": "regex_match", "threshold": "("}, {"name": "n", "description": "d", "severity": "Low", "condition": "regex_match", "threshold": 3},
    {"name": "n", "description": "d", "severity": "Low", "condition": "min_length", "threshold": -1}, {"name": "n", "description": "d", "severity": "Low", "condition": "allowed_values", "threshold": "a"},
    {"name": "n", "description": "d", "severity": "Low", "condition": "max_missing_pct", "threshold": 101},
]


@pytest.mark.parametrize("spec", BAD_RULES)
def test_bad_rules(spec):
    with pytest.raises(ValueError):
        R.parse(spec)


def test_rule_files(tmp_path):
    with pytest.raises(FileNotFoundError):
        R.load_rules(str(tmp_path / "no"))
    for text in ("{", "[]", '{"rules": 1}'):
        (tmp_path / "r.json").write_text(text)
        with pytest.raises(ValueError):
            R.load_rules(str(tmp_path / "r.json"))
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"name": "n", "description": "d", "severity": "Low", "condition": "max_length", "threshold": 2, "column_pattern": "^na"}]}))
    (rule,) = R.load_rules(str(tmp_path / "r.json"))
    assert rule.applies_to("Name") and not rule.applies_to("x")


CELLS = ["abc", " AB-12 ", "", None, "12", "x\ny", "é"]


@pytest.mark.parametrize(
    ("condition", "limit", "bad"),
    [
        ("regex_match", r"[A-Z]+-\d+", lambda v: not re.fullmatch(r"[A-Z]+-\d+", v)), ("not_regex_match", r"\w+", lambda v: bool(re.fullmatch(r"\w+", v))), ("min_length", 2.5, lambda v: len(v) < 2.5), ("max_length", 2, lambda v: len(v) > 2),
        ("allowed_values", ["ABC", "12"], lambda v: v.lower() not in ("abc", "12")), ("disallowed_values", ["É"], lambda v: v.lower() == "é"),
    ],
)
def test_conditions(spark, condition, limit, bad):
    df = frame(spark, [(c,) for c in CELLS], ["c"])
    want = [c.strip() for c in CELLS if c and bad(c.strip())]
    found = R.evaluate_rule(R.Rule("n", "d", "High", condition, limit, ["c"]), df, "c")
    assert (found["detail"]["violations"], found["detail"]["examples"]) == (len(want), want[:5])


def test_missing_share_isnt_rounded(spark):
    df = frame(spark, [(None,)] + [("x",)] * 2, ["c"])
    assert R.evaluate_rule(R.Rule("n", "d", "High", "max_missing_pct", 33.34, ["c"]), df, "c") is None
    assert R.evaluate_rule(R.Rule("n", "d", "High", "max_missing_pct", 33.3, ["c"]), df, "c")["detail"]["actual"] == 33.3


def test_severities():
    assert [scoring.rate("null_analysis", p) for p in (5, 5.1, 20, 20.1, 50, 50.1)] == [None, "Low", "Low", "Medium", "Medium", "High"]
    assert [scoring.rate("mixed_format", p) for p in (10, 10.1, 30, 30.1)] == ["Low", "Medium", "Medium", "High"]
    assert scoring.rate_severity("phantom_duplicate", {"group_size": 4}) == "High"
    assert scoring.rate_severity("fuzzy_duplicate", {"match_method": "levenshtein"}) == "Low"
    assert scoring.health_score(Counter(High=2, Low=1), [10.0, 0.0], Counter(exact_duplicate=1)) == round(100 - 6.5 - 1 - 5)
    assert scoring.overall([0, 65]) == 32 and scoring.overall([]) == 100


def test_schema():
    sheet = {"fields": {"a": {"inferred_type": "id", "null_analysis": {"missing_pct": 30.0}}}}
    spec = {"columns": {"a": {"type": "name", "max_missing_pct": 10}, "b": {"type": "id", "required": True}}, "sheets": {"s": {"columns": {"a": {"type": "id"}}}}}
    assert [(v["type"], v["severity"]) for v in schema.validate_schema(sheet, spec, "t")] == [("schema_type_mismatch", "High"), ("schema_completeness_violation", "High"), ("schema_missing_column", "High")]
    assert [v["type"] for v in schema.validate_schema(sheet, spec, "s")] == ["schema_missing_column"]


def test_trend():
    one = lambda score, n: {"health_score": score, "fields": {"c": {"issues": [{"severity": "High"}] * n}}}
    t = trend.compute_trend({"overall_score": 80, "sheets": {"a": one(80, 1), "n": one(1, 0)}}, {"overall_score": 60, "sheets": {"a": one(60, 3), "o": one(1, 1)}})
    assert (t["score_delta"], t["issues_delta"], t["sheets"]["a"]["issues_delta"], t["sheets"]["n"]["status"], t["sheets"]["o"]["status"]) == (20, -3, -2, "new", "removed")


def test_fixes(spark):
    df = frame(spark, [("(555)123-4567", "$-1,200.50", "Mar 5, 2023", "TBD")], ["p", "a", "d", "n"])
    row = df.select(fixes.phones(F.col("p")), fixes.amounts(F.col("a")), fixes.dates(F.col("d")), fixes.without_placeholders(F.col("n"))).first()
    assert tuple(row) == ("(555) 123-4567", -1200.5, "2023-03-05", None)
    assert fixes.generate_dup_fix("fuzzy_duplicate", {"rows": [2, 5], "group_size": 2})["code"].count("0, 3") == 1
    assert {fixes.generate_fix("null_analysis", {"missing_pct": p}, "c")["strategy"] for p in (60, 30, 6)} == {"evaluate_column", "impute_or_flag", "fill_missing"}
