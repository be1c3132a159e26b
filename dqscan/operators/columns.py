"""Checks of single columns.

Missing cells are counted in one aggregation of the table. Everything else is read off a table of
value frequencies, `frequencies`: (field, raw, n, first_row), whose partial sums are formed before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqscan.functions import patterns as P
from dqscan.functions import text as X
from dqscan.operators.scoring import percent
from dqscan.plans.spool import spool

ROW = "row_idx"
#: Marks a column of that name as row numbers; a table's own column of the name is renamed.
MARK = {"row_number": True}
OWN = "row_idx (own)"


def is_numbered(df: DataFrame) -> bool:
    return ROW in df.columns and MARK.items() <= df.schema[ROW].metadata.items()


def numbered_by(df: DataFrame, column: str) -> DataFrame:
    """Takes a column of whole numbers for the row number."""
    return df.select(F.col(f"`{column}`").cast("long").alias(ROW, metadata=MARK), *[F.col(f"`{c}`") for c in df.columns if c != column])


def with_row_idx(df: DataFrame) -> DataFrame:
    """Numbers the rows from 0 in the order of the files.

    The rows are written with their places first, so that the counts and the numbers made of them
    come from one reading, and every later pass reads that table. Only the counts of the partitions,
    a number each, come to the driver; rows aren't shuffled.
    """
    if is_numbered(df):
        return df
    if ROW in df.columns:
        df = df.withColumnRenamed(ROW, OWN)
    marked = spool(df.withColumn("__at", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("__at", 33)
    counts = {r["p"]: r["n"] for r in marked.select(part.alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    start, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(start)]
        start += counts[p]
    base = F.element_at(F.create_map(*offsets), part) if len(offsets) > 2 else F.lit(0)
    return marked.select((base + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long").alias(ROW, metadata=MARK), *[F.col(f"`{c}`") for c in df.columns])


def as_text(df: DataFrame) -> DataFrame:
    """All cells as text, row numbers aside."""
    own = is_numbered(df)
    return df.select(*[F.col(ROW) if own and c == ROW else X.cell_text(F.col(f"`{c}`"), kind).alias(c) for c, kind in df.dtypes])


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, raw, n, first_row) for text columns; a row number column is needed."""
    columns = columns or [c for c in df.columns if c != ROW]
    long = df.select(ROW, *[F.col(f"`{c}`") for c in columns]).unpivot([ROW], [F.col(f"`{c}`") for c in columns], "field", "raw")
    return long.groupBy("field", "raw").agg(F.count("*").alias("n"), F.min(ROW).alias("first_row"))


def values(freq: DataFrame) -> DataFrame:
    """(field, v, n, first_row) of the stripped, non-empty values."""
    return freq.withColumn("v", X.clean("raw")).where("v is not null").groupBy("field", "v").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))


def null_analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts of the three kinds of missing cells by field: sums over the table, without a shuffle of its cells."""
    columns = columns or [c for c in df.columns if c != ROW]
    times = lambda on: F.coalesce(F.sum(on.cast("long")), F.lit(0))
    sums = [F.count("*").alias("total_rows")]
    for k, c in enumerate(columns):
        raw = F.col(f"`{c}`")
        empty = F.coalesce(X.strip(raw) == "", F.lit(False))
        blank = F.coalesce(raw == "", F.lit(False))
        sums += [times(raw.isNull()).alias(f"n{k}"), times(blank).alias(f"b{k}"), times(empty & ~blank).alias(f"w{k}")]
    each = [F.struct(F.lit(c).alias("field"), F.col(f"n{k}").alias("null_count"), F.col(f"b{k}").alias("blank_count"), F.col(f"w{k}").alias("whitespace_only"), (F.col(f"n{k}") + F.col(f"b{k}") + F.col(f"w{k}")).alias("total_missing"), "total_rows") for k, c in enumerate(columns)]
    return df.agg(*sums).where("total_rows > 0").select(F.explode(F.array(*each)).alias("x")).select("x.*")


def content_votes(df: DataFrame, columns: list[str], sample: int = 200) -> DataFrame:
    """By field, how many of the first `sample` non-empty cells look like a date, phone, amount or email.

    One pass for all columns: each task keeps its first cells of a column, and those of all tasks are
    ranked together.
    """
    long = df.select(ROW, *[X.clean(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot([ROW], [F.col(f"`{c}`") for c in columns], "field", "v").where("v is not null")
    first = long.withColumn("k", F.row_number().over(Window.partitionBy("field").orderBy(ROW))).where(F.col("k") <= sample)
    hit = lambda on: F.sum(F.when(on, 1).otherwise(0)).cast("long")
    return first.groupBy("field").agg(F.count("*").alias("n"), *[hit(P.format_label(F.col("v"), k) != P.NON_STANDARD).alias(k) for k in ("date", "phone", "currency")], hit(P.matches(F.col("v"), P.EMAIL)).alias("email"))


def infer_types(df: DataFrame, filled: dict[str, bool]) -> dict[str, str]:
    """Semantic types: by name, else by the vote of the cells; `filled` says which columns hold any value."""
    columns = [c for c in df.columns if c != ROW]
    out = {c: "empty" if not filled.get(c) else P.type_by_name(c) for c in columns}
    open_ = [c for c, kind in out.items() if kind is None]
    votes = {r["field"]: r for r in content_votes(df, open_).collect()} if open_ else {}
    for c in open_:
        out[c] = next((k for k in ("date", "phone", "currency", "email") if c in votes and votes[c][k] > votes[c]["n"] * 0.5), "freetext")
    return out


def _by_type(types: dict[str, str], label) -> Column:
    out = F.lit(None).cast("string")
    for kind in P.FORMATS:
        fields = [c for c, k in types.items() if k == kind]
        if fields:
            out = F.when(F.col("field").isin(*fields), label(kind)).otherwise(out)
    return out


def format_distribution(vals: DataFrame, types: dict[str, str]) -> DataFrame:
    """(field, label, n, first_row) for fields of dates, phones and amounts."""
    typed = [c for c, kind in types.items() if kind in P.FORMATS]
    # Filtered by field: a filter on the label would work it out a second time.
    labelled = vals.where(F.col("field").isin(*typed)).withColumn("label", _by_type(types, lambda kind: P.format_label(F.col("v"), kind)))
    return labelled.groupBy("field", "label").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))


def mixed_formats(distribution: DataFrame) -> DataFrame:
    """Fields with more than one format: the dominant one and how many cells differ from it."""
    top = F.min(F.struct((-F.col("n")).alias("n"), "first_row", "label"))
    return (
        distribution.groupBy("field")
        .agg(F.count("*").alias("n_formats"), F.sum("n").alias("total"), top.alias("t"))
        .where("n_formats > 1")
        .select("field", F.col("t.label").alias("dominant_format"), (-F.col("t.n")).alias("dominant_count"), (F.col("total") + F.col("t.n")).alias("inconsistent_count"), "total")
    )


def misused_cells(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(field, kind, issue, example, row) of cells in a column of another purpose: a filtered scan, as large as what is wrong."""
    found = []
    for c, kind in types.items():
        v = X.clean(F.col(f"`{c}`"))
        code = P.matches(v, P.CODE_IN_NAME)
        issue = {
            "name": F.when(code, "Code/ID stuffed in name field").when(P.matches(v, r"^\d+$"), "Numeric value in name field"),
            "currency": F.when(v.rlike("^[a-zA-Z]"), "Text in currency field"),
            "email": F.when(~P.matches(v, P.EMAIL) & ~P.is_placeholder(v), "Invalid email format"),
        }.get(kind)
        if issue is not None:
            found.append(F.struct(F.lit(c).alias("field"), issue.alias("issue"), v.alias("example")))
    if not found:
        return df.select(F.lit("").alias("field"), F.lit("").alias("issue"), F.lit("").alias("example"), ROW).where("false")
    return df.select(ROW, F.explode(F.array(*found)).alias("x")).where("x.issue is not null").select("x.field", "x.issue", "x.example", ROW)


def id_formats(vals: DataFrame, types: dict[str, str]) -> DataFrame:
    """(field, coded, bare, other) for id fields that mix formats."""
    fields = [c for c, k in types.items() if k == "id"]
    coded, bare = P.matches(F.col("v"), P.CODED_ID), P.matches(F.col("v"), P.BARE_ID)
    times = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0))
    counts = vals.where(F.col("field").isin(*fields)).groupBy("field").agg(times(coded).alias("coded"), times(bare).alias("bare"), times(~coded & ~bare).alias("other"))
    return counts.where("cast(coded > 0 as int) + cast(bare > 0 as int) + cast(other > 0 as int) > 1")


BOOLEANS = {"numeric": ("0", "1"), "y/n": ("y", "n"), "yes/no": ("yes", "no"), "true/false": ("true", "false")}


def mixed_booleans(vals: DataFrame, types: dict[str, str]) -> DataFrame:
    """Categorical fields of nothing but truth values, in more than one notation: (field, families, spellings)."""
    fields = [c for c, k in types.items() if k == "categorical"]
    low, family = F.lower("v"), F.lit(None).cast("string")
    for name, words in BOOLEANS.items():
        family = F.when(low.isin(*words), name).otherwise(family)
    own = vals.where(F.col("field").isin(*fields)).withColumn("family", family)
    flags = own.groupBy("field").agg(F.bool_and(F.col("family").isNotNull()).alias("all"), F.countDistinct("family").alias("families")).where("`all` and families > 1")
    # Spellings are read of fields that hold nothing else: a few dozen are possible.
    spelled = own.join(F.broadcast(flags.select("field", "families")), "field").groupBy("field", "families").agg(F.array_join(F.array_sort(F.collect_set("v")), ", ").alias("spellings"))
    return spelled.select("field", "families", "spellings")


def mixed_casing(vals: DataFrame, types: dict[str, str]) -> DataFrame:
    """(field, key, spellings, first_row) of categorical values that are spelled in more than one case."""
    fields = [c for c, k in types.items() if k == "categorical"]
    return (
        vals.where(F.col("field").isin(*fields))
        .groupBy("field", F.lower("v").alias("key"))
        .agg(F.count("*").alias("n_spellings"), F.array_join(F.array_sort(F.collect_set("v")), " / ").alias("spellings"), F.min("first_row").alias("first_row"))
        .where("n_spellings > 1")
    )


def _top(vals: DataFrame, k: int) -> DataFrame:
    """The k commonest values of each field. Each of 64 parts of a field ranks its own first, so that a field's values spread over tasks."""
    part = F.pmod(F.xxhash64("v"), F.lit(64))
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first_row"))
    near = vals.withColumn("part", part).withColumn("rank", order("field", "part")).where(F.col("rank") <= k).drop("part", "rank")
    return near.withColumn("rank", order("field")).where(F.col("rank") <= k)


def placeholder_values(vals: DataFrame, k: int = 5) -> DataFrame:
    """The commonest placeholders of each field."""
    return _top(vals.where(P.is_placeholder(F.col("v"))), k)


def repeated_values(vals: DataFrame, k: int = 5) -> DataFrame:
    """Values among the k commonest of their field with a tenth of its cells, three at least, placeholders aside."""
    totals = vals.groupBy("field").agg(F.sum("n").alias("total"))
    return _top(vals, k).join(totals, "field").where((F.col("n") >= 3) & (F.col("n") / F.col("total") >= 0.1) & ~P.is_placeholder(F.col("v")))


NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def medians(numbers: DataFrame, cuts: int = 256) -> DataFrame:
    """(field, numeric_median) of (field, x, n) rows, exact.

    A field's numbers are cut at quantiles of a bounded sketch, counts of the ranges say which of them
    hold the two middle places, and only those are looked at number by number: no task holds all
    distinct numbers of a field.
    """
    points = [k / cuts for k in range(1, cuts)]
    bounds = numbers.groupBy("field").agg(F.percentile_approx("x", points, 4 * cuts).alias("b"))
    ranged = numbers.join(F.broadcast(bounds), "field").select("field", "x", "n", F.aggregate("b", F.lit(0), lambda s, b: s + (b < F.col("x")).cast("int")).alias("range"))  # a row a field is broadcast
    sizes = ranged.groupBy("field", "range").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("field").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("m").over(Window.partitionBy("field"))
    places = sizes.select("field", "range", "m", before.alias("before"), F.floor((total - 1) / 2).alias("low"), F.floor(total / 2).alias("high"))
    held = places.where("(low >= before and low < before + m) or (high >= before and high < before + m)")
    near = ranged.join(F.broadcast(held), ["field", "range"])  # two rows a field at most
    upto = F.sum("n").over(Window.partitionBy("field", "range").orderBy("x")) + F.col("before")
    met = near.withColumn("upto", upto)
    at = lambda place: F.min(F.when(F.col("upto") > F.col(place), F.col("x")))
    return met.groupBy("field").agg(((at("low") + at("high")) / 2).alias("numeric_median"))


def profiles(vals: DataFrame, types: dict[str, str]) -> DataFrame:
    """Distinct values, lengths and, for amounts and ids, number statistics by field."""
    amounts, ids = ([c for c, k in types.items() if k == kind] for kind in ("currency", "id"))
    bare = F.when(F.col("field").isin(*amounts), F.regexp_replace("v", "[$,£€]", "")).when(F.col("field").isin(*ids), F.col("v"))
    number = F.when(F.trim(bare).rlike(NUMBER), F.trim(bare).try_cast("double"))
    size = F.length("v")
    numbered = vals.withColumn("x", number)
    made = numbered.groupBy("field").agg(
        F.count("*").alias("cardinality"),
        F.sum("n").alias("non_empty_values"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        F.sum(size * F.col("n")).alias("total_length"),
        F.min("x").alias("numeric_min"),
        F.max("x").alias("numeric_max"),
        (F.sum(F.col("x") * F.col("n")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("numeric_mean"),
    )
    middle = medians(numbered.where("x is not null").select("field", "x", "n"))
    return made.join(F.broadcast(middle), "field", "left")  # a row a field


def finished_profile(p: dict | None, total: int) -> dict:
    """A row of `profiles` with shares and averages."""
    if p is None:
        return {"cardinality": 0, "uniqueness_pct": 0, "total_values": total, "non_empty_values": 0, "min_length": 0, "max_length": 0, "avg_length": 0}
    out = {
        "cardinality": p["cardinality"], "uniqueness_pct": percent(p["cardinality"], p["non_empty_values"]), "total_values": total, "non_empty_values": p["non_empty_values"],
        "min_length": p["min_length"], "max_length": p["max_length"], "avg_length": round(p["total_length"] / p["non_empty_values"], 1),
    }
    return out | {k: round(p[k], 2) for k in ("numeric_min", "numeric_max", "numeric_mean", "numeric_median") if p[k] is not None}
