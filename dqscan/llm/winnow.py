"""Document fingerprints by winnowing, with DataFrame functions alone.

A text's units are its words, long ones cut every `UNIT` characters. A unit's hash is its CRC32; that
of the k-gram that ends at each unit is a polynomial of theirs modulo a prime (the first k - 1 grams
are shorter). Of every window of w hashes the least is kept, the rightmost on ties, with its place,
that of the gram's last unit. One scheme serves all lengths, so that any run of w + k - 1 units that
two texts share leaves a common entry in both; texts of fewer than w units keep the least of what
they have.

Edge cases: a null text is empty; texts without a unit have the empty fingerprint, and two such are
alike by 1; texts of any length are read whole; equal texts have equal fingerprints, wherever they
stand; repeated ids are ordered by their text; null ids come first; ids must be whole numbers, as
their order decides (TypeError for others); an empty table gives an empty one; other columns aren't
read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3
WINDOW = 4
UNIT = 16
UNITS = rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"
LOW = (1 << 32) - 1
PRIME, BASE = (1 << 31) - 1, 1103515245


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`, array<long>: 31 bits of hash over the place counted down from 2**32 - 1, in the order of places.

    Each step is a projection of its own, as an expression that is named twice is worked out twice.
    """
    h, v = (f"__{out}_{x}" for x in "hv")
    names = df.columns
    units = F.regexp_extract_all(F.col(text), F.lit(UNITS), F.lit(0))
    step = df.select(*names, F.transform(units, lambda u: F.crc32(u.cast("binary"))).alias(h))
    none = F.array().cast("array<bigint>")

    def gram(i: Column) -> Column:
        """Hash of the gram that ends at unit i; units before the first one count as 0."""
        out = F.lit(0).cast("bigint")
        for j in range(GRAM - 1, -1, -1):
            out = (out * BASE + F.coalesce(F.get(F.col(h), i - j), F.lit(0))) % PRIME
        return out

    ranked = F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.shiftleft(gram(i), 32).bitwiseOR(F.lit(LOW) - i))
    step = step.select(*names, F.when(F.size(h) > 0, ranked).otherwise(none).alias(v))
    least = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(v) - WINDOW), lambda i: F.least(*[F.get(F.col(v), i + j) for j in range(WINDOW)])))
    picked = F.when(F.size(v) >= WINDOW, least).when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(none)
    return step.select(*names, picked.alias(out))


def shown(fingerprint: Column) -> Column:
    """The entries as hash@place, in the order of places."""
    entry = lambda e: F.concat(F.lower(F.hex(F.shiftright(e, 32))), F.lit("@"), (F.lit(LOW) - e.bitwiseAND(F.lit(LOW))).cast("string"))
    return F.concat_ws(" ", F.transform(fingerprint, entry))


def hash_set(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda e: F.shiftright(e, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared hashes over the sum of both numbers of them, 0 to 1; 1 if both are empty. a, b: from hash_set."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / F.greatest(total, F.lit(1)))


def with_bucket(df: DataFrame, key: str, rows_each: int = 2000, most: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """df with a column bucket that never falls as key rises, and (bucket, previous) of the buckets in use.

    The bounds are quantiles of the key, 128 at most, each range cut evenly further; both the bounds
    and the list of buckets (at most `most` rows) are of a fixed size, whatever the table's.
    """
    k = F.col(key)
    points = [i / 128 for i in range(1, 128)]
    s = df.agg(F.count(k).alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi"), F.percentile_approx(k, points, 10_000).alias("q")).first()
    if not s["n"]:
        bucket = F.lit(0)
    else:
        total = min(most, max(1, -(-s["n"] // rows_each)))
        ranges = min(total, 128)
        step = 128 / ranges
        bounds = sorted({s["lo"], *(int(s["q"][round(i * step) - 1]) for i in range(1, ranges) if s["q"])})
        each = -(-total // len(bounds))
        ends = [*bounds[1:], s["hi"] + 1]

        def choose(a: int, b: int) -> Column:  # a balanced tree of comparisons
            if b - a == 1:
                wide = max(1, -(-(ends[a] - bounds[a]) // each))
                return F.lit(1 + a * each) + F.expr(f"cast(least(({key} - {bounds[a]}L) div {wide}L, {each - 1}L) as int)")
            mid = (a + b) // 2
            return F.when(k < bounds[mid], choose(a, mid)).otherwise(choose(mid, b))

        bucket = F.when(k.isNull(), F.lit(0)).otherwise(choose(0, len(bounds)))
    out = df.withColumn("bucket", bucket)
    used = sorted(r["bucket"] for r in out.select("bucket").distinct().collect())
    spark = df.sparkSession
    if not used:
        return out, spark.range(0).selectExpr("cast(id as int) as bucket", "cast(id as int) as previous")
    pairs = ",".join(f"{b} {p}" for b, p in zip(used, [used[-1], *used[:-1]], strict=True))
    links = spark.range(1).select(F.explode(F.split(F.lit(pairs), ",")).alias("x")).selectExpr("cast(split(x, ' ')[0] as int) as bucket", "cast(split(x, ' ')[1] as int) as previous")
    return out, links


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited text gives up its last quarter for the beginning of the next document. Documents are
    dealt out once, by ranges of their ids; the first of each range goes to the range before as well.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"ids must be whole numbers, not {docs.schema[key].dataType.simpleString()}: the next document is that of the next one")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows, links = with_bucket(rows, "id")
    firsts = rows.groupBy("bucket").agg(F.min("id").alias("first"))
    links = links.join(F.broadcast(firsts), "bucket")  # as bounded as the buckets
    rows = (
        rows.join(F.broadcast(links), "bucket")
        .select("id", "text", F.explode(F.when(F.col("id").eqNullSafe(F.col("first")), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("previous").alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest"))))).alias("x"))
        .select("id", "text", F.col("x.b").alias("bucket"), F.col("x.guest").alias("guest"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
    )
    marked = with_fingerprint(rows, "text", "fp")
    order = Window.partitionBy("bucket").orderBy("guest", F.asc_nulls_first("id"), "text")
    n = F.length("text")
    paired = marked.select(
        "id", "text", "fp", "guest", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")
    ).where("not guest")
    quarter = F.floor(n / 4).cast("int")
    paired = paired.select("id", n.alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), quarter)).alias("edited"), "fp", "next_fp")
    paired = with_fingerprint(paired, "edited", "edited_fp")
    sets = paired.select("*", hash_set(F.col("fp")).alias("s"), hash_set(F.col("edited_fp")).alias("se"), hash_set(F.col("next_fp")).alias("sn"))
    return sets.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key),
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("se")).alias("near_edited"),
        likeness(F.col("s"), F.col("sn")).alias("near_next"),
    )


def _crc_table() -> list[int]:
    """CRC32 of single bytes, as the reversed polynomial 0xEDB88320 makes them, for engines that have no such function."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_CRC = "[" + ", ".join(f"{c}::BIGINT" for c in _crc_table()) + "]"


def oracle() -> str:
    """DuckDB SQL for `edited` over the table documents."""

    def entries(text: str) -> str:
        """[(hash, place)] of a text, by way of the same ranks."""
        units = f"regexp_extract_all({text}, '{UNITS}')"
        hashed = f"list_transform(u, lambda x: xor(list_reduce(list_transform(range(0, strlen(x)), lambda k: ('0x' || substring(hex(encode(x)), 2 * k + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, {_CRC}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT))"
        gram = "0"
        for j in range(GRAM - 1, -1, -1):
            gram = f"(({gram}) * {BASE} + CASE WHEN i > {j} THEN h[i - {j}] ELSE 0 END) % {PRIME}"
        ranks = f"list_transform(range(1, len(h) + 1), lambda i: (({gram})::BIGINT << 32) | ({LOW} - (i - 1)))"
        least = f"list_transform(range(1, len(v) - {WINDOW - 2}), lambda i: list_min(v[i:i + {WINDOW - 1}]))"
        return f"(SELECT list_transform(CASE WHEN len(v) >= {WINDOW} THEN list_distinct({least}) WHEN len(v) > 0 THEN [list_min(v)] ELSE [] END, lambda e: {{'p': {LOW} - (e & {LOW}), 'h': e >> 32}}) FROM (SELECT {ranks} AS v FROM (SELECT {hashed} AS h FROM (SELECT {units} AS u))))"

    show = lambda e: f"array_to_string(list_transform(list_sort({e}), lambda x: format('{{:x}}', x.h) || '@' || x.p), ' ')"
    hashes = lambda e: f"list_distinct(list_transform({e}, lambda x: x.h))"

    def alike(a: str, b: str) -> str:
        return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({hashes(a)}, {hashes(b)})) / (len({hashes(a)}) + len({hashes(b)})) END"

    order = "ORDER BY doc_id NULLS FIRST, t"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), n AS (
  SELECT *, coalesce(lead(t) OVER ({order}), first_value(t) OVER ({order})) AS after FROM d
), e AS (
  SELECT doc_id, t, after, t[1:length(t) - length(t) // 4] || after[1:length(t) // 4] AS edited FROM n
), f AS (
  SELECT doc_id, length(t) AS n_chars, sha256(edited) AS edited_sha256, {entries("t")} AS a, {entries("edited")} AS b, {entries("after")} AS c FROM e
)
SELECT doc_id, n_chars, edited_sha256, {show("a")} AS fingerprint, {show("b")} AS edited_fingerprint, {alike("a", "b")} AS near_edited, {alike("a", "c")} AS near_next FROM f"""
