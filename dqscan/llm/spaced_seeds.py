"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

Tokens are the runs of letters and digits of the lower-cased text. A seed is a fixed mask over a
span of tokens: the hash of a place takes the tokens where the mask has a 1 and ignores the rest, so
that a substitution under a 0 changes nothing. The seeds of all places of the documents are joined
with those of the benchmark; around each hit, document and item are laid side by side on the hit's
diagonal, and the tokens that agree within `MARGIN` places of the seed are counted. A hit counts if
at least `need` = 11 agree (or 80 % of an item of fewer than 13 tokens).

The benchmark's side is broadcast if it holds at most `max_broadcast` seeds; beyond that the seeds
are joined by a shuffle and the texts of the documents with hits are fetched by a second join.

With `short_items`, items of fewer than eight tokens match where a document holds them whole, and of
eight to eleven wherever 80 % of the tokens agree: such an item is cut into one block more than
tokens may differ, so that a block is always whole, and the blocks are seeds as well.

Edge cases: null and empty texts have no tokens; documents and items of fewer than eight tokens have
no spaced seed and match by `short_items` alone; texts of any length are read whole; repeated items
and rows each count, rows of one id together, a null id of documents or items being an id like any
other; an empty benchmark or table gives an empty result; other columns aren't read and may have any
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool

#: The masks; together they hit any twelve tokens of which one is substituted.
SEEDS = ("11101011", "110100111", "1110011001")
SPAN = 8
MARGIN = 5
#: (first token, length) of the blocks of short items by their number of tokens.
BLOCKS = {n: ((0, n),) for n in range(1, SPAN)} | {8: ((0, 4), (4, 4)), 9: ((0, 4), (4, 5)), 10: ((0, 3), (3, 4), (7, 3)), 11: ((0, 3), (3, 4), (7, 4))}


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def seeds(h: Column) -> Column:
    """Hashes of all masks at all places, those of a place side by side. Where a mask reaches beyond the end it takes what there is."""

    def at(i: Column) -> Column:
        return F.array(*[F.xxhash64(F.lit(k), *[F.get(h, i + p) for p, bit in enumerate(mask) if bit == "1"]) for k, mask in enumerate(SEEDS)])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - SPAN), at))


def _placed(rows: DataFrame, *carry: str) -> DataFrame:
    """One row a seed: what is carried along, its place and its hash. Needs a column h.

    The seeds are a column before they are dealt out, so that generating rows and looking them up
    run in one compiled stage. The outer form is used as the other one adds a filter on the size of
    the array, which works all seeds out again.
    """
    made = rows.select(*carry, F.when(F.size("h") >= SPAN, seeds(F.col("h"))).otherwise(F.array().cast("array<bigint>")).alias("s"))
    return made.select(*carry, F.posexplode_outer("s").alias("p", "seed")).select(*carry, F.expr(f"p div {len(SEEDS)}").cast("int").alias("place"), "seed")


def _block(h: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), F.slice(h, start + 1, length))


def _short_hits(words: DataFrame, items: DataFrame, sizes: list[int], few: bool) -> DataFrame:
    """doc, item, place, item_place where a block of an item of one of these sizes lies in a document, both moved back to the item's start or the document's."""
    size = F.size("item_h")
    cut = F.coalesce(*[F.when(size == n, F.array(*[F.struct(F.lit(o).alias("at"), _block(F.col("item_h"), F.lit(o), k).alias("seed")) for o, k in BLOCKS[n]])) for n in sizes])
    theirs = items.select("item", F.explode(cut).alias("b")).select("item", "b.at", "b.seed")
    lengths = sorted({k for n in sizes for _, k in BLOCKS[n]})

    def placed(k: int) -> Column:
        return F.when(F.size("h") >= k, F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: F.struct(i.alias("p"), _block(F.col("h"), i, k).alias("seed"))))

    ours = words.select("doc", F.explode(F.flatten(F.filter(F.array(*map(placed, lengths)), lambda x: x.isNotNull()))).alias("b")).select("doc", "b.p", "b.seed")
    return ours.join(F.broadcast(theirs) if few else theirs, "seed").select("doc", "item", F.greatest(F.col("p") - F.col("at"), F.lit(0)).alias("place"), F.greatest(F.col("at") - F.col("p"), F.lit(0)).alias("item_place"))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", need: int = 11, max_broadcast: int = 500_000, short_items: bool = False) -> DataFrame:
    """One row for each document and item that overlap: key, item, n_hits, n_agreeing tokens around the best hit, first_place.

    Hits are rows of four numbers, written first. Only documents with hits are read again, and each
    hit is verified by itself on the few tokens around it, so that no document's hits are gathered.
    """
    words = docs.select(F.col(f"`{key}`").alias("doc"), hashes(F.col(f"`{text}`")).alias("h"))
    items = benchmark.select(F.col(f"`{item}`").alias("item"), hashes(F.col(f"`{item_text}`")).alias("item_h"))
    theirs = _placed(items.withColumnRenamed("item_h", "h"), "item").where("seed is not null").select("seed", F.col("place").alias("item_place"), "item")
    short = {r["n"]: r["count"] for r in items.groupBy(F.size("item_h").alias("n")).count().where(F.col("n").isin(*BLOCKS)).collect()} if short_items else {}
    few = theirs.count() + sum(len(BLOCKS[n]) * k for n, k in short.items()) <= max_broadcast
    span = max(map(len, SEEDS)) + 2 * MARGIN
    seeded = _placed(words, "doc").join(F.broadcast(theirs) if few else theirs, "seed").select("doc", "item", "place", "item_place")
    if short:
        seeded = seeded.unionByName(_short_hits(words, items, sorted(short), few))
    hits = spool(seeded.distinct(), "hits")
    ids = hits.select("doc").distinct()
    # Sixteen bytes an id: at most 16 MB are broadcast, and more ids are joined by a shuffle.
    ids = F.broadcast(ids) if ids.count() <= 2 * max_broadcast else ids
    found = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    found = found.join(ids, F.col("k").eqNullSafe(F.col("doc")), "left_semi").select("k", hashes(F.col("t")).alias("h"))
    near = hits.join(found, F.col("k").eqNullSafe(F.col("doc"))).select("doc", "item", "place", "item_place", F.least("place", F.lit(MARGIN)).alias("before"), F.slice(F.col("h"), F.greatest(F.col("place") - MARGIN, F.lit(0)) + 1, F.lit(span)).alias("near"))
    beside = items.where(F.size("item_h") >= (1 if short else SPAN)).withColumnRenamed("item", "beside")
    near = near.join(F.broadcast(beside) if few else beside, F.col("item").eqNullSafe(F.col("beside")))
    around = F.sequence(-F.least(F.col("before"), F.col("item_place")), F.least(F.lit(span - MARGIN), F.size("item_h") - F.col("item_place")) - 1)
    agree = F.size(F.filter(around, lambda k: F.get(F.col("near"), F.col("before") + k) == F.get(F.col("item_h"), F.col("item_place") + k)))
    enough = F.least(F.lit(need), F.ceil(F.size("item_h") * F.lit(0.8)))
    return (
        near.select("doc", "item", "place", agree.alias("agree"), enough.alias("enough"))
        .where("agree >= enough")
        .groupBy("doc", "item")
        .agg(F.count("*").alias("n_hits"), F.max("agree").alias("n_agreeing"), F.min("place").alias("first_place"))
        .select(F.col("doc").alias(key), F.col("item").alias(item), "n_hits", "n_agreeing", "first_place")
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents without any overlap; rows that share an id, null included, go together."""
    bad = overlaps(docs, benchmark, key, **options)
    bad = bad.select(bad[key].alias("bad")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["bad"]), "left_anti")


def oracle(need: int = 11) -> str:
    """DuckDB SQL for `overlaps` over documents and benchmark, which compares the tokens themselves; for items of twelve tokens and more."""
    cut = lambda x: r"list_filter(string_split_regex(lower(coalesce(" + x + r", '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
    masks = ", ".join("[" + ", ".join(str(k) for k, x in enumerate(m) if x == "1") + "]" for m in SEEDS)
    span = max(map(len, SEEDS)) + MARGIN

    def placed(source: str, name: str) -> str:
        seed = "array_to_string(list_transform(list_filter(mask, lambda k: p + k < len(h)), lambda k: h[p + k + 1]), ' ')"
        return f"SELECT {name}, p, m, {seed} AS seed FROM (SELECT {name}, h, unnest(range(0, len(h) - {SPAN - 1})) AS p FROM {source} WHERE len(h) >= {SPAN}), mask"

    return f"""
WITH d AS (
  SELECT doc_id, {cut("text")} AS h FROM documents
), i AS (
  SELECT item_id, {cut("text")} AS h FROM benchmark
), mask AS (
  SELECT unnest([{masks}]) AS mask, unnest(range({len(SEEDS)})) AS m
), ours AS (
  {placed("d", "doc_id")}
), theirs AS (
  {placed("i", "item_id")}
), hit AS (
  SELECT DISTINCT doc_id, item_id, o.p, t.p AS q FROM ours o JOIN theirs t USING (m, seed)
), laid AS (
  SELECT hit.doc_id, hit.item_id, p, q, len(i.h) AS n,
         len(list_filter(range(-least(p, q, {MARGIN}), least({span}, len(i.h) - q)), lambda k: p + k < len(d.h) AND d.h[p + k + 1] = i.h[q + k + 1])) AS agree
  FROM hit JOIN d ON hit.doc_id IS NOT DISTINCT FROM d.doc_id JOIN i ON hit.item_id IS NOT DISTINCT FROM i.item_id
)
SELECT doc_id, item_id, count(*) AS n_hits, max(agree) AS n_agreeing, min(p)::INT AS first_place
FROM laid WHERE agree >= least({need}, ceil(n * 0.8)) GROUP BY doc_id, item_id"""
