"""Quotation linking: conversations in reply order, without what their messages quote.

A line that begins with `>` marks quotes; the number of marks, which blanks may separate, is its
level. Neighbouring lines of one level are a passage. Passages and the unquoted parts of messages
are normalised (lower case, letters and digits alone, single blanks) and hashed; a quoted passage is
linked to the latest earlier message of its conversation that says the same without quoting it, as a
run of whole lines: one line, one or several paragraphs, or all of it, however the quote is wrapped.
A passage that no message says as one run is linked through the longest of its paragraphs that one
does say, and else of its lines. A message replies to the message that its shallowest linked quote
comes from; without one it replies to the message before it. Conversations are laid out in reply
order: each message behind the one it answers, answers to the same message by turn.

Edge cases: null texts are empty messages; a null role reads `unknown`; rows without conversation or
turn can't be ordered and are left out; repeated rows of a conversation and turn are kept and
ordered by role and a hash of their text; quotes that nothing matches are removed and counted as unlinked; messages of
any length are read whole; an empty table gives an empty one; other columns aren't read and may have
any names. In conversations that hold quotes the work on a message grows with its lines times the
number of different quote lengths asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import on_workers, schema_of, spool

#: Stands for "answers nothing".
NONE = -(2**63 - 1)
PARAGRAPH = r"\n\s*\n"
MARK = r"^[ \t]*>"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def key_of(text: Column) -> Column:
    """128 bits of a normalised passage, null for an empty one."""
    return F.when(F.length(text) > 0, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")))


def n_words(text: Column) -> Column:
    """Words of a normalised passage."""
    return F.when(F.length(text) > 0, F.size(F.split(text, " "))).otherwise(0)


def pieces_of(passage: Column) -> Column:
    """[(grain, text)]: the passage, its paragraphs if it has several, and its lines if it has several."""

    def cut(grain: int, parts: Column) -> Column:
        made = F.transform(parts, lambda x: F.struct(F.lit(grain).alias("grain"), normalised(x).alias("text")))
        return F.when(F.size(parts) > 1, made).otherwise(F.slice(made, 1, 0))

    return F.concat(F.array(F.struct(F.lit(0).alias("grain"), normalised(passage).alias("text"))), cut(1, F.split(passage, PARAGRAPH)), cut(2, F.split(passage, r"\n")))


def runs_of(rows: DataFrame) -> DataFrame:
    """conv, source, key of the runs of whole lines of `said` that have one of the numbers of words in `lengths`."""
    lines = F.filter(F.transform(F.split("said", r"\n"), lambda x: F.split(normalised(x), " ")), lambda x: x != F.array(F.lit("")))
    rows = rows.select("conv", F.col("turn").alias("source"), "lengths", lines.alias("lines"))
    ends = F.aggregate("lines", F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + F.size(x))))
    rows = rows.select("conv", "source", "lengths", F.flatten("lines").alias("words"), ends.alias("ends"))  # `ends` begins with 0, the start of the first line
    runs = F.flatten(F.transform("ends", lambda s: F.transform(F.array_intersect(F.col("lengths"), F.transform("ends", lambda e: e - s)), lambda n: F.array_join(F.slice("words", s + 1, n), " "))))
    return rows.select("conv", "source", F.explode(runs).alias("run")).select("conv", "source", key_of(F.col("run")).alias("key")).distinct()


def level_of(line: Column) -> Column:
    marks = F.regexp_extract(line, r"^((?:[ \t]*>)*)", 1)
    return F.length(F.regexp_replace(marks, r"[^>]", ""))


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """id (of the row, once the table is written), conv, turn, role, h (hash of the text), said (text without quotes), quotes: [(level, passage)]."""
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.where("conv is not null and turn is not null").withColumn("h", F.md5("text")).withColumn("id", F.monotonically_increasing_id())
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.struct(level_of(x).alias("level"), F.regexp_replace(x, r"^(?:[ \t]*>)+[ \t]?", "").alias("line")))
    rows = rows.withColumn("lines", F.when(F.col("text").rlike(r"(?m)" + MARK), lines))
    said = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    # Lines of one level in a row are a passage: one opens where the level changes.
    opens = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    rows = rows.withColumn("opens", F.when(F.col("lines").isNotNull(), opens))
    passage = lambda at, k: F.struct(F.get("lines", at)["level"].alias("level"), F.array_join(F.transform(F.slice("lines", at + 1, F.coalesce(F.get("opens", k + 1), F.size("lines")) - at), lambda x: x["line"]), "\n").alias("passage"))
    quotes = F.filter(F.transform("opens", passage), lambda x: x["level"] > 0)
    none = F.array().cast("array<struct<level:int,passage:string>>")
    return rows.select("id", "conv", "turn", "role", "h", F.trim(F.when(F.col("lines").isNull(), F.col("text")).otherwise(said)).alias("said"), F.coalesce(quotes, none).alias("quotes"))


def conversations(messages: DataFrame, **columns: str) -> DataFrame:
    """One row a message: conv_id, turn, role, said, reply_to (turn or null), n_quotes, n_linked, reply_order."""
    on_workers(messages.sparkSession)
    rows = spool(parsed(messages, **columns), "messages")
    quoting = rows.where(F.size("quotes") > 0).select("conv", "turn", "id", F.posexplode("quotes").alias("at", "q")).select("conv", "turn", "id", "at", F.col("q.level").alias("level"), F.explode(pieces_of(F.col("q.passage"))).alias("p"))
    quoting = quoting.select("conv", "turn", "id", "at", "level", "p.grain", n_words(F.col("p.text")).alias("words"), key_of(F.col("p.text")).alias("key")).where("key is not null")
    asked = quoting.groupBy("conv").agg(F.collect_set("words").alias("lengths"))
    # Sources and quotes of a key lie in one order, so that a line said and quoted often makes no pairs.
    sources = runs_of(rows.join(asked, "conv")).withColumn("turn", F.col("source"))
    earlier = F.max("source").over(Window.partitionBy("conv", "key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    linked = (
        quoting.unionByName(sources, allowMissingColumns=True)
        .withColumn("found", earlier)
        .where("at is not null and found is not null")
        .groupBy("id", "at", "level")
        .agg(F.max(F.struct(-F.col("grain"), "words", "found")).alias("best"))
        .select("id", "at", "level", F.col("best.found").alias("source"))
        .groupBy("id")
        .agg(F.count("*").alias("n_linked"), F.min(F.struct("level", (-F.col("source")).alias("late"), "at")).alias("best"))
        .select("id", "n_linked", (-F.col("best.late")).alias("quoted"))
    )
    # From here on numbers alone travel, until the texts are joined to them.
    own = Window.partitionBy("conv").orderBy("turn")
    before = F.max("turn").over(own.rangeBetween(Window.unboundedPreceding, -1))
    slim = rows.select("id", "conv", "turn", "role", "h").join(linked, "id", "left").withColumn("before", before)
    slim = spool(slim.withColumn("reply_to", F.coalesce("quoted", "before")), "replies")
    # Only conversations in which a message answers another one than that before it leave the order of turns.
    tree = slim.groupBy("conv", "turn").agg(F.min(F.coalesce("reply_to", F.lit(NONE))).alias("to"), F.max(F.coalesce("before", F.lit(NONE))).alias("before"))
    turned = tree.where("to <> before").select("conv").distinct()
    ranks = reply_ranks(spool(tree.join(turned, "conv", "left_semi").select("conv", "turn", "to"), "tree"))
    order = Window.partitionBy("conv").orderBy(F.coalesce("rank", F.lit(0)), "turn", "role", "h")
    slim = slim.join(ranks, ["conv", "turn"], "left").select("id", "reply_to", "n_linked", F.row_number().over(order).alias("reply_order"))
    return rows.join(slim, "id").select(F.col("conv").alias("conv_id"), "turn", "role", "said", "reply_to", F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_order")


def _walk(turns: list[int], to: list[int]) -> list[int]:
    """Ranks in reply order of the messages of a conversation, whose turns ascend and which answer earlier ones."""
    at = {t: k for k, t in enumerate(turns)}
    parent, size = [at.get(t, -1) for t in to], [1] * len(turns)
    for k in range(len(turns) - 1, -1, -1):
        if parent[k] >= 0:
            size[parent[k]] += size[k]
    free, top, out = [0] * len(turns), 0, []
    for k, p in enumerate(parent):
        if p < 0:
            rank, top = top, top + size[k]
        else:
            rank, free[p] = free[p], free[p] + size[k]
        free[k] = rank + 1
        out.append(rank)
    return out


def reply_ranks(tree: DataFrame, most: int = 100_000) -> DataFrame:
    """conv, turn, rank of (conv, turn, to) rows: each message behind the one it answers, answers to one message by turn.

    Conversations of up to `most` messages are walked in a task; longer ones are ranked by pointer
    doubling over the table, so that no task holds one.
    """
    kind = tree.schema["conv"].dataType
    sizes = tree.groupBy("conv").agg(F.count("*").alias("m"))
    sized = spool(tree.join(sizes, "conv"), "sized")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def ranked(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            first = rows["first"].to_pylist()
            cuts = [k for k, x in enumerate(first) if x] + [len(first)]
            turns, to, out = rows["turn"].to_pylist(), rows["to"].to_pylist(), []
            for a, b in zip(cuts, cuts[1:], strict=False):
                out += _walk(turns[a:b], to[a:b])
            return pa.RecordBatch.from_arrays([rows["conv"].chunk(0), rows["turn"].chunk(0), pa.array(out, pa.int64())], names=["conv", "turn", "rank"])

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            last = max((k for k, x in enumerate(rows["first"].to_pylist()) if x), default=0)  # a conversation may go on in the next batch
            if last:
                yield ranked(rows.slice(0, last))
            left = rows.slice(last)
        if left is not None and left.num_rows:
            yield ranked(left)

    first = F.row_number().over(Window.partitionBy("conv").orderBy("turn")) == 1
    small = sized.where(F.col("m") <= most).select("conv", "turn", "to", first.alias("first")).mapInArrow(walk, schema_of(T.StructType([T.StructField("conv", kind)]), "turn long, rank long"))
    long = sized.where(F.col("m") > most).select("conv", "turn", "to")
    return small.unionByName(_doubled(long)) if long.limit(1).count() else small


def _doubled(tree: DataFrame) -> DataFrame:
    """Ranks by pointer doubling on the tour that enters and leaves every message: what is still to be entered from each stop on."""
    child = tree.groupBy("conv", F.col("to").alias("turn")).agg(F.min("turn").alias("child"))
    sibling = F.lead("turn").over(Window.partitionBy("conv", "to").orderBy("turn"))
    known = tree.select("conv", F.col("turn").alias("to"), F.lit(True).alias("answered"))
    rows = tree.withColumn("sibling", sibling).join(child, ["conv", "turn"], "left").join(known, ["conv", "to"], "left")
    enter = F.struct(F.lit(0).alias("side"), F.coalesce("child", "turn").alias("next"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("next_side"), F.lit(1).cast("long").alias("left"))
    leave = F.struct(F.lit(1).alias("side"), F.coalesce("sibling", F.when(F.col("answered"), F.col("to"))).alias("next"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("next_side"), F.lit(0).cast("long").alias("left"))
    live, done = spool(rows.select("conv", "turn", F.explode(F.array(enter, leave)).alias("x")).select("conv", "turn", "x.*"), "tour"), []
    while live.where("next is not null").limit(1).count():
        on = live.select("conv", F.col("turn").alias("next"), F.col("side").alias("next_side"), F.col("next").alias("n2"), F.col("next_side").alias("s2"), F.col("left").alias("l2"))
        moved = live.where("next is not null").join(on, ["conv", "next", "next_side"]).select("conv", "turn", "side", F.col("n2").alias("next"), F.col("s2").alias("next_side"), (F.col("left") + F.col("l2")).alias("left"))
        live = spool(moved.unionByName(live.where("next is null")), "tour")
    total = live.groupBy("conv").agg(F.max("left").alias("n"))
    return live.where("side = 0").join(total, "conv").select("conv", "turn", (F.col("n") - F.col("left")).alias("rank"))


def oracle() -> str:
    """DuckDB SQL for `conversations` over the table of that name, which compares normalised passages themselves."""
    normal = lambda x: r"trim(regexp_replace(lower(" + x + r"), '[^\p{L}\p{N}]+', ' ', 'g'))"
    words = lambda x: f"CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END"
    return rf"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER () AS id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, 'unknown'), md5(coalesce(text, ''))) AS n,
         max(turn::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), cut AS (
  SELECT id, conv_id, turn, unnest(l) AS raw, unnest(range(1, len(l) + 1)) AS k FROM (SELECT *, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM m)
), line AS (
  SELECT *, length(regexp_replace(regexp_extract(raw, '^((?:[ 	]*>)*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(raw, '^(?:[ 	]*>)+[ 	]?', '') AS line FROM cut
), marked AS (
  SELECT id FROM line GROUP BY id HAVING max(level) > 0
), said AS (
  SELECT m.id, CASE WHEN marked.id IS NULL THEN any_value(m.text) ELSE coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (level = 0), '') END AS said
  FROM m LEFT JOIN marked USING (id) LEFT JOIN line USING (id) GROUP BY m.id, marked.id
), island AS (
  SELECT *, k - row_number() OVER (PARTITION BY id, level ORDER BY k) AS part FROM line SEMI JOIN marked USING (id)
), q AS (
  SELECT id, conv_id, turn, level, min(k) AS place, string_agg(line, chr(10) ORDER BY k) AS passage FROM island WHERE level > 0 GROUP BY id, conv_id, turn, level, part
), piece AS (
  SELECT id, conv_id, turn, level, place, 0 AS grain, {normal("passage")} AS t FROM q
  UNION ALL SELECT id, conv_id, turn, level, place, 1, {normal("unnest(string_split_regex(passage, '" + PARAGRAPH + "'))")} FROM q
  UNION ALL SELECT id, conv_id, turn, level, place, 2, {normal("unnest(string_split(passage, chr(10)))")} FROM q
), source AS (
  SELECT m.conv_id, m.turn, list({normal("x")} ORDER BY k) AS lines
  FROM (SELECT id, unnest(string_split(trim(said), chr(10))) AS x, unnest(range(1, len(string_split(trim(said), chr(10))) + 1)) AS k FROM said) JOIN m USING (id)
  WHERE {normal("x")} <> '' AND m.conv_id IN (SELECT conv_id FROM q) GROUP BY m.id, m.conv_id, m.turn
), run AS (
  SELECT DISTINCT conv_id, turn AS source, array_to_string(lines[i:j], ' ') AS t
  FROM (SELECT *, unnest(range(i, len(lines) + 1)) AS j FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM source))
), found AS (
  SELECT id, place, level, grain, {words("p.t")} AS words, max(source) AS source
  FROM piece p JOIN run USING (conv_id, t) WHERE source < p.turn AND p.t <> '' GROUP BY id, place, level, grain, p.t
), best AS (
  SELECT id, place, level, source FROM found QUALIFY row_number() OVER (PARTITION BY id, place ORDER BY grain, words DESC, source DESC) = 1
), linked AS (
  SELECT id, count(*) AS n_linked, first(source ORDER BY level, source DESC, place) AS quoted FROM best GROUP BY id
), r AS (
  SELECT m.*, trim(said) AS said, coalesce(quoted, before) AS reply_to, coalesce(n_linked, 0) AS n_linked, (SELECT count(*) FROM q WHERE q.id = m.id) AS n_quotes
  FROM m JOIN said USING (id) LEFT JOIN linked USING (id)
), node AS (
  SELECT conv_id, turn, min(coalesce(reply_to, {NONE})) AS up FROM r GROUP BY conv_id, turn
), path AS (
  SELECT conv_id, turn, [turn] AS path FROM node WHERE up = {NONE}
  UNION ALL SELECT node.conv_id, node.turn, list_append(path, node.turn) FROM node JOIN path ON node.conv_id = path.conv_id AND node.up = path.turn
)
SELECT conv_id, turn, role, said, reply_to, n_quotes, n_linked, row_number() OVER (PARTITION BY conv_id ORDER BY path, n) AS reply_order
FROM r JOIN path USING (conv_id, turn)"""
