"""Suffix, SimHash and window dedup against brute force, and the cases their docstrings define."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dqscan.llm import blocks, simhash, suffix_dedup, window_dedup

SCHEMA = "doc_id long, text string"


def texts_of(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(400))
    out = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 30, 120])))) for i in range(25)]
    out += [(30, passage), (31, "x " + passage + " y"), (32, long), (33, long), (34, long[:900] + "q" + long[901:]), (35, "a" * 700), (36, "a" * 350 + "b" + "a" * 350), (37, "é" * 200), (38, "é" * 130 + passage)]
    out += [(39, None), (40, ""), (41, "  \t\n"), (42, "of " * 300), (43, passage + " " + passage)]
    return out


def brute_bytes(docs, width=100):
    seen, out = set(), {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            k = b[i : i + width]
            if k in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(k)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, suffix_dedup.HOT), (2, suffix_dedup.HOT), (1, 2), (2, 3)])
def test_suffix_dedup(spark, seed, hot):
    """With a low bound for hot anchors, nearly all windows are filed one by one."""
    docs = texts_of(seed)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    rows = suffix_dedup.remove_repeats(df, hot=hot).collect()
    assert {r[0]: tuple(r)[1:5] for r in rows} == brute_bytes(docs)
    assert all(r["kept_text"] == "" for r in rows if r["doc_id"] == 33)


def test_a_frequent_gram_is_split(spark):
    """A line that every document has between words of its own: its anchors have as many fragments as there are documents."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    line = " ".join(word() for _ in range(40))
    docs = [(i, " ".join(word() for _ in range(20)) + " " + line + " " + " ".join(word() for _ in range(20))) for i in range(80)]
    docs += [(100 + i, docs[i][1][40:-30]) for i in range(40)]
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA).repartition(3), hot=20).collect()
    assert {r[0]: tuple(r)[1:5] for r in rows} == brute_bytes(docs)


def test_fragments_of_one_key_and_other_bytes_stay_apart():
    sizes = np.array([140, 140, 140])
    flat = np.frombuffer(b"a" * 140 + b"b" * 140 + b"a" * 140, np.uint8)
    columns = [np.full(3, 9, np.uint64), np.full(3, 9, np.uint64), np.array([3, 2, 1]), np.zeros(3, np.int64), np.zeros(3, np.int64), np.array([0, 200, 400]), (sizes - 99).astype(np.uint8), np.zeros(3, np.uint8)]
    pile = suffix_dedup.Pile(columns, flat, 100).combined()
    assert sorted(zip(pile.doc.tolist(), [bytes(pile.bytes_of(np.array([k])))[:1] for k in range(len(pile.doc))], strict=True)) == [(1, b"a"), (2, b"b")]


def test_deep_shallow_sorts():
    rnd = np.random.default_rng(3)
    data = np.r_[rnd.integers(97, 99, 400).astype(np.uint8), np.full(300, 97, np.uint8)]
    starts = np.arange(600)
    order, label = suffix_dedup.deep_shallow(np.r_[data, np.zeros(120, np.uint8)], starts, np.zeros(600, np.int64), 90)
    keys = [bytes(np.r_[data, np.zeros(120, np.uint8)][s : s + 90]) for s in starts[order]]
    assert keys == sorted(keys)
    assert [a != b for a, b in zip(keys, keys[1:], strict=False)] == (np.diff(label) != 0).tolist()


def test_suffix_dedup_cases(spark):
    p = "".join(chr(97 + i * 7 % 26) for i in range(60)) * 3
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(3_000_000))
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    df = spark.createDataFrame([(None, p, "u"), (1, p, "v"), (1, p, "v"), (2, "z" * 99, "w"), (2, "y" * 120 + p, "w"), (3, long, "x"), (4, long[:50_000], "x")], SCHEMA + ", n_removed string")
    rows = sorted(map(tuple, suffix_dedup.remove_repeats(df, with_text=False, carry=("n_removed",)).toDF("doc_id", "n_bytes", "gone", "n_spans", "sha", "n_removed").select("doc_id", "n_bytes", "gone", "n_removed").collect()), key=str)
    first = brute_bytes([(None, p)])[None]
    assert (None, 180, first[1], "u") in rows  # a null id comes first and keeps what it has first
    assert rows.count((1, 180, 180, "v")) == 2
    assert (2, 99, 0, "w") in rows and (3, 3_000_000, 0, "x") in rows and (4, 50_000, 50_000, "x") in rows
    twice = spark.createDataFrame([(5, p[:150] + "q" * 30), (5, p[:150] + "q" * 30)], SCHEMA)
    assert {r["n_removed"] for r in suffix_dedup.remove_repeats(twice).collect()} == {brute_bytes([(5, p[:150] + "q" * 30)])[5][1]}
    with pytest.raises(TypeError, match="whole numbers"):
        suffix_dedup.remove_repeats(df.withColumn("doc_id", df.doc_id.cast("string")))


def brute_words(docs, width=35):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    count = Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def narrow() -> blocks.Sketch:
    """A sketch that takes most single entries for repeated."""
    sketch = blocks.Sketch(1)
    sketch.bits, sketch.wide = 8, -(-(1 << 8) // sketch.shards)
    return sketch


@pytest.mark.parametrize("sketch", [None, narrow()])
def test_window_dedup(spark, sketch):
    """Where the sketch is wrong about most windows, the second pass makes up for it."""
    docs = texts_of(4)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert {r[0]: tuple(r)[1:4] for r in window_dedup.remove_repeats(df, sketch=sketch).collect()} == brute_words(docs)


def test_window_dedup_cases(spark):
    assert window_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    t = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"v{i}" for i in range(400_000))
    df = spark.createDataFrame([(None, t, 1), (None, "other", 1), ("7", "b " * 10, 1), ("7", t, 2), ("8", None, 3), ("9", long, 4)], "doc_id string, text string, n_words int")
    rows = window_dedup.remove_repeats(df, carry=("n_words",)).toDF("doc_id", "n_words", "n_removed", "sha", "kept", "carried").collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["carried"]) for r in rows) == Counter([(None, 40, 40, 1), (None, 1, 0, 1), ("7", 10, 0, 1), ("7", 40, 40, 2), ("8", 0, 0, 3), ("9", 400_000, 0, 4)])


def test_words_of_equal_polynomials_stay(spark):
    """Two words that every polynomial hash modulo 2**64 takes for one, followed by equal words."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    rest = " ".join(f"w{i}" for i in range(34))
    docs = [(1, f"{word} {rest}"), (2, f"{word.translate(str.maketrans('ab', 'ba'))} {rest}")]
    assert [r["n_removed"] for r in window_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()] == [0, 0]


@pytest.mark.parametrize("operator", [window_dedup, suffix_dedup])
def test_removals_equal_their_sql(spark, operator):
    import duckdb
    import pandas as pd

    docs = [*texts_of(6), (7, "again " * 50)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    want = sorted(con.sql(operator.oracle()).fetchall())
    assert sorted(map(tuple, operator.remove_repeats(spark.createDataFrame(docs, SCHEMA), with_text=False).collect())) == want


@pytest.mark.parametrize("expected", [200_000, 8_000_000_000])
def test_few_single_entries_pass_the_sketch(expected):
    """A shard at full load, as it is at any size of the input, takes less than 5 % of single entries for repeated and no repeated one for single."""
    sketch = blocks.Sketch(expected)
    rnd = np.random.default_rng(5)
    n = min(sketch.SHARD, expected // sketch.shards)
    single, double = rnd.integers(0, 2**62, n, dtype=np.uint64), rnd.integers(0, 2**62, 1000, dtype=np.uint64)
    squeeze = lambda v: v % np.uint64(sketch.wide)  # all into the first shard
    parts = []
    for own in (np.r_[single[: n // 2], double], np.r_[single[n // 2 :], double]):
        v, where, c = np.unique(squeeze(blocks.mixed(own)), return_inverse=True, return_counts=True)
        parts.append((v, c, where))
    pieces = [piece for v, c, _ in parts for shard, piece in sketch.pieces(v, c) if shard == 0]
    assert len(pieces) == 2
    passed = np.concatenate([e[where] >= 2 for e, (_, _, where) in zip(sketch.estimates(pieces), parts, strict=True)])
    of_single = np.r_[passed[: n // 2], passed[n // 2 + 1000 : -1000]]
    assert of_single.mean() < 0.05 and passed[n // 2 : n // 2 + 1000].all() and passed[-1000:].all()


def test_blocks_stay_where_they_are(spark):
    """What is found out about a block joins it without an exchange of the blocks; they hold all rows, a task's in one bucket."""
    rows = spark.range(5000).selectExpr("id", "repeat('text ', cast(id % 300 as int)) as text").repartition(5)
    table = blocks.packed(rows, "text", 3_000_000, "test", limit=100_000)
    assert sum(blocks.opened(r["data"]).num_rows for r in table.collect()) == 5000
    assert table.select("block").distinct().count() == table.count() > 20
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert table.selectExpr("block >> 40 as task", f"pmod(hash(block), {n}) as bucket").distinct().count() == 5
    answers = table.selectExpr("block", "1 as kind", "2 as shard", "cast('x' as binary) as answer")
    plan = blocks.with_answers(table, spark.createDataFrame(answers.collect(), answers.schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_shards_fill_evenly():
    """Also with hashes that were picked for being small, as those of anchors are."""
    sketch = blocks.Sketch(40_000_000)
    v, n, _ = sketch.entries(np.random.default_rng(6).integers(0, 2**58, 200_000, dtype=np.uint64))
    sizes = [len(sketch._read(piece)[0]) for _, piece in sketch.pieces(v, n)]
    assert len(sizes) == sketch.shards and max(sizes) < 1.1 * min(sizes)


def brute_components(docs):
    fp = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp[d] = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    root = {d: d for d in fp}

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {d: (f"{fp[d]:016x}", find(d)) for d in fp}


def test_simhash(spark):
    docs = texts_of(5)
    base = " ".join(f"word{i}" for i in range(150))
    docs += [(100 + i, base + f" end{i}") for i in range(12)] + [(200, base.upper())]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    assert got == brute_components(docs)
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert kept == {c for _, c in brute_components(docs).values()}


def test_simhash_equals_its_sql(spark):
    """The SQL forms XXH64 by itself; shingles of all lengths, and near copies of long texts."""
    import duckdb
    import pandas as pd

    base = [f"Wörd{i}" for i in range(400)]
    docs = [*texts_of(8), (600, "x " * 5 + "y" * 90), (601, "One"), (602, " ".join(base)), (603, " ".join(base[:-3]).lower()), (604, " ".join(base[2:]))]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    got = simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(simhash.oracle()).fetchall())


def test_any_four_positions_hold_a_choice():
    choices = [set(c) for c in simhash.CHOICES]
    assert len(choices) == 20 and all(any(c <= set(four) for c in choices) for four in itertools.combinations(range(8), 4))


def test_tally_counts_shared_positional_bytes():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 2**63, 500, dtype=np.uint64), rnd.integers(0, 2**63, 500, dtype=np.uint64)
    mask = np.array([sum(255 << 8 * k for k in range(8) if i >> k & 1) for i in range(256)], np.uint64)[rnd.integers(0, 256, 500)]
    b = (b & ~mask) | (a & mask)
    want = (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(1)
    assert (simhash.tally(a, b) == want).all()


@pytest.mark.parametrize("bits", [24, 40])
def test_long_posting_lists_lose_no_link(bits):
    """Fingerprints around a centre, and others that share bytes with it: lists beyond DENSE are cut, and go by way of the middle."""
    rnd = np.random.default_rng(2)
    centre = rnd.integers(0, 2**63, dtype=np.uint64)
    fps = {int(centre)}
    while len(fps) < 1500:
        x = int(centre)
        for k in rnd.integers(0, bits, 3):
            x ^= 1 << int(k)
        fps.add(x)
    fps |= {int(centre) ^ int(x) for x in rnd.integers(0, 2**bits, 1500, dtype=np.uint64)}
    fps = np.array(sorted(fps | {int(x) for x in rnd.integers(0, 2**63, 200, dtype=np.uint64)}), np.uint64)
    a, b = simhash.links(simhash.postings(fps).ravel(), np.repeat(fps, len(simhash.CHOICES)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    x, y = np.nonzero(np.triu(near, 1))
    want = simhash.forest(fps[x], fps[y])
    assert (np.array(want) == np.array([a, b])).all()
    nodes = rnd.integers(0, 2**63, dtype=np.uint64) ^ rnd.integers(0, 2**20, len(fps), dtype=np.uint64)  # of which some differ in too many bits
    a, b = simhash.links(simhash.postings(fps).ravel(), np.repeat(fps, len(simhash.CHOICES)), np.repeat(nodes, len(simhash.CHOICES)), 4, 9)
    x, y = np.nonzero(np.triu(near & (np.bitwise_count(nodes[:, None] ^ nodes[None, :]) <= 9), 1))
    assert (np.array(simhash.forest(nodes[x], nodes[y])) == np.array([a, b])).all()


def test_near_copies(spark):
    """Groups by brute force over all pairs, and copies of which one word in forty is changed."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    docs = [*texts_of(7)]
    for k in range(30):
        words = [word() for _ in range(240)]
        docs.append((1000 + 10 * k, " ".join(words)))
        for c in range(1, 3):
            for at in range(c, 240, 60):
                words[at] = word()
            docs.append((1000 + 10 * k + c, " ".join(words)))
    docs += [(3000, docs[-1][1].upper()), (None, docs[-2][1])]
    raw = [(t or "").encode() for _, t in docs]
    prints, check = simhash.word_prints(raw, 5), simhash.fingerprint_many(raw, 5)
    near = np.logical_or.reduce([np.bitwise_count(p[:, None] ^ p[None, :]) <= 4 for p in prints]) & (np.bitwise_count(check[:, None] ^ check[None, :]) <= 12) | (check[:, None] == check[None, :])
    root = list(range(len(docs)))

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for x, y in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        root[max(find(x), find(y))] = min(find(x), find(y))
    groups: dict[int, set] = {}
    for k, (d, _) in enumerate(docs):
        groups.setdefault(find(k), set()).add(d)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got: dict[int, set] = {}
    for r in simhash.near_copies(df).collect():
        got.setdefault(r["component"], set()).add(r["doc_id"])
    assert sorted(map(str, map(sorted, (map(str, g) for g in got.values())))) == sorted(map(str, map(sorted, (map(str, g) for g in groups.values()))))
    kept = {r["doc_id"] for r in simhash.one_of_each(df, groups=simhash.near_copies).collect()}
    assert kept == {min(g, key=lambda d: (d is None, d or 0)) for g in groups.values()}
    assert sum(1000 + 10 * k + c in kept for k in range(30) for c in (1, 2)) < 6 and all(1000 + 10 * k in kept for k in range(30))


def test_simhash_cases(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "", 1), (5, None, 2), (9, " ", 3), (9, " ", 3), (3, "one two", 4), (7, "a b c d e " * 100_000, 5)], SCHEMA + ", fp int")
    df = df.withColumn("row_hash", F.lit("u")).withColumn("id", F.lit("v")).withColumn("component", F.lit(0))
    got = Counter((r["doc_id"], r["fingerprint"] == "0" * 16, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == Counter({(None, True, 5): 1, (5, True, 5): 1, (9, True, 5): 2, (3, False, 3): 1, (7, False, 7): 1})
    assert sorted((r["doc_id"], r["fp"], r["id"]) for r in simhash.one_of_each(df).collect()) == [(3, 4, "v"), (5, 2, "v"), (7, 5, "v")]
    twins = spark.createDataFrame([("a", "x y z", 1), ("a", "x y z", 2), ("a", "x y z", 2), ("b", "x y z", 3)], "doc_id string, text string, n int")
    assert [r["doc_id"] for r in simhash.one_of_each(twins).collect()] == ["a"]
