"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint is eight bytes, each at its position. Two fingerprints of at most `max_bits` = 4
differing bits differ in four bytes at most, so at least four of the eight positional bytes are
shared: the guaranteed minimum of the count filter. For each pair that the index brings together the
shared positional bytes are tallied, pairs below the minimum are dropped, and the others are verified
on all 64 bits.

The index files a fingerprint under the bytes of three positions at a time: twenty choices of three,
such that any four shared positions hold one of them. Posting lists of single bytes, whose pairs grow
with the square of the table whatever their bytes, are never walked. A list of more than `DENSE`
entries is cut by the byte of a fourth position, which a pair that reaches the minimum shares as
well; one that is longer still finds links by way of the middle: two fingerprints are linked just
when some value is within two bits of both, so that each entry is filed under the 529 values around
the half it doesn't share, and the work stays linear. A list never emits its pairs, only a forest
that spans its verified links. Equal fingerprints are one entry of the index.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; texts of
fewer than four words hash as one shingle, texts of any length are read whole; repeated rows share a
component; a null id is ignored by component_id unless the component has no other; ids of any type
that can be ordered will do; an empty table gives an empty one; other columns aren't read and may
have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, mixed, on_workers, pieces, schema_of, small_batches, spool

SEED = 42
POSITIONS = 8
DENSE = 1024
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
#: Three positions of one group, or two of a group and one of the next: any four positions hold such a choice.
CHOICES = [c for k, g in enumerate(_GROUPS) for c in (*combinations(g, 3), *((*two, one) for two in combinations(g, 2) for one in _GROUPS[(k + 1) % 3]))]
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: All values of 32 bits with at most two bits set.
NEAR = np.array([0, *(1 << i for i in range(32)), *((1 << i) | (1 << j) for i, j in combinations(range(32), 2))], np.uint32)


def shingle_hashes(text: bytes, words_each: int = 4) -> list[int]:
    """XXH64 of every shingle of a text whose letters A-Z are lowered."""
    words = text.translate(LOWER).split()
    line = b" ".join(words)
    if len(words) <= words_each:
        return [xxhash.xxh64_intdigest(line, SEED)] if words else []
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends[words_each - 1 :], strict=False)]


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose hashes lie one behind the other, `sizes` of them each: bits set in over half of them."""
    out = np.zeros(len(sizes), np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        tally = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[filled], axis=0, dtype=np.int32)
        out[filled] = np.packbits(2 * tally > sizes[filled, None], axis=1).copy().view(">u8").ravel()
    return out


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((x for xs in lists for x in xs), np.uint64, int(sizes.sum())), sizes


def fingerprint_many(texts: list[bytes], words_each: int = 4) -> np.ndarray:
    return majority(*_joined([shingle_hashes(t, words_each) for t in texts]))


def word_prints(texts: list[bytes], prints: int) -> list[np.ndarray]:
    """Independent fingerprints of the different words of each text: what a near copy changes least."""
    digest = xxhash.xxh64_intdigest
    h, sizes = _joined([[digest(w, SEED) for w in set(t.translate(LOWER).split())] for t in texts])
    return [majority(mixed(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)), sizes) for k in range(prints)]


def fingerprints(docs: DataFrame, key: str, text: str, make: Callable[[list[bytes]], list[np.ndarray]], names: list[str]) -> DataFrame:
    """id, row_hash (of the text and all other columns) and the fingerprints, as signed 64-bit numbers."""
    on_workers(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            made = make([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row_hash"), *(pa.array(x.view(np.int64)) for x in made)], names=["id", "row_hash", *names])

    rows = docs.select(F.col(f"`{key}`").alias("id"), row_hash(docs, key, text).alias("row_hash"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema_of(T.StructType([rows.schema["id"]]), "row_hash long, " + ", ".join(f"{n} long" for n in names)))


def row_hash(docs: DataFrame, key: str, text: str) -> Column:
    others = [c for c in docs.columns if c not in (key, text)]
    return F.xxhash64(F.col(f"`{text}`").cast("string"), F.to_json(F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in others])))


# ---------------------------------------------------------------- the index


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the graph with links a-b: every node that isn't the least of its component, and that least one."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[label])
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    below = label != np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes pairs of fingerprints share."""
    x = a ^ b
    for shift in (4, 2, 1):  # the lowest bit of a byte gathers whether any bit of it is set
        x = x | x >> np.uint64(shift)
    return POSITIONS - np.bitwise_count(x & np.uint64(0x0101010101010101))


def retained(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs that pass the count filter, and then the verification on all bits."""
    found = np.flatnonzero(tally(a, b) >= POSITIONS - max_bits)
    return found[np.bitwise_count(a[found] ^ b[found]) <= max_bits]


def _byte(fps: np.ndarray, position: int) -> np.ndarray:
    return fps >> np.uint64(8 * position) & np.uint64(255)


def postings(fps: np.ndarray) -> np.ndarray:
    """(fingerprints, choices): the key of each posting, choice << 24 | the three bytes chosen."""
    out = np.empty((len(fps), len(CHOICES)), np.uint64)
    for c, choice in enumerate(CHOICES):
        value = np.full(len(fps), np.uint64(c))
        for k in choice:
            value = (value << np.uint64(8)) | _byte(fps, k)
        out[:, c] = value
    return out


def links(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray | None = None, max_bits: int = 4, node_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the verified links of all posting lists given.

    Links are those of fingerprints, or of the `nodes` that have them; these too may be asked to
    differ in `node_bits` at most.
    """
    if max_bits > 4:
        raise ValueError("fingerprints that differ in more than four bits need not share four bytes")
    nodes = fps if nodes is None else nodes
    order = np.argsort(keys, kind="stable")
    keys, fps, nodes = keys[order], fps[order], nodes[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    size = np.diff(np.r_[first, len(keys)])
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lo, n in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        x, y = _of_list(fps[lo : lo + n], nodes[lo : lo + n], CHOICES[int(keys[lo] >> np.uint64(24)) % len(CHOICES)], max_bits, node_bits)
        a.append(x)
        b.append(y)
    small = np.repeat(size <= 64, size)
    at = np.flatnonzero(small)
    for gap in range(1, 64):
        at = at[at + gap < len(keys)]
        at = at[keys[at] == keys[at + gap]]
        if not len(at):
            break
        near = at[retained(fps[at], fps[at + gap], max_bits)]
        near = near[np.bitwise_count(nodes[near] ^ nodes[near + gap]) <= node_bits]
        a.append(nodes[near])
        b.append(nodes[near + gap])
    return forest(np.concatenate(a), np.concatenate(b))


def _of_list(own: np.ndarray, nodes: np.ndarray, shared: tuple[int, ...], max_bits: int, node_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the links of a list whose entries share the bytes of some positions."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    if len(own) <= DENSE:
        for lo in range(0, len(own), 128):
            x, y = np.nonzero(np.arange(lo, min(lo + 128, len(own)))[:, None] < np.arange(len(own)))
            x += lo
            near = retained(own[x], own[y], max_bits)
            x, y = nodes[x[near]], nodes[y[near]]
            near = np.bitwise_count(x ^ y) <= node_bits
            a.append(x[near])
            b.append(y[near])
    elif len(shared) < 4:
        for k in (k for k in range(POSITIONS) if k not in shared):
            byte = _byte(own, k)
            order = np.argsort(byte, kind="stable")
            cuts = np.searchsorted(byte[order], np.arange(257))
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    x, y = _of_list(own[order[lo:hi]], nodes[order[lo:hi]], (*shared, k), max_bits, node_bits)
                    a.append(x)
                    b.append(y)
    else:
        below, root = forest(*_by_middle(own, shared, max_bits))
        if node_bits >= 64 and nodes is own:
            return below, root
        at = np.minimum(np.searchsorted(below, own), max(len(below) - 1, 0))
        part = np.where(below[at] == own, root[at], own) if len(below) else own
        order = np.argsort(part, kind="stable")
        cuts = np.r_[np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]), len(own)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            x, y = _reached(own[order[lo:hi]], nodes[order[lo:hi]], max_bits, node_bits)
            a.append(x)
            b.append(y)
    return forest(np.concatenate(a), np.concatenate(b))


def _reached(own: np.ndarray, nodes: np.ndarray, max_bits: int, node_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found by a walk: an entry that is met is held against those not met yet, which are few in a dense group."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    left, waiting = np.arange(len(own)), []
    while len(left):
        if not waiting:
            waiting, left = [int(left[0])], left[1:]
        x = waiting.pop()
        near = (tally(own[left], own[x]) >= POSITIONS - max_bits) & (np.bitwise_count(own[left] ^ own[x]) <= max_bits) & (np.bitwise_count(nodes[left] ^ nodes[x]) <= node_bits)
        if near.any():
            met = left[near]
            a.append(nodes[met])
            b.append(np.full(len(met), nodes[x]))
            waiting += met.tolist()
            left = left[~near]
    return np.concatenate(a), np.concatenate(b)


def _by_middle(fps: np.ndarray, shared: tuple[int, ...], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a long list, whose entries share four bytes: neighbours under a common middle value."""
    if max_bits != 4:
        raise ValueError("the middle is two bits away from both for max_bits = 4 alone")
    rest = np.zeros(len(fps), np.uint32)
    for k in (k for k in range(POSITIONS) if k not in shared):
        rest = (rest << np.uint32(8)) | _byte(fps, k).astype(np.uint32)
    a, b = [], []
    for part in range(16):  # a sixteenth of the middle values at a time
        own, middle = [], []
        for mask in NEAR:
            m = rest ^ mask
            hit = np.flatnonzero(m >> np.uint32(28) == part)
            own.append(hit)
            middle.append(m[hit])
        own, middle = np.concatenate(own), np.concatenate(middle)
        order = np.argsort(middle, kind="stable")
        own, middle = own[order], middle[order]
        same = np.flatnonzero(middle[1:] == middle[:-1])
        x, y = forest(fps[own[same]], fps[own[same + 1]])
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def linked(entries: DataFrame, prints: list[str], node: str, max_bits: int = 4, node_bits: int = 64) -> DataFrame:
    """(a, b): links that span the components of the distinct entries' nodes, by any of their fingerprints `prints`."""
    shards = max(12, entries.count() * len(prints) * len(CHOICES) * 20 // (16 << 20))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n, batch=batch: batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = np.concatenate([postings(column(p)) + np.uint64(k * len(CHOICES) << 24) for k, p in enumerate(prints)], axis=1)
            own = np.repeat(np.stack([column(p) for p in prints], 1), len(CHOICES), axis=1).ravel()
            nodes = np.repeat(column(node), keys.shape[1])
            keys = keys.ravel()
            shard = (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cuts))
            cut = lambda x, order=order, cuts=cuts, full=full: pa.array([x[order[cuts[k] : cuts[k + 1]]].tobytes() for k in full], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), cut(keys.astype(np.uint32)), cut(own), cut(nodes) if [node] != prints else pa.nulls(len(full), pa.binary())], names=["shard", "keys", "fps", "nodes"])

    def verify(_, group):
        read = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in group[c]), kind)
        nodes = None if [node] == prints else read("nodes", np.uint64)
        a, b = links(read("keys", np.uint32).astype(np.uint64), read("fps", np.uint64), nodes, max_bits, node_bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    columns = list(dict.fromkeys([*prints, node]))
    return entries.select(*columns).mapInArrow(index, "shard int, keys binary, fps binary, nodes binary").groupBy("shard").applyInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = 4) -> DataFrame:
    """key, row_hash, fingerprint (16 hex digits), component_id (least key that can be reached), component (of fingerprints)."""
    rows = spool(fingerprints(docs, key, text, lambda texts: [fingerprint_many(texts)], ["fp"]), "fingerprints")
    distinct = spool(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(linked(distinct, ["fp"], "fp", max_bits), "a", "b")
    of = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("component"))
    of = spool(of, "components")
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    table = of.select("fp", "component").join(ids, "component")
    return rows.join(table, "fp").select(F.col("id").alias(key), "row_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", prints: int = 5, max_bits: int = 4, check_words: int = 5, check_bits: int = 12) -> DataFrame:
    """key, row_hash, component: groups of copies that differ more than a single fingerprint of shingles allows.

    A changed word alters all shingles that hold it, but one of the text's different words. Candidates
    come from the index over `prints` independent fingerprints of the different words, each tallied and
    verified at `max_bits`; a candidate stays if the fingerprints of its shingles of five words agree in
    at least 0.8 of their bits. Texts of equal such fingerprints are one node.
    """
    names = [f"p{k}" for k in range(prints)]
    make = lambda texts: [*word_prints(texts, prints), fingerprint_many(texts, check_words)]
    rows = spool(fingerprints(docs, key, text, make, [*names, "fp"]), "fingerprints")
    entries = spool(rows.select(*names, "fp").distinct(), "distinct")
    roots = components(linked(entries, names, "fp", max_bits, check_bits), "a", "b")
    return rows.join(roots, rows.fp == roots.node, "left").select(F.col("id").alias(key), "row_hash", F.coalesce("root", "fp").alias("component"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The documents, one of each group: that of the least key, among rows that share it the first by a hash of all their columns, equal rows once."""
    names = docs.columns
    found = groups(docs, key, text)
    found = spool(found.select(found[key].alias("k"), "row_hash", "component"), "grouped")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "row_hash")).alias("m")).select("m.k", "m.row_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{key}`").alias("k"), row_hash(docs, key, text).alias("row_hash"))
    kept = rows.alias("r").join(best.alias("b"), F.col("r.k").eqNullSafe(F.col("b.k")) & (F.col("r.row_hash") == F.col("b.row_hash")), "left_semi")
    if found.groupBy("k", "row_hash").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["k", "row_hash"])
    return kept.select(*[F.col("row")[c].alias(c) for c in names])


#: The primes of XXH64 (fixed values).
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _xxh64_sql(source: str, seed: int = SEED) -> str:
    """CTEs that add the XXH64 of a column g of the CTE `source`, as `hashed` (g, h). Numbers are 128 bits wide and kept below 2**64."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in PRIMES)
    whole = f"{2**64}::UHUGEINT"
    mul = lambda a, b: f"(({a}) * {b} % {whole})"
    xor = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"
    rotl = lambda a, r: f"(({a}) * {2**r}::UHUGEINT % {whole} + ({a}) // {2 ** (64 - r)}::UHUGEINT)"
    one = lambda a, lane: mul(rotl(f"(({a}) + {mul(lane, p2)}) % {whole}", 31), p1)
    little = lambda at, n: "('0x' || " + " || ".join(f"substring(x, ({at}) * 2 + {2 * k + 1}, 2)" for k in range(n - 1, -1, -1)) + ")::UBIGINT::UHUGEINT"
    starts = (f"{(seed + PRIMES[0] + PRIMES[1]) % 2**64}", f"{(seed + PRIMES[1]) % 2**64}", f"{seed}", f"{(seed - PRIMES[0]) % 2**64}")
    stripes = ", ".join(f"list_reduce(list_transform(range(0, n // 32), lambda k: l[4 * k + {j + 1}]), lambda a, lane: {one('a', 'lane')}, {v}::UHUGEINT) AS v{j}" for j, v in enumerate(starts))
    gathered = f"({' + '.join(rotl(f'v{j}', r) for j, r in enumerate((1, 7, 12, 18)))}) % {whole}"
    for j in range(4):
        gathered = f"({mul(xor(gathered, one('0::UHUGEINT', f'v{j}')), p1)} + {p4}) % {whole}"
    return f"""xa AS (SELECT g, hex(encode(g)) AS x, strlen(g) AS n FROM {source}),
xb AS (SELECT *, list_transform(range(0, n // 8), lambda k: {little("8 * k", 8)}) AS l FROM xa),
xc AS (SELECT *, {stripes} FROM xb),
xd AS (SELECT *, ((CASE WHEN n >= 32 THEN {gathered} ELSE {seed + PRIMES[4]}::UHUGEINT END) + n::UHUGEINT) % {whole} AS h FROM xc),
xe AS (SELECT g, x, n, list_reduce(l[4 * (n // 32) + 1:], lambda a, lane: ({mul(rotl(xor("a", one("0::UHUGEINT", "lane")), 27), p1)} + {p4}) % {whole}, h) AS h FROM xd),
xf AS (SELECT g, x, n, CASE WHEN n % 8 >= 4 THEN ({mul(rotl(xor("h", mul(little("n // 8 * 8", 4), p1)), 23), p2)} + {p3}) % {whole} ELSE h END AS h FROM xe),
xg AS (SELECT g, list_reduce(list_transform(range(n // 4 * 4, n), lambda k: {little("k", 1)}), lambda a, b: {mul(rotl(xor("a", mul("b", p5)), 11), p1)}, h) AS h FROM xf),
xh AS (SELECT g, {mul(xor("h", f"h // {2**33}::UHUGEINT"), p2)} AS h FROM xg),
xi AS (SELECT g, {mul(xor("h", f"h // {2**29}::UHUGEINT"), p3)} AS h FROM xh),
hashed AS (SELECT g, {xor("h", f"h // {2**32}::UHUGEINT")} AS h FROM xi)"""


def oracle(words_each: int = 4, max_bits: int = 4) -> str:
    """DuckDB SQL for `near_duplicates` over the table documents, which compares all pairs of fingerprints."""
    shingles = f"list_transform(range(1, len(w) - {words_each - 2}), lambda i: array_to_string(w[i:i + {words_each - 1}], ' '))"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {words_each} THEN [array_to_string(w, ' ')] ELSE {shingles} END) AS g FROM d
), each AS (
  SELECT r, g, count(*) AS times FROM s GROUP BY r, g
), known AS (
  SELECT DISTINCT g FROM s
), {_xxh64_sql("known")}, bit AS (
  SELECT r, k, sum(CASE WHEN h // b % 2 = 1 THEN times ELSE 0 END) * 2 > sum(times) AS is_set, b
  FROM each JOIN hashed USING (g), (SELECT unnest(range(64)) AS k, unnest([{", ".join(f"{2**k}::UHUGEINT" for k in range(64))}]) AS b) GROUP BY r, k, b
), f AS (
  SELECT doc_id, coalesce(p, 0::UBIGINT) AS fp FROM d LEFT JOIN (SELECT r, bit_or(CASE WHEN is_set THEN b::UBIGINT ELSE 0::UBIGINT END) AS p FROM bit GROUP BY r) USING (r)
), node AS (
  SELECT fp, min(doc_id) AS least FROM f GROUP BY fp
), near AS (
  SELECT a.fp AS a, b.fp AS b FROM node a JOIN node b ON bit_count(xor(a.fp, b.fp)::BIT) <= {max_bits}
), reached AS (
  SELECT fp AS a, fp AS b FROM node UNION SELECT reached.a, near.b FROM reached JOIN near ON reached.b = near.a
), component AS (
  SELECT a AS fp, min(least) AS component_id FROM reached JOIN node ON b = node.fp GROUP BY a
)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN component USING (fp)"""
