"""Removal of repeated byte strings with suffix arrays sorted deep-shallow.

Removed is each byte covered by a `width`-byte string that also starts earlier: in a document of
smaller id, or further to the left in the same one.

Suffixes that can share `width` bytes have to meet in one task. Every window of `width` bytes is
filed under an anchor, the 40-byte gram of least hash inside it (the rightmost on ties), so that
equal windows have equal anchors at the same distance; the windows of one anchor are neighbours and
travel as one fragment of text. A sketch of merged anchor counts, in shards that grow with the input
and never underestimating, keeps back the fragments whose anchor occurs once. Each task sends a
fragment it has met many times once; fragments of one key are merged after their bytes are compared.

An anchor that the sketch estimates at `HOT` or more, a boilerplate gram with ever new surroundings,
is split: its windows are counted one by one in a second sketch, and those that may repeat are filed
each under its own `width` bytes, so that no task gets all fragments of a frequent gram.

Where an anchor has several different fragments, their suffixes are sorted: first a multikey
quicksort by 8-byte keys, down to the shallow depth of 24 bytes; what is still tied there has a long
common prefix and is ordered by blind tries, built breadth first: a node keeps nothing but the depth
at which its suffixes first differ, and branches on the byte there. Suffixes that no trie can tell
apart within `width` bytes are equal windows; the first of them stays.

What returns to the blocks of documents are the windows to keep among those that may repeat.

Edge cases: null and empty texts have no bytes; shorter texts than `width` lose none, and one of any
length is judged whole; rows with the same id count as one document, so that what starts at the same
place in both stays in both; a null id sorts before all others; ids must be whole numbers, as their
order decides (TypeError for others); an empty table gives an empty one; other columns aren't read,
unless they are carried along, and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Sketch, counted, known_of, opened, packed, with_answers
from .common import BASE_A, ids_of, mixed, pieces, prefix_hash, schema_of, span_hash, spool, text_bytes

GRAM = 40
SHALLOW = 24
BYTES = np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64))
#: Bytes of fragments that a task holds before it sends them on.
HELD = 16 << 20
#: Estimated occurrences of an anchor from which its windows are filed one by one.
HOT = 1000
BY_ANCHOR, BY_WINDOW, KEPT = 1, 2, 3


# ---------------------------------------------------------------- sorting suffixes


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from every place, as an unsigned number of the same order. data: padded by 8 bytes at least."""
    return sliding_window_view(data, 8)[at].copy().view(">u8").ravel().astype(np.uint64)


def _split(group: np.ndarray, differs: np.ndarray) -> np.ndarray:
    """New group numbers for sorted rows, a new one wherever `differs` from the row before."""
    return np.cumsum(np.r_[False, (group[1:] != group[:-1]) | differs[1:]][: len(group)])


def deep_shallow(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes of each group by their first `depth` bytes.

    Returns their order and, for each place in it, the number of its class of equal suffixes.
    data must be padded by `depth + 8` bytes; `group` numbers buckets that are already in order.
    """
    order = np.argsort(group, kind="stable")
    label = _split(group[order], np.zeros(len(order), bool))
    live = np.arange(len(order))  # places whose suffix is still tied

    def ties(places: np.ndarray) -> np.ndarray:
        g = label[places]
        same = np.r_[False, g[1:] == g[:-1]]
        return places[same | np.r_[same[1:], False]] if len(places) else places

    live = ties(live)
    for d in range(0, min(SHALLOW, depth), 8):  # multikey quicksort: the ties of a key go eight bytes deeper
        if not len(live):
            break
        key = _words(data, starts[order[live]] + d)
        if d + 8 > depth:
            key &= np.uint64((2**64 - 1) << (8 * (d + 8 - depth)) & (2**64 - 1))
        by = np.lexsort((key, label[live]))
        order[live] = order[live][by]
        key = key[by]
        fresh = _split(label[live], np.r_[False, key[1:] != key[:-1]])
        label[live] = _renumbered(label, live, fresh)
        live = ties(live)
    if depth > SHALLOW:
        _tries(data, starts, order, label, live, depth, ties)
    return order, _split(label, np.zeros(len(label), bool))


def _renumbered(label: np.ndarray, live: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Numbers of the parts of split groups: the place of their first member, which no other group has."""
    first = np.r_[0, np.flatnonzero(np.diff(fresh)) + 1]
    return (live[first] + len(label))[fresh]


def _tries(data: np.ndarray, starts: np.ndarray, order: np.ndarray, label: np.ndarray, live: np.ndarray, depth: int, ties) -> None:
    """Blind tries over all tied groups at once, one level of nodes a turn."""
    known = np.full(len(order), SHALLOW, np.int64)  # bytes that the members of a place's node share
    while len(live):
        g = label[live]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[first, len(live)])
        head = np.repeat(live[first], size)
        agree = np.full(len(live), depth, np.int64)  # how many bytes a member shares with the first one of its node
        base, at, other = known[live], starts[order[live]], starts[order[head]]
        open_, d = np.arange(len(live)), 0
        while len(open_):
            x = _words(data, at[open_] + base[open_] + d) ^ _words(data, other[open_] + base[open_] + d)
            found = x != 0
            if found.any():
                lead = 8 - np.searchsorted(BYTES, x[found], "right")
                agree[open_[found]] = np.minimum(base[open_[found]] + d + lead, depth)
            d += 8
            open_ = open_[~found]
            open_ = open_[base[open_] + d < depth]
        node = np.repeat(np.minimum.reduceat(agree, first), size)
        ended = node >= depth  # equal as far as is asked
        live, node = live[~ended], node[~ended]
        if not len(live):
            break
        branch = data[starts[order[live]] + node]
        by = np.lexsort((branch, label[live]))
        order[live] = order[live][by]
        branch = branch[by]
        fresh = _split(label[live], np.r_[False, branch[1:] != branch[:-1]])
        known[live] = node + 1
        label[live] = _renumbered(label, live, fresh)
        live = ties(live)


# ---------------------------------------------------------------- anchors and fragments


class Fragments:
    """The windows of a batch, gathered by anchor: a fragment holds `windows` of them from `start` on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        n, reach = len(data), width - GRAM + 1  # grams of a window
        self.pre = prefix_hash(data, BASE_A)
        count = np.maximum(np.diff(offsets) - width + 1, 0)
        if n < width or not count.any():
            self.start = self.windows = self.anchor = self.text = np.zeros(0, np.int64)
            self.mark = np.zeros(0, np.uint64)
            return
        grams = n - GRAM + 1
        sums, down = self.pre
        hashed = mixed((sums[GRAM:] - sums[:grams]) * down[:grams])
        # The upper half orders grams, the lower one prefers the rightmost.
        value = (hashed & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(grams, dtype=np.uint64))
        blocks = -(-grams // reach)
        padded = np.full(blocks * reach, np.uint64(2**64 - 1))
        padded[:grams] = value
        square = padded.reshape(blocks, reach)
        left = np.minimum.accumulate(square, axis=1).ravel()
        right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - width + 1
        least = np.minimum(right[:windows], left[reach - 1 : reach - 1 + windows])
        anchor = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
        valid = np.zeros(n + 1, np.int64)
        has = count > 0
        valid[offsets[:-1][has]] += 1
        np.add.at(valid, (offsets[:-1] + count)[has], -1)
        inside = np.flatnonzero(np.cumsum(valid[:windows]) > 0)
        anchor = anchor[inside]
        cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)])
        self.start = inside[cut]
        self.windows = np.diff(np.r_[cut, len(inside)])
        self.anchor = anchor[cut]
        self.mark = hashed[self.anchor]
        self.text = np.searchsorted(offsets, self.start, "right") - 1

    def keys(self, which: np.ndarray, width: int) -> np.ndarray:
        end = self.start[which] + self.windows[which] + width - 1
        return span_hash(self.pre, self.start[which], end) ^ mixed((self.anchor[which] - self.start[which]).astype(np.uint64))


def _flat(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one behind the other; a million at a time, as places take eight bytes each."""
    to = np.cumsum(size)
    out = np.empty(int(to[-1]) if len(to) else 0, np.uint8)
    cuts = np.unique(np.r_[0, np.searchsorted(to, np.arange(1 << 20, len(out), 1 << 20)), len(to)])
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo, hi = int(to[a - 1]) if a else 0, int(to[b - 1])
        out[lo:hi] = data[np.arange(lo, hi) + np.repeat(start[a:b] - (to[a:b] - size[a:b]), size[a:b])]
    return out


class Pile:
    """Fragments as columns: key and mark, the document, its place in it, its block and the place in that, windows, bytes before the anchor."""

    names = ("key", "mark", "doc", "place", "block", "at", "windows", "ahead")
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint8, np.uint8)

    def __init__(self, columns: list[np.ndarray], flat: np.ndarray, width: int):
        self.columns, self.flat, self.width = columns, flat, width

    def __getattr__(self, name: str):
        return self.columns[self.names.index(name)]

    @property
    def size(self) -> np.ndarray:
        return self.windows.astype(np.int64) + self.width - 1

    def joined(self, others: list[Pile]) -> Pile:
        every = [self, *others]
        return Pile([np.concatenate(x) for x in zip(*(p.columns for p in every), strict=True)], np.concatenate([p.flat for p in every]), self.width)

    def bytes_of(self, rows: np.ndarray) -> np.ndarray:
        size = self.size
        return _flat(self.flat, (np.cumsum(size) - size)[rows], size[rows])

    def take(self, rows: np.ndarray) -> Pile:
        return Pile([c[rows] for c in self.columns], self.bytes_of(rows), self.width)

    def combined(self) -> Pile:
        """Equal fragments as one row, that of the first place; rows of one document and place all stay."""
        if not len(self.key):
            return self
        order = np.lexsort((self.place, self.doc, self.ahead, self.windows, self.mark, self.key))
        fresh = np.zeros(len(order), bool)
        fresh[0] = True
        for c in (self.key, self.mark, self.windows, self.ahead):
            fresh[1:] |= c[order][1:] != c[order][:-1]
        lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        rest = np.flatnonzero(~fresh)
        if not len(rest):
            return self
        other, first = order[rest], lead[rest]
        size = self.size[other]
        # Keys alone don't decide: a fragment of other bytes than the first one of its key is a row of its own.
        differs = np.add.reduceat(self.bytes_of(other) != self.bytes_of(first), np.cumsum(size) - size) > 0
        fresh[rest] = differs | ((self.doc[other] == self.doc[first]) & (self.place[other] == self.place[first]))
        return self.take(order[fresh])

    def dealt(self, shards: int) -> Iterator[tuple[int, Pile]]:
        """The rows of each shard."""
        shard = (self.mark % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        own, shard = self.take(order), shard[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)]), len(shard)].tolist()
        to = np.r_[0, np.cumsum(own.size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(shard[a]), Pile([c[a:b] for c in own.columns], own.flat[to[a] : to[b]], self.width)

    def packed(self) -> bytes:
        raw = np.int64([len(self.key), len(self.flat)]).tobytes() + b"".join(c.tobytes() for c in self.columns) + self.flat.tobytes()
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def unpacked(cls, blob: bytes, width: int) -> Pile:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        columns, at = [], 16
        for kind in cls.kinds:
            columns.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(columns, np.frombuffer(raw, np.uint8, m, at), width)


def _steps(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for every n, one behind the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def kept_windows(pile: Pile, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, at, bits): windows of a fragment's first occurrence that no earlier window equals."""
    pile = pile.combined()
    windows = pile.windows.astype(np.int64)
    bits = np.where(windows >= 64, np.uint64(2**64 - 1), (np.uint64(1) << (windows % 64).astype(np.uint64)) - np.uint64(1))
    by_mark = np.argsort(pile.mark, kind="stable")
    mark = pile.mark[by_mark]
    same = np.r_[False, mark[1:] == mark[:-1]]
    several = by_mark[same | np.r_[same[1:], False]] if len(mark) else by_mark
    if len(several):
        size = pile.size
        at = (np.cumsum(size) - size)[several]
        n = windows[several]
        rows, step = np.repeat(np.arange(len(several)), n), _steps(n)
        starts = at[rows] + step
        ahead = pile.ahead[several].astype(np.int64)[rows] - step  # from the window's start to its anchor
        bucket = pile.mark[several][rows] * np.uint64(64) + ahead.astype(np.uint64)  # windows of other buckets differ
        bucket = np.unique(bucket, return_inverse=True)[1]
        order, label = deep_shallow(np.r_[pile.flat, np.zeros(width + 16, np.uint8)], starts, bucket, width)
        doc, place = pile.doc[several][rows][order], (pile.place[several][rows] + step)[order]
        rank = np.lexsort((place, doc, label))
        label, doc, place = label[rank], doc[rank], place[rank]
        lead = np.maximum.accumulate(np.where(np.r_[True, label[1:] != label[:-1]], np.arange(len(rank)), 0))
        later = order[rank[(doc != doc[lead]) | (place != place[lead])]]
        np.bitwise_and.at(bits, several[rows[later]], ~(np.uint64(1) << step[later].astype(np.uint64)))
    keep = bits != 0
    return pile.block[keep], pile.at[keep], bits[keep]


ENTRY = np.dtype([("at", np.int64), ("bits", np.uint64)])


class Part:
    """A piece of a block: its bytes from place `base` of the block on, and their fragments."""

    def __init__(self, batch: pa.RecordBatch, base: int, width: int):
        self.batch, self.base, self.width = batch, base, width
        self.data, self.offsets = text_bytes(batch.column("text"))
        self.f = Fragments(self.data, self.offsets, width)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of some fragments, and the hashes of their bytes."""
        n = self.f.windows[which]
        starts = np.repeat(self.f.start[which], n) + _steps(n)
        return starts, span_hash(self.f.pre, starts, starts + self.width) if len(starts) else np.zeros(0, np.uint64)

    def pile(self, block: int, some: np.ndarray, alone: tuple[np.ndarray, np.ndarray]) -> Pile:
        """Fragments `some`, and windows filed under their own bytes."""
        f, ids = self.f, ids_of(self.batch.column("id"))
        starts, own = alone
        text, of = f.text[some], np.searchsorted(self.offsets, starts, "right") - 1
        start = np.r_[f.start[some], starts].astype(np.int64)
        windows = np.r_[f.windows[some], np.ones(len(starts), np.int64)]
        columns = [
            np.r_[f.keys(some, self.width) if len(some) else np.zeros(0, np.uint64), mixed(own)], np.r_[f.mark[some], mixed(own + np.uint64(BASE_A))], ids[np.r_[text, of].astype(np.int64)],
            start - self.offsets[np.r_[text, of].astype(np.int64)], np.full(len(start), block), start + self.base, windows.astype(np.uint8), np.r_[f.anchor[some] - f.start[some], np.zeros(len(starts), np.int64)].astype(np.uint8),
        ]
        return Pile(columns, _flat(self.data, start, windows + self.width - 1), self.width)


def parts_of(data: bytes, width: int) -> list[Part]:
    out, base = [], 0
    for batch in pieces(iter([opened(data)]), "text", 1 << 20):
        out.append(Part(batch, base, width))
        base += len(out[-1].data)
    return out


class Search:
    """What the two sketches say about the windows of a block."""

    def __init__(self, size: int, width: int):
        self.width = width
        self.anchors, self.windows = Sketch(int(size * 2.1 / (width - GRAM))), Sketch(size // 8)

    def marks(self, data: bytes, _) -> np.ndarray:
        return np.concatenate([p.f.mark for p in parts_of(data, self.width)])

    def codes(self, parts: list[Part], known: list | None) -> list[np.ndarray]:
        """For the fragments of each part: 0 single, 1 perhaps repeated, 2 of a hot anchor."""
        marks = np.concatenate([p.f.mark for p in parts])
        if not len(marks):
            return [np.zeros(0, np.uint8)] * len(parts)
        v, _, where = self.anchors.entries(marks)
        return np.split(self.anchors.codes(v, known_of(known, BY_ANCHOR))[where], np.cumsum([len(p.f.mark) for p in parts])[:-1])

    def hot(self, data: bytes, known: list | None) -> np.ndarray:
        """Hashes of all windows of hot anchors."""
        parts = parts_of(data, self.width)
        return np.concatenate([p.windows(np.flatnonzero(c == 2))[1] for p, c in zip(parts, self.codes(parts, known), strict=True)])

    def found(self, parts: list[Part], known: list | None) -> Iterator[tuple[Part, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """For each part: fragments that may repeat, and (starts, hashes) of windows of hot anchors that may."""
        codes = self.codes(parts, known)
        hot = [p.windows(np.flatnonzero(c == 2)) for p, c in zip(parts, codes, strict=True)]
        every = np.concatenate([h for _, h in hot])
        may = np.zeros(0, bool)
        if len(every):
            v, _, where = self.windows.entries(every)
            may = self.windows.codes(v, known_of(known, BY_WINDOW))[where] > 0
        for p, c, (starts, own), m in zip(parts, codes, hot, np.split(may, np.cumsum([len(h) for _, h in hot])[:-1]), strict=True):
            yield p, np.flatnonzero(c == 1), (starts[m], own[m])


def remove_repeats(docs: DataFrame, width: int = 100, key: str = "doc_id", text: str = "text", with_text: bool = True, carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, if with_text kept_text, and the columns to carry along.

    kept_text leaves out the remains of code points that a removed span cuts through.
    """
    if not GRAM < width <= GRAM + 63:
        raise ValueError(f"width must be from {GRAM + 1} to {GRAM + 63}")
    kind = docs.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids must be whole numbers, not {kind.simpleString()}: their order decides which copy stays")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in carry]).alias("extra"), F.col(f"`{text}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = packed(rows, "text", size, "bytes")
    search = Search(size, width)
    anchors = spool(counted(blocks, search.marks, search.anchors, BY_ANCHOR, hot), "anchors")
    windows = spool(counted(with_answers(blocks, anchors), search.hot, search.windows, BY_WINDOW), "windows")
    shards = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (8 << 20))
    packed_type = "block long, kind int, shard int, answer binary"

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send():
            own = [(k, p.packed()) for k, p in held[0].joined(held[1:]).combined().dealt(shards)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int32()), pa.array([p for _, p in own], pa.binary())], names=["shard", "pile"])

        for batch in batches:
            for block, data, known in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("known"), strict=True):
                for part, some, alone in search.found(parts_of(data.as_py(), width), known.as_py()):
                    if len(some) or len(alone[0]):
                        held.append(part.pile(block, some, alone).combined())
                        n += len(held[-1].flat)
                    if n > HELD:
                        yield send()
                        held, n = [], 0
        if n:
            yield send()

    def sort(key, group):
        piles = [Pile.unpacked(b.as_py(), width) for b in group["pile"]]
        block, at, bits = kept_windows(piles[0].joined(piles[1:]), width)
        order = np.lexsort((at, block))
        block = block[order]
        found = np.empty(len(block), ENTRY)
        found["at"], found["bits"] = at[order], bits[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
        n, ends = len(first), np.r_[first, len(block)][1:]
        return pa.table({"block": pa.array(block[first], pa.int64()), "kind": pa.array([KEPT] * n, pa.int32()), "shard": pa.array([key[0].as_py()] * n, pa.int32()), "answer": pa.array([found[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())})

    kept = with_answers(blocks, anchors, windows).mapInArrow(fragments, "shard int, pile binary").groupBy("shard").applyInArrow(sort, packed_type)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, known in zip(batch.column("data"), batch.column("known"), strict=True):
                known = known.as_py()
                stay = np.frombuffer(b"".join(known_of(known, KEPT).values()), ENTRY)
                stay = stay[np.argsort(stay["at"], kind="stable")]
                for part, some, (starts, _) in search.found(parts_of(data.as_py(), width), known):
                    yield _cut(part, some, starts, stay, with_text)

    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text]
    schema = schema_of(T.StructType([rows.schema["id"], rows.schema["extra"]]), "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    done = with_answers(blocks, anchors, windows, kept).mapInArrow(finish, schema)
    return done.select(F.col("id").cast(kind).alias(key), *made, *[F.col("extra")[c].alias(c) for c in carry])


def _looked_up(stay: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits of the windows to keep from each place on."""
    if not len(stay):
        return np.zeros(len(at), np.uint64)
    where = np.minimum(np.searchsorted(stay["at"], at), len(stay) - 1)
    return np.where(stay["at"][where] == at, stay["bits"][where], np.uint64(0))


def _cut(part: Part, some: np.ndarray, alone: np.ndarray, stay: np.ndarray, with_text: bool) -> pa.RecordBatch:
    """The rows of a part without what is repeated."""
    f, data, offsets = part.f, part.data, part.offsets
    bits, n = _looked_up(stay, f.start[some] + part.base), f.windows[some]
    step = _steps(n)
    starts = np.repeat(f.start[some], n) + step
    gone_at = np.r_[starts[(np.repeat(bits, n) >> step.astype(np.uint64)) & np.uint64(1) == 0], alone[_looked_up(stay, alone + part.base) == 0]].astype(np.int64)
    change = np.zeros(len(data) + 1, np.int32)
    change[gone_at] += 1
    np.add.at(change, gone_at + part.width, -1)
    gone = np.cumsum(change[:-1]) > 0
    raw, cuts = memoryview(data.tobytes()), offsets.tolist()
    total = np.r_[0, np.cumsum(gone)]
    removed = total[offsets[1:]] - total[offsets[:-1]]
    spans, sha, kept = [], [], []
    for a, b, n in zip(cuts, cuts[1:], removed.tolist(), strict=False):
        if not n:
            spans.append(0)
            sha.append(hashlib.sha256(raw[a:b]).hexdigest())
            kept.append(str(raw[a:b], "utf-8", "ignore") if with_text else None)
            continue
        g = gone[a:b]
        spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()))
        sha.append(hashlib.sha256(data[a:b][~g].tobytes()).hexdigest())
        kept.append(_whole(bytes(raw[a:b]), g) if with_text else None)
    out = [part.batch.column("id"), part.batch.column("extra"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
    names = ["id", "extra", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        out.append(pa.array(kept, pa.string()))
        names.append("kept_text")
    return pa.RecordBatch.from_arrays(out, names=names)


def _whole(text: bytes, gone: np.ndarray) -> str:
    """What is left of a text, without parts of code points."""
    edges = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
    return "".join(text[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2], strict=True))


def oracle(width: int = 100) -> str:
    """DuckDB SQL for `remove_repeats` over the table documents, which compares the windows' bytes themselves."""
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - {width - 1})) AS s FROM d WHERE len(h) >= {2 * width}
), k AS (
  SELECT r, coalesce(doc_id, -9223372036854775808) AS id, s, substring(h, 2 * s + 1, {2 * width}) AS k FROM w
), later AS (
  SELECT r, s FROM (SELECT *, min({{'id': id, 's': s}}) OVER (PARTITION BY k) AS f FROM k) WHERE {{'id': id, 's': s}} > f
), mark AS (
  SELECT *, s > lag(s, 1, -{2 * width}) OVER (PARTITION BY r ORDER BY s) + {width} AS opens FROM later
), span AS (
  SELECT r, min(s) AS a, max(s) + {width} AS b FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY r ORDER BY s) AS g FROM mark) GROUP BY r, g
), gap AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS start FROM span
), cut AS (
  SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS kept
  FROM gap JOIN d USING (r) GROUP BY r
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)"""
