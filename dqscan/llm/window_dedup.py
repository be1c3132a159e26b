"""Removal of word windows that repeat anywhere, behind a count-min prefilter.

First pass: every block of documents counts the hashes of its windows in a partial count-min sketch;
the partial sketches are merged on the executors, shard by shard, and one bit an entry (estimated
count of two or more) returns to the block. Counts are only ever overestimated, so that a window
which repeats always passes; of the others about two in a hundred do, at any size of the input.
Second pass: windows estimated repeated are grouped exactly, by a 128-bit BLAKE2b digest of their
words; a block sends each of its digests once, with a mark if it has it more than once, and gets a
bit for each. Third pass: blocks drop the words that repeated windows cover.

A window that fills a third of all rows travels once a block. Nothing is gathered by document.

Edge cases: a null text has no words, as has an empty one; a text shorter than a window keeps all
its words, one of any length is judged whole; ids are carried along, of whatever type, null or
repeated; repeated rows remove each other's windows, as any two copies do; an empty table gives an
empty one; other columns aren't read, unless they are carried along, and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Sketch, asked, counted, known_of, opened, packed, with_answers
from .common import BASE_A, BASE_B, prefix_hash, schema_of, span_hash, spool, text_bytes

BY_SKETCH, BY_DIGEST = 1, 2


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts in a buffer, and the number of words of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.r_[False, inside[:-1]]
    before[inner] = False  # a word doesn't go on into the next text
    begins = inside & ~before
    after = np.r_[inside[1:], False]
    after[inner - 1] = False
    starts, ends = np.flatnonzero(begins), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


class Windows:
    """The windows of all texts of a batch, with a hash each for the sketch; equal windows have equal hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        self.data, self.width = data, width
        self.starts, self.ends, self.words = word_spans(data, offsets)
        self.first_word = np.cumsum(np.r_[0, self.words])
        count = np.maximum(self.words - width + 1, 0)
        text = np.repeat(np.arange(len(self.words)), count)
        self.word = np.arange(len(text)) - np.repeat(np.cumsum(np.r_[0, count[:-1]]), count) + self.first_word[:-1][text]
        raw, cuts = data.tobytes(), offsets.tolist()
        self.spelled = [w for a, b in zip(cuts, cuts[1:], strict=False) for w in raw[a:b].split()]  # bytes.split() knows the same six blanks
        words = span_hash(prefix_hash(data, BASE_A), self.starts, self.ends)
        self.hash = span_hash(prefix_hash(words, BASE_B), self.word, self.word + width)

    def digests(self, which: np.ndarray) -> np.ndarray:
        """(high, low) of the BLAKE2b digests of windows, whose words are joined by one blank: the exact key."""
        line = memoryview(b" ".join(self.spelled))
        to = np.cumsum(self.ends - self.starts + 1) - 1  # ends of words in `line`
        at = self.word[which]
        begin, end = (to[at] - (self.ends - self.starts)[at]).tolist(), to[at + self.width - 1].tolist()
        blake = hashlib.blake2b
        return np.frombuffer(b"".join([blake(line[a:b], digest_size=16).digest() for a, b in zip(begin, end, strict=True)]), ">u8").reshape(-1, 2).astype(np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (high, low) rows in order, which of them are met more than once, and the place of each key among them."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    own = keys[order]
    fresh = np.r_[True, (own[1:] != own[:-1]).any(1)][: len(own)]
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(fresh) - 1
    return own[fresh], np.bincount(where, minlength=int(fresh.sum())) > 1, where


def _parts(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of ordered digests, dealt by ranges of the high half."""
    cuts = [0, *np.searchsorted(keys[:, 0], np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)).tolist(), len(keys)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def _same(pieces: list[bytes]) -> list[bytes]:
    """For each digest of each piece, a bit: whether it is met more than once in all pieces."""
    sizes = [int.from_bytes(p[:8], "little") for p in pieces]
    keys = np.concatenate([np.frombuffer(p, np.uint64, 2 * n, 8).reshape(-1, 2) for p, n in zip(pieces, sizes, strict=True)])
    twice = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, -1, 8 + 16 * n))[:n] for p, n in zip(pieces, sizes, strict=True)])
    _, met, where = _distinct(keys)
    met[where[twice > 0]] = True
    return [np.packbits(x).tobytes() for x in np.split(met[where], np.cumsum(sizes)[:-1])]


def remove_repeats(docs: DataFrame, width: int = 35, key: str = "doc_id", text: str = "text", with_text: bool = True, carry: tuple[str, ...] = (), sketch: Sketch | None = None) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, if with_text kept_text (kept words joined by one blank), and the columns to carry along."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in carry]).alias("extra"), F.col(f"`{text}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    sketch = sketch or Sketch(size // 6)
    blocks = packed(rows, "text", size, "windows")

    def windows(batch: pa.RecordBatch) -> Windows:
        return Windows(*text_bytes(batch.column("text")), width)

    first = spool(counted(blocks, lambda data, _: windows(opened(data)).hash, sketch, BY_SKETCH), "repeated")

    def estimated(w: Windows, known: list | None) -> np.ndarray:
        """Windows estimated repeated."""
        if not len(w.hash):
            return np.zeros(0, np.int64)
        v, _, where = sketch.entries(w.hash)
        return np.flatnonzero(sketch.codes(v, known_of(known, BY_SKETCH))[where])

    def ask(data: bytes, known: list | None) -> Iterator[tuple[int, bytes]]:
        w = windows(opened(data))
        hit = estimated(w, known)
        if len(hit):
            keys, twice, _ = _distinct(w.digests(hit))
            for shard, a, b in _parts(keys, sketch.shards):
                yield shard, (b - a).to_bytes(8, "little") + keys[a:b].tobytes() + np.packbits(twice[a:b]).tobytes()

    second = asked(with_answers(blocks, first), ask, _same, BY_DIGEST)

    def repeated(w: Windows, known: list | None) -> np.ndarray:
        """Windows that do repeat."""
        hit = estimated(w, known)
        if not len(hit):
            return hit
        keys, _, where = _distinct(w.digests(hit))
        met, bits = np.zeros(len(keys), bool), known_of(known, BY_DIGEST)
        for shard, a, b in _parts(keys, sketch.shards):
            met[a:b] = np.unpackbits(np.frombuffer(bits[shard], np.uint8))[: b - a]
        return hit[met[where]]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, known in zip(batch.column("data"), batch.column("known"), strict=True):
                own = opened(data.as_py())
                w = windows(own)
                hit = repeated(w, known.as_py())
                change = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(change, w.word[hit], 1)
                np.add.at(change, w.word[hit] + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                total = np.r_[0, np.cumsum(gone)]
                stay = list(compress(w.spelled, (~gone).tolist()))
                cuts = (w.first_word - total[w.first_word]).tolist()  # among the words that stay
                kept = [b" ".join(stay[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                out = [own.column("id"), own.column("extra"), pa.array(w.words, pa.int64()), pa.array(total[w.first_word[1:]] - total[w.first_word[:-1]], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                names = ["id", "extra", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    out.append(pa.array(kept, pa.binary()).cast(pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(out, names=names)

    made = ["n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    schema = schema_of(T.StructType([rows.schema["id"], rows.schema["extra"]]), "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    done = with_answers(blocks, first, second).mapInArrow(finish, schema)
    return done.select(F.col("id").alias(key), *made, *[F.col("extra")[c].alias(c) for c in carry])


def oracle(width: int = 35) -> str:
    """DuckDB SQL for `remove_repeats` over the table documents, which compares the windows' words themselves."""
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, unnest(range(1, len(w) - {width - 2})) AS i, w FROM d WHERE len(w) >= {width}
), k AS (
  SELECT r, i, array_to_string(w[i:i + {width - 1}], ' ') AS k FROM win
), hit AS (
  SELECT r, i FROM k SEMI JOIN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) USING (k)
), gone AS (
  SELECT DISTINCT r, i + j AS p FROM hit, range({width}) t(j)
), word AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS line FROM word ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
