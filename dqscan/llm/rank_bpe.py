"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

The text is cut into words by the tokenizer's own pattern. A short word is held as one array of
parts and one of the ranks of adjacent parts; the least rank is looked up again and again, its
boundary deleted, and the two neighbouring ranks refreshed. Words beyond `LONG` bytes, where the
repeated scan would be quadratic, take the same merges in the same order from a heap.

Edge cases: a null or empty text has no ids and decodes to the empty text; any length is encoded
whole; repeated rows give repeated results; an empty table gives an empty one. Ids of any
type are carried along; other columns aren't read and may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_workers, pieces, small_batches

#: Bytes of a word from which the heap replaces the scans.
LONG = 400
#: Bytes of the words that are merged many at a time.
WIDE = 48
#: Words that a worker remembers; it starts anew when they are reached.
REMEMBERED = 250_000
#: The pattern of byte-level BPE files that split by regular expression (a fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that the regex module's newer tables call letters or numbers and the tokenizer's pattern doesn't, or the other way round (fixed values).
#: They are all code points p for which the library's splits of "a" p "1" " " p differ from those of WORDS, at tokenizers 0.23 and regex 2026.9; a
#: test holds those in the table and their neighbours against the library.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What the executors need of a tokenizer file: token bytes, merges and special tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.digest = hashlib.sha256(raw).hexdigest()
        data = json.loads(raw)
        model, split = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or data["normalizer"] or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE file without normaliser and prefix blank is needed")
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in model["vocab"].items():
            self.tokens[i] = token.encode() if token in self.special else bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.bytes = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]


class Coder(dict):
    """Maps a word to its ids, packed as little-endian 32-bit integers; `learn` merges the unknown words of a batch."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.of_byte = np.array(vocabulary.bytes, np.int64)
        self.tokens = vocabulary.tokens
        left, right, self.made = vocabulary.merges.T
        keys = (left << 32) | right
        self.never = len(keys)
        order = np.argsort(keys, kind="stable")
        self.keys_sorted, self.rank_sorted = np.r_[keys[order], np.int64(2**62)], np.r_[order, self.never]
        self.rank = {k: i for i, k in reversed(list(enumerate(keys.tolist())))}
        self.made_list = self.made.tolist()
        newer = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in NEWER.split())
        self.common = regex.compile(WORDS).findall
        self.late = re.compile("[^\x00-\u0557]").search  # below are none of the code points in NEWER
        self.newer = regex.compile(f"[{newer}]").search
        letters, numbers = (rf"(?![{newer}])\p{{{x}}}" for x in "LN")
        self.careful = regex.compile(WORDS.replace(r"\p{L}+", f"(?:{letters})+").replace(r"\p{N}+", f"(?:{numbers})+").replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])+")).findall
        self.special = vocabulary.special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.keys_sorted, key)
        return np.where(self.keys_sorted[at] == key, self.rank_sorted[at], self.never)

    def learn(self, words: set[str]) -> None:
        """Merges words of one length at a time: a row of parts and a row of ranks for each word."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode("utf-8")
            if len(b) < 2 or len(b) > WIDE:
                self[w] = self.alone(b)
            else:
                by_length.setdefault(len(b), []).append((w, b))
        for n, group in by_length.items():
            names = np.array([w for w, _ in group], object)
            parts = self.of_byte[np.frombuffer(b"".join(b for _, b in group), np.uint8).reshape(-1, n)]
            ranks = self.ranks(parts[:, :-1], parts[:, 1:])
            while len(names):
                at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(names), np.int64)
                least = ranks[np.arange(len(names)), at] if ranks.shape[1] else np.full(len(names), self.never)
                done = least == self.never
                if done.any():
                    packed, size = parts[done].astype("<u4").tobytes(), 4 * parts.shape[1]
                    for i, w in enumerate(names[done]):
                        self[w] = packed[i * size : (i + 1) * size]
                    names, parts, ranks, at, least = names[~done], parts[~done], ranks[~done], at[~done], least[~done]
                    if not len(names):
                        break
                rows = np.arange(len(names))
                parts[rows, at] = self.made[least]
                keep = np.ones(parts.shape, bool)
                keep[rows, at + 1] = False
                parts = parts[keep].reshape(len(names), -1)
                keep = np.ones(ranks.shape, bool)
                keep[rows, at] = False
                ranks = ranks[keep].reshape(len(names), -1)
                for near, side in ((at > 0, -1), (at < ranks.shape[1], 0)):
                    r, c = rows[near], at[near] + side
                    ranks[r, c] = self.ranks(parts[r, c], parts[r, c + 1])

    def alone(self, word: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        return np.array(self.scanned(ids) if len(ids) < LONG else self.heaped(ids), "<u4").tobytes()

    def scanned(self, ids: list[int]) -> list[int]:
        rank, made, never = self.rank.get, self.made_list, self.never
        ranks = [rank(a << 32 | b, never) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            ids[i] = new = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, never)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], never)
        return ids

    def heaped(self, ids: list[int]) -> list[int]:
        rank, made, never, n = self.rank.get, self.made_list, self.never, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1], never)) < never]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or rank(ids[i] << 32 | ids[j], never) != r:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := rank(ids[i] << 32 | ids[k], never)) < never:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := rank(ids[h] << 32 | ids[i], never)) < never:
                heapq.heappush(heap, (x, h))
        return [i for i in ids if i >= 0]

    def find(self, text: str) -> list[str]:
        return self.careful(text) if not text.isascii() and self.late(text) and self.newer(text) else self.common(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of every text."""
        parts = [[t] if self.cut is None or not any(s in t for s in self.special) else self.cut(t) for t in texts]
        words = [[p if p in self.special else self.find(p) for p in ps] for ps in parts]
        unknown = {w for ws in words for found in ws if found.__class__ is list for w in found} - self.keys()
        if len(self) + len(unknown) > REMEMBERED:
            self.clear()
            unknown = {w for ws in words for found in ws if found.__class__ is list for w in found}
        self.learn(unknown)
        get, one = self.__getitem__, lambda special: np.array([self.special[special]], "<u4").tobytes()
        out = [b"".join([one(f) if f.__class__ is str else b"".join(map(get, f)) for f in ws]) for ws in words]
        for w in unknown:
            if len(w) > WIDE:
                del self[w]
        return out

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def _coder(vocabulary: Vocabulary) -> Coder:
    """The worker's coder of a vocabulary, one at a time, known by the digest of its file."""
    if vocabulary.digest not in _coders:
        _coders.clear()
        _coders[vocabulary.digest] = Coder(vocabulary)
    return _coders[vocabulary.digest]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids (array<int>, if keep_ids), decoded, ids_sha256, decoded_sha256 of every row."""
    spark: SparkSession = docs.sparkSession
    on_workers(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in pieces(batches, "text"):
            packed = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            decoded = [coder.decode(p) for p in packed]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            out = [batch.column("key"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([sha(p) for p in packed], pa.string()), pa.array([sha(d.encode("utf-8", "surrogatepass")) for d in decoded], pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                out += [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
