"""Language identification by prediction with partial matching (PPM).

One context tree a language, of variable order up to three bytes, is counted on a bounded sample of
labelled texts and then frozen. The code length of a byte is that of PPM with escape method C and
exclusion: a context that has met the byte predicts it by its count, any other one pays its escape
and asks its suffix for the byte among those not yet excluded, down to equal odds for all 256 bytes.
As nothing is updated while scoring, all code lengths are worked out once, into one table over
(context, byte, language); a text costs two look-ups a byte, over the whole text.

Edge cases: a null text, an empty one and one without a letter get language `und` and score 0;
without any labelled text every row does. A text of any length is scored whole. Ties go to the first
language in byte order. Repeated rows get equal results; an empty table gives an empty one. Other
columns are carried along, and one that has the name of the result is replaced by it; rows of the
sample with a null language or text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers, pieces, schema_of, small_batches, text_bytes

ORDER = 3


class Model:
    """Frozen context trees of all languages and their table of code lengths."""

    def __init__(self, samples: dict[str, list[bytes]], max_contexts: int = 16_000):
        self.languages = sorted(samples, key=lambda x: x.encode())
        seen = np.zeros(256, bool)
        for texts in samples.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        self.symbol = np.zeros(256, np.int64)  # 0: a byte that no sample has
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        self.width = int(seen.sum()) + 1
        counts = [self._grams(samples[x]) for x in self.languages]
        self._build(counts, max_contexts)

    def _previous(self, symbols: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The symbols 1 to ORDER places back; 0 before the start of a text. at: place within the text."""
        out = []
        for back in range(1, ORDER + 1):
            p = np.zeros_like(symbols)
            p[back:] = symbols[:-back] if len(symbols) > back else symbols[:0]
            p[at < back] = 0
            out.append(p)
        return out

    def _grams(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order, the (context, symbol) codes met and their counts."""
        texts = [t for t in texts if t]
        if not texts:
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (ORDER + 1)
        s = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        at = np.concatenate([np.arange(len(t)) for t in texts])
        back = self._previous(s, at)
        out, code, scale = [], s, self.width
        for order in range(ORDER + 1):
            if order:
                code = code + back[order - 1] * scale
                scale *= self.width
            out.append(np.unique(code[at >= order], return_counts=True))
        return out

    def _build(self, counts: list[list[tuple[np.ndarray, np.ndarray]]], max_contexts: int) -> None:
        w, n = self.width, len(self.languages)
        least = 2
        while True:  # contexts of too few occurrences are left to their suffixes
            kept = [np.zeros(1, np.int64)]
            for order in range(1, ORDER + 1):
                codes = np.concatenate([c[order][0] // w for c in counts] or [np.zeros(0, np.int64)])
                weights = np.concatenate([c[order][1] for c in counts] or [np.zeros(0, np.int64)])
                contexts, where = np.unique(codes, return_inverse=True)
                kept.append(contexts[np.bincount(where, weights, len(contexts)) >= least] if len(contexts) else contexts)
            if sum(map(len, kept)) <= max_contexts:
                break
            least *= 2
        base = np.cumsum([0] + [len(k) for k in kept])
        total = int(base[-1])
        self.table = np.zeros((total, w, n), np.float32)
        for k, c in enumerate(counts):
            p = np.full((total, w), 1 / 256)
            for order in range(ORDER + 1):
                own = kept[order]
                if not len(own):
                    continue
                codes, times = c[order]
                rows = np.searchsorted(own, codes // w)
                ok = rows < len(own)
                ok[ok] = own[rows[ok]] == (codes // w)[ok]
                met = np.zeros((len(own), w))
                met[rows[ok], codes[ok] % w] = times[ok]
                if order == 0:
                    suffix = np.full((1, w), 1 / 256)
                else:
                    short = own % w ** (order - 1)
                    suffix = p[base[order - 1] + self._at(kept[order - 1], short)]
                total_met, kinds = met.sum(1, keepdims=True), (met > 0).sum(1, keepdims=True)
                rest = np.maximum(1 - (suffix * (met > 0)).sum(1, keepdims=True), 1e-12)
                full = np.where(met > 0, met, kinds * suffix / rest) / np.maximum(total_met + kinds, 1)
                p[base[order] : base[order + 1]] = np.where(total_met > 0, full, suffix)
            self.table[:, :, k] = -np.log2(np.maximum(p, 1e-30))
        self.table = self.table.reshape(total * w, n)
        longest = np.zeros((w,) * ORDER, np.int32)  # [third, second, first byte back] -> longest known context
        for order in range(1, ORDER + 1):
            ids = np.arange(base[order], base[order + 1], dtype=np.int32)
            digits = [kept[order] // w**k % w for k in range(order)]  # nearest byte first
            longest[(*[slice(None)] * (ORDER - order), *digits[::-1])] = ids
        self.longest = longest.reshape(-1)

    @staticmethod
    def _at(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.searchsorted(sorted_codes, codes)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits that every language's tree needs for every text: (texts, languages)."""
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), len(self.languages)))
        if not len(data):
            return out
        s = self.symbol[data]
        at = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
        w, context = self.width, np.zeros(len(data), np.int64)
        for p in self._previous(s, at)[::-1]:
            context = context * w + p
        rows = self.longest[context].astype(np.int64) * w + s
        filled = sizes > 0
        out[filled] = np.add.reduceat(self.table[rows], offsets[:-1][filled], axis=0, dtype=np.float64)
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 300, max_contexts: int = 16_000) -> Model:
    """Counts the trees on about `docs_per_language` different whole texts a language at most, those of the least hash: the bound of the sample.

    The bound on a hash that leaves a third more than are wanted is worked out first, so that a
    language's rows are never brought together, and copies of a text count once.
    """
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text")).where("lang is not null and text is not null")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    share = F.lit(None)
    for k, n in found.items():
        share = F.when(F.col("lang") == k, F.lit(min(1.0, 1.3 * docs_per_language / max(n, 1)))).otherwise(share)
    near = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)) if found else rows
    samples: dict[str, list[bytes]] = {}
    for r in sorted(near.groupBy("lang", "h").agg(F.first("text").alias("text")).collect(), key=lambda r: (r["lang"], r["h"] % (1 << 30), r["h"])):
        own = samples.setdefault(r["lang"], [])
        if len(own) < docs_per_language:
            own.append(r["text"].encode("utf-8", "replace"))
    return Model(samples, max_contexts)


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """docs with a column `out`: lang_pred, score (the language's share of the likelihood) and bits_per_byte (of the best one).

    A column of that name is replaced.
    """
    spark = docs.sparkSession
    on_workers(spark)
    small_batches(spark)
    if not model.languages:
        return docs.withColumn(out, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte")))
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != out]
    whole = F.col(f"`{text}`").cast("string")
    work = docs.select(F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in names]).alias("row"), whole.rlike(r"\p{L}").alias("letters"), whole.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = np.array(m.languages, object)
        for batch in pieces(batches, "text", 1 << 20):
            data, offsets = text_bytes(batch.column("text"))
            bits = m.code_lengths(data, offsets)
            best = bits.argmin(1)
            least = bits[np.arange(len(bits)), best]
            share = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
            letters = batch.column("letters").fill_null(False).to_numpy(zero_copy_only=False)
            rate = least / np.maximum(np.diff(offsets), 1)
            out = [batch.column("row"), pa.array(np.where(letters, known[best], "und"), pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(np.where(letters, rate, 0.0))]
            yield pa.RecordBatch.from_arrays(out, names=["row", "lang_pred", "score", "bits_per_byte"])

    done = work.mapInArrow(run, schema_of(work.select("row").schema, "lang_pred string, score double, bits_per_byte double"))
    return done.select(*[F.col("row")[c].alias(c) for c in names], F.struct("lang_pred", "score", "bits_per_byte").alias(out))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """crc32 of the key's text modulo folds is `fold`."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
