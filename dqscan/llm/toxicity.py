"""A toxicity classifier with counterfactual regularisation.

Logistic regression over the different words of a text and their beginnings and endings. Sentences
of labelled texts are paired with their counterfactuals: an identity term swapped for others of its
kind where it stands, or, in texts that name no group, terms of one kind put into one slot of a
sentence. The loss penalises the squared change of the logit between the two, so that a neutral
mention of a group can't carry weight, be it of the word or of what it begins and ends with.

The fit runs on the driver, on a bounded sample of labelled rows (`max_rows`), and picks its
settings by cross-validation within them; scoring reads every text whole, and needs no shuffle.

Edge cases: null, empty and wordless texts get the score of the bias alone; a text of any length is
scored whole; null labels and labels without a document are left out of the fit; without labels of
both classes every score is the share of label 1 (0 without labels). Repeated rows get equal
scores; an empty table gives an empty one; other columns are carried along, and one that has the
name of the score is replaced by it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, pieces, schema_of, small_batches

#: Terms that name groups of people; a counterfactual swaps a term for the next one of its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"), ("transgender", "cisgender"), ("black", "white", "asian", "latino"),
    ("immigrants", "citizens", "refugees"), ("disabled", "abled"), ("old", "young"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word itself, and what it begins and ends with."""
    out = ["=" + word]
    for k in (3, 4, 6):
        if len(word) > k:
            out += ["<" + word[:k], ">" + word[-k:]]
    return out


SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def counterfactuals(text: str | None, identity_terms=IDENTITY_TERMS, most: int = 8) -> tuple[list[tuple[set[str], set[str]]], bool]:
    """Pairs of word sets whose scores should be equal, and whether the text names a group itself.

    In a sentence with identity terms one term at a time is swapped, where it stands, for each of
    the others of its row. A text without any lends its first sentence: two terms of a row are put
    into one slot of it, and are compared with each other and with the sentence alone. Row, terms
    and slot follow from a checksum of the sentence; `most` pairs a text are kept.
    """
    row_of = {t: row for row in identity_terms for t in row}
    sentences = [found for x in SENTENCE.split(text or "") if (found := WORD.findall(x.lower()))]
    out = []
    for tokens in sentences:
        for i, t in enumerate(tokens):
            if t in row_of and len(out) < most:
                out += [(set(tokens), {*tokens[:i], other, *tokens[i + 1 :]}) for other in row_of[t] if other != t]
    if out or not sentences:
        return out[:most], bool(out)
    pick = zlib.crc32(" ".join(sentences[0]).encode())
    row = identity_terms[pick % len(identity_terms)]
    first = pick // len(identity_terms) % len(row)
    one, other = row[first], row[(first + 1) % len(row)]
    bag = set(sentences[0])
    return [(bag | {one}, bag | {other}), (bag | {one}, bag), (bag | {other}, bag)], False


class Classifier:
    """Weights of features. `report` holds the settings, the number of pairs and how far scores change between their sides."""

    def __init__(self, weights: dict[str, float], bias: float, report: dict | None = None):
        self.weights, self.bias, self.report = weights, bias, report or {}

    def word_weights(self) -> _Memory:
        return _Memory(self.weights)

    def logit(self, words: set[str], memory: _Memory) -> float:
        # A feature counts once a text, however many of its words have it.
        found: dict[str, float] = {}
        for w in words:
            if got := memory[w]:
                found.update(got)
        return self.bias + sum(found[k] for k in sorted(found))


class _Memory(dict):
    """word -> its features of non-zero weight."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str):
        got = {f: self.weights[f] for f in features_of(word) if f in self.weights} or None
        if len(self) > 400_000:
            self.clear()
        if len(word) < 40:
            self[word] = got
        return got


class _Cells:
    """Labelled texts and their counterfactual pairs as numbers of features."""

    def __init__(self, texts: list[str | None], labels: list[int], identity_terms):
        self.y = np.array(labels, float)
        self.number: dict[str, int] = {}  # of a feature
        self.of_word: dict[str, list[int]] = {}
        self.feats = [self._numbers(words_of(t)) for t in texts]
        self.text, self.plus, self.minus, self.natural = [], [], [], 0  # of the pairs: their text, features of one side alone
        for k, t in enumerate(texts):
            pairs, own = counterfactuals(t, identity_terms)
            self.natural += own
            for one, other in pairs:
                a, b = self._numbers(one), self._numbers(other)
                self.text.append(k)
                self.plus.append(np.setdiff1d(a, b))
                self.minus.append(np.setdiff1d(b, a))
        self.text = np.array(self.text, np.int64)
        self.names = list(self.number)

    def _numbers(self, words: set[str]) -> np.ndarray:
        out = []
        for w in words:
            if w not in self.of_word:
                self.of_word[w] = [self.number.setdefault(f, len(self.number)) for f in features_of(w)]
            out += self.of_word[w]
        return np.unique(np.array(out, np.int64))

    def chosen(self, rows: np.ndarray, min_gain: float, min_docs: int, most: int) -> np.ndarray:
        """Features by the log-likelihood ratio of their presence against the label."""
        y, n = self.y[rows], len(rows)
        at, cols = _cells([self.feats[k] for k in rows])
        n1, count, a = y.sum(), np.bincount(cols, minlength=len(self.names)), np.bincount(cols, y[at], len(self.names))
        gain = np.zeros(len(self.names))
        for x, of_row, of_col in ((a, count, n1), (count - a, count, n - n1), (n1 - a, n - count, n1), ((n - n1) - (count - a), n - count, n - n1)):
            gain += x * np.log(np.maximum(x, 1e-12) / np.maximum(of_row * of_col / n, 1e-12))
        good = np.flatnonzero((count >= min_docs) & (gain >= min_gain)).tolist()
        return np.array(sorted(good, key=lambda i: (-gain[i], self.names[i]))[:most], np.int64)

    def solved(self, rows: np.ndarray, kept: np.ndarray, l2: float, penalty: float, steps: int) -> tuple[np.ndarray, float, float]:
        """Weights of the features kept, bias, and the mean change of the logit over the pairs."""
        y, n, size = self.y[rows], len(rows), len(kept)
        index = np.full(len(self.names), -1)
        index[kept] = np.arange(size)

        def within(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            at, cols = _cells(lists)
            ok = index[cols] >= 0
            return at[ok], index[cols[ok]]

        at, cols = within([self.feats[k] for k in rows])
        pairs = np.flatnonzero(np.isin(self.text, rows))
        plus, minus = within([self.plus[k] for k in pairs]), within([self.minus[k] for k in pairs])
        drow, dcol = np.r_[plus[0], minus[0]], np.r_[plus[1], minus[1]]
        dval = np.r_[np.ones(len(plus[0])), -np.ones(len(minus[0]))]
        inverse = 1 / np.sqrt(np.bincount(cols, minlength=size) / n + 1e-6)  # rare features take larger steps
        # The step is bounded by the largest curvature that a text or a pair can add, which rules out divergence.
        steepest = 0.25 * (1 + np.bincount(at, inverse[cols], n).max(initial=0)) + l2 / n * inverse.max(initial=0)
        if len(dval):
            steepest += 2 * penalty * len(pairs) / n * np.bincount(drow, inverse[dcol], len(pairs)).max()
        rate = 1 / steepest
        n1 = y.sum()
        w, bias, t = np.zeros(size), float(np.log(n1 / (n - n1))), 1.0
        v, vb = w.copy(), bias
        for _ in range(steps):
            z = vb + np.bincount(at, v[cols], n)
            g = (1 / (1 + np.exp(-z)) - y) / n
            grad = np.bincount(cols, g[at], size) + l2 * v / n
            if len(dval):
                change = np.bincount(drow, dval * v[dcol], len(pairs))
                grad += 2 * penalty * np.bincount(dcol, dval * change[drow], size) / n
            new, new_b = v - rate * inverse * grad, vb - rate * g.sum()
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - bias)
            w, bias, t = new, new_b, t2
        change = np.abs(np.bincount(drow, dval * w[dcol], len(pairs))).mean() if len(dval) else 0.0
        return w, float(bias), float(change)

    def loss(self, rows: np.ndarray, kept: np.ndarray, w: np.ndarray, bias: float) -> float:
        index = np.zeros(len(self.names))
        index[kept] = w
        at, cols = _cells([self.feats[k] for k in rows])
        z = bias + np.bincount(at, index[cols], len(rows))
        return float(np.mean(np.logaddexp(0, np.where(self.y[rows] > 0, -z, z))))


def fit(
    texts: list[str | None],
    labels: list[int],
    identity_terms=IDENTITY_TERMS,
    penalty: float = 10.0,
    l2: float | None = None,
    min_gain: float | None = None,
    max_features: int = 4000,
    min_docs: int = 3,
    steps: int = 1500,
    grid: tuple[tuple[float, float], ...] = ((0.02, 3.0), (0.02, 8.0), (0.2, 3.0), (0.2, 8.0), (2.0, 3.0), (2.0, 8.0)),
    folds: int = 3,
) -> Classifier:
    """Full-batch fit by accelerated gradient descent of
    mean log loss + penalty * mean squared change of the logit between the sides of the pairs + l2 * |w|^2 / (2 n).

    Where l2 or min_gain is not given, both are taken from `grid`, (l2, min_gain) each, by the log
    loss of a cross-validation within the texts given, folds dealt by their order.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Classifier({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    cells, every = _Cells(texts, labels, identity_terms), np.arange(len(y))
    if l2 is None or min_gain is None:
        losses = dict.fromkeys(grid, 0.0)
        for fold in range(folds):
            train, test = every[every % folds != fold], every[every % folds == fold]
            if len(test) and 0 < y[train].sum() < len(train):
                of_gain = {gain: cells.chosen(train, gain, min_docs, max_features) for _, gain in grid}
                for x in grid:
                    w, bias, _ = cells.solved(train, of_gain[x[1]], x[0], penalty, steps // 8)
                    losses[x] += cells.loss(test, of_gain[x[1]], w, bias)
        l2, min_gain = min(grid, key=lambda x: (losses[x], x))
    kept = cells.chosen(every, min_gain, min_docs, max_features)
    w, bias, change = cells.solved(every, kept, l2, penalty, steps)
    report = {"rows": len(y), "pairs": len(cells.text), "texts_naming_groups": cells.natural, "l2": l2, "min_gain": min_gain, "features": len(kept), "mean_change": change}
    return Classifier({cells.names[i]: float(x) for i, x in zip(kept.tolist(), w, strict=True) if abs(x) > 1e-4}, bias, report)


def _cells(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)


def mean_change(classifier: Classifier, texts: list[str | None], identity_terms=IDENTITY_TERMS) -> float:
    """Mean absolute change of the logit over the counterfactual pairs of texts."""
    memory = classifier.word_weights()
    found = [abs(classifier.logit(a, memory) - classifier.logit(b, memory)) for t in texts for a, b in counterfactuals(t, identity_terms)[0]]
    return float(np.mean(found)) if found else 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", max_rows: int = 6000) -> tuple[list[str], list[int]]:
    """The texts of at most `max_rows` labelled ids, those of the least hash, with the bound as the only thing broadcast.

    An id that is labelled more than once counts as 1 if any of its labels is; texts are whole.
    """
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    picked = rows.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    got = docs.select(F.col(key).alias("k"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "k").select("text", "y").collect()
    got.sort(key=lambda r: (r["text"] is None, r["text"], r["y"]))
    return [r["text"] for r in got], [r["y"] for r in got]


def score(docs: DataFrame, classifier: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`: 0 to 1, higher where label 1 is likelier. A column of that name is replaced."""
    spark = docs.sparkSession
    on_workers(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(classifier)
    names = [c for c in docs.columns if c != out]
    work = docs.select(F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        memory = c.word_weights()
        for batch in pieces(batches, "text"):
            z = np.array([c.logit(words_of(t), memory) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(1 / (1 + np.exp(-z)))], names=["row", "score"])

    done = work.mapInArrow(run, schema_of(work.select("row").schema, "score double"))
    return done.select(*[F.col("row")[c].alias(c) for c in names], F.col("score").alias(out))
