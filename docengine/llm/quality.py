"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document.  Documents with equal votes are counted
together, and expectation-maximisation over these counts (at most 3 to the number of labellers, however large the
corpus) estimates each labeller's accuracy and the posterior of good for every pattern of votes.  Posteriors then
label a bounded sample of documents for a logistic scorer over hashed words and word shapes, which scores all.

Defined cases: a null or empty text has no words, draws no bad vote and is kept, with the scorer's bias as its score;
a null id is carried along; equal rows score alike; an empty table gives no rows and trains nothing; where no labeller
speaks on any document all are kept; further columns are kept by ``keep_good`` and ignored by ``scores``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.words import MEMO, mapped, slices, texts_as_bytes

GOOD, BAD, ABSTAIN = 1, -1, 0

#: Characters that mark up junk, and sentence ends (fixed values).
SYMBOLS = b"#*$%&|<>!~^"
STOPS = (b".", b"?", b"!", b":", b'"', b")")


def _between(value: float, bad: float, good: float, rising: bool) -> int:
    """A vote from two cuts: bad beyond the one, good beyond the other."""
    if rising:
        return BAD if value < bad else GOOD if value >= good else ABSTAIN
    return BAD if value > bad else GOOD if value <= good else ABSTAIN


def _symbols(text: bytes, words: list[bytes]) -> int:
    marks = len(text) - len(text.translate(None, SYMBOLS))
    return _between(marks / len(words), 0.5, 0.05, False)


def _marked_words(text: bytes, words: list[bytes]) -> int:
    return _between(sum(w[-1] in SYMBOLS for w in words) / len(words), 0.4, 0.1, False)


def _capitals(text: bytes, words: list[bytes]) -> int:
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    return _between(upper / len(words), 0.4, 0.08, False)


def _again(words: list[bytes]) -> int:
    return sum(map(bytes.__eq__, words, words[1:]))


def _repeats(text: bytes, words: list[bytes]) -> int:
    return _between(_again(words) / len(words), 0.25, 0.04, False)


def _variety(text: bytes, words: list[bytes]) -> int:
    if len(words) < 20:
        return ABSTAIN
    # of long texts, distinct words grow with the square root
    return _between(len(set(words)) / (len(words) * min(len(words), 400)) ** 0.5, 0.22, 0.4, True)


def _same_lines(text: bytes, words: list[bytes]) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return ABSTAIN if len(lines) < 3 else _between(1 - len(set(lines)) / len(lines), 0.4, 0.1, False)


def _lone_marks(text: bytes, words: list[bytes]) -> int:
    bare = sum(not w.strip(SYMBOLS) for w in words)
    return _between(bare / len(words), 0.2, 0.02, False)


def _word_lengths(text: bytes, words: list[bytes]) -> int:
    mean = sum(map(len, words)) / len(words)
    return BAD if mean > 20 or mean < 2 else GOOD if 3 <= mean <= 10 else ABSTAIN


#: The labellers, each of text and words; none sees a document without words.
LABELLERS = (_symbols, _marked_words, _capitals, _repeats, _variety, _same_lines, _lone_marks, _word_lengths)


def votes(text: bytes, words: list[bytes]) -> list[int]:
    return [f(text, words) for f in LABELLERS] if len(words) > 7 else [ABSTAIN] * len(LABELLERS)


@dataclass
class LabelModel:
    """Labellers vote independently given the class; each has its own rates of voting good, bad or neither.  Where all
    abstain, as on a few words, the prior stands and nothing is learnt."""

    prior: float = 0.85
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0, 3)))  # class, labeller, vote + 1

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        at = np.arange(patterns.shape[1])
        logs = [np.log(self.rates[c][at, patterns + 1]).sum(1) for c in (0, 1)]
        odds = np.log(self.prior / (1 - self.prior)) + logs[1] - logs[0]
        odds = np.where((patterns == ABSTAIN).all(1), np.log(self.prior / (1 - self.prior)), odds)
        return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
        """Starts from labellers that are right in four of five votes, whatever they mark."""
        spoken = (patterns != ABSTAIN).any(1)
        patterns, counts = patterns[spoken], counts[spoken]
        n = patterns.shape[1]
        seen = lambda share: np.array([[(share * (patterns[:, j] == v)).sum() for v in (BAD, ABSTAIN, GOOD)] for j in range(n)]) + 0.5
        self.rates = np.array([[[0.8, 1.0, 0.2]] * n, [[0.2, 1.0, 0.8]] * n]) * seen(counts)
        self.rates /= self.rates.sum(2, keepdims=True)
        for _ in range(rounds if len(counts) else 0):
            good = self.posterior(patterns)
            for c, share in enumerate((counts * (1 - good), counts * good)):
                self.rates[c] = seen(share)
                self.rates[c] /= self.rates[c].sum(1, keepdims=True)
            self.prior = float(np.clip((counts * good).sum() / counts.sum(), 0.01, 0.99))
        return self


def _shape(word: bytes) -> bytes:
    """The word with letters and digits as classes and runs of one class drawn together."""
    out = bytearray()
    for b in word:
        c = 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out)


class Buckets(dict):
    """Word to its two hashed features; a memo that empties itself."""

    def __init__(self, width: int):
        self.width = width

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > MEMO:
            self.clear()
        half = self.width // 2
        self[word] = x = (1 + xxhash.xxh3_64_intdigest(word.lower()) % (half - 1), half + xxhash.xxh3_64_intdigest(_shape(word), 1) % half)
        return x


class Weights(dict):
    """Word to the sum of its features' weights."""

    def __init__(self, weights: np.ndarray):
        self.buckets, self.weights = Buckets(len(weights)), weights.tolist()

    def __missing__(self, word: bytes) -> float:
        if len(self) > MEMO:
            self.clear()
        self.buckets.clear()
        a, b = self.buckets[word]
        self[word] = x = self.weights[a] + self.weights[b]
        return x


#: Words of no weight that count as part of every document, so that a few words decide little.
PADDING = 15

#: The bucket of words that follow themselves.
AGAIN = 0


@dataclass
class Scorer:
    """Logistic regression on a document's hashed features, each as its share of the words."""

    weights: np.ndarray
    bias: float = 0.0

    @staticmethod
    def fit(rows: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, width: int, rounds: int = 150, rate: float = 4.0, decay: float = 1e-5) -> Scorer:
        """Full-batch Adagrad on soft labels."""
        at = np.concatenate(rows)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        x = np.concatenate(shares)
        w, b, seen, seen_b = np.zeros(width), 0.0, np.full(width, 1e-8), 1e-8
        for _ in range(rounds):
            m = np.bincount(of, x * w[at], len(rows)) + b
            e = (1 / (1 + np.exp(-np.clip(m, -35, 35))) - y) / len(y)
            g, gb = np.bincount(at, x * e[of], width) + decay * w, e.sum()
            seen += g**2
            seen_b += gb**2
            w -= rate * g / np.sqrt(seen)
            b -= 0.1 * rate * gb / np.sqrt(seen_b)
        return Scorer(w, float(b))


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer


def _vote_table(docs: DataFrame) -> DataFrame:
    names = [f.__name__.strip("_") for f in LABELLERS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [votes(t, t.split()) for t in texts_as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*rows)], names=names)

    return docs.select("text").mapInArrow(run, ", ".join(f"{n} int" for n in names)).groupBy(*names).count()


def _drawn(docs: DataFrame, n: float, sample: int) -> DataFrame:
    """Texts of ``sample`` documents: of all there are, those of the lowest hashes of id and text, each once.  Where many
    rows are equal there are fewer, but never none."""
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    for share in (min(1.0, 8 * sample / n), 1.0):
        some = hashed.where(F.col("h") < int(share * 2**64 - 2**63)) if share < 1 else hashed
        last = some.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        if last is not None:
            return hashed.where(F.col("h") <= last).groupBy("h").agg(F.first("text").alias("text")).select("text")
    raise ValueError("no documents")


def fit(docs: DataFrame, *, sample: int = 6000, width: int = 1 << 15) -> QualityModel | None:
    """``sample`` bounds the documents that the scorer is trained on; votes are counted over all documents.  It is an error
    if labellers speak, but on none of the sample, as there is nothing to learn from."""
    patterns = np.array([tuple(r) for r in _vote_table(docs).collect()], np.int64)
    if not len(patterns):
        return None
    counts, patterns = patterns[:, -1].astype(float), patterns[:, :-1]
    labels = LabelModel().fit(patterns, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(width)
        for batch in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for text in texts_as_bytes(batch.column(0)):
                words = text.split()
                said = votes(text, words)
                if any(said):
                    at, n = np.unique(np.array([buckets[w] for w in words]).ravel(), return_counts=True)
                    out[0].append(np.append(at, AGAIN))
                    out[1].append(np.append(n, _again(words)) / (len(words) + PADDING))
                    out[2].append(said)
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["at", "share", "votes"])

    rows = _drawn(docs, counts.sum(), sample).mapInArrow(run, "at array<int>, share array<double>, votes array<int>").toArrow()
    if not rows.num_rows:
        if patterns.any():
            raise ValueError("no labeller speaks on any document of the sample; take a larger one")
        return QualityModel(labels, Scorer(np.zeros(width), 1.0))
    y = labels.posterior(np.array(rows["votes"].to_pylist(), np.int64))
    lists = [[x.values.to_numpy() for x in rows[c]] for c in ("at", "share")]
    return QualityModel(labels, Scorer.fit(*lists, y, width))


def _scored(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, float, float]]]]:
    table, bias, again = Weights(model.scorer.weights), model.scorer.bias, float(model.scorer.weights[AGAIN])
    known: dict[tuple[int, ...], float] = {}
    for batch in slices(batches):
        rows = []
        for text in texts_as_bytes(batch.column(batch.schema.get_field_index("text"))):
            words = text.split()
            m = bias + (sum(map(table.__getitem__, words)) + again * _again(words)) / (len(words) + PADDING)
            said = tuple(votes(text, words))
            if said not in known:
                known[said] = float(model.labels.posterior(np.array([said]))[0])
            rows.append((len(words), known[said], 1 / (1 + exp(-min(max(m, -35.0), 35.0)))))
        yield batch, rows


def scores(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """For each document (``doc_id``, ``text``): words, weak posterior, the scorer's probability of good, and whether
    it is kept."""
    schema = "doc_id long, n_words long, weak_posterior double, score double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _scored(batches, model):
            n, p, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(p), pa.array(s), pa.array([not w or x >= 0.5 for w, x in zip(n, s)])], names=["doc_id", "n_words", "weak_posterior", "score", "kept"])

    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The documents that the scorer does not reject, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _scored(batches, model):
            yield batch.filter(pa.array([not n or s >= 0.5 for n, _, s in rows]))

    return docs if model is None else mapped(docs, run)
