"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is ``quality + not toxic`` of its label row: 0, 1 or 2. The model is the proportional-odds one,
``P(grade <= j) = sigmoid(b_j - w.x)``: one weight vector over hashed text features shared by all grades, and ordered
thresholds ``b_0 < b_1``. It gives the expected grade and the tail probability ``P(grade >= g)``, by which documents are
selected.

Features of a whole text: its words, lower-cased and without marks at their ends, hashed to ``2**bits`` buckets, each
present or not (one of two hundred words counts as much in a long text as in a short one); and a few hashed shape features (share of capitals, digits, marks, repeated words, word
length and text length by classes), so that the text's form counts beside its words.

An L1 penalty, and a least number of training documents for a bucket to get a weight, keep chance words out of the model.

Training rows are a bounded sample: at most ``max_train`` labelled documents, those with the least hashes of their ids, each
with all its features; the model is fitted in one task. Scoring reads whole texts of all documents.

Defined results: a null or empty text has shape features only and is scored by them; null labels are left out; a document
labelled twice counts with its lowest grade; repeated documents score alike; with no labels, or labels of one grade,
every document scores the share of the labels seen (tail probability 1 with none), so nothing is rejected on no evidence;
an empty table gives an empty table. Columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, hash_unit, kept, release, table

GRADES = 3
MARKS = b"""!"#$%&'()*+,-./:;<=>?@[]^_`{|}~"""


@dataclass(frozen=True)
class Settings:
    bits: int = 17
    max_train: int = 12_000
    least_documents: int = 8
    rounds: int = 150
    rate: float = 0.3
    l1: float = 2.5e-4
    seed: int = 7


_WORD_HASH: dict[bytes, int] = kept("quality")


def _word_hash(word: bytes) -> int:
    h = _WORD_HASH.get(word)
    if h is None:
        if len(_WORD_HASH) >= 100_000:
            _WORD_HASH.clear()
        h = _WORD_HASH[word] = xxhash.xxh3_64_intdigest(word)
    return h


def shape(raw: bytes, words: list[bytes]) -> list[str]:
    """Names of the classes that the form of a whole text (in UTF-8) falls into."""
    n = max(1, len(raw))
    codes = np.frombuffer(raw, np.uint8)
    letters = int(np.count_nonzero((codes >= 128) | (codes >= 97) & (codes <= 122) | (codes >= 65) & (codes <= 90)))
    upper = sum(1 for w in words if w.isupper())
    marks = sum(1 for w in words if not w[-1:].isalnum() and w[-1:] < b"\x80")
    total, distinct = max(1, len(words)), len(set(words))
    tenth = lambda x: min(9, int(10 * x))
    return [
        f"upper{tenth(upper / total)}", f"letters{min(20, int(20 * letters / n))}", f"marked{tenth(marks / total)}", f"distinct{tenth(distinct / total)}",
        f"word{min(20, n // total)}", f"length{int(math.log2(n))}", f"digits{min(10, int(20 * sum(1 for w in words if any(48 <= c < 58 for c in w)) / total))}",
    ]


def buckets(text: str | None, bits: int) -> np.ndarray:
    """Distinct buckets of a text's words, then those of its shape."""
    raw = (text or "").encode("utf-8", "replace")
    plain = raw.split()
    words = raw.lower().split()
    got = np.unique(np.array([_word_hash(w) for w in {w.strip(MARKS) for w in words}], np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return np.concatenate([got, np.array([xxhash.xxh3_64_intdigest(s) >> (64 - bits) for s in shape(raw, plain)], np.int64)])


@dataclass
class Model:
    """``weights`` has 2**bits numbers; ``cuts`` are the ordered thresholds. Of fixed size, whatever the corpus."""

    bits: int
    weights: np.ndarray
    cuts: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= j), a column for each j but the last."""
        return 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - score[:, None], -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            out[i] = float(self.weights[buckets(t, self.bits)].sum())
        return out


def cuts_of(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds: a start, then positive steps, whose logarithms are free."""
    return np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def likelihood(weights: np.ndarray, free: np.ndarray, doc: np.ndarray, at: np.ndarray, grades: np.ndarray, balance: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The balanced mean log-likelihood of the grades and its gradients by the weights and by the free numbers of the thresholds.

    Entry k says that document ``doc[k]`` has bucket ``at[k]``.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n = len(grades)
    score = np.bincount(doc, weights[at], n)
    edge = np.concatenate([[-np.inf], cuts_of(free), [np.inf]])
    high, low = edge[grades + 1] - score, edge[grades] - score
    ph, pl = np.where(np.isinf(high), 1.0, sigmoid(high)), np.where(np.isinf(low), 0.0, sigmoid(low))
    p = np.maximum(ph - pl, 1e-12)
    dh, dl = ph * (1 - ph) / p * balance, pl * (1 - pl) / p * balance
    to_cut = np.zeros(GRADES - 1)
    np.add.at(to_cut, np.minimum(grades, GRADES - 2), np.where(grades < GRADES - 1, dh, 0))
    np.add.at(to_cut, np.maximum(grades - 1, 0), np.where(grades > 0, -dl, 0))
    tail = np.cumsum(to_cut[::-1])[::-1] / n
    return float((balance * np.log(p)).sum() / n), np.bincount(at, (dl - dh)[doc], len(weights)) / n, np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])


def fit(rows: list[np.ndarray], grades: np.ndarray, settings: Settings) -> Model:
    """Maximum likelihood by AdaGrad over the whole sample each round, with an L1 step after each."""
    seen = np.bincount(grades, minlength=GRADES) / max(1, len(grades))
    below = np.clip(np.cumsum(seen)[:-1], 1e-6, 1 - 1e-6)
    first, steps = math.log(below[0] / (1 - below[0])), np.diff(np.log(below / (1 - below)))
    if len(grades) == 0:
        first, steps = -30.0, np.full(GRADES - 2, 1e-3)
    free = np.concatenate([[first], np.log(np.maximum(steps, 1e-3))])
    weights = np.zeros(1 << settings.bits)
    if np.count_nonzero(seen) >= 2:
        at, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        often = np.bincount(at, minlength=len(weights)) >= settings.least_documents
        known, own = np.flatnonzero(often), np.zeros(np.count_nonzero(often))  # other buckets keep weight 0
        doc, at = doc[often[at]], np.searchsorted(known, at[often[at]])
        balance = (1 / np.maximum(seen, 1e-9) / np.count_nonzero(seen))[grades] ** 0.5
        g_w, g_f = np.full(len(own), 1e-7), np.full(len(free), 1e-8)
        for _ in range(settings.rounds):
            _, grad, grad_free = likelihood(own, free, doc, at, grades, balance)
            g_w += grad**2
            g_f += grad_free**2
            step = settings.rate / np.sqrt(g_w)
            own += step * grad
            own = np.sign(own) * np.maximum(np.abs(own) - step * settings.l1, 0)
            free += 0.1 * settings.rate * grad_free / np.sqrt(g_f)
        weights[known] = own
    return Model(settings.bits, weights, cuts_of(free))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """at (the buckets), grade: the bounded sample. Only its ids are broadcast."""
    graded = labels.select(F.col(key).alias("_id"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("_grade")).where(f"_id is not null and _grade between 0 and {GRADES - 1}").groupBy("_id").agg(F.min("_grade").alias("_grade"))
    share = F.lit(1.0)
    n = graded.count()
    if n > settings.max_train:
        share = F.lit(1.05 * settings.max_train / n)
    sample = graded.withColumn("_u", hash_unit(F.col("_id"), settings.seed)).where(F.col("_u") <= share).orderBy("_u", "_id").limit(settings.max_train).select("_id", "_grade")
    bits = settings.bits

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0, keep="quality"):
            yield pa.RecordBatch.from_arrays([pa.array([buckets(t, bits).astype("<i4").tobytes() for t in batch.column(0).to_pylist()], pa.binary()), batch.column(1)], ["at", "grade"])

    return docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_grade").mapInArrow(over, "at binary, grade int")


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Model:
    """The model, fitted in one task (the sample is bounded); only its numbers reach the driver."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((g, at) for batch in batches for at, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        model = fit([np.frombuffer(at, "<i4").astype(np.int64) for _, at in rows], np.array([g for g, _ in rows], np.int64), settings)
        del rows
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.cuts.tobytes()], pa.binary())], ["weights", "cuts"])

    got = training_rows(docs, labels, settings, key, text).repartition(1).mapInArrow(over, "weights binary, cuts binary").collect()
    return Model(settings.bits, np.frombuffer(got[0].weights), np.frombuffer(got[0].cuts)) if got else fit([], np.empty(0, np.int64), settings)


def score(docs: DataFrame, model: Model, text: str = "text", expected: str = "expected_grade", tail: str = "tail_probability", at_least: int = GRADES - 1) -> DataFrame:
    """Add the expected grade and ``P(grade >= at_least)``."""
    names = [c for c in docs.columns if c not in (expected, tail)]
    at = names.index(text)
    schema = T.StructType([docs.schema[c] for c in names]).add(expected, T.DoubleType()).add(tail, T.DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast((model.bits, model.weights.astype(np.float32), model.cuts))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, weights, cuts = shared.value
        own = Model(bits, weights, cuts)
        for batch in bounded(batches, at, keep="quality"):
            below = own.at_most(own.score(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(np.round((1 - below).sum(axis=1), 9)), pa.array(np.round(1 - below[:, at_least - 1], 9))], [*names, expected, tail])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(over, schema)


#: A document is kept when the top grade is at least this likely.
KEEP = 0.55


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, expected_grade, tail_probability, keep of every document."""
    got = score(docs.select("doc_id", "text"), train(docs, labels, settings))
    return got.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP).alias("keep"))


def select_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents the classifier rejects go; the columns stay."""
    got = score(docs, train(docs, table(spark, sf_dir, "labels")), expected="_expected", tail="_tail")
    return got.where(F.col("_tail") >= KEEP).drop("_expected", "_tail")
