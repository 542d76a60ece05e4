"""Toxicity by non-negative positive-unlabelled learning: a sparse linear classifier in numpy, trained from texts that are
confirmed toxic and from texts of which nothing is known.

With the share ``prior`` of toxic texts, the risk of calling a clean text toxic is what unlabelled texts show of it less what
toxic ones add to it. Where this difference is below zero the model has learned single texts, and a step undoes it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, stored, texts_of, with_arrow

#: Bounds of the confirmed and of the unlabelled texts of the fit, of the features, and the least toxic texts that have one.
FIT_TOXIC, FIT_UNLABELLED, FEATURES, LEAST = 2000, 4000, 1024, 3
#: Letters of a word's beginnings that are features beside the word itself, since insults are inflected and compounded.
BEGINNINGS = range(3, 8)
#: Words that a text's counts are held against are so many more than it has.
SMOOTH = 20
#: SPARSE is the pull of a weight towards zero, for each toxic text of the fit one such part.
STEPS, RATE, SPARSE = 300, 0.05, 0.05
#: Words whose features a task remembers.
REMEMBERED = 200_000
WORDS = re.compile(r"\w+")
SCORE = T.StructType([T.StructField("score", T.DoubleType())])
COUNTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("features", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def features_of(word: str) -> list[int]:
    """Numbers of a word and of its beginnings."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (f"{word} ", *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n))]


def counted(text: str) -> tuple[int, Counter]:
    """Words of a whole text, and how often each feature is in it."""
    words, of = Counter(WORDS.findall(text.lower())), Counter()
    for word, n in words.items():
        for f in features_of(word):
            of[f] += n
    return words.total(), of


def value(count, n_words):
    """A feature's value: the logarithm of its count for 200 words."""
    return np.log1p(200 * np.asarray(count, float) / (np.asarray(n_words) + SMOOTH))


def length(n_words):
    """The value that stands for a text's length."""
    return 0.3 * np.log1p(np.asarray(n_words, float))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(z_toxic: np.ndarray, z_other: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk under the log loss: of toxic texts called clean, and of clean ones called toxic.

    The second is unbiased, not bounded by zero.
    """
    loss = lambda z: float(np.logaddexp(0, z).mean())
    return prior * loss(-z_toxic), loss(z_other) - prior * loss(z_toxic)


def slopes(z_toxic: np.ndarray, z_other: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What each text's logit adds to the step: the slope of both parts, or against that of the second where it is below zero."""
    clean_t, clean_o = -prior * sigmoid(z_toxic) / len(z_toxic), sigmoid(z_other) / len(z_other)
    if risk(z_toxic, z_other, prior)[1] < 0:
        return -clean_t, -clean_o
    return clean_t - prior * sigmoid(-z_toxic) / len(z_toxic), clean_o


@dataclass
class Model:
    """Weights by feature number, of the length, and the bias."""

    weights: dict[int, float] = field(default_factory=dict)
    length: float = 0.0
    bias: float = 0.0
    known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def score(self, text: str) -> float:
        """Probability that a whole text is toxic."""
        words = Counter(WORDS.findall(text.lower()))
        n, of = words.total(), {}
        for word, times in words.items():
            has = self.known.get(word)
            if has is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                has = self.known[word] = tuple(f for f in features_of(word) if f in self.weights)
            for f in has:
                of[f] = of.get(f, 0) + times
        z = self.bias + self.length * float(length(n))
        for f in sorted(of):
            z += self.weights[f] * float(value(of[f], n))
        return float(sigmoid(np.float64(z)))


def fit(toxic: np.ndarray, other: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias from value matrices (the last column is the length): Adam on the non-negative risk, with soft thresholds."""
    w, b = np.zeros(toxic.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    toxic, other = toxic.astype(np.float32), other.astype(np.float32)
    for i in range(STEPS):
        w32 = w.astype(np.float32)
        by_t, by_o = slopes(toxic @ w32 + b, other @ w32 + b, prior)
        slope = np.append(toxic.T @ by_t.astype(np.float32) + other.T @ by_o.astype(np.float32), by_t.sum() + by_o.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        spread = np.sqrt(v / (1 - 0.99 ** (i + 1))) + 1e-6
        rate = RATE * (1 - i / STEPS)
        step = rate * m / (1 - 0.9 ** (i + 1)) / spread
        w, b = w - step[:-1], b - step[-1]
        cut = rate * SPARSE / len(toxic) / spread[:-1]
        cut[-1] = 0
        w = np.sign(w) * np.maximum(0, np.abs(w) - cut)
    return w, b


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model from rows labelled toxic whose crc32(doc_id as text) mod 5 is not 0, and from unlabelled documents of any id.

    Of both those of the smallest id hashes, at most FIT_TOXIC and FIT_UNLABELLED ids; texts count whole, null as empty. The
    prior is the share of toxic rows among those labelled (of these ids), with one more of each. Features are the FEATURES
    that toxic texts have most in excess, of those that LEAST of them have. A document with several labels is toxic if one says so.
    Without toxic texts or features every text scores the prior. Only chosen features reach the driver: at most
    (FIT_TOXIC + FIT_UNLABELLED) * FEATURES counts, for ids that are unique.
    """
    said = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    n, n_toxic = said.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (n_toxic + 1) / (n + 2)
    model = Model(bias=float(np.log(prior / (1 - prior))))
    first = lambda ids, most: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    toxic = first(said.where("y = 1").select("doc_id"), FIT_TOXIC).withColumn("toxic", F.lit(True))
    other = first(docs.select("doc_id").where("doc_id is not null").distinct(), FIT_UNLABELLED).withColumn("toxic", F.lit(False))
    # at most FIT_TOXIC + FIT_UNLABELLED ids
    picked = docs.select("doc_id", "text").join(F.broadcast(toxic.unionByName(other)), "doc_id")

    def make():
        def step(batch: pa.RecordBatch) -> list:
            rows = [counted(x) for x in texts_of(batch, "text")]
            return [[k for k, _ in rows], [list(c) for _, c in rows], [list(c.values()) for _, c in rows]]

        return step

    rows = stored(with_arrow(picked, COUNTS, make, keep=["doc_id", "toxic"]), "toxicity")
    have = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not have.get(True) or not have.get(False):
        return model
    n_of = lambda is_toxic: F.count_if(F.col("toxic") == F.lit(is_toxic))
    by = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(n_of(True).alias("t"), n_of(False).alias("o")).where(F.col("t") >= LEAST)
    excess = F.col("t") * F.log((F.col("t") / have[True]) / (F.greatest(F.col("o"), F.lit(0.5)) / have[False]))
    chosen = [r["feature"] for r in by.withColumn("excess", excess).where("excess > 0").orderBy(F.desc("excess"), "feature").limit(FEATURES).collect()]
    if not chosen:
        return model
    place_of = {f: i for i, f in enumerate(chosen)}

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [[(place_of[f], n) for f, n in zip(fs.as_py(), ns.as_py(), strict=True) if f in place_of] for fs, ns in zip(batch.column("features"), batch.column("counts"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("n_words"), pa.array([[x[0] for x in r] for r in some], pa.list_(pa.int32())), pa.array([[x[1] for x in r] for r in some], pa.list_(pa.int64()))], names=["doc_id", "toxic", "n_words", "at", "n"])

    table = rows.mapInArrow(narrowed, T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("toxic boolean, n_words long, at array<int>, n array<long>")])).orderBy("doc_id", "n_words", "at", "n").collect()
    matrix = {k: np.zeros((have[k], len(chosen) + 1), np.float32) for k in (True, False)}
    place = {True: 0, False: 0}
    for r in table:
        line = matrix[r["toxic"]][place[r["toxic"]]]
        place[r["toxic"]] += 1
        line[-1] = length(r["n_words"])
        line[r["at"]] = value(r["n"], r["n_words"])
    w, b = fit(matrix[True], matrix[False], prior)
    return Model({f: float(x) for f, x in zip(chosen, w, strict=False) if x}, float(w[-1]), float(b))


def toxicity_scores(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``score``, the probability that a whole text is toxic.

    Null and empty texts score by bias alone. Repeated rows get equal scores; a column named ``score`` is replaced; an
    empty table gives an empty result.
    """

    def make():
        own = Model(model.weights, model.length, model.bias)
        return lambda batch: [[own.score(x) for x in texts_of(batch, text)]]

    return with_arrow(docs, SCORE, make, text, keep)


__all__ = ["Model", "fit", "fitted", "risk", "slopes", "toxicity_scores"]
