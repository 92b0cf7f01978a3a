"""Toxicity by a chain of linear classifiers over words.

The chain's categories come one after another.  Each has a logistic regression
over the presence of words and over the probabilities of all earlier categories.
In training those probabilities are out of fold: predicted for a row by chains
that were fitted without its fold, so that a later model learns from them what
they are worth on texts that were not seen.

Learning takes a bounded sample: ``TRAIN_DOCS`` documents of those that have a
label, by a hash of their id; of several rows of an id the least text teaches.  Their words are counted by category in Spark, the ``FEATURES`` words
most telling by chi-square are kept, and only the positions of those words in the
sampled documents come to the driver.  Prediction reads whole texts.

Cases.  Null and empty texts have no words: the model's intercepts decide.  A
null label is unknown and left out of that category; of several label rows of a
document the greatest value counts.  A category with one known value predicts
that value's share.  No labelled document: probabilities null, nothing rejected.
Repeated rows get equal results; null doc_id is allowed and has no label.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.texts import give_back, trimmed
from larkspur.plans.staging import stage

#: The sample, the words kept in all, the least documents of a kept word, folds and the penalty.
TRAIN_DOCS, FEATURES, LEAST_DOCS, FOLDS, PENALTY, STEPS = 16_000, 1_500, 4, 3, 0.5, 250
#: Documents with at least this probability of the decisive category are rejected: a toxic text
#: that stays costs more than a clean one that goes, and clean texts score well below.
THRESHOLD = 0.25
_WORD = re.compile(r"[^\W\d_]+")


def categories() -> dict[str, Column]:
    """The chain over the columns of ``labels``, in order; toxic decides."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low, "toxic": toxic, "toxic_low_quality": low & toxic}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Presence:
    """Rows of a sparse 0/1 matrix, each the positions of its ones, beside a few dense columns."""

    def __init__(self, rows: list[np.ndarray], width: int, dense: np.ndarray | None = None):
        self.rows, self.width = rows, width
        self.dense = np.zeros((len(rows), 0)) if dense is None else dense
        self.at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.shape = (len(rows), width + self.dense.shape[1])

    def beside(self, dense: np.ndarray) -> Presence:
        return Presence(self.rows, self.width, dense)

    def where(self, keep: np.ndarray) -> Presence:
        return Presence([self.rows[i] for i in np.flatnonzero(keep)], self.width, self.dense[keep])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=w[self.at], minlength=self.shape[0])[: self.shape[0]] + self.dense @ w[self.width :]

    def back(self, m: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.at, weights=m[self.of], minlength=self.width), m @ self.dense])


def fit_logistic(x: Presence, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Weights, the intercept last, by accelerated gradient descent on the penalised loss."""
    w = np.zeros(x.shape[1] + 1)
    if not len(y):
        return w
    prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(prior / (1 - prior))
    if y.min() == y.max():
        return w
    v = np.ones(x.shape[1])  # the largest curvature, by power iteration
    for _ in range(12):
        v = x.back(x.times(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1 / (0.3 * (float(np.linalg.norm(x.times(v))) ** 2 + len(y)) + penalty)
    at = w.copy()
    for k in range(steps):
        miss = _sigmoid(x.times(at[:-1]) + at[-1]) - y
        new = at.copy()
        new[:-1] -= step * (x.back(miss) + penalty * at[:-1])
        new[-1] -= step * miss.sum()
        at, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class Chain:
    """words; weights[c]: of the words, then of the earlier categories, then the intercept."""

    names: list[str]
    words: list[str]
    weights: list[np.ndarray]

    def probabilities(self, base: np.ndarray) -> np.ndarray:
        """(rows, categories) from the word part of every category's score, intercepts included."""
        out = np.zeros_like(base)
        n = len(self.words)
        for c, w in enumerate(self.weights):
            out[:, c] = _sigmoid(base[:, c] + (out[:, :c] * w[n : n + c]).sum(1))
        return out

    def base(self, rows: list[np.ndarray]) -> np.ndarray:
        """The word part of every category's score for rows of word positions."""
        x = Presence(rows, len(self.words))
        return np.stack([x.times(w[: x.width]) + w[-1] for w in self.weights], 1)


def fit_chain(names: list[str], words: list[str], rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> Chain:
    """rows: positions of each row's words; y: (rows, categories) of 0, 1 or nan; fold: of every row."""
    x, out_of_fold, fitted = Presence(rows, len(words)), np.zeros(y.shape), []
    for c in range(len(names)):  # a category's models use the out-of-fold values of the earlier ones
        both, known = x.beside(out_of_fold[:, :c]), ~np.isnan(y[:, c])
        fitted.append(fit_logistic(both.where(known), y[known, c]))
        for k in range(folds if c + 1 < len(names) else 0):
            others = known & (fold != k)
            w = fit_logistic(both.where(others), y[others, c])
            out_of_fold[fold == k, c] = _sigmoid(both.where(fold == k).times(w[:-1]) + w[-1])
    return Chain(names, words, fitted)


def learn(docs: DataFrame, labels: DataFrame, chain: dict[str, Column] | None = None, train_docs: int = TRAIN_DOCS, features: int = FEATURES) -> Chain | None:
    """A chain from a sample of the labelled rows of ``docs`` (doc_id, text)."""
    chain = chain or categories()
    names = list(chain)
    marks = [F.max(c.cast("int")).alias(n) for n, c in chain.items()]
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*marks).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    known = stage(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "known")  # labels of other documents teach nothing
    total = known.count()
    if not total:
        return None
    drawn = known.where(F.col("h") < min(1.0, 1.3 * train_docs / total) * (1 << 30)).orderBy("h", "doc_id").limit(train_docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    # an id may stand on many rows: one of them teaches; dealt over all cores, so that no task gets the whole sample
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in ("h", *names)])
    sample = stage(one.select("h", "text", *names).repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism)), "labelled")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            found = [sorted(words_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), *batch.columns[1:]], ["words", *batch.schema.names[1:]])

    kinds = ", ".join(f"{n} int" for n in names)
    worded = stage(sample.select("text", "h", *names).mapInArrow(trimmed(distinct_words), f"words array<string>, h long, {kinds}"), "words")
    tallies = [F.count(n).alias(f"n_{n}") for n in names] + [F.sum(n).alias(f"s_{n}") for n in names]
    whole = worded.agg(*tallies).first()
    if not any(whole[f"n_{n}"] for n in names):
        return None
    counts = worded.select(F.explode("words").alias("word"), *names).groupBy("word").agg(F.count(F.lit(1)).alias("docs"), *tallies).where(F.col("docs") >= LEAST_DOCS)
    # chi-square of presence against each category, signed: the words that tell for it come first
    for n in names:
        all_, ones = float(whole[f"n_{n}"] or 0), float(whole[f"s_{n}"] or 0)
        expected = F.col(f"n_{n}") * F.lit(ones / all_ if all_ else 0.0)
        counts = counts.withColumn(f"x_{n}", F.coalesce((F.col(f"s_{n}") - expected) * F.abs(F.col(f"s_{n}") - expected) / F.nullif(expected * F.lit(1 - (ones / all_ if all_ else 0.0)), F.lit(0.0)), F.lit(0.0)))
    each = max(1, features // len(names))
    words = sorted({r[0] for n in names for r in counts.orderBy(F.desc(f"x_{n}"), "word").limit(each).select("word").collect()})
    place = docs.sparkSession.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, i int")
    rows = worded.select(F.monotonically_increasing_id().alias("r"), "h", *names, "words")
    hits = rows.select("r", F.explode("words").alias("word")).join(F.broadcast(place), "word").groupBy("r").agg(F.collect_list("i").alias("at"))
    table = rows.drop("words").join(hits, "r", "left").orderBy("h", "r").toArrow()
    positions = [np.array(at or [], np.int64) for at in table.column("at").to_pylist()]
    y = np.full((table.num_rows, len(names)), np.nan)
    for c, n in enumerate(names):
        y[:, c] = [np.nan if v is None else v for v in table.column(n).to_pylist()]
    return fit_chain(names, words, positions, y, np.asarray(table.column("h").to_numpy()) % FOLDS)


def score(docs: DataFrame, chain: Chain | None, decisive: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with p_<category> for each category and rejected (boolean); columns of
    those names are replaced."""
    names = chain.names if chain else list(categories())
    new = [f"p_{n}" for n in names]
    kept = [c for c in docs.columns if c not in (*new, "rejected")]
    if chain is None:
        return docs.select(*kept, *[F.lit(None).cast("double").alias(n) for n in new], F.lit(False).alias("rejected"))
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain = held.value
        at = {w: i for i, w in enumerate(chain.words)}
        for part in texts:
            out = [np.zeros((0, len(new)))]
            for k in range(0, len(part), 1000):
                rows = [np.array([at[w] for w in words_of(t) & at.keys()], np.int64) for t in part.iloc[k : k + 1000]]
                out.append(chain.probabilities(chain.base([np.sort(r) for r in rows])))
            yield pd.DataFrame(np.concatenate(out), columns=new)
        give_back()

    predict = F.pandas_udf(run, ", ".join(f"{n} double" for n in new))
    scored = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), predict(F.col("text").cast("string")).alias("p"))
    columns = [F.col("row").getField(c).alias(c) for c in kept]
    return scored.select(*columns, "p.*").withColumn("rejected", F.col(f"p_{decisive}") >= threshold)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the chain's probabilities and verdict."""
    return score(docs, learn(docs, labels))
