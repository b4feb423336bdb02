"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A row's features are which word n-grams and skip-grams (two words with others between) occur in its text,
the 1-grams also cut to their first bytes (for languages that inflect), hashed to 2^20 coordinates; how
often and how long the text is don't count, so that a few toxic words weigh the same in any text. FTRL-proximal learns with a rate for each coordinate, and its L1 term
leaves a few thousand weights other than 0, at most 2^20 whatever the corpus: these are broadcast, and
scoring is one pass over the texts without a shuffle.

The model is fit on MAX_TRAIN labelled rows at most (those with the smallest hash of the id), in one task;
all rows are scored. The setting was chosen by tune.py, without the held-out fold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import held_out, table
from graphloom.llm.linear import Ftrl, WordHashes, grams, sigmoid

#: Labelled rows that the model is fit on, at most; coordinates (and one more for the intercept).
MAX_TRAIN, BITS = 8000, 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Setting:
    """n-grams up to n words; words between the two of a skip-gram, at most; bytes that words are cut to; passes; the learner's rate and sparsity."""

    n: int = 2
    skip: int = 1
    stems: tuple[int, ...] = (4, 6)
    epochs: int = 3
    alpha: float = 0.5
    l1: float = 3.0


SETTING = Setting()


def coordinates(text: str | None, hashes: WordHashes, setting: Setting = SETTING) -> np.ndarray:
    """The coordinates of all n-grams and skip-grams of the whole text, repeats included."""
    words = WORD.findall((text or "").encode().lower())
    stems = [hashes.of([w[:k] for w in words]) * np.uint64(2 * k + 1) for k in setting.stems]
    return (np.concatenate([*grams(hashes.of(words), setting.n, setting.skip), *stems]) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def fit(rows: list[tuple[str, int]], setting: Setting = SETTING) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) other than 0; coordinate 2^BITS is the intercept."""
    hashes, model = WordHashes(), Ftrl((1 << BITS) + 1, alpha=setting.alpha, l1=setting.l1)
    seen = [(np.append(np.unique(coordinates(text, hashes, setting)), 1 << BITS), label) for text, label in rows]
    order = np.random.default_rng(7)
    for _ in range(setting.epochs):
        for i in order.permutation(len(seen)):
            model.learn(seen[i][0], 1.0, seen[i][1])
    w = model.weights()
    at = np.flatnonzero(w)
    return at, w[at]


def _fit_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches) or [pd.DataFrame({"text": [], "label": [], "place": []})]).sort_values(["place", "text"])
    if len(rows):
        at, w = fit(list(zip(rows["text"], rows["label"])))
        yield pd.DataFrame({"at": at, "w": w})


def sample(labels: DataFrame, label_col: str, most: int = MAX_TRAIN, id_col: str = "doc_id") -> DataFrame:
    """Up to ``most`` labelled ids outside the held-out fold, the same in each run: (__id, label, place). Ids with several labels take the mean."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    own = own.groupBy(F.col(id_col).alias("__id")).agg(F.avg(label_col).alias("mean"))
    own = own.select("__id", (F.col("mean") >= 0.5).cast("int").alias("label"), F.xxhash64("__id").alias("place"))
    return own.orderBy("place", "__id").limit(most)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) of the model; both empty if no row is labelled."""
    # The sample has MAX_TRAIN rows at most, so it can be broadcast and its texts fit one task.
    picked = F.broadcast(sample(labels, label_col, most))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, "__id")
    one = rows.groupBy("__id", "label", "place").agg(F.min("text").alias("text"))
    found = one.select("text", "label", "place").repartition(1).mapInPandas(_fit_task, "at long, w double").toPandas().sort_values("at")
    return found["at"].to_numpy(np.int64), found["w"].to_numpy(float)


def scorer(spark: SparkSession, at: np.ndarray, w: np.ndarray) -> Callable[[Column], Column]:
    """A column function: the score of a text, 0 if the model is empty."""
    shared = spark.sparkContext.broadcast((at, w))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w = shared.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        hashes = WordHashes()
        for texts in batches:
            sums = np.zeros(len(texts))
            for i, text in enumerate(texts):
                own = coordinates(text, hashes)
                sums[i] = dense[np.unique(own[dense[own] != 0])].sum()
            yield pd.Series(sigmoid(sums + dense[-1]) if len(at) else sums)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: likelier toxic) and predicted (1 if score >= 0.5, else 0).

    Of a repeated id the smallest text teaches its label. Null and empty texts get the score of a text without
    words; without labels all scores are 0; an empty table gives no rows; columns of these names that
    ``docs`` has are replaced, other columns stay; long texts are read whole.
    """
    score = scorer(docs.sparkSession, *train(docs, labels, most=most, id_col=id_col, text_col=text_col))
    out = docs.withColumn("score", score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
