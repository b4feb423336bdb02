"""Quality by co-training: a classifier of the text's content and one of the page's metadata teach each other.

The content view sees what is written: words and marks, their shapes in short runs, and repeats. The
metadata view sees only what the table says of the page beside its text: source, language and length, alone
and two by two. Both are FTRL-proximal logistic regressions.

In each round either classifier is fit on the labelled rows and on what the other one was sure of in the
round before (a calibrated score of SURE or more, or of 1 - SURE or less) among a pool of unlabelled rows.
Scores are calibrated (Platt) on labelled rows kept back for that, and at the end a logistic regression
over the two calibrated log-odds, fit on other rows kept back, combines them.

Models are fit in one task on MAX_TRAIN labelled and MAX_POOL unlabelled rows at most, those with the
smallest hash of the id. All rows are scored, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import held_out, table
from graphloom.llm.linear import REMEMBERED, Ftrl, WordHashes, sigmoid
from graphloom.llm.toxicity import sample

MAX_TRAIN, MAX_POOL, ROUNDS, SURE = 6000, 4000, 3, 0.95
CONTENT_BITS, META_BITS = 18, 12
#: Features of the content view, in order: shapes, pairs of shapes, repeats, words and marks.
PARTS = ("shapes", "pairs", "repeats", "words")
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+|\n+")
META = ["source", "lang", "n_chars"]


@dataclass(frozen=True)
class Setting:
    """The content view's features, passes over the rows, and the learners' sparsity; chosen by tune.py, without the held-out fold."""

    parts: tuple[str, ...] = PARTS
    epochs: int = 2
    l1: float = 0.3


SETTING = Setting()


class Shapes(WordHashes):
    """token -> 48 bits for the token, 16 for its shape: a mark itself, or a word's case and length."""

    def __missing__(self, token: bytes) -> int:
        if token[0] in b"0123456789":
            shape = b"0"
        elif token[:1].isalpha() or token[0] >= 0x80:
            case = b"A" if len(token) > 1 and token.isupper() else b"T" if token[:1].isupper() else b"a"
            shape = case + b"+" * min(3, len(token) // 5)
        else:
            shape = token[:3]
        h = xxhash.xxh64_intdigest(token) & (1 << 48) - 1 | (xxhash.xxh64_intdigest(shape) & 0xFFFF) << 48
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = h
        return h


def content(text: str | None, shapes: Shapes, parts: tuple[str, ...] = SETTING.parts) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the content view; a run of shapes weighs by its share of the text."""
    h = shapes.of(TOKEN.findall((text or "").encode()))
    if not len(h):
        return np.array([1 << CONTENT_BITS]), np.array([1.0])
    shape = h >> np.uint64(48)
    pair = shape[:-1] * np.uint64(0x9E3779B1) + shape[1:] * np.uint64(0x85EBCA6B) + np.uint64(1)
    same = (h[1:] == h[:-1]).astype(np.uint64) + np.uint64(7)
    found = dict(zip(PARTS, (shape, pair >> np.uint64(7), same, h * np.uint64(0xC2B2AE3D) >> np.uint64(20))))
    all_ = np.concatenate([found[p] for p in parts]) & np.uint64((1 << CONTENT_BITS) - 1)
    at, n = np.unique(all_.astype(np.int64), return_counts=True)
    return np.append(at, 1 << CONTENT_BITS), np.append(np.sqrt(n / len(h)), 1.0)


def metadata(row: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the metadata view, from META's values in order; nulls are values of their own."""
    source, lang, chars = row
    size = "?" if chars is None or chars != chars else int(math.log(max(0, chars) + 1, 1.5))
    own = [f"s{source}", f"l{lang}", f"c{size}"]
    said = [*own, *(a + b for i, a in enumerate(own) for b in own[i + 1 :])]
    at = np.unique([xxhash.xxh64_intdigest(x.encode()) & (1 << META_BITS) - 1 for x in said])
    return np.append(at, 1 << META_BITS), np.ones(len(at) + 1)


def _fit(rows: list, labels: np.ndarray, bits: int, setting: Setting) -> Ftrl:
    model, order = Ftrl((1 << bits) + 1, l1=setting.l1), np.random.default_rng(11)
    for _ in range(setting.epochs):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i], labels[i])
    return model


def _odds(model: Ftrl, rows: list) -> np.ndarray:
    w = model.weights()
    return np.array([w[at] @ x for at, x in rows])


def platt(odds: np.ndarray, labels: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights (one a column of ``odds``, then an intercept) of a logistic regression, by Newton's method with a small ridge."""
    x = np.column_stack([odds, np.ones(len(labels))])
    ridge = np.eye(x.shape[1]) * 1e-2
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - labels) + ridge @ w)
    return w


def co_train(texts: list, metas: list, labels: list[int | None], rounds: int = ROUNDS, setting: Setting = SETTING) -> dict[str, np.ndarray]:
    """The model: dense weights of both views, their calibrations and the combination. labels: None for the pool."""
    shapes = Shapes()
    views = [([content(t, shapes, setting.parts) for t in texts], CONTENT_BITS), ([metadata(m) for m in metas], META_BITS)]
    known = [i for i, y in enumerate(labels) if y is not None]
    pool = [i for i, y in enumerate(labels) if y is None]
    own = [i for k, i in enumerate(known) if k % 8 not in (3, 7)]
    kept, last = (([i for k, i in enumerate(known) if k % 8 == r] or known) for r in (3, 7))  # to calibrate, to combine
    y_kept, y_last = (np.array([labels[i] for i in rows], float) for rows in (kept, last))
    taught: list[dict[int, int]] = [{}, {}]
    models, scales = [None, None], [None, None]
    for k in range(rounds + 1):
        told: list[dict[int, int]] = [{}, {}]
        for v, (rows, bits) in enumerate(views):
            use = own + list(taught[v])
            models[v] = _fit([rows[i] for i in use], np.array([labels[i] if labels[i] is not None else taught[v][i] for i in use]), bits, setting)
            scales[v] = platt(_odds(models[v], [rows[i] for i in kept])[:, None], y_kept)
            if pool and k < rounds:
                p = sigmoid(_odds(models[v], [rows[i] for i in pool]) * scales[v][0] + scales[v][1])
                told[1 - v] = {i: int(q >= SURE) for i, q in zip(pool, p) if q >= SURE or q <= 1 - SURE}
        taught = told
    both = np.column_stack([_odds(models[v], [views[v][0][i] for i in last]) * scales[v][0] + scales[v][1] for v in (0, 1)])
    return {"content": models[0].weights(), "metadata": models[1].weights(), "scales": np.array(scales), "both": platt(both, y_last)}


def _train_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches) or [pd.DataFrame({"text": [], "label": [], "place": [], **{m: [] for m in META}})]).sort_values(["place", "text"])
    labels = [None if y < 0 else int(y) for y in rows["label"]]
    if not any(y is not None for y in labels):
        return
    metas = list(zip(*(rows[m].astype(object).where(rows[m].notna(), None) for m in META)))
    model = co_train(rows["text"].tolist(), metas, labels)
    for name, w in model.items():
        at = np.flatnonzero(w.ravel())
        yield pd.DataFrame({"part": name, "at": at, "w": w.ravel()[at]})


def _with_meta(docs: DataFrame) -> DataFrame:
    """The columns of the metadata view; those that ``docs`` lacks are null."""
    there = lambda c, kind: (F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)).alias(c)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), there("source", "string"), there("lang", "string"), there("n_chars", "double"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> dict[str, np.ndarray] | None:
    rows = _with_meta(docs)
    known = sample(labels, label_col, MAX_TRAIN)
    free = docs.select("doc_id").where(F.col("doc_id").isNotNull()).join(labels.select("doc_id").distinct(), "doc_id", "left_anti").distinct()
    free = free.select(F.col("doc_id").alias("__id"), F.lit(-1).alias("label"), F.xxhash64("doc_id").alias("place")).orderBy("place", "__id").limit(MAX_POOL)
    # MAX_TRAIN + MAX_POOL rows at most are broadcast; of a repeated id the smallest text is used.
    picked = F.broadcast(known.union(free))
    one = rows.withColumnRenamed("doc_id", "__id").join(picked, "__id").groupBy("__id", "label", "place").agg(F.min(F.struct("text", *META)).alias("r"))
    found = one.select("label", "place", "r.*").repartition(1).mapInPandas(_train_task, "part string, at long, w double").toPandas()
    if not len(found):
        return None
    shapes = {"content": ((1 << CONTENT_BITS) + 1,), "metadata": ((1 << META_BITS) + 1,), "scales": (2, 2), "both": (3,)}
    model = {}
    for name, shape in shapes.items():
        part = found[found["part"] == name]
        flat = np.zeros(int(np.prod(shape)))
        flat[part["at"].to_numpy(np.int64)] = part["w"]
        model[name] = flat.reshape(shape)
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, higher: quality 1 likelier), predicted, content_score, metadata_score.

    Null texts count as empty; missing or null metadata are a value of their own; without labels all
    scores are 0; repeated rows are scored each; an empty table gives no rows; texts are read whole.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in ("score", "content_score", "metadata_score")])

    @F.pandas_udf(kind)
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        m, shapes = shared.value, Shapes()
        for text, *meta in batches:
            if m is None:
                yield pd.DataFrame(np.zeros((len(text), 3)), columns=kind.names)
                continue
            odds = np.zeros((len(text), 2))
            values = zip(*(s.astype(object).where(s.notna(), None) for s in meta))
            for i, (t, row) in enumerate(zip(text, values)):
                for v, (at, x) in enumerate((content(t, shapes), metadata(row))):
                    odds[i, v] = m["metadata" if v else "content"][at] @ x
            odds = odds * m["scales"][:, 0] + m["scales"][:, 1]
            yield pd.DataFrame(np.column_stack([sigmoid(odds @ m["both"][:2] + m["both"][2]), sigmoid(odds)]), columns=kind.names)

    out = _with_meta(docs).withColumn("s", scored("text", *META))
    return out.select("doc_id", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.content_score", "s.metadata_score")


def op9_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "content_score", "metadata_score")
