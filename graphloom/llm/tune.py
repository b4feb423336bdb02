"""Choose the settings of the two classifiers: python -m graphloom.llm.tune FOLDER... [--held-out]

Of the labelled rows, those whose remainder (crc32 of the id modulo 5) is 1, 2 or 3 teach and those whose
remainder is 4 judge; the setting with the least log loss there, over all folders, is the one to take. The
held-out fold (remainder 0) is read with --held-out only, for the setting in use, and chooses nothing.
"""

from __future__ import annotations

import itertools
import sys
from concurrent.futures import ProcessPoolExecutor
from multiprocessing import get_context

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.llm import quality, toxicity
from graphloom.llm.common import table
from graphloom.llm.linear import WordHashes, sigmoid

#: Labelled rows that are read of a folder, at most.
MOST = 20_000
TOXICITY = [toxicity.Setting(n, skip, stems, epochs, alpha, l1) for (n, skip), stems, epochs, alpha, l1 in itertools.product([(2, 1), (3, 2)], [(), (5,), (4, 6)], [3], [0.1, 0.5], [1.0, 3.0, 10.0])]
QUALITY = [quality.Setting(parts, epochs, l1) for parts, epochs, l1 in itertools.product([("words",), ("shapes", "pairs", "repeats"), quality.PARTS], [2], [0.3, 1.0, 3.0])]


def labelled(spark: SparkSession, folder: str, label: str) -> pd.DataFrame:
    """Up to MOST labelled rows (those with the smallest hash of the id): doc_id, text, META, label, fold."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, folder, "labels").where(F.col(label).isNotNull()).select("doc_id", F.col(label).alias("label"), fold.alias("fold"), F.xxhash64("doc_id").alias("place"))
    some = labels.orderBy("place").limit(MOST)
    return table(spark, folder, "documents").select("doc_id", "text", *quality.META).join(F.broadcast(some), "doc_id").toPandas().sort_values("place")


def toxic_scores(teach: pd.DataFrame, ask: pd.DataFrame, setting: toxicity.Setting) -> np.ndarray:
    teach = teach[: toxicity.MAX_TRAIN]
    at, w = toxicity.fit(list(zip(teach["text"].fillna(""), teach["label"])), setting)
    dense, hashes = np.zeros((1 << toxicity.BITS) + 1), WordHashes()
    dense[at] = w
    return sigmoid(np.array([dense[np.unique(toxicity.coordinates(t, hashes, setting))].sum() for t in ask["text"]]) + dense[-1])


def quality_scores(teach: pd.DataFrame, ask: pd.DataFrame, setting: quality.Setting) -> np.ndarray:
    """The combined scores. The pool is the rows that are asked, without their labels, as in use most rows are."""
    teach, pool = teach[: quality.MAX_TRAIN], ask[: quality.MAX_POOL]
    rows = pd.concat([teach, pool])
    metas = list(zip(*(rows[m].astype(object).where(rows[m].notna(), None) for m in quality.META)))
    model = quality.co_train(rows["text"].fillna("").tolist(), metas, [int(y) for y in teach["label"]] + [None] * len(pool), setting=setting)
    shapes, odds = quality.Shapes(), np.zeros((len(ask), 2))
    for i, (t, *meta) in enumerate(zip(ask["text"], *(ask[m].astype(object).where(ask[m].notna(), None) for m in quality.META))):
        for v, (at, x) in enumerate((quality.content(t, shapes, setting.parts), quality.metadata(tuple(meta)))):
            odds[i, v] = model["metadata" if v else "content"][at] @ x
    odds = odds * model["scales"][:, 0] + model["scales"][:, 1]
    return sigmoid(odds @ model["both"][:2] + model["both"][2])


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def area(p: np.ndarray, y: np.ndarray) -> float:
    rank = pd.Series(p).rank().to_numpy()
    ones = int(y.sum())
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / max(1, ones * (len(y) - ones)))


def tried(label: str, setting, folds: list) -> tuple:
    """(mean log loss, the setting, for each folder: log loss, area under the curve, ones found, ones, zeros taken for ones, zeros)."""
    said = []
    for teach, ask in folds:
        p, y = (toxic_scores if label == "toxic" else quality_scores)(teach, ask, setting), ask["label"].to_numpy(float)
        said.append((round(log_loss(p, y), 5), round(area(p, y), 5), int(((p >= 0.5) & (y == 1)).sum()), int(y.sum()), int(((p >= 0.5) & (y == 0)).sum()), int((1 - y).sum())))
    return round(float(np.mean([s[0] for s in said])), 5), setting, *said


def main(folders: list[str], held_out: bool) -> None:
    spark = SparkSession.builder.getOrCreate()
    with ProcessPoolExecutor(6, mp_context=get_context("spawn")) as pool:
        for label, grid, now in (("toxic", TOXICITY, toxicity.SETTING), ("quality", QUALITY, quality.SETTING)):
            data = [labelled(spark, f, label) for f in folders]
            folds = [(d[d["fold"].isin([1, 2, 3, 4])], d[d["fold"] == 0]) if held_out else (d[d["fold"].isin([1, 2, 3])], d[d["fold"] == 4]) for d in data]
            runs = [pool.submit(tried, label, setting, folds) for setting in ([now] if held_out else grid)]
            for result in sorted((r.result() for r in runs), key=lambda r: r[0]):
                print(label, *result, flush=True)


if __name__ == "__main__":
    main([a for a in sys.argv[1:] if not a.startswith("--")], "--held-out" in sys.argv)
