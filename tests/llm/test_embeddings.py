"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from graphloom.llm import embed_dedup
from graphloom.llm.common import min_labels


def brute(vectors, threshold):
    n = len(vectors)
    links = np.zeros(n, int)
    a, b = [], []
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                x, y = np.array(vectors[i], float), np.array(vectors[j], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[[i, j]] += 1
                    a.append(i)
                    b.append(j)
    return links, min_labels(n, np.array(a, int), np.array(b, int))


def data():
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=16) for _ in range(120)]
    for _ in range(150):
        rows.append(rows[rng.integers(len(rows))] + rng.normal(size=16) * 0.1)
    rows += [rows[0]] * 4 + [rows[1] * 2.5, -rows[2]]
    rows = [r.astype(np.float32).tolist() for r in rows]
    return rows + [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], rows[3][:15]]


def test_against_all_pairs(spark):
    vectors = data()
    ids = list(range(len(vectors)))
    rows = [(i, v, 0) for i, v in zip(ids, vectors)]
    links, lab = brute(vectors, 0.9)
    got = {r["vec_id"]: r for r in embed_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()}
    assert len(got) == len(ids)
    for i in ids:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], lab[i], lab[i] == i)


def test_windows_and_blocks(spark, monkeypatch):
    """Pairs count once, whatever pass or block finds them."""
    vectors = np.random.default_rng(1).normal(size=(700, 8))
    near = np.concatenate([vectors, vectors[:300] + 0.01, vectors[:200] - 0.01])
    links, lab = brute(near.tolist(), 0.97)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(near.tolist())], "vec_id long, embedding array<double>")
    got = embed_dedup.embedding_groups(frame, threshold=0.97, window=200, n_passes=12).toPandas().sort_values("vec_id")
    assert got["n_links"].sum() >= 0.95 * links.sum() and (got["n_links"].to_numpy() <= links).all()
    assert (got["component_id"].to_numpy() == lab).mean() > 0.95


def test_group_far_larger_than_the_window(spark):
    """Every link of a dense group counts, whatever passes its windows leave out."""
    rng = np.random.default_rng(5)
    hot = rng.normal(size=16) + rng.normal(size=(900, 16)) * 0.1
    vectors = np.concatenate([hot, rng.normal(size=(1500, 16))])
    links, lab = brute(vectors.tolist(), 0.9)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = embed_dedup.embedding_groups(frame, window=32).toPandas().sort_values("vec_id")
    assert links[:900].min() > 32 and (got["n_links"].to_numpy() <= links).all()
    assert got["n_links"].sum() >= 0.995 * links.sum()
    assert (got["component_id"].to_numpy() == lab).mean() > 0.99


@pytest.mark.parametrize("mean_cosine", [0.5, 0.7])
def test_vectors_that_share_a_direction(spark, mean_cosine):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1600, 64)) * np.sqrt((1 - mean_cosine) / 64)
    x[:, 0] += np.sqrt(mean_cosine)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(200, 64))
    side -= (side * x[:200]).sum(axis=1, keepdims=True) * x[:200]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    vectors = np.concatenate([x, 0.91 * x[:200] + np.sqrt(1 - 0.91**2) * side])
    close = np.triu(vectors @ vectors.T >= 0.9, 1)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = embed_dedup.embedding_groups(frame, window=16).toPandas()
    assert close.sum() >= 200 and 2 * close.sum() >= got["n_links"].sum() >= 0.98 * 2 * close.sum()


def test_runs_are_the_leading_signs():
    x = embed_dedup.unit(np.random.default_rng(8).normal(size=(500, 24)))
    whole = embed_dedup.hashes(x, 5)
    assert (embed_dedup.runs(x[::3], 5, 9) == (whole >> (embed_dedup.SIGNS - 9))[::3]).all()


def test_very_large_and_very_small_vectors(spark):
    """Squares of these components overflow, or vanish."""
    rows = [[1e200, 1e200], [1e200, 1.001e200], [1e-200, 1e-200], [5e-324, 5e-324], [1e-200, -1e-200], [1.0, 1.0], [1e308, 1e-308], [1.0, 0.0]]
    got = embed_dedup.embedding_groups(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (0, 4), 5: (4, 0), 6: (1, 6), 7: (1, 6)}


def test_copies_of_a_hot_group_count(spark):
    """Repeats of the vectors of a group larger than the window, met in windows, in runs and by chance."""
    rng = np.random.default_rng(9)
    base = np.concatenate([rng.normal(size=12) + rng.normal(size=(300, 12)) * 0.12, rng.normal(size=(500, 12))])
    vectors = np.concatenate([base, base[:200], base[350:400]])
    links, lab = brute(vectors.tolist(), 0.9)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = embed_dedup.embedding_groups(frame, window=24).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() <= links).all() and got["n_links"].sum() >= 0.995 * links.sum()


def test_compare_halo():
    """A block's last rows meet the next block's first ones."""
    import pandas as pd

    n, window = embed_dedup.BLOCK, 50
    rank = np.arange(n - 100, n + window)
    v = np.random.default_rng(2).normal(size=(len(rank), 6))
    v[120] = v[90]
    rows = pd.DataFrame({"node": rank * 10, "copies": 1, "vector": list(v), "ranks": [[r] for r in rank], "rank": rank})
    got = embed_dedup._compare(rows, 0, 0, 0.9999, window)
    assert sorted(zip(got["node"], got["links"])) == [(int(rank[90]) * 10, 1), (int(rank[120]) * 10, 1)]


def test_sketches_of_pairs_at_the_threshold_are_near_enough():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(20_000, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    for threshold in (0.9, 0.97):
        b = threshold * a + np.sqrt(1 - threshold**2) * side
        apart = np.bitwise_count((embed_dedup.sketches(a) ^ embed_dedup.sketches(b)).view(np.uint64)).sum(axis=1)
        assert (apart > embed_dedup.sketch_limit(threshold)).mean() < 1e-3
    far = np.bitwise_count((embed_dedup.sketches(a[1:]) ^ embed_dedup.sketches(a[:-1])).view(np.uint64)).sum(axis=1)
    assert (far <= embed_dedup.sketch_limit(0.9)).mean() < 0.01


@pytest.mark.parametrize("n", [0, 1, 10, 1024, 10_000, 10**6, 10**9])
def test_passes_follow_the_size(n):
    assert 1 <= embed_dedup.passes(n) <= 400
    assert embed_dedup.passes(n) <= embed_dedup.passes(10 * n + 10)


def test_nothing(spark):
    assert embed_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    odd = spark.createDataFrame([(1, None), (None, [1.0]), (3, [1.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, embed_dedup.embedding_groups(odd).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True)], key=str)
