"""Nearest neighbours by cosine."""

from __future__ import annotations

from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.vectors import cosine
from graphloom.session import durable

#: Vectors in a block of the blocked comparison, and queries that are asked at a time.
BLOCK, MOST_QUERIES = 4096, 4096
#: Rows that are compared with a block at once.
STRIPE = 512
#: Neighbours of a node that are compared at once.
SET = 4096
#: Rows whose lists measure window_top_k(), and how much of them it has to find.
SAMPLE, RECALL = 200, 0.95


def top_k(rows: DataFrame, query: list[float], k: int = 5, vector_col: str = "vector") -> DataFrame:
    """The k rows (id, vector) most similar to one vector, with ``sim`` and ``rank`` from 1; ties by id. k below 1 gives none.

    Vectors that are null, hold nulls or have another length are left out, here and below.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = rows.where((F.size(vector_col) == len(query)) & F.forall(vector_col, lambda x: x.isNotNull()))
    best = rows.withColumn("sim", cosine(F.col(vector_col), q)).orderBy(F.col("sim").desc(), "id").limit(max(0, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("sim").desc(), "id")))  # k rows


def _whole(rows: DataFrame) -> DataFrame:
    """``rows`` whose ``vector`` can be compared (with others of its length, ``dim``): not null, and without nulls in it."""
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())).withColumn("dim", F.size("vector"))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of ``sims``, ties by id."""
    if len(sims) > 4 * k:
        least = np.partition(sims, -k)[-k]
        some = np.flatnonzero(sims >= least)
    else:
        some = np.arange(len(sims))
    return some[np.lexsort((ids[some], -sims[some]))][:k]


def _best_of_rows(mine: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of each row's k largest, ties by id; a row's own id is left out."""
    sims[mine[:, None] == ids[None, :]] = -np.inf
    least = np.partition(sims, max(0, sims.shape[1] - k), axis=1)[:, max(0, sims.shape[1] - k)]
    r, c = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((place[c], -sims[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < k], c[nth < k], sims[r[nth < k], c[nth < k]]


def top_k_batch(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, sim, rank) for a set of queries (query_id, vector) of any size, MOST_QUERIES of which go to every task at a time.

    Each task keeps k rows a query; those are ranked again per query. With more than MOST_QUERIES, a block's
    lists are written to the checkpoint folder before the next block is asked.
    """
    schema = "query_id string, id string, sim double"
    if k < 1:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    blocks, found = batched(_whole(queries.select("query_id", "vector")).toLocalIterator(), MOST_QUERIES), None
    for asked in blocks:
        of = {d: [r for r in asked if r["dim"] == d] for d in {r["dim"] for r in asked}}
        of = {d: ([str(r["query_id"]) for r in own], _unit(pd.Series([r["vector"] for r in own]))) for d, own in of.items()}
        some = _ranked(_whole(rows.select("id", "vector")).mapInPandas(_search(of, k), schema), k)
        if found is not None or len(asked) == MOST_QUERIES:
            some = durable(some)
        found = some if found is None else found.union(some)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    return _ranked(found.drop("rank"), k)  # a name may be in two blocks


def _search(of: dict[int, tuple[list[str], np.ndarray]], k: int):
    """of: names and vectors of the queries by length."""

    def search(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                names, q = of.get(dim, ([], None))
                if not names:
                    continue
                sims, ids = _unit(part["vector"]) @ q.T, part["id"].astype(str).to_numpy()
                for j, name in enumerate(names):
                    at = _best(ids, sims[:, j], k)
                    yield pd.DataFrame({"query_id": name, "id": ids[at], "sim": sims[at, j]})

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def self_top_k(rows: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(id, other, sim, rank): for each row (id, vector) its k most similar others, exactly; ties by id.

    Rows are dealt to blocks by hash. Each pair of blocks is one matrix product in one task, whose k best
    a row are ranked again: n^2 work, spread evenly, and n x blocks rows moved. No cheaper way is exact;
    for tables where that is too much there is window_top_k().
    """
    n = rows.count()
    blocks = max(1, -(-n // block))
    keyed = _whole(rows.select("id", "vector")).select("id", "vector", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    all_ = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = keyed.select(F.col("own").alias("i"), all_.alias("j"), "id", "vector", "dim", F.lit(True).alias("asks"))
    right = keyed.select(all_.alias("i"), F.col("own").alias("j"), "id", "vector", "dim", F.lit(False).alias("asks"))

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[part["asks"]], part[~part["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "sim": []})
        x, y, out = _unit(a["vector"]), _unit(b["vector"]), []
        ids, mine = b["id"].to_numpy(), a["id"].to_numpy()
        for i in range(0, len(x), STRIPE):
            r, c, sims = _best_of_rows(mine[i : i + STRIPE], ids, x[i : i + STRIPE] @ y.T, k)
            out.append(pd.DataFrame({"id": mine[i + r], "other": ids[c], "sim": sims}))
        return pd.concat(out, ignore_index=True)

    found = left.unionByName(right).groupBy("dim", "i", "j").applyInPandas(compare, "id string, other string, sim double")
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def window_top_k(rows: DataFrame, k: int = 5, passes: int = 12, window: int = 512, seed: int = 7, recall: float = RECALL) -> DataFrame:
    """self_top_k() for large tables, approximately: n log n work a pass, n x passes rows moved.

    A pass orders the rows by the signs of 62 random projections and compares each with the ``window`` rows
    before it and after it, whatever task has them. Similar rows agree in most signs, so they meet in some
    pass; a row's k best of all passes are its list. How many passes that takes depends on the table's size
    and its similarities: SAMPLE rows are asked exactly, and from ``passes`` on passes double until their
    lists hold ``recall`` of what they should. Where passes come to move more rows than all pairs in blocks
    would, the lists are those of self_top_k().
    """
    if not 0 < window <= BLOCK:
        raise ValueError(f"window must be from 1 to {BLOCK}")
    rows = durable(_whole(rows.select("id", "vector")))
    sizes = rows.groupBy("dim").count().collect()  # a row a length
    if len(sizes) > 1:
        return reduce(DataFrame.union, (window_top_k(rows.where(F.col("dim") == s["dim"]), k, passes, window, seed, recall) for s in sizes))
    n = sizes[0]["count"] if sizes else 0
    if k < 1 or passes * 4 * window >= n:
        return self_top_k(rows, k)
    some = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE)
    exact = top_k_batch(rows, some.select(F.col("id").alias("query_id"), "vector"), k + 1).where("query_id <> id")
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "id")
    exact = durable(exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("query_id").alias("id"), F.col("id").alias("other")))
    wanted, done, found = recall * exact.count(), 0, None
    while True:
        new = _window_passes(rows, k, range(done, passes), window, seed)
        found = durable(_best_of(new if found is None else found.drop("rank").union(new), k))
        if found.join(exact, ["id", "other"], "left_semi").count() >= wanted:
            return found
        done, passes = passes, 2 * passes
        if passes * 4 * window >= n:
            return self_top_k(rows, k)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    one = found.groupBy("id", "other").agg(F.max("sim").alias("sim"))
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _window_passes(rows: DataFrame, k: int, passes: range, window: int, seed: int) -> DataFrame:
    """(id, other, sim): what the rows show each other in ``passes``."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def orders(vectors: pd.Series) -> pd.Series:
        x = _unit(vectors)
        weights = 1 << np.arange(61, -1, -1, dtype=np.int64)
        found = [((x @ np.random.default_rng([seed, p, x.shape[1]]).standard_normal((x.shape[1], 62))) >= 0) @ weights for p in passes]
        return pd.Series(list(np.stack(found, axis=1)))

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        sims, ids, rank = _unit(part["vector"]), part["id"].to_numpy(), part["rank"].to_numpy()
        own, out = int((rank // BLOCK == key[1]).sum()), []  # the rest belong to the next block
        for i in range(0, own, window):
            j = min(own, i + window)
            hi = min(len(part), j + window)
            s = sims[i:j] @ sims[i:hi].T
            out += _both_ways(ids[i:j], ids[i:hi], np.where(rank[None, i:hi] - rank[i:j, None] <= window, s, -np.inf), k)
        return pd.concat(out, ignore_index=True).drop_duplicates(["id", "other"])

    order = ["pass", "sign", "id"]
    signed = durable(rows.select("id", "vector", F.posexplode(orders("vector")).alias("pass", "sign")))  # the ranges are sampled from it
    dealt = durable(signed.repartitionByRange(*order).sortWithinPartitions(*order).drop("sign").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    parts = dealt.groupBy("pass", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = dealt.join(F.broadcast(offsets), ["pass", "part"]).select("id", "vector", "pass", (F.col("offset") + F.col("at") - F.col("first")).alias("rank"))
    block = F.floor(F.col("rank") / F.lit(BLOCK))
    both = F.when((F.col("rank") % BLOCK < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    return ranked.withColumn("block", F.explode(both)).groupBy("pass", "block").applyInPandas(compare, "id string, other string, sim double")


def _both_ways(a: np.ndarray, b: np.ndarray, sims: np.ndarray, k: int):
    """The k best of b for each of a, and of a for each of b, without a row itself."""
    for left, right, s in ((a, b, sims), (b, a, sims.T)):
        s = np.where(left[:, None] == right[None, :], -np.inf, s)
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        flat = np.repeat(np.arange(len(left)), best.shape[1]), best.ravel()
        ok = np.isfinite(s[flat])
        yield pd.DataFrame({"id": left[flat[0][ok]], "other": right[flat[1][ok]], "sim": s[flat][ok]})


def neighbour_jaccard(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``jac``: how much the neighbour sets of both overlap; 0 if both are empty. near: distinct (id, other).

    Sets are compared as arrays, in as many parts (by hash) as keep the largest set's at about SET each; sizes give
    the union. So what moves are the sets of the pairs, and not a row for each neighbour of each pair.
    """
    sizes = near.groupBy("id").agg(F.count("*").alias("n"))
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()  # either way once
    parts = -(-(sizes.agg(F.max("n")).first()[0] or 1) // SET)
    sets = near.withColumn("__part", F.pmod(F.xxhash64("other"), F.lit(parts))).groupBy("id", "__part").agg(F.collect_set("other").alias("items"))
    a, b = (sets.select(F.col("id").alias(c), "__part", F.col("items").alias(f"__{c}")) for c in ("a", "b"))
    common = both.join(a, "a").join(b, ["b", "__part"]).select("a", "b", F.size(F.array_intersect("__a", "__b")).alias("n"))
    common = common.groupBy("a", "b").agg(F.sum("n").alias("common"))
    common = common.withColumnsRenamed({"a": "__low", "b": "__high"})
    out = pairs.withColumn("__low", F.least("a", "b")).withColumn("__high", F.greatest("a", "b")).join(common, ["__low", "__high"], "left").drop("__low", "__high")
    out = out.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a", "left").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b", "left")
    common, union = F.coalesce("common", F.lit(0)), F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)) - F.coalesce("common", F.lit(0))
    return out.withColumn("jac", F.when(union > 0, common / union).otherwise(F.lit(0.0))).drop("common", "na", "nb")
