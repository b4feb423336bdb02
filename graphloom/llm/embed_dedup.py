"""Embedding near-dedup by sorted projection passes.

A pass orders the vectors lexicographically by their concatenated random hashes: the 63 signs of the
pass's random projections, as one number. Similar vectors agree in many leading signs and so stand near
each other. Each vector is compared with those up to WINDOW places after it, by cosine in double
precision, and the verified pairs of all passes are joined.

Equal vectors are one node from the start. Ranks come from a sort by ranges and the counts of its parts.
A pass is cut into blocks of BLOCK ranks, each with the WINDOW next rows, so that every task compares a
block of the same size, however the vectors are spread. A pair counts in the first pass in which its two
rows share their leading signs (a run, see below), which a task works out again from the vectors, for rows
that have a link only: nothing but the vector itself crosses the network for it, and no list of pairs is
made. Pairs that a window holds though they share no run in any pass are few, MISSED of those at the
threshold; these are listed, 2 WINDOW a row and pass at most, and counted once each. What else leaves a
block are sums per vector and a spanning forest of links.

The vectors themselves cross the network late. A first round of passes moves a sketch of each vector (256
signs, 32 bytes) in its place, and keeps the vectors that have, in some window, another whose sketch is as
near as that of a pair at the threshold can be, 4.5 standard deviations allowed. Only those, in most tables
few, go through the passes with their vectors, where pairs are verified.

The number of passes follows the number of vectors: passes() takes as many as give a pair at the
threshold itself MISSED chance at most to share its leading signs in none of them; closer pairs are missed
less. Rows with the same leading signs are a run. Runs within the window are met by it; longer ones (a dense
group, vectors that share a direction) are compared whole as well, block against block, so that the chance
holds however the vectors are spread. Where the long runs of all passes make more pairs than the table has,
all pairs are compared instead, once. In the first round only rows without a near sketch so far ask.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from graphloom.llm.common import durable, min_labels, table
from graphloom.llm.components import connected_components

THRESHOLD, WINDOW, BLOCK, SIGNS, SEED = 0.9, 1024, 4096, 63, 20240229
#: Chance that a pair at the threshold is in no window, by the estimate in passes().
MISSED = 0.005
#: Signs of a sketch; rows that are compared at once.
SKETCH, STRIPE = 256, 512
OUT_SCHEMA = "node long, links long, other long, stray boolean"


def leading(n: int, window: int = WINDOW) -> int:
    """Signs that rows of a run share: even runs of n vectors are half the window at most."""
    return 0 if n <= window else math.ceil(math.log2(n / window) + 1)


def passes(n: int, threshold: float = THRESHOLD, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes for n vectors. A pair at the threshold agrees in a sign with chance 1 - angle / pi, and is
    compared if it agrees in the leading() signs (at least one pass)."""
    chance = (1 - math.acos(threshold) / math.pi) ** leading(n, window)
    return 1 if chance >= 1 - missed else max(1, math.ceil(math.log(missed) / math.log(1 - chance)))


def planes(dim: int, k: int) -> np.ndarray:
    """The projections of pass k."""
    return np.random.default_rng([SEED, dim, k]).standard_normal((dim, SIGNS))


def unit(vectors) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision. The largest component is divided out first, so that no square overflows or vanishes."""
    x = np.stack(list(vectors)).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashes(x: np.ndarray, n_passes: int) -> np.ndarray:
    """For each row of x the hash of each pass: its signs, the first the highest bit."""
    weights = (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
    return np.stack([((x @ planes(x.shape[1], k)) >= 0).astype(np.int64) @ weights for k in range(n_passes)], axis=1)


def runs(x: np.ndarray, n_passes: int, signs: int) -> np.ndarray:
    """For each row of x its run in each pass: the leading ``signs`` signs of hashes()."""
    weights = (1 << np.arange(signs - 1, -1, -1, dtype=np.int64))
    return np.stack([((x @ planes(x.shape[1], k)[:, :signs]) >= 0).astype(np.int64) @ weights for k in range(n_passes)], axis=1)


def sketches(x: np.ndarray) -> np.ndarray:
    """For each row of x SKETCH signs of random projections, as 64-bit words."""
    p = np.random.default_rng([SEED, x.shape[1], 1 << 20]).standard_normal((x.shape[1], SKETCH))
    return np.packbits(x @ p >= 0, axis=1).view(np.int64)


def sketch_limit(threshold: float) -> int:
    """Signs in which the sketches of a pair at the threshold may differ."""
    p = math.acos(threshold) / math.pi
    return math.floor(SKETCH * p + 4.5 * math.sqrt(SKETCH * p * (1 - p)))


def _hash_udf(n_passes: int):
    """The hashes of all passes, then the words of the sketch."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def udf(vectors: pd.Series) -> pd.Series:
        out = np.empty(len(vectors), object)
        sizes = vectors.map(len)
        for dim in sizes.unique():
            at = np.flatnonzero(sizes.to_numpy() == dim)
            x = unit(vectors.iloc[at])
            found = np.concatenate([hashes(x, n_passes), sketches(x)], axis=1)
            for i, row in zip(at, found):
                out[i] = row
        return pd.Series(out)

    return udf


def _ranked(hashed: DataFrame) -> DataFrame:
    """``hashed`` (dim, pass, h, node, ...) without h, with ``rank``, from 0, within the pass (of vectors of one length).

    Rows are dealt to tasks by ranges of the order itself, which are even however many rows begin alike;
    the counts of the tasks' parts give offsets.
    """
    order = ["dim", "pass", "h", "node"]
    rows = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = durable(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop("h"))
    parts = rows.groupBy("dim", "pass", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("dim", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    found = rows.join(offsets, ["dim", "pass", "part"])
    return found.withColumn("rank", F.col("offset") + F.col("at") - F.col("first")).drop("at", "part", "first", "offset")


def _in_blocks(ranked: DataFrame, window: int) -> DataFrame:
    """Rows by (dim, pass, block): a block's own BLOCK ranks, and the first ``window`` of the next block."""
    block = F.floor(F.col("rank") / F.lit(BLOCK))
    both = F.when((F.col("rank") % BLOCK < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    return ranked.withColumn("block", F.explode(both))


def _run(signs: int):
    """The run of a row: its leading ``signs`` signs."""
    return F.shiftright("h", SIGNS - signs).alias("run")


def _long_runs(rows: DataFrame, window: int) -> DataFrame:
    """(dim, pass, run, first, n): runs that the window doesn't cover, with their first rank and their rows."""
    runs = rows.groupBy("dim", "pass", "run").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    return runs.where(F.col("n") > window + 1)


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Rows of long runs (with first and n) by (dim, pass, run, i, j): each two blocks of BLOCK rows of a run, and each block alone."""
    own = F.floor((F.col("rank") - F.col("first")) / F.lit(BLOCK))
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.lit(BLOCK)).cast("int"))).alias("with")
    spread = rows.select("*", own.cast("int").alias("own"), other)
    return spread.withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")}).drop("with", "first", "n")


def _meet(rows: pd.DataFrame, block: int, limit: int, window: int) -> pd.DataFrame:
    """The nodes of a block (and the window after it) that have another with a near sketch within the window."""
    rows = rows.sort_values("rank")
    words = np.stack(rows["sketch"].to_list()).astype(np.int64).view(np.uint64)
    rank = rows["rank"].to_numpy()
    own, met = int((rank // BLOCK == block).sum()), np.zeros(len(rows), bool)
    for i in range(0, own, STRIPE):
        j = min(own, i + STRIPE)
        to = slice(i, min(len(rows), j + window))
        apart = np.zeros((j - i, to.stop - i), np.uint16)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[i:j, None, w] ^ words[None, to, w])
        near = np.triu(apart <= limit, 1) & (rank[None, to] - rank[i:j, None] <= window)
        met[i:j] |= near.any(axis=1)
        met[to] |= near.any(axis=0)
    return pd.DataFrame({"node": rows["node"].to_numpy()[met]})


def _meet_far(rows: pd.DataFrame, i: int, j: int, limit: int) -> pd.DataFrame:
    """Nodes of two blocks of a run, or of one, that have another with a near sketch; rows that ask are compared with all."""
    words = np.stack(rows["sketch"].to_list()).astype(np.int64).view(np.uint64)
    own, asks, met = rows["own"].to_numpy(), rows["asks"].to_numpy(bool), np.zeros(len(rows), bool)
    for mine, to in {(i, j), (j, i)}:
        a, b = np.flatnonzero(asks & (own == mine)), np.flatnonzero(own == to)
        for at in range(0, len(a), STRIPE):
            some = a[at : at + STRIPE]
            apart = np.zeros((len(some), len(b)), np.uint16)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(words[some, None, w] ^ words[None, b, w])
            near = (apart <= limit) & (some[:, None] != b[None, :])
            met[some] |= near.any(axis=1)
            met[b] |= near.any(axis=0)
    return pd.DataFrame({"node": rows["node"].to_numpy()[met]})


def with_near_sketch(distinct: DataFrame, n_passes: int, limit: int, window: int, signs_of_run: int) -> DataFrame:
    """(node): the vectors of ``distinct`` (node, vector) that may have a link."""
    signs = durable(distinct.select("node", F.size("vector").alias("dim"), _hash_udf(n_passes)("vector").alias("s")))  # the ranges are sampled from it
    sketch = F.slice("s", F.lit(n_passes + 1), F.lit(SKETCH // 64)).alias("sketch")
    hashed = signs.select("node", "dim", sketch, F.posexplode(F.slice("s", F.lit(1), F.lit(n_passes))).alias("pass", "h"))
    ranked = _ranked(hashed.select("*", _run(signs_of_run)))

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _meet(part, key[2], limit, window)

    def meet_far(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _meet_far(part, key[3], key[4], limit)

    met = durable(_in_blocks(ranked.drop("run"), window).groupBy("dim", "pass", "block").applyInPandas(meet, "node long").distinct())
    key, found = ["dim", "pass", "run"], met.withColumn("met", F.lit(True))

    def long(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(_long_runs(rows, window)), key)
        return rows.join(found, "node", "left").withColumn("asks", F.col("met").isNull()).drop("met")

    rows = durable(long(ranked))
    asked = rows.where("asks").agg(F.sum("n").cast("double").alias("pairs"), F.countDistinct("node").alias("nodes")).first()
    if not asked["nodes"]:
        return met
    if asked["pairs"] > asked["nodes"] * signs.count():  # all rows in one run are fewer pairs
        rows = long(ranked.where("pass = 0").withColumn("run", F.lit(0).cast("long")))
    else:
        rows = rows.join(F.broadcast(rows.where("asks").select(*key).distinct()), key)
    return met.union(_in_pairs(rows).groupBy(*key, "i", "j").applyInPandas(meet_far, "node long")).distinct()


class _Runs:
    """The runs of a task's rows in all passes, worked out for rows that are asked for."""

    def __init__(self, x: np.ndarray, n_passes: int, signs: int):
        self.x, self.n, self.signs = x, n_passes, signs
        self.known, self.found = np.zeros(len(x), bool), np.zeros((len(x), n_passes), np.int64)

    def of(self, *at: np.ndarray) -> np.ndarray:
        new = np.zeros(len(self.x), bool)
        for rows in at:
            new[rows] = True
        new = np.flatnonzero(new & ~self.known)
        if len(new):
            self.found[new], self.known[new] = runs(self.x[new], self.n, self.signs), True
        return self.found


def _first_met(a: np.ndarray, b: np.ndarray, own: np.ndarray, of: _Runs, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs a, b of pass k count in it (share its run, and none before), and which share no run in any pass. own: the rows' runs in pass k."""
    found, now = of.of(a, b), own[a] == own[b]
    new, stray = now.copy(), ~now
    for p in range(of.n):
        if p == k or not (stray.any() or (p < k and new.any())):
            continue
        same = found[a, p] == found[b, p]
        stray &= ~same
        if p < k:
            new &= ~same
    return new, stray


def _count(rows: pd.DataFrame, k: int, threshold: float, window: int, spans, far: bool, n_passes: int, signs: int) -> pd.DataFrame:
    """Sums of links and a forest of links of ``rows``, in order of rank. spans: rows from, to and those that
    they meet, from and to, of which only later ones count; far: further apart than the window, else within it."""
    x = unit(rows["vector"])
    rank, node, weight = rows["rank"].to_numpy(), rows["node"].to_numpy(), rows["copies"].to_numpy()
    of, own = _Runs(x, n_passes, signs), rows["run"].to_numpy() if signs else None
    links, lab, strays = np.zeros(len(rows), np.int64), np.arange(len(rows)), []
    for i, j, lo, hi in spans:
        close = x[i:j] @ x[lo:hi].T >= threshold
        apart = rank[None, lo:hi] - rank[i:j, None]
        close &= (apart > window) if far else (apart <= window)
        close &= np.arange(lo, hi)[None, :] > np.arange(i, j)[:, None]
        if signs:  # without signs all rows are one run
            a, b = np.nonzero(close)
            new, stray = _first_met(a + i, b + lo, own, of, k)
            close[a[~new], b[~new]] = False
            strays.append(np.stack([a[stray] + i, b[stray] + lo]))
        links[i:j] += close @ weight[lo:hi]
        links[lo:hi] += weight[i:j] @ close
        a, b = np.nonzero(close & (lab[i:j, None] != lab[None, lo:hi]))
        lab = min_labels(len(lab), lab[a + i], lab[b + lo])[lab]
    at = np.flatnonzero((links > 0) | (lab != np.arange(len(rows))))
    out = pd.DataFrame({"node": node[at], "links": links[at], "other": node[lab[at]], "stray": False})
    if not strays:
        return out
    a, b = np.concatenate([*strays, *(s[::-1] for s in strays)], axis=1)  # from either end
    return pd.concat([out, pd.DataFrame({"node": node[a], "links": weight[b], "other": node[b], "stray": True})])


def _compare(rows: pd.DataFrame, k: int, block: int, threshold: float, window: int, n_passes: int = 1, signs: int = 0) -> pd.DataFrame:
    """Sums of links and a forest of links of a block (and the window after it) of pass k."""
    rows = rows.sort_values("rank")
    own = int((rows["rank"].to_numpy() // BLOCK == block).sum())  # the rest belong to the next block
    stripes = ((i, min(own, i + STRIPE)) for i in range(0, own, STRIPE))
    return _count(rows, k, threshold, window, ((i, j, i, min(len(rows), j + window)) for i, j in stripes), False, n_passes, signs)


def _compare_far(rows: pd.DataFrame, k: int, i: int, j: int, threshold: float, window: int, n_passes: int = 1, signs: int = 0) -> pd.DataFrame:
    """As _compare(), for blocks i and j of a run: the pairs further apart than the window."""
    rows = rows.sort_values("rank")
    own = int((rows["own"] == i).sum())
    spans = ((a, min(own, a + STRIPE), a if i == j else own, len(rows)) for a in range(0, own, STRIPE))
    return _count(rows, k, threshold, window, spans, True, n_passes, signs)


def _valid(vector):
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding", n_passes: int | None = None) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of
    different lengths don't link. Equal vectors are linked with each other, repeated rows too; of rows
    with one id each is kept or not like the others. A null id takes part; it is a component's id only
    if all its ids are null. An empty table gives no rows; extra columns are not read.
    """
    if not 0 < window <= BLOCK:
        raise ValueError(f"window must be from 1 to {BLOCK}")
    kind = vectors.schema[vector_col].dataType.simpleString()  # floats stay floats, at half the bytes; what is computed is double
    v = F.when(_valid(F.col(vector_col)), F.transform(vector_col, lambda x: F.when(x == 0, F.lit(0)).otherwise(x)).cast(kind))  # -0.0 is 0.0
    key = F.sha2(F.to_binary(F.to_json(F.struct(v.alias("v"))), F.lit("utf-8")), 256)
    rows = durable(vectors.select(F.col(id_col).alias("vec_id"), v.alias("vector"), F.unhex(F.when(v.isNotNull(), key)).alias("digest")))
    distinct = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.min("vector").alias("vector"))
    distinct = durable(distinct.withColumn("node", F.monotonically_increasing_id()))
    total = distinct.count()
    near = with_near_sketch(distinct, n_passes or passes(total, threshold, window), sketch_limit(threshold), window, leading(total, window))
    some = durable(distinct.join(near, "node", "left_semi").select("node", "copies", "vector"))
    left = some.count()
    n_passes, signs_of_run = n_passes or passes(left, threshold, window), leading(left, window)

    signs = durable(some.select("node", F.size("vector").alias("dim"), F.slice(_hash_udf(n_passes)("vector"), F.lit(1), F.lit(n_passes)).alias("s")))
    hashed = signs.select("node", "dim", F.posexplode("s").alias("pass", "h"))
    sizes = hashed.groupBy("dim", "pass", _run(signs_of_run)).count().where(F.col("count") > window + 1)
    if (sizes.agg(F.sum(F.col("count").cast("double") ** 2)).first()[0] or 0) > left**2:  # all pairs are fewer
        hashed, signs_of_run = hashed.where("pass = 0"), 0
    ranked = _ranked(hashed.select("*", _run(signs_of_run)))
    spread = ranked.join(some.select("node", "copies", "vector"), "node")

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _compare(part, key[1], key[2], threshold, window, n_passes, signs_of_run)

    def compare_far(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _compare_far(part, key[1], key[3], key[4], threshold, window, n_passes, signs_of_run)

    found = _in_blocks(spread, window).groupBy("dim", "pass", "block").applyInPandas(compare, OUT_SCHEMA)
    longer = durable(_long_runs(ranked, window))
    if not longer.isEmpty():
        far = _in_pairs(spread.join(F.broadcast(longer), ["dim", "pass", "run"]))
        found = found.union(far.groupBy("dim", "pass", "run", "i", "j").applyInPandas(compare_far, OUT_SCHEMA))
    found = durable(found)
    once = found.where("stray").select("node", "links", "other").distinct()  # several passes may hold them
    sums = found.where("not stray").select("node", "links").union(once.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = distinct.select("node", "digest", "low", "copies").join(sums, "node", "left").join(parts, "node", "left")
    nodes = nodes.select("digest", "copies", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    lows = nodes.groupBy("root").agg(F.min("low").alias("component"))
    of = nodes.join(lows, "root").select("digest", "n_links", "component")
    out = rows.select("vec_id", "digest").join(of, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
