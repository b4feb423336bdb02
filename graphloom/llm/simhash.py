"""SimHash near-dedup: pigeonhole blocks, verified Hamming distances, components.

Fingerprints that differ in at most 3 of 64 bits agree in at least 3 of 6 blocks, so each of the 20
choices of 3 blocks is a key, and every close pair shares one. Equal fingerprints are one node from the
start, so a group of copies is one row. A key's bucket is compared bit by bit in one task, and gives a
spanning forest of its verified links, never its pairs. A bucket of more than BUCKET fingerprints is
split once more: its bits outside the key are cut to 6 blocks, and each 3 of them make a finer key.
Such a bucket has at most 18 free bits, and its links are found by flipping up to 3 of them, so no
bucket is too large and none is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import durable, min_labels
from graphloom.llm.components import connected_components

DISTANCE, BLOCKS, SHARED = 3, 6, 3
CHOICES = list(combinations(range(BLOCKS), SHARED))
#: Fingerprints of a bucket that are compared each with each, as one matrix in memory.
BUCKET = 1500
LINK_SCHEMA = "level int, k int, key long, a long, b long"


def _cut(bits: list[int]) -> list[list[int]]:
    """Bit positions in BLOCKS runs of nearly equal length."""
    return [list(map(int, x)) for x in np.array_split(bits, BLOCKS)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


@lru_cache(None)
def _masks() -> list[int]:
    """The bits of each of the 20 keys."""
    blocks = _cut(range(64))
    return [_mask(sum((blocks[i] for i in c), [])) for c in CHOICES]


@lru_cache(None)
def _finer(k: int) -> list[int]:
    """The bits of the 20 finer keys within key k: its own and those of 3 of 6 blocks of the rest."""
    own = _masks()[k]
    blocks = _cut([b for b in range(64) if not own >> b & 1])
    return [own | _mask(sum((blocks[i] for i in c), [])) for c in CHOICES]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, block: int = 1 << 15) -> int:
    """The fingerprint of a whole text: 3-word shingles, XXH64 with seed 42, a bit where over half have it. Null: empty."""
    words = (text or "").encode().lower().split()  # of bytes, lower() changes A-Z only and split() cuts at space and \\x09-\\x0D
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < 3:
        starts, ends = [0], [len(whole)]
    else:
        starts, ends = starts[:-2].tolist(), ends[2:].tolist()
    n, h, counts = len(starts), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, block):
        part = np.fromiter((h(whole[s:e], 42) for s, e in zip(starts[i : i + block], ends[i : i + block])), "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")


def _literal(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")


def _keys(masks: list[int]) -> Column:
    """One (k, key) for each mask."""
    return F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(_literal(m)).alias("key")) for k, m in enumerate(masks)))


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) of the components of a few distinct fingerprints."""
    close = np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= DISTANCE, 1)
    lab = min_labels(len(fps), *np.nonzero(close))
    at = np.flatnonzero(lab != np.arange(len(fps)))
    return fps[at], fps[lab[at]]


def _dense_forest(fps: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a bucket whose fingerprints differ in the few bits of the mask ``free`` only."""
    bits = [b for b in range(64) if free >> b & 1]
    small = np.zeros(len(fps), np.int64)
    for i, b in enumerate(bits):
        small |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    node = np.full(1 << len(bits), -1, np.int64)
    node[small] = np.arange(len(fps))
    lab = np.arange(len(fps))
    flips = [_mask(c) for d in range(1, DISTANCE + 1) for c in combinations(range(len(bits)), d)]
    for flip in flips:  # a flip's links join what earlier flips have joined, so one round of them is enough
        other = node[small ^ flip]
        there = np.flatnonzero((other >= 0) & (lab[other] != lab))
        lab = min_labels(len(fps), lab[there], lab[other[there]])[lab]
    at = np.flatnonzero(lab != np.arange(len(fps)))
    return fps[at], fps[lab[at]]


def _rows(level: int, k: int, key: np.ndarray | int, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"level": level, "k": k, "key": key, "a": a.view(np.int64), "b": b.view(np.int64)})


def _cuts(k: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a new bucket begins, after the first."""
    return np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1


def _buckets(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """From rows sorted by (k, key): whole buckets, many at a time (False), or a part of one bucket of more than ``most`` rows (True).

    No more than a batch and ``most`` rows are held.
    """
    rest: list[pd.DataFrame] = []  # the last bucket so far
    last, large = None, False
    for batch in batches:
        if not len(batch):
            continue
        k, key = batch["k"].to_numpy(), batch["key"].to_numpy()
        cuts = _cuts(k, key)
        if last == (k[0], key[0]):
            head = batch.iloc[: cuts[0]] if len(cuts) else batch
            rest.append(head)
            large = large or sum(map(len, rest)) > most
            if large:
                yield pd.concat(rest), True
                rest = []
            if not len(cuts):
                continue
            batch = batch.iloc[cuts[0] :]
            cuts = cuts[1:] - cuts[0]
        if rest:
            yield pd.concat(rest), False
        end = cuts[-1] if len(cuts) else 0
        if end:
            yield batch.iloc[:end], False
        rest, last, large = [batch.iloc[end:]], (batch["k"].iloc[-1], batch["key"].iloc[-1]), False
    if rest:
        yield pd.concat(rest), False


def _finer_rows(k: int, own: np.ndarray) -> Iterator[pd.DataFrame]:
    """A large bucket's fingerprints under its 20 finer keys."""
    for j, mask in enumerate(_finer(k)):
        yield _rows(1, k * len(CHOICES) + j, (own & np.uint64(mask)).view(np.int64), own, own)


def _compare(batches: Iterator[pd.DataFrame], level: int) -> Iterator[pd.DataFrame]:
    """Links of the buckets (level 0), and finer rows of those that are too large (level 1). A finer bucket has 2^18 fingerprints at most."""
    for part, large in _buckets(batches, 1 << 18 if level else BUCKET):
        k, key, fps = part["k"].to_numpy(), part["key"].to_numpy(), part["fp"].to_numpy().view(np.uint64)
        if large:
            yield from _finer_rows(int(k[0]), fps)
            continue
        cuts = np.concatenate(([0], _cuts(k, key), [len(k)]))
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        a, b = fps[two], fps[two + 1]
        close = np.bitwise_count(a ^ b) <= DISTANCE
        found = [(a[close], b[close])]
        for at in np.flatnonzero(sizes > 2):
            own = fps[cuts[at] : cuts[at + 1]]
            if len(own) <= BUCKET:
                found.append(_forest(own))
            elif level:
                coarse = int(k[cuts[at]])
                found.append(_dense_forest(own, ~_finer(coarse // len(CHOICES))[coarse % len(CHOICES)] & (1 << 64) - 1))
            else:
                yield from _finer_rows(int(k[cuts[at]]), own)
        yield _rows(0, 0, 0, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))


def close_links(distinct: DataFrame) -> DataFrame:
    """Verified links (a, b) among the distinct fingerprints ``fp`` (long): every close pair is joined by a path of them."""
    keyed = distinct.select("fp", F.explode(_keys(_masks())).alias("x")).select("x.k", "x.key", "fp")
    dealt = keyed.repartition("k", "key").sortWithinPartitions("k", "key")
    first = durable(dealt.mapInPandas(lambda it: _compare(it, 0), LINK_SCHEMA))
    finer = first.where("level = 1").select("k", "key", F.col("a").alias("fp")).repartition("k", "key").sortWithinPartitions("k", "key")
    second = finer.mapInPandas(lambda it: _compare(it, 1), LINK_SCHEMA)
    return first.where("level = 0").union(second).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach),
    group_key (the component, also where ids repeat or are null), text_key (a hash of the text).

    Null texts count as empty; texts without words have fingerprint zero and are linked like any other;
    repeated rows give repeated rows; a null id is larger than any id, so that it is a component's id
    only if all its ids are null; an empty table gives no rows; extra columns are not read.
    """
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    parts = connected_components(close_links(nodes.select("fp")))
    joined = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    of = joined.join(lows, "root").select("fp", "component_id", F.col("root").alias("group_key"))
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_key", "text_key")


def first_of_groups(groups: DataFrame) -> DataFrame:
    """(doc_id, text_key) of the row that stays of each group: the smallest id, then the smallest hash."""
    low = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("m")
    return groups.groupBy("group_key").agg(low).select("m.doc_id", "m.text_key")
