"""Exact dedup against a minimal perfect hash over the distinct digests seen before.

A history of distinct SHA-256 digests is dealt to shards by the digest, and each shard gets a minimal
perfect hash: levels of bit arrays, in which a digest that meets no other at a level takes a bit, and
the rank of the bit is its slot. A slot holds the full digest (32 bytes), the locator of the row that
stays (the largest id, and whether there is one) and the number of copies. A new digest is looked up in
its shard; all 32 bytes of the slot must agree. Members are repeats of what the slot names; nonmembers are grouped among themselves.

Cost: one pass for the digests, one shuffle of (id, digest), pre-aggregated, and a join of ids with
groups, whose hot digests adaptive execution splits. Rows that repeat are one with a count until the end.
No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable, mix64, unfolded

SLOTS_A_SHARD = 16384
INDEX_SCHEMA = "shard long, levels array<binary>, slots binary, locators array<long>, named array<boolean>, sizes array<long>"
GROUP_SCHEMA = "digest binary, keep_id long, named boolean, group_size long, was_known boolean"
#: Stands for the largest id of a group that has none (named: false); a null id is smaller than any.
NO_ID = -(2**63)
#: Bits of a level for each digest that is still without a slot.
SPACE = 1.3


def _words(digests: np.ndarray) -> np.ndarray:
    """The digests (n x 32 bytes) as n x 4 unsigned integers."""
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix64(words[:, 1] ^ mix64(words[:, 2] + np.uint64(level))) % np.uint64(bits)).astype(np.int64)


def _bits(level: bytes) -> np.ndarray:
    """A level's bits; its first 8 bytes are their number."""
    return np.unpackbits(np.frombuffer(level, np.uint8, offset=8), count=int.from_bytes(level[:8], "little"))


def build_hash(digests: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The levels of a minimal perfect hash over distinct digests (n x 32 bytes), and each digest's slot."""
    words, rest = _words(digests), np.arange(len(digests))
    slot, levels, base = np.zeros(len(digests), np.int64), [], 0
    while len(rest):
        size = max(8, int(SPACE * len(rest)))
        at = _place(words[rest], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        won = alone[at]
        slot[rest[won]] = base + (np.cumsum(alone) - 1)[at[won]]
        levels.append(size.to_bytes(8, "little") + np.packbits(alone).tobytes())
        base += int(alone.sum())
        rest = rest[~won]
    return levels, slot


def find_slots(levels: list[bytes], digests: np.ndarray) -> np.ndarray:
    """The slot that each digest would have, -1 if no level has a bit for it. Whether it is a member only the slot can tell."""
    words, out, rest, base = _words(digests), np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for k, level in enumerate(levels):
        bits = _bits(level)
        at = _place(words[rest], k, len(bits))
        hit = bits[at] == 1
        out[rest[hit]] = base + (np.cumsum(bits, dtype=np.int64) - 1)[at[hit]]
        base += int(bits.sum())
        rest = rest[~hit]
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(-1, 32)


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(rows["digest"])
    levels, slot = build_hash(digests)
    order = np.argsort(slot)
    return pd.DataFrame({"shard": [key[0]], "levels": [levels], "slots": [digests[order].tobytes()], "locators": [rows["keep_id"].to_numpy()[order]], "named": [rows["named"].to_numpy(bool)[order]], "sizes": [rows["group_size"].to_numpy()[order]]})


def _meet_shard(key: tuple, index: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
    """The groups of a shard: of its slots, with the new copies, and of the digests that no slot holds."""
    digests = _matrix(fresh["digest"]) if len(fresh) else np.zeros((0, 32), np.uint8)
    parts, member = [], np.zeros(len(fresh), bool)
    ids, names, sizes = (fresh[c].to_numpy(kind) for c, kind in (("keep_id", np.int64), ("named", bool), ("group_size", np.int64)))
    for r in index.itertuples():  # one row, or none if no historical digest fell to the shard
        slots = np.frombuffer(bytes(r.slots), np.uint8).reshape(-1, 32)
        at = find_slots([bytes(x) for x in r.levels], digests)
        hit = at >= 0
        hit[hit] = (slots[at[hit]] == digests[hit]).all(axis=1)
        keep, named, size = np.array(r.locators, np.int64), np.array(r.named, bool), np.array(r.sizes, np.int64)
        where = at[hit]  # a digest comes once, so no slot is met twice
        keep[where] = np.maximum(keep[where], ids[hit])
        named[where] |= names[hit]
        size[where] += sizes[hit]
        parts.append(pd.DataFrame({"digest": [x.tobytes() for x in slots], "keep_id": keep, "named": named, "group_size": size, "was_known": True}))
        member |= hit
    parts.append(pd.DataFrame({"digest": [bytes(x) for x in fresh["digest"][~member]], "keep_id": ids[~member], "named": names[~member], "group_size": sizes[~member], "was_known": False}))
    return pd.concat(parts, ignore_index=True)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the whole text in UTF-8; null counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """The distinct digests of (doc_id, digest), with the largest id (NO_ID and not ``named`` if all are null) and the number of rows; ``n``, if there, counts a row's copies."""
    size = F.sum("n") if "n" in rows.columns else F.count("*")
    return rows.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("keep_id"), F.max("doc_id").isNotNull().alias("named"), size.alias("group_size"))


def with_shard(groups: DataFrame, n_shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards).cast("long")))


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """One row a shard, of about SLOTS_A_SHARD digests: the hash's levels and its slots. history: see grouped()."""
    return with_shard(history, n_shards).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def lookup(index: DataFrame, fresh: DataFrame, n_shards: int) -> DataFrame:
    """All groups after ``fresh`` (see grouped()) has met the index; it is also the next run's history."""
    left, right = index.groupBy("shard"), with_shard(fresh, n_shards).groupBy("shard")
    return left.cogroup(right).applyInPandas(_meet_shard, GROUP_SCHEMA)


def exact_groups(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """Groups over both tables of (doc_id, digest): GROUP_SCHEMA, was_known: in the history."""
    return _met(grouped(history), history, grouped(fresh), fresh)


def _met(old: DataFrame, history: DataFrame, new: DataFrame, fresh: DataFrame) -> DataFrame:
    # As many shards as the rows need; a shard's digests are even, as they are hashes.
    rows = history.count() + fresh.count()
    n = max(1, -(-rows // SLOTS_A_SHARD))
    return lookup(build_index(old, n), new, n)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    history: groups of earlier deliveries (GROUP_SCHEMA, distinct digests, as lookup() returns them); their
    rows count in group_size, and where one has the largest id none of ``docs`` is kept. Without it the
    rows are taken as two deliveries: ids up to the middle of the id range are the history that the index
    is built over, later ids (and null ids) meet it; that split affects no result.

    Ids are integers. Null texts count as empty; equal texts keep the row with the largest id (nulls are
    smaller than any id); of rows with the same id and text one is kept; an empty table gives no rows; extra
    columns are not read. Texts are hashed whole.
    """
    rows = durable(digests(docs, id_col, text_col).groupBy("doc_id", "digest").agg(F.count("*").alias("n")))
    if history is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        middle = 0 if low is None else (low + high) // 2
        late = F.coalesce(F.col("doc_id") > middle, F.lit(True))
        groups = exact_groups(rows.where(~late), rows.where(late))
    else:
        history = durable(history.select("digest", "keep_id", "named", "group_size"))
        groups = _met(history, history, grouped(rows), rows)
    keep = F.when(F.col("named"), F.col("keep_id"))
    out = durable(rows.join(groups.select("digest", keep.alias("keep_id"), "group_size"), "digest"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return unfolded(out, "n", "copy").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
