"""Exact dedup, SimHash near-dedup and their components against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from graphloom.llm import common, sharding, simhash
from graphloom.llm.common import min_labels, mix64, one_of_each
from graphloom.llm.components import connected_components
from graphloom.llm.exact_dedup import build_hash, exact_dedup, exact_groups, digests, find_slots

DOCS = "doc_id long, text string, source string, kept string"


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 20_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    levels, slot = build_hash(keys)
    assert sorted(slot) == list(range(n))
    assert (find_slots(levels, keys) == slot).all()


def test_strangers_are_told_by_the_slot():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(2000)), np.uint8).reshape(-1, 32)
    levels, slot = build_hash(keys[:1000])
    slots = keys[:1000][np.argsort(slot)]
    at = find_slots(levels, keys[1000:])
    assert ((at < 0) | (slots[at] != keys[1000:]).any(axis=1)).all()


def rows():
    rng = random.Random(3)
    out = [(i, f"text {rng.randrange(40)}", None, "x") for i in range(300)]
    out += [(None, "text 1", "s", None), (None, "only null", "s", None), (400, None, None, None), (401, "", None, None), (402, " ", None, None)]
    out += [(500, "twice", "a", "1"), (500, "twice", "b", "2"), (500, "other", "b", "2"), (2**60 + 1, "big", None, None), (2**60, "big", None, None), (600, "long " * 50_000, None, None)]
    return out


def test_exact_dedup_against_brute_force(spark):
    data = rows()
    groups = defaultdict(list)
    for i, text, *_ in data:
        groups[text or ""].append(i)
    got = exact_dedup(spark.createDataFrame(data, DOCS)).collect()
    assert len(got) == len(data)
    kept = defaultdict(int)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        ids = groups[by_sha[r["text_sha256"]]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_history_is_met_and_strangers_group_alone(spark):
    old = digests(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"))
    new = digests(spark.createDataFrame([(4, "a"), (5, "c"), (0, "c"), (None, "b")], "doc_id long, text string"))
    got = {(r["keep_id"], r["group_size"], r["was_known"]) for r in exact_groups(old, new).collect()}
    assert got == {(4, 3, True), (3, 2, True), (5, 2, False)}


def test_an_outside_history_is_met(spark):
    kind = "doc_id long, text string"
    first = exact_groups(digests(spark.createDataFrame([], kind)), digests(spark.createDataFrame([(1, "a"), (9, "b"), (None, "c")], kind)))
    got = exact_dedup(spark.createDataFrame([(5, "a"), (5, "a"), (6, "b"), (7, "d"), (None, "c")], kind), history=first).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str) == sorted([(5, 5, 3, True), (5, 5, 3, False), (6, 9, 2, False), (7, 7, 1, True), (None, None, 2, True)], key=str)


def test_the_smallest_id_is_an_id(spark):
    low = -(2**63)
    got = exact_dedup(spark.createDataFrame([(low, "a"), (None, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["kept"]) for r in got), key=str) == sorted([(low, low, True), (None, low, False), (None, None, True)], key=str)


@pytest.mark.parametrize("run", [7, 4096])
def test_heavy_repeats(spark, monkeypatch, run):
    """A row that is there 10,000 times: its copies are unfolded in runs, and one is kept."""
    monkeypatch.setattr(common, "RUN", run)
    docs = spark.range(10_000).selectExpr("IF(id % 100 = 0, id, -1) AS doc_id", "IF(id % 100 = 0, string(id), 'same') AS text", "id AS copy", "'x' AS n")
    got = exact_dedup(docs).groupBy("keep_id", "group_size").agg({"*": "count", "doc_id": "min"}).toPandas()
    assert len(got) == 101 and sorted(got["count(1)"])[-2:] == [1, 9900] and got["group_size"].max() == 9900
    assert exact_dedup(docs).where("kept").count() == 101
    numbered, total = sharding.row_numbers(docs.select("doc_id", "text"), ["doc_id", "text"])
    assert total == 10_000 and numbered.select("row").distinct().count() == 10_000 and numbered.agg({"row": "max"}).first()[0] == 9999


def test_one_of_each_keeps_one_of_equal_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "doc_id long, text string")
    picked = spark.createDataFrame([(1,), (None,)], "doc_id long")
    assert [r["doc_id"] for r in one_of_each(docs, picked).orderBy("doc_id").collect()] == [None, 1]


def brute_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", words)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", "  \t", "One", "one TWO", "a b c", "Ünï ÄB c d e f", "x " * 2000, "a\x0bb\x0cc\rd e\nf", "A b A b A b"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(text, block=3) == brute_fingerprint(text)


def components(fps):
    fps = np.asarray(fps, np.uint64)
    return min_labels(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))


def test_simhash_groups_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(25)]
    data = []
    for i in range(300):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        data.append((i, " ".join(words), None, None))
    data += [(300, None, None, None), (301, "", None, None), (None, "", None, None), (7, data[7][1], "x", None), (302, "word " * 60_000, None, None)]
    fps = [brute_fingerprint(r[1]) for r in data]
    lab = components(fps)
    low = {}
    for (i, *_), c in zip(data, lab):
        if i is not None:
            low[c] = min(i, low.get(c, i))
    want = sorted(((r[0] is None, r[0] or 0, f"{f:016x}", low.get(c)) for r, f, c in zip(data, fps, lab)))
    got = simhash.simhash_groups(spark.createDataFrame(data, DOCS))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got.collect()) == want
    assert simhash.first_of_groups(got).count() == len(set(lab))
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("flips", [3, 6])
def test_large_buckets_lose_no_link(flips):
    """Thousands of fingerprints in one bucket: coarse keys hand them on, finer keys find all links."""
    rng = np.random.default_rng(flips)
    near = np.zeros(5000, np.uint64)
    for _ in range(flips):  # in bits that several keys leave out
        near ^= np.uint64(1) << rng.integers(0, 36, len(near)).astype(np.uint64)
    fps = np.unique(np.concatenate([near, mix64(np.arange(500))]))
    links = []

    def compare(rows, level):
        rows = rows.sort_values(["k", "key"], kind="stable").reset_index(drop=True)
        parts = [rows.iloc[i : i + 777] for i in range(0, len(rows), 777)]
        return pd.concat(list(simhash._compare(iter(parts), level)), ignore_index=True)

    keyed = pd.concat([pd.DataFrame({"k": k, "key": (fps & np.uint64(m)).view(np.int64), "fp": fps.view(np.int64)}) for k, m in enumerate(simhash._masks())])
    first = compare(keyed, 0)
    finer = first[first["level"] == 1]
    assert len(finer), "the bucket was to be too large"
    second = compare(finer.rename(columns={"a": "fp"})[["k", "key", "fp"]], 1)
    links = pd.concat([first[first["level"] == 0], second])
    a, b = links["a"].to_numpy().view(np.uint64), links["b"].to_numpy().view(np.uint64)
    assert (np.bitwise_count(a ^ b) <= 64).all()
    place = {int(f): i for i, f in enumerate(fps)}
    got = min_labels(len(fps), np.array([place[int(x)] for x in a]), np.array([place[int(x)] for x in b]))
    assert (got == components(fps)).all()


def test_connected_components_against_union_find(spark):
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
