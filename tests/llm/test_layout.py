"""Packing, sharding and mixing."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import mixing, packing, sharding

DOCS = "doc_id long, text string, source string, shard string, size string"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(), st.text("ab 'stllvere\n\t  é😀١９_-.,1", max_size=80), st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "é", "<", "s"])).map("".join)))
def test_ids_are_those_of_the_tokenizer(tokenizer, text):
    assert packing.token_ids(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_special_string_has_its_own_id(tokenizer):
    assert packing.token_ids("a <|endoftext|> b") == [64, 220, 50256, 275] == tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert packing.token_ids(None) == []


@given(st.integers(1, 100_000))
def test_piece_lengths(n):
    lengths = packing.piece_lengths(n)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 1024 for x in lengths)
    assert len([x for x in lengths if x < 1024]) == len({x for x in lengths if x < 1024})


def data():
    return [(i, "some words here " * i, f"s{i % 5}", None, None) for i in range(60)] + [(60, None, None, None, None), (61, "", None, None, None), (3, "some words here " * 3, "s3", "z", "z"), (None, "x", "s0", None, None), (62, "véry <|endoftext|> long " * 9000, "s1", None, None)]


def test_pack(spark, tokenizer, tmp_path):
    got = packing.pack(spark.createDataFrame(data(), DOCS)).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    want = Counter()
    for i, text, *_ in data():
        want[(i, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [0]))] += 1
    read = Counter()
    pieces = sorted(got, key=lambda r: r["sequence_id"])
    while pieces:
        ids, first = [], pieces[0]
        while len(ids) < first["doc_tokens"]:
            r = pieces.pop(0)
            own = np.frombuffer(bytes(r["ids"]), "<u4")
            assert (r["doc_id"], r["start"], r["length"], 1 << r["bucket"]) == (first["doc_id"], len(ids), len(own), len(own))
            ids += own.tolist()
        read[(first["doc_id"], tuple(ids))] += 1
    assert read == want
    digest = packing.digest(packing.pack(spark.createDataFrame(data(), DOCS))).collect()
    assert Counter(zlib.crc32(bytes(r["ids"])) for r in got) == Counter(r["ids_crc32"] for r in digest)
    packing.write_buckets(packing.pack(spark.createDataFrame(data(), DOCS)), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").where("length <> 1 << bucket").count() == 0 and len(list(tmp_path.glob("b/bucket=*"))) > 3
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], DOCS), limit=1000)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4096, 4097])
def test_permutation(n):
    rows = np.arange(n)
    places = sharding.permute(rows, n)
    assert sorted(places) == list(range(n))
    assert (sharding.permute(places, n, inverse=True) == rows).all()
    assert n < 1000 or (sharding.permute(rows, n, seed=1) != places).any()


def test_permutation_looks_random():
    places = sharding.permute(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), places)[0, 1]) < 0.05


def test_feistel_shards(spark):
    docs = spark.createDataFrame(data(), DOCS)
    got = sharding.feistel_shards(docs, shards=7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in data())
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 7
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    for r in got:
        place = int(sharding.permute(np.array([r["row"]]), len(got))[0])
        assert (r["shard"], r["slot"]) == (place % 7, place // 7)
    again = sharding.feistel_shards(docs.repartition(3), shards=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.feistel_shards(docs.limit(0)).count() == 0


def water(sizes):
    """Targets by resharing what stands above a cap until nothing does. sizes: in the order of sources."""
    w, total = [(5, 2, 1)[i % 3] for i in range(len(sizes))], sum(sizes)
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(3 * sizes[i] for i in capped)
        share = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 3 * sizes[i] * (1 + 1e-12)}
        if not over:
            return [3 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 10], [0, 5, 0, 7], [100], [3, 1, 4, 1, 5, 9, 2, 6, 5000], [0, 0]])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame([(f"0s{i:02d}", s) for i, s in enumerate(sizes)], "skey string, source_size long")).orderBy("skey").collect()
    assert [r["target"] for r in got] == pytest.approx(water(sizes))


def test_splitting_tree_keeps_quotas(spark):
    quotas = {"a": 1000, "b": 37, "c": 0, "d": 260}
    tree = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "skey string, quota long"), 16).collect()
    assert len(tree) == 16 * 4 and min(r["blocks"] for r in tree) >= 0
    assert {k: sum(r["blocks"] for r in tree if r["skey"] == k) for k in quotas} == quotas
    whole = Counter()
    for r in tree:
        whole[r["shard"]] += r["blocks"]
    assert max(whole.values()) - min(whole.values()) <= 5
    alone = mixing.splitting_tree(spark.createDataFrame([("a", 9)], "skey string, quota long"), 1).collect()
    assert [(r["shard"], r["blocks"]) for r in alone] == [(0, 9)]


@pytest.mark.parametrize(("n", "shards"), [(200, 16), (4200, 4)])
def test_splitting_tree_of_many_sources(spark, n, shards):
    """More sources than a row of the tree holds, and more than a row of rows: quotas are kept, shards are even, shares are as a deal of all blocks gives them."""
    quotas = {f"0s{i:05d}": i % 40 for i in range(n)}
    tree = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "skey string, quota long"), shards).toPandas()
    assert len(tree) == n * shards and tree["blocks"].min() >= 0
    assert tree.groupby("skey")["blocks"].sum().to_dict() == quotas
    whole = tree.groupby("shard")["blocks"].sum()
    assert whole.max() - whole.min() <= shards.bit_length()
    p, q = 1 / shards, tree["skey"].map(quotas).to_numpy()
    total = sum(quotas.values())
    spread = q * p * (1 - p) * (total - q) / (total - 1)  # of a hypergeometric number
    off = (tree["blocks"] - q * p).to_numpy()
    assert abs((off**2).sum() / spread.sum() - 1) < 0.15


def test_mixed_rows_have_the_shards_of_the_plan(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 4}", None, None) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = Counter((r["doc_id"], s) for r in mixing.mix(docs, shards=8).collect() for s in r["shards"])
    got = mixing.mixed(docs, shards=8, shard_col="to")
    assert got.columns == [*docs.columns, "to"] and Counter((r["doc_id"], r["to"]) for r in got.collect()) == plan


def test_draw_is_hypergeometric(spark):
    """Evenly spread uniform numbers give the distribution itself."""
    total, good, n, m = 60, 25, 30, 4000
    rows = spark.range(m).select(F.expr(mixing._draw(str(total), str(good), str(n), f"((id + 0.5D) / {m})")).alias("x")).groupBy("x").count().collect()
    from math import comb

    for r in rows:
        p = comb(good, r["x"]) * comb(total - good, n - r["x"]) / comb(total, n)
        assert abs(r["count"] / m - p) <= 2 / m
    edge = spark.sql("SELECT " + ", ".join(mixing._draw(*map(str, x), "0.5D") for x in [(0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 2, 5), (5, 3, 0)])).first()
    assert list(edge) == [0, 3, 0, 2, 0]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(spark):
    rows = [(i, "w " * (i % 23 + 1), f"s{'abcdefghij'[min(9, int((i % 97) ** 0.5))]}", None, None) for i in range(2000)]
    rows += [(5000, None, None, None, None), (5001, "", None, None, None), (5002, "a b c", None, None, None), (None, "null id", "sa", None, None), (3, "w " * 4, "sb", None, None), (3, "w " * 4, "sb", None, None), (5003, "big " * 30_000, "sc", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, shards=8, buckets=16).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[(source is None, source or "")] += size(text)
    names = sorted(sizes)
    targets = dict(zip([n[1] for n in names], water([sizes[n] for n in names])))
    by_size = {sizes[n]: targets[n[1]] for n in names}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(by_size[r["source_size"]])
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"] and len(r["shards"]) == r["copies"]
        taken[r["source_size"]] += r["taken"]
    for s, t in by_size.items():
        assert abs(taken[s] - t) <= 23
    shards = Counter(s for r in got for s in r["shards"])
    assert set(shards) <= set(range(8))
    again = mixing.mix(docs.repartition(5), shards=8, buckets=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.mixed(docs, shards=8)
    assert out.columns == docs.columns
    plan = Counter()
    for r in mixing.mix(docs, shards=8).collect():
        plan[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == +plan
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
