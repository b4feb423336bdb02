"""The pipeline's stages, each against plain Python on its own input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm.common import min_labels
from graphloom.llm.mixing import mix
from graphloom.llm.packing import piece_lengths, token_ids
from graphloom.llm.simhash import fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators and stages use for themselves.
CLASHES = ["score", "predicted", "kept", "keep_id", "n", "copy", "copies", "shards", "size", "component_id", "fingerprint", "text_key", "text_sha256", "digest", "label", "place", "__key", "__n", "__id", "__doc_id", "__digest", "__copy", "__shard", "__turn", "__part", "there", "plan", "rows", "Shard", "ids"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(6), tmp_path_factory.mktemp("tables")
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rng.choices(words, k=rng.randrange(20, 90)))
        if i % 5 == 1:
            text += " vile"
        if i % 7 == 3:
            text = rows[rng.randrange(len(rows))][1]
        if i % 11 == 5:
            text = rows[rng.randrange(len(rows))][1] + " end"
        rows.append((i, text, "en", f"s{i % 6}", len(text)))
        if i % 10 != 9:
            labels.append((i, 1, int("vile" in text)))
    rows += [(400, None, None, None, None), (401, "", None, None, 0), (None, "no id here", None, None, 3)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, tables):
    folder, rows = tables
    docs, stages = spark.createDataFrame(rows, DOCS), dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, folder)
    kept = clean.collect()
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows if "vile" not in (r[1] or "")}

    one = stages["exact dedup"](spark, clean, folder)
    last = {}
    for r in kept:
        text = r["text"] or ""
        last[text] = max((r["doc_id"] for q in [r] if q["doc_id"] is not None), default=last.get(text), key=lambda x: -1 if x is None else x) if text not in last or (last[text] or -1) < (r["doc_id"] or -1) else last[text]
    got = one.collect()
    assert one.columns == docs.columns and Counter(r["doc_id"] for r in got) == Counter(last.values())

    near = stages["simhash near-dedup"](spark, one, folder)
    fps = np.array([fingerprint(r["text"]) for r in got], np.uint64)
    lab = min_labels(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    low = defaultdict(list)
    for r, c in zip(got, lab):
        low[c].append(r["doc_id"])
    assert Counter(r["doc_id"] for r in near.collect()) == Counter(min((i for i in ids if i is not None), default=None) for ids in low.values())
    assert near.columns == docs.columns

    mixed = stages["mixing"](spark, near, folder)
    plan = Counter()
    for r in mix(near).collect():
        plan[r["doc_id"]] += r["copies"]
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == +plan

    packed = stages["packing"](spark, mixed, folder)
    want = Counter()
    for r in mixed.collect():
        want.update((r["doc_id"], x) for x in piece_lengths(len(token_ids(r["text"])) + 1))
    assert Counter((r["doc_id"], r["length"]) for r in packed.collect()) == want


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns_with_clashing_names(spark, tables, k):
    """Columns called as the stage's own, null or not, go along; a map and an array too."""
    folder, rows = tables
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"IF(doc_id % 3 = 0, NULL, concat('{c}', doc_id)) AS `{c}`" for c in CLASHES), "map('a', doc_id) AS m", "array(doc_id) AS a").drop("lang")
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(docs.where("doc_id < 5").withColumn("n", F.lit("other")))
    plain = spark.createDataFrame(rows, DOCS)
    plain = plain.unionByName(plain.where("doc_id < 9")).unionByName(plain.where("doc_id < 5"))
    _, stage = corpus_pipeline.STAGES[k]
    got, want = stage(spark, docs, folder), stage(spark, plain, folder)
    pick = lambda df: Counter((r["doc_id"], r["text"] if k < 4 else r["start"]) for r in df.collect())
    assert pick(got) == pick(want)
    if k == 4:
        return
    assert got.columns == docs.columns
    whole = {str(r) for r in docs.collect()}
    assert all(str(r) in whole for r in got.collect())
    again = stage(spark, docs.repartition(7), folder)
    assert Counter(map(str, again.collect())) == Counter(map(str, got.collect()))


def test_run_goes_on_after_a_failure(spark, tables, tmp_path, monkeypatch):
    folder, _ = tables
    asked = []

    def counted(name, stage, fails):
        def own(spark, docs, sf_dir):
            asked.append(name)
            if fails and asked.count(name) == 1:
                raise ValueError("lost")
            return stage(spark, docs, sf_dir)

        return name, own

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(n, s, n == "mixing") for n, s in stages])
    with pytest.raises(ValueError) as failed:
        corpus_pipeline.run(spark, folder, f"{tmp_path}/p")
    assert "goes on" in failed.value.__notes__[0]
    out = corpus_pipeline.run(spark, folder, f"{tmp_path}/p")
    assert asked == [n for n, _ in stages[:3]] + ["mixing", "mixing", "packing"]
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == ["4"]
    assert len(list(tmp_path.glob("p/4/bucket=*"))) > 3 and out.where("length <> 1 << bucket OR length * 4 <> octet_length(ids)").isEmpty()


def test_run_gives_what_the_stages_give(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    pick = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert pick(corpus_pipeline.run(spark, folder)) == pick(docs)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
