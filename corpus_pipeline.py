"""A corpus pipeline of five stages: toxicity, exact dedup, near-dedup, mixing, packing.

Each stage is a function of (spark, docs, sf_dir). run() writes what a stage returns as Parquet into the
shared checkpoint folder and reads it again as the next stage's docs.

All stages: a null text counts as empty, and is kept by the first stage; a null id is an id like others; very
long texts are read whole; an empty table gives an empty one; further columns, whatever their names, go
along unchanged (the last stage leaves them out). Where rows tie or repeat, each stage says what it does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import is_written, one_of_each, remove, shared_folder, table, unused
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.mixing import mixed
from graphloom.llm.packing import PIECE_SCHEMA, pack, write_buckets
from graphloom.llm.simhash import first_of_groups, simhash_groups
from graphloom.llm.toxicity import scorer, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic; it learns from the labels of those it gets.

    Equal texts have equal scores, so repeated rows stay or go together. Without labels all stay.
    """
    score = scorer(spark, *train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id (null ids are the smallest).

    Of rows with that id and text the first in the order of all columns stays.
    """
    key = unused("__digest", docs)
    kept = exact_dedup(docs).where("kept").select("doc_id", F.unhex("text_sha256").alias(key))
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return one_of_each(keyed, kept, also=(key,)).select(*(f"`{c}`" for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Of rows with that id the one whose text has the smallest hash stays, and of equal texts the first in the
    order of all columns; texts without words are one group.
    """
    key = unused("__key", docs)
    kept = first_of_groups(simhash_groups(docs)).withColumnRenamed("text_key", key)
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return one_of_each(keyed, kept, also=(key,)).select(*(f"`{c}`" for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them (copies are equal rows), shard by shard in each file.

    Documents without words are left out, as they add nothing to a target. Rows with one id and text are told apart by
    their other columns, in order.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence of its own, with their token ids; repeated rows are packed each."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


#: What the last stage returns.
SEQUENCE_SCHEMA = f"{PIECE_SCHEMA}, sequence_id long, offset long, ids_crc32 long"

STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mix), ("packing", packing)]

#: No SQL can say what the classifier and the hashes decide; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The sequences of ``documents`` after all stages, stored by bucket (sequences of one length).

    folder: where stages are written (a new one in the shared folder). A run that failed goes on after its
    last whole stage if it is given the same folder; the stage before a whole one is removed.
    """
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"

    def stored(k: int) -> DataFrame:  # a table by bucket has no file, and so no schema, if it is empty
        reader = spark.read if k < len(STAGES) - 1 else spark.read.schema(SEQUENCE_SCHEMA)
        return reader.parquet(f"{folder}/{k}")

    whole = [k for k in range(len(STAGES)) if is_written(spark, f"{folder}/{k}")]
    docs = stored(max(whole)) if whole else table(spark, sf_dir, "documents")
    for k in range(max(whole, default=-1) + 1, len(STAGES)):
        name, stage = STAGES[k]
        remove(spark, f"{folder}/{k}")  # what a failed run left
        try:
            out = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                out.write.parquet(f"{folder}/{k}")
            else:
                write_buckets(out, f"{folder}/{k}")
        except Exception as e:
            e.add_note(f"The stage {name} failed; run(spark, sf_dir, {folder!r}) goes on from there.")
            raise
        docs = stored(k)
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
