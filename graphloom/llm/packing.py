"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of n (lengths over the
sequence limit repeat the limit), the longest first. Each piece is a sequence of its own, so that no
sequence crosses documents and none needs padding, and sequences of one length form a bucket from which
batches are drawn. No row leaves its task: nothing is shuffled, and a hot document is only a long one.

Token ids are those of the byte-level BPE of the vocabulary file that ``tokenizers`` reads (its ``.json``).
They are computed with ``tiktoken`` from the same vocabulary as ranks, which gives the same ids (tested)
in a fifth of the time. The file's added tokens have their own ids wherever they stand in a text, as there.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

MAX_LENGTH = 1024
END_OF_DOCUMENT = 0
VOCABULARY = "byte_bpe_50k"
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())])


def vocabulary_path(name: str, kind: str) -> str:
    """The place of a vocabulary's file (kind: json or tiktoken) on the machine that asks. name: of a public vocabulary, or a path without ending."""
    import public_tokenizers

    return f"{name}.{kind}" if "/" in name else public_tokenizers.path(f"{name}.{kind}")


@lru_cache(4)
def encoder(name: str = VOCABULARY):
    """The encoder of a vocabulary: its ranks, and the added tokens that its ``.json`` names."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name, "json"), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take in what stands beside them are not known here")
    with open(vocabulary_path(name, "tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {t["content"]: t["id"] for t in added}
    ranks = {token: rank for token, rank in ranks.items() if rank not in special.values()}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids of a whole text; null counts as empty."""
    return encoder(vocabulary).encode(text or "", allowed_special="all")


def piece_lengths(n: int, limit: int = MAX_LENGTH) -> list[int]:
    """Powers of two with sum n, none above ``limit`` (a power of two), the longest first."""
    whole, rest = divmod(n, limit)
    return [limit] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.array([*token_ids(text.as_py(), vocabulary), END_OF_DOCUMENT], "<u4")
            start = 0
            for length in piece_lengths(len(ids), limit):
                rows.append((doc_id, start, length, len(ids), length.bit_length() - 1, ids[start : start + length].tobytes()))
                start += length
            held += len(ids)
            if held > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = MAX_LENGTH) -> DataFrame:
    """One row per piece, each a whole sequence: doc_id, start, length, doc_tokens, bucket, ids, sequence_id, offset.

    ids: the piece's token ids as little-endian unsigned 32-bit integers. bucket: log2 of the length.
    sequence_id: unique, not dense. offset: 0, as a sequence holds one piece.

    A null or empty text has the one token that ends a document; repeated rows are packed each for
    themselves; null ids stay null; an empty table gives no rows; extra columns are not read; a very
    long text is encoded whole, in the memory of one task.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(lambda it: _pieces(it, vocabulary, limit), PIECE_SCHEMA)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store sequences by bucket: a folder holds sequences of one length, from which a batch can be drawn without padding."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_pack_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
