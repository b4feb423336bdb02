"""The graph's tables: nodes, edges, the traversal log and the pass log.

Every table of nodes or edges has ``seq``, the order in which rows came; what depends on order uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _I, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODE_REF = _struct(id=_S, version=_I)
#: One struct for all kinds of provenance; ``kind`` says which fields count.
PROVENANCE = _struct(
    kind=_S, raw_doc_id=_S, line_or_span=_S, extraction_run_id=_S, user_id=_S, conversation_id=_S, turn_id=_S, classification=_S,
    operation_id=_S, operation_type=_S, inputs=T.ArrayType(NODE_REF), derived_at=_TS, llm_run_id=_S,
)
#: For each kind the fields that it must have.
PROVENANCE_FIELDS = {
    "direct": ("raw_doc_id", "extraction_run_id"),
    "user": ("user_id", "conversation_id", "turn_id", "classification"),
    "derived": ("operation_id", "operation_type", "inputs", "derived_at", "llm_run_id"),
}
RETRACTION = _struct(retracted_at=_TS, reason=_S, pass_id=_S)
NODE = _struct(
    id=_S, type=_S, label=_S, summary=_S, detail=_S, weight=_D, created_at=_TS, version=_I, provenance=PROVENANCE,
    suspicious=_B, suspicious_pass_count=_I, merged_into=_S, seq=_L,
)
EDGE = _struct(
    id=_S, source_id=_S, target_id=_S, type=_S, weight=_D, provenance=PROVENANCE, created_at=_TS, last_reinforced=_TS,
    retraction_log=T.ArrayType(RETRACTION), suspicious=_B, suspicious_pass_count=_I, seq=_L,
)
TRAVERSAL = _struct(ts=_S, kind=_S, question=_S, seed_node_ids=T.ArrayType(_S), touched_node_ids=T.ArrayType(_S), touched_edge_ids=T.ArrayType(_S))
PASS_EVENT = _struct(ts=_TS, kind=_S, pass_id=_S, summary=_S, payload=_S, seq=_L)

#: What a field holds when nothing says otherwise.
DEFAULTS = {
    "summary": "", "detail": "", "weight": 1.0, "version": 1, "suspicious": False, "suspicious_pass_count": 0,
}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the fields of ``schema``: those it lacks get their default, or null."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            value = F.col(f.name)
        elif f.name == "retraction_log":
            value = F.array()
        else:
            value = F.lit(DEFAULTS.get(f.name))
        cols.append(value.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def provenance(kind: str, **fields: Column) -> Column:
    """A provenance struct of the given kind; fields that aren't given are null."""
    unknown = set(fields) - set(PROVENANCE.names)
    if unknown or kind not in PROVENANCE_FIELDS:
        raise ValueError(f"{kind} provenance with {sorted(unknown)}")
    of = {"kind": F.lit(kind)} | fields
    return F.struct(*(of.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PROVENANCE.fields))


def bad_provenance(df: DataFrame) -> DataFrame:
    """Rows whose provenance lacks a field that its kind must have, or has an unknown kind or value."""
    p = F.col("provenance")
    ok = F.lit(False)
    for kind, fields in PROVENANCE_FIELDS.items():
        has = F.lit(True)
        for f in fields:
            has = has & p[f].isNotNull()
        if kind == "user":
            has = has & p["classification"].isin("experience", "supplement")
        if kind == "derived":
            has = has & p["operation_type"].isin("merge", "traversal")
        ok = ok | ((p["kind"] == kind) & has)
    return df.where(~F.coalesce(ok, F.lit(False)))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id made from what it names, so that a repeated task gives the same."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256), 1, 32))
