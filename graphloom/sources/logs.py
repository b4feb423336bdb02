"""The traversal log: JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import TRAVERSAL, empty
from graphloom.sources.store import TAKEN, read_or_none


def append_traversals(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def parsed(lines: DataFrame) -> DataFrame:
    """The records of lines (value). Blank lines, and those that aren't one JSON object from end to end, are passed over.

    Spark's parsers stop after a first value. In a list a line must be followed by a bracket and as a field's
    value by a brace, and what follows its object can't be both.
    """
    ends = (F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1) & F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").isNotNull()
    rows = lines.where(F.col("value").rlike(r"^\s*\{")).where(ends).select(F.from_json("value", TRAVERSAL).alias("r")).where("r is not null").select("r.*")
    none = F.array().cast("array<string>")
    return rows.select(*(F.coalesce(f.name, none).alias(f.name) if f.name.endswith("_ids") else F.col(f.name) for f in TRAVERSAL.fields))


def read_traversals(spark: SparkSession, path: str) -> DataFrame:
    """All records; a missing log is empty."""
    lines = read_or_none(spark, path, "text")
    return empty(spark, TRAVERSAL) if lines is None else parsed(lines)


def unread(spark: SparkSession, path: str, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of the files that aren't in ``taken``, those files); see Store.taken(). A file of the log is not changed once it is written.

    Files that come while the records are read are in neither.
    """
    lines = read_or_none(spark, path, "text")
    if lines is None:
        return empty(spark, TRAVERSAL), spark.createDataFrame([], TAKEN)
    rows = lines.select("value", F.col("_metadata.file_path").alias("name")).join(taken.select("name").distinct(), "name", "left_anti")
    return parsed(rows), rows.select("name", F.lit(0).cast("long").alias("upto")).distinct()
