"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and cut from its lineage.

    See shared_folder() for the folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a one-machine session gets a temporary one; on a cluster that is an error, as executors
    would not share it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="graphloom-")


def in_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3, ... in the given order; written down.

    The sort is by ranges, spread over tasks, and the tasks' counts (a row each, broadcast) make the numbers
    dense; a window without a key would do it in one task.
    """
    rows = durable(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    found = rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1)
    return found.drop("__at", "__part", "__first", "__before")
