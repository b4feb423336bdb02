"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_GOLDEN, _MUL_A, _MUL_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, its lineage cut; a lost executor loses none of it.

    The folder is the one named by ``spark.checkpoint.dir``. Only an unset folder of a one-machine
    session (as in tests) is replaced by a temporary one; an unset folder on a cluster is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where a one-machine session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="graphloom-")


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end there, on any file system that Spark reads."""
    files, at = _place(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _place(spark, path)
    files.delete(at, True)


#: Copies of a row that a task unfolds at once.
RUN = 4096


def unfolded(rows: DataFrame, n: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0 to ``n`` - 1, a row each; ``n`` is dropped. rows: written down, as they are read more than once.

    A row with more than RUN copies becomes runs of RUN first, which are dealt to all tasks, so that
    neither a list nor a task holds all copies of a row.
    """
    zero, most = F.lit(0).cast("long"), F.lit(RUN - 1).cast("long")
    if rows.where(F.col(n) > RUN).isEmpty():
        return rows.withColumn(name, F.explode(F.sequence(zero, F.col(n) - 1))).drop(n)
    few = rows.where(F.col(n) <= RUN).withColumn(name, F.explode(F.sequence(zero, F.col(n) - 1))).drop(n)
    runs = rows.where(F.col(n) > RUN).withColumn("__run", F.explode(F.sequence(zero, F.floor((F.col(n) - 1) / F.lit(RUN)))))
    runs = runs.repartition(*rows.columns, "__run")
    first = F.col("__run") * RUN
    many = runs.withColumn(name, F.explode(F.sequence(first, F.least(first + most, F.col(n) - 1)))).drop(n, "__run")
    return few.unionByName(many)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64) + np.uint64(_GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MUL_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MUL_B)
    return x ^ (x >> np.uint64(31))


def min_labels(m: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..m-1 and the links left[i]-right[i], each node's smallest reachable node."""
    lab = np.arange(m)
    while len(left):
        low = np.minimum(lab[left], lab[right])
        new = lab.copy()
        np.minimum.at(new, lab[left], low)
        np.minimum.at(new, lab[right], low)
        while True:  # pointer jumping
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        lab = new
        open_ = lab[left] != lab[right]
        left, right = left[open_], right[open_]
    return lab


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores before it until no column of the tables is called so."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def total_order(df: DataFrame) -> list[Column]:
    """All columns of ``df``, to sort by: rows that tie agree in every column. Types that can't be sorted are sorted as JSON."""
    odd = lambda kind: any(w in kind for w in ("map<", "variant"))
    return [F.to_json(F.struct(f"`{c}`")) if odd(kind) else F.col(f"`{c}`") for c, kind in df.dtypes]


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the given order (of columns that tell rows apart); written down.

    Rows are dealt to tasks by ranges; the tasks' counts, a row each, give offsets and are broadcast.
    """
    rows = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    found = rows.join(F.broadcast(offsets), "__part")
    return found.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before")


def one_of_each(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` whose id is in ``decisions`` (distinct ids, with the columns of ``also`` to match too).

    Of rows that agree in all of those columns one stays, the first in the order of all columns, so that
    repeated rows leave one and reruns leave the same. Ids may be null. The text of every row crosses the
    network once; the sort of the join serves the numbering.
    """
    keys = [id_col, *also]
    mark, place = {k: unused(f"__{k}", docs) for k in keys}, unused("__n", docs)
    marks = decisions.select(*(F.col(k).alias(mark[k]) for k in keys))
    on = F.col(id_col).eqNullSafe(F.col(mark[id_col]))
    for k in also:
        on = on & (F.col(k) == F.col(mark[k]))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*total_order(docs)))
    return docs.join(marks, on).withColumn(place, n).where(F.col(place) == 1).select(*(f"`{c}`" for c in docs.columns))


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from: crc32 of the id as text leaves 0 when divided by 5 (null ids: held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0
