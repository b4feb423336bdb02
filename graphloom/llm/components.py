"""Connected components of a link table, as alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable


def _stars(arcs: DataFrame) -> DataFrame:
    """For each (u, v) of ``arcs`` the smallest v of u, or u if that is smaller, as ``m``.

    The smallest is found with a partial aggregate, so a hub sends one row a task; the join back has
    one row a node on one side, which lets adaptive execution split a hub's links among tasks.
    """
    low = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(low, "u")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for each node of ``links`` (two long columns): the smallest node that it reaches.

    Self-links and null ends are left out; repeated links don't matter; no links give no rows. Each
    round is written to the checkpoint folder. Rounds end when a round changes nothing; as a round can only
    lower what a node is linked to, that comes.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = durable(edges)
    state = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    seen = edges.agg(state.alias("s")).first()["s"]
    while seen["n"]:
        both = edges.union(edges.select("v", "u"))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _stars(large.distinct()).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = durable(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
        now = edges.agg(state.alias("s")).first()["s"]
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
