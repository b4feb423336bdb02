"""Reinforcement: usage of edges raises their weight, every pass lowers all, nodes take the mean of their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import few, incident, marked

#: Fixed values.
PER_TRAVERSAL, PER_CITATION, DECAY = 0.01, 0.02, 0.95


def traverse_hits(log: DataFrame) -> DataFrame:
    """(edge_id, traversed): how often each edge id stands in the log; repeats in a record count, and so do edges that are gone."""
    return log.select(F.explode("touched_edge_ids").alias("edge_id")).groupBy("edge_id").agg(F.count("*").alias("traversed"))


def cite_hits(log: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, cited): how often an existing edge stands in a record that has one of its ends as a seed."""
    touched = log.select("seed_node_ids", F.explode("touched_edge_ids").alias("edge_id"))
    found = touched.join(edges.select(F.col("id").alias("edge_id"), "source_id", "target_id"), "edge_id")
    seed = F.array_contains("seed_node_ids", F.col("source_id")) | F.array_contains("seed_node_ids", F.col("target_id"))
    return found.where(seed).groupBy("edge_id").agg(F.count("*").alias("cited"))


def reinforce_edges(edges: DataFrame, log: DataFrame) -> DataFrame:
    """``edges`` with new weights: (w + 0.01 traversed + 0.02 cited) x 0.95, for every edge."""
    hit = traverse_hits(log).withColumnRenamed("edge_id", "id")
    cited = cite_hits(log, marked(edges, "id", hit.select("id"), hit.count())).withColumnRenamed("edge_id", "id")
    hits = few(hit.join(cited, "id", "left"))
    gain = F.coalesce("traversed", F.lit(0)) * PER_TRAVERSAL + F.coalesce("cited", F.lit(0)) * PER_CITATION
    out = edges.join(hits, "id", "left").withColumn("weight", (F.col("weight") + gain) * DECAY)
    return out.select(*edges.columns)


def reinforce_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` whose weight is the mean weight of their edges (an edge to itself twice); without edges it stays."""
    means = incident(edges).groupBy(F.col("node_id").alias("id")).agg(F.avg("weight").alias("__mean"))
    out = nodes.join(means, "id", "left").withColumn("weight", F.coalesce("__mean", "weight"))
    return out.select(*nodes.columns)


def reinforce(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = reinforce_edges(edges, log)
    return reinforce_nodes(nodes, edges), edges
