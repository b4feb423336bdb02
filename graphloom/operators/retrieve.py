"""Retrieval: top-k seeds, one hop of neighbours, a token budget, the edges among what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import CONTEXT_BUDGET, HISTORY_BUDGET, context_line, count_tokens
from graphloom.operators.graph import expand


def budget_prefix(expanded: DataFrame, nodes: DataFrame, budget: int = CONTEXT_BUDGET, tokens=count_tokens) -> DataFrame:
    """(query_id, id, hop, via, line, tokens, place, used) of the nodes that fit a budget.

    Nodes come in the order seeds by rank, then neighbours by the lowest rank of a seed, then id. The
    first line that would pass the budget ends the context, and tokens are never negative, so the running
    sum decides. A window holds the neighbourhood of one query.
    """
    line = context_line(F.col("type"), F.col("label"), F.col("summary"))
    rows = expanded.join(nodes.select("id", "type", "label", "summary"), "id").withColumn("line", line)
    order = Window.partitionBy("query_id").orderBy("hop", "via", "id")
    rows = rows.withColumn("tokens", tokens(F.col("line"))).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("used") <= budget).select("query_id", "id", "hop", "via", "line", "tokens", "place", "used")


def retrieve(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int = CONTEXT_BUDGET) -> tuple[DataFrame, DataFrame]:
    """(context nodes, edges with both ends in the context of one query) for seeds (query_id, id, rank)."""
    included = budget_prefix(expand(nodes, edges, seeds), nodes, budget)
    ids = included.select("query_id", F.col("id").alias("source_id"))
    touched = edges.select(F.col("id").alias("edge_id"), "source_id", "target_id").join(ids, "source_id")
    both = touched.join(included.select("query_id", F.col("id").alias("target_id")), ["query_id", "target_id"])
    return included, both.select("query_id", "edge_id", "source_id", "target_id")


def traversal_records(included: DataFrame, touched: DataFrame, seeds: DataFrame, questions: DataFrame, ts) -> DataFrame:
    """Log records of retrievals, one a query: questions (query_id, question); ids sorted, seeds in rank order."""
    s = seeds.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("seed_node_ids"))
    n = included.groupBy("query_id").agg(F.sort_array(F.collect_set("id")).alias("touched_node_ids"))
    e = touched.groupBy("query_id").agg(F.sort_array(F.collect_set("edge_id")).alias("touched_edge_ids"))
    none = F.array().cast("array<string>")
    rows = questions.join(s, "query_id", "left").join(n, "query_id", "left").join(e, "query_id", "left")
    return rows.select(ts.cast("string").alias("ts"), F.lit("graph_query").alias("kind"), "question", *(F.coalesce(c, none).alias(c) for c in ("seed_node_ids", "touched_node_ids", "touched_edge_ids")))


def citations(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, rank, id, label) of all seeds, also of those that the budget cut."""
    return seeds.join(nodes.select("id", "label"), "id").select("query_id", "rank", "id", "label")


def history_window(turns: DataFrame, budget: int = HISTORY_BUDGET, tokens=count_tokens) -> DataFrame:
    """The newest turns (conv_id, turn, text, ...) of each conversation whose tokens fit the budget, as ``kept_tokens`` counts from the end."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("kept_tokens", F.sum(tokens(F.col("text"))).over(newest)).where(F.col("kept_tokens") <= budget)
