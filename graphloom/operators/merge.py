"""Merging of nodes that name one thing: candidates, verdicts, a matching, the merge itself."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.providers import Providers
from graphloom.functions.text import CHARS_A_TOKEN, DETAIL_CAP, SUMMARY_CAP, truncate
from graphloom.operators.graph import active, incident, marked, migrate, neighbours
from graphloom.operators.similarity import neighbour_jaccard, self_top_k
from graphloom.schema import provenance, shaped, stable_id
from graphloom.session import durable, in_order

#: Fixed values.
TOP, JACCARD, COSINE, COSINE_SAME_TYPE, MOST_ROUNDS, CAVEAT_FACTOR = 5, 0.3, 0.85, 0.55, 10, 0.9
JUDGED_NEIGHBOURS, JUDGED_DETAIL, JUDGED_SUMMARY = 20, 2000, 120


def drop_ghosts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` without those that were merged before and have no edge left."""
    old = nodes.where(F.col("merged_into").isNotNull()).select("id")
    if not (n := old.count()):
        return nodes
    touched = marked(incident(edges).select(F.col("node_id").alias("id")), "id", old, n).distinct()
    gone = old.join(touched, "id", "left_anti")
    return nodes.join(gone, "id", "left_anti")


def candidates(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, jaccard: float = JACCARD, cosine: float = COSINE, same_type: float = COSINE_SAME_TYPE, top: int = TOP, nearest=self_top_k, near: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, sim, jac, rank) to be judged, ``rank`` rising in the order of judging. vectors: (id, vector).

    nearest: what finds the top lists; similarity.window_top_k for graphs too large for all pairs. near: the
    neighbours() of the nodes that have vectors, where they are at hand.

    Only pairs in the top list of one of the two are looked at; negative similarities don't count. A pair
    is written from the end that came first among the nodes that list it; the order is that node's, then
    the place in its list.
    """
    live = active(nodes).select("id", "type", "seq")
    lists = durable(nearest(vectors.join(live, "id", "left_semi"), top).where("sim >= 0"))
    rows = lists.join(live, "id").withColumnRenamed("type", "ta").join(live.select(F.col("id").alias("other"), F.col("type").alias("tb")), "other")
    rows = neighbour_jaccard(rows.withColumnRenamed("id", "a").withColumnRenamed("other", "b"), neighbours(nodes, edges, vectors) if near is None else near)
    fits = (F.col("sim") >= cosine) | (F.col("jac") >= jaccard) | ((F.col("ta") == F.col("tb")) & (F.col("sim") >= same_type))
    rows = rows.where(fits).withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b"))
    first = rows.groupBy("low", "high").agg(F.min_by(F.struct("a", "b", "sim", "jac", "seq", "rank"), F.struct("seq", "rank", "a")).alias("r")).select("r.*")
    return in_order(first, ["seq", "rank", "a"], "rank").select("a", "b", "sim", "jac", "rank")


def judge_rows(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``pairs`` with what a judge is shown of each node, as structs na and nb: id, type, label, summary, detail (cut), neighbours (20 at most), n_neighbours."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    near = neighbours(nodes, edges, ids) if near is None else near.join(ids, "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("id").orderBy("seq", "other"))
    first = near.join(nodes.select(F.col("id").alias("other"), "seq"), "other").withColumn("place", place).where(F.col("place") <= JUDGED_NEIGHBOURS)
    said = F.concat("label", F.lit(": "), F.substring("summary", 1, JUDGED_SUMMARY))
    first = first.select("id", "other", "place").join(nodes.select(F.col("id").alias("other"), said.alias("said")), "other")
    first = first.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "said"))).alias("s"))
    near = near.groupBy("id").agg(F.count("*").alias("n")).join(first, "id")
    shown = nodes.join(ids, "id", "left_semi").join(near, "id", "left")
    node = F.struct("id", "type", "label", "summary", F.substring("detail", 1, JUDGED_DETAIL).alias("detail"), F.coalesce(F.transform("s", lambda x: x["said"]), F.array().cast("array<string>")).alias("neighbours"), F.coalesce("n", F.lit(0)).alias("n_neighbours"))
    shown = shown.select(F.col("id").alias("__id"), node.alias("__node"))
    out = pairs.join(shown.select(F.col("__id").alias("a"), F.col("__node").alias("na")), "a")
    return out.join(shown.select(F.col("__id").alias("b"), F.col("__node").alias("nb")), "b")


def verdicts(pairs: DataFrame, providers: Providers) -> DataFrame:
    """(a, b, rank, verdict, why) of judged pairs (see judge_rows()), written down so that no pair is asked twice. A judge that fails says ``error``."""
    ask = providers.judge

    def judged(batches):
        for part in batches:
            out = []
            for r in part.itertuples():
                try:
                    verdict, why = ask(dict(r.na), dict(r.nb))
                except Exception as e:  # noqa: BLE001  whatever a judge raises is its verdict
                    verdict, why = "error", str(e)[:120]
                out.append((r.a, r.b, r.rank, str(verdict).lower(), why))
            yield pd.DataFrame(out, columns=["a", "b", "rank", "verdict", "why"])

    return durable(pairs.select("a", "b", "rank", "na", "nb").mapInPandas(judged, "a string, b string, rank long, verdict string, why string"))


#: Pairs that one task goes through in order.
FEW_PAIRS = 100_000


def _one_by_one(batches):
    rows, used = pd.concat(list(batches)).sort_values("rank"), set()
    won = []
    for r in rows.itertuples(index=False):
        won.append(not {r.a, r.b} & used)
        if won[-1]:
            used |= {r.a, r.b}
    yield rows[won]


def matching(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, rank) those that going through them by rank would take, each node once.

    A pair that has the lowest rank at both of its nodes is taken for certain; its nodes' other pairs go;
    and so on. A round is a few joins, and takes the lowest rank of all at least. When FEW_PAIRS or fewer are
    left, one task goes through them.
    """
    left, taken = durable(pairs.select("a", "b", "rank")), []
    while n := left.count():
        if n <= FEW_PAIRS:
            taken.append(durable(left.repartition(1).mapInPandas(_one_by_one, left.schema)))
            break
        at = left.select(F.explode(F.array("a", "b")).alias("id"), "rank").groupBy("id").agg(F.min("rank").alias("low"))
        low_a, low_b = at.select(F.col("id").alias("a"), F.col("low").alias("la")), at.select(F.col("id").alias("b"), F.col("low").alias("lb"))
        won = durable(left.join(low_a, "a").join(low_b, "b").where("rank = la and rank = lb").select("a", "b", "rank"))
        taken.append(won)
        ids = won.select(F.explode(F.array("a", "b")).alias("id"))
        left = durable(left.join(ids.withColumnRenamed("id", "a"), "a", "left_anti").join(ids.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "rank"))
    return reduce(DataFrame.union, taken) if taken else left


def judged_in_order(judged: DataFrame, matched: DataFrame) -> DataFrame:
    """The verdicts that going through the pairs would have reached: those of pairs none of whose nodes was merged before."""
    at = matched.select(F.explode(F.array("a", "b")).alias("id"), F.col("rank").alias("when"))
    rows = judged.join(at.select(F.col("id").alias("a"), F.col("when").alias("wa")), "a", "left").join(at.select(F.col("id").alias("b"), F.col("when").alias("wb")), "b", "left")
    return rows.where("rank <= coalesce(wa, rank) and rank <= coalesce(wb, rank)").select(*judged.columns)


def histogram(judged: DataFrame) -> DataFrame:
    """(verdict, n): the four usual verdicts always, others where they came."""
    usual = judged.sparkSession.createDataFrame([(v,) for v in ("same", "different", "same_with_caveats", "error")], "verdict string")
    return usual.withColumn("n", F.lit(0)).unionByName(judged.select("verdict", F.lit(1).alias("n"))).groupBy("verdict").agg(F.sum("n").alias("n"))


def decay_caveats(nodes: DataFrame, judged: DataFrame) -> DataFrame:
    """``nodes`` whose weight lost a tenth for each caveat that they were judged with."""
    hits = judged.where("verdict = 'same_with_caveats'").select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("__n"))
    out = nodes.join(hits, "id", "left")
    return out.withColumn("weight", F.when(F.col("__n") > 0, F.col("weight") * F.pow(F.lit(CAVEAT_FACTOR), F.col("__n"))).otherwise(F.col("weight"))).select(*nodes.columns)


def fused(pairs: DataFrame, providers: Providers) -> DataFrame:
    """(a, b, fused_summary, reconciliation) of matched pairs with na and nb; written down."""
    ask = providers.fuse

    def both(batches):
        for part in batches:
            rows = [(r.a, r.b, *ask(dict(r.na), dict(r.nb))) for r in part.itertuples()]
            yield pd.DataFrame(rows, columns=["a", "b", "fused_summary", "reconciliation"])

    return durable(pairs.select("a", "b", "na", "nb").mapInPandas(both, "a string, b string, fused_summary string, reconciliation string"))


def merge_nodes(nodes: DataFrame, matched: DataFrame, fusions: DataFrame, pass_id: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes with the new ones and the merged ones marked, remap of old_id to new_id).

    The heavier node (the first, if equal) gives type and label; weights add up; the new nodes come last.
    """
    side = lambda c: nodes.select(F.col("id").alias(c), F.struct("type", "label", "detail", "weight", "version").alias(f"n{c}"))
    rows = matched.join(side("a"), "a").join(side("b"), "b").join(fusions, ["a", "b"])
    a, b = F.col("na"), F.col("nb")
    heavy = a["weight"] >= b["weight"]
    main, minor = F.when(heavy, a).otherwise(b), F.when(heavy, b).otherwise(a)
    detail = F.concat(a["detail"], F.lit("\n\n---\n"), b["detail"], F.lit("\n\nReconciliation: "), F.col("reconciliation"))
    last = nodes.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    new = rows.crossJoin(F.broadcast(last)).select(  # one row
        stable_id("m-", F.lit(pass_id), F.col("a"), F.col("b")).alias("id"), main["type"].alias("type"), main["label"].alias("label"),
        F.substring("fused_summary", 1, SUMMARY_CAP * CHARS_A_TOKEN).alias("summary"), truncate(detail, DETAIL_CAP).alias("detail"), (a["weight"] + b["weight"]).alias("weight"), now.alias("created_at"),
        provenance("derived", operation_id=F.concat(F.lit(f"{pass_id}:merge:"), main["label"], F.lit("+"), minor["label"]), operation_type=F.lit("merge"),
                   inputs=F.array(F.struct(F.col("a").alias("id"), a["version"].alias("version")), F.struct(F.col("b").alias("id"), b["version"].alias("version"))), derived_at=now, llm_run_id=F.lit(pass_id)).alias("provenance"),
        (F.col("last") + F.col("rank")).alias("seq"), "a", "b",
    )
    new = durable(new)
    remap = new.select(F.explode(F.array("a", "b")).alias("old_id"), F.col("id").alias("new_id"))
    marked = nodes.join(remap.select(F.col("old_id").alias("id"), "new_id"), "id", "left").withColumn("merged_into", F.coalesce("new_id", "merged_into")).select(*nodes.columns)
    return marked.unionByName(shaped(new, nodes.schema)), remap


def merge_round(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, providers: Providers, pass_id: str, now: Column, **thresholds) -> dict:
    """One round: the new nodes and edges, the merged pairs with their new ids, the verdicts, and counts for the log."""
    near = durable(neighbours(nodes, edges, vectors))
    pairs = candidates(nodes, edges, vectors, near=near, **thresholds)
    n = pairs.count()
    shown = judge_rows(pairs, nodes, edges, near)
    judged = verdicts(shown, providers)
    matched = matching(judged.where("verdict = 'same'"))
    judged = durable(judged_in_order(judged, matched))
    found = {r["verdict"]: r["n"] for r in histogram(judged).collect()}  # a row a kind of verdict
    n_merged = found["same"]  # each that is reached in order is taken
    if found["same_with_caveats"]:
        nodes = durable(decay_caveats(nodes, judged))
    remap = None
    if n_merged:
        fusions = fused(shown.join(matched.select("a", "b"), ["a", "b"], "left_semi"), providers)
        nodes, remap = merge_nodes(nodes, matched, fusions, pass_id, now)
        nodes, edges = durable(nodes), durable(migrate(edges, remap))
    return {"nodes": nodes, "edges": edges, "judged": judged, "matched": matched, "remap": remap, "candidates": n, "merged": n_merged, "verdicts": found}
