"""New links between nodes two hops apart."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.providers import Providers
from graphloom.functions.text import path_text, strip
from graphloom.operators.graph import active, around, neighbours, two_hops
from graphloom.schema import provenance, shaped, stable_id
from graphloom.session import durable, in_order

#: Fixed values.
MOST_NEW, NEW_WEIGHT, SEED_SHARE = 20, 0.5, 10
#: Pairs that a round asks first, and seeds that it looks around first.
FIRST_BATCH, FIRST_SEEDS = 200, 64


def top_share(nodes: DataFrame, share: int = SEED_SHARE) -> DataFrame:
    """(id, weight): the heaviest tenth of the active nodes, one at least, ties by their order."""
    live = active(nodes).select("id", "weight", "seq")
    n = live.agg(F.greatest(F.lit(1), F.floor(F.count("*") / F.lit(share))).cast("int").alias("n")).first()["n"]
    return in_order(live, [F.col("weight").desc(), "seq", "id"], "__place").where(F.col("__place") <= n).select("id", "weight")


def seeds(nodes: DataFrame, merged: DataFrame | None) -> DataFrame:
    """(id): nodes that were merged in this pass, and the heaviest tenth."""
    own = top_share(nodes).select("id")
    return own if merged is None else own.union(merged.select("id").join(nodes.select("id"), "id", "left_semi")).distinct()


def untried(nodes: DataFrame, edges: DataFrame, seeds_: DataFrame, tried: DataFrame | None, among: DataFrame | None = None, near: DataFrame | None = None, remotes: DataFrame | None = None) -> DataFrame:
    """(seed_id, mid_id, remote_id): pairs at distance two that weren't tried before, in no order; see pairs_to_ask()."""
    order = nodes.select("id", "seq").distinct().join((seeds_ if among is None else among).select("id").distinct(), "id", "left_semi")
    rows = two_hops(nodes, edges, seeds_, near, order, remotes)  # a pair with an edge is at distance one
    if tried is None:
        return rows
    rows = rows.withColumn("low", F.least("seed_id", "remote_id")).withColumn("high", F.greatest("seed_id", "remote_id"))
    return rows.join(tried.select("low", "high"), ["low", "high"], "left_anti").select("seed_id", "mid_id", "remote_id")


def pairs_to_ask(nodes: DataFrame, edges: DataFrame, seeds_: DataFrame, tried: DataFrame | None, among: DataFrame | None = None, near: DataFrame | None = None, remotes: DataFrame | None = None) -> DataFrame:
    """(seed_id, mid_id, remote_id, low, high, place): pairs at distance two that weren't tried before, in the order of seeds and remotes.

    A pair that two seeds reach from either end is asked once, by the seed that came first. among: all seeds
    (id), where seeds_ is a part of them; near, remotes: see two_hops().
    """
    rows = untried(nodes, edges, seeds_, tried, among, near, remotes)
    rows = rows.withColumn("low", F.least("seed_id", "remote_id")).withColumn("high", F.greatest("seed_id", "remote_id"))
    order = nodes.select("id", "seq").distinct()
    rows = rows.join(order.select(F.col("id").alias("seed_id"), F.col("seq").alias("s1")), "seed_id").join(order.select(F.col("id").alias("remote_id"), F.col("seq").alias("s2")), "remote_id")
    return in_order(durable(rows), ["s1", "s2", "seed_id", "remote_id"], "place").drop("s1", "s2")  # sorting reads it twice


def accepted(answers: DataFrame) -> DataFrame:
    """Answers (holds, what, why, edge_type, ...) that hold and say what and why. ``holds`` is a boolean: a text that says false is false."""
    what, why, kind = strip(F.coalesce("what", F.lit(""))), strip(F.coalesce("why", F.lit(""))), strip(F.coalesce("edge_type", F.lit("RELATED_TO")))
    rows = answers.withColumn("what", what).withColumn("why", why).withColumn("edge_type", F.when(kind == "", "RELATED_TO").otherwise(kind))
    return rows.where(F.coalesce(F.col("holds"), F.lit(False)) & (F.col("what") != "") & (F.col("why") != ""))


def first_accepted(answers: DataFrame, most: int = MOST_NEW) -> DataFrame:
    """The first ``most`` accepted answers by ``place``."""
    return accepted(answers).orderBy("place").limit(most)


#: What a linker is shown of a node.
SHOWN = ["id", "type", "label", "summary", "version"]
ANSWERS = "place long, seed_id string, mid_id string, remote_id string, low string, high string, holds boolean, what string, why string, edge_type string, error string"


def _fitting(nodes: DataFrame, seeds_: DataFrame, near: DataFrame | None, edges: DataFrame, providers: Providers) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(seeds, remotes, neighbours) that a round needs: all, or those that the linker says it takes (see providers.takes()).

    A pair is still asked by the seed that came first of all seeds; so the pairs left out are those that the
    linker, when asked, would refuse.
    """
    if not hasattr(providers.link, "seed_fits"):
        return seeds_, None, durable(neighbours(nodes, edges)) if near is None else near
    node = F.struct(*SHOWN)
    own = seeds_.select("id").join(nodes.where(providers.link.seed_fits(node)).select("id"), "id", "left_semi")
    own, remotes = durable(own), durable(nodes.where(providers.link.remote_fits(node)).select("id"))
    return own, remotes, durable(around(edges, own.union(remotes))) if near is None else near


def _with_paths(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` with the nodes of their paths: n_seed_id, n_mid_id, n_remote_id."""
    node = lambda c: nodes.select(F.col("id").alias(c), F.struct(*SHOWN).alias(f"n_{c}"))
    return pairs.join(node("seed_id"), "seed_id").join(node("mid_id"), "mid_id").join(node("remote_id"), "remote_id")


def answers(pairs: DataFrame, nodes: DataFrame, providers: Providers) -> DataFrame:
    """``pairs`` (see pairs_to_ask()) with the linker's verdict, written down. A linker that fails doesn't hold, and says why in ``error``."""
    ask, keys = providers.link, ["place", "seed_id", "mid_id", "remote_id", "low", "high"]

    def said(batches):
        for part in batches:
            out = []
            for r in part.itertuples():
                try:
                    v, error = ask(dict(r.n_seed_id), dict(r.n_remote_id), r.path_text), None
                except Exception as e:  # noqa: BLE001
                    v, error = {}, str(e)[:120]
                holds = v.get("holds")
                holds = holds.strip().lower() == "true" if isinstance(holds, str) else bool(holds)
                out.append((holds, *(None if v.get(k) is None else str(v[k]) for k in ("what", "why", "edge_type")), error))
            verdicts = pd.DataFrame(out, columns=["holds", "what", "why", "edge_type", "error"])
            yield pd.concat([part[keys].reset_index(drop=True), verdicts], axis=1)

    path = F.array("n_seed_id", "n_mid_id", "n_remote_id")
    shown = _with_paths(pairs.select(*keys), nodes).select(*keys, "n_seed_id", "n_remote_id", path_text(path).alias("path_text"))
    return durable(shown.mapInPandas(said, ANSWERS))


def link_round(nodes: DataFrame, edges: DataFrame, seeds_: DataFrame, tried: DataFrame | None, providers: Providers, pass_id: str, now: Column, most: int = MOST_NEW, near: DataFrame | None = None) -> dict:
    """One round: edges with the new ones, the new ones, tried pairs (both are unions of what was written down), neighbours, and counts.

    Pairs are asked in order until the round's quota is full: those of FIRST_SEEDS seeds and then of ever
    more are found, and FIRST_BATCH pairs and then ever more are asked, so that a quota that fills early
    leaves most pairs unfound. Pairs after the one that fills it stay untried and may come again; links made
    in this round open new pairs in the next. Pairs that the linker says it never takes aren't made, nor counted as asked.
    """
    mine, remotes, near = _fitting(nodes, seeds_, near, edges, providers)
    turns = in_order(nodes.join(mine.select("id").distinct(), "id", "left_semi").select("id", "seq"), ["seq", "id"], "turn").select("id", "turn")
    n_seeds, looked, wide, size, places, found, parts = turns.count(), 0, FIRST_SEEDS, FIRST_BATCH, 0, 0, []
    while looked < n_seeds and found < most:
        own = turns.where(F.col("turn").between(looked + 1, looked + wide))
        pairs = pairs_to_ask(nodes, edges, own, tried, seeds_, near, remotes)
        n, upto = pairs.count(), 0
        while upto < n and found < most:
            part = pairs.where(F.col("place").between(upto + 1, upto + size)).withColumn("place", F.col("place") + places)
            parts.append(answers(part, nodes, providers))
            found += accepted(parts[-1]).count()
            upto, size = upto + size, size * 4
        looked, wide, places = looked + wide, wide * 8, places + n
    if not parts:  # no pairs
        parts.append(nodes.sparkSession.createDataFrame([], ANSWERS))
    asked = reduce(DataFrame.union, parts)
    good = _with_paths(first_accepted(asked, most), nodes)
    good = durable(good.withColumn("path", F.array("n_seed_id", "n_mid_id", "n_remote_id")).drop("n_seed_id", "n_mid_id", "n_remote_id"))
    added, until = good.agg(F.count("*"), F.max("place")).first()
    if added >= most:
        done, n_done = asked.where(F.col("place") <= until), until  # places are dense, from 1
    else:
        done, n_done = asked, places
    label = lambda i: F.col("path")[i]["label"]
    last = edges.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    new = good.crossJoin(F.broadcast(last)).select(  # one row
        stable_id("l-", F.lit(pass_id), F.col("seed_id"), F.col("remote_id"), F.col("edge_type")).alias("id"), F.col("seed_id").alias("source_id"), F.col("remote_id").alias("target_id"),
        F.col("edge_type").alias("type"), F.lit(NEW_WEIGHT).alias("weight"), now.alias("created_at"), now.alias("last_reinforced"),
        provenance("derived", operation_id=F.concat(F.lit(f"{pass_id}:link:"), label(0), F.lit("->"), label(2)), operation_type=F.lit("traversal"), inputs=F.transform("path", lambda n: F.struct(n["id"].alias("id"), n["version"].alias("version"))), derived_at=now, llm_run_id=F.lit(pass_id)).alias("provenance"),
        (F.col("last") + F.col("place")).alias("seq"), "what", "why", F.concat(label(0), F.lit(" -["), F.col("edge_type"), F.lit("]-> "), label(2)).alias("summary"),
    )
    keys = done.select("low", "high")
    tried = keys if tried is None else tried.select("low", "high").union(keys)
    if added:
        new = durable(new)
        edges = edges.unionByName(shaped(new, edges.schema))
        ends = new.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
        near = near.union(ends).union(ends.select("other", "id"))  # none were neighbours before
    return {"edges": edges, "new": new, "tried": tried, "near": near, "asked": n_done, "added": added, "failed": done.where("error is not null")}
