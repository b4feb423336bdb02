"""Ingestion of documents and of statements: extraction replies become nodes and edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.providers import Providers
from graphloom.functions.text import INGEST_CAP, STATEMENT_CAP, SUMMARY_CAP, classify, count_tokens, parse_loose_json, strip, truncate
from graphloom.operators.graph import first_by_label
from graphloom.schema import EDGE, NODE, provenance, shaped, stable_id
from graphloom.session import durable, in_order

REPLY = "nodes array<struct<type:string,label:string,summary:string>>, edges array<struct<source_label:string,target_label:string,type:string>>"


def token_gate(docs: DataFrame, text_col: str = "text", cap: int = INGEST_CAP) -> DataFrame:
    """``docs`` with tokens and accepted: whether the text is within the cap (a text over it is refused, not cut)."""
    return docs.withColumn("tokens", count_tokens(F.col(text_col))).withColumn("accepted", F.col("tokens") <= cap)


def replies(texts: DataFrame, ask, text_col: str = "text") -> DataFrame:
    """``texts`` with the extractor's reply, parsed (see REPLY), as nodes and edges; replies that can't be parsed have none."""

    @F.pandas_udf(T.StringType())
    def said(column: pd.Series) -> pd.Series:
        return column.map(lambda t: ask(t or ""))

    parsed = F.from_json(parse_loose_json(said.asNondeterministic()(F.col(text_col)), '{"nodes": [], "edges": []}'), REPLY)
    return durable(texts.withColumn("__r", parsed)).select(*texts.columns, "__r.nodes", "__r.edges")


def extracted_nodes(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, type, label, summary): the extracted nodes that have a label; a missing type is Entity; summaries over their cap are cut."""
    out = rows.select(key, F.posexplode("nodes").alias("pos", "n"))
    label = strip(F.coalesce(F.col("n.label"), F.lit("")))
    summary = truncate(F.coalesce(F.col("n.summary"), F.lit("")), SUMMARY_CAP)
    return out.select(key, "pos", F.coalesce(F.col("n.type"), F.lit("Entity")).alias("type"), label.alias("label"), summary.alias("summary")).where("label <> ''")


def extracted_edges(rows: DataFrame, key: str) -> DataFrame:
    out = rows.select(key, F.posexplode("edges").alias("pos", "e"))
    return out.select(key, "pos", *(strip(F.coalesce(F.col(f"e.{c}"), F.lit(""))).alias(c) for c in ("source_label", "target_label")), F.coalesce(F.col("e.type"), F.lit("RELATED_TO")).alias("type"))


def _numbered(df: DataFrame, order: list, start: DataFrame) -> DataFrame:
    """``df`` with a rising ``seq`` after the last of ``start``."""
    last = start.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__last"))
    return in_order(df, order, "__n").crossJoin(F.broadcast(last)).withColumn("seq", F.col("__last") + F.col("__n")).drop("__n", "__last")  # one row


def ingest(nodes: DataFrame, edges: DataFrame, docs: DataFrame, run_id: str, now: Column, providers: Providers = Providers()) -> dict:
    """New nodes and edges of documents (doc_id, text), and counters a document.

    Documents over the cap are refused. Nodes are not matched with those of other documents, nor with
    each other: a label that comes twice in one document makes two nodes, of which edges take the last.
    Edges whose labels the document lacks are skipped.
    """
    gated = token_gate(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    rows = replies(gated.where("accepted"), providers.extract)
    found, links = durable(extracted_nodes(rows, "doc_id")), durable(extracted_edges(rows, "doc_id"))
    source = lambda: provenance("direct", raw_doc_id=F.col("doc_id"), extraction_run_id=F.lit(run_id))
    new = found.withColumn("id", stable_id("n-", F.lit(run_id), F.col("doc_id"), F.col("pos"))).withColumn("provenance", source()).withColumn("created_at", now)
    new_nodes = shaped(_numbered(new, ["doc_id", "pos"], nodes), NODE)
    last = new.groupBy("doc_id", "label").agg(F.max_by("id", "pos").alias("id"))
    end = lambda c: last.select("doc_id", F.col("label").alias(f"{c}_label"), F.col("id").alias(f"{c}_id"))
    resolved = durable(links.join(end("source"), ["doc_id", "source_label"], "left").join(end("target"), ["doc_id", "target_label"], "left"))
    whole = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    made = resolved.where(whole).withColumn("id", stable_id("e-", F.lit(run_id), F.col("doc_id"), F.col("pos"))).withColumn("provenance", source()).withColumn("created_at", now).withColumn("last_reinforced", now)
    new_edges = shaped(_numbered(made, ["doc_id", "pos"], edges), EDGE)
    counters = gated.select("doc_id", "accepted", "tokens")
    counters = counters.join(found.groupBy("doc_id").agg(F.countDistinct("label").alias("nodes_added")), "doc_id", "left")
    counters = counters.join(resolved.groupBy("doc_id").agg(F.count_if(whole).alias("edges_added"), F.count_if(~whole).alias("edges_skipped")), "doc_id", "left")
    counters = counters.select("doc_id", "accepted", "tokens", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes_added", "edges_added", "edges_skipped")))
    return {"nodes": nodes.unionByName(new_nodes), "edges": edges.unionByName(new_edges), "new_nodes": new_nodes, "new_edges": new_edges, "counters": counters}


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, (type, label, id, existed) of all): the first of ``new`` (type, label, summary, order, provenance, created_at) for each pair
    that no node has; a node that has it stays as it is, merged ones too."""
    first = new.groupBy("type", "label").agg(F.min_by(F.struct("summary", "provenance", "created_at", "order"), "order").alias("r")).select("type", "label", "r.*")
    have = nodes.groupBy("type", "label").agg(F.min_by("id", F.struct("seq", "id")).alias("id"))
    fresh = first.join(have, ["type", "label"], "left_anti").withColumn("id", stable_id("u-", F.col("type"), F.col("label")))
    add = shaped(_numbered(fresh.withColumn("summary", truncate(F.col("summary"), SUMMARY_CAP)), ["order", "type", "label"], nodes), NODE)
    known = first.select("type", "label").join(have, ["type", "label"]).withColumn("existed", F.lit(True))
    return add, known.unionByName(add.select("type", "label", "id", F.lit(False).alias("existed")))


def integrate(nodes: DataFrame, edges: DataFrame, statements: DataFrame, now: Column, providers: Providers = Providers()) -> dict:
    """New nodes and edges of users' statements (statement_id, text, user_id, conversation_id, turn_id), and counters a statement.

    Statements over the soft cap are compressed, then cut. Nodes are matched on type and label; edges are
    always added, between the last node of a label in the statement; edges without such ends are dropped.
    """
    shorten, kind = providers.compress, providers.classify

    @F.pandas_udf(T.StringType())
    def shorter(column: pd.Series) -> pd.Series:
        return column.map(lambda t: shorten(t or "", STATEMENT_CAP) or t)

    @F.pandas_udf(T.StringType())
    def said(column: pd.Series) -> pd.Series:
        return column.map(lambda t: kind(t or ""))

    long_ = count_tokens(F.col("text")) > STATEMENT_CAP
    rows = statements.withColumn("original_tokens", count_tokens(F.col("text"))).withColumn("compressed", long_)
    rows = rows.withColumn("text", F.when(long_, truncate(shorter.asNondeterministic()(F.col("text")), STATEMENT_CAP)).otherwise(F.col("text")))
    rows = durable(rows.withColumn("classification", classify(said.asNondeterministic()(F.col("text")))))
    found = replies(rows, providers.extract)
    who = rows.select("statement_id", "user_id", "conversation_id", "turn_id", "classification")
    source = provenance("user", **{c: F.col(c) for c in ("user_id", "conversation_id", "turn_id", "classification")})
    mentioned = durable(extracted_nodes(found, "statement_id"))
    named = mentioned.join(who, "statement_id").withColumn("provenance", source).withColumn("created_at", now).withColumn("order", F.struct("statement_id", "pos"))
    add, ids = upsert_nodes(nodes, named)
    add, ids = durable(add), durable(ids)
    last = mentioned.join(ids, ["type", "label"]).groupBy("statement_id", "label").agg(F.max_by("id", "pos").alias("id"))
    end = lambda c: last.select("statement_id", F.col("label").alias(f"{c}_label"), F.col("id").alias(f"{c}_id"))
    links = extracted_edges(found, "statement_id").join(end("source"), ["statement_id", "source_label"]).join(end("target"), ["statement_id", "target_label"])
    made = links.join(who, "statement_id").withColumn("provenance", source).withColumn("created_at", now).withColumn("last_reinforced", now)
    made = made.withColumn("id", stable_id("s-", F.col("statement_id"), F.col("turn_id"), F.col("pos")))
    new_edges = durable(shaped(_numbered(made, ["statement_id", "pos"], edges), EDGE))
    touched = mentioned.groupBy("statement_id").agg(F.countDistinct("type", "label").alias("nodes_touched"))
    n_edges = links.groupBy("statement_id").agg(F.count("*").alias("edges_added"))
    counters = rows.select("statement_id", "classification", "compressed", "original_tokens", count_tokens(F.col("text")).alias("compressed_tokens"))
    counters = counters.join(touched, "statement_id", "left").join(n_edges, "statement_id", "left").fillna(0, ["nodes_touched", "edges_added"])
    return {"nodes": nodes.unionByName(add), "edges": edges.unionByName(new_edges), "new_nodes": add, "new_edges": new_edges, "counters": counters}


def upsert_edge(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, prov: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """(edges to add, reports) for ``wanted`` (order, source_label, target_label, type): ends are the first nodes with the labels, of any type,
    merged ones too. A report says whether both were found; nothing is added where one is missing."""
    by = first_by_label(nodes)
    rows = wanted.join(by.select(F.col("label").alias("source_label"), F.col("id").alias("source_id")), "source_label", "left")
    rows = rows.join(by.select(F.col("label").alias("target_label"), F.col("id").alias("target_id")), "target_label", "left")
    report = rows.select("order", "source_label", "target_label", F.col("source_id").isNotNull().alias("source_found"), F.col("target_id").isNotNull().alias("target_found"))
    good = rows.where("source_id is not null and target_id is not null").withColumn("type", F.coalesce("type", F.lit("RELATED_TO")))
    good = _numbered(good, ["order"], edges).withColumn("id", stable_id("x-", F.col("seq"), F.col("source_id"), F.col("target_id"), F.col("type")))
    return shaped(good.withColumn("provenance", prov).withColumn("created_at", now).withColumn("last_reinforced", now), EDGE), report
