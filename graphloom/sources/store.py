"""Graphs on any file system that Spark reads: snapshots, and a table that says which one counts."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import retrieval_text
from graphloom.functions.vectors import embed
from graphloom.operators.graph import drop_nodes, put_nodes
from graphloom.operators.graph import stats as graph_stats
from graphloom.schema import EDGE, NODE, PASS_EVENT, empty, shaped


#: What was taken in: a file of the log, or the batches of a stream up to a number.
TAKEN = "name string, upto long"


def read_or_none(spark: SparkSession, path: str, kind: str = "parquet", schema=None) -> DataFrame | None:
    """The table at a path, None if nothing is there."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


@dataclass
class Graph:
    """A graph's tables, as plain DataFrames; operations give new ones."""

    nodes: DataFrame
    edges: DataFrame

    def get_node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def get_edge(self, edge_id: str) -> DataFrame:
        return self.edges.where(F.col("id") == edge_id).orderBy("seq").limit(1)

    def put_nodes(self, new: DataFrame) -> Graph:
        return Graph(put_nodes(self.nodes, shaped(new, NODE)), self.edges)

    def remove_nodes(self, ids: DataFrame) -> Graph:
        return Graph(*drop_nodes(self.nodes, self.edges, ids))

    def add_edges(self, new: DataFrame) -> Graph:
        """Edges are always appended; parallel ones are fine."""
        return Graph(self.nodes, self.edges.unionByName(shaped(new, EDGE)))

    def remove_edge(self, edge_id: str) -> Graph:
        """Without the first edge of that id."""
        first = self.get_edge(edge_id).select("id", "seq")
        return Graph(self.nodes, self.edges.join(first, ["id", "seq"], "left_anti"))

    def show_provenance(self, some_id: str, edges_too: bool = False) -> DataFrame:
        """One row: id and the provenance as JSON; ``{"kind":"not_found"}`` for an unknown id. Edges are looked up only if asked for."""
        rows = self.nodes.select("id", "provenance").where(F.col("id") == some_id)
        if edges_too:
            rows = rows.union(self.edges.select("id", "provenance").where(F.col("id") == some_id))
        found = rows.agg(F.first(F.to_json("provenance")).alias("p"))
        return found.select(F.lit(some_id).alias("id"), F.coalesce("p", F.lit('{"kind":"not_found"}')).alias("provenance"))


class Store:
    """A named graph under a base path.

    ``save`` writes a whole new snapshot and then appends its name to the table of versions, so a reader
    sees the old graph or the new one, and a save that fails leaves the old one. Old snapshots stay.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "graph", embedder=embed):
        self.spark, self.path, self.name, self.embedder = spark, path.rstrip("/"), name, embedder
        self.pass_running = False

    def _versions(self) -> DataFrame | None:
        return read_or_none(self.spark, f"{self.path}/versions", schema="version long, snapshot string")

    def version(self) -> tuple[int, str] | None:
        versions = self._versions()
        row = None if versions is None else versions.orderBy(F.col("version").desc()).first()
        return None if row is None else (row["version"], row["snapshot"])

    def load(self) -> Graph:
        """The latest snapshot; an empty graph if there is none."""
        now = self.version()
        if now is None:
            return Graph(empty(self.spark, NODE), empty(self.spark, EDGE))
        at = f"{self.path}/snapshots/{now[1]}"
        return Graph(self.spark.read.schema(NODE).parquet(f"{at}/nodes"), self.spark.read.schema(EDGE).parquet(f"{at}/edges"))

    def vectors(self) -> DataFrame:
        """(id, vector) of the latest snapshot's nodes, for retrieval; they were embedded when it was saved."""
        now = self.version()
        if now is None:
            return self.spark.createDataFrame([], "id string, vector array<double>")
        return self.spark.read.parquet(f"{self.path}/snapshots/{now[1]}/vectors")

    def taken(self) -> DataFrame:
        """What the latest snapshot has taken in, as TAKEN: it counts from the moment the snapshot does."""
        now = self.version()
        found = None if now is None else read_or_none(self.spark, f"{self.path}/snapshots/{now[1]}/taken", schema=TAKEN)
        return self.spark.createDataFrame([], TAKEN) if found is None else found

    def took(self, name: str) -> int:
        """Up to which number the latest snapshot has taken in what is called so; -1 if nothing of it."""
        found = self.taken().where(F.col("name") == name).agg(F.max("upto")).first()[0]
        return -1 if found is None else found

    def save(self, graph: Graph, took: DataFrame | None = None) -> int:
        """Write a version. took: what it has taken in beside what the one before had (TAKEN)."""
        version, snapshot = (self.version() or (0, ""))[0] + 1, uuid.uuid4().hex
        taken = self.taken() if took is None else self.taken().union(took)
        taken.groupBy("name").agg(F.max("upto").alias("upto")).write.parquet(f"{self.path}/snapshots/{snapshot}/taken")
        graph.nodes.write.parquet(f"{self.path}/snapshots/{snapshot}/nodes")
        graph.edges.write.parquet(f"{self.path}/snapshots/{snapshot}/edges")
        texts = self.spark.read.schema(NODE).parquet(f"{self.path}/snapshots/{snapshot}/nodes")
        texts.select("id", self.embedder(retrieval_text(F.col("label"), F.col("summary"))).alias("vector")).write.parquet(f"{self.path}/snapshots/{snapshot}/vectors")
        row = self.spark.createDataFrame([(version, snapshot)], "version long, snapshot string")
        row.write.mode("append").parquet(f"{self.path}/versions")
        return version

    def stats(self) -> DataFrame:
        graph = self.load()
        return graph_stats(graph.nodes, graph.edges, self.name)

    def log(self, events: DataFrame) -> None:
        """Append pass events (see schema.PASS_EVENT)."""
        shaped(events, PASS_EVENT).write.mode("append").parquet(f"{self.path}/pass_log")

    def events(self) -> DataFrame:
        found = read_or_none(self.spark, f"{self.path}/pass_log", schema=PASS_EVENT)
        return empty(self.spark, PASS_EVENT) if found is None else found


def recent_events(events: DataFrame, kind: str, k: int = 10) -> DataFrame:
    """The newest k events of a kind, newest first; one at least, whatever k."""
    return events.where(F.col("kind") == kind).orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(max(k, 1))
