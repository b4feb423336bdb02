"""Streams: each traversal record is used once; nodes are upserted batch by batch."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.functions.text import HISTORY_BUDGET, count_tokens
from graphloom.operators.ingest import upsert_nodes
from graphloom.operators.reinforce import reinforce
from graphloom.sources.logs import parsed
from graphloom.sources.store import TAKEN, Graph, Store


def traversal_stream(spark: SparkSession, path: str) -> DataFrame:
    """New records of a folder of JSON lines; lines that aren't JSON objects are passed over."""
    return parsed(spark.readStream.format("text").load(path))


def consume(records: DataFrame, checkpoint: str, use: Callable[[DataFrame, int], None]) -> None:
    """Hand all records that weren't handed out before to ``use``, then stop. The checkpoint keeps what was read; the log is never deleted.

    A batch that failed before the checkpoint has it done comes again, with the same number: see consume_into().
    """
    query = records.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def consume_into(store: Store, records: DataFrame, checkpoint: str, use: Callable[[Graph, DataFrame], Graph]) -> None:
    """As consume(), for a stored graph: each batch makes a version of it, once.

    A version says which batch of which stream it took in last, in the snapshot itself; a batch that comes again after its
    version was saved is passed over. A stream is known by the id that its checkpoint gives it.
    """
    spark, started, stream = store.spark, threading.Event(), []

    def once(batch: DataFrame, number: int) -> None:
        started.wait()
        if number > store.took(stream[0]):
            store.save(use(store.load(), batch), spark.createDataFrame([(stream[0], number)], TAKEN))

    query = records.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.append(f"stream {query.id}")
    started.set()
    query.awaitTermination()


def reinforce_from_log(spark: SparkSession, store: Store, log_path: str, checkpoint: str) -> None:
    """Reinforce the stored graph with the records that came since the last call; each batch saves a version."""
    consume_into(store, traversal_stream(spark, log_path), checkpoint, lambda graph, batch: Graph(*reinforce(graph.nodes, graph.edges, batch)))


def upsert_stream(stream: DataFrame, store: Store, checkpoint: str) -> None:
    """Upsert nodes from a stream (type, label, summary, order, provenance, created_at)."""

    def use(graph: Graph, batch: DataFrame) -> Graph:
        add, _known = upsert_nodes(graph.nodes, batch)
        return Graph(graph.nodes.unionByName(add), graph.edges)

    consume_into(store, stream, checkpoint, use)


def history_stream(turns: DataFrame, budget: int = HISTORY_BUDGET) -> DataFrame:
    """(conv_id, kept, oldest, tokens) of each conversation that got turns (conv_id, turn, text): its newest turns within the budget.

    The state holds those turns' numbers and tokens, and the newest turn that was left out: as sums only
    grow, neither it nor an older one can come back.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, tokens, cut = state.get if state.exists else ([], [], None)
        rows = list(zip(numbers, tokens)) + [(int(t), int(n)) for part in parts for t, n in zip(part["turn"], part["tokens"])]
        kept, used = [], 0
        for t, n in sorted(rows, reverse=True):
            if cut is not None and t <= cut:
                break
            if used + n > budget:
                cut = t
                break
            kept.append((t, n))
            used += n
        state.update(([t for t, _ in kept], [n for _, n in kept], cut))
        yield pd.DataFrame({"conv_id": [key[0]], "kept": [len(kept)], "oldest": pd.array([kept[-1][0] if kept else None], "Int64"), "tokens": [used]})

    rows = turns.select("conv_id", "turn", count_tokens(F.col("text")).alias("tokens"))
    return rows.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, kept long, oldest long, tokens long", "numbers array<bigint>, tokens array<bigint>, cut bigint", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type) counted by tumbling windows; rows later than the watermark are dropped. An addition of this engine's own."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
