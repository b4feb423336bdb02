"""Joins and aggregates over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import durable

#: Neighbours of one node that are paired at once, and bits of a bitmap of ids at most (16 MB).
BLOCK, MARK_BITS = 1024, 27
#: Seeds of a block that are unfolded at once.
SLICE = 8
#: Rows that are sent to every task, in place of moving a large table to them.
FEW = 100_000


def active(nodes: DataFrame) -> DataFrame:
    """Nodes that no other node has taken in."""
    return nodes.where(F.col("merged_into").isNull())


def ends(edges: DataFrame) -> DataFrame:
    """(id, other): each edge seen from both ends, once for each distinct pair."""
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    return out.union(out.select("other", "id")).distinct()


def _both_ways(edges: DataFrame, a: str = "source_id", b: str = "target_id") -> DataFrame:
    """(id, other): each edge from both ends; edges are read once."""
    way = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("other"))
    return edges.select(F.explode(F.array(way(a, b), way(b, a))).alias("x")).select("x.*")


def few(rows: DataFrame) -> DataFrame:
    """``rows``, to be sent to every task if there are at most FEW."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def neighbours(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, other): distinct neighbours that exist as nodes. A node with an edge to itself is its own neighbour.

    of: a table with ``id``; only edges that touch it are followed.
    """
    if of is not None:
        ids = of.select("id").distinct()
        near = marked(_both_ways(edges), "id", ids, ids.count()).join(ids, "id").distinct()
    else:
        near = ends(edges)
    return near.join(nodes.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other")


def incident(edges: DataFrame) -> DataFrame:
    """Each edge once for each end, as ``node_id``: an edge of a node to itself comes twice."""
    return edges.withColumn("node_id", F.explode(F.array("source_id", "target_id")))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (id)."""
    s, t = ids.select(F.col("id").alias("source_id")).distinct(), ids.select(F.col("id").alias("target_id")).distinct()
    return edges.join(s, "source_id", "left_semi").join(t, "target_id", "left_semi")


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, id, hop, via): seeds (query_id, id, rank) at hop 0, and at hop 1 their neighbours that are no seeds, ``via`` the lowest rank of a seed."""
    own = seeds.select("query_id", "id", F.lit(0).alias("hop"), F.col("rank").alias("via"))
    near = neighbours(nodes, edges, seeds).join(seeds, "id").select("query_id", F.col("other").alias("id"), "rank")
    near = near.groupBy("query_id", "id").agg(F.min("rank").alias("via"))
    near = near.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return own.unionByName(near.select("query_id", "id", F.lit(1).alias("hop"), "via"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count (ids of nodes and ends of edges that lack one), edge_count."""
    ids = nodes.select("id").union(edges.select("source_id")).union(edges.select("target_id")).distinct()
    return ids.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row and one row


def types(rows: DataFrame) -> DataFrame:
    """How many rows each type has."""
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def stats(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row: name, node_count, edge_count, and the histograms of types as sorted texts ``type=n``."""
    said = lambda rows, c: types(rows).agg(F.array_join(F.sort_array(F.collect_list(F.concat("type", F.lit("="), "n"))), ",").alias(c))
    return counts(nodes, edges).crossJoin(said(nodes, "node_types")).crossJoin(said(edges, "edge_types")).select(F.lit(name).alias("name"), "*")


def first_by_label(nodes: DataFrame) -> DataFrame:
    """(label, id): of each label the node that came first, whatever its type."""
    return nodes.groupBy("label").agg(F.min_by("id", F.struct("seq", "id")).alias("id"))


def resolve_labels(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (source_label, target_label, ...) with source_id and target_id, null where no node has the label."""
    by = first_by_label(nodes)
    out = pairs.join(by.select(F.col("label").alias("source_label"), F.col("id").alias("source_id")), "source_label", "left")
    return out.join(by.select(F.col("label").alias("target_label"), F.col("id").alias("target_id")), "target_label", "left")


def drop_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes ``ids`` (id) and all edges that touch them."""
    gone = ids.select("id").distinct()
    edges = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), edges


def put_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with ``new`` put in, a new row in place of one with its id. Of new rows with one id the last (by seq) stays; an id keeps its place."""
    last = new.groupBy("id").agg(F.max_by(F.struct(*new.columns), "seq").alias("r")).select("r.*")
    place = nodes.select("id", F.col("seq").alias("__seq"))
    last = last.join(place, "id", "left").withColumn("seq", F.coalesce("__seq", "seq")).drop("__seq")
    return nodes.join(last.select("id"), "id", "left_anti").unionByName(last.select(*nodes.columns))


def migrate(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges after nodes ``old_id`` became ``new_id``.

    Edges that touch no old id stay as they are. The others get their new ends; those whose ends became
    one are dropped; those that then agree in source, target and type become one with the sum of their
    weights, which keeps the other fields of the one that came first.
    """
    remap = few(remap.select("old_id", "new_id"))
    to = lambda c: remap.select(F.col("old_id").alias(c), F.col("new_id").alias(f"__{c}"))
    found = edges.join(to("source_id"), "source_id", "left").join(to("target_id"), "target_id", "left")
    touched = F.col("__source_id").isNotNull() | F.col("__target_id").isNotNull()
    found = found.withColumn("__touched", touched)
    moved = found.where("__touched").withColumn("source_id", F.coalesce("__source_id", "source_id")).withColumn("target_id", F.coalesce("__target_id", "target_id"))
    moved = moved.where("source_id <> target_id").select(*edges.columns)
    rest = [c for c in edges.columns if c not in ("source_id", "target_id", "type", "weight")]
    one = moved.groupBy("source_id", "target_id", "type").agg(F.sum("weight").alias("weight"), F.min_by(F.struct(*rest), F.struct("seq", "id")).alias("r"))
    return found.where(~F.col("__touched")).select(*edges.columns).unionByName(one.select("source_id", "target_id", "type", "weight", "r.*").select(*edges.columns))


def marked(rows: DataFrame, c: str, ids: DataFrame, most: int) -> DataFrame:
    """``rows`` without most of those whose ``c`` is no id of ``ids`` (id), before anything is moved.

    The ids set bits of a bitmap (4 KB a row of it; 16 bits an id, MARK_BITS bits at most), which is broadcast. A
    bit may be another id's: an exact join must follow. most: about how many ids there are.
    """
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(1 << min(MARK_BITS, max(15, (16 * most).bit_length()))))
    marks = ids.groupBy(F.bitmap_bucket_number(place("id")).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("id"))).alias("__bits"))
    four = lambda i: F.conv(F.hex(F.substring("__bits", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
    # 1024 ints a row: an array is read in place, where bytes would be copied (4 KB) for each row that is looked up
    words = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.when(four(i) >= 1 << 31, four(i) - (1 << 32)).otherwise(four(i)).cast("int"))
    at = F.bitmap_bit_position(place(c)).cast("int")
    found = rows.withColumn("__bucket", F.bitmap_bucket_number(place(c))).join(F.broadcast(marks.select("__bucket", words.alias("__bits"))), "__bucket")
    bit = F.getbit(F.get("__bits", F.call_function("shiftright", at, F.lit(5))), F.lit(24) - at.bitwiseAND(24) + at.bitwiseAND(7))
    return found.where(bit == 1).drop("__bucket", "__bits")


def _blocks(rows: DataFrame, c: str, split: str, *more: str) -> DataFrame:
    """(mid_id, split, items): the distinct (``c``, ...) of each node between, about BLOCK at once, so that a hub is many rows."""
    hubs = rows.groupBy("mid_id").count().where(F.col("count") > BLOCK)  # at most one for BLOCK rows
    hubs = hubs.select("mid_id", F.ceil(F.col("count") / BLOCK).alias("__parts"))
    part = F.coalesce(F.pmod(F.xxhash64(c), F.col("__parts")), F.lit(0))
    keyed = rows.join(F.broadcast(hubs), "mid_id", "left").select("mid_id", split, part.alias("__part"), F.struct(c, *more).alias("x") if more else F.col(c).alias("x"))
    return keyed.repartition("mid_id", split, "__part").groupBy("mid_id", split, "__part").agg(F.collect_set("x").alias("items")).drop("__part")


def around(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other), distinct: the edges that touch an id of ``ids`` (id), and a few more, from both ends; edges are read once."""
    ids = ids.select("id").distinct()
    return _both_ways(marked(_both_ways(edges), "id", ids, ids.count()), "id", "other").distinct()


def two_hops(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, near: DataFrame | None = None, order: DataFrame | None = None, remotes: DataFrame | None = None) -> DataFrame:
    """(seed_id, mid_id, remote_id): nodes at distance exactly 2 from each seed (id), by the smallest node between.

    near: all neighbours(nodes, edges), or around() seeds and remotes, where they are at hand. remotes: (id) of the
    remotes that are wanted, all unless given. order: (id, seq) of seeds; then a pair that two of
    them reach comes from the first (by seq and id) only, and seeds that it lacks have no pairs.

    There are as many pairs at a hub as the square of its neighbours, so they are made last, in blocks of seeds
    against blocks of remotes, and moved no more. Only pairs that may have several nodes between, or an edge, are
    brought together: those of a seed with several neighbours and a remote that has several too, or is one.
    """
    spark, there = nodes.sparkSession, nodes.select("id").distinct()
    if near is None:
        out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
        out = out.union(out.select("other", "id"))
    else:
        out = near
    out, own, n = out.where("id <> other"), seeds.select("id").distinct(), nodes.count()
    at = [] if order is None else ["at"]
    turns = None if order is None else order.select(F.col("id").alias("__id"), F.col("seq").cast("long").alias("at")).distinct()
    # inner joins: the optimizer would push a semi join below that with the bitmap
    first = marked(out, "id", own, seeds.count()).join(own, "id").select(F.col("id").alias("seed_id"), F.col("other").alias("mid_id"))
    first = first.join(turns, F.col("seed_id") == F.col("__id")).drop("__id") if at else first
    first = first.join(there.withColumnRenamed("id", "mid_id"), "mid_id")
    by = Window.partitionBy("seed_id")
    # nth: a number that is aggregated by hashing, where a text would be sorted
    first = first.withColumn("nth", F.dense_rank().over(by.orderBy("mid_id"))).withColumn("many", F.min("mid_id").over(by) < F.max("mid_id").over(by))
    first = durable(first)  # used five times, each of which would find the seeds' edges again
    mids = first.select(F.col("mid_id").alias("remote_id")).distinct().withColumn("__is_mid", F.lit(True))

    step = marked(out, "id", first.select(F.col("mid_id").alias("id")), n).select(F.col("id").alias("mid_id"), F.col("other").alias("remote_id"))
    if remotes is not None:
        wanted = remotes.select("id").distinct()
        step, there = marked(step, "remote_id", wanted, remotes.count()), there.join(wanted, "id", "left_semi")
    step = step.join(there.withColumnRenamed("id", "remote_id"), "remote_id").join(mids, "remote_id", "left")
    step = step.join(turns, F.col("remote_id") == F.col("__id"), "left").drop("__id") if at else step
    by = Window.partitionBy("remote_id")
    step = step.withColumn("hard", F.col("__is_mid").isNotNull() | (F.min("mid_id").over(by) < F.max("mid_id").over(by)))

    left = _blocks(first, "seed_id", "many", "nth", *at).withColumnRenamed("items", "seeds")
    met = left.join(_blocks(step, "remote_id", "hard", *at).withColumnRenamed("items", "remotes"), "mid_id")
    both = F.when(F.size("seeds") + F.size("remotes") > 0, F.col("many") & F.col("hard"))  # always so; it can't be pushed down, so that both uses share what is moved
    later = F.col("r.at").isNull() | (F.col("r.at") > F.col("s.at")) | ((F.col("r.at") == F.col("s.at")) & (F.col("r.remote_id") > F.col("s.seed_id")))
    cols = ["seed_id", "mid_id", "remote_id"]

    def remote(rows: DataFrame) -> DataFrame:
        if not at:
            return rows.select(F.col("s").alias("seed_id"), "mid_id", F.explode("remotes").alias("remote_id")).where("seed_id <> remote_id")
        return rows.select("s", "mid_id", F.explode("remotes").alias("r")).where(later).select("s.seed_id", "mid_id", "r.remote_id")

    def turned(rows: DataFrame) -> DataFrame:
        """Each seed with the remotes that it may have: the turns are compared before anything is moved, and stay behind."""
        rows, s = rows.select(F.explode("seeds").alias("s"), "remotes"), lambda k: F.col("s")[k]
        if at:
            own = F.filter("remotes", lambda r: r["at"].isNull() | (r["at"] > s("at")) | ((r["at"] == s("at")) & (r["remote_id"] > s("seed_id"))))
            rows = rows.select("s", F.transform(own, lambda r: r["remote_id"]).alias("remotes")).where(F.size("remotes") > 0)
        return rows.select(s("nth").alias("nth"), s("seed_id").alias("seed_id"), "remotes")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    plain = met.where(~both).repartition(tasks, "mid_id", F.col("seeds")[0], F.col("remotes")[0])
    # generated code holds all rows that it makes of a row: few seeds at once, and a coalesce(), which joins no parts here, lest
    # both unfoldings become one function, which would hold the pairs of two whole blocks
    plain = plain if at else plain.withColumn("seeds", F.transform("seeds", lambda x: x["seed_id"]))
    at_once = F.transform(F.sequence(F.lit(0), F.floor((F.size("seeds") - 1) / SLICE)), lambda i: F.slice("seeds", i * SLICE + 1, SLICE))
    plain = plain.select("mid_id", F.explode(at_once).alias("seeds"), "remotes").coalesce(tasks)
    several = first.where("many")
    edges_ = several.select(F.lit(0).alias("nth"), "seed_id", F.array("mid_id").alias("remotes"))
    # more and smaller parts than elsewhere: each is hashed in a task's memory
    rest = turned(met.where(both)).unionByName(edges_).repartition(4 * tasks, "seed_id")
    rest = rest.select("seed_id", "nth", F.explode("remotes").alias("remote_id")).where("seed_id <> remote_id")
    rest = rest.groupBy("seed_id", "remote_id").agg(F.min("nth").alias("nth")).where("nth > 0")
    rest = rest.join(several.select("seed_id", "nth", "mid_id").distinct(), ["seed_id", "nth"])
    return remote(plain.select("mid_id", F.explode("seeds").alias("s"), "remotes")).select(*cols).union(rest.select(*cols))


def unlinked(pairs: DataFrame, edges: DataFrame, a: str = "seed_id", b: str = "remote_id") -> DataFrame:
    """Pairs without an edge between their two nodes, in either direction."""
    low, high = F.least("source_id", "target_id").alias("__low"), F.greatest("source_id", "target_id").alias("__high")
    have = edges.select(low, high).distinct()
    keyed = pairs.withColumn("__low", F.least(a, b)).withColumn("__high", F.greatest(a, b))
    return keyed.join(have, ["__low", "__high"], "left_anti").drop("__low", "__high")
