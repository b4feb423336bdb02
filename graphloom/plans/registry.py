"""The registered graph queries and their SQL. Graphs are made of the test tables by plans.fixtures."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions.providers import Providers
from graphloom.functions.vectors import embed, normalise
from graphloom.operators import graph as g
from graphloom.operators import ingest as ing
from graphloom.operators import link, merge, prune, reinforce, retrieve, similarity
from graphloom.plans import fixtures as fx
from graphloom.plans import tools
from graphloom.schema import bad_provenance, provenance
from graphloom.session import shared_folder
from graphloom.sources.logs import append_traversals, read_traversals
from graphloom.sources.store import Graph, Store, recent_events
from graphloom.sources.texts import section
from graphloom.streaming.log_consumer import consume, history_stream, traversal_stream, windowed_counts

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
STAMP = "2026-01-01 00:00:00"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _ghosts(spark: SparkSession, d: str, most: int | None = 10) -> DataFrame:
    """Nodes of the tables; the suppliers of the merge are merged."""
    return fx.table_nodes(spark, d).drop("merged_into").join(fx.merge_remap(spark, d, most).select(F.col("old_id").alias("id"), F.col("new_id").alias("merged_into")), "id", "left")


_N = f"n AS ({fx.NODES_SQL})"
_E = f"e AS ({fx.EDGES_SQL})"
_GHOSTS = f"{_N}, {fx.REMAP_SQL}, gn AS (SELECT n.*, new_id AS merged_into FROM n LEFT JOIN rm ON old_id = id)"


# Scans, lookups, counts


@query(f"WITH {_GHOSTS} SELECT id, type, label FROM gn WHERE merged_into IS NULL")
def node_scan_active(spark, d):
    return g.active(_ghosts(spark, d)).select("id", "type", "label")


@query(f"WITH {_GHOSTS} SELECT id, type, label, merged_into FROM gn")
def node_scan(spark, d, most=10):
    return _ghosts(spark, d, most).select("id", "type", "label", "merged_into")


@query(fx.EDGES_SQL)
def edge_scan(spark, d):
    return fx.table_edges(spark, d).drop("seq")


@query(f"WITH {_N} SELECT type, count(*) AS n FROM n GROUP BY type")
def graph_stats_nodes(spark, d):
    return g.types(fx.table_nodes(spark, d))


@query(f"WITH {_E} SELECT type, count(*) AS n FROM e GROUP BY type")
def graph_stats_edges(spark, d):
    return g.types(fx.table_edges(spark, d))


_SAID = "(SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT type || '=' || count(*) AS s FROM {} GROUP BY type))"


@query(f"""WITH {_N}, {_E}
SELECT 'fx' AS name, (SELECT count(*) FROM (SELECT id FROM n UNION SELECT source_id FROM e UNION SELECT target_id FROM e)) AS node_count, (SELECT count(*) FROM e) AS edge_count,
       {_SAID.format("n")} AS node_types, {_SAID.format("e")} AS edge_types""")
def instance_stats(spark, d):
    return g.stats(fx.table_nodes(spark, d), fx.table_edges(spark, d), "fx")


@query(f"WITH {_N} SELECT id, type, label FROM n WHERE id = 'c7'")
def node_lookup(spark, d):
    return fx.table_nodes(spark, d).where(F.col("id") == "c7").select("id", "type", "label")


@query(f"WITH {_E} SELECT id, source_id, target_id, type FROM e WHERE id = 'cn7'")
def edge_lookup(spark, d):
    return fx.table_edges(spark, d).where(F.col("id") == "cn7").select("id", "source_id", "target_id", "type")


def _sourced(spark, d):
    return fx.table_nodes(spark, d).withColumn("provenance", provenance("direct", raw_doc_id=F.col("type"), extraction_run_id=F.lit("fx")))


@query(f"""WITH {_N}, q AS (SELECT unnest(['c7', 'n3', 'nowhere']) AS id)
SELECT q.id, CASE WHEN n.id IS NULL THEN '{{"kind":"not_found"}}' ELSE '{{"kind":"direct","raw_doc_id":"' || type || '","extraction_run_id":"fx"}}' END AS provenance FROM q LEFT JOIN n USING (id)""")
def show_provenance(spark, d):
    asked = spark.createDataFrame([("c7",), ("n3",), ("nowhere",)], "id string")
    found = asked.join(_sourced(spark, d).select("id", F.to_json("provenance").alias("provenance")), "id", "left")
    return found.select("id", F.coalesce("provenance", F.lit('{"kind":"not_found"}')).alias("provenance"))


@query(f"WITH {_N} SELECT id FROM n WHERE type = 'Part'")
def invalid_provenance(spark, d):
    """Nodes whose provenance lacks what its kind must have; here the parts' run is taken away."""
    rows = fx.table_nodes(spark, d).withColumn("provenance", provenance("direct", raw_doc_id=F.col("type"), extraction_run_id=F.when(F.col("type") != "Part", "fx")))
    return bad_provenance(rows).select("id")


# Joins


@query(f"WITH {_N}, {_E} SELECT DISTINCT a AS id, b AS other FROM (SELECT source_id AS a, target_id AS b FROM e UNION ALL SELECT target_id, source_id FROM e) WHERE b IN (SELECT id FROM n)")
def neighbors_undirected(spark, d):
    return g.neighbours(fx.table_nodes(spark, d), fx.table_edges(spark, d))


@query(f"WITH {_E} SELECT source_id AS node_id, id FROM e UNION ALL SELECT target_id, id FROM e")
def incident_edges(spark, d):
    return g.incident(fx.table_edges(spark, d)).select("node_id", "id")


@query(f"WITH {_N}, {_E}, k AS (SELECT id FROM n WHERE type IN ('Region', 'Nation', 'Supplier')) SELECT id, source_id, target_id, type FROM e WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)")
def induced_subgraph(spark, d):
    ids = fx.table_nodes(spark, d).where(F.col("type").isin("Region", "Nation", "Supplier"))
    return g.induced(fx.table_edges(spark, d), ids).select("id", "source_id", "target_id", "type")


@query(f"""WITH {_N}, f AS (SELECT label, min_by(id, seq) AS id FROM n GROUP BY label), p AS (SELECT event_id, 'nowhere' AS source_label, p_name AS target_label FROM events JOIN part ON p_partkey = user_id UNION ALL SELECT event_id, c_name, p_name FROM events JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = user_id)
SELECT event_id, source_label, target_label, s.id AS source_id, t.id AS target_id FROM p LEFT JOIN f AS s ON s.label = source_label LEFT JOIN f AS t ON t.label = target_label""")
def resolve_labels(spark, d):
    """Labels of customers and parts that events name; many parts share one, and one label is nobody's."""
    events = fx.read(spark, d, "events").select("event_id", "user_id")
    part = fx.read(spark, d, "part").select(F.col("p_partkey").alias("user_id"), F.col("p_name").alias("target_label"))
    own = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("source_label"))
    some = events.join(part, "user_id")
    pairs = some.withColumn("source_label", F.lit("nowhere")).unionByName(some.join(own, "user_id"))
    return g.resolve_labels(fx.table_nodes(spark, d), pairs).select("event_id", "source_label", "target_label", "source_id", "target_id")


# Similarity


_Q0 = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


def _query_vector(spark, d) -> list[float]:
    return list(fx.read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"""WITH {_Q0}, s AS (SELECT 'v' || vec_id AS id, {_COS.format("embedding::DOUBLE[]", "qv")} AS sim FROM embeddings, q)
SELECT id, round(sim, 6) AS sim, row_number() OVER (ORDER BY sim DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def cosine_topk(spark, d):
    rows = fx.read(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"), F.col("embedding").alias("vector"))
    return similarity.top_k(rows, _query_vector(spark, d), 5).select("id", F.round("sim", 6).alias("sim"), "rank")


_TOP5 = f"""{fx.VECTORS_SQL}, s AS (SELECT a.id, b.id AS other, {_COS.format("a.vector", "b.vector")} AS sim FROM vn AS a, vn AS b WHERE a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other)::INTEGER AS rank FROM s QUALIFY rank <= 5)"""


@query(f"WITH {_TOP5} SELECT id, other, round(sim, 6) AS sim, rank FROM t WHERE sim >= 0")
def similarity_self_join_top5(spark, d):
    rows = fx.vector_nodes(spark, d).select("id", "vector")
    return similarity.self_top_k(rows, 5).where("sim >= 0").select("id", "other", F.round("sim", 6).alias("sim"), "rank")


@query(f"""WITH {_Q0}, s AS (SELECT q.vec_id AS qid, e.vec_id, {_COS.format("e.embedding::DOUBLE[]", "q.embedding::DOUBLE[]")} AS sim FROM embeddings AS e, embeddings AS q WHERE q.vec_id % 100 = 0)
SELECT 'q' || qid AS query_id, 'v' || vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, 'v' || vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def cosine_topk_batch(spark, d):
    """A stated set of queries, those whose id 100 divides, against all rows."""
    e = fx.read(spark, d, "embeddings")
    rows = e.select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 100 = 0").select(F.concat(F.lit("q"), F.col("vec_id")).alias("query_id"), F.col("embedding").alias("vector"))
    return similarity.top_k_batch(rows, asked, 5).select("query_id", "id", "rank")


def _supplier_pairs(spark, d):
    s = fx.read(spark, d, "supplier").select("s_suppkey")
    return s.join(s.select(F.col("s_suppkey").alias("t")), F.col("s_suppkey") + 1 == F.col("t")).select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("a"), F.concat(F.lit("s"), F.col("t")).alias("b"))


@query("""WITH near AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), sizes AS (SELECT s, count(*) AS n FROM near GROUP BY s),
c AS (SELECT x.s, count(*) AS n FROM near AS x JOIN near AS y ON y.s = x.s + 1 AND y.p = x.p GROUP BY x.s)
SELECT 's' || a.s_suppkey AS a, 's' || b.s_suppkey AS b, CASE WHEN coalesce(u.n, 0) + coalesce(v.n, 0) = 0 THEN 0.0 ELSE coalesce(c.n, 0) / (coalesce(u.n, 0) + coalesce(v.n, 0) - coalesce(c.n, 0))::DOUBLE END AS jac
FROM supplier AS a JOIN supplier AS b ON b.s_suppkey = a.s_suppkey + 1 LEFT JOIN sizes AS u ON u.s = a.s_suppkey LEFT JOIN sizes AS v ON v.s = b.s_suppkey LEFT JOIN c ON c.s = a.s_suppkey""")
def neighbor_jaccard(spark, d):
    near = g.ends(fx.supplies(spark, d))
    return similarity.neighbour_jaccard(_supplier_pairs(spark, d), near).select("a", "b", "jac")


_CAND = f"""{_TOP5}, adj AS (SELECT DISTINCT a AS id, b AS other FROM (SELECT source_id AS a, target_id AS b FROM ve UNION ALL SELECT target_id, source_id FROM ve)), sz AS (SELECT id, count(*) AS n FROM adj GROUP BY id),
l AS (SELECT t.id AS a, t.other AS b, t.sim, t.rank, x.seq, x.type = y.type AS same FROM t JOIN vn AS x ON x.id = t.id JOIN vn AS y ON y.id = t.other WHERE sim >= 0),
cm AS (SELECT l.a, l.b, count(*) AS n FROM l JOIN adj AS p ON p.id = l.a JOIN adj AS q ON q.id = l.b AND q.other = p.other GROUP BY l.a, l.b),
j AS (SELECT l.*, CASE WHEN coalesce(u.n, 0) + coalesce(v.n, 0) = 0 THEN 0.0 ELSE coalesce(cm.n, 0) / (coalesce(u.n, 0) + coalesce(v.n, 0) - coalesce(cm.n, 0))::DOUBLE END AS jac
      FROM l LEFT JOIN cm ON cm.a = l.a AND cm.b = l.b LEFT JOIN sz AS u ON u.id = l.a LEFT JOIN sz AS v ON v.id = l.b),
k AS (SELECT * FROM j WHERE sim >= 0.3::DOUBLE OR jac >= 0.3::DOUBLE OR (same AND sim >= 0.2::DOUBLE)),
mc AS (SELECT a, b, sim, jac FROM k QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq, rank) = 1)"""


def _candidates(spark, d):
    """At thresholds that the tables' vectors reach."""
    nodes = fx.vector_nodes(spark, d)
    return merge.candidates(nodes.drop("vector"), fx.vector_edges(spark, d), nodes.select("id", "vector"), cosine=0.3, same_type=0.2)


@query(f"WITH {_CAND} SELECT a, b, round(sim, 6) AS sim, round(jac, 6) AS jac FROM mc")
def merge_candidates(spark, d):
    return _candidates(spark, d).select("a", "b", F.round("sim", 6).alias("sim"), F.round("jac", 6).alias("jac"))


# Retrieval


_SEEDS = f"""{fx.VECTORS_SQL}, {_Q0}, sd AS (SELECT id, row_number() OVER (ORDER BY {_COS.format("vector", "qv")} DESC, id)::INTEGER AS rank FROM vn, q QUALIFY rank <= 5),
nb AS (SELECT other AS id, min(rank) AS via FROM (SELECT source_id AS id, target_id AS other FROM ve UNION ALL SELECT target_id, source_id FROM ve) AS a JOIN sd USING (id) WHERE other NOT IN (SELECT id FROM sd) GROUP BY other),
ex AS (SELECT id, 0 AS hop, rank AS via FROM sd UNION ALL SELECT id, 1, via FROM nb)"""
_BUDGET = f"""{_SEEDS}, ln AS (SELECT ex.*, '- [' || type || '] ' || label || ': ' || summary AS line FROM ex JOIN vn USING (id)),
tk AS (SELECT *, ceil(length(line) / 4.0)::BIGINT AS tokens FROM ln),
cx AS (SELECT id, hop, via, tokens, row_number() OVER w::INTEGER AS place, (sum(tokens) OVER w)::BIGINT AS used FROM tk WINDOW w AS (ORDER BY hop, via, id ROWS UNBOUNDED PRECEDING) QUALIFY used <= {tx.CONTEXT_BUDGET})"""


def _seeds(spark, d):
    rows = fx.vector_nodes(spark, d).select("id", "vector")
    return similarity.top_k(rows, _query_vector(spark, d), 5).select(F.lit("q").alias("query_id"), "id", "rank")


@query(f"WITH {_SEEDS} SELECT id, hop, via FROM ex")
def seed_expansion(spark, d):
    return g.expand(fx.vector_nodes(spark, d), fx.vector_edges(spark, d), _seeds(spark, d)).select("id", "hop", "via")


@query(f"WITH {_BUDGET} SELECT id, hop, via, tokens, place, used FROM cx")
def context_budget(spark, d):
    nodes = fx.vector_nodes(spark, d)
    return retrieve.budget_prefix(g.expand(nodes, fx.vector_edges(spark, d), _seeds(spark, d)), nodes).select("id", "hop", "via", "tokens", "place", "used")


@query(f"WITH {_BUDGET} SELECT id AS edge_id, source_id, target_id FROM ve WHERE source_id IN (SELECT id FROM cx) AND target_id IN (SELECT id FROM cx)")
def graph_retrieve(spark, d):
    """From a question's vector to the edges of its context."""
    _, touched = retrieve.retrieve(fx.vector_nodes(spark, d), fx.vector_edges(spark, d), _seeds(spark, d))
    return touched.select("edge_id", "source_id", "target_id")


@query(f"""WITH {_BUDGET} SELECT 'graph_query' AS kind, 'q' AS question, (SELECT string_agg(id, ',' ORDER BY rank) FROM sd) AS seeds, (SELECT string_agg(id, ',' ORDER BY id) FROM cx) AS nodes,
(SELECT coalesce(string_agg(id, ',' ORDER BY id), '') FROM ve WHERE source_id IN (SELECT id FROM cx) AND target_id IN (SELECT id FROM cx)) AS edges""")
def traversal_record(spark, d):
    seeds = _seeds(spark, d)
    included, touched = retrieve.retrieve(fx.vector_nodes(spark, d), fx.vector_edges(spark, d), seeds)
    asked = spark.createDataFrame([("q", "q")], "query_id string, question string")
    rows = retrieve.traversal_records(included, touched, seeds, asked, F.lit("2026-01-01T00:00:00+00:00"))
    return rows.select("kind", "question", *(F.array_join(c, ",").alias(n) for c, n in (("seed_node_ids", "seeds"), ("touched_node_ids", "nodes"), ("touched_edge_ids", "edges"))))


@query("""WITH t AS (SELECT conv_id, turn, role, (sum(ceil(coalesce(length(text), 0) / 4.0)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS kept_tokens FROM conversations)
SELECT * FROM t WHERE kept_tokens <= 300""")
def history_window(spark, d):
    return retrieve.history_window(fx.read(spark, d, "conversations"), 300).select("conv_id", "turn", "role", "kept_tokens")


# Reinforcement


_HITS = f"{fx.TRAVERSALS_SQL}, ts AS (SELECT edge_id, seed, count(*) AS n FROM te GROUP BY edge_id, seed), th AS (SELECT edge_id, sum(n)::BIGINT AS traversed FROM ts GROUP BY edge_id), {_E}, ch AS (SELECT edge_id, sum(n)::BIGINT AS cited FROM ts JOIN e ON e.id = edge_id WHERE seed IN (source_id, target_id) GROUP BY edge_id)"
_REINFORCED = f"{_HITS}, re AS (SELECT e.*, (weight + (coalesce(traversed, 0) * 0.01::DOUBLE + coalesce(cited, 0) * 0.02::DOUBLE)) * 0.95::DOUBLE AS new_weight FROM e LEFT JOIN th ON th.edge_id = id LEFT JOIN ch ON ch.edge_id = id)"


@query(f"WITH {_HITS} SELECT * FROM th")
def traverse_hits(spark, d):
    return reinforce.traverse_hits(fx.traversals(spark, d))


@query(f"WITH {_HITS} SELECT * FROM ch")
def cite_hits(spark, d):
    return reinforce.cite_hits(fx.traversals(spark, d), fx.table_edges(spark, d))


@query(f"WITH {_HITS} SELECT count(*) AS n FROM th")
def distinct_edges_touched(spark, d):
    return reinforce.traverse_hits(fx.traversals(spark, d)).agg(F.count("*").alias("n"))


@query(f"WITH {_REINFORCED} SELECT id, new_weight AS weight FROM re")
def reinforce_edges(spark, d):
    return reinforce.reinforce_edges(fx.table_edges(spark, d), fx.traversals(spark, d)).select("id", "weight")


@query(f"""WITH {_N}, {_REINFORCED}, m AS (SELECT node, avg(new_weight) AS w FROM (SELECT source_id AS node, new_weight FROM re UNION ALL SELECT target_id, new_weight FROM re) GROUP BY node)
SELECT id, floor(coalesce(w, weight) * 1e6::DOUBLE + 0.3::DOUBLE)::BIGINT AS weight_micros FROM n LEFT JOIN m ON node = id""")
def reinforce_nodes(spark, d):
    """In millionths: means are sums in no fixed order, and the edges' weights often end in a half of the last digit."""
    nodes, _ = reinforce.reinforce(fx.table_nodes(spark, d), fx.table_edges(spark, d), fx.traversals(spark, d))
    return nodes.select("id", F.floor(F.col("weight") * 1e6 + 0.3).alias("weight_micros"))


# Pruning


def _prune_sql(cascade: bool) -> str:
    return f"""WITH {fx.prune_sql(cascade)}, r AS (SELECT *, weight <= 0.1 AS low, CASE WHEN suspicious THEN cnt + 1 ELSE 1 END AS after FROM pe), q AS (SELECT *, greatest(0, 3 - after) AS dr FROM r),
h AS (SELECT coalesce(max((low AND dr = 0)::INT), 0) AS a, coalesce(max((low AND dr = 1)::INT), 0) AS b, coalesce(max((low AND dr = 2)::INT), 0) AS c FROM q), k AS (SELECT 1 + a + a * b + a * b * c AS rounds FROM h)"""


_FIXPOINT = """ SELECT id, CASE WHEN low AND NOT suspicious THEN weight * 0.5::DOUBLE ELSE weight END AS weight, suspicious OR low AS suspicious, (CASE WHEN low THEN after + rounds - 1 ELSE cnt END)::INTEGER AS suspicious_pass_count
FROM q, k WHERE NOT (low AND dr < rounds)"""
_ROUNDS = """, s AS (SELECT unnest([0, 1, 2, 3])::INTEGER AS round)
SELECT round, (SELECT count(*) FROM q WHERE low AND dr = round AND round < 3) AS deleted, CASE WHEN round = 0 THEN (SELECT count(*) FROM q WHERE low AND NOT suspicious) ELSE 0 END AS marked FROM s, k WHERE round < rounds"""


@query(_prune_sql(False) + _FIXPOINT)
def prune_fixpoint(spark, d):
    return prune.survivors(prune.prune(fx.prune_input(spark, d, False))).select("id", "weight", "suspicious", "suspicious_pass_count")


@query(_prune_sql(True) + _FIXPOINT)
def prune_fixpoint_cascade(spark, d):
    return prune.survivors(prune.prune(fx.prune_input(spark, d, True))).select("id", "weight", "suspicious", "suspicious_pass_count")


@query(_prune_sql(True) + _ROUNDS)
def prune_round_stats(spark, d):
    return prune.round_stats(fx.prune_input(spark, d, True))


# Merging


@query(f"WITH {_GHOSTS} SELECT id FROM gn WHERE merged_into IS NULL OR id IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def ghost_cleanup(spark, d, most=10):
    """Merged suppliers go where no edge is left; here those with money keep one."""
    kept = fx.read(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("source_id"))
    edges = kept.withColumn("target_id", F.lit("n0"))
    return merge.drop_ghosts(_ghosts(spark, d, most), edges).select("id")


@query(f"""WITH {_E}, {fx.REMAP_SQL}, m AS (SELECT e.*, coalesce(a.new_id, source_id) AS s, coalesce(b.new_id, target_id) AS t, a.new_id IS NOT NULL OR b.new_id IS NOT NULL AS touched FROM e LEFT JOIN rm AS a ON a.old_id = source_id LEFT JOIN rm AS b ON b.old_id = target_id)
SELECT source_id, target_id, type, weight, 1::BIGINT AS n FROM m WHERE NOT touched UNION ALL SELECT s, t, type, sum(weight), 1::BIGINT FROM m WHERE touched AND s <> t GROUP BY s, t, type""")
def edge_migration(spark, d, most=10):
    out = g.migrate(fx.table_edges(spark, d), fx.merge_remap(spark, d, most))
    return out.select("source_id", "target_id", "type", "weight", F.lit(1).cast("long").alias("n"))


_PAIRS = f"{fx.REMAP_SQL}, pr AS (SELECT new_id, min(s) AS x, max(s) AS y FROM (SELECT new_id, old_id[2:]::BIGINT AS s FROM rm) GROUP BY new_id HAVING count(*) = 2)"


@query(f"""WITH {_PAIRS} SELECT 'Supplier' AS type, CASE WHEN a.s_acctbal >= b.s_acctbal THEN a.s_name ELSE b.s_name END AS label, a.s_name || ' / ' || b.s_name AS summary, round(a.s_acctbal + b.s_acctbal, 4) AS weight
FROM pr JOIN supplier AS a ON a.s_suppkey = x JOIN supplier AS b ON b.s_suppkey = y""")
def merge_nodes(spark, d, most=10):
    """Neighbouring suppliers merged, weighed by their account balance."""
    s = fx.read(spark, d, "supplier")
    nodes = fx.shaped(s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.lit("Supplier").alias("type"), F.col("s_name").alias("label"), F.col("s_name").alias("summary"), F.col("s_acctbal").alias("weight"), F.col("s_suppkey").alias("seq")), fx.NODE)
    both = fx.merge_remap(spark, d, most).withColumn("k", F.substring("old_id", 2, 20).cast("long")).groupBy("new_id").agg(F.min_by("old_id", "k").alias("a"), F.max_by("old_id", "k").alias("b"), F.min("k").alias("rank")).where("a <> b")
    side = lambda c: nodes.select(F.col("id").alias(c), F.struct("id", "type", "label", "summary").alias(f"n{c}"))
    shown = both.select("a", "b", "rank").join(side("a"), "a").join(side("b"), "b")
    out, _ = merge.merge_nodes(nodes, both.select("a", "b", "rank"), merge.fused(shown, Providers()), "fx", F.to_timestamp(F.lit(STAMP)))
    return out.where("id like 'm-%'").select("type", "label", "summary", F.round("weight", 4).alias("weight"))


def _over_all(f) -> None:
    """Register ``f`` as <name>_all: all neighbouring suppliers are merged, not ten pairs."""
    name = f"{f.__name__}_all"
    _QUERIES[name] = lambda spark, d: f(spark, d, None)
    _SQL[name] = _SQL[f.__name__].replace("least(10, count(*) // 2)", "count(*) // 2")


for _f in (node_scan, ghost_cleanup, edge_migration, merge_nodes):
    _over_all(_f)


@query("""WITH p AS (SELECT a.s_nationkey AS x, b.s_nationkey AS y FROM supplier AS a JOIN supplier AS b ON b.s_suppkey = a.s_suppkey + 1), v AS (SELECT CASE WHEN x = y THEN 'same' WHEN abs(x - y) = 1 THEN 'same_with_caveats' ELSE 'different' END AS verdict FROM p)
SELECT k.verdict, (SELECT count(*) FROM v WHERE v.verdict = k.verdict) AS n FROM (SELECT unnest(['same', 'different', 'same_with_caveats', 'error']) AS verdict) AS k""")
def verdict_histogram(spark, d):
    """Neighbouring suppliers judged by their nations."""
    key = F.concat(F.lit("s"), F.col("s_suppkey"))
    nation = fx.read(spark, d, "supplier").select(key.alias("id"), F.col("s_nationkey").alias("k"))
    rows = _supplier_pairs(spark, d).join(nation.select(F.col("id").alias("a"), F.struct("k").alias("na")), "a").join(nation.select(F.col("id").alias("b"), F.struct("k").alias("nb")), "b").withColumn("rank", F.lit(1).cast("long"))

    def by_nation(a: dict, b: dict) -> tuple[str, str]:
        gap = abs(a["k"] - b["k"])
        return ("same" if gap == 0 else "same_with_caveats" if gap == 1 else "different"), ""

    return merge.histogram(merge.verdicts(rows, Providers(judge=by_nation))).select("verdict", F.col("n").cast("long").alias("n"))


@query(f"""WITH RECURSIVE {_CAND}, o AS (SELECT a, b, row_number() OVER (ORDER BY seq, rank, a) AS i FROM (SELECT a, b, seq, rank FROM k QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq, rank) = 1)),
w AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, FALSE AS won UNION ALL SELECT o.i, CASE WHEN list_has_any(used, [a, b]) THEN used ELSE list_concat(used, [a, b]) END, NOT list_has_any(used, [a, b]) FROM w JOIN o ON o.i = w.i + 1)
SELECT a, b FROM o JOIN w USING (i) WHERE won""")
def greedy_matching(spark, d):
    """The candidates matched in order, each node once."""
    return merge.matching(_candidates(spark, d)).select("a", "b")


# Links


_WEIGHED = f"{_N}, {_E}, wn AS (SELECT n.*, coalesce(c_acctbal, s_acctbal, 0)::DOUBLE AS w FROM n LEFT JOIN customer ON id = 'c' || c_custkey LEFT JOIN supplier ON id = 's' || s_suppkey)"
_TOPS = f"{_WEIGHED}, tp AS (SELECT id, w FROM wn QUALIFY row_number() OVER (ORDER BY w DESC, seq, id) <= greatest(1, (SELECT count(*) FROM wn) // 10))"
_TWO = f"""{_TOPS}, ad AS (SELECT DISTINCT a AS id, b AS other FROM (SELECT source_id AS a, target_id AS b FROM es UNION ALL SELECT target_id, source_id FROM es) WHERE a <> b),
tw AS (SELECT x.id AS seed_id, min(x.other) AS mid_id, y.other AS remote_id FROM tp JOIN ad AS x ON x.id = tp.id JOIN ad AS y ON y.id = x.other WHERE y.other <> x.id GROUP BY x.id, y.other),
th AS (SELECT tw.* FROM tw LEFT JOIN ad ON ad.id = seed_id AND ad.other = remote_id WHERE ad.id IS NULL)""".replace(f"{_E},", f"{_E}, es AS (SELECT * FROM e WHERE type <> 'SUPPLIES'),")


def _weighed(spark, d):
    money = fx.read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_acctbal").alias("w")).union(fx.read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")), "s_acctbal"))
    return fx.table_nodes(spark, d).drop("weight").join(money, "id", "left").withColumn("weight", F.coalesce("w", F.lit(0.0))).drop("w")


def _ties(spark, d):
    """The edges without the supplies: those that the SQL of two hops follows."""
    return fx.table_edges(spark, d).where("type <> 'SUPPLIES'")


@query(f"WITH {_TOPS} SELECT id, w AS weight FROM tp")
def top_decile_seeds(spark, d):
    return link.top_share(_weighed(spark, d)).select("id", "weight")


@query(f"WITH {_TWO} SELECT * FROM th")
def bfs_two_hop(spark, d):
    nodes = _weighed(spark, d)
    return g.two_hops(nodes, _ties(spark, d), link.top_share(nodes))


@query()
def bfs_two_hop_all(spark, d):
    """bfs_two_hop over all edges, hubs of suppliers and parts too (tests hold it against brute force)."""
    nodes = _weighed(spark, d)
    return g.two_hops(nodes, fx.table_edges(spark, d), link.top_share(nodes))


@query("SELECT 'c' || c_custkey AS seed_id, 'r' || n_regionkey AS remote_id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def direct_edge_anti(spark, d):
    """Customers with their nation and with their region: only the latter have no edge between them."""
    rows = fx.read(spark, d, "customer").join(fx.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    far = F.explode(F.array(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey"))))
    return g.unlinked(rows.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("seed_id"), far.alias("remote_id")), fx.table_edges(spark, d)).select("seed_id", "remote_id")


@query(f"""WITH {_TWO} SELECT th.seed_id, th.mid_id, th.remote_id FROM th JOIN wn AS a ON a.id = seed_id JOIN wn AS b ON b.id = remote_id
QUALIFY row_number() OVER (PARTITION BY least(seed_id, remote_id), greatest(seed_id, remote_id) ORDER BY a.seq, b.seq) = 1""")
def link_candidates(spark, d):
    nodes = _weighed(spark, d)
    return link.untried(nodes, _ties(spark, d), link.seeds(nodes, None), None)


@query()
def link_candidates_all(spark, d):
    """link_candidates over all edges."""
    nodes = _weighed(spark, d)
    return link.untried(nodes, fx.table_edges(spark, d), link.seeds(nodes, None), None)


@query("""WITH a AS (SELECT event_id AS place, value >= 50 AS holds, event_type AS what, CASE WHEN user_id % 3 = 0 THEN '  ' ELSE 'seen' END AS why, CASE WHEN user_id % 2 = 0 THEN 'LIKES' END AS edge_type FROM events)
SELECT place, what, why, coalesce(edge_type, 'RELATED_TO') AS edge_type FROM a WHERE holds AND trim(what) <> '' AND trim(why) <> '' ORDER BY place LIMIT 20""")
def link_accept(spark, d):
    answers = fx.read(spark, d, "events").select(F.col("event_id").alias("place"), (F.col("value") >= 50).alias("holds"), F.col("event_type").alias("what"), F.when(F.col("user_id") % 3 == 0, "  ").otherwise("seen").alias("why"), F.when(F.col("user_id") % 2 == 0, "LIKES").alias("edge_type"))
    return link.first_accepted(answers).select("place", "what", "why", "edge_type")


# Ingestion


def _mentions(spark, d):
    """A language and a source node for each document."""
    docs = fx.read(spark, d, "documents")
    both = F.explode(F.array(F.struct(F.lit("Language").alias("type"), F.col("lang").alias("label"), F.lit(0).alias("pos")), F.struct(F.lit("Source").alias("type"), F.col("source").alias("label"), F.lit(1).alias("pos"))))
    rows = docs.select("doc_id", both.alias("m")).select("doc_id", "m.*")
    return rows.select("type", "label", F.concat(F.lit("from "), F.col("doc_id")).alias("summary"), F.struct("doc_id", "pos").alias("order"), provenance("user", user_id=F.lit("u"), conversation_id=F.lit("c"), turn_id=F.lit("t0"), classification=F.lit("supplement")).alias("provenance"), F.to_timestamp(F.lit(STAMP)).alias("created_at"))


@query("""WITH m AS (SELECT doc_id, 'Language' AS type, lang AS label FROM documents UNION ALL SELECT doc_id, 'Source', source FROM documents)
SELECT type, label, 'from ' || min(doc_id) AS summary FROM m WHERE NOT (type = 'Language' AND label = 'de') GROUP BY type, label""")
def upsert_nodes(spark, d):
    """What documents name, added once each; one language is there already."""
    have = spark.createDataFrame([("old", "Language", "de", 1)], "id string, type string, label string, seq long")
    add, _ = ing.upsert_nodes(have, _mentions(spark, d))
    return add.select("type", "label", "summary")


@query(f"""WITH {_N}, f AS (SELECT label, min_by(id, seq) AS id FROM n GROUP BY label)
SELECT s.id AS source_id, t.id AS target_id, 'BOUGHT' AS type, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN f AS s ON s.label = c_name JOIN f AS t ON t.label = p_name GROUP BY s.id, t.id""")
def upsert_edges(spark, d):
    """An edge from each customer's label to each bought part's label; labels name the first node that has them, and edges are never merged."""
    bought = fx.read(spark, d, "orders").join(fx.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(fx.read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(fx.read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    wanted = bought.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("order"), F.col("c_name").alias("source_label"), F.col("p_name").alias("target_label"), F.lit("BOUGHT").alias("type"))
    nodes = fx.table_nodes(spark, d)
    add, _ = ing.upsert_edge(nodes, fx.table_edges(spark, d), wanted, provenance("user", user_id=F.lit("u"), conversation_id=F.lit("c"), turn_id=F.lit("t0"), classification=F.lit("supplement")), F.to_timestamp(F.lit(STAMP)))
    return add.groupBy("source_id", "target_id", "type").agg(F.count("*").alias("n"))


_GATE = f"t AS (SELECT doc_id::VARCHAR AS doc_id, lang, source, ceil(coalesce(length(text), 0) / 4.0)::BIGINT AS tokens FROM documents)"


@query(f"WITH {_GATE} SELECT doc_id, tokens, tokens <= 8000 AS accepted FROM t")
def ingest_token_gate(spark, d):
    """At the cap for statements, which some documents pass at all scales."""
    docs = fx.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return ing.token_gate(docs, cap=tx.STATEMENT_CAP).select("doc_id", "tokens", "accepted")


def _ingested(spark, d):
    nodes, edges = fx.shaped(fx.table_nodes(spark, d), fx.NODE), fx.shaped(fx.table_edges(spark, d), fx.EDGE)
    return ing.ingest(nodes, edges, fx.stub_extraction(fx.read(spark, d, "documents")), "run", F.to_timestamp(F.lit(STAMP)))


@query("""SELECT type, label, count(*) AS n FROM (SELECT 'Document' AS type, 'doc' || doc_id AS label FROM documents UNION ALL SELECT 'Language', lang FROM documents UNION ALL SELECT 'Source', source FROM documents) WHERE label <> '' GROUP BY type, label""")
def ingest_documents(spark, d):
    """Nodes of an extractor's replies for all documents; nothing is matched across documents."""
    return _ingested(spark, d)["new_nodes"].groupBy("type", "label").agg(F.count("*").alias("n"))


@query("SELECT type, count(*) AS n, count(DISTINCT source_id) AS sources FROM (SELECT 'WRITTEN_IN' AS type, doc_id AS source_id FROM documents WHERE lang <> '' UNION ALL SELECT 'FROM', doc_id FROM documents WHERE source <> '') GROUP BY type")
def ingest_edges(spark, d):
    return _ingested(spark, d)["new_edges"].groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


@query("""SELECT doc_id::VARCHAR AS doc_id, TRUE AS accepted, (1 + (coalesce(lang, '') <> '')::INT + (coalesce(source, '') <> '' AND source <> lang)::INT)::BIGINT AS nodes_added,
((coalesce(lang, '') <> '')::INT + (coalesce(source, '') <> '')::INT)::BIGINT AS edges_added, (1 + (coalesce(lang, '') = '')::INT + (coalesce(source, '') = '')::INT)::BIGINT AS edges_skipped FROM documents""")
def ingest_counters(spark, d):
    return _ingested(spark, d)["counters"].select("doc_id", "accepted", "nodes_added", "edges_added", "edges_skipped")


def _statements(spark, d):
    said = fx.read(spark, d, "conversations").where("role = 'user'")
    return said.select(F.format_string("%010d-%05d", "conv_id", "turn").alias("statement_id"), F.col("text").alias("text"), F.concat(F.lit("u"), F.col("conv_id") % 7).alias("user_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.concat(F.lit("t"), F.col("turn")).alias("turn_id"))


@query(r"""SELECT printf('%010d-%05d', conv_id, turn) AS statement_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(i|my|me|we|our)($|[^a-z])') THEN 'experience' ELSE 'supplement' END AS classification,
ceil(length(text) / 4.0)::BIGINT > 8000 AS compressed, 2::BIGINT AS nodes_touched, 1::BIGINT AS edges_added FROM conversations WHERE role = 'user'""")
def integrate_statements(spark, d):
    """Users' turns integrated; the extractor names the user and the language, the same for all."""
    reply = '{"nodes": [{"type": "Person", "label": "user"}, {"type": "Topic", "label": "talk", "summary": "s"}], "edges": [{"source_label": "user", "target_label": "talk"}, {"source_label": "user", "target_label": "x"}]}'
    kind = lambda t: "experience" if re.search(r"(^|[^a-z])(i|my|me|we|our)($|[^a-z])", t.lower()) else "other"
    nodes, edges = fx.shaped(fx.table_nodes(spark, d), fx.NODE), fx.shaped(fx.table_edges(spark, d), fx.EDGE)
    out = ing.integrate(nodes, edges, _statements(spark, d), F.to_timestamp(F.lit(STAMP)), Providers(extract=lambda t: reply, classify=kind))
    return out["counters"].select("statement_id", "classification", "compressed", "nodes_touched", "edges_added")


# Texts


@query("SELECT doc_id, CASE WHEN ceil(coalesce(length(text), 0) / 4.0) > 300 THEN md5(substring(text, 1, 1200)) ELSE md5(text) END AS kept FROM documents")
def truncate_to_cap(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", F.md5(tx.truncate(F.col("text"), tx.SUMMARY_CAP)).alias("kept"))


@query("SELECT doc_id, ceil(coalesce(length(text), 0) / 4.0)::BIGINT AS tokens, ceil(coalesce(length(text), 0) / 4.0) <= 300 AS fits FROM documents")
def token_counts(spark, d):
    return fx.read(spark, d, "documents").select("doc_id", tx.count_tokens(F.col("text")).alias("tokens"), tx.within(F.col("text"), tx.SUMMARY_CAP).alias("fits"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'experience') THEN 'experience' ELSE 'supplement' END AS classification FROM conversations")
def classify_statements(spark, d):
    return fx.read(spark, d, "conversations").select("conv_id", "turn", tx.classify(F.col("text")).alias("classification"))


#: A reply's JSON in all its states, and what becomes of it.
_JSON = [('{"a": 1}', '{"a": 1}'), ('so: {"a": 2} done', '{"a": 2}'), ('{"a": 3} mid {"b": 1}', "{}"), ("[1, 2]", "{}"), ("", "{}"), ("no", "{}"), ('{"a": {"b": "é"}}', '{"a": {"b": "é"}}')]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{out}')" for i, (_, out) in enumerate(_JSON)) + ") AS t(i, parsed)")
def parse_json_loose(spark, d):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(_JSON)], "i int, text string")
    return rows.select("i", tx.parse_loose_json(F.col("text")).alias("parsed"))


_CALLS = [
    ('<tool_call>{"name": "graph_query", "arguments": {"question": "who"}}</tool_call>', "graph_query", '{"question": "who"}'),
    ('{"function": "graph_query", "parameters": "{\\"question\\": \\"why\\"}"}', "graph_query", '{"question": "why"}'),
    ('<|tool_call|>call:list_recent_merges{k: 5}<|/tool_call|>', "list_recent_merges", '{"k": 5}'),
    ('call:graph_query{question:<|"|>what<|"|>}', "graph_query", '{"question": "what"}'),
    ("call:graph_query{oops oops}", "graph_query", "{}"),
    ("call:drop_all{}", None, None),
    ("just text", None, None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ", ".join("NULL" if x is None else f"'{x}'" for x in r[1:]) + ")" for i, r in enumerate(_CALLS)) + ") AS t(i, name, args)")
def parse_tool_call(spark, d):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(_CALLS)], "i int, text string")
    return rows.select("i", tx.parse_tool_call(F.col("text"), list(tools.TOOLS)).alias("c")).select("i", "c.name", "c.args")


_DOC = "# Types\nintro\n## Company\nlabel\n## Person\nrole\n## Persona\nnone"


@query(f"SELECT * FROM (VALUES ('person', 'Person\nrole'), ('COMP', 'Company\nlabel'), ('none', '{_DOC}'), ('', '{_DOC}')) AS t(name, text)")
def ontology_section(spark, d):
    doc = spark.createDataFrame([(_DOC,)], "text string")
    out = None
    for name in ("person", "COMP", "none", ""):
        one = section(doc, name).select(F.lit(name).alias("name"), "text")
        out = one if out is None else out.union(one)
    return out


# Logs and reports


@query("SELECT event_id AS seq, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_events_of_kind(spark, d):
    events = fx.read(spark, d, "events").select("ts", F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), "user_id")
    return recent_events(events, "click", 10).select("seq", "user_id")


def _runs(spark, d):
    """Events as routing runs: tiers by user, hits by value."""
    e = fx.read(spark, d, "events")
    return e.select((F.col("user_id") % 10 + 1).alias("tier"), (F.col("value") >= 10).cast("long").alias("tool_ok"), (F.col("value") >= 20).cast("long").alias("param_ok"), F.lit(1).cast("long").alias("total"))


@query("SELECT user_id % 10 + 1 AS tier, sum((value >= 10)::INT)::DOUBLE / count(*) AS tool_accuracy, sum((value >= 20)::INT)::DOUBLE / count(*) AS param_accuracy FROM events GROUP BY 1")
def tier_accuracy(spark, d):
    return tools.tier_accuracy(_runs(spark, d))


@query("SELECT event_type AS actual, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def wrong_calls(spark, d):
    rows = fx.read(spark, d, "events").select(F.array(F.lit("click"), F.lit("view")).alias("expected"), F.col("event_type").alias("actual"))
    return tools.wrong_calls(rows)


# Streams


def _folder(spark, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _write_batches(path: str, shape=lambda batch: batch):
    def use(batch: DataFrame, k: int) -> None:
        shape(batch).write.parquet(f"{path}/batch={k}")

    return use


@query(f"WITH {_HITS} SELECT * FROM th")
def log_consume_stream(spark, d):
    """The traversal log written as JSON lines, consumed once by a stream, and counted."""
    base = _folder(spark, "log-stream")
    append_traversals(fx.traversals(spark, d), f"{base}/log")
    consume(traversal_stream(spark, f"{base}/log"), f"{base}/checkpoint", _write_batches(f"{base}/hits", reinforce.traverse_hits))
    return spark.read.parquet(f"{base}/hits").groupBy("edge_id").agg(F.sum("traversed").alias("traversed"))


@query(f"WITH {_HITS} SELECT * FROM th")
def traversal_log_scan(spark, d):
    """The log read as a table; blank and broken lines beside it are passed over."""
    base = _folder(spark, "log-scan")
    append_traversals(fx.traversals(spark, d), base)
    spark.createDataFrame([("",), ("{broken",), ("  ",)], "value string").write.mode("append").text(base)
    return reinforce.traverse_hits(read_traversals(spark, base))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts_stream(spark, d):
    """Events counted by the hour, as a stream with a watermark; the last counts of each window."""
    base = _folder(spark, "windows")
    events = fx.read(spark, d, "events").select("ts", "event_type")
    events.write.parquet(f"{base}/in")
    counted = windowed_counts(spark.readStream.schema(events.schema).parquet(f"{base}/in"))
    counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n").writeStream.outputMode("update").foreachBatch(_write_batches(f"{base}/out")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("start", "event_type").agg(F.max("n").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, (sum(ceil(coalesce(length(text), 0) / 4.0)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM conversations)
SELECT conv_id, count(*) FILTER (used <= 300) AS kept, min(turn) FILTER (used <= 300) AS oldest, coalesce(max(used) FILTER (used <= 300), 0) AS tokens FROM t GROUP BY conv_id""")
def history_window_stream(spark, d):
    """The rolling window of conversations, kept as a stream's state."""
    base = _folder(spark, "history")
    turns = fx.read(spark, d, "conversations").select("conv_id", "turn", "text")
    turns.write.parquet(f"{base}/in")
    rows = history_stream(spark.readStream.schema(turns.schema).parquet(f"{base}/in"), 300)
    rows.writeStream.outputMode("update").foreachBatch(_write_batches(f"{base}/out")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{base}/out")
    return last.groupBy("conv_id").agg(F.max_by(F.struct("kept", "oldest", "tokens"), "batch").alias("r")).select("conv_id", "r.*")


# Mutations


@query(f"WITH {_N} SELECT id, CASE WHEN type = 'Nation' THEN upper(label) || '!' ELSE label END AS label, seq FROM n UNION ALL SELECT 'new' || r_regionkey, r_name, 5000000000 + r_regionkey FROM region")
def node_put(spark, d):
    """Nations overwritten, which keep their place, and nodes added."""
    nodes = fx.table_nodes(spark, d)
    over = nodes.where("type = 'Nation'").withColumn("label", F.concat(F.upper("label"), F.lit("!"))).withColumn("seq", F.col("seq") + 9_000_000_000)
    new = nodes.where("type = 'Region'").withColumn("id", F.regexp_replace("id", "^r", "new")).withColumn("seq", F.col("seq") + 5_000_000_000)
    return g.put_nodes(nodes, over.unionByName(new)).select("id", "label", "seq")


@query(f"WITH {_N}, {_E} SELECT 'node' AS kind, type, count(*) AS n FROM n WHERE type <> 'Supplier' GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM e WHERE source_id NOT LIKE 's%' AND target_id NOT LIKE 's%' GROUP BY type")
def node_delete(spark, d):
    """All suppliers deleted, and every edge that touched one."""
    nodes = fx.table_nodes(spark, d)
    left, edges = g.drop_nodes(nodes, fx.table_edges(spark, d), nodes.where("type = 'Supplier'"))
    return g.types(left).select(F.lit("node").alias("kind"), "*").union(g.types(edges).select(F.lit("edge").alias("kind"), "*"))


@query(f"WITH {_E} SELECT id, source_id, target_id FROM e WHERE id <> 'cn7'")
def edge_delete(spark, d):
    return Graph(fx.table_nodes(spark, d), fx.table_edges(spark, d)).remove_edge("cn7").edges.select("id", "source_id", "target_id")


@query(f"WITH {_E} SELECT id, type FROM e UNION ALL SELECT id, 'TWICE' FROM e WHERE type = 'IN_REGION'")
def edge_append(spark, d):
    """Parallel edges are fine."""
    edges = fx.shaped(fx.table_edges(spark, d), fx.EDGE)
    again = edges.where("type = 'IN_REGION'").withColumn("type", F.lit("TWICE"))
    return Graph(fx.table_nodes(spark, d), edges).add_edges(again).edges.select("id", "type")


@query(f"WITH {_E} SELECT type, count(*) AS n, count(DISTINCT id) AS ids FROM e GROUP BY type")
def graph_save_and_load(spark, d):
    """The graph saved twice and loaded: the second version counts."""
    store = Store(spark, _folder(spark, "store"), "fx")
    nodes = fx.shaped(fx.table_nodes(spark, d), fx.NODE)
    store.save(Graph(nodes, fx.shaped(fx.table_edges(spark, d).limit(0), fx.EDGE)))
    store.save(Graph(nodes, fx.shaped(fx.table_edges(spark, d), fx.EDGE)))
    return store.load().edges.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{label}', {w}::DOUBLE)" for t, label, w in fx.TOY_NODES) + ") AS t(type, label, weight)")
def toy_nodes(spark, d):
    return fx.toy_graph(spark).nodes.select("type", "label", "weight")


# Projections


@query(f"WITH {_SEEDS} SELECT rank, id, id AS label FROM sd")
def citations(spark, d):
    seeds = _seeds(spark, d)
    return retrieve.citations(fx.vector_nodes(spark, d), seeds).select("rank", "id", "label")


@query(f"WITH {_N} SELECT id, label || ': ' || summary AS for_retrieval, type || ': ' || label || ' — ' || summary AS for_merging, '- [' || type || '] ' || label || ': ' || summary AS line FROM n")
def embedding_texts(spark, d):
    t, label, said = F.col("type"), F.col("label"), F.col("summary")
    return fx.table_nodes(spark, d).select("id", tx.retrieval_text(label, said).alias("for_retrieval"), tx.merge_text(t, label, said).alias("for_merging"), tx.context_line(t, label, said).alias("line"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def normalised_vectors(spark, d):
    return fx.read(spark, d, "embeddings").select("vec_id", F.round(normalise(F.col("embedding"))[0], 6).alias("first"))


@query("SELECT 'c' || c_custkey AS id, '[Customer] ' || c_name || ' -> [Nation] ' || n_name || ' -> [Region] ' || r_name AS path FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def path_render(spark, d):
    """The way from each customer to its region."""
    rows = fx.read(spark, d, "customer").join(fx.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(fx.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    step = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).alias("label"))
    return rows.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), tx.path_text(F.array(step("Customer", "c_name"), step("Nation", "n_name"), step("Region", "r_name"))).alias("path"))


@query(f"""WITH {_N}, near AS (SELECT DISTINCT 's' || l_suppkey AS id, 'p' || l_partkey AS other FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
o AS (SELECT near.id, n.label || ': ' || substring(n.summary, 1, 120) AS said, row_number() OVER (PARTITION BY near.id ORDER BY seq, other) AS k, count(*) OVER (PARTITION BY near.id) AS total FROM near JOIN n ON n.id = other),
j AS (SELECT id, string_agg(said, ' / ' ORDER BY k) FILTER (k <= 20) AS shown, max(total) AS total FROM o GROUP BY id)
SELECT 's' || a.s_suppkey AS a, 's' || b.s_suppkey AS b, x.shown, x.total AS n_neighbours FROM supplier AS a JOIN supplier AS b ON b.s_suppkey = a.s_suppkey + 1 JOIN j AS x ON x.id = 's' || a.s_suppkey""")
def judge_projection(spark, d):
    """What a judge sees of the first of two neighbouring suppliers: 20 neighbours at most, and how many there are."""
    nodes = fx.table_nodes(spark, d).withColumn("detail", F.lit(""))
    rows = merge.judge_rows(_supplier_pairs(spark, d), nodes, fx.table_edges(spark, d))
    return rows.select("a", "b", F.array_join("na.neighbours", " / ").alias("shown"), F.col("na.n_neighbours").cast("long").alias("n_neighbours"))


@query("""WITH p AS (SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier AS a JOIN supplier AS b ON b.s_suppkey = a.s_suppkey + 1 WHERE abs(a.s_nationkey - b.s_nationkey) <= 3), h AS (SELECT k, count(*) AS n FROM (SELECT x AS k FROM p UNION ALL SELECT y FROM p) GROUP BY k)
SELECT 's' || s_suppkey AS id, round(s_acctbal * power(0.9::DOUBLE, coalesce(n, 0)), 6) AS weight FROM supplier LEFT JOIN h ON k = s_suppkey""")
def caveat_decay(spark, d):
    """Suppliers judged to be alike with a caveat, by their nations, lose a tenth each time."""
    s = fx.read(spark, d, "supplier")
    key = F.concat(F.lit("s"), F.col("s_suppkey"))
    near = lambda c: s.select(key.alias(c), F.col("s_nationkey").alias(f"k{c}"))
    judged = _supplier_pairs(spark, d).join(near("a"), "a").join(near("b"), "b").where("abs(ka - kb) <= 3").select("a", "b", F.lit("same_with_caveats").alias("verdict"))
    return merge.decay_caveats(s.select(key.alias("id"), F.col("s_acctbal").alias("weight")), judged).select("id", F.round("weight", 6).alias("weight"))


@query(f"WITH {_TOPS} SELECT id FROM tp UNION SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey < 10")
def link_seeds(spark, d):
    """Seeds carried over that still exist, and the heaviest tenth."""
    carried = spark.createDataFrame([(f"s{i}",) for i in range(10)] + [("gone",)], "id string")
    return link.seeds(_weighed(spark, d), carried)


_STRIP = [" a ", "\t b\n", "\u00a0c\u2003", "", " \u3000 ", "d e"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t.strip()}')" for i, t in enumerate(_STRIP)) + ") AS t(i, label)")
def strip_labels(spark, d):
    return spark.createDataFrame(list(enumerate(_STRIP)), "i int, t string").select("i", tx.strip(F.col("t")).alias("label"))


@query()
def window_topk(spark, d):
    """The approximate top lists (tests measure them against the exact ones)."""
    return similarity.window_top_k(fx.vector_nodes(spark, d).select("id", "vector"), 5).select("id", "other", "rank")


@query()
def embedded_nodes(spark, d):
    """Texts of all nodes embedded by the default embedder (a test counts their 3-grams in plain Python): its places other than 0, in millionths."""
    v = embed(tx.retrieval_text(F.col("label"), F.col("summary")))
    some = F.filter(F.transform("v", lambda x, i: F.concat_ws(":", i, F.round(x * 1_000_000).cast("long"))), lambda s: ~s.endswith(":0"))
    return fx.table_nodes(spark, d).select("id", v.alias("v")).select("id", F.size("v").alias("dim"), F.array_join(some, ",").alias("vector"))


@query(fx.PASS_SQL)
def maintenance_pass(spark, d):
    """A whole pass over the tables' graph, with the traversals as its log: its counts.

    Suppliers are what can be merged, nations what can be linked; all other providers are the defaults.
    """
    from graphloom.plans.passrun import run_pass

    providers = Providers(judge=fx.judge_suppliers, link=fx.link_nations)
    graph, report, _ = run_pass(fx.pass_graph(spark, d), fx.traversals(spark, d), "pass-tables", providers, vectors=lambda nodes: fx.supplier_vectors(spark, d, nodes))
    s = report["stats"]
    said = {"edges_traversed": s["reinforce_edges_traversed"], "merge_total": s["merge_total"], "merge_rounds": report["merge_iters"]}
    for k in range(2):
        one = s.get(f"merge_round_{k}", {})
        said |= {f"{c}_{k}": one.get(c, 0) for c in ("candidates", "same", "different", "same_with_caveats")}
    said |= {"prune_total": s["prune_total"], "prune_rounds": report["prune_iters"], "marked": s.get("prune_round_0", {}).get("newly_marked", 0), "link_total": s["link_total"]}
    said |= {"nodes": graph.nodes.count(), "active_nodes": g.active(graph.nodes).count(), "edges": graph.edges.count()}
    return spark.createDataFrame(list(said.items()), "name string, value long")


from graphloom.plans import scenarios  # noqa: E402, F401  registers its queries
