"""Graphs to try things on: a small toy graph, and graphs made of the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.providers import takes
from graphloom.schema import EDGE, NODE, provenance, shaped
from graphloom.sources.store import Graph

#: Fixed values: (type, label, weight) of the toy graph's nodes, and its edges as (source, type, target, weight).
TOY_NODES = [
    ("Company", "Tesla Inc", 3.0), ("Company", "Tesla Motors", 2.5), ("Person", "Elon Musk", 3.0), ("Person", "JB Straubel", 1.5),
    ("Company", "SpaceX", 2.0), ("Company", "X", 1.5), ("Product", "Model S", 1.2), ("Product", "Model 3", 1.2),
    ("Location", "Palo Alto", 1.0), ("Location", "Austin", 1.0), ("Organization", "NHTSA", 1.0), ("Industry", "Electric Vehicles", 1.0),
]
TOY_EDGES = [
    ("Elon Musk", "CEO_OF", "Tesla Inc", 2.0), ("Tesla Motors", "PRODUCES", "Model S", 1.5), ("Tesla Inc", "PRODUCES", "Model 3", 1.5),
    ("Elon Musk", "FOUNDED", "SpaceX", 2.0), ("Elon Musk", "OWNS", "X", 1.5), ("Tesla Inc", "HEADQUARTERED_IN", "Austin", 1.5),
    ("Tesla Motors", "HEADQUARTERED_IN", "Palo Alto", 1.3), ("JB Straubel", "CO_FOUNDED", "Tesla Motors", 1.5),
    ("Model S", "IN_INDUSTRY", "Electric Vehicles", 1.0), ("Model 3", "IN_INDUSTRY", "Electric Vehicles", 1.0),
    ("NHTSA", "REGULATES", "Tesla Inc", 1.2), ("Elon Musk", "RELATED_TO", "NHTSA", 0.05),
]


def toy_graph(spark: SparkSession) -> Graph:
    """12 nodes and 12 edges; the last edge is weak and was marked twice."""
    direct = provenance("direct", raw_doc_id=F.lit("toy"), extraction_run_id=F.lit("toy"))
    key = {label: f"t{i:02d}" for i, (_, label, _) in enumerate(TOY_NODES)}
    nodes = spark.createDataFrame([(key[label], kind, label, f"{label}, a {kind.lower()}.", w, i) for i, (kind, label, w) in enumerate(TOY_NODES)], "id string, type string, label string, summary string, weight double, seq long")
    rows = [(f"e{i:02d}", key[s], key[t], kind, w, w < 0.1, 2 if w < 0.1 else 0, i) for i, (s, kind, t, w) in enumerate(TOY_EDGES)]
    edges = spark.createDataFrame(rows, "id string, source_id string, target_id string, type string, weight double, suspicious boolean, suspicious_pass_count int, seq long")
    return Graph(shaped(nodes.withColumn("provenance", direct), NODE), shaped(edges.withColumn("provenance", direct), EDGE))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of regions, nations, customers, suppliers and parts; ``seq`` puts kinds one after the other."""
    parts = [
        ("region", "r", "r_regionkey", "Region", F.col("r_name"), F.lit("")),
        ("nation", "n", "n_nationkey", "Nation", F.col("n_name"), F.lit("")),
        ("customer", "c", "c_custkey", "Customer", F.col("c_name"), F.col("c_mktsegment")),
        ("supplier", "s", "s_suppkey", "Supplier", F.col("s_name"), F.lit("")),
        ("part", "p", "p_partkey", "Part", F.col("p_name"), F.col("p_type")),
    ]
    out = None
    for k, (name, prefix, key, kind, label, summary) in enumerate(parts):
        rows = read(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key)).alias("id"), F.lit(kind).alias("type"), label.alias("label"), summary.alias("summary"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("merged_into"), (F.lit(k * 1_000_000_000) + F.col(key)).alias("seq"))
        out = rows if out is None else out.unionByName(rows)
    return out


NODES_SQL = """
  SELECT 'r' || r_regionkey AS id, 'Region' AS type, r_name AS label, '' AS summary, 1.0::DOUBLE AS weight, r_regionkey::BIGINT AS seq FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name, '', 1.0::DOUBLE, 1000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name, c_mktsegment, 1.0::DOUBLE, 2000000000 + c_custkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name, '', 1.0::DOUBLE, 3000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'Part', p_name, p_type, 1.0::DOUBLE, 4000000000 + p_partkey FROM part
"""

#: All columns of lineitem, in order: only whole rows are distinct.
LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier -> part edge for each line item, with its return flag and line number. An edge's id is made from its whole row."""
    line = read(spark, sf_dir, "lineitem")
    whole = F.concat_ws("|", *(F.col(c.strip()).cast("string") if c.strip() != "l_shipdate" else F.date_format("l_shipdate", "yyyy-MM-dd") for c in LINE.split(",") if c.strip() not in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), *(F.round(F.col(c) * 100).cast("long") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    return line.select(
        F.concat(F.lit("sp"), F.md5(whole)).alias("id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target_id"),
        F.lit("SUPPLIES").alias("type"), (F.col("l_quantity") / 64).alias("weight"), "l_returnflag", "l_linenumber",
    )


SUPPLIES_SQL = """
  SELECT 'sp' || md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'),
           round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT)) AS id,
         's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id, 'SUPPLIES' AS type, l_quantity / 64 AS weight, l_returnflag, l_linenumber
  FROM lineitem
"""


def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges: nation -> region, customer -> nation, supplier -> nation, and supplies(). ``seq`` is the id's hash: the order is fixed, and means nothing."""
    nation, customer, supplier = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    edge = lambda df, p, key, s, t, tk, kind, w: df.select(F.concat(F.lit(p), F.col(key)).alias("id"), F.concat(F.lit(s), F.col(key)).alias("source_id"), F.concat(F.lit(t), F.col(tk)).alias("target_id"), F.lit(kind).alias("type"), F.lit(w).alias("weight"))
    out = edge(nation, "nr", "n_nationkey", "n", "r", "n_regionkey", "IN_REGION", 1.5)
    out = out.unionByName(edge(customer, "cn", "c_custkey", "c", "n", "c_nationkey", "IN_NATION", 1.0)).unionByName(edge(supplier, "sn", "s_suppkey", "s", "n", "s_nationkey", "IN_NATION", 2.0))
    return out.unionByName(supplies(spark, sf_dir).drop("l_returnflag", "l_linenumber")).withColumn("seq", F.crc32("id"))


EDGES_SQL = f"""
  SELECT 'nr' || n_nationkey AS id, 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id, 'IN_REGION' AS type, 1.5::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'cn' || c_custkey, 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION', 1.0::DOUBLE FROM customer
  UNION ALL SELECT 'sn' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey, 'IN_NATION', 2.0::DOUBLE FROM supplier
  UNION ALL SELECT id, source_id, target_id, type, weight FROM ({SUPPLIES_SQL})
"""


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the embeddings, with the text of a document as summary, and ``vector``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("summary"))
    n = docs.agg(F.count("*").alias("n"))
    v = read(spark, sf_dir, "embeddings").crossJoin(F.broadcast(n))  # one row
    rows = v.join(docs, F.pmod("vec_id", "n") == F.col("doc_id"))
    name = F.concat(F.lit("v"), F.col("vec_id"))
    return rows.select(name.alias("id"), F.concat(F.lit("L"), F.col("label")).alias("type"), name.alias("label"), "summary", F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("merged_into"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("vector"))


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v -> (7 v + 1) mod n, type NEXT."""
    e = read(spark, sf_dir, "embeddings").select("vec_id")
    rows = e.crossJoin(F.broadcast(e.agg(F.count("*").alias("n"))))  # one row
    return rows.select(F.concat(F.lit("e"), F.col("vec_id")).alias("id"), F.concat(F.lit("v"), F.col("vec_id")).alias("source_id"), F.concat(F.lit("v"), F.pmod(F.col("vec_id") * 7 + 1, "n")).alias("target_id"), F.lit("NEXT").alias("type"), F.lit(1.0).alias("weight"), F.col("vec_id").alias("seq"))


VECTORS_SQL = """
vn AS (
  SELECT 'v' || vec_id AS id, 'L' || label AS type, 'v' || vec_id AS label, d.text AS summary, vec_id AS seq, embedding::DOUBLE[] AS vector
  FROM embeddings, (SELECT count(*) AS n FROM documents) AS c JOIN documents AS d ON d.doc_id = vec_id % n),
ve AS (
  SELECT 'e' || vec_id AS id, 'v' || vec_id AS source_id, 'v' || ((7 * vec_id + 1) % n) AS target_id
  FROM embeddings, (SELECT count(*) AS n FROM embeddings) AS c)
"""


def traversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log record for each event: the customer is the seed; the customer's edge and its nation's are touched."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id")
    nation = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = events.join(nation, F.col("user_id") == F.col("c_custkey"), "left")
    seed, own = F.concat(F.lit("c"), F.col("user_id")), F.concat(F.lit("cn"), F.col("user_id"))
    return rows.select(F.lit("graph_query").alias("kind"), F.array(seed).alias("seed_node_ids"), F.array(seed).alias("touched_node_ids"), F.when(F.col("c_nationkey").isNull(), F.array(own)).otherwise(F.array(own, F.concat(F.lit("nr"), F.col("c_nationkey")))).alias("touched_edge_ids"))


TRAVERSALS_SQL = """
tl AS (SELECT event_id, 'c' || user_id AS seed, 'cn' || user_id AS own, 'nr' || c_nationkey AS far FROM events LEFT JOIN customer ON c_custkey = user_id),
te AS (SELECT event_id, seed, own AS edge_id FROM tl UNION ALL SELECT event_id, seed, far FROM tl WHERE far IS NOT NULL)
"""


def prune_input(spark: SparkSession, sf_dir: str, cascade: bool) -> DataFrame:
    """supplies() with marks: returned lines are suspicious, and counts let all rounds delete (cascade) or break after the first."""
    returned = F.col("l_returnflag") == "R"
    count = F.col("l_linenumber") % 3 if cascade else 2 * (F.col("l_linenumber") % 2)
    return supplies(spark, sf_dir).withColumn("suspicious", returned).withColumn("suspicious_pass_count", F.when(returned, count).otherwise(0).cast("int")).drop("l_returnflag", "l_linenumber")


def prune_sql(cascade: bool) -> str:
    count = "l_linenumber % 3" if cascade else "2 * (l_linenumber % 2)"
    return f"pe AS (SELECT id, source_id, target_id, type, weight, l_returnflag = 'R' AS suspicious, CASE WHEN l_returnflag = 'R' THEN {count} ELSE 0 END AS cnt FROM ({SUPPLIES_SQL}))"


def pass_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The tables' graph for a maintenance pass: nations' summaries name their region, and supplies are marked as in prune_input(cascade)."""
    region = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("region "), F.col("n_regionkey")).alias("said"))
    nodes = table_nodes(spark, sf_dir).join(region, "id", "left").withColumn("summary", F.coalesce("said", "summary"))
    line = prune_input(spark, sf_dir, True).withColumn("seq", F.lit(1).cast("long"))
    edges = table_edges(spark, sf_dir).where("type <> 'SUPPLIES'").withColumns({"suspicious": F.lit(False), "suspicious_pass_count": F.lit(0), "seq": F.lit(0).cast("long")})
    return Graph(shaped(nodes, NODE), shaped(edges.unionByName(line), EDGE))


def supplier_vectors(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    """(id, vector) of the suppliers among active nodes: a place each for the pair (2j, 2j + 1), in two digits of base 64, for any supplier, for the nation, and for odd or even.

    Lengths are 1, cosines are 64ths, and all are exact.
    """
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_suppkey").cast("long").alias("k"), F.floor(F.col("s_suppkey") / 2).alias("j"), F.col("s_nationkey").cast("long").alias("nation"))
    rows = s.join(nodes.where("merged_into IS NULL").select("id"), "id", "left_semi")
    places = [(F.lit(0).cast("long"), 0.25), (1 + F.col("j") % 64, 0.75), (65 + F.floor(F.col("j") / 64) % 64, 0.5), (129 + F.col("nation"), 0.25), (160 + F.col("k") % 2, 0.25)]

    def at(i):
        out = F.lit(0.0)
        for place, x in places:
            out = F.when(i == place, x).otherwise(out)
        return out

    return rows.select("id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(161).cast("long")), at).alias("vector"))


def judge_suppliers(a: dict, b: dict) -> tuple[str, str]:
    """Two of three pairs (2j, 2j + 1) are the same; suppliers two apart are so with caveats."""
    x, y = sorted((int(a["id"][1:]), int(b["id"][1:])))
    if x // 2 == y // 2:
        return ("same" if x // 2 % 3 else "different"), "their numbers"
    return ("same_with_caveats" if y - x == 2 else "different"), "their numbers"


@takes(lambda n: n["type"] == "Nation", lambda n: n["type"] == "Nation")
def link_nations(seed: dict, remote: dict, path: str) -> dict:
    """Nations of one region belong together."""
    holds = seed["type"] == remote["type"] == "Nation" and seed["summary"] == remote["summary"]
    return {"holds": holds, "edge_type": "BESIDE", "what": "both lie in a region", "why": path}


def _judged_sql(k: int, suppliers: str) -> str:
    """What a round of merging judges among the suppliers of a table (id, k, j, nation): pairs by rank, verdicts, and those reached in order."""
    return f"""
al{k} AS (SELECT x.id, y.id AS other, (4 + 36 * (x.j % 64 = y.j % 64)::INT + 16 * ((x.j // 64) % 64 = (y.j // 64) % 64)::INT + 4 * (x.nation = y.nation)::INT + 4 * (x.k % 2 = y.k % 2)::INT) / 64::DOUBLE AS sim FROM {suppliers} AS x JOIN {suppliers} AS y ON x.id <> y.id),
tl{k} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS place FROM al{k} QUALIFY place <= 5),
cm{k} AS (SELECT t.id, t.other, count(*) AS n FROM tl{k} AS t JOIN sa AS p ON p.id = t.id JOIN sa AS q ON q.id = t.other AND q.near = p.near GROUP BY t.id, t.other),
ca{k} AS (SELECT t.id AS a, t.other AS b, t.place, substr(t.id, 2)::BIGINT AS seq FROM tl{k} AS t LEFT JOIN cm{k} AS c ON c.id = t.id AND c.other = t.other LEFT JOIN sn AS u ON u.id = t.id LEFT JOIN sn AS v ON v.id = t.other
  WHERE sim >= 0.55::DOUBLE OR coalesce(coalesce(c.n, 0) / nullif(coalesce(u.n, 0) + coalesce(v.n, 0) - coalesce(c.n, 0), 0)::DOUBLE, 0) >= 0.3::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY least(t.id, t.other), greatest(t.id, t.other) ORDER BY seq, place) = 1),
ju{k} AS (SELECT a, b, row_number() OVER (ORDER BY seq, place, a) AS rank, least(substr(a, 2)::BIGINT, substr(b, 2)::BIGINT) AS x, greatest(substr(a, 2)::BIGINT, substr(b, 2)::BIGINT) AS y FROM ca{k}),
ve{k} AS (SELECT *, CASE WHEN x // 2 = y // 2 THEN CASE WHEN (x // 2) % 3 > 0 THEN 'same' ELSE 'different' END WHEN y - x = 2 THEN 'same_with_caveats' ELSE 'different' END AS verdict FROM ju{k}),
wh{k} AS (SELECT unnest([a, b]) AS id, rank AS won FROM ve{k} WHERE verdict = 'same'),
jo{k} AS (SELECT v.* FROM ve{k} AS v LEFT JOIN wh{k} AS p ON p.id = a LEFT JOIN wh{k} AS q ON q.id = b WHERE rank <= coalesce(p.won, rank) AND rank <= coalesce(q.won, rank))"""


#: The counts of a pass over pass_graph(), with the log of traversals(): every step in SQL.
PASS_SQL = f"""
WITH {TRAVERSALS_SQL}, n AS ({NODES_SQL}),
ed AS (SELECT id, source_id, target_id, type, weight, FALSE AS suspicious, 0 AS cnt, 0 AS seq FROM ({EDGES_SQL}) WHERE type <> 'SUPPLIES'
       UNION ALL SELECT id, source_id, target_id, type, weight, l_returnflag = 'R', CASE WHEN l_returnflag = 'R' THEN l_linenumber % 3 ELSE 0 END, 1 FROM ({SUPPLIES_SQL})),
ts AS (SELECT edge_id, seed, count(*) AS n FROM te GROUP BY ALL), th AS (SELECT edge_id, sum(n) AS traversed FROM ts GROUP BY edge_id),
ch AS (SELECT edge_id, sum(n) AS cited FROM ts JOIN ed ON ed.id = edge_id WHERE seed IN (source_id, target_id) GROUP BY edge_id),
re AS (SELECT ed.* REPLACE ((weight + (coalesce(traversed, 0) * 0.01::DOUBLE + coalesce(cited, 0) * 0.02::DOUBLE)) * 0.95::DOUBLE AS weight) FROM ed LEFT JOIN th ON th.edge_id = ed.id LEFT JOIN ch ON ch.edge_id = ed.id),
nw AS (SELECT node, avg(weight) AS w FROM (SELECT source_id AS node, weight FROM re UNION ALL SELECT target_id, weight FROM re) GROUP BY node),
sa AS (SELECT DISTINCT source_id AS id, target_id AS near FROM ed WHERE source_id LIKE 's%'), sn AS (SELECT id, count(*) AS n FROM sa GROUP BY id),
s0 AS (SELECT 's' || s_suppkey AS id, s_suppkey AS k, s_suppkey // 2 AS j, s_nationkey AS nation FROM supplier), {_judged_sql(0, "s0")},
s1 AS (SELECT * FROM s0 WHERE id NOT IN (SELECT id FROM wh0)), {_judged_sql(1, "s1")},
rm AS (SELECT id AS old_id, 'm' || won AS new_id FROM wh0),
mv AS (SELECT re.*, coalesce(a.new_id, source_id) AS s, coalesce(b.new_id, target_id) AS t, a.new_id IS NOT NULL OR b.new_id IS NOT NULL AS touched FROM re LEFT JOIN rm AS a ON a.old_id = source_id LEFT JOIN rm AS b ON b.old_id = target_id),
mg AS (SELECT weight, suspicious, cnt FROM mv WHERE NOT touched
       UNION ALL SELECT sum(weight), arg_min(suspicious, (seq, id)), arg_min(cnt, (seq, id)) FROM mv WHERE touched AND s <> t GROUP BY s, t, type),
lo AS (SELECT suspicious, greatest(0, 3 - CASE WHEN suspicious THEN cnt + 1 ELSE 1 END) AS dr FROM mg WHERE weight <= 0.1),
ro AS (SELECT 1 + a + a * b + a * b * c AS rounds FROM (SELECT coalesce(max((dr = 0)::INT), 0) AS a, coalesce(max((dr = 1)::INT), 0) AS b, coalesce(max((dr = 2)::INT), 0) AS c FROM lo)),
pt AS (SELECT count(*) FILTER (dr < rounds) AS pruned, count(*) FILTER (NOT suspicious) AS marked, coalesce(any_value(rounds), 1) AS rounds FROM lo, ro),
ac AS (SELECT n.id, n.seq, coalesce(w, n.weight) AS w FROM n LEFT JOIN nw ON node = n.id WHERE n.id NOT IN (SELECT old_id FROM rm)
       UNION ALL SELECT new_id, 9000000000, sum(w) FROM rm JOIN nw ON node = old_id GROUP BY new_id),
tp AS (SELECT id FROM ac QUALIFY row_number() OVER (ORDER BY w DESC, seq, id) <= greatest(1, (SELECT count(*) FROM ac) // 10)),
li AS (SELECT count(*) AS links FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
       WHERE 'n' || a.n_nationkey IN (SELECT id FROM tp) OR 'n' || b.n_nationkey IN (SELECT id FROM tp))
SELECT unnest([
  {{'name': 'edges_traversed', 'value': (SELECT count(*) FROM th)}},
  {{'name': 'merge_total', 'value': (SELECT count(*) FROM ve0 WHERE verdict = 'same')}},
  {{'name': 'merge_rounds', 'value': CASE WHEN (SELECT count(*) FROM ve0 WHERE verdict = 'same') > 0 THEN 2 ELSE 1 END}},
  {{'name': 'candidates_0', 'value': (SELECT count(*) FROM ve0)}}, {{'name': 'same_0', 'value': (SELECT count(*) FROM jo0 WHERE verdict = 'same')}},
  {{'name': 'different_0', 'value': (SELECT count(*) FROM jo0 WHERE verdict = 'different')}}, {{'name': 'same_with_caveats_0', 'value': (SELECT count(*) FROM jo0 WHERE verdict = 'same_with_caveats')}},
  {{'name': 'candidates_1', 'value': (SELECT count(*) FROM ve1)}}, {{'name': 'same_1', 'value': (SELECT count(*) FROM jo1 WHERE verdict = 'same')}},
  {{'name': 'different_1', 'value': (SELECT count(*) FROM jo1 WHERE verdict = 'different')}}, {{'name': 'same_with_caveats_1', 'value': (SELECT count(*) FROM jo1 WHERE verdict = 'same_with_caveats')}},
  {{'name': 'prune_total', 'value': (SELECT pruned FROM pt)}}, {{'name': 'prune_rounds', 'value': (SELECT rounds FROM pt)}}, {{'name': 'marked', 'value': (SELECT marked FROM pt)}},
  {{'name': 'link_total', 'value': (SELECT links FROM li)}},
  {{'name': 'nodes', 'value': (SELECT count(*) FROM n) + (SELECT count(*) FROM rm) // 2}}, {{'name': 'active_nodes', 'value': (SELECT count(*) FROM ac)}},
  {{'name': 'edges', 'value': (SELECT count(*) FROM mg) - (SELECT pruned FROM pt) + (SELECT links FROM li)}}
], recursive := true)
"""


def merge_remap(spark: SparkSession, sf_dir: str, most: int | None = 10) -> DataFrame:
    """Suppliers 2k and 2k+1 become m<k>, for the first ``most`` k or as many as there are; None: for all."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    pairs = F.floor(F.count("*") / F.lit(2))
    rows = s.crossJoin(F.broadcast(s.agg((pairs if most is None else F.least(F.lit(most), pairs)).alias("n"))))  # one row
    k = F.floor(F.col("s_suppkey") / F.lit(2))
    return rows.where(k < F.col("n")).select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("old_id"), F.concat(F.lit("m"), k).alias("new_id"))


REMAP_SQL = "rm AS (SELECT 's' || s_suppkey AS old_id, 'm' || (s_suppkey // 2) AS new_id FROM supplier, (SELECT least(10, count(*) // 2) AS n FROM supplier) WHERE s_suppkey // 2 < n)"


def stub_extraction(docs: DataFrame) -> DataFrame:
    """(doc_id, text) whose texts are what an extractor would reply: the document, its language and its source, and two edges."""
    node = lambda kind, label: F.struct(F.lit(kind).alias("type"), label.alias("label"), F.lit("").alias("summary"))
    d, lang, source = F.concat(F.lit("doc"), F.col("doc_id")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    edge = lambda t, kind: F.struct(d.alias("source_label"), t.alias("target_label"), F.lit(kind).alias("type"))
    reply = F.struct(F.array(node("Document", d), node("Language", lang), node("Source", source)).alias("nodes"), F.array(edge(lang, "WRITTEN_IN"), edge(source, "FROM"), edge(F.lit("nowhere"), "FROM")).alias("edges"))
    return docs.select("doc_id", F.to_json(reply).alias("text"))
