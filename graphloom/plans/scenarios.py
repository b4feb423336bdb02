"""Registered queries that play a scene on a stored graph, and some smaller ones; what must come out is SQL, or literals in it."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from graphloom.functions.providers import Providers, backend_of
from graphloom.operators import ingest, merge
from graphloom.operators.graph import active
from graphloom.plans import fixtures as fx
from graphloom.plans import tools
from graphloom.plans.passrun import maintain
from graphloom.plans.registry import STAMP, _folder, _supplier_pairs, query
from graphloom.schema import EDGE, NODE, provenance, shaped, stable_id
from graphloom.sources.logs import append_traversals, read_traversals
from graphloom.sources.store import Graph, Store
from graphloom.sources.texts import read_text
from graphloom.streaming.log_consumer import upsert_stream

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def literals(rows: list[tuple], *columns: str) -> str:
    """SQL for a table of texts and whole numbers."""
    said = lambda x: "NULL" if x is None else f"{x}::BIGINT" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows) + f") AS t({', '.join(columns)})"


def _toy_store(spark, name: str) -> tuple[str, Store]:
    base = _folder(spark, name)
    store = Store(spark, f"{base}/graph", "toy")
    store.save(fx.toy_graph(spark))
    return base, store


def _apart(nodes):
    """Two nodes that name one company are alike; no others are."""
    labels = [label for _, label, _ in fx.TOY_NODES]
    at = F.when(F.col("label").startswith("Tesla"), 0).otherwise(F.coalesce(F.array_position(F.array(*map(F.lit, labels)), F.col("label")), F.lit(len(labels) + 1)))
    return active(nodes).select("id", F.transform(F.sequence(F.lit(0), F.lit(len(labels) + 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0)).alias("vector"))


_EVENTS = [("link_form", 1), ("link_round_done", 2), ("merge", 1), ("merge_round_done", 2), ("pass_end", 1), ("pass_start", 1), ("prune", 1), ("prune_round_done", 2), ("reinforce", 1)]


@query(literals(_EVENTS, "kind", "n"))
def toy_pass_events(spark, d):
    """The events of a pass over the stored toy graph, as its log has them."""
    _, store = _toy_store(spark, "toy-pass")
    maintain(store, None, vectors=_apart, now=NOW)
    return store.events().groupBy("kind").agg(F.count("*").alias("n"))


@query(literals([("active", 11), ("edges", 12), ("link_iters", 2), ("merge_iters", 2), ("nodes", 13), ("prune_iters", 2), ("stamps", 1), ("version", 2)], "name", "value"))
def toy_pass_saved(spark, d):
    """What a pass over the toy graph saves and reports; all its events bear the pass's own time."""
    _, store = _toy_store(spark, "toy-saved")
    report, graph = maintain(store, None, vectors=_apart, now=NOW), store.load()
    said = {"active": active(graph.nodes).count(), "edges": graph.edges.count(), "nodes": graph.nodes.count(), "version": store.version()[0]}
    said |= {k: report[k] for k in ("merge_iters", "prune_iters", "link_iters")} | {"stamps": store.events().select("ts").distinct().count()}
    return spark.createDataFrame(list(said.items()), "name string, value long")


@query(literals([(1, 2), (2, 0), (3, 1)], "pass", "traversed"))
def trigger_sleep_pass(spark, d):
    """Three passes by the tool: what one has read the next doesn't count; what came since it does."""
    base, store = _toy_store(spark, "tool-pass")
    agent = tools.Agent(store, f"{base}/log", base, f"{base}/none.md")
    log = lambda *edges: append_traversals(spark.createDataFrame([("graph_query", ["t02"], ["t02"], list(edges))], "kind string, seed_node_ids array<string>, touched_node_ids array<string>, touched_edge_ids array<string>"), f"{base}/log")
    rows = []
    for k, edges in enumerate([("e00", "e01"), (), ("e00",)], 1):
        if edges:
            log(*edges)
        rows.append((k, agent.run("trigger_sleep_pass", {})["stats"]["reinforce_edges_traversed"]))
    return spark.createDataFrame(rows, "pass long, traversed long")


_SCENE = [
    ("upsert_node", {"type": "City", "label": "Ulm"}, ("type", "label"), '{"label": "Ulm", "type": "City"}'),
    ("upsert_node", {"label": "Bonn"}, ("type", "label"), '{"label": "Bonn", "type": "Entity"}'),
    ("upsert_edge", {"source_label": "Ulm", "target_label": "X"}, ("type",), '{"type": "RELATED_TO"}'),
    ("upsert_edge", {"source_label": "Ulm", "target_label": "nowhere", "type": "NEAR"}, ("source_found", "target_found"), '{"source_found": true, "target_found": false}'),
    ("get_graph_stats", {}, ("node_count", "edge_count"), '{"edge_count": 13, "node_count": 14}'),
    ("show_provenance", {"node_or_edge_id": "t00"}, ("kind", "raw_doc_id"), '{"kind": "direct", "raw_doc_id": "toy"}'),
    ("show_provenance", {"node_or_edge_id": "none"}, ("kind",), '{"kind": "not_found"}'),
    ("list_recent_merges", {}, ("events",), '{"events": []}'),
    ("run_plant_recover_eval", {}, ("status",), '{"status": "not_implemented"}'),
    ("compare_with_baseline", {}, ("status",), '{"status": "not_implemented"}'),
    ("no_such_tool", {}, ("error",), '{"error": "unknown tool no_such_tool"}'),
]


@query(literals([(i, name, want) for i, (name, _, _, want) in enumerate(_SCENE)], "i", "tool", "said"))
def tool_scene(spark, d):
    """Tools run one after the other on the toy graph; each write is a saved version that the next tool sees."""
    base, store = _toy_store(spark, "tools")
    agent, rows = tools.Agent(store, f"{base}/log", base, f"{base}/none.md"), []
    for i, (name, args, shown, _) in enumerate(_SCENE):
        said = agent.run(name, args)
        rows.append((i, name, json.dumps({k: said.get(k) for k in shown}, sort_keys=True)))
    return spark.createDataFrame(rows, "i long, tool string, said string")


@query("SELECT r_regionkey::BIGINT AS i, r_name AS label, 1::BIGINT AS nodes_added, 1::BIGINT AS edges_added, 1::BIGINT AS edges_skipped FROM region")
def ingest_file(spark, d):
    """Each region written as a file that an extractor's reply is in, and ingested by the tool."""
    base, store = _toy_store(spark, "ingest")
    rows = []
    for r in fx.read(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect():  # five rows
        edges = [{"source_label": r["r_name"], "target_label": r["r_name"], "type": "SELF"}, {"source_label": r["r_name"], "target_label": "nowhere"}]
        text = json.dumps({"nodes": [{"type": "Region", "label": r["r_name"]}], "edges": edges})
        at = f"{base}/raw{r['r_regionkey']}"
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
        name = spark.read.text(at).select("_metadata.file_name").first()[0]
        said = tools.Agent(store, f"{base}/log", at, f"{base}/none.md").run("ingest_file", {"filename": f"../elsewhere/{name}"})
        rows.append((r["r_regionkey"], r["r_name"], said["nodes_added"], said["edges_added"], said["edges_skipped"]))
    kept = store.load().nodes.where("type = 'Region'").select("label")
    return spark.createDataFrame(rows, "i long, label string, nodes_added long, edges_added long, edges_skipped long").join(kept, "label").select("i", "label", "nodes_added", "edges_added", "edges_skipped")


@query("SELECT r_regionkey::BIGINT AS i, r_name || chr(10) AS text, 0::BIGINT AS errors FROM region UNION ALL SELECT -1, NULL, 4")
def raw_text_files(spark, d):
    """Regions written as text files and read back by name; names that lead nowhere are errors, and raise nothing."""
    base, rows = _folder(spark, "raw"), []
    for r in fx.read(spark, d, "region").select("r_regionkey", "r_name").collect():  # five rows
        at = f"{base}/{r['r_regionkey']}"
        spark.createDataFrame([(r["r_name"],)], "value string").coalesce(1).write.text(at)
        name = spark.read.text(at).select("_metadata.file_name").first()[0]
        found = read_text(spark, at, f"a\\..\\{name}")
        rows.append((r["r_regionkey"], found.get("text"), int("error" in found)))
    rows.append((-1, None, sum("error" in read_text(spark, f"{base}/0", x) for x in ("none.txt", "", "..", None))))
    return spark.createDataFrame(rows, "i long, text string, errors long")


@query(literals([(i, t) for i, t in enumerate(tools.READING_TOOLS)] + [(100, "read_ontology"), (101, "graph_query")], "i", "tool"))
def exposed_tools(spark, d):
    """The tools that only read, and a list of wanted ones of which those that don't exist are left out."""
    agent = lambda names: tools.Agent(None, "", "", "", tools=names).exposed
    rows = list(enumerate(agent(tools.READING_TOOLS))) + list(enumerate(agent(["read_ontology", "nothing", "graph_query"]), 100))
    return spark.createDataFrame(rows, "i long, tool string")


@query(literals([("None", 10), ("0", 1), ("3", 3), ("40", 12)], "k", "n"))
def recent_defaults(spark, d):
    """How many of twelve events a tool shows: ten unless told, one at least; a number may be a text."""
    base, store = _toy_store(spark, "events")
    store.log(spark.range(12).select(F.lit(NOW).alias("ts"), F.lit("merge").alias("kind"), F.col("id").alias("seq"), F.lit("{}").alias("payload")))
    agent = tools.Agent(store, f"{base}/log", base, f"{base}/none.md")
    rows = [(str(k), len(agent.run("list_recent_merges", {} if k is None else {"k": k})["events"])) for k in (None, 0, "3", 40)]
    return spark.createDataFrame(rows, "k string, n long")


_REPLIES = ["call:get_graph_stats{}", '{"name": "get_graph_stats", "arguments": "{}"}', "call:drop_all{}", "plain words", "<tool_call>read_ontology{section: <|\"|>x<|\"|>}</tool_call>"]
_ROUTES = [("get_graph_stats", "{}"), ("get_graph_stats", "{}"), (None, None), (None, None), ("read_ontology", '{"section": "x"}')]


@query(literals([(i, t, a) for i, (t, a) in enumerate(_ROUTES)], "i", "tool", "args"))
def routes(spark, d):
    """Which tool a reply in text chooses; nothing is run."""
    _, store = _toy_store(spark, "routes")
    rows = []
    for i, reply in enumerate(_REPLIES):
        route = tools.Agent(store, "", "", "", chat=lambda *a, said=reply, **b: {"content": said}).route("which?")
        rows.append((i, route.tool, None if route.args is None else json.dumps(route.args)))
    return spark.createDataFrame(rows, "i long, tool string, args string")


@query(literals([("answered", "12 nodes"), ("calls", "2"), ("never done", "at last"), ("steps", "6"), ("paused", tools.PAUSED)], "name", "said"))
def agent_loop(spark, d):
    """A model that uses a tool and answers, one that never stops using it, and one that asks while a pass runs."""
    base, store = _toy_store(spark, "loop")
    asked = []

    def good(messages, tools=None, temperature=0.0):
        asked.append(1)
        return {"content": "call:get_graph_stats{}"} if len(messages) == 2 else {"content": f"{json.loads(messages[-1]['content'])['node_count']} nodes"}

    agent = tools.Agent(store, f"{base}/log", base, f"{base}/none.md", chat=good)
    rows = [("answered", agent.call("how many?")), ("calls", str(len(asked)))]
    asked.clear()

    def stubborn(messages, tools=None, temperature=0.0):
        asked.append(1)
        return {"content": "call:compare_with_baseline{}" if tools else "at last"}

    agent.chat = stubborn
    rows += [("never done", agent.call("again?")), ("steps", str(len(asked)))]
    store.pass_running = True
    return spark.createDataFrame([*rows, ("paused", agent.call("now?"))], "name string, said string")


@query(literals([("agent", "", "local"), ("agent", "backend", "other"), ("agent", "both", "own"), ("backend", "both", "other"), ("backend", "", "local")], "role", "named", "backend"))
def chat_backends(spark, d):
    """The backend of each role: its own, or that of the role it falls back to."""
    env = {"": {}, "backend": {"GRAPHLOOM_BACKEND": "other"}, "both": {"GRAPHLOOM_BACKEND": "other", "GRAPHLOOM_AGENT": "own"}}
    rows = [(role, named, backend_of(role, env[named])) for role, named in (("agent", ""), ("agent", "backend"), ("agent", "both"), ("backend", "both"), ("backend", ""))]
    return spark.createDataFrame(rows, "role string, named string, backend string")


@query("SELECT turn, 'demo-user' AS user_id, 'demo-conv' AS conversation_id, 't' || turn AS turn_id FROM conversations WHERE conv_id = 0")
def session_contexts(spark, d):
    """Who writes, at each turn of a conversation."""
    turns = [r["turn"] for r in fx.read(spark, d, "conversations").where("conv_id = 0").select("turn").collect()]  # of one conversation
    rows = [(t, *(tools.session_user(t)[k] for k in ("user_id", "conversation_id", "turn_id"))) for t in turns]
    return spark.createDataFrame(rows, "turn int, user_id string, conversation_id string, turn_id string").withColumn("turn", F.col("turn").cast(fx.read(spark, d, "conversations").schema["turn"].dataType))


@query("""WITH p AS (SELECT a.s_suppkey AS x, b.s_suppkey AS y, a.s_name AS ax, b.s_name AS bx, a.s_acctbal AS aw, b.s_acctbal AS bw, a.s_nationkey AS an, b.s_nationkey AS bn FROM supplier AS a JOIN supplier AS b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 2 = 0)
SELECT 's' || x AS a, 's' || y AS b, 'nation ' || an || chr(10) || chr(10) || '---' || chr(10) || 'nation ' || bn || chr(10) || chr(10) || 'Reconciliation: ' AS detail,
  'fx:merge:' || CASE WHEN aw >= bw THEN ax || '+' || bx ELSE bx || '+' || ax END AS operation_id,
  'm-' || substr(sha256('fx' || chr(31) || 's' || x || chr(31) || 's' || y), 1, 32) AS id FROM p""")
def merged_details(spark, d):
    """Details, operation ids and ids of all neighbouring suppliers merged."""
    s = fx.read(spark, d, "supplier")
    nodes = shaped(s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.lit("Supplier").alias("type"), F.col("s_name").alias("label"), F.col("s_name").alias("summary"), F.concat(F.lit("nation "), F.col("s_nationkey")).alias("detail"), F.col("s_acctbal").alias("weight"), F.col("s_suppkey").alias("seq")), NODE)
    pairs = _supplier_pairs(spark, d).withColumn("rank", F.substring("a", 2, 20).cast("long")).where("rank % 2 = 0")
    side = lambda c: nodes.select(F.col("id").alias(c), F.struct("id", "type", "label", "summary").alias(f"n{c}"))
    fusions = merge.fused(pairs.join(side("a"), "a").join(side("b"), "b"), Providers())
    out, remap = merge.merge_nodes(nodes, pairs, fusions, "fx", F.to_timestamp(F.lit(STAMP)))
    ends = remap.withColumn("k", F.substring("old_id", 2, 20).cast("long")).groupBy(F.col("new_id").alias("id")).agg(F.min_by("old_id", "k").alias("a"), F.max_by("old_id", "k").alias("b"))
    return out.join(ends, "id").select("a", "b", "detail", F.col("provenance.operation_id").alias("operation_id"), "id")


@query("SELECT 'c' || c_custkey AS id, 'u-' || substr(sha256(c_mktsegment || chr(31) || c_name), 1, 32) AS made FROM customer")
def stable_ids(spark, d):
    """Ids made from what they name."""
    rows = fx.read(spark, d, "customer")
    return rows.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), stable_id("u-", F.col("c_mktsegment"), F.col("c_name")).alias("made"))


@query("""SELECT doc_id::VARCHAR AS statement_id, ceil(coalesce(length(text), 0) / 4.0)::BIGINT > 8000 AS compressed, ceil(coalesce(length(text), 0) / 4.0)::BIGINT AS original_tokens,
least(ceil(coalesce(length(text), 0) / 4.0)::BIGINT, 8000) AS compressed_tokens FROM documents""")
def compressed_statements(spark, d):
    """All documents as statements of a user: those over the soft cap are shortened to it."""
    said = fx.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("statement_id"), "text", F.lit("u").alias("user_id"), F.lit("c").alias("conversation_id"), F.lit("t").alias("turn_id"))
    empty = fx.toy_graph(spark)
    out = ingest.integrate(empty.nodes, empty.edges, said, F.lit(NOW), Providers(extract=lambda text: ""))
    return out["counters"].select("statement_id", "compressed", "original_tokens", "compressed_tokens")


@query("""SELECT 'Segment' AS type, c_mktsegment AS label, arg_min(c_name, c_custkey) AS summary FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'Customer', c_name, c_mktsegment FROM customer""")
def upsert_node_stream(spark, d):
    """Customers and their segments upserted as a stream into an empty graph: the first of a label stays."""
    base = _folder(spark, "upserts")
    c = fx.read(spark, d, "customer")
    prov = provenance("user", user_id=F.lit("u"), conversation_id=F.lit("c"), turn_id=F.lit("t"), classification=F.lit("supplement"))
    rows = c.select(F.lit("Segment").alias("type"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("summary"), F.col("c_custkey").cast("long").alias("order"))
    rows = rows.union(c.select(F.lit("Customer"), "c_name", "c_mktsegment", F.col("c_custkey").cast("long"))).withColumn("provenance", prov).withColumn("created_at", F.lit(NOW))
    rows.write.parquet(f"{base}/in")
    store = Store(spark, f"{base}/graph")
    toy = fx.toy_graph(spark)
    store.save(Graph(toy.nodes.limit(0), shaped(toy.edges.limit(0), EDGE)))
    upsert_stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), store, f"{base}/checkpoint")
    return store.load().nodes.select("type", "label", "summary")


@query(literals([('{"kind":"a"}', 1), ('{"kind":"b"} junk', 0), ('{"kind":"c"}]', 0), ("[1]", 0), ("", 0), ('{"kind":"d","x":1}', 1)], "line", "records"))
def strict_log_lines(spark, d):
    """Which lines of a log are records: one JSON object from end to end."""
    base, rows = _folder(spark, "lines"), []
    for i, line in enumerate(['{"kind":"a"}', '{"kind":"b"} junk', '{"kind":"c"}]', "[1]", "", '{"kind":"d","x":1}']):
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{base}/{i}")
        rows.append((line, read_traversals(spark, f"{base}/{i}").count()))
    return spark.createDataFrame(rows, "line string, records long")
