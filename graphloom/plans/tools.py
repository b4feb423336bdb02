"""The tools by which a chat model uses a stored graph, and the loop that runs them."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.providers import Providers
from graphloom.functions.text import CONTEXT_BUDGET, tool_call
from graphloom.functions.vectors import hashed_vector
from graphloom.operators.ingest import ingest, upsert_edge, upsert_nodes
from graphloom.operators.graph import counts, types
from graphloom.operators.retrieve import citations, retrieve, traversal_records
from graphloom.operators.similarity import top_k
from graphloom.plans.passrun import maintain
from graphloom.schema import provenance
from graphloom.session import durable
from graphloom.sources.logs import append_traversals, unread
from graphloom.sources.store import Graph, Store, recent_events
from graphloom.sources.texts import read_text, section

#: Name -> (what it is for, {argument: (type, default)}, arguments that it must have).
TOOLS = {
    "graph_query": ("Answer a question from the graph.", {"question": ("string", None)}, ["question"]),
    "trigger_sleep_pass": ("Run the maintenance pass.", {}, []),
    "get_graph_stats": ("Count nodes and edges, by type.", {}, []),
    "list_recent_merges": ("The newest merges.", {"k": ("integer", 10)}, []),
    "list_recent_prunings": ("The newest deleted edges.", {"k": ("integer", 10)}, []),
    "show_provenance": ("Where a node came from.", {"node_or_edge_id": ("string", None)}, ["node_or_edge_id"]),
    "read_ontology": ("The ontology, or one section of it.", {"section": ("string", None)}, []),
    "run_plant_recover_eval": ("Not available yet.", {}, []),
    "compare_with_baseline": ("Not available yet.", {}, []),
    "upsert_node": ("Add an entity unless it exists.", {"type": ("string", None), "label": ("string", None), "summary": ("string", None)}, ["type", "label"]),
    "upsert_edge": ("Link two entities by label.", {"source_label": ("string", None), "target_label": ("string", None), "type": ("string", None)}, ["source_label", "target_label", "type"]),
    "ingest_file": ("Ingest a file of the folder of raw documents.", {"filename": ("string", None)}, ["filename"]),
}
READING_TOOLS = [t for t in TOOLS if t not in ("upsert_node", "upsert_edge")]
PAUSED = "The maintenance pass is running; ask again when it is done."
SYSTEM = "You answer from a knowledge graph. Use a tool where one fits; otherwise answer directly."
MOST_STEPS = 5


def schemas(names: list[str] | None = None) -> list[dict]:
    """JSON schemas of the named tools that exist, in the order asked."""
    out = []
    for name in TOOLS if names is None else names:
        if name in TOOLS:
            about, args, needed = TOOLS[name]
            fields = {a: {"type": kind} | ({} if default is None else {"default": default}) for a, (kind, default) in args.items()}
            out.append({"type": "function", "function": {"name": name, "description": about, "parameters": {"type": "object", "properties": fields, "required": needed}}})
    return out


@dataclass
class Route:
    """What a model chose: a tool and its arguments, or a text."""

    tool: str | None = None
    args: dict | None = None
    text: str | None = None
    error: str | None = None


def session_user(turns: int, user_id: str = "demo-user", conversation_id: str = "demo-conv") -> dict:
    return {"user_id": user_id, "conversation_id": conversation_id, "turn_id": f"t{turns}"}


class Agent:
    """Runs tools on a store. answer(question, context) makes the final text of a graph query; chat is a client's chat method."""

    def __init__(self, store: Store, log_path: str, raw_folder: str, ontology_path: str, chat: Callable | None = None, answer: Callable[[str, str], str] | None = None, tools: list[str] | None = None, providers: Providers = Providers(), user: dict | None = None, embed_question: Callable = lambda q: hashed_vector(q).tolist()):
        self.store, self.log_path, self.raw_folder, self.ontology_path = store, log_path, raw_folder, ontology_path
        self.chat, self.answer, self.providers, self.user = chat, answer or (lambda q, context: context), providers, user or session_user(0)
        self.embed_question = embed_question  # as the store's embedder
        self.exposed = [t for t in (list(TOOLS) if tools is None else tools) if t in TOOLS]

    def run(self, name: str, args: dict) -> dict:
        if name not in TOOLS:
            return {"error": f"unknown tool {name}"}
        return getattr(self, f"_{name}")(args)

    def _graph_query(self, args: dict) -> dict:
        question, graph, spark = str(args.get("question", "")), self.store.load(), self.store.spark
        seeds = durable(top_k(self.store.vectors(), list(self.embed_question(question))).select(F.lit("q").alias("query_id"), "id", "rank"))
        included, touched = (durable(x) for x in retrieve(graph.nodes, graph.edges, seeds, CONTEXT_BUDGET))
        questions = spark.createDataFrame([("q", question)], "query_id string, question string")
        append_traversals(traversal_records(included, touched, seeds, questions, F.lit(datetime.now(timezone.utc).isoformat())), self.log_path)
        lines = [r["line"] for r in included.orderBy("place").select("line").collect()]  # within the token budget
        cited = [r.asDict() for r in citations(graph.nodes, seeds).orderBy("rank").select("id", "label").collect()]  # k rows
        return {"answer": self.answer(question, "\n".join(lines)), "citations": cited}

    def _trigger_sleep_pass(self, args: dict) -> dict:
        records, files = unread(self.store.spark, self.log_path, self.store.taken())
        return maintain(self.store, records, self.providers, took=durable(files))

    def _get_graph_stats(self, args: dict) -> dict:
        graph = self.store.load()
        kinds = {key: {r["type"]: r["n"] for r in types(rows).collect()} for key, rows in (("node_types", graph.nodes), ("edge_types", graph.edges))}
        return counts(graph.nodes, graph.edges).first().asDict() | kinds

    def _recent(self, kind: str, args: dict) -> dict:
        rows = recent_events(self.store.events(), kind, int(args.get("k", 10)))
        return {"events": [r.asDict() | json.loads(r["payload"] or "{}") for r in rows.drop("seq").collect()]}

    def _list_recent_merges(self, args: dict) -> dict:
        return self._recent("merge", args)

    def _list_recent_prunings(self, args: dict) -> dict:
        return self._recent("prune", args)

    def _show_provenance(self, args: dict) -> dict:
        return json.loads(self.store.load().show_provenance(str(args.get("node_or_edge_id", ""))).first()["provenance"])

    def _read_ontology(self, args: dict) -> dict:
        folder, _, name = self.ontology_path.rpartition("/")
        found = read_text(self.store.spark, folder, name)
        if "error" in found:
            return {"content": "", "note": found["error"]}
        doc = self.store.spark.createDataFrame([(found["text"],)], "text string")
        return {"content": section(doc, args.get("section")).first()["text"]}

    def _run_plant_recover_eval(self, args: dict) -> dict:
        return {"status": "not_implemented"}

    _compare_with_baseline = _run_plant_recover_eval

    def _write(self, args: dict) -> tuple:
        return self.store.load(), F.current_timestamp(), provenance("user", **{k: F.lit(v) for k, v in self.user.items()}, classification=F.lit("supplement"))

    def _upsert_node(self, args: dict) -> dict:
        graph, now, prov = self._write(args)
        row = [(str(args.get("type", "Entity")), str(args.get("label", "")), str(args.get("summary", "")), 0)]
        new = self.store.spark.createDataFrame(row, "type string, label string, summary string, order int").withColumn("provenance", prov).withColumn("created_at", now)
        add, ids = upsert_nodes(graph.nodes, new)
        found = ids.first()
        if not found["existed"]:
            self.store.save(Graph(graph.nodes.unionByName(add), graph.edges))
        return {"id": found["id"], "type": row[0][0], "label": row[0][1]}

    def _upsert_edge(self, args: dict) -> dict:
        graph, now, prov = self._write(args)
        row = [(0, str(args.get("source_label", "")), str(args.get("target_label", "")), str(args.get("type", "RELATED_TO")))]
        add, report = upsert_edge(graph.nodes, graph.edges, self.store.spark.createDataFrame(row, "order int, source_label string, target_label string, type string"), prov, now)
        said = report.first()
        if not (said["source_found"] and said["target_found"]):
            return {"error": "no node with that label", "source_found": said["source_found"], "target_found": said["target_found"]}
        made = add.first()
        self.store.save(Graph(graph.nodes, graph.edges.unionByName(add)))
        return {"source_id": made["source_id"], "target_id": made["target_id"], "type": made["type"]}

    def _ingest_file(self, args: dict) -> dict:
        found = read_text(self.store.spark, self.raw_folder, args.get("filename"))
        if "error" in found:
            return found
        graph, run_id = self.store.load(), f"m1-{secrets.token_hex(4)}"
        docs = self.store.spark.createDataFrame([(found["name"], found["text"])], "doc_id string, text string")
        made = ingest(graph.nodes, graph.edges, docs, run_id, F.current_timestamp(), self.providers)
        c = made["counters"].first()
        if not c["accepted"]:
            return {"error": f"{found['name']} has {c['tokens']} tokens, which is over the cap"}
        self.store.save(Graph(made["nodes"], made["edges"]))
        return {"status": "ok", "filename": found["name"], "run_id": run_id} | {k: c[k] for k in ("nodes_added", "edges_added", "edges_skipped")}

    def _choose(self, messages: list[dict], temperature: float) -> tuple[tuple[str, str, str] | None, str]:
        """((call id, tool, arguments as JSON) or None, text) of one reply; only a reply's first call counts."""
        reply = self.chat(messages, tools=schemas(self.exposed), temperature=temperature)
        text = reply.get("content") or ""
        if reply.get("tool_calls"):
            c = reply["tool_calls"][0]
            return (c.get("id") or f"fb_{secrets.token_hex(4)}", c["function"]["name"], c["function"].get("arguments") or "{}"), text
        said = tool_call(text, self.exposed)
        return (None if said is None else (f"fb_{secrets.token_hex(4)}", said[0], json.dumps(said[1]))), text

    def _start(self, message: str, history: list[dict] | None) -> list[dict]:
        return [{"role": "system", "content": SYSTEM}, *(history or []), {"role": "user", "content": message}]

    def route(self, message: str, history: list[dict] | None = None) -> Route:
        """Which tool the model would use; nothing is run."""
        if self.store.pass_running:
            return Route(text=PAUSED)
        try:
            choice, text = self._choose(self._start(message, history), 0.7)
        except Exception as e:  # noqa: BLE001  whatever the client raises is reported
            return Route(error=str(e))
        if choice is None:
            return Route(text=text)
        try:
            args = json.loads(choice[2])
        except ValueError:
            args = None
        return Route(choice[1], args, text)

    def call(self, message: str, history: list[dict] | None = None) -> str:
        """The model's answer after it used tools, MOST_STEPS at most; then it must answer without."""
        if self.store.pass_running:
            return PAUSED
        messages = self._start(message, history)
        for step in range(MOST_STEPS):
            choice, text = self._choose(messages, 0.2 if step else 0.7)
            if choice is None:
                return text
            call_id, name, raw = choice
            try:
                args = json.loads(raw)
            except ValueError:
                args = {}
            result = self.run(name, args if isinstance(args, dict) else {})
            messages.append({"role": "assistant", "tool_calls": [{"id": call_id, "type": "function", "function": {"name": name, "arguments": raw}}]})
            messages.append({"role": "tool", "tool_call_id": call_id, "content": json.dumps(result, default=str, ensure_ascii=False)})
        return self.chat(messages, temperature=0.2).get("content") or ""


def tier_accuracy(runs: DataFrame) -> DataFrame:
    """(tier, tool_accuracy, param_accuracy) of routing runs (tier, tool_ok, param_ok, total); runs that failed count as misses through ``total``."""
    return runs.groupBy("tier").agg(*((F.sum(c) / F.sum("total")).alias(f"{c.removesuffix('_ok')}_accuracy") for c in ("tool_ok", "param_ok")))


def wrong_calls(runs: DataFrame) -> DataFrame:
    """(actual, n): tools that were called where others were expected. runs: (expected: array of accepted tools, actual)."""
    return runs.where(~F.array_contains("expected", F.coalesce("actual", F.lit("None")))).groupBy(F.coalesce("actual", F.lit("None")).alias("actual")).agg(F.count("*").alias("n"))
