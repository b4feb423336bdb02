"""Graph operators against small plain-Python models, and the toy graph's known results."""

import json
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timezone
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.functions.providers import BACKENDS, Providers, client_for, takes
from graphloom.functions.text import loose_json, strip, tool_call
from graphloom.functions.vectors import cosine, hashed_vector, normalise
from graphloom.operators import graph as g
from graphloom.operators import ingest, link, merge, prune, reinforce, retrieve, similarity
from graphloom.plans import tools
from graphloom.plans.fixtures import toy_graph
from graphloom.plans.passrun import maintain, run_pass
from graphloom.schema import EDGE, NODE, empty, provenance, shaped
from graphloom.session import in_order
from graphloom.sources.logs import append_traversals, read_traversals, unread
from graphloom.sources.store import Graph, Store, recent_events
from graphloom.sources.texts import basename, read_text
from graphloom.streaming.log_consumer import consume, history_stream, reinforce_from_log, traversal_stream, upsert_stream, windowed_counts

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def random_graph(spark, seed, n=12, m=30):
    rng = random.Random(seed)
    nodes = [(f"n{i:02d}", rng.choice("AB"), f"label {i % 5}", "s", 1.0 + i, None, i) for i in range(n)]
    edges = [(f"e{i:02d}", rng.choice(nodes)[0], rng.choice(nodes)[0], rng.choice("xy"), rng.choice([0.5, 1.0, 2.0]), i) for i in range(m)]
    edges.append(("dangling", "n00", "gone", "x", 1.0, m))
    return nodes, edges, spark.createDataFrame(nodes, "id string, type string, label string, summary string, weight double, merged_into string, seq long"), spark.createDataFrame(edges, "id string, source_id string, target_id string, type string, weight double, seq long")


def near_of(nodes, edges):
    ids, out = {n[0] for n in nodes}, defaultdict(set)
    for _, s, t, *_ in edges:
        out[s].add(t)
        out[t].add(s)
    return {k: v & ids for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_against_sets(spark, seed):
    nodes, edges, ndf, edf = random_graph(spark, seed)
    near = near_of(nodes, edges)
    got = defaultdict(set)
    for r in g.neighbours(ndf, edf).collect():
        got[r["id"]].add(r["other"])
    assert {k: v for k, v in near.items() if v} == dict(got)
    assert Counter(r["node_id"] for r in g.incident(edf).collect()) == Counter(x for e in edges for x in (e[1], e[2]))
    some = {"n00", "n01", "n02", "n03", "n04"}
    ids = spark.createDataFrame([(x,) for x in some], "id string")
    assert {r["id"] for r in g.induced(edf, ids).collect()} == {e[0] for e in edges if e[1] in some and e[2] in some}
    two = {(r["seed_id"], r["remote_id"], r["mid_id"]) for r in g.two_hops(ndf, edf, ids).collect()}
    want = set()
    for s in some:
        one = near[s] - {s}
        for r in set().union(*(near[x] for x in one)) - one - {s} if one else ():
            want.add((s, r, min(x for x in one if r in near[x])))
    assert two == want
    seeds = spark.createDataFrame([("q", "n03", 1), ("q", "n05", 2)], "query_id string, id string, rank int")
    got = {(r["id"], r["hop"], r["via"]) for r in g.expand(ndf, edf, seeds).collect()}
    want = {("n03", 0, 1), ("n05", 0, 2)} | {(x, 1, 1 if x in near["n03"] else 2) for x in (near["n03"] | near["n05"]) - {"n03", "n05"}}
    assert got == want
    one = g.counts(ndf, edf).first()
    assert (one["node_count"], one["edge_count"]) == (len(nodes) + 1, len(edges))
    n2, e2 = g.drop_nodes(ndf, edf, ids)
    assert n2.count() == len(nodes) - 5 and {r["id"] for r in e2.collect()} == {e[0] for e in edges if not {e[1], e[2]} & some}


@pytest.mark.parametrize("seed", range(4))
def test_migration_against_one_by_one(spark, seed):
    nodes, edges, _, edf = random_graph(spark, seed, n=8, m=40)
    pairs = [("n00", "n01"), ("n02", "n03")]
    remap = {x: f"m{i}" for i, p in enumerate(pairs) for x in p}
    current = [list(e) for e in edges]
    for i, (a, b) in enumerate(pairs):
        new = f"m{i}"
        mine, rest = [e for e in current if {e[1], e[2]} & {a, b}], [e for e in current if not {e[1], e[2]} & {a, b}]
        made = {}
        for e in mine:
            s, t = (new if x in (a, b) else x for x in (e[1], e[2]))
            if s == t:
                continue
            if (s, t, e[3]) in made:
                made[s, t, e[3]][4] += e[4]
            else:
                made[s, t, e[3]] = [e[0], s, t, e[3], e[4], e[5]]
        current = rest + list(made.values())
    got = g.migrate(edf, spark.createDataFrame(list(remap.items()), "old_id string, new_id string")).collect()
    assert Counter((r["source_id"], r["target_id"], r["type"], r["weight"]) for r in got) == Counter((e[1], e[2], e[3], e[4]) for e in current)


def test_put_nodes(spark):
    old = spark.createDataFrame([("a", "x", 0), ("b", "y", 1)], "id string, label string, seq long")
    new = spark.createDataFrame([("b", "z", 5), ("c", "u", 6), ("c", "v", 7)], "id string, label string, seq long")
    assert {(r["id"], r["label"], r["seq"]) for r in g.put_nodes(old, new).collect()} == {("a", "x", 0), ("b", "z", 1), ("c", "v", 7)}


def prune_loop(edges):
    edges = [dict(e) for e in edges]
    rounds = []
    while True:
        deleted, marked, keep = 0, 0, []
        for e in edges:
            if e["weight"] <= 0.1:
                if e["suspicious"]:
                    e["count"] += 1
                    if e["count"] >= 3:
                        deleted += 1
                        continue
                else:
                    e["suspicious"], e["count"] = True, 1
                    e["weight"] *= 0.5
                    marked += 1
            keep.append(e)
        edges = keep
        rounds.append((deleted, marked))
        if not deleted:
            return edges, rounds


@pytest.mark.parametrize("seed", range(6))
def test_prune_against_the_loop(spark, seed):
    rng = random.Random(seed)
    edges = []
    for i in range(0 if seed == 5 else rng.randrange(1, 12)):
        marked = rng.random() < 0.6
        edges.append({"id": f"e{i}", "weight": rng.choice([0.05, 0.1, 0.2]), "suspicious": marked, "count": rng.randrange(4) if marked else 0})
    frame = spark.createDataFrame([(e["id"], e["weight"], e["suspicious"], e["count"]) for e in edges], "id string, weight double, suspicious boolean, suspicious_pass_count int")
    want, rounds = prune_loop(edges)
    got = {r["id"]: (r["weight"], r["suspicious"], r["suspicious_pass_count"]) for r in prune.survivors(prune.prune(frame)).collect()}
    assert got == {e["id"]: (e["weight"], e["suspicious"], e["count"]) for e in want}
    assert [(r["deleted"], r["marked"]) for r in prune.round_stats(frame).orderBy("round").collect()] == rounds


@pytest.mark.parametrize("few", [0, 10, 100_000])
@pytest.mark.parametrize("seed", range(3))
def test_matching_against_one_by_one(spark, monkeypatch, seed, few):
    monkeypatch.setattr(merge, "FEW_PAIRS", few)  # rounds only, rounds and then one task, one task
    rng = random.Random(seed)
    pairs = [(f"n{a}", f"n{b}", i) for i, (a, b) in enumerate(tuple(rng.sample(range(14), 2)) for _ in range(30))]
    used, want = set(), set()
    for a, b, _ in pairs:
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    got = merge.matching(spark.createDataFrame(pairs, "a string, b string, rank long"))
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    assert merge.matching(spark.createDataFrame([], "a string, b string, rank long")).count() == 0


def test_merge_round_with_caveats(spark):
    """A caveat before a merge lowers the weight that is merged; one after it is never judged."""
    nodes = shaped(spark.createDataFrame([(x, "T", x, 1.0 + i, i) for i, x in enumerate("abcd")], "id string, type string, label string, weight double, seq long"), NODE)
    edges = shaped(spark.createDataFrame([("e", "a", "c", "x", 1.0, 0), ("f", "b", "c", "x", 2.0, 1), ("h", "a", "b", "x", 9.0, 2)], "id string, source_id string, target_id string, type string, weight double, seq long"), EDGE)
    vectors = spark.createDataFrame([(x, [1.0, 0.01 * i]) for i, x in enumerate("abcd")], "id string, vector array<double>")

    def judge(a, b):
        pair = a["id"] + b["id"]
        if pair == "cd":
            raise RuntimeError("no answer")
        return {"ab": ("same_with_caveats", ""), "ac": ("same", ""), "bc": ("same_with_caveats", "late")}.get(pair, ("different", ""))

    r = merge.merge_round(nodes, edges, vectors, Providers(judge=judge), "p", F.lit(NOW))
    assert [(x["a"], x["b"]) for x in r["matched"].collect()] == [("a", "c")]
    # Judged in order: ab, ac (merged), then only bd, as ad, bc and cd have a merged node.
    assert r["verdicts"] == {"same": 1, "same_with_caveats": 1, "different": 1, "error": 0}
    by = {x["id"]: x for x in r["nodes"].collect()}
    new = next(x for i, x in by.items() if i.startswith("m-"))
    assert new["weight"] == pytest.approx(1.0 * 0.9 + 3.0) and new["label"] == "c" and new["summary"] == " / "
    assert by["b"]["weight"] == pytest.approx(1.8) and by["a"]["merged_into"] == new["id"] == by["c"]["merged_into"]
    assert new["provenance"]["operation_id"] == "p:merge:c+a" and [x["id"] for x in new["provenance"]["inputs"]] == ["a", "c"]
    assert {(x["source_id"], x["target_id"], x["weight"]) for x in r["edges"].collect()} == {("b", new["id"], 2.0), (new["id"], "b", 9.0)}


def test_similarity(spark):
    rng = random.Random(1)
    rows = [(f"v{i:02d}", [rng.random() - 0.3 for _ in range(4)]) for i in range(30)] + [("zero", [0.0] * 4), ("v00b", None)]
    frame = spark.createDataFrame([r for r in rows if r[1]], "id string, vector array<double>")

    def cos(a, b):
        dot, na, nb = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return dot / na / nb if na and nb else 0.0

    data = dict(r for r in rows if r[1])
    best = {a: sorted((b for b in data if b != a), key=lambda b: (-round(cos(data[a], data[b]), 12), b))[:5] for a in data}
    for block in (4096, 7):
        got = defaultdict(dict)
        for r in similarity.self_top_k(frame, 5, block).collect():
            got[r["id"]][r["rank"]] = r["other"]
        assert {a: [got[a][i] for i in range(1, 6)] for a in data if a != "zero"} == {a: b for a, b in best.items() if a != "zero"}
    one = similarity.top_k(frame, data["v03"], 3).orderBy("rank").collect()
    assert [r["id"] for r in one] == ["v03", *best["v03"][:2]] and similarity.top_k(frame, data["v03"], 0).count() == 0
    asked = spark.createDataFrame([("a", data["v03"]), ("b", data["v04"])], "query_id string, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in similarity.top_k_batch(frame, asked, 2).collect()}
    assert got == {("a", 1): "v03", ("a", 2): best["v03"][0], ("b", 1): "v04", ("b", 2): best["v04"][0]}
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(normalise(F.col("a")).alias("n"), cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert (row["n"], row["c"]) == ([0.6, 0.8], 0.0)
    assert hashed_vector("") .sum() == 0 and abs((hashed_vector("some text") ** 2).sum() - 1) < 1e-9


def test_vectors_that_cannot_be_compared_are_left_out(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", None), ("d", [1.0, None]), ("e", [1.0]), ("f", [2.0]), ("g", []), ("h", [0.0, 0.0])], "id string, vector array<double>")
    pairs = {("a", "b"), ("b", "a"), ("e", "f"), ("f", "e"), ("a", "h"), ("b", "h"), ("h", "a"), ("h", "b")}
    assert {(r["id"], r["other"]) for r in similarity.self_top_k(rows, 3).collect()} == pairs
    assert {(r["id"], r["other"]) for r in similarity.window_top_k(rows, 3).collect()} == pairs
    assert [r["id"] for r in similarity.top_k(rows, [1.0, 0.0], 9).orderBy("rank").collect()] == ["a", "b", "h"]
    asked = rows.select(F.col("id").alias("query_id"), "vector").where("id in ('a', 'c', 'd', 'f')")
    assert {(r["query_id"], r["id"]) for r in similarity.top_k_batch(rows, asked, 9).collect()} == {("a", "a"), ("a", "b"), ("a", "h"), ("f", "e"), ("f", "f")}


def test_top_k_of_more_queries_than_a_block(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(similarity, "MOST_QUERIES", 7)
    x = np.random.default_rng(8).normal(size=(60, 6))
    frame = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    asked = frame.select(F.concat(F.lit("q"), "id").alias("query_id"), "vector").limit(21)  # three whole blocks
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for queries, n in ((asked, 21), (asked.union(frame.select(F.concat(F.lit("r"), "id"), "vector").limit(2)), 23)):
        got = similarity.top_k_batch(frame, queries, 3).collect()
        assert len(got) == 3 * n and len({r["query_id"] for r in got}) == n
        for r in got:
            best = np.argsort(-(unit @ unit[int(r["query_id"][2:])]))
            assert r["id"] == f"v{best[r['rank'] - 1]}"


def test_window_top_k_finds_near_rows(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 24))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.15 for _ in range(6)])
    frame = spark.createDataFrame([(f"v{i:04d}", v) for i, v in enumerate(x.tolist())], "id string, vector array<double>")
    exact = {(r["id"], r["other"]) for r in similarity.self_top_k(frame, 5).collect()}
    got = similarity.window_top_k(frame, 5, window=64).collect()
    assert Counter(r["id"] for r in got) == {f"v{i:04d}": 5 for i in range(len(x))}
    assert len(exact & {(r["id"], r["other"]) for r in got}) >= 0.95 * len(exact)


def test_window_top_k_of_ordinary_vectors(spark):
    """No planted copies, and far more rows than the windows of the first passes show."""
    import numpy as np

    x = np.random.default_rng(9).normal(size=(6000, 24))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -1)
    exact = {(f"v{i}", f"v{j}") for i in range(len(x)) for j in np.argpartition(-sims[i], 5)[:5]}
    frame = spark.createDataFrame([(f"v{i}", v) for i, v in enumerate(x.tolist())], "id string, vector array<double>")
    got = similarity.window_top_k(frame, 5, window=16).collect()
    assert Counter(r["id"] for r in got) == {f"v{i}": 5 for i in range(len(x))}
    assert len(exact & {(r["id"], r["other"]) for r in got}) >= 0.93 * len(exact)


def test_budget_ends_at_the_first_line_that_is_too_long(spark):
    nodes = spark.createDataFrame([("a", "T", "a", "x" * 40), ("b", "T", "b", "x" * 400), ("c", "T", "c", "")], "id string, type string, label string, summary string")
    ex = spark.createDataFrame([("q", "a", 0, 1), ("q", "b", 1, 1), ("q", "c", 1, 1)], "query_id string, id string, hop int, via int")
    assert [r["id"] for r in retrieve.budget_prefix(ex, nodes, 40).collect()] == ["a"]
    assert [r["place"] for r in retrieve.budget_prefix(ex, nodes, 400).orderBy("place").collect()] == [1, 2, 3]


def test_toy_pass(spark):
    """One pass without a log: 1 merge, 1 deleted edge, 1 new link, and the weights worked out by hand."""
    toy = toy_graph(spark)
    nodes, edges = reinforce.reinforce(toy.nodes, toy.edges, empty(spark, __import__("graphloom.schema", fromlist=["TRAVERSAL"]).TRAVERSAL))
    w = {r["label"]: r["weight"] for r in nodes.collect()}
    want = {"Elon Musk": 1.318125, "Tesla Inc": 1.4725, "Tesla Motors": 1.361667, "Model S": 1.1875, "Model 3": 1.1875, "SpaceX": 1.9, "X": 1.425, "Austin": 1.425, "Palo Alto": 1.235, "JB Straubel": 1.425, "Electric Vehicles": 0.95, "NHTSA": 0.59375}
    assert w == pytest.approx(want, abs=1e-6)

    def vectors(frame):
        return g.active(frame).select("id", F.when(F.col("label").startswith("Tesla"), F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.0), F.crc32("id").cast("double"))).alias("vector"))

    graph, report, events = run_pass(toy, None, "p1", vectors=vectors, now=NOW)
    stats = report["stats"]
    assert (stats["merge_total"], stats["prune_total"], stats["link_total"]) == (1, 1, 1)
    assert (report["merge_iters"], report["prune_iters"], report["link_iters"]) == (2, 2, 2)
    live = g.active(graph.nodes).collect()
    tesla = [r for r in live if "tesla" in r["label"].lower()]
    assert len(tesla) == 1 and tesla[0]["label"] == "Tesla Inc" and tesla[0]["weight"] == pytest.approx(2.834167, abs=1e-6)
    assert graph.nodes.count() == 13 and graph.edges.count() == 12
    new = graph.edges.where("provenance.operation_type = 'traversal'").collect()
    assert [(r["source_id"], r["weight"], r["type"]) for r in new] == [(tesla[0]["id"], 0.5, "IN_INDUSTRY")]
    kinds = Counter(e["kind"] for e in events.collect())
    assert kinds["merge"] == kinds["prune"] == kinds["link_form"] == 1 and kinds["pass_start"] == kinds["pass_end"] == 1
    assert [e["kind"] for e in events.orderBy("seq").collect()][:3] == ["pass_start", "reinforce", "merge"]
    nodes2 = merge.drop_ghosts(graph.nodes, graph.edges)
    assert nodes2.count() == 11


def test_link_rounds_stop_at_their_quota(spark):
    n = 60
    nodes = shaped(spark.createDataFrame([("hub", "H", "hub", 9.0, 0)] + [(f"n{i:02d}", "T", f"l{i}", 1.0, i + 1) for i in range(n)], "id string, type string, label string, weight double, seq long"), NODE)
    edges = shaped(spark.createDataFrame([(f"e{i}", "hub", f"n{i:02d}", "x", 1.0, i) for i in range(n)], "id string, source_id string, target_id string, type string, weight double, seq long"), EDGE)
    seeds = spark.createDataFrame([("n00",)], "id string")
    say = lambda s, r, p: {"holds": True, "what": "w", "why": "y", "edge_type": " "}
    one = link.link_round(nodes, edges, seeds, None, Providers(link=say), "p", F.lit(NOW))
    assert (one["asked"], one["added"]) == (20, 20) and {r["type"] for r in one["new"].collect()} == {"RELATED_TO"}
    two = link.link_round(nodes, one["edges"], seeds, one["tried"], Providers(link=say), "p", F.lit(NOW))
    assert (two["asked"], two["added"]) == (20, 20)
    no = link.link_round(nodes, edges, seeds, None, Providers(link=lambda s, r, p: {"holds": "false", "what": "w", "why": "y"}), "p", F.lit(NOW))
    assert (no["asked"], no["added"]) == (59, 0)


def test_ingest(spark):
    reply = json.dumps({"nodes": [{"type": "A", "label": " one "}, {"label": "two", "summary": "s" * 5000}, {"label": " \t"}, {"type": "B", "label": "one"}], "edges": [{"source_label": "one", "target_label": "two", "type": "t"}, {"source_label": "one", "target_label": "three"}]})
    docs = spark.createDataFrame([("d1", "text " + reply), ("d2", "nothing"), ("d3", "x" * 100_004)], "doc_id string, text string")
    out = ingest.ingest(empty(spark, NODE), empty(spark, EDGE), docs, "run", F.lit(NOW))
    got = {r["doc_id"]: (r["accepted"], r["nodes_added"], r["edges_added"], r["edges_skipped"]) for r in out["counters"].collect()}
    assert got == {"d1": (True, 2, 1, 1), "d2": (True, 0, 0, 0), "d3": (False, 0, 0, 0)}
    nodes = {r["id"]: r for r in out["nodes"].collect()}
    assert sorted((r["type"], r["label"], len(r["summary"])) for r in nodes.values()) == [("A", "one", 0), ("B", "one", 0), ("Entity", "two", 1200)]
    edge = out["edges"].first()
    assert nodes[edge["source_id"]]["type"] == "B" and edge["provenance"]["raw_doc_id"] == "d1"


def test_integrate(spark):
    have = shaped(spark.createDataFrame([("old", "A", "one", "keep", 4)], "id string, type string, label string, summary string, seq long"), NODE)
    reply = '{"nodes": [{"type": "A", "label": "one", "summary": "new"}, {"type": "A", "label": "two"}], "edges": [{"source_label": "one", "target_label": "two"}, {"source_label": "one", "target_label": "x"}]}'
    rows = [("s1", "I saw it", "u", "c", "t1"), ("s2", "long " * 10_000, "u", "c", "t2")]
    out = ingest.integrate(have, empty(spark, EDGE), spark.createDataFrame(rows, "statement_id string, text string, user_id string, conversation_id string, turn_id string"), F.lit(NOW), Providers(extract=lambda t: reply, compress=lambda t, n: ""))
    got = {r["statement_id"]: r.asDict() for r in out["counters"].collect()}
    assert (got["s1"]["classification"], got["s2"]["classification"]) == ("experience", "supplement")
    assert got["s2"]["compressed"] and got["s2"]["compressed_tokens"] == 8000 and got["s1"]["edges_added"] == 1 and got["s1"]["nodes_touched"] == 2
    nodes = out["nodes"].collect()
    assert sorted((r["label"], r["summary"]) for r in nodes) == [("one", "keep"), ("two", "")] and out["edges"].count() == 2
    assert {r["source_id"] for r in out["edges"].collect()} == {"old"}


def test_text_functions(spark):
    assert [loose_json(x) for x in ("[1]", 'a {"b": 1} c', "{} {}", None)] == ["{}", '{"b": 1}', "{}", "{}"]
    assert tool_call('{"name": "x", "arguments": "[1]"}', ["x"]) is None
    assert tool_call('call: x{a: 1, b: "c"}', ["x"]) == ("x", {"a": 1, "b": "c"})
    calls = ['{"name": "y", "arguments": {}} x{a: 1}', '{"function": "x"}', '{"name": "x", "arguments": "{broken"}', '{"name": ["x"], "arguments": {}}', "x{a b} x{c: 1}", "<tool_call>x{}</tool_call> y{}", "<tool_call> </tool_call>x{}", "", None]
    assert [tool_call(c, ["x"]) for c in calls] == [("x", {"a": 1}), ("x", {}), ("x", {}), None, ("x", {}), ("x", {}), None, None, None]
    rows = spark.createDataFrame([(" \t a b \x1c\n",), (None,)], "t string")
    assert [r["s"] for r in rows.select(strip(F.col("t")).alias("s")).collect()] == ["a b", None]
    assert [basename(x) for x in ("../../etc/x.txt", "a\\b.txt", "..", "", None)] == ["x.txt", "b.txt", None, None, None]


def test_store_logs_and_tools(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/g", "toy")
    assert store.load().nodes.count() == 0 and store.events().count() == 0
    store.save(toy_graph(spark))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text('{"nodes": [{"type": "City", "label": "Bonn"}], "edges": []}', encoding="utf-8")
    (tmp_path / "raw" / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "ontology.md").write_text("# O\n## Person\nx\n## Place\ny", encoding="utf-8")
    agent = tools.Agent(store, f"{tmp_path}/log", f"{tmp_path}/raw", f"{tmp_path}/ontology.md")
    assert len(tools.schemas()) == 12 and len(tools.READING_TOOLS) == 10 and tools.schemas(["nope"]) == []
    assert agent.run("get_graph_stats", {})["node_count"] == 12
    found = agent.run("graph_query", {"question": "Tesla Inc, a company."})
    assert found["citations"][0]["label"] == "Tesla Inc" and "- [Company] Tesla Inc" in found["answer"]
    assert read_traversals(spark, f"{tmp_path}/log").first()["seed_node_ids"][0] == "t00"
    assert agent.run("show_provenance", {"node_or_edge_id": "t00"})["kind"] == "direct"
    assert agent.run("show_provenance", {"node_or_edge_id": "e00"}) == {"kind": "not_found"}
    assert store.load().show_provenance("e00", edges_too=True).first()["provenance"] != '{"kind":"not_found"}'
    assert agent.run("read_ontology", {"section": "pla"})["content"] == "Place\ny"
    assert agent.run("run_plant_recover_eval", {}) == agent.run("compare_with_baseline", {}) == {"status": "not_implemented"}
    made = agent.run("upsert_node", {"type": "City", "label": "Ulm"})
    assert agent.run("upsert_node", {"type": "City", "label": "Ulm"}) == made and store.load().nodes.count() == 13
    assert agent.run("upsert_edge", {"source_label": "Ulm", "target_label": "X", "type": "NEAR"})["type"] == "NEAR"
    assert agent.run("upsert_edge", {"source_label": "Ulm", "target_label": "?"})["target_found"] is False
    assert agent.run("ingest_file", {"filename": "../raw/a.txt"})["nodes_added"] == 1
    assert all("error" in agent.run("ingest_file", {"filename": x}) for x in ("none.txt", "", "bad.txt", ".."))
    assert agent.run("no_such_tool", {}) == {"error": "unknown tool no_such_tool"}
    assert agent.run("list_recent_merges", {})["events"] == []
    report = maintain(store, read_traversals(spark, f"{tmp_path}/log"))
    assert report["status"] == "ok" and report["stats"]["prune_total"] >= 1
    assert agent.run("list_recent_prunings", {"k": 0})["events"][0]["edge_id"]
    store.pass_running = True
    assert maintain(store) == {"status": "already_running"} and agent.call("x") == tools.PAUSED and agent.route("x").text == tools.PAUSED
    store.pass_running = False
    graph = store.load()
    assert graph.remove_edge("e00").edges.count() == graph.edges.count() - 1
    assert graph.get_node("t00").count() == 1 and graph.get_edge("e01").count() == 1
    assert graph.put_nodes(graph.get_node("t00")).nodes.count() == graph.nodes.count()
    assert graph.add_edges(graph.get_edge("e01")).edges.count() == graph.edges.count() + 1
    assert graph.remove_nodes(spark.createDataFrame([("t02",)], "id string")).edges.where("source_id = 't02' or target_id = 't02'").count() == 0


def test_a_failed_pass_saves_nothing(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/g")
    store.save(toy_graph(spark))

    def broken(frame):
        raise RuntimeError("no vectors")

    with pytest.raises(RuntimeError):
        maintain(store, None, vectors=broken)
    assert store.version()[0] == 1 and not store.pass_running


def test_chat_loop(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/g")
    store.save(toy_graph(spark))
    said, asked = iter(["call:get_graph_stats{}", '{"name": "read_ontology"}', "done"]), []

    def chat(messages, tools=None, temperature=0.0):
        asked.append((len(messages), temperature, tools is not None))
        return {"content": next(said)}

    agent = tools.Agent(store, f"{tmp_path}/log", f"{tmp_path}", f"{tmp_path}/none.md", chat=chat)
    assert agent.call("how big?") == "done" and asked == [(2, 0.7, True), (4, 0.2, True), (6, 0.2, True)]
    agent.chat = lambda messages, tools=None, temperature=0.0: {"content": "", "tool_calls": [{"id": "1", "function": {"name": "get_graph_stats", "arguments": "{broken"}}]} if tools else {"content": "at last"}
    assert agent.call("again") == "at last"
    route = agent.route("x")
    assert (route.tool, route.args) == ("get_graph_stats", None)
    agent.chat = lambda *a, **b: 1 / 0
    assert agent.route("x").error
    assert client_for("backend", {}).model == "local" and "local" in BACKENDS
    with pytest.raises(ValueError):
        client_for("backend", {"GRAPHLOOM_BACKEND": "other"})


def test_traversal_log_is_forgiving_and_read_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = '{"ts":"t","kind":"graph_query","question":"q","seed_node_ids":["t02"],"touched_node_ids":[],"touched_edge_ids":["e00","e00"]}'
    (log / "a.json").write_text(f"{line}\n\n{{broken\n{line}\n", encoding="utf-8")
    assert read_traversals(spark, str(log)).count() == 2 and read_traversals(spark, f"{tmp_path}/none").count() == 0
    store = Store(spark, f"{tmp_path}/g")
    store.save(toy_graph(spark))
    for version in (2, 2):
        reinforce_from_log(spark, store, str(log), f"{tmp_path}/cp")
        assert store.version()[0] == version
    w = {r["id"]: r["weight"] for r in store.load().edges.collect()}
    assert w["e00"] == pytest.approx((2.0 + 4 * 0.01 + 4 * 0.02) * 0.95) and w["e01"] == pytest.approx(1.5 * 0.95)
    append_traversals(read_traversals(spark, str(log)), str(log))
    reinforce_from_log(spark, store, str(log), f"{tmp_path}/cp")
    assert store.version()[0] == 3


def test_only_whole_lines_are_records(spark, tmp_path):
    """A line is one JSON object from end to end, or it is dropped."""
    good = ['{"kind":"x"}', '  {"kind":"y","seed_node_ids":["a]","b}"]}  ', '{"kind":"q \\" } ]"}']
    bad = ['{"kind":"x"} junk', '{"kind":"x"}]', '{"kind":"x"}}', '{"kind":"x"},', '{"kind":"x"}{"kind":"y"}', '{"kind":"x"},{"kind":"y"}', '{"kind":"x"}],[{"kind":"y"}', '{"kind":"x"},"w":{"kind":"y"}', "[1]", "3", "null", '"t"', "{", "}", "x"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join([*good, *bad]) + "\n", encoding="utf-8")
    assert sorted(r["kind"] for r in read_traversals(spark, f"{tmp_path}/log").collect()) == ['q " } ]', "x", "y"]
    got = []
    consume(traversal_stream(spark, f"{tmp_path}/log"), f"{tmp_path}/cp", lambda batch, _: got.extend(r["kind"] for r in batch.collect()))
    assert len(got) == 3


def test_the_pass_takes_each_record_once(spark, tmp_path):
    """The tool's passes: what a saved pass has read doesn't count again, what a failed pass has read does."""
    log, line = f"{tmp_path}/log", '{"kind":"graph_query","seed_node_ids":["t02"],"touched_node_ids":[],"touched_edge_ids":["e00"]}'
    store = Store(spark, f"{tmp_path}/g")
    store.save(toy_graph(spark))
    spark.createDataFrame([(line,)] * 3, "value string").coalesce(1).write.mode("append").text(log)
    traversed = lambda agent: agent.run("trigger_sleep_pass", {})["stats"]["reinforce_edges_traversed"]
    agent = tools.Agent(store, log, f"{tmp_path}", f"{tmp_path}/none.md")
    with pytest.raises(ZeroDivisionError):
        records, files = unread(spark, log, store.taken())
        maintain(store, records, took=files, vectors=lambda nodes: 1 / 0)
    assert (traversed(agent), store.taken().count()) == (1, 1)
    weight = store.load().edges.where("id = 'e00'").first()["weight"]
    assert weight == pytest.approx((2.0 + 3 * 0.03) * 0.95)
    assert traversed(agent) == 0
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(log)
    assert (traversed(agent), traversed(agent), store.taken().count()) == (1, 0, 2)
    assert store.load().edges.where("id = 'e00'").first()["weight"] == pytest.approx(((weight * 0.95 + 0.03) * 0.95) * 0.95)


def test_a_batch_that_comes_again_is_not_applied_twice(spark, tmp_path, monkeypatch):
    """A failure between the save and the stream's checkpoint: the batch comes again, its version is there."""
    (tmp_path / "log").mkdir()
    line = '{"kind":"graph_query","seed_node_ids":["t02"],"touched_node_ids":[],"touched_edge_ids":["e00"]}'
    (tmp_path / "log" / "a.json").write_text(f"{line}\n", encoding="utf-8")
    store = Store(spark, f"{tmp_path}/g")
    store.save(toy_graph(spark))
    save = Store.save

    def lost(self, *args):
        save(self, *args)
        raise RuntimeError("lost after the save")

    monkeypatch.setattr(Store, "save", lost)
    with pytest.raises(Exception, match="lost after the save"):
        reinforce_from_log(spark, store, f"{tmp_path}/log", f"{tmp_path}/cp")
    monkeypatch.setattr(Store, "save", save)
    reinforce_from_log(spark, store, f"{tmp_path}/log", f"{tmp_path}/cp")
    assert store.version()[0] == 2 and store.load().edges.where("id = 'e00'").first()["weight"] == pytest.approx((2.0 + 0.03) * 0.95)
    (tmp_path / "log" / "b.json").write_text(f"{line}\n", encoding="utf-8")
    reinforce_from_log(spark, store, f"{tmp_path}/log", f"{tmp_path}/cp")
    assert store.version()[0] == 3


def test_in_order_is_dense(spark):
    rows = in_order(spark.range(5000).repartition(7).withColumn("k", F.col("id") % 10), [F.col("k").desc(), "id"], "n").collect()
    assert [(r["k"], r["id"]) for r in sorted(rows, key=lambda r: r["n"])] == [(k, i) for k in range(9, -1, -1) for i in range(k, 5000, 10)]
    assert sorted(r["n"] for r in rows) == list(range(1, 5001))


@pytest.mark.parametrize("most", [3, 1000])
def test_link_rounds_ask_what_all_pairs_in_order_would(spark, monkeypatch, most):
    """Seeds in small batches: the same pairs, in the same order, as from all pairs at once."""
    monkeypatch.setattr(link, "FIRST_SEEDS", 2)
    monkeypatch.setattr(link, "FIRST_BATCH", 3)
    _, _, nodes, edges = random_graph(spark, 5, n=40, m=60)
    nodes, edges = shaped(nodes, NODE), shaped(edges, EDGE)
    seeds = nodes.where("seq % 3 = 0").select("id")
    whole = link.pairs_to_ask(nodes, edges, seeds, None).orderBy("place").collect()
    holds = lambda s, r, p: {"holds": (int(s["id"][1:]) + int(r["id"][1:])) % 4 == 0, "what": "w", "why": "y"}
    want, n = [], 0
    for p in whole:
        if n < most:
            want.append((p["low"], p["high"]))
            n += holds({"id": p["seed_id"]}, {"id": p["remote_id"]}, "")["holds"]
    got = link.link_round(nodes, edges, seeds, None, Providers(link=holds), "p", F.lit(NOW), most)
    assert {tuple(r) for r in got["tried"].collect()} == set(want) and (got["asked"], got["added"]) == (len(want), n)
    assert most > 3 or len(want) < len(whole)


@pytest.mark.parametrize("most", [3, 1000])
def test_a_linker_that_says_what_it_takes_makes_the_same_links(spark, most):
    """Pairs that it never takes aren't made, and the links are those of asking it about all pairs."""
    _, _, nodes, edges = random_graph(spark, 5, n=40, m=60)
    nodes, edges = shaped(nodes, NODE), shaped(edges, EDGE)
    seeds = nodes.where("seq % 3 <> 0").select("id")
    number, asked = lambda n: n["id"].substr(2, 5).cast("int"), spark.sparkContext.accumulator(0)

    def say(s, r, p):
        asked.add(1)
        a, b = int(s["id"][1:]), int(r["id"][1:])
        return {"holds": a % 4 == 0 and b % 2 == 1 and a + b > 20, "what": "w", "why": "y"}

    plain, n_plain = link.link_round(nodes, edges, seeds, None, Providers(link=lambda *x: say(*x)), "p", F.lit(NOW), most), asked.value
    ruled = link.link_round(nodes, edges, seeds, None, Providers(link=takes(lambda n: number(n) % 4 == 0, lambda n: number(n) % 2 == 1)(say)), "p", F.lit(NOW), most)
    links = lambda r: sorted((x["source_id"], x["target_id"]) for x in r["new"].collect())
    assert links(ruled) == links(plain) and plain["added"] == ruled["added"] > 2
    assert ruled["asked"] < plain["asked"] and asked.value - n_plain < n_plain


def test_roles_fall_back_and_the_environment_is_checked(monkeypatch):
    from graphloom.functions.providers import BACKENDS, ChatClient, backend_of, validate_env

    monkeypatch.setitem(BACKENDS, "other", lambda env: ChatClient("http://127.0.0.1:9", "m", timeout=0.2))
    assert [backend_of("agent", env) for env in ({}, {"GRAPHLOOM_BACKEND": "other"}, {"GRAPHLOOM_BACKEND": "other", "GRAPHLOOM_AGENT": "local"}, {"GRAPHLOOM_AGENT": ""})] == ["local", "other", "local", "local"]
    got = validate_env({"GRAPHLOOM_BACKEND": "other"})
    assert got == {"backend": "other", "agent": "other", "base_url": "http://127.0.0.1:9", "model": "m", "context_tokens": 40_000, "reachable": False}
    with pytest.raises(ValueError):
        validate_env({"GRAPHLOOM_AGENT": "none"})


def test_chat_client_against_a_server():
    """What is sent and what is taken of the reply; a server that is away doesn't answer a ping."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from graphloom.functions.providers import ChatClient

    got = []

    class Server(BaseHTTPRequestHandler):
        def _say(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            got.append((self.path, None))
            self._say({"data": []})

        def do_POST(self):
            got.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers["Authorization"]))
            self._say({"choices": [{"message": {"content": "hi", "tool_calls": None}}]})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = ChatClient(f"http://127.0.0.1:{server.server_port}/v1/", "m", "key", timeout=10)
    assert client.chat([{"role": "user", "content": "q"}], tools=[{"type": "function"}], temperature=0.7)["content"] == "hi" and client.ping()
    assert got[0] == ("/v1/chat/completions", {"model": "m", "messages": [{"role": "user", "content": "q"}], "temperature": 0.7, "tools": [{"type": "function"}], "tool_choice": "auto"}, "Bearer key")
    assert client.chat([])["content"] == "hi" and "tools" not in got[2][1] and got[1] == ("/v1/models", None)
    server.shutdown()
    server.server_close()
    assert not client.ping()


def test_upsert_stream(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/g")
    store.save(toy_graph(spark))
    prov = provenance("user", user_id=F.lit("u"), conversation_id=F.lit("c"), turn_id=F.lit("t"), classification=F.lit("supplement"))
    rows = spark.createDataFrame([("Company", "X", "known", 0), ("City", "Ulm", "first", 1), ("City", "Ulm", "second", 2)], "type string, label string, summary string, order int")
    rows.withColumn("provenance", prov).withColumn("created_at", F.lit(NOW)).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/cp")
    got = store.load().nodes
    assert got.count() == 13 and got.where("label = 'Ulm'").first()["summary"] == "first"


def test_history_stream_agrees_with_the_window(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, "x" * rng.randrange(1, 60)) for c in range(5) for t in range(12)]
    rng.shuffle(rows)
    schema = "conv_id long, turn long, text string"
    latest = {}

    def use(batch, _):
        latest.update({r["conv_id"]: (r["kept"], r["oldest"], r["tokens"]) for r in batch.collect()})

    for k in range(0, len(rows), 20):
        spark.createDataFrame(rows[k : k + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = history_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 40).writeStream.outputMode("update").foreachBatch(use).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        seen = spark.createDataFrame(rows[: k + 20], schema)
        want = {r["conv_id"]: (r["n"], r["o"], r["t"]) for r in retrieve.history_window(seen, 40).groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("o"), F.max("kept_tokens").alias("t")).collect()}
        assert {c: v for c, v in latest.items() if v[0]} == want


def test_windowed_counts(spark, tmp_path):
    rows = [("2026-01-01 00:10:00", "a"), ("2026-01-01 00:50:00", "a"), ("2026-01-01 01:10:00", "b")]
    spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    schema, got = spark.read.parquet(f"{tmp_path}/in").schema, []
    counted = windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    query = counted.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend((r["event_type"], r["n"]) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(got) == [("a", 2), ("b", 1)]


def test_recent_events(spark):
    rows = spark.createDataFrame([(NOW, "merge", i) for i in range(5)] + [(NOW, "prune", 9)], "ts timestamp, kind string, seq long")
    assert [r["seq"] for r in recent_events(rows, "merge", 2).collect()] == [4, 3]
    assert recent_events(rows, "merge", -1).count() == 1 and recent_events(rows, "none").count() == 0


def test_scores(spark):
    runs = spark.createDataFrame([(1, 10, 5, 10), (1, 0, 0, 10), (2, 0, 0, 0)], "tier int, tool_ok int, param_ok int, total int")
    got = {r["tier"]: (r["tool_accuracy"], r["param_accuracy"]) for r in tools.tier_accuracy(runs.where("total > 0")).collect()}
    assert got == {1: (0.5, 0.25)}
    calls = spark.createDataFrame([(["a"], "b"), (["a"], "a"), (["None"], None), (["a"], None)], "expected array<string>, actual string")
    assert {r["actual"]: r["n"] for r in tools.wrong_calls(calls).collect()} == {"b": 1, "None": 1}


def test_empty_graph_passes(spark):
    graph, report, _ = run_pass(Graph(empty(spark, NODE), empty(spark, EDGE)), None, "p", now=NOW)
    assert report["stats"]["merge_total"] == report["stats"]["prune_total"] == report["stats"]["link_total"] == 0 and graph.nodes.count() == 0


def _shuffled(spark, run):
    """(what ``run`` gives, rows that it shuffled)."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    written = lambda: sum(s.shuffleWriteRecords() for s in _each(store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))
    before = written()
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, written() - before


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


@pytest.mark.parametrize("ordered", [False, True])
def test_pairs_at_a_hub_are_not_moved(spark, ordered):
    """2.2 million pairs around one hub: none of them is shuffled, only the hub's neighbours are."""
    n = 1500
    nodes = spark.range(n + 1).select(F.concat(F.lit("n"), "id").alias("id"), F.col("id").alias("seq"))
    edges = spark.range(1, n + 1).select(F.concat(F.lit("n"), "id").alias("source_id"), F.lit("n0").alias("target_id"))
    ids = nodes.where("seq > 0").select("id")
    pairs = (lambda: link.untried(nodes, edges, ids, None).count()) if ordered else (lambda: g.two_hops(nodes, edges, ids).count())
    found, moved = _shuffled(spark, pairs)
    assert found == n * (n - 1) // (2 if ordered else 1)
    assert moved < 100_000


def test_turns_are_compared_before_pairs_move(spark):
    """Lists of remotes move by their seed without the turns (four words a remote), in parts of a fixed number."""
    nodes, edges = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, seq long"), spark.createDataFrame([("a", "b"), ("b", "c")], "source_id string, target_id string")
    plan = link.untried(nodes, edges, nodes.select("id"), None)._jdf.queryExecution().analyzed().toString()
    assert re.search(r"RepartitionByExpression \[seed_id#\d+\], \d+", plan)


def test_blocks_are_not_unfolded_by_one_function(spark):
    """Generated code holds all rows that it makes of a row, so seeds and remotes of two blocks are unfolded by two functions."""
    nodes = spark.range(4).select(F.concat(F.lit("n"), "id").alias("id"), F.col("id").alias("seq"))
    edges = spark.createDataFrame([("n1", "n0"), ("n2", "n0"), ("n3", "n0")], "source_id string, target_id string")
    pairs = g.two_hops(nodes, edges, nodes.select("id"))
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    whole = re.split(r"Coalesce \d+", plan, maxsplit=1)
    assert len(whole) == 2 and "Generate explode(remotes" in whole[0] and "Generate explode(transform" in whole[1] and f"{g.SLICE})" in whole[1]
    assert {(r["seed_id"], r["remote_id"]) for r in pairs.collect()} == {(f"n{a}", f"n{b}") for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


def test_pairs_with_several_nodes_between_are_hashed(spark):
    """The least node between is found by its number, by hashing: a text's would be found by sorting all that a seed reaches."""
    nodes = spark.range(6).select(F.concat(F.lit("n"), "id").alias("id"), F.col("id").alias("seq"))
    edges = spark.createDataFrame([("n1", "n0"), ("n3", "n1"), ("n2", "n0"), ("n3", "n2"), ("n2", "n0"), ("n4", "n2"), ("n4", "n0")], "source_id string, target_id string")
    pairs = g.two_hops(nodes, edges, nodes.where("id in ('n0', 'n3', 'n5')").select("id"))
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate(keys=[seed_id" in plan and not re.search(r"SortAggregate\(key=\[seed_id#\d+, remote_id", plan)
    assert sorted(map(tuple, pairs.collect())) == [("n0", "n1", "n3"), ("n3", "n1", "n0"), ("n3", "n2", "n4")]


@pytest.mark.parametrize("most", [4096, 7])
def test_overlaps_move_sets(spark, monkeypatch, most):
    """435 pairs of nodes with 200 neighbours or so: their sets are moved, not each neighbour of each pair; sets in one part and in many."""
    monkeypatch.setattr(similarity, "SET", most)
    draw = random.Random(5)
    near = {f"n{i:02d}": set(draw.sample([f"x{k}" for k in range(400)], 200 + i)) for i in range(29)} | {"n29": {"y"}}
    rows = spark.createDataFrame([(k, x) for k, v in near.items() for x in v], "id string, other string")
    pairs = spark.createDataFrame([(a, b) if (len(a) + i) % 2 else (b, a) for i, (a, b) in enumerate(combinations([*near, "none"], 2))], "a string, b string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, moved = _shuffled(spark, lambda: similarity.neighbour_jaccard(pairs, rows).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    near["none"] = set()
    assert len(found) == 465 and all(r["jac"] == pytest.approx(len(near[r["a"]] & near[r["b"]]) / len(near[r["a"]] | near[r["b"]])) for r in found)
    assert most == 7 or moved < 40_000


@pytest.mark.parametrize("seed", [1, 2])
def test_two_hops_in_small_blocks(spark, monkeypatch, seed):
    """Blocks of 2, triangles, double edges, edges to oneself and ends without a node, against brute force."""
    monkeypatch.setattr(g, "BLOCK", 2)
    draw = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(30)]
    ends = [(draw.choice(ids[:8] if draw.random() < 0.3 else ids), draw.choice([*ids, "gone"])) for _ in range(70)]
    nodes, edges = spark.createDataFrame([(x, 100 - i // 2) for i, x in enumerate(ids)], "id string, seq long"), spark.createDataFrame(ends, "source_id string, target_id string")
    near, seq = {}, {x: 100 - i // 2 for i, x in enumerate(ids)}
    for a, b in ends:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seeds = [*ids[::3], "gone"]
    want = {}
    for s in seeds:
        for m in sorted(near.get(s, set()) & set(ids) - {s}, reverse=True):
            want |= {(s, r): m for r in near[m] & set(ids) - near[s] - {s}}
    got = g.two_hops(nodes, edges, spark.createDataFrame([(s,) for s in seeds], "id string")).collect()
    assert {(r["seed_id"], r["remote_id"]): r["mid_id"] for r in got} == want and len(got) == len(want)
    place, asked = lambda x: (seq[x], x), {}
    for a, b in sorted((p for p in want if p[0] in seq), key=lambda p: (place(p[0]), place(p[1]))):
        asked.setdefault(frozenset((a, b)), (a, want[a, b], b))
    rows = link.untried(nodes, edges, spark.createDataFrame([(s,) for s in seeds], "id string"), None).collect()
    assert sorted(map(tuple, rows)) == sorted(asked.values())
