"""Toxicity, quality, chat formatting and secret scans."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import chat_format as chat
from graphloom.llm import quality, secret_scan, toxicity
from graphloom.llm.common import mix64
from graphloom.llm.linear import Ftrl, WordHashes, grams, sigmoid

DOCS = "doc_id long, text string, source string, lang string, n_chars long, score string"
LABELS = "doc_id long, quality int, toxic int"


def prose(rng, n):
    return " ".join(rng.choice(["the", "a", "house", "river", "stands", "near", "old", "green", "tree", "and"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, toxic, good = prose(rng, rng.randrange(5, 60)), i % 5 == 0, i % 4 != 1
        if toxic:
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(["Dreck,", "dreckig", "scum", "SCUM!"])
            text = " ".join(words)
        if not good:
            text = " | ".join(text.upper().split())
        docs.append((i, text, f"s{i % 3}", "en", len(text), "own"))
        if i % 10 < 8:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


EDGE = [(2000, None, None, None, None, None), (2001, "", "s1", "en", 0, None), (None, "scum", "s1", "en", 4, None), (2002, "tree " * 60_000 + "scum", "s1", "en", 9, None), (3, "a house", "s1", "en", 7, None)]


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    model = Ftrl(200, l1=3.0)
    for _ in range(3000):
        at = np.append(rng.choice(199, 8, replace=False), 199)  # the last is the intercept
        model.learn(at, 1.0, int(7 in at))
    w = model.weights()
    assert w[7] == w.max() and w[7] > 2 and (w == 0).sum() > 100


def test_grams():
    h = np.arange(1, 6, dtype=np.uint64)
    one, two, skip = grams(h, 2, 1)
    assert (len(one), len(two), len(skip)) == (5, 4, 3)
    assert len(set(np.concatenate([one, two, skip]).tolist())) == 12
    assert [len(x) for x in grams(h[:1], 2, 1)] == [1, 0, 0]
    assert len(WordHashes().of([b"a", b"a", b"b"])) == 3


def test_toxicity_held_out(spark):
    docs, labels = corpus()
    labels += [(0, 1, None), (None, 1, 1), (1, 1, 0)]
    got = toxicity.score_toxicity(spark.createDataFrame(docs + EDGE, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) + len(EDGE)
    by = {r["doc_id"]: r for r in got[: len(docs)]}
    ids = [i for i in range(900) if held(i)]
    right = [by[i]["predicted"] == int(i % 5 == 0) for i in ids]
    assert np.mean(right) > 0.98 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    edge = {r["doc_id"]: r for r in got if r["doc_id"] is None or r["doc_id"] >= 2000}
    assert edge[2000]["score"] == edge[2001]["score"] < 0.5 and edge[None]["predicted"] == 1 and edge[2002]["predicted"] == 1
    assert got[0]["source"] == docs[0][2]


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = corpus(n=20)
    none = spark.createDataFrame([], LABELS)
    assert {(r["score"], r["predicted"]) for r in toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), none).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


def test_the_sample_is_bounded_and_leaves_the_fold_out(spark):
    _, labels = corpus()
    got = toxicity.sample(spark.createDataFrame(labels + labels[:5], LABELS), "toxic", 50).collect()
    assert len(got) == 50 and not any(held(r["__id"]) for r in got) and len({r["__id"] for r in got}) == 50


def test_quality_held_out(spark):
    docs, labels = corpus(2)
    frame = spark.createDataFrame(docs + EDGE, DOCS)
    got = quality.score_quality(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) + len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 4 != 1) for r in got[: len(docs)] if held(r["doc_id"])]
    assert np.mean(right) > 0.97
    assert {r["score"] for r in quality.score_quality(frame, spark.createDataFrame([], LABELS)).collect()} == {0.0}
    assert quality.score_quality(frame.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    assert quality.score_quality(frame.select("doc_id", "text"), spark.createDataFrame(labels, LABELS)).count() == len(got)


def test_a_view_teaches_the_other():
    """With few labels, what one view is sure of makes up for what the other lacks."""
    rng = random.Random(4)
    texts, metas, labels, truth = [], [], [], []
    for i in range(1200):
        good = i % 2
        texts.append(prose(rng, 30) if good else prose(rng, 30).upper())
        metas.append(("good" if good else "bad", "en", 150.0))
        labels.append(good if i < 80 else None)
        truth.append(good)
    model = quality.co_train(texts, metas, labels)
    shapes = quality.Shapes()
    for v, rows in (("content", [quality.content(t, shapes) for t in texts]), ("metadata", [quality.metadata(m) for m in metas])):
        odds = np.array([model[v][at] @ x for at, x in rows])
        assert np.mean((odds * model["scales"][int(v == "metadata")][0] + model["scales"][int(v == "metadata")][1] > 0) == np.array(truth)) > 0.95


class PlainFtrl:
    """The learner, a coordinate at a time."""

    def __init__(self, l1, alpha=0.5, beta=1.0, l2=0.5):
        self.z, self.n, self.l1, self.alpha, self.beta, self.l2 = {}, {}, l1, alpha, beta, l2

    def weight(self, c):
        z = self.z.get(c, 0.0)
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(self.n[c])) / self.alpha + self.l2)

    def odds(self, row):
        return sum(self.weight(c) * x for c, x in row.items())

    def learn(self, row, label):
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, self.odds(row)))))
        for c, x in row.items():
            g, w, n = (p - label) * x, self.weight(c), self.n.get(c, 0.0)
            self.z[c] = self.z.get(c, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
            self.n[c] = n + g * g


def plain_scale(odds, labels):
    """Weights of a logistic regression with a ridge of 0.01, by small steps downhill along Newton's direction; odds: a list of columns."""
    columns = [*odds, [1.0] * len(labels)]
    m, w = len(columns), [0.0] * len(columns)
    for _ in range(50):
        p = [1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[j] * columns[j][i] for j in range(m)))))) for i in range(len(labels))]
        grad = [sum((q - y) * x for q, y, x in zip(p, labels, columns[j])) + 0.01 * w[j] for j in range(m)]
        rows = [[sum(q * (1 - q) * a * b for q, a, b in zip(p, columns[j], columns[k])) + 0.01 * (j == k) for k in range(m)] + [grad[j]] for j in range(m)]
        for j in range(m):  # Gauss
            best = max(range(j, m), key=lambda r: abs(rows[r][j]))
            rows[j], rows[best] = rows[best], rows[j]
            for r in range(m):
                if r != j:
                    f = rows[r][j] / rows[j][j]
                    rows[r] = [a - f * b for a, b in zip(rows[r], rows[j])]
        w = [w[j] - rows[j][m] / rows[j][j] for j in range(m)]
    return w


def test_toxicity_scores_against_plain_python(spark):
    """The query's scores against a learner written out row by row, over features found from the words themselves."""
    docs, labels = corpus(5, 260)
    rows = [(i, t) for i, t, *_ in docs]
    mark = {i: y for i, _, y in labels}

    def features(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        hashes = WordHashes()
        named = [np.uint64(hashes[w]) for w in words]
        found = set(int(h) for h in named)
        with np.errstate(over="ignore"):
            for a, b in zip(named, named[1:]):
                found.add(int(mix64(a) + b * np.uint64(3)))
            for a, b in zip(named, named[2:]):
                found.add(int(mix64(a ^ np.uint64(2)) ^ b))
            for k in toxicity.SETTING.stems:
                found |= {int(np.uint64(hashes[w[:k]]) * np.uint64(2 * k + 1)) for w in words}
        return {h & (1 << toxicity.BITS) - 1: 1.0 for h in found} | {1 << toxicity.BITS: 1.0}

    own = [i for i, _ in rows if i in mark and not held(i)]
    place = {i: xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) for i in own}
    own.sort(key=lambda i: place[i] - (1 << 64) * (place[i] >> 63))
    seen, model, order = [(features(dict(rows)[i]), mark[i]) for i in own], PlainFtrl(toxicity.SETTING.l1, toxicity.SETTING.alpha), np.random.default_rng(7)
    for _ in range(toxicity.SETTING.epochs):
        for i in order.permutation(len(seen)):
            model.learn(*seen[i])
    got = toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    for r in got:
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-model.odds(features(r["text"])))), abs=1e-9)


def test_co_training_against_plain_python():
    """Rounds of pseudo-labels, calibration and combination written out row by row."""
    rng = random.Random(6)
    texts, metas, labels = [], [], []
    for i in range(500):
        good = rng.random() < 0.5
        texts.append(prose(rng, 20) if good != (rng.random() < 0.03) else prose(rng, 20).upper())
        metas.append((rng.choice(["a", "b", None]) if good else "c", rng.choice(["en", "de"]), rng.choice([90.0, 150.0, None])))
        labels.append(int(good) if i % 2 else None)
    got = quality.co_train(texts, metas, labels)
    shapes = quality.Shapes()
    views = [[dict(zip(at.tolist(), (x * np.ones(len(at))).tolist())) for at, x in rows] for rows in ([quality.content(t, shapes) for t in texts], [quality.metadata(m) for m in metas])]
    known = [i for i in range(500) if labels[i] is not None]
    own, kept, last = ([i for k, i in enumerate(known) if k % 8 in which] for which in ((0, 1, 2, 4, 5, 6), (3,), (7,)))
    taught, odds = [{}, {}], [None, None]
    for k in range(quality.ROUNDS + 1):
        told = [{}, {}]
        for v, rows in enumerate(views):
            use, order, model = own + list(taught[v]), np.random.default_rng(11), PlainFtrl(quality.SETTING.l1)
            for _ in range(quality.SETTING.epochs):
                for i in order.permutation(len(use)):
                    model.learn(rows[use[i]], taught[v].get(use[i], labels[use[i]]))
            w = plain_scale([[model.odds(rows[i]) for i in kept]], [labels[i] for i in kept])
            odds[v] = [model.odds(r) * w[0] + w[1] for r in rows]
            if k < quality.ROUNDS:
                p = {i: 1 / (1 + math.exp(-odds[v][i])) for i in range(500) if labels[i] is None}
                told[1 - v] = {i: int(q >= quality.SURE) for i, q in p.items() if q >= quality.SURE or q <= 1 - quality.SURE}
        taught = told
        assert k == quality.ROUNDS or all(taught), "both views are to teach"
    w = plain_scale([[o[i] for i in last] for o in odds], [labels[i] for i in last])
    want = [w[0] * a + w[1] * b + w[2] for a, b in zip(*odds)]
    for i in range(500):
        own_odds = [got[name][at] @ (x * np.ones(len(at))) * got["scales"][v][0] + got["scales"][v][1] for v, (name, (at, x)) in enumerate((("content", quality.content(texts[i], shapes)), ("metadata", quality.metadata(metas[i]))))]
        assert own_odds == pytest.approx([odds[0][i], odds[1][i]], abs=1e-6)
        assert got["both"][:2] @ own_odds + got["both"][2] == pytest.approx(want[i], abs=1e-6)


def test_platt_is_calibrated():
    rng = np.random.default_rng(1)
    odds = rng.normal(size=4000) * 2
    w = quality.platt(odds[:, None], (rng.random(4000) < sigmoid(1.5 * odds - 0.5)).astype(float))
    assert w == pytest.approx([1.5, -0.5], abs=0.2)


CONTROLS = st.text(alphabet=st.sampled_from(list("[]</>\\sINT é\n")), max_size=40)


@given(CONTROLS, CONTROLS)
def test_escaping_is_reversible_and_hides_control_strings(role, text):
    java = lambda t: re.sub(chat.CONTROL, r"\1\\\2\3", t)  # noqa: E731  as Spark's expression
    for t in (role, text):
        assert chat.unescape(java(t)) == t
        assert not any(c in java(t) for c in (chat.OPEN, chat.CLOSE, chat.END, "<s>"))
    segment = chat.OPEN + java(role) + chat.CLOSE + java(text) + chat.END
    assert [(chat.unescape(r), chat.unescape(t)) for r, t in chat.TURN.findall(segment * 2)] == [(role, text)] * 2


def test_layouts(spark):
    two = [("user", "hi"), ("assistant", "yes")]
    records = [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}], "id": 3}, two),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}]}, two),
        ({"prompt": "hi", "response": "yes"}, two),
        ({"completion": "yes", "prompt": "hi", "meta": {"a": [1]}}, two),
        ({"instruction": "hi", "output": "yes"}, two),
        ({"instruction": "do", "input": "this", "output": "yes"}, [("user", "do\n\nthis"), ("assistant", "yes")]),
        ({"system": None, "prompt": "hi", "response": "yes"}, [("system", ""), *two]),
        ({"role": "user", "text": None, "turn": 0}, [("user", "")]),
        ({"prompt": "other", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]}, two),
        ({"strange": 1}, []),
        ([1], []),
        (None, []),
    ]
    for value, want in records:
        assert chat.record_turns(None if value is None else json.dumps(value)) == want
    assert chat.record_turns("{broken") == []
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(records)], "conv_id long, record string")
    got = chat.json_turns(rows, "record").collect()
    assert Counter((r["conv_id"], r["role"], r["text"]) for r in got) == Counter((i, *t) for i, (_, want) in enumerate(records) for t in want)
    tables = [
        ("conv_id long, messages array<struct<role:string,content:string>>, extra int", [(1, [("user", "hi"), ("assistant", "yes")], 3)]),
        ("conv_id long, conversations array<struct<from:string,value:string>>", [(1, [("human", "hi"), ("gpt", "yes")])]),
        ("conv_id long, prompt string, response string", [(1, "hi", "yes")]),
        ("conv_id long, turn long, role string, text string, prompt string, messages string", [(1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", "yes", None, None)]),
        ("conv_id long, instruction string, input string, output string", [(1, "hi", "", "yes")]),
    ]
    for schema, data in tables:
        turns = chat.table_turns(spark.createDataFrame(data, schema)).orderBy("turn").collect()
        assert [(r["role"], r["text"]) for r in turns] == two
    with pytest.raises(ValueError):
        chat.table_turns(spark.createDataFrame([(1, "x")], "conv_id long, strange string"))


def test_odd_records(spark):
    """Items that are no objects, lists of parts, empty lists, deep nesting, halves of surrogate pairs: none stops a task."""
    deep = "[" * 100_000 + "]" * 100_000
    parts = {"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "text", "text": "you"}]}]}
    records = [
        ('{"messages": [{"role": "user", "content": "hi"}, "x", null, 3]}', "messages", [("user", "hi"), ("", "x"), ("", ""), ("", "3")]),
        (json.dumps(parts), "message-parts", [("user", "hi\nyou")]),
        ('{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "image"}]}]}', "messages", [("user", "hi"), ("assistant", '{"type": "image"}')]),
        ('{"messages": []}', "messages", []),
        ('{"conversations": []}', "from-value", []),
        (deep, None, []),
        ('{"messages": ' + deep + "}", None, []),
        ('{"prompt": "a\\ud800b", "response": "\\ud83d\\ude00"}', "prompt-response", [("user", "a\ufffdb"), ("assistant", "😀")]),
        ('{"messages": [{"role": "model", "content": "as it is"}]}', "messages", [("model", "as it is")]),
        ('{"messages": "none"}', None, []),
        ('{"strange": 1}', None, []),
        (None, None, []),
    ]
    assert [chat.read_record(r) for r, *_ in records] == [(name, turns) for _, name, turns in records]
    rows = spark.createDataFrame([(i, r) for i, (r, *_) in enumerate(records)], "conv_id long, record string")
    got = chat.json_turns(rows, "record").orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [(i, *t) for i, (_, _, turns) in enumerate(records) for t in turns]
    assert [tuple(r) for r in chat.json_layouts(rows, "record").orderBy("conv_id").collect()] == [(i, name, len(turns)) for i, (_, name, turns) in enumerate(records)]
    table = spark.createDataFrame([(1, [("user", [("text", "hi"), ("text", "you")]), ("user", None)])], "conv_id long, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert [tuple(r) for r in chat.table_turns(table).orderBy("turn").collect()] == [(1, 0, "user", "hi\nyou"), (1, 1, "user", "")]


def test_chat_sql_agrees_on_ties_and_roles(spark):
    """Roles of the plain layout stay as they are; tied turns come in the order of their formatted text."""
    rng = random.Random(3)
    rows = [(c, rng.choice([0, 1, None]), rng.choice(["human", "gpt", "user", "assistant", "user!", "<s>"]), rng.choice(["a", "a!", "<", "<s>", "", None, "é"])) for c in range(30) for _ in range(6)]
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"}))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turn", F.coalesce("turn", F.lit(-1)))
    con.execute("CREATE TABLE c AS SELECT conv_id, coalesce(turn, -1) AS turn, role, text FROM conversations")
    con.unregister("conversations")
    con.execute("ALTER TABLE c RENAME TO conversations")
    want = {r[0]: r[1:] for r in con.execute(chat.OP5_SQL).fetchall() if r[0] >= 0}
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.format_chats(chat.table_turns(frame)).collect()} == want


def test_formatted_chats_against_plain_python(spark):
    rng = random.Random(2)
    bits = ["[INST]", "</s>", "<s>", "[/INST]", "\\", "é😀", "word ", "\n", "<\\/s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[INST]", None]), "".join(rng.choices(bits, k=rng.randrange(9))), 1) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "null id", 1), (50, 1, "assistant", None, 1), (50, 1, "assistant", None, 1), (51, None, "user", "first", 1), (51, 0, "assistant", "x" * 300_000, 1), (2**60 + 1, 0, "assistant", "big id", 1)]
    got = {r["conv_id"]: r for r in chat.format_chats(chat.table_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score int"))).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        esc = lambda t: re.sub(chat.CONTROL, r"\1\\\2\3", t)
        own = [(t, esc(r or ""), esc(x or ""), r or "", x or "") for k, t, r, x, _ in rows if k == c]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, chat.OPEN + r[1] + chat.CLOSE + r[2] + chat.END))
        learnt = "".join(r[4] for r in own if r[3] == "assistant")
        said = "".join(f"{r[3]}\n{r[4]}\n" for r in own)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(r[1]) + len(r[2]) + 17 for r in own)
    assert chat.format_chats(chat.table_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def texts():
    rng = random.Random(8)
    bits = ["password", "Secret", "TOKEN", "apikey", "api_key", " = ", ":", "=", '"', "'", " ", "abc", "abcdef", "x1+/_.=-", "AKIA", "AKIA" + "A1" * 8, "AKIA" + "B" * 15, "0f" * 12, "deadbeef", "é😀", "\n", "zz"]
    return ["".join(rng.choices(bits, k=rng.randrange(25))) for _ in range(600)] + ["secret=token: abcdefghij", "token=ab;token=abcdef", "a" * 24, "a" * 23, "AKIA" * 6, "password:=abcdef", "😀token=abcdefé", "w " * 50_000 + "secret=abcdefg"]


def test_secret_spans_against_python(spark):
    rows = list(enumerate(texts())) + [(900, None), (901, ""), (None, "token=abcdefg"), (5, texts()[5]), (5, "token=repeated1")]
    got, ledger = secret_scan.scan_secrets(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, spans string"))
    want = Counter()
    for i, t in rows:
        s = spans(t or "")
        want[(i, s.count("assign"), s.count("access"), s.count("hex"), s)] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in got.collect()) == want
    assert ledger.count() == 3 * len({t or "" for _, t in rows})
    assert secret_scan.scan_secrets(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_many_matches(spark):
    """The spans of a text with 40,000 matches, within seconds."""
    text = "é" + ("0f" * 12 + " token=abcd" + " secret=abcdef ") * 20_000
    began = time.time()
    got = secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first()
    assert (got["n_hex"], got["n_assign"], got["spans"]) == (20_000, 20_000, spans(text))
    assert time.time() - began < 60


def test_texts_that_are_not_wanted_stay(spark):
    """Before the join: every wanted row, and few others."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("path"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("blob"), F.lit("t").alias("text"))
    todo = rows.where("path % 100 = 7 OR (path IS NULL AND hex(blob) LIKE '0%')").select("path", "blob")
    got = secret_scan._wanted(rows, todo)
    assert got.join(todo, (got["blob"] == todo["blob"]), "left_semi").count() == todo.count() > 250
    assert got.count() < todo.count() + 0.1 * 20_000 and got.columns == rows.columns
    assert secret_scan._wanted(rows, todo.limit(0)).count() == 0


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([(1, "token=abcdefg"), (2, "plain")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "token=abcdefg"), (4, "token=fresh123")], "doc_id long, text string")
    _, ledger = secret_scan.scan_secrets(first)
    got, new = secret_scan.scan_secrets(second, ledger)
    assert {r["doc_id"]: r["spans"] for r in got.collect()} == {3: "assign:0:13", 4: "assign:0:14"}
    assert new.count() == 3, "one new blob, three rules"
    newer = [("hex", 2, "[0-9a-f]{5,}", None, None) if r[0] == "hex" else r for r in secret_scan.RULES]
    got, new = secret_scan.scan_secrets(second, ledger.union(new), newer)
    assert new.count() == 2 and {r["rule"] for r in new.collect()} == {"hex"}
    assert {r["doc_id"]: r["spans"] for r in got.collect()} == {3: "assign:0:13,hex:6:12", 4: "assign:0:14"}


def test_secret_sql_agrees(spark):
    rows = pd.DataFrame(list(enumerate(texts()[:300])), columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", rows)
    want = {r[0]: r[5] for r in con.execute(secret_scan.oracle()).fetchall()}
    assert want == {i: spans(t) for i, t in zip(rows["doc_id"], rows["text"])}
