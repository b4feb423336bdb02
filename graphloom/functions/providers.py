"""What a model does elsewhere, as pluggable functions with deterministic defaults.

All are plain Python functions of rows, called on executors in batches; one that calls a server can hold
a client per worker. A judge's answers are written down once (session.durable) before they are used, so
that a repeated task doesn't ask again.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from graphloom.functions.text import SUMMARY_CAP, CHARS_A_TOKEN

#: Words that a company's label loses before it is compared.
COMPANY_ENDINGS = {"inc", "corp", "motors", "llc"}


def canonical_label(kind: str | None, label: str | None) -> str:
    """A label as the ontology's merge rules compare it."""
    words = re.findall(r"\w+", (label or "").lower())
    return " ".join(w for w in words if kind != "Company" or w not in COMPANY_ENDINGS)


def judge(a: dict, b: dict) -> tuple[str, str]:
    """(verdict, why) for two nodes (type, label, summary...): the same type and canonical label, or different."""
    same = a["type"] == b["type"] and canonical_label(a["type"], a["label"]) == canonical_label(b["type"], b["label"]) != ""
    return ("same", "labels agree") if same else ("different", "labels differ")


def fuse(a: dict, b: dict) -> tuple[str, str]:
    """(summary, reconciliation) of two nodes."""
    return f"{a['summary']} / {b['summary']}"[: SUMMARY_CAP * CHARS_A_TOKEN], ""


def stop_merging(merged: int, candidates: int) -> bool:
    """Whether the rounds of merging end: when a round merged nothing."""
    return merged == 0


#: (type of seed, type of remote) -> (edge type, what, why) that the default linker takes to hold.
LINK_RULES = {
    ("Company", "Industry"): ("IN_INDUSTRY", "the company works in the industry", "a product of the company belongs to it"),
    ("Person", "Product"): ("RELATED_TO", "the person is tied to the product", "the person's company makes it"),
}


def takes(seed: Callable, remote: Callable) -> Callable:
    """Lets a linker say beforehand which nodes it can link: two functions of a Column (a struct of id, type, label, summary, version) that give a boolean.

    They must be true wherever the linker could hold. Pairs with other nodes are refused without being made.
    """

    def said(linker: Callable) -> Callable:
        linker.seed_fits, linker.remote_fits = seed, remote
        return linker

    return said


@takes(lambda n: n["type"].isin(*(s for s, _ in LINK_RULES)), lambda n: n["type"].isin(*(r for _, r in LINK_RULES)))
def link(seed: dict, remote: dict, path: str) -> dict:
    """A verdict on a link: holds, what, why, edge_type."""
    rule = LINK_RULES.get((seed["type"], remote["type"]))
    return {"holds": False} if rule is None else {"holds": True, "edge_type": rule[0], "what": rule[1], "why": rule[2]}


def extract(text: str) -> str:
    """The reply of an extractor; the default takes the text to be one."""
    return text


def classify(statement: str) -> str:
    return "experience" if re.search(r"\b(i|my|me|we|our)\b", statement.lower()) else "supplement"


def compress(statement: str, target_tokens: int) -> str:
    """A shorter statement; an empty reply means: keep the original."""
    return statement[: target_tokens * CHARS_A_TOKEN]


@dataclass(frozen=True)
class Providers:
    judge: Callable = judge
    fuse: Callable = fuse
    stop_merging: Callable = stop_merging
    link: Callable = link
    extract: Callable = extract
    classify: Callable = classify
    compress: Callable = compress


@dataclass
class ChatClient:
    """A client of a chat-completions server."""

    base_url: str
    model: str
    api_key: str = "none"
    timeout: float = 120.0
    context_tokens: int = 40_000
    headers: dict = field(default_factory=dict)

    def _send(self, path: str, body: dict | None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"} | self.headers
        with urllib.request.urlopen(urllib.request.Request(self.base_url.rstrip("/") + path, data, headers), timeout=self.timeout) as r:
            return json.load(r)

    def chat(self, messages: list[dict], tools: list[dict] | None = None, temperature: float = 0.2) -> dict:
        """The reply's message: content, and tool_calls if it has any."""
        body = {"model": self.model, "messages": messages, "temperature": temperature}
        if tools:
            body |= {"tools": tools, "tool_choice": "auto"}
        return self._send("/chat/completions", body)["choices"][0]["message"]

    def ping(self) -> bool:
        try:
            self._send("/models", None)
        except OSError:
            return False
        return True


#: Makers of clients by name; a role is mapped to a name by the environment or by the caller.
BACKENDS: dict[str, Callable[[dict], ChatClient]] = {
    "local": lambda env: ChatClient(env.get("GRAPHLOOM_CHAT_URL", "http://127.0.0.1:1234/v1"), env.get("GRAPHLOOM_CHAT_MODEL", "local"), env.get("GRAPHLOOM_CHAT_KEY", "none")),
}


#: The roles, and where a role without a name of its own looks next.
ROLES = {"backend": None, "agent": "backend"}


def backend_of(role: str, env: dict) -> str:
    """The name in ``GRAPHLOOM_<ROLE>``, or that of the role it falls back to, or local. Empty counts as unset."""
    while role is not None:
        if named := env.get(f"GRAPHLOOM_{role.upper()}"):
            return named
        role = ROLES.get(role)
    return "local"


def client_for(role: str, env: dict) -> ChatClient:
    name = backend_of(role, env)
    if name not in BACKENDS:
        raise ValueError(f"no chat backend {name!r} for {role}; known: {sorted(BACKENDS)}")
    return BACKENDS[name](env)


def validate_env(env: dict) -> dict:
    """What the environment gives, for a check at the start: each role's backend, and where the backend's client talks to.

    A role that names an unknown backend is an error; a server that doesn't answer is not, it is reported.
    """
    clients = {role: client_for(role, env) for role in ROLES}
    main = clients["backend"]
    return {role: backend_of(role, env) for role in ROLES} | {"base_url": main.base_url, "model": main.model, "context_tokens": main.context_tokens, "reachable": main.ping()}
