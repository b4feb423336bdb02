"""Chat formatting: layouts found by a schema fingerprint, turned into canonical turns, one template.

A record's layout is the set of its nested field paths (``messages[].role``). The sorted paths are hashed,
and the hash selects a declarative mapping that says where turns, roles and texts are. Tables have one
layout, found from their schema; JSON records have one each. Columns that no mapping knows are ignored.

The template writes a turn as ``[INST]role[/INST]text</s>``. Control strings inside roles and texts are
escaped by a backslash after their first character (one more where backslashes stand there already), so
that they can't be taken for the template's, and unescaping gives back what was there. The loss mask
covers the texts of assistant turns.

A conversation's text is the concatenation of its turns' segments, and is kept as one row a turn, so that
no conversation must fit in memory. Reading back streams sorted segments through running digests.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import table

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: What looks like a control string ([INST], [/INST], <s>, </s>), with the backslashes after its first character.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "(.*?)" + re.escape(END), re.S)
LEARNT = "assistant"
#: Names of roles in the layout that has its own.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
BACK_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. turns: the array that holds them, "" if a row is a turn, None if fields are turns.

    role, text, order: names within a turn. fields: (role, names of fields, joined by an empty line), in order.
    roles: other names that the layout has for roles. parts: the text is a list of parts, whose texts are joined by a line end.
    """

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = ""
    text: str = ""
    order: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    parts: bool = False


MAPPINGS = [
    Mapping("rows", ("role", "text", "turn"), "", "role", "text", "turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("message-parts", ("messages[].content[].text", "messages[].content[].type", "messages[].role"), "messages", "role", "content", parts=True),
    Mapping("from-value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=tuple(ROLES.items())),
    Mapping("prompt-response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt-completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system-prompt-response", ("prompt", "response", "system"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction-input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
]
KNOWN = {re.split(r"\[|\.", p)[0] for m in MAPPINGS for p in m.paths}


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    """The hash of a layout: of its field paths in order, without those whose top field no mapping knows."""
    own = sorted(p for p in set(paths) if re.split(r"\[|\.", p)[0] in KNOWN)
    return hashlib.sha256("\n".join(own).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def select_mapping(paths: set[str]) -> Mapping | None:
    """The mapping of a layout's fingerprint.

    Fields of another layout beside a whole one (an extra column that is called ``prompt``, say) change
    the fingerprint; then the mapping that takes up most of the paths counts, the first listed if several do.
    """
    exact = BY_FINGERPRINT.get(fingerprint(paths))
    if exact is not None:
        return exact
    return max((m for m in MAPPINGS if set(m.paths) <= paths), key=lambda m: len(m.paths), default=None)


def schema_paths(kind: T.DataType, path: str = "") -> set[str]:
    """The paths of a schema's leaves; an array's elements are ``[]``."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{path}.{f.name}" if path else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{path}[]")
    return {path}


def value_paths(value) -> set[str]:
    """The same for a parsed JSON value, however deep; an empty array or object is a leaf."""
    found, open_ = set(), [("", value)]
    while open_:
        path, v = open_.pop()
        if isinstance(v, dict) and v:
            open_ += [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            open_ += [(f"{path}[]", x) for x in v]
        else:
            found.add(path)
    return found


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _role(c: Column, m: Mapping) -> Column:
    if not m.roles:
        return _text(c)
    known = F.create_map(*(F.lit(x) for pair in m.roles for x in pair))
    return F.coalesce(known[c], _text(c))


def _content(c: Column, m: Mapping) -> Column:
    return F.coalesce(F.array_join(F.transform(c, lambda p: p["text"]), "\n"), F.lit("")) if m.parts else _text(c)


def table_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table, by the mapping that its schema's fingerprint selects."""
    m = select_mapping(schema_paths(df.schema))
    if m is None:
        raise ValueError(f"no mapping for a table with {sorted(schema_paths(df.schema))}")
    i = F.col(id_col).cast("long").alias("conv_id")
    if m.turns == "":
        return df.select(i, F.col(m.order).cast("long").alias("turn"), _role(F.col(m.role), m).alias("role"), _text(F.col(m.text)).alias("text"))
    if m.turns:
        rows = df.select(i, F.posexplode(m.turns).alias("turn", "t"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("t")[m.role], m).alias("role"), _content(F.col("t")[m.text], m).alias("text"))
    fields = [F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *(F.when(F.col(n) != "", F.col(n)) for n in names)).alias("text")) for r, names in m.fields]
    rows = df.select(i, F.posexplode(F.array(*fields)).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def _said(x) -> str:
    """A JSON value as text: null is empty, what isn't a string is JSON; halves of a surrogate pair, which no text holds, become U+FFFD."""
    said = "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    return said.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _joined(x) -> str:
    """A text, or the texts of a list of parts, a line each; parts without a text are JSON."""
    if not isinstance(x, list):
        return _said(x)
    return "\n".join(_said(p["text"] if isinstance(p, dict) and "text" in p else p) for p in x)


def read_record(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """(name of the layout, canonical (role, text) turns) of one JSON record.

    None and no turns if it can't be parsed, is nested too deep for the parser, or has an unknown layout. An
    empty list of turns is that layout without turns. An item of a list of turns that is no object is a
    turn without a role; a text that is a list of parts is their texts, a line each.
    """
    try:
        value = json.loads(record or "")
        if not isinstance(value, dict):
            return None, []
        m = select_mapping(value_paths(value)) or next((m for m in MAPPINGS if m.turns and value.get(m.turns) == []), None)
        if m is None:
            return None, []
        if m.turns is None:
            return m.name, [(r, "\n\n".join(x for n in names if (x := _said(value.get(n))))) for r, names in m.fields]
        items, roles = value[m.turns] if m.turns else [value], dict(m.roles)
        turns = [(_said(t.get(m.role)), _joined(t.get(m.text))) if isinstance(t, dict) else ("", _said(t)) for t in items]
        return m.name, [(roles.get(r, r), text) for r, text in turns]
    except (ValueError, RecursionError):
        return None, []


def record_turns(record: str | None) -> list[tuple[str, str]]:
    return read_record(record)[1]


def json_turns(df: DataFrame, record_col: str, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns of a column of JSON records, each by its own fingerprint. Unknown layouts give no turns: see json_layouts()."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))
    def turns(records: pd.Series) -> pd.Series:
        return pd.Series([[{"role": r, "text": t} for r, t in record_turns(x)] for x in records])

    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), F.posexplode(turns(F.col(record_col))).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def json_layouts(df: DataFrame, record_col: str, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, layout, n_turns) of each record; layout: null for records that json_turns() can't read."""

    @F.pandas_udf(T.StructType([T.StructField("layout", T.StringType()), T.StructField("n", T.LongType())]))
    def layout(records: pd.Series) -> pd.DataFrame:
        found = [read_record(x) for x in records]
        return pd.DataFrame({"layout": pd.Series([name for name, _ in found], dtype=object), "n": [len(turns) for _, turns in found]})

    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), layout(F.col(record_col)).alias("l"))
    return rows.select("conv_id", "l.layout", F.col("l.n").alias("n_turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, segment (of the conversation's formatted text), loss_start, loss_length (code points of the segment)."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    rows = turns.select("conv_id", "turn", "role", role.alias("r"), text.alias("t"))
    learnt = F.col("role") == LEARNT
    start = F.length("r") + len(OPEN) + len(CLOSE)
    return rows.select("conv_id", "turn", F.concat(F.lit(OPEN), "r", F.lit(CLOSE), "t", F.lit(END)).alias("segment"), F.when(learnt, start).otherwise(0).alias("loss_start"), F.when(learnt, F.length("t")).otherwise(0).alias("loss_length"))


class _Conversation:
    """Running digests of a conversation's segments."""

    def __init__(self, conv_id):
        self.id, self.turns, self.chars, self.loss = conv_id, 0, 0, 0
        self.all, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, length: int) -> None:
        for role, text in TURN.findall(segment):
            self.turns += 1
            self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        learnt = unescape(segment[start : start + length])
        self.loss += len(learnt)
        self.learnt.update(learnt.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return None if self.id is None else int(self.id), self.turns, self.all.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in BACK_SCHEMA.split(", ")]
    columns = dict(zip(names, zip(*rows)))
    return pd.DataFrame(columns | {"conv_id": pd.array(columns["conv_id"], "Int64")})  # a null must not turn ids to floats


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, done = None, []
    for batch in batches:
        for key, segment, start, length in zip(batch["key"], batch["segment"], batch["loss_start"], batch["loss_length"]):
            conv_id = key or None
            if now is None or now.id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv_id)
            now.add(segment, start, length)
        if len(done) >= 1000:
            yield _frame(done)
            done = []
    if now is not None:
        yield _frame([*done, now.row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from its segments alone: see BACK_SCHEMA.

    A conversation's digests need its turns in order, so one task reads a conversation, as a stream; what
    can be done turn by turn (mapping, escaping, formatting) was done before, wherever the turn was.
    """
    keyed = formatted.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))  # as text, since a null would turn ids to floats
    dealt = keyed.repartition("key").sortWithinPartitions("key", "turn", "segment")
    return dealt.select("key", "segment", "loss_start", "loss_length").mapInPandas(_read, BACK_SCHEMA)


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations, read back. turns: see table_turns().

    Turns come in the order of ``turn`` (nulls first), ties in the order of their formatted text; repeated
    rows are turns too. Null roles and texts are empty; rows with a null id are one conversation; an empty
    table gives no rows; extra columns of the tables are ignored.
    """
    return read_back(format_turns(turns))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations (a row a turn), and conversation -1 in the layout of a list of messages."""
    ok = f"{END}{OPEN} ok {CLOSE}"
    kind = "conv_id long, messages array<struct<role:string,content:string>>"
    extra = spark.createDataFrame([(-1, [("user", ok), ("assistant", ok)])], kind)
    return format_chats(table_turns(table(spark, sf_dir, "conversations")).unionByName(table_turns(extra)))


_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
OP5_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{OPEN} ok {CLOSE}' UNION ALL SELECT -1, 1, 'assistant', '{END}{OPEN} ok {CLOSE}'
), f AS (SELECT *, '{OPEN}' || {_ESC.format("role")} || '{CLOSE}' || {_ESC.format("text")} || '{END}' AS segment FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, segment)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LEARNT}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, segment) FILTER (role = '{LEARNT}'), '')) AS loss_sha256,
       sum(length(segment))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
