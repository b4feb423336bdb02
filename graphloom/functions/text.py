"""Text functions: token counts and caps, strict-then-loose JSON, tool calls in text, renderings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Caps in tokens, and characters that stand for a token.
SUMMARY_CAP, DETAIL_CAP, INGEST_CAP, STATEMENT_CAP = 300, 8_000, 25_000, 8_000
CONTEXT_BUDGET, HISTORY_BUDGET, CHARS_A_TOKEN = 20_000, 3_000, 4
#: Room for a tokenizer that counts more; stated, and applied nowhere.
SAFETY_FACTOR = 1.2


def count_tokens(text: Column) -> Column:
    """The default token count: a quarter of the characters, rounded up; null counts 0."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / F.lit(CHARS_A_TOKEN)).cast("long")


def within(text: Column, cap: int) -> Column:
    return count_tokens(text) <= cap


def truncate(text: Column, cap: int) -> Column:
    """Text over ``cap`` tokens is cut to cap x 4 characters; other text stays."""
    return F.when(count_tokens(text) > cap, F.substring(text, 1, cap * CHARS_A_TOKEN)).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind that Unicode knows and the four separators U+001C to U+001F."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def classify(reply: Column) -> Column:
    """``experience`` if the reply says so anywhere, else ``supplement``."""
    return F.when(F.lower(strip(reply)).contains("experience"), "experience").otherwise("supplement")


def context_line(kind: Column, label: Column, summary: Column) -> Column:
    return F.concat(F.lit("- ["), kind, F.lit("] "), label, F.lit(": "), summary)


def retrieval_text(label: Column, summary: Column) -> Column:
    return F.concat(label, F.lit(": "), summary)


def merge_text(kind: Column, label: Column, summary: Column) -> Column:
    return F.concat(kind, F.lit(": "), label, F.lit(" — "), summary)


def path_text(steps: Column) -> Column:
    """``[type] label -> ...`` of an array of structs (type, label)."""
    return F.array_join(F.transform(steps, lambda s: F.concat(F.lit("["), s["type"], F.lit("] "), s["label"])), " -> ")


def loose_json(text: str | None, default: str = "{}") -> str:
    """The JSON object in a reply, as compact JSON: the whole text, else from its first ``{`` to its last ``}``, else the default.

    Anything but an object counts as the default, lists and numbers too.
    """
    tries = [text or ""]
    if (span := re.search(r"\{.*\}", tries[0], re.S)) is not None:
        tries.append(span[0])
    for candidate in tries:
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else default
    return default


def parse_loose_json(text: Column, default: str = "{}") -> Column:
    """loose_json() of a column. Spark's own parsers accept what follows a first value, which must fail here."""

    @F.pandas_udf(T.StringType())
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: loose_json(t, default))

    return parsed(text)


#: Fixed patterns of tool calls in text.
_BLOCK = re.compile(r"<\|?\s*tool_call\s*\|?>(.+?)<\|?\s*/?\s*tool_call\s*\|?>", re.S)
_CALL = re.compile(r"(?:call\s*:\s*)?([A-Za-z_]\w*)\s*\{(.*)\}", re.S)
_KEY = re.compile(r"([{,]\s*)([A-Za-z_]\w*)\s*:")


#: Fixed names of fields, in the order in which they are looked for.
_NAMES, _ARGUMENTS = ("name", "function"), ("arguments", "parameters")


def _json_or(text: str, other):
    try:
        return json.loads(text)
    except ValueError:
        return other


def _from_object(body: str) -> tuple | None:
    """A JSON object that names a tool; its arguments may be JSON in a string."""
    said = _json_or(body, None)
    if not isinstance(said, dict):
        return None
    name, args = (next(filter(None, map(said.get, fields)), None) for fields in (_NAMES, _ARGUMENTS))
    args = _json_or(args, None) if isinstance(args, str) else args
    return name, {} if args is None else args


def _from_braces(body: str) -> tuple | None:
    """``name{...}``, with marks for quotes and keys without them. Arguments beyond repair are empty."""
    for name, inside in _CALL.findall(body)[:1]:
        quoted = _KEY.sub(r'\1"\2":', "{%s}" % inside.replace('<|"|>', '"'))
        return name, _json_or(quoted, {})
    return None


#: Ways to write a call, in the order in which they are tried.
_DECODERS = (_from_object, _from_braces)


def tool_call(reply: str | None, allowed: list[str]) -> tuple[str, dict] | None:
    """(name, arguments) of the tool call in a model's text: the first reading that names an allowed tool and has an object of arguments.

    What a marked block holds is read, else the whole text.
    """
    texts = _BLOCK.findall(reply or "")[:1] or [reply or ""]
    readings = filter(None, (decode(texts[0].strip()) for decode in _DECODERS))
    return next((r for r in readings if isinstance(r[0], str) and r[0] in allowed and isinstance(r[1], dict)), None)


def parse_tool_call(reply: Column, allowed: list[str]) -> Column:
    """tool_call() of a column: struct(name, args), null without a call. Written with pandas, as no built-in function mends JSON."""

    @F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.StringType())]))
    def parsed(replies: pd.Series) -> pd.DataFrame:
        rows = [tool_call(r, allowed) or (None, None) for r in replies]
        return pd.DataFrame([(n, None if a is None else json.dumps(a, ensure_ascii=False)) for n, a in rows], columns=["name", "args"])

    out = parsed(reply)
    return F.when(out["name"].isNotNull(), out)
