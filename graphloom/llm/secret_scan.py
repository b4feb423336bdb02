"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by its content (SHA-256): a blob. The ledger holds the pairs (blob,
rule, rule version) that were ever scanned, with their findings, so that a delivery is scanned for pairs
that the ledger lacks only: a text that came before, under whatever path, is read no further, and a rule
with a new version is the only one run over old texts. Findings are kept per blob, once, and are joined
back to all paths that hold it.

Spans of matches come from cutting the text at the rule's pattern: the lengths of the pieces between
matches and of the matches add up to code-point offsets. They are added up by doubling steps, so that a
text with many matches takes little more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import durable, table

#: Fixed values, in the order of the kinds: (kind, version, pattern, cheap test that each match passes,
#: least length of the match or of its second group).
RULES = [
    (
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "[:=]",
        6,
    ),
    ("access", 1, "AKIA[A-Z0-9]{16,}", "AKIA", None),
    ("hex", 1, "[0-9a-f]{24,}", None, None),
]
KINDS = [r[0] for r in RULES]
LEDGER_SCHEMA = "blob binary, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


def blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob): the content address of each row's text; null counts as empty."""
    return docs.select(F.col(id_col).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob"))


def _running(numbers: Column, n: Column) -> Column:
    """The running sums of an array of ``n`` numbers: each step adds to an entry the one 1, 2, 4, ... places before."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"))

    def add(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(F.lit(0)))

    return F.aggregate(steps, numbers, add)


def _spans(text: Column, rule: tuple) -> Column:
    """The spans of a rule's matches in ``text``, in order; code points, end exclusive."""
    kind, _, pattern, test, least = rule
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    good = F.transform(found, lambda m: F.lit(True))
    if least is not None:
        good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda g: F.length(g) >= least)
    size = lambda c: F.transform(c, lambda x: F.length(x).cast("long"))
    cut = F.struct(size(found).alias("len"), size(gaps).alias("gap"), good.alias("good"))  # of gaps, the last has no match after it

    def placed(cut: Column) -> Column:
        ends = _running(F.zip_with(F.slice(cut["gap"], F.lit(1), F.size(cut["len"])), cut["len"], lambda g, m: g + m), F.size(cut["len"]))
        ended = F.arrays_zip(ends.alias("end"), cut["len"].alias("len"), cut["good"].alias("good"))
        return F.transform(F.filter(ended, lambda x: x["good"]), lambda x: F.struct((x["end"] - x["len"]).alias("start"), x["end"].alias("end")))

    spans = F.get(F.transform(F.array(cut), placed), F.lit(0))  # the text is cut once
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    some = text.rlike(pattern) if test is None else text.rlike(test) & text.rlike(pattern)
    return F.when(some, spans).otherwise(none)


#: Marks of wanted rows: one bit of 2^MARK_BITS at most, so 16 MB are sent to all executors at most, however many rows are wanted.
MARK_BITS = 27


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("path", "blob"), F.lit(1 << bits))


def _wanted(texts: DataFrame, todo: DataFrame) -> DataFrame:
    """``texts`` (path, blob, ...) without most rows that aren't in ``todo`` (path, blob), before anything is moved.

    todo's rows set bits of a bitmap (4 KB a row of it), which is broadcast. A bit may be another row's: an exact join must follow.
    """
    n = todo.count()
    bits = min(MARK_BITS, max(15, (16 * n).bit_length()))
    place = _place(bits)
    marks = todo.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))
    rows = texts.withColumn("__bucket", F.bitmap_bucket_number(place)).withColumn("__at", F.bitmap_bit_position(place)).join(F.broadcast(marks), "__bucket")
    byte = F.conv(F.hex(F.substring("__bits", F.expr("int(__at div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    set_ = F.call_function("shiftright", byte, F.expr("int(__at % 8)")).bitwiseAND(F.lit(1)) == 1
    return rows.where(set_).drop("__bucket", "__at", "__bits")


def scan(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None = None, rules: list[tuple] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows: the findings of each (blob, rule, version) of ``docs`` that the ledger lacks. paths: see blobs().

    A blob is read from one path, the smallest. Only the texts of those rows cross the network (and a few
    that a bitmap can't tell from them), to meet the blob's row; rules whose pair is known are not run.
    """
    want = paths.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*(F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("version")) for r in rules))
    if ledger is None:
        todo = want.withColumn("todo", every)
    else:
        known = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("known"))  # few: a row a rule and version
        todo = want.join(known, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("known", F.array_except(every, every))))
        todo = todo.where(F.size("todo") > 0).drop("known")
    todo = durable(todo)
    texts = docs.select(F.col(id_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = _wanted(texts.withColumn("blob", F.unhex(F.sha2("text", 256))), todo)
    one = texts.join(todo.withColumnRenamed("path", "__path").hint("shuffle_hash"), "blob").where(F.col("path").eqNullSafe(F.col("__path")))
    results = []
    for rule in rules:
        pair = F.struct(F.lit(rule[0]).alias("rule"), F.lit(rule[1]).alias("version"))
        row = F.struct(F.lit(rule[0]).alias("rule"), F.lit(rule[1]).alias("version"), _spans(F.col("text"), rule).alias("spans"))
        results.append(F.when(F.array_contains("todo", pair), row))
    found = one.select("blob", F.explode(F.array(*results)).alias("r")).where("r is not null")
    return found.select("blob", "r.rule", "r.version", "r.spans").dropDuplicates(["blob", "rule", "version"])  # a path may come twice


def findings(ledger: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """Per blob, under the given versions: n_<kind> of each kind, and all spans as kind:start:end by start, then kind as listed."""
    now = F.array(*(F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("version")) for r in rules))
    rows = ledger.where(F.array_contains(now, F.struct("rule", "version")))
    place = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r[0], i)))
    tagged = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place[F.col("rule")].alias("k"), F.concat_ws(":", "rule", s["start"], s["end"]).alias("said")))
    # A blob has one row a rule.
    each = rows.groupBy("blob").agg(*(F.max(F.when(F.col("rule") == r[0], tagged)).alias(r[0]) for r in rules))
    both = F.array_sort(F.flatten(F.array(*(F.coalesce(r[0], F.array().cast("array<struct<start:bigint,k:int,said:string>>")) for r in rules))))
    said = F.array_join(F.transform(both, lambda s: s["said"]), ",")
    return each.select("blob", *(F.coalesce(F.size(r[0]), F.lit(0)).cast("long").alias(f"n_{r[0]}") for r in rules), said.alias("spans"))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: list[tuple] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a row per row of ``docs``: doc_id, n_<kind>..., spans; the ledger's new rows, LEDGER_SCHEMA).

    Null counts as empty; a null id is a path too; repeated rows each get their text's findings; an empty
    table gives no rows; extra columns are not read; long texts are scanned whole.
    """
    paths = durable(blobs(docs, id_col, text_col))
    new = durable(scan(docs, paths, ledger, rules, id_col, text_col))
    whole = new if ledger is None else ledger.select(*new.columns).union(new)
    per_blob = findings(whole, rules)
    rows = paths.join(per_blob, "blob")
    return rows.select(F.col("path").alias("doc_id"), *(f"n_{r[0]}" for r in rules), "spans"), new


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = scan_secrets(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def _oracle_spans(kind: str, pattern: str, k: int, least: int | None) -> str:
    good = f"length(regexp_extract(m[i], '{pattern}', 2)) >= {least}" if least else "TRUE"
    return f"""
    SELECT doc_id, '{kind}' AS kind, {k} AS k, pos AS start, pos + length(m[i]) AS stop
    FROM (SELECT doc_id, m, i, list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS pos
          FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM d WHERE regexp_matches(text, '{pattern}')),
               LATERAL (SELECT unnest(generate_series(1, len(m))) AS i))
    WHERE {good}"""


def oracle() -> str:
    """DuckDB SQL for the query: the same cut of the text between matches."""
    parts = [_oracle_spans(kind, pattern.replace("'", "''"), k, least) for k, (kind, _, pattern, _, least) in enumerate(RULES)]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""
