"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Words are counted; sources get targets by water-filling (see targets()).
2. Each source's rows are put in a permuted order: by hash bucket, then hash. A (source, pass, bucket)
   is a block. Two-level prefix sums (over the buckets' sums, then within a bucket) tell which rows fit, so
   that no task holds a source.
3. A source whose target is p times its size and a rest gives all blocks p times, and of the rest's pass
   the rows of the permuted order that fit: a row too large for what is left is passed over in the next
   round. If all rows that fit are not enough, some are taken again; at last the row nearest to the gap is added.
4. The number of blocks each source gives is its exact quota. A binary tree over the output shards splits
   the vector of quotas: the left half's share of blocks is drawn from the multivariate hypergeometric
   distribution, source by source (groups of sources first, where they are many), by inversion with
   uniform numbers from a hash; the right half gets what is left. So each shard gets what a uniformly random deal of all blocks would give it.
5. Each source's blocks, in hash order, are dealt to the shards in runs as long as their quotas: disjoint
   draws of permuted blocks. Within a shard rows are put in hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import durable, numbered, table, total_order, unused

#: Fixed values of the mix: weights by the sources' order, repeated, and how often a source may be taken.
WEIGHTS, MOST_PASSES = (5, 2, 1), 3
SHARDS, BUCKETS, SEED = 256, 1024, 20240301
#: Parts of a shard that may be in different tasks, so that tasks needn't hold whole shards.
PARTS = 256
#: Rounds in which rows of the rest's pass are taken; each leaves a gap smaller than a row that it could hold.
#: Rounds after those take rows again, for sources whose rest is larger than what fits it.
FILLS, REPEATS = 3, 2
#: Sources that one row of the tree holds, and tasks that its rows are dealt to where they are many.
GROUP, NODE_TASKS = 64, 64
#: Up to so many sources (rows of a few dozen bytes) are sent to all executors; beyond it a shuffled join is used.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: F.Column) -> F.Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (skey, source_size; a row a source) with ``target``: shares of the total by weight, none above its cap.

    The level is what a weight of 1 gets. It starts as the total over all weights; sources whose cap is not
    above their share keep the cap, and the others share what is left at a higher level, until no more
    sources reach their caps. A round is one aggregate of whole numbers; few are needed.
    """
    weight = F.array(*map(F.lit, WEIGHTS))[(F.col("i") % len(WEIGHTS)).cast("int")]
    rows = numbered(sizes.select("skey", "source_size"), ["skey"], "i").withColumn("w", weight).withColumn("cap", F.col("source_size") * MOST_PASSES)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w") if capped >= 0 else F.lit(False)
        n, spent, free = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == capped or not free:
            break
        level, capped = (total - (spent or 0)) / free, n
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")) if free else F.col("cap").cast("double")
    return rows.select("skey", "source_size", target.alias("target"))


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _log_factorial(x: str) -> str:
    """SQL for the logarithm of x!: exact for small x, else Stirling's series (off by less than 1e-10)."""
    small = ", ".join(f"{math.lgamma(k + 1)!r}D" for k in range(12))
    return f"if({x} < 12, element_at(array({small}), cast({x} as int) + 1), {x} * ln({x}) - {x} + ln({2 * math.pi!r}D * {x}) / 2 + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}) + 1D / (1260D * pow({x}, 5)))"


def _draw(total: str, good: str, n: str, u: str) -> str:
    """SQL for a hypergeometric number: of ``n`` drawn from ``total``, how many are among the ``good``; ``u`` is uniform in [0, 1).

    By inversion: chances add up, from 8 standard deviations below the mean on, until they exceed ``u``.
    """
    f = lambda x: _let(f"cast({x} as double)", "x", _log_factorial("x"))
    first = f"exp({f('p.g')} + {f('p.t - p.g')} + {f('p.n')} + {f('p.t - p.n')} - {f('p.t')} - {f('a.lo')} - {f('p.g - a.lo')} - {f('p.n - a.lo')} - {f('p.t - p.g - p.n + a.lo')})"
    up = "s.w * (p.g - k + 1) * (p.n - k + 1) / (k * (p.t - p.g - p.n + k))"
    ks = "slice(sequence(a.lo, a.hi), 2, cast(a.hi - a.lo as int))"
    step = _let(up, "x", "struct(x as w, s.c + x as c, k as at)")
    pick = f"aggregate({ks}, struct(b as w, b as c, a.lo as at), (s, k) -> if({u} < s.c, s, {step})).at"
    mean = "(cast(p.n as double) * p.g / p.t)"
    spread = f"(8 * sqrt({mean} * (1 - cast(p.g as double) / p.t) * (p.t - p.n) / greatest(p.t - 1, 1)) + 2)"
    low = f"greatest(greatest(p.n - (p.t - p.g), 0), cast(floor({mean} - {spread}) as bigint))"
    high = f"least(least(p.g, p.n), cast(ceil({mean} + {spread}) as bigint))"
    inner = _let(f"struct({low} as lo, {high} as hi)", "a", f"if(a.lo >= a.hi, a.lo, {_let(first, 'b', pick)})")
    return _let(f"struct(cast({total} as bigint) as t, cast({good} as bigint) as g, cast({n} as bigint) as n)", "p", f"if(p.t = 0, cast(0 as bigint), {inner})")


_SUM = "aggregate(q, 0L, (s, x) -> s + x)"


def _split(nodes: DataFrame, groups: int, level: int, seed: int) -> DataFrame:
    """``nodes`` (first, n, grp, q) with ``got``: how much of each entry of q the left half of a node's shards gets.

    A node's sources are in ``groups`` rows of GROUP entries at most. Sums of rows are entries of a row above,
    and so on up to one row a node. From there down, entries draw one after the other within their row, of
    what the row has drawn; so the whole is a multivariate hypergeometric draw, and no row grows with the sources.
    """
    rows = [nodes]
    while groups > 1:
        sums = rows[-1].groupBy("first", "n", F.expr(f"grp div {GROUP}").alias("grp"))
        sums = sums.agg(F.sort_array(F.collect_list(F.struct(F.col("grp").alias("below"), F.expr(_SUM).alias("s")))).alias("e"))  # GROUP entries at most
        rows.append(sums.select("first", "n", "grp", F.col("e.s").alias("q")))
        groups = -(-groups // GROUP)
    drawn = rows.pop().withColumn("want", F.expr(f"cast(floor({_SUM} * (n div 2) / n) as bigint)"))
    while True:
        u = f"((xxhash64({seed}, {level}, {len(rows)}, first, grp, i) & 9007199254740991L) / 9007199254740992D)"
        state = f"struct({_SUM} as t, want as n, cast(array() as array<bigint>) as got)"
        deal = _let(_draw("st.t", "q[i]", "st.n", u), "d", "struct(st.t - q[i] as t, st.n - d as n, concat(st.got, array(d)) as got)")
        drawn = drawn.withColumn("got", F.expr(f"if(n = 1 or size(q) = 0, q, aggregate(sequence(0, size(q) - 1), {state}, (st, i) -> {deal}).got)")).drop("want")
        if not rows:
            return drawn
        each = drawn.select("first", F.col("grp").alias("above"), F.posexplode("got").alias("at", "want"))
        drawn = rows.pop().join(each.select("first", F.expr(f"above * {GROUP} + at").alias("grp"), "want"), ["first", "grp"])


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """For each source and shard its number of blocks: (skey, shard, blocks), from (skey, quota).

    A node of the tree is as many rows as its sources need, GROUP a row, dealt to all tasks; a level is one
    projection where all sources fit a row, else a few joins. The result is a row a source and shard.
    """
    own = numbered(quotas.select("skey", F.col("quota").cast("long").alias("quota")), ["skey"], "i").withColumn("grp", F.expr(f"i div {GROUP}"))
    held = own.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("i", "skey", "quota"))).alias("s"))  # GROUP entries at most
    held = durable(held)
    groups = held.count()
    nodes = held.select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "grp", F.col("s.quota").alias("q"))
    for level in range(max(0, (shards - 1).bit_length())):
        nodes = _split(nodes, groups, level, seed)
        left = F.struct(F.col("got").alias("q"), F.col("first"), F.expr("if(n = 1, 1, n div 2)").alias("n"))
        right = F.struct(F.expr("zip_with(q, got, (a, b) -> a - b)").alias("q"), F.expr("int(first + n div 2)").alias("first"), F.expr("int(n - n div 2)").alias("n"))
        nodes = nodes.withColumn("e", F.explode(F.when(F.col("n") == 1, F.array(left)).otherwise(F.array(left, right)))).select("grp", "e.q", "e.first", "e.n")
        # Written down level by level: the plan of all levels in one would fill the driver.
        nodes = durable(nodes if groups == 1 else nodes.repartition(NODE_TASKS, "first", "grp"))
    pairs = nodes.join(held.select("grp", F.col("s.skey").alias("skeys")), "grp")
    pairs = pairs.select(F.col("first").alias("shard"), F.explode(F.arrays_zip(F.col("skeys").alias("skey"), F.col("q").alias("blocks"))).alias("p"))
    return durable(pairs.select("p.skey", "shard", "p.blocks"))


def mix(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, shards, text_key.

    copies: how often the mix takes the row; taken: copies times size; shards: the output shard of each
    copy; text_key: a hash of the text, with which mixed() finds the row again.

    A null text has no words; null is a source of its own, the last; sources without words have target 0;
    repeated rows and ties in the hash order are told apart by nothing that shows, so reruns agree; an
    empty table gives no rows; extra columns are not read.
    """
    skey = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))  # in order of code points, null last
    rows = docs.select(F.col(id_col).alias("doc_id"), skey.alias("skey"), words(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "text_key"))
    rows = durable(rows.withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int")))

    plan = targets(rows.groupBy("skey").agg(F.sum("size").alias("source_size")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = durable(plan.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))))
    few = plan.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)

    inside = Window.partitionBy("skey", "bucket")
    numbered = rows.withColumn("rn", F.row_number().over(inside.orderBy("place", "doc_id", "size", "text_key"))).drop("place")
    state = numbered.join(small(plan.drop("rest")), "skey").withColumn("extra", F.lit(0))
    # Rows of the rest's pass, in the permuted order: of those that the gap still holds, the ones whose running sum fits.
    gaps = plan.select("skey", F.col("rest").alias("gap"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(FILLS + REPEATS):
        if k and gaps.where("gap >= 1").isEmpty():
            break
        free = F.col("extra") == 0 if k < FILLS else F.col("passes") + F.col("extra") < MOST_PASSES
        open_ = free & (F.col("size") <= F.col("gap")) & (F.col("gap") > 0) & ((F.col("size") > 0) | F.lit(k == 0))
        now = state.join(small(gaps), "skey").withColumn("open", open_).withColumn("step", F.when(F.col("open"), F.col("size")).otherwise(0))
        sums = now.groupBy("skey", "bucket").agg(F.sum("step").alias("n"))
        starts = sums.select("skey", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        now = now.withColumn("upto", F.sum("step").over(upto)).join(starts, ["skey", "bucket"])
        fits = F.col("open") & (F.col("start") + F.col("upto") <= F.col("gap"))
        state = durable(now.withColumn("extra", F.col("extra") + fits.cast("int")).select(*state.columns))
        used = state.groupBy("skey").agg(F.sum(F.col("size") * F.col("extra")).alias("used"))
        gaps = durable(plan.join(used, "skey").select("skey", (F.col("rest") - F.col("used")).alias("gap")))
    # Then the row whose size is nearest to what is left, if it brings the source nearer.
    off = F.abs(F.col("size") - F.col("gap"))
    near = state.join(small(gaps.where("gap >= 1")), "skey").where((F.col("passes") + F.col("extra") < MOST_PASSES) & (F.col("size") > 0) & (off < F.col("gap")))
    fill = near.groupBy("skey").agg(F.min(F.struct(off.alias("off"), "extra", "bucket", "rn")).alias("f")).select("skey", "f.bucket", "f.rn", F.lit(1).alias("fill"))
    taken = state.join(small(fill), ["skey", "bucket", "rn"], "left")
    taken = taken.withColumn("copies", F.col("passes") + F.col("extra") + F.coalesce("fill", F.lit(0)))
    taken = durable(taken.select("doc_id", "size", "text_key", "skey", "bucket", "source_size", "target", "passes", "copies"))

    blocks = taken.groupBy("skey", "bucket", "passes").agg(F.max("copies").alias("n")).where("n > 0").select("skey", "bucket", F.explode(F.sequence(F.lit(1), "n")).alias("pass"))
    tree = splitting_tree(blocks.groupBy("skey").agg(F.count("*").alias("quota")), shards, seed)
    ends = tree.groupBy("skey").agg(F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("s"))
    ends = ends.select("skey", F.expr("aggregate(s.blocks, cast(array(0L) as array<bigint>), (a, x) -> concat(a, array(element_at(a, -1) + x)))").alias("ends"))
    turn = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 1), "skey", "bucket", "pass"), "bucket", "pass")
    dealt = blocks.withColumn("turn", F.row_number().over(turn) - 1).join(small(ends), "skey")
    dealt = dealt.select("skey", "bucket", "pass", F.expr("int(size(filter(ends, e -> e <= turn)) - 1)").alias("shard"))
    of = dealt.groupBy("skey", "bucket").agg(F.expr("transform(sort_array(collect_list(struct(pass, shard))), x -> x.shard)").alias("all"))
    out = taken.join(of, ["skey", "bucket"], "left")
    mine = F.when(F.col("copies") > 0, F.slice("all", F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", mine.alias("shards"), "text_key")


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, by shard, and shuffled within; same columns.

    shard_col: a column for the shard that the tree dealt the copy to. Without it the shards are runs of the
    rows of a partition. Rows with the same id and text are told apart by their other columns, in order;
    nulls, empty and long texts and extra columns, whatever their names, are as in mix().
    """
    plan = mix(docs, shards, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col)
    key, place, copy, shard, turn, part = (unused(f"__{c}", docs) for c in ("key", "n", "copy", "shard", "turn", "part"))
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    left = docs.withColumn(key, hashed).withColumn(place, F.row_number().over(Window.partitionBy(id_col, key).orderBy(*total_order(docs))))
    there = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("copies", "shards"))
    right = plan.withColumn("there", there).where(F.size("shards") > 0).alias("plan")
    left = left.alias("rows")
    same = F.col(f"rows.{id_col}").eqNullSafe(F.col("plan.doc_id")) & (F.col(f"rows.{key}") == F.col("plan.text_key")) & (F.col(f"rows.{place}") == F.col("plan.there"))
    rows = left.join(right, same).select("rows.*", F.posexplode("plan.shards").alias(copy, shard))
    rows = rows.withColumn(turn, F.xxhash64(F.lit(seed + 2), key, copy)).withColumn(part, F.pmod(turn, F.lit(PARTS)))
    dealt = rows.repartition(shard, part).sortWithinPartitions(shard, part, turn)
    return dealt.select(*(f"`{c}`" for c in docs.columns), *([] if shard_col is None else [F.col(shard).alias(shard_col)]))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", F.array_join("shards", ",").alias("shards"))
