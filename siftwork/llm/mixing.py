"""Mixing sources to target weights, with DataFrame functions only.

A source's weight is its token share to the power of an exponent, normalised. The exponent is
searched between 0 (all sources alike) and 1 (as they are) for a target entropy or a repetition
limit. Weights become token budgets: whole epochs of a source, and a part of one more.

Each epoch deals a source's documents to blocks by a hash of their own, which is its permutation.
The part of an epoch ends at a place of that order found by block sums, twice, and then by
documents of one small block, so that a source of any size is neither sorted nor gathered. What
a document needs to know is one row of its source: epochs and the place where the last one ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.session import cut, table

WIDTH = 4096
#: A plan is broadcast up to this size.
PLAN_BYTES = 16_000_000
#: Production setting: close this part of the gap between the entropy of the sources and its maximum,
#: but let no source come up more often than MAX_REPEATS.
GAIN, MAX_REPEATS = 0.5, 4.0


def word_count(text: Column) -> Column:
    """Runs of characters outside \\x20 and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Never null, and apart from every text where the source is null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def _place(id_: Column, epoch: Column, seed: int) -> Column:
    """A document's place in the permutation of an epoch."""
    return F.xxhash64(id_, epoch.cast("long"), F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))


def _block(place: Column, level: int) -> Column:
    """Upper 12 bits for level 1, the next 12 for level 2."""
    return F.shiftright(place, 62 - 12 * level).bitwiseAND(F.lit(WIDTH - 1)).cast("int")


def _with_plan(rows: DataFrame, plan: DataFrame, key: Column, id_: Column) -> DataFrame:
    """rows with the plan's row of their source. plan: a checkpoint, so that its size is known at once.

    A plan of PLAN_BYTES at most is broadcast, and the rows stay where they are. Beyond it, as a source
    may hold a third of all rows, they are dealt over as many salts as there are shuffle partitions,
    and a source's one row of the plan is repeated for each.
    """
    joined = rows.withColumn("__key", key)
    if (plan.agg(F.sum(F.octet_length("__skey") + 100)).first()[0] or 0) <= PLAN_BYTES:
        return joined.join(F.broadcast(plan), F.col("__key") == F.col("__skey")).drop("__key")
    salts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copies = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = joined.withColumn("__own", F.pmod(F.xxhash64(id_, F.lit(11)), F.lit(salts)).cast("int"))
    return dealt.join(copies, (F.col("__key") == F.col("__skey")) & (F.col("__own") == F.col("__salt"))).drop("__key", "__own", "__salt")


def find_exponent(sizes: DataFrame, entropy: float | None, max_repeats: float | None, budget: float, rounds: int = 6, sections: int = 32) -> float:
    """The largest exponent in [0, 1] that reaches the entropy (nats), or the smallest that keeps to max_repeats.

    sizes: (tokens) of each source. Each round cuts the interval into sections at once: one
    aggregate over the sources, of which the driver sees a row a section. An entropy out of
    reach gives 0 or 1; so does a limit.
    """
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    low, high = 0.0, 1.0
    share = sizes.filter("tokens > 0").select((F.col("tokens") / F.lit(float(total or 1))).alias("p"))
    for _ in range(rounds):
        step = (high - low) / sections
        grid = F.array(*[F.lit(low + step * i) for i in range(sections + 1)])
        powered = share.select("p", F.posexplode(grid).alias("i", "x")).select("i", "x", "p", F.pow("p", "x").alias("q"))
        rows = (
            powered.groupBy("i", "x")
            .agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("p")).alias("l"), F.max(F.col("q") / F.col("p")).alias("most"))
            .orderBy("i")
            .collect()
        )
        if entropy is not None:
            fine = [r.i for r in rows if math.log(r.z) - r.x * r.l / r.z >= entropy]
            at = max(fine, default=0)
            low, high = low + step * at, low + step * min(at + 1, sections)
        else:
            fine = [r.i for r in rows if r.most / r.z * budget / total <= max_repeats * (1 + 1e-12)]
            at = min(fine, default=sections)
            low, high = low + step * max(at - 1, 0), low + step * at
        if low == high:
            break
    return low if entropy is not None else high


def mixing_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float | None = None,
    gain: float = GAIN, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, seed: int = 29,
) -> tuple[DataFrame, DataFrame]:
    """(counted documents, one row a source): see mix."""
    counted = cut(docs.select(F.col(id_col).alias("id"), _key(F.col(source_col)).alias("skey"), word_count(F.col(text_col)).alias("tokens")))
    sizes = cut(counted.groupBy("skey").agg(F.sum("tokens").alias("tokens")))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    x = 1.0
    if total:
        if entropy is None:
            part = F.col("tokens") / F.lit(float(total))
            now, n = sizes.filter("tokens > 0").agg(F.sum(-part * F.log(part)), F.count(F.lit(1))).first()
            entropy = now + gain * (math.log(n) - now)
        x = find_exponent(sizes, entropy, None, float(budget))
        if max_repeats is not None:
            x = max(x, find_exponent(sizes, None, max_repeats, float(budget)))
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(x))).otherwise(F.lit(0.0))
    z = sizes.agg(F.sum(power)).first()[0] or 1.0
    goal = sizes.select("skey", "tokens", (power / F.lit(z)).alias("weight")).withColumn(
        "budget", F.round(F.col("weight") * F.lit(float(budget))).cast("long")
    )
    empty = F.col("tokens") == 0  # such a source costs nothing and comes back once
    goal = cut(
        goal.withColumn("epochs", F.when(empty, 1).otherwise(F.floor(F.col("budget") / F.when(~empty, F.col("tokens")))).cast("long"))
        .withColumn("rest", F.when(empty, 0).otherwise(F.col("budget") - F.col("epochs") * F.col("tokens")).cast("long"))
    )
    partly = goal.filter("rest > 0").select(F.col("skey").alias("__skey"), "epochs", "rest")
    last = _with_plan(counted, partly, F.col("skey"), F.col("id")).withColumn("place", _place(F.col("id"), F.col("epochs"), seed))
    last = last.select("skey", "tokens", "rest", "place")
    for level in (1, 2):
        blocks = last.withColumn("block", _block(F.col("place"), level))
        sums = blocks.groupBy("skey", "rest", "block").agg(F.sum("tokens").alias("t"))
        before = F.sum("t").over(Window.partitionBy("skey").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")
        stop = cut(
            sums.withColumn("before", before)
            .filter("before < rest AND before + t >= rest")
            .select("skey", "block", (F.col("rest") - F.col("before")).alias("left"))
        )
        last = blocks.join(stop, ["skey", "block"]).select("skey", "tokens", F.col("left").alias("rest"), "place")
    upto = F.sum("t").over(Window.partitionBy("skey").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")
    ends = (
        last.groupBy("skey", "rest", "place").agg(F.sum("tokens").alias("t")).withColumn("before", upto)
        .filter("before < rest").groupBy("skey").agg(F.max("place").alias("end"))
    )
    plan = cut(goal.join(ends, "skey", "left").select("skey", "weight", "budget", "epochs", F.coalesce("end", F.lit(-1)).alias("end")))
    return counted, plan


def _draws(rows: DataFrame, plan: DataFrame, key: Column, id_: Column, seed: int) -> DataFrame:
    """rows once for each use: whole epochs, and one more for those up to the end of the last."""
    planned = plan.select(F.col("skey").alias("__skey"), F.col("weight").alias("__weight"), F.col("epochs").alias("__epochs"), F.col("end").alias("__end"))
    uses = F.col("__epochs") + (_place(id_, F.col("__epochs"), seed) <= F.col("__end")).cast("long")
    return (
        _with_plan(rows, planned, key, id_)
        .withColumn("__uses", uses)
        .filter("__uses > 0")
        .withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__uses") - 1)))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 29, **target) -> DataFrame:
    """Rows of docs, each as often as its source's budget says; the columns of docs alone.

    Tokens are words. The budget is that of all documents unless given. The exponent is the largest
    that reaches `entropy` (nats; by default `gain` of the gap to its maximum), raised as far as
    `max_repeats` asks for. A source's last epoch ends with the first
    document that fills the budget. A null source is a source. Documents without words cost
    nothing and come in every whole epoch; if a source or the whole table has none but those,
    each comes back once. Rows that repeat an id are apart but share a place. A null id is an id.
    """
    _, plan = mixing_plan(docs, id_col, text_col, source_col, seed=seed, **target)
    return _draws(docs, plan, _key(F.col(source_col)), F.col(id_col), seed).select(*docs.columns)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document: its epoch, and its block and place in that epoch's permutation."""
    seed = 29
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted, plan = mixing_plan(docs, seed=seed)
    place = _place(F.col("id"), F.col("__epoch"), seed)
    source = F.when(F.col("skey") != "-", F.expr("substr(skey, 2)"))
    return _draws(counted, plan, F.col("skey"), F.col("id"), seed).select(
        F.col("id").alias("doc_id"), source.alias("source"), F.col("tokens").alias("n_tokens"), F.col("__weight").alias("weight"),
        F.col("__epoch").alias("epoch"), _block(place, 1).alias("block"), place.alias("place"),
    )
