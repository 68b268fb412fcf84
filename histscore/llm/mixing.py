"""Mixing sources to target weights.

Words are summed per source, every source gets a target, and a document is
taken ``floor(rate)`` times plus one hash-seeded Bernoulli copy with the
probability of the fraction, ``rate = target / source size``.

Targets: sources in code-point order (null last) weigh ``weights`` in turn
and share all words; no target exceeds ``max_rate`` times its source's size,
and what is above is shared again by weight until none is.

Defined cases: null text counts 0 words; a null source is a source of its
own; sources without words get target 0; null and repeated ids are ordinary
rows (equal rows draw alike); an empty table gives an empty result; other
columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histscore.llm.common import join_checked, word_count
from histscore.session import checkpointed

WEIGHTS = (1, 2, 3)
MAX_RATE = 3
#: Seeds tried per source; the one whose mix comes nearest to the target wins.
SEEDS = 16


def draw_key() -> Column:
    """One md5 per document; each seed hashes it again."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit(""))))


def draw(key: Column, seed: Column) -> Column:
    """A number in [0, 1) from 52 bits of md5(key, seed)."""
    digits = F.substring(F.md5(F.concat(key, seed.cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(rate: Column, key: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_rate: int) -> DataFrame:
    """(source, source_size) -> with target, rate. The sources are numbered
    by a sort over all tasks; every round of resharing is one aggregate."""
    spark = sizes.sparkSession
    schema = T.StructType([*sizes.schema.fields, T.StructField("weight", T.LongType())])
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    turn = tuple(weights)
    table = checkpointed(
        spark.createDataFrame(ordered.map(lambda x: (*x[0], turn[x[1] % len(turn)])), schema)
    )
    cap = F.col("source_size") * max_rate
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, held = None, -1
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        n, used, weight = table.agg(
            F.count_if(above), F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        if n == held or not weight:
            break
        level, held = float(total - used) / float(weight), n
    share = F.lit(level if level is not None else 0.0) * F.col("weight")
    target = F.when(share > cap, cap.cast("double")).otherwise(share)
    return table.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def mixing_plan(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seeds: int = SEEDS
) -> DataFrame:
    """One row per source: source, source_size, target, rate, seed.

    ``sized`` has source, size, key. Sums are pre-aggregated before the
    shuffle, so a source with a third of all rows is one row per task."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_rate)
    with_rate = _with_plan(sized, targets)
    tried = with_rate.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    tried = tried.groupBy("source", "try").agg(
        F.sum(F.col("size") * copies(F.col("rate"), F.col("key"), F.col("try"))).alias("taken"),
        F.first("target").alias("target"),
    )
    off = F.struct(F.abs(F.col("taken") - F.col("target")).alias("off"), F.col("try").alias("seed"))
    near = tried.groupBy(F.col("source").alias("__near_source")).agg(F.min(off)["seed"].alias("seed"))
    best = targets.join(near, F.col("source").eqNullSafe(F.col("__near_source"))).drop("__near_source")
    return checkpointed(best)


def _with_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """``df`` with the plan's columns by source (inner: every source has one)."""
    p = plan.withColumnRenamed("source", "__plan_source")
    on = F.col("source").eqNullSafe(F.col("__plan_source"))
    return join_checked(df, p, on, "inner", F.coalesce(F.octet_length("__plan_source"), F.lit(0)) + 64).drop("__plan_source")


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key, written once: later passes leave the texts."""
    return checkpointed(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw_key().alias("key"))
    )


def mix_counts(docs: DataFrame, **params) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken."""
    sized = sized_documents(docs)
    picked = _with_plan(sized, mixing_plan(sized, **params))
    n = copies(F.col("rate"), F.col("key"), F.col("seed"))
    return picked.select(
        "doc_id", "source", "size", "source_size", "target", n.alias("copies"), (F.col("size") * n).alias("taken")
    )


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mixed documents themselves: every row as often as it is taken,
    with the columns of ``docs``. Texts are read, never shuffled, while the
    plan is small enough to broadcast."""
    plan = mixing_plan(sized_documents(docs), **params).select(
        F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"), F.col("seed").alias("__mix_seed")
    )
    on = F.col("source").eqNullSafe(F.col("__mix_source"))
    joined = join_checked(docs, plan, on, "inner", F.coalesce(F.octet_length("__mix_source"), F.lit(0)) + 32)
    n = copies(F.col("__mix_rate"), draw_key(), F.col("__mix_seed"))
    again = joined.withColumn("__mix_copy", F.explode(F.when(n > 0, F.array_repeat(F.lit(1), n.cast("int")))))
    return again.select(*docs.columns)
