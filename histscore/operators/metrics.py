"""M1-M6 metrics and A14-A16 run summaries, as aggregate queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histscore.functions.scalar import softplus
from histscore.operators.ordering import running_totals


def auc(
    df: DataFrame,
    score: str = "prediction",
    label: str = "target",
    by: Sequence[str] = (),
    name: str = "auc",
    ranges: int | None = None,
    counts: bool = False,
) -> DataFrame:
    """M1/M2: exact ROC-AUC, a tie counting one half (Mann-Whitney).

    Rows collapse to one per distinct score first (partial aggregation, so a
    hot score costs nothing); the negatives below each score come from the
    two-level running total, never from a global window. A null or NaN score
    or a null label fails the job.
    """
    by = list(by)
    bad = F.col(score).isNull() | F.isnan(F.col(score).cast("double")) | F.col(label).isNull()
    refused = F.raise_error(F.lit("AUC needs a finite score and a label in every row"))
    df = df.withColumn(label, F.when(bad, refused.cast(df.schema[label].dataType)).otherwise(F.col(label)))
    per_score = df.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("long").alias("_neg"),
    )
    ranked = running_totals(per_score, [score], ["_neg"], by, ranges=ranges, prefix="_below")
    extra = (
        [F.sum("_pos").cast("long").alias("n_pos"), F.sum("_neg").cast("long").alias("n_neg")]
        if counts
        else []
    )
    return ranked.groupBy(*by).agg(
        F.try_divide(
            F.sum(F.col("_pos") * (F.col("_below_neg") + F.col("_neg") / 2.0)),
            F.sum("_pos").cast("double") * F.sum("_neg").cast("double"),
        ).alias(name),
        *extra,
    )


def weighted_bce(
    df: DataFrame,
    margin: str,
    label: str,
    pos_weight: float = 4.0,
    by: Sequence[str] = (),
    name: str = "bce",
) -> DataFrame:
    """M3: mean of w*y*softplus(-x) + (1-y)*softplus(x) over rows."""
    y = F.col(label).cast("double")
    loss = F.lit(pos_weight) * y * softplus(-F.col(margin)) + (1 - y) * softplus(
        F.col(margin)
    )
    return df.groupBy(*by).agg(F.avg(loss).alias(name))


PAIR_BLOCK = 1024


def pairwise_rank_loss(
    df: DataFrame,
    score: str,
    label: str,
    by: Sequence[str],
    name: str = "rank_loss",
    block: int = PAIR_BLOCK,
) -> DataFrame:
    """M4: mean softplus(-(p+ - p-)) over positive x negative pairs of each
    group, 0 when a class is absent. Scores of a class are dealt into blocks
    of about ``block``; blocks of positives meet blocks of negatives of their
    group and the pairs are folded inside one row, so a group of any size is
    shared among tasks and no list grows with it."""
    by = list(by)
    sides = df.select(*by, F.col(score).cast("double").alias("_s"), (F.col(label) == 1).alias("_is_pos"))
    sizes = sides.groupBy(*by, "_is_pos").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = sides.join(sizes, [*by, "_is_pos"]).withColumn("_b", F.pmod(F.xxhash64("_s"), F.col("_blocks")))
    # equal scores share a block; a value and its count stand for all of them
    counted = dealt.groupBy(*by, "_is_pos", "_b", "_s").agg(F.count(F.lit(1)).alias("_c"))
    lists = counted.groupBy(*by, "_is_pos", "_b").agg(F.collect_list(F.struct("_s", "_c")).alias("_l"))
    pos = lists.where("_is_pos").select(*by, F.col("_l").alias("_p"))
    neg = lists.where("not _is_pos").select(*by, F.col("_l").alias("_n"))
    loss = F.aggregate(
        "_p",
        F.lit(0.0),
        lambda acc, p: acc
        + F.aggregate(
            "_n",
            F.lit(0.0),
            lambda inner, n: inner + softplus(n["_s"] - p["_s"]) * (n["_c"] * p["_c"]),
        ),
    )
    count = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x["_c"])
    folded = pos.join(neg, by).select(*by, loss.alias("_loss"), (count("_p") * count("_n")).alias("_pairs"))
    per_group = folded.groupBy(*by).agg((F.sum("_loss") / F.sum("_pairs")).alias(name))
    groups = sides.select(*by).distinct()
    return groups.join(per_group, by, "left").select(*by, F.coalesce(name, F.lit(0.0)).alias(name))


def correlation(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M6: Pearson correlation for each pair of prediction columns."""
    columns = list(columns)
    exprs = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            exprs.append(F.corr(a, b).alias(f"{a}__{b}"))
    return wide.agg(*exprs)


def best_epoch(runs: DataFrame, metric: str = "auc", epoch: str = "epoch", by=()) -> DataFrame:
    """Epoch with the highest metric, the earliest on a tie."""
    key = F.struct(-F.col(metric), F.col(epoch))
    return runs.groupBy(*by).agg(
        F.min_by(epoch, key).alias("best_epoch"), F.max(metric).alias(f"best_{metric}")
    )


def early_stop_epoch(
    runs: DataFrame, patience: int, metric: str = "auc", epoch: str = "epoch", by=()
) -> DataFrame:
    """First epoch after ``patience`` epochs without a strict
    improvement of the running best (null when training runs out first)."""
    w = Window.partitionBy(*by).orderBy(epoch)
    prior_best = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = runs.withColumn(
        "_improved", F.when(prior_best.isNull() | (F.col(metric) > prior_best), 1).otherwise(0)
    )
    last_improved = F.max(F.when(F.col("_improved") == 1, F.col(epoch))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    stale = flagged.withColumn("_stale", F.col(epoch) - last_improved)
    return stale.groupBy(*by).agg(
        F.min(F.when(F.col("_stale") >= patience, F.col(epoch))).alias("stop_epoch")
    )


def epoch_loss(batches: DataFrame, loss: str, weight: str, epoch: str = "epoch") -> DataFrame:
    """Example-weighted mean of per-batch losses, per epoch."""
    return batches.groupBy(epoch).agg(
        (F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)).alias("epoch_loss")
    )


def running_loss(
    batches: DataFrame, loss: str, weight: str, order_cols: Sequence[str], epoch: str = "epoch", name: str = "running_loss"
) -> DataFrame:
    """A16, running form: at each batch the example-weighted mean loss of its
    epoch so far, in ``order_cols`` order (a total order in an epoch)."""
    parts = batches.withColumn("_lw", F.col(loss).cast("double") * F.col(weight))
    before = running_totals(parts, order_cols, ["_lw", weight], [epoch])
    ratio = (F.col("before__lw") + F.col("_lw")) / (F.col(f"before_{weight}") + F.col(weight))
    return before.select(*batches.columns, ratio.alias(name))
