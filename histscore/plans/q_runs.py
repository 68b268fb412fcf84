"""Fold, split and run-summary queries: P3/A10, S4, S15, A13-A16, H15."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from histscore.functions.scalar import fold, softplus
from histscore.operators import history as H
from histscore.operators import metrics as M
from histscore.operators import split as SP
from histscore.operators.ordering import stored
from histscore.plans import bindings as B
from histscore.plans import q_seq
from histscore.plans.oracle_ctes import with_roles
from histscore.plans.registry import register
from histscore.plans.sqlkit import auc_sql
from histscore.session import scratch_path
from histscore.sources.sinks import write_json_row

FOLD_SQL = "((id % 10) + 10) % 10"
PARTS = 8
CURVE_EPOCHS = 12
PATIENCE = 3


@register(
    "temporal_fold",
    with_roles(
        ["target_dense"],
        """SELECT b.border, count(*) AS n_temporal, CAST(sum(t.flag) AS BIGINT) AS n_pos
           FROM target_dense t, (SELECT quantile_cont(id, 0.9) AS border FROM target_dense) b
           WHERE t.id >= b.border GROUP BY b.border""",
    ),
)
def q_temporal_fold(spark, sf_dir):
    rows, border = SP.temporal_fold(B.target_dense(spark, sf_dir), 0.9)
    return rows.agg(
        F.lit(float(border)).alias("border"),
        F.count(F.lit(1)).alias("n_temporal"),
        F.sum("flag").cast("long").alias("n_pos"),
    )


@register(
    "partition_mod",
    with_roles(
        ["history_b"],
        f"""SELECT CAST(((id % {PARTS}) + {PARTS}) % {PARTS} AS INTEGER) AS part, count(*) AS n_rows,
                   count(DISTINCT id) AS n_ids
            FROM history_b GROUP BY 1""",
    ),
)
def q_partition_mod(spark, sf_dir):
    path = scratch_path(spark, f"partition_mod/{uuid.uuid4().hex}")
    SP.partition_by_mod(B.history_b(spark, sf_dir), PARTS, path)
    parts = spark.read.parquet(path)
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids")
    )


@register(
    "union_splits",
    with_roles(
        ["history_b"],
        f"""SELECT CASE WHEN {FOLD_SQL} = 0 THEN 'test' ELSE 'train' END AS split,
                   count(*) AS n_rows, count(DISTINCT id) AS n_ids
            FROM history_b GROUP BY 1""",
    ),
)
def q_union_splits(spark, sf_dir):
    from histscore.sources.tables import union_splits

    h = B.history_b(spark, sf_dir)
    stacked = union_splits({"train": h.where(fold("id") != 0), "test": h.where(fold("id") == 0)})
    return stacked.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids")
    )


# ---------------------------------------------------------------- A13, S11
_SCORED_SQL = """(SELECT a.id, a.score, t.flag FROM (SELECT id, avg(state) AS score FROM history_b GROUP BY id) a
                  JOIN target_dense t USING (id))"""


@register(
    "run_summary",
    with_roles(
        ["history_b", "target_dense"],
        f"""SELECT (SELECT auc FROM aucs WHERE tag = 'random') AS random_auc,
                   (SELECT auc FROM aucs WHERE tag = 'temporal') AS temporal_auc,
                   (SELECT count(*) FROM scored WHERE {FOLD_SQL} <> 0) AS train_rows,
                   (SELECT count(*) FROM tagged WHERE tag = 'random') AS random_valid_rows,
                   (SELECT count(*) FROM tagged WHERE tag = 'temporal') AS temporal_valid_rows,
                   {len(B.HISTORY_B_NUMERIC) * 2 + 2} AS feature_count""",
        [
            ("scored", _SCORED_SQL[1:-1]),
            (
                "tagged",
                f"""SELECT 'random' AS tag, score, flag FROM scored WHERE {FOLD_SQL} = 0
                    UNION ALL
                    SELECT 'temporal', score, flag FROM scored
                    WHERE id >= (SELECT quantile_cont(id, 0.9) FROM scored)""",
            ),
            ("aucs", auc_sql("tagged", "score", "flag", ["tag"])),
        ],
    ),
)
def q_run_summary(spark, sf_dir):
    """The reference's metrics file as a one-row query (also written as
    JSON and read back, S11). The temporal rows include training rows (K22)."""
    feats = H.history_aggregate(B.history_b(spark, sf_dir), B.HISTORY_B_NUMERIC)
    scored = feats.join(B.target_dense(spark, sf_dir), "id").select(
        "id", F.col("state__mean").alias("score"), "flag"
    )
    temporal, border = SP.temporal_fold(scored, 0.9)
    tagged = scored.where(fold("id") == 0).withColumn("tag", F.lit("random")).unionByName(
        temporal.withColumn("tag", F.lit("temporal"))
    )
    aucs = M.auc(tagged, "score", "flag", by=["tag"], counts=True)
    train = scored.where(fold("id") != 0).select(F.lit("train").alias("tag"))
    parts = aucs.select("tag", "auc", (F.col("n_pos") + F.col("n_neg")).alias("rows")).unionByName(
        train.groupBy("tag").agg(F.lit(None).cast("double").alias("auc"), F.count(F.lit(1)).alias("rows"))
    )
    summary = parts.agg(
        F.max(F.when(F.col("tag") == "random", F.col("auc"))).alias("random_auc"),
        F.max(F.when(F.col("tag") == "temporal", F.col("auc"))).alias("temporal_auc"),
        F.max(F.when(F.col("tag") == "train", F.col("rows"))).alias("train_rows"),
        F.max(F.when(F.col("tag") == "random", F.col("rows"))).alias("random_valid_rows"),
        F.max(F.when(F.col("tag") == "temporal", F.col("rows"))).alias("temporal_valid_rows"),
        F.lit(len(feats.columns) - 1).alias("feature_count"),
    )
    path = scratch_path(spark, f"metrics/{uuid.uuid4().hex}")
    write_json_row(summary, path)
    return spark.read.schema(summary.schema).json(path)


# ---------------------------------------------------------------- A14, A15
def curve(spark, sf_dir):
    """Validation AUC of 'mean state over the last e rows' for e = 1..E: a
    per-epoch metric table derived from the data (truncation length plays
    the epoch)."""
    recent = H.last_n(B.history_b(spark, sf_dir), CURVE_EPOCHS)
    per_epoch = recent.select(
        "id", "state", F.explode(F.sequence(F.col("pos_desc"), F.lit(CURVE_EPOCHS))).alias("epoch")
    )
    scores = per_epoch.groupBy("id", "epoch").agg(F.avg("state").alias("score"))
    valid = B.target_dense(spark, sf_dir).where(fold("id") == 0)
    return M.auc(scores.join(valid, "id"), "score", "flag", by=["epoch"])


_CURVE_SQL = auc_sql(
    f"""(SELECT e.epoch, s.id, s.flag, avg(s.state) AS score
         FROM (SELECT h.id, h.state, t.flag, row_number() OVER (PARTITION BY h.id ORDER BY h.rn DESC) AS pd
               FROM history_b h JOIN target_dense t ON t.id = h.id AND {FOLD_SQL.replace('id', 't.id')} = 0) s,
              (SELECT unnest(range(1, {CURVE_EPOCHS} + 1)) AS epoch) e
         WHERE s.pd <= e.epoch GROUP BY e.epoch, s.id, s.flag)""",
    "score",
    "flag",
    ["epoch"],
)


@register(
    "best_epoch",
    with_roles(
        ["history_b", "target_dense"],
        """SELECT (SELECT epoch FROM runs ORDER BY auc DESC, epoch LIMIT 1) AS best_epoch,
                  (SELECT max(auc) FROM runs) AS best_auc""",
        [("runs", _CURVE_SQL)],
    ),
)
def q_best_epoch(spark, sf_dir):
    return M.best_epoch(curve(spark, sf_dir)).select(
        F.col("best_epoch").cast("long").alias("best_epoch"), "best_auc"
    )


@register(
    "early_stop",
    with_roles(
        ["history_b", "target_dense"],
        f"""SELECT min(CASE WHEN epoch - last_improved >= {PATIENCE} THEN epoch END) AS stop_epoch
            FROM (SELECT epoch, max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_improved
                  FROM (SELECT epoch, auc, (prior IS NULL OR auc > prior) AS improved
                        FROM (SELECT epoch, auc, max(auc) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING
                                                                AND 1 PRECEDING) AS prior FROM runs)))""",
        [("runs", _CURVE_SQL)],
    ),
)
def q_early_stop(spark, sf_dir):
    out = M.early_stop_epoch(curve(spark, sf_dir), PATIENCE)
    return out.select(F.col("stop_epoch").cast("long").alias("stop_epoch"))


# ---------------------------------------------------------------- A16
_MARGIN_SQL = "((s.discount - 5.0) / 2.0)"


@register(
    "epoch_loss",
    with_roles(
        ["history_b", "target_dense", "customer_scores"],
        f"""SELECT epoch, round(sum(loss * n) / sum(n), 6) AS epoch_loss
            FROM (SELECT p.epoch, p.batch_key, count(*) AS n,
                         avg(4.0 * t.flag * (greatest(-{_MARGIN_SQL}, 0) + ln(1 + exp(-abs({_MARGIN_SQL}))))
                             + (1 - t.flag) * (greatest({_MARGIN_SQL}, 0) + ln(1 + exp(-abs({_MARGIN_SQL})))))
                             AS loss
                  FROM plan p JOIN customer_scores s USING (id) JOIN target_dense t USING (id)
                  GROUP BY p.epoch, p.shard, p.batch_key)
            GROUP BY epoch""",
        [q_seq.TRAIN_IDS, ("plan", q_seq._PLAN_SQL)],
    ),
)
def q_epoch_loss(spark, sf_dir):
    out = M.epoch_loss(batch_losses(spark, sf_dir), "loss", "n")
    return out.select(F.col("epoch").cast("long").alias("epoch"), F.round("epoch_loss", 6).alias("epoch_loss"))


def batch_losses(spark, sf_dir):
    """epoch, shard, batch_key, loss, n of every batch of the plan."""
    scores = B.customer_scores(spark, sf_dir).select("id", ((F.col("discount") - 5.0) / 2.0).alias("margin"))
    rows = q_seq.plan(spark, sf_dir).join(scores, "id").join(B.target_dense(spark, sf_dir), "id")
    y = F.col("flag").cast("double")
    loss = 4.0 * y * softplus(-F.col("margin")) + (1 - y) * softplus("margin")
    return rows.groupBy("epoch", "shard", "batch_key").agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


@register(
    "epoch_loss_running",
    with_roles(
        ["history_b", "target_dense", "customer_scores"],
        f"""SELECT epoch, shard, batch_key, round(sum(loss * n) OVER w / sum(n) OVER w, 6) AS running_loss,
                   round(sum(loss * n) OVER (PARTITION BY epoch) / sum(n) OVER (PARTITION BY epoch), 6) AS final_loss
            FROM (SELECT p.epoch, p.shard, p.batch_key, count(*) AS n,
                         avg(4.0 * t.flag * (greatest(-{_MARGIN_SQL}, 0) + ln(1 + exp(-abs({_MARGIN_SQL}))))
                             + (1 - t.flag) * (greatest({_MARGIN_SQL}, 0) + ln(1 + exp(-abs({_MARGIN_SQL})))))
                             AS loss
                  FROM plan p JOIN customer_scores s USING (id) JOIN target_dense t USING (id)
                  GROUP BY p.epoch, p.shard, p.batch_key)
            WINDOW w AS (PARTITION BY epoch ORDER BY shard, batch_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        [q_seq.TRAIN_IDS, ("plan", q_seq._PLAN_SQL)],
    ),
)
def q_epoch_loss_running(spark, sf_dir):
    """The loss as it runs through each epoch, and where it ends."""
    batches = stored(batch_losses(spark, sf_dir))
    final = M.epoch_loss(batches, "loss", "n").select("epoch", F.round("epoch_loss", 6).alias("final_loss"))
    out = M.running_loss(batches, "loss", "n", ["shard", "batch_key"]).join(final, "epoch")
    return out.select(
        F.col("epoch").cast("long").alias("epoch"), F.col("shard").cast("long").alias("shard"), "batch_key",
        F.round("running_loss", 6).alias("running_loss"), "final_loss",
    )


# ---------------------------------------------------------------- H15
AB_PARTS = 4


@register(
    "ab_by_part",
    with_roles(
        ["history_b", "target_dense"],
        f"""SELECT a.part, a.auc_a, b.auc_b
            FROM ({auc_sql('s', 'score_a', 'flag', ['part'], 'auc_a')}) a
            JOIN ({auc_sql('(SELECT * FROM s WHERE score_b IS NOT NULL)', 'score_b', 'flag', ['part'], 'auc_b')}) b
            USING (part)""",
        [
            (
                "s",
                f"""SELECT h.id, CAST(((h.id % {AB_PARTS}) + {AB_PARTS}) % {AB_PARTS} AS INTEGER) AS part,
                           avg(h.state) AS score_a,
                           count(*) - max(CASE WHEN h.overdue > 0 THEN h.rn END) AS score_b, t.flag
                    FROM history_b h JOIN target_dense t USING (id) GROUP BY h.id, t.flag""",
            )
        ],
    ),
)
def q_ab_by_part(spark, sf_dir):
    """H15 on every part at once: AUC of two feature scores per id-mod part,
    so the comparison covers the whole table."""
    h = B.history_b(spark, sf_dir)
    a = H.history_aggregate(h, ["state"]).select("id", F.col("state__mean").alias("score_a"))
    b = H.since_last_flag(h, "overdue").select("id", F.col("since_overdue").alias("score_b"))
    s = a.join(b, "id").join(B.target_dense(spark, sf_dir), "id").withColumn(
        "part", F.pmod("id", F.lit(AB_PARTS)).cast("int")
    )
    auc_a = M.auc(s, "score_a", "flag", by=["part"], name="auc_a")
    auc_b = M.auc(s.where(F.col("score_b").isNotNull()), "score_b", "flag", by=["part"], name="auc_b")
    return auc_a.join(auc_b, "part")
