"""Queries over prediction sets: W3, M1-M6, B1-B7, J6/S8, C1-C7, P14, S12."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from histscore.functions.scalar import compact_decimal_text, fold, mix_hash, sigmoid, weighted_sum
from histscore.operators import blend as BL
from histscore.operators import checks as C
from histscore.operators import metrics as M
from histscore.operators import sequences as S
from histscore.operators.history import history_aggregate
from histscore.operators.ordering import global_row_number, rank_percentile, stored
from histscore.plans import bindings as B
from histscore.plans import q_axis
from histscore.plans.oracle_ctes import with_roles
from histscore.plans.registry import register
from histscore.plans.sqlhash import mix_hash_sql
from histscore.plans.sqlkit import auc_sql, dbl, weighted_sql
from histscore.session import scratch_path
from histscore.sources.sinks import read_in_file_order, write_compact_csv

MODELS = B.PRED_MODELS
# Stand-in blend weights for the four score columns (B1).
BLEND_WEIGHTS = {"discount": 0.2, "overdue_rate": 0.3, "max_qty": 0.1, "n_lines": 0.4}
# The reference's five-part stack weights, in their order,
# applied to "current" (raw) and the four ranked stand-in models.
STACK_WEIGHTS = [0.249725, 0.102310, 0.342734, 0.266927, 0.038304]
# Conservative mixing ratios.
MIX_RATIOS = [0.50, 0.60, 0.70, 0.80, 0.90]
# Positive-class weight of the log loss; weight grid of the
# two-model search (start, stop, points).
POS_WEIGHT = 4.0
GRID = (0.5, 1.0, 11)
RANK_LOSS_WEIGHT = 0.5

RANKS_CTE = (
    "ranks",
    """SELECT model, split, id, target, prediction, ord,
              (row_number() OVER (PARTITION BY model, split ORDER BY prediction, ord) - 1)
              / greatest(count(*) OVER (PARTITION BY model, split) - 1, 1) AS rank_pct
       FROM preds""",
)


def _wide_cte(split: str, name: str):
    cols = ", ".join(
        f"max(CASE WHEN model = '{m}' THEN rank_pct END) AS {m}" for m in MODELS
    )
    return (
        name,
        f"SELECT id, target, {cols} FROM ranks WHERE split = '{split}' GROUP BY id, target",
    )


VWIDE = _wide_cte("valid", "vwide")
TWIDE = _wide_cte("test", "twide")
BLEND_SQL = weighted_sql([(w, m) for m, w in BLEND_WEIGHTS.items()])
STACK_SQL = weighted_sql(list(zip(STACK_WEIGHTS, ["blend", *MODELS])))


def ranks(spark, sf_dir, split=None, models=None):
    """Ranks per (model, split); only the wanted rows are ever ranked."""
    preds = B.preds(spark, sf_dir)
    if split is not None:
        preds = preds.where(F.col("split") == split)
    if models is not None:
        preds = preds.where(F.col("model").isin(list(models)))
    return BL.model_ranks(preds, tiebreak="ord", group_cols=["model", "split"])


def wide(spark, sf_dir, split="valid", models=MODELS):
    return BL.align(ranks(spark, sf_dir, split, models), models, "rank_pct")


def stacked(spark, sf_dir, split="valid"):
    w = BL.blend(wide(spark, sf_dir, split), BLEND_WEIGHTS, "blend")
    parts = dict(zip(["blend", *MODELS], STACK_WEIGHTS))
    return BL.blend(w, parts, "stack")


# ---------------------------------------------------------------- W3
@register(
    "rank_pct",
    with_roles(["preds"], "SELECT model, split, id, rank_pct FROM ranks", [RANKS_CTE]),
)
def q_rank_pct(spark, sf_dir):
    return ranks(spark, sf_dir).select("model", "split", "id", "rank_pct")


# ---------------------------------------------------------------- M1, M2
@register(
    "auc_exact",
    with_roles(
        ["preds"],
        auc_sql("(SELECT * FROM preds WHERE split = 'valid' AND model = 'n_lines')", "prediction", "target"),
    ),
)
def q_auc_exact(spark, sf_dir):
    p = B.preds(spark, sf_dir).where((F.col("split") == "valid") & (F.col("model") == "n_lines"))
    return M.auc(p, "prediction", "target")


@register(
    "auc_by_model",
    with_roles(
        ["preds"],
        auc_sql("(SELECT * FROM preds WHERE split = 'valid')", "prediction", "target", ["model"]),
    ),
)
def q_auc_by_model(spark, sf_dir):
    p = B.preds(spark, sf_dir).where(F.col("split") == "valid")
    return M.auc(p, "prediction", "target", by=["model"])


# ---------------------------------------------------------------- J6, S8
@register(
    "aligned_preds",
    with_roles(["preds"], "SELECT * FROM vwide", [RANKS_CTE, VWIDE]),
)
def q_aligned_preds(spark, sf_dir):
    long = B.preds(spark, sf_dir).withColumnRenamed("id", "ids").withColumnRenamed(
        "prediction", "predictions"
    )
    canonical = BL.canonical_prediction_columns(long)
    valid = canonical.where(F.col("split") == "valid")
    return BL.align(BL.model_ranks(valid, tiebreak="ord", group_cols=["model", "split"]), MODELS, "rank_pct")


# ---------------------------------------------------------------- B1, B6
@register(
    "blend_rank",
    with_roles(["preds"], f"SELECT id, target, {BLEND_SQL} AS blend FROM vwide", [RANKS_CTE, VWIDE]),
)
def q_blend_rank(spark, sf_dir):
    return BL.blend(wide(spark, sf_dir), BLEND_WEIGHTS, "blend").select("id", "target", "blend")


@register(
    "blend_auc",
    with_roles(
        ["preds"],
        auc_sql(f"(SELECT target, {BLEND_SQL} AS blend FROM vwide)", "blend", "target"),
        [RANKS_CTE, VWIDE],
    ),
)
def q_blend_auc(spark, sf_dir):
    return M.auc(BL.blend(wide(spark, sf_dir), BLEND_WEIGHTS, "blend"), "blend", "target")


# ---------------------------------------------------------------- B2, O4
_GRID_SRC = f"""(SELECT g.weight, v.target, g.weight * v.n_lines + (1.0 - g.weight) * v.overdue_rate AS s
                 FROM vwide v, (SELECT {dbl(0.5)} + CAST(i AS DOUBLE) * {dbl(0.05)} AS weight
                                FROM range(11) t(i)) g)"""


@register(
    "blend_grid",
    with_roles(
        ["preds"],
        f"""SELECT weight, auc, weight = (SELECT weight FROM grid ORDER BY auc DESC, weight LIMIT 1) AS is_best
            FROM grid""",
        [RANKS_CTE, VWIDE, ("grid", auc_sql(_GRID_SRC, "s", "target", ["weight"]))],
    ),
)
def q_blend_grid(spark, sf_dir):
    two = wide(spark, sf_dir, models=["n_lines", "overdue_rate"])
    grid = BL.two_model_grid(two, "n_lines", "overdue_rate", "target", *GRID)
    return BL.mark_best(grid)


# ---------------------------------------------------------------- B4, B5
@register(
    "stack_fixed",
    with_roles(
        ["preds"],
        f"SELECT id, target, blend, {STACK_SQL} AS stack FROM (SELECT *, {BLEND_SQL} AS blend FROM vwide)",
        [RANKS_CTE, VWIDE],
    ),
)
def q_stack_fixed(spark, sf_dir):
    return stacked(spark, sf_dir).select("id", "target", "blend", "stack")


_MIX_SRC = f"""(SELECT r.ratio, s.target, r.ratio * s.stack + (1.0 - r.ratio) * s.blend AS m
               FROM (SELECT *, {STACK_SQL} AS stack FROM (SELECT *, {BLEND_SQL} AS blend FROM vwide)) s,
                    (SELECT CAST(unnest([{', '.join(repr(r) for r in MIX_RATIOS)}]) AS DOUBLE) AS ratio) r)"""


@register(
    "mix_ratios",
    with_roles(["preds"], auc_sql(_MIX_SRC, "m", "target", ["ratio"]), [RANKS_CTE, VWIDE]),
)
def q_mix_ratios(spark, sf_dir):
    return BL.ratio_mixes(stacked(spark, sf_dir), "stack", "blend", MIX_RATIOS)


# ---------------------------------------------------------------- B7
SIMPLEX_STEPS = 10
_W = [f"w_{m}" for m in MODELS]
_SIMPLEX_SRC = f"""(SELECT {", ".join(f"k{i} AS {w}" for i, w in enumerate(_W))}, v.target,
                          {" + ".join(f"(CAST(k{i} AS DOUBLE) / {SIMPLEX_STEPS}) * v.{m}" for i, m in enumerate(MODELS))} AS s
                   FROM vwide v, (SELECT *, {SIMPLEX_STEPS} - {" - ".join(f"k{i}" for i in range(len(MODELS) - 1))} AS k{len(MODELS) - 1}
                                  FROM {", ".join(f"range({SIMPLEX_STEPS + 1}) r{i}(k{i})" for i in range(len(MODELS) - 1))}) w
                   WHERE k{len(MODELS) - 1} >= 0)"""


@register(
    "weights_simplex",
    with_roles(
        ["preds"],
        f"""SELECT {", ".join(f"CAST({w} AS INTEGER) AS {w}" for w in _W)}, auc
            FROM ({auc_sql(_SIMPLEX_SRC, "s", "target", _W)})""",
        [RANKS_CTE, VWIDE],
    ),
)
def q_weights_simplex(spark, sf_dir):
    """B7 over all models."""
    return BL.simplex_search(wide(spark, sf_dir), MODELS, SIMPLEX_STEPS)


# ---------------------------------------------------------------- M3-M6, P14
_MARGIN = "(4.0 * rank_pct - 2.0)"
_SOFTPLUS_POS = f"(greatest(-{_MARGIN}, 0) + ln(1 + exp(-abs({_MARGIN}))))"
_SOFTPLUS_NEG = f"(greatest({_MARGIN}, 0) + ln(1 + exp(-abs({_MARGIN}))))"
_BCE_SQL = f"avg({POS_WEIGHT} * target * {_SOFTPLUS_POS} + (1 - target) * {_SOFTPLUS_NEG})"


def _valid_ranks(spark, sf_dir):
    return ranks(spark, sf_dir, "valid").withColumn("margin", 4.0 * F.col("rank_pct") - 2.0)


@register(
    "bce_weighted",
    with_roles(
        ["preds"],
        f"SELECT model, round({_BCE_SQL}, 6) AS bce FROM ranks WHERE split = 'valid' GROUP BY model",
        [RANKS_CTE],
    ),
)
def q_bce_weighted(spark, sf_dir):
    out = M.weighted_bce(_valid_ranks(spark, sf_dir), "margin", "target", POS_WEIGHT, by=["model"])
    return out.select("model", F.round("bce", 6).alias("bce"))


LOSS_BATCH = 16
LOSS_SEED = 11
# Batches over the validation ids (one epoch, one shard), the last one kept
# even if it is short: no validation row is left out of the loss.
VPLAN = (
    "vplan",
    f"""SELECT id, CAST(floor((r - 1) / {LOSS_BATCH}) AS BIGINT) AS batch
        FROM (SELECT id, row_number() OVER (ORDER BY h, id) AS r
              FROM (SELECT DISTINCT id, {mix_hash_sql('id', '1', seed=LOSS_SEED)} AS h
                    FROM preds WHERE split = 'valid'))""",
)
_BATCHED = f"SELECT r.model, v.batch, r.target, {_MARGIN} AS m FROM ranks r JOIN vplan v USING (id) WHERE r.split = 'valid'"
_PAIR_SQL = f"""SELECT p.model, p.batch, avg(greatest(n.m - p.m, 0) + ln(1 + exp(-abs(n.m - p.m)))) AS rank_loss
    FROM ({_BATCHED}) p JOIN ({_BATCHED}) n ON p.model = n.model AND p.batch = n.batch
    WHERE p.target = 1 AND n.target <> 1
    GROUP BY p.model, p.batch"""


def _batched_valid_ranks(spark, sf_dir):
    """Model, batch, target and margin, ranked and dealt into batches once."""
    r = stored(_valid_ranks(spark, sf_dir).select("model", "id", "target", "margin"))
    plan = S.batch_plan(r.select("id").distinct(), 1, 1, LOSS_BATCH, LOSS_SEED, drop_partial=False)
    return stored(r.join(plan.select("id", "batch"), "id").select("model", "batch", "target", "margin"))


@register(
    "rank_loss",
    with_roles(
        ["preds"],
        f"""SELECT b.model, b.batch, round(coalesce(l.rank_loss, 0.0), 6) AS rank_loss
            FROM (SELECT DISTINCT model, batch FROM ({_BATCHED})) b LEFT JOIN ({_PAIR_SQL}) l USING (model, batch)""",
        [RANKS_CTE, VPLAN],
    ),
)
def q_rank_loss(spark, sf_dir):
    r = _batched_valid_ranks(spark, sf_dir)
    out = M.pairwise_rank_loss(r, "margin", "target", ["model", "batch"])
    return out.select("model", "batch", F.round("rank_loss", 6).alias("rank_loss"))


@register(
    "objective",
    with_roles(
        ["preds"],
        f"""SELECT b.model, b.batch,
                   round(b.bce + {RANK_LOSS_WEIGHT} * coalesce(l.rank_loss, 0.0), 6) AS objective
            FROM (SELECT r.model, v.batch, {_BCE_SQL.replace('rank_pct', 'r.rank_pct').replace('target', 'r.target')} AS bce
                  FROM ranks r JOIN vplan v USING (id) WHERE r.split = 'valid' GROUP BY 1, 2) b
            LEFT JOIN ({_PAIR_SQL}) l USING (model, batch)""",
        [RANKS_CTE, VPLAN],
    ),
)
def q_objective(spark, sf_dir):
    r = _batched_valid_ranks(spark, sf_dir)
    bce = M.weighted_bce(r, "margin", "target", POS_WEIGHT, by=["model", "batch"])
    rl = M.pairwise_rank_loss(r, "margin", "target", ["model", "batch"])
    joined = bce.join(rl, ["model", "batch"])
    return joined.select(
        "model",
        "batch",
        F.round(F.col("bce") + RANK_LOSS_WEIGHT * F.col("rank_loss"), 6).alias("objective"),
    )


@register(
    "pred_corr",
    with_roles(
        ["preds"],
        "SELECT "
        + ", ".join(
            f"round(corr({a}, {b}), 6) AS {a}__{b}"
            for i, a in enumerate(MODELS)
            for b in MODELS[i + 1 :]
        )
        + " FROM vwide",
        [RANKS_CTE, VWIDE],
    ),
)
def q_pred_corr(spark, sf_dir):
    out = M.correlation(wide(spark, sf_dir), MODELS)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register(
    "sigmoid_score",
    with_roles(
        ["preds"],
        f"SELECT model, id, round(1 / (1 + exp(-{_MARGIN})), 6) AS p FROM ranks WHERE split = 'valid'",
        [RANKS_CTE],
    ),
)
def q_sigmoid_score(spark, sf_dir):
    r = _valid_ranks(spark, sf_dir)
    return r.select("model", "id", F.round(sigmoid("margin"), 6).alias("p"))


# ---------------------------------------------------------------- S12
_TEXT_SQL = r"regexp_replace(regexp_replace(printf('%.18f', v), '\.?0+$', ''), '^(-?)0\.', '\1.')"


@register(
    "compact_text",
    with_roles(
        ["preds"],
        f"""SELECT id, ord, CASE WHEN t = '-0' THEN '0' ELSE t END AS flag
            FROM (SELECT id, ord, {_TEXT_SQL} AS t
                  FROM (SELECT id, id AS ord, {BLEND_SQL} AS v FROM twide))""",
        [RANKS_CTE, TWIDE],
    ),
)
def q_compact_text(spark, sf_dir):
    test = BL.blend(wide(spark, sf_dir, "test"), BLEND_WEIGHTS, "v")
    return test.select("id", F.col("id").alias("ord"), compact_decimal_text("v").alias("flag"))


# ---------------------------------------------------------------- C1-C7
@register(
    "check_unique",
    with_roles(
        ["preds"],
        """SELECT 'target_dense' AS tbl, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows,
                  count_if(n > 1) AS dup_keys
           FROM (SELECT id, count(*) AS n FROM target_dense GROUP BY id)
           UNION ALL
           SELECT 'preds', count(*), CAST(sum(n) AS BIGINT), count_if(n > 1)
           FROM (SELECT model, id, count(*) AS n FROM preds GROUP BY model, id)""",
    ),
)
def q_check_unique(spark, sf_dir):
    def summary(df, keys, name):
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return per_key.agg(
            F.lit(name).alias("tbl"),
            F.count(F.lit(1)).alias("n_keys"),
            F.sum("n").cast("long").alias("n_rows"),
            F.count_if(F.col("n") > 1).alias("dup_keys"),
        )

    return summary(B.target_dense(spark, sf_dir), ["id"], "target_dense").unionByName(
        summary(B.preds(spark, sf_dir), ["model", "id"], "preds")
    )


@register(
    "check_complete",
    with_roles(
        ["history_b", "target_dense", "query_ids"],
        """SELECT 'labelled_without_features' AS check_name, count(*) AS missing
           FROM target_dense t WHERE t.id NOT IN (SELECT DISTINCT id FROM history_b)
           UNION ALL
           SELECT 'queries_without_rows', count(*)
           FROM query_ids q WHERE q.id NOT IN (SELECT doc_id FROM documents)""",
    ),
)
def q_check_complete(spark, sf_dir):
    feats = history_aggregate(B.history_b(spark, sf_dir), ["x"])
    a = C.missing_keys(B.target_dense(spark, sf_dir), feats, ["id"]).agg(
        F.lit("labelled_without_features").alias("check_name"), F.count(F.lit(1)).alias("missing")
    )
    docs = B.read_table(spark, sf_dir, "documents", ["doc_id"]).select(F.col("doc_id").alias("id"))
    b = C.missing_keys(B.query_ids(spark, sf_dir), docs, ["id"]).agg(
        F.lit("queries_without_rows").alias("check_name"), F.count(F.lit(1)).alias("missing")
    )
    return a.unionByName(b)


@register(
    "check_aligned",
    with_roles(
        ["preds"],
        f"""SELECT coalesce(l.model, r.model) AS model, count_if(r.id IS NULL) AS only_left,
                  count_if(l.id IS NULL) AS only_right,
                  count_if(l.id IS NOT NULL AND r.id IS NOT NULL AND l.target IS DISTINCT FROM r.target) AS differ
           FROM (SELECT model, id, target FROM preds WHERE split = 'valid') l
           FULL OUTER JOIN (SELECT m.model, id, flag AS target
                            FROM target_dense, (SELECT unnest([{', '.join(repr(m) for m in MODELS)}]) AS model) m
                            WHERE ((id % 10) + 10) % 10 = 0) r ON l.id = r.id AND l.model = r.model
           GROUP BY 1""",
    ),
)
def q_check_aligned(spark, sf_dir):
    """C3/C7 for every prediction set against the labelled validation ids."""
    left = B.preds(spark, sf_dir).where(F.col("split") == "valid").select("model", "id", "target")
    right = B.target_dense(spark, sf_dir).where(fold("id") == 0).select(
        F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"), "id", F.col("flag").alias("target")
    )
    return C.alignment_report(left, right, "id", ["target"], by=["model"])


@register(
    "check_rows",
    with_roles(
        ["preds"],
        """SELECT model, count(*) AS rows,
                  (SELECT count(*) FROM target_dense WHERE ((id % 10) + 10) % 10 <> 0) AS expected,
                  count(*) = (SELECT count(*) FROM target_dense WHERE ((id % 10) + 10) % 10 <> 0) AS ok
           FROM preds WHERE split = 'test' GROUP BY model""",
    ),
)
def q_check_rows(spark, sf_dir):
    expected = B.target_dense(spark, sf_dir).where(fold("id") != 0).count()
    test = B.preds(spark, sf_dir).where(F.col("split") == "test")
    return C.row_count_report(test, expected, by=["model"])


@register(
    "check_order",
    with_roles(
        ["preds"],
        """SELECT count(*) AS positions, count_if(o.id IS DISTINCT FROM s.id) AS mismatched
           FROM (SELECT id FROM twide) o
           FULL OUTER JOIN (SELECT id FROM target_dense WHERE ((id % 10) + 10) % 10 <> 0) s
           ON o.id = s.id""",
        [RANKS_CTE, TWIDE],
    ),
)
def q_check_order(spark, sf_dir):
    """C5 on the written file: predictions are joined to a sample in hash
    order, written and read back; positions come from the file."""
    sample = global_row_number(
        B.target_dense(spark, sf_dir).where(fold("id") != 0).select("id", mix_hash("id", seed=5).alias("_h")),
        ["_h", "id"],
        name="ord",
    ).select("id", "ord")
    blended = BL.blend(wide(spark, sf_dir, "test"), BLEND_WEIGHTS, "flag").select("id", "flag")
    path = scratch_path(spark, f"order/{uuid.uuid4().hex}")
    write_compact_csv(sample.join(blended, "id"), "id", "flag", "ord", path)
    return C.order_report(read_in_file_order(spark, path, "id long, flag string"), sample, "id", "ord")


@register(
    "check_range",
    with_roles(
        ["preds"],
        f"""SELECT count(*) AS rows, count_if(v IS NULL) AS nulls, count_if(isnan(v) OR isinf(v)) AS not_finite,
                   count_if(v < 0 OR v > 1) AS out_of_range
            FROM (SELECT {BLEND_SQL} AS v FROM twide)""",
        [RANKS_CTE, TWIDE],
    ),
)
def q_check_range(spark, sf_dir):
    test = BL.blend(wide(spark, sf_dir, "test"), BLEND_WEIGHTS, "v")
    return C.range_report(test, "v")


# ---------------------------------------------------------------- B3
# The reference's final-layer weights (time prior, bin model)
# and its three seed weights, applied to stand-in components.
TIME_WEIGHT = 0.0121
BIN_WEIGHT = 0.0257
SEED_WEIGHTS = {"discount": 0.2141, "overdue_rate": 0.2804, "max_qty": 0.2753}
MAIN_WEIGHT = 1.0 - TIME_WEIGHT - BIN_WEIGHT - sum(SEED_WEIGHTS.values())


def _layer_terms():
    return [(MAIN_WEIGHT, "blend"), (TIME_WEIGHT, "prior_rank"), (BIN_WEIGHT, "centre_rank")] + [
        (w, m) for m, w in SEED_WEIGHTS.items()
    ]


def _layers_sql(wide: str) -> str:
    return f"""SELECT w.id, w.target, {weighted_sql(_layer_terms())} AS layered
            FROM (SELECT *, {BLEND_SQL} AS blend FROM {wide}) w
            JOIN (SELECT id,
                         (row_number() OVER (ORDER BY prior, id) - 1) / greatest(count(*) OVER () - 1, 1) AS prior_rank,
                         (row_number() OVER (ORDER BY centre, id) - 1) / greatest(count(*) OVER () - 1, 1) AS centre_rank
                  FROM layers) r USING (id)"""


def layered(spark, sf_dir, split):
    """Main * (1 - sum of layer weights) + prior + bin model + seeds,
    every component as a rank over the split's ids."""
    layers = q_axis.customer_layers(spark, sf_dir, split)
    ranked = rank_percentile(rank_percentile(layers, "prior", "id", name="prior_rank"), "centre", "id", name="centre_rank")
    w = BL.blend(wide(spark, sf_dir, split), BLEND_WEIGHTS, "blend").join(
        ranked.select("id", "prior_rank", "centre_rank"), "id"
    )
    return w.select("id", "target", weighted_sum(_layer_terms()).alias("layered"))


@register(
    "blend_layers",
    with_roles(
        ["preds"],
        _layers_sql("vwide"),
        [RANKS_CTE, VWIDE, q_axis.CUSTOMER_TRAIN, q_axis.CUSTOMER_VALID, ("layers", q_axis.LAYERS_SQL["valid"])],
    ),
)
def q_blend_layers(spark, sf_dir):
    return layered(spark, sf_dir, "valid")


@register(
    "blend_layers_test",
    with_roles(
        ["preds"],
        _layers_sql("twide"),
        [RANKS_CTE, TWIDE, q_axis.CUSTOMER_TEST, ("layers", q_axis.LAYERS_SQL["test"])],
    ),
)
def q_blend_layers_test(spark, sf_dir):
    return layered(spark, sf_dir, "test")
