"""Train and score queries: T1-T6, H8, H15.

A fitted model is no SQL. Queries with SQL return what SQL can compute whole
(rows and ids scored and their order, sequence and bin scores, missing
scores); the learners' own results (AUCs, best iteration, importances, scores,
submission texts) have no SQL and are tested against brute force on the scored
rows. Feature table and fits are durable stages (S5): a fit is made once for
all queries and sessions with the same input and code."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from histscore.functions.scalar import fold, mix_hash
from histscore.operators import axis as X
from histscore.operators import learn as L
from histscore.operators import metrics as M
from histscore.operators import sequences as S
from histscore.operators import split as SP
from histscore.operators.checks import missing_keys
from histscore.operators.history import aggregate_columns
from histscore.operators.ordering import stored
from histscore.plans import bindings as B
from histscore.plans import q_axis, q_history, q_seq
from histscore.plans.oracle_ctes import with_roles
from histscore.plans.registry import register
from histscore.plans.sqlhash import mix_hash_sql
from histscore.session import scratch_path
from histscore.sources.sinks import read_in_file_order, write_compact_csv, write_json_row
from histscore.sources.stages import stage
from histscore.sources.tables import input_key

GBT_ITER = 20
TOP_K = 10
CROSS_FOLDS = 3
SOURCES = ["orders", "lineitem", "customer"]
# Prefix of the A5 columns in the stored feature table.
BASE = "base__"


def _stored(spark, sf_dir, name, build, **params):
    """The path of a stage keyed by the input tables and the parameters."""
    return stage(spark, name, {"input": input_key(spark, sf_dir, SOURCES), **params}, build)


def labelled_features(spark, sf_dir, variant="wide"):
    """Every labelled id with features ``wide`` (H14) or ``base`` (A5); one
    without a history has missing features."""

    def build(path):
        # both variants come from one pass over the history
        feats = q_history.wide_table(spark, sf_dir, also=aggregate_columns(B.HISTORY_B_NUMERIC, BASE))
        names = [c for c in feats.columns if c != "id"]
        table = B.target_dense(spark, sf_dir).join(feats, "id", "left").withColumn("is_valid", fold("id") == 0)
        L.prepare_features(table, names).write.parquet(path)

    table = spark.read.parquet(_stored(spark, sf_dir, "labelled", build))
    both = [c for c in table.columns if c not in ("id", "flag", "is_valid")]
    feats = [c for c in both if c.startswith(BASE) == (variant == "base")]
    names = [c.removeprefix(BASE) for c in feats]
    return table.select("id", "flag", *[F.col(c).alias(n) for c, n in zip(feats, names)], "is_valid"), names


def fitted(spark, sf_dir, variant="wide", max_iter=GBT_ITER, sliced=None):
    """(booster, table, features): fit outside fold 0, stopped and cut by the
    AUC on fold 0."""
    table, feats = labelled_features(spark, sf_dir, variant)

    def build(path):
        L.boost(table.where(~F.col("is_valid")), table.where("is_valid"), feats, max_iter, sliced=sliced).save(spark, path)

    path = _stored(spark, sf_dir, "boosted", build, variant=variant, max_iter=max_iter, sliced=sliced)
    return L.Booster.load(spark, path), table, feats


def tagged_scores(booster, table):
    scored = booster.score(table).select("id", "flag", "score", "is_valid")
    temporal, _ = SP.temporal_fold(scored, 0.9)
    return scored.where("is_valid").withColumn("tag", F.lit("random")).unionByName(
        temporal.withColumn("tag", F.lit("temporal"))
    )


@register(
    "gbt_fit_score",
    with_roles(
        ["target_dense"],
        """SELECT tag, count(*) AS rows, CAST(sum(flag) AS BIGINT) AS n_pos,
                  sum(flag) > 0 AND sum(flag) < count(*) AS auc_valid, true AS has_trees
           FROM (SELECT 'random' AS tag, flag FROM target_dense WHERE ((id % 10) + 10) % 10 = 0
                 UNION ALL SELECT 'temporal', flag FROM target_dense
                 WHERE id >= (SELECT quantile_cont(id, 0.9) FROM target_dense))
           GROUP BY tag""",
    ),
)
def q_gbt_fit_score(spark, sf_dir):
    """The rows scored for ``gbt_metrics`` (every labelled id of the fold, with
    a history or without), whether they have an AUC, and the fit's trees."""
    return q_gbt_metrics(spark, sf_dir).select(
        "tag", "rows", "n_pos", _auc_valid(), (F.col("iterations") > 0).alias("has_trees")
    )


def _auc_valid():
    """An AUC exists exactly where both classes do."""
    return F.coalesce(F.col("auc").between(0.0, 1.0), F.lit(False)).alias("auc_valid")


@register("gbt_metrics")
def q_gbt_metrics(spark, sf_dir):
    """Boosted trees on the engineered table, stopped and cut by
    the AUC on fold 0; exact AUC on fold 0 and on the temporal rows (which
    include training rows, K22)."""
    booster, table, feats = fitted(spark, sf_dir)
    aucs = M.auc(tagged_scores(booster, table), "score", "flag", by=["tag"], counts=True)
    return aucs.select(
        "tag", (F.col("n_pos") + F.col("n_neg")).alias("rows"), "n_pos", "auc",
        F.lit(booster.best).alias("best_iteration"), F.lit(len(booster.curve)).alias("iterations"),
        F.lit(len(feats)).alias("feature_count"),
    )


@register("gbt_curve")
def q_gbt_curve(spark, sf_dir):
    """The validation AUC after every iteration, from the margins."""
    booster, table, _ = fitted(spark, sf_dir)
    margins = booster.staged(table.where("is_valid"), ["id", "flag"])
    curve = M.auc(margins, "margin", "flag", by=["iteration"])
    return curve.select("iteration", "auc", (F.col("iteration") == booster.best).alias("is_best"))


@register("gbt_run_summary")
def q_gbt_run_summary(spark, sf_dir):
    """The metrics file of the boosted model, written as JSON and
    read back."""
    booster, table, feats = fitted(spark, sf_dir)
    aucs = M.auc(tagged_scores(booster, table), "score", "flag", by=["tag"], counts=True)
    tag = lambda t, c: F.max(F.when(F.col("tag") == t, F.col(c)))
    rows = F.col("n_pos") + F.col("n_neg")
    train = table.where(~F.col("is_valid")).agg(F.count(F.lit(1)).alias("n")).scalar()
    summary = aucs.withColumn("rows", rows).agg(
        tag("random", "auc").alias("random_auc"), tag("temporal", "auc").alias("temporal_auc"),
        tag("random", "rows").alias("random_valid_rows"), tag("temporal", "rows").alias("temporal_valid_rows"),
    ).select(
        "*", train.alias("train_rows"), F.lit(booster.best).alias("best_iteration"), F.lit(len(feats)).alias("feature_count")
    )
    path = scratch_path(spark, f"metrics/{uuid.uuid4().hex}")
    write_json_row(summary, path)
    return spark.read.schema(summary.schema).json(path)


@register(
    "model_roundtrip",
    with_roles(
        ["target_dense"],
        """SELECT count(*) AS rows, CAST(0.0 AS DOUBLE) AS max_abs_diff, true AS same_feature_order
           FROM target_dense WHERE ((id % 10) + 10) % 10 = 0""",
    ),
)
def q_model_roundtrip(spark, sf_dir):
    """Save, load, and score again; predictions and the feature order
    must survive."""
    booster, table, feats = fitted(spark, sf_dir)
    path = scratch_path(spark, f"models/gbt/{uuid.uuid4().hex}")
    booster.save(spark, path)
    loaded = L.Booster.load(spark, path)
    valid = table.where("is_valid")
    a = booster.score(valid).select("id", F.col("score").alias("a"))
    b = loaded.score(valid).select("id", F.col("score").alias("b"))
    same_order = L.model_feature_names(loaded.model) == feats
    return a.join(b, "id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"),
        F.lit(same_order).alias("same_feature_order"),
    )


# ---------------------------------------------------------------- T4, J2, J4
SAMPLE_SEED = 23


def cross_fitted(spark, sf_dir):
    """Every labelled id with the score of the model that did not see it. A
    fold's model is stopped by the AUC on the next fold, which it does not
    learn from either."""
    table, feats = labelled_features(spark, sf_dir)
    folded = table.withColumn("part", F.pmod(F.floor(F.col("id") / 10), F.lit(CROSS_FOLDS)).cast("int"))

    def fit(k, rows):
        def build(path):
            watched = F.col("part") == (k + 1) % CROSS_FOLDS
            L.boost(rows.where(~watched), rows.where(watched), feats, GBT_ITER).save(spark, path)

        path = _stored(spark, sf_dir, "crossed", build, fold=k, folds=CROSS_FOLDS, max_iter=GBT_ITER)
        return L.Booster.load(spark, path)

    return L.cross_scores(folded, "part", CROSS_FOLDS, fit).select("id", "flag", "part", "score")


def sample_file(spark, sf_dir):
    """The sample: a CSV of all ids in an order of its own, read back with the
    position in the file."""
    path = scratch_path(spark, f"sample/{uuid.uuid4().hex}")
    ids = B.target_dense(spark, sf_dir).select("id")
    ids.orderBy(mix_hash("id", seed=SAMPLE_SEED), "id").write.option("header", True).csv(path)
    return read_in_file_order(spark, path, "id long")


def submitted(spark, sample, predicted):
    """Predictions (id, flag) joined onto the sample, all there or an error,
    written as compact CSV in sample order, and read back in file order."""
    joined = sample.join(stored(predicted), "id", "left")
    missing = joined.where(F.col("flag").isNull()).count()
    if missing:
        raise ValueError(f"{missing} sample ids without a prediction")
    path = scratch_path(spark, f"submission/{uuid.uuid4().hex}")
    write_compact_csv(joined, "id", "flag", "ord", path)
    return read_in_file_order(spark, path, "id long, flag string").select("ord", "id", "flag")


@register(
    "submission",
    with_roles(
        ["target_dense"],
        f"""SELECT row_number() OVER (ORDER BY {mix_hash_sql('id', seed=SAMPLE_SEED)}, id) AS ord, id FROM target_dense""",
    ),
)
def q_submission(spark, sf_dir):
    """The ids of ``submission_text`` at their place in the written file."""
    return q_submission_text(spark, sf_dir).select("ord", "id")


@register("submission_text")
def q_submission_text(spark, sf_dir):
    """Every id scored by the model that did not see it,
    in the order of the sample file, as the compact texts read back."""
    predicted = cross_fitted(spark, sf_dir).select("id", F.col("score").alias("flag"))
    return submitted(spark, sample_file(spark, sf_dir), predicted)


@register("cross_fit_auc")
def q_cross_fit_auc(spark, sf_dir):
    """The AUC of the cross-fitted scores, per fold: no id is scored by a
    model that learnt from it."""
    return M.auc(cross_fitted(spark, sf_dir), "score", "flag", by=["part"], counts=True)


@register(
    "complete_check_submission",
    with_roles(
        ["history_b", "target_dense"],
        """SELECT count(*) AS rows, count(*) - count(h.id) AS null_predictions, count(*) - count(h.id) AS missing_ids
           FROM target_dense t LEFT JOIN (SELECT DISTINCT id FROM history_b) h ON t.id = h.id""",
    ),
)
def q_complete_check_submission(spark, sf_dir):
    """The sample file of all ids against the fitted model's scores
    of the ids with a history: what is missing, by the join and by the keys."""
    sample = sample_file(spark, sf_dir)
    booster, table, _ = fitted(spark, sf_dir)
    scores = stored(booster.score(table.where(F.col("loan_count") > 0)).select("id", "score").dropDuplicates(["id"]))
    joined = sample.join(scores, "id", "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score").isNull()).alias("null_predictions")
    )
    missing = missing_keys(sample, scores, ["id"]).agg(F.count(F.lit(1)).alias("n")).scalar()
    return joined.withColumn("missing_ids", missing)


# ---------------------------------------------------------------- H8
@register("feature_select")
def q_feature_select(spark, sf_dir):
    """H8 applied: the features of largest gain, and the fold-0 AUC of the
    model on all features and of one refitted on these alone."""
    whole, table, feats = fitted(spark, sf_dir)
    ranked = L.importances(whole.model)[:TOP_K]
    names = [n for n, _ in ranked]
    small, _, _ = fitted(spark, sf_dir, sliced=names)
    valid = table.where("is_valid")
    scores = whole.score(valid).select("flag", "score", F.lit("all").alias("of")).unionByName(
        small.score(valid).select("flag", "score", F.lit("top").alias("of"))
    )
    aucs = M.auc(scores, "score", "flag", by=["of"]).agg(
        F.max(F.when(F.col("of") == "all", F.col("auc"))).alias("auc_all"),
        F.max(F.when(F.col("of") == "top", F.col("auc"))).alias("auc_top"),
    ).first()
    rows = [(k + 1, n, float(v), aucs["auc_all"], aucs["auc_top"]) for k, (n, v) in enumerate(ranked)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double, auc_all double, auc_top double")


@register("feature_importances")
def q_feature_importances(spark, sf_dir):
    """H8: every feature with its GBT importance, largest first."""
    booster, _, _ = fitted(spark, sf_dir)
    rows = [(k + 1, n, float(v)) for k, (n, v) in enumerate(L.importances(booster.model))]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


# ---------------------------------------------------------------- T6
_VALID_ROWS = with_roles(
    ["history_b", "target_dense"],
    """SELECT count(*) AS rows, CAST(sum(flag) AS BIGINT) AS n_pos,
              sum(flag) > 0 AND sum(flag) < count(*) AS auc_valid
       FROM target_dense WHERE ((id % 10) + 10) % 10 = 0 AND id IN (SELECT id FROM history_b)""",
)
BIN_SIDE = 8


def packed_sequences(spark, sf_dir):
    """The packed sequences with their labels (Q1), stored once for all
    learners, fits and scorings."""

    def build(path):
        packed = q_seq.packed(spark, sf_dir, labels=False)
        S.with_labels(packed, B.target_dense(spark, sf_dir)).write.parquet(path)

    stage_path = _stored(spark, sf_dir, "packed", build, max_len=q_seq.MAX_LEN)
    return S.required_labels(spark.read.parquet(stage_path))


def learner_scores(spark, sf_dir):
    """(features, id, flag, score) on fold 0 of three learners: pooled
    sequences (Q4), sparse multi-hot codes (Q9), pooled bins (W8). Sequences
    exist for ids with a history; the bins, of every id, are of labels outside
    the fold, without the id's own."""
    p = packed_sequences(spark, sf_dir)
    pooled = p.select("id", F.col("y").alias("flag"), *S.masked_pool("seq", "len", len(q_seq.FIELDS), q_seq.FIELDS))
    offsets = S.field_offsets(q_seq.cards(spark, sf_dir))
    size = offsets.agg(F.max(F.col("offset") + F.col("cardinality"))).first()[0]
    hot = p.select("id", S.sequence_indices(offsets).cast("array<string>").alias("tokens"), F.col("y").alias("flag"))
    hot = hot.where(F.size("tokens") > 0)
    target = B.target_dense(spark, sf_dir)
    train = target.where(fold("id") != 0)
    bins = X.pooled_bins(X.multi_scale_bins(train, target, q_axis.BIN_WIDTHS, BIN_SIDE, q_axis.BIN_SMOOTHING, own_targets=train))
    parts = ["rate_c_centre", "rate_c_mean", "rate_c_max"]
    bins = bins.groupBy("id").pivot("width", list(q_axis.BIN_WIDTHS)).agg(*[F.first(c).alias(c) for c in parts])
    bins = stored(bins.join(target, "id"))
    out = None
    for name, table in (("pooled", pooled), ("multi_hot", hot), ("bins", bins)):
        feats = [c for c in table.columns if c not in ("id", "flag")]
        if name == "multi_hot":
            learner = L.sparse_pipeline(range(int(size)))
        else:
            learner, table = L.logistic_pipeline(feats), L.prepare_features(table, feats, missing=0.0)
        table = table.withColumn("flag", F.col("flag").cast("double"))
        model = learner.fit(table.where(fold("id") != 0))
        scored = L.positive_probability(model.transform(table.where(fold("id") == 0)))
        scored = scored.select(F.lit(name).alias("features"), "id", F.col("flag").cast("int").alias("flag"), "score")
        out = scored if out is None else out.unionByName(scored)
    return out


@register("learners_auc")
def q_learners_auc(spark, sf_dir):
    """A learner per feature set, fold-0 AUC of each."""
    out = M.auc(learner_scores(spark, sf_dir), "score", "flag", by=["features"], counts=True)
    return out.select("features", (F.col("n_pos") + F.col("n_neg")).alias("rows"), "n_pos", "auc")


@register("pooled_lr", _VALID_ROWS)
def q_pooled_lr(spark, sf_dir):
    """The rows scored for ``pooled_lr_auc``, and whether they have an AUC."""
    return q_pooled_lr_auc(spark, sf_dir).select("rows", "n_pos", _auc_valid())


@register("pooled_lr_auc")
def q_pooled_lr_auc(spark, sf_dir):
    """Logistic regression on pooled sequence features, fold-0 AUC."""
    p = packed_sequences(spark, sf_dir)
    pooled = p.select("id", "y", *S.masked_pool("seq", "len", len(q_seq.FIELDS), q_seq.FIELDS))
    feats = [c for c in pooled.columns if c not in ("id", "y")]
    table = L.prepare_features(pooled, feats, missing=0.0).withColumn("flag", F.col("y").cast("double"))
    model = L.logistic_pipeline(feats).fit(table.where(fold("id") != 0))
    scored = L.positive_probability(model.transform(table.where(fold("id") == 0)))
    out = M.auc(scored, "score", "flag", counts=True)
    return out.select((F.col("n_pos") + F.col("n_neg")).alias("rows"), "n_pos", "auc")


# ---------------------------------------------------------------- T5
def _linear_weights(n: int) -> np.ndarray:
    return np.array([((k % 7) - 3) / 10.0 for k in range(n)], dtype=np.float64)


BIAS = -0.5
_NB = 2 * q_axis.HALF_BINS + 1
_W_SQL = (
    f"((((w_idx * 2 + ch) * {_NB} + (bin + {q_axis.HALF_BINS})) % 7) - 3) / 10.0"
)


@register(
    "batch_score",
    with_roles(
        ["target_sparse", "query_ids"],
        f"""SELECT id, round(1 / (1 + exp(-(sum(v * {_W_SQL}) + ({BIAS})))), 6) AS score
            FROM (SELECT id, bin, list_position([{', '.join(str(w) for w in q_axis.BIN_WIDTHS)}], width) - 1 AS w_idx,
                         unnest([0, 1]) AS ch, unnest([rate_c, density]) AS v
                  FROM ({q_axis._bins_sql('query_ids', 'target_sparse', False)}))
            GROUP BY id""",
    ),
)
def q_batch_score(spark, sf_dir):
    bins = X.multi_scale_bins(
        B.target_sparse(spark, sf_dir), B.query_ids(spark, sf_dir),
        q_axis.BIN_WIDTHS, q_axis.HALF_BINS, q_axis.BIN_SMOOTHING,
    ).withColumn("density", F.round("density", 9))
    vectors = X.feature_array(bins)
    n = len(q_axis.BIN_WIDTHS) * 2 * _NB
    scored = L.batch_score(vectors, "features", L.linear_forward, {"w": _linear_weights(n), "b": BIAS})
    return scored.select("id", F.round("score", 6).alias("score"))


SEQ_WIDTH, SEQ_BIAS = 3, 0.1
_SEQ_W = "(((f * 31 + code * 17 + d * 7) % 11) - 5) / 10.0"
_SEQ_HEAD = "(d + 1) / 4.0"


def _sequence_params(codes):
    """Embedding tables (one per field) and a head that SQL can say."""
    f, code, d = np.ogrid[: len(q_seq.FIELDS), :codes, :SEQ_WIDTH]
    tables = (((f * 31 + code * 17 + d * 7) % 11) - 5) / 10.0
    return {"tables": list(tables), "head": (np.arange(SEQ_WIDTH) + 1) / 4.0, "bias": SEQ_BIAS}


@register(
    "sequence_score",
    with_roles(
        ["history_b_coded"],
        f"""SELECT id, round(1 / (1 + exp(-(sum(v) + {SEQ_BIAS}))), 6) AS score
            FROM (SELECT id, d, avg(e) * {_SEQ_HEAD} AS v
                  FROM (SELECT id, pos, d, sum({_SEQ_W}) AS e
                        FROM (SELECT id, pos, field AS f, CAST(value AS INTEGER) AS code, unnest(range({SEQ_WIDTH})) AS d FROM cells)
                        GROUP BY id, pos, d)
                  GROUP BY id, d)
            GROUP BY id""",
        [q_seq.KEPT, q_seq.CELLS],
    ),
)
def q_sequence_score(spark, sf_dir):
    """T5 over packed sequences: embedding sum and masked mean in numpy."""
    codes = int(q_seq.cards(spark, sf_dir).agg(F.max("cardinality")).first()[0])
    packed = q_seq.packed(spark, sf_dir, labels=False)
    scored = L.score_sequences(packed, L.embedding_forward, _sequence_params(codes))
    return scored.select("id", F.round("score", 6).alias("score"))


AB_PARTS = 4
AB_ITER = 10


@register(
    "ab_models",
    with_roles(
        ["target_dense"],
        f"""SELECT CAST(floor(id / 10) % {AB_PARTS} AS INTEGER) AS part, v.variant, count(*) AS rows,
                   CAST(sum(flag) AS BIGINT) AS n_pos, sum(flag) > 0 AND sum(flag) < count(*) AS auc_valid
            FROM target_dense, (SELECT unnest(['a', 'b']) AS variant) v
            WHERE ((id % 10) + 10) % 10 = 0 GROUP BY 1, 2""",
    ),
)
def q_ab_models(spark, sf_dir):
    """The rows compared in ``ab_models_auc``, and whether they have an AUC."""
    return q_ab_models_auc(spark, sf_dir).select("part", "variant", "rows", "n_pos", _auc_valid())


def ab_scores(spark, sf_dir):
    """(variant, part, id, flag, score) on fold 0: feature set A (the A5
    aggregates) and set B (the H14 wide table), the same learner and folds."""
    scored = None
    for tag, variant in (("a", "base"), ("b", "wide")):
        booster, table, _ = fitted(spark, sf_dir, variant, AB_ITER)
        part = booster.score(table.where("is_valid")).select("id", "flag", "score", F.lit(tag).alias("variant"))
        scored = part if scored is None else scored.unionByName(part)
    # Validation ids are multiples of 10; their parts come from id / 10.
    return scored.withColumn("part", F.pmod(F.floor(F.col("id") / 10), F.lit(AB_PARTS)).cast("int"))


@register("ab_models_auc")
def q_ab_models_auc(spark, sf_dir):
    """H15 with trained models: exact AUC of both on every part of the
    validation fold (the whole table, not one part)."""
    aucs = M.auc(ab_scores(spark, sf_dir), "score", "flag", by=["part", "variant"], counts=True)
    return aucs.select("part", "variant", (F.col("n_pos") + F.col("n_neg")).alias("rows"), "n_pos", "auc")
