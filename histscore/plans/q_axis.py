"""Queries on the ordered id axis: J5/U2, A8/A9, W4-W8 (labels = toxic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from histscore.functions.scalar import fold
from histscore.operators import axis as X
from histscore.plans import bindings as B
from histscore.plans.oracle_ctes import with_roles
from histscore.plans.registry import register

# Driver-scale parameters: the reference uses a 200,000-wide
# window and widths 64..16,384 with 129 bins for millions of ids.
HALF_WIDTH = 50
BIN_WIDTHS = (4, 8, 16)
HALF_BINS = 4
# The reference's smoothing strengths (prior, bins).
PRIOR_SMOOTHING = 20.0
BIN_SMOOTHING = 5.0

FOLD_SQL = "((id % 10) + 10) % 10"
TRAIN_LABELS = ("train_labels", f"SELECT id, flag FROM target_sparse WHERE {FOLD_SQL} <> 0")
VALID_IDS = ("valid_ids", f"SELECT id, flag FROM target_sparse WHERE {FOLD_SQL} = 0")


def _train_labels(spark, sf_dir):
    labels = B.target_sparse(spark, sf_dir)
    return X.included_labels(labels, labels.where(fold("id") == 0))


def _valid(spark, sf_dir):
    return B.target_sparse(spark, sf_dir).where(fold("id") == 0)


@register(
    "label_exclusion",
    with_roles(["target_sparse"], "SELECT id, flag FROM train_labels", [TRAIN_LABELS]),
)
def q_label_exclusion(spark, sf_dir):
    return _train_labels(spark, sf_dir)


@register(
    "base_rate",
    with_roles(
        ["target_sparse", "query_ids"],
        """SELECT count(*) AS n_labels, avg(flag) AS base_rate,
                  greatest(max(id), (SELECT max(id) FROM query_ids)) AS max_id
           FROM train_labels""",
        [TRAIN_LABELS],
    ),
)
def q_base_rate(spark, sf_dir):
    """A8/A9 in one pass over labels and query ids together."""
    labels = _train_labels(spark, sf_dir).select("id", "flag")
    queries = B.query_ids(spark, sf_dir).select("id", F.lit(None).cast("short").alias("flag"))
    ids = labels.unionByName(queries)
    return ids.agg(
        F.count("flag").alias("n_labels"), F.avg("flag").alias("base_rate"), F.max("id").alias("max_id")
    )


@register(
    "prefix_sums",
    with_roles(
        ["target_sparse"],
        """SELECT id AS pos,
                  CAST(coalesce(sum(flag) OVER w, 0) AS BIGINT) AS sum_before,
                  coalesce(count(*) OVER w, 0) AS count_before
           FROM train_labels
           WINDOW w AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           UNION ALL
           SELECT max(id) + 1, CAST(sum(flag) AS BIGINT), count(*) FROM train_labels""",
        [TRAIN_LABELS],
    ),
)
def q_prefix_sums(spark, sf_dir):
    return X.prefix_table(_train_labels(spark, sf_dir))


def _prior_sql(queries: str, labels: str, split: str) -> str:
    return f"""SELECT '{split}' AS split, q.id,
                   CAST(coalesce(sum(l.flag), 0) AS BIGINT) AS window_sum, count(l.id) AS window_count,
                   (coalesce(sum(l.flag), 0) + CAST({PRIOR_SMOOTHING} AS DOUBLE) * (SELECT avg(flag) FROM {labels}))
                   / (count(l.id) + CAST({PRIOR_SMOOTHING} AS DOUBLE)) AS prior
            FROM {queries} q LEFT JOIN {labels} l ON l.id BETWEEN q.id - {HALF_WIDTH} AND q.id + {HALF_WIDTH}
            GROUP BY q.id"""


@register(
    "id_prior",
    with_roles(
        ["target_sparse", "query_ids"],
        _prior_sql("valid_ids", "train_labels", "valid")
        + " UNION ALL "
        + _prior_sql("query_ids", "target_sparse", "test"),
        [TRAIN_LABELS, VALID_IDS],
    ),
)
def q_id_prior(spark, sf_dir):
    """Validation priors exclude the whole fold (K8); test priors use every
    label."""
    valid = X.centred_prior(_train_labels(spark, sf_dir), _valid(spark, sf_dir), HALF_WIDTH, PRIOR_SMOOTHING)
    test = X.centred_prior(
        B.target_sparse(spark, sf_dir), B.query_ids(spark, sf_dir), HALF_WIDTH, PRIOR_SMOOTHING
    )
    return valid.withColumn("split", F.lit("valid")).unionByName(test.withColumn("split", F.lit("test")))


def _bins_sql(queries: str, labels: str, own: bool, widths=BIN_WIDTHS) -> str:
    widths = ", ".join(str(w) for w in widths)
    own_sum = "- CASE WHEN b.bin = 0 THEN q.flag ELSE 0 END" if own else ""
    own_cnt = "- CASE WHEN b.bin = 0 THEN 1 ELSE 0 END" if own else ""
    return f"""
    SELECT id, width, bin, sum, count,
           (sum + CAST({BIN_SMOOTHING} AS DOUBLE) * base) / (count + CAST({BIN_SMOOTHING} AS DOUBLE)) - base AS rate_c,
           round(ln(1 + count) / ln(1 + width), 9) AS density
    FROM (
      SELECT b.id, b.width, b.bin,
             CAST(coalesce(sum(l.flag), 0) {own_sum} AS BIGINT) AS sum,
             CAST(count(l.id) {own_cnt} AS BIGINT) AS count,
             (SELECT avg(flag) FROM {labels}) AS base
      FROM (SELECT q.id, w.width, CAST(j.bin AS INTEGER) AS bin, q.id + j.bin * w.width - w.width // 2 AS lo
            FROM {queries} q, (SELECT unnest([{widths}]) AS width) w,
                 (SELECT unnest(range(-{HALF_BINS}, {HALF_BINS} + 1)) AS bin) j) b
      {"JOIN " + queries + " q ON q.id = b.id" if own else ""}
      LEFT JOIN {labels} l ON l.id >= b.lo AND l.id < b.lo + b.width
      GROUP BY b.id, b.width, b.bin {", q.flag" if own else ""})"""


@register(
    "multi_scale_bins",
    with_roles(["target_sparse", "query_ids"], _bins_sql("query_ids", "target_sparse", False)),
)
def q_multi_scale_bins(spark, sf_dir):
    bins = X.multi_scale_bins(
        B.target_sparse(spark, sf_dir), B.query_ids(spark, sf_dir), BIN_WIDTHS, HALF_BINS, BIN_SMOOTHING
    )
    return bins.withColumn("density", F.round("density", 9))


WIDTH_SCALE = 0.6


@register(
    "bins_scaled",
    with_roles(
        ["target_sparse", "query_ids"],
        _bins_sql("query_ids", "target_sparse", False, X.scaled_widths(BIN_WIDTHS, WIDTH_SCALE)),
    ),
)
def q_bins_scaled(spark, sf_dir):
    """The bins at widths scaled to the axis."""
    widths = X.scaled_widths(BIN_WIDTHS, WIDTH_SCALE)
    bins = X.multi_scale_bins(
        B.target_sparse(spark, sf_dir), B.query_ids(spark, sf_dir), widths, HALF_BINS, BIN_SMOOTHING
    )
    return bins.withColumn("density", F.round("density", 9))


@register(
    "bins_leave_self_out",
    with_roles(["target_sparse"], _bins_sql("train_labels", "train_labels", True), [TRAIN_LABELS]),
)
def q_bins_leave_self_out(spark, sf_dir):
    train = _train_labels(spark, sf_dir)
    bins = X.multi_scale_bins(train, train, BIN_WIDTHS, HALF_BINS, BIN_SMOOTHING, own_targets=train)
    return bins.withColumn("density", F.round("density", 9))


@register(
    "bins_pooled",
    with_roles(
        ["target_sparse", "query_ids"],
        f"""SELECT id, width, max(CASE WHEN bin = 0 THEN rate_c END) AS rate_c_centre,
                   round(avg(rate_c), 9) AS rate_c_mean, max(rate_c) AS rate_c_max
            FROM ({_bins_sql("query_ids", "target_sparse", False)}) GROUP BY id, width""",
    ),
)
def q_bins_pooled(spark, sf_dir):
    bins = X.multi_scale_bins(
        B.target_sparse(spark, sf_dir), B.query_ids(spark, sf_dir), BIN_WIDTHS, HALF_BINS, BIN_SMOOTHING
    )
    pooled = X.pooled_bins(bins)
    return pooled.withColumn("rate_c_mean", F.round("rate_c_mean", 9))


# ---------------------------------------------------------------- J2, O3
@register(
    "sample_left_join",
    with_roles(
        ["target_sparse", "query_ids"],
        f"""SELECT s.id, s.ord, p.prior FROM query_ids s
            LEFT JOIN ({_prior_sql("query_ids", "target_sparse", "test")}) p USING (id)""",
    ),
)
def q_sample_left_join(spark, sf_dir):
    """Predictions (test priors) joined onto the sample ids in sample
    order; a missing prediction stays null for the completeness check."""
    sample = B.sample_ids(spark, sf_dir)
    priors = X.centred_prior(B.target_sparse(spark, sf_dir), sample, HALF_WIDTH, PRIOR_SMOOTHING)
    return sample.join(priors.select("id", "prior"), "id", "left").select("id", "ord", "prior")


# ---------------------------------------------------------------- customer-axis layers
CUSTOMER_TRAIN = ("customer_train", f"SELECT id, flag FROM target_dense WHERE {FOLD_SQL} <> 0")
CUSTOMER_VALID = ("customer_valid", f"SELECT id, flag FROM target_dense WHERE {FOLD_SQL} = 0")
LAYER_WIDTH = 8


def customer_layers(spark, sf_dir, split="valid"):
    """Prior and centre-bin rate: of the validation customers with the labels
    of the other folds only (K8), of the test customers with all labels."""
    t = B.target_dense(spark, sf_dir)
    train = t.where(fold("id") != 0) if split == "valid" else t
    valid = t.where((fold("id") == 0) if split == "valid" else (fold("id") != 0))
    prior = X.centred_prior(train, valid, HALF_WIDTH, PRIOR_SMOOTHING).select("id", "prior")
    bins = X.multi_scale_bins(train, valid, (LAYER_WIDTH,), 0, BIN_SMOOTHING)
    centre = bins.where(F.col("bin") == 0).select("id", F.col("rate_c").alias("centre"))
    return valid.join(prior, "id").join(centre, "id")


_LAYERS_SQL = f"""
    SELECT v.id, v.flag,
           (coalesce(sum(l.flag), 0) + CAST({PRIOR_SMOOTHING} AS DOUBLE) * (SELECT avg(flag) FROM customer_train))
           / (count(l.id) + CAST({PRIOR_SMOOTHING} AS DOUBLE)) AS prior,
           (SELECT (coalesce(sum(c.flag), 0) + CAST({BIN_SMOOTHING} AS DOUBLE) * (SELECT avg(flag) FROM customer_train))
                   / (count(c.id) + CAST({BIN_SMOOTHING} AS DOUBLE)) - (SELECT avg(flag) FROM customer_train)
            FROM customer_train c
            WHERE c.id >= v.id - {LAYER_WIDTH // 2} AND c.id < v.id - {LAYER_WIDTH // 2} + {LAYER_WIDTH}) AS centre
    FROM customer_valid v LEFT JOIN customer_train l ON l.id BETWEEN v.id - {HALF_WIDTH} AND v.id + {HALF_WIDTH}
    GROUP BY v.id, v.flag"""

LAYERS_SQL = {
    "valid": _LAYERS_SQL,
    "test": _LAYERS_SQL.replace("customer_train", "target_dense").replace("customer_valid", "customer_test"),
}
CUSTOMER_TEST = ("customer_test", f"SELECT id, flag FROM target_dense WHERE {FOLD_SQL} <> 0")
