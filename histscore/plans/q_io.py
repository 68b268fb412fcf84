"""Source and sink queries: S3, S5-S7, S9, S14, P2 (stored fold), P8, and the
test side of B4 and B5."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from histscore.functions.scalar import clamp
from histscore.operators import blend as BL
from histscore.operators import split as SP
from histscore.plans import bindings as B
from histscore.plans import q_blend as Q
from histscore.plans.oracle_ctes import with_roles
from histscore.plans.registry import register
from histscore.session import scratch_path
from histscore.sources import sinks, tables
from histscore.sources.stages import stage

REQUIRED = ["orders", "lineitem", "customer"]
UTIL_CAP = (1, 6)


def _fresh(spark, name):
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


@register(
    "schema_features",
    with_roles(
        ["history_b"],
        """SELECT 'overdue' AS feature, count(overdue) AS present FROM history_b
           UNION ALL SELECT 'state', count(state) FROM history_b
           UNION ALL SELECT 'util', count(util) FROM history_b
           UNION ALL SELECT 'x', count(x) FROM history_b
           UNION ALL SELECT 'type', count(type) FROM history_b""",
    ),
)
def q_schema_features(spark, sf_dir):
    """S3: the features are the schema's columns but the keys."""
    h = B.history_b(spark, sf_dir)
    features = tables.feature_columns(h)
    counts = h.agg(*[F.count(c).alias(c) for c in features])
    return counts.unpivot([], features, "feature", "present")


@register(
    "required_inputs",
    " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in REQUIRED),
)
def q_required_inputs(spark, sf_dir):
    """Fails before any work if an input is missing, then its rows."""
    missing = tables.missing_inputs(spark, sf_dir, REQUIRED)
    if missing:
        raise FileNotFoundError(f"missing inputs: {missing}")
    parts = {n: tables.read_table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("rows")) for n in REQUIRED}
    return tables.union_splits(parts, "name")


@register("csv_roundtrip", with_roles(["target_dense"], "SELECT id, flag FROM target_dense"))
def q_csv_roundtrip(spark, sf_dir):
    """A CSV with a header whose types come from the given schema."""
    path = _fresh(spark, "csv")
    B.target_dense(spark, sf_dir).select("id", "flag").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("flag", T.ShortType())])
    return tables.read_csv_typed(spark, path, schema)


@register(
    "prediction_store",
    with_roles(["preds"], "SELECT model, split, id, target, prediction FROM preds"),
)
def q_prediction_store(spark, sf_dir):
    """Predictions written per model and read under their alias keys."""
    path = _fresh(spark, "preds")
    aliased = B.preds(spark, sf_dir).select(
        "model", "split", F.col("id").alias("ids"), F.col("target").alias("targets"), F.col("prediction").alias("predictions")
    )
    sinks.write_predictions(aliased, path)
    return sinks.read_predictions(spark, path).select("model", "split", "id", "target", "prediction")


@register(
    "stored_fold",
    with_roles(["target_dense"], "SELECT id, flag, CAST(((id % 10) + 10) % 10 AS INTEGER) AS fold FROM target_dense"),
)
def q_stored_fold(spark, sf_dir):
    """The fold stored as a column and a folder, so a filter on it
    prunes folders; a committed stage is reused for the same input."""

    def build(path):
        SP.with_fold(B.target_dense(spark, sf_dir)).write.partitionBy("fold").parquet(path)

    path = stage(spark, "folds", {"input": tables.input_key(spark, sf_dir, ["customer"])}, build)
    return spark.read.parquet(path).select("id", "flag", "fold")


@register("bom_csv", with_roles(["target_dense"], "SELECT id, flag FROM target_dense"))
def q_bom_csv(spark, sf_dir):
    """CSV files that begin with a byte-order mark keep their first
    column's name and type."""
    path = _fresh(spark, "bom")
    marked = B.target_dense(spark, sf_dir).select(F.col("id").alias("\ufeffid"), "flag")
    marked.write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("flag", T.ShortType())])
    return tables.read_csv_typed(spark, path, schema)


@register(
    "util_clamped",
    with_roles(
        ["history_b"],
        f"""SELECT id, avg(least(greatest(util, {UTIL_CAP[0]}), {UTIL_CAP[1]})) AS util__clamped_mean
            FROM history_b GROUP BY id""",
    ),
)
def q_util_clamped(spark, sf_dir):
    """Utilisation clipped to a range, then averaged."""
    h = B.history_b(spark, sf_dir)
    return h.groupBy("id").agg(F.avg(clamp("util", *UTIL_CAP)).alias("util__clamped_mean"))


# ---------------------------------------------------------------- test side
_STACKED_TEST = f"(SELECT *, {Q.STACK_SQL} AS stack FROM (SELECT *, {Q.BLEND_SQL} AS blend FROM twide))"


@register(
    "stack_test",
    with_roles(["preds"], f"SELECT id, blend, stack FROM {_STACKED_TEST}", [Q.RANKS_CTE, Q.TWIDE]),
)
def q_stack_test(spark, sf_dir):
    """B4 on the test split."""
    return Q.stacked(spark, sf_dir, "test").select("id", "blend", "stack")


@register(
    "mix_outputs",
    with_roles(
        ["preds"],
        f"""SELECT r.ratio, s.id, r.ratio * s.stack + (1.0 - r.ratio) * s.blend AS mixed
            FROM {_STACKED_TEST} s,
                 (SELECT CAST(unnest([{', '.join(repr(r) for r in Q.MIX_RATIOS)}]) AS DOUBLE) AS ratio) r""",
        [Q.RANKS_CTE, Q.TWIDE],
    ),
)
def q_mix_outputs(spark, sf_dir):
    """The mixed prediction of every ratio on the test split."""
    return BL.mixed_outputs(Q.stacked(spark, sf_dir, "test"), "stack", "blend", Q.MIX_RATIOS)
