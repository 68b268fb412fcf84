"""Spark ML training, scoring and feature selection.

The learners are Spark ML's (distributed); the reference's LightGBM and GPU
networks are not rebuilt. Trees are boosted in stages: the margin after every
iteration is a running sum of leaf values, so one explode over iterations
gives the validation AUC of each, and the model is cut where it is best. T5 is
the one Python-in-executor point: a user-supplied numpy forward function
applied to Arrow batches with its parameters shipped once per executor.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histscore.operators.metrics import auc

# Stand-in for a missing value (the reference's learner handles nulls): far
# below any feature, so trees can split it off and no legal value meets it.
MISSING = -1.0e30
# The table learner's settings (step, depth, leaf size,
# row and feature sampling, seed).
GBT_STEP = 0.04
GBT_DEPTH = 5
GBT_MIN_LEAF = 100
GBT_SUBSAMPLE = 0.8
GBT_FEATURE_SUBSET = "0.8"
GBT_SEED = 42
# Fixed value: iterations without a better AUC after which boosting stops.
PATIENCE = 100
# Rows of a training partition at most, where dealing by cores gives more.
FIT_ROWS = 250_000


def gbt_pipeline(
    feature_cols: Sequence[str],
    label: str = "flag",
    max_iter: int = 20,
    seed: int = GBT_SEED,
    min_instances: int = GBT_MIN_LEAF,
    sliced: Sequence[str] | None = None,
) -> Pipeline:
    """The table learner on all rows given to it. With ``sliced`` (H8) a
    ``VectorSlicer`` keeps only those of the assembled features."""
    stages = [VectorAssembler(inputCols=list(feature_cols), outputCol="features")]
    if sliced is not None:
        places = [list(feature_cols).index(c) for c in sliced]
        stages.append(VectorSlicer(inputCol="features", outputCol="selected", indices=places))
    gbt = GBTClassifier(
        labelCol=label,
        featuresCol="features" if sliced is None else "selected",
        leafCol="leaf",
        stepSize=GBT_STEP,
        maxDepth=GBT_DEPTH,
        minInstancesPerNode=min_instances,
        subsamplingRate=GBT_SUBSAMPLE,
        featureSubsetStrategy=GBT_FEATURE_SUBSET,
        maxIter=max_iter,
        seed=seed,
    )
    return Pipeline(stages=[*stages, gbt])


_LEAF = re.compile(r"Predict: (\S+)")


def leaf_values(model: PipelineModel) -> list[list[float]]:
    """Each tree's weighted leaf values, in the order of the leaf numbers that
    ``leafCol`` gives (left to right)."""
    gbt = model.stages[-1]
    trees = [[float(v) for v in _LEAF.findall(t.toDebugString)] for t in gbt.trees]
    return [[w * v for v in values] for w, values in zip(gbt.treeWeights, trees)]


@dataclass
class Booster:
    """A fitted pipeline cut to its best iteration, and the AUC curve that
    says so: (iteration, auc) up to where boosting stopped."""

    model: PipelineModel
    values: list[list[float]]
    best: int
    curve: list[tuple[int, float | None]]

    def _outputs(self, trees: int) -> Column:
        """The weighted outputs of the first trees, as an array."""
        size = max(len(v) for v in self.values)
        flat = F.lit([x for v in self.values[:trees] for x in (*v, *[0.0] * (size - len(v)))])
        leaves = F.slice(vector_to_array("leaf"), 1, trees)
        return F.transform(leaves, lambda leaf, i: F.get(flat, i * size + leaf.cast("int")))

    def staged(self, df: DataFrame, keep: Sequence[str], key: str = "id") -> DataFrame:
        """(keep, iteration, margin) after every iteration: one explode, and a
        running sum in tree order per row. Rows are dealt by key before the
        explode, so one short array is shuffled in place of a row per tree."""
        rows = self.model.transform(df).select(*keep, self._outputs(len(self.values)).alias("_outs"))
        outputs = rows.repartition(key).select(*keep, F.posexplode("_outs").alias("_tree", "_out"))
        order = Window.partitionBy(key).orderBy("_tree").rowsBetween(Window.unboundedPreceding, 0)
        return outputs.select(*keep, (F.col("_tree") + 1).alias("iteration"), F.sum("_out").over(order).alias("margin"))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """The positive-class probability of the model as cut."""
        margin = F.aggregate(self._outputs(self.best), F.lit(0.0), lambda acc, x: acc + x)
        scored = self.model.transform(df).withColumn(name, 1.0 / (1.0 + F.exp(-2.0 * margin)))
        return scored.select(*df.columns, name)

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().save(f"{path}/model")
        told = json.dumps({"best": self.best, "curve": self.curve})
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{path}/stages")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Booster:
        model = PipelineModel.load(f"{path}/model")
        told = json.loads(spark.read.text(f"{path}/stages").first()[0])
        return Booster(model, leaf_values(model), told["best"], [tuple(c) for c in told["curve"]])


def stop_early(curve: Sequence[tuple[int, float | None]], patience: int) -> tuple[int, list[tuple[int, float | None]]]:
    """(best iteration, the curve as far as boosting goes): it stops once
    ``patience`` iterations in a row bring no strictly better AUC; the first
    best iteration counts. Without an AUC (one class) the last is taken."""
    best, top = None, None
    for k, (iteration, value) in enumerate(curve):
        if value is not None and (top is None or value > top):
            best, top = iteration, value
        elif best is not None and iteration - best >= patience:
            return best, list(curve[: k + 1])
    return best if best is not None else curve[-1][0], list(curve)


def fit_parts(df: DataFrame) -> DataFrame:
    """``df`` for a tree learner. A level of a tree is a job, and each of its
    tasks sends the statistics of all open nodes: in as many partitions as the
    session runs at once (more only where one would hold over ``FIT_ROWS``
    rows), tasks and statistics do not grow with the files of the table. No
    shuffle; a table of fewer partitions stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-df.count() // FIT_ROWS)))


def boost(
    train: DataFrame,
    valid: DataFrame,
    feature_cols: Sequence[str],
    max_iter: int,
    patience: int = PATIENCE,
    label: str = "flag",
    key: str = "id",
    **params,
) -> Booster:
    """Fit on ``train``, AUC on ``valid`` after every iteration, early
    stop, and the cut to the best iteration."""
    model = gbt_pipeline(feature_cols, label, max_iter, **params).fit(fit_parts(train))
    whole = Booster(model, leaf_values(model), len(model.stages[-1].trees), [])
    found = {r.iteration: r.auc for r in auc(whole.staged(valid, [key, label], key), "margin", label, by=["iteration"]).collect()}
    curve = [(k, found.get(k)) for k in range(1, len(whole.values) + 1)]
    best, curve = stop_early(curve, patience)
    return Booster(model, whole.values, best, curve)


def cross_scores(
    table: DataFrame, fold_col: str, folds: int, fit: Callable[[int, DataFrame], Booster], name: str = "score"
) -> DataFrame:
    """T4: every row scored by the model that did not see it. ``fit(k, rows)``
    gets the rows outside fold ``k``."""
    out = None
    for k in range(folds):
        part = fit(k, table.where(F.col(fold_col) != k)).score(table.where(F.col(fold_col) == k), name)
        out = part if out is None else out.unionByName(part)
    return out


def prepare_features(df: DataFrame, feature_cols: Sequence[str], missing: float = MISSING) -> DataFrame:
    """Cast features to double and replace nulls by the missing marker (for
    trees; a linear model takes 0.0 instead)."""
    cols = [
        F.coalesce(F.col(c).cast("double"), F.lit(missing)).alias(c) if c in feature_cols else F.col(c)
        for c in df.columns
    ]
    return df.select(*cols)


def positive_probability(scored: DataFrame, name: str = "score") -> DataFrame:
    """The positive-class probability as a plain column."""
    return scored.withColumn(name, vector_to_array("probability")[1])


def model_feature_names(model: PipelineModel) -> list[str]:
    """The feature-order contract saved with the pipeline."""
    return list(model.stages[0].getInputCols())


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """H8: features by GBT importance (gain-based), largest first."""
    names = model_feature_names(model)
    if isinstance(model.stages[-2], VectorSlicer):
        names = [names[k] for k in model.stages[-2].getIndices()]
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, values.tolist()), key=lambda t: (-t[1], t[0]))


def logistic_pipeline(feature_cols: Sequence[str], label: str = "flag") -> Pipeline:
    """A second learner over pooled sequence / bin features."""
    assembler = VectorAssembler(inputCols=list(feature_cols), outputCol="features")
    lr = LogisticRegression(labelCol=label, featuresCol="features", maxIter=50, regParam=0.01)
    return Pipeline(stages=[assembler, lr])


def sparse_pipeline(vocabulary: Sequence[int], tokens: str = "tokens", label: str = "flag") -> Pipeline:
    """T6 on Q9: index arrays (as strings) to sparse count vectors scaled to
    sum one, and a logistic regression on them."""
    hot = CountVectorizerModel.from_vocabulary([str(v) for v in vocabulary], inputCol=tokens, outputCol="hot")
    share = Normalizer(inputCol="hot", outputCol="features", p=1.0)
    return Pipeline(stages=[hot, share, LogisticRegression(labelCol=label, featuresCol="features", maxIter=50, regParam=0.001)])


def batch_score(
    df: DataFrame,
    array_col: str,
    forward: Callable[[np.ndarray, dict], np.ndarray],
    params: dict,
    keep: Sequence[str] = ("id",),
    out_col: str = "score",
) -> DataFrame:
    """T5: apply ``forward(X, params)`` to Arrow batches of a fixed-length
    array column. ``params`` (model weights) are a broadcast variable: sent
    once per executor, not with every task."""
    keep = list(keep)
    shared = df.sparkSession.sparkContext.broadcast(params)
    schema = T.StructType(
        [f for f in df.schema.fields if f.name in keep] + [T.StructField(out_col, T.DoubleType())]
    )

    def run(batches):
        weights = shared.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[array_col].to_numpy()).astype(np.float64)
            out = pdf[keep].copy()
            out[out_col] = np.asarray(forward(x, weights), dtype=np.float64)
            yield out

    return df.select(*keep, array_col).mapInPandas(run, schema=schema)


def linear_forward(x: np.ndarray, params: dict) -> np.ndarray:
    """A numpy linear scorer: sigmoid(x . w + b)."""
    margin = x @ params["w"] + params["b"]
    return 1.0 / (1.0 + np.exp(-margin))


def score_sequences(
    df: DataFrame,
    forward: Callable[[np.ndarray, np.ndarray, dict], np.ndarray],
    params: dict,
    seq: str = "seq",
    length: str = "len",
    keep: Sequence[str] = ("id",),
    out_col: str = "score",
    rows: int = 1024,
) -> DataFrame:
    """T5 over packed sequences (Q1): nested Arrow lists become one padded
    numpy tensor per batch, ``forward(x, mask, params)`` gets codes (n, length,
    fields) and the mask of valid positions. ``params`` are broadcast."""
    keep = list(keep)
    shared = df.sparkSession.sparkContext.broadcast(params)
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField(out_col, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                x = padded(part.column(len(keep)))
                valid = np.arange(x.shape[1]) < part.column(len(keep) + 1).to_numpy()[:, None]
                out = np.asarray(forward(x, valid, shared.value), np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(out)], names=[*keep, out_col])

    return df.select(*keep, seq, length).mapInArrow(run, schema)


def padded(column: pa.Array) -> np.ndarray:
    """A list-of-lists column as (rows, longest, fields), zeros on the right."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    events = column.flatten()
    fields = int(events.value_lengths()[0].as_py()) if len(events) else 0
    cells = events.flatten().to_numpy().reshape(len(events), fields)
    out = np.zeros((len(column), int(sizes.max(initial=0)), fields), cells.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = cells
    return out


def embedding_forward(x: np.ndarray, valid: np.ndarray, params: dict) -> np.ndarray:
    """Sum of the fields' embeddings of each event, masked mean over the
    valid events, linear head, sigmoid. ``tables[f][code]`` is a vector."""
    events = sum(table[x[:, :, f]] for f, table in enumerate(params["tables"]))
    mean = (events * valid[:, :, None]).sum(axis=1) / np.maximum(valid.sum(axis=1), 1)[:, None]
    return 1.0 / (1.0 + np.exp(-(mean @ params["head"] + params["bias"])))
