"""B1-B7 rank blends, grids and stacks, plus J6/S8 prediction alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histscore.functions.scalar import weighted_sum
from histscore.operators.metrics import auc
from histscore.operators.ordering import rank_percentile

# Alternative spellings of the prediction-set keys.
KEY_ALIASES = {"ids": "id", "targets": "target", "predictions": "prediction"}


def canonical_prediction_columns(df: DataFrame) -> DataFrame:
    """Accept ``id|ids``, ``target|targets``, ``prediction|predictions``."""
    out = df
    for alias, name in KEY_ALIASES.items():
        if alias in out.columns and name not in out.columns:
            out = out.withColumnRenamed(alias, name)
    return out


def model_ranks(
    preds: DataFrame,
    tiebreak: str = "id",
    group_cols: Sequence[str] = ("model",),
    name: str = "rank_pct",
) -> DataFrame:
    """W3 for every model at once (one range-partitioned pass)."""
    return rank_percentile(preds, "prediction", tiebreak, group_cols, name=name)


def align(
    long: DataFrame, models: Sequence[str], value: str, keys: Sequence[str] = ("id", "target")
) -> DataFrame:
    """One row per id with one column per model (explicit pivot values,
    so no extra job to discover them). Ids missing from a model give null
    there; ``checks.alignment_report`` counts such mismatches."""
    return long.groupBy(*keys).pivot("model", list(models)).agg(F.first(value))


def blend(
    wide: DataFrame, weights: Mapping[str, float], name: str = "blend"
) -> DataFrame:
    """Weighted sum of aligned columns, left to right."""
    return wide.withColumn(name, weighted_sum([(w, c) for c, w in weights.items()]))


def grid_weights(start: float, stop: float, points: int):
    """Weights start + i * step as doubles (numpy linspace arithmetic)."""
    step = (stop - start) / (points - 1)
    return [F.lit(float(start)) + F.lit(float(i)) * F.lit(step) for i in range(points)]


def two_model_grid(
    wide: DataFrame,
    first: str,
    second: str,
    label: str = "target",
    start: float = 0.5,
    stop: float = 1.0,
    points: int = 11,
) -> DataFrame:
    """B2: AUC of w*first + (1-w)*second for each grid weight; O4 flags the
    best, the earliest weight on a tie. Rows are replicated by the grid size
    (a parameter), never paired with each other."""
    weights = F.explode(F.array(*grid_weights(start, stop, points))).alias("weight")
    expanded = wide.select(label, first, second, weights)
    scored = expanded.select(
        "weight",
        label,
        (F.col("weight") * F.col(first) + (1.0 - F.col("weight")) * F.col(second)).alias("_s"),
    )
    return auc(scored, "_s", label, by=["weight"])


def mark_best(grid: DataFrame, metric: str = "auc", key: str = "weight") -> DataFrame:
    """Flag the first best row (highest metric, smallest key). One window
    over the grid, whose rows are a parameter; the search runs once."""
    best = F.min_by(key, F.struct(-F.col(metric), F.col(key))).over(Window.partitionBy(F.lit(0)))
    return grid.select("*", F.coalesce(F.col(key) == best, F.lit(False)).alias("is_best"))


def ratio_mixes(
    wide: DataFrame, final: str, current: str, ratios: Sequence[float], label: str = "target"
) -> DataFrame:
    """AUC of r*final + (1-r)*current for each ratio (raw inputs)."""
    ratio = F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio")
    mixed = wide.select(label, final, current, ratio).select(
        "ratio",
        label,
        (F.col("ratio") * F.col(final) + (1.0 - F.col("ratio")) * F.col(current)).alias("_s"),
    )
    return auc(mixed, "_s", label, by=["ratio"])


def mixed_outputs(
    wide: DataFrame, final: str, current: str, ratios: Sequence[float], key: str = "id"
) -> DataFrame:
    """r*final + (1-r)*current for each ratio and id."""
    ratio = F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio")
    mixed = F.col("ratio") * F.col(final) + (1.0 - F.col("ratio")) * F.col(current)
    return wide.select(key, final, current, ratio).select("ratio", key, mixed.alias("mixed"))


def simplex(n: int, step_count: int) -> list[tuple[int, ...]]:
    """Integer compositions of ``step_count`` into ``n`` parts (weights are
    parts / step_count)."""
    if n == 1:
        return [(step_count,)]
    return [(k, *rest) for k in range(step_count + 1) for rest in simplex(n - 1, step_count - k)]


def simplex_search(
    wide: DataFrame, columns: Sequence[str], step_count: int = 10, label: str = "target"
) -> DataFrame:
    """AUC of every simplex weight vector (step 1/step_count)."""
    combos = simplex(len(columns), step_count)
    structs = [
        F.struct(*[F.lit(k).alias(f"k{i}") for i, k in enumerate(c)]) for c in combos
    ]
    expanded = wide.select(label, *columns, F.explode(F.array(*structs)).alias("_w"))
    score = None
    for i, c in enumerate(columns):
        term = (F.col(f"_w.k{i}").cast("double") / step_count) * F.col(c)
        score = term if score is None else score + term
    keyed = expanded.select(
        *[F.col(f"_w.k{i}").alias(f"w_{c}") for i, c in enumerate(columns)],
        label,
        score.alias("_s"),
    )
    return auc(keyed, "_s", label, by=[f"w_{c}" for c in columns])
