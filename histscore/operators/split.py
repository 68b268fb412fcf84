"""P2/P3 folds, A10 quantile border, S4 partitioned rewrite, S15 union."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histscore.functions.scalar import fold
from histscore.operators.ordering import running_totals


def with_fold(df: DataFrame, folds: int = 10, id_col: str = "id") -> DataFrame:
    """Persistable fold column (``pmod`` is not pushed into Parquet, a
    stored ``fold`` column is)."""
    return df.withColumn("fold", fold(id_col, folds).cast("int"))


def quantile_border(df: DataFrame, q: float = 0.9, id_col: str = "id") -> float:
    """A10: exact linearly interpolated quantile of the ids (one number):
    the two neighbours of rank ``q * (n - 1)``, found by the running counts
    of the distinct values."""
    values = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_c"))
    counted = running_totals(values, [id_col], ["_c"], totals_prefix="_all")
    rank = F.lit(q) * (F.col("_all_c") - 1)
    low, high = F.floor(rank), F.ceil(rank)
    holds = lambda r: (F.col("before__c") <= r) & (r < F.col("before__c") + F.col("_c"))
    row = counted.agg(
        F.max(F.when(holds(low), F.col(id_col))).cast("double").alias("low"),
        F.max(F.when(holds(high), F.col(id_col))).cast("double").alias("high"),
        F.max(rank - low).alias("share"),
    ).first()
    return None if row["low"] is None else row["low"] + (row["high"] - row["low"]) * row["share"]


def temporal_fold(df: DataFrame, q: float = 0.9, id_col: str = "id") -> tuple[DataFrame, float]:
    """Rows with ``id >= quantile(id, q)``; the border is a literal, so
    the filter reaches the Parquet scan."""
    border = quantile_border(df, q, id_col)
    dtype = df.schema[id_col].dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        # id >= 13499.1 is id >= 13500 for integers; a literal of the
        # column's type keeps the predicate pushable (no cast on the column).
        bound = F.lit(math.ceil(border)).cast(dtype)
    else:
        bound = F.lit(border)
    return df.where(F.col(id_col) >= bound), border


def partition_by_mod(df: DataFrame, parts: int, path: str, id_col: str = "id") -> None:
    """Rewrite into ``part = id mod P`` folders. No shuffle: every task
    writes its own rows into at most P files, so one part is never funnelled
    through a single writer (Spark's exchange makes the reference's manual
    hash parts unnecessary for later joins anyway)."""
    (
        df.withColumn("part", F.pmod(F.col(id_col), F.lit(parts)).cast("int"))
        .sortWithinPartitions("part")
        .write.mode("overwrite")
        .partitionBy("part")
        .parquet(path)
    )
