"""C1-C7 contracts, each a query whose result states whether it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ContractError(f"key {list(keys)} is not unique")


def missing_keys(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``required`` without a partner in ``present``."""
    return required.select(*keys).join(present.select(*keys), list(keys), "left_anti")


def alignment_report(
    left: DataFrame, right: DataFrame, key: str, compare: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """One row (per ``by``, e.g. the model) counting ids only on the
    left, only on the right, and ids whose ``compare`` columns differ
    (null-safe)."""
    keys = [*by, key]
    lcols = [F.col(c) for c in keys] + [F.col(c).alias(f"_l_{c}") for c in compare] + [F.lit(1).alias("_l")]
    rcols = [F.col(c) for c in keys] + [F.col(c).alias(f"_r_{c}") for c in compare] + [F.lit(1).alias("_r")]
    both = left.select(*lcols).join(right.select(*rcols), keys, "full_outer")
    differ = F.lit(False)
    for c in compare:
        differ = differ | ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))
    return both.groupBy(*by).agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & differ).alias("differ"),
    )


def row_count_report(df: DataFrame, expected: int, by: Sequence[str] = ()) -> DataFrame:
    """C4: the row count (per ``by``) against its expectation."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(expected).cast("long").alias("expected"),
    ).withColumn("ok", F.col("rows") == F.col("expected"))


def order_report(output: DataFrame, sample: DataFrame, key: str, ord_col: str) -> DataFrame:
    """Output rows whose (ord, id) pair is not the sample's."""
    joined = output.select(ord_col, F.col(key).alias("_out")).join(
        sample.select(ord_col, F.col(key).alias("_sample")), ord_col, "full_outer"
    )
    return joined.agg(
        F.count(F.lit(1)).alias("positions"),
        F.count_if(~F.col("_out").eqNullSafe(F.col("_sample"))).alias("mismatched"),
    )


def range_report(df: DataFrame, column: str, lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """Counts of null, NaN/infinite and out-of-range predictions."""
    c = F.col(column)
    finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(c.isNull()).alias("nulls"),
        F.count_if(c.isNotNull() & ~finite).alias("not_finite"),
        F.count_if(c.isNotNull() & finite & ~c.between(lower, upper)).alias("out_of_range"),
    )
