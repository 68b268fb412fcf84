"""A1-A6 history aggregates and H1-H14 engineered history features.

Inputs are history tables ``(id, rn, fields...)`` with ``rn`` an ascending
position per id (gaps allowed). Everything is one ``groupBy('id')`` (partial
hash aggregation, so a hot id is pre-combined on the map side). Features that
need a previous row use a ``lag`` per id (``with_previous``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history_aggregate(df: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """A1-A5: loan_count, rn_max, ``<f>__mean`` and ``<f>__max`` per id."""
    return df.groupBy(id_col).agg(*aggregate_columns(fields))


def aggregate_columns(fields: Sequence[str], prefix: str = "") -> list[Column]:
    """The columns of ``history_aggregate``."""
    exprs = [
        F.count(F.lit(1)).alias(f"{prefix}loan_count"),
        F.max("rn").alias(f"{prefix}rn_max"),
    ]
    exprs += [F.avg(f).alias(f"{prefix}{f}__mean") for f in fields]
    exprs += [F.max(f).alias(f"{prefix}{f}__max") for f in fields]
    return exprs


def first_pos_count(df: DataFrame, pos_col: str = "pos", id_col: str = "id") -> DataFrame:
    """Distinct ids with the first global position and the row count."""
    return df.groupBy(id_col).agg(
        F.min(pos_col).alias("first_pos"), F.count(F.lit(1)).alias("n")
    )


def last_n(df: DataFrame, n: int, order: Sequence[str] = ("rn",), id_col: str = "id") -> DataFrame:
    """Position from the end (1 = latest) and keep the last ``n``.
    The ``<= n`` filter on ``row_number`` becomes a WindowGroupLimit that
    also runs before the shuffle, so a hot id sends at most ``n`` rows per
    map partition."""
    w = Window.partitionBy(id_col).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("pos_desc", F.row_number().over(w)).where(F.col("pos_desc") <= n)


def last_values(df: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """H1: fields of the latest row by rn."""
    latest = F.max_by(F.struct(*fields), "rn")
    return df.groupBy(id_col).agg(latest.alias("_l")).select(
        id_col, *[F.col(f"_l.{f}").alias(f"{f}__last") for f in fields]
    )


def last_k_mean(df: DataFrame, fields: Sequence[str], k: int = 3, id_col: str = "id") -> DataFrame:
    """H2: mean of the ``k`` most recent rows."""
    recent = last_n(df, k, id_col=id_col)
    return recent.groupBy(id_col).agg(*[F.avg(f).alias(f"{f}__last{k}") for f in fields])


def dispersion(df: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """H3: sample standard deviation (null for a single row)."""
    return df.groupBy(id_col).agg(*[F.stddev_samp(f).alias(f"{f}__std") for f in fields])


def payment_summary(
    df: DataFrame, state: str = "state", overdue: str = "overdue", id_col: str = "id"
) -> DataFrame:
    """H4: payment-state and overdue summaries."""
    return df.groupBy(id_col).agg(
        F.sum(state).cast("long").alias("state__sum"),
        F.max(state).alias("state__max"),
        F.avg(state).alias("state__mean"),
        F.sum(overdue).cast("long").alias("overdue__sum"),
        F.avg(overdue).alias("overdue__mean"),
        F.max_by(state, "rn").alias("state__last"),
    )


def category_frequencies(
    df: DataFrame, column: str, values: Sequence, prefix: str | None = None, id_col: str = "id"
) -> DataFrame:
    """H5-H7: share of rows per category value (the vocabulary is a
    parameter, e.g. collected once from a small dimension) and of all other
    values, null included, so the shares add up to 1."""
    prefix = prefix or column
    n = F.count(F.lit(1))
    exprs = [
        (F.count_if(F.col(column) == F.lit(v)) / n).alias(f"{prefix}__freq_{_safe(v)}")
        for v in values
    ]
    exprs.append((F.count_if(other_value(column, values)) / n).alias(f"{prefix}__freq_other"))
    return df.groupBy(id_col).agg(*exprs)


def other_value(column: str, values: Sequence) -> Column:
    """True for null and for values outside the vocabulary."""
    return F.coalesce(~F.col(column).isin(list(values)), F.lit(True))


def _safe(value) -> str:
    text = str(value)
    return "".join(ch if ch.isalnum() else "_" for ch in text)


def with_previous(df: DataFrame, fields: Sequence[str], id_col: str = "id", rn: str = "rn") -> DataFrame:
    """H9 building block: each row with the previous row's fields
    (``<f>__prev``, null on the first row), by ``rn`` order; ``rn`` may have
    gaps. The window is partitioned like the numbering before it, so it adds
    a sort but no shuffle, and its buffer spills. Columns that the numbering
    has brought already (``number_within(previous=...)``) are kept."""
    w = Window.partitionBy(id_col).orderBy(rn)
    return df.select("*", *[F.lag(f).over(w).alias(f"{f}__prev") for f in fields if f"{f}__prev" not in df.columns])


def deltas(df: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """H9: last minus first value and the value before the last."""
    exprs = []
    for f in fields:
        exprs.append((F.max_by(f, "rn") - F.min_by(f, "rn")).alias(f"{f}__delta"))
    paired = with_previous(df, fields, id_col)
    exprs += [F.max_by(f"{f}__prev", "rn").alias(f"{f}__prev_last") for f in fields]
    return paired.groupBy(id_col).agg(*exprs)


def trend(df: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """Slope over rn, total variation and number of changes."""
    paired = with_previous(df, fields, id_col)
    exprs = []
    for f in fields:
        step = F.col(f) - F.col(f"{f}__prev")
        exprs += [
            F.regr_slope(f, "rn").alias(f"{f}__slope"),
            F.coalesce(F.sum(F.abs(step)), F.lit(0)).alias(f"{f}__tv"),
            F.count_if(F.col(f) != F.col(f"{f}__prev")).alias(f"{f}__changes"),
        ]
    return paired.groupBy(id_col).agg(*exprs)


def transitions(
    df: DataFrame, state: str, states: Sequence[int], id_col: str = "id"
) -> DataFrame:
    """Counts of each (previous state, state) pair and the entropy of
    the state frequencies (nats)."""
    paired = with_previous(df, [state], id_col)
    prev = F.col(f"{state}__prev")
    exprs = [
        F.count_if((prev == a) & (F.col(state) == b)).alias(f"{state}__t{a}{b}")
        for a in states
        for b in states
    ]
    n = F.count(F.lit(1))
    shares = [F.count_if(F.col(state) == s) / n for s in states]
    entropy = None
    for p in shares:
        term = F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0))
        entropy = term if entropy is None else entropy + term
    exprs.append(entropy.alias(f"{state}__entropy"))
    return paired.groupBy(id_col).agg(*exprs)


def _last_flagged(flag: str, id_col: str) -> Column:
    return F.max(F.when(F.col(flag) > 0, F.col("rn"))).over(Window.partitionBy(id_col))


def since_last_flag(df: DataFrame, flag: str = "overdue", id_col: str = "id") -> DataFrame:
    """Rows after the latest flagged row (null if none was flagged);
    counts rows, so ``rn`` may have gaps."""
    marked = df.withColumn("_flagged", _last_flagged(flag, id_col))
    after = F.count_if(F.col("rn") > F.col("_flagged"))
    return marked.groupBy(id_col).agg(F.when(F.max("_flagged").isNotNull(), after).alias(f"since_{flag}"))


def by_category(
    df: DataFrame,
    category: str,
    values: Sequence,
    mean_of: str,
    sum_of: str,
    id_col: str = "id",
) -> DataFrame:
    """Per-category mean of one field and sum of another, and the same
    for all other values."""
    exprs = []
    hits = [(_safe(v), F.col(category) == F.lit(v)) for v in values]
    for tag, hit in [*hits, ("other", other_value(category, values))]:
        exprs += [
            F.avg(F.when(hit, F.col(mean_of))).alias(f"{mean_of}__mean_{tag}"),
            F.sum(F.when(hit, F.col(sum_of)).otherwise(0)).cast("long").alias(f"{sum_of}__sum_{tag}"),
        ]
    return df.groupBy(id_col).agg(*exprs)


def wide_features(
    df: DataFrame,
    fields: Sequence[str],
    category: str,
    categories: Sequence,
    state: str,
    states: Sequence[int],
    overdue: str,
    util: str,
    id_col: str = "id",
    also: Sequence[Column] = (),
) -> DataFrame:
    """The combined table in one aggregate pass over the history joined
    to its previous row; ``also`` are further aggregates of the same pass."""
    n = F.count(F.lit(1))
    plain = [
        n.alias("loan_count"),
        F.max("rn").alias("rn_max"),
    ]
    for f in fields:
        plain += [
            F.avg(f).alias(f"{f}__mean"),
            F.max(f).alias(f"{f}__max"),
            F.stddev_samp(f).alias(f"{f}__std"),
            F.max_by(f, "rn").alias(f"{f}__last"),
            (F.max_by(f, "rn") - F.min_by(f, "rn")).alias(f"{f}__delta"),
            F.regr_slope(f, "rn").alias(f"{f}__slope"),
        ]
    hits = [(_safe(v), F.col(category) == F.lit(v)) for v in categories]
    for tag, hit in [*hits, ("other", other_value(category, categories))]:
        plain.append((F.count_if(hit) / n).alias(f"{category}__freq_{tag}"))
        plain.append(F.avg(F.when(hit, F.col(util))).alias(f"{util}__mean_{tag}"))
    for s in states:
        plain.append((F.count_if(F.col(state) == s) / n).alias(f"{state}__freq_{s}"))
    plain.append((F.count_if(other_value(state, states)) / n).alias(f"{state}__freq_other"))
    after = F.count_if(F.col("rn") > F.col("_flagged"))
    plain.append(F.when(F.max("_flagged").isNotNull(), after).alias(f"since_{overdue}"))
    df = df.withColumn("_flagged", _last_flagged(overdue, id_col))
    paired = with_previous(df, list(dict.fromkeys([state, *fields])), id_col)
    seq = []
    for f in fields:
        seq += [
            F.coalesce(F.sum(F.abs(F.col(f) - F.col(f"{f}__prev"))), F.lit(0)).alias(f"{f}__tv"),
            F.count_if(F.col(f) != F.col(f"{f}__prev")).alias(f"{f}__changes"),
        ]
    prev = F.col(f"{state}__prev")
    seq += [
        F.count_if((prev == a) & (F.col(state) == b)).alias(f"{state}__t{a}{b}")
        for a in states
        for b in states
    ]
    # One aggregate over the self-joined rows: the left side carries every
    # history row, so the plain aggregates come from the same pass.
    return paired.groupBy(id_col).agg(*plain, *seq, *also)


def select_rounded(df: DataFrame, digits: int = 6, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Round fractional columns (for cross-engine comparison)."""
    cols: list[Column] = []
    for f in df.schema.fields:
        if f.name in keep:
            cols.append(F.col(f.name))
        elif f.dataType.typeName() in ("double", "float"):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
