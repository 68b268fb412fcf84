"""Running totals in a global order, without funnelling rows into one task.

A window ``orderBy`` with no ``partitionBy`` sends every row to one task.
Here the order is cut into ranges instead. The input is evaluated once, into
a table in the shared folder; the JVM-only steps read that table:

1. a few hundred boundaries, the quantiles of the keys of smallest hash (a
   deterministic sample of bounded size), become literals; a row's range is
   found by a balanced tree of literal comparisons, so every evaluation of
   the plan deals the rows alike;
2. a window per (range, group) gives the running sums inside the range;
3. one row per (range, group) gives the offsets, joined back on the same key.

The join key is a struct, so null groups meet like any other. Every step is
exact; the sample only decides how balanced the ranges are.
``block_running_totals`` is the variant for an integer axis (fixed blocks, no
sampling), and ``number_within`` numbers rows inside entities.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histscore.session import scratch_path

# Broadcast bound of ``join_small``, in rows.
MAX_BROADCAST_ROWS = 200_000
# Ranges at most, and sampled keys per range.
MAX_RANGES = 512
SAMPLE_PER_RANGE = 32
# Rows of a part whose sort is kept in memory.
PART_ROWS = 500_000
KEY = "_range_key"


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join with a side that is small by construction, broadcasting it only
    after counting it (the count stops at ``max_rows + 1``); above the bound
    it is an ordinary shuffled join."""
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on=on, how=how)
    return big.join(small, on=on, how=how)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: whatever made them runs once,
    and its readers survive lost executors. Select the columns needed first."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return df
    path = scratch_path(df.sparkSession, f"ordered/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sum_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return T.LongType()
    if isinstance(dtype, T.DecimalType):
        return T.DecimalType(38, dtype.scale)
    return T.DoubleType()


def range_bounds(df: DataFrame, key_cols: Sequence[str], ranges: int) -> list[tuple]:
    """At most ``ranges - 1`` ascending keys that cut ``df`` evenly: quantiles
    of the ``ranges * SAMPLE_PER_RANGE`` keys of smallest hash."""
    if ranges <= 1:
        return []
    size = ranges * SAMPLE_PER_RANGE
    picked = df.select(*key_cols).orderBy(F.xxhash64(*key_cols), *key_cols).limit(size)
    rows = picked.orderBy(*key_cols).collect()
    cuts = [rows[len(rows) * k // ranges] for k in range(1, ranges)] if rows else []
    return list(dict.fromkeys(tuple(r) for r in cuts))


def range_of(df: DataFrame, key_cols: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """Number of bounds that are not above the row's key (nulls first)."""
    types = [df.schema[c].dataType for c in key_cols]
    key = F.struct(*[F.col(c) for c in key_cols])

    def literal(bound: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(bound, types, key_cols)])

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < literal(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def running_totals(
    df: DataFrame,
    order_cols: Sequence[str],
    values: Sequence[str],
    group_cols: Sequence[str] = (),
    ranges: int | None = None,
    prefix: str = "before_",
    totals_prefix: str | None = None,
) -> DataFrame:
    """Add ``{prefix}{v}``: the sum of ``v`` over rows strictly before this
    row in ``order_cols`` order within ``group_cols``. ``order_cols`` must be
    a total order inside each group; null keys and null groups are ordinary
    (first) values. With ``totals_prefix`` the group totals are added."""
    order_cols, values, group_cols = list(order_cols), list(values), list(group_cols)
    df = stored(df)
    types = {v: _sum_type(df.schema[v].dataType) for v in values}
    keys = group_cols + order_cols
    if ranges is None:
        ranges = min(MAX_RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = range_bounds(df, keys, ranges)
    keyed = df.withColumn(
        KEY, F.struct(range_of(df, keys, bounds).alias("_range"), *[F.col(c).alias(f"_g_{c}") for c in group_cols])
    )

    def total(v: str, over=None) -> Column:
        s = F.sum(v) if over is None else F.sum(v).over(over)
        return F.coalesce(s, F.lit(0)).cast(types[v])

    inside = Window.partitionBy(KEY).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.select("*", *[total(v, inside).alias(f"_l_{v}") for v in values])
    totals = keyed.groupBy(KEY).agg(*[total(v).alias(f"_t_{v}") for v in values])
    # At most ranges + groups rows: a group has a row in each range it reaches.
    groups = [F.col(f"{KEY}._g_{c}") for c in group_cols]
    earlier = Window.partitionBy(*groups).orderBy(F.col(f"{KEY}._range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        KEY,
        *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).cast(types[v]).alias(f"_o_{v}") for v in values],
        *[
            F.sum(f"_t_{v}").over(Window.partitionBy(*groups)).cast(types[v]).alias(f"{totals_prefix}{v}")
            for v in (values if totals_prefix is not None else [])
        ],
    )
    # A merge join keeps the window output where it is: it is partitioned and
    # sorted by the key already; only the offsets move.
    joined = local.join(offsets.hint("merge"), KEY)
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{v}") + F.col(f"_o_{v}")).cast(types[v]).alias(f"{prefix}{v}") for v in values],
        *([F.col(f"{totals_prefix}{v}") for v in values] if totals_prefix is not None else []),
    )


def global_row_number(
    df: DataFrame,
    order_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    ranges: int | None = None,
    name: str = "row_number",
    count_name: str | None = None,
) -> DataFrame:
    """1-based row number in ``order_cols`` order inside ``group_cols``
    (two-level, exact); optionally the group size as ``count_name``."""
    numbered = running_totals(
        df.withColumn("_one", F.lit(1).cast("long")),
        order_cols,
        ["_one"],
        group_cols,
        ranges=ranges,
        prefix="_rn_",
        totals_prefix="_n_" if count_name else None,
    )
    cols = [*df.columns, (F.col("_rn__one") + 1).alias(name)]
    if count_name:
        cols.append(F.col("_n__one").alias(count_name))
    return numbered.select(*cols)


def rank_percentile(
    df: DataFrame,
    score: str,
    tiebreak: str,
    group_cols: Sequence[str] = (),
    name: str = "rank_pct",
    ranges: int | None = None,
) -> DataFrame:
    """``(row_number - 1) / max(n - 1, 1)`` with ties broken by
    ``tiebreak`` (input order in the reference: id on validation, sample
    order on test)."""
    numbered = global_row_number(
        df,
        [score, tiebreak],
        group_cols,
        ranges=ranges,
        name="_rn",
        count_name="_n",
    )
    return numbered.select(
        *df.columns,
        ((F.col("_rn") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).alias(name),
    )


BLOCK = "_block"
# Blocks under one entry of the second level of offsets.
SUPER = 4096


def block_running_totals(
    df: DataFrame,
    pos_col: str,
    order_cols: Sequence[str],
    values: Sequence[str],
    block_size: int,
    prefix: str = "before_",
    totals_prefix: str | None = None,
) -> DataFrame:
    """``running_totals`` for an integer axis, cut into fixed blocks of
    ``block_size`` positions instead of sampled ranges.

    The blocks are a pure function of the position: one shuffle by block
    feeds a window (running sum inside the block). The offsets have two
    levels, blocks within a super-block of ``SUPER`` blocks and super-blocks,
    so the one window over the whole axis has a row per ``SUPER *
    block_size`` positions. ``order_cols`` must start with ``pos_col`` and be
    a total order.
    """
    order_cols, values = list(order_cols), list(values)
    df = stored(df)
    types = {v: _sum_type(df.schema[v].dataType) for v in values}
    keyed = df.withColumn(BLOCK, F.floor(F.col(pos_col) / F.lit(block_size)).cast("long"))
    inside = Window.partitionBy(BLOCK).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)

    def before(column: str, v: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0)).cast(types[v])

    local = keyed.select("*", *[before(v, v, inside).alias(f"_l_{v}") for v in values])
    blocks = keyed.groupBy(BLOCK).agg(*[F.sum(v).cast(types[v]).alias(f"_t_{v}") for v in values])
    blocks = blocks.withColumn("_super", F.floor(F.col(BLOCK) / SUPER))
    supers = blocks.groupBy("_super").agg(*[F.sum(f"_t_{v}").cast(types[v]).alias(f"_s_{v}") for v in values])
    earlier = Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(
        "_super",
        *[before(f"_s_{v}", v, earlier).alias(f"_p_{v}") for v in values],
        *[
            F.sum(f"_s_{v}").over(Window.partitionBy()).cast(types[v]).alias(f"{totals_prefix}{v}")
            for v in (values if totals_prefix is not None else [])
        ],
    )
    within = Window.partitionBy("_super").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(BLOCK, "_super", *[before(f"_t_{v}", v, within).alias(f"_b_{v}") for v in values])
    offsets = offsets.join(supers, "_super").drop("_super")
    # A merge join keeps the (large) window output where it is: it is already
    # partitioned and sorted by block, so only the offsets move.
    joined = local.join(offsets.hint("merge"), BLOCK)
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{v}") + F.col(f"_b_{v}") + F.col(f"_p_{v}")).cast(types[v]).alias(f"{prefix}{v}") for v in values],
        *([F.col(f"{totals_prefix}{v}") for v in values] if totals_prefix is not None else []),
    )


def in_parts(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into parts of about ``PART_ROWS`` of its
    ``rows``, so that a part's sort stays in memory whatever the size; left to
    the session's own partitions where these are enough."""
    parts = -(-rows // PART_ROWS)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(parts, *keys)


def number_within(
    df: DataFrame,
    key: str,
    order_cols: Sequence[str],
    name: str = "rn",
    split: bool = False,
    ranges: int | None = None,
    previous: Sequence[str] = (),
) -> DataFrame:
    """Dense 1..N position of each row inside its ``key`` group.

    A ``row_number`` window per key, which streams a sorted group and spills;
    it reads its input once. ``split`` numbers in ranges instead, which
    shares one huge group among tasks at the price of reading it again. The
    same window gives ``<f>__prev`` of the ``previous`` columns, without a
    sort of their own."""
    if split:
        if previous:
            raise ValueError("ranges do not keep the previous row")
        numbered = global_row_number(df, order_cols, [key], ranges=ranges, name=name)
        return numbered.withColumn(name, F.col(name).cast("int"))
    w = Window.partitionBy(key).orderBy(*order_cols)
    return df.select(
        *df.columns,
        F.row_number().over(w).cast("int").alias(name),
        *[F.lag(f).over(w).alias(f"{f}__prev") for f in previous],
    )
