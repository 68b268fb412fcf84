"""Target-rate priors over an ordered integer key (the id axis).

A sum over a window of the key is the difference of two prefix sums. The axis
is cut into blocks of positions; a block gets its queries and the labels of a
halo on each side, as far as a window reaches. There the prefix sums stand in
a dense array, and a query reads the edges of all its windows by index. One
shuffle brings labels and queries together; a label goes to a bounded number
of blocks (``HALO``) per width, and a block's size is set by the parameters,
not by the data. Clipping windows to the axis cannot change a sum (no label
lies outside), so it is implied.

The arrays are read with numpy in ``mapInArrow``: built-in functions have no
dense scatter into an array. All else is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histscore.functions.scalar import log_density, smoothed_rate
from histscore.operators.ordering import block_running_totals, running_totals

LABEL, QUERY = 0, 1
# Least positions of a block, and blocks of a window's reach.
BLOCK_SIZE = 1 << 12
HALO = 4
# Queries answered together.
CHUNK = 2048


def included_labels(labels: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Labels whose id is not excluded (left anti join)."""
    if excluded is None:
        return labels
    return labels.join(excluded.select("id").distinct(), "id", "left_anti")


def unique_labels(labels: DataFrame) -> DataFrame:
    """One row per label id; a repeated id counts once, with its largest
    flag. A null id is on no axis."""
    return labels.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("flag").alias("flag"))


def window_sums(
    labels: DataFrame,
    queries: DataFrame,
    windows: Sequence[tuple[int, Sequence[int]]],
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """For each query id and each (width, offsets) of ``windows``: ``sums`` and
    ``counts`` of the labels between consecutive offsets from the id, as
    arrays. ``queries`` is (id, own); ``own`` is handed on. Null ids are on no
    axis."""
    offsets = [np.array(o, np.int64) for _, o in windows]
    sizes = [max(block_size, int(o[-1] - o[0]) // HALO) for o in offsets]
    specs = list(enumerate(zip(offsets, sizes)))

    def reached(spec, offsets, size):
        first = F.floor((F.col("pos") - int(offsets[-1]) + 1) / size).cast("long")
        last = F.floor((F.col("pos") - int(offsets[0])) / size).cast("long")
        return F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(spec).alias("spec"), b.alias("block")))

    def own_block(spec, size):
        return F.struct(F.lit(spec).alias("spec"), F.floor(F.col("pos") / size).cast("long").alias("block"))

    label_rows = unique_labels(labels).select(F.col("id").cast("long").alias("pos"), F.col("flag").cast("long").alias("y"))
    label_rows = label_rows.select(F.inline(F.flatten(F.array(*[reached(k, o, b) for k, (o, b) in specs]))), F.lit(LABEL).alias("kind"), "pos", "y")
    query_rows = queries.where("id is not null").select(F.col("id").cast("long").alias("pos"), F.col("own").cast("long").alias("y"))
    query_rows = query_rows.select(F.inline(F.array(*[own_block(k, b) for k, (_, b) in specs])), F.lit(QUERY).alias("kind"), "pos", "y")
    laid = label_rows.unionByName(query_rows).repartition("spec", "block").sortWithinPartitions("spec", "block", "kind", "pos")
    widths = [w for w, _ in windows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            spec, at, kind, pos = (batch.column(k).to_numpy() for k in range(4))
            change = np.flatnonzero((np.diff(spec) != 0) | (np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            cuts = [0, *change.tolist(), len(spec)] if len(spec) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if (spec[lo], at[lo]) != key:
                    key = (spec[lo], at[lo])
                    block = _Block(offsets[spec[lo]], sizes[spec[lo]], int(at[lo]))
                if kind[lo] == LABEL:
                    block.add(pos[lo:hi], batch.column(4).slice(lo, hi - lo).to_numpy())
                    continue
                for k in range(lo, hi, CHUNK):
                    n = min(CHUNK, hi - k)
                    sums, counts = block.between(pos[k : k + n])
                    width = pa.array(np.full(n, widths[spec[lo]], np.int32))
                    columns = [pa.array(pos[k : k + n]), width, batch.column(4).slice(k, n), _lists(sums), _lists(counts)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "width", "own", "sums", "counts"])

    return laid.mapInArrow(run, "id long, width int, own long, sums array<long>, counts array<long>")


class _Block:
    """Labels around a block as dense prefix sums."""

    def __init__(self, offsets: np.ndarray, size: int, block: int):
        self.offsets = offsets
        self.low = block * size + int(offsets[0])
        self.cells = np.zeros((2, size + int(offsets[-1] - offsets[0]) + 1), np.int64)
        self.prefix = None

    def add(self, pos: np.ndarray, y: np.ndarray) -> None:
        at = pos - self.low + 1
        self.cells[0, at] += y
        self.cells[1, at] += 1

    def between(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.prefix is None:
            self.prefix = np.cumsum(self.cells, axis=1)
        edges = (ids - self.low)[:, None] + self.offsets
        return np.diff(self.prefix[0][edges], axis=1), np.diff(self.prefix[1][edges], axis=1)


def _lists(rows: np.ndarray) -> pa.Array:
    places = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(rows.reshape(-1)))


def base_rate(labels: DataFrame):
    """The labels' mean target as a scalar subquery; null without labels."""
    counted = unique_labels(labels).agg(F.sum("flag").cast("long").alias("y"), F.count(F.lit(1)).alias("c"))
    return counted.select(F.try_divide("y", "c").alias("base")).scalar()


def prefix_table(
    labels: DataFrame, ranges: int | None = None, block_size: int = BLOCK_SIZE
) -> DataFrame:
    """At every label position, the sums of targets and counts over ids
    strictly below it, plus the end row (``max_id + 1``) with the totals."""
    rows = unique_labels(labels).select(
        F.col("id").cast("long").alias("pos"), F.col("flag").cast("long").alias("y"), F.lit(1).cast("long").alias("c")
    )
    if ranges is None:
        totals = block_running_totals(rows, "pos", ["pos"], ["y", "c"], block_size, totals_prefix="tot_")
    else:
        totals = running_totals(
            rows, ["pos"], ["y", "c"], ranges=ranges, prefix="before_", totals_prefix="tot_"
        )
    body = totals.select(
        "pos", F.col("before_y").alias("sum_before"), F.col("before_c").alias("count_before")
    )
    end = unique_labels(labels).agg(
        (F.max("id") + 1).cast("long").alias("pos"),
        F.sum("flag").cast("long").alias("sum_before"),
        F.count(F.lit(1)).alias("count_before"),
    )
    return body.unionByName(end)


def centred_prior(
    labels: DataFrame, queries: DataFrame, half_width: int, smoothing: float, block_size: int = BLOCK_SIZE
) -> DataFrame:
    """Smoothed target rate of the labels in ``[q-h, q+h]`` for
    each query id; the base rate is the mean of the given labels (after any
    exclusion, K9)."""
    q = queries.select("id").distinct().withColumn("own", F.lit(None).cast("long"))
    found = window_sums(labels, q, [(0, (-half_width, half_width + 1))], block_size)
    return found.select(
        "id", F.col("sums")[0].alias("window_sum"), F.col("counts")[0].alias("window_count")
    ).withColumn("prior", smoothed_rate("window_sum", "window_count", base_rate(labels), smoothing))


def scaled_widths(widths: Sequence[int], scale: float, least: int = 4) -> list[int]:
    """Bin widths times a scale, rounded half to even, ``least`` at
    least; widths that meet count once."""
    return list(dict.fromkeys(max(least, round(w * scale)) for w in widths))


def bin_arrays(
    labels: DataFrame,
    queries: DataFrame,
    widths: Sequence[int],
    half_bins: int,
    own_targets: DataFrame | None = None,
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """W6-W7 (id, width, sums, counts), the arrays in bin order: for width w,
    edge j in [-H, H+1] sits at q + j*w - w//2; bin j spans edge j to edge j+1
    (K6). With ``own_targets`` (id, flag) the query's own label, carried on its
    row, leaves the centre bin."""
    q = queries.select("id").distinct()
    if own_targets is None:
        q = q.withColumn("own", F.lit(None).cast("long"))
    else:
        q = q.join(unique_labels(own_targets).select("id", F.col("flag").alias("own")), "id", "left")
    windows = [(w, [j * w - w // 2 for j in range(-half_bins, half_bins + 2)]) for w in widths]
    found = window_sums(labels, q, windows, block_size)

    def without(column: str, less):
        return F.transform(column, lambda v, k: F.when((k == half_bins) & F.col("own").isNotNull(), v - less).otherwise(v)).alias(column)

    if own_targets is None:
        return found.select("id", "width", "sums", "counts")
    return found.select("id", "width", without("sums", F.col("own")), without("counts", F.lit(1)))


def multi_scale_bins(
    labels: DataFrame,
    queries: DataFrame,
    widths: Sequence[int],
    half_bins: int,
    smoothing: float = 5.0,
    own_targets: DataFrame | None = None,
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """Long form ``(id, width, bin, sum, count, rate_c,
    density)`` of ``bin_arrays``; ``rate_c`` = smoothed rate minus base rate."""
    arrays = bin_arrays(labels, queries, widths, half_bins, own_targets, block_size)
    base = base_rate(labels)
    bins = arrays.select("id", "width", F.posexplode(F.arrays_zip("sums", "counts")).alias("_p", "_v")).select(
        "id", "width", (F.col("_p") - half_bins).alias("bin"), F.col("_v.sums").alias("sum"), F.col("_v.counts").alias("count")
    )
    return bins.select(
        "*",
        (smoothed_rate("sum", "count", base, smoothing) - base).alias("rate_c"),
        log_density("count", "width").alias("density"),
    )


def pooled_bins(bins: DataFrame, value: str = "rate_c") -> DataFrame:
    """Centre, mean and max of the bins of each (id, width)."""
    return bins.groupBy("id", "width").agg(
        F.max(F.when(F.col("bin") == 0, F.col(value))).alias(f"{value}_centre"),
        F.avg(value).alias(f"{value}_mean"),
        F.max(value).alias(f"{value}_max"),
    )


def feature_array(bins: DataFrame, channels: Sequence[str] = ("rate_c", "density")) -> DataFrame:
    """The per-query feature vector (widths x channels x bins, the
    reference's channel layout) as one array; its length is fixed by the
    parameters, not by the data."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(i).alias("ch"), F.col(c).cast("double").alias("v")) for i, c in enumerate(channels)])
    )
    long = bins.select("id", "width", "bin", cells.alias("_c"))
    keyed = F.struct("width", F.col("_c.ch").alias("ch"), "bin", F.col("_c.v").alias("v"))
    grouped = long.groupBy("id").agg(F.sort_array(F.collect_list(keyed)).alias("_vs"))
    return grouped.select("id", F.transform("_vs", lambda s: s["v"]).alias("features"))
