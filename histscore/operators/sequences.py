"""Q1-Q11 sequence assembly and batching, A7 cardinalities, A12, P9, P10.

A packed sequence is ``ARRAY<ARRAY<SHORT>>`` (positions x fields): the last
``max_len`` rows of an id by ``rn``, codes shifted by one (0 = padding),
zero rows on the right. The keep-last-N filter runs before the shuffle as a
WindowGroupLimit, so an id never brings more than ``max_len`` rows per map
partition to the collect, whatever its history length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histscore.functions.scalar import embedding_width, hash_unit, mix_hash
from histscore.operators.history import last_n
from histscore.operators.ordering import global_row_number


def pack_sequences(
    df: DataFrame,
    fields: Sequence[str],
    max_len: int,
    labels: DataFrame | None = None,
    id_col: str = "id",
) -> DataFrame:
    """Q1 (P6, P7): ``(id, len, seq[, y])``. With ``labels`` (id, flag) every
    id must have a label (J3), else the job fails."""
    kept = last_n(df, max_len, id_col=id_col)
    row = F.array(*[(F.col(f) + 1).cast("short") for f in fields])
    packed = kept.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col("rn"), row.alias("codes")))).alias("_rows")
    )
    zero_row = F.array(*[F.lit(0).cast("short") for _ in fields])
    seq = F.transform("_rows", lambda r: r["codes"])
    out = packed.select(
        id_col,
        F.size("_rows").cast("short").alias("len"),
        F.concat(seq, F.array_repeat(zero_row, F.lit(max_len) - F.size("_rows"))).alias("seq"),
    )
    if labels is not None:
        out = required_labels(with_labels(out, labels, id_col))
    return out


def with_labels(packed: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """Packed sequences with their label as ``_y``, null where there is none."""
    return packed.join(labels.select(id_col, F.col("flag").alias("_y")), id_col, "left")


def required_labels(joined: DataFrame) -> DataFrame:
    """A missing label fails the job when the row is produced (no extra
    pass to look for it first); a row filtered out before is not looked at."""
    y = F.when(F.col("_y").isNull(), F.raise_error(F.lit("id without a target in the sequence table")))
    return joined.select(*[c for c in joined.columns if c != "_y"], y.otherwise(F.col("_y")).cast("short").alias("y"))


def sequence_text(seq: str = "seq") -> F.Column:
    """Serialised form: fields joined by ',', positions by ';'."""
    return F.array_join(F.transform(seq, lambda r: F.array_join(r, ",")), ";")


def cardinalities(df: DataFrame, fields: Sequence[str], max_width: int = 16) -> DataFrame:
    """A7 + P10: per field ``max code + 2`` over all rows (pad + shift) and
    the embedding width heuristic; one aggregate pass, then unpivot."""
    maxima = df.agg(*[F.max(f).cast("int").alias(f) for f in fields])
    long = maxima.unpivot([], list(fields), "field", "max_code")
    order = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))])
    return long.select(
        "field",
        order[F.col("field")].alias("field_index"),
        (F.col("max_code") + 2).alias("cardinality"),
    ).withColumn("emb_width", embedding_width("cardinality", max_width))


def field_offsets(cards: DataFrame) -> DataFrame:
    """Exclusive running sum of cardinalities in field order (a table
    with one row per field)."""
    w = Window.orderBy("field_index").rowsBetween(Window.unboundedPreceding, -1)
    return cards.withColumn("offset", F.coalesce(F.sum("cardinality").over(w), F.lit(0)).cast("long"))


def valid_mask(max_len: int, length: str = "len") -> F.Column:
    """Q3: boolean per position, true below the length."""
    return F.transform(F.sequence(F.lit(0), F.lit(max_len - 1)), lambda p: p < F.col(length))


def masked_pool(seq: str, length: str, n_fields: int, names: Sequence[str]) -> list[F.Column]:
    """Q4 (re-aimed to the codes): per field mean and max over valid
    positions (invalid cells filled with -1e4 before the max) and the last
    valid value."""
    valid = F.slice(seq, 1, F.col(length))
    cols = []
    for i, name in enumerate(names):
        cols += _pool_field(seq, valid, length, i, name)
    return cols


def _pool_field(seq: str, valid: F.Column, length: str, i: int, name: str) -> list[F.Column]:
    values = F.transform(valid, lambda r: r[i].cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    filled = F.transform(
        F.sequence(F.lit(1), F.size(seq)),
        lambda p: F.when(p <= F.col(length), F.element_at(seq, p)[i].cast("double")).otherwise(F.lit(-1e4)),
    )
    return [
        (total / F.col(length)).alias(f"{name}__pool_mean"),
        F.array_max(filled).alias(f"{name}__pool_max"),
        F.element_at(seq, F.col(length).cast("int"))[i].alias(f"{name}__pool_last"),
    ]


def softmax_pool(seq: str, length: str, field: int, max_len: int, name: str) -> F.Column:
    """Q5 (re-aimed): softmax-weighted mean of one field over valid
    positions, scored by recency ``p / max_len``."""
    positions = F.sequence(F.lit(1), F.col(length).cast("int"))
    score = lambda p: p.cast("double") / F.lit(float(max_len))
    top = F.col(length).cast("double") / F.lit(float(max_len))
    weights = F.transform(positions, lambda p: F.exp(score(p) - top))
    norm = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    weighted = F.aggregate(
        F.transform(positions, lambda p: F.exp(score(p) - top) * F.element_at(seq, p)[field].cast("double")),
        F.lit(0.0),
        lambda a, v: a + v,
    )
    return (weighted / norm).alias(name)


def explode_cells(packed: DataFrame, fields: Sequence[str], seq: str = "seq", length: str = "len") -> DataFrame:
    """Long form of the valid cells: (id, pos, field, value)."""
    cells = packed.select(
        "id",
        F.posexplode(F.slice(seq, 1, F.col(length))).alias("_p", "_row"),
    )
    return cells.select(
        "id",
        (F.col("_p") + 1).alias("pos"),
        F.posexplode("_row").alias("field", "value"),
    )


def field_mask(cells: DataFrame, probability: float, seed: int) -> DataFrame:
    """Q7: hash-decided masking of valid cells with the given probability;
    ``masked`` is 0 where hidden, ``original`` keeps the answer."""
    threshold = int(round(probability * 65536))
    hit = hash_unit("id", "pos", "field", seed=seed) < F.lit(threshold)
    return cells.select(
        "id",
        "pos",
        "field",
        F.col("value").alias("original"),
        F.when(hit, F.lit(0).cast("short")).otherwise(F.col("value")).alias("masked"),
        hit.alias("is_masked"),
    )


def mask_answers(masked: DataFrame) -> DataFrame:
    """Q8: per field, the masked cells and the loss of predicting the
    marginal distribution of their answers (entropy in nats)."""
    answers = masked.where("is_masked")
    freq = answers.groupBy("field", "original").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("field")
    with_p = freq.withColumn("p", F.col("n") / F.sum("n").over(w))
    return with_p.groupBy("field").agg(
        F.sum("n").alias("n_masked"),
        F.sum(-F.col("p") * F.log("p")).alias("baseline_loss"),
    )


def multi_hot(packed: DataFrame, offsets: DataFrame, seq: str = "seq", length: str = "len") -> DataFrame:
    """Q9 (with P9): per event the vocabulary indices of its non-zero codes
    and the 1/sqrt(F) scale of each. The offsets (one row per field) become
    literals; every event is one row and nothing is shuffled."""
    shift = _shift(offsets)
    events = packed.select("id", F.posexplode(F.slice(seq, 1, F.col(length))).alias("_p", "_row"))
    return events.select(
        "id",
        (F.col("_p") + 1).alias("pos"),
        F.sort_array(_indices(F.col("_row"), shift)).alias("indices"),
        F.lit(1.0 / len(shift) ** 0.5).alias("scale"),
    ).where(F.size("indices") > 0)


def _shift(offsets: DataFrame) -> list[int]:
    return [int(r["offset"]) for r in offsets.orderBy("field_index").select("offset").collect()]


def _indices(row: F.Column, shift: Sequence[int]) -> F.Column:
    """The vocabulary indices of an event's non-zero codes."""
    literal = F.array(*[F.lit(k).cast("long") for k in shift])
    return F.filter(
        F.transform(row, lambda v, i: F.when(v != 0, v.cast("long") + F.get(literal, i))), lambda x: x.isNotNull()
    )


def sequence_indices(offsets: DataFrame, seq: str = "seq", length: str = "len") -> F.Column:
    """Q9 of a whole sequence: the indices of all its events (``multi_hot``
    without one row per event), made in the row, so nothing is shuffled."""
    shift = _shift(offsets)
    return F.flatten(F.transform(F.slice(seq, 1, F.col(length)), lambda row: _indices(row, shift)))


def pooled_rows(df: DataFrame, fields: Sequence[str], max_len: int, id_col: str = "id") -> DataFrame:
    """Q4 without packing: mean, max and last of the shifted codes over the
    kept rows, as one aggregate."""
    kept = last_n(df, max_len, id_col=id_col)
    code = {f: (F.col(f) + 1).cast("short") for f in fields}
    return kept.groupBy(id_col).agg(
        *[
            c
            for f in fields
            for c in (
                F.avg(code[f]).alias(f"{f}__pool_mean"),
                F.max(code[f].cast("double")).alias(f"{f}__pool_max"),
                F.max_by(code[f], "rn").alias(f"{f}__pool_last"),
            )
        ]
    )


def batch_plan(
    ids: DataFrame,
    epochs: int,
    shards: int,
    batch_size: int,
    seed: int,
    ranges: int | None = None,
    drop_partial: bool = True,
) -> DataFrame:
    """Q10: per epoch each shard (id mod shards) is shuffled by hash and cut
    into full batches (the partial last batch of a shard is dropped, a
    training rule; ``drop_partial=False`` keeps it); the batches of an epoch are ordered by a hash of (epoch, shard, batch).
    Row numbers inside (epoch, shard) come from the two-level form."""
    per_epoch = ids.select(
        "id", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")
    ).withColumn("shard", F.pmod("id", F.lit(shards)))
    keyed = per_epoch.withColumn("_h", mix_hash("id", "epoch", seed=seed))
    numbered = global_row_number(
        keyed, ["_h", "id"], ["epoch", "shard"], ranges=ranges, name="_r", count_name="_n"
    )
    full = numbered
    if drop_partial:
        full = numbered.where(F.col("_r") <= F.floor(F.col("_n") / batch_size) * batch_size)
    return full.select(
        "epoch",
        "shard",
        "id",
        F.floor((F.col("_r") - 1) / batch_size).cast("long").alias("batch"),
        mix_hash("epoch", "shard", F.floor((F.col("_r") - 1) / batch_size), seed=seed).alias("batch_key"),
    )


def steps_per_epoch(ids: DataFrame, shards: int, batch_size: int) -> DataFrame:
    """Sum over shards of floor(rows / batch_size)."""
    per_shard = ids.groupBy(F.pmod("id", F.lit(shards)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return per_shard.agg(
        F.sum(F.floor(F.col("n") / batch_size)).cast("long").alias("steps"),
        F.count(F.lit(1)).alias("shards"),
    )


def fixed_samples(ids: DataFrame, steps: int, size: int, seed: int) -> DataFrame:
    """Q11: for each step, ``size`` ids without replacement, the smallest by
    hash(id, step). The per-step top-k is a WindowGroupLimit: partial top-k
    before the shuffle, so each step moves at most ``size`` rows per map
    partition."""
    per_step = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    keyed = per_step.withColumn("_h", mix_hash("id", "step", seed=seed))
    w = Window.partitionBy("step").orderBy("_h", "id")
    return keyed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).select(
        "step", "id"
    )
