"""Sequence queries: Q1, Q3-Q5, Q7-Q11, A7, A12, P9, P10, J3."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from histscore.functions.scalar import fold
from histscore.operators import sequences as S
from histscore.plans import bindings as B
from histscore.plans.oracle_ctes import with_roles
from histscore.plans.registry import register
from histscore.plans.sqlhash import hash_unit_sql, mix_hash_sql
from histscore.session import scratch_path
from histscore.sources.sinks import write_json_row, write_sequences
from histscore.sources.stages import stage
from histscore.sources.tables import input_key

FIELDS = B.SEQ_FIELDS_B
MAX_LEN = 32
MASK_P = 0.15
MASK_SEED = 7
EPOCHS = 2
SHARDS = 4
BATCH = 16
PLAN_SEED = 42
SAMPLE_STEPS = 5
SAMPLE_SIZE = 32

FOLD_SQL = "((id % 10) + 10) % 10"
KEPT = (
    "kept",
    f"""SELECT * FROM (SELECT id, rn, {", ".join(FIELDS)},
                              row_number() OVER (PARTITION BY id ORDER BY rn DESC) AS pd
                       FROM history_b_coded) WHERE pd <= {MAX_LEN}""",
)
ZERO_ROW = ",".join("0" for _ in FIELDS)
ROW_TEXT = "concat_ws(',', " + ", ".join(f"{f} + 1" for f in FIELDS) + ")"
PACKED = (
    "packed",
    f"""SELECT id, count(*) AS len,
               string_agg({ROW_TEXT}, ';' ORDER BY rn)
               || repeat(';{ZERO_ROW}', {MAX_LEN} - CAST(count(*) AS INTEGER)) AS seq_text
        FROM kept GROUP BY id""",
)
CELLS = (
    "cells",
    "SELECT id, pos, field, value FROM ("
    + " UNION ALL ".join(
        f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY rn) AS INTEGER) AS pos,
                   {i} AS field, CAST({f} + 1 AS SMALLINT) AS value FROM kept"""
        for i, f in enumerate(FIELDS)
    )
    + ")",
)


def packed(spark, sf_dir, labels=True):
    lab = B.target_dense(spark, sf_dir) if labels else None
    return S.pack_sequences(B.history_b_coded(spark, sf_dir, ordered=True), FIELDS, MAX_LEN, lab)


def cards(spark, sf_dir):
    return S.cardinalities(B.history_b_coded(spark, sf_dir), FIELDS)


@register(
    "sequence_pack",
    with_roles(
        ["history_b_coded", "target_dense"],
        "SELECT p.id, CAST(p.len AS SMALLINT) AS len, p.seq_text, t.flag AS y FROM packed p JOIN target_dense t USING (id)",
        [KEPT, PACKED],
    ),
)
def q_sequence_pack(spark, sf_dir):
    p = packed(spark, sf_dir)
    return p.select("id", "len", S.sequence_text("seq").alias("seq_text"), "y")


_CARD_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {i} AS field_index, CAST(max({f}) AS INTEGER) + 2 AS cardinality FROM history_b_coded"
    for i, f in enumerate(FIELDS)
)
_WIDTH_SQL = "least(16, greatest(2, CAST(round_even(1.6 * pow(cardinality, 0.56), 0) AS INTEGER)))"


@register(
    "cardinalities",
    with_roles(
        ["history_b_coded"],
        f"SELECT field, field_index, cardinality, {_WIDTH_SQL} AS emb_width FROM ({_CARD_SQL})",
    ),
)
def q_cardinalities(spark, sf_dir):
    return cards(spark, sf_dir)


@register(
    "field_offsets",
    with_roles(
        ["history_b_coded"],
        f"""SELECT field, field_index, cardinality, {_WIDTH_SQL} AS emb_width,
                   CAST(coalesce(sum(cardinality) OVER (ORDER BY field_index ROWS BETWEEN UNBOUNDED PRECEDING
                                                        AND 1 PRECEDING), 0) AS BIGINT) AS offset
            FROM ({_CARD_SQL})""",
    ),
)
def q_field_offsets(spark, sf_dir):
    return S.field_offsets(cards(spark, sf_dir))


@register(
    "valid_mask",
    with_roles(
        ["history_b_coded"],
        f"""SELECT id, count(*) AS n_valid,
                   CASE WHEN count(*) < {MAX_LEN} THEN count(*) + 1 ELSE 0 END AS first_invalid
            FROM kept GROUP BY id""",
        [KEPT],
    ),
)
def q_valid_mask(spark, sf_dir):
    p = packed(spark, sf_dir, labels=False).withColumn("mask", S.valid_mask(MAX_LEN))
    return p.select(
        "id",
        F.size(F.filter("mask", lambda m: m)).cast("long").alias("n_valid"),
        F.array_position("mask", False).alias("first_invalid"),
    )


_POOL_SQL = ", ".join(
    f"avg({f} + 1) AS {f}__pool_mean, max({f} + 1) AS {f}__pool_max, arg_max({f} + 1, rn) AS {f}__pool_last"
    for f in FIELDS
)


@register(
    "masked_pool",
    with_roles(
        ["history_b_coded"],
        f"""SELECT id, {', '.join(f"CAST({f}__pool_mean AS DOUBLE) AS {f}__pool_mean, CAST({f}__pool_max AS DOUBLE) AS {f}__pool_max, CAST({f}__pool_last AS SMALLINT) AS {f}__pool_last" for f in FIELDS)}
            FROM (SELECT id, {_POOL_SQL} FROM kept GROUP BY id)""",
        [KEPT],
    ),
)
def q_masked_pool(spark, sf_dir):
    return S.pooled_rows(B.history_b_coded(spark, sf_dir), FIELDS, MAX_LEN)


@register(
    "softmax_pool",
    with_roles(
        ["history_b_coded"],
        f"""SELECT id, round(sum(w * (util + 1)) / sum(w), 6) AS util__softmax
            FROM (SELECT id, util,
                         exp(CAST(pos AS DOUBLE) / {MAX_LEN}.0 - CAST(n AS DOUBLE) / {MAX_LEN}.0) AS w
                  FROM (SELECT id, util, row_number() OVER (PARTITION BY id ORDER BY rn) AS pos,
                               count(*) OVER (PARTITION BY id) AS n FROM kept))
            GROUP BY id""",
        [KEPT],
    ),
)
def q_softmax_pool(spark, sf_dir):
    p = packed(spark, sf_dir, labels=False)
    pooled = p.select("id", S.softmax_pool("seq", "len", FIELDS.index("util"), MAX_LEN, "util__softmax"))
    return pooled.select("id", F.round("util__softmax", 6).alias("util__softmax"))


def masked_cells(spark, sf_dir):
    cells = S.explode_cells(packed(spark, sf_dir, labels=False), FIELDS)
    return S.field_mask(cells, MASK_P, MASK_SEED)


_MASK_HIT = f"{hash_unit_sql('id', 'pos', 'field', seed=MASK_SEED)} < {int(round(MASK_P * 65536))}"


@register(
    "field_mask",
    with_roles(
        ["history_b_coded"],
        f"""SELECT id, pos, field, value AS original,
                   CAST(CASE WHEN {_MASK_HIT} THEN 0 ELSE value END AS SMALLINT) AS masked,
                   {_MASK_HIT} AS is_masked
            FROM cells""",
        [KEPT, CELLS],
    ),
)
def q_field_mask(spark, sf_dir):
    m = masked_cells(spark, sf_dir)
    return m.select(
        "id", F.col("pos").cast("int").alias("pos"), F.col("field").cast("int").alias("field"),
        "original", "masked", "is_masked",
    )


@register(
    "mask_answers",
    with_roles(
        ["history_b_coded"],
        f"""SELECT field, CAST(sum(n) AS BIGINT) AS n_masked, round(sum(-p * ln(p)), 6) AS baseline_loss
            FROM (SELECT field, n, n / sum(n) OVER (PARTITION BY field) AS p
                  FROM (SELECT field, value, count(*) AS n FROM cells WHERE {_MASK_HIT} GROUP BY field, value))
            GROUP BY field""",
        [KEPT, CELLS],
    ),
)
def q_mask_answers(spark, sf_dir):
    ans = S.mask_answers(masked_cells(spark, sf_dir))
    return ans.select(
        F.col("field").cast("int").alias("field"), F.col("n_masked").cast("long").alias("n_masked"),
        F.round("baseline_loss", 6).alias("baseline_loss"),
    )


@register(
    "multi_hot",
    with_roles(
        ["history_b_coded"],
        f"""SELECT c.id, c.pos, array_to_string(list_sort(list(CAST(c.value + o.offset AS BIGINT))), ',') AS idx_text,
                   1.0 / sqrt({len(FIELDS)}) AS scale
            FROM cells c JOIN offs o USING (field) WHERE c.value <> 0 GROUP BY c.id, c.pos""",
        [KEPT, CELLS, ("offs", f"""SELECT field_index AS field,
                                   coalesce(sum(cardinality) OVER (ORDER BY field_index ROWS BETWEEN
                                            UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset
                            FROM ({_CARD_SQL})""")],
    ),
)
def q_multi_hot(spark, sf_dir):
    hot = S.multi_hot(packed(spark, sf_dir, labels=False), S.field_offsets(cards(spark, sf_dir)))
    return hot.select(
        "id", F.col("pos").cast("int").alias("pos"), F.array_join("indices", ",").alias("idx_text"), "scale"
    )


# ---------------------------------------------------------------- Q10, A12, Q11
TRAIN_IDS = ("train_ids", f"SELECT id FROM target_dense WHERE {FOLD_SQL} <> 0")


def _train_ids(spark, sf_dir):
    return B.target_dense(spark, sf_dir).where(fold("id") != 0).select("id")


_PLAN_SQL = f"""
    SELECT epoch, shard, id, CAST(floor((r - 1) / {BATCH}) AS BIGINT) AS batch,
           {mix_hash_sql('epoch', 'shard', f'floor((r - 1) / {BATCH})', seed=PLAN_SEED)} AS batch_key
    FROM (SELECT *, row_number() OVER (PARTITION BY epoch, shard ORDER BY h, id) AS r,
                 count(*) OVER (PARTITION BY epoch, shard) AS n
          FROM (SELECT t.id, e.epoch, ((t.id % {SHARDS}) + {SHARDS}) % {SHARDS} AS shard,
                       {mix_hash_sql('t.id', 'e.epoch', seed=PLAN_SEED)} AS h
                FROM train_ids t, (SELECT unnest(range(1, {EPOCHS} + 1)) AS epoch) e))
    WHERE r <= floor(n / {BATCH}) * {BATCH}"""


def plan(spark, sf_dir):
    return S.batch_plan(_train_ids(spark, sf_dir), EPOCHS, SHARDS, BATCH, PLAN_SEED)


@register("batch_plan", with_roles(["target_dense"], _PLAN_SQL, [TRAIN_IDS]))
def q_batch_plan(spark, sf_dir):
    return plan(spark, sf_dir).select(
        F.col("epoch").cast("long").alias("epoch"), F.col("shard").cast("long").alias("shard"),
        "id", "batch", "batch_key",
    )


@register(
    "steps_per_epoch",
    with_roles(
        ["target_dense"],
        f"""SELECT CAST(sum(floor(n / {BATCH})) AS BIGINT) AS steps, count(*) AS shards
            FROM (SELECT ((id % {SHARDS}) + {SHARDS}) % {SHARDS} AS shard, count(*) AS n FROM train_ids GROUP BY 1)""",
        [TRAIN_IDS],
    ),
)
def q_steps_per_epoch(spark, sf_dir):
    return S.steps_per_epoch(_train_ids(spark, sf_dir), SHARDS, BATCH)


@register(
    "fixed_sample",
    with_roles(
        ["target_dense"],
        f"""SELECT step, id FROM (
              SELECT s.step, t.id, row_number() OVER (PARTITION BY s.step
                     ORDER BY {mix_hash_sql('t.id', 's.step', seed=PLAN_SEED)}, t.id) AS r
              FROM train_ids t, (SELECT unnest(range(1, {SAMPLE_STEPS} + 1)) AS step) s)
            WHERE r <= {SAMPLE_SIZE}""",
        [TRAIN_IDS],
    ),
)
def q_fixed_sample(spark, sf_dir):
    out = S.fixed_samples(_train_ids(spark, sf_dir), SAMPLE_STEPS, SAMPLE_SIZE, PLAN_SEED)
    return out.select(F.col("step").cast("long").alias("step"), "id")


# ---------------------------------------------------------------- Q2, S10, S11
@register(
    "prepare_sequences",
    with_roles(
        ["history_b_coded"],
        f"""SELECT CASE WHEN {FOLD_SQL} = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS sequences,
                   CAST(sum(least(n, {MAX_LEN})) AS BIGINT) AS events,
                   count_if({FOLD_SQL} <> 0) AS labelled
            FROM (SELECT id, count(*) AS n FROM history_b_coded GROUP BY id) GROUP BY 1""",
    ),
)
def q_prepare_sequences(spark, sf_dir):
    """Q2: packed sequences for the labelled (train) and unlabelled (test)
    split, written to a path keyed by the parameters (K14), plus the
    metadata row (feature names, cardinalities, max_len, parts) as JSON."""
    # The stage names the input files and every parameter, so it is reused
    # only for the same data and settings.
    key = {"input": input_key(spark, sf_dir, ["orders", "lineitem", "customer"]), "max_len": MAX_LEN, "fields": FIELDS}

    def build(path):
        h = B.history_b_coded(spark, sf_dir)
        labels = B.target_dense(spark, sf_dir)
        write_sequences(S.pack_sequences(h.where(fold("id") != 0), FIELDS, MAX_LEN, labels.where(fold("id") != 0)), f"{path}/table/split=train")
        write_sequences(S.pack_sequences(h.where(fold("id") == 0), FIELDS, MAX_LEN, None), f"{path}/table/split=test")
        fields = cards(spark, sf_dir).orderBy("field_index").agg(
            F.collect_list("field").alias("feature_names"), F.collect_list("cardinality").alias("cardinalities")
        )
        write_json_row(fields.withColumn("max_len", F.lit(MAX_LEN)), f"{path}/metadata")

    root = stage(spark, "sequences", key, build)
    meta = spark.read.json(f"{root}/metadata").first()
    if meta["feature_names"] != FIELDS or meta["max_len"] != MAX_LEN:
        raise ValueError("the stored sequences have other fields or another length")
    stored = spark.read.option("mergeSchema", "true").parquet(f"{root}/table")
    return stored.groupBy("split").agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("len").cast("long").alias("events"),
        F.count("y").alias("labelled"),
    )


@register(
    "sequence_metadata",
    with_roles(["history_b_coded"], f"SELECT field, CAST(cardinality AS BIGINT) AS cardinality, {MAX_LEN} AS max_len FROM ({_CARD_SQL})"),
)
def q_sequence_metadata(spark, sf_dir):
    """The metadata row written as JSON and read back."""
    path = scratch_path(spark, f"metadata/{uuid.uuid4().hex}")
    fields = cards(spark, sf_dir).agg(F.sort_array(F.collect_list(F.struct("field_index", "field", "cardinality"))).alias("fields"))
    write_json_row(fields.withColumn("max_len", F.lit(MAX_LEN)), path)
    back = spark.read.json(path)
    return back.select(F.inline("fields"), F.col("max_len").cast("int").alias("max_len")).select("field", "cardinality", "max_len")
