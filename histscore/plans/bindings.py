"""Roles of the reference's inputs, bound to the driver tables.

history_a  events:  id=user_id, rn by (ts, event_id), four code fields
history_b  orders x lineitem: id=o_custkey, rn by a total line order
target_dense   customer: flag = c_acctbal < 0
target_sparse  labels:   flag = toxic
query_ids      documents without a label, ord = rank of id
preds          four deterministic scores per customer (long form)

At scale the history tables arrive with ``rn`` already set (as in the
reference). Here ``rn`` is built with ``number_within``: a window per
entity, so a history is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histscore.functions.scalar import fold
from histscore.operators.ordering import global_row_number, in_parts, number_within
from histscore.sources.tables import read_table

# Values a code column may have.
MAX_CODES = 10_000
HISTORY_A_FIELDS = ["f_type", "f_k", "f_hour", "f_val"]
HISTORY_B_NUMERIC = ["state", "util", "overdue", "x"]
# Payment-state codes of the return flag (any other: the next).
STATE_CODES = {"A": 0, "N": 1, "R": 2}
# The score columns that stand in for model predictions.
PRED_MODELS = ["discount", "overdue_rate", "max_qty", "n_lines"]


def category_codes(df: DataFrame, column: str, code_name: str) -> DataFrame:
    """Dense 0-based codes of a categorical column in sorted order. The
    vocabulary is the distinct values; beyond ``MAX_CODES`` it is no category
    and the job fails before anything is numbered."""
    vocab = df.select(column).distinct()
    found = sorted((r[0] for r in vocab.limit(MAX_CODES + 1).collect()), key=lambda v: (v is not None, v))
    if len(found) > MAX_CODES:
        raise ValueError(f"{column} has more than {MAX_CODES} values")
    schema = T.StructType([df.schema[column], T.StructField(code_name, T.ShortType())])
    return df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(found)], schema)


def with_code(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """The codes joined null-safely: a null category has a code like any
    other, and no row is lost. ``category_codes`` bounds the codes."""
    key = F.col(column).alias("_category")
    return df.join(F.broadcast(codes.select(key, *[c for c in codes.columns if c != column])), F.col(column).eqNullSafe(F.col("_category")), "left").drop("_category")


def history_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(
        spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"]
    )
    codes = category_codes(events, "event_type", "f_type")
    coded = number_within(with_code(events, codes, "event_type"), "user_id", ["ts", "event_id"])
    return coded.select(
        F.col("user_id").alias("id"),
        "rn",
        F.col("f_type"),
        F.get_json_object("props", "$.k").cast("int").cast("short").alias("f_k"),
        F.hour("ts").cast("short").alias("f_hour"),
        F.floor(F.col("value") / 25).cast("short").alias("f_val"),
    )


def history_b(spark: SparkSession, sf_dir: str, previous: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """Orders x lineitem in line order; with the previous row's values of the
    ``previous`` columns where asked for. ``ordered`` is for those who need
    ``rn``: customers are dealt into parts whose sort stays in memory."""
    orders = read_table(
        spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]
    ).withColumnRenamed("o_orderpriority", "type")
    state = None
    for flag, code in STATE_CODES.items():
        hit = F.col("l_returnflag") == flag
        state = F.when(hit, code) if state is None else state.when(hit, code)
    overdue = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40), 1).otherwise(0)
    # The rest of the line order only matters inside an order: its lines are
    # numbered where the join brings them together (the join takes over that
    # sort), and the number travels on to the customer in place of the columns.
    in_order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", *in_order, "l_discount", "l_returnflag"]).select(
        "l_orderkey",
        *in_order,
        state.otherwise(len(STATE_CODES)).cast("short").alias("state"),
        F.round(F.col("l_discount") * 100).cast("short").alias("util"),
        overdue.cast("short").alias("overdue"),
    )
    n = lines.count()  # from the file footers
    lines = number_within(in_parts(lines, n, "l_orderkey"), "l_orderkey", in_order, name="_line")
    joined = in_parts(orders, n, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    placed = joined.select(
        F.col("o_custkey").alias("id"),
        "o_orderdate",
        "l_orderkey",
        "_line",
        "type",
        "state",
        "util",
        "overdue",
        F.col("l_quantity").alias("x"),
    )
    line_order = ["o_orderdate", "l_orderkey", "_line"]
    if ordered:
        placed = in_parts(placed, n, "id")
    numbered = number_within(placed, "id", line_order, previous=previous)
    return numbered.select("id", "rn", "type", "state", "util", "overdue", "x", *[f"{f}__prev" for f in previous])


def target_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("short").alias("flag"),
    )


def target_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    return labels.select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("short").alias("flag")
    )


def query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id"]).select(
        F.col("doc_id").alias("id")
    )
    return docs.join(target_sparse(spark, sf_dir), "id", "left_anti")


def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query ids with their position in the sample (the rank of the id)."""
    return global_row_number(query_ids(spark, sf_dir), ["id"], name="ord")


def customer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide per-customer scores from history B (one aggregate pass)."""
    return history_b(spark, sf_dir).groupBy("id").agg(
        F.avg("util").alias("discount"),
        F.avg("overdue").alias("overdue_rate"),
        F.max("x").alias("max_qty"),
        F.count(F.lit(1)).cast("double").alias("n_lines"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prediction table (model, split, id, target, prediction, ord).
    Fold 0 is the validation split; the rest plays the test split, whose
    sample order is the id order."""
    scores = customer_scores(spark, sf_dir).join(target_dense(spark, sf_dir), "id")
    long = scores.unpivot(
        ["id", "flag"], PRED_MODELS, variableColumnName="model", valueColumnName="prediction"
    )
    return long.select(
        "model",
        F.when(fold("id") == 0, "valid").otherwise("test").alias("split"),
        "id",
        F.col("flag").alias("target"),
        F.col("prediction").cast("double").alias("prediction"),
        F.col("id").alias("ord"),
    )


SEQ_FIELDS_B = ["type_code", "state", "util", "overdue"]


def history_b_coded(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """History B with the priority as a dense code (sequence fields)."""
    h = history_b(spark, sf_dir, ordered=ordered)
    # The vocabulary comes from one column of the orders scan, not from the
    # (joined, numbered) history itself.
    priorities = read_table(spark, sf_dir, "orders", ["o_orderpriority"]).select(
        F.col("o_orderpriority").alias("type")
    )
    codes = category_codes(priorities, "type", "type_code")
    return with_code(h, codes, "type")
