"""Hand-checked cases (FIXTURES.md section 3)."""

import math
import os
import tempfile

from pyspark.sql import functions as F

from histscore.functions.scalar import compact_decimal_text, embedding_width, fold
from histscore.operators import axis as X
from histscore.operators import history as H
from histscore.operators import sequences as S
from histscore.operators.metrics import auc
from histscore.operators.ordering import rank_percentile
from histscore.operators.split import quantile_border
from histscore.sources.tables import read_csv_typed


def test_rank_percentile_ties_by_input_order(spark):
    values = [0.2, 0.5, 0.2, 0.9, 0.5]
    df = spark.createDataFrame(list(enumerate(values)), "ord long, value double")
    out = rank_percentile(df, "value", "ord", ranges=3).orderBy("ord")
    assert [r.rank_pct for r in out.collect()] == [0.0, 0.5, 0.25, 1.0, 0.75]


def test_rank_percentile_single_row(spark):
    df = spark.createDataFrame([(0, 0.3)], "ord long, value double")
    assert rank_percentile(df, "value", "ord").first().rank_pct == 0.0


def test_auc_ties_count_half(spark):
    p = [0.1, 0.4, 0.4, 0.35, 0.8, 0.4]
    y = [0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(p, y)), "prediction double, target int")
    assert auc(df, ranges=4).first().auc == 0.6666666666666666


def test_compact_text(spark):
    values = [0.0, 1.0, 0.5, 0.1, 0.785021, 1e-19, -0.25, 100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    out = df.select("i", compact_decimal_text("v").alias("t")).orderBy("i")
    assert [r.t for r in out.collect()] == ["0", "1", ".5", ".1", ".785021", "0", "-.25", "100"]


def test_embedding_width(spark):
    df = spark.createDataFrame([(c,) for c in [2, 5, 20, 63, 100]], "c int")
    out = df.select(embedding_width("c", 16).alias("w")).collect()
    assert [r.w for r in out] == [2, 4, 9, 16, 16]


def test_centred_prior(spark):
    labels = spark.createDataFrame(list(zip([0, 1, 3, 4, 7], [1, 0, 1, 0, 0])), "id long, flag int")
    queries = spark.createDataFrame([(2,), (3,), (9,)], "id long")
    out = X.centred_prior(labels, queries, half_width=2, smoothing=20.0).orderBy("id")
    got = [r.prior for r in out.collect()]
    assert got == [0.4166666666666667, 0.391304347826087, 0.38095238095238093]


def test_pack_pads_right(spark):
    rows = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 2, 3)], "id long, rn int, a int, b int")
    out = S.pack_sequences(rows, ["a", "b"], 4).first()
    assert out.len == 2
    assert [list(r) for r in out.seq] == [[1, 2], [3, 4], [0, 0], [0, 0]]


def test_quantile_border(spark):
    df = spark.range(0, 11).withColumnRenamed("id", "id")
    assert quantile_border(df, 0.9) == 9.0


def test_fold_is_floor_mod(spark):
    assert spark.range(1).select(fold(F.lit(-3)).alias("f")).first().f == 7


def test_bom_csv(spark):
    folder = tempfile.mkdtemp(prefix="bom-")
    path = os.path.join(folder, "t.csv")
    with open(path, "wb") as fh:
        fh.write(b"\xef\xbb\xbfid,flag\n1,0\n2,1\n")
    df = read_csv_typed(spark, path, __import__("pyspark.sql.types", fromlist=["x"]).StructType.fromDDL("id int, flag int"))
    assert df.columns == ["id", "flag"]
    assert sorted(r.id for r in df.collect()) == [1, 2]


def test_since_last_overdue(spark):
    df = spark.createDataFrame(
        [(1, 1, 0), (1, 2, 1), (1, 3, 0), (1, 4, 0), (2, 1, 0), (2, 2, 0)], "id long, rn int, overdue int"
    )
    got = {r.id: r.since_overdue for r in H.since_last_flag(df).collect()}
    assert got == {1: 2, 2: None}


def test_changes_and_total_variation(spark):
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate([3, 3, 5, 1])], "id long, rn int, x int")
    r = H.trend(df, ["x"]).first()
    assert r.x__changes == 2
    assert r.x__tv == 6
    assert math.isclose(r.x__slope, -0.4)  # cov -2 / var 5


def test_previous_row_of_each_id(spark):
    rows = [(1, i, i * 10) for i in range(1, 12)] + [(2, 1, 5)]
    df = spark.createDataFrame(rows, "id long, rn int, x int")
    out = {(r.id, r.rn): r.x__prev for r in H.with_previous(df, ["x"]).collect()}
    assert len(out) == 12
    assert out[(1, 1)] is None and out[(2, 1)] is None
    assert all(out[(1, i)] == (i - 1) * 10 for i in range(2, 12))


def test_prior_without_labels_is_null(spark):
    labels = spark.createDataFrame([], "id long, flag int")
    queries = spark.createDataFrame([(2,), (3,)], "id long")
    out = X.centred_prior(labels, queries, half_width=2, smoothing=20.0).collect()
    assert len(out) == 2 and all(r.prior is None for r in out)
