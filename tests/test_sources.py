"""Sources and sinks: S5, S8, S9, S11, S12, S14."""

import os
import uuid

from pyspark.sql import functions as F

from histscore.plans import bindings as B
from histscore.session import scratch_path
from histscore.sources import sinks
from histscore.sources.tables import missing_inputs
from tests.conftest import SF_SMALL


def test_prediction_store_round_trip(spark):
    preds = B.preds(spark, SF_SMALL)
    path = scratch_path(spark, f"test/preds/{uuid.uuid4().hex}")
    assert not sinks.stage_done(spark, path)
    sinks.write_predictions(preds.withColumnRenamed("prediction", "predictions"), path)
    assert sinks.stage_done(spark, path)
    back = sinks.read_predictions(spark, path)
    assert "prediction" in back.columns
    assert back.count() == preds.count()
    assert sorted(r.model for r in back.select("model").distinct().collect()) == sorted(B.PRED_MODELS)


def test_json_row(spark):
    path = scratch_path(spark, f"test/meta/{uuid.uuid4().hex}")
    sinks.write_json_row(spark.range(1).select(F.lit(32).alias("max_len")), path)
    assert spark.read.json(path).first().max_len == 32


def test_compact_csv_in_sample_order(spark):
    df = spark.createDataFrame([(3, 2, 0.25), (1, 0, 0.5), (2, 1, 1.0)], "id long, ord long, v double")
    path = scratch_path(spark, f"test/csv/{uuid.uuid4().hex}")
    sinks.write_compact_csv(df, "id", "v", "ord", path)
    local = path[len("file:"):] if path.startswith("file:") else path
    lines = []
    for name in sorted(os.listdir(local)):
        if name.startswith("part-"):
            with open(os.path.join(local, name)) as fh:
                lines += [line.strip() for line in fh if line.strip()]
    body = [line for line in lines if line != "id,flag"]
    assert body == ["1,.5", "2,1", "3,.25"]


def test_missing_inputs(spark):
    assert missing_inputs(spark, SF_SMALL, ["customer", "no_such_table"]) == ["no_such_table"]
