"""S9-S13 sinks and the prediction-set reader.

Every write goes through Spark's Hadoop output committer, which publishes a
directory only when all tasks succeed (the reference's temp-file-then-rename,
S13). Paths should live in shared storage; ``session.scratch_path`` gives one
under the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histscore.functions.scalar import compact_decimal_text
from histscore.operators.blend import canonical_prediction_columns
from histscore.operators.ordering import global_row_number


def write_predictions(preds: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The long prediction table, one folder per model."""
    preds.write.mode(mode).partitionBy("model").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Read a prediction set, accepting the plural key spellings."""
    return canonical_prediction_columns(spark.read.parquet(path))


def write_sequences(packed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Packed sequences (array columns) as Parquet; the path should
    carry the parameters (e.g. ``.../max_len=32``) so a cached table is never
    reused for other settings (K14)."""
    packed.write.mode(mode).parquet(path)


def stage_done(spark: SparkSession, path: str) -> bool:
    """A stage is reusable when its committed output exists."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def write_json_row(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row table (metadata, metrics) as JSON."""
    df.coalesce(1).write.mode(mode).json(path)


def compact_submission(
    df: DataFrame, id_col: str, value_col: str, ord_col: str, out_name: str = "flag"
) -> DataFrame:
    """S12 rows: ``id`` and the compact decimal text, in sample order."""
    return df.orderBy(ord_col).select(id_col, compact_decimal_text(value_col).alias(out_name))


def write_compact_csv(
    df: DataFrame, id_col: str, value_col: str, ord_col: str, path: str, mode: str = "overwrite"
) -> None:
    """Header ``id,flag``; the global sort writes part files whose
    concatenation is the sample order."""
    compact_submission(df, id_col, value_col, ord_col).write.mode(mode).option("header", True).csv(path)


def read_in_file_order(spark: SparkSession, path: str, schema: str, name: str = "ord") -> DataFrame:
    """A CSV folder as written by ``write_compact_csv`` with each row's
    1-based position in the files taken in name order. A file is read by one
    task per split in order, so (file, task, row) is the position."""
    rows = spark.read.option("header", True).schema(schema).csv(path)
    # split of a file, then row of the split
    rows = rows.select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return global_row_number(rows, ["_file", "_start", "_row"], name=name).drop("_file", "_start", "_row")
