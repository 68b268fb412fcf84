"""Table readers."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(
    spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Parquet scan with a column list (pruned at the reader)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def feature_columns(df: DataFrame, keys: Iterable[str] = ("id", "rn")) -> list[str]:
    """S3: every column except the keys, in schema order."""
    skip = set(keys)
    return [c for c in df.columns if c not in skip]


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and explicit types. Spark's CSV reader drops a
    UTF-8 byte-order mark, so a BOM-prefixed header still yields ``id``."""
    return spark.read.schema(schema).option("header", True).csv(path)


def missing_inputs(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> list[str]:
    """Names whose Parquet file cannot be opened (schema read only)."""
    missing = []
    for name in names:
        try:
            spark.read.parquet(table_path(sf_dir, name)).schema
        except Exception:  # noqa: BLE001 - any read failure means missing
            missing.append(name)
    return missing


def union_splits(parts: dict[str, DataFrame], split_col: str = "split") -> DataFrame:
    """Stack train and test parts for unlabelled use, tagged by split."""
    frames = [df.withColumn(split_col, F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def input_key(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> str:
    """A short name of the tables' current files: place, size and time of
    each, from the file listing (no data is read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in names:
        for file in spark.read.parquet(table_path(sf_dir, name)).inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
            status = path.getFileSystem(conf).getFileStatus(path)
            seen.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:12]
