"""Helpers shared by the operators: words, small-table joins, shared files."""

from __future__ import annotations

import ctypes
import os
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histscore.session import checkpoint_dir

#: A word: a run of code points other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Rows and bytes up to which a side counts as small enough to broadcast.
SMALL_ROWS, SMALL_BYTES = 100_000, 16 << 20
#: Texts taken out of an Arrow batch at a time.
SLICE = 256
#: Rows of an Arrow batch that holds whole texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_checked(big: DataFrame, small: DataFrame, on: Column, how: str, name_bytes: Column) -> DataFrame:
    """Join with a table that is usually small: broadcast after its rows and
    bytes have been counted, an ordinary shuffled join beyond the bound."""
    rows, size = small.agg(F.count("*"), F.sum(name_bytes)).first()
    if rows <= SMALL_ROWS and (size or 0) <= SMALL_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def whole_texts(df: DataFrame) -> DataFrame:
    """The same table; Arrow batches of this session have at most
    ``BATCH_ROWS`` rows from here on, as a row holds a whole text and a batch
    is held by the JVM and by its worker."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def release_memory() -> None:
    """Hands freed memory back to the system: workers are reused, and what an
    idle one keeps is missing elsewhere on its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def slices(batches, *columns: str, rows: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Pieces of at most ``rows`` rows with the named columns as lists; freed
    memory is released before the first and after the last."""
    release_memory()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
    batch = part = None
    release_memory()


def out_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return posixpath.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def open_store(path: str):
    """The pyarrow file system of a URI or a plain path, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return fs.LocalFileSystem(), os.path.abspath(path)
