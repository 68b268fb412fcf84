"""Sharding by extendible hashing.

A directory indexed by the leading bits of a document's hash. It starts with
one bucket; only a bucket above the byte limit splits, on one more bit,
until every shard fits. A shard is thus the shortest prefix of a document's
hash whose documents fit the limit. Bits 1-40 come from md5(doc_id); bits
41-60 from the row, so a hot id with a third of all rows still splits.

The directory is built in bands of ``BAND`` bits: one aggregate gives the
bytes of every prefix of the band, and only documents of buckets still too
large go on to the next. It stays a DataFrame throughout.

Defined cases: null text has 0 bytes; a null id hashes as the string 'null';
one document above the limit is a shard of its own (``over_limit``), as
documents are not cut; equal rows are kept apart by their row bits; an empty
table gives an empty result; other columns are carried by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histscore.session import checkpointed

LIMIT_BYTES = 1 << 20
KEY_BITS, ROW_BITS, BAND = 40, 20, 3
BITS = KEY_BITS + ROW_BITS


def _prefix(code: Column, depth: Column | int) -> Column:
    """The first ``depth`` of the ``BITS`` bits."""
    return F.shiftright(code, BITS - depth) if isinstance(depth, int) else F.expr(f"shiftright(code, {BITS} - depth)")


def _coded(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, KEY_BITS // 4), 16, 10)
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        (F.shiftleft(key.cast("long"), ROW_BITS) + row).alias("code"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )


def assign_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, bytes, shard (its hash prefix as bits), depth, shard_bytes,
    shard_docs, over_limit; with ``carry`` a struct of those columns."""
    rest = checkpointed(_coded(docs, carry))  # pins the row bits
    done = None
    for lo in range(0, BITS + 1, BAND + 1):
        hi = min(lo + BAND, BITS)
        last = hi == BITS
        cells = rest.groupBy(_prefix(F.col("code"), hi).alias("cell")).agg(
            F.sum("bytes").alias("b"), F.count("*").alias("n")
        )
        paths = cells.withColumn("depth", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(
            "prefix", F.expr(f"shiftright(cell, {hi} - depth)")
        )
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1)
        if last:
            fits = fits | (F.col("depth") == hi)
        buckets = (
            paths.groupBy("depth", "prefix")
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
            .filter(fits)
        )
        directory = (
            paths.select("cell", "depth", "prefix")
            .join(buckets, ["depth", "prefix"])
            .groupBy("cell")
            .agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("at"))
        )
        joined = checkpointed(
            rest.withColumn("cell", _prefix(F.col("code"), hi)).join(directory, "cell", "left").drop("cell")
        )
        found = joined.filter(F.col("at").isNotNull()).select(
            "doc_id",
            "bytes",
            F.when(F.col("at.depth") == 0, F.lit(""))
            .otherwise(F.expr("lpad(bin(at.prefix), at.depth, '0')"))
            .alias("shard"),
            F.col("at.depth").cast("long").alias("depth"),
            F.col("at.shard_bytes").alias("shard_bytes"),
            F.col("at.shard_docs").alias("shard_docs"),
            (F.col("at.shard_bytes") > limit_bytes).alias("over_limit"),
            *(["carried"] if carry else []),
        )
        done = found if done is None else done.unionByName(found)
        rest = joined.filter(F.col("at").isNull()).drop("at")
        if last or rest.isEmpty():
            return done
    return done


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> None:
    """The documents as Parquet, one folder per shard."""
    placed = assign_shards(docs, limit_bytes, carry=docs.columns)
    rows = placed.select("carried.*", F.col("shard").alias("shard_prefix"))
    rows.repartition("shard_prefix").write.partitionBy("shard_prefix").parquet(path)
