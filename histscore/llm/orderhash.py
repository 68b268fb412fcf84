"""Order MinHash fingerprints in SQL functions only.

A text's k-mers are runs of ``K`` words, each with its occurrence number, so
a repeated k-mer is several different items. Items are hashed once and dealt
into ``BINS`` bins by their leading bits; in every bin the ``PICK`` smallest
items are selected, put back into text order, and the ordered tuple is
hashed. A swap of two passages changes tuples that a plain MinHash keeps, so
the signature follows edit distance. One hash with bins stands in for one
hash per signature entry: each text is sorted once, not ``BINS`` times.

Everything happens inside a row with higher-order functions: no text is
exploded and nothing is shuffled for the fingerprint itself.

The likeness of two fingerprints is the number of bins with equal tuples over
the number of bins filled in either; two empty fingerprints are alike (1.0).

Defined cases: null text is empty, its fingerprint is the empty string; fewer
than ``K`` words are one k-mer; ids descend, null ids come last, equal ids in
the order of their text's hash; a single document is its own neighbour; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, PICK, BIN_BITS = 3, 2, 6
BINS = 1 << BIN_BITS
#: An item is a long: hash bits above, word position below.
PLACE_BITS = 28
_PLACE = (1 << PLACE_BITS) - 1
_HASH = ~_PLACE
#: Rows aimed at per order bucket; most buckets; literal bounds.
BUCKET_ROWS, MOST_BUCKETS, BOUNDS = 2048, 200_000, 256
#: Above the parts of any bound: a bucket is bound * MOST_PARTS + part.
MOST_PARTS = 1 << 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n-1, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_HASH))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _kmers(words: Column, k: int) -> Column:
    """One item per k-mer, sorted by hash, then place."""
    n = F.size(words)
    count = F.when(n >= k, n - (k - 1)).otherwise(F.least(n, F.lit(1)))
    item = lambda i: _hash(F.xxhash64(*[F.get(words, i + j) for j in range(k)])).bitwiseOR(i.cast("long"))
    return F.sort_array(F.transform(_upto(count), item))


def _numbered(items: Column) -> Column:
    """Items hashed again with their occurrence number, sorted. Equal k-mers
    are neighbours in text order, so a run's index is the number."""
    starts = F.filter(
        _upto(F.size(items)),
        lambda j: (j == 0) | (_hash(F.get(items, j)) != _hash(F.get(items, j - 1))),
    )

    def runs(first: Column) -> Column:
        def one(start: Column, a: Column) -> Column:
            end = F.coalesce(F.get(first, a + 1), F.size(items))
            return F.transform(
                F.slice(items, start + 1, end - start),
                lambda x, o: _hash(F.xxhash64(_hash(x), o)).bitwiseOR(_place(x)),
            )

        return F.flatten(F.transform(first, one))

    return F.sort_array(let(starts, runs))


def _tuples(items: Column) -> Column:
    """bin * 65536 + 16 bits of the ordered tuple's hash, for filled bins."""

    def picked(p: Column) -> Column:
        def entry(x: Column, j: Column) -> Column:
            group = F.array_sort(
                F.transform(
                    F.filter(F.slice(p, j + 1, F.lit(PICK)), lambda y: _bin(y) == _bin(x)),
                    lambda y: F.struct(_place(y).alias("at"), _hash(y).alias("h")),
                )
            )
            value = let(group, lambda g: F.xxhash64(*[F.get(g, F.lit(k))["h"] for k in range(PICK)]))
            packed = _bin(x) * 65536 + value.bitwiseAND(F.lit(0xFFFF))
            head = (j == 0) | (_bin(F.get(p, j - 1)) != _bin(x))
            return F.when(head, packed.cast("int"))

        return F.filter(F.transform(p, entry), lambda x: x.isNotNull())

    smallest = F.filter(items, lambda x, j: (j < PICK) | (_bin(F.get(items, j - PICK)) != _bin(x)))
    return let(smallest, picked)


def signature(text: Column, k: int = K) -> Column:
    """The fingerprint as an array of ints, one per filled bin, in the order
    of the signed hashes."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return let(words, lambda w: let(_kmers(w, k), lambda m: let(_numbered(m), _tuples)))


def as_text(sig: Column) -> Column:
    """Six hex digits per filled bin: the bin and its tuple's hash."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 16))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _part(parts: int) -> Column:
    """One of ``parts`` equal ranges of the tie's hash, ascending."""
    share = (F.col("tie").cast("double") / F.lit(float(1 << 64)) + 0.5) * parts
    return F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share))).cast("long")


def _place_in(found: list[int], sub: int, null_parts: int) -> Column:
    """The order bucket, ascending with (doc_id, tie), null ids first: a
    balanced tree of comparisons with the quantiles ``found``, then ``sub``
    even cuts between two of them. An id that fills several quantiles, and
    the null id, are cut by the tie, so no id is one bucket."""
    x = F.col("doc_id")
    bounds = sorted(set(found))

    def at(base: int, part: Column) -> Column:
        return F.lit(base * MOST_PARTS).cast("long") + part

    def leaf(k: int) -> Column:
        low, high = bounds[k], bounds[min(k + 1, len(bounds) - 1)]
        share = (x.cast("double") - F.lit(float(low))) / F.lit(float(max(high - low, 1))) * sub
        between = at(2 * k + 1, F.greatest(F.lit(0), F.least(F.lit(sub - 1), F.floor(share))).cast("long"))
        filled = found.count(low)
        if filled < 2:
            return between
        hot = at(2 * k, _part((filled + 1) * sub))
        return F.when(x == low, hot).when(x < low, at(2 * k - 1, F.lit(0).cast("long"))).otherwise(between)

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid, hi))

    placed = F.when(x.isNull(), at(-2, _part(null_parts)))
    return placed.otherwise(tree(0, len(bounds))) if bounds else placed


def order_bucket(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> Column:
    """The order bucket of the rows of a table with doc_id and tie, of about
    ``bucket_rows`` rows each."""
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    wanted = max(1, min(math.ceil(n / bucket_rows), MOST_BUCKETS))
    cuts = min(wanted, BOUNDS)
    found = rows.agg(F.percentile_approx("doc_id", [i / cuts for i in range(cuts + 1)], 10_000)).first()[0]
    return _place_in(found or [], math.ceil(wanted / cuts), max(1, min(math.ceil(nulls / bucket_rows), MOST_BUCKETS)))


def with_next(rows: DataFrame, values: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``next_<v>`` for each value: that of the next row by descending
    (doc_id, tie); after the last row comes the first.

    Rows are cut into buckets by literal bounds of the id, and of the tie
    where one id has many rows; the first row of a bucket is sent along to the bucket before it, so no row needs a second shuffle and
    no window spans more than a bucket."""
    placed = rows.withColumn("__bucket", order_bucket(rows, bucket_rows))
    heads = placed.select("__bucket", "doc_id", "tie").groupBy("__bucket").agg(
        F.max(F.struct(F.col("doc_id").alias("id"), F.col("tie").alias("t"))).alias("__head")
    )
    # one row per bucket: at most MOST_BUCKETS of 32 bytes
    line = Window.orderBy("__bucket")
    last = F.last("__bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lowest = F.first("__bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    to = F.when(F.col("__bucket") == last, lowest).otherwise(F.lead("__bucket").over(line))
    heads = heads.select(F.col("__bucket").alias("__b"), "__head", to.alias("__to"))
    joined = placed.join(F.broadcast(heads), F.col("__bucket") == F.col("__b"))
    first = F.col("doc_id").eqNullSafe(F.col("__head.id")) & F.col("tie").eqNullSafe(F.col("__head.t"))
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("ghost"))
    sent = F.struct(F.col("__to").alias("b"), F.lit(True).alias("ghost"))
    dealt = joined.withColumn("__at", F.explode(F.when(first, F.array(own, sent)).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, F.col("__at.b").alias("__b"), F.col("__at.ghost").alias("__ghost"))
    order = Window.partitionBy("__b").orderBy("__ghost", F.col("doc_id").desc_nulls_last(), F.col("tie").desc_nulls_last())
    out = dealt.select("*", *[F.lead(v).over(order).alias(f"next_{v}") for v in values])
    return out.filter(~F.col("__ghost")).drop("__b", "__ghost")


def fingerprint_edits(docs: DataFrame, k: int = K, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), body.alias("text"), F.xxhash64(body).alias("tie"), signature(body, k).alias("sig")
    )
    paired = with_next(rows, ["text", "sig"], bucket_rows)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = paired.select("doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    signed = made.select("*", signature(F.col("edited"), k).alias("edited_sig"))
    return signed.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
