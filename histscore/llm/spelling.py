"""Spelling variants by asymmetric q-chunks.

Words are counted per task and summed on Spark. Of two words within one edit
the shorter (of equal length: the smaller) contributes two disjoint q-chunks,
its first and its last ``q = length // 2`` code points; the other contributes
its positional q-grams. One edit leaves one of the two chunks whole and moves
it by one place at most, so the words meet on (length, chunk place, text)
among grams within shift one of that place, and ``levenshtein`` verifies each
meeting. Grams further than one from either place can meet no chunk and are
not sent.

A key that more than ``HOT`` meetings share (a common prefix or ending) is
not joined. Its words meet on what is left after deleting one code point
instead, where a group is bounded by the alphabet; a pair within one edit
that only shares hot keys always shares such a remainder.

A word's form is its near word of largest count if that is at least
``FACTOR`` times its own; counts grow by that factor along forms, so the
chains are short and pointer doubling finds the roots in a few joins.

Defined cases: null and empty texts have no words; a null id counts as an
empty id in the hash that damages runs; repeated rows count again; runs of
any length are words like others; ties between forms go to the smallest word;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histscore.llm.common import out_dir
from histscore.llm.runs import distinct, lower_ascii, pieces, split_runs, text_bytes

#: Shortest word, least count, divisor of the damage hash, factor of a form.
LENGTH, TIMES, DAMAGE, FACTOR = 7, 2, 31, 10
#: Meetings of one key up to which it is joined.
HOT = 20_000
#: Bytes of words a task holds before it sends their counts.
HELD = 48 << 20


@cache
def _after(length: int) -> np.ndarray:
    """Tables that carry a crc32 over ``length`` more bytes: the crc of two
    texts in a row is ``crc(second) ^ tables(crc(first))``."""
    blank = bytes(length)
    base = crc32(blank)
    return np.array([[crc32(blank, v << (8 * k)) ^ base for v in range(256)] for k in range(4)], np.uint32)


def joined_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each first text followed by its second of that many bytes."""
    out = second.astype(np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        some = order[lo:hi]
        tables, x = _after(int(lengths[some[0]])), first[some]
        for k in range(4):
            out[some] ^= tables[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def damaged(word: bytes, h: int) -> bytes:
    text = word.decode()
    k = h % len(text)
    return (text[:k] + text[k + 1 :]).encode()


def count_words(docs: DataFrame, length: int = LENGTH, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of all texts, each word once."""
    prefix = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("prefix")

    def run(batches):
        held: dict[bytes, int] = {}
        size = 0
        for part in pieces(batches, "text"):
            raw, at = text_bytes(part.column(1))
            raw = lower_ascii(raw)
            inside = ((raw >= 97) & (raw <= 122)) | (raw == 0xC3)
            inside[1:] |= raw[:-1] == 0xC3  # U+00C0 to U+00FF: this byte and one more
            doc, words = split_runs(raw, at, inside)
            codes, found = distinct(words)
            if not found:
                continue
            counts = np.bincount(codes, minlength=len(found))
            pairs, times = np.unique(doc * len(found) + codes, return_counts=True)
            d, k = np.divmod(pairs, len(found))
            first = np.array([crc32(p.encode()) for p in part.column(0).to_pylist()], np.uint32)
            second = np.array([crc32(w) for w in found], np.uint32)
            h = joined_crc(first[d], second[k], np.array([len(w) for w in found])[k])
            hit = h % damage == 0
            changed: list[tuple[bytes, int]] = []
            for w, n, x in zip(k[hit].tolist(), times[hit].tolist(), h[hit].tolist()):
                counts[w] -= n
                changed.append((damaged(found[w], x), n))
            for w, n in [*zip(found, counts.tolist()), *changed]:
                if n and len(w) >= length and (w.isascii() or len(w.decode()) >= length):
                    if w in held:
                        held[w] += n
                    else:
                        held[w] = n
                        size += len(w) + 120
            if size > HELD:
                yield _rows(held)
                held, size = {}, 0
        if held:
            yield _rows(held)

    parts = docs.select(prefix, F.col("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _rows(held: dict[bytes, int]) -> pa.RecordBatch:
    words = pa.array(list(held), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _key(size: Column, place: Column, text: Column) -> Column:
    return F.xxhash64(size, place, text)


def chunk_rows(words: DataFrame) -> DataFrame:
    """Two disjoint chunks of each word: (key, word, n)."""
    size, q = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    places = F.array(F.lit(0), size - q)
    keys = F.transform(places, lambda p: _key(size, p, F.substring(F.col("word"), p + 1, q)))
    return words.select(F.explode(keys).alias("key"), "word", "n")


def gram_rows(words: DataFrame, length: int = LENGTH) -> DataFrame:
    """Positional grams of each word that a chunk of an equally long or one
    shorter word can meet within shift one: (key, word, n)."""
    word, size = F.col("word"), F.length("word")

    def of(shorter: Column) -> Column:
        q = F.floor(shorter / 2).cast("int")
        last = size - q

        def near(p: Column) -> Column:
            at = F.filter(F.array(p - 1, p, p + 1), lambda s: (s >= 0) & (s <= last))
            return F.transform(at, lambda s: _key(shorter, p, F.substring(word, s + 1, q)))

        return F.when(shorter >= length, F.concat(near(F.lit(0)), near(shorter - q)))

    some = F.array_distinct(F.concat(of(size), F.coalesce(of(size - 1), F.array().cast("array<long>"))))
    return words.select(F.explode(some).alias("key"), "word", "n")


def _verified(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Pairs (a, b) that meet on a key and differ by exactly one edit."""
    a = left.select(on, F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = right.select(on, F.col("word").alias("b"), F.col("n").alias("n_b"))
    size_a, size_b = F.length("a"), F.length("b")
    once = (size_a < size_b) | ((size_a == size_b) & (F.col("a") < F.col("b")))
    near = F.levenshtein("a", "b", 1) == 1
    return a.join(b, on).where(once & near).select("a", "b", "n_a", "n_b")


def remainders(words: DataFrame) -> DataFrame:
    """Each word and what is left of it without one code point."""
    word, size = F.col("word"), F.length("word")
    cut = F.transform(F.sequence(F.lit(1), size), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, size)))
    keys = F.transform(F.concat(F.array(word), cut), lambda w: F.xxhash64(w))
    return words.select(F.explode(F.array_distinct(keys)).alias("key"), "word", "n")


def near_pairs(words: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Each pair of words that differ by one inserted, deleted or replaced
    code point, once: (a, b, n_a, n_b)."""
    chunks, grams = chunk_rows(words), gram_rows(words, length)
    met = chunks.select("key", F.lit(1).alias("c"), F.lit(0).alias("g")).unionAll(grams.select("key", F.lit(0), F.lit(1)))
    met = met.groupBy("key").agg(F.sum("c").alias("c"), F.sum("g").alias("g"))
    crowded = met.where(F.col("c") * F.col("g") > hot).select("key")
    path = out_dir(words.sparkSession, "hot-chunks")
    crowded.write.parquet(path)
    crowded = words.sparkSession.read.parquet(path)
    pairs = _verified(chunks.join(crowded, "key", "left_anti"), grams, "key")
    both = chunks.join(crowded, "key", "left_semi").unionAll(grams.join(crowded, "key", "left_semi"))
    left = remainders(both.select("word", "n").distinct())
    return pairs.unionAll(_verified(left, left, "key")).distinct()


def _root(forms: DataFrame, largest: int, factor: int) -> DataFrame:
    """(word, root): the end of each word's chain of forms."""
    steps = 1
    while factor**steps <= largest:  # no chain is longer
        steps += 1

    def doubled(at: DataFrame, _) -> DataFrame:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        path = out_dir(at.sparkSession, "forms")
        at.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")).write.parquet(path)
        return at.sparkSession.read.parquet(path)

    return reduce(doubled, range((steps - 1).bit_length()), forms.select("word", F.col("form").alias("root")))


def spelling_variants(docs: DataFrame, length: int = LENGTH, times: int = TIMES, factor: int = FACTOR, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word that occurs ``times``."""
    spark = docs.sparkSession
    path = out_dir(spark, "spellings")
    count_words(docs, length).where(F.col("n") >= times).write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    pairs = near_pairs(words, length, hot)
    names = ("word", "other", "n_other")
    ways = F.array(*[F.struct(*[F.col(c).alias(k) for k, c in zip(names, cs)]) for cs in (("a", "b", "n_b"), ("b", "a", "n_a"))])
    best = F.min(F.struct((-F.col("n_other")).alias("minus"), F.col("other").alias("best")))
    near = (
        pairs.select(F.inline(ways))
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), best.alias("best"))
    )
    is_form = -F.col("best.minus") >= factor * F.col("n")
    words.join(near, "word", "left").select(
        "word",
        F.when(is_form, F.col("best.best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.minus")).alias("form_n"),
    ).write.parquet(f"{path}/near")
    out = spark.read.parquet(f"{path}/near")
    largest = out.agg(F.max("n")).first()[0] or 1
    roots = _root(out.where("form is not null"), largest, factor)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
