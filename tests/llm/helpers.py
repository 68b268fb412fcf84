"""Fixtures with odd rows, and brute-force versions of the operators."""

from __future__ import annotations

import random

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, w long, copies int, shard string, sig string, ids binary"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, ties, repeated
    rows and ids, and columns named as the operators' own."""
    long = words(40_000, 1)
    base = words(300, 2)
    texts = [
        (1, base, "en", "b"),
        (2, base, "en", "a"),
        (3, base + " " + words(60, 3), "en", None),
        (3, base + " " + words(60, 3), "en", None),
        (4, None, None, "a"),
        (5, "", "en", "c"),
        (6, " \t\n\x0b\x0c\r ", "en", "c"),
        (7, long, "de", "d"),
        (8, words(70, 4) + "\n" + " ".join(long.split()[100:180]), "de", "d"),
        (9, "one word", "fr", "\U0001f600"),
        (9, words(80, 5), "fr", "b"),
        (None, words(90, 6), "fr", "b"),
        (None, base, "es", None),
        (10, ("same line again\n" * 60).strip(), "es", "e"),
        (11, "Àé\x85 \xa0 it's don't <|endoftext|> 日本\U0001f600 " * 20, "es", "e"),
        (12, "#$% " * 80, None, "e"),
        (-5, words(55, 7).upper(), "en", "a"),
    ]
    return [(i, t, la, s, None if t is None else len(t), 7, 7, 7, 7, "x", "x", b"x") for i, t, la, s in texts]


def odd_docs(spark, path=None):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    if path is None:
        return df
    df.write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def real_docs(name: str = "documents", sf: str = SF) -> list[dict]:
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def split(text: str | None) -> list[str]:
    out, held = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if held:
                out.append(held)
            held = ""
        else:
            held += c
    return out + [held] * bool(held)
