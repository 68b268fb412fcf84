"""Spelling variants against brute force over all words."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from histscore.llm import spelling as S
from tests.llm.helpers import no_docs, odd_docs, odd_rows, real_docs


def brute_words(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, factor=10):
    found = {}
    for w in words:
        beside = [v for v in words if near(w, v)]
        best = min(beside, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= factor * words[w] else None
        found[w] = form, len(beside)
    rows = set()
    for w, (form, n_near) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        rows.add((w, form, root, words[w], n_near, words[form] if form else None))
    return rows


def planted(seed=4, size=150):
    """Words with edits of each kind at each place, chains of forms, shared
    beginnings and endings, and letters beyond ASCII."""
    r = random.Random(seed)
    alphabet = "abcéÿ×"
    words = {"".join(r.choice(alphabet) for _ in range(r.randint(6, 11))) for _ in range(size)}
    words |= {"common" + "".join(r.choice("abcd") for _ in range(5)) for _ in range(60)}
    for w in sorted(words):
        k = r.randrange(len(w))
        words.add(r.choice([w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "q" + w[k + 1 :]]))
    out = {w: r.choice([2, 3, 20, 30, 300]) for w in words if len(w) >= 7}
    chain = ["wanderin", "wandering", "wanderings", "wanderingso", "wanderingsoo"]
    return {**out, **{w: 2 * 10**k for k, w in enumerate(chain)}}


@pytest.mark.parametrize("hot", [20_000, 30, 0])
def test_pairs_and_forms(spark, hot):
    words = planted()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r.a, r.b) if r.a < r.b else (r.b, r.a) for r in S.near_pairs(df, hot=hot).collect()}
    ordered = sorted(words)
    assert got == {(a, b) for k, a in enumerate(ordered) for b in ordered[k + 1 :] if near(a, b)}


def test_crc_of_joined_texts():
    r = random.Random(1)
    firsts = [bytes(r.randrange(256) for _ in range(r.randint(0, 9))) for _ in range(500)]
    seconds = [bytes(r.randrange(256) for _ in range(r.choice([1, 2, 7, 8, 300]))) for _ in range(500)]
    crc = lambda xs: np.array([crc32(x) for x in xs], np.uint32)
    got = S.joined_crc(crc(firsts), crc(seconds), np.array([len(s) for s in seconds]))
    assert got.tolist() == [crc32(a + b) for a, b in zip(firsts, seconds)]


def test_counts_and_roots(spark, monkeypatch):
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(sorted(planted(5, 60).items())) if n < 3000]
    docs += [(10_000 + k, " ".join(["wanderingsoo"] * 4000)) for k in range(5)]
    monkeypatch.setattr(S, "HELD", 2000)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in S.spelling_variants(df).collect()} == brute(brute_words(docs))


def test_real_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in real_docs()[:60]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in S.spelling_variants(df).collect()} == brute(brute_words(docs))


def test_odd_and_empty_tables(spark):
    docs = [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 10_000]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in S.spelling_variants(df).collect()} == brute(brute_words(docs))
    words = brute_words([(r[0], r[1]) for r in odd_rows()])
    assert {(r.word, r.n) for r in S.spelling_variants(odd_docs(spark)).collect()} == set(words.items())
    assert S.spelling_variants(no_docs(spark)).count() == 0
